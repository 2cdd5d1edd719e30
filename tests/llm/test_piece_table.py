"""Ids and texts equal those of the sentencepiece library."""

import hashlib
import random
import time
from array import array

import pytest

from sheetseam.llm import piece_table
from sheetseam.llm.queries import piece_model_path

sentencepiece = pytest.importorskip("sentencepiece")
SCHEMA = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def both():
    path = piece_model_path()
    return piece_table.PieceTable(piece_table.model_bytes(path)), sentencepiece.SentencePieceProcessor(model_file=path)


def test_random_texts(both):
    table, library = both
    rnd = random.Random(5)
    assert table.encode("ab" * 3000) == library.encode("ab" * 3000, add_eos=True)
    letters = "abcdefghi ▁\n\t  éßñ日本𠀀.,!12<>  theingon"
    for _ in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        ids = library.encode(text, add_eos=True)
        assert table.encode(text) == ids, repr(text)
        assert table.packed(text)[1] == table.decode(ids) == library.decode(ids), repr(text)


def test_runs_of_spaces_and_long_words(both):
    table, library = both
    rnd = random.Random(8)
    texts = [" " * 100_000, "a" + " " * 5000 + "b" + "▁" * 37, "the" * 2000, "\n" * 300 + "  \n   x"]
    texts += ["".join(rnd.choice(["  ", "   a", "th", "e", "▁", "日", "\n", " " * 40]) for _ in range(60)) for _ in range(300)]
    for text in texts:
        began = time.time()
        ids, decoded = table.packed(text)
        assert time.time() - began < 2
        want = library.encode(text, add_eos=True)
        assert array("i", ids).tolist() == want, repr(text[:50])
        assert decoded == table.decode(want) == library.decode(want)


def test_random_ids(both):
    table, library = both
    rnd = random.Random(6)
    for _ in range(2000):
        ids = [rnd.randrange(32000) if rnd.random() < 0.5 else rnd.randrange(260) for _ in range(rnd.randint(0, 12))]
        assert table.decode(ids) == library.decode(ids), ids


def test_pair_test_is_merging(both):
    """The boundary test says what merging both tokens' text from scratch does."""
    table, _ = both
    rnd = random.Random(7)
    tokens = [p for p in table.ids if "▁▁" not in p and table.merged(p) == [p]]
    ends: dict = {}
    for p in tokens:
        ends.setdefault(p[0], []).append(p)
    for _ in range(20000):
        a, b = rnd.choice(tokens), rnd.choice(tokens)
        if "▁" in b:
            continue
        assert table.compatible(a, b) == (table.merged(a + b) == [a, b]), (a, b)


def test_frame(llm, both):
    _, library = both
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b\n c  d", None), (3, "a b\n c  d", None), (None, "word " * 20000, "z")]
    df = llm.createDataFrame(rows, SCHEMA)
    out = piece_table.with_ids(df, "text", piece_model_path())
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = {r.text: r for r in out.collect()}
    assert got[None].ids is None and got[None].decoded is None
    assert got[""].ids == [2] and got[""].decoded == ""
    for _, text, _ in rows[2:]:
        assert got[text].ids == library.encode(text, add_eos=True)
        assert got[text].decoded == text
    digest = out.where("text IS NOT NULL").select("text", *piece_table.digest(out.ids, out.decoded)).collect()
    for r in digest:
        ids = library.encode(r.text, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert piece_table.with_ids(df.where("doc_id > 5"), "text", piece_model_path()).count() == 0


def test_decoded_text_is_read_from_the_ids(both):
    """The decoded text shows what the ids stand for, not the text that was encoded."""
    table = piece_table.PieceTable(piece_table.model_bytes(piece_model_path()))
    text = "the theme 日𠀀 of the\x00 day"
    ids = both[0].encode(text)
    assert both[0].packed(text)[1] == text == both[1].decode(ids)
    table.shown[ids[0]] = table.plain[ids[0]] = " THE"
    assert table.packed(text)[1].startswith("THE")


def test_words_cut_at_spaces_are_the_units(both):
    table, library = both
    BARE, _words = piece_table.BARE, piece_table._words
    whole = "to be\nor not \nto  be"
    assert _words("to be\n or \nnot ") == ["to", "be", "\n", BARE, "or", "", "\n", BARE + "not", ""]
    for text in (whole, " a", "a ", "\na", "a\n", "\n", " ", "  ", "a \n b", "a\n\n b", f"a{BARE}b c", f"{BARE}a a", "a▁ b", "▁", "a\n▁b", "é\n漢 x"):
        for _ in range(2):  # the second time from the cache
            ids = library.encode(text, add_eos=True)
            assert table.encode(text) == ids, repr(text)
            assert table.packed(text)[1] == library.decode(ids), repr(text)
