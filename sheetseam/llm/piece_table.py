"""SentencePiece encoding and decoding by a prefix table of last tokens.

For every prefix of a text the encoding has one last token.  It is found among the pieces that an
Aho-Corasick automaton reports as ending there: the one that is *compatible* with the last token of
the prefix before it, i.e. merging the two tokens' text from scratch gives just these two tokens.
Walking back from the end of the text through the last tokens yields the ids.  The decoded text is put together from the ids' pieces.

A text is cut into units that no piece can cross (no piece holds a ``▁`` after another character,
and none holds a line feed); this is checked when the vocabulary is loaded.  Runs of ``▁`` carry equal
scores, where the uniqueness argument does not hold, so units that contain such a run are merged
directly.  Characters outside the vocabulary become their UTF-8 byte pieces.

Null text: null ids and null text out of ``encode``; empty text: only the end id.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from operator import add, itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import returned

SPACE = "▁"
_UNITS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
#: Units in each of the two generations kept per worker (results do not depend on it).
CACHE_UNITS = 300_000
#: The same where a worker goes on to other work, which needs the memory.
CACHE_UNITS_BRIEF = 50_000


#: Numbers from here on are characters without a piece.
LONE = 1 << 21
#: Stands before a word that follows a line feed, not a space.
BARE = "\x00"
_IDS, _TEXT = itemgetter(0), itemgetter(1)


class PieceTable:
    def __init__(self, model: bytes, cached: int = CACHE_UNITS) -> None:
        self.cached = cached
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        t, n = proto.trainer_spec, proto.normalizer_spec
        if t.model_type != 2 or not t.byte_fallback or n.name != "identity" or n.precompiled_charsmap:
            raise ValueError("only merge-type models with byte fallback and no normalisation are supported")
        if not n.add_dummy_prefix or n.remove_extra_whitespaces or t.treat_whitespace_as_suffix:
            raise ValueError("only models with a leading space marker and kept white space are supported")
        self.pieces, self.ids, self.score, self.byte_ids = [], {}, {}, [0] * 256
        self.byte_of: dict[int, int] = {}
        self.hidden: set[int] = set()
        for i, p in enumerate(proto.pieces):
            self.pieces.append(p.piece)
            if p.type == 1:
                self.ids[p.piece], self.score[p.piece] = i, p.score
            elif p.type == 6:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.byte_of[i] = int(p.piece[1:-1], 16)
            elif p.type == 2:
                self.unk_id = i
            elif p.type == 3:
                self.hidden.add(i)
            else:
                raise ValueError("models with user-defined or unused pieces are not supported")
        self.eos, self.unk_surface = t.eos_id, t.unk_surface
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("a piece crosses a unit boundary")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.whole: dict[str, bool] = {}
        #: What ``compatible`` said, by the two tokens' numbers.
        self.known: dict[int, bool] = {}
        self.split: dict[str, tuple[str, str]] = {}
        #: Character pairs inside some piece; no merge can cross any other pair.
        self.joints = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.units: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self._end = array("i", [self.eos]).tobytes()
        self.shown = [p.replace(SPACE, " ") for p in self.pieces]
        self.length = [len(p) for p in self.pieces]
        #: Ids that do not simply show their piece.
        self.odd = np.zeros(len(self.pieces), dtype=bool)
        self.odd[[*self.byte_of, *self.hidden, self.unk_id]] = True
        self.plain = [None if o else t for o, t in zip(self.odd.tolist(), self.shown, strict=True)]

    def merged(self, text: str) -> list[str]:
        """Plain merging: best score first, leftmost among equals."""
        if len(text) > 32:
            return self._merged_by_queue(text)
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merged_by_queue(self, text: str) -> list[str]:
        """The same for long texts: possible merges wait in a queue, parts are linked to their neighbours."""
        parts: list[str | None] = list(text)
        n, score = len(parts), self.score
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n:
                both = parts[i] + parts[j]
                s = score.get(both)
                if s is not None:
                    heappush(queue, (-s, i, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, both = heappop(queue)
            j = after[i]
            if parts[i] is None or j >= n or parts[i] + parts[j] != both:
                continue  # one of the two has been merged since
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def halves(self, token: str) -> tuple[str, str]:
        """The two parts whose merge forms the token last."""
        known = self.split.get(token)
        if known is None:
            parts, score = list(token), self.score
            while len(parts) > 2:
                _, at = max((score.get(parts[i] + parts[i + 1], float("-inf")), -i) for i in range(len(parts) - 1))
                parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
            known = self.split[token] = (parts[0], parts[1])
        return known

    def compatible(self, a: str, b: str) -> bool:
        """Would merging the text of ``a`` and ``b`` stop at exactly these two tokens?

        The merges that form the two tokens are undone, latest first; the tokens stay apart if at no
        moment the piece across the boundary would have been merged before the step just undone."""
        if not a:
            known = self.whole.get(b)
            if known is None:
                known = self.whole[b] = self.merged(b) == [b]
            return known
        score, least, tie, x, y = self.score, float("-inf"), False, a, b
        while True:
            s = score.get(x + y)
            if s is not None and (s > least or tie and s == least):
                return False
            if len(x) == 1 and len(y) == 1:
                return True
            if len(x) > 1 and (len(y) == 1 or score[x] < score[y]):
                least, tie, x = score[x], False, self.halves(x)[1]
            else:
                least, tie, y = score[y], True, self.halves(y)[0]

    def last_tokens(self, text: str) -> list[int]:
        """The last token of each non-empty prefix, as its id, or ``LONE`` plus the character for one without a piece."""
        last: list[int] = []
        known, at = self.known, 0  # at: prefixes decided so far
        for end, (token, n) in self.automaton.iter(text):
            if end < at:
                continue  # decided by a longer piece
            while at < end:
                last.append(self._lone(text, at))
                at += 1
            start = end + 1 - n
            pair = (last[start - 1] << 22 | token) if start else ~token
            fits = known.get(pair)
            if fits is None:
                if len(known) > 2 * self.cached:
                    known.clear()
                before = last[start - 1] if start else None
                fits = known[pair] = self.compatible("" if before is None else self.pieces[before] if before < LONE else chr(before - LONE), self.pieces[token])
            if fits:
                last.append(token)
                at = end + 1
        while at < len(text):
            last.append(self._lone(text, at))
            at += 1
        return last

    def _lone(self, text: str, at: int) -> int:
        if text[at] in self.ids:
            raise AssertionError(f"no last token for a prefix of {text!r}")
        return LONE + ord(text[at])

    def unit(self, text: str) -> tuple[bytes, str]:
        """Ids of a unit as four-byte numbers and the text that these ids show."""
        ids = self._cut(text) if text else ()
        try:
            shown = "".join(map(self.plain.__getitem__, ids))
        except TypeError:  # a byte piece, a control or the unknown id
            shown = self._shown(np.array(ids, np.intc))
        return array("i", ids).tobytes(), shown

    def word(self, word: str) -> tuple[bytes, str]:
        """The unit of a word (see ``_words``), from the last two generations of the cache if it is there."""
        got = self.units.get(word) or self.older.pop(word, None)
        if got is None:
            got = self.unit(word if word == "\n" else word[1:] if word[:1] == BARE else SPACE + word)
        if len(word) < 64:
            if len(self.units) >= self.cached:
                self.older, self.units = self.units, {}
            self.units[word] = got
        return got

    def _cut(self, text: str) -> tuple[int, ...]:
        """Ids of a unit, cut where no merge can cross."""
        joints = self.joints
        edges = [i for i, pair in enumerate(map(add, text, text[1:]), 1) if pair not in joints]
        if not edges:
            return self.from_table(text)
        edges = [0, *edges, len(text)]
        ids: list[int] = []
        for i, j in zip(edges, edges[1:], strict=False):
            part = text[i:j]
            got = self.parts.get(part)
            if got is None:
                got = self.from_table(part)
                if len(part) < 64:
                    if len(self.parts) >= self.cached:
                        self.parts.clear()
                    self.parts[part] = got
            ids += got
        return tuple(ids)

    def from_table(self, text: str) -> tuple[int, ...]:
        out: list[int] = []
        if SPACE + SPACE in text:
            tokens = [self.ids.get(t, t) for t in self.merged(text)]
        else:
            last, i, tokens = self.last_tokens(text), len(text), []
            while i:
                token = last[i - 1]
                tokens.append(token if token < LONE else text[i - 1])
                i -= self.length[token] if token < LONE else 1
            tokens.reverse()
        for token in tokens:
            if isinstance(token, str):
                out.extend(self.byte_ids[b] for b in token.encode("utf-8"))
            else:
                out.append(token)
        return tuple(out)

    def packed(self, text: str) -> tuple[bytes, str]:
        """Ids as four-byte numbers, with the end id, and the text that they decode to.

        A unit's ids are decoded once with it: byte pieces of a character never lie in two units, so the units' texts make the whole; the first marker
        goes, if the first piece begins with it."""
        if BARE in text:
            found = list(map(self.unit, _UNITS.findall(SPACE + text.replace(" ", SPACE))))
        else:
            words = _words(text)
            found = list(map(self.units.get, words))
            if None in found:
                for k, got in enumerate(found):
                    if got is None:
                        found[k] = self.word(words[k])
        ids = b"".join(map(_IDS, found)) + self._end
        shown = "".join(map(_TEXT, found))
        starts_marked = bool(text) and self.pieces[int.from_bytes(ids[:4], sys.byteorder)].startswith(SPACE)
        return ids, shown[starts_marked:]

    def encode(self, text: str, end: bool = True) -> list[int]:
        ids = array("i", self.packed(text)[0]).tolist()
        return ids if end else ids[:-1]

    def _shown(self, ids: np.ndarray) -> str:
        """Texts of the ids; stretches without byte pieces, control and unknown ids are joined at once."""
        shown, byte_of, out, raw, at = self.shown.__getitem__, self.byte_of, [], bytearray(), 0
        listed = ids.tolist()
        for k in np.flatnonzero(self.odd[ids]).tolist():
            i = listed[k]
            if raw and (k > at or i not in byte_of):
                out.append(_utf8(raw))
                raw = bytearray()
            out.extend(map(shown, listed[at:k]))
            if i in byte_of:
                raw.append(byte_of[i])
            elif i == self.unk_id:
                out.append(self.unk_surface)
            at = k + 1
        if raw:
            out.append(_utf8(raw))
        out.extend(map(shown, listed[at:]))
        return "".join(out)

    def decode(self, ids) -> str:
        ids = np.asarray(ids, dtype=np.intc)
        text = self._shown(ids)
        first = next((i for i in map(int, ids) if i not in self.hidden), None)
        return text[1:] if first is not None and first not in self.byte_of and self.pieces[first].startswith(SPACE) else text


def _words(text: str) -> list[str]:
    """The units of a text without ``BARE``: a word stands for the marker and itself, after ``BARE`` for itself alone, a line feed for itself.

    Where no two markers meet, cutting at the spaces gives them; the empty word is a marker alone, ``BARE`` alone is nothing."""
    if not text:
        return []
    if "  " in text or text[0] == " " or SPACE in text:
        units = _UNITS.findall(SPACE + text.replace(" ", SPACE))
        return [u[1:] if u[0] == SPACE else u if u == "\n" else BARE + u for u in units]
    return text.replace("\n", " \n " + BARE).split(" ")


def _utf8(raw: bytearray) -> str:
    """UTF-8 with one replacement character per byte that is not part of a valid character."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(raw[i : i + n]).decode("utf-8"))
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


_TABLES: dict[int, PieceTable] = {}


def _table(model: bytes, cached: int) -> PieceTable:
    key = hash(model)
    if key not in _TABLES or _TABLES[key].cached != cached:
        _TABLES.clear()
        _TABLES[key] = PieceTable(model, cached)
    return _TABLES[key]


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def with_ids(df: DataFrame, text: str, model_path: str, ids: str = "ids", decoded: str = "decoded", *, keep_cache: bool = False) -> DataFrame:
    """``df`` plus ``ids`` (array<int>, with an end id) and ``decoded`` (the ids' text).

    The vocabulary file (about half a megabyte, whatever the corpus) is read on the driver and sent
    to the executors.  Null texts give null; other columns pass unchanged; a column that already has
    one of the two names is replaced.  ``keep_cache`` keeps a worker's cache of units for its next task (less work,
    about 150 MB more in workers that go on to other work)."""
    sc = df.sparkSession.sparkContext
    model = sc.broadcast(model_bytes(model_path))
    PieceTable(model.value)  # fail early on an unsupported model

    @F.pandas_udf("ids array<int>, decoded string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = _table(model.value, CACHE_UNITS if keep_cache else CACHE_UNITS_BRIEF)
        for batch in texts:
            both = [(None, None) if x is None else t.packed(x) for x in batch]
            ids = [None if b is None else np.frombuffer(b, np.intc) for b, _ in both]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([d for _, d in both], dtype=object)})
        if not keep_cache:  # a worker outlives its task and may do quite other work next
            t = ids = both = None
            _TABLES.clear()
            returned(pd.DataFrame())

    kept = [F.col(f"`{c}`") for c in df.columns if c not in (ids, decoded)]
    both = df.select(*kept, run(F.col(f"`{text}`")).alias("__pieces"))
    names = [F.col(f"`{c}`") for c in df.columns if c not in (ids, decoded)]
    return both.select(*names, F.col("__pieces.ids").alias(ids), F.col("__pieces.decoded").alias(decoded))


def digest(ids: Column, decoded: Column) -> list[Column]:
    """Number of ids, and SHA-256 of the ids as decimals joined by a space and of the decoded text."""
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids, " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decoded.cast("binary"), 256).alias("decoded_sha256"),
    ]
