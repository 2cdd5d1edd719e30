"""Stages against plain Python on the smallest table, and odd rows."""

import corpus_pipeline as C
from sheetseam.llm import latent_leaks, piece_table
from sheetseam.llm.queries import piece_model_path

SF = "/root/testdata/sf0.001"


def test_run(llm):
    docs = {r.doc_id: r for r in llm.read.parquet(f"{SF}/documents.parquet").collect()}
    out = C.run(llm, SF).collect()
    assert len({r.doc_id for r in out}) == len(out) and len(out) <= len(docs)
    table = piece_table.PieceTable(piece_table.model_bytes(piece_model_path()))
    for r in out:
        assert table.encode(r.text) == r.ids and r.n_tokens == len(r.ids) and r.lang is not None
    # near duplicates: one of each group by the plain comparison
    words = {i: r.text.encode().lower().split() for i, r in docs.items() if any(map(str.isalpha, r.text))}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} for i, w in words.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    firsts = {i for i in ids if find(i) == i}
    leaked = {r.doc_id for r in latent_leaks.leaks(llm.read.parquet(f"{SF}/documents.parquet"), llm.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    kept = {r.doc_id for r in out}
    assert kept <= firsts - leaked
    assert len((firsts - leaked) - kept) <= 0.01 * len(docs)  # what language ID rejects


def test_odd_rows(llm):
    rows = [(1, None, "en", "s", None, 1), (2, "", None, None, 0, 2), (3, "?? 12", "en", "s", 5, 3), (None, "the of and that with the", None, "s", 24, 4), (4, "the of and that with the", "en", "s", 24, 5), (4, "the of and that with the", "en", "s", 24, 5), (5, "the of and that with the", "en", "t", 24, 6)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int")
    for k, (_, stage) in enumerate(C.STAGES):
        before = docs.columns
        docs = stage(llm, docs, SF)
        if k < len(C.STAGES) - 1:
            assert docs.columns == before
            docs = llm.createDataFrame(docs.collect(), docs.schema)
    assert sorted((str(r.doc_id), r.text) for r in docs.collect()) == [("4", rows[4][1]), ("None", rows[3][1])]


def test_empty(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in C.STAGES:
        docs = stage(llm, docs, SF)
        assert docs.count() == 0
