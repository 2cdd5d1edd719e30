"""The latent space is fitted on every passage, and searched for every item."""

import random

import numpy as np

from sheetseam.llm import latent_leaks as L


def corpus(n, seed=3):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["É", "straße", "x_1"]
    sentence = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    return [sentence(rnd.choice([0, 1, 5, 15, 16, 17, 33, 150])) for _ in range(n)], [sentence(rnd.randint(10, 30)) for _ in range(12)]


def test_all_documents_fit_the_space_and_all_items_are_searched_in_it(llm, monkeypatch):
    texts, items = corpus(6000)
    fitted, searched = [], []
    space, finder = L.latent_space, L._finder

    def recorded_space(rows, *rest):
        fitted.append(rows.count())
        return space(rows, *rest)

    def recorded_finder(shared):
        searched.append((len(shared.value.latent), set(np.array(shared.value.of).tolist())))
        return finder(shared)

    monkeypatch.setattr(L, "latent_space", recorded_space)
    monkeypatch.setattr(L, "_finder", recorded_finder)
    monkeypatch.setattr(L, "FLOOR", 1.1)  # every item also goes to the index
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    L.with_leaks(docs, llm.createDataFrame(list(enumerate(items)), "item_id long, text string"), rank=4)
    assert fitted == [6000]
    assert searched == [(12, set(range(12)))]


def test_sums_over_all_passages(llm):
    texts, items = corpus(60)
    known = L.Items.of(list(enumerate(items)))
    n = len(known.terms)
    rng = np.random.default_rng(1)
    idf, basis = rng.random(n) + 0.5, rng.standard_normal((n, 5))
    rows = []
    for t in texts:
        ids = [known.terms.get(w.encode(), -1) for w in L.tokens(t)]
        blocks = [ids[k : k + L.STEP] for k in range(0, len(ids), L.STEP)]
        for p in [a + b for a, b in zip(blocks, blocks[1:], strict=False)] if len(blocks) > 1 else blocks:
            v, square = np.zeros(n), 0.0
            for x in p:
                if x >= 0:
                    v[x] += idf[x]
                    square += idf[x] ** 2
            rows.append(v / np.sqrt(max(square, 1e-12)))
    a = np.array(rows)
    numbered = L.numbered(llm.createDataFrame([(t,) for t in texts], "text string").repartition(3), known).select("ids")
    assert np.allclose(L._summed(numbered, idf, basis, True), a.T @ (a @ basis), rtol=1e-4, atol=1e-4)
    assert np.allclose(L._summed(numbered, idf, basis, False), (a @ basis).T @ (a @ basis), rtol=1e-4, atol=1e-4)


def test_long_repeats_add_up():
    rng = np.random.default_rng(5)
    for size, kinds in ((0, 3), (1, 1), (40, 3), (5000, 2), (5000, 700)):
        to = np.sort(rng.integers(0, kinds, size))
        rows, values = rng.integers(0, 50, size), rng.integers(0, 9, (50, 4)).astype(np.float32)
        plain = np.zeros((kinds, 4))
        np.add.at(plain, to, values[rows])
        at, sums = L.summed_by(to, rows, values)
        assert at.tolist() == np.unique(to).tolist()
        assert (plain[at] == sums).all()


def test_the_pipeline_fits_all_documents(llm, monkeypatch, tmp_path):
    import corpus_pipeline

    texts, items = corpus(2500)
    fitted = []
    space = L.latent_space

    def recorded(rows, *rest):
        fitted.append(rows.count())
        return space(rows, *rest)

    monkeypatch.setattr(L, "latent_space", recorded)
    llm.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(5000, "before " + items[3] + " after", "en"), (5001, None, "en"), (None, "w1 w2", None)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    got = corpus_pipeline.decontamination(llm, docs, str(tmp_path))
    assert got.columns == docs.columns
    ids = {r.doc_id for r in got.collect()}
    assert fitted == [2502]
    assert 5000 not in ids and {5001, None} <= ids and len(ids) > 2400
