"""Every label can be predicted, however many there are."""

from sheetseam.llm import language_id


def test_seventy_labels(llm):
    rows = [(70 * k + i, f"l{i:02d}", " ".join(chr(0x4E00 + 20 * i + (k * j) % 20) * 2 for j in range(1, 30))) for i in range(70) for k in range(1, 9)]
    df = llm.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.train(df, "text", "lang", "doc_id")
    assert model.labels == [f"l{i:02d}" for i in range(70)]
    out = language_id.predict(df, "text", model).collect()
    assert len({r.lang_pred for r in out}) == 70 and sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)
