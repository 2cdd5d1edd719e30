"""Copies are found whatever the number of items and their length."""

import random

from sheetseam.llm import latent_leaks


def test_more_items_than_the_rank(llm):
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randint(3, 9))) for _ in range(6000)]
    sentence = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [sentence(rnd.randint(20, 45)) for _ in range(2000)] + [sentence(n) for n in (65, 400, 1500)]
    docs, planted = [], set()
    for d in range(200):
        i = d * 10 if d < 190 else 2000 + d % 3
        text = sentence(rnd.randint(0, 120))
        at = rnd.randint(0, len(text))
        docs.append((d, " ".join(text[:at] + items[i] + text[at:])))
        planted.add((d, i))
    docs += [(1000 + d, " ".join(sentence(200))) for d in range(50)]
    df = llm.createDataFrame(docs, "doc_id long, text string")
    bench = llm.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in latent_leaks.leaks(df, bench).collect()}
    assert set(got) == planted
    assert all(r.lcs == 1 and r.cosine >= 0.3 for r in got.values())
