"""Grounding of claims against all spans of all documents, held against brute force."""

import random

from docloom.functions.similarity import best_partial_ratio, codes_of, partial_ratio
from docloom.plans.validation import grounding_partial


def test_best_partial_ratio():
    rng = random.Random(3)
    for _ in range(150):
        make = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
        a = make(rng.choice((1, 2, 7, 61, 62, 63, 90, 130)))
        texts = [make(len(a) + rng.randint(0, 160)) for _ in range(rng.randint(1, 4))]
        want = max(partial_ratio(a, t) for t in texts)
        assert abs(best_partial_ratio(a, codes_of(texts)) - want) < 1e-9
        assert best_partial_ratio(a, codes_of(texts), want + 1) == want + 1


def test_grounding_partial_searches_all(spark, tmp_path):
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(n))
    items = [words(12) for _ in range(6)] + [None, " "]
    texts = {i: words(30) for i in range(130)}
    texts[15] = words(40) + " " + items[0].upper() + " " + words(3)
    texts[3] = words(420) + " " + items[1] + " " + words(200)
    texts[120] = words(5) + " " + items[2][:20] + "x" + items[2][22:]
    texts[77], texts[78], texts[79] = None, "", items[3][:9]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    chunks = []
    for t in texts.values():
        w = (t or "").split()
        chunks += [t or ""] if len(w) <= 200 else [" ".join(w[i * 150 : i * 150 + 200]) for i in range(-(-(len(w) - 200) // 150) + 1)]
    want = {i: round(max(partial_ratio(x.lower(), c.lower()) for c in chunks) / 100, 4) for i, x in enumerate(items[:6])}
    rows = {r.claim_id: r for r in grounding_partial(spark, str(tmp_path)).collect()}
    assert len(rows) == 8 and {i: rows[i].score for i in want} == want
    assert want[0] == want[1] == 1.0 and rows[0].bucket == rows[2].bucket == "HIGH" and rows[6].score == 0.0
