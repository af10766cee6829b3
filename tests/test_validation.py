"""Grounding and validation."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions.similarity import partial_ratio, ratio
from docloom.functions.text import confidence_bucket
from docloom.operators import extraction as X, validation as V


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def best_window(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    m, n = len(a), len(b)
    return max(200 * lcs(a, b[max(0, s) : min(n, s + m)]) / (m + min(n, s + m) - max(0, s)) for s in range(1 - m, n))


def test_similarity_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))
        b = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))
        assert abs(partial_ratio(a, b) - best_window(a, b)) < 1e-9
        assert abs(ratio(a, b) - (200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100)) < 1e-9


def test_known_miss():
    q, c = "Concrete pump rental agreement terms and conditions", "The deadline for submission of tenders is January 15th."
    assert round(partial_ratio(q.lower(), c.lower()) / 100, 4) == 0.3913


def test_grounding(spark):
    claims = spark.createDataFrame([(1, 1, "steel bars"), (1, 2, "zzz"), (1, 3, None), (2, 4, "steel bars")], "grp int, claim_id int, quote string")
    chunks = spark.createDataFrame([(1, "All Steel Bars are new"), (1, "other")], "grp int, text string")
    got = {r.claim_id: r.score for r in V.grounding(claims, chunks, ["grp"]).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}


@pytest.mark.parametrize("score,bucket", [(0.95, "HIGH"), (0.9, "HIGH"), (0.75, "MEDIUM"), (0.3, "LOW")])
def test_bucket(spark, score, bucket):
    assert spark.range(1).select(confidence_bucket(F.lit(score))).first()[0] == bucket


def test_validate(spark):
    s = spark.createDataFrame([(1, "spec", 1.0), (1, "spec", 0.37), (2, "deliverable", 0.1)], "d int, kind string, score double")
    rows = {r.d: r for r in V.validate(s, "d").collect()}
    assert (rows[1].specs, rows[1].specs_rejected, rows[1].high, rows[1].accuracy) == (1, 1, 1, 100.0)
    assert (rows[2].deliverables_rejected, rows[2].accuracy) == (1, 0.0)


def test_repair_json(spark):
    raws = ['```json\n{"a": 1}\n```', 'x {"a": "l1\nl2"} y', "none", "} {", '{"a": ']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, r string")
    got = [r[0] for r in df.orderBy("i").select(X.repair_json(F.col("r"))).collect()]
    assert got == ['{"a": 1}', '{"a": "l1\\nl2"}', "none", "} {", '{"a":']


def test_salvage_and_retries():
    assert X.salvaged('{"s": [{"a": {"b": 1}}, {"c": 2}, {"d"', "s") == ['{"a": {"b": 1}}', '{"c": 2}']
    assert X.salvaged(None, "s") == [] and X.salvaged("{}", "s") == []
    calls, waits = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise ValueError
        return "ok"

    assert X.with_retries(flaky, 3, waits.append)("p") == "ok" and waits == [1.0, 2.0]


def test_near_copies(spark):
    h = spark.createDataFrame([(1, 1, 0.9, "the same text here"), (1, 2, 0.8, "The same text there"), (1, 3, 0.7, "something else")], "q int, i int, score double, text string")
    assert sorted(r.i for r in X.drop_near_copies(h, "q", "i").collect()) == [1, 3]
    assert [(r.a, r.b) for r in X.near_copy_pairs(h, "q", "i").collect()] == [(1, 2)]
