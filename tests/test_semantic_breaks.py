"""Breaks between sentences: the operator against plain arithmetic, the query against its SQL."""

import math
import random

import pytest

from docloom import registry
from docloom.operators import chunking as C

registry.load()
_SCHEMA = "vec_id long, embedding array<float>, label int"


def distance(a, b):
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    return 1 - max(-1.0, min(1.0, dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))))


def breaks(vectors, percent=0.95):
    """(dist, gradient, part) of the sentences of one document."""
    d = [distance(a, b) for a, b in zip(vectors, vectors[1:])]
    last = len(d) - 1
    g = [(d[min(i + 1, last)] - d[max(i - 1, 0)]) / (2 if 0 < i < last else 1) for i in range(len(d))]
    at = last * percent
    low, high = sorted(g)[math.floor(at)], sorted(g)[math.ceil(at)]
    limit = low if low == high else low + (high - low) * (at - math.floor(at))
    return [(*x, sum(y > limit for y in g[:i])) for i, x in enumerate([*zip(d, g), (None, None)])]


def test_distances_are_not_rounded(spark):
    rng = random.Random(4)
    pool = [[float(rng.randint(1, 9)) for _ in range(6)] for _ in range(5)]
    docs = {"one": [[rng.randint(-9, 9) + 0.5 for _ in range(6)] for _ in range(50)], "copies": [rng.choice(pool) for _ in range(90)], "same": [pool[0]] * 30}
    rows = [(d, i, v) for d, l in docs.items() for i, v in enumerate(l)]
    out = C.semantic_breaks(spark.createDataFrame(rows, "doc_id string, ord int, vector array<double>")).collect()
    got = {(r.doc_id, r.ord): (r.dist, r.gradient, r.part) for r in out}
    assert got == {(d, i): x for d, l in docs.items() for i, x in enumerate(breaks(l))}


def _differs(spark, tmp_path, rows):
    """Rows of the query that are not its SQL's, and the other way round."""
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(map(str, con.execute(registry.ORACLE_SQL["semantic_breaks"]).fetchall()))
    got = sorted(str(tuple(r)) for r in registry.QUERIES["semantic_breaks"](spark, str(tmp_path)).collect())
    assert len(got) == len(want) == len(rows)
    return [(a, b) for a, b in zip(got, want) if a != b]


def test_query_rounds_once(spark, tmp_path):
    """Rounded to nine places and then to six, these distances are off by one in the last place."""
    pairs = ((1, 100), (23, 153), (37, 134), (75, 128), (91, 51), (94, 77))
    rows = [(2 * i + j, v, i) for i, (a, b) in enumerate(pairs) for j, v in enumerate(([1.0, 0.0], [float(a), float(b)]))]
    assert _differs(spark, tmp_path, rows) == []


def test_query_on_odd_vectors(spark, tmp_path):
    rng = random.Random(6)
    some = lambda: [rng.gauss(0, 1) for _ in range(4)]
    missing = [(i, None if i % 7 == 3 else some(), 0) for i in range(40)]
    zero = [(100 + i, [0.0] * 4 if i % 9 == 4 else some(), 1) for i in range(40)]
    empty = [(200, [], 2), (201, [], 2), (202, None, 2), (203, [], 2)]
    unnamed = [(300, some(), 3), (301, some(), 3), (None, some(), 3), (302, some(), 3), (400, some(), None), (401, some(), None), (500, some(), 5)]
    assert _differs(spark, tmp_path, missing + zero + empty + unnamed) == []
