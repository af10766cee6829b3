"""Retrieval against a plain BM25 and cosine."""

import math
from collections import Counter

from pyspark.sql import functions as F

from docloom.operators import retrieval as R

TEXTS = {1: "steel bar grade fe500 steel", 2: "cement bag grade", 3: "the the deadline for tenders", 4: ""}


def children(spark):
    return spark.createDataFrame([(k, 0, t) for k, t in TEXTS.items()], "doc_id long, child_no int, text string")


def okapi(query):
    docs = {k: t.lower().split() for k, t in TEXTS.items()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    out = {}
    for k, d in docs.items():
        tf = Counter(d)
        out[k] = sum(idf.get(q, 0) * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(d) / avg)) for q in query.split() if tf[q])
    return out


def test_bm25(spark):
    c = children(spark)
    q = spark.createDataFrame([(0, "steel grade grade"), (1, "nothing")], "query_id int, query string")
    post, stats = R.postings(c), R.corpus_stats(c)
    got = {(r.query_id, r.doc_id): r.score for r in R.bm25(post, stats, R.term_idf(post, stats), q).collect()}
    expected = {(0, k): v for k, v in okapi("steel grade grade").items()}
    assert got.keys() <= expected.keys() and all(abs(got.get(k, 0) - v) < 1e-9 for k, v in expected.items())


def test_hybrid_prefers_the_match(spark):
    c = children(spark)
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.6, 0.8]), (3, 0, [0.0, 1.0])], "doc_id long, child_no int, vector array<float>")
    q = spark.createDataFrame([(0, "steel reinforcement grade", [1.0, 0.1])], "query_id int, query string, vector array<float>")
    hits = R.hybrid_retrieve(c, v, q, 2).orderBy("rank").collect()
    assert [h.doc_id for h in hits] == [1, 2] and abs(hits[0].bm25_score - 1) < 1e-9
    only = R.hybrid_retrieve(c, v, q, 2, only=F.col("doc_id") != 1).orderBy("rank").collect()
    assert [h.doc_id for h in only][0] == 2


def test_child_spans_cover_words(spark):
    words = [f"w{i}" for i in range(505)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "a  b"), (3, "")], "doc_id long, text string")
    got = R.child_spans(df).orderBy("doc_id", "child_no").collect()
    one = [r.text.split() for r in got if r.doc_id == 1]
    assert [len(x) for x in one] == [200, 200, 200, 55] and one[1][0] == "w150"
    assert [r.text for r in got if r.doc_id > 1] == ["a  b", ""]


def test_merge_takes_the_first_query(spark):
    h = spark.createDataFrame([(0, 0, 1, 7, 0.2), (0, 1, 1, 7, 0.9), (0, 1, 2, 8, 0.5)], "query_id int, query_ord int, rank int, doc_id int, score double")
    assert [(r.doc_id, r.score, r["rank"]) for r in R.merge_queries(h, 5).orderBy("rank").collect()] == [(8, 0.5, 1), (7, 0.2, 2)]
