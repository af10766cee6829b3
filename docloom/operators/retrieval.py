"""Hybrid retrieval: child spans, BM25 over postings, exact cosine, fusion, parents of best children.

Children are (doc_id, child_no, text); questions are (query_id, query[, vector]). Many questions over
many documents run in one plan. Postings are joined to the questions' terms, which are few and broadcast
by Spark itself if their measured size allows; children without a term of a question are never paired
with it, but stand for a score of 0 in its range and, if candidates are short, in its candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docloom.config import DEFAULT, SCOPE_SECTION_TERMS, SCOPE_TEXT_PATTERN, SPEC_SECTION_TERMS, SPEC_TEXT_PATTERN, Config
from docloom.functions.text import any_contained, raw_words, words
from docloom.session import cut

CHILD = ("doc_id", "child_no")


#: Decimal places of scores. Scores are ranked as they are given out, so that children with equal texts tie
#: whatever the order of a sum, and ids decide.
PLACES = 9


def child_spans(parents: DataFrame, cfg: Config = DEFAULT, by: tuple[str, ...] = ()) -> DataFrame:
    """Parents' texts as (doc_id, child_no, text): up to child_words words as they are, longer ones in
    overlapping spans of words. Spans are made in the parent's row, so its words are not copied to each."""
    n, w = F.size("w"), F.col("w")
    last = F.greatest(F.lit(0), F.ceil((n - cfg.child_words) / cfg.child_stride)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * cfg.child_stride + 1, F.lit(cfg.child_words)), " "))
    spans = parents.select(*by, "doc_id", "text", raw_words(F.col("text")).alias("w"))
    spans = spans.select(*by, "doc_id", F.when(n <= cfg.child_words, F.array("text")).otherwise(parts).alias("parts"))
    return spans.select(*by, "doc_id", F.posexplode("parts").alias("child_no", "text"))


def _with(a: DataFrame, b: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Rows of ``a`` with those of ``b`` of the same collection; without ``by`` b is one row."""
    return a.join(b, list(by)) if by else a.join(b)


def postings(children: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, child_no, dl, term, tf), with columns ``by`` that name a collection. A child is one row, so its
    terms are counted there, as runs of its sorted words: no word is shuffled."""
    sorted_ = children.select(*by, *CHILD, F.sort_array(words(F.col("text"))).alias("w"))
    w, n = F.col("w"), F.size("w")
    begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(w, i - 1) != F.get(w, i - 2)))
    runs = sorted_.select(*by, *CHILD, "w", n.cast("long").alias("dl"), F.when(n > 0, begins).otherwise(F.array().cast("array<int>")).alias("begins"))
    at = F.col("begins")
    terms = F.transform(at, lambda x, i: F.struct(F.get(w, x - 1).alias("term"), (F.coalesce(F.get(at, i + 1), F.size(w) + 1) - x).cast("long").alias("tf")))
    return runs.select(*by, *CHILD, "dl", F.explode(terms).alias("t")).select(*by, *CHILD, "dl", "t.term", "t.tf")


def corpus_stats(children: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """n children and avgdl: one row, or one for each collection."""
    return children.select(*by, F.size(words(F.col("text"))).alias("dl")).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def term_idf(post: DataFrame, stats: DataFrame, cfg: Config = DEFAULT, by: tuple[str, ...] = ()) -> DataFrame:
    """(term, df, idf): Okapi idf; negative ones are epsilon times the mean idf of all terms."""
    df = _with(post.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df")), stats.select(*by, "n"), by)
    raw = df.select(*by, "term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.groupBy(*by).agg(F.avg("raw").alias("mean"))
    return _with(raw, mean, by).select(*by, "term", "df", F.when(F.col("raw") < 0, cfg.epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(post: DataFrame, stats: DataFrame, idf: DataFrame, questions: DataFrame, cfg: Config = DEFAULT, by: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, doc_id, child_no, score) of children with a term of the question; a term that a
    question repeats counts as often. With ``by`` a question meets its own collection only."""
    asked = questions.select(*by, "query_id", F.explode(words(F.col("query"))).alias("term")).groupBy(*by, "query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    hit = _with(post.join(asked.join(idf, [*by, "term"]), [*by, "term"]), stats.select(*by, "avgdl"), by)
    norm = F.col("tf") + cfg.k1 * (1 - cfg.b + cfg.b * F.col("dl") / F.col("avgdl"))
    part = F.col("times") * F.col("idf") * (F.col("tf") * (cfg.k1 + 1) / norm)
    return hit.groupBy("query_id", *CHILD).agg(F.round(F.sum(part), PLACES).alias("score"))


def min_max(scores: DataFrame, stats: DataFrame, questions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, low, high) over all children; one that is not in scores has 0."""
    seen = scores.groupBy("query_id").agg(F.min("score").alias("a"), F.max("score").alias("b"), F.count(F.lit(1)).alias("hits"))
    zero = F.col("hits") < F.col("n")
    return _with(questions.select(*by, "query_id").join(seen, "query_id", "left"), stats.select(*by, "n"), by).select(
        "query_id",
        F.when(F.col("hits").isNull(), 0.0).when(zero, F.least("a", F.lit(0.0))).otherwise(F.col("a")).alias("low"),
        F.when(F.col("hits").isNull(), 0.0).when(zero, F.greatest("b", F.lit(0.0))).otherwise(F.col("b")).alias("high"),
    )


def normalised(score: Column, low: Column, high: Column) -> Column:
    return F.when(high - low < 1e-9, F.lit(0.0)).otherwise((score - low) / (high - low))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """The cosine by which hits are ranked, to PLACES places; 0 without a direction."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.round(F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0)), PLACES)


def vector_topk(vectors: DataFrame, questions: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, doc_id, child_no, cos): each question's k nearest vectors, exactly; ties by id. With ``by``
    those of its own collection.

    The questions are a stated set against all vectors. Each task keeps k rows a question before the
    shuffle by question (WindowGroupLimit).
    """
    # A stated set of questions, so this is no join of a table with itself.
    scored = _with(vectors, questions.select(*by, "query_id", F.col("vector").alias("qv")), by).select("query_id", *CHILD, cosine(F.col("vector"), F.col("qv")).alias("cos"))
    order = W.partitionBy("query_id").orderBy(F.desc("cos"), *CHILD)
    return scored.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).drop("rn")


def top_scores(scores: DataFrame, children: DataFrame, questions: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, doc_id, child_no, score): each question's k best children by BM25, with the first
    children of score 0 where fewer have a score."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), *CHILD)
    best = scores.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).drop("rn")
    # k + k children at most are looked at for each question, so the first 2k by id are enough.
    if by:
        place = F.row_number().over(W.partitionBy(*by).orderBy(*CHILD))
        first = children.select(*by, *CHILD).withColumn("rn", place).filter(F.col("rn") <= 2 * k).drop("rn")
    else:
        first = children.select(*CHILD).orderBy(*CHILD).limit(2 * k)
    spare = _with(first, questions.select(*by, "query_id"), by).join(best.select("query_id", *CHILD), ["query_id", *CHILD], "left_anti").withColumn("score", F.lit(0.0))
    all_ = best.unionByName(spare.select("query_id", *CHILD, "score"))
    return all_.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).drop("rn")


def fuse(sparse: DataFrame, dense: DataFrame, scores: DataFrame, ranges: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(query_id, doc_id, child_no, score, bm25_score, embedding_score) of all candidates."""
    keys = ["query_id", *CHILD]
    candidates = sparse.select(*keys).union(dense.select(*keys)).distinct()
    joined = candidates.join(scores, keys, "left").join(dense, keys, "left").join(ranges, "query_id")
    bm = normalised(F.coalesce("score", F.lit(0.0)), F.col("low"), F.col("high"))
    out = joined.select(*keys, bm.alias("bm25_score"), F.coalesce("cos", F.lit(0.0)).alias("embedding_score"))
    return out.withColumn("score", F.round(cfg.bm25_weight * F.col("bm25_score") + cfg.dense_weight * F.col("embedding_score"), PLACES))


def best_parents(fused: DataFrame, k: int) -> DataFrame:
    """Each question's k best parents, by their best child; ties by id."""
    child = W.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "child_no")
    one = fused.withColumn("rn", F.row_number().over(child)).filter("rn = 1").drop("rn")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= k)


def scored_children(children: DataFrame, questions: DataFrame, cfg: Config = DEFAULT, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The scores of ``bm25`` and the ``corpus_stats``. Both are small beside the texts and are read several times
    by what follows, so they are made once: texts are not split into words again for ranges and candidates."""
    stats = cut(corpus_stats(children, by))
    post = postings(children, by)
    return cut(bm25(post, stats, term_idf(post, stats, cfg, by), questions, cfg, by)), stats


def hybrid_retrieve(
    children: DataFrame, vectors: DataFrame | None, questions: DataFrame, k: int = 10, only: Column | None = None, cfg: Config = DEFAULT, by: tuple[str, ...] = ()
) -> DataFrame:
    """(query_id, doc_id, child_no, score, bm25_score, embedding_score, rank).

    ``only`` filters children by their columns before anything is counted or ranked. With ``by``, columns
    that children, vectors and questions have, each question has a collection of its own: terms, ranges and
    candidates are that collection's. Without vectors the dense part is 0.
    """
    if only is not None:
        children = children.filter(only)
        vectors = vectors.join(children.select(*CHILD), list(CHILD), "left_semi") if vectors is not None else None
    scores, stats = scored_children(children, questions, cfg, by)
    limit = cfg.candidates * k
    sparse = top_scores(scores, children, questions, limit, by)
    if vectors is None:
        dense = sparse.select("query_id", *CHILD, F.lit(0.0).alias("cos")).filter(F.lit(False))
    else:
        dense = vector_topk(vectors, questions, limit, by)
    return best_parents(fuse(sparse, dense, scores, min_max(scores, stats, questions, by), cfg), k)


def spec_boost(cfg: Config = DEFAULT) -> Column:
    """Factor of a hit by chunk_type, section and text."""
    return (
        F.when(F.col("chunk_type") == "table", cfg.table_boost).otherwise(1.0)
        * F.when(any_contained(F.col("section"), SPEC_SECTION_TERMS), cfg.spec_section_boost).otherwise(1.0)
        * F.when(F.col("text").rlike("(?i)" + SPEC_TEXT_PATTERN), cfg.spec_text_boost).otherwise(1.0)
    )


def scope_boost(cfg: Config = DEFAULT) -> Column:
    return (
        F.when(F.col("chunk_type").isin("paragraph", "list"), cfg.scope_type_boost).otherwise(1.0)
        * F.when(any_contained(F.col("section"), SCOPE_SECTION_TERMS), cfg.scope_section_boost).otherwise(1.0)
        * F.when(F.col("text").rlike("(?i)" + SCOPE_TEXT_PATTERN), cfg.scope_text_boost).otherwise(1.0)
    )


def rerank(hits: DataFrame, boost: Column, k: int) -> DataFrame:
    """Hits with boosted scores, ranked anew, k for each question."""
    boosted = hits.withColumn("score", F.round(F.col("score") * boost, PLACES))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return boosted.withColumn("rank", rank).filter(F.col("rank") <= k)


def merge_queries(hits: DataFrame, k: int) -> DataFrame:
    """Hits of several queries (query_ord, rank, doc_id, score) of a question as one list: the first
    query that found a chunk gives its score."""
    first = W.partitionBy("query_id", "doc_id").orderBy("query_ord", "rank")
    one = hits.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn", "rank")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "query_ord", "doc_id"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= k)


def reciprocal_rank_fusion(hits: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """A merge that does not compare scores of different queries: sums of 1 / (constant + rank)."""
    summed = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), PLACES).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return summed.withColumn("rank", rank).filter(F.col("rank") <= k)
