"""Retrieval queries over documents, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.config import DEFAULT, SCOPE_SECTION_TERMS, SCOPE_TEXT_PATTERN, SPEC_SECTION_TERMS, SPEC_TEXT_PATTERN
from docloom.functions.text import any_contained, expand_query, words
from docloom.operators import retrieval as R
from docloom.registry import query, table

#: (query_id, query, vec_id of its vector): stated questions in the corpus's invented languages.
QUESTIONS = (
    (0, "the and that with the thouea", 0),
    (1, "le la les des elle pour", 7),
    (2, "specification of material", 11),
    (3, "der die und in thbleor", 23),
)
K = 10
LIMIT = DEFAULT.candidates * K
TOPIC = "the thereof"


def questions(spark: SparkSession, sf: str) -> DataFrame:
    q = spark.createDataFrame(QUESTIONS, "query_id int, query string, vec_id long")
    return q.join(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector")), "vec_id", "left").select("query_id", "query", "vector")


def children(spark: SparkSession, sf: str) -> DataFrame:
    return R.child_spans(table(spark, sf, "documents"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("child_no"), F.col("embedding").alias("vector"))


def _values(rows) -> str:
    return ", ".join(f"({i}, '{q}', {v})" for i, q, v in rows)


def split_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


CHILDREN = f"""
doc_words AS MATERIALIZED (SELECT doc_id, text, {split_words('text')} AS w FROM source),
children AS MATERIALIZED (
  SELECT doc_id, cast(i AS INT) AS child_no,
    CASE WHEN len(w) <= 200 THEN text ELSE array_to_string(list_slice(w, i * 150 + 1, i * 150 + 200), ' ') END AS text
  FROM (SELECT doc_id, text, w, unnest(range(0, cast(greatest(0, ceil((len(w) - 200) / 150.0)) AS BIGINT) + 1)) AS i FROM doc_words)),
tokens AS MATERIALIZED (SELECT doc_id, child_no, {split_words('lower(text)')} AS w FROM children),
post AS MATERIALIZED (
  SELECT doc_id, child_no, dl, term, count(*) AS tf
  FROM (SELECT doc_id, child_no, len(w) AS dl, unnest(w) AS term FROM tokens) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tokens),
raw AS MATERIALIZED (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM post, stats GROUP BY term),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def scored(source: str = "documents", queries: str = _values(QUESTIONS)) -> str:
    """CTEs from the questions to the best parents."""
    where = "" if source == "documents" else " WHERE EXISTS (SELECT 1 FROM children c WHERE c.doc_id = vec_id AND c.child_no = 0)"
    return f"""
WITH source AS (SELECT * FROM {source}), questions(query_id, query, vec_id) AS (VALUES {queries}), {CHILDREN},
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({split_words('lower(query)')}) AS term FROM questions) GROUP BY ALL),
scores AS MATERIALIZED (
  SELECT query_id, doc_id, child_no, round(sum(times * idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25 + 0.75::DOUBLE * dl / avgdl)))), 9) AS score
  FROM post JOIN asked USING (term) JOIN idf USING (term), stats GROUP BY ALL),
ranges AS (
  SELECT q.query_id,
    CASE WHEN hits IS NULL THEN 0.0 WHEN hits < n THEN least(a, 0.0) ELSE a END AS low,
    CASE WHEN hits IS NULL THEN 0.0 WHEN hits < n THEN greatest(b, 0.0) ELSE b END AS high
  FROM questions q LEFT JOIN (SELECT query_id, min(score) AS a, max(score) AS b, count(*) AS hits FROM scores GROUP BY 1) s USING (query_id), stats),
cosines AS (
  SELECT query_id, e.vec_id AS doc_id, 0 AS child_no, round(list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS cos
  FROM questions q JOIN embeddings v USING (vec_id), (SELECT * FROM embeddings{where}) e),
dense AS (SELECT * FROM cosines QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, doc_id, child_no) <= {LIMIT}),
every AS (
  SELECT q.query_id, c.doc_id, c.child_no, coalesce(s.score, 0.0) AS score
  FROM questions q CROSS JOIN children c LEFT JOIN scores s ON s.query_id = q.query_id AND s.doc_id = c.doc_id AND s.child_no = c.child_no),
sparse AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, child_no) <= {LIMIT}),
candidates AS (SELECT query_id, doc_id, child_no FROM sparse UNION SELECT query_id, doc_id, child_no FROM dense),
parts AS (
  SELECT c.query_id, c.doc_id, c.child_no,
    CASE WHEN high - low < 1e-9 THEN 0.0 ELSE (coalesce(s.score, 0.0) - low) / (high - low) END AS bm25_score,
    coalesce(d.cos, 0.0) AS embedding_score
  FROM candidates c LEFT JOIN scores s USING (query_id, doc_id, child_no) LEFT JOIN dense d USING (query_id, doc_id, child_no) JOIN ranges USING (query_id)),
fused AS (SELECT *, round(0.35::DOUBLE * bm25_score + 0.65::DOUBLE * embedding_score, 9) AS score FROM parts),
one AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, child_no) = 1),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM one)
"""


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"}).withColumns({c: F.col(c).cast("long") for c in ("rank",) if c in df.columns})


HITS = "SELECT query_id, doc_id, child_no, round(score, 6) AS score, round(bm25_score, 6) AS bm25_score, round(embedding_score, 6) AS embedding_score, rank FROM hits"
_C = f"WITH source AS (SELECT * FROM documents), {CHILDREN}"


@query(_C + " SELECT doc_id, child_no, text FROM children")
def child_spans(spark, sf):
    return children(spark, sf)


@query(f"SELECT doc_id, len(w) AS n_words, list_distinct(w).len() AS n_terms, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {split_words('lower(text)')} AS w FROM documents)")
def tokenize(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", words(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_terms"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@query(_C + " SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_index(spark, sf):
    c = children(spark, sf)
    return rounded(R.term_idf(R.postings(c), R.corpus_stats(c)))


def _scores(spark, sf):
    q = questions(spark, sf)
    return *R.scored_children(children(spark, sf), q), q


@query(scored() + "SELECT query_id, doc_id, child_no, round(score, 6) AS score FROM scores")
def bm25_scores(spark, sf):
    return rounded(_scores(spark, sf)[0])


@query(scored() + "SELECT query_id, doc_id, child_no, round(CASE WHEN high - low < 1e-9 THEN 0.0 ELSE (score - low) / (high - low) END, 6) AS norm FROM scores JOIN ranges USING (query_id)")
def minmax_norm(spark, sf):
    scores, stats, q = _scores(spark, sf)
    joined = scores.join(R.min_max(scores, stats, q), "query_id")
    return rounded(joined.select("query_id", "doc_id", "child_no", R.normalised(F.col("score"), F.col("low"), F.col("high")).alias("norm")))


@query(
    f"""SELECT query_id, doc_id, 0 AS child_no, round(cos, 6) AS cos
FROM (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS cos
  FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, embeddings e)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, doc_id) <= {LIMIT}"""
)
def vector_topk(spark, sf):
    """Queries are the vectors whose id is divisible by 100, against all."""
    asked = table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return rounded(R.vector_topk(vectors(spark, sf), asked, LIMIT))


def _candidates(spark, sf):
    scores, stats, q = _scores(spark, sf)
    sparse = R.top_scores(scores, children(spark, sf), q, LIMIT)
    return sparse, R.vector_topk(vectors(spark, sf), q, LIMIT), scores, R.min_max(scores, stats, q)


@query(scored() + "SELECT * FROM candidates")
def candidate_union(spark, sf):
    sparse, dense, _, _ = _candidates(spark, sf)
    keys = ["query_id", "doc_id", "child_no"]
    return sparse.select(*keys).union(dense.select(*keys)).distinct()


@query(scored() + "SELECT query_id, doc_id, child_no, round(score, 6) AS score, round(bm25_score, 6) AS bm25_score, round(embedding_score, 6) AS embedding_score FROM fused")
def hybrid_fusion(spark, sf):
    return rounded(R.fuse(*_candidates(spark, sf)))


@query(scored() + f"{HITS} WHERE rank <= {K}")
def parent_child_topk(spark, sf):
    return rounded(R.best_parents(R.fuse(*_candidates(spark, sf)), K))


@query(scored() + f"{HITS} WHERE rank <= {K}")
def hybrid_retrieve(spark, sf):
    return rounded(R.hybrid_retrieve(children(spark, sf), vectors(spark, sf), questions(spark, sf), K))


EN = "(SELECT * FROM documents WHERE lang = 'en')"


@query(scored(EN) + f"{HITS} WHERE rank <= {K}")
def retrieve_filtered(spark, sf):
    c = R.child_spans(table(spark, sf, "documents").filter("lang = 'en'"))
    return rounded(R.hybrid_retrieve(c, vectors(spark, sf), questions(spark, sf), K, only=F.col("doc_id").isNotNull()))


_TYPES = "CASE d.doc_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'paragraph' ELSE 'list' END"
_SECTIONS = "CASE d.doc_id % 4 WHEN 0 THEN 'Scope of Work' WHEN 1 THEN 'Technical data' WHEN 2 THEN NULL ELSE 'Unknown' END"


def _described(spark, sf, hits):
    """Hits with chunk_type, section and text of their document."""
    d = table(spark, sf, "documents").alias("d").selectExpr("doc_id", f"{_TYPES} AS chunk_type", f"{_SECTIONS} AS section", "text")
    return hits.join(d, "doc_id")


def _rerank_sql(kind: str) -> str:
    contains = lambda terms: " OR ".join(f"contains(lower(coalesce(section, '')), '{t}')" for t in terms)
    if kind == "spec":
        terms, pattern, types, a, b, c = SPEC_SECTION_TERMS, SPEC_TEXT_PATTERN, "'table'", 1.15, 1.15, 1.10
    else:
        terms, pattern, types, a, b, c = SCOPE_SECTION_TERMS, SCOPE_TEXT_PATTERN, "'paragraph', 'list'", 1.10, 1.20, 1.10
    return (
        scored()
        + f""", described AS (SELECT h.*, {_TYPES} AS chunk_type, {_SECTIONS} AS section, d.text FROM hits h JOIN documents d USING (doc_id) WHERE rank <= {2 * K}),
boosted AS (
  SELECT query_id, doc_id, round(score * (CASE WHEN chunk_type IN ({types}) THEN {a}::DOUBLE ELSE 1.0 END) * (CASE WHEN {contains(terms)} THEN {b}::DOUBLE ELSE 1.0 END)
    * (CASE WHEN regexp_matches(text, '(?i){pattern}') THEN {c}::DOUBLE ELSE 1.0 END), 9) AS score FROM described)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM boosted
QUALIFY rank <= {K}"""
    ).replace(f"<= {LIMIT})", f"<= {2 * LIMIT})")


def _reranked(spark, sf, boost):
    hits = R.hybrid_retrieve(children(spark, sf), vectors(spark, sf), questions(spark, sf), 2 * K)
    return rounded(R.rerank(_described(spark, sf, hits), boost, K).select("query_id", "doc_id", "score", "rank"))


@query(_rerank_sql("spec"))
def rerank_spec(spark, sf):
    return _reranked(spark, sf, R.spec_boost())


@query(_rerank_sql("scope"))
def rerank_scope(spark, sf):
    return _reranked(spark, sf, R.scope_boost())


@query(scored() + f"{HITS} WHERE rank <= 8")
def qa_retrieve(spark, sf):
    return rounded(R.hybrid_retrieve(children(spark, sf), vectors(spark, sf), questions(spark, sf), K)).filter("rank <= 8")


@query(
    "SELECT doc_id, "
    + " OR ".join(f"contains(lower(text), '{t}')" for t in SPEC_SECTION_TERMS)
    + " AS spec_term, "
    + " OR ".join(f"contains(lower(text), '{t}')" for t in SCOPE_SECTION_TERMS)
    + f" AS scope_term, regexp_matches(text, '(?i){SPEC_TEXT_PATTERN}') AS spec_text, regexp_matches(text, '(?i){SCOPE_TEXT_PATTERN}') AS scope_text FROM documents"
)
def term_flags(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        any_contained(t, SPEC_SECTION_TERMS).alias("spec_term"),
        any_contained(t, SCOPE_SECTION_TERMS).alias("scope_term"),
        t.rlike("(?i)" + SPEC_TEXT_PATTERN).alias("spec_text"),
        t.rlike("(?i)" + SCOPE_TEXT_PATTERN).alias("scope_text"),
    )


_EXPAND = """trim(q || coalesce(' ' || nullif(concat_ws(' ',
  CASE WHEN contains(lower(q), 'specification') AND NOT contains(lower(q), 'specs') THEN 'specs' END,
  CASE WHEN contains(lower(q), 'specification') AND NOT contains(lower(q), 'standard') THEN 'standard' END,
  CASE WHEN contains(lower(q), 'material') AND NOT contains(lower(q), 'grade') THEN 'grade' END,
  CASE WHEN contains(lower(q), 'material') AND NOT contains(lower(q), 'alloy') THEN 'alloy' END,
  CASE WHEN contains(lower(q), 'dimension') AND NOT contains(lower(q), 'size') THEN 'size' END,
  CASE WHEN contains(lower(q), 'dimension') AND NOT contains(lower(q), 'diameter') THEN 'diameter' END), ''), ''))"""
_PARTS = "p_name || CASE p_partkey % 4 WHEN 0 THEN ' Specification tolerance material' WHEN 1 THEN ' dimension and size' WHEN 2 THEN ' Material grade' ELSE '' END"


@query(f"SELECT p_partkey, q, {_EXPAND} AS expanded FROM (SELECT p_partkey, {_PARTS} AS q FROM part)", name="expand_query")
def expanded_queries(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey", f"{_PARTS} AS q").withColumn("expanded", expand_query(F.col("q")))


#: A question's variants, as the session asks them: itself, expanded, and after the topic.
VARIANTS = tuple((i * 10 + k, text, v) for i, q, v in QUESTIONS for k, text in enumerate((q, q + " specs standard grade alloy" if "specification" in q else q, f"{TOPIC} {q}")))


def _merged_sql(k: int, final: int) -> str:
    return scored(queries=_values(VARIANTS)).replace(f"<= {LIMIT})", f"<= {5 * k})") + f"""
, firsts AS (
  SELECT query_id // 10 AS query_id, query_id % 10 AS query_ord, rank, doc_id, score FROM hits WHERE rank <= {k}
  QUALIFY row_number() OVER (PARTITION BY query_id // 10, doc_id ORDER BY query_id % 10, rank) = 1)
SELECT query_id, query_ord, doc_id, round(score, 6) AS score, place AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, query_ord, doc_id) AS place FROM firsts) WHERE place <= {final}"""


def _variants(spark, sf) -> DataFrame:
    asked = spark.createDataFrame(QUESTIONS, "query_id int, query string, vec_id long")
    q = F.col("query")
    each = asked.select("query_id", "vec_id", F.posexplode(F.array(q, expand_query(q), F.concat(F.lit(TOPIC + " "), q))).alias("query_ord", "query"))
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return each.join(v, "vec_id", "left").select((F.col("query_id") * 10 + F.col("query_ord")).alias("query_id"), "query", "vector")


def _merged(spark, sf, k, final):
    hits = R.hybrid_retrieve(children(spark, sf), vectors(spark, sf), _variants(spark, sf), k)
    ordered = hits.select(F.floor(F.col("query_id") / 10).cast("int").alias("query_id"), (F.col("query_id") % 10).alias("query_ord"), "rank", "doc_id", "score")
    return rounded(R.merge_queries(ordered, final))


@query(_merged_sql(8, 8))
def qa_multi_query(spark, sf):
    return _merged(spark, sf, 8, 8)


@query(_merged_sql(15, 15))
def multi_query_merge(spark, sf):
    return _merged(spark, sf, 15, 15)


@query(_merged_sql(8, 8).split(", firsts AS (")[0] + f""", fusions AS (SELECT query_id // 10 AS query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM hits WHERE rank <= 8 GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fusions QUALIFY rank <= 8""")
def rank_fusion(spark, sf):
    hits = R.hybrid_retrieve(children(spark, sf), vectors(spark, sf), _variants(spark, sf), 8)
    return rounded(R.reciprocal_rank_fusion(hits.withColumn("query_id", F.floor(F.col("query_id") / 10).cast("int")), 8))


@query(scored().replace(f"<= {LIMIT})", "<= 75)") + "SELECT DISTINCT query_id // 2 AS grp, doc_id FROM hits WHERE rank <= CASE WHEN query_id < 2 THEN 15 ELSE 10 END")
def grounding_corpus(spark, sf):
    """What claims are held against: 15 hits of the first two questions, 10 of the others, each chunk once."""
    hits = R.hybrid_retrieve(children(spark, sf), vectors(spark, sf), questions(spark, sf), 15)
    return hits.filter(F.col("rank") <= F.when(F.col("query_id") < 2, 15).otherwise(10)).select(F.floor(F.col("query_id") / 2).cast("int").alias("grp"), "doc_id").distinct()
