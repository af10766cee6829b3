"""Validation and grounding queries over part, benchmark, documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docloom.functions import text as X
from docloom.functions.similarity import lcs_length
from docloom.operators import validation as V
from docloom.operators.retrieval import child_spans
from docloom.registry import query, table

_COMPONENT = "CASE p_partkey % 6 WHEN 0 THEN '12.5' WHEN 1 THEN '  ' || p_name || ' ' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN cast(p_size AS {s}) ELSE p_type END"
_SPEC = "CASE p_partkey % 4 WHEN 0 THEN p_type || ' - : ' || p_name WHEN 1 THEN 'ab: ' || p_name WHEN 2 THEN ' NOT_FOUND ' ELSE NULL END"
_UNIT = "CASE p_partkey % 3 WHEN 0 THEN ' nos ' WHEN 1 THEN '' ELSE 'NOT_FOUND' END"
_CONFIDENCE = "CASE p_partkey % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN '0.75' WHEN 2 THEN NULL WHEN 3 THEN '1.5' ELSE '0.25' END"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _found(x: str) -> str:
    return f"nullif(nullif({_strip(x)}, ''), 'NOT_FOUND')"


def specs(spark, sf) -> DataFrame:
    """Parts as specifications, every other one in the legacy shape."""
    now = "p_partkey % 2 = 0"
    return table(spark, sf, "part").selectExpr(
        "p_partkey",
        f"CASE WHEN {now} THEN {_COMPONENT.format(s='STRING')} END AS component",
        f"CASE WHEN {now} THEN map('specification', {_SPEC}, 'unit', {_UNIT}, 'brand', p_brand) END AS specs",
        f"CASE WHEN NOT {now} THEN {_COMPONENT.format(s='STRING')} END AS item_name",
        f"{_SPEC} AS specification_text",
        f"{_UNIT} AS unit",
        "cast(p_size AS STRING) AS numeric_value",
        "cast(NULL AS STRING) AS tolerance",
        "'' AS standard_reference",
        "p_type AS material",
        "CASE WHEN p_partkey % 3 = 0 THEN cast(p_size AS STRING) WHEN p_partkey % 3 = 1 THEN 'x' END AS page",
        "cast(NULL AS STRING) AS chunk_id",
        "cast(NULL AS STRING) AS clause",
        "p_name AS exact_text",
        f"{_CONFIDENCE} AS confidence",
    )


def _component_sql(name: str, text: str) -> str:
    left = f"regexp_replace(split_part(coalesce({text}, ''), ':', 1), '^[ \\-•\t]+|[ \\-•\t]+$', '', 'g')"
    clean = _strip(f"coalesce({name}, '')")
    return f"""CASE WHEN {clean} <> '' AND NOT regexp_matches(regexp_replace({clean}, '^([^.]*)\\.', '\\1'), '^[0-9]+$') AND regexp_matches({clean}, '\\p{{L}}') THEN {clean}
  WHEN contains(coalesce({text}, ''), ':') AND length({left}) >= 4 AND regexp_matches({left}, '\\p{{L}}') THEN left({left}, 80)
  WHEN coalesce({text}, '') <> '' THEN {_strip(f'left({text}, 80)')} WHEN {clean} <> '' THEN {clean} ELSE 'NOT_FOUND' END"""


def _entries(m: str) -> F.Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e.key, F.lit("="), e.value)), ";")


@query(f"SELECT p_partkey, concat_ws(';', 'brand=' || p_brand, 'specification=' || {_found(_SPEC)}, 'unit=' || {_found(_UNIT)}) AS specs FROM part")
def specs_map_clean(spark, sf):
    m = table(spark, sf, "part").selectExpr("p_partkey", f"map('specification', {_SPEC}, 'unit', {_UNIT}, 'brand', p_brand) AS m")
    return m.select("p_partkey", V.clean_map(F.col("m")).alias("m")).select("p_partkey", _entries("m").alias("specs"))


@query(f"SELECT p_partkey, {_component_sql('c', 's')} AS component FROM (SELECT p_partkey, {_COMPONENT.format(s='VARCHAR')} AS c, {_found(_SPEC)} AS s FROM part)")
def component_normalize(spark, sf):
    c = table(spark, sf, "part").selectExpr("p_partkey", f"{_COMPONENT.format(s='STRING')} AS c", f"{_SPEC} AS s")
    return c.select("p_partkey", V.normalise_component(F.col("c"), X.found(F.col("s"))).alias("component"))


@query(
    f"""WITH s AS (
  SELECT p_partkey, p_partkey % 2 = 0 AS now, {_COMPONENT.format(s='VARCHAR')} AS c, {_found(_SPEC)} AS spec, {_found(_UNIT)} AS unit, {_CONFIDENCE} AS conf, * EXCLUDE (p_partkey) FROM part),
n AS (SELECT *, CASE WHEN now AND c IS NOT NULL THEN c WHEN now THEN 'NOT_FOUND' ELSE {_strip("coalesce(nullif(c, ''), 'NOT_FOUND')")} END AS name FROM s)
SELECT p_partkey, {_component_sql('name', 'spec')} AS component,
  CASE WHEN now AND c IS NOT NULL THEN concat_ws(';', 'brand=' || p_brand, 'specification=' || spec, 'unit=' || unit)
    WHEN now THEN concat_ws(';', 'brand=' || p_brand, 'material=' || p_type, 'numeric_value=' || cast(p_size AS VARCHAR), 'specification=' || spec, 'unit=' || unit)
    ELSE concat_ws(';', 'material=' || p_type, 'numeric_value=' || cast(p_size AS VARCHAR), 'specification=' || spec, 'unit=' || unit) END AS specs,
  CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END AS page, p_name AS exact_text, coalesce(try_cast(conf AS DOUBLE), 0.5) AS confidence
FROM n"""
)
def spec_shape_normalize(spark, sf):
    n = V.normalise_specs(specs(spark, sf))
    return n.select("p_partkey", "component", _entries("specs").alias("specs"), "page", "exact_text", "confidence")


@query(
    f"""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN ' ' ELSE p_name END AS component, coalesce(try_cast({_CONFIDENCE} AS DOUBLE), 0.5) AS confidence FROM part)
SELECT p_partkey, CASE WHEN {_strip('component')} = '' THEN 'component' WHEN confidence < 0 OR confidence > 1 THEN 'confidence' END AS fault FROM n"""
)
def schema_quarantine(spark, sf):
    n = table(spark, sf, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 4 = 3 THEN ' ' ELSE p_name END AS component", f"coalesce(try_cast({_CONFIDENCE} AS DOUBLE), 0.5D) AS confidence")
    return V.quarantine(n).select("p_partkey", "fault")


@query(f"SELECT p_partkey, CASE WHEN {_strip('u')} = '' THEN 'NOT_FOUND' ELSE u END AS unit FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE p_type END AS u FROM part)")
def enforce_not_found(spark, sf):
    u = table(spark, sf, "part").selectExpr("p_partkey", "CASE p_partkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE p_type END AS u")
    return u.select("p_partkey", V.enforce_not_found(F.col("u")).alias("unit"))


@query("SELECT item_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(trim(b.text))) GROUP BY 1")
def grounding_contains(spark, sf):
    """The exact path of grounding, all claims against all chunks; claims are the stated, small set."""
    claims = table(spark, sf, "benchmark").select("item_id", F.lower(F.trim("text")).alias("quote"))
    docs = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))
    return docs.join(claims, F.contains("t", F.col("quote"))).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


_LCS = """WITH RECURSIVE pairs AS (SELECT DISTINCT lower(p_name) AS a, lower(p_type || ' ' || p_brand) AS b FROM part),
dp AS (
  SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0::BIGINT) AS r FROM pairs
  UNION ALL
  SELECT a, b, i + 1, list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc, CASE WHEN a[i + 1] = b[j] THEN r[j] + 1 ELSE greatest(r[j + 1], acc[j]) END), [0::BIGINT]) FROM dp WHERE i < length(a))
SELECT a, b, r[length(b) + 1] AS lcs, round(200.0::DOUBLE * r[length(b) + 1] / (length(a) + length(b)), 6) AS ratio FROM dp WHERE i = length(a)"""


@query(_LCS)
def grounding_lcs(spark, sf):
    from docloom.session import ship

    ship(spark)
    pairs = table(spark, sf, "part").select(F.lower("p_name").alias("a"), F.lower(F.concat_ws(" ", "p_type", "p_brand")).alias("b")).distinct()
    out = pairs.withColumn("lcs", lcs_length("a", "b"))
    return out.withColumn("ratio", F.round(200.0 * F.col("lcs") / (F.length("a") + F.length("b")), 6))


def scored_claims(spark, sf) -> DataFrame:
    """Benchmark items as claims against all spans of all documents."""
    claims = table(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"), V.quote(F.col("text"), F.lit(None).cast("string")).alias("quote"))
    return V.grounding_in_all(claims, child_spans(table(spark, sf, "documents")))


@query()
def grounding_partial(spark, sf):
    return scored_claims(spark, sf).select("claim_id", F.round("score", 4).alias("score"), X.confidence_bucket(F.col("score")).alias("bucket"))


_SCORES = "SELECT doc_id % 20 AS grp, CASE WHEN doc_id % 3 = 0 THEN 'deliverable' ELSE 'spec' END AS kind, ((doc_id * 37) % 101) / 100.0::DOUBLE AS score FROM labels"


def _scores(spark, sf):
    return table(spark, sf, "labels").selectExpr("doc_id % 20 AS grp", "CASE WHEN doc_id % 3 = 0 THEN 'deliverable' ELSE 'spec' END AS kind", "((doc_id * 37) % 101) / 100.0D AS score")


@query("SELECT score, CASE WHEN score >= 0.9 THEN 'HIGH' WHEN score >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS bucket, count(*) AS n FROM (" + _SCORES + ") GROUP BY 1, 2")
def confidence_bucket(spark, sf):
    s = _scores(spark, sf)
    return s.groupBy("score", X.confidence_bucket(F.col("score")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_OK = "score >= 0.4 - 1e-9"


@query(
    f"""SELECT grp, count(*) FILTER ({_OK} AND kind = 'spec') AS specs, count(*) FILTER (NOT ({_OK}) AND kind = 'spec') AS specs_rejected,
  count(*) FILTER ({_OK} AND kind <> 'spec') AS deliverables, count(*) FILTER (NOT ({_OK}) AND kind <> 'spec') AS deliverables_rejected,
  count(*) FILTER ({_OK} AND kind = 'spec' AND score >= 0.9) AS high, count(*) FILTER ({_OK} AND kind = 'spec' AND score >= 0.6 AND score < 0.9) AS medium,
  count(*) FILTER ({_OK} AND kind = 'spec' AND score < 0.6) AS low, coalesce(round(avg(score) FILTER ({_OK}) * 100, 2), 0.0) AS accuracy
FROM ({_SCORES}) GROUP BY 1"""
)
def validate_aggregate(spark, sf):
    return V.validate(_scores(spark, sf), "grp")


@query(f"SELECT CASE WHEN score >= 0.9 THEN 'HIGH' WHEN score >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS bucket, count(*) AS n, count(*) FILTER (NOT ({_OK})) AS rejected FROM ({_SCORES}) GROUP BY 1")
def confidence_histogram(spark, sf):
    s = _scores(spark, sf)
    return s.groupBy(X.confidence_bucket(F.col("score")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~V.is_accepted(F.col("score"))).alias("rejected"))


_LIST = "[p_name, NULL, ' ', p_type, '']"


@query(f"SELECT p_partkey, array_to_string(list_filter({_LIST}, lambda x: x IS NOT NULL AND {_strip('x')} <> ''), '|') AS kept FROM part")
def scope_lists_clean(spark, sf):
    kept = V.clean_list(F.array("p_name", F.lit(None).cast("string"), F.lit(" "), "p_type", F.lit("")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(kept, "|").alias("kept"))
