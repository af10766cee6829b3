"""Extraction, scoring and read-side queries over conversations, events, part, supplier and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docloom.operators import extraction as X, scoring as S
from docloom.registry import query, table

BUDGET = 200


def _turns(spark, sf) -> DataFrame:
    """Turns as hits: a conversation is a question, a page is two turns."""
    return table(spark, sf, "conversations").selectExpr("conv_id", "turn", "text", "cast(floor(turn / 2) AS INT) AS page", "cast(turn % 3 AS DOUBLE) AS score", "CASE role WHEN 'assistant' THEN 'Unknown' ELSE role END AS section")


@query(
    f"""WITH RECURSIVE l AS (SELECT conv_id, list(turn ORDER BY turn) AS ids, list(greatest(1, length(text) // 4) ORDER BY turn) AS t FROM conversations GROUP BY 1),
walk AS (
  SELECT conv_id, 1 AS i, 0 AS batch, t[1] AS n FROM l
  UNION ALL
  SELECT w.conv_id, i + 1, CASE WHEN n + t[i + 1] > {BUDGET} AND n > 0 THEN batch + 1 ELSE batch END, CASE WHEN n + t[i + 1] > {BUDGET} AND n > 0 THEN t[i + 1] ELSE n + t[i + 1] END
  FROM walk w JOIN l USING (conv_id) WHERE i < len(t))
SELECT conv_id, ids[i] AS turn, batch FROM walk JOIN l USING (conv_id)"""
)
def context_batches(spark, sf):
    return X.context_batches(_turns(spark, sf), ["conv_id"], ["turn"], BUDGET).select("conv_id", "turn", "batch")


_CONTEXT = """
t AS (SELECT conv_id, turn, text, turn // 2 AS page, turn % 3 AS score, CASE role WHEN 'assistant' THEN 'Unknown' ELSE role END AS section FROM conversations),
p AS (SELECT *, lag(section) OVER (PARTITION BY conv_id ORDER BY page, score, turn) AS prior FROM t),
c AS (
  SELECT conv_id, string_agg((CASE WHEN section IS NOT NULL AND section IS DISTINCT FROM prior AND section NOT IN ('', 'Unknown', 'Table') THEN chr(10) || '[Section: ' || section || ']' || chr(10) || chr(10) ELSE '' END)
    || '[p.' || cast(page AS VARCHAR) || '] ' || text, chr(10) || chr(10) ORDER BY page, score, turn) AS context FROM p GROUP BY 1)"""


@query(f"WITH {_CONTEXT.strip()} SELECT conv_id, md5(context) AS digest, length(context) AS n FROM c")
def context_build(spark, sf):
    c = X.context(_turns(spark, sf), "conv_id", "turn")
    return c.select("conv_id", F.md5(F.col("context").cast("binary")).alias("digest"), F.length("context").cast("long").alias("n"))


@query()
def neardup_pairs(spark, sf):
    """Turns beside copies of them with a word more, so that each conversation has pairs."""
    t = _turns(spark, sf)
    copies = t.withColumns({"turn": F.col("turn") + 1000, "text": F.concat(F.lit("Again "), F.col("text"))})
    return X.near_copy_pairs(t.unionByName(copies), "conv_id", "turn").withColumn("ratio", F.round("ratio", 4))


@query()
def neardup_greedy(spark, sf):
    return X.drop_near_copies(_turns(spark, sf), "conv_id", "turn").select("conv_id", "turn")


SYSTEM = "You extract technical specifications from tender documents. Answer with JSON only."


@query(f"SELECT item_id, '<|system|>' || chr(10) || '{SYSTEM}<|end|>' || chr(10) || '<|user|>' || chr(10) || 'Context:' || chr(10) || text || '<|end|>' || chr(10) || '<|assistant|>' AS prompt FROM benchmark")
def prompt_build(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.prompt(SYSTEM, F.concat(F.lit("Context:\n"), F.col("text"))).alias("prompt"))


_RAW = "CASE event_id % 4 WHEN 0 THEN '```json' || {n} || props || {n} || '```' WHEN 1 THEN 'Sure: ' || props || ' done' WHEN 2 THEN 'no json {{here' ELSE '  ' || props END"


@query(
    "WITH r AS (SELECT event_id, " + _RAW.format(n="chr(10)") + """ AS raw FROM events),
b AS (SELECT event_id, regexp_replace(regexp_replace(raw, '```(?:json)?', '', 'g'), '^\\s+|\\s+$', '', 'g') AS x FROM r)
SELECT event_id, CASE WHEN strpos(x, '{') > 0 AND strpos(x, '}') > 0 THEN regexp_extract(x, '\\{[\\s\\S]*\\}') ELSE x END AS repaired FROM b"""
)
def json_repair(spark, sf):
    r = table(spark, sf, "events").selectExpr("event_id", _RAW.format(n="'\\n'") + " AS raw")
    return r.select("event_id", X.repair_json(F.col("raw")).alias("repaired"))


@query("SELECT event_id, unnest([0, 1])::INT AS ord, '{\"k\": ' || json_extract_string(props, '$.k') || '}' AS object FROM events")
def json_salvage(spark, sf):
    X.register_salvage(spark)
    e = table(spark, sf, "events").selectExpr("event_id", """concat('{"items": [', props, ', ', props, ', {"k": ', cast(event_id AS STRING)) AS raw""")
    e.createOrReplaceTempView("cut_off")
    return spark.sql("SELECT event_id, ord, object FROM cut_off, LATERAL salvage_json(raw, 'items')")


_SPECS = "SELECT p_partkey, p_brand, CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE ' ' || upper(p_name) || ' ' END AS component FROM part"


@query(f"SELECT p_partkey, p_brand FROM (SELECT *, lower(trim(component)) AS k FROM ({_SPECS})) QUALIFY k = '' OR row_number() OVER (PARTITION BY p_brand, k ORDER BY p_partkey) = 1")
def specs_dedupe(spark, sf):
    s = table(spark, sf, "part").selectExpr("p_partkey", "p_brand", "CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE ' ' || upper(p_name) || ' ' END AS component")
    return X.first_components(s, "p_brand", ["p_partkey"]).select("p_partkey", "p_brand")


@query(
    """WITH s AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS summary, unnest([p_name, p_type, '']) AS item, unnest([1, 2, 3]) AS i FROM part),
f AS (SELECT p_brand, item, min((p_partkey, i)) AS k FROM s WHERE item <> '' GROUP BY ALL)
SELECT p_brand, (SELECT arg_min(summary, p_partkey) FROM s WHERE s.p_brand = f.p_brand AND summary <> '') AS summary, string_agg(item, ';' ORDER BY k) AS deliverables, count(*) AS n FROM f GROUP BY p_brand"""
)
def scope_merge(spark, sf):
    none = "cast(array() AS array<string>)"
    s = table(spark, sf, "part").selectExpr("p_brand", "p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS summary", "array(p_name, p_type, '') AS deliverables", f"{none} AS exclusions", f"{none} AS locations", f"{none} AS references")
    m = X.merge_scopes(s, "p_brand", "p_partkey")
    return m.select("p_brand", "summary", F.array_join("deliverables", ";").alias("deliverables"), F.size("deliverables").cast("long").alias("n"))


@query(
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'NOT_FOUND' WHEN event_id % 5 = 1 THEN 'plain' ELSE event_type END AS answer,
  CASE WHEN event_id % 5 = 0 OR event_id % 5 = 1 THEN 'LOW' WHEN event_id % 5 = 2 THEN 'HIGH' ELSE 'LOW' END AS confidence FROM events"""
)
def qa_no_evidence(spark, sf):
    a = table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE WHEN event_id % 5 = 0 THEN 0 ELSE 3 END AS n_hits",
        """CASE event_id % 5 WHEN 1 THEN 'plain' WHEN 2 THEN concat('{"answer": "', event_type, '", "confidence": "HIGH"}') ELSE concat('x {"answer": "', event_type, '"} y') END AS raw""",
    )
    return X.answer_or_default(a).select("event_id", "answer", "confidence")


@query()
def rule_extract(spark, sf):
    """The whole way of an answer: context, prompt, extractor, repair, specifications."""
    hits = table(spark, sf, "part").selectExpr("p_brand", "p_partkey", "cast(p_size AS INT) AS page", "1.0D AS score", "'Unknown' AS section", "p_name || ': ' || p_type AS text")
    prompts = X.context(hits, "p_brand", "p_partkey").select("p_brand", X.prompt(SYSTEM, F.col("context")).alias("prompt"))
    answers = X.extract(prompts).withColumn("j", F.from_json(X.repair_json(F.col("answer")), "technical_specifications array<struct<component:string,specs:map<string,string>,source:struct<exact_text:string>>>"))
    specs = answers.select("p_brand", F.posexplode("j.technical_specifications").alias("ord", "s")).select("p_brand", "ord", "s.component", F.col("s.specs")["specification"].alias("specification"))
    return X.first_components(specs, "p_brand", ["ord"])


@query(
    """WITH g AS (SELECT p_brand, list(p_type ORDER BY p_partkey) AS d, list(p_name ORDER BY p_partkey) AS c FROM part GROUP BY 1)
SELECT p_brand, 'Scope Summary: ' || p_brand || chr(10) || 'Deliverables: ' || array_to_string(d[1:5], ', ') || chr(10) || 'Key Components: ' || array_to_string(c[1:10], ', ') AS summary FROM g"""
)
def tender_summary(spark, sf):
    ordered = lambda c: F.transform(F.slice(F.array_sort(F.collect_list(F.struct("p_partkey", c))), 1, 10), lambda x: x[c])
    g = table(spark, sf, "part").groupBy("p_brand").agg(ordered("p_type").alias("d"), ordered("p_name").alias("c"))
    return g.select("p_brand", S.tender_summary(F.col("p_brand"), F.col("d"), F.col("c")).alias("summary"))


_MATCH = """SELECT o_orderkey, s_suppkey, cast(o_totalprice AS DOUBLE) AS cost, cast(s_acctbal * 50 AS DOUBLE) AS budget, {needs} AS needs, {caps} AS capabilities, {excl} AS exclusions,
  o_orderstatus AS location, {locs} AS locations FROM orders JOIN supplier ON s_suppkey = o_custkey % 100"""
_A = dict(needs="[o_orderpriority, o_orderstatus]", caps="[CASE WHEN s_nationkey % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END, 'F']", excl="[CASE WHEN s_nationkey % 5 = 0 THEN '3-MEDIUM' ELSE 'none' END]", locs="['O', 'P']")


@query(
    f"""WITH m AS ({_MATCH.format(**_A)})
SELECT o_orderkey, s_suppkey, CASE WHEN list_has_any(needs, exclusions) THEN 0 ELSE cast(floor(60 * (len(list_intersect(needs, capabilities)) / cast(len(needs) AS DOUBLE)) + CASE WHEN list_contains(locations, location) THEN 20 ELSE 0 END + CASE WHEN cost <= budget THEN 20 ELSE 0 END + 0.5) AS INT) END AS match_score,
  CASE WHEN budget IS NULL THEN 'Unknown' WHEN cost <= 0.5 * budget THEN 'High' WHEN cost <= budget THEN 'Medium' ELSE 'Low' END AS cost_feasibility FROM m"""
)
def match_score_baseline(spark, sf):
    for t in ("orders", "supplier"):
        table(spark, sf, t).createOrReplaceTempView(t)
    m = spark.sql(_MATCH.format(**{k: "array(" + v[1:-1] + ")" for k, v in _A.items()}))
    return S.baseline_match(m).select("o_orderkey", "s_suppkey", "match_score", "cost_feasibility")


@query("SELECT event_id, CASE WHEN s > 70 THEN 'green' WHEN s > 40 THEN 'yellow' ELSE 'red' END AS band FROM (SELECT event_id, least(greatest(cast(floor(value * 5) AS INT) - 10, 0), 100) AS s FROM events)")
def score_band(spark, sf):
    return table(spark, sf, "events").select("event_id", S.score_band(F.floor(F.col("value") * 5) - 10).alias("band"))


@query("SELECT page_id, 'qa_' || left(regexp_extract(url, '([^/]*)$', 1), 20) || '_' || left(md5(url), 10) AS key FROM pages")
def index_key(spark, sf):
    stem = F.substring(F.regexp_extract("url", "([^/]*)$", 1), 1, 20)
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("qa_"), stem, F.lit("_"), F.substring(F.md5(F.col("url").cast("binary")), 1, 10)).alias("key"))


_CONF = "CASE event_id % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'Low' WHEN 3 THEN '0.5' WHEN 4 THEN '7' ELSE 'x' END"


@query(f"SELECT event_id, CASE WHEN try_cast(c AS DOUBLE) IS NOT NULL THEN greatest(0.0, least(1.0, try_cast(c AS DOUBLE))) WHEN upper(c) = 'HIGH' THEN 0.9 WHEN upper(c) = 'MEDIUM' THEN 0.65 WHEN upper(c) = 'LOW' THEN 0.35 ELSE 0.0 END::DOUBLE AS confidence FROM (SELECT event_id, {_CONF} AS c FROM events)")
def confidence_to_number(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", f"{_CONF} AS c").select("event_id", S.confidence_number(F.col("c")).alias("confidence"))


@query("SELECT p_partkey, 'size: ' || cast(p_size AS VARCHAR) || ', type: ' || p_type || ', brand: ' || p_brand AS summary, CASE WHEN p_size / 50.0 >= 0.8 THEN 'high' WHEN p_size / 50.0 >= 0.5 THEN 'medium' ELSE 'low' END AS bucket FROM part")
def specs_summary(spark, sf):
    m = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"), F.lit("name"), F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", S.first_entries(m).alias("summary"), S.display_bucket(F.col("p_size") / 50.0).alias("bucket"))


@query("SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END, ''), 'NOT_FOUND') AS summary, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name || ';' || p_brand END AS deliverables, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE '' END AS exclusions FROM part")
def scope_legacy_normalize(spark, sf):
    s = table(spark, sf, "part").selectExpr(
        "p_partkey",
        "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS summary",
        "CASE WHEN p_partkey % 2 = 0 THEN array(p_type) ELSE cast(array() AS array<string>) END AS deliverables",
        "array(named_struct('task_description', p_name), named_struct('task_description', p_brand), named_struct('task_description', '')) AS tasks",
        "cast(NULL AS array<string>) AS exclusions",
        "CASE WHEN p_partkey % 5 = 0 THEN array(named_struct('item', p_brand), named_struct('item', cast(NULL AS string))) END AS exclusion_items",
    )
    return S.normalise_scope(s).select("p_partkey", "summary", F.array_join("deliverables", ";").alias("deliverables"), F.array_join("exclusions", ";").alias("exclusions"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN 'a;b' WHEN s_nationkey % 3 = 1 THEN 'a;b;c' ELSE 'a;b' END AS tags FROM supplier")
def tag_add(spark, sf):
    new = F.when(F.col("s_nationkey") % 3 == 0, " b ").when(F.col("s_nationkey") % 3 == 1, " c").otherwise("  ")
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(S.add_tags(F.array(F.lit("a"), F.lit("b")), new), ";").alias("tags"))
