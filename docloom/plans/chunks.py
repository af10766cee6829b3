"""Chunking queries: orders as outlines of numbered lines, documents as pages, parts as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docloom.functions import text as X
from docloom.operators import chunking as C
from docloom.plans.specs import CLEAN, rows as part_rows
from docloom.registry import query, table

_OUTLINE = """SELECT doc_id, page, cast(row_number() OVER (PARTITION BY doc_id, page ORDER BY rn, m, i) - 1 AS INT) AS ln, line FROM (
  SELECT o_custkey AS doc_id, cast(floor((rn - 1) / 4) + 1 AS INT) AS page, rn, 0 AS m, 0 AS i, cast(rn AS {s}) || '. Order ' || cast(o_orderkey AS {s}) AS line FROM ranked
  UNION ALL
  SELECT doc_id, page, rn, m, i, line FROM ({explode}))"""
_RANKED = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders"
_ITEMS = """SELECT o_custkey AS doc_id, cast(floor((rn - 1) / 4) + 1 AS INT) AS page, rn, l_partkey, l_returnflag, l_linestatus, l_quantity,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS m FROM lineitem JOIN ranked ON l_orderkey = o_orderkey"""
_LINES = "cast(rn AS {s}) || '.' || cast(m AS {s}) || ' Part ' || cast(l_partkey AS {s}), '  - flag ' || l_returnflag || ' ', '- status ' || l_linestatus, CASE WHEN m % 3 = 0 THEN '  ' ELSE 'quantity ' || cast(cast(l_quantity AS INT) AS {s}) || ' ordered' END"
_SQL_EXPLODE = f"SELECT doc_id, page, rn, m, unnest([1, 2, 3, 4]) AS i, unnest([{_LINES.format(s='VARCHAR')}]) AS line FROM items"
HINTS = ("quantity 7 ordered", "quantity 21 ordered")
OUTLINE = f"ranked AS ({_RANKED}), items AS ({_ITEMS}), outline AS ({_OUTLINE.format(s='VARCHAR', explode=_SQL_EXPLODE)})"


def outline(spark, sf) -> DataFrame:
    """Lines of orders by customer: a numbered line for an order, numbered lines and bullets for its items."""
    for t in ("orders", "lineitem"):
        table(spark, sf, t).createOrReplaceTempView(t)
    spark.sql(_RANKED).createOrReplaceTempView("ranked")
    spark.sql(_ITEMS).createOrReplaceTempView("items")
    explode = f"SELECT doc_id, page, rn, m, i + 1 AS i, line FROM items LATERAL VIEW posexplode(array({_LINES.format(s='STRING')})) x AS i, line"
    return spark.sql(_OUTLINE.format(s="STRING", explode=explode))


def pages(spark, sf) -> DataFrame:
    """Documents in pages of 20 lines."""
    l = table(spark, sf, "documents").select("doc_id", F.split("text", "\n", -1).alias("l"))
    n = F.ceil(F.size("l") / 20).cast("int")
    return l.select("doc_id", "l", F.explode(F.sequence(F.lit(1), n)).alias("page")).select("doc_id", "page", F.array_join(F.slice("l", (F.col("page") - 1) * 20 + 1, F.lit(20)), "\n").alias("text"))


PAGES = """v_pages AS (
  SELECT doc_id, cast(p AS INT) AS page, array_to_string(list_slice(l, (p - 1) * 20 + 1, p * 20), chr(10)) AS text
  FROM (SELECT doc_id, l, unnest(range(1, cast(ceil(len(l) / 20.0) AS BIGINT) + 1)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


_HEADER = "'^(\\d+(?:\\.\\d+)*\\.?)\\s+(.+)$'"
_MARKED = f"""marked AS (
  SELECT doc_id, page, ln, s AS stripped, CASE WHEN h THEN regexp_replace(regexp_extract(s, {_HEADER}, 1), '\\.+$', '') END AS number, CASE WHEN h THEN {_strip(f"regexp_extract(s, {_HEADER}, 2)")} END AS title
  FROM (SELECT *, regexp_matches(s, {_HEADER}) AS h FROM (SELECT *, {_strip('line')} AS s FROM outline)))"""
_HINT_LIST = ", ".join(f"'{h}'" for h in HINTS)
_SECTIONS = f"""{_MARKED},
named AS (
  SELECT *, number IS NULL AND stripped IN ({_HINT_LIST}) AS is_hint, CASE WHEN number IS NOT NULL THEN number || ' ' || title WHEN stripped IN ({_HINT_LIST}) THEN stripped END AS name FROM marked),
befores AS (SELECT *, coalesce(last_value(name IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'Unknown') AS prior FROM named),
ups AS (SELECT *, CASE WHEN name IS NULL THEN NULL WHEN number IS NOT NULL AND contains(number, '.') THEN prior ELSE name END AS up FROM befores),
sections AS (
  SELECT *, coalesce(last_value(name IGNORE NULLS) OVER w, 'Unknown') AS section, coalesce(last_value(up IGNORE NULLS) OVER w, 'Unknown') AS parent_section,
    CASE WHEN stripped = '' OR number IS NOT NULL OR is_hint THEN 1 ELSE 0 END AS brk
  FROM ups WINDOW w AS (PARTITION BY doc_id, page ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_PARAS = f"""{_SECTIONS},
islands AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM sections),
grouped AS (
  SELECT doc_id, page, island, string_agg(stripped, chr(10) ORDER BY ln) AS text, arg_min(section, ln) AS section, arg_min(parent_section, ln) AS parent_section,
    count(*) AS n_lines, sum(CASE WHEN regexp_matches(stripped, '^\\s*[-•*]\\s') THEN 1 ELSE 0 END) AS bullets
  FROM islands WHERE stripped <> '' GROUP BY ALL),
paragraphs AS (
  SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY island) AS para, text, section, parent_section,
    CASE WHEN bullets > 0.5 * n_lines AND n_lines >= 2 THEN 'list' ELSE 'paragraph' END AS chunk_type, n_lines FROM grouped)"""


def _hints():
    return F.array(*[F.lit(h) for h in HINTS])


@query(f"WITH {OUTLINE}, {_MARKED} SELECT doc_id, page, ln, number, title FROM marked WHERE number IS NOT NULL")
def section_headers(spark, sf):
    return C.section_headers(outline(spark, sf)).filter("number is not null").select("doc_id", "page", "ln", "number", "title")


@query(f"WITH {OUTLINE}, {_SECTIONS} SELECT doc_id, page, ln, stripped FROM sections WHERE is_hint")
def heading_hints(spark, sf):
    return C.sections(outline(spark, sf), _hints()).filter("is_hint").select("doc_id", "page", "ln", "stripped")


@query(f"WITH {OUTLINE}, {_SECTIONS} SELECT doc_id, page, ln, section, parent_section FROM sections")
def section_hierarchy(spark, sf):
    return C.sections(outline(spark, sf), _hints()).select("doc_id", "page", "ln", "section", "parent_section")


@query(f"WITH {OUTLINE}, {_PARAS} SELECT doc_id, page, para, text, section, parent_section, chunk_type, n_lines FROM paragraphs")
def chunk_paragraphs(spark, sf):
    return C.paragraphs(outline(spark, sf), _hints())


@query(f"WITH {OUTLINE}, {_PARAS} SELECT doc_id, page, para, n_lines FROM paragraphs WHERE chunk_type = 'list'")
def list_detect(spark, sf):
    return C.paragraphs(outline(spark, sf), _hints()).filter("chunk_type = 'list'").select("doc_id", "page", "para", "n_lines")


@query(f"WITH {CLEAN} SELECT doc_id, page, table_id || '_row_' || cast(row_no AS VARCHAR) AS chunk_id, '[Table Headers]: ' || array_to_string(headers, ' | ') || chr(10) || '[Row ' || cast(row_no AS VARCHAR) || ']: ' || array_to_string(cells, ' | ') AS text FROM rows_ WHERE len(list_filter(cells, lambda c: c <> '')) > 0")
def chunk_table_rows(spark, sf):
    return C.table_chunks(part_rows(spark, sf)).select("doc_id", "page", "chunk_id", "text")


@query("SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def token_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.token_count(F.col("text")).alias("tokens"))


_SENTENCES = "string_split(regexp_replace({}, '([.!?])\\s+', concat('\\1', chr(1)), 'g'), chr(1))"


@query(f"SELECT doc_id, cast(i - 1 AS INT) AS ord, l[i] AS sentence FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES.format('text')} AS l FROM documents))")
def sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("ord", "sentence"))


def _pack_sql(source: str, keys: str, most: int, overlap: int) -> str:
    """Greedy packing as a walk over sentences: s is a chunk's first sentence, n its tokens so far."""
    return f"""
lists AS (SELECT {keys}, text, {_SENTENCES.format('text')} AS l FROM {source}),
counted AS (SELECT {keys}, text, l, [greatest(1, length(x) // 4) for x in l] AS t FROM lists),
walk AS (
  SELECT {keys}, 0 AS i, 1 AS s, 0::BIGINT AS n, 0 AS chunk, NULL::INT AS from_, NULL::INT AS to_ FROM counted WHERE greatest(1, length(text) // 4) > {most}
  UNION ALL
  SELECT {keys}, i + 1,
    CASE WHEN flush THEN i + 1 - k ELSE s END, CASE WHEN flush THEN list_sum(t[i + 1 - k : i])::BIGINT + t[i + 1] ELSE n + t[i + 1] END,
    CASE WHEN flush THEN chunk + 1 ELSE chunk END, CASE WHEN flush THEN s END, CASE WHEN flush THEN i END
  FROM (
    SELECT w.*, c.t, n + c.t[i + 1] > {most} AND i >= s AS flush,
      greatest(1, len(list_filter(range(1, i - s + 2), lambda j: list_sum(c.t[i + 1 - j : i]) <= {overlap})))::INT AS k
    FROM walk w JOIN counted c USING ({keys}) WHERE i < len(c.t))),
cuts AS (
  SELECT {keys}, chunk - 1 AS part, from_, to_ FROM walk WHERE from_ IS NOT NULL
  UNION ALL SELECT {keys}, chunk, s, i FROM walk w JOIN counted c USING ({keys}) WHERE i = len(c.t)),
packed AS (
  SELECT {keys}, cast(part AS INT) AS part, array_to_string(l[from_ : to_], ' ') AS chunk FROM cuts JOIN counted USING ({keys})
  UNION ALL SELECT {keys}, 0, text FROM counted WHERE greatest(1, length(text) // 4) <= {most})"""


@query(f"WITH RECURSIVE {_pack_sql('documents', 'doc_id', 500, 100)} SELECT doc_id, part, chunk FROM packed")
def token_pack(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(C.pack(F.col("text"))).alias("part", "chunk"))


@query(
    f"""WITH RECURSIVE {CLEAN}, {OUTLINE}, {_PARAS}, {_pack_sql('paragraphs', 'doc_id, page, para', 500, 100)}
SELECT 'table' AS kind, cast(doc_id AS VARCHAR) AS doc, page, count(*) AS n, sum(length(headers[1]))::BIGINT AS size FROM rows_ WHERE len(list_filter(cells, lambda c: c <> '')) > 0 GROUP BY ALL
UNION ALL SELECT 'page', cast(doc_id AS VARCHAR), page, count(*), sum(length(chunk))::BIGINT FROM packed GROUP BY ALL"""
)
def chunks_all(spark, sf):
    rows = part_rows(spark, sf)
    t = C.table_chunks(rows).withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("size", F.length(F.substring_index(F.substring("text", 18, 1000), " | ", 1)))
    p = C.page_chunks(outline(spark, sf), _hints()).withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("size", F.length("text"))
    all_ = t.unionByName(p)
    kind = F.when(F.col("chunk_type") == "table", "table").otherwise("page")
    return all_.groupBy(kind.alias("kind"), F.col("doc_id").alias("doc"), "page").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query(f"WITH {OUTLINE}, {_PARAS} SELECT chunk_type, count(*) AS n FROM paragraphs GROUP BY 1")
def chunk_type_histogram(spark, sf):
    return C.paragraphs(outline(spark, sf), _hints()).groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {OUTLINE}, {_PARAS} SELECT doc_id, chunk_type, count(*) AS n, sum(n_lines)::BIGINT AS n_lines FROM paragraphs GROUP BY ROLLUP (doc_id, chunk_type)")
def chunk_rollup(spark, sf):
    return C.paragraphs(outline(spark, sf), _hints()).rollup("doc_id", "chunk_type").agg(F.count(F.lit(1)).alias("n"), F.sum("n_lines").alias("n_lines"))


@query(f"WITH {OUTLINE}, {_PARAS} SELECT doc_id, page, para, left(sha256(concat_ws('|', cast(doc_id AS VARCHAR), cast(page AS VARCHAR), cast(para AS VARCHAR), text)), 8) AS id FROM paragraphs")
def chunk_ids(spark, sf):
    return C.paragraphs(outline(spark, sf), _hints()).select("doc_id", "page", "para", C.chunk_id("doc_id", "page", "para", "text").alias("id"))


_BREAKS = """
v AS (SELECT label AS doc_id, vec_id AS ord, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT * FROM (SELECT doc_id, ord, 1 - list_cosine_similarity(e, lead(e) OVER (PARTITION BY doc_id ORDER BY ord)) AS dist FROM v) WHERE dist IS NOT NULL),
g AS (
  SELECT *, CASE WHEN u IS NULL AND w IS NULL THEN 0.0 WHEN w IS NULL THEN u - dist WHEN u IS NULL THEN dist - w ELSE (u - w) / 2 END AS gradient
  FROM (SELECT *, lead(dist) OVER (PARTITION BY doc_id ORDER BY ord) AS u, lag(dist) OVER (PARTITION BY doc_id ORDER BY ord) AS w FROM d)),
lim AS (SELECT doc_id, quantile_cont(gradient, 0.95) AS lim FROM g GROUP BY 1),
f AS (SELECT doc_id, ord, dist, gradient, CASE WHEN gradient > lim THEN 1 ELSE 0 END AS b FROM g JOIN lim USING (doc_id))
SELECT v.doc_id, v.ord, round(dist, 6) AS dist, round(gradient, 6) AS gradient,
  coalesce(sum(b) OVER (PARTITION BY v.doc_id ORDER BY v.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS part
FROM v LEFT JOIN f USING (doc_id, ord)"""


@query("WITH " + _BREAKS.strip())
def semantic_breaks(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    out = C.semantic_breaks(v)
    return out.withColumns({"dist": F.round("dist", 6), "gradient": F.round("gradient", 6)})
