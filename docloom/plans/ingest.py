"""Source, sink and orchestration queries over pages, documents, supplier and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.config import SCOPE_QUERIES, SPEC_QUERIES, TOPIC_PATTERNS
from docloom.functions.text import expand_query
from docloom.operators import extraction as E
from docloom.operators.tables import table_specs as specs_of
from docloom.plans.chunks import PAGES, pages
from docloom.plans.specs import _VALUES, rows as part_rows
from docloom.registry import query, table
from docloom.sources import ingest as I

_PATH = "url || CASE page_id % 5 WHEN 0 THEN '/a.PDF' WHEN 1 THEN '/b.docx' WHEN 2 THEN '/c.jpeg' WHEN 3 THEN '/d' ELSE '/e.txt' END"
_SUFFIX = "lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1))"


def _files(spark, sf):
    return table(spark, sf, "pages").selectExpr("page_id", f"{_PATH} AS path", "length(html) * 20000 AS length")


@query(f"SELECT page_id, CASE WHEN s = '.pdf' THEN 'pdf' WHEN s = '.docx' THEN 'docx' WHEN s IN ('.jpg', '.jpeg', '.png') THEN 'image' ELSE 'unsupported' END AS parser FROM (SELECT page_id, {_SUFFIX} AS s FROM (SELECT page_id, {_PATH} AS path FROM pages))")
def ingest_route_format(spark, sf):
    return _files(spark, sf).select("page_id", I.route(F.col("path")).alias("parser"))


@query(f"SELECT page_id, CASE WHEN s NOT IN ('.pdf', '.docx', '.jpg', '.jpeg', '.png') THEN 'unsupported' WHEN n > 52428800 THEN 'too large' END AS fault FROM (SELECT page_id, {_SUFFIX} AS s, n FROM (SELECT page_id, {_PATH} AS path, length(html) * 20000 AS n FROM pages))")
def ingest_validate(spark, sf):
    return _files(spark, sf).select("page_id", I.fault(F.col("path"), F.col("length")).alias("fault"))


@query("SELECT page_id, cast(i - 1 AS INT) AS ord, h[i] AS heading FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, list_filter([regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '^\\s+|\\s+$', '', 'g') for x in regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)], lambda x: x <> '') AS h FROM pages))")
def headings_from_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(I.html_headings(F.col("html"))).alias("ord", "heading"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (s > 12 OR (f & 16) > 0) AND n < 150 AS heading FROM (SELECT *, l_quantity / 2 AS s, cast(l_quantity AS INT) AS f, length(l_returnflag) + l_linenumber * 40 AS n FROM lineitem)")
def heading_predicate(spark, sf):
    text = F.repeat(F.lit("x"), F.length("l_returnflag") + F.col("l_linenumber") * 40)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", I.is_heading(F.col("l_quantity") / 2, F.col("l_quantity").cast("int"), text).alias("heading"))


@query(f"WITH {PAGES} SELECT doc_id, page, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 50 AS is_ocr FROM v_pages")
def ocr_routing(spark, sf):
    return pages(spark, sf).select("doc_id", "page", I.needs_ocr(F.col("text")).alias("is_ocr"))


@query("SELECT p_partkey, p_name || ' | ' || p_type AS line FROM part")
def docx_row_flatten(spark, sf):
    return table(spark, sf, "part").select("p_partkey", I.joined_cells(F.array(F.concat(F.lit(" "), "p_name"), F.lit(" \n"), "p_type", F.lit(""))).alias("line"))


_PROFILE = "struct<company_name:string,core_capabilities:array<string>,max_project_budget_usd:double>"


@query("SELECT s_suppkey, s_name AS company_name, 'x;' || cast(s_nationkey AS VARCHAR) AS capabilities, s_acctbal AS budget FROM supplier")
def profile_load(spark, sf):
    s = table(spark, sf, "supplier").select(
        "s_suppkey", F.to_json(F.struct(F.col("s_name").alias("company_name"), F.array(F.lit("x"), F.col("s_nationkey").cast("string")).alias("core_capabilities"), F.col("s_acctbal").alias("max_project_budget_usd"))).alias("j")
    )
    p = s.withColumn("p", F.from_json("j", _PROFILE))
    return p.select("s_suppkey", "p.company_name", F.array_join("p.core_capabilities", ";").alias("capabilities"), F.col("p.max_project_budget_usd").alias("budget"))


@query("""SELECT p_partkey, '{"component":"' || p_name || '","specs":{"type":"' || p_type || '"},"page":' || cast(p_size AS VARCHAR) || '}' AS json FROM part""")
def result_json(spark, sf):
    body = F.struct(F.col("p_name").alias("component"), F.create_map(F.lit("type"), F.col("p_type")).alias("specs"), F.col("p_size").alias("page"))
    return table(spark, sf, "part").select("p_partkey", F.to_json(body).alias("json"))


@query("SELECT d.doc_id, coalesce(l.quality * 100.0, 0.0)::DOUBLE AS accuracy, CASE WHEN l.doc_id IS NULL THEN 'NOT_FOUND' ELSE 'found' END AS summary FROM documents d LEFT JOIN labels l USING (doc_id)")
def empty_result_fill(spark, sf):
    found = table(spark, sf, "labels").select("doc_id", (F.col("quality") * 100.0).alias("accuracy"), F.lit("found").alias("summary"))
    return E.filled(table(spark, sf, "documents").select("doc_id"), found, "doc_id", {"accuracy": F.lit(0.0), "summary": F.lit("NOT_FOUND")})


_TOPIC = "coalesce(" + ", ".join(f"nullif(left(regexp_extract(t, '(?i){p}', 0), 200), '')" for p in TOPIC_PATTERNS) + ", left(t, 300))"
_EARLY = f"early AS (SELECT doc_id, (CASE WHEN doc_id % 3 = 0 THEN 'Notice for Supply of pumps: ' WHEN doc_id % 3 = 1 THEN 'Name of work: laying of ' ELSE '' END) || string_agg(text, ' ' ORDER BY page) AS t FROM v_pages WHERE page <= 5 GROUP BY doc_id)"


def topic(early: F.Column) -> F.Column:
    """The first pattern's match, up to 200 characters, else the first 300."""
    found = [F.nullif(F.substring(F.regexp_extract(early, "(?i)" + p, 0), 1, 200), F.lit("")) for p in TOPIC_PATTERNS]
    return F.coalesce(*found, F.substring(early, 1, 300))


def _topics(spark, sf):
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x.text), " ")
    g = pages(spark, sf).filter("page <= 5").groupBy("doc_id").agg(texts.alias("t"))
    head = F.when(F.col("doc_id") % 3 == 0, "Notice for Supply of pumps: ").when(F.col("doc_id") % 3 == 1, "Name of work: laying of ").otherwise("")
    return g.select("doc_id", topic(F.concat(head, F.col("t"))).alias("topic"))


@query(f"WITH {PAGES}, {_EARLY} SELECT doc_id, {_TOPIC} AS topic FROM early")
def topic_discovery(spark, sf):
    return _topics(spark, sf)


def _template_sql() -> str:
    items = ", ".join("'" + q + "'" for q in (*SPEC_QUERIES, *SCOPE_QUERIES))
    return f"[{items}]"


_EXPANDED = """q || CASE WHEN e = '' THEN '' ELSE ' ' || e END"""
_WORDS = "concat_ws(' ', " + ", ".join(
    f"CASE WHEN contains(lower(q), '{t}') AND NOT contains(lower(q), '{w}') THEN '{w}' END" for t, w in (("specification", "specs"), ("specification", "standard"), ("material", "grade"), ("material", "alloy"), ("dimension", "size"), ("dimension", "diameter"))
) + ")"


@query(
    f"""WITH t AS (SELECT p_partkey, p_name || ' ' || p_type AS topic FROM part),
q AS (SELECT p_partkey, cast(i - 1 AS INT) AS ord, replace({_template_sql()}[i], '{{topic}}', topic) AS q FROM (SELECT *, unnest(range(1, {len(SPEC_QUERIES) + len(SCOPE_QUERIES) + 1})) AS i FROM t))
SELECT p_partkey, ord, CASE WHEN ord < {len(SPEC_QUERIES)} THEN 'spec' ELSE 'scope' END AS kind, {_EXPANDED} AS query FROM (SELECT *, {_WORDS} AS e FROM q)"""
)
def targeted_queries(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("topic"))
    all_ = F.array(*[F.replace(F.lit(q), F.lit("{topic}"), F.col("topic")) for q in (*SPEC_QUERIES, *SCOPE_QUERIES)])
    q = t.select("p_partkey", F.posexplode(all_).alias("ord", "q"))
    return q.select("p_partkey", "ord", F.when(F.col("ord") < len(SPEC_QUERIES), "spec").otherwise("scope").alias("kind"), expand_query(F.col("q")).alias("query"))


@query(_VALUES + "SELECT 0 AS src, doc_id, page, item_name AS component FROM specs UNION ALL SELECT 1, p_brand, p_size, p_name FROM part")
def specs_union(spark, sf):
    a = specs_of(part_rows(spark, sf)).select(F.lit(0).alias("src"), "doc_id", "page", F.col("item_name").alias("component"))
    b = table(spark, sf, "part").select(F.lit(1).alias("src"), F.col("p_brand").alias("doc_id"), F.col("p_size").alias("page"), F.col("p_name").alias("component"))
    return a.unionByName(b)
