"""Table and specification queries over part."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docloom.config import HEADER_PATTERNS, TABLE_KEYWORDS
from docloom.functions import text as X
from docloom.operators import scoring as S, tables as T
from docloom.registry import query, table

_ITEMS = "CASE p_size % 4 WHEN 0 THEN {a} WHEN 1 THEN {b} WHEN 2 THEN {c} ELSE {d} END"
_TEXT = "p_name || ' ' || p_type || ' part number ' || cast(p_partkey AS {s})"


def _headers(array: str) -> str:
    lists = (
        ("S. No.", "Equipment", "Specified Details", "UOM", "Qty"),
        ("Sr No", "Description", "Technical Parameter", "Tolerance Range", "IS Code", "Grade"),
        ("Index", "Particulars", "Amount", "Volume"),
        ("Index", "Remarks"),
    )
    a, b, c, d = (array.format(", ".join(f"'{h}'" for h in x)) for x in lists)
    return _ITEMS.format(a=a, b=b, c=c, d=d)


def _cells(array: str, s: str) -> str:
    n = f"cast(row_no AS {s})"
    text = _TEXT.format(s=s)
    rows = (
        f"'  ' || {n} || '.', p_name, CASE WHEN p_partkey % 3 = 0 THEN p_type || ': ' || {text} ELSE '- ' || {text} END, ' nos ', cast(p_size AS {s})",
        f"'(' || {n} || ')', NULL, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE {text} || '; see note' END, '+/- 5%', 'IS ' || cast(p_partkey AS {s}), p_brand",
        f"{n}, p_name || chr(10) || p_type, cast(p_size AS {s}), '   '",
        f"'', p_name",
    )
    a, b, c, d = (array.format(x) for x in rows)
    return _ITEMS.format(a=a, b=b, c=c, d=d)


_ROWS = """SELECT p_brand AS doc_id, p_size AS page, 'table_' || lpad(cast(p_size AS {s}), 3, '0') AS table_id, p_partkey, row_no, {headers} AS headers, {cells} AS cells
  FROM (SELECT *, cast(row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS {i}) AS row_no FROM part)"""
RAW = _ROWS.format(s="VARCHAR", i="BIGINT", headers=_headers("[{}]"), cells=_cells("[{}]", "VARCHAR"))
_WHITE = "regexp_replace(regexp_replace(coalesce(c, ''), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
CLEAN = f"raw_rows AS ({RAW}), rows_ AS (SELECT * EXCLUDE (cells), [{_WHITE} for c in cells] AS cells FROM raw_rows)"


def raw_rows(spark, sf) -> DataFrame:
    """Parts as rows of tables: a document for each brand, a page for each size, four kinds of headers."""
    table(spark, sf, "part").createOrReplaceTempView("part")
    return spark.sql(_ROWS.format(s="STRING", i="BIGINT", headers=_headers("array({})"), cells=_cells("array({})", "STRING")))


def rows(spark, sf) -> DataFrame:
    return raw_rows(spark, sf).withColumn("cells", T.clean_cells(F.col("cells")))


def _sql_fold() -> str:
    """A recursive walk over the headers of each distinct table head."""
    pick = "\n".join(f"      WHEN NOT list_contains(taken, '{f}') AND regexp_matches(h[i + 1], '(?i){p}') THEN '{f}'" for f, p in HEADER_PATTERNS)
    return f"""
heads AS (SELECT DISTINCT headers AS h FROM raw_rows),
fold AS (
  SELECT h, 0 AS i, []::VARCHAR[] AS taken, []::INT[] AS pos_ FROM heads
  UNION ALL
  SELECT h, i + 1, CASE WHEN f IS NULL THEN taken ELSE list_append(taken, f) END, CASE WHEN f IS NULL THEN pos_ ELSE list_append(pos_, i) END
  FROM (SELECT *, CASE
{pick}
      END AS f FROM fold WHERE i < len(h))),
mapped AS (SELECT h AS headers, taken, pos_ FROM fold WHERE i = len(h))"""


MAPPED = f"WITH RECURSIVE {CLEAN}, {_sql_fold()}"
_INDEX = "pos_[list_position(taken, '{}')]"


@query(f"WITH {CLEAN} SELECT p_partkey, array_to_string(cells, '|') AS cells, len(cells) AS n FROM rows_")
def table_clean(spark, sf):
    return rows(spark, sf).select("p_partkey", F.array_join("cells", "|").alias("cells"), F.size("cells").cast("long").alias("n"))


@query(MAPPED + " SELECT array_to_string(headers, '|') AS headers, " + ", ".join(f"{_INDEX.format(f)} AS {f}" for f in T.FIELDS) + " FROM mapped")
def table_map_columns(spark, sf):
    heads = raw_rows(spark, sf).select("headers").distinct().withColumn("m", T.map_columns(F.col("headers")))
    return heads.select(F.array_join("headers", "|").alias("headers"), *[F.try_element_at("m", F.lit(f)).alias(f) for f in T.FIELDS])


_KEYWORD = " OR ".join(f"contains(lower(array_to_string(headers, ' ')), '{k}')" for k in TABLE_KEYWORDS)


@query(f"WITH {CLEAN} SELECT DISTINCT doc_id, page, table_id FROM rows_ WHERE page >= 15 OR {_KEYWORD}")
def table_page_gate(spark, sf):
    r = rows(spark, sf)
    return r.filter(T.passes_page(F.col("page"), F.col("headers"))).select("doc_id", "page", "table_id").distinct()


_SIGNAL = "list_contains(taken, 'item_name') AND list_has_any(taken, ['specification_text', 'numeric_value', 'tolerance', 'standard_reference', 'material'])"


@query(f"{MAPPED} SELECT doc_id, page, count(*) AS n_rows FROM rows_ JOIN mapped USING (headers) WHERE {_SIGNAL} GROUP BY ALL")
def table_structure_gate(spark, sf):
    r = rows(spark, sf)
    return r.filter(T.passes_structure(T.map_columns(F.col("headers")))).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"WITH {CLEAN} SELECT p_partkey, f[1] AS item, array_to_string(f[2:], ' ') AS rest FROM (SELECT p_partkey, list_filter(cells, lambda c: c <> '') AS f FROM rows_) WHERE len(f) >= 2")
def row_gate_and_fallback(spark, sf):
    r = rows(spark, sf).select("p_partkey", T.filled(F.col("cells")).alias("f")).filter("size(f) >= 2")
    return r.select("p_partkey", F.get("f", F.lit(0)).alias("item"), F.array_join(F.slice("f", 2, F.size("f")), " ").alias("rest"))


_SERIAL = "regexp_matches(regexp_replace({}, '[\\s().-]+', '', 'g'), '^[0-9]+$')"


@query(f"WITH {CLEAN} SELECT p_partkey, cells[1] AS label, {_SERIAL.format('cells[1]')} AS is_serial FROM rows_")
def serial_label(spark, sf):
    c = F.get("cells", F.lit(0))
    return rows(spark, sf).select("p_partkey", c.alias("label"), X.is_serial(c).alias("is_serial"))


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _spec_clean(x: str) -> str:
    bullets = _strip(f"regexp_replace({x}, '^[\\s\\x{{2022}}\\x{{f0b7}}-]+', '')")
    return _strip(f"regexp_replace(regexp_replace({bullets}, '^([A-Za-z])\\s+([A-Za-z]{{2,}})', '\\1\\2'), '\\s+', ' ', 'g')")


_BULLETS = "CASE p_partkey % 4 WHEN 0 THEN chr(8226) || ' - ' || p_name WHEN 1 THEN 'S teel  ' || p_type WHEN 2 THEN chr(61623) || p_name || ' a' ELSE '-- a b c' END"


@query(f"SELECT p_partkey, {_spec_clean(_BULLETS)} AS cleaned FROM part")
def spec_text_clean(spark, sf):
    marks = _BULLETS.replace("chr(8226)", "'•'").replace("chr(61623)", "''")
    return table(spark, sf, "part").selectExpr("p_partkey", f"{marks} AS t").select("p_partkey", X.clean_spec(F.col("t")).alias("cleaned"))


def _derive_sql(source: str) -> str:
    """Rows of ``source`` with item and spec to those with derived d_item and d_spec."""
    left = _spec_clean("split_part(s, ':', 1)")
    right = _spec_clean("substr(s, strpos(s, ':') + 1)")
    first = _spec_clean("split_part(split_part(split_part(s, '.', 1), ';', 1), ':', 1)")
    return f"""(SELECT *,
    CASE WHEN serial AND has_colon AND l <> '' AND regexp_matches(l, '\\p{{L}}') THEN left(l, 80)
      WHEN serial AND s <> '' AND length(f) >= 6 AND regexp_matches(f, '\\p{{L}}') THEN left(f, 80)
      WHEN i = '' THEN 'NOT_FOUND' ELSE i END AS d_item,
    CASE WHEN serial AND has_colon AND l <> '' AND regexp_matches(l, '\\p{{L}}') THEN (CASE WHEN r = '' THEN s ELSE r END)
      WHEN s = '' THEN 'NOT_FOUND' ELSE s END AS d_spec
  FROM (SELECT *, {_SERIAL.format('i')} AS serial, contains(s, ':') AS has_colon, {left} AS l, {right} AS r, {first} AS f
    FROM (SELECT *, {_spec_clean('item')} AS i, {_spec_clean('spec')} AS s FROM {source})))"""


_PAIR = "CASE p_partkey % 3 WHEN 0 THEN '(' || cast(p_partkey AS {s}) || ')' WHEN 1 THEN cast(p_size AS {s}) || '.' ELSE p_name END AS item, CASE p_partkey % 5 WHEN 0 THEN p_type || ': ' || p_name WHEN 1 THEN ': ' || p_name WHEN 2 THEN p_name || '. Then; more' WHEN 3 THEN 'ab; ' || p_name ELSE '' END AS spec"


@query(f"WITH s AS (SELECT p_partkey, {_PAIR.format(s='VARCHAR')} FROM part) SELECT p_partkey, d_item AS item, d_spec AS spec FROM {_derive_sql('s')}")
def derive_component(spark, sf):
    pairs = table(spark, sf, "part").selectExpr("p_partkey", *_split_pair())
    return pairs.select("p_partkey", T.derive(F.col("item"), F.col("spec")).alias("d")).select("p_partkey", "d.item", "d.spec")


def _split_pair() -> list[str]:
    a, b = _PAIR.format(s="STRING").split(" AS item, ")
    return [a + " AS item", b]


@query("SELECT doc_id, length(text) > 180 AND length(text) - length(replace(text, ' ', '')) > 25 AND NOT regexp_matches(text, '[0-9]') AS narrative FROM documents")
def narrative_reject(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.is_narrative(F.col("text")).alias("narrative"))


_VALUES = f"""{MAPPED},
cell AS (
  SELECT r.*, """ + ", ".join(f"nullif({_strip(f'cells[{_INDEX.format(f)} + 1]')}, '') AS {f}" for f in T.FIELDS) + f""",
    list_filter(cells, lambda c: {_strip('c')} <> '') AS f
  FROM rows_ r JOIN mapped m USING (headers) WHERE (page >= 15 OR {_KEYWORD}) AND {_SIGNAL}),
pairs AS (
  SELECT * EXCLUDE (f), {_strip("coalesce(nullif(item_name, 'NOT_FOUND'), f[1])")} AS item, {_strip("coalesce(nullif(specification_text, 'NOT_FOUND'), array_to_string(f[2:], ' '))")} AS spec
  FROM cell WHERE len(f) >= 2),
derived AS (SELECT * FROM {_derive_sql('pairs')}),
judged AS (
  SELECT *,
    (length(d_spec) > 180 AND length(d_spec) - length(replace(d_spec, ' ', '')) > 25 AND NOT regexp_matches(d_spec, '[0-9]')) AS narrative,
    (length(d_item) < 4 AND length(d_spec) < 10) AS short,
    (length(d_spec) >= 15 AND regexp_matches(d_spec, '\\p{{L}}')) AS spec_ok,
    (length(d_item) >= 5 AND NOT regexp_matches(regexp_replace(d_item, '^([^.]*)\\.', '\\1'), '^\\p{{N}}+$') AND regexp_matches(d_item, '\\p{{L}}')
      AND length(d_spec) >= 20 AND regexp_matches(d_spec, '[a-zA-Z0-9]{{3,}}') AND d_spec <> d_item) AS other_ok
  FROM derived),
specs AS (
  SELECT doc_id, page, table_id, row_no, CASE WHEN page >= 20 AND d_item IN ('', 'NOT_FOUND') THEN left(d_spec, 50) ELSE d_item END AS item_name, d_spec AS specification_text,
    """ + ", ".join(f"coalesce({f}, 'NOT_FOUND') AS {f}" for f in T.FIELDS[2:]) + """,
    table_id || '_row_' || cast(row_no AS VARCHAR) AS chunk_id, array_to_string(cells, ' | ') AS exact_text, 'MEDIUM' AS confidence
  FROM judged WHERE NOT narrative AND NOT short AND (CASE WHEN page >= 20 THEN spec_ok ELSE other_ok END))
"""


@query(_VALUES + "SELECT * FROM specs")
def table_specs(spark, sf):
    return T.table_specs(rows(spark, sf))


@query(_VALUES + "SELECT page >= 20 AS spec_page, count(*) AS n, count(DISTINCT doc_id) AS n_docs, sum(CASE WHEN unit = 'NOT_FOUND' THEN 0 ELSE 1 END)::BIGINT AS with_unit FROM specs GROUP BY 1")
def table_row_gates(spark, sf):
    s = T.table_specs(rows(spark, sf))
    return s.groupBy((F.col("page") >= 20).alias("spec_page")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.count_if(F.col("unit") != "NOT_FOUND").alias("with_unit"))


_TABLE = "SELECT p_brand AS doc_id, p_size AS page, p_partkey % 3 AS ord, count(*) AS n, sum(CASE WHEN p_partkey % 7 < 5 THEN 1 ELSE 0 END) AS n_full FROM part GROUP BY ALL"


@query(
    f"""WITH t AS ({_TABLE}), numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, ord) AS no FROM t WHERE n >= 1)
SELECT doc_id, page, 'table_' || lpad(cast(no AS VARCHAR), 3, '0') AS table_id, n AS n_rows FROM numbered WHERE n_full > 0"""
)
def tables_filter_nonempty(spark, sf):
    p = table(spark, sf, "part")
    cells = F.when(F.col("p_partkey") % 7 < 5, F.array("p_name", F.lit(None).cast("string"))).otherwise(F.array(F.lit(" \n"), F.lit("")))
    grouped = p.groupBy(F.col("p_brand").alias("doc_id"), F.col("p_size").alias("page"), (F.col("p_partkey") % 3).alias("ord")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", cells.alias("c")))).alias("r"))
    raw = grouped.select("doc_id", "page", "ord", F.concat(F.array(F.array(F.lit("Item"), F.lit("Unit"))), F.transform("r", lambda x: x.c)).alias("raw"))
    return T.number_tables(raw).select("doc_id", "page", "table_id", F.size("rows").cast("long").alias("n_rows"))


@query("SELECT p_partkey FROM part WHERE (CASE WHEN p_size > 30 THEN 'HIGH' WHEN p_size > 10 THEN 'MEDIUM' ELSE 'LOW' END) = 'MEDIUM' AND contains(lower(concat_ws(' ', p_name, p_type, p_brand)), 'bolt')")
def specs_search(spark, sf):
    bucket = X.confidence_bucket(F.col("p_size"), 31, 11)
    return S.search_specs(table(spark, sf, "part"), "Bolt", ["p_name", "p_type", "p_brand"], bucket, "MEDIUM").select("p_partkey")


_SHOWN = "list_filter([struct_pack(k := 'specification_text', v := p_type), struct_pack(k := 'unit', v := CASE WHEN p_size % 2 = 0 THEN 'NOT_FOUND' ELSE 'mm' END), struct_pack(k := 'material', v := CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END)], lambda x: x.v NOT IN ('', 'NOT_FOUND'))"


@query(
    f"""SELECT p_brand AS doc_id, cast(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS place,
  CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_type ELSE 'Spec ' || cast(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS VARCHAR) END AS component,
  CASE WHEN p_partkey % 4 = 0 THEN 'a: b' ELSE array_to_string(list_transform({_SHOWN}, lambda x: x.k || ': ' || x.v), ', ') END AS shown,
  CASE p_size % 3 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN p_size % 7 = 0 THEN 'NOT_FOUND' ELSE p_name END AS exact_text FROM part"""
)
def specs_display(spark, sf):
    """Parts as specifications of both shapes."""
    size, part = F.col("p_size"), F.col("p_partkey")
    none = F.lit(None).cast("string")
    rows = table(spark, sf, "part").select(
        F.col("p_brand").alias("doc_id"),
        part.alias("ord"),
        F.when(part % 3 == 0, F.col("p_name")).when(part % 3 == 1, "").alias("component"),
        F.when(part % 3 == 1, F.col("p_type")).alias("item_name"),
        F.when(part % 4 == 0, F.create_map(F.lit("a"), F.lit("b"))).alias("specs"),
        F.col("p_type").alias("specification_text"),
        F.when(size % 2 == 0, "NOT_FOUND").otherwise("mm").alias("unit"),
        *[none.alias(c) for c in ("numeric_value", "tolerance", "standard_reference", "chunk_id", "clause")],
        F.when(size % 5 == 0, "").otherwise(F.col("p_brand")).alias("material"),
        F.when(size % 3 == 0, "HIGH").when(size % 3 == 1, "0.5").otherwise("none").alias("confidence"),
        F.when(size % 7 != 0, F.col("p_name")).alias("exact_text"),
        F.lit(None).cast("int").alias("page"),
    )
    out = S.display_specs(rows, "doc_id", "ord")
    return out.select("doc_id", "place", "component", S.first_entries(F.col("specs")).alias("shown"), "confidence", "exact_text")
