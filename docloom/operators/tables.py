"""Tables to specifications: cleaning, column mapping by header patterns, gates, row rules.

Rows are (…, page, table_id, headers, row_no, cells). Everything is an expression on the row: no
shuffle, and gates that need only headers and page come before row work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docloom.config import DEFAULT, HEADER_PATTERNS, NOT_FOUND, TABLE_KEYWORDS, Config
from docloom.functions.text import after, before, clean_spec, collapse, has_letter, is_serial, or_not_found, strip

FIELDS = tuple(f for f, _ in HEADER_PATTERNS)


def clean_cells(cells: Column) -> Column:
    return F.transform(cells, collapse)


def map_columns(headers: Column) -> Column:
    """map<field, index from 0>: each header, from the left, takes the first field that is free and
    whose pattern it matches."""
    kind = "map<string,int>"

    def step(state: Column, i: Column) -> Column:
        header = F.coalesce(F.get(headers, i), F.lit(""))
        taken = F.coalesce(*[F.when(~F.map_contains_key(state, f) & header.rlike("(?i)" + p), F.lit(f)) for f, p in HEADER_PATTERNS])
        return F.when(taken.isNull(), state).otherwise(F.map_concat(state, F.create_map(taken, i)))

    empty = F.create_map().cast(kind)
    return F.when(F.size(headers) > 0, F.aggregate(F.sequence(F.lit(0), F.size(headers) - 1), empty, step)).otherwise(empty)


def cell(cells: Column, index: Column) -> Column:
    """The stripped cell; null if there is none or it is blank."""
    value = strip(F.get(cells, index))
    return F.when(value != "", value)


def has_keyword(headers: Column) -> Column:
    joined = F.lower(F.array_join(headers, " "))
    out = F.lit(False)
    for k in TABLE_KEYWORDS:
        out = out | F.contains(joined, F.lit(k))
    return out


def passes_page(page: Column, headers: Column, cfg: Config = DEFAULT) -> Column:
    return (page >= cfg.keyword_page) | has_keyword(headers)


def passes_structure(mapping: Column) -> Column:
    signal = F.lit(False)
    for f in ("specification_text", "numeric_value", "tolerance", "standard_reference", "material"):
        signal = signal | F.map_contains_key(mapping, f)
    return F.map_contains_key(mapping, "item_name") & signal


def filled(cells: Column) -> Column:
    return F.filter(cells, lambda c: strip(c) != "")


def derive(item: Column, spec: Column) -> Column:
    """struct(item, spec) of a row whose item may be a serial number."""
    item, spec = clean_spec(item), clean_spec(spec)

    def body(x: Column) -> Column:
        left, right = clean_spec(before(x.spec, ":")), clean_spec(after(x.spec, ":"))
        first = clean_spec(before(before(before(x.spec, "."), ";"), ":"))
        split = F.contains(x.spec, F.lit(":")) & (left != "") & has_letter(left)
        clause = (x.spec != "") & (F.length(first) >= 6) & has_letter(first)
        blank = lambda c: F.when(c == "", F.lit(NOT_FOUND)).otherwise(c)
        plain = F.struct(blank(x.item).alias("item"), blank(x.spec).alias("spec"))
        return (
            F.when(is_serial(x.item) & split, F.struct(F.substring(left, 1, 80).alias("item"), F.when(right == "", x.spec).otherwise(right).alias("spec")))
            .when(is_serial(x.item) & clause, F.struct(F.substring(first, 1, 80).alias("item"), x.spec.alias("spec")))
            .otherwise(plain)
        )

    return F.get(F.transform(F.array(F.struct(item.alias("item"), spec.alias("spec"))), body), F.lit(0))


def is_narrative(spec: Column) -> Column:
    spaces = F.length(spec) - F.length(F.replace(spec, F.lit(" "), F.lit("")))
    return (F.length(spec) > 180) & (spaces > 25) & ~spec.rlike("[0-9]")


def is_too_short(item: Column, spec: Column) -> Column:
    return (F.length(item) < 4) & (F.length(spec) < 10)


def passes_spec_page(spec: Column) -> Column:
    return (F.length(spec) >= 15) & has_letter(spec)


def passes_other_page(item: Column, spec: Column) -> Column:
    numeric = F.regexp_replace(item, r"^([^.]*)\.", "$1").rlike(r"^\p{N}+$")
    return (F.length(item) >= 5) & ~numeric & has_letter(item) & (F.length(spec) >= 20) & spec.rlike("[a-zA-Z0-9]{3,}") & (spec != item)


def table_specs(rows: DataFrame, keys: tuple[str, ...] = ("doc_id", "page", "table_id", "row_no"), cfg: Config = DEFAULT) -> DataFrame:
    """Specification rows: keys, item_name, specification_text, unit, numeric_value, tolerance,
    standard_reference, material, chunk_id, exact_text, confidence."""
    gated = rows.filter(passes_page(F.col("page"), F.col("headers"), cfg)).withColumn("m", map_columns(F.col("headers")))
    gated = gated.filter(passes_structure(F.col("m"))).withColumn("full", filled(F.col("cells"))).filter(F.size("full") >= 2)
    value = lambda f: cell(F.col("cells"), F.try_element_at("m", F.lit(f)))
    item = F.coalesce(F.when(value("item_name") != NOT_FOUND, value("item_name")), F.get("full", F.lit(0)))
    spec = F.coalesce(F.when(value("specification_text") != NOT_FOUND, value("specification_text")), F.array_join(F.slice("full", 2, F.size("full")), " "))
    on_spec_page = F.col("page") >= cfg.spec_page

    def judge(d: Column) -> Column:
        kept = ~is_narrative(d.spec) & ~is_too_short(d["item"], d.spec) & F.when(on_spec_page, passes_spec_page(d.spec)).otherwise(passes_other_page(d["item"], d.spec))
        return F.struct(d["item"].alias("item"), d.spec.alias("spec"), kept.alias("kept"))

    # A lambda's variable binds the derived pair, so that the filter does not repeat its expression.
    kept = gated.withColumn("d", F.get(F.transform(F.array(derive(strip(item), strip(spec))), judge), F.lit(0))).filter("d.kept")
    item, spec = F.col("d.item"), F.col("d.spec")
    name = F.when(on_spec_page & ((item == "") | (item == NOT_FOUND)), F.substring(spec, 1, 50)).otherwise(item)
    return kept.select(
        *keys,
        name.alias("item_name"),
        spec.alias("specification_text"),
        *[or_not_found(value(f)).alias(f) for f in ("unit", "numeric_value", "tolerance", "standard_reference", "material")],
        F.concat(F.col("table_id"), F.lit("_row_"), F.col("row_no").cast("string")).alias("chunk_id"),
        F.array_join("cells", " | ").alias("exact_text"),
        F.lit("MEDIUM").alias("confidence"),
    )


def number_tables(tables: DataFrame) -> DataFrame:
    """Tables (doc_id, page, ord, raw rows) of two rows or more, numbered in each document, with headers
    and rows; tables without any cell go after numbering, so that ids have gaps."""
    order = W.partitionBy("doc_id").orderBy("page", "ord")
    numbered = tables.filter(F.size("raw") >= 2).withColumn("no", F.row_number().over(order))
    clean = numbered.withColumn("raw", F.transform("raw", clean_cells))
    some = clean.filter(F.exists(F.slice("raw", 2, F.size("raw")), lambda r: F.exists(r, lambda c: c != "")))
    return some.select("doc_id", "page", F.concat(F.lit("table_"), F.lpad(F.col("no").cast("string"), 3, "0")).alias("table_id"), F.get("raw", F.lit(0)).alias("headers"), F.slice("raw", 2, F.size("raw")).alias("rows"))
