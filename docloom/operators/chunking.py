"""Chunking: lines to paragraphs by gaps and islands, sections carried forward, packing by tokens.

Lines are (doc_id, page, ln, line). A window is one page, so its size is bounded by a page, and all
windows share one partitioning by (doc_id, page).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docloom.config import BULLET_PATTERN, DEFAULT, SECTION_PATTERN, Config
from docloom.functions.text import sentences, strip, token_count

PAGE = ("doc_id", "page")


def lines(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page, text[, headings, is_ocr]) as lines."""
    more = [c for c in ("headings", "is_ocr") if c in pages.columns]
    return pages.select(*PAGE, *more, F.posexplode(F.split("text", "\n", -1)).alias("ln", "line"))


def section_headers(rows: DataFrame) -> DataFrame:
    """Lines with their stripped text, section number and title (null if the line is no header)."""
    s = strip(F.col("line"))
    out = rows.withColumn("stripped", s)
    is_header = F.col("stripped").rlike(SECTION_PATTERN)
    number = F.regexp_replace(F.regexp_extract("stripped", SECTION_PATTERN, 1), r"\.+$", "")
    title = strip(F.regexp_extract("stripped", SECTION_PATTERN, 2))
    return out.withColumns({"number": F.when(is_header, number), "title": F.when(is_header, title)})


def sections(rows: DataFrame, hints: Column | None = None) -> DataFrame:
    """Lines with the section and parent in force from each line on, the flags is_header and is_hint, and
    brk (1 where a paragraph begins or a blank line ends one).

    A header of depth 1 and a heading hint are their own parents; a deeper header's parent is the section
    in force before it. Sections start as Unknown on each page.
    """
    marked = section_headers(rows)
    hint = F.array_contains(hints, F.col("stripped")) if hints is not None else F.lit(False)
    marked = marked.withColumns({"is_header": F.col("number").isNotNull(), "is_hint": F.col("number").isNull() & (F.col("stripped") != "") & F.coalesce(hint, F.lit(False))})
    name = F.when(F.col("is_header"), F.concat_ws(" ", "number", "title")).when(F.col("is_hint"), F.col("stripped"))
    order = W.partitionBy(*PAGE).orderBy("ln")
    named = marked.withColumn("name", name)
    before = F.coalesce(F.last("name", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit("Unknown"))
    deep = F.col("is_header") & F.contains("number", F.lit("."))
    named = named.withColumn("up", F.when(F.col("name").isNull(), F.lit(None)).when(deep, before).otherwise(F.col("name")))
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    carried = named.withColumns(
        {
            "section": F.coalesce(F.last("name", ignorenulls=True).over(so_far), F.lit("Unknown")),
            "parent_section": F.coalesce(F.last("up", ignorenulls=True).over(so_far), F.lit("Unknown")),
        }
    )
    return carried.withColumn("brk", ((F.col("stripped") == "") | F.col("is_header") | F.col("is_hint")).cast("int"))


def paragraphs(rows: DataFrame, hints: Column | None = None, page_type: Column | None = None) -> DataFrame:
    """(doc_id, page, para, text, section, parent_section, chunk_type, n_lines); para counts from 1."""
    order = W.partitionBy(*PAGE).orderBy("ln").rowsBetween(W.unboundedPreceding, 0)
    island = sections(rows, hints).withColumn("island", F.sum("brk").over(order)).filter("stripped <> ''")
    kept = island.withColumn("bullet", F.col("stripped").rlike(BULLET_PATTERN).cast("int"))
    packed = kept.groupBy(*PAGE, "island").agg(
        F.array_sort(F.collect_list(F.struct("ln", "stripped"))).alias("l"),
        F.min_by(F.struct("section", "parent_section"), "ln").alias("s"),
        F.sum("bullet").alias("bullets"),
        F.count(F.lit(1)).alias("n_lines"),
    )
    is_list = (F.col("bullets") > 0.5 * F.col("n_lines")) & (F.col("n_lines") >= 2)
    kind = F.when(is_list, "list").otherwise(F.lit("paragraph") if page_type is None else page_type)
    return packed.select(
        *PAGE,
        F.row_number().over(W.partitionBy(*PAGE).orderBy("island")).alias("para"),
        F.array_join(F.transform("l", lambda x: x.stripped), "\n").alias("text"),
        "s.section",
        "s.parent_section",
        kind.alias("chunk_type"),
        "n_lines",
    )


def pack(text: Column, max_tokens: int = DEFAULT.max_tokens, overlap: int = DEFAULT.overlap_tokens) -> Column:
    """The text in chunks of up to max_tokens, cut at sentences; each chunk but the first repeats the
    last sentences of the one before, up to ``overlap`` tokens and one sentence at least."""
    sentence = "struct<s:string,n:bigint>"
    state = f"struct<out:array<string>,cur:array<{sentence}>,n:bigint>"
    items = F.transform(sentences(text), lambda s: F.struct(s.alias("s"), token_count(s).alias("n")))
    joined = lambda cur: F.array_join(F.transform(cur, lambda x: x.s), " ")

    def tail(cur: Column) -> Column:
        start = F.struct(F.array().cast(f"array<{sentence}>").alias("k"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("full"))

        def step(a: Column, x: Column) -> Column:
            full = a.full | ((a.n + x.n > overlap) & (F.size(a.k) > 0))
            return F.struct(F.when(full, a.k).otherwise(F.concat(F.array(x), a.k)).alias("k"), F.when(full, a.n).otherwise(a.n + x.n).alias("n"), full.alias("full"))

        return F.aggregate(F.reverse(cur), start, step)

    def step(a: Column, x: Column) -> Column:
        flush = (a.n + x.n > max_tokens) & (F.size(a.cur) > 0)
        again = F.get(
            F.transform(
                F.array(tail(a.cur)),
                lambda t: F.struct(F.concat(a.out, F.array(joined(a.cur))).alias("out"), F.concat(t.k, F.array(x)).alias("cur"), (t.n + x.n).alias("n")).cast(state),
            ),
            F.lit(0),
        )
        return F.when(flush, again).otherwise(F.struct(a.out.alias("out"), F.concat(a.cur, F.array(x)).alias("cur"), (a.n + x.n).alias("n")).cast(state))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast(f"array<{sentence}>").alias("cur"), F.lit(0).cast("long").alias("n")).cast(state)
    packed = F.aggregate(items, start, step, lambda a: F.when(F.size(a.cur) > 0, F.concat(a.out, F.array(joined(a.cur)))).otherwise(a.out))
    return F.when(token_count(text) <= max_tokens, F.array(text)).otherwise(packed)


def semantic_breaks(sentence_vectors: DataFrame, percent: float = 0.95) -> DataFrame:
    """Sentences (doc_id, ord, vector) with dist (cosine distance to the next), gradient of dist along the
    document and part, which rises after each gradient above the document's percentile.

    Distances are not rounded, since gradients and the percentile are made of them. One is null beside a
    vector that is null or empty, and NaN beside one of length zero. Sentences without ord come last.
    """
    from docloom.operators.retrieval import dot

    order = W.partitionBy("doc_id").orderBy(F.asc_nulls_last("ord"))
    square = F.when(F.size("vector") > 0, dot(F.col("vector"), F.col("vector")))
    near = sentence_vectors.withColumn("square", square).withColumns({"next": F.lead("vector").over(order), "next_square": F.lead("square").over(order)})
    # One root of the product: equal vectors are at exactly 0, and distances are those of the SQL to the last bit.
    norm = F.sqrt(F.col("square") * F.col("next_square"))
    cosine = F.when(norm == 0, F.lit(float("nan"))).otherwise(dot(F.col("vector"), F.col("next")) / norm)
    dist = F.get(F.transform(F.array(cosine), lambda c: 1 - F.when(F.isnan(c) | c.between(-1, 1), c).otherwise(F.signum(c))), F.lit(0))
    near = near.withColumn("dist", dist)
    d = near.filter("dist is not null").select("doc_id", "ord", "dist")
    up, down = F.lead("dist").over(order), F.lag("dist").over(order)
    gradient = F.when(up.isNull() & down.isNull(), 0.0).when(down.isNull(), up - F.col("dist")).when(up.isNull(), F.col("dist") - down).otherwise((up - down) / 2)
    g = d.withColumn("gradient", gradient)
    limit = g.groupBy("doc_id").agg(F.percentile("gradient", percent).alias("limit"))
    flagged = g.join(limit, "doc_id").withColumn("is_break", (F.col("gradient") > F.col("limit")).cast("int"))
    joined = sentence_vectors.select("doc_id", "ord").join(flagged.select("doc_id", "ord", "dist", "gradient", "is_break"), ["doc_id", "ord"], "left")
    part = F.coalesce(F.sum("is_break").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return joined.select("doc_id", "ord", "dist", "gradient", part.alias("part"))


def table_chunks(rows: DataFrame) -> DataFrame:
    """Table rows (doc_id, page, table_id, row_no, headers, cells) with a cell as chunks."""
    some = rows.filter(F.exists("cells", lambda c: strip(c) != ""))
    text = F.concat(F.lit("[Table Headers]: "), F.array_join("headers", " | "), F.lit("\n[Row "), F.col("row_no").cast("string"), F.lit("]: "), F.array_join("cells", " | "))
    return some.select(
        *PAGE,
        F.concat(F.col("table_id"), F.lit("_row_"), F.col("row_no").cast("string")).alias("chunk_id"),
        text.alias("text"),
        F.lit("Table").alias("section"),
        F.lit("Document Tables").alias("parent_section"),
        F.lit("table").alias("chunk_type"),
        "table_id",
    )


def chunk_id(*parts: str) -> Column:
    """A content id: the first 8 hex digits of the SHA-256 of the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), 256), 1, 8)


def page_chunks(rows: DataFrame, hints: Column | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Paragraphs packed to chunks, in the shape of ``table_chunks``."""
    scanned = F.first("is_ocr").alias("is_ocr") if "is_ocr" in rows.columns else None
    p = paragraphs(rows, hints)
    if scanned is not None:  # a paragraph of a page that was read by OCR is told from others
        p = p.join(rows.groupBy(*PAGE).agg(scanned), [*PAGE])
        p = p.withColumn("chunk_type", F.when((F.col("chunk_type") == "paragraph") & F.col("is_ocr"), "image_ocr").otherwise(F.col("chunk_type"))).drop("is_ocr")
    p = p.select("*", F.posexplode(pack(F.col("text"), cfg.max_tokens, cfg.overlap_tokens)).alias("part", "chunk"))
    p = p.select(*PAGE, "para", "part", F.col("chunk").alias("text"), "section", "parent_section", "chunk_type")
    named = F.concat(F.lit("chunk_"), F.col("page").cast("string"), F.lit("_"), chunk_id("doc_id", "page", "para", "part", "text"))
    return p.select(*PAGE, named.alias("chunk_id"), "text", "section", "parent_section", "chunk_type", F.lit(None).cast("string").alias("table_id"))


def all_chunks(table_rows: DataFrame, page_lines: DataFrame, hints: Column | None = None, cfg: Config = DEFAULT) -> DataFrame:
    return table_chunks(table_rows).unionByName(page_chunks(page_lines, hints, cfg))
