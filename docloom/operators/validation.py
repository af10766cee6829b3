"""Validation: shapes of specifications, grounding of claims in chunks, accuracy and quarantine."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from docloom.config import DEFAULT, NOT_FOUND, Config
from docloom.functions.similarity import best_partial_ratio, codes_of, indel_partial_ratio, partial_ratio
from docloom.functions.text import before, confidence_bucket, found, has_letter, strip
from docloom.session import cut, ship

LEGACY = (("specification", "specification_text"), ("unit", "unit"), ("numeric_value", "numeric_value"), ("tolerance", "tolerance"), ("standard_reference", "standard_reference"), ("material", "material"))


def clean_map(m: Column) -> Column:
    """Stripped values; without those that are null, blank or NOT_FOUND."""
    return F.map_filter(F.transform_values(m, lambda k, v: found(v)), lambda k, v: v.isNotNull())


def normalise_component(component: Column, spec_text: Column) -> Column:
    """The component if it has a letter and is no number, else what the specification starts with."""
    clean = strip(F.coalesce(component, F.lit("")))
    serial = F.regexp_replace(clean, r"^([^.]*)\.", "$1").rlike("^[0-9]+$")
    text = F.coalesce(spec_text, F.lit(""))
    left = F.regexp_replace(before(text, ":"), "^[ \\-•\t]+|[ \\-•\t]+$", "")
    return (
        F.when((clean != "") & ~serial & has_letter(clean), clean)
        .when(F.contains(text, F.lit(":")) & (F.length(left) >= 4) & has_letter(left), F.substring(left, 1, 80))
        .when(text != "", strip(F.substring(text, 1, 80)))
        .when(clean != "", clean)
        .otherwise(F.lit(NOT_FOUND))
    )


def normalise_specs(specs: DataFrame) -> DataFrame:
    """Rows of either shape (component, specs; or item_name and the legacy fields) with chunk_id, page,
    clause, exact_text and confidence as strings, in the current shape."""
    legacy = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), found(F.col(c)).alias("value")) for k, c in LEGACY]), lambda x: x.value.isNotNull()))
    current = clean_map(F.col("specs"))
    both = F.map_concat(F.map_filter(current, lambda k, v: ~F.map_contains_key(legacy, k)), legacy)
    is_current = F.col("component").isNotNull() & F.col("specs").isNotNull()
    merged = F.when(is_current, current).when(F.col("specs").isNull(), legacy).otherwise(both)
    named = F.when(is_current, F.col("component")).otherwise(strip(F.coalesce(F.nullif(F.col("component"), F.lit("")), F.nullif(F.col("item_name"), F.lit("")), F.lit(NOT_FOUND))))
    out = specs.withColumns({"_specs": merged, "_name": named})
    text = F.coalesce(F.try_element_at("_specs", F.lit("specification")), F.try_element_at("_specs", F.lit("specification_text")))
    keep = [c for c in specs.columns if c not in {"component", "specs", "item_name", "chunk_id", "page", "clause", "exact_text", "confidence", *[c for _, c in LEGACY]}]
    return out.select(
        *keep,
        normalise_component(F.col("_name"), text).alias("component"),
        F.col("_specs").alias("specs"),
        F.coalesce("chunk_id", F.lit(NOT_FOUND)).alias("chunk_id"),
        F.coalesce(F.col("page").try_cast("int"), F.lit(0)).alias("page"),
        F.coalesce("clause", F.lit(NOT_FOUND)).alias("clause"),
        F.coalesce("exact_text", F.lit(NOT_FOUND)).alias("exact_text"),
        F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.5)).alias("confidence"),
    )


def quote(exact_text: Column, component: Column) -> Column:
    """What is looked for: the quoted text, else the component's first 200 characters; null if neither."""
    usable = lambda c: F.when((c != "") & (c != NOT_FOUND), c)
    return strip(F.lower(F.coalesce(usable(exact_text), F.substring(usable(component), 1, 200))))


def grounding(claims: DataFrame, chunks: DataFrame, on: list[str]) -> DataFrame:
    """Claims (…, claim_id, quote) with score, the best partial ratio to the chunks (…, text) of the same
    ``on``; 0 without a quote or a chunk.

    A quote found whole scores 1 by a built-in; only other pairs reach the Arrow function. Chunks of a
    claim are the hits that were retrieved for it, a bounded number.
    """
    ship(claims.sparkSession)
    pairs = claims.filter("quote is not null").join(chunks.select(*on, strip(F.lower("text")).alias("_t")), on)
    pairs = pairs.withColumn("_whole", F.contains("_t", F.col("quote")))
    hit = pairs.filter("_whole").select(*on, "claim_id").distinct().withColumn("_score", F.lit(1.0))
    rest = pairs.filter("not _whole").join(hit, [*on, "claim_id"], "left_anti").select(*on, "claim_id", (indel_partial_ratio("quote", "_t") / 100.0).alias("_score"))
    best = hit.unionByName(rest).groupBy(*on, "claim_id").agg(F.max("_score").alias("score"))
    return claims.join(best, [*on, "claim_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


_CHARS = 1 << 20  # of texts that are searched together


def _best_of(quotes: list[str], texts: list[str], best: dict[str, float]) -> None:
    """Raise each quote's best partial ratio, 0 to 100, by the texts."""
    lengths = sorted(set(texts), key=len, reverse=True)
    groups: dict[int, tuple] = {}
    for q in quotes:
        n = sum(len(t) >= len(q) for t in lengths)
        if n and n not in groups:
            groups[n] = codes_of(lengths[:n])
        if n and best[q] < 100.0:
            best[q] = best_partial_ratio(q, groups[n], best[q])
        for t in lengths[n:]:
            if best[q] < 100.0:
                best[q] = max(best[q], partial_ratio(t, q))


def grounding_in_all(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """Claims (…, claim_id, quote) with score, the best partial ratio to any of the chunks (…, text); 0
    without a quote or a chunk.

    Claims are a stated, small set: the quotes that no chunk holds whole come to the driver and are
    broadcast. Each task searches its chunks for them and gives a row for each quote, so nothing else is
    shuffled.
    """
    spark = claims.sparkSession
    ship(spark)
    texts = chunks.select(strip(F.lower("text")).alias("_t")).filter("_t is not null")
    asked = claims.select("quote").filter("quote is not null").distinct()
    whole = cut(texts.join(asked, F.contains("_t", F.col("quote"))).select("quote").distinct())
    rest = sorted(r[0] for r in asked.join(whole, "quote", "left_anti").collect())
    shared = spark.sparkContext.broadcast(rest)

    def run(it):
        quotes = shared.value
        best, held, n = dict.fromkeys(quotes, 0.0), [], 0
        for b in it:
            for t in b.column(0).to_pylist():
                held.append(t)
                n += len(t)
                if n >= _CHARS:
                    _best_of(quotes, held, best)
                    held, n = [], 0
        if held:
            _best_of(quotes, held, best)
        yield pa.RecordBatch.from_arrays([pa.array(quotes, pa.string()), pa.array([best[q] / 100.0 for q in quotes], pa.float64())], ["quote", "score"])

    part = texts.mapInArrow(run, T.StructType().add("quote", "string").add("score", "double"))
    best = whole.select("quote", F.lit(1.0).alias("score")).unionByName(part.groupBy("quote").agg(F.max("score").alias("score")))
    return claims.join(best, "quote", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def is_accepted(score: Column, cfg: Config = DEFAULT) -> Column:
    return score >= cfg.reject - 1e-9


def validate(scored: DataFrame, key: str, cfg: Config = DEFAULT) -> DataFrame:
    """Per key, from claims (kind spec or deliverable, score): accepted and rejected counts, buckets of
    accepted specs, accuracy (mean of all accepted scores, in percent)."""
    ok = is_accepted(F.col("score"), cfg)
    spec, given = F.col("kind") == "spec", F.round("score", 4)
    bucket = confidence_bucket(given, cfg.high, cfg.medium)
    return scored.groupBy(key).agg(
        F.count_if(ok & spec).alias("specs"),
        F.count_if(~ok & spec).alias("specs_rejected"),
        F.count_if(ok & ~spec).alias("deliverables"),
        F.count_if(~ok & ~spec).alias("deliverables_rejected"),
        *[F.count_if(ok & spec & (bucket == b)).alias(b.lower()) for b in ("HIGH", "MEDIUM", "LOW")],
        F.coalesce(F.round(F.avg(F.when(ok, F.col("score"))) * 100, 2), F.lit(0.0)).alias("accuracy"),
    )


def clean_list(c: Column) -> Column:
    """The strings of a list that are not blank, as they are; an empty list for null."""
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: strip(x) != "")


def quarantine(specs: DataFrame) -> DataFrame:
    """Rows with their fault, or null: component blank, confidence outside 0 to 1."""
    blank = F.coalesce(strip(F.col("component")) == "", F.lit(True))
    outside = F.coalesce((F.col("confidence") < 0) | (F.col("confidence") > 1), F.lit(True))
    return specs.withColumn("fault", F.when(blank, "component").when(outside, "confidence"))


def enforce_not_found(c: Column) -> Column:
    """NOT_FOUND for a blank string; null stays."""
    return F.when(strip(c) == "", F.lit(NOT_FOUND)).otherwise(c)
