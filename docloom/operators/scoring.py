"""Scoring of results against company profiles, and the normalisers of the read side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docloom.config import NOT_FOUND


def tender_summary(summary: Column, deliverables: Column, components: Column) -> Column:
    """The summary, the first 5 deliverables and the first 10 components, in three lines."""
    return F.concat(
        F.lit("Scope Summary: "), F.coalesce(summary, F.lit("")), F.lit("\nDeliverables: "), F.array_join(F.slice(deliverables, 1, 5), ", "), F.lit("\nKey Components: "), F.array_join(F.slice(components, 1, 10), ", ")
    )


def parsed_score(raw: Column) -> Column:
    """struct(match_score, cost_feasibility, reasoning) of a model's answer, with defaults."""
    p = F.from_json(raw, "match_score int, cost_feasibility string, reasoning string")
    return F.struct(F.coalesce(p.match_score, F.lit(0)).alias("match_score"), F.coalesce(p.cost_feasibility, F.lit("Unknown")).alias("cost_feasibility"), F.coalesce(p.reasoning, F.lit("")).alias("reasoning"))


def baseline_match(pairs: DataFrame) -> DataFrame:
    """Pairs (needs, location, cost; capabilities, locations, exclusions, budget) with a score without a
    model: 60 for the share of needs met, 20 for the location, 20 for the budget; 0 if a need is excluded."""
    met = F.size(F.array_intersect("needs", "capabilities"))
    share = F.when(F.size("needs") > 0, met / F.size("needs")).otherwise(F.lit(0.0))
    points = 60 * share + F.when(F.array_contains("locations", F.col("location")), 20).otherwise(0) + F.when(F.col("cost") <= F.col("budget"), 20).otherwise(0)
    score = F.when(F.arrays_overlap("needs", "exclusions"), 0).otherwise(F.floor(points + 0.5)).cast("int")
    feasible = F.when(F.col("cost") <= 0.5 * F.col("budget"), "High").when(F.col("cost") <= F.col("budget"), "Medium").otherwise("Low")
    return pairs.withColumns({"match_score": score, "cost_feasibility": F.when(F.col("budget").isNull(), "Unknown").otherwise(feasible)})


def score_band(score: Column) -> Column:
    s = F.least(F.greatest(score, F.lit(0)), F.lit(100))
    return F.when(s > 70, "green").when(s > 40, "yellow").otherwise("red")


def confidence_number(raw: Column) -> Column:
    """A number clamped to 0 to 1, or the value of a bucket's name; 0 for anything else."""
    number, name = raw.try_cast("double"), F.upper(F.coalesce(raw, F.lit("")))
    named = F.when(name == "HIGH", 0.9).when(name == "MEDIUM", 0.65).when(name == "LOW", 0.35).otherwise(0.0)
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).otherwise(named)


def display_bucket(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def first_entries(specs: Column, n: int = 3) -> Column:
    """The first entries of a map as text."""
    return F.array_join(F.transform(F.slice(F.map_entries(specs), 1, n), lambda e: F.concat(e.key, F.lit(": "), e.value)), ", ")


def normalise_scope(scopes: DataFrame) -> DataFrame:
    """Scopes of the current or the older shape (tasks with task_description, exclusions with item)."""
    some = lambda c: F.filter(c, lambda x: x.isNotNull() & (x != ""))
    inferred = some(F.transform("tasks", lambda t: t.task_description))
    empty = F.array().cast("array<string>")
    return scopes.withColumns(
        {
            "summary": F.coalesce(F.nullif("summary", F.lit("")), F.lit(NOT_FOUND)),
            "deliverables": F.when(F.size(F.coalesce("deliverables", empty)) > 0, F.col("deliverables")).otherwise(F.coalesce(inferred, empty)),
            "exclusions": F.coalesce(some(F.col("exclusions")), some(F.transform("exclusion_items", lambda x: x["item"])), empty),
        }
    )


LEGACY_FIELDS = ("specification_text", "unit", "numeric_value", "tolerance", "standard_reference", "material")


def display_specs(specs: DataFrame, key: str, order: str) -> DataFrame:
    """Specifications of the current or the older shape as they are shown: key, place (from 1), component
    (else item_name, else ``Spec`` and its place), specs, confidence from 0 to 1, and the source with its defaults."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(key).orderBy(order))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    legacy = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, LEGACY_FIELDS)), F.array(*LEGACY_FIELDS)), lambda k, v: F.coalesce(~v.isin("", NOT_FOUND), F.lit(False)))
    return specs.withColumn("place", place).select(
        key,
        "place",
        F.coalesce(some("component"), some("item_name"), F.concat(F.lit("Spec "), F.col("place").cast("string"))).alias("component"),
        F.coalesce("specs", legacy).alias("specs"),
        confidence_number(F.col("confidence")).alias("confidence"),
        *[F.coalesce(some(c), F.lit(NOT_FOUND)).alias(c) for c in ("chunk_id", "clause", "exact_text")],
        F.coalesce("page", F.lit(0)).alias("page"),
    )


def search_specs(specs: DataFrame, text: str, columns: list[str], bucket: Column | None = None, wanted: str | None = None) -> DataFrame:
    """Specifications whose columns hold the text in any case, and whose bucket is the wanted one, if one is."""
    found = specs.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lower(F.lit(text))))
    return found if wanted is None else found.filter(bucket == wanted)


def add_tags(tags: Column, new: Column) -> Column:
    """The list with the trimmed tag, if it is not empty and not there."""
    t = F.trim(new)
    return F.when((t == "") | F.array_contains(tags, t), tags).otherwise(F.concat(tags, F.array(t)))
