"""Column functions on text. All are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docloom.config import NOT_FOUND, SYNONYMS


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends; null as empty."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def token_count(c: Column) -> Column:
    """Tokens as a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


def raw_words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def found(c: Column) -> Column:
    """The stripped text; null if blank or NOT_FOUND."""
    s = strip(c)
    return F.when((s != "") & (s != NOT_FOUND), s)


def or_not_found(c: Column) -> Column:
    return F.coalesce(c, F.lit(NOT_FOUND))


def has_letter(c: Column) -> Column:
    return c.rlike(r"\p{L}")


def is_serial(c: Column) -> Column:
    """Digits only, once blanks, brackets, dots and hyphens are gone."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s().-]+", "").rlike("^[0-9]+$")


def clean_spec(c: Column) -> Column:
    """Without leading bullets, a split first letter joined to its word, white space collapsed."""
    no_bullet = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s•\-]+", ""))
    joined = F.regexp_replace(no_bullet, r"^([A-Za-z])\s+([A-Za-z]{2,})", "$1$2")
    return strip(F.regexp_replace(joined, r"\s+", " "))


def before(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, 1)


def after(c: Column, mark: str) -> Column:
    """What follows the first mark."""
    return c.substr(F.instr(c, mark) + 1, F.length(c))


def expand_query(c: Column, synonyms=SYNONYMS) -> Column:
    """The query with up to two synonyms, not yet in it, of each term in it."""
    low = F.lower(c)
    more = [F.when(F.contains(low, F.lit(term)) & ~F.contains(low, F.lit(word.lower())), F.lit(word)) for term, all_ in synonyms for word in all_[:2]]
    extra = F.concat_ws(" ", *more)
    return F.when(extra == "", c).otherwise(strip(F.concat(c, F.lit(" "), extra)))


def any_contained(c: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(t))
    return out


def confidence_bucket(score: Column, high: float = 0.90, medium: float = 0.60) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")
