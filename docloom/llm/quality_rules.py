"""Quality rules: a learned decision list over text statistics, as ordered Spark conditions.

Statistics, rules and verdicts are DataFrame expressions without a shuffle: each row is judged alone,
whatever its size or how often it repeats. Rules come from labelled documents by sequential covering: a
rule for low quality grows by the threshold condition of most information gain, is pruned on rows held
back from growing, and is kept if it is precise there; the rows that it covers are then set aside for
the next rule. Learning takes about ``SAMPLE`` labels at most, those whose hashed doc_id is least, which
are broadcast, and twice as many rows of ``documents`` that they name (by a hash of the text, if ids repeat);
only the statistics of these are computed and come to the driver (a few numbers a row).

Defined results: a null or empty text has no words, all statistics 0, and fails the base rule; labels
that are null or of unknown documents are not learned from, and without labels of both kinds there are
no learned rules; where labels of a document disagree, each counts; labels and labelled rows that repeat
count once; other columns are ignored; an empty
table gives an empty table; rows that repeat give as many rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Labelled rows to learn from, about; a parameter of ``learn_rules``.
SAMPLE = 20_000
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WHITE = " \t\n\x0b\x0c\r"
#: Shares that do not fall or rise with a text's length, so that long texts are judged like short ones.
FEATURES = ("symbol_share", "upper_share", "word_chars_mean", "dup_line_share", "repeat_share")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda's variable, which no optimizer rule expands."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more."""
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    found = _let(F.sort_array(windows), lambda s: F.filter(s, lambda x, i: (x.h == F.get(s, i - 1).h) | (x.h == F.get(s, i + 1).h)))
    positions = F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x.i, x.i + 1, x.i + 2))))
    return F.when(n >= 3, F.size(positions)).otherwise(0)


def statistics(text: Column) -> Column:
    """A struct of the base counts and FEATURES of a text; one expression that reads the text once."""
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def counts(t: Column, words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(_without(t, _WHITE)).cast("long").alias("word_chars"),
            (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _covered(words).cast("long").alias("n_repeat_words"),
            (F.length(t) - F.length(_without(t, UPPER))).cast("long").alias("n_upper"),
            F.size(lines).cast("long").alias("n_lines"),
        )

    def shares(c: Column) -> Column:
        base = [c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        return F.struct(
            *base,
            part(c.n_symbols, c.word_chars).alias("symbol_share"),
            part(c.n_upper, c.word_chars).alias("upper_share"),
            part(c.word_chars, c.n_words).alias("word_chars_mean"),
            part(c.n_dup_lines, c.n_lines).alias("dup_line_share"),
            part(c.n_repeat_words, c.n_words).alias("repeat_share"),
        )

    words = lambda t: F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = lambda t: F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(F.coalesce(text.cast("string"), F.lit("")), lambda t: _let(words(t), lambda w: _let(lines(t), lambda x: _let(counts(t, w, x), shares))))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    limit: float

    def column(self, stats: Column) -> Column:
        c = stats[self.feature]
        return c > F.lit(self.limit) if self.above else c <= F.lit(self.limit)

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        v = values[self.feature]
        return v > self.limit if self.above else v <= self.limit

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:g}"


Rule = tuple[Condition, ...]


def _all_hold(rule: Rule, values: dict, n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(values)
    return out


def _best(values: dict, bad: np.ndarray, inside: np.ndarray) -> Condition | None:
    """The condition of most information gain (FOIL) on the rows inside; ties: first feature, least limit."""
    p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
    if not p0 or not n0:
        return None
    before, best, gain = np.log2(p0 / (p0 + n0)), None, 1e-9
    for feature in FEATURES:
        v = values[feature]
        cuts = np.unique(np.quantile(v[inside], np.linspace(0, 1, 65)))
        for limit in np.unique(np.round((cuts[1:] + cuts[:-1]) / 2, 6)):
            high = inside & (v > limit)
            p, n = int((bad & high).sum()), int((~bad & high).sum())
            for above, a, b in ((True, p, n), (False, p0 - p, n0 - n)):
                if a and (g := a * (np.log2(a / (a + b)) - before)) > gain:
                    best, gain = Condition(feature, above, float(limit)), g
    return best


def cover(rows: list[tuple], min_precision: float = 0.95, min_rows: int = 3, max_rules: int = 16, max_conditions: int = 4) -> list[Rule]:
    """Rules for low quality from (features..., quality) rows; every third row is held back for pruning."""
    if not rows:
        return []
    table = np.array(rows, float)
    values = {f: table[:, i] for i, f in enumerate(FEATURES)}
    bad, n = table[:, -1] == 0, len(table)
    if bad.all() or not bad.any():
        return []
    held = np.arange(n) % 3 == 2
    left, rules = np.ones(n, bool), []
    for _ in range(max_rules):
        grow, prune = left & ~held, left & held
        rule: Rule = ()
        inside = grow.copy()
        while len(rule) < max_conditions and (c := _best(values, bad, inside)):
            rule += (c,)
            inside &= c.holds(values)
        if not rule:
            break

        def worth(r: Rule) -> tuple[float, int]:
            x = _all_hold(r, values, n) & prune
            p, q = int((x & bad).sum()), int((x & ~bad).sum())
            return ((p - q) / (p + q) if p + q else -1.0, -len(r))

        rule = max((rule[: k + 1] for k in range(len(rule))), key=worth)
        inside = _all_hold(rule, values, n) & left
        p, q = int((inside & bad).sum()), int((inside & ~bad).sum())
        x = inside & held
        precise = p >= min_rows and p >= min_precision * (p + q) and (x & bad).sum() >= min_precision * max(1, x.sum())
        if precise:
            rules.append(rule)
        left &= ~inside  # a rule that is not precise is left out, and the rows that it misled with it
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """An ordered decision list for quality 0 from the labelled documents' statistics."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).filter("_id is not null and quality in (0, 1)").distinct()
    n = known.count()
    if not n:
        return []
    buckets = 1 << 20
    if n > sample:  # rows with the least hashes, about ``sample`` of them
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(buckets)) < int(buckets * sample / n))
    same = F.col("_doc") == F.col("_id")
    rows = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).join(F.broadcast(known), same)
    m = docs.select(F.col("doc_id").alias("_doc")).join(F.broadcast(known.select("_id")), same).count()
    if m > 2 * sample:  # ids that repeat with many texts
        rows = rows.filter(F.pmod(F.xxhash64("_id", "_text"), F.lit(buckets)) < int(buckets * 2 * sample / m))
    rows = rows.select("_id", "quality", statistics(F.col("_text")).alias("s"))
    rows = rows.select("_id", *[f"s.{f}" for f in FEATURES], "quality", base_failed(F.col("s")).alias("_failed")).distinct()
    rows = rows.orderBy(F.xxhash64("_id"), "_id", *FEATURES, "quality").collect()
    # The list judges texts that the base rule passes, so it learns from these.
    return cover([tuple(r)[1:-1] for r in rows if not r["_failed"]])


def verdict(rules: list[Rule], stats: Column) -> Column:
    """The rules as one conditional expression, tried in order: false for low quality, else true."""
    out = None
    for rule in rules:
        condition = rule[0].column(stats)
        for c in rule[1:]:
            condition = condition & c.column(stats)
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def is_kept(rules: list[Rule], stats: Column) -> Column:
    return ~base_failed(stats) & verdict(rules, stats)


def quality_rules(docs: DataFrame, labels: DataFrame | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """A row for each document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept. Rules are learned from ``labels`` unless given."""
    if rules is None:
        rules = learn_rules(docs, labels) if labels is not None else []
    judged = docs.select("doc_id", statistics(F.col("text")).alias("s"))
    s = F.col("s")
    return judged.select("doc_id", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words", base_failed(s).alias("base_failed"), is_kept(rules, s).alias("kept"))


def filter_quality(docs: DataFrame, labels: DataFrame | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is kept."""
    if rules is None:
        rules = learn_rules(docs, labels) if labels is not None else []
    return docs.filter(_let(statistics(F.col("text")), lambda s: is_kept(rules, s)))
