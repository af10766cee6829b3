"""Removal of word sequences that occur more than once in a corpus, by suffix automata.

The corpus is its own reference. Its windows of ``min_words`` words are dealt to shards by an anchor,
the least fingerprint among a window's runs of ``K`` words: equal windows have equal anchors, so all
places of a window meet in one shard, and an anchor with one place needs no look. For each
anchor left, an automaton is built over the stretches of text around it, each state counts its places,
and the stretches are streamed through it for matching statistics: a window is removed if its state
has two places or more. Automata go to the stretches by a shuffle on the anchor, not by a broadcast,
because this reference grows with the corpus.

Bounds: a stretch has at most ``min_words - K + 1`` windows, and an automaton's shard at most ``HOT``
stretches. Places of an anchor with more (copies and passages found everywhere) never meet in one task:
their stretches are first summed by content, with partial sums before the shuffle. Up to ``HOT`` contents
of an anchor make an automaton in which each counts as often as it has places; more contents are cut into
windows, which are summed in turn under the anchor.

Hashes of words choose candidates only. What a result rests on is compared as text (automata, contents)
or by SHA-256: windows and contents by 128 bits of it, rows of one doc_id by 64.

Defined results: a null text has no words and nothing is removed; an empty table gives an empty
table; rows are documents of their own, also where doc_id or the whole row repeats or doc_id is null
(equal texts then remove each other); other columns are ignored. Nothing is removed from texts of
fewer than ``min_words`` words. Judged on the input, so all places of a repeated window go.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from docloom.llm._words import batches, grams, words_of
from docloom.session import cut, ship

K = 8
HOT = 64
MIN_WORDS = 35


def _least(g: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    size = 1
    while size * 2 <= n:
        g = np.minimum(g[: len(g) - size], g[size:])
        size *= 2
    return np.minimum(g[: len(g) - (n - size)], g[n - size :]) if n > size else g


def _stretches(w, min_words: int):
    """Anchor, text, first window and number of windows of each stretch of a batch's texts.

    A stretch is a run of windows with one anchor, at most ``min_words - k + 1`` long.
    """
    k = min(K, min_words)
    span = min_words - k + 1
    anchors = _least(grams(w.hash, k), span) if len(w.hash) >= min_words else np.zeros(0, np.uint64)
    sizes = np.maximum(np.diff(w.first) - min_words + 1, 0)
    doc = np.repeat(np.arange(len(w)), sizes)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = w.first[:-1][doc] + nth
    a = anchors[at].view(np.int64)
    if not len(a):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    lengths = np.diff(np.append(begin, len(a)))
    span = min(span, 60)  # a stretch's windows are bits of a long
    if lengths.max() > span:  # also where one anchor comes again and again
        parts = -(-lengths // span)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        stop = np.repeat(begin + lengths, parts)
        begin = np.repeat(begin, parts) + inner * span
        lengths = np.minimum(span, stop - begin)
    return a[begin], doc[begin], nth[begin], lengths


def _weights(w, a, doc, nth, sizes, min_words: int) -> np.ndarray:
    """2 where a stretch holds its anchor more than once, so that it may repeat a window itself; else 1."""
    if not len(a):
        return np.zeros(0, np.int64)
    k = min(K, min_words)
    g = grams(w.hash, k).view(np.int64)
    n = sizes + min_words - k
    first = np.cumsum(n) - n
    at = np.arange(n.sum()) - np.repeat(first - (w.first[:-1][doc] + nth), n)
    return np.minimum(2, np.add.reduceat((g[at] == np.repeat(a, n)).astype(np.int64), first))


def _anchors(min_words: int):
    def run(it):
        for b in batches(it, 2):
            w = words_of(b.column(2))
            a, doc, nth, sizes = _stretches(w, min_words)
            pick = pa.array(doc)
            weight = pa.array(_weights(w, a, doc, nth, sizes, min_words))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), pa.array(a), pa.array(nth), weight], ["doc_id", "text_key", "anchor", "at", "weight"])

    return run


def _cut_out(min_words: int):
    """(doc_id, text_key, text, found: list of (at, hot)) to the stretches found there."""

    def run(it):
        for b in batches(it, 2):
            w = words_of(b.column(2))
            a, doc, nth, sizes = _stretches(w, min_words)
            index = {(int(d), int(s)): i for i, (d, s) in enumerate(zip(doc, nth))}
            rows: list[tuple] = []
            blob = w.data.tobytes()
            for i, found in enumerate(b.column(3).to_pylist()):
                base = int(w.first[i])
                for x in found:
                    j = index.get((i, x["at"]))
                    if j is None:
                        continue
                    lo = base + x["at"]
                    hi = lo + int(sizes[j]) + min_words - 1
                    text = b" ".join(blob[w.start[lo] : w.end[hi - 1]].split())
                    rows.append((i, int(a[j]), x["at"], x["hot"], text))
            if rows:
                i, anchor, at, hot, text = zip(*rows)
                pick = pa.array(i, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pick), b.column(1).take(pick), pa.array(anchor, pa.int64()), pa.array(at, pa.int64()), pa.array(hot, pa.bool_()), pa.array(text, pa.binary())],
                    ["doc_id", "text_key", "anchor", "at", "hot", "stretch"],
                )

    return run


class Automaton:
    """A suffix automaton of word sequences, with the number of places of each state."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.places = [0]
        self._summed = False

    def add(self, words: list, times: int = 1) -> None:
        """Add a sequence that has ``times`` places."""
        last = 0
        for c in words:
            last = self._step(last, c)
            self.places[last] += times

    def _split(self, p: int, q: int, c) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.places.append(0)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _step(self, p: int, c) -> int:
        q = self.next[p].get(c)
        if q is not None:
            return q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[p] + 1)
        self.places.append(0)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def sums(self) -> None:
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.places[self.link[v]] += self.places[v]
        self._summed = True

    def repeated(self, words: list, least: int) -> list[int]:
        """First words of the stretches of ``least`` words that have two places or more."""
        if not self._summed:
            self.sums()
        found, v, matched = [], 0, 0
        for i, c in enumerate(words):
            while v and c not in self.next[v]:
                v = self.link[v]
                matched = self.length[v]
            if c in self.next[v]:
                v = self.next[v][c]
                matched += 1
            if matched >= least:
                u = v
                while self.length[self.link[u]] >= least:
                    u = self.link[u]
                if self.places[u] > 1:
                    found.append(i - least + 1)
        return found


def _mask(found: list[int]) -> int:
    out = 0
    for x in found:
        out |= 1 << x
    return out


def shard_masks(stretches: list[bytes], min_words: int, places: list[int] | None = None) -> list[int]:
    """For each stretch of one anchor's places, bits of its windows that are found twice or more. places:
    how many each stretch has, if they are given by content."""
    times = Counter(stretches) if places is None else dict(zip(stretches, places))
    if places is None and len(times) == 1 and len(stretches) > 1:  # one content: each window has a place in each
        return [(1 << (stretches[0].count(b" ") + 2 - min_words)) - 1] * len(stretches)
    automaton = Automaton()
    words = {s: s.split(b" ") for s in times}
    for s, n in times.items():
        automaton.add(words[s], n)
    masks = {s: _mask(automaton.repeated(words[s], min_words)) for s in times}
    return [masks[s] for s in stretches]


def _shards(min_words: int, by_content: bool = False):
    """Rows sorted by anchor, at most HOT to an anchor, to (doc_id, text_key, at, mask); contents (anchor,
    stretch_key, times, stretch) to (anchor, stretch_key, mask)."""

    def run(it):
        anchor, held = None, None  # rows of the anchor that goes on in the next batch

        def judged(t: pa.Table):
            a = t.column("anchor").to_numpy()
            s = t.column("stretch").to_pylist()
            times = t.column("times").to_pylist() if by_content else None
            edges = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)]
            masks: list[int] = []
            for i, j in zip(edges, edges[1:]):
                masks += shard_masks(s[i:j], min_words, times and times[i:j]) if j > i else []
            t = t.drop_columns(["times", "stretch"] if by_content else ["anchor", "stretch"]).append_column("mask", pa.array(masks, pa.int64()))
            return t.filter(pa.array([m != 0 for m in masks], pa.bool_())).to_batches()

        for b in batches(it):
            t = pa.Table.from_batches([b])
            if held is not None:
                t = pa.concat_tables([held, t])
            a = t.column("anchor").to_numpy()
            anchor = a[-1]
            keep = int(np.searchsorted(a, anchor)) if a[0] != anchor else 0
            held = t.slice(keep).combine_chunks()
            if keep:
                yield from judged(t.slice(0, keep))
        if held is not None:
            yield from judged(held)

    return run


def _hot_windows(min_words: int):
    """(anchor, stretch, stretch_key, times) to (anchor, window's digest, nth, stretch_key, times)."""

    def run(it):
        for b in batches(it, 1):
            w = words_of(b.column(1))
            blob = w.data.tobytes()  # words of a stretch are joined by one space, so equal windows have equal bytes
            sizes = np.maximum(np.diff(w.first) - min_words + 1, 0)
            row = np.repeat(np.arange(len(w)), sizes)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = w.first[:-1][row] + nth
            spans = zip(w.start[at].tolist(), w.end[at + min_words - 1].tolist())
            window = [hashlib.sha256(blob[s:e]).digest()[:16] for s, e in spans]
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pick), pa.array(window, pa.binary()), pa.array(nth), b.column(2).take(pick), b.column(3).take(pick)],
                ["anchor", "window", "nth", "stretch_key", "times"],
            )

    return run


def _removed(words: list[bytes], found, min_words: int) -> list[tuple[int, int]]:
    """Maximal spans [first, end) of words that windows cover, from (at, mask) pairs."""
    at = sorted(x["at"] + i for x in found or () for i in range(x["mask"].bit_length()) if x["mask"] >> i & 1)
    spans: list[tuple[int, int]] = []
    for s in at:
        if spans and s <= spans[-1][1]:
            spans[-1] = (spans[-1][0], s + min_words)
        else:
            spans.append((s, s + min_words))
    return spans


_SPLIT = b" \t\n\x0b\x0c\r"


def _result(min_words: int, with_text: bool):
    """(doc_id, text_key, text[, found]) to the result's rows."""

    def run(it):
        for b in batches(it, 2):
            found = b.column(3).to_pylist() if b.num_columns > 3 else [None] * b.num_rows
            n_words, n_removed, digests, kept_texts, all_spans = [], [], [], [], []
            texts = b.column(2).cast(pa.large_binary())
            offsets = words_of(texts) if with_text and any(found) else None
            for i, text in enumerate(texts.to_pylist()):
                words = text.split() if text is not None else []
                spans = _removed(words, found[i], min_words)
                kept, last = [], 0
                for s, e in spans:
                    kept += words[last:s]
                    last = e
                kept += words[last:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                if with_text:
                    all_spans.append([{"first": s, "end": e} for s, e in spans])
                    if spans:  # keep the white space that stands between kept words
                        base, at = int(offsets.first[i]), int(offsets.at[i])
                        parts, last = [], 0
                        for s, e in spans:
                            parts.append(text[last : int(offsets.start[base + s]) - at])
                            last = int(offsets.start[base + e]) - at if e < len(words) else len(text)
                        text = b"".join([*parts, text[last:]]).rstrip(_SPLIT)
                    kept_texts.append(text)
            out = [b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "text_key", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                out += [pa.array(kept_texts, pa.binary()).cast(pa.string()), pa.array(all_spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))]
                names += ["kept_text", "spans"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text: the pair names a row's text; rows with the same pair are copies."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_key"), text.alias("text"))


def _text_key():
    """As in ``keyed``, from the text's SHA-256: texts of one xxhash64 are easily made, also of one doc_id."""
    return F.xxhash64(F.sha2(F.col("text").cast("string").cast("binary"), 256)).alias("text_key")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", _text_key(), F.col("text").cast("string").alias("text"))


def _schema(docs: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    out = T.StructType([docs.schema["doc_id"], T.StructField("text_key", T.LongType())])
    for name, kind in fields:
        out = out.add(name, T.DataType.fromDDL(kind))
    return out


def repeated_windows(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """Documents with a candidate anchor, and their repeated windows as (at, mask) rows."""
    spark = docs.sparkSession
    ship(spark)
    d = _keyed(docs)
    # A short text has no window; its bytes bound its words.
    anchors = d.filter(F.octet_length("text") >= 2 * min_words - 1).mapInArrow(_anchors(min_words), _schema(d, ("anchor", "bigint"), ("at", "bigint"), ("weight", "bigint")))
    seen = anchors.groupBy("anchor").agg(F.sum("weight").alias("n")).filter("n > 1")
    wanted = (
        anchors.join(seen, "anchor")
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("at", (F.col("n") > HOT).alias("hot"))).alias("found"))
    )
    some = cut(
        d.alias("d")
        .join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_key") == F.col("w.text_key")))
        .select("d.doc_id", "d.text_key", "d.text", "w.found")
    )
    shape = _schema(d, ("anchor", "bigint"), ("at", "bigint"), ("hot", "boolean"), ("stretch", "binary"))
    part = lambda hot: some.withColumn("found", F.filter("found", lambda x: x.hot == F.lit(hot))).filter(F.size("found") > 0).mapInArrow(_cut_out(min_words), shape)

    cold = (
        part(False)
        .select("doc_id", "text_key", "at", "anchor", "stretch")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_shards(min_words), _schema(d, ("at", "bigint"), ("mask", "bigint")))
    )
    # A hot anchor: sums by content, then an automaton or sums by window; rows find their content's mask by a join.
    hot = part(True).withColumn("stretch_key", F.unhex(F.left(F.sha2("stretch", 256), F.lit(32))))
    contents = cut(hot.groupBy("anchor", "stretch_key", "stretch").agg(F.count(F.lit(1)).alias("times")))
    many = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("anchor")
    few = contents.join(many, "anchor", "left_anti").select("anchor", "stretch_key", "times", "stretch")
    judged = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shards(min_words, True), "anchor bigint, stretch_key binary, mask bigint")
    windows = contents.join(many, "anchor", "left_semi").select("anchor", "stretch", "stretch_key", "times").mapInArrow(_hot_windows(min_words), "anchor bigint, window binary, nth bigint, stretch_key binary, times bigint")
    twice = windows.groupBy("anchor", "window").agg(F.sum("times").alias("n")).filter("n > 1").select("anchor", "window")
    masks = windows.join(twice, ["anchor", "window"]).groupBy("anchor", "stretch_key").agg(F.bit_or(F.expr("shiftleft(1L, cast(nth as int))")).alias("mask"))
    masks = judged.unionByName(masks)
    hot = hot.select("doc_id", "text_key", "at", "anchor", "stretch_key").join(masks, ["anchor", "stretch_key"]).select("doc_id", "text_key", "at", "mask")
    return some, cold.unionByName(hot)


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, with_text: bool = False) -> DataFrame:
    """A row for each document: doc_id, text_key, n_words, n_removed, kept_sha256.

    Words that a window of ``min_words`` words with another place covers are removed. kept_sha256 is
    of the kept words joined by one space. With ``with_text`` also kept_text (the text without the
    removed spans; unchanged if none) and spans (word positions).
    """
    d = _keyed(docs)
    some, found = repeated_windows(docs, min_words)
    spans = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "mask")).alias("found"))
    shape = [("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")]
    shape += [("kept_text", "string"), ("spans", "array<struct<first:bigint,end:bigint>>")] if with_text else []
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))
    spans = cut(spans)
    changed = (
        some.alias("s").join(spans.alias("f"), same("s", "f")).select("s.doc_id", "s.text_key", "s.text", "f.found").mapInArrow(_result(min_words, with_text), _schema(d, *shape))
    )
    whole = d.mapInArrow(_result(min_words, with_text), _schema(d, *shape))
    whole = whole.alias("d").join(spans.select("doc_id", "text_key").alias("f"), same("d", "f"), "left_anti")
    return whole.unionByName(changed)


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, with repeated spans cut out of text; other texts stay as they are."""
    some, found = repeated_windows(docs, min_words)
    spans = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "mask")).alias("found"))
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_key") == F.col("f.text_key"))
    texts = some.alias("d").join(spans.alias("f"), same).select("d.doc_id", "d.text_key", "d.text", "f.found")
    shape = _schema(docs, ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string"), ("kept_text", "string"), ("spans", "array<struct<first:bigint,end:bigint>>"))
    changed = texts.mapInArrow(_result(min_words, True), shape).groupBy("doc_id", "text_key").agg(F.any_value("kept_text").alias("kept_text"))  # rows that repeat
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id"), _text_key()).alias("d")
    out = rows.join(changed.alias("f"), same, "left").select("d._row", "f.kept_text")
    return out.select(*[(F.coalesce("kept_text", F.col("_row.text")).alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c)) for c in docs.columns])
