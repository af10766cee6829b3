"""Benchmark decontamination: pigeonhole pieces and Myers' bit-parallel distance, over words.

Words are maximal runs without ASCII white space and punctuation, A-Z lower-cased; in scripts without
spaces between words (``_UNSPACED``) each character is a word. An item of w words may differ from a passage
by up to ``budget(w)`` word edits (insert, delete, replace). Cut into one piece more than that, a passage
within the budget holds one piece unchanged; pieces are found by the hashes of their first ``PIECE`` words,
or all if they have fewer, in one pass over a text's words. About each whole piece found, Myers' bit-parallel algorithm gives the least distance of the item to any passage there.

Items are broadcast in shards of ``SHARD_BYTES`` of text at most, with one pass over the documents for a
shard. Documents are judged row by row, without a shuffle, so hot items and copies need no care; memory
follows one text. Long texts are searched whole.

Defined results: null or empty texts and items match nothing; items of fewer than five words are found
exactly, without edits; an item_id that repeats is as many items, of which the best match is given; matches of a document and an
item are one row, with the least distance, then the first place; rows that repeat give as many rows;
other columns are ignored; empty tables give an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from docloom.llm._words import PUNCTUATION, SPACES, Words, batches, grams, words_of
from docloom.session import ship

RATE = 0.2
PIECE = 4
SHARD_BYTES = 32 << 20
_SEPARATORS = SPACES + PUNCTUATION
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}\x{30FC}])"
_BITS = 1 << 22


def _words(texts: pa.Array) -> Words:
    spaced = pc.replace_substring_regex(texts, _UNSPACED, r" \1 ")
    return words_of(spaced, lower=True, separators=_SEPARATORS)


def budget(w: int, rate: float = RATE) -> int:
    """Word edits that an item of w words may have."""
    return max(0, min(int(rate * w + 1e-9), w - 1))


class Pattern:
    """Myers' bit-parallel search for a word sequence: its least distance to any run of a text."""

    __slots__ = ("masks", "m")

    def __init__(self, words: list[int]):
        self.m = len(words)
        self.masks: dict[int, int] = {}
        for i, w in enumerate(words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i

    def best(self, text: list[int], anchored: bool = False) -> tuple[int, int]:
        """(least distance, end of the first run with it); runs start anywhere, or at 0 if anchored."""
        m, get = self.m, self.masks.get
        full, high = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score = full, 0, m
        least, at = m, 0
        for j, w in enumerate(text):
            eq = get(w, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
            ph = (ph << 1 | anchored) & full
            mh = mh << 1 & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
            if score < least:
                least, at = score, j + 1
        return least, at


@dataclass
class Item:
    key: object
    row: int
    words: np.ndarray
    budget: int
    forward: Pattern
    backward: Pattern


class Index:
    """Items and the hashes of their pieces' first words, by number of words."""

    def __init__(self, keys: list, texts: list[str], rate: float = RATE):
        w = _words(pa.array(texts, pa.string()))
        self.items: list[Item] = []
        probes: dict[int, list[tuple[int, int, int, int]]] = {}
        for row, (key, a, b) in enumerate(zip(keys, w.first[:-1], w.first[1:])):
            words = w.hash[a:b]
            n = len(words)
            if not n:
                continue
            k = budget(n, rate)
            symbols = words.tolist()
            self.items.append(Item(key, row, words, k, Pattern(symbols), Pattern(symbols[::-1])))
            edges = [n * i // (k + 1) for i in range(k + 2)]
            for start, end in zip(edges, edges[1:]):
                q = min(PIECE, end - start)
                h = int(grams(words[start : start + q], q)[0])
                probes.setdefault(q, []).append((h, len(self.items) - 1, start, end))
        self.probes = {}
        for q, rows in probes.items():
            rows.sort()
            hashes = np.array([r[0] for r in rows], np.uint64)
            flags = np.zeros(_BITS, bool)
            flags[hashes & np.uint64(_BITS - 1)] = True
            self.probes[q] = (hashes, flags, rows)

    def candidates(self, w: Words):
        """(text, item, place of the item's first word in the batch) of each piece found whole."""
        for q, (hashes, flags, rows) in self.probes.items():
            g = grams(w.hash, q)
            at = np.flatnonzero(flags[g & np.uint64(_BITS - 1)])
            left = np.searchsorted(hashes, g[at], "left")
            right = np.searchsorted(hashes, g[at], "right")
            hit = np.flatnonzero(right > left)
            docs = np.searchsorted(w.first, at[hit], "right") - 1
            for p, i, j, doc in zip(at[hit].tolist(), left[hit].tolist(), right[hit].tolist(), docs.tolist()):
                for _, item, start, end in rows[i:j]:
                    if p + end - start <= w.first[doc + 1] and np.array_equal(w.hash[p : p + end - start], self.items[item].words[start:end]):
                        yield doc, item, p - start

    def matches(self, w: Words) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(text, item) to (distance, first word, end) of the best match within the budget."""
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        seen = set()
        for doc, number, place in self.candidates(w):
            if (doc, number, place) in seen:
                continue
            seen.add((doc, number, place))
            item = self.items[number]
            base, stop = int(w.first[doc]), int(w.first[doc + 1])
            low = max(base, place - item.budget)
            run = w.hash[low : min(stop, place + len(item.words) + item.budget)].tolist()
            distance, end = item.forward.best(run)
            if distance > item.budget:
                continue
            back, length = item.backward.best(run[:end][::-1], anchored=True)
            match = (distance, low - base + end - length, low - base + end)
            if (doc, number) not in found or match < found[doc, number]:
                found[doc, number] = match
        return found


def _shards(benchmark: DataFrame, rate: float):
    """Broadcast indexes that together hold all items, each of a bounded size."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0]
    n = max(1, -(-2 * (total or 0) // SHARD_BYTES))
    for k in range(n):
        shard = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        rows = shard.orderBy("item_id", "text").toArrow().combine_chunks()
        yield spark.sparkContext.broadcast((rows.column(0), rows.column(1).to_pylist(), rate))


_INDEXES: dict = {}


def _index(shared) -> Index:
    """A shard's index, made once in each Python worker; the last few are kept."""
    if shared.value is None:
        raise ValueError("no items")
    key = id(shared.value)
    if key not in _INDEXES:
        if len(_INDEXES) >= 2:
            _INDEXES.clear()
        ids, texts, rate = shared.value
        _INDEXES[key] = (shared.value, Index(ids.to_pylist(), texts, rate))
    return _INDEXES[key][1]


def _find(shared):
    def run(it):
        index, ids = _index(shared), shared.value[0]
        for b in batches(it, 1):
            best: dict = {}
            for (doc, number), match in index.matches(_words(b.column(1))).items():
                key = (doc, index.items[number].key)
                if key not in best or match < best[key][0]:
                    best[key] = (match, index.items[number].row)
            rows = sorted((doc, *match, row) for (doc, _), (match, row) in best.items())
            if rows:
                doc, distance, first, end, row = (pa.array(x, pa.int64()) for x in zip(*rows))
                item = ids.take(row)
                item = item.combine_chunks() if isinstance(item, pa.ChunkedArray) else item
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(doc), item, distance, first, end],
                    ["doc_id", "item_id", "distance", "first_word", "end_word"],
                )

    return run


def decontamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """A row for each document and item with a passage within the item's budget: doc_id, item_id,
    distance (word edits), first_word and end_word (the passage's words in the text)."""
    ship(docs.sparkSession)
    shape = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"]])
    for name in ("distance", "first_word", "end_word"):
        shape = shape.add(name, "long")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = None
    for shared in _shards(benchmark, rate):
        part = texts.mapInArrow(_find(shared), shape)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item."""
    ship(docs.sparkSession)
    extra = "_text"
    while extra in docs.columns:
        extra += "_"
    for shared in _shards(benchmark, rate):

        def run(it, shared=shared):
            index = _index(shared)
            for b in batches(it):
                text = b.num_columns - 1
                for part in batches([b], text):
                    bad = {doc for doc, _ in index.matches(_words(part.column(text)))}
                    keep = pa.array([i not in bad for i in range(part.num_rows)], pa.bool_())
                    yield part.filter(keep)

        rows = docs.select("*", F.col("text").cast("string").alias(extra))
        docs = rows.mapInArrow(run, rows.schema).drop(extra)
    return docs
