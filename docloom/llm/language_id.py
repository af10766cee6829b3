"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1 (``DIMENSIONS`` of them); a trigram's vector is the product
of its letters' vectors, the first rotated by two places and the second by one (binding), and a text's
vector is the sum over its trigrams (bundling). A language's prototype is the sum of its documents'
unit vectors; a text gets the language of the prototype with the greatest cosine.

Letters are those of the lower-cased text: a to z have vectors of their own, other letters share
``OTHERS`` vectors by code point; each run of other characters is one blank, as are a text's ends.

Learning takes at most about ``SAMPLE`` documents with a language, those whose hashed doc_id is least;
their vectors are summed on the executors, in whole numbers, so that order does not matter, and only the
prototypes come to the driver and are broadcast (one vector a language). doc_id, lang and source play no
part in a prediction.

Defined results: a null text or one without a letter gives ``und`` and 0; without prototypes all do;
cosines that are equal to nine places are ties,
which go to the least language; a null doc_id is not held out and not learned from; rows that repeat give
as many rows; other columns are ignored; an empty table gives an empty table. Whole texts are used.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from docloom.llm._words import batches
from docloom.session import ship

DIMENSIONS = 512
OTHERS = 37
SAMPLE = 50_000
_M = 64  # blank, 26 letters, OTHERS
_SCALE = 1 << 20
#: Decimal places to which cosines are compared.
_PLACES = 9
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The symbol of each code point: 0 for a blank."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x80, 0x110000):
        if chr(c).isalpha():
            table[c] = 27 + c * 2654435761 % 2**32 * OTHERS // 2**32
    table[97:123] = np.arange(1, 27)
    table[65:91] = np.arange(1, 27)
    return table


@lru_cache(maxsize=2)
def _vectors(dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter vectors for the first, second and third place of a trigram."""
    plain = np.random.Generator(np.random.PCG64(7)).integers(0, 2, (_M, dimensions), dtype=np.int8) * 2 - 1
    return np.roll(plain, 2, axis=1), np.roll(plain, 1, axis=1), plain


def text_vector(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """The bundle of a text's trigram vectors; None without a letter."""
    if not text:
        return None
    symbols = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    symbols = np.concatenate(([0], symbols, [0])).astype(np.int32)
    keep = np.append(True, (symbols[1:] != 0) | (symbols[:-1] != 0))
    symbols = symbols[keep]
    if len(symbols) < 3:
        return None
    codes = np.sort((symbols[:-2] * _M + symbols[1:-1]) * _M + symbols[2:])
    edges = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    counts = np.diff(np.append(edges, len(codes))).astype(np.float32)
    codes = codes[edges]
    first, second, third = _vectors(dimensions)
    out = np.zeros(dimensions, np.float64)
    for i in range(0, len(codes), 4096):  # bounded memory for long texts
        c = codes[i : i + 4096]
        grams = first[c // (_M * _M)] * second[c // _M % _M] * third[c % _M]
        out += counts[i : i + 4096] @ grams.astype(np.float32)
    return out


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their unit vectors, from documents that are not held out."""
    ship(docs.sparkSession)
    known = docs.filter("lang is not null and text is not null and doc_id is not null").filter(~is_held_out(F.col("doc_id")))
    n = known.count()
    if n > sample:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample / n))

    def run(it):
        sums: dict[str, np.ndarray] = {}
        for b in batches(it, 1):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = text_vector(text, dimensions)
                if v is not None and (size := np.sqrt(v @ v)):
                    sums.setdefault(lang, np.zeros(dimensions, np.int64))
                    sums[lang] += np.rint(v * (_SCALE / size)).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([list(v) for v in sums.values()], pa.list_(pa.int64()))], ["lang", "vector"])

    parts = known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, "lang string, vector array<bigint>")
    summed = parts.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).select("lang", "v.x").collect()
    found = sorted((r[0], np.array(r[1], np.float64)) for r in rows if any(r[1]))
    return [k for k, _ in found], np.array([v / np.sqrt(v @ v) for _, v in found]).reshape(len(found), dimensions)


def language_id(docs: DataFrame, learn_from: DataFrame | None = None, dimensions: int = DIMENSIONS, sample: int = SAMPLE) -> DataFrame:
    """A row for each document: doc_id, held_out, lang_pred, score (cosine, 0 at least)."""
    langs, matrix = prototypes(learn_from if learn_from is not None else docs, dimensions, sample)
    shared = docs.sparkSession.sparkContext.broadcast((langs, matrix))

    def run(it):
        names, table = shared.value
        for b in batches(it, 2):
            preds, scores = [], []
            for text in b.column(2).to_pylist():
                v = text_vector(text, dimensions)
                size = np.sqrt(v @ v) if v is not None else 0.0
                if not names or v is None:
                    preds.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = table @ v / size if size else np.zeros(len(names))
                best = int(np.argmax(np.round(cosines, _PLACES)))
                preds.append(names[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    shape = T.StructType([docs.schema["doc_id"]]).add("held_out", "boolean").add("lang_pred", "string").add("score", "double")
    return docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, shape)
