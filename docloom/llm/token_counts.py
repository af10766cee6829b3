"""Token counts with a public tokenizer's own library; only lengths leave the Arrow function.

Texts are cut where the tokenizer's split cannot go across (see ``_chunks``), if its file shows that it
works on byte-level pieces; chunks that a worker has not seen yet are encoded in batches of about
``BATCH_BYTES`` bytes, and their lengths are remembered (``REMEMBERED`` chunks at most). So a very long
text is never one call. Tokenizers whose split is not known to be safe get whole texts.

Defined results: null is an empty text with 0 bytes and tokens; rows that repeat give as many rows;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from docloom.llm._chunks import chunks
from docloom.llm._words import batches, freed, keeps
from docloom.session import ship

REMEMBERED = 1 << 20
BATCH_BYTES = 1 << 16
LIMIT = 1024


def by_bytes(texts, most: int = BATCH_BYTES):
    """Lists of texts with about ``most`` bytes each, one text at least."""
    out, size = [], 0
    for x in texts:
        out.append(x)
        size += len(x.encode())
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def _cuttable(spec: dict) -> bool:
    """Byte-level pieces by the usual pattern, no normaliser, no added token with white space about it."""
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    tokens = spec.get("added_tokens") or []
    return bool(plain) and spec.get("normalizer") is None and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() for c in t["content"]) for t in tokens)


class Counter:
    """Numbers of tokens of texts, without begin, end or other special tokens that the text lacks."""

    def __init__(self, path: str):
        self.lengths: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.cuttable = False
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.cuttable = _cuttable(json.load(f))
        self.encode = lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.cuttable:
            return [n for some in by_bytes(texts) for n in self.encode(some)]
        parts = [chunks(x) for x in texts]
        known = self.lengths
        new = list(dict.fromkeys(c for p in parts for c in p if c not in known))
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(dict.fromkeys(c for p in parts for c in p))
        for some in by_bytes(new):
            known.update(zip(some, self.encode(some)))
        return [sum(map(known.__getitem__, p)) for p in parts]


@lru_cache(maxsize=2)
def counter_of(path: str) -> Counter:
    return Counter(path)


keeps("tokens", counter_of.cache_clear)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text."""
    ship(docs.sparkSession)

    def run(it):
        counter = counter_of(path)
        for b in batches(it, 1):
            texts = b.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n = pa.array(counter.counts([x or "" for x in texts.to_pylist()]), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    shape = T.StructType([docs.schema["doc_id"]]).add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(freed(run, "tokens"), shape)
