"""The corpus pipeline: quality rules, one of each group of near copies, repeated passages, benchmark
passages, tokens. Each stage calls one operator of docloom.llm on all rows that the one before kept.

All stages but the last return the columns of their input. Texts change in the third: repeated passages
are cut out, the white space between kept words stays, and n_chars follows the text where it is a column.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.llm.bpe import bpe_encode_decode
from docloom.llm.decontamination import drop_contaminated
from docloom.llm.ngram_join import keep_one
from docloom.llm.quality_rules import filter_quality
from docloom.llm.substring_dedup import cut_repeats
from docloom.session import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rule or the learned decision list."""
    return filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of each component of near copies."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words out of texts that windows of 35 words with another place cover."""
    out = cut_repeats(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its error budget."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text. Workers keep less than in a run of this stage
    alone, because executors still hold what earlier stages took."""
    return bpe_encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, remembered=1 << 17)


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_copies),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_passages),
    ("bpe_encode_decode", tokens),
]
#: Learned rules, edit distances and merges have no SQL form: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, over all of ``documents``; each stage's rows are computed once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
