"""Stores: chunks and vectors by document, profiles, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException


def _absent(e: AnalysisException) -> bool:
    """Whether a read failed because there is nothing at the path; other faults are the caller's to see."""
    return e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def save_by_document(df: DataFrame, path: str) -> None:
    """Replace the folders of the documents in ``df``; those of others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The store's rows; None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if not _absent(e):
            raise
        return None


def missing(documents: DataFrame, store: DataFrame | None) -> DataFrame:
    """Documents that the store does not hold, so that an index is reused and not made again."""
    return documents if store is None else documents.join(store.select("doc_id").distinct(), "doc_id", "left_anti")


def save_vectors(children: DataFrame, embed, path: str) -> None:
    """Vectors keyed by the content of their child, so that a changed text never meets an old vector.

    ``embed`` maps a list of texts to a list of vectors; it runs on the executors, batch by batch.
    """

    def run(it):
        for b in it:
            yield b.assign(vector=list(embed(b["text"].tolist())))[["doc_id", "key", "vector"]]

    keyed = children.select("doc_id", F.sha2("text", 256).alias("key"), "text").dropDuplicates(["doc_id", "key"])
    kind = children.schema["doc_id"].dataType.simpleString()
    save_by_document(keyed.mapInPandas(run, f"doc_id {kind}, key string, vector array<float>"), path)


def with_vectors(children: DataFrame, store: DataFrame) -> DataFrame:
    """(doc_id, child_no, vector) of the children whose text has a vector."""
    keyed = children.select("doc_id", "child_no", F.sha2("text", 256).alias("key"))
    return keyed.join(store, ["doc_id", "key"]).select("doc_id", "child_no", "vector")


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_profile(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Profiles of a JSON file; no rows if there is none."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as e:
        if not _absent(e):
            raise
        return spark.createDataFrame([], schema)


def save_profile(profile: DataFrame, path: str) -> None:
    """The profile takes the place of the one before as a whole."""
    profile.coalesce(1).write.mode("overwrite").json(path)
