"""A stored set of vectors by model and kind: resumable embedding runs and the retention of one model.

The store is a folder of Parquet files partitioned by ``model_id`` and ``kind``; a row is (key, part, dim, vec).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.embedprep import embed_batch, keep_model

KEYS = ["kind", "key", "part"]
SCHEMA = "key long, part long, dim long, vec array<float>, model_id string, kind string"


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The store's rows; a folder that does not exist yet is an empty store."""
    try:
        return spark.read.schema(SCHEMA).parquet(store)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def embed_missing(texts: DataFrame, store: str, embed_fn: Callable[[list[str]], np.ndarray], model_id: str,
                  prefix: str = "", max_chars: int | None = None) -> int:
    """Embed the texts that the store lacks and add them; returns how many there were.

    ``texts``: kind, key, part, text, one row per key. A run that was stopped goes on where it ended, and a run over texts
    that are all stored reads the keys only and writes nothing.
    """
    spark = texts.sparkSession
    stored = read_store(spark, store).where(F.col("model_id") == model_id).select(*KEYS)
    todo = texts.select(*KEYS, "text").join(stored, KEYS, "left_anti")
    n = todo.count()
    if n:
        made = embed_batch(todo, embed_fn, model_id, prefix, max_chars)
        made.write.mode("append").partitionBy("model_id", "kind").parquet(store)
    return n


def replace_vectors(vectors: DataFrame, store: str) -> None:
    """Put ``vectors`` in place of the partitions (model, kind) they belong to; all other partitions stay as they are."""
    (vectors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_id", "kind").parquet(store))


def _sizes(vectors: DataFrame, when: str) -> DataFrame:
    """(model_id, kind, n_vectors, n_bytes) with the names of one side of the report."""
    return vectors.groupBy("model_id", "kind").agg(
        F.count(F.lit(1)).alias(f"vectors_{when}"), F.sum(F.col("dim") * 4).cast("long").alias(f"bytes_{when}"))


def retain_model(spark: SparkSession, store: str, target: str, model_id: str) -> DataFrame:
    """Copy the store with one model's vectors only; returns the report, what stood there before and what stands now.

    (model_id, kind, vectors_before, bytes_before, vectors_after, bytes_after), zero where a model is gone. Partition
    pruning reads nothing else. A model without vectors is an error.
    """
    before = read_store(spark, store)
    keep_model(before, model_id).write.mode("overwrite").partitionBy("model_id", "kind").parquet(target)
    after = _sizes(read_store(spark, target), "after")
    report = _sizes(before, "before").join(after, ["model_id", "kind"], "left")
    return report.fillna(0, ["vectors_after", "bytes_after"])
