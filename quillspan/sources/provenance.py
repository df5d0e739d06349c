"""Where an index came from: file checksums, counts and content fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.ingest import content_fingerprint
from quillspan.sources.checksums import file_digests


def file_checksums(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """(key, value): sha256 of every source file of any size, computed where the file is read."""
    files = file_digests(spark, folder, pattern)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(F.concat(F.lit("sha256_"), name).alias("key"), F.col("sha256").alias("value"))


def index_metadata(spark: SparkSession, tables: dict[str, DataFrame], fixed: dict[str, str],
                   folder: str | None = None) -> DataFrame:
    """The key/value metadata table of an index: fixed values, row counts and fingerprints, and checksums of ``folder``."""
    rows = [
        content_fingerprint(df).selectExpr(
            f"stack(2, 'rows_{name}', cast(n_rows AS string), 'fingerprint_{name}', fingerprint) AS (key, value)"
        )
        for name, df in tables.items()
    ]
    constants = spark.createDataFrame(list(fixed.items()), "key string, value string")
    checksums = [file_checksums(spark, folder)] if folder else []
    return reduce(DataFrame.unionByName, [constants, *checksums, *rows])
