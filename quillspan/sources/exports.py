"""Writing results: history exports and the index dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.ingest import content_fingerprint
from quillspan.operators.history import mode_label


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_history_text(entries: DataFrame, answers: DataFrame, passages: DataFrame, path: str) -> None:
    """One plain-text block per entry, oldest first. ``answers``: id, answer (markers resolved)."""
    refs = passages.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("first_unit", "reference"))).alias("r"))
    joined = entries.drop("answer").join(answers, "id").join(refs, "id", "left")
    lines = F.transform(F.coalesce("r", F.array().cast("array<struct<first_unit:bigint,reference:string>>")),
                        lambda r: F.concat(F.lit("  "), r["reference"]))
    block = F.concat_ws(
        "\n", F.lit("-" * 72), F.concat(F.date_format("asked_at", "yyyy-MM-dd HH:mm:ss"), F.lit("  ("), mode_label(F.col("mode")), F.lit(")")),
        F.lit("QUESTION"), F.concat(F.lit("  "), "question"), F.lit("ANSWER"),
        F.concat(F.lit("  "), F.regexp_replace("answer", "\n", "\n  ")), F.lit("PASSAGES"), F.array_join(lines, "\n"),
    )
    joined.orderBy("id").select(block.alias("value")).write.mode("overwrite").text(path)


def write_index_table(df: DataFrame, path: str, order: list[str], partition_by: list[str] | None = None,
                      files: int | None = None) -> DataFrame:
    """A table of the index, range-partitioned and sorted so that rebuilds lay rows out alike.

    Returns the (n_rows, fingerprint) of what was written.
    """
    ranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    writer = ranged.sortWithinPartitions(*order).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return content_fingerprint(df.sparkSession.read.parquet(path).select(*df.columns))
