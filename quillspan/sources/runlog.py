"""Run logs and gold sets on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = (
    "model string, question_id string, seq long, canon string, query_mode string, verdict string, "
    "first_pass_verdict string, retry_verdict string, fallback_used boolean, structure_ok boolean, "
    "citation_precision double, citation_coverage double, recall25_sent double, themes long, "
    "fabrications_reaching_output long, wall_seconds double, peak_ram_mb double, cited_tokens array<string>, "
    "timings map<string, double>"
)

_PASSAGE = "struct<ref: string, verse_ids: array<bigint>, origins: array<string>, canon: string>"
GOLD_SCHEMA = (
    "schema string, status string, index_version string, graded array<struct<id: string, question: string, "
    "category: string, canon: string, keywords: array<string>, "
    f"must: array<{_PASSAGE}>, should: array<{_PASSAGE}>>>"
)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON-lines run log; the schema is stated, never inferred."""
    return spark.read.schema(RUN_SCHEMA).json(path)


def append_run_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """A nested gold-set file as one row per question."""
    nested = spark.read.schema(GOLD_SCHEMA).option("multiLine", True).json(path)
    return nested.select(F.explode("graded").alias("g")).select("g.*")


def explode_gold(questions: DataFrame, question: str = "id", units: str = "verse_ids") -> DataFrame:
    """(question, kind, passage_no, unit_id): must and should passages unit by unit.

    Works on any table with ``must`` and ``should`` arrays of passages.
    """
    listed = F.concat(
        F.transform("must", lambda p, i: F.struct(F.lit("must").alias("kind"), i.alias("no"), p[units].alias("units"))),
        F.transform("should", lambda p, i: F.struct(F.lit("should").alias("kind"), i.alias("no"), p[units].alias("units"))),
    )
    rows = questions.select(question, F.explode(listed).alias("p"))
    return rows.select(
        question, "p.kind", F.col("p.no").cast("long").alias("passage_no"), F.explode("p.units").alias("unit_id")
    )
