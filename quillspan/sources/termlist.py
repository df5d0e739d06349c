"""Phrase lists in comment-and-line text files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import collapse_spaces


def read_terms(spark: SparkSession, path: str) -> list[str]:
    """Normalised terms in file order; a list without terms is an error.

    A phrase list is configuration and comes to the driver as a whole, whatever its length.
    """
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", r"\r?\n")).alias("no", "line"))
    line = F.trim("line")
    terms = lines.where((line != "") & ~line.startswith("#")).select("no", collapse_spaces(F.lower(line)).alias("term"))
    rows = terms.orderBy("no").collect()
    if not rows:
        raise ValueError(f"{path} holds no terms; a list that matches nothing is refused")
    return [row["term"] for row in rows]
