"""Reference strings shown to readers and models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reference(name: Column, chapter: Column, first: Column, last: Column) -> Column:
    """``Name c:v`` for one unit, ``Name c:v-w`` for a range."""
    start = F.concat(name, F.lit(" "), chapter.cast("string"), F.lit(":"), first.cast("string"))
    return F.when(first == last, start).otherwise(F.concat(start, F.lit("-"), last.cast("string")))


def reader_name(display_name: Column, full_name: Column) -> Column:
    """The display name, falling back to the full name."""
    return F.coalesce(F.when(F.trim(display_name) != "", display_name), full_name)
