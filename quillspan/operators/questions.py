"""Jobs over incoming questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.automaton import first_phrase
from quillspan.functions.text import collapse_spaces


def query_modes(questions: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, mode, terms, query_text): what the raw, rewritten and fused form of every question searches and embeds.

    ``questions``: keys, ``text``, own, rewrites. The rewritten form embeds the question with its rewrites and, without
    any, falls back to the raw form. The fused form searches the own terms and the rewrites, repeats included: a term
    that is in both is a second list.
    """
    own, rewrites = F.col("own"), F.coalesce("rewrites", F.array().cast("array<string>"))
    with_rewrites = F.concat(F.col(text), F.lit(" "), F.array_join(rewrites, " "))
    given = F.size(rewrites) > 0
    modes = {
        "raw": (own, F.col(text)),
        "rewrite": (F.when(given, rewrites).otherwise(own), F.when(given, with_rewrites).otherwise(F.col(text))),
        "fused": (F.concat(own, rewrites), with_rewrites),
    }
    listed = F.array(*[F.struct(F.lit(m).alias("mode"), t.alias("terms"), q.alias("query_text")) for m, (t, q) in modes.items()])
    return questions.select(*keys, F.inline(listed))


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def flag_phrases(questions: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """Add ``flagged`` and ``term``, the first listed term the normalised text contains.

    An automaton over the whole list reads every text once, whatever the list's length; the term itself comes from a join
    with the list, a static table of one row per term. So streams are flagged by the same plan as batches.
    """
    if not terms:
        raise ValueError("the phrase list holds no terms; a list that matches nothing is refused")
    spark = questions.sparkSession
    number = unused(questions.columns, "_term_no")
    listed = spark.createDataFrame(list(enumerate(terms)), f"{number} int, term string")
    normal = F.trim(collapse_spaces(F.lower(text)))
    found = questions.withColumn(number, first_phrase(spark, list(terms), normal))
    # The list is configuration that went through the driver, so its size is known to fit.
    return found.join(F.broadcast(listed), number, "left").withColumn("flagged", F.col(number).isNotNull()).select(
        *questions.columns, "term", "flagged")
