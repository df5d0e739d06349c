"""Preparing texts for embedding models and checking what comes back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import vectors as V
from quillspan.functions.refs import reference
from quillspan.operators.ordering import order_statistics
from quillspan.operators.packing import greedy_runs

BATCH = 64
CHARS_PER_TOKEN = 4


def _headed(label: Column, heading: Column) -> Column:
    return F.concat(label, F.when(heading.isNull() | (heading == ""), "").otherwise(F.concat(F.lit(" — "), heading)))


def unit_templates(units: DataFrame, works: DataFrame, blocks: DataFrame, block_keys: list[str]) -> DataFrame:
    """(unit_id, text): the reference line, then the text."""
    joined = units.join(works.select("work_id", "abbrev"), "work_id").join(
        blocks.select(*block_keys, "heading"), block_keys, "left"
    )
    label = reference(F.col("abbrev"), F.col("chapter"), F.col("ordinal"), F.col("ordinal"))
    return joined.select("unit_id", F.concat(_headed(label, F.col("heading")), F.lit("\n"), F.col("text")).alias("text"))


def topic_templates(topics: DataFrame, parents: DataFrame) -> DataFrame:
    """(kind, topic_id, text): the heading, led by its parent's heading."""
    up = parents.select(
        F.col("kind").alias("parent_kind"), F.col("topic_id").alias("parent_id"), F.col("heading").alias("parent_heading")
    )
    joined = topics.join(up, ["parent_kind", "parent_id"], "left")
    text = F.when(F.col("parent_heading").isNull(), F.col("heading")).otherwise(
        F.concat("parent_heading", F.lit(" — "), "heading")
    )
    return joined.select("kind", "topic_id", text.alias("text"))


def split_blocks(units: DataFrame, blocks: DataFrame, keys: list[str], budget: Column,
                 size: Callable[[Column], Column] = F.length) -> DataFrame:
    """(keys, part, first_ordinal, last_ordinal, n_units, cost): blocks cut at unit boundaries.

    Greedy: a unit joins the current part while label, texts and the blanks between them stay within the budget; an
    oversize unit is a part by itself. The label is that of the part as it would be, so it is counted too. A block may
    hold any number of units. ``units``: keys, ordinal, abbrev, chapter, text. ``blocks``: keys, heading. ``size``
    measures a text, in characters unless told otherwise; ``budget`` may use the block's columns.
    """
    digits = lambda n: F.length(n.cast("string"))
    label = F.length("abbrev") + F.length(F.col("chapter").cast("string")) + 4 + F.when(
        F.col("heading").isNull(), 0).otherwise(F.length("heading") + 3)
    items = units.join(blocks.select(*keys, "heading"), keys, "left").select(
        *keys, "ordinal", size(F.col("text")).cast("long").alias("size"), label.cast("long").alias("label"),
        (budget - label).cast("long").alias("room"))
    # A text costs its length and the blank before it; the part's first unit has no such blank, but names the part.
    runs = greedy_runs(
        items, keys, ["ordinal"], 0, F.col("size") + 1, start=F.col("room") + 1 - digits(F.col("ordinal")),
        end=digits(F.col("ordinal")), name="part")
    first, last = F.min("ordinal"), F.max("ordinal")
    cost = F.max("label") + digits(first) + digits(last) + F.sum("size") + F.count(F.lit(1)) - 1
    return runs.groupBy(*keys, "part").agg(
        first.alias("first_ordinal"), last.alias("last_ordinal"), F.count(F.lit(1)).alias("n_units"),
        cost.cast("long").alias("cost"),
    )


def embed_batch(texts: DataFrame, embed_fn: Callable[[list[str]], np.ndarray], model_id: str,
                prefix: str = "", max_chars: int | None = None) -> DataFrame:
    """(model_id, kind, key, part, dim, vec): unit-length vectors of all texts.

    ``texts``: kind, key, part, text. ``embed_fn`` maps a list of strings to an
    (n, dim) array and is loaded once per worker; rows arrive in Arrow batches
    and go to the model ``BATCH`` at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                piece = frame.iloc[at : at + BATCH]
                given = [prefix + t if max_chars is None else (prefix + t)[:max_chars] for t in piece["text"]]
                out = np.asarray(embed_fn(given), dtype=np.float64)
                length = np.linalg.norm(out, axis=1, keepdims=True)
                out = np.divide(out, length, out=out, where=length > 0).astype(np.float32)
                yield pd.DataFrame({
                    "model_id": model_id, "kind": piece["kind"], "key": piece["key"], "part": piece["part"],
                    "dim": out.shape[1], "vec": list(out),
                })

    schema = "model_id string, kind string, key long, part long, dim long, vec array<float>"
    return texts.select("kind", "key", "part", "text").mapInPandas(run, schema)


def vector_drift(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: how far two runs of the same texts differ. Inputs: key, vec."""
    pairs = left.select("key", F.col("vec").alias("a")).join(right.select("key", F.col("vec").alias("b")), "key")
    cosine = V.dot(F.col("a"), F.col("b")) / (V.norm(F.col("a")) * V.norm(F.col("b")))
    measured = pairs.select(
        V.max_abs_difference(F.col("a"), F.col("b")).alias("diff"), cosine.alias("cosine"),
        (F.col("a") == F.col("b")).alias("same"),
    )
    return measured.agg(
        F.count(F.lit(1)).alias("n"), F.max("diff").alias("max_abs_diff"), F.min("cosine").alias("min_cosine"),
        F.count_if("same").alias("identical"),
    )


def size_profile(sizes: DataFrame, groups: list[str], value: str, budget: int) -> DataFrame:
    """Minimum, median (truncated), 90th percentile, maximum and over-budget count per group."""
    n = F.col("n")
    stats = order_statistics(sizes, groups, value, {
        "min": F.lit(1), "lo": F.call_function("div", n + 1, F.lit(2).cast("long")),
        "hi": F.call_function("div", n + 2, F.lit(2).cast("long")),
        "p90": F.least(n - 1, F.floor(n * 0.9).cast("long")) + 1, "max": n,
    })
    over = sizes.groupBy(*groups).agg(F.count_if(F.col(value) > budget).alias("over_budget"))
    return stats.join(over, groups).select(
        *groups, "n", "min", F.floor((F.col("lo") + F.col("hi")) / 2).cast("long").alias("median"), "p90", "max",
        "over_budget",
    )


def keep_model(vectors: DataFrame, model_id: str) -> DataFrame:
    """Only one model's vectors; an unknown model is an error, not an empty store."""
    kept = vectors.where(F.col("model_id") == model_id)
    if kept.isEmpty():
        raise ValueError(f"the store holds no vectors of model {model_id}")
    return kept
