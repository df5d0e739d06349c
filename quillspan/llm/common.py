"""Helpers that several training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.session import checkpoint_dir, remove_folder

#: Fixed value: ASCII white space, the separators of plain words.
SPACE = r"[\x20\x09-\x0D]+"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Fewer rows in an Arrow batch for the jobs that run inside: texts may be long, and workers hold whole batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, sweep: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The files survive lost executors and cut the lineage. They stay until the folder is cleaned, because the
    returned frame reads them. The job's shuffle files have no reader then, but Spark drops them only when the driver
    has collected the job's objects; ``sweep`` asks for that now, after a job with large shuffles.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/quillspan/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if sweep:
        spark.sparkContext._jvm.System.gc()
    made = spark.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def discard(*made: DataFrame) -> None:
    """Delete the files of tables that ``stored`` returned, once nothing will read them."""
    for df in made:
        remove_folder(df.sparkSession, df.stored_at)


#: The column that carries an input row past an operator.
ROW = "whole_row"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_rows(*needed: str, edits: tuple[str, ...] = ()) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """For operators from documents to documents: extra columns go past them unseen, whatever their names.

    The operator gets the ``needed`` columns and the row as one struct, and hands both on. Its ``edits`` replace the
    row's columns; a column that it adds keeps its name, with underscores appended while the input has that name.
    """

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(operator)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            names = docs.columns
            row = F.struct(*[F.col(quoted(c)) for c in names]).alias(ROW)
            made = operator(docs.select(*[F.col(c) for c in needed if c in names], row), *args, **options)
            out = [F.col(c) if c in edits else F.col(ROW)[c].alias(c) for c in names]
            taken = {c.lower() for c in names}
            for added in made.columns:
                if added == ROW or added in needed:
                    continue
                free = added
                while free.lower() in taken:
                    free += "_"
                out.append(F.col(added).alias(free))
            return made.select(*out)

        return run

    return wrap


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    A one-element generator keeps the optimizer from inlining an array into the lambdas that index it, which would
    compute it anew for each element.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    out = df.select("*", made.alias("_once"))
    return out.select(*[c for c in df.columns], *[F.col("_once")[n].alias(n) for n in columns])


def text_key(text: str = "text") -> Column:
    """Second half of a document's key: rows with equal id but other text are other documents."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def least_hashed(df: DataFrame, hashed: Column, want: int, total: int) -> DataFrame:
    """About the ``want`` rows of least hash out of ``total``, never more; a bounded, repeatable sample.

    A cut that lets twice as many pass goes first, so that no task hands on ``want`` rows of its own.
    """
    top = F.shiftrightunsigned(hashed, 24)
    cut = min(1.0, (2 * want + 100) / max(1, total))
    return df.where(top < F.lit(int(cut * (1 << 40)))).orderBy(top, hashed).limit(want)


#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def rolling_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of stretches of a byte array, all at once; for filters and features, where a collision does no harm."""
    global _powers
    n = len(data) + 1
    with np.errstate(over="ignore"):
        if len(_powers[0]) < n:
            _powers = tuple(
                np.cumprod(np.append(np.uint64(1), np.full(n - 1, x, np.uint64)), dtype=np.uint64) for x in (_BASE, _INVERSE))
        up, down = _powers
        total = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: n - 1])))
        h = (total[end] - total[start]) * down[start] + np.uint64(seed)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the number of a row with that label) after joining the rows i and j; for bounded groups in a task."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected components: edges (a, b) to (node, component), the component being its smallest node.

    Alternates large-star and small-star steps until the edges are stars. Each step is a min per node (combined
    before its shuffle) and a join, so a hub is neither gathered nor windowed; each round is written to the shared
    folder. Nodes without edge are not listed. Null nodes are ignored.
    """
    a, b = F.col("a"), F.col("b")
    now = stored(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = mark(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Stored, so that the joins have a plain shuffle on both sides and a hub's edges can be split.
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = (
            both.join(low, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = stored(large)
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
