"""Exact vector search for whole batches of queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.keys import CLASSIC, KeyLayout
from quillspan.session import stored

SCORE_DIGITS = 9
OVERFETCH = 4
FLATTEN_FACTOR = 4
# Bounds of a batch that is broadcast: cells of the query matrix (128 MB of doubles), cells of the best-so-far
# table (two 8-byte numbers each), and cells of a block of scores inside a task (32 MB).
MATRIX_CELLS = 16_000_000
BEST_CELLS = 8_000_000
BLOCK_CELLS = 4_000_000
# Cells of the corpus rows that a task holds while larger batches of queries stream past (64 MB of doubles), and the share
# of the groups, one in so many, that sets the floors.
GROUP_CELLS = 8_000_000
FLOOR_SHARE = 16


class TopK:
    """Best ``k`` (score, key) pairs per query, merged one block of scores at a time; ties go to the lower key."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k = k
        self.scores = np.full((n_queries, k), -np.inf)
        self.keys = np.full((n_queries, k), np.iinfo(np.int64).max)

    def add(self, at: int, scores: np.ndarray, keys: np.ndarray) -> None:
        """Merge the scores (queries × keys) of the queries from number ``at`` on."""
        scores = np.round(scores, SCORE_DIGITS)
        keys = np.broadcast_to(keys, scores.shape)
        if scores.shape[1] > 2 * self.k:
            scores, keys = self._leading(scores, keys)
        rows = slice(at, at + len(scores))
        scores = np.concatenate([self.scores[rows], scores], axis=1)
        keys = np.concatenate([self.keys[rows], keys], axis=1)
        order = np.lexsort((keys, -scores), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(scores, order, axis=1)
        self.keys[rows] = np.take_along_axis(keys, order, axis=1)

    def _leading(self, scores: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Twice ``k`` columns of each row, the best ``k`` among them whatever the ties."""
        width = 2 * self.k
        best = np.argpartition(-scores, width - 1, axis=1)[:, :width]
        kept = np.take_along_axis(scores, best, axis=1)
        floor = -np.partition(-kept, self.k - 1, axis=1)[:, self.k - 1]
        for row in np.flatnonzero(kept.min(axis=1) >= floor):  # ties reach beyond what was kept
            best[row] = np.lexsort((keys[row], -scores[row]))[:width]
        return np.take_along_axis(scores, best, axis=1), np.take_along_axis(keys, best, axis=1)

    def rows(self, ids: np.ndarray) -> pa.RecordBatch:
        held = np.isfinite(self.scores)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, held.sum(axis=1))), pa.array(self.keys[held]), pa.array(self.scores[held])],
            names=["query_id", "key", "score"])


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal-length vectors as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def scan_block(best: TopK, queries: np.ndarray, corpus: np.ndarray, keys: np.ndarray, block_cells: int) -> int:
    """Score a piece of the corpus in blocks of at most ``block_cells`` cells; returns the largest block's cells."""
    wide = max(1, min(len(corpus), block_cells))
    tall, largest = max(1, block_cells // wide), 0
    for left in range(0, len(corpus), wide):
        piece = corpus[left : left + wide].T
        for top in range(0, len(queries), tall):
            scores = queries[top : top + tall] @ piece
            largest = max(largest, scores.size)
            best.add(top, scores, keys[left : left + wide])
    return largest


def _scan_topk(corpus: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int, block_cells: int) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast((ids, matrix))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        best = TopK(len(ids), k)
        for batch in batches:
            if batch.num_rows:
                scan_block(best, queries, _matrix(batch.column("vec")), batch.column("key").to_numpy(), block_cells)
        yield best.rows(ids)

    return corpus.select("key", "vec").mapInArrow(scan, "query_id long, key long, score double")


def rank_within(df: DataFrame, groups: list[str], order: list[Column], limit: int | None = None,
                name: str = "pos") -> DataFrame:
    """0-based position within a group; a limit runs map-side before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*groups).orderBy(*order))
    ranked = df.withColumn("_rank", rank)
    if limit is not None:
        ranked = ranked.where(F.col("_rank") <= limit)
    return ranked.withColumn(name, (F.col("_rank") - 1).cast("long")).drop("_rank")


@dataclass(frozen=True)
class QueryBatch:
    """Query vectors, measured once; ``fetched`` is held only when they are few enough to be broadcast."""

    queries: DataFrame
    n_queries: int
    dim: int
    fetched: tuple[np.ndarray, np.ndarray] | None = None


def _fetch(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = queries.toArrow()
    return table.column("query_id").to_numpy(), _matrix(table.column("vec"))


def query_batch(queries: DataFrame, matrix_cells: int = MATRIX_CELLS) -> QueryBatch:
    """Measure ``queries`` (query_id, vec) and fetch them if their matrix is small."""
    queries = queries.select(F.col("query_id").cast("long"), "vec")
    n_queries, dim = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).head()
    return QueryBatch(queries, n_queries, dim, _fetch(queries) if n_queries * dim <= matrix_cells else None)


def vector_topk(queries: DataFrame | QueryBatch, corpus: DataFrame, k: int, matrix_cells: int = MATRIX_CELLS,
                best_cells: int = BEST_CELLS, block_cells: int = BLOCK_CELLS, group_cells: int = GROUP_CELLS) -> DataFrame:
    """(query_id, key, score, pos): the exact ``k`` best dot products per query.

    ``queries``: query_id, vec, or a batch measured before. ``corpus``: key, vec. Ties go to the lower key. A batch whose
    matrix and best-so-far table are small is broadcast and the corpus scanned where it lies, without a shuffle; a larger
    one meets the corpus group by group (``_meet``), so that no matrix goes through the driver.
    """
    batch = queries if isinstance(queries, QueryBatch) else query_batch(queries, matrix_cells)
    corpus = corpus.select(F.col("key").cast("long").alias("key"), "vec")
    if batch.fetched is not None and batch.n_queries * k <= best_cells:
        found = _scan_topk(corpus, *batch.fetched, k, block_cells)
    else:
        found = _grouped_topk(batch, corpus, k, block_cells, group_cells)
    return rank_within(found, ["query_id"], [F.desc("score"), F.asc("key")], k)


def _grouped_topk(batch: QueryBatch, corpus: DataFrame, k: int, block_cells: int, group_cells: int) -> DataFrame:
    """Candidates of every query from every group of the corpus; two rounds, whatever the number of queries.

    The first round takes one group in ``FLOOR_SHARE``. A query's k-th score there is a floor for the rest: what lies
    below it cannot be among the best, so the other groups hand on few rows.
    """
    n_groups = max(1, -(-corpus.count() * max(1, batch.dim) // group_cells))
    dealt = corpus.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(n_groups)))
    queries = batch.queries.withColumn("floor", F.lit(float("-inf")))
    early = -(-n_groups // FLOOR_SHARE)
    first = stored(rank_within(_meet(queries, dealt, 0, early, k, block_cells), ["query_id"], [F.desc("score"), F.asc("key")], k),
                   "nearest").drop("pos")
    if early == n_groups:
        return first
    floors = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(
        F.col("n") == k).drop("n")
    raised = batch.queries.join(floors, "query_id", "left").select(
        "query_id", "vec", F.coalesce("least", F.lit(float("-inf"))).alias("floor"))
    return first.unionByName(_meet(raised, dealt, early, n_groups, k, block_cells))


def _meet(queries: DataFrame, corpus: DataFrame, low: int, high: int, k: int, block_cells: int) -> DataFrame:
    """(query_id, key, score): each group's best ``k`` per query, none below the query's ``floor``.

    Every query goes to every group of ``low`` to below ``high``. In a task a group's corpus rows come first and are held
    (a group is bounded); the queries then stream past, a batch at a time.
    """
    rows = corpus.where((F.col("g") >= low) & (F.col("g") < high)).select(
        "g", F.lit(0).alias("kind"), F.col("key").alias("id"), F.lit(0.0).alias("floor"), F.col("vec").cast("array<double>"))
    asked = queries.select(
        F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high - 1).cast("long"))).alias("g"), F.lit(1).alias("kind"),
        F.col("query_id").alias("id"), "floor", F.col("vec").cast("array<double>"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, keys, corpus, norms = None, [], None, None, None
        for batch in batches:
            marks = batch.column("g").to_numpy() * 2 + batch.column("kind").to_numpy()
            for part in np.split(np.arange(len(marks)), np.flatnonzero(np.diff(marks)) + 1):
                if not len(part):
                    continue
                piece, now = batch.slice(part[0], len(part)), int(marks[part[0]])
                if now % 2 == 0:
                    if now != group:
                        group, held = now, []
                    held.append((piece.column("id").to_numpy(), _matrix(piece.column("vec"))))
                    keys = None
                    continue
                if group != now - 1:  # queries of a group without corpus rows
                    continue
                if keys is None:
                    keys, corpus = (np.concatenate(x) for x in zip(*held))
                    norms = np.sqrt((corpus * corpus).sum(axis=1))
                    falling = np.argsort(-norms, kind="stable")
                    keys, corpus, norms = keys[falling], corpus[falling], norms[falling]
                    held = [(keys, corpus)]
                yield _best_of(piece, keys, corpus, norms, k, block_cells)

    both = rows.unionByName(asked).repartition(max(1, high - low), "g").sortWithinPartitions("g", "kind")
    return both.mapInArrow(kernel, "query_id long, key long, score double")


def _best_of(asked: pa.RecordBatch, keys: np.ndarray, corpus: np.ndarray, norms: np.ndarray, k: int,
             block_cells: int) -> pa.RecordBatch:
    """Best rows of one group for a batch of queries. Corpus rows come by falling norm, and a product is at most the
    product of the norms; the scan ends when no query can gain any more."""
    ids, floor = asked.column("id").to_numpy(), asked.column("floor").to_numpy()
    queries = _matrix(asked.column("vec"))
    reach = np.sqrt((queries * queries).sum(axis=1))
    best = TopK(len(ids), k)
    best.scores[:] = np.where(np.isneginf(floor), -np.inf, floor)[:, None]
    wide = max(1, block_cells // max(1, len(ids)))
    for left in range(0, len(corpus), wide):
        if (reach * norms[left] * (1 + 1e-9) + 1e-9 < best.scores[:, -1]).all():
            break
        best.add(0, queries @ corpus[left : left + wide].T, keys[left : left + wide])
    best.scores[best.keys == np.iinfo(np.int64).max] = -np.inf  # what only the floor held
    return best.rows(ids)


MODES = ("primary", "secondary-only", "both")


def in_mode(collection: Column, mode: str | Column) -> Column:
    """Which collection a mode reads: ``primary``, ``secondary-only`` or ``both``. A mode may be a column."""
    if isinstance(mode, Column):
        return ((mode == "both") | ((mode == "primary") & (collection == "primary"))
                | ((mode == "secondary-only") & (collection == "secondary")))
    return {"primary": collection == "primary", "secondary-only": collection == "secondary", "both": F.lit(True)}[mode]


def for_modes(df: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """Rows (with a ``collection``) once for every mode that reads them, as column ``mode``."""
    listed = df.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    return listed.where(in_mode(F.col("collection"), F.col("mode")))


def with_collection(df: DataFrame, key: str, works: DataFrame, layout: KeyLayout) -> DataFrame:
    """Add the collection of a unit's work. ``works``: work_id, collection."""
    return (
        df.withColumn("_work", layout.work(F.col(key)))
        .join(works.select(F.col("work_id").alias("_work"), "collection"), "_work")
        .drop("_work")
    )


def filter_after_cap(ranked: DataFrame, works: DataFrame, modes: str | tuple[str, ...], limit: int,
                     layout: KeyLayout = CLASSIC) -> DataFrame:
    """Keep ``limit`` rows of a mode *after* the over-fetch cap, so a list may come up short.

    Several modes come out as rows with a ``mode`` column.
    """
    several = isinstance(modes, tuple)
    kept = for_modes(with_collection(ranked.drop("pos"), "key", works, layout), modes if several else (modes,))
    scope = ["mode", "query_id"]
    out = rank_within(kept, scope, [F.desc("score"), F.asc("key")], limit)
    return out if several else out.drop("mode")


def flatten_blocks(block_hits: DataFrame, members: DataFrame, pool: int) -> DataFrame:
    """Units of the best blocks in block order, first occurrence kept.

    ``block_hits``: query_id, block_id, pos. ``members``: block_id, unit_id.
    ``listed`` is false beyond ``4 * pool`` units: those count as found but
    take no part in the ranked list.
    """
    scope = [c for c in ("mode", "query_id") if c in block_hits.columns]
    found = (
        block_hits.select(*scope, "block_id", F.col("pos").alias("block_pos"))
        .join(members.select("block_id", "unit_id"), "block_id")
        .groupBy(*scope, "unit_id")
        .agg(F.min("block_pos").alias("block_pos"))
    )
    ranked = rank_within(found, scope, [F.asc("block_pos"), F.asc("unit_id")])
    return ranked.withColumn("listed", F.col("pos") < FLATTEN_FACTOR * pool)
