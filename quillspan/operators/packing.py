"""Greedy runs of consecutive items under a budget, for groups of any size.

An item joins the current run while the run stays within the budget, else it opens the next one. With running totals ``P``,
a run that opens at item ``i`` reaches as far as the items ``j`` with ``P[j] + end[j] <= P[i-1] + start[i] + budget``; the
right side is the run's threshold, and all that one item needs to know of those before it.

The items are sorted by range into pieces of bounded size; a piece may begin inside a group. What it does to the threshold
it is entered with is a step function: the first item beyond the threshold opens a run, and pointers to the next opening,
doubled until they leave the piece, tell the last one. The functions are chained in order of the pieces (a few steps each),
so that every piece knows its threshold, and the runs are then marked piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillspan.session import stored

PIECE_ITEMS = 200_000
#: Below this a group is walked item by item.
_SHORT = 64
_OPEN = np.iinfo(np.int64).min  # threshold of a group that has not begun


def _values(size: np.ndarray, start: np.ndarray, end: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(end of each item, threshold of a run that opens there, total), counted from the beginning of the stretch."""
    total = np.cumsum(size)
    return np.maximum.accumulate(total + end), total - size + start + budget, int(total[-1])


def _next(reach: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """The item that opens the run after one that opens at each item; the length of the stretch if none does."""
    return np.maximum(np.searchsorted(reach, threshold, "right"), np.arange(1, len(reach) + 1))


def step_function(size: np.ndarray, start: np.ndarray, end: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(below, leaves, opened, total): entered with a threshold under ``below[k]`` (and not under ``below[k-1]``), the
    stretch is left with ``leaves[k]`` after opening ``opened[k]`` runs. Beyond the last bound nothing opens."""
    reach, threshold, total = _values(size, start, end, budget)
    n = len(reach)
    jump = np.append(_next(reach, threshold), n)
    last, opened = np.arange(n + 1), np.ones(n + 1, np.int64)
    inside = jump < n
    far = np.where(inside, jump, np.arange(n + 1))
    steps = inside.astype(np.int64)
    while True:  # doubling: far(i) is 2^k openings after i, or the last one of the stretch
        farther = far[far]
        if (farther == far).all():
            break
        steps = steps + steps[far]
        far = farther
    last, opened = far[:n], 1 + steps[:n]
    leaves = threshold[last]
    # An item whose end does not pass that of the one before can be no first opening.
    first = np.append(True, reach[1:] > reach[:-1])
    leaves, opened, bound = leaves[first], opened[first], reach[first]
    change = np.append((leaves[1:] != leaves[:-1]) | (opened[1:] != opened[:-1]), True)
    return bound[change], leaves[change], opened[change], total


def entered(below: np.ndarray, leaves: np.ndarray, opened: np.ndarray, threshold: int) -> tuple[int, int]:
    """(threshold left with, runs opened) for one threshold."""
    k = int(np.searchsorted(below, threshold, "right"))
    return (int(leaves[k]), int(opened[k])) if k < len(below) else (threshold, 0)


def run_numbers(size: np.ndarray, start: np.ndarray, end: np.ndarray, budget: int, threshold: int = _OPEN,
                before: int = 0) -> np.ndarray:
    """Number of each item's run; ``threshold`` and ``before`` (runs opened so far) are what the stretch is entered with."""
    reach, limit, _ = _values(size, start, end, budget)
    opens = np.zeros(len(reach), np.int64)
    if len(reach) < _SHORT:
        for i, (r, t) in enumerate(zip(reach.tolist(), limit.tolist())):
            if r > threshold:
                opens[i], threshold = 1, t
    else:
        following = _next(reach, limit).tolist()
        at = int(np.searchsorted(reach, threshold, "right"))
        while at < len(reach):
            opens[at] = 1
            at = following[at]
    return before - 1 + np.cumsum(opens)


def _stretches(table: pa.Table) -> Iterator[tuple[str, slice, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The groups of one piece in order: (name, rows, numbers)."""
    name = table["_group"].combine_chunks().dictionary_encode()
    if isinstance(name, pa.ChunkedArray):
        name = name.combine_chunks()
    code = name.indices.to_numpy()
    numbers = [table[c].to_numpy() for c in ("_size", "_start", "_end")]
    cuts = np.append(np.append(0, np.flatnonzero(np.diff(code)) + 1), len(code))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield name.dictionary[int(code[a])].as_py(), slice(a, b), tuple(x[a:b] for x in numbers)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Whole pieces; a partition's rows come sorted by piece."""
    held, now = [], None
    for batch in batches:
        piece = batch.column("_piece").to_numpy()
        for part in np.split(np.arange(len(piece)), np.flatnonzero(np.diff(piece)) + 1):
            if not len(part):
                continue
            if now is not None and piece[part[0]] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(piece[part[0]])
            held.append(batch.slice(part[0], len(part)))
    if held:
        yield now, pa.Table.from_batches(held)


_STEPS = ("piece long, head string, tail string, below array<long>, leaves array<long>, opened array<long>, total long, "
          "tail_leaves long, tail_opened long")


def greedy_runs(items: DataFrame, keys: list[str], order: list[str], budget: int, size: Column, start: Column | None = None,
                end: Column | None = None, name: str = "run", piece_items: int = PIECE_ITEMS) -> DataFrame:
    """Add ``name``: the number (from 0) of each item's run within its group ``keys``, in the order of ``order``.

    ``size`` is what an item adds to the running total; ``start`` and ``end`` are what its run's beginning and its own end
    add once (see the module). All are whole numbers, sizes are not negative, and the order is unique within a group.
    """
    zero = F.lit(0)
    one = lambda c: F.coalesce((zero if c is None else c).cast("long"), F.lit(0).cast("long"))
    columns = items.columns
    group = F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"}) if keys else F.lit("{}")
    named = stored(items.select(
        "*", group.alias("_group"), one(size).alias("_size"), one(start).alias("_start"), one(end).alias("_end")), "items")
    n_pieces = max(1, -(-named.count() // piece_items))
    sort = ["_group", *order]
    dealt = named.repartitionByRange(n_pieces, *sort).sortWithinPartitions(*sort)
    pieces = stored(dealt.withColumn("_piece", F.spark_partition_id().cast("long")), "pieces")
    ready = pieces.repartition(n_pieces, "_piece").sortWithinPartitions("_piece", *sort)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, table in _pieces(batches):
            groups = list(_stretches(table))
            (head, _, numbers), (tail, _, final) = groups[0], groups[-1]
            below, leaves, opened, total = step_function(*numbers, budget)
            out, n = None, None
            if len(groups) > 1:
                own = step_function(*final, budget)
                out, n = entered(*own[:3], _OPEN)
                out -= own[3]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (piece, head, tail)] + [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (below, leaves, opened)]
                + [pa.array([x], pa.int64()) for x in (total, out, n)],
                ["piece", "head", "tail", "below", "leaves", "opened", "total", "tail_leaves", "tail_opened"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, threshold, opened = None, _OPEN, 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["head"] != group:
                    threshold, opened = _OPEN, 0
                yield pa.RecordBatch.from_pydict({"piece": [row["piece"]], "threshold": [threshold], "before": [opened]})
                group = row["tail"]
                if row["tail_leaves"] is not None:
                    threshold, opened = row["tail_leaves"], row["tail_opened"]
                    continue
                left, more = entered(*(np.array(row[c], np.int64) for c in ("below", "leaves", "opened")), threshold)
                # The next piece counts its totals from its own beginning.
                threshold, opened = (left if left == _OPEN else left - row["total"]), opened + more

    tables = stored(ready.mapInArrow(steps, _STEPS), "steps")
    # A row of a few steps per piece streams through one task, which holds one at a time.
    entries = tables.repartition(1).sortWithinPartitions("piece").mapInArrow(chain, "piece long, threshold long, before long")
    found = {r["piece"]: (r["threshold"], r["before"]) for r in entries.collect()}  # a row per piece

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, table in _pieces(batches):
            runs = []
            for n, (_, _, numbers) in enumerate(_stretches(table)):
                threshold, before = found[piece] if n == 0 else (_OPEN, 0)
                runs.append(run_numbers(*numbers, budget, threshold, before))
            yield from table.select(columns).append_column(name, pa.array(np.concatenate(runs), pa.int64())).to_batches()

    return ready.mapInArrow(mark, StructType([*items.schema.fields, StructField(name, LongType())]))
