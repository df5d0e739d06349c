"""Exact removal of long repeated byte strings by run-length compressed Burrows-Wheeler indexes.

A corpus has no single index. Every window of ``length`` bytes is filed under its anchor, the gram of 32 bytes with the
least hash inside it, so equal windows have equal anchors wherever they stand. Neighbouring windows with one anchor
form a block, a text of a few hundred bytes.

1. Blocks whose anchor occurs once hold no repeat and are dropped. Equal blocks repeat as a whole and collapse to one.
2. Different blocks under one anchor meet in an index: their suffixes are sorted, the Burrows-Wheeler transform is run
   length encoded, and positions and match lengths are kept only at the ends of runs. Streaming over the text then
   gives each position's longest match elsewhere from the last run end before it. Indexes are built over a bounded
   number of bytes.
3. An anchor with more different blocks than an index takes is resolved by counting its windows by 128-bit digest,
   combined before the shuffle.

Defined cases: a null text is empty; texts shorter than ``length`` have no window; a repeated row is another document
whose text repeats; documents are told apart by id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import load, stored, text_key
from quillspan.plans.registry import Builder

LENGTH = 200
GRAM = 32
#: Different blocks of one anchor that one index takes, and bytes at which an index is closed.
BLOCKS_PER_ANCHOR = 4096
INDEX_BYTES = 1 << 20
_SEGMENT = 1 << 23
_LOW = np.uint64(_SEGMENT * 2 - 1)
_MULTIPLIERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each run of 32 bytes, by doubling: 8 bytes are packed, then pairs are mixed twice."""
    x = data.astype(np.uint64)
    for bits in (8, 16, 32):
        x = x[: -(bits // 8)] | (x[bits // 8 :] << np.uint64(bits))
    for step, m in ((8, _MULTIPLIERS[0]), (16, _MULTIPLIERS[1])):
        x = (x ^ (x >> np.uint64(31))) * m
        x = x[:-step] * _MULTIPLIERS[2] + (x[step:] ^ (x[step:] >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLIERS[0]
    return x ^ (x >> np.uint64(29))


def blocks_of(data: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, spans, anchors, digests): runs of windows with one anchor, in segments of bounded size."""
    for base in range(0, max(0, len(data) - length + 1), _SEGMENT):
        part = data[base : base + _SEGMENT + length - 1]
        hashes = gram_hashes(np.frombuffer(part, np.uint8))
        low = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)  # ties go to the left
        width, step = length - GRAM + 1, 1
        while step * 2 <= width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
        at = (low & _LOW).astype(np.int64)
        starts = np.nonzero(np.concatenate(([True], at[1:] != at[:-1])))[0]
        spans = np.diff(np.concatenate((starts, [len(at)])))
        view = memoryview(part)
        digests = np.fromiter(
            (xxhash.xxh3_64_intdigest(view[s : s + n + length - 1]) for s, n in zip(starts.tolist(), spans.tolist())),
            np.uint64, len(starts))
        yield starts + base, spans, hashes[at[starts]].view(np.int64), digests.view(np.int64)


@dataclass
class RunIndex:
    """Run-length compressed Burrows-Wheeler transform of a text of symbols.

    ``symbols`` and ``sizes`` are the runs; ``heads`` and ``tails`` the text positions of the suffixes at the first and
    last row of each run; ``above`` and ``below`` how many symbols these share with the suffix before and after them.
    """

    symbols: np.ndarray
    sizes: np.ndarray
    heads: np.ndarray
    tails: np.ndarray
    above: np.ndarray
    below: np.ndarray

    @staticmethod
    def build(text: np.ndarray, cap: int = 1024) -> RunIndex:
        """``cap`` bounds the counted length of a shared part; blocks are shorter than a third of it."""
        order, packed = suffix_order(text)
        before = np.where(order == 0, 1 << 10, text[order - 1].astype(np.int64))
        first = np.concatenate(([True], before[1:] != before[:-1]))
        last = np.concatenate((first[1:], [True]))
        rows, ends = np.nonzero(first)[0], np.nonzero(last)[0]
        above, below = np.zeros(len(rows), np.int64), np.zeros(len(ends), np.int64)
        above[1:] = shared(packed, order[rows[1:] - 1], order[rows[1:]], cap)
        below[:-1] = above[1:]  # the end of a run borders on the head of the next
        return RunIndex(before[rows], ends - rows + 1, order[rows], order[ends], above, below)

    def matches(self) -> np.ndarray:
        """Matching statistics of the text against itself: each position's longest match elsewhere.

        Inside a run the neighbour of a suffix moves along with it, so a position has what the last sampled position
        before it has, less the distance.
        """
        n = int(self.sizes.sum())
        best = np.zeros(n, np.int64)
        here = np.arange(n)
        for samples, lengths in ((self.heads, self.above), (self.tails, self.below)):
            value, at = np.zeros(n, np.int64), np.full(n, -1)
            value[samples], at[samples] = lengths, samples
            at = np.maximum.accumulate(at)
            np.maximum(best, np.where(at >= 0, value[at] - (here - at), 0), out=best)
        return best


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of symbols below 512 by prefix doubling, and seven symbols packed at each position."""
    n = len(text)
    wide = np.concatenate((text.astype(np.int64), np.zeros(7, np.int64)))
    packed = np.zeros(n, np.int64)
    for j in range(7):
        packed = (packed << 9) | wide[j : j + n]
    order = np.argsort(packed)
    slots = np.arange(n)
    keys = packed[order]
    starts = np.maximum.accumulate(np.where(np.concatenate(([True], keys[1:] != keys[:-1])), slots, 0))
    rank = np.empty(n, np.int64)
    rank[order] = starts
    step = 7
    while len(slots):
        # Only rows that still share a rank go on.
        same = starts[1:] == starts[:-1]
        tied = np.concatenate((same, [False])) | np.concatenate(([False], same))
        slots = slots[tied]
        if not len(slots):
            break
        at = order[slots]
        after = at + step
        keys = rank[at] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(keys)
        order[slots], keys = at[by], keys[by]
        starts = np.maximum.accumulate(np.where(np.concatenate(([True], keys[1:] != keys[:-1])), slots, 0))
        rank[order[slots]] = starts
        step *= 2
    return order, np.concatenate((packed, np.zeros(1, np.int64)))


def shared(packed: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """How many symbols the suffixes at a and b share, at most ``cap``."""
    out, end = np.zeros(len(a), np.int64), len(packed) - 1
    live, at = np.arange(len(a)), 0
    while len(live) and at < cap:
        x = packed[np.minimum(a[live] + at, end)] ^ packed[np.minimum(b[live] + at, end)]
        differs = x != 0
        top = np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64)
        top -= (np.int64(1) << top) > np.maximum(x, 1)  # rounding up at powers of two
        out[live] = at + np.where(differs, (62 - top) // 9, 7)
        live = live[~differs]
        at += 7
    return np.minimum(out, cap)


def repeated_starts(texts: list[bytes], spans: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each block the ranges of window starts whose window stands elsewhere in these blocks too."""
    pieces = [np.concatenate((np.frombuffer(t, np.uint8).astype(np.uint16) + 1, np.zeros(1, np.uint16))) for t in texts]
    hit = RunIndex.build(np.concatenate(pieces)).matches() >= length
    out, base = [], 0
    for piece, span in zip(pieces, spans):
        out.append(ranges(hit[base : base + span]))
        base += len(piece)
    return out


def ranges(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), (np.nonzero(edge == -1)[0] - 1).tolist()))


_RANGES = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _resolve(length: int, index_bytes: int):
    """Kernel over blocks sorted by anchor: builds an index whenever whole anchors have filled one."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_starts([r[2] for r in rows], [r[3] for r in rows], length)
        keep = [(r[0], r[1], f) for r, f in zip(rows, found) if f]
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keep], pa.int64()), pa.array([k[1] for k in keep], pa.int64()),
             pa.array([[{"lo": lo, "hi": hi} for lo, hi in k[2]] for k in keep], _RANGES)], ["anchor", "digest", "ranges"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and size >= index_bytes and rows[-1][0] != row[0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
        if rows:
            yield solve(rows)

    return kernel


def blocks(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """(id, key, at, span, anchor, digest) of every block of every text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, rows = [[], [], [], []], []
            for n, data in enumerate(batch.column(2).to_pylist()):
                for part in blocks_of(data or b"", length):
                    for column, values in zip(made, part):
                        column.append(values)
                    rows.append(np.full(len(part[0]), n))
                if sum(map(len, rows[-64:])) > 1 << 20 or len(rows) >= 4096:
                    yield emit(batch, made, rows)
                    made, rows = [[], [], [], []], []
            if rows:
                yield emit(batch, made, rows)

    def emit(batch, made, rows):
        at, span, anchor, digest = (np.concatenate(c) for c in made)
        which = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(which), batch.column(1).take(which), pa.array(at), pa.array(span.astype(np.int32)),
             pa.array(anchor), pa.array(digest)], ["id", "key", "at", "span", "anchor", "digest"])

    return _keyed(docs, id_col, text_col).mapInArrow(
        kernel, f"id {kind}, key long, at long, span int, anchor long, digest long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"),
                       F.col(text_col).cast("binary").alias("data"))


def _same(a: DataFrame, b: DataFrame):
    return a["id"].eqNullSafe(b["id"]) & (a["key"] == b["key"])


def _texts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, digest, data, span): the bytes of one occurrence of each wanted block."""
    lists = wanted.groupBy("id", "key").agg(F.collect_list(F.struct("at", "span", "anchor", "digest")).alias("wanted"))
    met = docs.join(lists, _same(docs, lists)).select("data", "wanted").select("data", F.explode("wanted").alias("b"))
    # The generator's row holds the text only inside this stage; what leaves it is the cut block.
    return met.select("b.anchor", "b.digest", F.substring("data", (F.col("b.at") + 1).cast("int"),
                                                          F.col("b.span") + length - 1).alias("data"), "b.span")


def _windows(length: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for anchor, digest, data, span in zip(*(c.to_pylist() for c in batch.columns)):
                for i in range(span):
                    value = xxhash.xxh3_128_digest(data[i : i + length])
                    row = (anchor, digest, i, *np.frombuffer(value, np.int64).tolist())
                    for column, x in zip(out, row):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                 pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())], ["anchor", "digest", "lo", "h1", "h2"])

    return kernel


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
            blocks_per_anchor: int = BLOCKS_PER_ANCHOR, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(id, key, starts): ranges of the starts of windows that stand anywhere else, for documents that have any."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    found = blocks(docs, id_col, text_col, length)
    anchors = found.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("digest") != F.max("digest")).alias("several"))
    # Stored, so that the join has a plain shuffle on both sides and the rows of a hot anchor can be split.
    met = stored(found.join(stored(anchors.where("n > 1").select("anchor", "several")), "anchor"))
    by_digest = stored(met.groupBy("anchor", "digest").agg(
        F.count("*").alias("n"), F.first("several").alias("several"), F.min(F.struct("id", "key", "at", "span")).alias("one")))
    whole = by_digest.where("n > 1").select(
        "anchor", "digest", F.array(F.struct(F.lit(0).alias("lo"), (F.col("one.span") - 1).alias("hi"))).alias("ranges"))
    some = by_digest.where("several")
    large = stored(some.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > blocks_per_anchor).select("anchor"))
    texts = stored(_texts(_keyed(docs, id_col, text_col), some.select("one.*", "anchor", "digest"), length))
    usual = texts.join(large, "anchor", "left_anti").select("anchor", "digest", "data", "span")
    schema = "anchor long, digest long, ranges array<struct<lo:int,hi:int>>"
    solved = usual.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_resolve(length, index_bytes), schema)
    hot = texts.join(large, "anchor", "left_semi").select("anchor", "digest", "data", "span").mapInArrow(
        _windows(length), "anchor long, digest long, lo int, h1 long, h2 long")
    twice = hot.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    counted = hot.join(twice, ["h1", "h2"]).groupBy("anchor", "digest").agg(
        F.collect_list(F.struct("lo", F.col("lo").alias("hi"))).alias("ranges"))
    single = by_digest.where("n = 1").select("anchor", "digest")
    partly = solved.unionByName(counted).join(single, ["anchor", "digest"], "left_semi")
    marks = met.select("id", "key", "at", "anchor", "digest").join(whole.unionByName(partly), ["anchor", "digest"])
    starts = marks.select("id", "key", F.explode(F.transform("ranges", lambda r: F.struct(
        (F.col("at") + r["lo"]).alias("lo"), (F.col("at") + r["hi"]).alias("hi")))).alias("r"))
    return starts.groupBy("id", "key").agg(F.collect_list("r").alias("starts"))


def spans(starts: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal covered byte runs [from, to) of ranges of window starts."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"] + length) for r in starts or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _with_starts(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    keyed = _keyed(docs, id_col, text_col)
    found = repeats(docs, id_col, text_col, length)
    return keyed.join(found, _same(keyed, found), "left").select(keyed["id"], keyed["data"], "starts")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, spans, kept): removed byte ranges [lo, hi) and the bytes that stay, of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, cut, kept = [], [], []
            for data, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = data or b""
                gone = spans(starts, length)
                at, left = 0, []
                for lo, hi in gone:
                    left.append(data[at:lo])
                    at = hi
                left.append(data[at:])
                sizes.append(len(data))
                cut.append([{"lo": lo, "hi": hi} for lo, hi in gone])
                kept.append(b"".join(left))
            kinds = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(cut, kinds), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "spans", "kept"])

    return _with_starts(docs, id_col, text_col, length).mapInArrow(
        kernel, f"id {kind}, n_bytes long, spans array<struct<lo:long,hi:long>>, kept binary")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and spans removed from every document, and the digest of what is left."""
    return removed(load(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """What the query must give, by counting every window; for tests on small inputs."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = True
        gone = ranges(hit[: len(t)])
        kept = bytes(b for b, h in zip(t, hit) if not h)
        out.append((len(t), int(hit.sum()), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


OP3_SQL = f"""
WITH t AS (SELECT doc_id, hex(coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, {2 * LENGTH})) AS h
  FROM (SELECT doc_id, x, unnest(range(0, n - {LENGTH - 1})) AS i FROM t WHERE n >= {LENGTH})),
s AS (SELECT doc_id, i FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS opens FROM s),
g AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o),
r AS (SELECT doc_id, k, min(i) AS lo, max(i) + {LENGTH} AS hi FROM g GROUP BY 1, 2),
parts AS (
  SELECT doc_id, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS a, lo AS b FROM r
  UNION ALL SELECT t.doc_id, coalesce(max(hi), 0), any_value(n) FROM t LEFT JOIN r USING (doc_id) GROUP BY t.doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM parts JOIN t USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
  sha256(unhex(k)) AS kept_sha256
FROM t JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS runs FROM r GROUP BY 1) USING (doc_id)
"""

QUERIES: dict[str, Builder] = {"op3_suffix_array_dedup": op3_suffix_array_dedup}
SQL: dict[str, str] = {"op3_suffix_array_dedup": OP3_SQL}
