"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. If two fingerprints differ in at most three bits, one segment
differs in at most one, so the two share a variant of that segment with this one bit removed. Variants are joined by
equality: rows of a variant meet in one sorted run, where links are verified by their distance and reduced to a
spanning forest, so that a group of copies leaves rows in proportion to its size.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; a repeated row gives a row
each time; extra columns are ignored by ``fingerprints`` and ``near_duplicates``; a null id never becomes a component
unless the whole component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import paragraph_dedup
from quillspan.llm.common import SPACE, components, load, merged, stored, text_key, whole_rows
from quillspan.plans.registry import Builder

MAX_BITS = 3
SHINGLE = 3
SEED = 42
#: Jaccard similarity of five-word shingles from which the pipeline's stage takes documents for copies.
SIMILAR = 0.8
#: Rows of one variant that are compared in one go; larger variants are cut again by the other segment.
RUN_CAP = 4096
_BLOCK = 8192


def fingerprint(data: bytes | None, width: int = SHINGLE) -> int:
    """Majority bits of the hashes of all word shingles, repeats counted, as an unsigned number."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _BLOCK):
        part = hashes[start : start + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, fp): the fingerprint of every whole text as a signed long; ``key`` tells texts of one id apart."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x) for x in batch.column(2).to_pylist()], np.uint64)
            columns = [batch.column(0), batch.column(1), pa.array(prints.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(
        F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.col(text_col).cast("binary").alias("text")
    ).mapInArrow(kernel, f"id {kind}, key long, fp long")


def _near(x: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count(x) <= max_bits


def _canonical(x: np.ndarray) -> np.ndarray:
    """The one variant number in which a linked pair with difference ``x`` is reported."""
    low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
    first = np.bitwise_count(low) <= 1
    bits = np.where(first, low, high)
    at = np.bitwise_count(np.maximum(bits, np.uint64(1)) - np.uint64(1))
    return np.where(first, 0, 32) + np.where(bits == 0, 0, at).astype(np.int64)


def _forest(prints: np.ndarray, variant: int | None, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links of one run connect, at most one per row."""
    n = len(prints)
    label = np.arange(n)
    lefts, rights = [], []
    for start in range(0, n, 256):
        x = prints[start : start + 256, None] ^ prints[None, :]
        hit = _near(x, max_bits) & (np.arange(n)[None, :] > np.arange(start, min(start + 256, n))[:, None])
        i, j = np.nonzero(hit)
        if variant is not None and len(i):
            keep = _canonical(x[i, j]) == variant
            i, j = i[keep], j[keep]
        i = i + start
        if len(i) > n:  # merge at once, so that links of a dense group are not kept
            label = merged(label, i, j)
        else:
            lefts.append(i)
            rights.append(j)
    if lefts:
        label = merged(label, np.concatenate(lefts), np.concatenate(rights))
    rest = np.nonzero(label != np.arange(n))[0]
    return prints[label[rest]], prints[rest]


def _links(max_bits: int, cap: int | None):
    """Kernel over rows (key, fp) sorted by key: edges (0, a, b), and rows (1, key, fp) of runs over ``cap``."""

    def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
            ["kind", "a", "b"],
        )

    def runs(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.nonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[0]
        sizes = np.diff(np.concatenate((starts, [len(keys)])))
        at = starts[sizes == 2]
        x = prints[at] ^ prints[at + 1]
        keep = _near(x, max_bits)
        if cap is not None:
            keep &= _canonical(x) == keys[at] >> 32
        yield out(0, prints[at[keep]], prints[at[keep] + 1])
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            a, b = _forest(prints[s : s + n], None if cap is None else int(keys[s] >> 32), max_bits)
            if len(a):
                yield out(0, a, b)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints, over = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for batch in batches:
            new = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            keys, prints = np.concatenate((keys, new)), np.concatenate((prints, fps))
            if over is not None:
                n = int(np.searchsorted(keys, over, "right"))
                yield out(1, keys[:n], prints[:n])
                keys, prints = keys[n:], prints[n:]
                if not len(keys):
                    continue
                over = None
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield from runs(keys[:last], prints[:last])
            keys, prints = keys[last:], prints[last:]
            if cap is not None and len(keys) > cap:
                over = keys[0]
                yield out(1, keys, prints)
                keys, prints = keys[:0], prints[:0]
        if len(keys):
            yield from runs(keys, prints)

    return kernel


def links(prints: DataFrame, max_bits: int = MAX_BITS, cap: int = RUN_CAP) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect all within ``max_bits`` (at most 3)."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with one free bit find at most 3 differing bits")
    fp, i = F.col("fp"), F.col("i")
    segment = F.when(i < 32, fp.bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned(fp, 32))
    variants = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select(
        (i.cast("long") * (1 << 32) + segment.bitwiseAND(F.expr("~shiftleft(1L, i % 32)"))).alias("key"), "fp"
    )
    schema = "kind int, a long, b long"
    found = stored(variants.repartition("key").sortWithinPartitions("key").mapInArrow(_links(max_bits, cap), schema))
    # A run over the cap shares 31 bits; cut again by the other segment, its rows share 46 and at most 2^18 can meet.
    over = found.where("kind = 1").select(F.col("a").alias("outer"), F.col("b").alias("fp"))
    other = F.when(F.shiftright("outer", 32) < 32, F.shiftrightunsigned(fp, 32)).otherwise(fp.bitwiseAND(0xFFFFFFFF))
    piece = F.when(i < 16, F.col("other").bitwiseAND(0xFFFF)).otherwise(F.shiftright("other", 16))
    again = (
        over.select("outer", "fp", other.alias("other"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
        .select(F.xxhash64("outer", "i", piece.bitwiseAND(F.expr("~shiftleft(1L, i % 16)"))).alias("key"), "fp")
    )
    rest = again.repartition("key").sortWithinPartitions("key").mapInArrow(_links(max_bits, None), schema)
    return found.where("kind = 0").unionByName(rest).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(id, key, fp, component), a row per document: the component is the smallest id reachable over links."""
    prints = stored(fingerprints(docs, id_col, text_col))
    groups = stored(prints.groupBy("fp").agg(F.min("id").alias("first")))
    found = components(links(groups.select("fp"), max_bits)).select(F.col("node").alias("fp"), "component")
    joined = groups.join(found, "fp", "left")
    least = joined.where("component is not null").groupBy("component").agg(F.min("first").alias("least"))
    smallest = joined.join(least, "component", "left").select("fp", F.coalesce("least", "first").alias("component"))
    return prints.join(smallest, "fp").select("id", "key", "fp", "component")


def hex_digits(column: str = "fp"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest doc_id of its component."""
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), hex_digits().alias("fingerprint"), F.col("component").alias("component_id")
    )


@whole_rows("doc_id", "text")
def keep_first(docs: DataFrame) -> DataFrame:
    """Pipeline stage: one document of each component stays, that with the smallest id; columns unchanged.

    Of rows that share the smallest id, the one with the smallest text hash stays; of identical rows, one.
    """
    found = near_duplicates(docs).where("id <=> component")
    first = stored(
        found.groupBy("component").agg(F.min(F.struct("id", "key")).alias("one"), F.count("*").alias("rows"))
        .select("one.id", "one.key", "rows")
    )
    keyed = docs.withColumn("_key", text_key())
    kept = keyed.join(first, keyed["doc_id"].eqNullSafe(first["id"]) & (keyed["_key"] == first["key"]), "left_semi")
    if first.where("rows > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "_key"])
    return kept.select(*docs.columns)


def _unit() -> Column:
    """A document as one paragraph; texts without a word are told apart by their hash and do not meet others."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " "))
    return F.when(text.rlike(r"[\p{L}\p{N}_]"), text).otherwise(F.concat(F.lit("_ "), F.hex(F.xxhash64(text))))


def similar(docs: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """(id, key, keep) of every document that has a copy; ``keep`` is the place of the one that stays.

    Documents are linked by the exact Jaccard similarity of their five-word shingles. Candidates are fingerprints within
    three bits and, since such fingerprints miss pairs near the limit, MinHash bands (recall 0.998 at 0.8). ``key`` is
    that of ``_unit``.
    """
    units = docs.select("doc_id", _unit().alias("text"))
    prints = stored(fingerprints(units).distinct())

    def within(groups: DataFrame) -> DataFrame:
        at = stored(groups.join(prints, groups["first.id"].eqNullSafe(prints["id"]) & (groups["first.key"] == prints["key"])).select(
            "h1", "fp"))
        lead = stored(at.groupBy("fp").agg(F.min("h1").alias("lead")))
        same = at.join(lead, "fp").where("h1 <> lead").select(F.col("lead").alias("a"), F.col("h1").alias("b"))
        near = links(lead.select("fp")).join(lead.select(F.col("fp").alias("a"), F.col("lead").alias("lead_a")), "a").join(
            lead.select(F.col("fp").alias("b"), F.col("lead").alias("lead_b")), "b")
        return same.unionByName(near.select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b")))

    return paragraph_dedup.clusters(units, min_words=1, similarity=similarity, more_pairs=within).select("id", "key", "keep")


@whole_rows("doc_id", "text")
def keep_similar_first(docs: DataFrame) -> DataFrame:
    """Pipeline stage: one document of each group of similar ones stays, that with the least id; columns unchanged."""
    found = stored(similar(docs).distinct())
    surplus = found.where(~(F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("key") == F.col("keep.key"))))
    keyed = docs.withColumn("_unit", _unit()).withColumn("_key", text_key("_unit")).drop("_unit")
    gone = surplus.select(F.col("id").alias("_gone_id"), F.col("key").alias("_gone_key"))
    kept = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (F.col("_key") == F.col("_gone_key")), "left_anti")
    return kept.dropDuplicates(["doc_id", "_key"]).select(*docs.columns)


QUERIES: dict[str, Builder] = {"op8_simhash_near_dedup": op8_simhash_near_dedup}
SQL: dict[str, str] = {}
