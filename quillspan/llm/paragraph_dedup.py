"""Paragraph deduplication by MinHash banding with exact verification.

The query works on passages: the words of a whole text, cut where three words hash lowest among their neighbours, so that
a repeated passage is cut alike wherever it stands, inside a longer line or hard-wrapped. Without ``passages`` the units are
paragraphs: lines with at least ``min_words`` words or, with ``wrapped``, hard-wrapped lines joined to one, which has the
number of its first line. Units of equal words collapse to one; each distinct one has a MinHash signature over its
five-word shingles, cut into bands whose number is tuned to the wanted recall at the similarity limit. Units that share a
band are compared to one of them first. Where groups are still apart, the band's units meet in a bounded run and leave a
spanning forest, so a group of copies leaves rows in proportion to its size. All comparisons are the exact Jaccard
similarity of shingles; of each connected group the first
paragraph stays.

Defined cases: null and empty texts have no paragraphs; a paragraph of fewer words than a shingle is one shingle, a passage
of fewer takes no part; rows that share id and text count as one document; ties between ids are settled by the text's hash;
extra columns are ignored; a text is cut whole, whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.llm.common import components, load, merged, stored, text_key
from quillspan.plans.registry import Builder

MIN_WORDS = 20
SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.998
#: Signature rows in a band.
ROWS = 4
#: Rows of the table that keeps documents without candidates out of a shuffle.
FILTER_ROWS = 1 << 20
#: A passage begins where three words hash lowest among all within so many words: every 11 words or so.
PASSAGE_REACH = 5
#: Words of neighbouring passages with copies that the query takes for a repeated passage.
PASSAGE_RUN = 16
PASSAGE_RECALL = 0.98
PASSAGE_ROWS = 2
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = 400_000
#: Paragraphs that are compared in one go, and shingles to a block of the comparison.
RUN_CAP = 2048
_COLUMNS = 2048


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands by which a pair at the limit shares one with the wanted probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


def pieces(text: str | None, wrapped: bool = False) -> list[str]:
    """The paragraphs of a text by line number; those joined stand at their first line and leave empty lines.

    Short lines (under ``MIN_WORDS`` words) are one paragraph if they look broken at one width: no line but the last had
    room for the word that comes next, none repeats the one before, and some line ends inside a sentence. Three lines show the width; two are joined where the text has shown it elsewhere.
    """
    out = (text or "").split("\n")
    if not wrapped or len(out) < 3:
        return out
    size, ahead, short = [len(x.rstrip()) for x in out], [], []
    for x in out:
        ws = x.split(None, 1)
        ahead.append(len(ws[0]) + 1 if ws else 0)
        short.append(bool(ws) and len(_WORD.findall(x)) < MIN_WORDS)
    inside = lambda n: out[n].rstrip()[-1] not in ".!?"
    spans, width, i = [], 0, 0
    while i < len(out):
        j, most, least = i, size[i], 1 << 60  # least: the room that the tightest full line would have needed
        while short[i] and j + 1 < len(out) and short[j + 1]:
            tight, wide = min(least, size[j] + ahead[j + 1]), max(most, size[j + 1])
            if tight <= wide or out[j] == out[j + 1]:
                break
            j, most, least = j + 1, wide, tight
        if j - i >= 2 and any(inside(n) for n in range(i, j)):
            width = max(width, most)
            spans.append((i, j))
            i = j
        i += 1
    taken = {n for a, b in spans for n in range(a, b + 1)}
    i = 0
    while width and i + 1 < len(out):
        if short[i] and short[i + 1] and not {i, i + 1} & taken and inside(i) and max(size[i], size[i + 1]) <= width < size[i] + ahead[i + 1]:
            spans.append((i, i + 1))
            i += 1
        i += 1
    for a, b in spans:
        out[a : b + 1] = [" ".join(out[a : b + 1])] + [""] * (b - a)
    return out


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def passage_starts(flat: np.ndarray, reach: int = PASSAGE_REACH) -> np.ndarray:
    """First words of the passages of a text, from its word hashes.

    A passage begins at the text's first word and wherever three words hash lower than any other three that begin up to
    ``reach`` words away. So the cuts follow the words at hand: a passage that stands in two texts is cut alike in both,
    but for its ends, whatever stands around it and however lines are broken.
    """
    if len(flat) < 3:
        return np.zeros(min(1, len(flat)), np.int64)
    three = ((flat[:-2] * _MIX) ^ (flat[1:-1] >> np.uint64(7))) * _MIX + flat[2:]
    three = (three ^ (three >> np.uint64(32))) * _MIX
    most = np.full(reach, np.iinfo(np.uint64).max)
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate((most, three, most)), 2 * reach + 1)
    least = (three < around[:, :reach].min(axis=1)) & (three <= around[:, reach + 1 :].min(axis=1))
    starts = np.nonzero(least)[0]
    return starts if len(starts) and starts[0] == 0 else np.append(0, starts)


def shingle_hashes(words: list[list[str]], width: int = SHINGLE, flat: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): the shingle hashes of all paragraphs in a row, and where each paragraph begins."""
    flat = word_hashes([w for ws in words for w in ws]) if flat is None else flat
    sizes = np.array([len(ws) for ws in words])
    begins = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - width + 1, 1)
    starts = np.cumsum(counts) - counts
    at = np.arange(counts.sum()) - np.repeat(starts, counts) + np.repeat(begins, counts)
    reach = np.repeat(np.minimum(sizes, width), counts)
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        have = reach > j
        out[have] = (out[have] ^ (out[have] >> np.uint64(29))) * _MIX + flat[at[have] + j]
    return (out ^ (out >> np.uint64(32))) * _MIX, starts


def signatures(hashes: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """MinHash signatures, a row for each paragraph."""
    draw = np.random.default_rng(7)
    factors = draw.integers(1, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = draw.integers(0, 1 << 63, count, np.uint64)
    mixed = hashes ^ (hashes >> np.uint64(31))
    return np.stack([np.minimum.reduceat(mixed * a + b, starts) for a, b in zip(factors, shifts)], axis=1)


def _lines(text: str | None, wrapped: bool) -> Iterator[tuple]:
    """(number, words) of every paragraph."""
    for no, line in enumerate(pieces(text, wrapped)):
        yield no, words_of(line)


def _passages(text: str | None) -> Iterator[tuple]:
    """(first word, words, word hashes) of every passage."""
    words = words_of(text or "")
    flat = word_hashes(words)
    starts = passage_starts(flat).tolist()
    for a, b in zip(starts, [*starts[1:], len(words)]):
        yield a, words[a:b], flat[a:b]


def paragraphs(docs: DataFrame, id_col: str, text_col: str, min_words: int, width: int, bands: int, rows: int,
               wrapped: bool = False, passages: bool = False) -> DataFrame:
    """(id, key, no, n, h1, h2, bands): every paragraph with enough words, its name and its band hashes.

    With ``passages`` the texts' passages take the place of paragraphs; ``no`` is then a passage's first word.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def emit(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        words = [f[2] for f in found]
        banded = [ws for ws in words if len(ws) >= width]  # others only equal paragraphs, which have one name
        keys = np.zeros((len(banded), bands), np.uint64)
        if banded:
            flat = np.concatenate([f[3] for f in found if len(f[2]) >= width]) if passages else None
            hashes, starts = shingle_hashes(banded, width, flat)
            sig = signatures(hashes, starts, bands * rows)
            for b in range(bands):
                value = np.full(len(banded), b + 1, np.uint64)
                for r in range(rows):
                    value = (value ^ (value >> np.uint64(31))) * _MIX + sig[:, b * rows + r]
                keys[:, b] = value
        names = np.array([np.frombuffer(xxhash.xxh3_128_digest(" ".join(ws)), np.int64) for ws in words])
        which = pa.array([f[0] for f in found])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(bands * (len(ws) >= width) for ws in words)], dtype=np.int32)),
                                         pa.array(keys.reshape(-1).view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(which), batch.column(1).take(which), pa.array([f[1] for f in found], pa.int32()),
             pa.array([len(ws) for ws in words], pa.int32()), pa.array(names[:, 0]), pa.array(names[:, 1]), lists],
            ["id", "key", "no", "n", "h1", "h2", "bands"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0
            for at, text in enumerate(batch.column(2).to_pylist()):
                for found_ in _passages(text) if passages else _lines(text, wrapped):
                    if found_[1] and len(found_[1]) >= min_words:
                        found.append((at, *found_))
                        held += len(found_[1])
                    if held > _STEP:
                        yield emit(batch, found)
                        found, held = [], 0
            if found:
                yield emit(batch, found)

    based = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    return based.mapInArrow(
        kernel, f"id {kind}, key long, no int, n int, h1 long, h2 long, bands array<long>")


def _shingles(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int, wrapped: bool = False,
              passages: bool = False) -> DataFrame:
    """(h1, first, set): the distinct shingle hashes of one occurrence of each wanted paragraph."""
    lists = wanted.groupBy("first.id", "first.key").agg(F.collect_list(F.struct("h1", "first")).alias("wanted"))
    place = lambda key: F.pmod(F.hash(key), F.lit(FILTER_ROWS))
    hit = wanted.select(place("first.key").alias("place")).distinct()
    keyed = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    some = keyed.withColumn("place", place("key")).join(F.broadcast(hit), "place", "left_semi")  # at most FILTER_ROWS rows
    met = some.join(lists, some["id"].eqNullSafe(lists["id"]) & (some["key"] == lists["key"])).select("text", "wanted")

    def join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array(["\n".join(pieces(x, True)) for x in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts, batch.column(1)], ["text", "wanted"])

    first = wanted.schema["first"].dataType.simpleString()

    def of_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(1)
            out = []
            for text, some in zip(batch.column(0).to_pylist(), asked.to_pylist()):
                cut = {no: (ws, flat) for no, ws, flat in _passages(text)}
                out += [np.unique(shingle_hashes([cut[x["first"]["no"]][0]], width, cut[x["first"]["no"]][1])[0]).view(np.int64) for x in some]
            flat = asked.flatten()
            yield pa.RecordBatch.from_arrays(
                [flat.field("h1"), flat.field("first"), pa.array(out, pa.list_(pa.int64()))], ["h1", "first", "set"])

    if passages:
        return met.mapInArrow(of_passages, f"h1 long, first {first}, set array<long>").dropDuplicates(["h1", "first"])
    if wrapped:
        met = met.mapInArrow(join_lines, met.schema)
    cut = met.select(F.split("text", "\n").alias("parts"), "wanted").select("parts", F.explode("wanted").alias("x"))
    lines = cut.select("x.h1", "x.first", F.get("parts", F.col("x.first.no")).alias("line")).dropDuplicates(["h1", "first"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes([words_of(x)], width)[0]).view(np.int64) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], ["h1", "first", "set"])

    return lines.mapInArrow(kernel, f"h1 long, first {first}, set array<long>")


def verified(docs: DataFrame, pairs: DataFrame, groups: DataFrame, id_col: str, text_col: str, width: int,
             similarity: float, wrapped: bool = False, passages: bool = False) -> DataFrame:
    """Edges (a, b) between first occurrences for those pairs of h1 numbers with enough common shingles."""
    ends = pairs.select(F.col("a").alias("h1")).union(pairs.select(F.col("b").alias("h1"))).distinct()
    sets = stored(_shingles(docs, stored(groups.join(ends, "h1", "left_semi").select("h1", "first")), id_col, text_col, width, wrapped, passages))
    a = sets.select(F.col("h1").alias("a"), F.col("first").alias("first_a"), F.col("set").alias("set_a"))
    b = sets.select(F.col("h1").alias("b"), F.col("first").alias("first_b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(a, "a").join(b, "b").where(
        both >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - both) - F.lit(1e-9)
    ).select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))


def _connect(names: np.ndarray, group: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the groups which similar members of one run connect, at most one per group.

    Common shingles are counted by matrix products over blocks of shingles that at least two members have.
    """
    sizes = np.array([len(x) for x in sets], np.float32)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    shared = count[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        lo, hi = np.searchsorted(column, (start, start + _COLUMNS))
        part = np.zeros((len(sets), _COLUMNS), np.float32)
        part[row[lo:hi], column[lo:hi] - start] = 1.0
        common += part @ part.T
    near = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    ids, of = np.unique(group, return_inverse=True)
    i, j = np.nonzero(np.triu(near, 1))
    if not len(i):
        return names[:0], names[:0]
    pairs = np.unique(np.sort(np.stack((of[i], of[j])), axis=0), axis=1)
    label = merged(np.arange(len(ids)), pairs[0], pairs[1])
    member = names[np.unique(of, return_index=True)[1]]
    rest = np.nonzero(label != np.arange(len(ids)))[0]
    return member[label[rest]], member[rest]


def across(docs: DataFrame, left: DataFrame, groups: DataFrame, id_col: str, text_col: str, width: int, similarity: float,
           cap: int = RUN_CAP, wrapped: bool = False, passages: bool = False) -> DataFrame:
    """Edges (a, b) between first occurrences that join groups left apart in a band. ``left``: band, h1, group.

    The paragraphs of a band meet in one sorted run with their shingles and are compared there, so no pairs are written.
    A band with more than ``cap`` paragraphs is cut into parts, and every two parts are a run.
    """
    wanted = stored(groups.join(left.select("h1").distinct(), "h1", "left_semi").select("h1", "first"))
    sets = stored(_shingles(docs, wanted, id_col, text_col, width, wrapped, passages).select("h1", "set").dropDuplicates(["h1"]))
    sizes = stored(left.groupBy("band").agg(F.ceil(F.count("*") / F.lit(cap)).cast("int").alias("parts")).where("parts > 1"))
    cut = left.join(sizes, "band", "left").select(
        "band", "h1", "group", F.coalesce("parts", F.lit(1)).alias("parts")).withColumn(
        "part", F.pmod(F.xxhash64("h1", F.lit(3)), F.col("parts").cast("long")).cast("int"))
    run = cut.select("h1", "group", "band", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with")).select(
        F.xxhash64("band", F.least("part", "with"), F.greatest("part", "with")).alias("run"), "h1", "group")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple]) -> pa.RecordBatch:
            a, b = _connect(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), [r[3] for r in rows], similarity)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["h_a", "h_b"])

        rows: list[tuple] = []
        for batch in batches:
            keys, names, group = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            lists = batch.column(3)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for n in range(len(keys)):
                if rows and rows[0][0] != keys[n]:
                    if len(rows) > 1:
                        yield solve(rows)
                    rows = []
                rows.append((keys[n], names[n], group[n], flat[ends[n] : ends[n + 1]].copy()))
        if len(rows) > 1:
            yield solve(rows)

    found = run.join(sets, "h1").select("run", "h1", "group", "set").repartition("run").sortWithinPartitions("run").mapInArrow(
        kernel, "h_a long, h_b long").distinct()
    a = groups.select(F.col("h1").alias("h_a"), F.col("first").alias("a"))
    b = groups.select(F.col("h1").alias("h_b"), F.col("first").alias("b"))
    return stored(found).join(a, "h_a").join(b, "h_b").select("a", "b")


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
             width: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS,
             wrapped: bool = False, more_pairs: Callable[[DataFrame], DataFrame] | None = None,
             passages: bool = False) -> DataFrame:
    """(id, key, no, n, keep): every paragraph that has a copy; ``keep`` is the place of the one that stays.

    With ``passages`` these are passages, and ``no`` is the first word.

    ``more_pairs`` makes further candidates (a, b), h1 numbers, of the distinct paragraphs (h1, first); they are verified too.
    """
    bands = bands_for(similarity, recall, rows)
    found = stored(paragraphs(docs, id_col, text_col, min_words, width, bands, rows, wrapped, passages))
    groups = stored(found.groupBy("h1", "h2").agg(
        F.min(F.struct("id", "key", "no")).alias("first"), F.count("*").alias("rows")), sweep=True)
    spread = found.select("h1", F.explode("bands").alias("band"))
    # Stored, so that the join below has a plain shuffle on both sides and a hot band can be split.
    shared = stored(spread.groupBy("band").agg(F.min("h1").alias("lead"), F.max("h1").alias("last")).where("lead <> last"), sweep=True)
    met = stored(spread.join(shared.select("band", "lead"), "band").distinct(), sweep=True)
    star = met.where("h1 <> lead").select(F.col("lead").alias("a"), F.col("h1").alias("b"))
    if more_pairs:
        star = star.unionByName(more_pairs(groups.select("h1", "first")))
    star = stored(star.distinct(), sweep=True)
    edges = stored(verified(docs, star, groups, id_col, text_col, width, similarity, wrapped, passages))
    grouped = stored(components(edges))
    # Bands whose lead has not brought all together go on.
    first = groups.select("h1", "first")
    of = met.select("band", "h1").join(first, "h1").join(grouped, F.col("first") == F.col("node"), "left").select(
        "band", "h1", F.xxhash64(F.coalesce("component", "first")).alias("group"))
    open_ = of.groupBy("band").agg((F.min("group") != F.max("group")).alias("open")).where("open").select("band")
    left = stored(of.join(open_, "band"), sweep=True)
    more = across(docs, left, groups, id_col, text_col, width, similarity, wrapped=wrapped, passages=passages)
    whole = stored(components(edges.unionByName(more)))
    kept = groups.select("h1", "h2", "first", "rows").join(whole, F.col("first") == F.col("node"), "left").where(
        "rows > 1 or component is not null").select("h1", "h2", F.coalesce("component", "first").alias("keep"))
    return found.join(kept, ["h1", "h2"]).select("id", "key", "no", "n", "keep")


def repeated_passages(docs: DataFrame, least: int = PASSAGE_RUN) -> DataFrame:
    """(id, key, no, n, keep) of the passages that have a copy and stand in a run of such of ``least`` words or more.

    Lines, headings and stock phrases that are shorter than that are no repeated passages.
    """
    found = clusters(docs, min_words=SHINGLE, passages=True, recall=PASSAGE_RECALL, rows=PASSAGE_ROWS).distinct()
    inside = W.partitionBy("id", "key").orderBy("no")  # one document
    apart = (F.col("no") != F.lag(F.col("no") + F.col("n")).over(inside)).cast("int")
    runs = found.withColumn("run", F.sum(F.coalesce(apart, F.lit(0))).over(inside))
    words = F.sum("n").over(W.partitionBy("id", "key", "run"))
    return runs.withColumn("words", words).where(F.col("words") >= least).drop("run", "words")


def op1_paragraph_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of a repeated stretch (by its first word, from 0), the one that stands for it, and whether it goes."""
    return repeated_passages(load(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.col("no").alias("first_word"), F.col("n").cast("long").alias("n_words"),
        F.col("keep.id").alias("component_doc_id"), F.col("keep.no").alias("component_first_word"),
        (~F.struct("id", "key", "no").eqNullSafe(F.col("keep"))).alias("removed"))


QUERIES: dict[str, Builder] = {"op1_paragraph_minhash_dedup": op1_paragraph_minhash_dedup}
SQL: dict[str, str] = {}
