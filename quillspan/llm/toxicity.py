"""Toxicity by the nearest labelled examples, exact TF-IDF cosine over a block-max inverted index.

The examples are a bounded sample of the labelled rows (``per_class`` of each label, least hash first), so the index
has a fixed size and is broadcast. Terms are words and their beginnings (which catch inflected forms); those kept are
the ``max_terms`` that lean most clearly and most strongly to the toxic examples. Document frequencies of the kept terms count every
document. Each text is scored whole: blocks of examples are visited by descending upper bound until no block can hold
a nearer example, so the neighbours are exact. Their distance-weighted vote is calibrated on the examples, each judged
without itself and weighted back to the label's share of all labelled rows.

Defined cases: null and empty texts, and texts without a kept term, get the calibrated rate of such examples; without
labelled rows of both kinds every score is the smoothed share of label 1 (0 without labels); a document labelled twice
counts with its larger label; a null label is no label; a null id is never held out; repeated rows give a row each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import least_hashed, load, stored, whole_rows
from quillspan.plans.registry import Builder

PER_CLASS = 3_000
MAX_TERMS = 20_000
MIN_EXAMPLES = 3
MIN_LEANING = 3.5
#: A kept term is at least so many times as frequent in toxic examples; significance alone grows with the sample.
MIN_LIFT = 3.0
NEIGHBOURS = 15
EVIDENCE = 5
BLOCK = 64
REJECT = 0.3
#: Lengths of the word beginnings that are terms of their own.
BEGINNINGS = (4, 5, 6)
_TOKEN = re.compile(r"[^\W\d_]+")


def term_counts(text: str | None) -> Counter:
    """Counts of words and of word beginnings (marked with ``~``)."""
    out: Counter = Counter()
    for word, n in Counter(_TOKEN.findall((text or "").lower())).items():
        out[word] += n
        for k in BEGINNINGS:
            if len(word) >= k:
                out[word[:k] + "~"] += n
    return out


class Known(dict):
    """word → numbers of the known terms it stands for, remembered for as many words as fit ``LIMIT``."""

    LIMIT = 1_000_000

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, ...]:
        terms = [word] + [word[:k] + "~" for k in BEGINNINGS if len(word) >= k]
        found = tuple(n for n in map(self.vocabulary.get, terms) if n is not None)
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found
        return found

    def counts(self, text: str | None) -> dict[int, int]:
        """The counts of the known terms of a whole text."""
        out: dict[int, int] = {}
        for terms in map(self.__getitem__, _TOKEN.findall((text or "").lower())):
            for t in terms:
                out[t] = out.get(t, 0) + 1
        return out


def weigh(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms in order and their unit-length TF-IDF weights."""
    terms = np.array(sorted(counts), np.int64)
    if not len(terms):
        return terms, np.empty(0)
    weights = (1.0 + np.log([counts[t] for t in terms])) * idf[terms]
    norm = np.sqrt((weights * weights).sum())
    return terms, weights / norm if norm else weights


@dataclass
class Index:
    """Inverted index in blocks of ``BLOCK`` examples: each block has its terms in order and a row of weights per example;
    ``most`` holds each term's largest weight in each block."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    ids: list = field(default_factory=list)
    toxic: np.ndarray = field(default_factory=lambda: np.empty(0))
    blocks: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    most: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    levels: tuple | None = None
    without: float = 0.0

    def fill(self, examples: list[tuple]) -> None:
        """examples: (id, label, {term: count}); near ones share blocks, so that bounds are tight."""
        weighed = sorted(((weigh(c, self.idf), i, y) for i, y, c in examples if c), key=lambda e: (
            e[0][0][np.argsort(-e[0][1], kind="stable")[:4]].tolist(), str(e[1])))
        self.ids = [i for _, i, _ in weighed]
        self.toxic = np.array([y for *_, y in weighed], float)
        self.most = np.zeros((len(self.idf), -(-len(weighed) // BLOCK)))
        for start in range(0, len(weighed), BLOCK):
            held = [e[0] for e in weighed[start : start + BLOCK]]
            terms = np.unique(np.concatenate([t for t, _ in held]))
            rows = np.zeros((len(held), len(terms)))
            for row, (t, w) in enumerate(held):
                rows[row, np.searchsorted(terms, t)] = w
            self.most[terms, len(self.blocks)] = rows.max(axis=0)
            self.blocks.append((terms, rows))

    def nearest(self, counts: dict[int, int], k: int, leave_out: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar examples (numbers, cosines), ties by number; exact.

        Blocks are scored by descending upper bound, until none left can hold a nearer example.
        """
        terms, weights = weigh(counts, self.idf)
        best_at, best = np.empty(0, np.int64), np.empty(0)
        if not len(terms) or not self.blocks:
            return best_at, best
        bound = weights @ self.most[terms]
        for block in np.argsort(-bound, kind="stable").tolist():
            if bound[block] <= 0 or (len(best) == k and bound[block] < best[-1] - 1e-9):
                break
            of, rows = self.blocks[block]
            at = np.minimum(np.searchsorted(of, terms), len(of) - 1)
            known = of[at] == terms
            score = rows[:, at[known]] @ weights[known]
            hit = np.nonzero(score > 0)[0]
            if len(best) == k:
                hit = hit[score[hit] > best[-1] - 1e-9]
            number = hit + block * BLOCK
            if leave_out >= 0:
                hit, number = hit[number != leave_out], number[number != leave_out]
            if len(hit):
                best_at, best = np.concatenate((best_at, number)), np.concatenate((best, score[hit]))
                order = np.lexsort((best_at, -np.round(best, 12)))[:k]
                best_at, best = best_at[order], best[order]
        return best_at, best

    def vote(self, at: np.ndarray, near: np.ndarray) -> float:
        """Share of toxic neighbours, each weighted by its squared cosine and drawn to 0 by weak evidence."""
        w = near * near
        return float((w * self.toxic[at]).sum() / (w.sum() + 0.05)) if len(at) else 0.0

    def calibrate(self, examples: list[tuple], weight: dict[int, float], prior: float) -> None:
        """Isotonic map from votes to shares, each example judged without itself."""
        number = {i: n for n, i in enumerate(self.ids)}
        votes, labels, weights, plain, plain_toxic = [], [], [], 0.0, 0.0
        for i, y, counts in examples:
            at, near = self.nearest(counts, NEIGHBOURS, number.get(i, -1)) if counts else ((), ())
            if not len(at):
                plain, plain_toxic = plain + weight[y], plain_toxic + weight[y] * y
                continue
            votes.append(self.vote(at, near))
            labels.append(y)
            weights.append(weight[y])
        self.without = (plain_toxic + prior) / (plain + 1.0)
        if votes:
            self.levels = isotonic(np.array(votes), np.array(labels, float), np.array(weights))

    def score(self, counts: dict[int, int]) -> tuple[float, np.ndarray, np.ndarray]:
        at, near = self.nearest(counts, NEIGHBOURS) if counts else (np.empty(0, np.int64), np.empty(0))
        if not len(at) or self.levels is None:
            return self.without, at, near
        return float(np.clip(np.interp(self.vote(at, near), *self.levels), 0.0, 1.0)), at, near


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators; returns (centres, levels) for linear interpolation."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order]):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_terms: int = MAX_TERMS) -> Index:
    """Learn from at most ``per_class`` rows of each label; document frequencies cover all of ``docs``."""
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("label"))
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = shares.get(1, 0) / max(1, sum(shares.values()))
    if len(shares) < 2:
        return Index({}, np.empty(0), without=prior)
    drawn = [least_hashed(known.where(F.col("label") == y), F.xxhash64("doc_id"), per_class, shares[y]) for y in (0, 1)]
    chosen = stored(drawn[0].unionByName(drawn[1]))
    texts = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))  # bounded by 2 * per_class rows

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms = list(term_counts(text))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms, pa.string()), pa.array([label] * len(terms), pa.int32())], ["term", "label"])

    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Index({}, np.empty(0), without=prior)
    seen = texts.select("text", "label").mapInArrow(spread, "term string, label int").groupBy("term").agg(
        F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    p1, p0 = (F.col("a") + 0.5) / (n1 + 1), (F.col("b") + 0.5) / (n0 + 1)
    p = (F.col("a") + F.col("b") + 1) / (n1 + n0 + 2)
    leaning = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    picked = (
        seen.where(F.col("a") + F.col("b") >= MIN_EXAMPLES).where(p1 >= MIN_LIFT * p0)
        .select("term", leaning.alias("z")).where(F.col("z") >= MIN_LEANING).orderBy(F.desc("z"), "term").limit(max_terms).select("term").collect()
    )
    vocabulary = {r["term"]: n for n, r in enumerate(picked)}
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Known(shared.value)
        n = np.zeros(len(words.vocabulary) + 1, np.int64)  # the last counts documents
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if found := words.counts(text):
                    n[list(found)] += 1
                n[-1] += 1
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["term", "n"])

    counted = docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = np.zeros(len(vocabulary) + 1)
    for r in counted.collect():
        df[r["term"]] = r["n"]
    index = Index(vocabulary, np.log((1.0 + df[-1]) / (1.0 + df[:-1])) + 1.0)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Known(shared.value)
        for batch in batches:
            rows = [words.counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([list(r) for r in rows], pa.list_(pa.int64())),
                 pa.array([list(r.values()) for r in rows], pa.list_(pa.int64()))], ["doc_id", "label", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.select("doc_id", "text", "label").mapInArrow(
        vectors, f"doc_id {kind}, label int, terms array<long>, counts array<long>").collect()
    examples = [(r["doc_id"], r["label"], dict(zip(r["terms"], r["counts"]))) for r in sorted(rows, key=str)]
    index.fill(examples)
    index.calibrate(examples, {1: shares[1] / n1, 0: shares[0] / n0}, prior)
    return index


def score(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, text_key, score, neighbours) of every row; neighbours are the nearest examples as evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema["doc_id"].dataType
    of_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    evidence = pa.list_(pa.struct([("doc_id", of_id), ("similarity", pa.float64()), ("toxic", pa.int32())]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = Known(model.vocabulary)
        for batch in batches:
            scores, near = [], []
            for text in batch.column(1).to_pylist():
                value, at, cosines = model.score(words.counts(text))
                scores.append(value)
                near.append([{"doc_id": model.ids[a], "similarity": round(float(c), 6), "toxic": int(model.toxic[a])}
                             for a, c in zip(at[:EVIDENCE], cosines[:EVIDENCE])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(near, evidence)],
                ["doc_id", "score", "neighbours"])

    named = kind.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        kernel, f"doc_id {named}, score double, neighbours array<struct<doc_id:{named},similarity:double,toxic:int>>")


@whole_rows("text")
def reject(docs: DataFrame, index: Index, threshold: float = REJECT) -> DataFrame:
    """Pipeline stage: rows scored under ``threshold``, columns unchanged; the decision needs no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index("text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = Known(model.vocabulary)
        for batch in batches:
            keep = [model.score(words.counts(t))[0] < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(kernel, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score, the decision at 0.3, and the nearest examples."""
    docs = load(spark, sf_dir, "documents")
    found = score(docs, fit(docs, load(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"),
        "neighbours",
    )


QUERIES: dict[str, Builder] = {"op2_toxicity": op2_toxicity}
SQL: dict[str, str] = {}
