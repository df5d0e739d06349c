"""Document quality from a linear-chain conditional random field over lines.

Every non-blank line is good or bad. A line's evidence is its form (shares of character classes, word lengths, repeats
within the line and the document, line ends), cut into levels, together with the same levels of the line before and the
line after; neighbouring labels are tied by transition weights. Labels are known per document only: a document of label
1 has good lines only, one of label 0 has at least one bad line. So the field is fitted by the likelihood of "all lines
good", which needs the same forward-backward pass as the scores. A document's score is the mean of its lines' marginal
chances of being good, weighted by their lengths in characters and calibrated on documents held out in turn.

The fit uses at most ``per_class`` labelled documents of each label (least hash first), each by a stretch of at most
``LINES`` lines; statistics of the form have no corpus part. Scoring covers every line of every whole text.

Defined cases: null texts, empty texts and texts of blank lines get the calibrated rate of such documents; without
labelled rows of both kinds every score is the smoothed share of label 1 (0.5 without labels); a document labelled twice
counts with its smaller label; of rows with one id the one of least text hash is learnt from; a null label is no label; a
null id is never held out; repeated rows give a row each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import least_hashed, load, rolling_hashes, stored
from quillspan.llm.toxicity import held_out, isotonic
from quillspan.plans.registry import Builder

PER_CLASS = 3_000
#: Lines of one document that enter the fit.
LINES = 64
FOLDS = 3
ACCEPT = 0.7
#: Bytes of text whose lines are measured at once; a longer text is measured alone.
CHUNK = 1 << 20
#: A feature is over its n-th level or not.
LEVELS = np.array([0.004, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 0.95])
RIDGE = 0.02
#: Character classes of bytes: lower, upper, digit, blank, symbol, bar, exclamation, punctuation, lead, continuation, control.
_CLASSES = 11
_CLASS = np.full(256, 10, np.uint8)
for _number, _bytes in enumerate(
    (range(97, 123), range(65, 91), range(48, 58), b" \t\r\x0b\x0c", b"#*$%&^~@=+\\_/", b"|<>{}[]", b"!?", b".,;:'\"()-`",
     range(0xC2, 0xF5), range(0x80, 0xC0))
):
    _CLASS[list(_bytes)] = _number
FEATURES = (
    "chars", "words", "upper", "digit", "blank", "symbol", "bar", "exclamation", "punctuation", "wide", "control",
    "word_length", "longest_word", "repeated_neighbour", "repeated_in_line", "repeated_line", "repeated_in_text",
    "marked_word", "single_letter", "closed", "capital", "first", "last",
)


@dataclass
class Lines:
    """The non-blank lines of several texts: quantised features, length in characters, and where each text's lines lie."""

    features: np.ndarray
    chars: np.ndarray
    number: np.ndarray  # line number inside the text
    offset: np.ndarray  # first line of each text, and one more


def measure(texts: list[bytes]) -> Lines:
    """Features of all lines of whole texts."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    text_start = np.cumsum(sizes) - sizes
    ends = np.nonzero(raw == 10)[0]
    starts = np.append(0, ends[:-1] + 1)
    text_of = np.searchsorted(text_start, starts, "right") - 1
    first_line = np.searchsorted(starts, text_start)
    n = len(ends)
    line_of = np.repeat(np.arange(n, dtype=np.int32), ends - starts + 1)
    kinds = _CLASS[raw]
    count = np.bincount(line_of * np.int32(_CLASSES) + kinds, minlength=n * _CLASSES).reshape(n, _CLASSES)
    count[:, 10] -= 1  # the line end itself
    chars = count.sum(axis=1) - count[:, 9]
    inside = (kinds != 3) & (raw != 10)
    edge = np.diff(inside.view(np.int8), prepend=0)
    begin, stop = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    in_line = line_of[begin]
    words = np.bincount(in_line, minlength=n)
    h = rolling_hashes(raw, begin, stop)
    in_text = text_of[in_line]

    def share_of(flag: np.ndarray) -> np.ndarray:
        return np.bincount(in_line, weights=flag, minlength=n) / np.maximum(words, 1)

    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (in_line[1:] == in_line[:-1])
    mixed = h ^ (in_line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, once = np.unique(mixed, return_index=True)
    again = np.ones(len(h))
    again[once] = 0
    covered = np.zeros(len(h))
    if len(h) > 2:
        three = h[:-2] + h[1:-1] * np.uint64(3) + h[2:] * np.uint64(7) + in_text[:-2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        whole = in_text[:-2] == in_text[2:]
        _, back, often = np.unique(three, return_inverse=True, return_counts=True)
        twice = np.nonzero((often[back] > 1) & whole)[0]
        for j in range(3):
            covered[twice + j] = 1
    line_hash = rolling_hashes(raw, starts, ends) + text_of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    _, back, often = np.unique(line_hash, return_inverse=True, return_counts=True)
    length = (stop - begin).astype(float)
    marked = np.isin(kinds[stop - 1], (4, 6))
    longest = np.zeros(n)
    np.maximum.at(longest, in_line, length)
    some = np.maximum(chars, 1).astype(float)
    letters = np.maximum(count[:, 0] + count[:, 1], 1)
    has = words > 0
    opening, closing = np.zeros(n), np.zeros(n)
    opening[in_line[::-1]] = (kinds[begin] == 1)[::-1]
    closing[in_line] = kinds[stop - 1] == 7
    columns = [
        np.log2(1 + chars) / 16, np.log2(1 + words) / 12, count[:, 1] / letters, count[:, 2] / some, count[:, 3] / some,
        count[:, 4] / some, count[:, 5] / some, count[:, 6] / some, count[:, 7] / some, count[:, 8] / some,
        count[:, 10] / some, np.bincount(in_line, weights=length, minlength=n) / np.maximum(words, 1) / 20,
        np.log2(1 + longest) / 16, share_of(same), share_of(again), (often[back] > 1) & has, share_of(covered),
        share_of(marked), share_of(length == 1), closing, opening,
        np.arange(n) == first_line[text_of], np.append(text_of[1:] != text_of[:-1], True),
    ]
    features = np.stack([np.minimum(np.rint(255 * np.clip(c, 0, 1)), 255).astype(np.uint8) for c in columns], axis=1)
    kept = np.nonzero(has)[0]
    return Lines(features[kept], chars[kept], (np.arange(n) - first_line[text_of])[kept],
                 np.searchsorted(text_of[kept], np.arange(len(texts) + 1)))


def levels(features: np.ndarray) -> np.ndarray:
    """One 0/1 column per feature and level."""
    over = features[:, :, None] > np.rint(255 * LEVELS)[None, None, :]
    return over.reshape(len(features), -1).astype(np.float32)


WIDTH = len(FEATURES) * len(LEVELS)


@dataclass
class Chains:
    """Chains of lines in one flat table, walked together: longest first, step ``t`` moves all chains longer than ``t``."""

    offset: np.ndarray

    def __post_init__(self) -> None:
        size = np.diff(self.offset)
        order = np.argsort(-size, kind="stable")
        self.first, self.size, self.order = self.offset[:-1][order], size[order], order
        self.steps = int(size.max(initial=0))
        self.alive = [int(np.searchsorted(-self.size, -t, "left")) for t in range(self.steps + 1)]  # longer than t
        heads = self.offset[:-1][size > 0]
        self.head = np.zeros(int(self.offset[-1]), bool)
        self.head[heads] = True
        self.tail = np.zeros(int(self.offset[-1]), bool)
        self.tail[self.offset[1:][size > 0] - 1] = True

    def pairs(self, unary: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chance of good per line, expected transitions per chain [n, 2, 2], log of the partition sum per chain)."""
        n = len(unary)
        score = np.zeros((n, 2))
        score[:, 1] = unary
        ahead, back = score.copy(), np.zeros((n, 2))
        for t in range(1, self.steps):
            at = self.first[: self.alive[t]] + t
            ahead[at] += np.logaddexp(ahead[at - 1, :1] + tie[0], ahead[at - 1, 1:] + tie[1])
        for t in range(self.steps - 2, -1, -1):
            at = self.first[: self.alive[t + 1]] + t
            after = score[at + 1] + back[at + 1]
            back[at] = np.logaddexp(tie[:, 0] + after[:, :1], tie[:, 1] + after[:, 1:])
        total = np.zeros(len(self.size))
        full = self.size > 0
        last = (self.first + self.size - 1)[full]
        total[full] = np.logaddexp(ahead[last, 0], ahead[last, 1])
        out = np.empty(len(total))
        out[self.order] = total
        per_line = np.repeat(out, np.diff(self.offset))
        good = np.exp(np.minimum(ahead[:, 1] + back[:, 1] - per_line, 0.0))
        moves = np.zeros((len(self.size), 2, 2))
        inner = np.nonzero(~self.head)[0]
        chain = np.repeat(np.arange(len(out)), np.diff(self.offset))[inner]
        for i in range(2):
            for j in range(2):
                chance = np.exp(np.minimum(
                    ahead[inner - 1, i] + tie[i, j] + score[inner, j] + back[inner, j] - per_line[inner], 0.0))
                moves[:, i, j] = np.bincount(chain, weights=chance, minlength=len(out))
        return good, moves, out


def neighboured(own: np.ndarray, weights: np.ndarray, chains: Chains) -> np.ndarray:
    """Unary scores from a line's own levels and those of its neighbours in the text."""
    parts = own @ weights.reshape(3, -1).T.astype(np.float32)
    out = parts[:, 0].astype(float)
    out[1:] += np.where(chains.head[1:], 0.0, parts[:-1, 1])
    out[:-1] += np.where(chains.tail[:-1], 0.0, parts[1:, 2])
    return out


@dataclass
class Field:
    """Weights of the field: (own, line before, line after) levels, a bias, and the transitions; and the calibration."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(3 * WIDTH))
    bias: float = 0.0
    tie: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: tuple | None = None
    without: float = 0.5

    def marginals(self, lines: Lines) -> np.ndarray:
        """Chance of being good, per line."""
        chains = Chains(lines.offset)
        return chains.pairs(neighboured(levels(lines.features), self.weights, chains) + self.bias, self.tie)[0]

    def raw(self, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
        """(length-weighted mean of the marginals per text, nan without lines; marginals)."""
        good = self.marginals(lines) if len(lines.features) else np.empty(0)
        text = np.repeat(np.arange(len(lines.offset) - 1), np.diff(lines.offset))
        of = lambda w: np.bincount(text, weights=w, minlength=len(lines.offset) - 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return of(good * lines.chars) / of(lines.chars.astype(float)), good

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        """Scores; equal calibrated levels keep the order of the plain means."""
        if self.curve is None:
            return np.full(len(raw), self.without)
        fit = 0.99 * np.interp(np.nan_to_num(raw), *self.curve) + 0.01 * np.nan_to_num(raw)
        return np.clip(np.where(np.isnan(raw), self.without, fit), 0.0, 1.0)


def learn(lines: Lines, label: np.ndarray, rounds: int = 60) -> Field:
    """Most likely weights for "label 1: all lines good, label 0: not all", with a ridge, by limited-memory BFGS."""
    chains, own = Chains(lines.offset), levels(lines.features)
    size = np.diff(lines.offset)
    line_text = np.repeat(np.arange(len(label)), size)
    lined = size > 0
    inner = np.maximum(size - 1, 0)

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        weights, bias, tie = theta[: 3 * WIDTH], theta[3 * WIDTH], theta[3 * WIDTH + 1 :].reshape(2, 2)
        unary = neighboured(own, weights, chains) + bias
        good, moves, total = chains.pairs(unary, tie)
        whole = np.bincount(line_text, weights=unary, minlength=len(label)) + inner * tie[1, 1]
        log_good = np.minimum(whole - total, -1e-9)
        log_rest = np.log(-np.expm1(log_good))
        value = -np.where(label == 1, log_good, log_rest)[lined].sum()
        pull = np.where(label == 1, -1.0, np.exp(np.clip(log_good - log_rest, -50, 50))) * lined
        slope = (pull[line_text] * (1.0 - good)).astype(np.float32)
        before, after = slope[1:] * ~chains.head[1:], slope[:-1] * ~chains.tail[:-1]
        grad = np.concatenate([slope @ own, before @ own[:-1], after @ own[1:]]).astype(float)
        ties = -(pull[:, None, None] * moves)
        ties[:, 1, 1] += pull * inner
        grad = np.concatenate([grad, [slope.sum(dtype=float)], ties.sum(axis=0).ravel()])
        n = max(1, int(lined.sum()))
        return value / n + 0.5 * RIDGE * theta @ theta / n, grad / n + RIDGE * theta / n

    theta = np.zeros(3 * WIDTH + 5)
    value, grad = loss(theta)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way = -grad
        kept = []
        for s, y in reversed(steps):
            a = (s @ way) / (s @ y)
            kept.append(a)
            way = way - a * y
        if steps:
            s, y = steps[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(kept)):
            way = way + (a - (y @ way) / (s @ y)) * s
        slope, size_of = grad @ way, 1.0 if steps else 1.0 / max(1.0, float(np.abs(grad).sum()))
        if slope >= 0:
            break
        while size_of > 1e-6:
            new = theta + size_of * way
            new_value, new_grad = loss(new)
            if new_value <= value + 1e-4 * size_of * slope:
                break
            size_of /= 2
        else:
            break
        s, y = new - theta, new_grad - grad
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-8:]
        done = value - new_value < 1e-6 * max(1.0, abs(value))
        theta, value, grad = new, new_value, new_grad
        if done:
            break
    return Field(theta[: 3 * WIDTH], float(theta[3 * WIDTH]), theta[3 * WIDTH + 1 :].reshape(2, 2).copy())


def _chosen(lines: Lines, texts: np.ndarray) -> Lines:
    size = np.diff(lines.offset)[texts]
    at = np.repeat(lines.offset[:-1][texts] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return Lines(lines.features[at], lines.chars[at], lines.number[at], np.append(0, np.cumsum(size)))


def trained(lines: Lines, label: np.ndarray, fold: np.ndarray, weight: dict[int, float], prior: float) -> Field:
    """The field of all examples, calibrated by fields that had not seen the example; ``weight`` per label undoes the draw."""
    empty = np.diff(lines.offset) == 0
    w = np.array([weight[int(y)] for y in label])
    model = learn(lines, label)
    votes = np.full(len(label), np.nan)
    for f in range(FOLDS):
        there, rest = np.nonzero((fold == f) & ~empty)[0], np.nonzero(fold != f)[0]
        if len(there) and len(set(label[rest].tolist())) == 2:
            votes[there] = learn(_chosen(lines, rest), label[rest]).raw(_chosen(lines, there))[0]
    voted = ~np.isnan(votes)
    if voted.any():
        model.curve = isotonic(votes[voted], label[voted].astype(float), w[voted])
    model.without = float(((w * label)[empty].sum() + prior) / (w[empty].sum() + 1.0))
    return model


def _texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of about ``CHUNK`` bytes."""
    held, size, start = [], 0, 0
    for n, text in enumerate(column.cast(pa.binary()).to_pylist()):
        if held and size + len(text or b"") > CHUNK:
            yield start, held
            held, size, start = [], 0, n
        held.append(text or b"")
        size += len(text or b"")
    if held:
        yield start, held


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Field:
    """Learn from at most ``per_class`` documents of each label, by at most ``LINES`` lines each."""
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("label"))
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = (shares.get(1, 0) + 0.5) / (sum(shares.values()) + 1.0)
    if len(shares) < 2:
        return Field(without=prior)
    drawn = [least_hashed(known.where(F.col("label") == y), F.xxhash64("doc_id"), per_class, shares[y]) for y in (0, 1)]
    chosen = stored(drawn[0].unionByName(drawn[1]))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class ids

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, some in _texts(batch.column(1)):
                lines = measure(some)
                features, chars, key = [], [], []
                for n in range(len(some)):
                    low, high = int(lines.offset[n]), int(lines.offset[n + 1])
                    hashed = int(rolling_hashes(np.frombuffer(some[n], np.uint8), np.array([0]), np.array([len(some[n])]))[0])
                    if high - low > LINES:
                        low += hashed % (high - low - LINES + 1)
                        high = low + LINES
                    features.append(lines.features[low:high].tobytes())
                    chars.append(lines.chars[low:high].tolist())
                    key.append(hashed >> 1)
                part = batch.slice(start, len(some))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(features, pa.binary()), pa.array(chars, pa.list_(pa.int64())),
                     pa.array(key, pa.int64())], ["doc_id", "label", "features", "chars", "key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = texts.select("doc_id", "text", "label").mapInArrow(
        kernel, f"doc_id {kind}, label int, features binary, chars array<long>, key long")
    one = made.groupBy("doc_id", "label").agg(F.min_by(F.struct("features", "chars"), "key").alias("x"), F.min("key").alias("key"))
    rows = one.select("label", "x.features", "x.chars", "key").toArrow().to_pylist()
    # Equal texts of one label are one example.
    rows = sorted({(r["key"], r["label"]): r for r in rows}.values(), key=lambda r: (r["key"], r["label"]))
    label = np.array([r["label"] for r in rows])
    sizes = {y: int((label == y).sum()) for y in (0, 1)}
    if not all(sizes.values()):
        return Field(without=prior)
    counts = np.array([len(r["chars"]) for r in rows])
    features = np.frombuffer(b"".join(r["features"] for r in rows), np.uint8).reshape(-1, len(FEATURES))
    lines = Lines(features, np.array([c for r in rows for c in r["chars"]], np.int64), np.zeros(len(features), np.int64),
                  np.append(0, np.cumsum(counts)))
    fold = np.array([r["key"] % FOLDS for r in rows])
    return trained(lines, label, fold, {y: shares[y] / sizes[y] for y in (0, 1)}, prior)


def score(docs: DataFrame, model: Field) -> DataFrame:
    """(doc_id, score, n_lines, bad_lines) of every row; ``bad_lines`` are the numbers (from 1) of the lines that are
    more likely bad than good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            for start, some in _texts(batch.column(1)):
                lines = measure(some)
                raw, good = field.raw(lines)
                bad = np.nonzero(good < 0.5)[0]
                per = np.searchsorted(bad, lines.offset)
                found = pa.ListArray.from_arrays(
                    pa.array(per, pa.int32()), pa.array(lines.number[bad] + 1, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(some)), pa.array(field.calibrated(raw)),
                     pa.array(np.diff(lines.offset), pa.int64()), found], ["doc_id", "score", "n_lines", "bad_lines"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        kernel, f"doc_id {kind}, score double, n_lines long, bad_lines array<int>")


def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score, the decision at 0.7, and how many of its lines look bad."""
    docs = load(spark, sf_dir, "documents")
    found = score(docs, fit(docs, load(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
        "n_lines", F.size("bad_lines").cast("long").alias("n_bad_lines"),
    )


QUERIES: dict[str, Builder] = {"op11_line_quality": op11_line_quality}
SQL: dict[str, str] = {}
