"""Keyword index and BM25 ranking.

The index is built once and searched many times. It holds

* ``tokens``: one row per unit with its words in order; phrases are read from it;
* ``postings``: one row per (word, unit), written where the units' words were counted, each task's by word and unit;
* ``impacts``: the same postings in order of word and falling weight, packed in blocks of at most ``BLOCK_POSTINGS``; a
  list of the best units reads the first blocks of its word and no other;
* ``runs``: a word's postings may lie in several runs (one per write task); the directory says how many come before each;
* ``frequencies`` (document frequency per word) and ``statistics`` (one row).

Postings are dealt by unit and blocks by range of (word, weight), so a word that every unit holds is written by many tasks.
A search reads the postings of its words, phrases read the words of the units, and nothing reads a text.

Each search term is its own ranked list. A list depends on the term alone, so it is ranked once per distinct term and
then joined to every query that asks for the term: the cost follows the vocabulary of the batch, not the product of
queries and postings. Terms are tokenised like the texts; a term of several words is a phrase.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.text import words
from quillspan.operators.vector import rank_within
from quillspan.session import stored

# The usual parameters of the ranking formula.
K1 = 1.2
B = 0.75
MIN_IDF = 1e-6
TIE_DIGITS = 12
#: Folders the stored postings are spread over by word, so that a search opens those of its words only.
BUCKETS = 16
BLOCK_POSTINGS = 256
#: A filtered list first looks at so many times its length, and at four times as much whenever that was too little.
FIRST_LOOK = 4
#: Words under which a phrase is filed: as many of its first words as the largest of these that it has.
FILED_WORDS = (8, 4, 2)
#: Characters of phrases that are broadcast at once; more phrases read the units' words once per so many.
PASS_CHARS = 32_000_000


@dataclass(frozen=True)
class KeywordIndex:
    """A stored index.

    ``tokens``: unit_id, unit_len, tokens · ``postings``: bucket, term, unit_id, tf, unit_len, first_pos · ``impacts``: bucket, term, run, before (in
    the run), n, unit_ids, tfs, weights · ``runs``: bucket, term, run, run_before, run_n · ``frequencies``: term, df ·
    ``buckets``: over how many folders the words are spread.
    """

    tokens: DataFrame
    postings: DataFrame
    impacts: DataFrame
    runs: DataFrame
    frequencies: DataFrame
    n_units: int
    mean_len: float
    buckets: int


def tokenized(units: DataFrame, text: str = "text") -> DataFrame:
    """Units with their token array and token count, computed in place."""
    return units.withColumn("tokens", words(F.col(text))).withColumn("unit_len", F.size("tokens").cast("long"))


def _bucket(term, buckets: int):
    return F.pmod(F.hash(term), F.lit(buckets))


def postings(units: DataFrame, stem: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(term, unit_id, unit_len, tf, first_pos, positions): the inverted index.

    With ``stem`` the vocabulary is stemmed once and joined back, so the stemmer sees each distinct word one time.
    Texts are dealt by unit before they are cut into words. Words of a unit then lie in one task, and grouping them moves
    no word: a text is shorter than the row per word with its key that would be moved otherwise.
    """
    return _grouped(_unit_words(units.select("unit_id", "text").repartition("unit_id"), stem))


def _unit_words(units: DataFrame, stem: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(unit_id, unit_len, tokens): the words of every unit in order, or their stems."""
    held = tokenized(units).select("unit_id", "unit_len", "tokens")
    if stem is None:
        return held
    rows = held.withColumn("_row", F.monotonically_increasing_id()).select(
        "_row", "unit_id", "unit_len", F.posexplode_outer("tokens").alias("token_pos", "term"))
    stems = stem(rows.where(F.col("term").isNotNull()).select("term").distinct())
    stemmed = F.struct("token_pos", "stem")
    return rows.join(stems, "term", "left").groupBy("_row", "unit_id", "unit_len").agg(F.transform(
        F.array_sort(F.collect_list(F.when(F.col("stem").isNotNull(), stemmed))), lambda t: t["stem"]).alias("tokens")).drop("_row")


def _grouped(held: DataFrame) -> DataFrame:
    rows = held.select("unit_id", "unit_len", F.posexplode("tokens").alias("token_pos", "term"))
    return rows.groupBy("term", "unit_id", "unit_len").agg(
        F.count(F.lit(1)).alias("tf"), F.min("token_pos").cast("long").alias("first_pos"),
        F.sort_array(F.collect_list("token_pos")).alias("positions"),
    )


def stem_vocabulary(stem_fn: Callable[[str], str]) -> Callable[[DataFrame], DataFrame]:
    """Lift a word stemmer to a job over a one-column vocabulary."""

    def run(vocabulary: DataFrame) -> DataFrame:
        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(stem=batch["term"].map(stem_fn))

        return vocabulary.mapInPandas(apply, "term string, stem string")

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one task as blocks; ``before`` counts the postings of the word that the task has packed already."""
    run, now, packed = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        term = batch.column("term").dictionary_encode()
        code = term.indices.to_numpy()
        opens = np.append(True, code[1:] != code[:-1])
        first = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
        place = np.arange(n) - first
        names = term.dictionary.to_pylist()
        if names[code[0]] == now:
            place[: int(np.argmax(np.append(opens[1:], True))) + 1] += packed
        start = np.nonzero(opens | (place % BLOCK_POSTINGS == 0))[0]
        offsets = pa.array(np.append(start, n), pa.int32())
        now, packed = names[code[-1]], int(place[-1]) + 1
        at = pa.array(start)
        lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("unit_id", "tf", "weight")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("bucket").take(at), batch.column("term").take(at), pa.array(np.full(len(start), run, np.int64)),
             pa.array(place[start].astype(np.int64)), pa.array(np.diff(np.append(start, n)).astype(np.int64)), *lists],
            ["bucket", "term", "run", "before", "n", "unit_ids", "tfs", "weights"])


_IMPACTS = ("bucket int, term string, run long, before long, n long, unit_ids array<long>, tfs array<long>, "
            "weights array<double>")


def write_index(units: DataFrame, path: str, stem: Callable[[DataFrame], DataFrame] | None = None,
                buckets: int = BUCKETS) -> None:
    """Build and store the index of ``units`` (unit_id, text) under ``path``; texts are read once."""
    spark = units.sparkSession
    held = _unit_words(units.select("unit_id", "text").repartition("unit_id"), stem)
    held.write.mode("overwrite").parquet(f"{path}/tokens")
    held = spark.read.schema(held.schema).parquet(f"{path}/tokens")
    n_units, n_tokens = held.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
    mean_len = n_tokens / n_units if n_units else 0.0

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    counted = _grouped(held.repartition("unit_id")).drop("positions").withColumn("bucket", _bucket("term", buckets))
    raw = write(counted.sortWithinPartitions("bucket", "term", "unit_id"), "postings")
    weight = F.round(term_weight(F.col("tf"), F.col("unit_len"), F.lit(mean_len)), TIE_DIGITS)
    by_weight = raw.select("bucket", "term", "unit_id", "tf", weight.alias("weight"))
    falling = [F.col("bucket"), F.col("term"), F.desc("weight"), F.col("unit_id")]
    dealt = by_weight.repartitionByRange(*falling).sortWithinPartitions(*falling)
    impacts = write(dealt.mapInArrow(_packed, _IMPACTS), "impacts")
    runs = impacts.groupBy("bucket", "term", "run").agg(F.sum("n").alias("run_n"))
    earlier = W.partitionBy("bucket", "term").orderBy("run").rowsBetween(W.unboundedPreceding, -1)  # a row per write task
    runs = write(runs.withColumn("run_before", F.coalesce(F.sum("run_n").over(earlier), F.lit(0))), "runs")
    write(runs.groupBy("bucket", "term").agg(F.sum("run_n").alias("df")), "frequencies")
    spark.createDataFrame([(n_units, mean_len, buckets)], "n_units long, mean_len double, buckets int").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/statistics")


def open_index(spark: SparkSession, path: str) -> KeywordIndex:
    held = spark.read.parquet(f"{path}/statistics").first()
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return KeywordIndex(read("tokens"), read("postings"), read("impacts"), read("runs"), read("frequencies"), *held)


def term_weight(tf, unit_len, mean_len, k1: float = K1, b: float = B):
    """The saturating term-frequency part of BM25."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * unit_len / mean_len))


def inverse_frequency(n_units, df):
    return F.greatest(F.log((n_units - df + 0.5) / (df + 0.5)), F.lit(MIN_IDF))


def asked_words(index: KeywordIndex, terms: DataFrame, stem: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(term, width, at, word, bucket, df): the words of each distinct term in order, stored.

    The table is small beside the index and read by every part of a search.
    """
    wanted = terms.select("term").distinct().withColumn("term_words", words(F.col("term")))
    rows = wanted.select("term", F.size("term_words").alias("width"), F.posexplode("term_words").alias("at", "word"))
    if stem is not None:
        stems = stem(rows.select(F.col("word").alias("term")).distinct()).select(F.col("term").alias("word"), "stem")
        rows = rows.join(stems, "word").select("term", "width", "at", F.col("stem").alias("word"))
    rows = rows.withColumn("bucket", _bucket("word", index.buckets).cast("int"))
    known = index.frequencies.select("bucket", F.col("term").alias("word"), "df")
    return stored(rows.join(known, ["bucket", "word"], "left").select(
        "term", "width", "at", "word", "bucket", F.coalesce("df", F.lit(0)).alias("df")), "asked")


def _postings(index: KeywordIndex, *columns: str) -> DataFrame:
    return index.postings.select("bucket", F.col("term").alias("word"), *columns)


def single_matches(index: KeywordIndex, asked: DataFrame) -> DataFrame:
    """(term, unit_id, unit_len, tf, df): all units that hold a term of one word."""
    wanted = asked.where("width = 1").select("term", "word", "bucket", "df")
    return wanted.join(_postings(index, "unit_id", "unit_len", "tf"), ["bucket", "word"]).select(
        "term", "unit_id", "unit_len", "tf", "df")


def _filed(asked: DataFrame) -> DataFrame:
    """(term, width, filed, key, phrase): terms of several words, all of them known, under their first words."""
    phrase = asked.where("width > 1").groupBy("term", "width").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]).alias("term_words"),
        F.min("df").alias("least")).where("least > 0")
    filed = F.coalesce(*[F.when(F.col("width") >= n, F.lit(n)) for n in FILED_WORDS])
    return phrase.withColumn("filed", filed).select(
        "term", "width", "filed", F.array_join(F.slice("term_words", F.lit(1), F.col("filed")), " ").alias("key"),
        F.array_join("term_words", " ").alias("phrase"))


def phrase_matches(index: KeywordIndex, asked: DataFrame, pass_chars: int = PASS_CHARS) -> DataFrame:
    """(term, unit_id, unit_len, tf): units that hold the words of a term of several in a row.

    The words of the units are read once. At each place the next words look up the phrases that begin with them in a
    table that is broadcast, and longer phrases are compared to the end there. Only places where a phrase stands become
    rows, so the work follows the units and what is found, not the product of phrases and the units of their words.
    Phrases of more than ``pass_chars`` characters go out in passes.
    """
    filed = stored(_filed(asked), "filed")
    lengths, n_chars = filed.agg(F.collect_set("filed"), F.sum(F.length("term") + F.length("key") + F.length("phrase"))).first()
    if not lengths:
        return index.tokens.select(F.lit("").alias("term"), "unit_id", "unit_len", F.lit(0).cast("long").alias("tf")).limit(0)
    passes = 1 + n_chars // pass_chars
    places = index.tokens.select(
        "unit_id", "unit_len", "tokens", F.posexplode("tokens").alias("place", "_word")).withColumn(
        "n", F.explode(F.array(*[F.lit(n) for n in sorted(lengths)]))).where(F.col("place") + F.col("n") <= F.col("unit_len"))
    run = lambda n: F.array_join(F.slice("tokens", F.col("place") + 1, F.col(n)), " ")
    opened = places.withColumn("key", run("n"))
    whole = (F.col("width") == F.col("filed")) | (run("width") == F.col("phrase"))
    dealt = [filed.where(F.pmod(F.hash("term"), F.lit(passes)) == number) for number in range(passes)] if passes > 1 else [filed]
    found = [opened.join(F.broadcast(part), "key").where(whole).select("term", "unit_id", "unit_len") for part in dealt]
    return reduce(DataFrame.unionByName, found).groupBy("term", "unit_id", "unit_len").agg(F.count(F.lit(1)).alias("tf"))


def matches(index: KeywordIndex, terms: DataFrame, stem: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(term, unit_id, unit_len, tf): units that hold a term, its words in a row."""
    asked = asked_words(index, terms, stem)
    return single_matches(index, asked).drop("df").unionByName(phrase_matches(index, asked))


def _scored(index: KeywordIndex, found: DataFrame) -> DataFrame:
    """(term, unit_id, tf, df, weight, idf) of matches with their document frequency."""
    return found.select(
        "term", "unit_id", "tf", "df",
        F.round(term_weight(F.col("tf"), F.col("unit_len"), F.lit(index.mean_len)), TIE_DIGITS).alias("weight"),
        inverse_frequency(F.lit(index.n_units), F.col("df")).alias("idf"),
    )


def scored_phrases(index: KeywordIndex, asked: DataFrame) -> DataFrame:
    """(term, unit_id, tf, df, weight, idf) of the terms of several words; their frequencies are counted here."""
    found = stored(phrase_matches(index, asked), "phrases")
    return _scored(index, found.join(found.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term"))


def score_terms(index: KeywordIndex, terms: DataFrame, stem: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(term, unit_id, tf, df, weight, idf) for every match of the wanted terms.

    Document frequency and mean length run over the whole corpus.
    """
    asked = asked_words(index, terms, stem)
    return _scored(index, single_matches(index, asked)).unionByName(scored_phrases(index, asked))


def impact_blocks(index: KeywordIndex, asked: DataFrame, low: int, high: int) -> DataFrame:
    """(term, df, n, unit_ids, tfs, weights): the blocks of one-word terms that begin at the places from ``low`` to below
    ``high`` of the word's postings by falling weight."""
    wanted = asked.where("width = 1").select("term", "word", "bucket", "df")
    directory = index.runs.select("bucket", F.col("term").alias("word"), "run", "run_before", "run_n")
    near = wanted.join(directory, ["bucket", "word"]).where((F.col("run_before") < high) & (F.col("run_before") + F.col("run_n") > low))
    blocks = index.impacts.where(F.col("before") < high).withColumnRenamed("term", "word")
    start = F.col("run_before") + F.col("before")
    return near.join(blocks, ["bucket", "word", "run"]).where((start >= low) & (start < high)).select(
        "term", "df", "n", "unit_ids", "tfs", "weights")


def _rows(index: KeywordIndex, blocks: DataFrame) -> DataFrame:
    listed = F.arrays_zip(F.col("unit_ids").alias("unit_id"), F.col("tfs").alias("tf"), F.col("weights").alias("weight"))
    return blocks.select("term", "df", F.explode(listed).alias("p")).select(
        "term", "p.unit_id", "p.tf", "df", "p.weight", inverse_frequency(F.lit(index.n_units), F.col("df")).alias("idf"))


def _best_first() -> list[Column]:
    return [F.desc("weight"), F.asc("unit_id")]


def term_lists(index: KeywordIndex, terms: DataFrame, limit: int,
               stem: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(term, unit_id, tf, df, weight, idf): the ``limit`` best units of every distinct term.

    Blocks come by falling weight and ties by unit, so the blocks that begin before place ``limit`` hold the whole list.
    """
    asked = asked_words(index, terms, stem)
    single = _rows(index, impact_blocks(index, asked, 0, limit))
    return rank_within(single.unionByName(scored_phrases(index, asked)), ["term"], _best_first(), limit).drop("pos")


def grouped_lists(index: KeywordIndex, terms: DataFrame, limit: int, grouped: Callable[[DataFrame], DataFrame],
                  n_groups: int, stem: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(group, term, unit_id, tf, df, weight, idf): the ``limit`` best units of every term in every group, stored.

    ``grouped`` adds a column ``group`` to rows with a ``unit_id``. A word is read by falling weight, deeper and deeper,
    until each of the ``n_groups`` has its list or the word has no more postings.
    """
    asked = asked_words(index, terms, stem)
    pending, low, high = asked.where("width = 1"), 0, max(FIRST_LOOK * limit, BLOCK_POSTINGS)
    best = lambda rows: rank_within(rows, ["group", "term"], _best_first(), limit).drop("pos")
    found = stored(best(grouped(_rows(index, impact_blocks(index, pending, low, high)).unionByName(
        scored_phrases(index, asked)))), "lists")
    while True:
        full = found.groupBy("term", "group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit).groupBy("term").agg(
            F.count(F.lit(1)).alias("n")).where(F.col("n") >= n_groups)
        pending = pending.where(F.col("df") > high).join(full, "term", "left_anti")
        if pending.isEmpty():
            return found
        pending = stored(pending, "pending")
        low, high = high, 4 * high
        found = stored(best(found.unionByName(grouped(_rows(index, impact_blocks(index, pending, low, high))))), "lists")


def bm25_lists(scored: DataFrame, limit: int, scope: list[str] | None = None) -> DataFrame:
    """(scope, term, unit_id, score, pos): the ``limit`` best units of every distinct term among ``scored`` matches."""
    ranked = rank_within(scored, [*(scope or []), "term"], _best_first(), limit)
    return ranked.withColumn("score", F.col("idf") * F.col("weight"))


def bm25_topk(index: KeywordIndex, query_terms: DataFrame, limit: int,
              stem: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, term_no, term, unit_id, score, pos, tf) for a batch of query terms.

    A term that matches nothing, or holds no word at all, yields an empty list.
    """
    lists = bm25_lists(term_lists(index, query_terms, limit, stem), limit)
    return query_terms.select("query_id", "term_no", "term").join(lists, "term")


def term_hits(index: KeywordIndex, terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(term, n_units, n_groups): distinct units and groups (works) that hold each term. ``groups``: unit_id, group."""
    found = matches(index, terms).select("term", "unit_id").join(groups.select("unit_id", "group"), "unit_id")
    return found.groupBy("term", "group").agg(F.count(F.lit(1)).alias("n_units")).groupBy("term").agg(
        F.sum("n_units").alias("n_units"), F.count(F.lit(1)).alias("n_groups"))


def contained_phrases(phrases: DataFrame, index: KeywordIndex) -> DataFrame:
    """(phrase_id, unit_id): units that hold a phrase as a run of whole words. ``phrases``: phrase_id, text."""
    named = phrases.select("phrase_id", F.col("text").alias("term"))
    return named.join(matches(index, named).select("term", "unit_id"), "term").select("phrase_id", "unit_id").distinct()
