"""Stored answers: paging, search, rendering against the current index, export, migration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.keys import CLASSIC, KeyLayout
from quillspan.functions.refs import reference
from quillspan.functions.text import words
from quillspan.operators.vector import rank_within
from quillspan.session import cut_lineage, remove_folder

Stemmer = Callable[[DataFrame], DataFrame]

BUCKETS = 16
SEARCH_LIMIT = 100
VERSION = 2
STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def answer_rows(answers: DataFrame) -> DataFrame:
    """History rows of assembled answers: ids and timings as JSON, the fallback where there is no synopsis.

    ``answers`` are nested answers with asked_at, question, mode, model_id, index_version, flagged, timings (a map of
    seconds by stage) and verdict beside them.
    """
    sent = F.transform(
        F.array_sort(
            F.transform(
                F.filter("passages", lambda p: p["sent"]),
                lambda p: F.struct(F.regexp_extract(p["token"], r"(\d+)", 1).cast("int").alias("no"), p["unit_ids"].alias("ids")),
            )
        ),
        lambda p: p["ids"],
    )
    return answers.select(
        F.col("query_id").alias("id"), "asked_at", "question", "mode",
        F.coalesce("synopsis", "fallback_text", F.lit("")).alias("answer"), F.to_json(sent).alias("passage_ids"),
        F.to_json("cited_unit_ids").alias("cited_ids"), "model_id", "index_version", "flagged", "fallback_used",
        F.to_json("timings").alias("timings"), "verdict",
    )


def append_answers(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def page(entries: DataFrame, limit: int, offset: int = 0, key: str = "id") -> DataFrame:
    """Newest first; only the top ``limit + offset`` rows of every partition are kept."""
    return entries.orderBy(F.desc(key)).offset(offset).limit(limit)


def _text_of(entries: DataFrame):
    return F.concat(F.coalesce("question", F.lit("")), F.lit(" "), F.coalesce("answer", F.lit("")))


def stored_stems(path: str, stem: Stemmer) -> Stemmer:
    """A stemmer that keeps the stem of every word it has met in a table (term, stem) under ``path``.

    Words that the table has are joined to it; only new ones are stemmed, and added. The table lies beside an index and is
    shared by its building, its maintenance and its searches.
    """

    def run(vocabulary: DataFrame) -> DataFrame:
        spark = vocabulary.sparkSession
        words_ = cut_lineage(vocabulary.select("term").where("term IS NOT NULL").distinct())
        known = _read_or_none(spark, path)
        new = words_ if known is None else words_.join(known, "term", "left_anti")
        if not new.isEmpty():
            stem(new).select("term", "stem").write.mode("append").parquet(path)
        held = _read_or_none(spark, path)
        return stem(words_) if held is None else words_.join(held, "term")

    return run


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("term string, stem string").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def entry_postings(entries: DataFrame, stem: Stemmer | None = None) -> DataFrame:
    """(id, term, tf) over question and answer; with ``stem`` the distinct words are stemmed once and joined back."""
    rows = entries.select("id", F.explode(words(_text_of(entries))).alias("term"))
    if stem is not None:
        rows = rows.join(stem(rows.select("term").distinct()), "term").select("id", F.col("stem").alias("term"))
    return rows.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def search(postings: DataFrame, ids: DataFrame, searches: DataFrame, limit: int = SEARCH_LIMIT,
           stem: Stemmer | None = None) -> DataFrame:
    """(query_id, id, pos): entries that hold every word of a search string, newest first.

    ``postings``: the stored index (id, term). ``ids``: id of every entry. ``searches``: query_id, text. A search
    starts from the entries of its rarest word and looks the other words up there, so a common word never multiplies. A
    string without words lists the newest entries.
    """
    wanted = searches.select("query_id", F.array_distinct(words(F.col("text"))).alias("terms"))
    terms = wanted.select("query_id", F.explode("terms").alias("term"))
    if stem is not None:
        stems = stem(terms.select("term").distinct())
        terms = terms.join(stems, "term").select("query_id", F.col("stem").alias("term")).distinct()
    held = postings.select("id", "term")
    counts = held.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rare = terms.join(counts, "term", "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("lead"))
    begun = rare.join(held.withColumnRenamed("term", "lead"), "lead")
    others = begun.select("query_id", "id", "lead").join(terms, "query_id").where(F.col("term") != F.col("lead"))
    met = others.join(held, ["id", "term"], "left_semi").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"))
    found = begun.join(met, ["query_id", "id"], "left").where(
        F.coalesce("n", F.lit(0)) == F.col("n_terms") - 1).select("query_id", "id")
    newest = ids.select("id").orderBy(F.desc("id")).limit(limit).agg(F.collect_list("id")).scalar()
    listed = wanted.where(F.size("terms") == 0).select("query_id", newest.alias("ids")).select(
        "query_id", F.explode("ids").alias("id")
    )
    return rank_within(found.unionByName(listed), ["query_id"], [F.desc("id")], limit)


def maintain_postings(postings: DataFrame, changed: DataFrame, deleted: DataFrame, stem: Stemmer | None = None) -> DataFrame:
    """The index after updates and deletes: old rows of touched ids leave, new rows of changed ids enter.

    Only the changed entries are tokenised. ``changed``: id, question, answer. ``deleted``: id.
    """
    touched = changed.select("id").unionByName(deleted.select("id")).distinct()
    return postings.join(touched, "id", "left_anti").unionByName(
        entry_postings(changed.join(deleted.select("id"), "id", "left_anti"), stem)
    )


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.hash("id"), F.lit(buckets)))


def _by_range(rows: DataFrame) -> DataFrame:
    """Rows dealt by ranges of bucket and word: a bucket is written by as many tasks as its size asks for."""
    order = ["bucket", "term", "id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def write_postings(postings: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store the index by buckets of ids, so that a change rewrites the buckets it touches and no others."""
    _by_range(_bucketed(postings, buckets)).write.mode("overwrite").partitionBy("bucket").parquet(path)


def update_postings(path: str, changed: DataFrame, deleted: DataFrame, buckets: int = BUCKETS, stem: Stemmer | None = None) -> None:
    """Apply changes to a stored index in place. The new buckets are kept in the shared folder before any is replaced."""
    spark = changed.sparkSession
    stored = spark.read.parquet(path)
    touched = _bucketed(changed.select("id").unionByName(deleted.select("id")), buckets).select("bucket").distinct()
    numbers = [r["bucket"] for r in touched.collect()]  # at most ``buckets`` numbers
    held = stored.where(F.col("bucket").isin(numbers)).select("id", "term", "tf")
    fresh = cut_lineage(_bucketed(maintain_postings(held, changed, deleted, stem), buckets))
    _by_range(fresh).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    emptied = set(numbers) - {r["bucket"] for r in fresh.select("bucket").distinct().collect()}
    for number in emptied:
        remove_folder(spark, f"{path}/bucket={number}")


def latest_settings(changes: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Last written value per key."""
    return changes.groupBy(key).agg(F.max_by(value, order).alias(value))


# --- stored passage lists ----------------------------------------------------------

def is_numbered(ids: Column) -> Column:
    """True for a list of lists (passage numbers known), false for a flat legacy list."""
    return ids.rlike(r"^\s*\[\s*(\[|\])")


def passage_lists(ids: Column, layout: KeyLayout = CLASSIC) -> Column:
    """Unit ids per stored passage; a flat list is regrouped by adjacency."""
    flat = F.array_sort(F.array_distinct(F.from_json(ids, "array<bigint>")))

    def grow(groups: Column, unit: Column) -> Column:
        last = F.element_at(groups, -1)
        tail = F.element_at(last, -1)
        near = (layout.work(tail) == layout.work(unit)) & (layout.chapter(tail) == layout.chapter(unit)) & (unit - tail <= 1)
        extended = F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(F.concat(last, F.array(unit))))
        return F.when((F.size(groups) > 0) & near, extended).otherwise(F.concat(groups, F.array(F.array(unit))))

    regrouped = F.aggregate(flat, F.array().cast("array<array<bigint>>"), grow)
    return F.when(is_numbered(ids), F.from_json(ids, "array<array<bigint>>")).otherwise(
        F.coalesce(regrouped, F.array().cast("array<array<bigint>>"))
    )


def passage_bodies(lists: DataFrame, units: DataFrame, body: Callable[[Column], Column]) -> DataFrame:
    """(unit_ids, body): the text of every distinct list of units, passed through ``body``.

    Entries name the same passages again and again. A text is read once per distinct passage that holds it, so what is
    moved follows the index and not the history.
    """
    rows = lists.select("unit_ids").distinct().select("unit_ids", F.explode("unit_ids").alias("unit_id"))
    parts = rows.join(units.select("unit_id", "text"), "unit_id").groupBy("unit_ids").agg(
        F.array_sort(F.collect_list(F.struct("unit_id", "text"))).alias("p"))
    return parts.select("unit_ids", body(F.array_join(F.transform("p", lambda u: u["text"]), " ")).alias("body"))


def stored_passages(entries: DataFrame, works: DataFrame, units: DataFrame, index_version: str,
                    layout: KeyLayout = CLASSIC, body: Callable[[Column], Column] | None = lambda text: text) -> DataFrame:
    """(id, no, token, reference, collection, first_unit, body, cited, stale): passages read from today's index.

    ``entries``: id, passage_ids, cited_ids, index_version. Tokens exist only
    where the numbering was stored. ``body`` says what is kept of a passage's text (a digest, a length, the text
    itself); it is applied once per distinct passage, before rows get it. With None no text is read and the column is left out.
    """
    listed = entries.select(
        "id", "index_version", is_numbered(F.col("passage_ids")).alias("numbered"),
        F.from_json("cited_ids", "array<bigint>").alias("cited_ids"),
        F.posexplode(passage_lists(F.col("passage_ids"), layout)).alias("no", "unit_ids"),
    ).where(F.size("unit_ids") > 0)
    first, last = F.element_at("unit_ids", 1), F.element_at("unit_ids", -1)
    located = listed.select(
        "id", F.col("no").cast("long").alias("no"), "unit_ids", layout.work(first).alias("work_id"),
        F.when(F.col("numbered"), F.concat(F.lit("[P"), (F.col("no") + 1).cast("string"), F.lit("]"))).alias("token"),
        F.arrays_overlap("unit_ids", "cited_ids").alias("cited"), (F.col("index_version") != index_version).alias("stale"),
        first.alias("first_unit"), layout.chapter(first).alias("chapter"), layout.ordinal(first).alias("lo"),
        layout.ordinal(last).alias("hi"),
    )
    named = located.join(works.select("work_id", "abbrev", "collection"), "work_id")
    shown = reference(F.col("abbrev"), F.col("chapter"), F.col("lo"), F.col("hi")).alias("reference")
    if body is None:
        return named.select("id", "no", "token", shown, "collection", "first_unit", "cited", "stale")
    return named.join(passage_bodies(listed, units, body), "unit_ids", "left").select(
        "id", "no", "token", shown, "collection", "first_unit", F.coalesce("body", body(F.lit(""))).alias("body"), "cited", "stale",
    )


def with_markers_resolved(text: Column, refs: Column, resolvable: Column) -> Column:
    """``[P#]`` markers replaced by `` (reference)``; unknown numbers stay, unresolvable entries lose theirs."""
    pattern = r"\s*\[P(\d+)\]"
    pieces = F.split(text, pattern)
    whole = F.regexp_extract_all(text, F.lit(r"(\s*\[P\d+\])"), F.lit(1))
    numbers = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    shown = F.zip_with(
        whole, numbers,
        lambda mark, n: F.when(~resolvable, F.lit("")).otherwise(
            F.coalesce(F.concat(F.lit(" ("), F.get(refs, n.cast("int") - 1), F.lit(")")), mark)
        ),
    )
    return F.array_join(F.zip_with(pieces, shown, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")


def resolve_markers(entries: DataFrame, passages: DataFrame) -> DataFrame:
    """(id, answer): stored answers with their markers written out. ``passages``: id, no, reference."""
    listed = passages.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("no", "reference"))).alias("r"))
    listed = listed.select("id", F.transform("r", lambda r: r["reference"]).alias("refs"))
    joined = entries.select("id", "answer", is_numbered(F.col("passage_ids")).alias("numbered")).join(listed, "id", "left")
    refs = F.coalesce("refs", F.array().cast("array<string>"))
    prepared = joined.select("id", "answer", "numbered", refs.alias("refs"))
    return prepared.select("id", with_markers_resolved(F.col("answer"), F.col("refs"), F.col("numbered")).alias("answer"))


def migrate(entries: DataFrame, version: int) -> DataFrame:
    """Entries brought to the current version; those without stored numbering are dropped."""
    if version > VERSION:
        raise ValueError(f"history version {version} was written by a newer release; this one understands {VERSION}")
    return entries if version == VERSION else entries.where(is_numbered(F.col("passage_ids")))


def mode_label(mode: Column) -> Column:
    return F.when(mode == "both", "both collections").otherwise("primary collection")


def export_questions(entries: DataFrame, passages: DataFrame) -> DataFrame:
    """One row per entry, oldest first."""
    counts = passages.groupBy("id").agg(F.count(F.lit(1)).alias("n_passages"), F.count_if("cited").alias("n_cited"))
    return (
        entries.join(counts, "id", "left").fillna(0, ["n_passages", "n_cited"])
        .select(
            "id", F.date_format("asked_at", STAMP).alias("asked"), "question", mode_label(F.col("mode")).alias("books"),
            "model_id", "index_version", "n_passages", "n_cited",
            F.when(F.col("flagged"), "yes").otherwise("no").alias("note_shown"),
        )
        .orderBy("id")
    )


def export_passages(passages: DataFrame) -> DataFrame:
    """Passages of every entry in reading order; stale entries list references without text."""
    order = W.partitionBy("id").orderBy("first_unit", "no")
    yes = lambda c: F.when(c, "yes").otherwise("no")
    return passages.select(
        "id", (F.row_number().over(order) - 1).cast("long").alias("row_no"), "reference", yes(F.col("cited")).alias("cited"),
        yes(F.col("collection") == "secondary").alias("secondary"), F.when(~F.col("stale"), F.col("body")).alias("body"),
    )
