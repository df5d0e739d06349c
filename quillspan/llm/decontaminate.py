"""Benchmark decontamination with DataFrame functions only.

Each distinct benchmark window is filed under its rarest-looking word (its longest, ties by hash). The documents are
tokenised once; their words probe that table, and only where a word matches is the window around it cut out and
compared in full, so a hit is exact and no window is built where nothing can match.

The window table is broadcast only while its measured size is within ``broadcast_bytes``; a larger benchmark is
joined by a shuffle on the words, each with the few words around it.

Defined cases: null and empty texts have no words and no hits; benchmark items with fewer words than a window are one
window, those without words none; repeated documents give a row each; windows that several items share count for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import load, once, stored, text_key, whole_rows
from quillspan.plans.registry import Builder

WINDOW = 10
#: Bytes of windows up to which their table is broadcast.
BROADCAST_BYTES = 32 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed value: whatever is not a word character.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, ASCII letters and all non-ASCII characters, A-Z lower-cased."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lowered, _GAP), "")


def windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(item, gram, n, anchor, offset): each window of each item, and the word it is filed under."""
    made = once(items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")), w=words(F.col("text")))
    made = made.where(F.size("w") > 0).select("item", "w", F.least(F.size("w"), F.lit(size)).alias("n"))
    made = made.select("item", "w", "n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("at"))
    made = once(made.select("item", "n", "w", "at"), gram=F.slice("w", F.col("at"), F.col("n"))).drop("w", "at")
    rank = F.array_max(F.transform("gram", lambda x: F.struct(F.length(x).alias("l"), F.xxhash64(x).alias("h"), x.alias("x"))))
    anchor = rank["x"]
    return once(made, anchor=anchor).select(
        "item", "gram", "n", "anchor", (F.array_position("gram", F.col("anchor")) - 1).cast("int").alias("offset")
    )


def scan(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", size: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(id, key, copies, n_words, spans, items): hits of each distinct document.

    ``spans`` lists the distinct (at, n) word ranges in order, ``items`` the distinct items; both are empty without a
    hit. ``copies`` counts the rows that share id and text (``key``).
    """
    filed = stored(windows(items, item_col, item_text, size))
    grams = filed.select("gram", "n", "anchor", "offset").distinct()
    measured = grams.agg(F.sum(2 * F.octet_length(F.array_join("gram", "")) + 32 * F.size("gram") + 64)).first()[0]
    small = (measured or 0) <= broadcast_bytes
    base = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), words(F.col(text_col)).alias("w"))
    # Position 0 stands for the document itself, so that one scan gives both word counts and matches.
    probe = once(base.select("id", "key", "w"), n_words=F.size("w")).select(
        "id", "key", "w", "n_words", F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("at", "word")
    )
    cut = F.slice("w", F.col("at") - F.col("offset"), F.col("n"))
    inside = (F.col("at") > F.col("offset")) & (F.col("at") - F.col("offset") + F.col("n") - 1 <= F.col("n_words"))
    if small:
        joined = probe.join(F.broadcast(grams), F.col("word") == F.col("anchor"), "left")
        met = joined.where((F.col("at") == 0) | (F.col("anchor").isNotNull() & inside)).select(
            "id", "key", "n_words", F.when(F.col("at") > 0, F.col("at") - F.col("offset")).alias("at"), "n",
            F.when(F.col("at") > 0, cut).alias("cut"), "gram",
        ).where("at is null or cut = gram").select("id", "key", "n_words", "at", "n", "gram")
    else:
        rows = probe.where("at = 0").select("id", "key", "n_words", F.lit(None).cast("int").alias("at"),
                                            F.lit(None).cast("int").alias("n"),
                                            F.lit(None).cast("array<string>").alias("gram"))
        # Bounded slices around each word go through the shuffle, never whole documents.
        near = probe.where("at > 0").select(
            "id", "key", "n_words", "at", "word", F.greatest(F.lit(1), F.col("at") - size + 1).alias("from"),
            F.slice("w", F.greatest(F.lit(1), F.col("at") - size + 1), F.lit(2 * size - 1)).alias("near"),
        )
        start = F.col("at") - F.col("offset")
        met = near.join(grams, F.col("word") == F.col("anchor")).where(
            inside & (F.slice("near", start - F.col("from") + 1, F.col("n")) == F.col("gram"))
        ).select("id", "key", "n_words", start.alias("at"), "n", "gram").unionByName(rows)
    hits = met.groupBy("id", "key", "at", "n", "gram").agg(F.max("n_words").alias("n_words"), F.count("*").alias("rows"))
    hits = stored(hits)
    wholes = hits.where("at is null").select("id", "key", "n_words", F.col("rows").alias("copies"))
    spans = hits.where("at is not null").select("id", "key", "at", "n").distinct().groupBy("id", "key").agg(
        F.sort_array(F.collect_list(F.struct("at", "n"))).alias("spans"))
    of = hits.where("at is not null").select("id", "key", "gram").distinct().join(
        filed.select("gram", "item").distinct(), "gram").select("id", "key", "item").distinct()
    named = of.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.col("item").cast("string"))).alias("items"))
    found = spans.join(named, [spans["id"].eqNullSafe(named["id"]), spans["key"] == named["key"]]).select(
        spans["id"], spans["key"], "spans", "items")
    return wholes.join(found, [wholes["id"].eqNullSafe(found["id"]), wholes["key"] == found["key"]], "left").select(
        wholes["id"], wholes["key"], "copies", "n_words",
        F.coalesce("spans", F.array().cast("array<struct<at:int,n:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def covered(spans: Column) -> Column:
    """Words inside the union of spans that are sorted by start."""
    step = F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(s["end"], x["at"].cast("long")))).alias("n"),
            F.greatest(s["end"], (x["at"] + x["n"]).cast("long")).alias("end"),
        ),
    )
    return step["n"]


def _with_spans(docs: DataFrame, items: DataFrame, size: int, how: str) -> DataFrame:
    bad = scan(docs, items, size=size).where(F.size("spans") > 0).select(
        F.col("id").alias("_id"), F.col("key").alias("_of"), F.col("spans").alias("_spans"))
    keyed = docs.withColumn("_key", text_key())
    return keyed.join(bad, keyed["doc_id"].eqNullSafe(bad["_id"]) & (keyed["_key"] == bad["_of"]), how)


@whole_rows("doc_id", "text")
def clean_documents(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Documents without any hit, columns unchanged."""
    return _with_spans(docs, items, size, "left_anti").select(*docs.columns)


@whole_rows("doc_id", "text", edits=("text",))
def cut_spans(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Documents with the words of every hit (and the gaps between those words) taken out of the text."""
    met = _with_spans(docs, items, size, "left")
    # Before lower-casing, A-Z are letters too.
    letter, gap = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    met = once(met, _piece=F.regexp_extract_all("text", F.lit(f"({letter}+|{gap}+)"), F.lit(1)))
    is_word = F.transform("_piece", lambda x: x.rlike(f"^{letter}"))
    met = once(met, _first=F.when(F.size("_piece") > 0, F.when(F.get(is_word, F.lit(0)), 1).otherwise(0)).otherwise(1))
    # Pieces alternate, so a piece's word number follows from its place; a gap belongs to the word before it.
    number = lambda i: F.floor((i + F.col("_first") + 1) / 2)
    kept = F.filter("_piece", lambda x, i: ~F.exists(
        "_spans", lambda s: (number(i) >= s["at"]) & (number(i) < s["at"] + s["n"])))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    return met.withColumn("text", text).select(*docs.columns)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, hit words, items met, and whether it is contaminated."""
    found = scan(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    found = found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
    hit = covered(F.col("spans"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(len(w), 10) - 1) AS gram, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM g),
p AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS gram
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d CROSS JOIN sizes
        WHERE len(w) >= n)),
h AS (SELECT DISTINCT p.doc_id, p.i, p.n, g.item_id FROM p JOIN g ON p.n = g.n AND p.gram = g.gram),
hit AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS word FROM h) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES: dict[str, Builder] = {"op4_benchmark_decontamination": op4_benchmark_decontamination}
SQL: dict[str, str] = {"op4_benchmark_decontamination": OP4_SQL}
