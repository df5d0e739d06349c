"""Rank fusion, expansions, final ranking and passage grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.keys import CLASSIC, KeyLayout
from quillspan.operators.vector import for_modes, in_mode, rank_within, with_collection

# Fusion constants and expansion caps.
RRF_K = 60
TOPIC_CAP = 60
TOPIC_WEIGHT = 0.5
TOPIC_MAX = 3
EDGE_ANCHORS = 25
EDGE_SCAN_CAP = 800
EDGE_CAP = 200
EDGE_WEIGHT = 0.25
EDGE_MAX = 4
TOP_N = 25
EXTRA_N = 8
RERANK_HEAD = 60
SCORE_DIGITS = 6
EXTRA_DIGITS = 9
TIE_DIGITS = 12

# Which retrieval paths each ablation configuration switches on.
CONFIGURATIONS = {
    "A": ("vector-unit",),
    "B": ("vector-block",),
    "C": ("vector-unit", "vector-block"),
    "D": ("keyword",),
    "E": ("vector-unit", "vector-block", "keyword"),
    "F": ("vector-unit", "vector-block", "keyword", "topic", "edge"),
}
# Fixed value: configurations that rerank the head of another one's passages.
RERANKED = {"G": "F"}


def stable(score: Column) -> Column:
    """Scores are compared after rounding, so summation order cannot flip a rank."""
    return F.round(score, TIE_DIGITS)


def fuse(lists: DataFrame, scope: list[str]) -> DataFrame:
    """Weighted reciprocal rank fusion.

    ``lists``: scope columns, origin, unit_id, pos (0-based), weight, listed.
    Rows not ``listed`` only tag their origin.
    """
    part = F.when(F.col("listed"), F.col("weight") / (RRF_K + F.col("pos") + 1)).otherwise(F.lit(0.0))
    return lists.groupBy(*scope, "unit_id").agg(
        stable(F.sum(part)).alias("score"), F.collect_set("origin").alias("origins"),
        F.max("listed").alias("listed"),
    )


def topic_boost(topic_hits: DataFrame, topic_units: DataFrame, works: DataFrame, modes: str | tuple[str, ...],
                layout: KeyLayout = CLASSIC) -> DataFrame:
    """(query_id, unit_id, boost): the first members of every matched topic; with several modes a ``mode`` column too.

    The member cap comes first and the collection filter after it. The cap is taken per topic once, not per query, and
    only for topics that some query has met.
    """
    met = topic_hits.select("topic_id").distinct()
    known = topic_units.select("topic_id", "unit_id").join(met, "topic_id", "left_semi")
    capped = rank_within(known, ["topic_id"], [F.asc("unit_id")], TOPIC_CAP)
    several = isinstance(modes, tuple)
    members = for_modes(
        with_collection(capped.select("topic_id", "unit_id"), "unit_id", works, layout), modes if several else (modes,))
    scope = ["mode", "query_id"] if several else ["query_id"]
    counted = topic_hits.select("query_id", "topic_id").join(members, "topic_id").groupBy(*scope, "unit_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    step = TOPIC_WEIGHT / (RRF_K + 1)
    return counted.select(*scope, "unit_id", (F.least("n", F.lit(TOPIC_MAX)) * step).alias("boost"))


def numbered_edges(edges: DataFrame) -> DataFrame:
    """(from_id, to_id, anchor, edge_no): each source's edges in (to, anchor) order, from 0."""
    return rank_within(
        edges.select("from_id", "to_id", "anchor"), ["from_id"],
        [F.asc("to_id"), F.asc_nulls_first("anchor")], name="edge_no",
    )


def scanned_edges(anchors: DataFrame, edges: DataFrame, scope: list[str], cap: int = EDGE_SCAN_CAP) -> DataFrame:
    """(scope, to_id): the first ``cap`` edges of a scope's anchors in (from, to, anchor) order.

    ``anchors``: scope, from_id. ``edges`` come numbered within their source. The counts of the sources say where the cap
    falls before any edge is met, so a scope meets the edges it reads and no others, however many its anchors have.
    """
    counts = edges.groupBy("from_id").agg(F.count(F.lit(1)).alias("n_edges"))
    earlier = W.partitionBy(*scope).orderBy("from_id").rowsBetween(W.unboundedPreceding, -1)
    open_to = F.lit(cap) - F.coalesce(F.sum("n_edges").over(earlier), F.lit(0))
    read = anchors.join(counts, "from_id").withColumn("open_to", open_to).where("open_to > 0").drop("n_edges")
    near = edges.where(F.col("edge_no") < cap).select("from_id", "to_id", "edge_no")
    return read.join(near, "from_id").where(F.col("edge_no") < F.col("open_to")).select(*scope, "to_id")


def edge_boost(scores: DataFrame, edges: DataFrame, works: DataFrame, mode: str | None,
               scope: list[str], layout: KeyLayout = CLASSIC) -> DataFrame:
    """(scope, unit_id, boost): neighbours of the best units so far.

    Anchors are the best ``EDGE_ANCHORS`` by (score desc, unit asc). Their edges
    are read in (from, to, anchor) order up to a cap, filtered by collection,
    counted per target (parallel edges count), and the most frequent targets
    kept. ``edges`` that are not numbered yet are numbered for anchors only. Without ``mode`` the scope's ``mode`` column counts.
    """
    anchors = rank_within(scores, scope, [F.desc("score"), F.asc("unit_id")], EDGE_ANCHORS).select(
        *scope, F.col("unit_id").alias("from_id"))
    if "edge_no" not in edges.columns:
        edges = numbered_edges(edges.join(anchors.select("from_id").distinct(), "from_id", "left_semi"))
    scanned = scanned_edges(anchors, edges, scope)
    counted = (
        with_collection(scanned.withColumnRenamed("to_id", "unit_id"), "unit_id", works, layout)
        .where(in_mode(F.col("collection"), F.col("mode") if mode is None else mode))
        .groupBy(*scope, "unit_id").agg(F.count(F.lit(1)).alias("n"))
    )
    kept = rank_within(counted, scope, [F.desc("n"), F.asc("unit_id")], EDGE_CAP)
    step = EDGE_WEIGHT / (RRF_K + 1)
    return kept.select(*scope, "unit_id", (F.least("n", F.lit(EDGE_MAX)) * step).alias("boost"))


def add_boost(scores: DataFrame, boost: DataFrame, origin: str, scope: list[str]) -> DataFrame:
    """Add a boost; it may bring in units the ranked lists never held."""
    both = scores.select(*scope, "unit_id", "score", "origins").unionByName(
        boost.select(*scope, "unit_id", F.col("boost").alias("score"), F.array(F.lit(origin)).alias("origins"))
    )
    return both.groupBy(*scope, "unit_id").agg(
        stable(F.sum("score")).alias("score"),
        F.array_distinct(F.flatten(F.collect_list("origins"))).alias("origins"),
    )


def final_ranking(scores: DataFrame, scope: list[str]) -> DataFrame:
    """Position by (score desc, unit asc); scores are rounded after the sort."""
    ranked = rank_within(scores, scope, [F.desc("score"), F.asc("unit_id")])
    return ranked.select(
        *scope, "pos", "unit_id", F.bround("score", SCORE_DIGITS).alias("score"),
        F.array_sort("origins").alias("origins"),
    )


def append_secondary(ranked: DataFrame) -> DataFrame:
    """The primary ranking unchanged, then the best secondary units below its tail.

    ``ranked``: mode (``primary`` and ``secondary-only``), query_id, pos, unit_id, score, origins, so that both come out
    of one plan. ``cut`` marks rows of the generation cut: the primary top plus every appended row.
    """
    per_query = W.partitionBy("query_id")
    primary = F.col("mode") == "primary"
    placed = ranked.where(primary | (F.col("pos") < EXTRA_N)).select(
        "*", F.min(F.when(primary, F.col("score"))).over(per_query).alias("tail_score"),
        F.count_if(primary).over(per_query).alias("tail_pos"))
    below = F.bround(F.coalesce("tail_score", F.lit(0.0)) - (F.col("pos") + 1) * 1e-6, EXTRA_DIGITS)
    return placed.select(
        "query_id", F.when(primary, F.col("pos")).otherwise(F.col("tail_pos") + F.col("pos")).alias("pos"), "unit_id",
        F.when(primary, F.col("score")).otherwise(below).alias("score"), "origins",
        F.when(primary, "primary").otherwise("secondary").alias("collection"),
        (~primary | (F.col("pos") < TOP_N)).alias("cut"),
    )


def islands(ranked: DataFrame, scope: list[str], gap: int = 1, layout: KeyLayout = CLASSIC) -> DataFrame:
    """Group neighbouring units of one chapter into passages.

    The window is keyed by (scope, work, chapter), so its size is bounded by a
    chapter, and passages come out ordered by best score, then reading order.
    """
    key = F.col("unit_id")
    located = ranked.select(
        *scope, "unit_id", "score", "origins",
        layout.work(key).alias("work_id"), layout.chapter(key).alias("chapter"), layout.ordinal(key).alias("ordinal"),
    )
    place = W.partitionBy(*scope, "work_id", "chapter").orderBy("ordinal")
    opened = located.withColumn(
        "opens", F.when(F.col("ordinal") - F.lag("ordinal").over(place) <= gap, F.lit(0)).otherwise(F.lit(1))
    )
    numbered = opened.withColumn("island", F.sum("opens").over(place.rowsBetween(W.unboundedPreceding, W.currentRow)))
    grouped = numbered.groupBy(*scope, "work_id", "chapter", "island").agg(
        F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.max("score").alias("score"),
        F.sort_array(F.collect_list("unit_id")).alias("unit_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("origins")))).alias("origins"),
    )
    return rank_within(
        grouped.drop("island").withColumn("first_unit", F.element_at("unit_ids", 1)),
        scope, [F.desc("score"), F.asc("first_unit")], name="rank",
    )


def top_cut(passages: DataFrame, scope: list[str], mode: str, top: int = TOP_N, extra: int = EXTRA_N) -> DataFrame:
    """First passages for generation; in ``both`` mode each collection is cut by itself.

    ``passages``: scope, rank, collection, …; the cut keeps primary before secondary.
    """
    if mode != "both":
        cut = passages.where(F.col("rank") < top)
        return cut.withColumn("cut_pos", F.col("rank"))
    ranked = rank_within(passages, [*scope, "collection"], [F.asc("rank")], max(top, extra), "in_collection")
    kept = ranked.where(
        F.when(F.col("collection") == "secondary", F.col("in_collection") < extra).otherwise(F.col("in_collection") < top)
    )
    return rank_within(
        kept, scope, [F.asc("collection"), F.asc("rank")], name="cut_pos"
    ).drop("in_collection")


def rerank_head(passages: DataFrame, new_scores: DataFrame, scope: list[str], head: int = RERANK_HEAD) -> DataFrame:
    """Re-order the first ``head`` passages by outside scores; the tail keeps its order.

    ``new_scores``: scope, rank, new_score.
    """
    joined = passages.join(new_scores, [*scope, "rank"], "left")
    in_head = F.col("rank") < head
    scored = joined.withColumn(
        "score", F.when(in_head, F.coalesce("new_score", "score")).otherwise(F.col("score"))
    ).withColumn("_tail", F.when(in_head, 0).otherwise(1))
    head_order = F.when(F.col("_tail") == 0, -F.col("score"))
    return rank_within(
        scored, scope, [F.asc("_tail"), F.asc_nulls_first(head_order), F.asc("rank")], name="new_rank"
    ).drop("_tail", "new_score")
