"""The hybrid search plan: every path, fusion, expansion and ranking in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.keys import CLASSIC, KeyLayout
from quillspan.operators import fusion
from quillspan.operators.keyword import KeywordIndex, bm25_lists, grouped_lists
from quillspan.operators.vector import (
    OVERFETCH, filter_after_cap, flatten_blocks, for_modes, query_batch, vector_topk, with_collection,
)
from quillspan.session import stored

POOL = 100
TOPIC_HITS = 5
ALL_PATHS = fusion.CONFIGURATIONS["F"]


@dataclass(frozen=True)
class SearchIndex:
    """The tables a search reads.

    ``unit_vectors``: key, vec · ``block_vectors``: key (the block's first unit), vec ·
    ``block_members``: block_id, unit_id · ``topic_vectors``: key (topic id), vec ·
    ``topic_units``: topic_id, unit_id · ``keywords``: the stored keyword index ·
    ``edges``: from_id, to_id, anchor, edge_no (``fusion.numbered_edges``) · ``works``: work_id, collection
    """

    unit_vectors: DataFrame
    block_vectors: DataFrame
    block_members: DataFrame
    topic_vectors: DataFrame
    topic_units: DataFrame
    keywords: KeywordIndex
    edges: DataFrame
    works: DataFrame
    layout: KeyLayout = CLASSIC


@dataclass(frozen=True)
class Hits:
    """Mode-independent hits, stored once and shared by every mode and configuration.

    ``terms`` has the best units of every term in each collection, so every mode's lists are among them.
    """

    units: DataFrame
    blocks: DataFrame
    topics: DataFrame
    terms: DataFrame
    query_terms: DataFrame


def find_hits(index: SearchIndex, queries: DataFrame, query_terms: DataFrame, pool: int = POOL) -> Hits:
    """``queries``: query_id, vec. ``query_terms``: query_id, term_no, term."""
    batch = query_batch(queries)
    grouped = lambda rows: with_collection(rows, "unit_id", index.works, index.layout).withColumnRenamed("collection", "group")
    wanted = stored(query_terms.select("query_id", "term_no", "term"), "terms")
    return Hits(
        units=stored(vector_topk(batch, index.unit_vectors, pool * OVERFETCH), "units"),
        blocks=stored(vector_topk(batch, index.block_vectors, pool * OVERFETCH), "blocks"),
        topics=stored(vector_topk(batch, index.topic_vectors, TOPIC_HITS), "topics"),
        terms=grouped_lists(index.keywords, wanted, pool, grouped, 2).withColumnRenamed("group", "collection"),
        query_terms=wanted,
    )


def ranked_lists(index: SearchIndex, hits: Hits, modes: str | tuple[str, ...], pool: int = POOL) -> DataFrame:
    """(query_id, origin, unit_id, pos, weight, listed) of all three ranked paths; several modes add ``mode``."""
    wanted = modes if isinstance(modes, tuple) else (modes,)
    units = filter_after_cap(hits.units, index.works, wanted, pool, index.layout).select(
        "mode", "query_id", F.lit("vector-unit").alias("origin"), F.col("key").alias("unit_id"), "pos",
        F.lit(True).alias("listed"),
    )
    blocks = filter_after_cap(hits.blocks, index.works, wanted, pool, index.layout)
    flat = flatten_blocks(blocks.withColumnRenamed("key", "block_id"), index.block_members, pool).select(
        "mode", "query_id", F.lit("vector-block").alias("origin"), "unit_id", "pos", "listed"
    )
    # the keyword filter sits inside the ranking, before its limit
    readable = for_modes(hits.terms, wanted)
    term_lists = bm25_lists(readable, pool, ["mode"])
    keyword = hits.query_terms.select("query_id", "term").join(term_lists, "term").select(
        "mode", "query_id", F.lit("keyword").alias("origin"), "unit_id", "pos", F.lit(True).alias("listed")
    )
    every = reduce(DataFrame.unionByName, [units, flat, keyword]).withColumn("weight", F.lit(1.0))
    return every if isinstance(modes, tuple) else every.drop("mode")


def search(index: SearchIndex, hits: Hits, modes: str | tuple[str, ...], pool: int = POOL,
           paths: tuple[str, ...] = ALL_PATHS) -> DataFrame:
    """(query_id, pos, unit_id, score, origins): the full ranking.

    Several modes are one plan: the mode is a column, and every path is ranked once.
    """
    wanted = modes if isinstance(modes, tuple) else (modes,)
    lists = ranked_lists(index, hits, wanted, pool).where(F.col("origin").isin(*paths))
    scope = ["mode", "query_id"]
    scores = fusion.fuse(lists, scope)
    if "topic" in paths:
        topics = hits.topics.select("query_id", F.col("key").alias("topic_id"))
        boost = fusion.topic_boost(topics, index.topic_units, index.works, wanted, index.layout)
        scores = fusion.add_boost(scores, boost, "topic", scope)
    if "edge" in paths:
        boost = fusion.edge_boost(scores, index.edges, index.works, None, scope, index.layout)
        scores = fusion.add_boost(scores, boost, "edge", scope)
    ranked = fusion.final_ranking(scores, scope)
    return ranked if isinstance(modes, tuple) else ranked.drop("mode")


def additive_search(index: SearchIndex, hits: Hits, pool: int = POOL) -> DataFrame:
    """Both collections without displacing a single primary result."""
    return fusion.append_secondary(search(index, hits, ("primary", "secondary-only"), pool))


def ablation(index: SearchIndex, hits: Hits, mode: str, pool: int = POOL) -> DataFrame:
    """(config, query_id, pos, unit_id, score, origins) for every configuration in one job."""
    spark = hits.units.sparkSession
    switches = spark.createDataFrame(
        [(name, path) for name, paths in fusion.CONFIGURATIONS.items() for path in paths],
        "config string, origin string",
    )
    scope = ["config", "query_id"]
    lists = ranked_lists(index, hits, mode, pool).join(switches, "origin")
    scores = fusion.fuse(lists, scope)
    topics = hits.topics.select("query_id", F.col("key").alias("topic_id"))
    boost = fusion.topic_boost(topics, index.topic_units, index.works, mode, index.layout)
    using = lambda path: [name for name, paths in fusion.CONFIGURATIONS.items() if path in paths]
    expanding = F.explode(F.array(*[F.lit(c) for c in using("topic")])).alias("config")
    boosted = fusion.add_boost(scores, boost.select("*", expanding), "topic", scope)
    edges = fusion.edge_boost(
        boosted.where(F.col("config").isin(using("edge"))), index.edges, index.works, mode, scope, index.layout
    )
    return fusion.final_ranking(fusion.add_boost(boosted, edges, "edge", scope), scope)


def ablation_passages(index: SearchIndex, hits: Hits, mode: str, rerank: Callable[[DataFrame], DataFrame],
                      pool: int = POOL) -> DataFrame:
    """(config, query_id, rank, passage columns): passages of every configuration, reranked ones included.

    ``rerank`` scores the head of a configuration: passages to (config, query_id, rank, new_score). The passages before it are
    stored: every reranked configuration reads them twice, and the search is not to run again for that.
    """
    scope = ["config", "query_id"]
    found = stored(fusion.islands(ablation(index, hits, mode, pool), scope, layout=index.layout), "passages")
    again = [found.where(F.col("config") == base).withColumn("config", F.lit(name)) for name, base in fusion.RERANKED.items()]
    heads = [fusion.rerank_head(p, rerank(p.where(F.col("rank") < fusion.RERANK_HEAD)), scope) for p in again]
    moved = [h.withColumn("rank", F.col("new_rank")).drop("new_rank").select(*found.columns) for h in heads]
    return reduce(DataFrame.unionByName, [found, *moved])
