"""Integrity rules and profiles of an index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators.intervals import points_outside_intervals


def dead_references(rules: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(rule, violations): rows whose key has no match. Each rule: rows, key, targets, target key."""

    def count(rule: str) -> DataFrame:
        rows, key, targets, target = rules[rule]
        dead = rows.select(F.col(key).alias("_key")).join(targets.select(F.col(target).alias("_key")), "_key", "left_anti")
        return dead.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")

    return reduce(DataFrame.unionByName, [count(rule) for rule in rules])


def count_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) for row rules, all of them in one pass over ``df``."""
    names = list(rules)
    counts = df.agg(*[F.count_if(~rules[n]).alias(f"r{i}") for i, n in enumerate(names)])
    pairs = ", ".join(f"'{n}', r{i}" for i, n in enumerate(names))
    return counts.selectExpr(f"stack({len(names)}, {pairs}) AS (rule, violations)")


def outside_parent(parts: DataFrame, wholes: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """(rule, violations): parts that do not lie inside the whole of their keys, or have none.

    ``parts`` and ``wholes``: keys, start_id, end_id. The keys keep the interval check a hash join.
    """
    bounds = wholes.select(*keys, F.col("start_id").alias("_low"), F.col("end_id").alias("_high"))
    inside = (F.col("start_id") >= F.col("_low")) & (F.col("end_id") <= F.col("_high"))
    return _counted(parts.join(bounds, keys, "left").where(~F.coalesce(inside, F.lit(False))), rule)


def outside_all(units: DataFrame, wholes: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """(rule, violations): units that no whole of their keys holds. ``wholes``: keys, start_id, end_id."""
    return _counted(points_outside_intervals(units, wholes, keys, "unit_id", "start_id", "end_id"), rule)


def not_from_zero(parts: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """(rule, violations): wholes whose part numbers are not 0, 1, 2 … without a gap."""
    spans = parts.groupBy(*keys).agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count_distinct("part").alias("n"))
    return _counted(spans.where((F.col("low") != 0) | (F.col("high") != F.col("n") - 1)), rule)


def _counted(rows: DataFrame, rule: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def _line(df: DataFrame, section: str, key, value: Column | None = None) -> DataFrame:
    """(section, key, n): one count, or a count per value of a key column."""
    count = F.count(F.lit(1)) if value is None else value
    if isinstance(key, Column):
        return df.groupBy(key.alias("key")).agg(count.alias("n")).select(F.lit(section).alias("section"), "key", "n")
    return df.agg(count.alias("n")).select(F.lit(section).alias("section"), F.lit(key).alias("key"), "n")


def index_profile(works: DataFrame, units: DataFrame, blocks: DataFrame, edges: DataFrame, topics: DataFrame,
                  topic_units: DataFrame, quarantine: DataFrame, spots: list[tuple[str, int, int]]) -> DataFrame:
    """(section, key, n): what an index holds.

    ``works``: work_id, code, collection, era · ``units``: work_id, chapter, ordinal, ordinal_end (of a bridge) ·
    ``blocks``: work_id, source, heading · ``edges``: from_id, to_id · ``topics``: topic_id, parent_id ·
    ``topic_units``: topic_id, unit_id · ``quarantine``: reason · ``spots``: (code, chapter, ordinal) to look up; their
    line says how many units stand there, 0 where one is missing.
    """
    named = works.select("work_id", "code", "collection", "era")
    label = lambda c: F.coalesce(F.col(c), F.lit("all"))
    pair = lambda df: df.groupingSets([["collection", "era"], ["collection"], []], "collection", "era")
    sets = lambda df, section, n: pair(df).agg(n.alias("n")).select(
        F.lit(section).alias("section"), F.concat(label("collection"), F.lit("/"), label("era")).alias("key"), "n")
    chapters = units.groupBy("work_id", "chapter").agg(
        F.count(F.lit(1)).alias("units"), F.count("ordinal_end").alias("bridges"))
    located = chapters.join(named, "work_id")
    wanted = works.sparkSession.createDataFrame(spots, "code string, chapter long, ordinal long")
    met = units.join(named.select("work_id", "code"), "work_id").select("code", "chapter", "ordinal").join(
        wanted, ["code", "chapter", "ordinal"], "left_semi").groupBy("code", "chapter", "ordinal").agg(F.count(F.lit(1)).alias("n"))
    place = F.concat("code", F.lit(" "), F.col("chapter").cast("string"), F.lit(":"), F.col("ordinal").cast("string"))
    spot = wanted.join(met, ["code", "chapter", "ordinal"], "left").select(
        F.lit("spots").alias("section"), place.alias("key"), F.coalesce("n", F.lit(0)).alias("n"))
    heading = F.when(F.col("heading").isNull(), "without heading").otherwise("with heading")
    level = F.when(F.col("parent_id").isNull(), "root").otherwise("leaf")
    distinct = lambda df, c: df.select(c).where(F.col(c).isNotNull()).distinct()
    return reduce(DataFrame.unionByName, [
        sets(named, "works", F.count(F.lit(1))), sets(located, "chapters", F.count(F.lit(1))),
        sets(located, "units", F.sum("units")), sets(located, "bridges", F.sum("bridges")),
        _line(blocks, "blocks", F.col("source")), _line(blocks, "blocks", heading),
        _line(distinct(blocks.where("heading IS NOT NULL"), "work_id"), "blocks", "works with heading"),
        _line(edges, "edges", "all"), _line(distinct(edges, "from_id"), "edges", "sources"),
        _line(distinct(edges, "to_id"), "edges", "targets"), _line(topics, "topics", level),
        _line(topic_units, "topics", "members"), _line(distinct(topic_units, "unit_id"), "topics", "member units"),
        _line(distinct(topic_units, "topic_id"), "topics", "with members"),
        _line(quarantine, "unresolved", "all"), _line(quarantine, "unresolved", F.col("reason")), spot,
    ])


def content_works(works: DataFrame, dropped: list[str], collections: list[str], eras: list[str]) -> DataFrame:
    """Works without the non-content ones (by code), with ``known``: whether collection and era are listed values."""
    known = F.col("collection").isin(collections) & F.col("era").isin(eras)
    return works.where(~F.col("code").isin(dropped)).withColumn("known", F.coalesce(known, F.lit(False)))
