"""Relations a reader sees: topic groups, work groups, chapters, packed passages, answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.keys import CLASSIC, KeyLayout
from quillspan.functions.text import short_label
from quillspan.operators.ordering import neighbours
from quillspan.operators.packing import greedy_runs
from quillspan.operators.vector import rank_within
from quillspan.operators.verify import cited_tokens

MAX_HOPS = 16
OTHER = "Other passages"
PASSAGE_OVERHEAD = 16

# Fixed value: the footer of an answer that cites the secondary collection.
SECONDARY_FOOTER = (
    "This answer includes passages from the Deuterocanon, which some traditions include and others do not. "
    "Each is labelled."
)
SECONDARY_MARK = " (Deuterocanon)"


def topic_roots(topics: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """(topic_id, root_id, root_heading): the topmost ancestor within ``hops`` steps.

    Each round joins every topic's current ancestor with *that* ancestor's own,
    doubling the distance, so the walk takes log2(hops) joins instead of one per
    level, and a cycle ends by itself. ``topics``: topic_id, parent_id, heading.
    """
    parent = F.when(F.col("parent_id").isNull(), F.col("topic_id")).otherwise(F.col("parent_id"))
    known = topics.select("topic_id", "heading")
    up = topics.select("topic_id", parent.alias("up"))
    steps = 1
    while steps < hops:
        above = up.select(F.col("topic_id").alias("up"), F.col("up").alias("next"))
        up = up.join(above, "up", "left").select("topic_id", F.coalesce("next", "up").alias("up"))
        steps *= 2
    named = known.select(F.col("topic_id").alias("root_id"), F.col("heading").alias("root_heading"))
    return up.withColumnRenamed("up", "root_id").join(named, "root_id", "left").select("topic_id", "root_id", "root_heading")


def topic_passages(hits: DataFrame, passages: DataFrame, members: DataFrame) -> DataFrame:
    """(query_id, topic_id, topic_rank, rank, first_unit, reference): passages holding a topic's unit.

    ``hits``: query_id, topic_id, pos. ``passages``: query_id, rank, unit_ids,
    first_unit, reference. Only units the passages hold are looked up.
    """
    units = passages.select("query_id", "rank", "first_unit", "reference", F.explode("unit_ids").alias("unit_id"))
    matched = units.join(members.select("topic_id", "unit_id"), "unit_id").join(
        hits.select("query_id", "topic_id", F.col("pos").alias("topic_rank")), ["query_id", "topic_id"]
    )
    return matched.select("query_id", "topic_id", "topic_rank", "rank", "first_unit", "reference").distinct()


def _ordered_refs(order: str, value: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda r: r[value])


def matched_topics(hits: DataFrame, held: DataFrame, topics: DataFrame, members: DataFrame) -> DataFrame:
    """(query_id, pos, topic_id, heading, heading_display, size, score, references[])."""
    sizes = members.groupBy("topic_id").agg(F.count(F.lit(1)).alias("size"))
    refs = held.groupBy("query_id", "topic_id").agg(_ordered_refs("first_unit", "reference").alias("references"))
    return (
        hits.join(topics.select("topic_id", "heading"), "topic_id").join(sizes, "topic_id", "left")
        .join(refs, ["query_id", "topic_id"], "left")
        .select(
            "query_id", "pos", "topic_id", "heading", short_label(F.col("heading")).alias("heading_display"),
            F.coalesce("size", F.lit(0)).alias("size"), F.bround("score", 4).alias("score"),
            F.coalesce("references", F.array().cast("array<string>")).alias("references"),
        )
    )


def topic_groups(held: DataFrame, passages: DataFrame, topics: DataFrame, roots: DataFrame) -> DataFrame:
    """(query_id, group_no, root_id, heading, sub_label, references[]).

    Every passage goes to its strongest matching topic alone. Topics under one
    root merge in order of appearance; a sub-label already contained in the
    group's label is not repeated. Unclaimed passages end under one last group.
    """
    claimed = held.groupBy("query_id", "rank", "first_unit", "reference").agg(
        F.min_by("topic_id", "topic_rank").alias("topic_id"), F.min("topic_rank").alias("topic_rank")
    )
    labelled = claimed.join(roots, "topic_id").join(topics.select("topic_id", "heading"), "topic_id")
    sub = F.when(F.col("root_id") == F.col("topic_id"), F.lit("")).otherwise(short_label(F.col("heading")))
    by_topic = labelled.withColumn("sub", sub).groupBy("query_id", "root_id", "root_heading", "topic_rank", "sub").agg(
        F.array_sort(F.collect_list(F.struct("first_unit", "reference"))).alias("refs")
    )
    by_root = by_topic.groupBy("query_id", "root_id", "root_heading").agg(
        F.array_sort(F.collect_list(F.struct("topic_rank", "sub", "refs"))).alias("parts"),
        F.min("topic_rank").alias("first_rank"),
    )
    label = F.aggregate(
        "parts", F.lit(""),
        lambda text, p: F.when(text.contains(p["sub"]), text).when(text == "", p["sub"]).otherwise(
            F.concat(text, F.lit("; "), p["sub"])
        ),
    )
    refs = F.transform(F.flatten(F.transform("parts", lambda p: p["refs"])), lambda r: r["reference"])
    groups = by_root.select(
        "query_id", "first_rank", "root_id", F.col("root_heading").alias("heading"), label.alias("sub_label"),
        refs.alias("references"),
    )
    rest = passages.select("query_id", "rank", "first_unit", "reference").join(
        claimed.select("query_id", "rank"), ["query_id", "rank"], "left_anti"
    )
    other = rest.groupBy("query_id").agg(_ordered_refs("first_unit", "reference").alias("references")).select(
        "query_id", F.lit(2**31).cast("long").alias("first_rank"), F.lit(None).cast("long").alias("root_id"),
        F.lit(OTHER).alias("heading"), F.lit("").alias("sub_label"), "references",
    )
    return rank_within(
        groups.withColumn("first_rank", F.col("first_rank").cast("long")).unionByName(other),
        ["query_id"], [F.asc("first_rank")], name="group_no",
    ).drop("first_rank")


def work_groups(passages: DataFrame) -> DataFrame:
    """(query_id, work_id, n_passages, n_cited, references[]) in reading order. ``passages`` carry ``cited``."""
    return passages.groupBy("query_id", "work_id").agg(
        F.count(F.lit(1)).alias("n_passages"), F.count_if("cited").alias("n_cited"),
        _ordered_refs("first_unit", "reference").alias("references"),
    )


def chapter_navigation(units: DataFrame, works: DataFrame, mode: str, layout: KeyLayout = CLASSIC,
                       range_width: int = 65_536) -> DataFrame:
    """(work_id, chapter, n_units, collection, previous, following): neighbours in reading order.

    Chapter numbers step inside a work; stepping out of it goes to the next
    readable work, and out of an unreadable work nowhere. ``previous`` and
    ``following`` are packed (work, chapter) keys. Works are ordered in key
    ranges, so the number of chapters never meets in one task.
    """
    chapters = units.groupBy("work_id", "chapter").agg(F.count(F.lit(1)).alias("n_units"))
    ends = chapters.groupBy("work_id").agg(F.max("chapter").alias("last"))
    readable = works.where(F.lit(mode == "both") | (F.col("collection") == "primary")).join(ends, "work_id", "left_semi")
    linked = neighbours(readable.select("work_id"), "work_id", "prev_work", "next_work", range_width)
    tail = ends.select(F.col("work_id").alias("prev_work"), F.col("last").alias("prev_last"))
    linked = linked.join(tail, "prev_work", "left")
    place = lambda work, chapter: work * layout.chapter_radix + chapter
    chapter, work = F.col("chapter"), F.col("work_id")
    joined = chapters.join(ends, "work_id").join(works.select("work_id", "collection"), "work_id").join(linked, "work_id", "left")
    return joined.select(
        "work_id", "chapter", "n_units", "collection",
        F.when(chapter > 1, place(work, chapter - 1)).otherwise(place(F.col("prev_work"), F.col("prev_last"))).alias("previous"),
        F.when(chapter < F.col("last"), place(work, chapter + 1)).otherwise(place(F.col("next_work"), F.lit(1))).alias("following"),
    )


def passage_texts(passages: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, body): unit texts of a passage joined by blanks, in reading order."""
    rows = passages.select(*keys, F.explode("unit_ids").alias("unit_id")).join(units.select("unit_id", "text"), "unit_id")
    parts = F.array_sort(F.collect_list(F.struct("unit_id", "text")))
    return rows.groupBy(*keys).agg(parts.alias("p")).select(
        *keys, F.array_join(F.transform("p", lambda u: u["text"]), " ").alias("body")
    )


def passage_sizes(passages: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_chars): characters of ``passage_texts``, from the lengths of the units; no text meets a passage."""
    lengths = units.select("unit_id", F.length("text").cast("long").alias("n"))
    rows = passages.select(*keys, F.explode("unit_ids").alias("unit_id")).join(lengths, "unit_id")
    return rows.groupBy(*keys).agg(F.coalesce(F.sum(F.col("n") + 1) - 1, F.lit(0)).alias("n_chars"))


def pack_passages(cut: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_sent, prompt): numbered passages as the writer is given them.

    ``cut``: keys, cut_pos, reference, collection, unit_ids.
    """
    joined = cut.join(passage_texts(cut, units, [*keys, "cut_pos"]), [*keys, "cut_pos"], "left")
    mark = F.when(F.col("collection") == "secondary", SECONDARY_MARK).otherwise("")
    block = F.concat(
        F.lit("[P"), (F.col("cut_pos") + 1).cast("string"), F.lit("] "), "reference", mark, F.lit("\n"),
        F.coalesce("body", F.lit("")),
    )
    packed = joined.select(*keys, "cut_pos", block.alias("block")).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("cut_pos", "block"))).alias("b")
    )
    return packed.select(
        *keys, F.size("b").cast("long").alias("n_sent"),
        F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("prompt"),
    )


def batch_packing(sized: DataFrame, keys: list[str], order: list[str], budget: int,
                  token_count: Callable[[Column], Column] | None = None) -> DataFrame:
    """(keys, order, batch_no, size): consecutive items in batches that stay within the budget.

    ``sized`` carries ``size``, or a ``text`` that ``token_count`` measures. An oversize item is a batch by itself. Groups
    may be of any size.
    """
    measured = sized if token_count is None else sized.withColumn("size", token_count(F.col("text")))
    items = measured.select(*keys, *order, F.col("size").cast("long").alias("size"))
    packed = greedy_runs(items, keys, order, budget, F.col("size"), name="batch_no")
    return packed.select(*keys, *order, "batch_no", "size")


def assemble_answers(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """One nested answer per query.

    ``texts``: query_id, synopsis (NULL when the fallback is shown), fallback.
    ``passages``: query_id, rank, reference, unit_ids, collection, score, origins,
    token (NULL when not sent).
    """
    cited = texts.select(
        "query_id", "synopsis", "fallback", F.coalesce(cited_tokens(F.col("synopsis")), F.array().cast("array<string>")).alias("cited")
    )
    marked = passages.join(cited.select("query_id", "cited"), "query_id").withColumn(
        "is_cited", F.coalesce(F.array_contains("cited", F.col("token")), F.lit(False))
    )
    nested = marked.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "rank", "reference", "unit_ids", "score", "origins", "collection", "token",
            F.col("token").isNotNull().alias("sent"), F.col("is_cited").alias("cited"),
        ))).alias("passages"),
        F.count("token").alias("sent_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("is_cited"), F.col("unit_ids")))))).alias("cited_unit_ids"),
        F.max(F.col("is_cited") & (F.col("collection") == "secondary")).alias("secondary_cited"),
    )
    joined = cited.join(nested, "query_id", "left")
    return joined.select(
        "query_id", F.col("synopsis").isNull().alias("fallback_used"), "synopsis",
        F.when(F.col("synopsis").isNull(), F.col("fallback")).alias("fallback_text"), F.col("cited").alias("cited_tokens"),
        F.coalesce("cited_unit_ids", F.array().cast("array<bigint>")).alias("cited_unit_ids"),
        F.coalesce("sent_count", F.lit(0)).alias("sent_count"),
        F.coalesce("secondary_cited", F.lit(False)).alias("secondary_cited"),
        F.when(F.col("secondary_cited"), SECONDARY_FOOTER).alias("footer"), "passages",
    )
