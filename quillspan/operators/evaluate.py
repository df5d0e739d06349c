"""Measuring retrieval and answers: gold drafting, recall, precision, runs, gates, parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.keys import CLASSIC, KeyLayout
from quillspan.operators.fusion import stable
from quillspan.operators.ordering import order_statistics, sequential_ids
from quillspan.operators.packing import greedy_runs
from quillspan.operators.vector import rank_within

CUTS = (10, 25, 50)

# Gold drafting weights, limits and selection sizes.
TOPIC_WEIGHT = 3.0
TOPIC_SCALE = 200.0
KEYWORD_WEIGHT = 4.0
KEYWORD_DECAY = 5.0
KEYWORD_LIMIT = 60
HOP_WEIGHT = 0.5
HOP_MAX = 4
HOP_ANCHORS = 25
RANGE_GAP = 2
RANGE_LENGTH = 12
MUST_MAX = 8
SHOULD_MAX = 12


# --- retrieval quality -------------------------------------------------------------

def gold_ranks(gold: DataFrame, ranked: DataFrame, scope: list[str], query: str = "query_id") -> DataFrame:
    """(gold columns, scope, rank): the first passage, counted from 1, that shares a unit with each gold passage, else NULL.

    ``gold``: query, passage_id, unit_id. ``ranked``: scope (query included),
    rank, unit_ids. Both sides meet unit by unit in a hash join.
    """
    units = ranked.select(*scope, "rank", F.explode("unit_ids").alias("unit_id"))
    firsts = gold.join(units, [query, "unit_id"]).groupBy(*scope, "passage_id").agg((F.min("rank") + 1).alias("rank"))
    wanted = gold.select(query, "passage_id").distinct()
    others = [c for c in scope if c != query]
    if others:
        wanted = wanted.join(ranked.select(*scope).distinct(), query)
    return wanted.join(firsts, [*scope, "passage_id"], "left")


def recall_at(ranks: DataFrame, queries: DataFrame, scope: list[str], cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """(scope, k, recall, recall_or_null): share of gold passages found in the first k.

    Without gold the one reads 0.0 and the other NULL; both conventions are used.
    """
    hits = ranks.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("rank") <= k).alias(f"at{k}") for k in cuts]
    )
    every = queries.select(*scope).join(hits, scope, "left")
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), (F.col(f"at{k}") / F.col("n")).alias("share")) for k in cuts])
    return every.select(*scope, F.inline(rows)).select(
        *scope, "k", F.bround(F.coalesce("share", F.lit(0.0)), 6).alias("recall"), F.bround("share", 6).alias("recall_or_null")
    )


def citation_precision(cited: DataFrame, sent_units: DataFrame, gold_units: DataFrame, scope: list[str],
                       answers: DataFrame) -> DataFrame:
    """(scope, precision): cited tokens that touch gold / cited tokens; NULL when nothing is cited.

    ``cited``: scope, token (an unsent token counts as bad). ``sent_units``:
    scope, token, unit_id. ``gold_units``: scope, unit_id, must and should alike.
    """
    good = sent_units.join(gold_units.select(*scope, "unit_id").distinct(), [*scope, "unit_id"], "left_semi")
    good = good.select(*scope, "token").distinct().withColumn("good", F.lit(1))
    judged = cited.select(*scope, "token").distinct().join(good, [*scope, "token"], "left")
    shares = judged.groupBy(*scope).agg(F.avg(F.coalesce("good", F.lit(0))).alias("precision"))
    return answers.select(*scope).join(shares, scope, "left").select(*scope, F.bround("precision", 6).alias("precision"))


def citation_coverage(cited: DataFrame, sent_units: DataFrame, must_units: DataFrame, scope: list[str],
                      answers: DataFrame) -> DataFrame:
    """(scope, coverage, recall_sent): of the must passages that were sent, the share cited; of all, the share sent."""
    marked = sent_units.join(cited.select(*scope, "token").distinct().withColumn("cited", F.lit(1)), [*scope, "token"], "left")
    by_unit = marked.groupBy(*scope, "unit_id").agg(F.max(F.coalesce("cited", F.lit(0))).alias("cited"))
    flags = must_units.join(by_unit, [*scope, "unit_id"], "left").groupBy(*scope, "passage_id").agg(
        F.max(F.when(F.col("cited").isNotNull(), 1).otherwise(0)).alias("present"),
        F.max(F.coalesce("cited", F.lit(0))).alias("cited"),
    )
    shares = flags.groupBy(*scope).agg(
        F.avg(F.when(F.col("present") == 1, F.col("cited"))).alias("coverage"), F.avg("present").alias("recall_sent")
    )
    return answers.select(*scope).join(shares, scope, "left").select(
        *scope, F.bround("coverage", 6).alias("coverage"), F.bround("recall_sent", 6).alias("recall_sent")
    )


def displacement(passages: DataFrame, scope: list[str], top: int = 25) -> DataFrame:
    """(scope, displaced): passages of the primary top that the unfiltered top no longer holds.

    ``passages``: mode (``primary`` and ``both``), scope, rank, first_unit, last, so that both modes are one plan.
    """
    primary = F.col("mode") == "primary"
    held = passages.groupBy(*scope, "first_unit", "last").agg(
        F.min(F.when(primary, F.col("rank"))).alias("own"), F.min(F.when(~primary, F.col("rank"))).alias("other"))
    lost = (F.col("own") < top) & (F.coalesce("other", F.lit(top)) >= top)
    return held.groupBy(*scope).agg(F.count_if(lost).alias("displaced"), F.count("own").alias("n")).where("n > 0").drop("n")


# --- gold drafting -----------------------------------------------------------------

def topic_evidence(asked: DataFrame, topics: DataFrame, members: DataFrame) -> DataFrame:
    """(query_id, unit_id, points): members of the asked topics, small topics weighing more.

    ``asked``: query_id, topic_id. ``topics``: topic_id, see_ids (targets of its
    see-also pointer). An empty topic hands over to its first non-empty target,
    once.
    """
    sizes = members.groupBy("topic_id").agg(F.count_distinct("unit_id").alias("size"))
    named = asked.join(topics.select("topic_id", "see_ids"), "topic_id").join(sizes, "topic_id", "left")
    own = named.where("size IS NOT NULL").select("query_id", "topic_id", "size")
    pointed = named.where("size IS NULL").select(
        "query_id", F.col("topic_id").alias("asked_id"), F.posexplode("see_ids").alias("no", "topic_id")
    ).join(sizes, "topic_id")
    first = pointed.groupBy("query_id", "asked_id").agg(F.min_by(F.struct("topic_id", "size"), "no").alias("t"))
    used = own.unionByName(first.select("query_id", "t.topic_id", "t.size"))
    weight = TOPIC_WEIGHT * (TOPIC_SCALE / (TOPIC_SCALE + F.col("size")))
    return used.join(members.select("topic_id", "unit_id").distinct(), "topic_id").select(
        "query_id", "unit_id", weight.alias("points")
    )


def gold_scores(topic_points: DataFrame, keyword_hits: DataFrame, edges: DataFrame, keep: Column) -> DataFrame:
    """(query_id, unit_id, score, origins): summed evidence of topics, keywords and one hop.

    ``keyword_hits``: query_id, unit_id, pos. ``keep`` restricts topic and hop
    evidence by unit. Parallel edges are folded to a count before any query
    meets them.
    """
    topic = topic_points.where(keep).select("query_id", "unit_id", "points", F.lit("topic").alias("origin"))
    keyword = keyword_hits.select(
        "query_id", "unit_id", (F.lit(KEYWORD_WEIGHT) / (F.col("pos") / KEYWORD_DECAY + 1)).alias("points"),
        F.lit("keyword").alias("origin"),
    )
    direct = topic.unionByName(keyword).groupBy("query_id", "unit_id").agg(
        stable(F.sum("points")).alias("score"), F.collect_set("origin").alias("origins")
    )
    anchors = rank_within(direct, ["query_id"], [F.desc("score"), F.asc("unit_id")], HOP_ANCHORS)
    folded = edges.groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n"))
    hops = anchors.select("query_id", F.col("unit_id").alias("from_id")).join(folded, "from_id").groupBy(
        "query_id", F.col("to_id").alias("unit_id")
    ).agg(F.sum("n").alias("n")).where(keep)
    hop = hops.select(
        "query_id", "unit_id", (F.least("n", F.lit(HOP_MAX)) * HOP_WEIGHT).alias("score"),
        F.array(F.lit("edge")).alias("origins"),
    )
    return direct.unionByName(hop).groupBy("query_id", "unit_id").agg(
        stable(F.sum("score")).alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("origins")))).alias("origins")
    )


def gold_ranges(scores: DataFrame, units: DataFrame, layout: KeyLayout = CLASSIC) -> DataFrame:
    """(query_id, rank, work_id, chapter, first, last, unit_ids, origins, density, agreement, hits).

    Units up to ``RANGE_GAP`` apart join a range of at most ``RANGE_LENGTH``: stretches without a wider gap are cut
    greedily by length. Ranges are filled with the units in between that exist, and rank by score density.
    """
    key = F.col("unit_id")
    located = scores.select(
        "query_id", layout.work(key).alias("work_id"), layout.chapter(key).alias("chapter"),
        layout.ordinal(key).alias("ordinal"), "score", "origins",
    )
    chapter = ["query_id", "work_id", "chapter"]
    inside = W.partitionBy(*chapter).orderBy("ordinal")  # a chapter's ordinals are bounded by the layout
    wide = F.coalesce(F.col("ordinal") - F.lag("ordinal").over(inside) > RANGE_GAP, F.lit(False))
    stretches = located.withColumn("wide", wide.cast("int")).withColumn("stretch", F.sum("wide").over(inside)).drop("wide")
    place = F.col("ordinal")
    cut = greedy_runs(stretches, [*chapter, "stretch"], ["ordinal"], RANGE_LENGTH, F.lit(0), start=place - 1, end=place)
    rows = cut.withColumn("first", F.min("ordinal").over(W.partitionBy(*chapter, "stretch", "run"))).drop("stretch", "run")
    ranges = rows.groupBy("query_id", "work_id", "chapter", "first").agg(
        F.max("ordinal").alias("last"), F.sum("score").alias("total"), F.count(F.lit(1)).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("origins")))).alias("origins"),
    )
    filled = ranges.select("query_id", "work_id", "chapter", "first", F.explode(F.sequence("first", "last")).alias("ordinal"))
    filled = filled.withColumn("unit_id", layout.pack(F.col("work_id"), F.col("chapter"), F.col("ordinal")))
    existing = filled.join(units.select("unit_id"), "unit_id", "left_semi").groupBy(
        "query_id", "work_id", "chapter", "first"
    ).agg(F.array_sort(F.collect_list("unit_id")).alias("unit_ids"))
    full = ranges.join(existing, ["query_id", "work_id", "chapter", "first"]).select(
        "query_id", "work_id", "chapter", "first", "last", "unit_ids", "origins", "hits",
        F.bround(stable(F.col("total")) / F.sqrt(F.size("unit_ids")), 3).alias("density"),
        F.size("origins").cast("long").alias("agreement"), F.element_at("unit_ids", 1).alias("first_unit"),
    )
    return rank_within(
        full, ["query_id"], [F.desc("density"), F.desc("agreement"), F.desc("hits"), F.asc("first_unit")], name="rank"
    )


def gold_split(ranges: DataFrame) -> DataFrame:
    """(…, kind, kind_rank): must = best corroborated ranges, should = the next ones of the rest."""
    strong = F.col("agreement") >= 2
    order = W.partitionBy("query_id", "strong").orderBy("rank")
    placed = ranges.withColumn("strong", strong).withColumn("_no", F.row_number().over(order))
    must = F.col("strong") & (F.col("_no") <= MUST_MAX)
    placed = placed.withColumn("kind", F.when(must, "must").otherwise("rest")).drop("_no")
    ranked = rank_within(
        placed, ["query_id", "kind"], [F.desc("density"), F.desc("agreement"), F.asc("first_unit")],
        max(MUST_MAX, SHOULD_MAX), "kind_rank",
    )
    return ranked.where((F.col("kind") == "must") | (F.col("kind_rank") < SHOULD_MAX)).withColumn(
        "kind", F.when(F.col("kind") == "must", "must").otherwise("should")
    ).drop("strong")


def gold_invariants(gold: DataFrame, chapter_sizes: DataFrame, works: DataFrame, scopes: DataFrame,
                    known_origins: tuple[str, ...], layout: KeyLayout = CLASSIC) -> DataFrame:
    """(rule, violations) of a gold set.

    ``gold``: query_id, kind, first_unit, unit_ids, agreement, origins, collection (the label it carries) ·
    ``chapter_sizes``: work_id, chapter, chapter_size · ``works``: work_id, collection · ``scopes``: query_id, both
    (whether the question reads both collections). A unit in a must and a should passage of one question is a violation,
    also where the passages differ. Passages of the secondary collection have one origin at hand and need no second.
    """
    key = F.col("unit_ids")
    chapter = lambda u: F.call_function("div", u, F.lit(layout.ordinal_radix))
    located = gold.withColumn("work_id", layout.work(F.col("first_unit"))).withColumn(
        "chapter", layout.chapter(F.col("first_unit")))
    sized = located.join(chapter_sizes, ["work_id", "chapter"], "left").join(
        works.select("work_id", F.col("collection").alias("own")), "work_id", "left").join(scopes, "query_id", "left")
    known = F.array(*[F.lit(o) for o in known_origins])
    secondary = F.coalesce(F.col("own") == "secondary", F.lit(False))
    rows = sized.agg(
        F.count_if(chapter(F.array_max(key)) != chapter(F.array_min(key))).alias("one_chapter"),
        F.count_if((F.size("unit_ids") >= F.coalesce("chapter_size", F.lit(0))) & (F.coalesce("chapter_size", F.lit(0)) != 1)).alias("whole_chapter"),
        F.count_if(key != F.array_sort(key)).alias("sorted"),
        F.count_if(F.array_max(key) - F.array_min(key) >= RANGE_LENGTH).alias("length"),
        F.count_if((F.col("kind") == "must") & (F.col("agreement") < 2) & ~secondary).alias("corroborated"),
        F.count_if((F.size("origins") == 0) | (F.size(F.array_except("origins", known)) > 0)).alias("unknown_origin"),
        F.count_if(~F.col("collection").eqNullSafe(F.col("own"))).alias("collection_label"),
        F.count_if(secondary & ~F.coalesce("both", F.lit(False))).alias("secondary_out_of_scope"),
    )
    per_query = gold.groupBy("query_id").agg(
        F.count_if(F.col("kind") == "must").alias("n_must"), F.count_if(F.col("kind") == "should").alias("n_should"),
        F.count(F.lit(1)).alias("n"), F.count_distinct("first_unit").alias("n_distinct"),
    ).agg(
        F.count_if(F.col("n_must") > MUST_MAX).alias("too_many_must"),
        F.count_if(F.col("n_should") > SHOULD_MAX).alias("too_many_should"),
        F.count_if(F.col("n_should") == 0).alias("no_should"),
        F.count_if(F.col("n") != F.col("n_distinct")).alias("duplicates"),
    )
    kinds = gold.select("query_id", "kind", F.explode("unit_ids").alias("unit_id")).groupBy("query_id", "unit_id").agg(
        F.count_distinct("kind").alias("kinds"))
    shared = kinds.agg(F.count_if(F.col("kinds") > 1).alias("must_in_should"))
    stacked = lambda df: df.selectExpr(
        f"stack({len(df.columns)}, " + ", ".join(f"'{c}', {c}" for c in df.columns) + ") AS (rule, violations)"
    )
    return stacked(rows).unionByName(stacked(per_query)).unionByName(stacked(shared))


def config_report(results: DataFrame, evidence: tuple[str, ...]) -> DataFrame:
    """(model, config, evidence, questions, at_10, at_25, at_50, mean_seconds) of result rows.

    ``results``: model, config, question_id, r10, r25, r50, seconds. Means skip missing values. ``evidence`` names the
    configurations that use no path the gold lists were drawn from.
    """
    means = {f"at_{k}": F.bround(F.avg(f"r{k}"), 6) for k in CUTS} | {"mean_seconds": F.bround(F.avg("seconds"), 6)}
    return results.groupBy("model", "config").agg(
        F.count_distinct("question_id").alias("questions"), *[m.alias(n) for n, m in means.items()]
    ).withColumn("evidence", F.col("config").isin(*evidence))


def question_report(results: DataFrame, config: str, models: list[str]) -> DataFrame:
    """(question_id, one column per model): recall at 25 under one configuration."""
    shown = results.where(F.col("config") == config).groupBy("question_id").pivot("model", models).agg(F.bround(F.avg("r25"), 6))
    return shown.select("question_id", *models)


# --- runs --------------------------------------------------------------------------

def last_run_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last written row per key: a map-side combinable maximum, not a sort."""
    rest = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return latest.select(*keys, "_r.*")


def run_summary(rows: DataFrame, run: str = "run") -> DataFrame:
    """One row per run; means skip missing values and the median is exact.

    ``rows``: run, first_verdict, retry_verdict, fallback_used, structure_ok,
    precision, coverage, wall_seconds, themes, fabrications. Theme counts are
    listed as ``value×count`` pairs.
    """
    rate = lambda condition: F.bround(F.avg(F.when(condition, 1.0).otherwise(0.0)), 6)
    main = rows.groupBy(run).agg(
        F.count(F.lit(1)).alias("questions"),
        rate(F.col("first_verdict") != "ok").alias("violation_rate"),
        rate(F.col("retry_verdict").isNotNull()).alias("retry_rate"),
        rate(F.col("fallback_used")).alias("fallback_rate"),
        rate(F.col("structure_ok")).alias("structure_rate"),
        F.bround(F.avg("precision"), 6).alias("precision"),
        F.bround(F.avg("coverage"), 6).alias("coverage"),
        F.max("wall_seconds").alias("max_seconds"),
        F.sum("fabrications").alias("fabrications"),
    )
    middle = exact_median(rows, [run], "wall_seconds", "median_seconds").select(run, "median_seconds")
    themes = rows.groupBy(run, "themes").agg(F.count(F.lit(1)).alias("n"))
    listed = themes.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("themes", "n"))).alias("t")).select(
        run, F.array_join(F.transform("t", lambda x: F.concat(x["themes"].cast("string"), F.lit("x"), x["n"].cast("string"))), ",")
        .alias("themes")
    )
    return main.join(middle, run).join(listed, run)


def exact_median(rows: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """(groups, n, name): the exact median without gathering a group anywhere."""
    n = F.col("n")
    half = lambda add: F.call_function("div", n + add, F.lit(2).cast("long"))
    stats = order_statistics(rows, groups, value, {"_lo_mid": half(1), "_hi_mid": half(2)})
    return stats.select(*groups, "n", F.bround((F.col("_lo_mid") + F.col("_hi_mid")) / 2, 6).alias(name))


def gates(summaries: DataFrame, limits: dict[str, Column], run: str = "run", size: str = "size") -> DataFrame:
    """Pass flag per gate and run, and the role the selection rule gives each run.

    The smallest passing run is the fallback and the next passing size the
    default; when none passes nothing is selected.
    """
    flagged = summaries.select(run, size, *[limit.alias(f"pass_{name}") for name, limit in limits.items()])
    passes = F.lit(True)
    for name in limits:
        passes = passes & F.col(f"pass_{name}")
    judged = flagged.withColumn("passes", passes)
    order = rank_within(judged.where("passes"), ["passes"], [F.asc(size), F.asc(run)], 2, "place")
    role = F.when(F.col("place") == 0, "fallback").when(F.col("place") == 1, "default").otherwise("none")
    return judged.join(order.select(run, "place"), run, "left").withColumn("role", role).drop("place")


def run_delta(summaries: DataFrame, metrics: list[str], baseline: str, run: str = "run") -> DataFrame:
    """(run, metric, value, base, delta) of every run against a baseline run."""
    pairs = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in metrics)
    long = summaries.select(run, F.expr(f"stack({len(metrics)}, {pairs}) AS (metric, value)"))
    base = long.where(F.col(run) == baseline).select("metric", F.col("value").alias("base"))
    return long.join(base, "metric").withColumn("delta", F.bround(F.col("value") - F.col("base"), 6))


def mode_choice(values: DataFrame, modes: tuple[str, ...] = ("raw", "rewrite", "fused")) -> DataFrame:
    """(mode, mean, wins, chosen): questions at or above the best mode; ties go to ``raw``.

    ``values``: query_id and one column per mode.
    """
    best = F.greatest(*[F.col(m) for m in modes])
    totals = values.agg(
        *[F.avg(m).alias(f"mean_{m}") for m in modes], *[F.count_if(F.col(m) >= best).alias(f"wins_{m}") for m in modes]
    )
    rows = F.array(*[
        F.struct(F.lit(m).alias("mode"), F.bround(f"mean_{m}", 9).alias("mean"), F.col(f"wins_{m}").alias("wins"),
                 F.lit(-i).alias("priority")) for i, m in enumerate(modes)
    ])
    top = F.array_max(F.transform(rows, lambda r: F.struct(r["mean"].alias("mean"), r["priority"].alias("p"), r["mode"].alias("mode"))))
    return totals.select(top["mode"].alias("_best"), F.inline(rows)).select(
        "mode", F.bround("mean", 6).alias("mean"), "wins", (F.col("mode") == F.col("_best")).alias("chosen")
    )


def bootstrap_ci(differences: DataFrame, resamples: int, low: float = 0.025, high: float = 0.975,
                 seed: str = "resample") -> DataFrame:
    """One row: mean difference and percentile interval over questions.

    ``differences``: query_id, diff. Draws ``4c`` to ``4c + 3`` of resample ``r`` are the four 8-digit groups of
    ``md5(seed|r|c)`` modulo the number of questions, so any engine repeats them. They are spread over the cluster
    chunk by chunk and averaged before they are ordered.
    """
    numbered = sequential_ids(differences.select("query_id", "diff"), "query_id", "no", start=0)
    spark = differences.sparkSession
    n = numbered.count()
    chunks = -(-max(n, 1) // 4)
    part = spark.range(resamples * chunks).select(
        F.call_function("div", F.col("id"), F.lit(chunks)).alias("r"), (F.col("id") % chunks).alias("c"))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("r").cast("string"), F.col("c").cast("string")))
    draws = part.select("r", "c", digest.alias("h"), F.explode(F.array(*[F.lit(j) for j in range(4)])).alias("j")).select(
        "r", (F.col("c") * 4 + F.col("j")).alias("d"),
        F.conv(F.substring("h", F.col("j") * 8 + 1, F.lit(8)), 16, 10).cast("long").alias("x"))
    drawn = draws.where(F.col("d") < n).select("r", (F.col("x") % F.lit(max(n, 1))).alias("no"))
    means = drawn.join(numbered, "no").groupBy("r").agg(F.round(F.avg("diff"), 9).alias("m"))
    count = F.col("n")
    at = lambda q: F.least(F.floor(count * q), count - 1) + 1
    bounds = order_statistics(means.withColumn("g", F.lit(1)), ["g"], "m", {"low": at(low), "high": at(high)})
    overall = differences.agg(
        F.lit(1).alias("g"), F.bround(F.avg("diff"), 6).alias("mean"), F.count(F.lit(1)).alias("n_questions")
    )
    ends = bounds.select("g", F.bround("low", 6).alias("low"), F.bround("high", 6).alias("high"))
    return ends.join(overall, "g").drop("g")


def parity_diff(left: DataFrame, right: DataFrame, case: str, rank: str, tolerance: float = 1e-5) -> DataFrame:
    """(case, n_left, n_right, n_mismatch, first_rank, first_field) of two rankings, rank by rank.

    Both: case, rank, unit_id, score, origins, collection.
    """
    fields = ["unit_id", "score", "origins", "collection"]
    a = left.select(case, rank, *[F.col(f).alias(f"a_{f}") for f in fields])
    b = right.select(case, rank, *[F.col(f).alias(f"b_{f}") for f in fields])
    both = a.join(b, [case, rank], "full_outer")
    field = (
        F.when(F.col("a_unit_id").isNull() | F.col("b_unit_id").isNull(), "length")
        .when(F.col("a_unit_id") != F.col("b_unit_id"), "unit_id")
        .when(F.abs(F.col("a_score") - F.col("b_score")) > tolerance, "score")
        .when(F.col("a_origins") != F.col("b_origins"), "origins")
        .when(F.col("a_collection") != F.col("b_collection"), "collection")
    )
    judged = both.withColumn("field", field)
    wrong = F.col("field").isNotNull()
    return judged.groupBy(case).agg(
        F.count("a_unit_id").alias("n_left"), F.count("b_unit_id").alias("n_right"), F.count_if(wrong).alias("n_mismatch"),
        F.min(F.when(wrong, F.col(rank))).alias("first_rank"),
        F.min_by(F.when(wrong, F.col("field")), F.when(wrong, F.col(rank))).alias("first_field"),
    )


def stage_latency(rows: DataFrame, stages: list[str], groups: list[str]) -> DataFrame:
    """(groups, stage, n, total, median, max) over one timing column per stage."""
    pairs = ", ".join(f"'{s}', {s}" for s in stages)
    long = rows.select(*groups, F.expr(f"stack({len(stages)}, {pairs}) AS (stage, seconds)")).where("seconds IS NOT NULL")
    keys = [*groups, "stage"]
    totals = long.groupBy(*keys).agg(F.bround(F.sum("seconds"), 4).alias("total"), F.max("seconds").alias("max"))
    return totals.join(exact_median(long, keys, "seconds", "median"), keys)
