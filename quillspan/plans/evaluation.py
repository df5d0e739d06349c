"""Published evaluation queries: gold from planted benchmark passages, runs from events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.keys import CLASSIC
from quillspan.operators import evaluate as E
from quillspan.operators import fusion, keyword, search
from quillspan.plans import inputs as I
from quillspan.plans import retrieval as P
from quillspan.plans.registry import query
from quillspan.session import cut_lineage, stored
from quillspan.sources.runlog import explode_gold
from quillspan.sources.tables import table

# --- gold: documents that hold a benchmark item, and their chapter neighbours ---------

def must_units(spark, sf) -> DataFrame:
    """(query_id, passage_id, unit_id): a planted document and the one after it in its chapter, stored."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("phrase_id"), "text")
    found = keyword.contained_phrases(items, I.keyword_index(spark, sf))
    start = F.col("unit_id")
    pair = F.when(CLASSIC.ordinal(start) < 20, F.array(start, start + 1)).otherwise(F.array(start))
    spread = found.select(F.col("phrase_id").alias("query_id"), start.alias("passage_id"), F.explode(pair).alias("unit_id"))
    return stored(spread.join(I.shelf_units(spark, sf).select("unit_id"), "unit_id", "left_semi"), "must")


def should_units(spark, sf, must: DataFrame) -> DataFrame:
    """(query_id, passage_id, unit_id): good-quality documents of the planted documents' chapters."""
    places = must.select("query_id", F.call_function("div", F.col("passage_id"), F.lit(1000)).alias("place")).distinct()
    good = table(spark, sf, "labels").where("quality = 1").select(I.shelf_key(F.col("doc_id")).alias("unit_id"))
    near = good.withColumn("place", F.call_function("div", F.col("unit_id"), F.lit(1000))).join(places, "place")
    rest = near.join(must.select("query_id", "unit_id"), ["query_id", "unit_id"], "left_anti")
    return rest.select("query_id", F.col("unit_id").alias("passage_id"), "unit_id")


_W = I.sql_words
GOLD_SQL = f"""
planted AS (
  SELECT item_id AS query_id, doc_id FROM
    (SELECT item_id, ' ' || array_to_string({_W('text')}, ' ') || ' ' AS needle FROM benchmark),
    (SELECT doc_id, ' ' || array_to_string({_W('text')}, ' ') || ' ' AS hay FROM documents) WHERE contains(hay, needle)),
must AS (
  SELECT query_id, {I.sql_key('doc_id')} AS passage_id, {I.sql_key('d')} AS unit_id FROM (
    SELECT query_id, doc_id, unnest(CASE WHEN doc_id % 20 < 19 THEN [doc_id, doc_id + 1] ELSE [doc_id] END) AS d FROM planted)
  WHERE d IN (SELECT doc_id FROM documents)),
should AS (
  SELECT DISTINCT m.query_id, l.u AS passage_id, l.u AS unit_id
  FROM must m JOIN (SELECT {I.sql_key('doc_id')} AS u FROM labels WHERE quality = 1) l ON l.u // 1000 = m.passage_id // 1000
  WHERE NOT EXISTS (SELECT 1 FROM must x WHERE x.query_id = m.query_id AND x.unit_id = l.u))
"""


def gold(spark, sf) -> DataFrame:
    """Nested gold set: one row per question with must and should passages."""
    def nested(units: DataFrame, name: str) -> DataFrame:
        passages = units.groupBy("query_id", "passage_id").agg(F.array_sort(F.collect_list("unit_id")).alias("unit_ids"))
        return passages.groupBy("query_id").agg(
            F.array_sort(F.collect_list(F.struct("passage_id", "unit_ids"))).alias(name))

    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    must = must_units(spark, sf)
    empty = F.array().cast("array<struct<passage_id:bigint,unit_ids:array<bigint>>>")
    return (
        queries.join(nested(must, "must"), "query_id", "left")
        .join(nested(should_units(spark, sf, must), "should"), "query_id", "left")
        .withColumn("must", F.coalesce("must", empty)).withColumn("should", F.coalesce("should", empty))
    )


@query("gold_explode", I.with_sql(GOLD_SQL) + """
SELECT query_id, 'must' AS kind, dense_rank() OVER (PARTITION BY query_id ORDER BY passage_id) - 1 AS passage_no, unit_id FROM must
UNION ALL SELECT query_id, 'should', dense_rank() OVER (PARTITION BY query_id ORDER BY passage_id) - 1, unit_id FROM should""")
def q_gold_explode(spark, sf):
    return explode_gold(gold(spark, sf), "query_id", "unit_ids")


QUERIES_SQL = "queries AS (SELECT item_id AS query_id FROM benchmark)"
RANKS_SQL = """
granks AS (
  SELECT m.query_id, m.passage_id, min("rank") + 1 AS "rank" FROM must m
  LEFT JOIN (SELECT query_id, "rank", unnest(unit_ids) AS unit_id FROM passages) p USING (query_id, unit_id) GROUP BY 1, 2)
"""


def _queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))


@query("gold_rank", I.with_sql(*P.PASSAGES_SQL, GOLD_SQL, RANKS_SQL) + 'SELECT query_id, passage_id, "rank" FROM granks')
def q_gold_rank(spark, sf):
    return E.gold_ranks(must_units(spark, sf), P.passages(spark, sf), ["query_id"])


def _recall_sql(scope: str = "query_id", source: str = "granks", every: str = "queries") -> str:
    return f"""
rec AS (
  SELECT {scope}, k, count(*) AS n, count(*) FILTER ("rank" <= k) AS h FROM {source}, (VALUES (10), (25), (50)) v(k) GROUP BY {scope}, k),
recall AS (
  SELECT {scope}, k, round_even(coalesce(h / n, 0), 6) AS recall, round_even(h / n, 6) AS recall_or_null
  FROM (SELECT q.*, unnest([10, 25, 50]) AS k FROM {every} q) LEFT JOIN rec USING ({scope}, k))
"""


@query("recall_at_k", I.with_sql(*P.PASSAGES_SQL, GOLD_SQL, RANKS_SQL, QUERIES_SQL, _recall_sql())
       + "SELECT query_id, CAST(k AS BIGINT) AS k, recall, recall_or_null FROM recall")
def q_recall_at_k(spark, sf):
    ranks = E.gold_ranks(must_units(spark, sf), P.passages(spark, sf), ["query_id"])
    return E.recall_at(ranks, _queries(spark, sf), ["query_id"])


@query("config_pivot", I.with_sql(*P.ABLATION_PASSAGES_SQL, GOLD_SQL, QUERIES_SQL, """
configs AS (SELECT DISTINCT config FROM switches UNION ALL SELECT 'G'),
granks AS (
  SELECT config, m.query_id, m.passage_id, min(p."rank") + 1 AS "rank"
  FROM must m CROSS JOIN configs
  LEFT JOIN (SELECT config, query_id, "rank", unnest(unit_ids) AS unit_id FROM apassages) p USING (config, query_id, unit_id)
  GROUP BY 1, 2, 3),
every AS (SELECT * FROM configs, queries)""", _recall_sql("config, query_id", "granks", "every")) + """
SELECT config, round_even(avg(recall) FILTER (k = 10), 6) AS at_10, round_even(avg(recall) FILTER (k = 25), 6) AS at_25,
       round_even(avg(recall) FILTER (k = 50), 6) AS at_50 FROM recall GROUP BY 1""")
def q_config_pivot(spark, sf):
    """Mean recall per configuration, one column per cut."""
    scope = ["config", "query_id"]
    found = stored(P.ablation_passages(spark, sf).select(*scope, "rank", "unit_ids"), "ranked")
    names = [*fusion.CONFIGURATIONS, *fusion.RERANKED]
    every = _queries(spark, sf).select("*", F.explode(F.array(*[F.lit(c) for c in names])).alias("config"))
    recall = E.recall_at(E.gold_ranks(must_units(spark, sf), found, scope), every, scope)
    pivoted = recall.groupBy("config").pivot("k", [10, 25, 50]).agg(F.bround(F.avg("recall"), 6))
    return pivoted.select("config", *[F.col(str(k)).alias(f"at_{k}") for k in (10, 25, 50)])


# --- citations of answers written over the first 25 passages --------------------------

CUT_SQL = """
sentp AS (
  SELECT query_id, '[P' || ("rank" + 1) || ']' AS token, unit_ids, (query_id * 7 + "rank" * 3) % 5 < 2 AS cited
  FROM passages WHERE "rank" < 25),
sentu AS (SELECT query_id, token, cited, unnest(unit_ids) AS unit_id FROM sentp),
cited AS (
  SELECT query_id, token FROM sentp WHERE cited AND query_id % 10 <> 9
  UNION ALL SELECT query_id, '[P99]' FROM queries WHERE query_id % 4 = 0)
"""


def _sent_and_cited(spark, sf):
    """Tokens of the first 25 passages; each answer cites some of them, some answers an unsent one. Both read one search."""
    cut = stored(P.passages(spark, sf).where(F.col("rank") < 25).select(
        "query_id", F.concat(F.lit("[P"), (F.col("rank") + 1).cast("string"), F.lit("]")).alias("token"), "unit_ids",
        ((F.col("query_id") * 7 + F.col("rank") * 3) % 5 < 2).alias("cited")), "cut")
    unsent = _queries(spark, sf).where("query_id % 4 = 0").select("query_id", F.lit("[P99]").alias("token"))
    cited = cut.where("cited AND query_id % 10 <> 9").select("query_id", "token").unionByName(unsent)
    return cut.select("query_id", "token", F.explode("unit_ids").alias("unit_id")), cited


@query("citation_precision", I.with_sql(*P.PASSAGES_SQL, GOLD_SQL, QUERIES_SQL, CUT_SQL, """
gold AS (SELECT query_id, unit_id FROM must UNION SELECT query_id, unit_id FROM should),
good AS (SELECT DISTINCT query_id, token FROM sentu JOIN gold USING (query_id, unit_id))""") + """
SELECT query_id, round_even(p, 6) AS precision FROM queries LEFT JOIN (
  SELECT c.query_id, avg(CASE WHEN g.token IS NULL THEN 0 ELSE 1 END) AS p FROM cited c LEFT JOIN good g USING (query_id, token)
  GROUP BY 1) USING (query_id)""")
def q_citation_precision(spark, sf):
    sent, cited = _sent_and_cited(spark, sf)
    must = must_units(spark, sf)
    units = must.select("query_id", "unit_id").unionByName(should_units(spark, sf, must).select("query_id", "unit_id"))
    return E.citation_precision(cited, sent, units, ["query_id"], _queries(spark, sf))


@query("citation_coverage", I.with_sql(*P.PASSAGES_SQL, GOLD_SQL, QUERIES_SQL, CUT_SQL, """
flags AS (
  SELECT m.query_id, m.passage_id, max(CASE WHEN s.token IS NOT NULL THEN 1 ELSE 0 END) AS present,
         max(CASE WHEN c.token IS NOT NULL THEN 1 ELSE 0 END) AS hit
  FROM must m LEFT JOIN sentu s USING (query_id, unit_id)
  LEFT JOIN cited c ON c.query_id = m.query_id AND c.token = s.token GROUP BY 1, 2)""") + """
SELECT query_id, round_even(c, 6) AS coverage, round_even(r, 6) AS recall_sent FROM queries LEFT JOIN (
  SELECT query_id, avg(hit) FILTER (present = 1) AS c, avg(present) AS r FROM flags GROUP BY 1) USING (query_id)""")
def q_citation_coverage(spark, sf):
    sent, cited = _sent_and_cited(spark, sf)
    return E.citation_coverage(cited, sent, must_units(spark, sf), ["query_id"], _queries(spark, sf))


@query("fullset_profile", I.with_sql(*P.PASSAGES_SQL, """
per AS (
  SELECT query_id, count(DISTINCT "rank") AS passages, count(*) AS units, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM (
    SELECT query_id, "rank", unnest(unit_ids) AS unit_id FROM passages) JOIN units USING (unit_id) GROUP BY 1),
long AS (SELECT * FROM per UNPIVOT (v FOR what IN (passages, units, tokens)))""") + """
SELECT what, min(v) AS min, round_even(median(v), 6) AS median, max(v) AS max FROM long GROUP BY 1""")
def q_fullset_profile(spark, sf):
    """Size of the full retrieved set per question: passages, units, estimated tokens."""
    found = P.passages(spark, sf).select("query_id", "rank", F.explode("unit_ids").alias("unit_id"))
    sized = I.shelf_units(spark, sf).select("unit_id", F.call_function("div", F.length("text"), F.lit(4)).alias("tokens"))
    per = found.join(sized, "unit_id").groupBy("query_id").agg(
        F.count_distinct("rank").alias("passages"), F.count(F.lit(1)).alias("units"), F.sum("tokens").alias("tokens"))
    long = per.selectExpr("stack(3, 'passages', passages, 'units', units, 'tokens', tokens) AS (what, v)")
    long = cut_lineage(long)  # three rows per question, read several times below
    edges = long.groupBy("what").agg(F.min("v").alias("min"), F.max("v").alias("max"))
    return edges.join(E.exact_median(long, ["what"], "v", "median"), "what").select("what", "min", "median", "max")


@query("displacement", I.with_sql(
    *P.SHELF, *P.HITS_SQL, P.lists_sql("primary"), P.boosted_sql("primary"), P.islands_sql("final", out="pa"),
    P.lists_sql("both", "2"), P.boosted_sql("both", "2").replace("tcap AS", "tcap2 AS"), P.islands_sql("final2", out="pb")) + """
SELECT query_id, count(*) FILTER (b.query_id IS NULL AND a."rank" < 25) AS displaced
FROM pa a LEFT JOIN (SELECT query_id, first_unit, "last" FROM pb WHERE "rank" < 25) b USING (query_id, first_unit, "last")
GROUP BY 1""")
def q_displacement(spark, sf):
    ranked = search.search(I.search_index(spark, sf), P._hits(spark, sf), ("primary", "both"))
    return E.displacement(fusion.islands(ranked, ["mode", "query_id"]), ["query_id"])


# --- query modes ---------------------------------------------------------------------

MODES = ("raw", "rewrite", "fused", "hand")


def _mode_terms(spark, sf) -> DataFrame:
    """(query_id, form, mode, terms) per benchmark item; the rewrites are word pairs from all over the item."""
    from quillspan.functions.text import question_terms, words
    from quillspan.operators.questions import query_modes

    items = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), "text", words(F.col("text")).alias("w"), question_terms(F.col("text")).alias("own"))
    # every fifth word with its neighbour
    pairs = F.filter(F.transform("w", lambda x, i: F.when((i % 5 == 0) & (i + 1 < F.size("w")), F.concat_ws(" ", x, F.get("w", i + 1)))),
                     lambda p: p.isNotNull())
    modes = query_modes(items.withColumn("rewrites", pairs), ["query_id"]).drop("query_text")
    hand = items.select("query_id", F.lit("hand").alias("mode"), F.filter("own", lambda x: F.length(x) >= 6).alias("terms"))
    number = F.array_position(F.array(*[F.lit(m) for m in MODES]), F.col("mode")) - 1
    return modes.unionByName(hand).withColumn("form", F.col("query_id") * len(MODES) + number)


MODE_SQL = (f"""
modes AS (
  SELECT query_id, m.mode, query_id * 4 + m.i AS form, m.terms FROM (
    SELECT item_id AS query_id, own, CASE WHEN len(pairs) > 0 THEN pairs ELSE own END AS rewritten, own || pairs AS fused,
           list_filter(own, lambda x: length(x) >= 6) AS hand FROM (
      SELECT item_id, {I.sql_question_terms('text')} AS own, list_filter(list_transform(w, lambda x, i:
               CASE WHEN (i - 1) % 5 = 0 AND i < len(w) THEN x || ' ' || w[i + 1] END), lambda p: p IS NOT NULL) AS pairs
      FROM (SELECT *, {I.sql_words('text')} AS w FROM benchmark))) q,
    LATERAL (VALUES ('raw', 0, own), ('rewrite', 1, rewritten), ('fused', 2, fused), ('hand', 3, hand)) m(mode, i, terms))""", """
qvec AS (
  SELECT form AS query_id, CAST(embedding AS DOUBLE[]) AS vec FROM modes
  JOIN embeddings ON vec_id = modes.query_id + CASE WHEN mode IN ('rewrite', 'fused') THEN 1 ELSE 0 END)""", """
qterms AS (SELECT form AS query_id, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS term_no FROM modes)""",
    I.WORKS_SQL, I.UNITS_SQL, I.VECTORS_SQL, I.EDGES_SQL, *P.HITS_SQL, P.lists_sql("primary"), P.boosted_sql("primary"),
    P.islands_sql(), GOLD_SQL, """
mranks AS (
  SELECT form, o.mode, m.query_id, m.passage_id, min(p."rank") + 1 AS "rank" FROM must m JOIN modes o USING (query_id)
  LEFT JOIN (SELECT query_id AS form, "rank", unnest(unit_ids) AS unit_id FROM passages) p USING (form, unit_id) GROUP BY ALL),
mrec AS (
  SELECT mode, query_id, round_even(coalesce(r, 0), 6) AS recall FROM modes LEFT JOIN (
    SELECT form, count(*) FILTER ("rank" <= 25) / count(*) AS r FROM mranks GROUP BY 1) USING (form)),
grid AS (
  SELECT query_id, max(recall) FILTER (mode = 'raw') AS raw, max(recall) FILTER (mode = 'rewrite') AS "rewrite",
         max(recall) FILTER (mode = 'fused') AS fused, max(recall) FILTER (mode = 'hand') AS hand FROM mrec GROUP BY 1)""")
_MODE_CTES = MODE_SQL


def mode_grid(spark, sf) -> DataFrame:
    """(query_id, raw, rewrite, fused, hand): recall of the full search in every form, one job.

    Each form of a question is a question of its own to the search. The vector of a rewritten text is stood in for by
    the one stored under the next id.
    """
    modes = _mode_terms(spark, sf)
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("vec"))
    shifted = F.col("query_id") + F.when(F.col("mode").isin("rewrite", "fused"), 1).otherwise(0)
    asked = modes.withColumn("vec_id", shifted).join(vectors, "vec_id").select(F.col("form").alias("query_id"), "vec")
    terms = modes.select(F.col("form").alias("query_id"), F.posexplode("terms").alias("term_no", "term"))
    index = I.search_index(spark, sf)
    ranked = search.search(index, search.find_hits(index, asked, terms), "primary")
    found = fusion.islands(ranked, ["query_id"])
    forms = modes.select("query_id", "form", "mode")
    gold = must_units(spark, sf).join(forms, "query_id").select(F.col("form").alias("query_id"), "passage_id", "unit_id")
    recall = E.recall_at(E.gold_ranks(gold, found, ["query_id"]), forms.select(F.col("form").alias("query_id")), ["query_id"], (25,))
    named = recall.withColumnRenamed("query_id", "form").join(forms, "form")
    return named.groupBy("query_id").pivot("mode", list(MODES)).agg(F.max("recall"))


@query("mode_recall", I.with_sql(*_MODE_CTES) + "SELECT * FROM grid")
def q_mode_recall(spark, sf):
    return mode_grid(spark, sf)


@query("mode_choice", I.with_sql(*_MODE_CTES, """
w AS (SELECT *, greatest(raw, "rewrite", fused) AS best FROM grid),
t AS (
  SELECT 'raw' AS mode, 0 AS p, round_even(avg(raw), 9) AS mean, count(*) FILTER (raw >= best) AS wins FROM w
  UNION ALL SELECT 'rewrite', -1, round_even(avg("rewrite"), 9), count(*) FILTER ("rewrite" >= best) FROM w
  UNION ALL SELECT 'fused', -2, round_even(avg(fused), 9), count(*) FILTER (fused >= best) FROM w)""") + """
SELECT mode, round_even(mean, 6) AS mean, wins, row_number() OVER (ORDER BY mean DESC, p DESC) = 1 AS chosen FROM t""")
def q_mode_choice(spark, sf):
    return E.mode_choice(mode_grid(spark, sf))


RESAMPLES = 20_000


@query("bootstrap_ci", I.with_sql(*_MODE_CTES, f"""
d AS (SELECT query_id, raw - hand AS diff, row_number() OVER (ORDER BY query_id) - 1 AS no FROM grid),
n AS (SELECT count(*) AS n FROM d),
draws AS (
  SELECT r, CAST('0x' || substr(md5('resample|' || r || '|' || (k // 4)), 1 + 8 * (k % 4), 8) AS BIGINT) % n AS no
  FROM range(0, {RESAMPLES}) t(r), n, LATERAL (SELECT unnest(range(0, n)) AS k)),
means AS (SELECT r, round(avg(diff), 9) AS m FROM draws JOIN d USING (no) GROUP BY 1),
o AS (SELECT m, row_number() OVER (ORDER BY m) AS i FROM means)""") + f"""
SELECT round_even((SELECT m FROM o WHERE i = floor({RESAMPLES} * 0.025) + 1), 6) AS low,
       round_even((SELECT m FROM o WHERE i = floor({RESAMPLES} * 0.975) + 1), 6) AS high,
       round_even(avg(diff), 6) AS mean, count(*) AS n_questions FROM d""")
def q_bootstrap_ci(spark, sf):
    """Interval of the recall difference between raw terms and a short hand-picked list."""
    diffs = mode_grid(spark, sf).select("query_id", (F.col("raw") - F.col("hand")).alias("diff"))
    return E.bootstrap_ci(cut_lineage(diffs), RESAMPLES)


# --- gold drafting -------------------------------------------------------------------

def _topic_links(spark, sf) -> DataFrame:
    """Topics with their see-also targets: an empty root points at its leaves in order."""
    topics = I.topics(spark, sf)
    leaves = topics.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("topic_id")).agg(
        F.array_sort(F.collect_list("topic_id")).alias("see_ids"))
    return topics.select("topic_id").join(leaves, "topic_id", "left").withColumn(
        "see_ids", F.coalesce("see_ids", F.array().cast("array<bigint>")))


def draft_scores(spark, sf) -> DataFrame:
    queries = _queries(spark, sf)
    asked = queries.select("query_id", F.explode(F.array(
        F.col("query_id") % 10 + 1, F.lit(100).cast("long") + F.col("query_id") % 3)).alias("topic_id"))
    index = I.search_index(spark, sf)
    works = index.works.where("collection = 'primary'").select("work_id")
    primary = I.shelf_units(spark, sf).select("unit_id").withColumn("work_id", CLASSIC.work(F.col("unit_id")))
    readable = F.col("unit_id").isNotNull() & (CLASSIC.work(F.col("unit_id")) % 3 != 0)
    points = E.topic_evidence(asked, _topic_links(spark, sf), index.topic_units)
    terms = I.shelf_question_terms(spark, sf)
    units = primary.join(works, "work_id", "left_semi").select("unit_id")
    scored = keyword.score_terms(index.keywords, terms).join(units, "unit_id", "left_semi")
    lists = keyword.bm25_lists(scored, E.KEYWORD_LIMIT)
    hits = terms.join(lists, "term").select("query_id", "unit_id", "pos")
    return E.gold_scores(points, hits, index.edges, readable)


DRAFT_SQL = (
    I.WORKS_SQL, I.UNITS_SQL, I.QTERMS_SQL, I.VECTORS_SQL, I.EDGES_SQL, I.TOPICS_SQL, P.BM25_SQL, QUERIES_SQL, """
asked AS (
  SELECT query_id, query_id % 10 + 1 AS topic_id FROM queries
  UNION ALL SELECT query_id, (SELECT min(topic_id) FROM leaf WHERE parent_id = 100 + query_id % 3) FROM queries),
sizes AS (SELECT topic_id, count(DISTINCT unit_id) AS size FROM tunits GROUP BY 1),
tp AS (
  SELECT query_id, unit_id, 3.0::DOUBLE * (200.0::DOUBLE / (200 + size)) AS points, 'topic' AS origin
  FROM asked JOIN sizes USING (topic_id) JOIN tunits USING (topic_id) WHERE (unit_id // 1000000) % 3 <> 0),
kl AS (
  SELECT term, unit_id, row_number() OVER (PARTITION BY term ORDER BY weight DESC, unit_id) - 1 AS pos
  FROM scored JOIN works ON work_id = unit_id // 1000000 WHERE collection = 'primary'),
kp AS (
  SELECT query_id, unit_id, 4.0::DOUBLE / (1 + pos / 5.0::DOUBLE) AS points, 'keyword' AS origin
  FROM qterms JOIN kl USING (term) WHERE pos < 60),
direct AS (
  SELECT query_id, unit_id, round(sum(points), 12) AS score, list(DISTINCT origin) AS origins
  FROM (SELECT * FROM tp UNION ALL SELECT * FROM kp) GROUP BY 1, 2),
da AS (
  SELECT query_id, unit_id AS from_id FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS r FROM direct) WHERE r <= 25),
hop AS (
  SELECT query_id, to_id AS unit_id, least(count(*), 4) * 0.5::DOUBLE AS score FROM da JOIN edges USING (from_id)
  WHERE (to_id // 1000000) % 3 <> 0 GROUP BY 1, 2),
draft AS (
  SELECT query_id, unit_id, round(sum(score), 12) AS score, list_sort(list_distinct(flatten(list(origins)))) AS origins FROM (
    SELECT * FROM direct UNION ALL SELECT query_id, unit_id, score, ['edge'] FROM hop) GROUP BY 1, 2)""")

RANGES_SQL = """
seq AS (
  SELECT *, unit_id // 1000 AS place, row_number() OVER (PARTITION BY query_id, unit_id // 1000 ORDER BY unit_id) AS i FROM draft),
fold AS (
  SELECT query_id, place, i, unit_id, unit_id AS start FROM seq WHERE i = 1
  UNION ALL
  SELECT s.query_id, s.place, s.i, s.unit_id,
         CASE WHEN s.unit_id - f.unit_id <= 2 AND s.unit_id - f.start + 1 <= 12 THEN f.start ELSE s.unit_id END
  FROM fold f JOIN seq s ON s.query_id = f.query_id AND s.place = f.place AND s.i = f.i + 1),
rg AS (
  SELECT query_id, start, max(s.unit_id) AS stop, round(sum(score), 12) AS total, count(*) AS hits,
         list_sort(list_distinct(flatten(list(origins)))) AS origins
  FROM fold f JOIN seq s USING (query_id, place, i) GROUP BY 1, 2),
filled AS (
  SELECT query_id, start, list(u.unit_id ORDER BY u.unit_id) AS unit_ids FROM rg JOIN units u ON u.unit_id BETWEEN start AND stop
  GROUP BY 1, 2),
ranges AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY density DESC, agreement DESC, hits DESC, first_unit) - 1 AS "rank" FROM (
    SELECT query_id, start % 1000 AS "first", stop % 1000 AS "last", unit_ids, origins, hits, len(origins) AS agreement,
           round_even(total / sqrt(len(unit_ids)), 3) AS density, unit_ids[1] AS first_unit
    FROM rg JOIN filled USING (query_id, start))),
split AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY density DESC, agreement DESC, first_unit) - 1 AS kind_rank FROM (
    SELECT *, CASE WHEN agreement >= 2 AND row_number() OVER (PARTITION BY query_id, agreement >= 2 ORDER BY "rank") <= 8
              THEN 'must' ELSE 'should' END AS kind FROM ranges)
  QUALIFY kind = 'must' OR kind_rank < 12)
"""


@query("gold_scores", I.with_sql(*DRAFT_SQL) + """
SELECT query_id, unit_id, round_even(score, 6) AS score, array_to_string(origins, ',') AS origins FROM draft""")
def q_gold_scores(spark, sf):
    return draft_scores(spark, sf).select(
        "query_id", "unit_id", F.bround("score", 6).alias("score"), F.array_join("origins", ",").alias("origins"))


def draft_ranges(spark, sf) -> DataFrame:
    return E.gold_ranges(draft_scores(spark, sf), I.shelf_units(spark, sf))


@query("gold_ranges", I.with_sql(*DRAFT_SQL, RANGES_SQL).replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT query_id, "rank", first_unit, "first", "last", hits, agreement, density, array_to_string(unit_ids, ',') AS unit_ids,
       array_to_string(origins, ',') AS origins FROM ranges""")
def q_gold_ranges(spark, sf):
    return draft_ranges(spark, sf).select(
        "query_id", "rank", "first_unit", "first", "last", "hits", "agreement", "density",
        F.array_join("unit_ids", ",").alias("unit_ids"), F.array_join("origins", ",").alias("origins"))


@query("gold_split", I.with_sql(*DRAFT_SQL, RANGES_SQL).replace("WITH ", "WITH RECURSIVE ", 1)
       + 'SELECT query_id, kind, kind_rank, first_unit, "last", density FROM split')
def q_gold_split(spark, sf):
    return E.gold_split(draft_ranges(spark, sf)).select("query_id", "kind", "kind_rank", "first_unit", "last", "density")


@query("gold_invariants", I.with_sql(*DRAFT_SQL, RANGES_SQL, """
labelled AS (
  SELECT s.*, s.query_id % 4 > 0 AS two, w.collection AS own,
         CASE WHEN "rank" % 7 = 3 THEN 'primary' ELSE w.collection END AS label
  FROM split s LEFT JOIN works w ON w.work_id = first_unit // 1000000),
cs AS (SELECT unit_id // 1000 AS place, count(*) AS chapter_size FROM units GROUP BY 1),
pq AS (SELECT query_id, count(*) FILTER (kind = 'must') AS m, count(*) FILTER (kind = 'should') AS s, count(*) AS n,
              count(DISTINCT first_unit) AS d FROM split GROUP BY 1),
ku AS (SELECT query_id, unit_id, count(DISTINCT kind) AS k FROM (SELECT query_id, kind, unnest(unit_ids) AS unit_id FROM split) GROUP BY 1, 2)
""").replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT 'one_chapter' AS rule, count(*) FILTER (list_max(unit_ids) // 1000 <> list_min(unit_ids) // 1000) AS violations FROM split
UNION ALL SELECT 'whole_chapter', count(*) FILTER (len(unit_ids) >= coalesce(chapter_size, 0) AND coalesce(chapter_size, 0) <> 1) FROM split LEFT JOIN cs ON place = first_unit // 1000
UNION ALL SELECT 'sorted', count(*) FILTER (unit_ids <> list_sort(unit_ids)) FROM split
UNION ALL SELECT 'length', count(*) FILTER (list_max(unit_ids) - list_min(unit_ids) >= 12) FROM split
UNION ALL SELECT 'corroborated', count(*) FILTER (kind = 'must' AND agreement < 2 AND NOT coalesce(own = 'secondary', FALSE)) FROM labelled
UNION ALL SELECT 'unknown_origin', count(*) FILTER (len(origins) = 0 OR len(list_filter(origins, lambda o: o NOT IN ('topic', 'keyword'))) > 0) FROM split
UNION ALL SELECT 'collection_label', count(*) FILTER (label IS DISTINCT FROM own) FROM labelled
UNION ALL SELECT 'secondary_out_of_scope', count(*) FILTER (coalesce(own = 'secondary', FALSE) AND NOT two) FROM labelled
UNION ALL SELECT 'too_many_must', count(*) FILTER (m > 8) FROM pq
UNION ALL SELECT 'too_many_should', count(*) FILTER (s > 12) FROM pq
UNION ALL SELECT 'no_should', count(*) FILTER (s = 0) FROM pq
UNION ALL SELECT 'duplicates', count(*) FILTER (n <> d) FROM pq
UNION ALL SELECT 'must_in_should', count(*) FILTER (k > 1) FROM ku""")
def q_gold_invariants(spark, sf):
    """Every seventh range is labelled primary, a fourth of the questions read one collection, and one origin is unlisted."""
    key = F.col("unit_id")
    sizes = I.shelf_units(spark, sf).groupBy(CLASSIC.work(key).alias("work_id"), CLASSIC.chapter(key).alias("chapter")).agg(
        F.count(F.lit(1)).alias("chapter_size"))
    works = I.shelf_works(spark, sf).select("work_id", "collection")
    split = E.gold_split(draft_ranges(spark, sf)).drop("work_id", "chapter").withColumn("work_id", CLASSIC.work(F.col("first_unit")))
    gold = split.join(works, "work_id", "left").withColumn(
        "collection", F.when(F.col("rank") % 7 == 3, "primary").otherwise(F.col("collection"))).drop("work_id")
    scopes = gold.select("query_id").distinct().withColumn("both", F.col("query_id") % 4 > 0)
    return E.gold_invariants(gold, sizes, works, scopes, ("topic", "keyword"))


# --- result tables --------------------------------------------------------------------

RESULTS_SQL = """
results AS (
  SELECT 'm' || (user_id % 3) AS model, chr(CAST(65 + k % 7 AS INTEGER)) AS config, event_id % 40 AS question_id,
         CASE WHEN k % 11 <> 0 THEN k / 100 END AS r10, least(1.0::DOUBLE, k / 80) AS r25, least(1.0::DOUBLE, k / 60) AS r50,
         "value" AS seconds
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))
"""


def result_rows(spark, sf) -> DataFrame:
    """Every event as one result of a (model, configuration, question)."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    return table(spark, sf, "events").withColumn("k", k).select(
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.char(65 + F.col("k") % 7).alias("config"),
        (F.col("event_id") % 40).alias("question_id"), F.when(F.col("k") % 11 != 0, F.col("k") / 100).alias("r10"),
        F.least(F.lit(1.0), F.col("k") / 80).alias("r25"), F.least(F.lit(1.0), F.col("k") / 60).alias("r50"),
        F.col("value").alias("seconds"))


@query("config_report", I.with_sql(RESULTS_SQL) + """
SELECT model, config, config IN ('A', 'B', 'C') AS evidence, count(DISTINCT question_id) AS questions,
       round_even(avg(r10), 6) AS at_10, round_even(avg(r25), 6) AS at_25, round_even(avg(r50), 6) AS at_50,
       round_even(avg(seconds), 6) AS mean_seconds FROM results GROUP BY 1, 2""")
def q_config_report(spark, sf):
    return E.config_report(result_rows(spark, sf), ("A", "B", "C"))


@query("question_report", I.with_sql(RESULTS_SQL) + """
SELECT question_id, round_even(avg(r25) FILTER (model = 'm0'), 6) AS m0, round_even(avg(r25) FILTER (model = 'm1'), 6) AS m1,
       round_even(avg(r25) FILTER (model = 'm2'), 6) AS m2 FROM results WHERE config = 'C' GROUP BY 1""")
def q_question_report(spark, sf):
    return E.question_report(result_rows(spark, sf), "C", ["m0", "m1", "m2"])


# --- runs ----------------------------------------------------------------------------

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"


def run_rows(spark, sf) -> DataFrame:
    events = table(spark, sf, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("long"))
    k = F.col("k")
    return events.select(
        F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")).alias("run"), (F.col("event_id") % 40).alias("question_id"),
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "violation").otherwise("ok").alias("first_verdict"),
        F.when(F.col("event_type") == "error", F.when(k % 2 == 0, "ok").otherwise("violation")).alias("retry_verdict"),
        ((F.col("event_type") == "error") & (k % 2 == 1)).alias("fallback_used"), (k % 10 < 9).alias("structure_ok"),
        F.when(k % 7 != 0, k / 100).alias("precision"), F.when(k % 5 != 0, (100 - k) / 100).alias("coverage"),
        F.col("value").alias("wall_seconds"), (k % 6 + 2).alias("themes"),
        F.when(k == 13, 1).otherwise(0).cast("long").alias("fabrications"),
        (F.col("value") * 0.25).alias("search_seconds"), F.when(k % 4 != 0, F.col("value") * 0.5).alias("check_seconds"),
    )


RUNS_SQL = f"""
ev AS (SELECT *, {_K} AS k FROM events),
runs AS (
  SELECT 'r' || (user_id % 5) AS run, event_id % 40 AS question_id, event_id AS seq,
         CASE WHEN event_type = 'error' THEN 'violation' ELSE 'ok' END AS first_verdict,
         CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 'ok' ELSE 'violation' END END AS retry_verdict,
         event_type = 'error' AND k % 2 = 1 AS fallback_used, k % 10 < 9 AS structure_ok,
         CASE WHEN k % 7 <> 0 THEN k / 100.0::DOUBLE END AS precision, CASE WHEN k % 5 <> 0 THEN (100 - k) / 100.0::DOUBLE END AS coverage,
         value AS wall_seconds, k % 6 + 2 AS themes, CASE WHEN k = 13 THEN 1 ELSE 0 END AS fabrications,
         value * 0.25::DOUBLE AS search_seconds, CASE WHEN k % 4 <> 0 THEN value * 0.5::DOUBLE END AS check_seconds FROM ev),
summary AS (
  SELECT run, count(*) AS questions, round_even(avg(CASE WHEN first_verdict <> 'ok' THEN 1.0 ELSE 0 END), 6) AS violation_rate,
         round_even(avg(CASE WHEN retry_verdict IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS retry_rate,
         round_even(avg(CASE WHEN fallback_used THEN 1.0 ELSE 0 END), 6) AS fallback_rate,
         round_even(avg(CASE WHEN structure_ok THEN 1.0 ELSE 0 END), 6) AS structure_rate,
         round_even(avg(precision), 6) AS precision, round_even(avg(coverage), 6) AS coverage, max(wall_seconds) AS max_seconds,
         CAST(sum(fabrications) AS BIGINT) AS fabrications, round_even(median(wall_seconds), 6) AS median_seconds
  FROM runs GROUP BY 1),
tlist AS (
  SELECT run, string_agg(themes || 'x' || n, ',' ORDER BY themes) AS themes FROM (
    SELECT run, themes, count(*) AS n FROM runs GROUP BY 1, 2) GROUP BY 1)
"""


@query("last_run_wins", I.with_sql(RUNS_SQL) + """
SELECT run, question_id, seq, first_verdict, wall_seconds FROM runs
QUALIFY row_number() OVER (PARTITION BY run, question_id ORDER BY seq DESC) = 1""")
def q_last_run_wins(spark, sf):
    rows = run_rows(spark, sf).select("run", "question_id", "seq", "first_verdict", "wall_seconds")
    return E.last_run_wins(rows, ["run", "question_id"], "seq")


@query("run_summary", I.with_sql(RUNS_SQL) + "SELECT * FROM summary JOIN tlist USING (run)")
def q_run_summary(spark, sf):
    return E.run_summary(run_rows(spark, sf))


@query("gates", I.with_sql(RUNS_SQL, """
g AS (
  SELECT run, CAST(substr(run, 2) AS BIGINT) AS size, violation_rate <= 0.205 AS pass_violations, fallback_rate < 0.11 AS pass_fallback,
         structure_rate >= 0.85 AS pass_structure, median_seconds <= 180 AS pass_median, max_seconds <= 500 AS pass_max FROM summary),
p AS (SELECT *, pass_violations AND pass_fallback AND pass_structure AND pass_median AND pass_max AS passes FROM g),
o AS (SELECT run, row_number() OVER (ORDER BY size, run) AS i FROM p WHERE passes)""") + """
SELECT p.*, CASE i WHEN 1 THEN 'fallback' WHEN 2 THEN 'default' ELSE 'none' END AS role FROM p LEFT JOIN o USING (run)""")
def q_gates(spark, sf):
    """Thresholds close to the rates of these runs, so that some pass and some fail."""
    summaries = E.run_summary(run_rows(spark, sf)).withColumn("size", F.substring("run", F.lit(2), F.length("run")).cast("long"))
    return E.gates(summaries, {
        "violations": F.col("violation_rate") <= 0.205, "fallback": F.col("fallback_rate") < 0.11,
        "structure": F.col("structure_rate") >= 0.85, "median": F.col("median_seconds") <= 180,
        "max": F.col("max_seconds") <= 500,
    })


_METRICS = ["violation_rate", "retry_rate", "fallback_rate", "precision", "coverage", "median_seconds", "max_seconds"]


@query("run_delta", I.with_sql(RUNS_SQL, f"""
l AS (SELECT run, metric, value FROM (SELECT run, {', '.join(_METRICS)} FROM summary) UNPIVOT (value FOR metric IN ({', '.join(_METRICS)})))""") + """
SELECT l.run, metric, l.value, b.value AS base, round_even(l.value - b.value, 6) AS delta FROM l JOIN (
  SELECT metric, value FROM l WHERE run = 'r0') b USING (metric)""")
def q_run_delta(spark, sf):
    return E.run_delta(E.run_summary(run_rows(spark, sf)), _METRICS, "r0")


@query("stage_latency", I.with_sql(RUNS_SQL, """
l AS (
  SELECT run, 'wall_seconds' AS stage, wall_seconds AS s FROM runs UNION ALL SELECT run, 'search_seconds', search_seconds FROM runs
  UNION ALL SELECT run, 'check_seconds', check_seconds FROM runs WHERE check_seconds IS NOT NULL)""") + """
SELECT run, stage, count(*) AS n, round_even(sum(s), 4) AS total, round_even(median(s), 6) AS median, max(s) AS max FROM l GROUP BY 1, 2""")
def q_stage_latency(spark, sf):
    return E.stage_latency(run_rows(spark, sf), ["wall_seconds", "search_seconds", "check_seconds"], ["run"])


@query("parity_diff", I.with_sql(I.QVEC_SQL, I.VECTORS_SQL, P._top_sql("utop", "uvec", 40), """
a AS (SELECT query_id, pos, key AS unit_id, score FROM utop WHERE pos < 38),
b AS (
  SELECT query_id, pos, CASE WHEN (key + query_id) % 29 = 0 THEN key + 1 ELSE key END AS unit_id,
         score + CASE WHEN (key + query_id) % 31 = 0 THEN 2e-5 ELSE 1e-6 END AS score FROM utop
  WHERE pos < 40 - query_id % 3),
m AS (
  SELECT query_id, pos, a.unit_id AS au, b.unit_id AS bu, CASE WHEN a.unit_id IS NULL OR b.unit_id IS NULL THEN 'length'
         WHEN a.unit_id <> b.unit_id THEN 'unit_id' WHEN abs(a.score - b.score) > 1e-5 THEN 'score' END AS field
  FROM a FULL JOIN b USING (query_id, pos))""") + """
SELECT query_id, count(au) AS n_left, count(bu) AS n_right, count(field) AS n_mismatch, min(pos) FILTER (field IS NOT NULL) AS first_rank,
       arg_min(field, pos) FILTER (field IS NOT NULL) AS first_field FROM m GROUP BY 1""")
def q_parity_diff(spark, sf):
    """A ranking against a copy with planted differences."""
    from quillspan.operators.vector import vector_topk

    top = vector_topk(I.shelf_question_vectors(spark, sf), I.unit_vectors(spark, sf), 40).withColumns(
        {"origins": F.lit("vector-unit"), "collection": F.lit("primary")})
    key, case = F.col("key"), F.col("query_id")
    left = top.where("pos < 38").withColumnRenamed("key", "unit_id")
    right = top.where(F.col("pos") < 40 - case % 3).withColumn(
        "unit_id", F.when((key + case) % 29 == 0, key + 1).otherwise(key)).withColumn(
        "score", F.col("score") + F.when((key + case) % 31 == 0, 2e-5).otherwise(1e-6))
    return E.parity_diff(left, right, "query_id", "pos")
