"""Published presentation, embedding-preparation and profile queries."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.keys import CLASSIC, WIDE
from quillspan.functions.refs import reference
from quillspan.operators import embedprep, present, quality
from quillspan.plans import inputs as I
from quillspan.plans import references as R
from quillspan.plans import retrieval as P
from quillspan.plans.registry import query
from quillspan.session import checkpoint_dir, stored
from quillspan.sources.tables import table

_REF = """abbrev || ' ' || chapter || ':' || "first" || CASE WHEN "first" = "last" THEN '' ELSE '-' || "last" END"""
NAMED_SQL = f"""
named AS (SELECT p.*, collection, {_REF} AS reference FROM passages p JOIN works USING (work_id))
"""
PRIMARY_SQL = (*P.PASSAGES_SQL, NAMED_SQL)


def named(found: DataFrame, works: DataFrame) -> DataFrame:
    joined = found.join(works.select("work_id", "abbrev", "collection"), "work_id")
    return joined.withColumn("reference", reference(F.col("abbrev"), F.col("chapter"), F.col("first"), F.col("last")))


def named_passages(spark, sf, mode: str = "primary") -> DataFrame:
    return named(P.passages(spark, sf, mode), I.shelf_works(spark, sf))


def _topic_hits(spark, sf) -> DataFrame:
    from quillspan.operators.vector import vector_topk

    top = vector_topk(I.shelf_question_vectors(spark, sf), I.topic_vectors(spark, sf), 5)
    return top.withColumnRenamed("key", "topic_id")


HELD_SQL = """
held AS (
  SELECT DISTINCT p.query_id, t.key AS topic_id, t.pos AS topic_rank, p."rank", p.first_unit, p.reference
  FROM (SELECT *, unnest(unit_ids) AS unit_id FROM named) p JOIN tunits m USING (unit_id)
  JOIN ttop t ON t.query_id = p.query_id AND t.key = m.topic_id)
"""


@query("matched_topics", I.with_sql(*PRIMARY_SQL, I.TOPICS_SQL, HELD_SQL) + """
SELECT t.query_id, t.pos, t.key AS topic_id, heading, 'Matter of group ' || t.key AS heading_display,
       (SELECT count(*) FROM tunits m WHERE m.topic_id = t.key) AS size, round_even(t.score, 4) AS score, coalesce(r, '') AS refs
FROM ttop t JOIN topics ON topics.topic_id = t.key LEFT JOIN (
  SELECT query_id, topic_id, string_agg(reference, '|' ORDER BY first_unit) AS r FROM held GROUP BY 1, 2) h
  ON h.query_id = t.query_id AND h.topic_id = t.key""")
def q_matched_topics(spark, sf):
    hits, members = _topic_hits(spark, sf), I.topic_units(spark, sf)
    held = present.topic_passages(hits, named_passages(spark, sf), members)
    found = present.matched_topics(hits, held, I.topics(spark, sf), members)
    return found.withColumn("refs", F.array_join("references", "|")).drop("references")


@query("topic_roots", """
WITH RECURSIVE t AS (
  SELECT 'customer-' || c_custkey AS id, 'nation-' || c_nationkey AS up, c_name AS heading FROM customer
  UNION ALL SELECT 'nation-' || n_nationkey, 'region-' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 'region-' || r_regionkey, NULL, r_name FROM region),
walk AS (
  SELECT id, id AS at, 0 AS n FROM t
  UNION ALL SELECT w.id, t.up, n + 1 FROM walk w JOIN t ON t.id = w.at WHERE t.up IS NOT NULL AND n < 16)
SELECT w.id AS topic_id, arg_max(w.at, n) AS root_id, arg_max(t.heading, n) AS root_heading
FROM walk w JOIN t ON t.id = w.at GROUP BY 1""")
def q_topic_roots(spark, sf):
    node = lambda kind, key: F.concat(F.lit(f"{kind}-"), F.col(key).cast("string"))
    tree = reduce(DataFrame.unionByName, [
        table(spark, sf, "customer").select(node("customer", "c_custkey").alias("topic_id"),
                                            node("nation", "c_nationkey").alias("parent_id"), F.col("c_name").alias("heading")),
        table(spark, sf, "nation").select(node("nation", "n_nationkey").alias("topic_id"),
                                          node("region", "n_regionkey").alias("parent_id"), F.col("n_name").alias("heading")),
        table(spark, sf, "region").select(node("region", "r_regionkey").alias("topic_id"),
                                          F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("heading")),
    ])
    return present.topic_roots(tree)


@query("topic_groups", I.with_sql(*PRIMARY_SQL, I.TOPICS_SQL, HELD_SQL, """
claim AS (
  SELECT query_id, "rank", first_unit, reference, arg_min(topic_id, topic_rank) AS topic_id, min(topic_rank) AS tr FROM held GROUP BY 1, 2, 3, 4),
parts AS (
  SELECT query_id, parent_id AS root_id, tr, 'Matter of group ' || c.topic_id AS sub, string_agg(reference, '|' ORDER BY first_unit) AS refs
  FROM claim c JOIN leaf USING (topic_id) GROUP BY 1, 2, 3, 4),
subs AS (
  SELECT a.*, EXISTS (SELECT 1 FROM parts b WHERE b.query_id = a.query_id AND b.root_id = a.root_id AND b.tr < a.tr AND contains(b.sub, a.sub)) AS known
  FROM parts a),
grp AS (
  SELECT query_id, min(tr) AS fr, root_id, 'Root ' || root_id AS heading,
         coalesce(string_agg(sub, '; ' ORDER BY tr) FILTER (NOT known), '') AS sub_label, string_agg(refs, '|' ORDER BY tr) AS refs
  FROM subs GROUP BY query_id, root_id
  UNION ALL
  SELECT query_id, 2147483648, NULL, 'Other passages', '', string_agg(reference, '|' ORDER BY first_unit) FROM named n
  WHERE NOT EXISTS (SELECT 1 FROM claim c WHERE c.query_id = n.query_id AND c."rank" = n."rank") GROUP BY 1)""") + """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY fr) - 1 AS group_no, root_id, heading, sub_label, refs FROM grp""")
def q_topic_groups(spark, sf):
    found, topics = named_passages(spark, sf), I.topics(spark, sf)
    held = present.topic_passages(_topic_hits(spark, sf), found, I.topic_units(spark, sf))
    groups = present.topic_groups(held, found, topics, present.topic_roots(topics))
    return groups.withColumn("refs", F.array_join("references", "|")).drop("references")


_CITED = '(query_id * 7 + "rank" * 3) % 5 < 2 AND "rank" < 25'


@query("work_groups", I.with_sql(*PRIMARY_SQL) + f"""
SELECT query_id, work_id, count(*) AS n_passages, count(*) FILTER ({_CITED}) AS n_cited,
       string_agg(reference, '|' ORDER BY first_unit) AS refs FROM named GROUP BY 1, 2""")
def q_work_groups(spark, sf):
    cited = ((F.col("query_id") * 7 + F.col("rank") * 3) % 5 < 2) & (F.col("rank") < 25)
    groups = present.work_groups(named_passages(spark, sf).withColumn("cited", cited))
    return groups.withColumn("refs", F.array_join("references", "|")).drop("references")


@query("chapter_nav", I.with_sql(I.CORPUS_WORKS_SQL, I.CORPUS_UNITS_SQL, """
own AS (SELECT DISTINCT work_id, chapter AS doc FROM cunits),
num AS (SELECT work_id, doc, row_number() OVER (PARTITION BY work_id ORDER BY doc) AS chapter FROM own),
ch AS (
  SELECT u.work_id, n.chapter, count(*) AS n_units FROM cunits u JOIN num n ON n.work_id = u.work_id AND n.doc = u.chapter GROUP BY 1, 2),
ends AS (SELECT work_id, max(chapter) AS last FROM ch GROUP BY 1),
rd AS (
  SELECT work_id, lag(work_id) OVER (ORDER BY work_id) AS pw, lead(work_id) OVER (ORDER BY work_id) AS nw
  FROM cworks WHERE collection = 'primary' AND work_id IN (SELECT work_id FROM ends))""") + """
SELECT ch.work_id, ch.chapter, n_units, collection,
       CASE WHEN ch.chapter > 1 THEN ch.work_id * 1000000000 + ch.chapter - 1 ELSE pw * 1000000000 + pe.last END AS previous,
       CASE WHEN ch.chapter < e.last THEN ch.work_id * 1000000000 + ch.chapter + 1 ELSE nw * 1000000000 + 1 END AS following
FROM ch JOIN ends e USING (work_id) JOIN cworks USING (work_id) LEFT JOIN rd USING (work_id) LEFT JOIN ends pe ON pe.work_id = pw""")
def q_chapter_nav(spark, sf):
    """Chapters numbered 1, 2, 3 … within each source, stepping through the primary sources."""
    from quillspan.operators.ordering import numbered_within

    units = I.corpus_units(spark, sf).withColumnRenamed("chapter", "doc")
    chapters = numbered_within(units.select("work_id", "doc").distinct(), "work_id", "doc", "chapter")
    numbered = units.join(chapters, ["work_id", "doc"])
    return present.chapter_navigation(numbered, I.corpus_works(spark, sf), "primary", WIDE)


@query("pack_passages", I.with_sql(*P.BOTH_PASSAGES_SQL, """
body AS (
  SELECT query_id, cut_pos, string_agg(text, ' ' ORDER BY unit_id) AS body FROM (
    SELECT query_id, cut_pos, unnest(unit_ids) AS unit_id FROM cut) JOIN units USING (unit_id) GROUP BY 1, 2)""") + f"""
SELECT query_id, count(*) AS n_sent, string_agg('[P' || (cut_pos + 1) || '] ' || {_REF}
         || CASE WHEN collection = 'secondary' THEN ' (Deuterocanon)' ELSE '' END || chr(10) || coalesce(body, ''), chr(10) || chr(10) ORDER BY cut_pos) AS prompt
FROM cut LEFT JOIN body USING (query_id, cut_pos) GROUP BY 1""")
def q_pack_passages(spark, sf):
    cut = P.both_cut(spark, sf)
    cut = cut.withColumn("reference", reference(F.col("abbrev"), F.col("chapter"), F.col("first"), F.col("last")))
    return present.pack_passages(cut, I.shelf_units(spark, sf), ["query_id"])


BATCH_BUDGET = 24_000


@query("batch_packing", I.with_sql(*PRIMARY_SQL, """
sized AS (
  SELECT query_id, first_unit, CAST(sum(length(text) + 1) - 1 + any_value(length(reference)) + 16 AS BIGINT) AS size FROM (
    SELECT query_id, first_unit, reference, unnest(unit_ids) AS unit_id FROM named) JOIN units USING (unit_id) GROUP BY 1, 2),
seq AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_unit) AS i FROM sized),
fold AS (
  SELECT query_id, i, first_unit, size, 0 AS batch_no, size AS used FROM seq WHERE i = 1
  UNION ALL
  SELECT s.query_id, s.i, s.first_unit, s.size, CASE WHEN f.used + s.size > 24000 THEN f.batch_no + 1 ELSE f.batch_no END,
         CASE WHEN f.used + s.size > 24000 THEN s.size ELSE f.used + s.size END
  FROM fold f JOIN seq s ON s.query_id = f.query_id AND s.i = f.i + 1)""").replace("WITH ", "WITH RECURSIVE ", 1)
       + "SELECT query_id, first_unit, batch_no, size FROM fold")
def q_batch_packing(spark, sf):
    found = named_passages(spark, sf)
    keys = ["query_id", "first_unit"]
    sized = present.passage_sizes(found, I.shelf_units(spark, sf), [*keys, "reference"]).select(
        *keys, (F.col("n_chars") + F.length("reference") + present.PASSAGE_OVERHEAD).cast("long").alias("size"))
    return present.batch_packing(sized, ["query_id"], ["first_unit"], BATCH_BUDGET)


ANSWERS_SQL = (*P.BOTH_PASSAGES_SQL, """
bp AS (
  SELECT p.*, w.collection, '[P' || (c.cut_pos + 1) || ']' AS token FROM passages p JOIN works w USING (work_id)
  LEFT JOIN cut c USING (query_id, "rank")),
txt AS (SELECT query_id, CASE WHEN query_id % 3 <> 2 THEN
    ['[P' || (query_id % 7 + 1) || ']', '[P' || (query_id % 11 + 20) || ']', '[P' || (query_id % 5 + 26) || ']'] END AS toks FROM qvec),
mk AS (SELECT bp.*, toks, coalesce(list_contains(toks, token), FALSE) AS c FROM bp JOIN txt USING (query_id))""")


def answers(spark, sf) -> DataFrame:
    """Nested answers that cite three tokens each, every third one a fallback."""
    from quillspan.operators.fusion import top_cut

    located = stored(P.passages(spark, sf, "both").join(I.shelf_works(spark, sf), "work_id"), "passages")  # read twice
    tokens = top_cut(located, ["query_id"], "both").select(
        "query_id", "rank", F.concat(F.lit("[P"), (F.col("cut_pos") + 1).cast("string"), F.lit("]")).alias("token"))
    named_ = located.withColumn("reference", reference(F.col("abbrev"), F.col("chapter"), F.col("first"), F.col("last")))
    q = F.col("query_id")
    token = lambda n: F.concat(F.lit(" [P"), n.cast("string"), F.lit("]"))
    synopsis = F.concat(F.lit("One"), token(q % 7 + 1), token(q % 11 + 20), token(q % 5 + 26))
    texts = I.shelf_question_vectors(spark, sf).select(
        "query_id", F.when(q % 3 != 2, synopsis).alias("synopsis"), F.lit("listing").alias("fallback"))
    return present.assemble_answers(texts, named_.join(tokens, ["query_id", "rank"], "left"))


@query("assemble_answers", I.with_sql(*ANSWERS_SQL) + """
SELECT query_id, any_value(toks) IS NULL AS fallback_used, coalesce(array_to_string(list_sort(list_distinct(any_value(toks))), ','), '') AS cited_tokens,
       coalesce(array_to_string(list_sort(list_distinct(flatten(list(unit_ids) FILTER (c)))), ','), '') AS cited_unit_ids,
       count(token) AS sent_count, bool_or(c AND collection = 'secondary') AS secondary_cited, count(*) AS n_passages,
       bool_or(c AND collection = 'secondary') AS has_footer FROM mk GROUP BY 1""")
def q_assemble_answers(spark, sf):
    return answers(spark, sf).select(
        "query_id", "fallback_used", F.array_join("cited_tokens", ",").alias("cited_tokens"),
        F.array_join("cited_unit_ids", ",").alias("cited_unit_ids"), "sent_count", "secondary_cited",
        F.size("passages").cast("long").alias("n_passages"), F.col("footer").isNotNull().alias("has_footer"))


@query("history_append", I.with_sql(*ANSWERS_SQL) + """
SELECT query_id AS id, CASE WHEN any_value(toks) IS NULL THEN 'listing'
         ELSE 'One ' || array_to_string(any_value(toks), ' ') END AS answer,
       count(token) AS n_passages, CAST(coalesce(sum(len(unit_ids)) FILTER (token IS NOT NULL), 0) AS BIGINT) AS n_units,
       '[' || coalesce(array_to_string(list_sort(list_distinct(flatten(list(unit_ids) FILTER (c)))), ','), '') || ']' AS cited_ids,
       CASE WHEN any_value(toks) IS NULL THEN 'fallback' ELSE 'ok' END AS verdict, any_value(toks) IS NULL AS fallback_used,
       '{"search":' || CAST(CAST(query_id AS DOUBLE) * 0.25 AS VARCHAR) || '}' AS timings FROM mk GROUP BY query_id""")
def q_history_append(spark, sf):
    """Assembled answers become stored entries, with timings and verdict, and are read back."""
    from quillspan.operators import history as H
    from quillspan.session import checkpoint_dir

    made = answers(spark, sf).select(
        "*", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("asked_at"), F.lit("q").alias("question"), F.lit("both").alias("mode"),
        F.lit("m0").alias("model_id"), F.lit("0.1.0").alias("index_version"), F.lit(False).alias("flagged"),
        F.create_map(F.lit("search"), F.col("query_id") * F.lit(0.25)).alias("timings"),
        F.when(F.col("fallback_used"), "fallback").otherwise("ok").alias("verdict"))
    path = f"{checkpoint_dir(spark)}/entries-{uuid.uuid4().hex}"
    H.append_answers(H.answer_rows(made), path)
    entries = spark.read.parquet(path)
    lists = H.passage_lists(F.col("passage_ids"))
    return entries.select(
        "id", "answer", F.size(lists).cast("long").alias("n_passages"), F.size(F.flatten(lists)).cast("long").alias("n_units"),
        "cited_ids", "verdict", "fallback_used", "timings")


# --- embedding preparation ----------------------------------------------------------

SPLIT_BUDGET = 600


@query("split_blocks", I.with_sql(I.CORPUS_WORKS_SQL, I.CORPUS_UNITS_SQL, I.CORPUS_BLOCKS_SQL, f"""
seq AS (
  SELECT u.work_id, u.chapter, u.block_no, ordinal, length(text) AS size, {SPLIT_BUDGET} AS budget,
         length(abbrev) + length(CAST(u.chapter AS VARCHAR)) + 4 + coalesce(length(heading) + 3, 0) AS fixed,
         row_number() OVER (PARTITION BY u.work_id, u.chapter, u.block_no ORDER BY ordinal) AS i
  FROM cunits u JOIN cworks USING (work_id) JOIN cblocks b ON b.work_id = u.work_id AND b.chapter = u.chapter AND b.block_no = u.block_no),
fold AS (
  SELECT work_id, chapter, block_no, i, ordinal, 0 AS part, ordinal AS lo, size AS texts, fixed + 2 * len(ordinal::VARCHAR) + size AS cost FROM seq WHERE i = 1
  UNION ALL
  SELECT s.work_id, s.chapter, s.block_no, s.i, s.ordinal, CASE WHEN ok THEN f.part ELSE f.part + 1 END, CASE WHEN ok THEN lo ELSE s.ordinal END,
         CASE WHEN ok THEN texts + size + 1 ELSE size END,
         CASE WHEN ok THEN fixed + len(lo::VARCHAR) + len(s.ordinal::VARCHAR) + texts + size + 1 ELSE fixed + 2 * len(s.ordinal::VARCHAR) + size END
  FROM (SELECT f.*, s.size, s.fixed, s.ordinal AS so, s.i AS si,
               s.fixed + len(lo::VARCHAR) + len(s.ordinal::VARCHAR) + texts + s.size + 1 <= s.budget AS ok
        FROM fold f JOIN seq s ON s.work_id = f.work_id AND s.chapter = f.chapter AND s.block_no = f.block_no AND s.i = f.i + 1) f
  JOIN seq s ON s.work_id = f.work_id AND s.chapter = f.chapter AND s.block_no = f.block_no AND s.i = f.si)""".replace(
    "texts + size + 1", "texts + s.size + 1").replace("ELSE size END", "ELSE s.size END").replace("ELSE fixed", "ELSE s.fixed")
    .replace("THEN fixed", "THEN s.fixed").replace("+ size ELSE", "+ s.size ELSE").replace("s.ordinal::VARCHAR) + size END", "s.ordinal::VARCHAR) + s.size END")
).replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT work_id, chapter, block_no, CAST(part AS BIGINT) AS part, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal,
       count(*) AS n_units, CAST(max(cost) AS BIGINT) AS cost FROM fold GROUP BY 1, 2, 3, 4""")
def q_split_blocks(spark, sf):
    keys = ["work_id", "chapter", "block_no"]
    units = I.corpus_units(spark, sf).join(I.corpus_works(spark, sf).select("work_id", "abbrev"), "work_id")
    return embedprep.split_blocks(units, I.corpus_blocks(spark, sf), keys, F.lit(SPLIT_BUDGET))


# Longest input of each model, in characters.
MODEL_LIMITS = {"initials-16": 8_000}


def initials_embedding(texts: list[str], dim: int = 16) -> np.ndarray:
    """A repeatable stand-in for a model: counts of words by their first character."""
    out = np.zeros((len(texts), dim))
    for row, text in enumerate(texts):
        for word in text.replace("\n", " ").split(" "):
            if word:
                out[row, ord(word[0]) % dim] += 1.0
    return out


@query("embed_batch", I.with_sql(I.CORPUS_WORKS_SQL, I.CORPUS_UNITS_SQL, I.CORPUS_BLOCKS_SQL, """
t AS (
  SELECT u.unit_id, left('doc: ' || abbrev || ' ' || u.chapter || ':' || ordinal ||
         CASE WHEN heading IS NULL THEN '' ELSE ' — ' || heading END || chr(10) || text, 8000) AS text
  FROM cunits u JOIN cworks USING (work_id) LEFT JOIN cblocks b
    ON b.work_id = u.work_id AND b.chapter = u.chapter AND b.block_no = u.block_no),
w AS (
  SELECT unit_id, list_transform(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> ''),
           lambda x: unicode(x) % 16) AS slots FROM t),
v AS (SELECT unit_id, list_transform(range(0, 16), lambda d: CAST(len(list_filter(slots, lambda s: s = d)) AS DOUBLE)) AS n FROM w)""") + """
SELECT 'initials-16' AS model_id, 'unit' AS kind, unit_id AS key, CAST(0 AS BIGINT) AS part, CAST(16 AS BIGINT) AS dim,
       list_transform(n, lambda x: CAST(x / sqrt(list_sum(list_transform(n, lambda y: y * y))) AS FLOAT)) AS vec FROM v""")
def q_embed_batch(spark, sf):
    texts = embedprep.unit_templates(I.corpus_units(spark, sf), I.corpus_works(spark, sf), I.corpus_blocks(spark, sf),
                                     ["work_id", "chapter", "block_no"])
    rows = texts.select(F.lit("unit").alias("kind"), F.col("unit_id").alias("key"), F.lit(0).cast("long").alias("part"), "text")
    model = "initials-16"
    return embedprep.embed_batch(rows, initials_embedding, model, prefix="doc: ", max_chars=MODEL_LIMITS[model])


@query("vector_drift", """
WITH p AS (
  SELECT CAST(embedding AS DOUBLE[]) AS a,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN vec_id % 3 = 0 THEN x ELSE x * 1.001 + 0.0001 END) AS b FROM embeddings)
SELECT count(*) AS n, round_even(max(list_max(list_transform(a, lambda x, i: abs(x - b[i])))), 9) AS max_abs_diff,
       round_even(min(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))), 9) AS min_cosine,
       count(*) FILTER (a = b) AS identical FROM p""")
def q_vector_drift(spark, sf):
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vec"))
    moved = vecs.select("key", F.transform("vec", lambda x: F.when(F.col("key") % 3 == 0, x).otherwise(x * 1.001 + 0.0001)).alias("vec"))
    drift = embedprep.vector_drift(vecs, moved)
    return drift.withColumns({c: F.bround(c, 9) for c in ("max_abs_diff", "min_cosine")})


@query("block_size_profile", I.with_sql(I.CORPUS_WORKS_SQL, I.CORPUS_UNITS_SQL, I.CORPUS_BLOCKS_SQL, """
sz AS (
  SELECT w.era || ' ' || w.collection AS grp, b.n_units, b.n_chars FROM (
    SELECT work_id, chapter, block_no, count(*) AS n_units, CAST(sum(length(text) + 1) - 1 AS BIGINT) AS n_chars FROM cunits GROUP BY 1, 2, 3) b
  JOIN cworks w USING (work_id)),
l AS (
  SELECT grp, 'units' AS what, n_units AS v, 4 AS budget FROM sz UNION ALL SELECT grp, 'tokens', n_chars // 4, 4 FROM sz
  UNION ALL SELECT 'ALL', 'units', n_units, 4 FROM sz UNION ALL SELECT 'ALL', 'tokens', n_chars // 4, 4 FROM sz),
o AS (SELECT grp, what, list_sort(list(v)) AS s, count(*) FILTER (v > CASE what WHEN 'units' THEN 4 ELSE 150 END) AS over_budget FROM l GROUP BY 1, 2)""") + """
SELECT grp, what, len(s) AS n, s[1] AS min, CAST(floor(list_median(s)) AS BIGINT) AS median,
       s[CAST(least(len(s) - 1, floor(0.9 * len(s))) AS BIGINT) + 1] AS p90, s[-1] AS max, over_budget FROM o""")
def q_block_size_profile(spark, sf):
    works = I.corpus_works(spark, sf).select("work_id", F.concat("era", F.lit(" "), "collection").alias("grp"))
    sized = I.corpus_units(spark, sf).groupBy("work_id", "chapter", "block_no").agg(
        F.count(F.lit(1)).alias("units"), (F.sum(F.length("text") + 1) - 1).alias("chars")).join(works, "work_id")
    rows = sized.select(F.explode(F.array("grp", F.lit("ALL"))).alias("grp"), "units",
                        F.call_function("div", "chars", F.lit(embedprep.CHARS_PER_TOKEN)).alias("tokens"))
    one = lambda what, budget: embedprep.size_profile(
        rows.select("grp", F.lit(what).alias("what"), F.col(what).alias("v")), ["grp", "what"], "v", budget)
    return one("units", 4).unionByName(one("tokens", 150))


@query("vector_store_report", """
SELECT *, CASE WHEN model_id = 'model-0' THEN vectors_before ELSE 0 END AS vectors_after,
       CASE WHEN model_id = 'model-0' THEN bytes_before ELSE 0 END AS bytes_after FROM (
  SELECT model_id, kind, count(*) AS vectors_before, CAST(sum(len(embedding) * 4) AS BIGINT) AS bytes_before FROM (
    SELECT embedding, 'model-' || (label % 3) AS model_id, CASE WHEN label < 7 THEN 'unit' ELSE 'block' END AS kind
    FROM embeddings) GROUP BY 1, 2)""")
def q_vector_store_report(spark, sf):
    """A store of three models is written and cut down to one; the report joins what stood there with what stands now."""
    from quillspan.sources import vectorstore

    rows = table(spark, sf, "embeddings").select(
        F.concat(F.lit("model-"), (F.col("label") % 3).cast("string")).alias("model_id"),
        F.when(F.col("label") < 7, "unit").otherwise("block").alias("kind"), F.col("vec_id").alias("key"),
        F.lit(0).cast("long").alias("part"), F.size("embedding").cast("long").alias("dim"), F.col("embedding").alias("vec"))
    folder = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    vectorstore.replace_vectors(rows, f"{folder}/all")
    return vectorstore.retain_model(spark, f"{folder}/all", f"{folder}/kept", "model-0")


@query("embed_resume", """
SELECT 'first run' AS run, count(*) AS written FROM documents WHERE text IS NOT NULL AND doc_id % 3 > 0
UNION ALL SELECT 'second run', count(*) FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0
UNION ALL SELECT 'third run', 0
UNION ALL SELECT 'stored', count(*) FROM documents WHERE text IS NOT NULL""")
def q_embed_resume(spark, sf):
    """An embedding job that was stopped after two thirds of the documents, goes on, and is then started once more."""
    from quillspan.sources import vectorstore

    store = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select(
        F.lit("unit").alias("kind"), F.col("doc_id").alias("key"), F.lit(0).cast("long").alias("part"), "text")
    runs = {"first run": docs.where("key % 3 > 0"), "second run": docs, "third run": docs}
    written = [(name, vectorstore.embed_missing(rows, store, initials_embedding, "initials-16")) for name, rows in runs.items()]
    counts = spark.createDataFrame(written, "run string, written long")
    held = vectorstore.read_store(spark, store).agg(F.count(F.lit(1)).alias("written"))
    return counts.unionByName(held.select(F.lit("stored").alias("run"), "written"))


# --- profiles and invariants -----------------------------------------------------------

SPOTS = [("SRC1", 2, 1), ("SRC2", 3, 1), ("SRC5", 6, 2), ("SRC3", 1, 1)]  # the last names no such place


@query("index_profile", I.with_sql(I.CORPUS_WORKS_SQL, I.CORPUS_UNITS_SQL, I.CORPUS_BLOCKS_SQL, I.EDGES_SQL, I.TOPICS_SQL,
                                   I.CITABLE_SQL, R.PLACES_SQL, R.CITE_SQL, f"""
bridged AS (SELECT *, CASE WHEN ordinal % 9 = 4 THEN ordinal + 1 END AS ordinal_end FROM cunits),
per AS (SELECT work_id, chapter, count(*) AS units, count(ordinal_end) AS bridges FROM bridged GROUP BY 1, 2),
loc AS (SELECT * FROM per JOIN cworks USING (work_id)),
blk AS (SELECT *, CASE WHEN heading IS NULL THEN 'paragraph' ELSE 'heading' END AS source FROM cblocks),
tmem AS (SELECT CAST(label AS BIGINT) + 1 AS topic_id, {I.sql_key('vec_id')} AS unit_id FROM embeddings),
spots AS (SELECT * FROM (VALUES {', '.join(str(p) for p in SPOTS)}) AS v(code, chapter, ordinal))""") + """
SELECT 'works' AS section, coalesce(collection, 'all') || '/' || coalesce(era, 'all') AS key, count(*) AS n FROM cworks
GROUP BY GROUPING SETS ((collection, era), (collection), ())
UNION ALL SELECT 'chapters', coalesce(collection, 'all') || '/' || coalesce(era, 'all'), count(*) FROM loc GROUP BY GROUPING SETS ((collection, era), (collection), ())
UNION ALL SELECT 'units', coalesce(collection, 'all') || '/' || coalesce(era, 'all'), CAST(sum(units) AS BIGINT) FROM loc GROUP BY GROUPING SETS ((collection, era), (collection), ())
UNION ALL SELECT 'bridges', coalesce(collection, 'all') || '/' || coalesce(era, 'all'), CAST(sum(bridges) AS BIGINT) FROM loc GROUP BY GROUPING SETS ((collection, era), (collection), ())
UNION ALL SELECT 'blocks', source, count(*) FROM blk GROUP BY 2
UNION ALL SELECT 'blocks', CASE WHEN heading IS NULL THEN 'without heading' ELSE 'with heading' END, count(*) FROM blk GROUP BY 2
UNION ALL SELECT 'blocks', 'works with heading', count(DISTINCT work_id) FROM blk WHERE heading IS NOT NULL
UNION ALL SELECT 'edges', 'all', count(*) FROM edges UNION ALL SELECT 'edges', 'sources', count(DISTINCT from_id) FROM edges
UNION ALL SELECT 'edges', 'targets', count(DISTINCT to_id) FROM edges
UNION ALL SELECT 'topics', CASE WHEN parent_id IS NULL THEN 'root' ELSE 'leaf' END, count(*) FROM topics GROUP BY 2
UNION ALL SELECT 'topics', 'members', count(*) FROM tmem UNION ALL SELECT 'topics', 'member units', count(DISTINCT unit_id) FROM tmem
UNION ALL SELECT 'topics', 'with members', count(DISTINCT topic_id) FROM tmem
UNION ALL SELECT 'unresolved', 'all', count(*) FROM bad UNION ALL SELECT 'unresolved', reason, count(*) FROM bad GROUP BY 2
UNION ALL SELECT 'spots', s.code || ' ' || s.chapter || ':' || s.ordinal, count(u.unit_id) FROM spots s
  LEFT JOIN (SELECT code, chapter, ordinal, unit_id FROM cunits JOIN cworks USING (work_id)) u
  ON u.code = s.code AND u.chapter = s.chapter AND u.ordinal = s.ordinal GROUP BY s.code, s.chapter, s.ordinal""")
def q_index_profile(spark, sf):
    """Lines 4, 13, 22 … count as bridges over the next; blocks have a heading or begin at a paragraph."""
    units = I.corpus_units(spark, sf).withColumn("ordinal_end", F.when(F.col("ordinal") % 9 == 4, F.col("ordinal") + 1))
    blocks = I.corpus_blocks(spark, sf).withColumn("source", F.when(F.col("heading").isNull(), "paragraph").otherwise("heading"))
    return quality.index_profile(
        I.corpus_works(spark, sf), units, blocks, I.edges(spark, sf), I.topics(spark, sf), I.topic_units(spark, sf),
        R.quarantined_citations(spark, sf), SPOTS)


@query("index_invariants", I.with_sql(I.CORPUS_WORKS_SQL, I.CORPUS_UNITS_SQL, I.CORPUS_BLOCKS_SQL) + """
SELECT 'key encodes its parts' AS rule, count(*) FILTER (unit_id // 100000000000000 <> work_id OR unit_id % 100000 <> ordinal) AS violations FROM cunits
UNION ALL SELECT 'text is not empty', count(*) FILTER (trim(text) = '') FROM cunits
UNION ALL SELECT 'no markup left', count(*) FILTER (regexp_matches(text, '<[^>]*>|\\\\[a-z]')) FROM cunits
UNION ALL SELECT 'text is short', count(*) FILTER (length(text) > 300) FROM cunits
UNION ALL SELECT 'bounds are ordered', count(*) FILTER (start_id > end_id) FROM cblocks
UNION ALL SELECT 'block is full', count(*) FILTER (n_units < 5) FROM cblocks
UNION ALL SELECT 'vector has 64 dims', count(*) FILTER (len(embedding) <> 64) FROM embeddings
UNION ALL SELECT 'vector has length one', count(*) FILTER (abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) >= 1e-3) FROM embeddings
UNION ALL SELECT 'document has a vector', count(*) FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)""")
def q_index_invariants(spark, sf):
    from quillspan.functions.vectors import norm

    key = F.col("unit_id")
    units = quality.count_violations(I.corpus_units(spark, sf), {
        "key encodes its parts": (WIDE.work(key) == F.col("work_id")) & (WIDE.ordinal(key) == F.col("ordinal")),
        "text is not empty": F.trim("text") != "", "no markup left": ~F.col("text").rlike(r"<[^>]*>|\\[a-z]"),
        "text is short": F.length("text") <= 300,
    })
    blocks = quality.count_violations(I.corpus_blocks(spark, sf), {
        "bounds are ordered": F.col("start_id") <= F.col("end_id"), "block is full": F.col("n_units") >= 5})
    vecs = table(spark, sf, "embeddings")
    vectors = quality.count_violations(vecs, {
        "vector has 64 dims": F.size("embedding") == 64, "vector has length one": F.abs(norm(F.col("embedding")) - 1) < 1e-3})
    cover = quality.dead_references({"document has a vector": (table(spark, sf, "documents"), "doc_id", vecs, "vec_id")})
    return reduce(DataFrame.unionByName, [units, blocks, vectors, cover])


@query("content_works", I.with_sql(I.CORPUS_WORKS_SQL) + """
SELECT work_id, code, collection, era, collection IN ('primary', 'secondary') AND era = 'early' AS known FROM cworks
WHERE code NOT IN ('SRC0', 'SRC13')""")
def q_content_works(spark, sf):
    """Two works count as front matter; only one era is on the list, so the others are reported."""
    kept = quality.content_works(I.corpus_works(spark, sf), ["SRC0", "SRC13"], ["primary", "secondary"], ["early"])
    return kept.select("work_id", "code", "collection", "era", "known")


@query("part_invariants", I.with_sql(I.CORPUS_UNITS_SQL, I.CORPUS_BLOCKS_SQL, """
parts AS (
  SELECT work_id, chapter, block_no, (ordinal - 1) % 5 // 2 AS part, min(unit_id) AS start_id,
         max(unit_id) + CASE WHEN chapter % 7 = 0 THEN 9 ELSE 0 END AS end_id FROM cunits GROUP BY 1, 2, 3, 4),
kept AS (SELECT * FROM cblocks WHERE chapter % 11 <> 0)""") + """
SELECT 'part lies in its block' AS rule, count(*) AS violations FROM parts p LEFT JOIN cblocks b
  ON b.work_id = p.work_id AND b.chapter = p.chapter AND b.block_no = p.block_no
WHERE NOT coalesce(p.start_id >= b.start_id AND p.end_id <= b.end_id, FALSE)
UNION ALL SELECT 'parts count from 0', count(*) FROM (
  SELECT min(part) AS lo, max(part) AS hi, count(DISTINCT part) AS n FROM parts GROUP BY work_id, chapter, block_no) WHERE lo <> 0 OR hi <> n - 1
UNION ALL SELECT 'unit is in a block', count(*) FROM cunits u WHERE NOT EXISTS (
  SELECT 1 FROM kept k WHERE k.work_id = u.work_id AND k.chapter = u.chapter AND u.unit_id BETWEEN k.start_id AND k.end_id)""")
def q_part_invariants(spark, sf):
    """Parts of two lines; those of every seventh chapter are stretched and every eleventh chapter's blocks are withheld."""
    keys = ["work_id", "chapter", "block_no"]
    units, blocks = I.corpus_units(spark, sf), I.corpus_blocks(spark, sf)
    part = F.call_function("div", (F.col("ordinal") - 1) % 5, F.lit(2).cast("long"))
    parts = units.groupBy(*keys, part.alias("part")).agg(F.min("unit_id").alias("start_id"), F.max("unit_id").alias("end_id"))
    parts = parts.withColumn("end_id", F.col("end_id") + F.when(F.col("chapter") % 7 == 0, 9).otherwise(0))
    return reduce(DataFrame.unionByName, [
        quality.outside_parent(parts, blocks, keys, "part lies in its block"),
        quality.not_from_zero(parts, keys, "parts count from 0"),
        quality.outside_all(units, blocks.where("chapter % 11 <> 0"), keys[:2], "unit is in a block"),
    ])
