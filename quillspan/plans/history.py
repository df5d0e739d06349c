"""Published history queries (events and conversations as entries) and streaming twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators import history as H
from quillspan.plans import inputs as I
from quillspan.plans import registry
from quillspan.plans import verification as V
from quillspan.plans.registry import query
from quillspan.session import checkpoint_dir, cut_lineage, remove_folder
from quillspan.session import stored as kept_table
from quillspan.sources.tables import table
from quillspan.streaming import jobs

CURRENT = "0.1.0"


def _json_ids(first: str, other: str) -> str:
    return (
        f"CASE WHEN event_id % 10 = 9 THEN concat('[', {other}, ',', {first} + 1, ',', {first}, ']') "
        f"ELSE concat('[[', {first}, ',', {first} + 1, '],[', {other}, ']]') END"
    )


def entries(spark, sf):
    """Every event as a stored answer over two passages of the shelf; every tenth in the old flat form."""
    events = table(spark, sf, "events")
    n = table(spark, sf, "documents").agg(F.count(F.lit(1))).scalar()
    placed = events.withColumn("d1", F.col("event_id") % n).withColumn("d2", (F.col("event_id") * 7 + 3) % n)
    # the first passage spans two units, so it starts below its chapter's end
    placed = placed.withColumn("d1", F.col("d1") - F.when(F.col("d1") % 20 == 19, 1).otherwise(0))
    keyed = placed.withColumn("k1", I.shelf_key(F.col("d1"))).withColumn("k2", I.shelf_key(F.col("d2")))
    return keyed.select(
        F.col("event_id").alias("id"), F.col("ts").alias("asked_at"), F.col("event_type").alias("question"),
        F.when(F.col("event_id") % 3 == 0, "both").otherwise("primary").alias("mode"),
        F.concat(F.lit("Rest [P1], then [P2] [P7]; "), "event_type").alias("answer"),
        F.expr(_json_ids("k1", "k2")).alias("passage_ids"),
        F.concat(F.lit("["), F.when(F.col("event_id") % 2 == 0, F.col("k1")).otherwise(F.col("k2")).cast("string"), F.lit("]")).alias("cited_ids"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model_id"),
        F.when(F.col("event_id") % 4 == 0, "0.0.9").otherwise(CURRENT).alias("index_version"),
        (F.col("event_type") == "error").alias("flagged"), "props",
    )


ENTRIES_SQL = f"""
pl AS (
  SELECT *, d - CASE WHEN d % 20 = 19 THEN 1 ELSE 0 END AS d1, (event_id * 7 + 3) % n AS d2 FROM (
    SELECT *, event_id % n AS d FROM events, (SELECT count(*) AS n FROM documents))),
kd AS (SELECT *, {I.sql_key('d1')} AS k1, {I.sql_key('d2')} AS k2 FROM pl),
entries AS (
  SELECT event_id AS id, ts AS asked_at, event_type AS question, CASE WHEN event_id % 3 = 0 THEN 'both' ELSE 'primary' END AS mode,
         'Rest [P1], then [P2] [P7]; ' || event_type AS answer, {_json_ids('k1', 'k2')} AS passage_ids,
         CASE WHEN event_id % 2 = 0 THEN k1 ELSE k2 END AS cited_id, 'm' || (user_id % 3) AS model_id,
         CASE WHEN event_id % 4 = 0 THEN '0.0.9' ELSE '{CURRENT}' END AS index_version, event_type = 'error' AS flagged, k1, k2, props
  FROM kd),
groups AS (
  SELECT id, 0 AS no, [k1, k1 + 1] AS g FROM entries WHERE id % 10 <> 9
  UNION ALL SELECT id, 1, [k2] FROM entries WHERE id % 10 <> 9
  UNION ALL
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY g[1]) - 1, g FROM (
    SELECT id, unnest(CASE WHEN k2 IN (k1, k1 + 1) THEN [[k1, k1 + 1]]
                           WHEN k2 = k1 + 2 AND k2 // 1000 = k1 // 1000 THEN [[k1, k1 + 1, k2]]
                           WHEN k2 = k1 - 1 AND k2 // 1000 = k1 // 1000 THEN [[k2, k1, k1 + 1]]
                           ELSE [[k1, k1 + 1], [k2]] END) AS g FROM entries WHERE id % 10 = 9)),
stored AS (
  SELECT g.id, no, CASE WHEN g.id % 10 <> 9 THEN '[P' || (no + 1) || ']' END AS token,
         abbrev || ' ' || ((g[1] // 1000) % 1000) || ':' || (g[1] % 1000) || CASE WHEN len(g) > 1 THEN '-' || (g[-1] % 1000) ELSE '' END AS reference,
         collection, g[1] AS first_unit, list_contains(g, cited_id) AS cited, index_version <> '{CURRENT}' AS stale, g
  FROM groups g JOIN entries e USING (id) JOIN works ON work_id = g[1] // 1000000)
"""
STORED_SQL = (I.WORKS_SQL, I.UNITS_SQL, ENTRIES_SQL, """
bodies AS (
  SELECT id, no, string_agg(text, ' ' ORDER BY u) AS body FROM (SELECT id, no, unnest(g) AS u FROM stored) JOIN units ON unit_id = u GROUP BY 1, 2)""")


def stored(spark, sf, body):
    """The passages of all entries; ``body`` as in ``stored_passages``."""
    return H.stored_passages(entries(spark, sf), I.shelf_works(spark, sf), I.shelf_units(spark, sf), CURRENT, body=body)


@query("history_page", I.with_sql(ENTRIES_SQL.replace("works", "(SELECT 1 AS work_id, '' AS abbrev, '' AS collection)"))
       + "SELECT id, question, mode FROM entries ORDER BY id DESC LIMIT 50 OFFSET 20")
def q_history_page(spark, sf):
    return H.page(entries(spark, sf).select("id", "question", "mode"), 50, 20)


TURNS = 1 << 20  # turns a conversation may have


def _turns(spark, sf):
    turns = table(spark, sf, "conversations")
    fits = F.col("turn").between(0, TURNS - 1)
    key = F.when(fits, F.col("conv_id") * TURNS + F.col("turn")).otherwise(F.raise_error(F.lit("a turn number does not fit its key")))
    return turns.select(key.cast("long").alias("id"), F.col("role").alias("question"), F.col("text").alias("answer"))


def history_index(spark, sf):
    """The stored postings of all turns, written once per application and folder."""
    name = (spark.sparkContext.applicationId, sf)
    if name not in _INDEXES:
        path = f"{checkpoint_dir(spark)}/history-{uuid.uuid4().hex}"
        H.write_postings(H.entry_postings(_turns(spark, sf)), path)
        _INDEXES[name] = path
    return spark.read.parquet(_INDEXES[name])


_INDEXES: dict[tuple[str, str], str] = {}


@query("history_search", f"""
WITH e AS (SELECT conv_id * {TURNS} + turn AS id, list_distinct({I.sql_words("role || ' ' || text")}) AS w FROM conversations),
p AS (SELECT id, unnest(w) AS word FROM e),
b AS (SELECT item_id, {I.sql_words('text')} AS w FROM benchmark),
s AS (
  SELECT item_id || '-' || i AS query_id, list_distinct([w[i + 1], w[i + 2]]) AS t FROM b, LATERAL (SELECT unnest(range(0, len(w) - 1)) AS i)
  UNION ALL SELECT item_id || '-', [] FROM b WHERE item_id % 10 = 9),
q AS (SELECT query_id, len(t) AS n, unnest(t) AS word FROM s),
f AS (
  SELECT query_id, id FROM q JOIN p USING (word) GROUP BY query_id, id, n HAVING count(*) = n
  UNION ALL SELECT query_id, id FROM s, e WHERE len(t) = 0)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id DESC) - 1 AS pos FROM f QUALIFY pos < 100""")
def q_history_search(spark, sf):
    """Every two neighbouring words of every benchmark item; a tenth of the items adds an empty search."""
    from quillspan.functions.text import words

    items = table(spark, sf, "benchmark").select("item_id", words(F.col("text")).alias("w"))
    item = F.col("item_id").cast("string")
    pairs = items.where(F.size("w") > 1).select("item_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 2)).alias("i")).select(
        F.concat_ws("-", item, F.col("i").cast("string")).alias("query_id"),
        F.concat_ws('" ', F.get("w", F.col("i")), F.get("w", F.col("i") + 1)).alias("text"))
    empty = items.where("item_id % 10 = 9").select(F.concat(item, F.lit("-")).alias("query_id"), F.lit(" -- ").alias("text"))
    return H.search(history_index(spark, sf), _turns(spark, sf), pairs.unionByName(empty))


#: Forms that the entries get, and the stems they share with the searched forms.
FORMS = {"forgiveness": "forgiv", "forgiving": "forgiv", "worries": "worri", "worried": "worri", "hopeful": "hope",
         "hoping": "hope", "lantern": "lantern"}
SEARCHED = {"forgive": "forgiv", "worry": "worri", "hopes": "hope", "lanterns": "lantern", "absent": "absent"}
_FORM = f"list_value({', '.join(repr(f) for f in FORMS)})"


@query("history_search_stems", f"""
WITH stems AS (SELECT * FROM (VALUES {', '.join(f"('{w}', '{s}')" for w, s in (FORMS | SEARCHED).items())}) AS v(word, stem)),
e AS (SELECT conv_id * {TURNS} + turn AS id, conv_id * {TURNS} + turn AS k FROM conversations),
p AS (
  SELECT DISTINCT id, stem FROM (
    SELECT id, unnest([{_FORM}[k % 7 + 1], {_FORM}[(k // {TURNS}) % 7 + 1]]) AS word FROM e) JOIN stems USING (word)),
f AS (SELECT unnest({list(SEARCHED)!r}) AS word),
s AS (
  SELECT a.word || ' ' || b.word AS query_id, list_distinct([x.stem, y.stem]) AS t
  FROM f a, f b JOIN stems x ON x.word = a.word JOIN stems y ON y.word = b.word),
q AS (SELECT query_id, len(t) AS n, unnest(t) AS stem FROM s),
m AS (SELECT query_id, id FROM q JOIN p USING (stem) GROUP BY query_id, id, n HAVING count(*) = n)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id DESC) - 1 AS pos FROM m QUALIFY pos < 100""")
def q_history_search_stems(spark, sf):
    """Every entry gets two word forms; all pairs of other forms are searched. Stems are kept beside the postings."""
    from quillspan.functions.stem import porter
    from quillspan.operators.keyword import stem_vocabulary

    forms = F.array(*[F.lit(f) for f in FORMS])
    form = lambda n: F.get(forms, (n % len(FORMS)).cast("int"))
    turns = _turns(spark, sf).withColumn(
        "answer", F.concat_ws(" ", "answer", form(F.col("id")), form(F.call_function("div", F.col("id"), F.lit(TURNS)))))
    folder = f"{checkpoint_dir(spark)}/history-{uuid.uuid4().hex}"
    stems = H.stored_stems(f"{folder}/stems", stem_vocabulary(porter))
    H.write_postings(H.entry_postings(turns, stems), f"{folder}/postings")
    asked = spark.createDataFrame([(f"{a} {b}",) for a in SEARCHED for b in SEARCHED], "query_id string")
    searches = asked.withColumn("text", F.col("query_id"))
    return H.search(spark.read.parquet(f"{folder}/postings"), turns, searches, stem=stems)


@query("index_maintenance", f"""
WITH e AS (
  SELECT conv_id * {TURNS} + turn AS id, role || ' ' || CASE WHEN role = 'user' AND turn > 0 THEN 'revised ' || text ELSE text END AS t
  FROM conversations WHERE role <> 'system')
SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({I.sql_words('t')}) AS term FROM e) GROUP BY 1, 2""")
def q_index_maintenance(spark, sf):
    """System turns are deleted and later user turns revised."""
    turns = _turns(spark, sf)
    changed = turns.where(f"question = 'user' AND id % {TURNS} > 0").withColumn("answer", F.concat(F.lit("revised "), "answer"))
    deleted = turns.where("question = 'system'").select("id")
    path = f"{checkpoint_dir(spark)}/history-{uuid.uuid4().hex}"
    H.write_postings(H.entry_postings(turns), path)
    H.update_postings(path, changed, deleted)
    return spark.read.parquet(path).select("id", "term", "tf")


@query("history_render", I.with_sql(*STORED_SQL) + """
SELECT id, no, token, reference, collection, first_unit, cited, stale, md5(coalesce(body, '')) AS body_md5
FROM stored LEFT JOIN bodies USING (id, no)""")
def q_history_render(spark, sf):
    return stored(spark, sf, F.md5).withColumnRenamed("body", "body_md5")


@query("legacy_regroup", I.with_sql(I.WORKS_SQL, ENTRIES_SQL) + """
SELECT id, id % 10 <> 9 AS numbered, string_agg(array_to_string(g, ','), '|' ORDER BY no) AS groups FROM groups GROUP BY 1, 2""")
def q_legacy_regroup(spark, sf):
    ids = F.col("passage_ids")
    rows = entries(spark, sf).select("id", H.is_numbered(ids).alias("numbered"), H.passage_lists(ids).alias("g"))
    return rows.select("id", "numbered", F.array_join(F.transform("g", lambda x: F.array_join(x, ",")), "|").alias("groups"))


@query("history_migrate", I.with_sql(I.WORKS_SQL, ENTRIES_SQL) + "SELECT id, passage_ids FROM entries WHERE id % 10 <> 9")
def q_history_migrate(spark, sf):
    return H.migrate(entries(spark, sf), 1).select("id", "passage_ids")


@query("latest_settings", "SELECT event_type AS key, arg_max(props, event_id) AS value FROM events GROUP BY 1")
def q_latest_settings(spark, sf):
    changes = table(spark, sf, "events").select("event_id", F.col("event_type").alias("key"), F.col("props").alias("value"))
    return H.latest_settings(changes, "key", "value", "event_id")


@query("resolve_markers", I.with_sql(I.WORKS_SQL, ENTRIES_SQL) + """
SELECT id, CASE WHEN id % 10 = 9 THEN 'Rest, then; ' || question
  ELSE 'Rest (' || max(reference) FILTER (no = 0) || '), then (' || max(reference) FILTER (no = 1) || ') [P7]; ' || question END AS answer
FROM stored JOIN entries USING (id) GROUP BY id, question""")
def q_resolve_markers(spark, sf):
    return H.resolve_markers(entries(spark, sf), stored(spark, sf, None).select("id", "no", "reference"))


@query("export_questions", I.with_sql(I.WORKS_SQL, ENTRIES_SQL) + """
SELECT e.id, strftime(asked_at, '%Y-%m-%dT%H:%M:%SZ') AS asked, question, CASE WHEN mode = 'both' THEN 'both collections' ELSE 'primary collection' END AS books,
       model_id, index_version, count(s.id) AS n_passages, count(*) FILTER (cited) AS n_cited, CASE WHEN flagged THEN 'yes' ELSE 'no' END AS note_shown
FROM entries e LEFT JOIN stored s ON s.id = e.id GROUP BY ALL""")
def q_export_questions(spark, sf):
    return H.export_questions(entries(spark, sf), stored(spark, sf, None))


@query("export_passages", I.with_sql(*STORED_SQL) + """
SELECT id, row_number() OVER (PARTITION BY id ORDER BY first_unit, no) - 1 AS row_no, reference, CASE WHEN cited THEN 'yes' ELSE 'no' END AS cited,
       CASE WHEN collection = 'secondary' THEN 'yes' ELSE 'no' END AS secondary,
       CASE WHEN NOT stale THEN md5(coalesce(body, '')) END AS body_md5 FROM stored LEFT JOIN bodies USING (id, no)""")
def q_export_passages(spark, sf):
    return H.export_passages(stored(spark, sf, F.md5)).withColumnRenamed("body", "body_md5")


# --- streaming twins --------------------------------------------------------------------

START = "2024-01-01 00:00:00"  # event time of turn 0; a turn a minute
FILES = 4  # micro-batches of a stream
TASKS = 8  # input files that a micro-batch of turns has, so that many tasks write and read them


def _run_folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"


def _kept(spark, result: DataFrame, folder: str) -> DataFrame:
    """The result in the checkpoint folder, its run's files removed."""
    made = cut_lineage(result)
    remove_folder(spark, folder)
    return made


def _conversation_stream(spark, sf, folder: str):
    """All turns in several files that arrive one after the other."""
    turns = table(spark, sf, "conversations")
    turns.repartitionByRange(FILES * TASKS, "conv_id", "turn").write.parquet(f"{folder}/in")
    return jobs.stream_table(spark, f"{folder}/in", "*.parquet", turns.schema, files_per_trigger=TASKS)


@query("stream_phrase_flags", registry.oracles()["phrase_flags"])
def q_stream_phrase_flags(spark, sf):
    folder = _run_folder(spark)
    flagged = jobs.flagged_questions(_conversation_stream(spark, sf, folder), V.phrase_list(spark, sf)).select("conv_id", "turn", "flagged", "term")
    jobs.write_stream(flagged, f"{folder}/out", f"{folder}/log").awaitTermination()
    return _kept(spark, spark.read.schema(flagged.schema).parquet(f"{folder}/out"), folder)


@query("stream_verify", I.with_sql(*V.BASE_SQL) + "SELECT * FROM bad")
def q_stream_verify(spark, sf):
    """Every micro-batch of generated turns is checked by the batch operator."""
    from quillspan.operators import references as R
    from quillspan.operators.verify import violations

    folder = _run_folder(spark)
    aliases = kept_table(R.alias_dimension(I.citable_works(spark, sf)), "aliases")
    units = kept_table(I.citable_units(spark, sf).select("work_id", "chapter", "ordinal", "unit_id"), "units")

    def check(turns: DataFrame) -> DataFrame:
        texts = kept_table(V.answers(spark, sf, turns), "answers")
        ids = texts.select("conv_id").distinct()  # what was sent to other conversations is not asked for
        return violations(texts, V.sent(spark, sf, ids), V.sent_units(spark, sf, ids, units), aliases, units, V.KEYS, V.SCOPE)

    jobs.write_batches(_conversation_stream(spark, sf, folder), check, f"{folder}/out", f"{folder}/log").awaitTermination()
    return _kept(spark, spark.read.parquet(f"{folder}/out").drop("batch"), folder)


@query("stream_resolve", I.with_sql(*V.BASE_SQL, V._VERDICT_SQL) + V.ATTEMPTS_SQL)
def q_stream_resolve(spark, sf):
    """Verdicts arrive file by file in event time; the two-attempt state machine runs per conversation."""
    folder = _run_folder(spark)
    minutes = F.make_dt_interval(mins=F.col("turn").cast("int"))
    verdicts = V.attempt_verdicts(spark, sf).select("conv_id", "turn", "verdict").withColumn("at", F.lit(START).cast("timestamp") + minutes)
    verdicts = kept_table(verdicts, "verdicts")
    step = F.least(F.call_function("div", F.col("turn"), F.lit(2)), F.lit(FILES - 1))
    for number in range(FILES):  # attempts arrive in the order of their turns
        verdicts.where(step == number).coalesce(1).write.parquet(f"{folder}/in/step={number}")
    stream = spark.readStream.schema(verdicts.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/step=*")
    jobs.write_stream(jobs.resolve_stream(stream), f"{folder}/out", f"{folder}/log").awaitTermination()
    return _kept(spark, jobs.latest_outcomes(spark.read.schema(jobs.OUTCOME_SCHEMA).parquet(f"{folder}/out")), folder)


@query("stream_index", registry.oracles()["index_maintenance"])
def q_stream_index(spark, sf):
    """Inserts of every turn, then revisions and deletes, as three files of changes; the log is compacted at the end."""
    folder = _run_folder(spark)
    turns = _turns(spark, sf)
    system, user = "question = 'system'", f"question = 'user' AND id % {TURNS} > 0"
    op = lambda df, name, seq: df.select(F.lit(seq).cast("long").alias("seq"), "id", F.lit(name).alias("op"), "question", "answer")
    steps = [op(turns, "insert", 1), op(turns.where(user).withColumn("answer", F.concat(F.lit("revised "), "answer")), "update", 2),
             op(turns.where(system), "delete", 3)]
    for number, step in enumerate(steps):
        step.coalesce(1).write.parquet(f"{folder}/in/step={number}")
    stream = spark.readStream.schema(steps[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/step=*")
    jobs.write_batches(stream, jobs.index_changes, f"{folder}/out", f"{folder}/log").awaitTermination()
    jobs.compact(spark, f"{folder}/out")
    return _kept(spark, jobs.current_postings(spark.read.parquet(f"{folder}/out")), folder)
