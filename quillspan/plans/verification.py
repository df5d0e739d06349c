"""Published verification queries over assistant turns with planted citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions.refs import reference
from quillspan.operators import references as R
from quillspan.operators import verify as V
from quillspan.plans import inputs as I
from quillspan.plans.registry import query
from quillspan.sources.tables import table

KEYS = ["conv_id", "turn"]
SCOPE = ["conv_id"]

# The planted suffix, as expressions both engines read.
_TOK = "(conv_id * 7 + turn) % 30"
_OTHER = "(conv_id + turn * 3) % 28 + 1"
_SUFFIX = (
    "concat(' [P', tok, '] see ', nm, ' ', ch, ':', a, CASE WHEN turn % 3 > 0 THEN concat('-', b) ELSE '' END, "
    "' and [P', oth, '], read 12 times.')"
)
_ANSWER = f"CASE WHEN turn % 3 = 1 THEN concat('## First\n', text, {_SUFFIX}, '\n## Second\nMore on [P', oth, '].') ELSE concat(text, {_SUFFIX}) END"


def answers(spark, sf, conversations=None):
    """Assistant turns with planted tokens and one written reference each."""
    every = table(spark, sf, "conversations") if conversations is None else conversations
    turns = every.where("role = 'assistant'")
    turns = turns.withColumn("tok", F.expr(_TOK)).withColumn("oth", F.expr(_OTHER))
    placed = turns.withColumn("n_nationkey", ((F.col("conv_id") * 7 + F.col("tok") * 3) % 25).cast("int"))
    nations = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    regions = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.initcap("r_name").alias("nm"))
    a = (F.col("conv_id") + F.col("tok")) % 40 + 1
    full = placed.join(nations, "n_nationkey").join(regions, "n_regionkey").withColumn("ch", F.col("n_nationkey") + 1)
    full = full.withColumn("a", a).withColumn("b", F.col("a") + F.col("turn") % 3 * 2)
    return full.select("conv_id", "turn", F.expr(_ANSWER).alias("text"))


def sent(spark, sf, only=None):
    """Tokens 1–25 of every conversation, or of those in ``only``."""
    convs = table(spark, sf, "conversations").select("conv_id").distinct()
    convs = convs if only is None else convs.join(only, "conv_id", "left_semi")
    tokens = convs.select("conv_id", F.explode(F.sequence(F.lit(1), F.lit(25))).alias("t"))
    tokens = tokens.withColumn("n_nationkey", ((F.col("conv_id") * 7 + F.col("t") * 3) % 25).cast("int"))
    nations = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    located = tokens.join(nations, "n_nationkey").select(
        "conv_id", F.concat(F.lit("[P"), F.col("t").cast("string"), F.lit("]")).alias("token"), F.col("t").cast("long").alias("t"),
        (F.col("n_regionkey").cast("long") + 1).alias("work_id"), (F.col("n_nationkey").cast("long") + 1).alias("chapter"),
        ((F.col("conv_id") + F.col("t")) % 40 + 1).alias("a"),
    )
    return located.withColumn("b", F.col("a") + 4)


def sent_units(spark, sf, only=None, units=None):
    """The existing units behind what was sent."""
    units = I.citable_units(spark, sf).select("work_id", "chapter", "ordinal", "unit_id") if units is None else units
    return sent(spark, sf, only).join(units, ["work_id", "chapter"]).where(F.col("ordinal").between(F.col("a"), F.col("b")))


ANSWERS_SQL = f"""
turns AS (
  SELECT conv_id, turn, text, {_TOK} AS tok, {_OTHER} AS oth FROM conversations WHERE role = 'assistant'),
placedt AS (
  SELECT t.*, abbrev AS nm, n_nationkey + 1 AS ch, (conv_id + tok) % 40 + 1 AS a,
         (conv_id + tok) % 40 + 1 + turn % 3 * 2 AS b
  FROM turns t JOIN nation ON n_nationkey = (conv_id * 7 + tok * 3) % 25 JOIN rworks ON work_id = n_regionkey + 1),
answers AS (SELECT conv_id, turn, {_ANSWER.replace(chr(10), "' || chr(10) || '")} AS text FROM placedt),
sent AS (
  SELECT conv_id, '[P' || t || ']' AS token, t, CAST(n_regionkey AS BIGINT) + 1 AS work_id,
         CAST(n_nationkey AS BIGINT) + 1 AS chapter, (conv_id + t) % 40 + 1 AS a, (conv_id + t) % 40 + 5 AS b
  FROM (SELECT DISTINCT conv_id FROM conversations), range(1, 26) r(t)
  JOIN nation ON n_nationkey = (conv_id * 7 + t * 3) % 25),
sunits AS (
  SELECT s.*, u.ordinal, u.unit_id FROM sent s JOIN runits u USING (work_id, chapter) WHERE ordinal BETWEEN a AND b)
"""

# Regular-expression form of the same detection: one alternation over the written names.
_DETECT_SQL = f"""
occ AS (
  SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?i)\\b(Africa|America|Asia|Europe|Middle\\s+East)\\s*\\.?\\s+(\\d{{1,3}})(?:\\s*[:.]\\s*(\\d{{1,3}})(?:\\s*[-–—]\\s*(\\d{{1,3}}))?)?', 0)) AS text,
         text AS whole FROM answers),
refs AS (
  SELECT o.conv_id, o.turn, o.text, strpos(whole, o.text) - 1 AS start, strpos(whole, o.text) - 1 + length(o.text) AS stop,
         work_id, CAST(regexp_extract(o.text, '\\s(\\d+)(:\\d+)?(-\\d+)?$', 1) AS BIGINT) AS chapter,
         CAST(regexp_extract(o.text, ':(\\d+)', 1) AS BIGINT) AS v1,
         CAST(coalesce(nullif(regexp_extract(o.text, '-(\\d+)$', 1), ''), regexp_extract(o.text, ':(\\d+)', 1)) AS BIGINT) AS v2
  FROM occ o JOIN rworks ON starts_with(lower(o.text), lower(abbrev))),
judged AS (
  SELECT r.*, CASE WHEN v2 < v1 OR (SELECT count(DISTINCT ordinal) FROM sunits s WHERE s.conv_id = r.conv_id AND s.work_id = r.work_id
           AND s.chapter = r.chapter AND s.ordinal BETWEEN r.v1 AND r.v2) < v2 - v1 + 1
         THEN 'verses not in sent set' END AS reason FROM refs r),
tokocc AS (
  SELECT conv_id, turn, i - 1 AS no, m[i] AS match,
         list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT conv_id, turn, string_split_regex(text, '\\[P\\d+\\]') AS p, regexp_extract_all(text, '(\\[P\\d+\\])', 1) AS m FROM answers))),
badtok AS (
  SELECT * FROM tokocc t WHERE NOT EXISTS (SELECT 1 FROM sent s WHERE s.conv_id = t.conv_id AND s.token = t.match)),
bad AS (
  SELECT conv_id, turn, 'token' AS kind, match AS text, 'token not in sent set' AS reason, CAST(start AS BIGINT) AS start,
         CAST(start + length(match) AS BIGINT) AS stop FROM badtok
  UNION ALL SELECT conv_id, turn, 'reference', text, reason, start, stop FROM judged WHERE reason IS NOT NULL)
"""
BASE_SQL = (I.CITABLE_SQL, ANSWERS_SQL, _DETECT_SQL)


def found_violations(spark, sf):
    aliases = R.alias_dimension(I.citable_works(spark, sf))
    return V.violations(answers(spark, sf), sent(spark, sf), sent_units(spark, sf), aliases,
                        I.citable_units(spark, sf), KEYS, SCOPE)


@query("cited_tokens", I.with_sql(I.CITABLE_SQL, ANSWERS_SQL) + """
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(\\[P\\d+\\])', 1))), ',') AS cited
FROM answers""")
def q_cited_tokens(spark, sf):
    return answers(spark, sf).select(*KEYS, F.array_join(V.cited_tokens(F.col("text")), ",").alias("cited"))


@query("verify_tokens", I.with_sql(*BASE_SQL) + "SELECT conv_id, turn, no, match AS token FROM badtok")
def q_verify_tokens(spark, sf):
    return V.unsent_tokens(answers(spark, sf), sent(spark, sf), KEYS, SCOPE).select(
        *KEYS, "no", F.col("match").alias("token"))


@query("verify_references", I.with_sql(*BASE_SQL)
       + "SELECT conv_id, turn, text, start, stop, work_id, chapter, v1, v2, reason FROM judged")
def q_verify_references(spark, sf):
    aliases = R.alias_dimension(I.citable_works(spark, sf))
    refs = V.written_references(answers(spark, sf), aliases, KEYS)
    judged = V.judged_references(refs, sent_units(spark, sf), I.citable_units(spark, sf), KEYS, SCOPE)
    return judged.select(*KEYS, "text", "start", "stop", "work_id", "chapter", "v1", "v2", "reason")


@query("violations", I.with_sql(*BASE_SQL) + "SELECT * FROM bad")
def q_violations(spark, sf):
    return found_violations(spark, sf)


@query("strip_violations", I.with_sql(*BASE_SQL, """
spans AS (SELECT conv_id, turn, list({'a': start, 'b': stop} ORDER BY start DESC) AS s FROM bad GROUP BY 1, 2)""") + """
SELECT conv_id, turn, regexp_replace(CASE WHEN s IS NULL THEN text ELSE
  list_reduce([{'t': text, 'a': 0::BIGINT, 'b': 0::BIGINT}] || list_transform(s, lambda x: {'t': '', 'a': x.a, 'b': x.b}),
    lambda acc, x: {'t': acc.t[1:x.a] || acc.t[x.b + 1:], 'a': 0::BIGINT, 'b': 0::BIGINT}).t END, '[ \\t]{2,}', ' ', 'g') AS text
FROM answers LEFT JOIN spans USING (conv_id, turn)""")
def q_strip_violations(spark, sf):
    return V.strip_violations(answers(spark, sf), found_violations(spark, sf), KEYS)


@query("failure_notes", I.with_sql(*BASE_SQL) + """
SELECT conv_id, turn, string_agg(kind || ' "' || text || '" (' || reason || ')', '; ' ORDER BY kind DESC, start) AS note
FROM bad GROUP BY 1, 2""")
def q_failure_notes(spark, sf):
    return V.failure_notes(found_violations(spark, sf), KEYS)


_PASSAGES_SQL = """
spass AS (
  SELECT conv_id, token, any_value(s.work_id) AS work_id, any_value(abbrev) AS work_name, min(unit_id) AS first_unit,
         any_value(abbrev) || ' ' || any_value(chapter) || ':' || min(ordinal)
           || CASE WHEN min(ordinal) = max(ordinal) THEN '' ELSE '-' || max(ordinal) END AS reference
  FROM sunits s JOIN rworks USING (work_id) GROUP BY 1, 2)
"""


def sent_passages(spark, sf):
    works = I.citable_works(spark, sf).select("work_id", F.col("abbrev").alias("work_name"))
    grouped = sent_units(spark, sf).groupBy("conv_id", "token", "t", "work_id", "chapter").agg(
        F.min("unit_id").alias("first_unit"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"))
    return grouped.join(works, "work_id").withColumn(
        "reference", reference(F.col("work_name"), F.col("chapter"), F.col("lo"), F.col("hi")))


@query("fallback_listing", I.with_sql(I.CITABLE_SQL, ANSWERS_SQL, _PASSAGES_SQL, """
lines AS (
  SELECT conv_id, work_id, chr(10) || chr(10) || any_value(work_name) ||
         string_agg(chr(10) || '  ' || reference, '' ORDER BY first_unit, reference) AS part FROM spass GROUP BY 1, 2)""") + f"""
SELECT conv_id, '{V.FALLBACK_HEADING}' || string_agg(part, '' ORDER BY work_id) AS listing FROM lines GROUP BY 1""")
def q_fallback_listing(spark, sf):
    return V.fallback_listing(sent_passages(spark, sf), SCOPE)


_VERDICT_SQL = """
verdicts AS (
  SELECT conv_id, turn, CASE WHEN EXISTS (SELECT 1 FROM bad b WHERE b.conv_id = a.conv_id AND b.turn = a.turn)
         THEN 'violation' ELSE 'ok' END AS verdict FROM answers a)
"""
ATTEMPTS_SQL = """
SELECT conv_id, CASE WHEN f = 'ok' OR s = 'ok' THEN 'ok' ELSE 'fallback' END AS outcome,
       CASE WHEN f = 'ok' THEN fid WHEN s = 'ok' THEN sid END AS used,
       CASE WHEN f = 'ok' OR s IS NULL THEN 1 ELSE 2 END::BIGINT AS n_attempts
FROM (SELECT conv_id, max(verdict) FILTER (r = 1) AS f, max(verdict) FILTER (r = 2) AS s, max(turn) FILTER (r = 1) AS fid,
             max(turn) FILTER (r = 2) AS sid
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM verdicts) GROUP BY 1)"""


def attempt_verdicts(spark, sf):
    return V.verdicts(answers(spark, sf), found_violations(spark, sf), KEYS)


@query("resolve_attempts", I.with_sql(*BASE_SQL, _VERDICT_SQL) + ATTEMPTS_SQL)
def q_resolve_attempts(spark, sf):
    return V.resolve_attempts(attempt_verdicts(spark, sf), SCOPE, "turn")


@query("carry_through", I.with_sql(I.CITABLE_SQL, ANSWERS_SQL, """
last_turn AS (SELECT conv_id, max(turn) AS last FROM answers GROUP BY 1),
toks AS (
  SELECT conv_id, unnest(regexp_extract_all(text, '(\\[P\\d+\\])', 1)) AS token, turn = last AS is_merge
  FROM answers JOIN last_turn USING (conv_id)),
flags AS (SELECT conv_id, token, bool_or(NOT is_merge) AS b, bool_or(is_merge) AS m FROM toks GROUP BY 1, 2)""") + """
SELECT conv_id, count(*) FILTER (b) AS cited_by_batches, count(*) FILTER (b AND m) AS carried,
       count(*) FILTER (b AND NOT m) AS dropped FROM flags GROUP BY 1""")
def q_carry_through(spark, sf):
    rows = answers(spark, sf)
    last = rows.groupBy("conv_id").agg(F.max("turn").alias("last"))
    cited = rows.select(*KEYS, F.explode(V.tokens_in(F.col("text"))).alias("token")).join(last, "conv_id")
    return V.carry_through(cited.withColumn("is_merge", F.col("turn") == F.col("last")), SCOPE)


@query("structure_ok", I.with_sql(*BASE_SQL, _VERDICT_SQL, """
blocks AS (SELECT a.*, verdict, string_split_regex(text, '(?m)^[ \\t]*##')[2:] AS b FROM answers a JOIN verdicts USING (conv_id, turn)),
toks AS (SELECT conv_id, list(token) AS sent_tokens FROM sent GROUP BY 1)""") + """
SELECT conv_id, turn, len(b) AS themes,
       len(b) BETWEEN 2 AND 6 AND len(list_filter(b, lambda x: NOT regexp_matches(x, '\\[P\\d+\\]'))) = 0
         AND turn % 5 <> 4 AS strict,
       len(b) > 0 AND len(list_filter(b, lambda x: NOT regexp_matches(x, '\\[P\\d+\\]'))) = 0 AND turn % 5 <> 4
         AND len(list_filter(b, lambda x: NOT list_has_all(sent_tokens, regexp_extract_all(x, '(\\[P\\d+\\])', 1)))) = 0 AS report
FROM blocks JOIN toks USING (conv_id)""")
def q_structure_ok(spark, sf):
    tokens = sent(spark, sf).groupBy("conv_id").agg(F.collect_list("token").alias("sent_tokens"))
    rows = answers(spark, sf).join(tokens, "conv_id").withColumn("fallback", F.col("turn") % 5 == 4)
    text, fallback = F.col("text"), F.col("fallback")
    return rows.select(
        *KEYS, F.size(V.theme_blocks(text)).cast("long").alias("themes"),
        V.structure_strict(text, fallback).alias("strict"),
        V.structure_report(text, F.col("sent_tokens"), fallback).alias("report"),
    )


@query("fabrications", I.with_sql(*BASE_SQL, """
u AS (SELECT conv_id, turn, count(*) AS n_unsent FROM badtok GROUP BY 1, 2),
w AS (SELECT conv_id, turn, count(*) AS n_written FROM refs GROUP BY 1, 2)""") + """
SELECT conv_id, turn, coalesce(n_unsent, 0) AS n_unsent, coalesce(n_written, 0) AS n_written,
       coalesce(n_unsent, 0) + coalesce(n_written, 0) AS n_fabrications
FROM answers LEFT JOIN u USING (conv_id, turn) LEFT JOIN w USING (conv_id, turn)""")
def q_fabrications(spark, sf):
    aliases = R.alias_dimension(I.citable_works(spark, sf))
    return V.fabrications(answers(spark, sf), sent(spark, sf), aliases, KEYS, SCOPE)


# --- text jobs over conversations ----------------------------------------------------

@query("question_terms", f"""
SELECT conv_id, turn, array_to_string({I.sql_question_terms('text')}, ' ') AS terms FROM conversations WHERE role = 'user'""")
def q_question_terms(spark, sf):
    turns = table(spark, sf, "conversations").where("role = 'user'")
    return turns.select(*KEYS, F.array_join(T.question_terms(F.col("text")), " ").alias("terms"))


_NOISY = (
    "CASE WHEN turn % 4 = 0 THEN concat('Sure: [\"', w1, ' ', w2, '\", \"  ', w3, ' \", \"\", 7, \"', rest, '\"] done') "
    "WHEN turn % 4 = 1 THEN concat('# head\n- ', w1, ' ', w2, '\n* \"', w3, '\"\n', text) "
    "WHEN turn % 4 = 2 THEN concat('[broken ', w1, '\n- ', w2, ' ] ', rest, '\n', w3) ELSE text END"
)
_NOISY_SQL = f"""
tw AS (SELECT *, {I.sql_words('text')} AS w FROM conversations),
noisy AS (
  SELECT conv_id, turn, {_NOISY.replace(chr(10), "' || chr(10) || '")} AS text
  FROM (SELECT conv_id, turn, text, coalesce(w[1], '') AS w1, coalesce(w[2], '') AS w2, coalesce(w[3], '') AS w3, array_to_string(w, ' ') AS rest FROM tw)),
span AS (SELECT *, regexp_extract(text, '(?s)(\\[.*\\])', 1) AS j FROM noisy),
arr AS (
  SELECT *, CASE WHEN j <> '' AND json_valid(j) THEN
    list_slice(list_filter(list_transform(CAST(j::JSON AS VARCHAR[]), lambda x: trim(x)), lambda x: x <> ''), 1, 5) END AS a FROM span),
parsed AS (
  SELECT conv_id, turn, text, CASE WHEN len(a) > 0 THEN a ELSE list_slice(list_filter(
      list_transform(string_split_regex(text, '\\r?\\n'), lambda x: regexp_replace(x, '^[ \\t*"''-]+|[ \\t*"''-]+$', '', 'g')),
      lambda x: x <> '' AND len(string_split_regex(x, '\\s+')) <= 6 AND NOT starts_with(x, '#')), 1, 5) END AS q FROM arr)
"""


def _noisy(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("w", T.words(F.col("text")))
    word = lambda i: F.coalesce(F.get("w", F.lit(i - 1)), F.lit("")).alias(f"w{i}")
    return turns.select(*KEYS, "text", word(1), word(2), word(3), F.array_join("w", " ").alias("rest")).select(*KEYS, F.expr(_NOISY).alias("text"))


@query("parse_queries", I.with_sql(_NOISY_SQL)
       + "SELECT conv_id, turn, array_to_string(q, '|') AS queries, len(q) AS n FROM parsed")
def q_parse_queries(spark, sf):
    parsed = _noisy(spark, sf).select(*KEYS, T.query_list(F.col("text")).alias("q"))
    return parsed.select(*KEYS, F.array_join("q", "|").alias("queries"), F.size("q").cast("long").alias("n"))


@query("query_modes", I.with_sql(_NOISY_SQL, f"""
mixed AS (
  SELECT p.conv_id, p.turn, {I.sql_question_terms('c.text')} AS own, q, c.text, c.text || ' ' || array_to_string(q, ' ') AS long
  FROM parsed p JOIN conversations c USING (conv_id, turn))""") + """
SELECT conv_id, turn, 'raw' AS mode, array_to_string(own, '|') AS terms, text AS query_text FROM mixed
UNION ALL SELECT conv_id, turn, 'rewrite', array_to_string(CASE WHEN len(q) > 0 THEN q ELSE own END, '|'),
  CASE WHEN len(q) > 0 THEN long ELSE text END FROM mixed
UNION ALL SELECT conv_id, turn, 'fused', array_to_string(own || q, '|'), long FROM mixed""")
def q_query_modes(spark, sf):
    from quillspan.operators.questions import query_modes

    turns = table(spark, sf, "conversations").select(*KEYS, "text", T.question_terms(F.col("text")).alias("own"))
    rewrites = _noisy(spark, sf).select(*KEYS, T.query_list(F.col("text")).alias("rewrites"))
    modes = query_modes(turns.join(rewrites, KEYS), KEYS)
    return modes.withColumn("terms", F.array_join("terms", "|"))


# A neutral list over the tables' own vocabulary.
PHRASES = (
    "in the|the and|of the|is the|und der|der die|les de|de la|la de|que la|el de|de los|is and|the was|by the|"
    "sch und|est de|et la|and that|for the"
).split("|")


def phrase_list(spark, sf) -> list[str]:
    """The neutral phrases, then all runs of two and three words of the benchmark items in order; a list is configuration."""
    normal = F.trim(T.collapse_spaces(F.lower("text")))
    words = table(spark, sf, "benchmark").select(F.filter(F.split(normal, " "), lambda w: w != "").alias("w"))
    runs = lambda n: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: i <= F.size("w") - n + 1),
        lambda i: F.array_join(F.slice("w", i, n), " "))
    listed = words.select(F.explode(F.concat(runs(2), runs(3))).alias("term")).distinct().orderBy("term")
    return [*PHRASES, *(r["term"] for r in listed.collect())]


@query("phrase_flags", f"""
WITH n AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g')) AS t FROM conversations),
w AS (SELECT list_filter(string_split(trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g')), ' '), lambda x: x <> '') AS w
      FROM benchmark),
runs AS (
  SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
             || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS term FROM w),
terms AS (
  SELECT unnest({PHRASES!r}) AS term, generate_subscripts({PHRASES!r}, 1) AS no
  UNION ALL
  SELECT term, {len(PHRASES)} + row_number() OVER (ORDER BY term) FROM (SELECT DISTINCT term FROM runs))
SELECT conv_id, turn, h IS NOT NULL AS flagged, h AS term FROM n LEFT JOIN (
  SELECT conv_id, turn, arg_min(term, no) AS h FROM n JOIN terms ON contains(t, term) GROUP BY 1, 2) USING (conv_id, turn)""")
def q_phrase_flags(spark, sf):
    from quillspan.operators.questions import flag_phrases

    return flag_phrases(table(spark, sf, "conversations"), phrase_list(spark, sf)).select(*KEYS, "flagged", "term")


@query("short_labels", f"""
WITH h AS (
  SELECT doc_id, trim(regexp_replace(text, '\\n', ' ', 'g')) AS t FROM documents),
c AS (
  SELECT doc_id, CASE WHEN contains(t, '.') AND strlen(string_split(t, '.')[1]) >= 8 THEN trim(string_split(t, '.')[1])
                      WHEN contains(t, ';') AND strlen(string_split(t, ';')[1]) >= 8 THEN trim(string_split(t, ';')[1])
                      WHEN contains(t, ',') AND strlen(string_split(t, ',')[1]) >= 8 THEN trim(string_split(t, ',')[1])
                      ELSE t END AS cut FROM h),
k AS (SELECT *, left(cut, 60) AS cap, regexp_extract(left(cut, 60), '(?s)^(.*) [^ ]*$', 1) AS before_space FROM c)
SELECT doc_id, CASE WHEN length(cut) <= 60 THEN cut
  ELSE rtrim(CASE WHEN strlen(before_space) >= 30 THEN before_space ELSE cap END) || '...' END AS label FROM k""")
def q_short_labels(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", T.short_label(F.regexp_replace("text", "\n", " ")).alias("label"))


_LOG = "concat('# Title\n<think>', substring(text, 1, 40), CASE WHEN turn % 2 = 0 THEN '</think>' ELSE '' END, substring(text, 41, length(text)))"


@query("log_cleaning", f"""
WITH logs AS (SELECT conv_id, turn, {_LOG.replace(chr(10), "' || chr(10) || '")} AS text FROM conversations),
c AS (SELECT *, {I.sql_strip("regexp_replace(text, '(?is)<think>.*?(</think>|$)', '', 'g')")} AS cleaned FROM logs),
p AS (SELECT *, list_filter(list_transform(string_split(cleaned, chr(10)),
        lambda x: {I.sql_strip("regexp_replace(x, '^#+', '')")}), lambda x: x <> '')[1] AS f FROM c)
SELECT conv_id, turn, cleaned,
       CASE WHEN length(coalesce(f, '')) > 90 THEN left(f, 90) || '...' ELSE coalesce(f, '') END AS preview,
       array_to_string(list_filter(string_split(cleaned, chr(10)), lambda x: NOT starts_with(ltrim(x), '#')), chr(10)) AS body,
       array_to_string(list_slice(string_split(regexp_replace(regexp_replace(cleaned, '[ \\t\\r\\n]+', ' ', 'g'), '^ | $', '', 'g'), ' '), 1, 10), ' ') AS excerpt
FROM p""")
def q_log_cleaning(spark, sf):
    logs = table(spark, sf, "conversations").select(*KEYS, F.expr(_LOG).alias("text"))
    cleaned = logs.select(*KEYS, T.without_thinking(F.col("text")).alias("cleaned"))
    return cleaned.select(
        *KEYS, "cleaned", T.preview(F.col("cleaned")).alias("preview"),
        F.array_join(T.body_lines(F.col("cleaned")), "\n").alias("body"),
        T.first_words(F.col("cleaned"), 10).alias("excerpt"),
    )
