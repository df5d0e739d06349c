"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents fall into cells (source, language, topic). The cells' token shares are raked until the sums by source, by
language and by topic meet their targets; a document is then drawn with its cell's weight over its cell's tokens,
scaled so that the expected tokens meet the budget. Cells that would need more than all their documents give all, and
the scale of the others rises. Only the cell table is iterated, as a table; the draw hashes the id, so it does not
depend on order, partitions or retries.

Defined cases: null and empty texts have no tokens and the topic ``short``; null sources and languages are values of
their own; a cell without tokens is drawn at the budget rate; an empty table stays empty; rows with equal ids
share their draw.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.llm.common import ROW, SPACE, load, once, quoted, stored, whole_rows
from quillspan.plans.registry import Builder

_LOG = logging.getLogger(__name__)
#: Shares are raised to this power for default targets, which lifts small sources, languages and topics.
FLATTEN = 0.5
#: Expected share of all tokens that is drawn.
RATE = 0.5
ROUNDS = 10
LEVEL_ROUNDS = 12
#: Rounds of raking under the cells' tokens.
CAPPED_ROUNDS = 20
#: A target missed by more than this part of it is logged.
MISS = 0.01
SEED = "mix"
MARGINS = ("source", "lang", "topic")


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def default_topic(text: Column, tokens: Column) -> Column:
    """A topic that the text's form gives away."""
    plain = F.coalesce(text, F.lit(""))
    symbols = F.length(plain) - F.length(F.translate(plain, "#*$%&|<>", ""))
    return (
        F.when(tokens < 20, "short").when(F.lower(plain).contains("licen"), "licensed").when(plain.contains(" | "), "table")
        .when(symbols * 20 > F.length(plain), "symbols").when(tokens < 400, "page").otherwise("long")
    )


def with_topics(docs: DataFrame, topic=default_topic) -> DataFrame:
    """Add ``_tokens`` and ``_topic``."""
    counted = once(docs, _tokens=word_count(F.col("text")))
    held = F.col(ROW)[topic].cast("string") if isinstance(topic, str) else topic(F.col("text"), F.col("_tokens"))
    return counted.withColumn("_topic", held)


def _targets(cells: DataFrame, margin: str, wanted: dict[str, float] | None, total: float) -> DataFrame:
    """(value, goal): target shares of one margin; values without a stated share follow the flattened shares."""
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
    raw = F.pow(F.col("t") / F.lit(total), F.lit(FLATTEN))
    if wanted:
        stated = F.element_at(F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv]), F.col("value"))
        raw = F.coalesce(stated.cast("double"), raw)
    rows = sums.select("value", raw.alias("raw"))
    whole = rows.agg(F.sum("raw")).first()[0] or 1.0
    return stored(rows.select("value", (F.col("raw") / F.lit(whole)).alias("goal")))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Cells (source, lang, topic, tokens) with ``weight``, their share of the mix; cells without tokens weigh 0."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    now = cells.withColumn("weight", F.col("tokens") / F.lit(total or 1.0))
    goals = {m: _targets(cells, m, (targets or {}).get(m), total or 1.0) for m in MARGINS}
    for _ in range(rounds):
        for margin in MARGINS:
            sums = now.groupBy(F.col(margin).alias("value")).agg(F.sum("weight").alias("now"))
            goal = goals[margin].withColumnRenamed("value", "goal_value")
            step = sums.join(goal, sums["value"].eqNullSafe(goal["goal_value"])).select(
                "value", F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(F.lit(1.0)).alias("factor"))
            now = now.join(step, now[margin].eqNullSafe(step["value"]), "left").select(
                *cells.columns, (F.col("weight") * F.coalesce("factor", F.lit(1.0))).alias("weight"))
        now = stored(now)
    return now


def rake_capped(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE,
                rounds: int = CAPPED_ROUNDS) -> DataFrame:
    """As ``rake``, for a mix of ``rate`` times all tokens in which no cell gives more than it has.

    A cell counts with its cap or its weight, whichever is less. In each step the cells under their caps take what the
    capped ones leave of a margin; all weights of the margin move, so a capped cell is free again once it should give less.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    cap = F.col("tokens") / F.lit((total or 1.0) * rate)
    now = cells.withColumn("weight", F.col("tokens") / F.lit(total or 1.0))
    for m in MARGINS:
        goal = _targets(cells, m, (targets or {}).get(m), total or 1.0).withColumnRenamed("goal", f"goal_{m}")
        now = now.join(goal, now[m].eqNullSafe(goal["value"]), "left").drop("value")
    now = stored(now)
    full = F.col("weight") >= cap
    for _ in range(rounds):
        for m in MARGINS:
            of = W.partitionBy(m)  # cells only
            fixed = F.sum(F.when(full, cap).otherwise(0.0)).over(of)
            free = F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).over(of)
            now = now.withColumns({"fixed": fixed, "free": free})
            rest = F.col(f"goal_{m}") - F.col("fixed")
            factor = F.when((F.col("free") > 0) & (rest > 0), F.least(F.lit(100.0), rest / F.col("free"))).when(
                rest < 0, F.col(f"goal_{m}") / (F.col("fixed") + F.col("free"))).otherwise(F.lit(1.0))
            now = now.withColumn("weight", F.col("weight") * F.coalesce(factor, F.lit(1.0)))
        now = stored(now)
    return now.select(*cells.columns, "weight")


def shares(chances: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(margin, value, wanted, reached): target and expected token shares of cells with ``probability``."""
    total = float(chances.agg(F.sum("tokens")).first()[0] or 0) or 1.0
    drawn_tokens = F.col("tokens") * F.col("probability")
    whole = float(chances.agg(F.sum(drawn_tokens)).first()[0] or 0) or 1.0
    out = None
    for m in MARGINS:
        got = chances.groupBy(F.col(m).alias("got")).agg((F.sum(drawn_tokens) / F.lit(whole)).alias("reached"))
        goal = _targets(chances, m, (targets or {}).get(m), total)
        each = goal.join(got, goal["value"].eqNullSafe(got["got"])).select(
            F.lit(m).alias("margin"), "value", F.col("goal").alias("wanted"), "reached")
        out = each if out is None else out.unionByName(each)
    return out


def _log_misses(chances: DataFrame, targets: dict[str, dict[str, float]] | None) -> None:
    """Name the targets that the tokens at hand do not allow, the largest misses first."""
    off = F.abs(F.col("reached") - F.col("wanted"))
    for r in shares(chances, targets).where(off > MISS * F.col("wanted")).orderBy(off.desc()).limit(20).collect():
        _LOG.warning("mixing: %s %s was to have %.4f of the tokens and has %.4f", r.margin, r.value, r.wanted, r.reached)


def calibrate(raked: DataFrame, rate: float = RATE, rounds: int = LEVEL_ROUNDS) -> DataFrame:
    """Add ``probability``: min(1, level * weight / share), the level set so that expected tokens are rate * total."""
    total = float(raked.agg(F.sum("tokens")).first()[0] or 0)
    lift = F.col("weight") * F.lit(total) / F.col("tokens")
    rows = raked.withColumn("lift", F.when(F.col("tokens") > 0, lift))
    level = rate
    for _ in range(rounds):
        full = F.col("lift") * F.lit(level) >= 1
        got = rows.where("lift is not null").agg(
            F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"),
            F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("tokens") * F.col("lift"))).alias("rest")).first()
        if not got["rest"]:
            break
        level = max(level, (rate * total - float(got["full"] or 0)) / got["rest"])
    return rows.withColumn("probability", F.coalesce(F.least(F.lit(1.0), F.col("lift") * F.lit(level)), F.lit(rate))).drop("lift")


@whole_rows("doc_id", "text", "source", "lang")
def drawn(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE,
          topic=default_topic) -> DataFrame:
    """The drawn documents with ``_tokens``, ``_topic`` and ``_probability``.

    ``topic`` names a column of the documents, or makes a topic of the text and its number of words.
    """
    made = with_topics(docs, topic)
    named = ["_source", "_lang", "_topic"]
    made = made.withColumns({"_source": F.col("source"), "_lang": F.col("lang")})
    cells = stored(made.groupBy(*[F.col(n).alias(n[1:]) for n in named]).agg(F.sum("_tokens").alias("tokens")))
    given = stored(calibrate(rake_capped(cells, targets, rate), rate))
    _log_misses(given, targets)
    chances = stored(given.select(
        *[F.col(m).alias(f"c_{m}") for m in MARGINS], F.col("probability").alias("_probability")))
    same = [made[n].eqNullSafe(chances[f"c{n}"]) for n in named]
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{SEED}")))
    dice = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return made.join(chances, same[0] & same[1] & same[2]).where(dice < F.col("_probability")).select(
        *docs.columns, "_tokens", "_topic", "_probability")


def sample(docs: DataFrame, **options) -> DataFrame:
    """Pipeline stage: the drawn documents, columns unchanged."""
    return drawn(docs, **options).select(*[F.col(quoted(c)) for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn documents with their cell and probability."""
    return drawn(load(spark, sf_dir, "documents")).select(
        "doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
        F.round("_probability", 6).alias("probability"))


def _sql() -> str:
    """The same rows as SQL: one step of the fitting per common table."""
    out = [rf"""t AS (SELECT doc_id, source, lang, coalesce(text, '') AS text,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
d AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN n_tokens < 20 THEN 'short'
  WHEN contains(lower(text), 'licen') THEN 'licensed' WHEN contains(text, ' | ') THEN 'table'
  WHEN (length(text) - length(translate(text, '#*$%&|<>', ''))) * 20 > length(text) THEN 'symbols'
  WHEN n_tokens < 400 THEN 'page' ELSE 'long' END AS topic FROM t),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL),
total AS (SELECT sum(tokens) AS total FROM cells),
w0 AS (SELECT cells.*, tokens / (SELECT total FROM total) AS weight FROM cells)"""]
    for m in MARGINS:
        out.append(f"""g_{m} AS (SELECT {m} AS value, p / sum(p) OVER () AS goal FROM (
  SELECT {m}, pow(sum(tokens) / (SELECT total FROM total), {FLATTEN}) AS p FROM cells GROUP BY {m} HAVING sum(tokens) > 0))""")
    n = 0
    cap = f"(tokens / ((SELECT total FROM total) * {RATE}))"
    for _ in range(CAPPED_ROUNDS):
        for m in MARGINS:
            out.append(f"""w{n + 1} AS MATERIALIZED (SELECT w.source, w.lang, w.topic, w.tokens, w.weight * coalesce(
  CASE WHEN g.goal IS NULL THEN 1.0 WHEN s.free > 0 AND g.goal - s.fixed > 0 THEN least(100.0, (g.goal - s.fixed) / s.free)
  WHEN g.goal - s.fixed < 0 THEN g.goal / (s.fixed + s.free) ELSE 1.0 END, 1.0) AS weight
  FROM w{n} w JOIN (SELECT {m} AS value, sum(CASE WHEN weight >= {cap} THEN {cap} ELSE 0.0 END) AS fixed,
    sum(CASE WHEN weight >= {cap} THEN 0.0 ELSE weight END) AS free FROM w{n} GROUP BY {m}) s ON w.{m} IS NOT DISTINCT FROM s.value
  LEFT JOIN g_{m} g ON g.value IS NOT DISTINCT FROM s.value)""")
            n += 1
    out.append(f"""lift AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0
  THEN weight * (SELECT total FROM total) / tokens END AS lift FROM w{n})""")
    out.append(f"l0 AS (SELECT CAST({RATE} AS DOUBLE) AS level)")
    for k in range(LEVEL_ROUNDS):
        out.append(f"""l{k + 1} AS MATERIALIZED (SELECT CASE WHEN rest IS NULL OR rest = 0 THEN level ELSE greatest(level,
  ({RATE} * (SELECT total FROM total) - part) / rest) END AS level FROM (SELECT max(level) AS level,
  sum(CASE WHEN lift * level >= 1 THEN tokens ELSE 0 END) AS part,
  sum(CASE WHEN lift * level >= 1 THEN 0.0 ELSE tokens * lift END) AS rest FROM lift, l{k} WHERE lift IS NOT NULL))""")
    return "WITH " + ",\n".join(out) + rf"""
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens,
  round(coalesce(least(1.0, lift * (SELECT level FROM l{LEVEL_ROUNDS})), {RATE}), 6) AS probability
FROM d JOIN lift c ON d.source IS NOT DISTINCT FROM c.source AND d.lang IS NOT DISTINCT FROM c.lang AND d.topic = c.topic
WHERE CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || '|{SEED}'), 1, 8) AS BIGINT) / 4294967296.0
  < coalesce(least(1.0, lift * (SELECT level FROM l{LEVEL_ROUNDS})), {RATE})
"""


QUERIES: dict[str, Builder] = {"op6_mixing": op6_mixing}
SQL: dict[str, str] = {"op6_mixing": _sql()}
