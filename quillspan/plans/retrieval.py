"""Published retrieval queries: vectors, keywords, fusion, expansion, grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import vectors as V
from quillspan.operators import fusion, keyword, search, vector
from quillspan.plans import inputs as I
from quillspan.plans.registry import query
from quillspan.session import stored
from quillspan.sources.tables import table

SHELF = (I.WORKS_SQL, I.UNITS_SQL, I.QVEC_SQL, I.QTERMS_SQL, I.VECTORS_SQL, I.EDGES_SQL)


def _top_sql(name: str, corpus: str, keep: int) -> str:
    return f"""
{name}_s AS (
  SELECT query_id, key, round(list_dot_product(qvec.vec, {corpus}.vec), 9) AS score FROM qvec, {corpus}),
{name} AS (
  SELECT query_id, key, score, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) - 1 AS pos FROM {name}_s)
  WHERE pos < {keep})
"""


BM25_SQL = f"""
toks AS (SELECT unit_id, {I.sql_words('text')} AS tokens FROM units),
stats AS (SELECT count(*) AS n_units, sum(len(tokens)) / count(*) AS mean_len FROM toks),
qws AS (SELECT term, {I.sql_words('term')} AS ws FROM (SELECT DISTINCT term FROM qterms)),
qword AS (SELECT term, len(ws) AS width, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM qws),
places AS (SELECT unit_id, len(tokens) AS unit_len, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS p FROM toks),
runs AS (
  SELECT term, unit_id, unit_len, p - i AS start FROM places JOIN qword USING (word)
  GROUP BY term, unit_id, unit_len, p - i, width HAVING count(*) = width),
posts AS (SELECT term, unit_id, unit_len, count(*) AS tf FROM runs GROUP BY 1, 2, 3),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY 1),
scored AS (
  SELECT term, unit_id, tf, df,
         round(tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * unit_len / mean_len)), 12) AS weight,
         greatest(ln((n_units - df + 0.5) / (df + 0.5)), 1e-6) AS idf
  FROM posts JOIN dfs USING (term), stats)
"""


def _mode_predicate(mode: str) -> str:
    return {"primary": "collection = 'primary'", "secondary-only": "collection = 'secondary'", "both": "TRUE"}[mode]


def lists_sql(mode: str, tag: str = "", pool: int = 100) -> str:
    """Ranked lists of one mode as ``lists{tag}``; needs utop, btop and scored."""
    ok = _mode_predicate(mode)
    return f"""
uf{tag} AS (
  SELECT query_id, key AS unit_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) - 1 AS pos
  FROM utop JOIN works ON work_id = key // 1000000 WHERE {ok}),
bf{tag} AS (
  SELECT query_id, key AS block_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) - 1 AS pos
  FROM btop JOIN works ON work_id = key // 1000000 WHERE {ok}),
flat{tag} AS (
  SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY bpos, unit_id) - 1 AS pos FROM (
    SELECT query_id, unit_id, min(pos) AS bpos FROM bf{tag} JOIN bmembers USING (block_id)
    WHERE pos < {pool} GROUP BY 1, 2)),
tl{tag} AS (
  SELECT term, unit_id, idf * weight AS score, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY term ORDER BY weight DESC, unit_id) - 1 AS pos
    FROM scored JOIN works ON work_id = unit_id // 1000000 WHERE {ok} AND term IN (SELECT term FROM qterms))
  WHERE pos < {pool}),
lists{tag} AS (
  SELECT query_id, 'vector-unit' AS origin, unit_id, pos, TRUE AS listed FROM uf{tag} WHERE pos < {pool}
  UNION ALL SELECT query_id, 'vector-block', unit_id, pos, pos < {pool * 4} FROM flat{tag}
  UNION ALL SELECT query_id, 'keyword', unit_id, pos, TRUE FROM qterms JOIN tl{tag} USING (term))
"""


def boosted_sql(mode: str, tag: str = "", lists: str = "lists", scope: str = "query_id", dim: str = "") -> str:
    """Fusion, both boosts and the final ranking as ``final{tag}``."""
    ok = _mode_predicate(mode)
    return f"""
base{tag} AS (
  SELECT {scope}, unit_id, round(sum(CASE WHEN listed THEN 1.0::DOUBLE / (60 + pos + 1) ELSE 0 END), 12) AS score,
         list(DISTINCT origin) AS origins FROM {lists}{tag} GROUP BY {scope}, unit_id),
tcap AS NOT MATERIALIZED (
  SELECT topic_id, unit_id FROM (
    SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY unit_id) AS r FROM tunits) WHERE r <= 60),
tboost{tag} AS (
  SELECT {scope}, unit_id, least(count(*), 3) * (0.5::DOUBLE / 61) AS boost
  FROM ttop JOIN (SELECT topic_id AS key, unit_id FROM tcap JOIN works ON work_id = unit_id // 1000000 WHERE {ok})
    USING (key) {dim.format(path='topic')} GROUP BY {scope}, unit_id),
mid{tag} AS (
  SELECT {scope}, unit_id, round(sum(score), 12) AS score, list_distinct(flatten(list(origins))) AS origins FROM (
    SELECT {scope}, unit_id, score, origins FROM base{tag}
    UNION ALL SELECT {scope}, unit_id, boost, ['topic'] FROM tboost{tag}) GROUP BY {scope}, unit_id),
anch{tag} AS (
  SELECT {scope}, unit_id AS from_id FROM (
    SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY score DESC, unit_id) AS r FROM mid{tag}
    {"WHERE config IN (SELECT config FROM switches WHERE origin = 'edge')" if dim else ""}) WHERE r <= 25),
scan{tag} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY from_id, to_id, anchor NULLS FIRST) AS r
    FROM anch{tag} JOIN edges USING (from_id)) WHERE r <= 800),
cnt{tag} AS (
  SELECT {scope}, to_id AS unit_id, count(*) AS n FROM scan{tag} JOIN works ON work_id = to_id // 1000000
  WHERE {ok} GROUP BY {scope}, to_id),
eboost{tag} AS (
  SELECT {scope}, unit_id, least(n, 4) * (0.25::DOUBLE / 61) AS boost FROM (
    SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY n DESC, unit_id) AS r FROM cnt{tag}) WHERE r <= 200),
tot{tag} AS (
  SELECT {scope}, unit_id, round(sum(score), 12) AS score, list_distinct(flatten(list(origins))) AS origins FROM (
    SELECT {scope}, unit_id, score, origins FROM mid{tag}
    UNION ALL SELECT {scope}, unit_id, boost, ['edge'] FROM eboost{tag}) GROUP BY {scope}, unit_id),
final{tag} AS (
  SELECT {scope}, row_number() OVER (PARTITION BY {scope} ORDER BY score DESC, unit_id) - 1 AS pos, unit_id,
         round_even(score, 6) AS score, array_to_string(list_sort(origins), ',') AS origins FROM tot{tag})
"""


HITS_SQL = (_top_sql("utop", "uvec", 400), _top_sql("btop", "bvec", 400), _top_sql("ttop", "tvec", 5), BM25_SQL)


def hybrid_ctes(mode: str = "primary") -> tuple[str, ...]:
    return (*SHELF, *HITS_SQL, lists_sql(mode), boosted_sql(mode))


def _hits(spark, sf):
    return search.find_hits(
        I.search_index(spark, sf), I.shelf_question_vectors(spark, sf), I.shelf_question_terms(spark, sf)
    )


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("origins", F.array_join(F.array_sort("origins"), ","))


# --- vectors -------------------------------------------------------------------

@query("vector_topk", I.with_sql(I.QVEC_SQL, I.VECTORS_SQL, _top_sql("utop", "uvec", 25))
       + "SELECT query_id, key AS unit_id, pos, round_even(score, 6) AS score FROM utop")
def q_vector_topk(spark, sf):
    top = vector.vector_topk(I.shelf_question_vectors(spark, sf), I.unit_vectors(spark, sf), 25)
    return top.select("query_id", F.col("key").alias("unit_id"), "pos", F.bround("score", 6).alias("score"))


@query("vector_topk_filtered", I.with_sql(I.WORKS_SQL, I.QVEC_SQL, I.VECTORS_SQL, _top_sql("utop", "uvec", 100)) + """
SELECT query_id, unit_id, pos, score FROM (
  SELECT query_id, key AS unit_id, round_even(score, 6) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY u.score DESC, key) - 1 AS pos
  FROM utop u JOIN works ON work_id = key // 1000000 WHERE collection = 'primary') WHERE pos < 25""")
def q_vector_topk_filtered(spark, sf):
    top = vector.vector_topk(I.shelf_question_vectors(spark, sf), I.unit_vectors(spark, sf), 25 * vector.OVERFETCH)
    kept = vector.filter_after_cap(top, I.shelf_works(spark, sf), "primary", 25)
    return kept.select("query_id", F.col("key").alias("unit_id"), "pos", F.bround("score", 6).alias("score"))


@query("block_topk_flatten", I.with_sql(I.WORKS_SQL, I.QVEC_SQL, I.VECTORS_SQL, _top_sql("btop", "bvec", 100)) + """
, bf AS (
  SELECT query_id, key AS block_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) - 1 AS pos
  FROM btop JOIN works ON work_id = key // 1000000 WHERE collection = 'primary')
SELECT query_id, unit_id, pos, pos < 100 AS listed FROM (
  SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY bpos, unit_id) - 1 AS pos FROM (
    SELECT query_id, unit_id, min(pos) AS bpos FROM bf JOIN bmembers USING (block_id) WHERE pos < 25 GROUP BY 1, 2))""")
def q_block_topk_flatten(spark, sf):
    top = vector.vector_topk(I.shelf_question_vectors(spark, sf), I.block_vectors(spark, sf), 25 * vector.OVERFETCH)
    blocks = vector.filter_after_cap(top, I.shelf_works(spark, sf), "primary", 25)
    flat = vector.flatten_blocks(blocks.withColumnRenamed("key", "block_id"), I.block_members(spark, sf), 25)
    return flat.select("query_id", "unit_id", "pos", "listed")


@query("topic_topk", I.with_sql(I.QVEC_SQL, I.VECTORS_SQL, _top_sql("ttop", "tvec", 5))
       + "SELECT query_id, key AS topic_id, pos, round_even(score, 6) AS score FROM ttop")
def q_topic_topk(spark, sf):
    top = vector.vector_topk(I.shelf_question_vectors(spark, sf), I.topic_vectors(spark, sf), search.TOPIC_HITS)
    return top.select("query_id", F.col("key").alias("topic_id"), "pos", F.bround("score", 6).alias("score"))


@query("normalize_vectors", """
SELECT vec_id, round_even(sqrt(list_dot_product(v, v)), 6) AS norm_before,
       round_even(sqrt(list_sum(list_transform(v, lambda x: (x / sqrt(list_dot_product(v, v))) ** 2))), 6) AS norm_after,
       CAST(len(v) AS BIGINT) AS dim, abs(sqrt(list_dot_product(v, v)) - 1) < 1e-3 AS unit_length
FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (label + 1)) AS v FROM embeddings)""")
def q_normalize_vectors(spark, sf):
    vecs = table(spark, sf, "embeddings").select(
        "vec_id", F.transform(V.as_double(F.col("embedding")), lambda x: x * (F.col("label") + 1)).alias("v")
    )
    length = V.norm(F.col("v"))
    return vecs.select(
        "vec_id", F.bround(length, 6).alias("norm_before"),
        F.bround(V.norm(V.normalized(F.col("v"))), 6).alias("norm_after"),
        F.size("v").cast("long").alias("dim"), (F.abs(length - 1) < 1e-3).alias("unit_length"),
    )


# --- keywords ------------------------------------------------------------------

@query("postings", I.with_sql(I.UNITS_SQL, f"toks AS (SELECT unit_id, {I.sql_words('text')} AS tokens FROM units)") + """
SELECT term, unit_id, unit_len, count(*) AS tf, min(p) AS first_pos FROM (
  SELECT unit_id, len(tokens) AS unit_len, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS p FROM toks)
GROUP BY 1, 2, 3""")
def q_postings(spark, sf):
    return I.keyword_index(spark, sf).postings.select("term", "unit_id", "unit_len", "tf", "first_pos")


@query("bm25_topk", I.with_sql(I.WORKS_SQL, I.UNITS_SQL, I.QTERMS_SQL, BM25_SQL) + """
SELECT query_id, term_no, term, unit_id, pos, round_even(score, 6) AS score FROM qterms JOIN (
  SELECT term, unit_id, idf * weight AS score,
         row_number() OVER (PARTITION BY term ORDER BY weight DESC, unit_id) - 1 AS pos FROM scored) USING (term)
WHERE pos < 10""")
def q_bm25_topk(spark, sf):
    top = keyword.bm25_topk(I.keyword_index(spark, sf), I.shelf_question_terms(spark, sf), 10)
    return top.select("query_id", "term_no", "term", "unit_id", "pos", F.bround("score", 6).alias("score"))


_PHRASES_SQL = f"""
ph AS (
  SELECT query_id, t.i AS term_no, terms[t.i + 1] || ' ' || terms[t.i + 2] AS term
  FROM (SELECT item_id AS query_id, {I.sql_words('text')} AS terms FROM benchmark) q,
       LATERAL (SELECT unnest(range(0, len(q.terms) - 1)) AS i) t)
"""


@query("phrase_match", I.with_sql(I.UNITS_SQL, _PHRASES_SQL,
       f"toks AS (SELECT unit_id, {I.sql_words('text')} AS tokens FROM units)",
       """pairs AS (
  SELECT unit_id, tokens[i] || ' ' || tokens[i + 1] AS term, len(tokens) AS unit_len
  FROM (SELECT unit_id, tokens, unnest(range(1, len(tokens))) AS i FROM toks)),
posts AS (
  SELECT term, unit_id, unit_len, count(*) AS tf FROM pairs WHERE term IN (SELECT term FROM ph) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY 1),
stats AS (SELECT count(*) AS n_units, sum(len(tokens)) / count(*) AS mean_len FROM toks),
scored AS (
  SELECT term, unit_id, tf, round(tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * unit_len / mean_len)), 12) AS weight,
         greatest(ln((n_units - df + 0.5) / (df + 0.5)), 1e-6) AS idf FROM posts JOIN dfs USING (term), stats)""") + """
SELECT query_id, term_no, term, unit_id, pos, tf, round_even(score, 6) AS score FROM ph JOIN (
  SELECT term, unit_id, tf, idf * weight AS score,
         row_number() OVER (PARTITION BY term ORDER BY weight DESC, unit_id) - 1 AS pos FROM scored) USING (term)
WHERE pos < 10""")
def q_phrase_match(spark, sf):
    """Every two neighbouring words of every benchmark item, as phrases."""
    from quillspan.functions.text import words

    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), words(F.col("text")).alias("w"))
    phrases = items.select(
        "query_id", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.size("w").cast("long") - 2)).alias("term_no")
    ).select("query_id", "term_no", F.array_join(F.slice("w", F.col("term_no").cast("int") + 1, 2), " ").alias("term"))
    top = keyword.bm25_topk(I.keyword_index(spark, sf), phrases, 10)
    return top.select("query_id", "term_no", "term", "unit_id", "pos", "tf", F.bround("score", 6).alias("score"))


@query("term_hits", I.with_sql(I.UNITS_SQL, I.QTERMS_SQL, BM25_SQL) + """
SELECT term, count(*) AS n_units, count(DISTINCT unit_id // 1000000) AS n_groups FROM posts GROUP BY 1""")
def q_term_hits(spark, sf):
    groups = I.shelf_units(spark, sf).select("unit_id", I.CLASSIC.work(F.col("unit_id")).alias("group"))
    return keyword.term_hits(I.keyword_index(spark, sf), I.shelf_question_terms(spark, sf), groups)


# --- fusion and expansion --------------------------------------------------------

@query("rrf_fusion", I.with_sql(*SHELF, *HITS_SQL, lists_sql("primary")) + """
SELECT query_id, unit_id, round_even(s, 6) AS score, array_to_string(list_sort(o), ',') AS origins FROM (
  SELECT query_id, unit_id, round(sum(CASE WHEN listed THEN 1.0::DOUBLE / (60 + pos + 1) ELSE 0 END), 12) AS s,
         list(DISTINCT origin) AS o FROM lists GROUP BY 1, 2)""")
def q_rrf_fusion(spark, sf):
    index = I.search_index(spark, sf)
    fused = fusion.fuse(search.ranked_lists(index, _hits(spark, sf), "primary"), ["query_id"])
    return _joined(fused.select("query_id", "unit_id", F.bround("score", 6).alias("score"), "origins"))


@query("topic_expand", I.with_sql(I.WORKS_SQL, I.QVEC_SQL, I.VECTORS_SQL, _top_sql("ttop", "tvec", 5)) + """
SELECT query_id, unit_id, round_even(least(count(*), 3) * (0.5::DOUBLE / 61), 6) AS boost
FROM ttop JOIN (
  SELECT topic_id AS key, unit_id FROM (
    SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY unit_id) AS r FROM tunits)
  JOIN works ON work_id = unit_id // 1000000 WHERE r <= 60 AND collection = 'primary') USING (key)
GROUP BY 1, 2""")
def q_topic_expand(spark, sf):
    index = I.search_index(spark, sf)
    top = vector.vector_topk(I.shelf_question_vectors(spark, sf), index.topic_vectors, search.TOPIC_HITS)
    boost = fusion.topic_boost(top.select("query_id", F.col("key").alias("topic_id")), index.topic_units,
                               index.works, "primary")
    return boost.withColumn("boost", F.bround("boost", 6))


@query("edge_expand", I.with_sql(I.WORKS_SQL, I.QVEC_SQL, I.VECTORS_SQL, I.EDGES_SQL,
                                 _top_sql("utop", "uvec", 25)) + """
, scan AS (
  SELECT * FROM (
    SELECT query_id, to_id, row_number() OVER (PARTITION BY query_id ORDER BY from_id, to_id, anchor NULLS FIRST) AS r
    FROM utop JOIN edges ON from_id = key) WHERE r <= 800),
cnt AS (
  SELECT query_id, to_id AS unit_id, count(*) AS n FROM scan JOIN works ON work_id = to_id // 1000000
  WHERE collection = 'primary' GROUP BY 1, 2)
SELECT query_id, unit_id, round_even(least(n, 4) * (0.25::DOUBLE / 61), 6) AS boost FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, unit_id) AS r FROM cnt) WHERE r <= 200""")
def q_edge_expand(spark, sf):
    index = I.search_index(spark, sf)
    top = vector.vector_topk(I.shelf_question_vectors(spark, sf), index.unit_vectors, fusion.EDGE_ANCHORS)
    scores = top.select("query_id", F.col("key").alias("unit_id"), "score")
    boost = fusion.edge_boost(scores, index.edges, index.works, "primary", ["query_id"])
    return boost.withColumn("boost", F.bround("boost", 6))


@query("hybrid_search", I.with_sql(*hybrid_ctes()) + "SELECT query_id, pos, unit_id, score, origins FROM final")
def q_hybrid_search(spark, sf):
    return _joined(search.search(I.search_index(spark, sf), _hits(spark, sf), "primary"))


ADDITIVE_SQL = (
    *SHELF, *HITS_SQL, lists_sql("primary"), boosted_sql("primary"),
    lists_sql("secondary-only", "2"), boosted_sql("secondary-only", "2").replace("tcap AS NOT MATERIALIZED", "tcap2 AS NOT MATERIALIZED"),
    """
tail AS (SELECT query_id, min(score) AS s, count(*) AS p FROM final GROUP BY 1),
additive AS (
  SELECT query_id, pos, unit_id, score, origins, 'primary' AS collection, pos < 25 AS cut FROM final
  UNION ALL
  SELECT f.query_id, coalesce(p, 0) + f.pos, f.unit_id, round_even(coalesce(s, 0) - (f.pos + 1) * 1e-6::DOUBLE, 9),
         f.origins, 'secondary', TRUE
  FROM final2 f LEFT JOIN tail USING (query_id) WHERE f.pos < 8)""",
)


@query("additive_search", I.with_sql(*ADDITIVE_SQL) + "SELECT * FROM additive")
def q_additive_search(spark, sf):
    return _joined(search.additive_search(I.search_index(spark, sf), _hits(spark, sf)))


_SWITCHES_SQL = "switches AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', '{p}')" for c, paths in fusion.CONFIGURATIONS.items() for p in paths) + ") AS v(config, origin))"

ABLATION_SQL = (
    *SHELF, *HITS_SQL, lists_sql("primary"), _SWITCHES_SQL,
    "alists AS (SELECT config, l.* FROM lists l JOIN switches USING (origin))",
    boosted_sql("primary", "", "alists", "config, query_id",
                "CROSS JOIN (SELECT config FROM switches WHERE origin = '{path}')"),
)


def islands_sql(source: str = "final", scope: str = "query_id", out: str = "passages", gap: int = 1) -> str:
    """Gaps and islands over (work, chapter) as ``out``."""
    return f"""
{out}_o AS (
  SELECT *, CASE WHEN unit_id % 1000 - lag(unit_id % 1000) OVER w <= {gap} THEN 0 ELSE 1 END AS opens
  FROM {source} WINDOW w AS (PARTITION BY {scope}, unit_id // 1000 ORDER BY unit_id)),
{out}_n AS (
  SELECT *, sum(opens) OVER (PARTITION BY {scope}, unit_id // 1000 ORDER BY unit_id) AS island FROM {out}_o),
{out}_g AS (
  SELECT {scope}, unit_id // 1000000 AS work_id, (unit_id // 1000) % 1000 AS chapter, min(unit_id) % 1000 AS "first",
         max(unit_id) % 1000 AS "last", max(score) AS score, list(unit_id ORDER BY unit_id) AS unit_ids,
         min(unit_id) AS first_unit,
         array_to_string(list_sort(list_distinct(string_split(string_agg(origins, ','), ','))), ',') AS origins
  FROM {out}_n GROUP BY {scope}, unit_id // 1000000, (unit_id // 1000) % 1000, island),
{out} AS (
  SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY score DESC, first_unit) - 1 AS "rank" FROM {out}_g)
"""


def rerank_sql(source: str, scope: str, out: str) -> str:
    """The first 60 passages of ``source`` in the order of stand-in scores, as ``out``."""
    return f"""
{out}_t AS (
  SELECT {scope}, "rank", 'Vol' || any_value(work_id) || ' ' || any_value(chapter) || ':' || any_value("first")
           || CASE WHEN any_value("first") = any_value("last") THEN '' ELSE '-' || any_value("last") END
           || ' ' || string_agg(text, ' ' ORDER BY u) AS t
  FROM (SELECT *, unnest(unit_ids) AS u FROM {source} WHERE "rank" < 60) p JOIN units ON unit_id = u GROUP BY {scope}, "rank"),
{out} AS (
  SELECT s.*, row_number() OVER (PARTITION BY {scope} ORDER BY CASE WHEN "rank" < 60 THEN 0 ELSE 1 END,
           CASE WHEN "rank" < 60 THEN -coalesce(new_score, score) END NULLS FIRST, "rank") - 1 AS new_rank,
         CASE WHEN "rank" < 60 THEN coalesce(new_score, score) ELSE score END AS moved
  FROM {source} s LEFT JOIN (
    SELECT {scope}, "rank", round_even(1.0::DOUBLE / length(left(t, 2000)), 9) AS new_score FROM {out}_t) USING ({scope}, "rank"))
"""


ABLATION_PASSAGES_SQL = (
    *ABLATION_SQL, islands_sql("final", "config, query_id", "plain"), "best AS (SELECT * FROM plain WHERE config = 'F')",
    rerank_sql("best", "query_id", "again"), """
apassages AS (
  SELECT config, query_id, "rank", first_unit, score, origins, unit_ids FROM plain
  UNION ALL SELECT 'G', query_id, new_rank, first_unit, moved, origins, unit_ids FROM again)""",
)


def head_scores(spark, sf, passages: DataFrame, scope: list[str]) -> DataFrame:
    """Stand-in scores: shorter documents first (document = reference and texts, 2000 characters)."""
    from quillspan.functions.refs import reference

    units = I.shelf_units(spark, sf).select("unit_id", "text")
    texts = (
        passages.select(*scope, "rank", "work_id", "chapter", "first", "last", F.explode("unit_ids").alias("unit_id"))
        .join(units, "unit_id")
        .groupBy(*scope, "rank", "work_id", "chapter", "first", "last")
        .agg(F.array_sort(F.collect_list(F.struct("unit_id", "text"))).alias("parts"))
    )
    name = F.concat(F.lit("Vol"), F.col("work_id").cast("string"))
    document = F.concat(
        reference(name, F.col("chapter"), F.col("first"), F.col("last")), F.lit(" "),
        F.array_join(F.transform("parts", lambda p: p["text"]), " "),
    )
    return texts.select(*scope, "rank", F.bround(F.lit(1.0) / F.length(F.substring(document, 1, 2000)), 9).alias("new_score"))


def ablation_passages(spark, sf) -> DataFrame:
    scope = ["config", "query_id"]
    return search.ablation_passages(I.search_index(spark, sf), _hits(spark, sf), "primary",
                                    lambda head: head_scores(spark, sf, head, scope))


@query("ablation", I.with_sql(*ABLATION_PASSAGES_SQL) + """
SELECT config, query_id, "rank", first_unit, score, origins, array_to_string(unit_ids, ',') AS unit_ids FROM apassages""")
def q_ablation(spark, sf):
    """Passages of every configuration; G is F with its head reranked."""
    found = ablation_passages(spark, sf).withColumn("unit_ids", F.array_join("unit_ids", ","))
    return _joined(found.select("config", "query_id", "rank", "first_unit", "score", "origins", "unit_ids"))


# --- passages ------------------------------------------------------------------

PASSAGES_SQL = (*hybrid_ctes(), islands_sql())


def passages(spark, sf, mode: str = "primary") -> DataFrame:
    return fusion.islands(search.search(I.search_index(spark, sf), _hits(spark, sf), mode), ["query_id"])


@query("islands", I.with_sql(*PASSAGES_SQL) + """
SELECT query_id, "rank", work_id, chapter, "first", "last", score, origins,
       array_to_string(unit_ids, ',') AS unit_ids FROM passages""")
def q_islands(spark, sf):
    found = passages(spark, sf).select("query_id", "rank", "work_id", "chapter", "first", "last", "score",
                                       "origins", F.array_join("unit_ids", ",").alias("unit_ids"))
    return _joined(found)


BOTH_PASSAGES_SQL = (
    *hybrid_ctes("both"), islands_sql(), """
cut AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY collection, "rank") - 1 AS cut_pos FROM (
    SELECT p.*, collection, abbrev, name, row_number() OVER (PARTITION BY query_id, collection ORDER BY "rank") - 1 AS ic
    FROM passages p JOIN works USING (work_id)) WHERE ic < CASE WHEN collection = 'secondary' THEN 8 ELSE 25 END)""",
)


def both_cut(spark, sf) -> DataFrame:
    located = passages(spark, sf, "both").join(I.shelf_works(spark, sf), "work_id")
    return fusion.top_cut(located, ["query_id"], "both")


@query("top_cut", I.with_sql(*BOTH_PASSAGES_SQL)
       + 'SELECT query_id, cut_pos, "rank", collection, first_unit, score FROM cut')
def q_top_cut(spark, sf):
    return both_cut(spark, sf).select("query_id", "cut_pos", "rank", "collection", "first_unit", "score")


@query("rerank_head", I.with_sql(*PASSAGES_SQL, rerank_sql("passages", "query_id", "again")) + """
SELECT query_id, "rank", new_rank, first_unit, moved AS score FROM again""")
def q_rerank_head(spark, sf):
    found = stored(passages(spark, sf), "passages")  # read for the head and for the order
    scores = head_scores(spark, sf, found.where(F.col("rank") < fusion.RERANK_HEAD), ["query_id"])
    return fusion.rerank_head(found, scores, ["query_id"]).select(
        "query_id", "rank", "new_rank", "first_unit", "score"
    )
