"""Derived inputs of the published queries, each beside the SQL that states it.

``*_SQL`` constants are common table expressions for DuckDB; ``with_sql``
assembles the ones a query needs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.keys import CLASSIC, WIDE
from quillspan.functions.text import ACCENTED, STOPWORDS, UNACCENTED, question_terms, strip_edges, words
from quillspan.operators.fusion import numbered_edges
from quillspan.operators.keyword import KeywordIndex, open_index, write_index
from quillspan.operators.search import SearchIndex
from quillspan.session import checkpoint_dir, stored
from quillspan.sources.tables import table


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n"


# --- scalar SQL fragments -------------------------------------------------------

def sql_words(text: str) -> str:
    return (
        f"list_filter(string_split_regex(translate(lower({text}), '{ACCENTED}', '{UNACCENTED}'), "
        "'[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
    )


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def sql_question_terms(text: str) -> str:
    """Content words in first-seen order (list_distinct does not keep the order)."""
    kept = (
        f"list_filter(list_transform(string_split_regex({text}, '[^\\p{{L}}\\p{{N}}'']+'), "
        "lambda w: lower(regexp_replace(w, '^''+|''+$', '', 'g'))), "
        f"lambda w: strlen(w) >= 3 AND w NOT IN ({_STOP}))"
    )
    return f"list_filter({kept}, lambda w, i: list_position({kept}, w) = i)"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"


# --- the shelf: documents as units ----------------------------------------------
# A hundred documents make a work, twenty a chapter and five a block.

def shelf_key(doc_id: Column) -> Column:
    work = F.call_function("div", doc_id, F.lit(100)) + 1
    chapter = F.call_function("div", doc_id % 100, F.lit(20)) + 1
    return CLASSIC.pack(work, chapter, doc_id % 20 + 1)


def sql_key(doc: str) -> str:
    return f"(({doc}) // 100 + 1) * 1000000 + ((({doc}) % 100) // 20 + 1) * 1000 + ({doc}) % 20 + 1"


def shelf_works(spark: SparkSession, sf: str) -> DataFrame:
    work = F.call_function("div", F.col("doc_id"), F.lit(100)) + 1
    works = table(spark, sf, "documents").select(work.cast("long").alias("work_id")).distinct()
    return works.select(
        "work_id",
        F.concat(F.lit("Vol"), F.col("work_id").cast("string")).alias("abbrev"),
        F.concat(F.lit("Volume "), F.col("work_id").cast("string")).alias("name"),
        F.when(F.col("work_id") % 3 == 0, "secondary").otherwise("primary").alias("collection"),
    )


WORKS_SQL = """
works AS (
  SELECT work_id, 'Vol' || work_id AS abbrev, 'Volume ' || work_id AS name,
         CASE WHEN work_id % 3 = 0 THEN 'secondary' ELSE 'primary' END AS collection
  FROM (SELECT DISTINCT doc_id // 100 + 1 AS work_id FROM documents))
"""


def shelf_units(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(shelf_key(F.col("doc_id")).alias("unit_id"), "doc_id", "text")


UNITS_SQL = f"units AS (SELECT {sql_key('doc_id')} AS unit_id, doc_id, text FROM documents)"


def shelf_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item is a question; its vector is the one stored under its id."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return items.join(vectors, "query_id")


def shelf_question_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return shelf_questions(spark, sf).select("query_id", "vec")


def shelf_question_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Content words of every item, its first two words as a phrase, and its third word with an accent."""
    items = table(spark, sf, "benchmark").withColumn("w", words(F.col("text")))
    planted = F.array(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))),
                      F.translate(F.coalesce(F.get("w", F.lit(2)), F.lit("")), "eao", "éàô"))
    return items.select(
        F.col("item_id").alias("query_id"),
        F.posexplode(F.concat(question_terms(F.col("text")), planted)).alias("term_no", "term"),
    ).withColumn("term_no", F.col("term_no").cast("long"))


QVEC_SQL = """
qvec AS (
  SELECT item_id AS query_id, CAST(embedding AS DOUBLE[]) AS vec
  FROM benchmark JOIN embeddings ON vec_id = item_id)
"""
QTERMS_SQL = f"""
qterm_lists AS (
  SELECT item_id AS query_id, {sql_question_terms('text')} || [concat_ws(' ', w[1], w[2]), translate(coalesce(w[3], ''), 'eao', 'éàô')] AS terms
  FROM (SELECT *, {sql_words('text')} AS w FROM benchmark)),
qterms AS (
  SELECT query_id, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS term_no FROM qterm_lists)
"""


def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        shelf_key(F.col("vec_id")).alias("key"), F.col("embedding").alias("vec"), "vec_id", "label"
    )


def block_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Five consecutive vectors make a block, represented by the block's first."""
    first = table(spark, sf, "embeddings").withColumn("_block", F.call_function("div", F.col("vec_id"), F.lit(5)))
    lead = first.groupBy("_block").agg(F.min_by("embedding", "vec_id").alias("vec"))
    return lead.select(shelf_key(F.col("_block") * 5).alias("key"), "vec")


def block_members(spark: SparkSession, sf: str) -> DataFrame:
    vec_id = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        shelf_key(vec_id - vec_id % 5).alias("block_id"), shelf_key(vec_id).alias("unit_id")
    )


def topic_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vecs = table(spark, sf, "embeddings")
    return vecs.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vec")).select(
        (F.col("label").cast("long") + 1).alias("key"), "vec"
    )


def topic_units(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        (F.col("label").cast("long") + 1).alias("topic_id"), shelf_key(F.col("vec_id")).alias("unit_id")
    )


def topics(spark: SparkSession, sf: str) -> DataFrame:
    """Ten leaf topics under three roots; every label of the vectors is one leaf."""
    leaves = table(spark, sf, "embeddings").select((F.col("label").cast("long") + 1).alias("topic_id")).distinct()
    leaf = leaves.select(
        "topic_id",
        F.concat(F.lit("Matter of group "), F.col("topic_id").cast("string"), F.lit(", as first seen")).alias("heading"),
        (F.lit(100) + F.col("topic_id") % 3).cast("long").alias("parent_id"),
    )
    root = leaf.select(
        F.col("parent_id").alias("topic_id"),
        F.concat(F.lit("Root "), F.col("parent_id").cast("string")).alias("heading"),
        F.lit(None).cast("long").alias("parent_id"),
    ).distinct()
    return leaf.unionByName(root)


VECTORS_SQL = f"""
uvec AS (SELECT {sql_key('vec_id')} AS key, CAST(embedding AS DOUBLE[]) AS vec, vec_id, label FROM embeddings),
bvec AS (
  SELECT {sql_key('b * 5')} AS key, vec FROM (
    SELECT vec_id // 5 AS b, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS vec FROM embeddings GROUP BY 1)),
bmembers AS (SELECT {sql_key('vec_id - vec_id % 5')} AS block_id, {sql_key('vec_id')} AS unit_id FROM embeddings),
tvec AS (
  SELECT CAST(label AS BIGINT) + 1 AS key, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS vec
  FROM embeddings GROUP BY 1),
tunits AS (SELECT CAST(label AS BIGINT) + 1 AS topic_id, {sql_key('vec_id')} AS unit_id FROM embeddings)
"""
TOPICS_SQL = """
leaf AS (
  SELECT DISTINCT CAST(label AS BIGINT) + 1 AS topic_id,
         'Matter of group ' || (label + 1) || ', as first seen' AS heading,
         CAST(100 + (label + 1) % 3 AS BIGINT) AS parent_id
  FROM embeddings),
topics AS (
  SELECT * FROM leaf
  UNION ALL SELECT DISTINCT parent_id, 'Root ' || parent_id, CAST(NULL AS BIGINT) FROM leaf)
"""


def edge_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The order/part graph folded onto the shelf, repeats included; every eleventh anchor is missing."""
    lines = table(spark, sf, "lineitem")
    n_docs = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n")).scalar()
    anchor = F.when((F.col("l_orderkey") + F.col("l_partkey")) % 11 != 0, F.col("l_returnflag"))
    return lines.select(
        shelf_key(F.col("l_orderkey") % n_docs).alias("from_id"),
        shelf_key(F.col("l_partkey") % n_docs).alias("to_id"),
        anchor.alias("anchor"),
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return edge_rows(spark, sf).distinct()


EDGES_SQL = f"""
folded AS (
  SELECT DISTINCT l_orderkey % n AS f, l_partkey % n AS t,
         CASE WHEN (l_orderkey + l_partkey) % 11 <> 0 THEN l_returnflag END AS anchor
  FROM lineitem, (SELECT count(*) AS n FROM documents)),
edges AS (SELECT {sql_key('f')} AS from_id, {sql_key('t')} AS to_id, anchor FROM folded)
"""


_KEYWORDS: dict[tuple[str, str], KeywordIndex] = {}


def keyword_index(spark: SparkSession, sf: str) -> KeywordIndex:
    """The stored keyword index over the shelf, written once per application and folder."""
    name = (spark.sparkContext.applicationId, sf)
    if name not in _KEYWORDS:
        path = f"{checkpoint_dir(spark)}/keywords-{uuid.uuid4().hex}"
        write_index(shelf_units(spark, sf).select("unit_id", "text"), path)
        _KEYWORDS[name] = open_index(spark, path)
    return _KEYWORDS[name]


_SEARCH: dict[tuple[str, str], SearchIndex] = {}


def search_index(spark: SparkSession, sf: str) -> SearchIndex:
    """The stored tables a search reads, written once per application and folder."""
    name = (spark.sparkContext.applicationId, sf)
    if name not in _SEARCH:
        links = edge_rows(spark, sf).repartition("from_id").distinct()  # dealt once, for the repeats and the numbers
        _SEARCH[name] = SearchIndex(
            unit_vectors=stored(unit_vectors(spark, sf).select("key", "vec"), "unit-vectors"),
            block_vectors=stored(block_vectors(spark, sf), "block-vectors"),
            block_members=stored(block_members(spark, sf), "block-members"),
            topic_vectors=stored(topic_vectors(spark, sf), "topic-vectors"),
            topic_units=stored(topic_units(spark, sf), "topic-units"),
            keywords=keyword_index(spark, sf),
            edges=stored(numbered_edges(links), "edges"),
            works=stored(shelf_works(spark, sf), "works"),
        )
    return _SEARCH[name]


# --- the line corpus: lines of documents as units ---------------------------------

def corpus_works(spark: SparkSession, sf: str) -> DataFrame:
    number = F.regexp_extract("source", r"([0-9]+)$", 1).cast("long")
    works = table(spark, sf, "documents").select("source").distinct().withColumn("n", number)
    return works.select(
        (F.col("n") + 1).alias("work_id"),
        F.upper("source").alias("code"),
        F.concat(F.lit("S"), F.col("n").cast("string")).alias("abbrev"),
        F.concat(F.lit("The Collected Source, Commonly Called Source"), F.col("n").cast("string")).alias("name"),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit("Source "), F.col("n").cast("string"))).alias("display_name"),
        F.when((F.col("n") + 1) % 4 == 0, "secondary").otherwise("primary").alias("collection"),
        F.when(F.col("n") < 10, "early").otherwise("late").alias("era"),
    )


CORPUS_WORKS_SQL = """
cworks AS (
  SELECT n + 1 AS work_id, upper(source) AS code, 'S' || n AS abbrev,
         'The Collected Source, Commonly Called Source' || n AS name,
         CASE WHEN n % 2 = 0 THEN 'Source ' || n END AS display_name,
         CASE WHEN (n + 1) % 4 = 0 THEN 'secondary' ELSE 'primary' END AS collection,
         CASE WHEN n < 10 THEN 'early' ELSE 'late' END AS era
  FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS n FROM documents))
"""


def corpus_units(spark: SparkSession, sf: str) -> DataFrame:
    """Non-empty lines; a document is a chapter of its source, a line its ordinal."""
    docs = table(spark, sf, "documents")
    lines = docs.select(
        (F.regexp_extract("source", r"([0-9]+)$", 1).cast("long") + 1).alias("work_id"),
        (F.col("doc_id") + 1).alias("chapter"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"),
    )
    ordinal = (F.col("line_no") + 1).cast("long")
    return (
        lines.select("work_id", "chapter", ordinal.alias("ordinal"), strip_edges(F.col("line")).alias("text"))
        .where(F.col("text") != "")
        .withColumn("unit_id", WIDE.checked(F.col("work_id"), F.col("chapter"), F.col("ordinal")))
        .withColumn("block_no", F.call_function("div", F.col("ordinal") - 1, F.lit(5)))
    )


def corpus_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of five lines; even-numbered blocks carry their first words as heading."""
    from quillspan.functions.text import first_words

    grouped = corpus_units(spark, sf).groupBy("work_id", "chapter", "block_no").agg(
        F.min("unit_id").alias("start_id"), F.max("unit_id").alias("end_id"),
        F.count(F.lit(1)).alias("n_units"), F.min_by("text", "unit_id").alias("_first"),
    )
    return grouped.withColumn(
        "heading", F.when(F.col("block_no") % 2 == 0, first_words(F.col("_first"), 3))
    ).drop("_first")


CORPUS_UNITS_SQL = f"""
clines AS (
  SELECT CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) + 1 AS work_id, doc_id + 1 AS chapter,
         unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS ordinal
  FROM documents),
cunits AS (
  SELECT work_id, chapter, ordinal, {sql_strip('line')} AS text,
         work_id * 100000000000000 + chapter * 100000 + ordinal AS unit_id, (ordinal - 1) // 5 AS block_no
  FROM clines WHERE {sql_strip('line')} <> '')
"""
CORPUS_BLOCKS_SQL = """
cblocks AS (
  SELECT work_id, chapter, block_no, min(unit_id) AS start_id, max(unit_id) AS end_id, count(*) AS n_units,
         CASE WHEN block_no % 2 = 0 THEN array_to_string(list_slice(string_split(
           regexp_replace(arg_min(text, unit_id), '[ \\t\\r\\n]+', ' ', 'g'), ' '), 1, 3), ' ') END AS heading
  FROM cunits GROUP BY 1, 2, 3)
"""


# --- citable works: regions, nations and customer groups ---------------------------

from quillspan.functions.keys import KeyLayout  # noqa: E402

CITABLE = KeyLayout(chapter_radix=1_000, ordinal_radix=1_000_000)


def citable_works(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select(
        (F.col("r_regionkey").cast("long") + 1).alias("work_id"),
        F.concat((F.col("r_regionkey") + 1).cast("string"), F.substring("r_name", 1, 2)).alias("code"),
        F.initcap("r_name").alias("abbrev"),
        F.concat(F.lit("The Book Commonly Called "), F.initcap("r_name")).alias("name"),
    )


def citable_units(spark: SparkSession, sf: str) -> DataFrame:
    """One unit per group of 25 customer keys that a nation really has."""
    nations = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    customers = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("n_nationkey"),
        (F.call_function("div", F.col("c_custkey"), F.lit(25)) + 1).cast("long").alias("ordinal"),
        "c_name",
    )
    grouped = customers.groupBy("n_nationkey", "ordinal").agg(F.min("c_name").alias("text"))
    located = grouped.join(nations, "n_nationkey").select(
        (F.col("n_regionkey").cast("long") + 1).alias("work_id"),
        (F.col("n_nationkey").cast("long") + 1).alias("chapter"), "ordinal", "text",
    )
    return located.withColumn("unit_id", CITABLE.checked(F.col("work_id"), F.col("chapter"), F.col("ordinal")))


CITABLE_SQL = """
rworks AS (
  SELECT CAST(r_regionkey AS BIGINT) + 1 AS work_id, (r_regionkey + 1) || left(r_name, 2) AS code, nm AS abbrev,
         'The Book Commonly Called ' || nm AS name
  FROM (SELECT r_regionkey, r_name, array_to_string(list_transform(string_split(r_name, ' '),
          lambda w: upper(w[1]) || lower(w[2:])), ' ') AS nm FROM region)),
runits AS (
  SELECT CAST(n_regionkey AS BIGINT) + 1 AS work_id, CAST(n_nationkey AS BIGINT) + 1 AS chapter,
         c_custkey // 25 + 1 AS ordinal, min(c_name) AS text,
         (CAST(n_regionkey AS BIGINT) + 1) * 1000000000 + (CAST(n_nationkey AS BIGINT) + 1) * 1000000
           + c_custkey // 25 + 1 AS unit_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
"""
