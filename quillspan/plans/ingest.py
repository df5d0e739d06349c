"""Published ingest queries: segmentation, markup, outlines, blocks, metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions.keys import WIDE
from quillspan.functions.refs import reader_name, reference
from quillspan.functions.text import plain_text
from quillspan.operators import ingest
from quillspan.plans import inputs as I
from quillspan.plans.registry import query
from quillspan.sources.tables import table

SQL_CLEAN = (
    "regexp_replace(regexp_replace({c}, '(?is)<(script|style)\\b.*?</(script|style)>', '{r}', 'g'), "
    "'(?s)<!--.*?-->', '{r}', 'g')"
)


def sql_collapse(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '[ \\t\\r\\n]+', ' ', 'g'), '^ | $', '', 'g')"


def sql_plain(text: str) -> str:
    clean = SQL_CLEAN.format(c=text, r=" ")
    return sql_collapse(f"replace(replace(regexp_replace({clean}, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&')")


ROWS_SQL = f"""
hlines AS (
  SELECT page_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM (
    SELECT page_id, string_split(replace({SQL_CLEAN.format(c='html', r='')}, '<', chr(10) || '<'), chr(10)) AS l FROM pages)),
htag AS (
  SELECT page_id, pos, lower(regexp_extract(line, '^<([a-zA-Z]+[0-9]?)', 1)) AS tag,
         {sql_collapse("replace(regexp_replace(line, '^<[^>]*>', ' '), '&amp;', '&')")} AS text FROM hlines),
hkind AS (
  SELECT *, CASE WHEN tag IN ('nav', 'article', 'footer') THEN 'chapter'
                 WHEN regexp_full_match(tag, 'h[1-6]') THEN 'heading'
                 WHEN tag IN ('p', 'li') THEN 'unit' WHEN tag = 'div' THEN 'paragraph'
                 WHEN tag IN ('title', 'html', 'head', 'body', 'meta') THEN 'front' ELSE 'line' END AS kind
  FROM htag),
hrow AS (
  SELECT page_id, pos, tag, kind, text,
         count(*) FILTER (kind = 'unit') OVER w AS units_so_far,
         coalesce(last_value(CASE WHEN kind = 'chapter' THEN CASE tag WHEN 'nav' THEN 1 WHEN 'article' THEN 2 ELSE 3 END END
                  IGNORE NULLS) OVER w, 0) AS chapter,
         coalesce(last_value(CASE WHEN kind = 'unit' THEN pos WHEN kind IN ('chapter', 'heading', 'paragraph') THEN -1 END
                  IGNORE NULLS) OVER w, -1) AS unit_pos
  FROM hkind WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
hstretch AS (
  SELECT *, units_so_far - CASE WHEN kind = 'unit' THEN 1 ELSE 0 END AS stretch FROM hrow),
hpend AS (
  SELECT page_id, stretch, arg_max(text, pos) FILTER (kind = 'heading') AS heading,
         bool_or(kind = 'heading') AS has_heading FROM hstretch GROUP BY 1, 2),
hopen AS (
  SELECT s.*, coalesce(has_heading, FALSE) AS has_heading, heading,
         count(*) FILTER (kind = 'unit') OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block_no
  FROM hstretch s LEFT JOIN hpend USING (page_id, stretch))
"""


@query("segment_units", I.with_sql(ROWS_SQL) + f"""
SELECT doc_id, chapter, ordinal, block_no, text FROM (
  SELECT page_id AS doc_id, max(chapter) FILTER (kind = 'unit') AS chapter, max(units_so_far) FILTER (kind = 'unit') AS ordinal,
         max(block_no) FILTER (kind = 'unit') AS block_no, {sql_collapse("string_agg(text, ' ' ORDER BY pos)")} AS text
  FROM hopen WHERE unit_pos >= 0 AND kind IN ('unit', 'line', 'paragraph') GROUP BY page_id, unit_pos) WHERE text <> ''""")
def q_segment_units(spark, sf):
    units = ingest.segment_units(ingest.html_rows(table(spark, sf, "pages")), marked=False)
    return units.select("doc_id", F.col("chapter").cast("long").alias("chapter"), "ordinal", "block_no", "text")


@query("segment_blocks", I.with_sql(ROWS_SQL) + """
SELECT page_id AS doc_id, block_no, nullif(CASE WHEN has_heading THEN heading END, '') AS heading,
       CASE WHEN has_heading THEN 'heading' ELSE 'paragraph' END AS source
FROM hopen WHERE kind = 'unit'""")
def q_segment_blocks(spark, sf):
    return ingest.segment_blocks(ingest.html_rows(table(spark, sf, "pages")), marked=False)


@query("omitted_markers", I.with_sql(ROWS_SQL) + """
SELECT page_id AS doc_id, pos, kind FROM hopen m WHERE kind IN ('unit', 'paragraph') AND NOT EXISTS (
  SELECT 1 FROM hopen u WHERE u.page_id = m.page_id AND u.unit_pos = m.pos AND u.kind IN ('unit', 'line') AND u.text <> '')""")
def q_omitted_markers(spark, sf):
    rows = ingest.html_rows(table(spark, sf, "pages"))
    units = ingest.segment_units(rows, marked=False).withColumnRenamed("unit_pos", "pos")
    markers = rows.where(F.col("kind").isin("unit", "paragraph")).select("doc_id", "pos", "kind")
    return ingest.omitted_markers(markers, units, ["doc_id", "pos"])


@query("strip_markup", f"SELECT page_id, {sql_plain('html')} AS text FROM pages")
def q_strip_markup(spark, sf):
    return table(spark, sf, "pages").select("page_id", plain_text(F.col("html")).alias("text"))


LINK = r'(?is)<a href="([^"]*)"[^>]*>(.*?)</a>'
LED_LINK = r'(?is)(.*?)<a href="([^"]*)"[^>]*>(.*?)</a>'


@query("anchored_links", f"""
WITH spans AS (
  SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '{LED_LINK}', 1)) AS before_text,
         unnest(regexp_extract_all(html, '{LED_LINK}', 2)) AS reference, unnest(regexp_extract_all(html, '{LED_LINK}', 3)) AS body,
         generate_subscripts(regexp_extract_all(html, '{LED_LINK}', 2), 1) - 1 AS ref_no FROM pages),
named AS (SELECT *, nullif(regexp_replace({sql_plain('before_text')}, '[. ]+$', ''), '') AS own FROM spans)
SELECT doc_id, ref_no, anchor, reference, body FROM (
  SELECT doc_id, ref_no, reference, {sql_plain('body')} AS body,
         last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ref_no ROWS UNBOUNDED PRECEDING) AS anchor
  FROM named) WHERE NOT regexp_matches(reference, '[.,]$') AND body <> ''""")
def q_anchored_links(spark, sf):
    """Links of every page; targets that end in punctuation count as navigation."""
    entries = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return ingest.anchored_references(entries, LINK, lambda ref: ref.rlike("[.,]$"))


LINE = r"<br>|<li>|<p>"
REF = r'<a href="/([^A-Z"][^"]*)"[^>]*>[^<]*</a>'
SEE = r'<a href="/([A-Z][^"]*)"[^>]*>'

OUTLINE_SQL = f"""
olines AS (
  SELECT page_id AS doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM (
    SELECT page_id, string_split_regex({SQL_CLEAN.format(c='html', r=' ')}, '{LINE}') AS l FROM pages)),
outline AS (
  SELECT doc_id, line_no, nullif(regexp_replace({sql_collapse(
    f"replace(replace(regexp_replace(regexp_replace(regexp_replace(line, '{REF}', ' ', 'g'), '{SEE}', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), chr(8594), ' ')"
  )}, '^[ .;:,]+|[ .;:,]+$', '', 'g'), '') AS label,
         regexp_extract_all(line, '{REF}', 1) AS refs, regexp_extract_all(line, '{SEE}', 1) AS see
  FROM olines),
kept AS (SELECT * FROM outline WHERE len(refs) > 0 OR len(see) > 0 OR label IS NOT NULL)
"""


def page_outline(spark, sf):
    clean = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    clean = F.regexp_replace(clean, r"(?s)<!--.*?-->", " ")
    entries = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), clean.alias("text"))
    return ingest.outline_lines(entries, LINE, REF, SEE)


@query("outline_lines", I.with_sql(OUTLINE_SQL) + """
SELECT doc_id, line_no, label, array_to_string(refs, '|') AS refs, array_to_string(see, ', ') AS see FROM kept""")
def q_outline_lines(spark, sf):
    rows = page_outline(spark, sf)
    return rows.withColumn("refs", F.array_join("refs", "|")).withColumn("see", F.array_join("see", ", "))


@query("topic_tree", I.with_sql(OUTLINE_SQL, f"""
entry AS (SELECT page_id AS doc_id, {sql_plain("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS heading FROM pages),
pointer AS (
  SELECT doc_id, arg_min(see, line_no) AS see FROM kept WHERE len(refs) = 0 AND len(see) > 0 GROUP BY 1),
node AS (
  SELECT doc_id, -1 AS line_no, heading, array_to_string(see, ', ') AS see_also, NULL AS refs
  FROM entry LEFT JOIN pointer USING (doc_id)
  UNION ALL
  SELECT doc_id, line_no, coalesce(label, heading), CASE WHEN len(see) > 0 THEN array_to_string(see, ', ') END, refs
  FROM kept JOIN entry USING (doc_id) WHERE len(refs) > 0),
ids AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS topic_id FROM node),
tree AS (
  SELECT t.*, CASE WHEN t.line_no >= 0 THEN r.topic_id END AS parent_id
  FROM ids t JOIN ids r ON r.doc_id = t.doc_id AND r.line_no = -1),
member AS (
  SELECT DISTINCT topic_id, ref FROM (
    SELECT topic_id, unnest(refs) AS ref FROM tree WHERE line_no >= 0
    UNION ALL SELECT parent_id, unnest(refs) FROM tree WHERE line_no >= 0)),
sizes AS (SELECT topic_id, count(*) AS n_units FROM member GROUP BY 1)""") + """
SELECT topic_id, doc_id, line_no, heading, parent_id, see_also, coalesce(n_units, 0) AS n_units
FROM tree LEFT JOIN sizes USING (topic_id)""")
def q_topic_tree(spark, sf):
    title = plain_text(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))
    entries = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), title.alias("heading"))
    topics, members = ingest.topic_tree(entries, page_outline(spark, sf))
    sizes = members.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_units"))
    return topics.join(sizes, "topic_id", "left").fillna(0, ["n_units"])


# --- the line corpus ------------------------------------------------------------

BLOCK_RANGE = WIDE.ordinal_radix * 65_536


@query("block_bounds", I.with_sql(I.CORPUS_UNITS_SQL, I.CORPUS_BLOCKS_SQL) + """
SELECT work_id, chapter, block_no, start_id, end_id, n_units,
       row_number() OVER (ORDER BY start_id) AS block_id FROM cblocks""")
def q_block_bounds(spark, sf):
    return ingest.block_bounds(I.corpus_units(spark, sf), ["work_id", "chapter", "block_no"], BLOCK_RANGE)


@query("block_members", I.with_sql(I.CORPUS_UNITS_SQL, I.CORPUS_BLOCKS_SQL) + """
SELECT b.start_id AS block_id, u.unit_id FROM cunits u JOIN cblocks b
  ON u.work_id = b.work_id AND u.chapter = b.chapter AND u.unit_id BETWEEN b.start_id AND b.end_id""")
def q_block_members(spark, sf):
    blocks = I.corpus_blocks(spark, sf).withColumn("block_id", F.col("start_id"))
    units = I.corpus_units(spark, sf).select("work_id", "chapter", "unit_id")
    return ingest.block_of_units(units, blocks, ["work_id", "chapter"]).select("block_id", "unit_id")


@query("unit_key_roundtrip", I.with_sql(I.CORPUS_UNITS_SQL) + """
SELECT unit_id, unit_id // 100000000000000 AS work_id, (unit_id % 100000000000000) // 100000 AS chapter,
       unit_id % 100000 AS ordinal, ordinal < 100000 AND chapter < 1000000000 AS fits FROM cunits""")
def q_unit_key_roundtrip(spark, sf):
    key = F.col("unit_id")
    return I.corpus_units(spark, sf).select(
        "unit_id", WIDE.work(key).alias("work_id"), WIDE.chapter(key).alias("chapter"),
        WIDE.ordinal(key).alias("ordinal"), WIDE.fits(F.col("chapter"), F.col("ordinal")).alias("fits"),
    )


@query("fetch_units", I.with_sql(I.UNITS_SQL) + """
SELECT unit_id, text FROM units WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY unit_id""")
def q_fetch_units(spark, sf):
    wanted = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return I.shelf_units(spark, sf).join(wanted, "doc_id", "left_semi").select("unit_id", "text").orderBy("unit_id")


@query("unit_templates", I.with_sql(I.CORPUS_WORKS_SQL, I.CORPUS_UNITS_SQL, I.CORPUS_BLOCKS_SQL) + """
SELECT u.unit_id, abbrev || ' ' || u.chapter || ':' || ordinal ||
       CASE WHEN heading IS NULL THEN '' ELSE ' — ' || heading END || chr(10) || text AS text
FROM cunits u JOIN cworks USING (work_id) LEFT JOIN cblocks b
  ON b.work_id = u.work_id AND b.chapter = u.chapter AND b.block_no = u.block_no""")
def q_unit_templates(spark, sf):
    from quillspan.operators.embedprep import unit_templates

    return unit_templates(I.corpus_units(spark, sf), I.corpus_works(spark, sf), I.corpus_blocks(spark, sf),
                          ["work_id", "chapter", "block_no"])


@query("topic_templates", """
SELECT 'nation' AS kind, CAST(n_nationkey AS BIGINT) AS topic_id, r_name || ' — ' || n_name AS text
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'region', CAST(r_regionkey AS BIGINT), r_name FROM region
UNION ALL SELECT 'customer', c_custkey, n_name || ' — ' || c_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def q_topic_templates(spark, sf):
    from quillspan.operators.embedprep import topic_templates

    region = table(spark, sf, "region").select(
        F.lit("region").alias("kind"), F.col("r_regionkey").cast("long").alias("topic_id"),
        F.col("r_name").alias("heading"), F.lit(None).cast("string").alias("parent_kind"),
        F.lit(None).cast("long").alias("parent_id"))
    nation = table(spark, sf, "nation").select(
        F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("topic_id"),
        F.col("n_name").alias("heading"), F.lit("region").alias("parent_kind"),
        F.col("n_regionkey").cast("long").alias("parent_id"))
    customer = table(spark, sf, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("topic_id"), F.col("c_name").alias("heading"),
        F.lit("nation").alias("parent_kind"), F.col("c_nationkey").cast("long").alias("parent_id"))
    every = region.unionByName(nation).unionByName(customer)
    return topic_templates(every, region.unionByName(nation))


@query("format_refs", I.with_sql(I.CORPUS_WORKS_SQL, I.CORPUS_UNITS_SQL, I.CORPUS_BLOCKS_SQL) + """
SELECT start_id, abbrev || ' ' || r AS compact, coalesce(nullif(trim(display_name), ''), name) || ' ' || r AS reader FROM (
  SELECT *, chapter || ':' || (start_id % 100000)
         || CASE WHEN start_id = end_id THEN '' ELSE '-' || (end_id % 100000) END AS r FROM cblocks) JOIN cworks USING (work_id)""")
def q_format_refs(spark, sf):
    blocks = I.corpus_blocks(spark, sf).join(I.corpus_works(spark, sf), "work_id")
    parts = (F.col("chapter"), WIDE.ordinal(F.col("start_id")), WIDE.ordinal(F.col("end_id")))
    return blocks.select(
        "start_id", reference(F.col("abbrev"), *parts).alias("compact"),
        reference(reader_name(F.col("display_name"), F.col("name")), *parts).alias("reader"),
    )


# Columns of the tables: (i)nteger or text, (d)ouble, (t)ime, (a)rray of fractions.
TABLES = {
    "region": "i:r_regionkey i:r_name", "nation": "i:n_nationkey i:n_name i:n_regionkey",
    "customer": "i:c_custkey i:c_name i:c_nationkey d:c_acctbal i:c_mktsegment",
    "supplier": "i:s_suppkey i:s_name i:s_nationkey d:s_acctbal",
    "part": "i:p_partkey i:p_name i:p_brand i:p_type i:p_size d:p_retailprice",
    "orders": "i:o_orderkey i:o_custkey i:o_orderstatus d:o_totalprice t:o_orderdate i:o_orderpriority",
    "lineitem": "i:l_orderkey i:l_partkey i:l_suppkey i:l_linenumber d:l_quantity d:l_extendedprice d:l_discount d:l_tax "
                "i:l_returnflag i:l_linestatus t:l_shipdate",
    "events": "i:event_id t:ts i:user_id i:event_type d:value i:props",
    "documents": "i:doc_id i:text i:lang i:source i:n_chars", "embeddings": "i:vec_id a:embedding i:label",
    "pages": "i:page_id i:url i:html", "benchmark": "i:item_id i:text", "labels": "i:doc_id i:quality i:toxic",
    "conversations": "i:conv_id i:turn i:role i:text",
}
_RENDER = {
    "i": "CAST({0} AS VARCHAR)", "d": "CAST(CAST(round({0} * 100) AS BIGINT) AS VARCHAR)", "t": "CAST(epoch_us({0}) AS VARCHAR)",
    "a": "array_to_string(list_transform({0}, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ',')",
}


def _meta_sql() -> str:
    parts = ["SELECT 'index_version' AS key, '0.1.0' AS value", "SELECT 'schema_version', '1'"]
    for name, columns in TABLES.items():
        row = ", ".join("coalesce(" + _RENDER[c[0]].format(c[2:]) + ", '~')" for c in columns.split())
        parts.append(f"SELECT 'rows_{name}', CAST(count(*) AS VARCHAR) FROM {name}")
        parts.append(f"SELECT 'fingerprint_{name}', CAST(coalesce(sum(CAST('0x' || substr(md5(concat_ws('|', {row})), 1, 12) AS BIGINT)), 0) "
                     f"AS VARCHAR) FROM {name}")
    return " UNION ALL ".join(parts)


@query("index_meta", _meta_sql())
def q_index_meta(spark, sf):
    """Row counts and order-independent content fingerprints of all tables."""
    from quillspan.sources.provenance import index_metadata

    tables = {name: table(spark, sf, name).select([c[2:] for c in columns.split()]) for name, columns in TABLES.items()}
    return index_metadata(spark, tables, {"index_version": "0.1.0", "schema_version": "1"})


@query("source_checksums")
def q_source_checksums(spark, sf):
    """SHA-256 and size of every source file, streamed; SQL over the tables cannot see the files."""
    from quillspan.sources.checksums import file_digests

    return file_digests(spark, sf).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "n_bytes", "sha256")


@query("integrity_anti", """
WITH e AS (SELECT DISTINCT l_orderkey AS from_id, l_partkey AS to_id FROM lineitem)
SELECT 'dead source' AS rule, count(*) AS violations FROM e WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = from_id)
UNION ALL SELECT 'dead target', count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = to_id)
UNION ALL SELECT 'missing work', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = l.doc_id)
UNION ALL SELECT 'missing parent', count(*) FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_regionkey)""")
def q_integrity_anti(spark, sf):
    from quillspan.operators.quality import dead_references

    edges = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id")).distinct()
    docs = table(spark, sf, "documents").select("doc_id")
    vecs = table(spark, sf, "embeddings").select("vec_id")
    return dead_references({
        "dead source": (edges, "from_id", docs, "doc_id"),
        "dead target": (edges, "to_id", docs, "doc_id"),
        "missing work": (table(spark, sf, "labels"), "doc_id", vecs, "vec_id"),
        "missing parent": (table(spark, sf, "nation"), "n_regionkey", table(spark, sf, "region"), "r_regionkey"),
    })
