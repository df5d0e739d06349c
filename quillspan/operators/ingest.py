"""Marked-up documents to units, blocks, anchored references and topic trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.text import collapse_spaces, plain_marked_line, plain_text
from quillspan.operators.intervals import points_in_intervals
from quillspan.operators.ordering import sequential_ids

# Marker names of the backslash-marked text format.
PARAGRAPH_MARKERS = (
    "p m pi pi1 pi2 mi nb pc pr pm pmo pmc pmr cls li li1 li2 li3 ili ili1 ili2 b d sp"
).split()
HEADING_MARKERS = "s s1 s2 s3 s4 ms ms1 ms2 sr r".split()
FRONT_MARKERS = "id ide h toc1 toc2 toc3 mt1 mt2 mt3 ip is1 cl cp is imt".split()


def marked_rows(docs: DataFrame) -> DataFrame:
    """Marker rows of backslash-marked texts.

    ``docs``: doc_id, text. Rows: doc_id, pos, kind, ordinal, ordinal_end, text
    with kind one of chapter, heading, paragraph, unit, line, front. A unit
    marker that directly follows another marker gets a row of its own.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_no", "line"))
    lines = lines.select("doc_id", "line_no", F.trim("line").alias("line")).where("line != ''")
    marker = F.regexp_extract("line", r"^\\([a-z]+[0-9]?)\b\s*(.*)$", 1)
    rest = F.when(marker != "", F.regexp_extract("line", r"^\\([a-z]+[0-9]?)\b\s*(.*)$", 2)).otherwise(F.col("line"))
    lines = lines.select("doc_id", "line_no", marker.alias("marker"), rest.alias("rest"))
    inner_unit = F.col("rest").rlike(r"^\\v\s") & (F.col("marker") != "v")
    own = F.struct(
        F.col("marker").alias("marker"),
        F.when(inner_unit, F.lit("")).otherwise(F.col("rest")).alias("rest"),
    )
    unit = F.struct(F.lit("v").alias("marker"), F.regexp_replace("rest", r"^\\v\s+", "").alias("rest"))
    parts = F.when(inner_unit, F.array(own, unit)).otherwise(F.array(own))
    rows = lines.select("doc_id", "line_no", F.posexplode(parts).alias("part_no", "part"))
    marker, rest = F.col("part.marker"), F.col("part.rest")
    number = F.regexp_extract(rest, r"^(\d+)", 1)
    kind = (
        F.when(marker == "c", "chapter")
        .when(marker.isin(HEADING_MARKERS), "heading")
        .when(marker.isin(PARAGRAPH_MARKERS), "paragraph")
        .when((marker == "v") & (number != ""), "unit")
        .when(marker == "v", "break")
        .when(marker.isin(FRONT_MARKERS), "front")
        .otherwise("line")
    )
    last = F.regexp_extract(rest, r"^\d+[-–](\d+)", 1)
    body = F.when(kind == "unit", F.regexp_replace(rest, r"^\d+(?:[-–]\d+)?\s*", ""))
    return rows.select(
        "doc_id",
        (F.col("line_no") * 2 + F.col("part_no")).cast("long").alias("pos"),
        kind.alias("kind"),
        F.when(kind.isin("unit", "chapter") & (number != ""), number.cast("long")).alias("ordinal"),
        F.when((kind == "unit") & (last != ""), last.cast("long")).alias("ordinal_end"),
        F.coalesce(body, rest).alias("text"),
    )


def html_rows(pages: DataFrame) -> DataFrame:
    """The same marker rows out of raw pages (page_id, html), every tag on a line of its own.

    Page sections are chapters, h1–h6 headings, p and li paragraphs that open a
    unit, div a bare paragraph break and br a line break.
    """
    clean = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</(script|style)>", "")
    clean = F.regexp_replace(clean, r"(?s)<!--.*?-->", "")
    lines = pages.select("page_id", F.posexplode(F.split(F.replace(clean, F.lit("<"), F.lit("\n<")), "\n")).alias("pos", "line"))
    tag = F.lower(F.regexp_extract("line", r"^<([a-zA-Z]+[0-9]?)", 1))
    text = collapse_spaces(F.replace(F.regexp_replace("line", r"^<[^>]*>", " "), F.lit("&amp;"), F.lit("&")))
    kind = (
        F.when(tag.isin("nav", "article", "footer"), "chapter")
        .when(tag.rlike("^h[1-6]$"), "heading")
        .when(tag.isin("p", "li"), "unit")
        .when(tag == "div", "paragraph")
        .when(tag.isin("title", "html", "head", "body", "meta"), "front")
        .otherwise("line")
    )
    rows = lines.select("page_id", "pos", tag.alias("tag"), kind.alias("kind"), text.alias("text"))
    so_far = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    opened = F.sum(F.when(F.col("kind") == "unit", 1).otherwise(0)).over(so_far)
    section = F.when(F.col("tag") == "nav", 1).when(F.col("tag") == "article", 2).otherwise(3)
    return rows.select(
        F.col("page_id").alias("doc_id"),
        F.col("pos").cast("long").alias("pos"),
        "kind",
        F.when(F.col("kind") == "unit", opened).when(F.col("kind") == "chapter", section).cast("long").alias("ordinal"),
        F.lit(None).cast("long").alias("ordinal_end"),
        "text",
        F.col("tag").isin("p", "li").alias("opens_paragraph"),
    )


def _numbered(rows: DataFrame, legacy_break: bool) -> DataFrame:
    """Give every row its chapter, the unit it belongs to and the block it would open.

    All windows share the document as partition, so one shuffle serves them.
    """
    if "opens_paragraph" not in rows.columns:
        rows = rows.withColumn("opens_paragraph", F.lit(False))
    by_doc = W.partitionBy("doc_id").orderBy("pos")
    upto = by_doc.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = by_doc.rowsBetween(W.unboundedPreceding, -1)
    is_unit = F.col("kind") == "unit"
    breaks = F.col("kind").isin("chapter", "heading", "break")
    if legacy_break:
        breaks = breaks | (F.col("kind") == "paragraph")
    owner = F.when(is_unit, F.col("pos")).when(breaks, F.lit(-1))
    rows = rows.select(
        "*",
        F.coalesce(F.last(F.when(F.col("kind") == "chapter", F.col("ordinal")), ignorenulls=True).over(upto), F.lit(0))
        .alias("chapter"),
        F.coalesce(F.last(owner, ignorenulls=True).over(upto), F.lit(-1)).alias("unit_pos"),
        F.coalesce(F.sum(is_unit.cast("int")).over(before), F.lit(0)).alias("stretch"),
    )
    pending = W.partitionBy("doc_id", "stretch")
    heading_pos = F.max(F.when(F.col("kind") == "heading", F.col("pos"))).over(pending)
    heading = F.max_by(
        F.when(F.col("kind") == "heading", F.col("text")), F.when(F.col("kind") == "heading", F.col("pos"))
    ).over(pending)
    paragraph = F.max((F.col("kind") == "paragraph") | F.col("opens_paragraph")).over(pending)
    opens = is_unit & (heading_pos.isNotNull() | paragraph | (F.col("stretch") == 0))
    rows = rows.select(
        "*", opens.alias("opens_block"),
        F.when(opens & heading_pos.isNotNull(), heading).alias("heading"),
        F.when(opens, F.when(heading_pos.isNotNull(), "heading").otherwise("paragraph")).alias("source"),
    )
    return rows.withColumn("block_no", F.sum(F.col("opens_block").cast("int")).over(upto).cast("long"))


def segment_units(rows: DataFrame, marked: bool = True, legacy_break: bool = True) -> DataFrame:
    """(doc_id, chapter, ordinal, ordinal_end, block_no, text): units with their continuation lines.

    Units whose text is empty after markup removal are dropped. With
    ``legacy_break`` text after a paragraph break inside a unit is lost;
    without it the text stays with the unit.
    """
    numbered = _numbered(rows, legacy_break)
    owned = numbered.where((F.col("unit_pos") >= 0) & F.col("kind").isin("unit", "line", "paragraph"))
    first = lambda name: F.max(F.when(F.col("kind") == "unit", F.col(name))).alias(name)
    units = owned.groupBy("doc_id", "unit_pos").agg(
        first("chapter"), first("ordinal"), first("ordinal_end"), first("block_no"),
        F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("parts"),
    )
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    text = plain_marked_line(joined) if marked else collapse_spaces(joined)
    return units.select(
        "doc_id", "unit_pos", "chapter", "ordinal", "ordinal_end", "block_no", text.alias("text")
    ).where("text != ''")


def segment_blocks(rows: DataFrame, marked: bool = True, legacy_break: bool = True) -> DataFrame:
    """(doc_id, block_no, heading, source): a block exists once its first unit does."""
    heading = plain_marked_line(F.col("heading")) if marked else collapse_spaces(F.col("heading"))
    return _numbered(rows, legacy_break).where("opens_block").select(
        "doc_id", "block_no", F.when(heading != "", heading).alias("heading"), "source"
    )


def omitted_markers(markers: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """Markers present in the source that no unit survived from."""
    return markers.join(units.select(*keys).distinct(), keys, "left_anti")


def anchored_references(entries: DataFrame, span: str, is_navigation) -> DataFrame:
    """(doc_id, ref_no, anchor, reference, body): references with the text before them.

    ``span`` matches one reference element, with the target as group 1 and its
    words as group 2. A blank anchor carries the last one forward. Navigation
    spans are not returned, but they still move the position and may set the
    anchor.
    """
    found = entries.select(
        "doc_id", F.split("text", span).alias("pieces"),
        F.regexp_extract_all("text", F.lit(span), F.lit(1)).alias("targets"),
        F.regexp_extract_all("text", F.lit(span), F.lit(2)).alias("bodies"),
    )
    zipped = F.arrays_zip(
        F.slice("pieces", 1, F.size("targets")).alias("before"), F.col("targets").alias("reference"),
        F.col("bodies").alias("body"),
    )
    spans = found.select("doc_id", F.posexplode(zipped).alias("ref_no", "r"))
    own = F.regexp_replace(plain_text(F.col("r.before")), r"[. ]+$", "")
    rows = spans.select(
        "doc_id", F.col("ref_no").cast("long").alias("ref_no"), F.when(own != "", own).alias("own"),
        "r.reference", plain_text(F.col("r.body")).alias("body"),
    )
    upto = W.partitionBy("doc_id").orderBy("ref_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("anchor", F.last("own", ignorenulls=True).over(upto)).drop("own")
    return rows.where(~is_navigation(F.col("reference")) & (F.col("body") != ""))


def outline_lines(entries: DataFrame, line_break: str, ref: str, see_also: str) -> DataFrame:
    """(doc_id, line_no, label, refs[], see[]): one row per outline line that holds anything.

    ``ref`` matches a whole reference element and ``see_also`` an opening tag;
    both have the target as group 1.
    """
    lines = entries.select("doc_id", F.posexplode(F.split("text", line_break)).alias("line_no", "line"))
    label = F.regexp_replace(F.regexp_replace("line", ref, " "), see_also, " ")
    label = F.regexp_replace(label, r"<[^>]*>", " ")
    label = F.translate(F.replace(label, F.lit("&nbsp;"), F.lit(" ")), "→", " ")
    label = F.regexp_replace(collapse_spaces(label), r"^[ .;:,]+|[ .;:,]+$", "")
    rows = lines.select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"),
        F.when(label != "", label).alias("label"),
        F.regexp_extract_all("line", F.lit(ref), F.lit(1)).alias("refs"),
        F.regexp_extract_all("line", F.lit(see_also), F.lit(1)).alias("see"),
    )
    return rows.where((F.size("refs") > 0) | (F.size("see") > 0) | F.col("label").isNotNull())


def topic_tree(entries: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics (topic_id, doc_id, line_no, heading, parent_id, see_also) and members (topic_id, ref).

    ``entries``: doc_id, heading. Every entry is a root, every line with
    references a child; a line's references belong to the child and to the
    root. Lines without references hand their see-also targets to the root,
    first one wins. Ids number entries and lines in reading order.
    """
    pointer = lines.where((F.size("refs") == 0) & (F.size("see") > 0)).groupBy("doc_id").agg(
        F.min_by("see", "line_no").alias("see")
    )
    roots = entries.join(pointer, "doc_id", "left").select(
        "doc_id", F.lit(-1).cast("long").alias("line_no"), "heading", F.array_join("see", ", ").alias("see_also")
    )
    titled = lines.where(F.size("refs") > 0).join(entries.withColumnRenamed("heading", "key"), "doc_id")
    children = titled.select(
        "doc_id", "line_no", F.coalesce("label", "key").alias("heading"),
        F.when(F.size("see") > 0, F.array_join("see", ", ")).alias("see_also"),
    )
    numbered = sequential_ids(roots.unionByName(children), "doc_id", "topic_id", ["line_no"])
    parents = numbered.where("line_no = -1").select("doc_id", F.col("topic_id").alias("root_id"))
    topics = numbered.join(parents, "doc_id").select(
        "topic_id", "doc_id", "line_no", "heading", "see_also",
        F.when(F.col("line_no") >= 0, F.col("root_id")).alias("parent_id"), "root_id",
    )
    refs = lines.where(F.size("refs") > 0).select("doc_id", "line_no", F.explode("refs").alias("ref"))
    owned = topics.where("line_no >= 0").select("doc_id", "line_no", "topic_id", "root_id").join(
        refs, ["doc_id", "line_no"]
    )
    members = owned.select(F.explode(F.array("topic_id", "root_id")).alias("topic_id"), "ref").distinct()
    return topics.drop("root_id"), members


def block_bounds(units: DataFrame, blocks_by: list[str], range_width: int) -> DataFrame:
    """Blocks with first and last unit and a running id in reading order."""
    grouped = units.groupBy(*blocks_by).agg(
        F.min("unit_id").alias("start_id"), F.max("unit_id").alias("end_id"), F.count(F.lit(1)).alias("n_units")
    )
    return sequential_ids(grouped, "start_id", "block_id", width=range_width)


def block_of_units(units: DataFrame, blocks: DataFrame, equi: list[str]) -> DataFrame:
    """Units inside each block's bounds, a hash join however many blocks share the equality keys."""
    bounded = blocks.select(*equi, "block_id", "start_id", "end_id")
    return points_in_intervals(units, bounded, equi, "unit_id", "start_id", "end_id")


def _rendered(df: DataFrame, name: str, kind: str) -> Column:
    """A column as text that any engine renders alike: fractions as whole hundredths or millionths, times as microseconds."""
    value = F.col(name)
    if kind in ("double", "float") or kind.startswith("decimal"):
        value = F.round(value.cast("double") * 100).cast("long")
    elif kind.startswith("timestamp"):
        value = F.unix_micros(value.cast("timestamp"))
    elif kind in ("array<float>", "array<double>"):
        value = F.array_join(F.transform(value, lambda x: F.round(x.cast("double") * 1_000_000).cast("long").cast("string")), ",", "~")
    return F.coalesce(value.cast("string"), F.lit("~"))


def content_fingerprint(df: DataFrame) -> DataFrame:
    """(n_rows, fingerprint): the same for the same rows in any order or partitioning.

    The sum of the first twelve hexadecimal digits of each row's MD5, columns rendered alike by any engine.
    """
    row = F.concat_ws("|", *[_rendered(df, c, k) for c, k in df.dtypes])
    number = F.conv(F.substring(F.md5(row), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("fingerprint"))
