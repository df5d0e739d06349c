"""Written references to unit ids: names, ranges, carry-forward lists, quarantine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.keys import KeyLayout
from quillspan.operators.ordering import RANGE_WIDTH
from quillspan.session import stored

#: Units of one list in a row.
UNITS_A_ROW = 1024

# Reasons a reference is quarantined for.
EMPTY = "empty"
MALFORMED = "unknown book or malformed osisRef"
CROSS_WORK = "malformed or cross-book range"
TOO_BROAD = "book-level reference, too broad to attach"
NO_CHAPTER = "chapter not present in this text"
NO_UNIT = "verse not present in this text"
MARGINAL = "marginal note marker, not a reference"
UNKNOWN_NAME = "unknown book abbreviation"
UNPARSEABLE = "unparseable reference"
NO_MATCH = "no matching verse in this text"
NOTHING = "nothing resolved"

# Spelled-out numbers in front of a name and their digits.
ORDINALS = {
    "first": "1", "1st": "1", "i": "1", "1": "1",
    "second": "2", "2nd": "2", "ii": "2", "2": "2",
    "third": "3", "3rd": "3", "iii": "3", "3": "3",
}


def name_key(written: Column) -> Column:
    """Blanks and full stops do not distinguish names, nor does case."""
    return F.lower(F.regexp_replace(written, r"[\s.]", ""))


def name_variants(code: Column, name: Column, abbrev: Column, aliases: Column | None = None) -> Column:
    """Every way a work is written, most formal first."""
    tail = F.trim(F.regexp_replace(name, r"^.*\bCalled\b\s*", ""))
    bare = lambda v: F.when(F.lower(v).startswith("the "), F.substring(v, F.lit(5), F.length(v)))
    number = F.regexp_extract(code, r"^([123])", 1)
    base = F.regexp_replace(tail, r"^[123]\s*", "")
    spelled = F.when(number == "1", F.array(F.lit("first "), F.lit("i "))).when(
        number == "2", F.array(F.lit("second "), F.lit("ii "))
    ).otherwise(F.array(F.lit("third "), F.lit("iii ")))
    prefixes = F.concat(F.array(number, F.concat(number, F.lit(" "))), spelled)
    numbered = F.when((number != "") & (tail != ""), F.transform(prefixes, lambda p: F.concat(p, base))).otherwise(
        F.array().cast("array<string>")
    )
    parts = [F.array(code, abbrev, tail, name, bare(tail), bare(name))]
    if aliases is not None:
        parts.append(F.coalesce(aliases, F.array().cast("array<string>")))
    return F.filter(F.concat(*parts, numbered), lambda v: v.isNotNull() & (v != ""))


def alias_dimension(works: DataFrame, abbreviations: DataFrame | None = None) -> DataFrame:
    """(key, written, work_id): the first writer of a key in work order keeps it.

    ``works``: work_id, code, name, abbrev[, aliases]. ``abbreviations``:
    written, code; they only fill keys no work has claimed.
    """
    aliases = F.col("aliases") if "aliases" in works.columns else None
    variants = works.select(
        "work_id", F.posexplode(name_variants(F.col("code"), F.col("name"), F.col("abbrev"), aliases)).alias("no", "written")
    ).select(F.lit(0).alias("tier"), "work_id", F.col("no").cast("long").alias("no"), "written")
    if abbreviations is not None:
        extra = abbreviations.join(works.select("code", "work_id"), "code").select(
            F.lit(1).alias("tier"), "work_id", F.lit(0).cast("long").alias("no"), "written"
        )
        variants = variants.unionByName(extra)
    claim = F.struct("tier", "work_id", "no", "written")
    claimed = variants.groupBy(name_key(F.col("written")).alias("key")).agg(F.min(claim).alias("c"))
    return claimed.select("key", "c.written", "c.work_id")


def lookup_keys(key: Column) -> Column:
    """The key itself, then its spellings with a leading ordinal as digit, longest ordinal first."""
    by_length = sorted(ORDINALS.items(), key=lambda item: -len(item[0]))
    rewritten = [
        F.when(
            key.startswith(word) & (F.length(key) > len(word)),
            F.concat(F.lit(digit), F.substring(key, F.lit(len(word) + 1), F.length(key))),
        )
        for word, digit in by_length
    ]
    return F.filter(F.array(key, *rewritten), lambda k: k.isNotNull())


def alias_lookup(names: DataFrame, aliases: DataFrame, keys: list[str], written: str) -> DataFrame:
    """Add ``work_id`` of a written name (NULL when unknown).

    Names are looked up once per distinct spelling.
    """
    spelled = names.select(F.col(written).alias("_w")).distinct()
    tried = spelled.select("_w", F.posexplode(lookup_keys(name_key(F.col("_w")))).alias("_no", "key"))
    found = tried.join(aliases.select("key", "work_id"), "key").groupBy("_w").agg(
        F.min_by("work_id", "_no").alias("work_id")
    )
    return names.join(found, F.col(written) == F.col("_w"), "left").drop("_w")


# --- ranges ---------------------------------------------------------------------

def range_units(ranges: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, unit_id): existing units of each range; a unit is never invented.

    ``ranges``: keys, work_id, c1, v1, c2, v2 (v1 NULL = from the chapter's
    start, v2 NULL = to its end). A range becomes one row per chapter the work
    really has, which turns the bounds into a hash join on (work, chapter).
    """
    last = units.groupBy("work_id").agg(F.max("chapter").alias("_last"))
    bounded = ranges.join(last, "work_id").withColumn("_c2", F.least("c2", "_last")).where("c1 <= _c2")
    spread = bounded.select(
        *keys, "work_id", "c1", "v1", "c2", "v2", F.explode(F.sequence("c1", "_c2")).alias("chapter")
    )
    joined = spread.join(units.select("work_id", "chapter", "ordinal", "unit_id"), ["work_id", "chapter"])
    low = (F.col("chapter") != F.col("c1")) | F.col("v1").isNull() | (F.col("ordinal") >= F.col("v1"))
    high = (F.col("chapter") != F.col("c2")) | F.col("v2").isNull() | (F.col("ordinal") <= F.col("v2"))
    return joined.where(low & high).select(*keys, "unit_id")


def range_counts(ranges: DataFrame, units: DataFrame, keys: list[str], value: Column | None = None) -> DataFrame:
    """(keys, n_units, total): how many existing units the ranges of a key hold and the sum of ``value`` over them.

    Columns as in ``range_units``; keys whose ranges hold nothing are left out. No unit is joined to the ranges that hold
    it: a range asks for running counts at its two ends, and equal ranges ask once, so the work follows units and ranges
    however wide the ranges are.
    """
    value = F.lit(0).cast("long") if value is None else value.cast("long")
    place = ["work_id", "chapter"]
    marks = units.groupBy(*place, "ordinal").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("v"))
    chapters = marks.groupBy(*place).agg(F.min("ordinal").alias("_min"), F.max("ordinal").alias("_max"))
    last = chapters.groupBy("work_id").agg(F.max("chapter").alias("_last"))
    asked = ranges.select(*keys, F.struct("work_id", "c1", "v1", "c2", "v2").alias("bounds"))
    pieces = asked.select("bounds").distinct().select("bounds", "bounds.*").join(last, "work_id").withColumn(
        "_c2", F.least("c2", "_last")).where("c1 <= _c2").select(
        "bounds", "work_id", "c1", "v1", "c2", "v2", F.explode(F.sequence("c1", "_c2")).alias("chapter")).join(chapters, place)
    low = F.when((F.col("chapter") == F.col("c1")) & F.col("v1").isNotNull(), F.greatest("v1", "_min")).otherwise(F.col("_min"))
    high = F.when((F.col("chapter") == F.col("c2")) & F.col("v2").isNotNull(), F.least("v2", "_max")).otherwise(F.col("_max"))
    ends = pieces.select("bounds", *place, low.alias("_low"), high.alias("_high")).where("_low <= _high").select(
        "bounds", *place, F.inline(F.array(
            F.struct((F.col("_low") - 1).alias("ordinal"), F.lit(-1).cast("long").alias("sign")),
            F.struct(F.col("_high").alias("ordinal"), F.lit(1).cast("long").alias("sign")))))
    zero = F.lit(0).cast("long")
    wanted = ends.select(*place, "ordinal").distinct().select(*place, "ordinal", zero.alias("n"), zero.alias("v"), F.lit(True).alias("end"))
    line = marks.withColumn("end", F.lit(False)).unionByName(wanted).withColumn(
        "_cell", F.call_function("div", F.col("ordinal"), F.lit(RANGE_WIDTH).cast("long")))
    earlier = W.partitionBy(*place).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)  # a row per stretch of a chapter
    before = line.groupBy(*place, "_cell").agg(F.sum("n").alias("_n"), F.sum("v").alias("_v")).select(
        *place, "_cell", F.coalesce(F.sum("_n").over(earlier), zero).alias("_n"), F.coalesce(F.sum("_v").over(earlier), zero).alias("_v"))
    inside = W.partitionBy(*place, "_cell").orderBy("ordinal").rangeBetween(W.unboundedPreceding, W.currentRow)
    running = line.select(*place, "_cell", "ordinal", "end", F.sum("n").over(inside).alias("n"), F.coalesce(F.sum("v").over(inside), zero).alias("v"))
    upto = running.where("end").join(before, [*place, "_cell"]).select(
        *place, "ordinal", (F.col("n") + F.col("_n")).alias("n"), (F.col("v") + F.col("_v")).alias("v"))
    held = ends.join(upto, [*place, "ordinal"]).groupBy("bounds").agg(
        F.sum(F.col("sign") * F.col("n")).alias("n"), F.sum(F.col("sign") * F.col("v")).alias("v")).where("n > 0")
    return asked.join(held, "bounds").groupBy(*keys).agg(F.sum("n").alias("n_units"), F.sum("v").alias("total"))


_POINT = r"([0-9A-Za-z]+)(?:\.(\d+))?(?:\.(\d+))?"


def parsed_ranges(refs: DataFrame, works: DataFrame, key: str = "ref_id", raw: str = "raw") -> DataFrame:
    """(key, raw, work_id, c1, v1, c2, v2, reason) of structured ranges ``Code.ch.v[-Code.ch.v]``.

    ``reason`` is set where the writing alone rules a range out. ``works``: code, work_id.
    """
    text = F.trim(F.col(raw))
    start, end = F.trim(F.substring_index(text, "-", 1)), F.trim(F.regexp_extract(text, r"(?s)^[^-]*-(.*)$", 1))
    whole = f"^{_POINT}$"
    part = lambda side, n: F.when(F.regexp_extract(side, whole, n) != "", F.regexp_extract(side, whole, n))
    parsed = refs.select(
        F.col(key), F.col(raw), text.alias("text"), end.alias("end"),
        part(start, 1).alias("code"), part(start, 2).cast("long").alias("c1"), part(start, 3).cast("long").alias("v1"),
        part(end, 1).alias("end_code"), part(end, 2).cast("long").alias("end_c"), part(end, 3).cast("long").alias("end_v"),
    )
    named = parsed.join(works.select("code", "work_id"), "code", "left").join(
        works.select(F.col("code").alias("end_code"), F.col("work_id").alias("end_work")), "end_code", "left"
    )
    has_end = F.col("end") != ""
    reason = (
        F.when(F.col("text") == "", EMPTY)
        .when(F.col("work_id").isNull(), MALFORMED)
        .when(has_end & (F.col("end_work").isNull() | (F.col("end_work") != F.col("work_id"))), CROSS_WORK)
        .when(F.col("c1").isNull(), TOO_BROAD)
    )
    c2 = F.coalesce(F.when(has_end, F.col("end_c")), F.col("c1"))
    v2 = F.when(F.col("v1").isNull(), F.lit(None)).when(has_end, F.col("end_v")).otherwise(F.col("v1"))
    return named.select(
        key, raw, "work_id", "c1", "v1", c2.alias("c2"), v2.cast("long").alias("v2"), reason.alias("reason")
    )


def _quarantined(judged: DataFrame, counts: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, raw, reason) of parsed ranges that are ruled out or hold no unit."""
    missing = judged.where("reason IS NULL").join(counts, key, "left_anti").select(
        key, raw, F.when(F.col("v1").isNull(), NO_CHAPTER).otherwise(NO_UNIT).alias("reason")
    )
    return judged.where("reason IS NOT NULL").select(key, raw, "reason").unionByName(missing)


def resolve_ranges(refs: DataFrame, works: DataFrame, units: DataFrame, key: str = "ref_id",
                   raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Structured ranges → (resolved: key, unit_id; quarantined: key, raw, reason). ``works``: code, work_id."""
    judged = parsed_ranges(refs, works, key, raw)
    usable = judged.where("reason IS NULL")
    return range_units(usable, units, [key]), _quarantined(judged, range_counts(usable, units, [key]), key, raw)


def resolved_counts(refs: DataFrame, works: DataFrame, units: DataFrame, value: Column, key: str = "ref_id",
                    raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """As ``resolve_ranges`` for callers that need no unit ids: (counts: key, n_units, total of ``value``; quarantined)."""
    judged = parsed_ranges(refs, works, key, raw)
    counts = range_counts(judged.where("reason IS NULL"), units, [key], value)
    return counts, _quarantined(judged, counts, key, raw)


# --- citation lists ---------------------------------------------------------------

#: Fixed values of the input's grammar: how a list item begins with a work's name, and the four forms of its numbers.
_NAME = r"^\s*((?:[123]\s*)?[A-Za-z]+\.?)\s*"
_ITEM_FULL = r"^(\d+)\s*:\s*(\d+)\s*-\s*(?:(\d+)\s*:\s*)?(\d+)$"
_ITEM_POINT = r"^(\d+)\s*:\s*(\d+)$"
_ITEM_SPAN = r"^(\d+)\s*-\s*(\d+)$"
_ITEM_SINGLE = r"^(\d+)$"


def citation_items(lists: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per item of ``;``/``,`` lists with its work and chapter carried forward.

    ``lists``: ref_id, text, ctx_work, ctx_chapter. ``aliases``: key, work_id.
    Columns: ref_id, chunk_no, item_no, raw, reason, work_id, chapter,
    name_seen, and the numbers c1, v1, c2, v2, a, b of the item's form.
    All windows share ``ref_id``, so the names' join and one shuffle suffice.
    """
    chunks = lists.select("ref_id", "ctx_work", "ctx_chapter", F.posexplode(F.split("text", ";")).alias("chunk_no", "chunk"))
    chunks = chunks.withColumn("chunk", F.trim("chunk")).where("chunk != ''")
    marginal = F.col("chunk").startswith("*")
    items = chunks.select(
        "*", F.posexplode(F.when(marginal, F.array("chunk")).otherwise(F.split("chunk", ","))).alias("item_no", "item")
    ).withColumn("item", F.trim("item"))
    name = F.when(~marginal, F.regexp_extract("item", _NAME, 1)).otherwise("")
    items = items.where("item != ''").select(
        "ref_id", "chunk_no", "item_no", "ctx_work", "ctx_chapter", "chunk", "item", marginal.alias("marginal"),
        F.when(name != "", name_key(name)).alias("key"),
        F.when(marginal, "").otherwise(F.trim(F.regexp_replace("item", _NAME, ""))).alias("numbers"),
    )
    named = items.join(aliases.select("key", F.col("work_id").alias("named_work")), "key", "left")
    unknown = F.col("key").isNotNull() & F.col("named_work").isNull()
    order = W.partitionBy("ref_id").orderBy("chunk_no", "item_no")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    in_chunk = W.partitionBy("ref_id", "chunk_no")
    # an unknown name in front of a chunk drops the chunk, elsewhere only its item
    dropped = F.max(unknown & (F.col("item_no") == 0)).over(in_chunk)
    state = named.withColumn("dropped", dropped & ~F.col("marginal")).withColumn("unknown", unknown)
    opens = F.when(~F.col("dropped") & F.col("named_work").isNotNull(), F.col("named_work"))
    state = state.withColumn("opens", opens).withColumn(
        "work_run", F.sum(F.when(F.col("opens").isNotNull(), 1).otherwise(0)).over(upto)
    ).withColumn("work_id", F.coalesce(F.last("opens", ignorenulls=True).over(upto), "ctx_work"))
    number = lambda pattern, group: F.regexp_extract("numbers", pattern, group)
    full, point, span, single = _ITEM_FULL, _ITEM_POINT, _ITEM_SPAN, _ITEM_SINGLE
    asked = lambda pattern, group: F.when(number(pattern, group) != "", number(pattern, group).cast("long"))
    c1 = F.coalesce(asked(full, 1), asked(point, 1))
    v1 = F.coalesce(asked(full, 2), asked(point, 2))
    c2 = F.coalesce(asked(full, 3), asked(full, 1), asked(point, 1))
    v2 = F.coalesce(asked(full, 4), asked(point, 2))
    a, b = F.coalesce(asked(span, 1), asked(single, 1)), F.coalesce(asked(span, 2), asked(single, 1))
    usable = ~F.col("dropped") & ~F.col("marginal") & ~F.col("unknown")
    form = lambda value: F.when(usable, value)
    state = state.select(
        "*", form(c1).alias("c1"), form(v1).alias("v1"), form(c2).alias("c2"), form(v2).alias("v2"),
        form(a).alias("a"), form(b).alias("b"), F.col("numbers").rlike(single).alias("is_single"),
    )
    in_run = W.partitionBy("ref_id", "work_run").orderBy("chunk_no", "item_no").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    carried = F.last("c2", ignorenulls=True).over(in_run)
    chapter = F.coalesce(carried, F.when(F.col("work_run") == 0, F.col("ctx_chapter")))
    reason = (
        F.when(F.col("marginal"), MARGINAL)
        .when(F.col("unknown") | F.col("dropped"), UNKNOWN_NAME)
        .when((F.col("numbers") != "") & F.col("c1").isNull() & F.col("a").isNull(), UNPARSEABLE)
    )
    return state.select(
        "ref_id", "chunk_no", "item_no", "chunk",
        F.when(F.col("dropped") | F.col("marginal"), F.col("chunk"))
        .when(F.col("unknown"), F.col("item")).otherwise(F.col("numbers")).alias("raw"),
        reason.alias("reason"), "work_id", chapter.alias("chapter"), (F.col("work_run") > 0).alias("name_seen"),
        "c1", "v1", "c2", "v2", "a", "b", "is_single", (F.col("numbers") == "").alias("name_only"), "dropped",
    )


def counted_units(ranges: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """(key, unit_id, n): the existing units that the ranges of a key hold, and in how many of them each lies.

    Columns as in ``range_units``. Keys that ask for the same ranges share one list of units, in rows of at most
    ``UNITS_A_ROW``, so what is listed per key meets neither a shuffle nor an aggregate.
    """
    asks = stored(ranges.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("work_id", "c1", "v1", "c2", "v2"))).alias("asks")), "asks")
    named = stored(asks.select("asks").distinct().withColumn("ask", F.monotonically_increasing_id()), "asks")
    held = range_units(named.select("ask", F.inline("asks")), units, ["ask"]).groupBy("ask", "unit_id").agg(F.count(F.lit(1)).alias("n"))
    rows = held.groupBy("ask", F.call_function("div", F.col("unit_id"), F.lit(UNITS_A_ROW))).agg(
        F.collect_list(F.struct("unit_id", "n")).alias("held"))
    return asks.join(named, "asks").select(key, "ask").join(rows, "ask").select(key, F.inline("held"))


def resolve_citations(lists: DataFrame, aliases: DataFrame, units: DataFrame, counted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Compact citation lists → (resolved: ref_id, unit_id; quarantined: ref_id, raw, reason).

    A unit is listed as often as its list cites it; with ``counted`` once, with that number as ``n``.
    """
    items = stored(citation_items(lists, aliases).where(~F.col("dropped") | (F.col("item_no") == 0)), "items")
    item_keys = ["ref_id", "chunk_no", "item_no"]
    null = F.lit(None).cast("long")
    form = lambda c1, v1, c2, v2, rank: F.struct(
        c1.alias("c1"), v1.alias("v1"), c2.alias("c2"), v2.alias("v2"), F.lit(rank).alias("choice")
    )
    a, b, chapter = F.col("a"), F.col("b"), F.col("chapter")
    readings = (
        F.when(F.col("c1").isNotNull(), F.array(form(F.col("c1"), F.col("v1"), F.col("c2"), F.col("v2"), 0)))
        .when(a.isNotNull() & chapter.isNotNull(), F.array(form(chapter, a, chapter, b, 0)))
        .when(a.isNotNull() & ~F.col("is_single"), F.array(form(a, null, b, null, 0)))
        .when(
            a.isNotNull() & F.col("name_seen"),
            F.array(form(a, null, a, null, 0), form(F.lit(1).cast("long"), a, F.lit(1).cast("long"), a, 1)),
        )
    )
    asked = items.where("reason IS NULL AND NOT name_only").select(*item_keys, "work_id", F.explode(readings).alias("r"))
    ranges = asked.select(*item_keys, "work_id", "r.*").where(F.col("work_id").isNotNull())
    # a bare number is a chapter where that chapter exists, else a unit of chapter one
    chosen = stored(range_counts(ranges, units, [*item_keys, "choice"]).groupBy(*item_keys).agg(F.min("choice").alias("choice")), "chosen")
    taken = ranges.join(chosen, [*item_keys, "choice"])
    resolved = counted_units(taken, units, "ref_id") if counted else range_units(taken, units, ["ref_id"])
    failed = items.where("reason IS NULL AND NOT name_only").join(chosen, item_keys, "left_anti").select(
        "ref_id", "chunk_no", "raw", F.lit(NO_MATCH).alias("reason")
    )
    quarantined = items.where("reason IS NOT NULL").select("ref_id", "chunk_no", "raw", "reason").unionByName(failed)
    # a chunk that is nothing but a name counts only where nothing failed before it
    alone = items.groupBy("ref_id", "chunk_no").agg(F.min("name_only").alias("alone"), F.max("chunk").alias("raw"))
    alone = alone.where("alone").groupBy("ref_id").agg(F.min_by("raw", "chunk_no").alias("raw"), F.min("chunk_no").alias("chunk_no"))
    first_failure = quarantined.groupBy("ref_id").agg(F.min("chunk_no").alias("failed_at"))
    nothing = alone.join(first_failure, "ref_id", "left").where(
        F.col("failed_at").isNull() | (F.col("failed_at") > F.col("chunk_no"))
    ).select("ref_id", "chunk_no", "raw", F.lit(NOTHING).alias("reason"))
    return resolved, quarantined.unionByName(nothing).select("ref_id", "raw", "reason")


def quarantine_counts(parts: list[DataFrame]) -> DataFrame:
    """(reason, n) over every quarantined row."""
    every = reduce(DataFrame.unionByName, [p.select("reason") for p in parts])
    return every.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def edge_set(edges: DataFrame) -> DataFrame:
    """Distinct (from_id, to_id, anchor); a missing anchor equals a missing anchor."""
    return edges.select("from_id", "to_id", "anchor").distinct()


def unpacked(df: DataFrame, layout: KeyLayout, key: str = "unit_id") -> DataFrame:
    """Add work_id, chapter and ordinal of a packed key."""
    unit = F.col(key)
    return df.withColumns({
        "work_id": layout.work(unit), "chapter": layout.chapter(unit), "ordinal": layout.ordinal(unit)
    })
