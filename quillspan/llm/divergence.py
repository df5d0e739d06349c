"""Quality rules by distribution divergence, with DataFrame functions only.

Each document's histogram of character classes and of common words is compared to the mean histogram of its language
by the Jensen-Shannon distance (base 2, 0 to 1). A distance counts only for texts long enough to give a histogram.

Defined cases: null and empty texts have zero counts and fail the base rules; a language without a word list, or a
null language, is compared by character classes alone, against its own mean; a language with fewer than
``MIN_REFERENCE`` sound documents has no reference and rejects nothing; repeated rows give a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import SPACE, load, once, stored
from quillspan.plans.registry import Builder

#: Common words of each language, the bins of its word histogram.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "at"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "sur"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "una"),
}
#: Characters in each class, as a regular expression; what is left is the last class.
CLASSES = ("[a-z]", "[A-Z]", "[0-9]", "[ \\t\\n\\r]", "[.,;:!?'\"()-]", "[#*$%&|<>]", "[\\x21-\\x7E]")
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50
MIN_CLASS_CHARS = 200
MIN_WORD_WORDS = 100
MIN_REFERENCE = 20
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.45


def _repeated_words(hashes: Column) -> Column:
    """Words inside three-word windows that occur twice or more; ``hashes`` has one value per window."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # Bound once by the outer lambda; equal windows are neighbours.
    twice = F.transform(F.array(ordered), lambda s: F.transform(
        F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
                 | F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))
    spread = F.flatten(F.transform(F.flatten(twice), lambda i: F.array(i, i + 1, i + 2)))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(F.size(F.array_distinct(spread)))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            common: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(doc_id, lang, base measures, char and word histograms as shares); one pass over the texts."""
    lists = COMMON_WORDS if common is None else common
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text.alias("text"))
    made = once(base, w=F.array_remove(F.split("text", SPACE), ""))
    every = sorted({w for ws in lists.values() for w in ws})
    lines = F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.when(F.size("w") >= 3, F.slice(
        F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))), F.lit(1), F.size("w") - 2
    )).otherwise(F.array().cast("array<bigint>"))
    made = once(made, lines=lines, hashes=windows,
                common=F.filter(F.transform("w", lambda x: F.lower(x)), lambda x: x.isin(every)))
    # Each class is cut from what the one before it has left, so the chain costs one pass over ever shorter texts.
    made = made.withColumn("left0", F.col("text"))
    for n, kind in enumerate(CLASSES):
        made = once(made, **{f"left{n + 1}": F.regexp_replace(f"left{n}", kind + "+", "")})
    n_chars = F.length("text")
    shares = [F.length(f"left{n}") - F.length(f"left{n + 1}") for n in range(len(CLASSES))] + [F.length(f"left{len(CLASSES)}")]
    bins = F.lit(None).cast("array<string>")
    for lang, ws in lists.items():
        bins = F.when(F.col("lang") == lang, F.array(*[F.lit(x) for x in ws])).otherwise(bins)
    made = once(
        made.select("doc_id", "lang", "text", "w", "lines", "hashes", "common", F.array(*shares).alias("classes")),
        bins=bins,
    )
    hits = F.transform("bins", lambda b: F.size(F.filter("common", lambda x: x == b)))
    made = once(made, hits=hits)
    n_words = F.size("w")
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    with_rest = F.concat("hits", F.array(n_words - total("hits")))
    return made.select(
        "doc_id", "lang", n_words.cast("long").alias("n_words"), n_chars.cast("long").alias("n_chars"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (n_chars - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("hashes")).cast("long").alias("n_repeat_words"),
        F.when(n_chars > 0, F.transform("classes", lambda x: x / n_chars)).alias("char_shares"),
        F.when(n_words > 0, F.transform(with_rest, lambda x: x / n_words)).alias("word_shares"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def references(measured: DataFrame) -> DataFrame:
    """(lang, char_reference, word_reference): mean histograms of all documents that pass the base rules."""
    out = None
    sound = measured.where(~base_failed())
    for name, shares in (("char_reference", "char_shares"), ("word_reference", "word_shares")):
        means = (
            sound.where(F.col(shares).isNotNull()).select("lang", F.posexplode(shares).alias("i", "share"))
            .groupBy("lang", "i").agg(F.avg("share").alias("mean"), F.count("*").alias("n"))
            .where(F.col("n") >= MIN_REFERENCE)
            .groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "mean"))), lambda x: x["mean"]).alias(name))
        )
        out = means if out is None else out.join(means, out["lang"].eqNullSafe(means["lang"]), "left").select(
            out["lang"], "char_reference", name)
    return out


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms given as shares."""
    half = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    parts = F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2))


def judge(measured: DataFrame) -> DataFrame:
    """Add distances, base_failed and kept."""
    found = stored(references(measured)).withColumnRenamed("lang", "_lang")
    joined = measured.join(found, measured["lang"].eqNullSafe(found["_lang"]), "left")
    by_class = F.when(F.col("n_chars") >= MIN_CLASS_CHARS, js_distance(F.col("char_shares"), F.col("char_reference")))
    by_word = F.when(F.col("n_words") >= MIN_WORD_WORDS, js_distance(F.col("word_shares"), F.col("word_reference")))
    scored = joined.withColumn("class_distance", by_class).withColumn("word_distance", by_word)
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (
        F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~far)


def op9_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every document."""
    found = judge(stored(measure(load(spark, sf_dir, "documents"))))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    """The same rows as SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    bins = "CASE lang " + " ".join(
        f"WHEN {quoted(g)} THEN [{', '.join(map(quoted, ws))}]" for g, ws in COMMON_WORDS.items()) + " END"
    chain, shares = [], []
    for n, kind in enumerate(CLASSES):
        chain.append(f"c{n + 1} AS (SELECT *, regexp_replace(l{n}, {quoted(kind + '+')}, '', 'g') AS l{n + 1} FROM c{n})")
        shares.append(f"length(l{n}) - length(l{n + 1})")
    shares.append(f"length(l{len(CLASSES)})")
    half = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0.0 END"
    distance = f"sqrt(greatest(0.0, sum({half('p', 'q')} + {half('q', 'p')}) / 2))"
    means = lambda kind: f"""
{kind}_rows AS (SELECT doc_id, lang, unnest({kind}) AS p, generate_subscripts({kind}, 1) AS i FROM shares WHERE {kind} IS NOT NULL),
{kind}_means AS (
  SELECT lang, i, avg(p) AS q FROM {kind}_rows JOIN base USING (doc_id) WHERE NOT base_failed GROUP BY 1, 2 HAVING count(*) >= {MIN_REFERENCE}),
{kind}_far AS (
  SELECT r.doc_id, {distance} AS d FROM {kind}_rows r JOIN {kind}_means m ON r.i = m.i AND r.lang IS NOT DISTINCT FROM m.lang GROUP BY 1)"""  # noqa: E731
    return rf"""
WITH t AS (
  SELECT doc_id, lang, coalesce(text, '') AS l0, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
grams AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, i FROM (
  SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM t)),
twice AS (SELECT doc_id, a, b, c FROM grams GROUP BY ALL HAVING count(*) > 1),
repeated AS (SELECT doc_id, count(DISTINCT x) AS n FROM (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS x FROM grams JOIN twice USING (doc_id, a, b, c)) GROUP BY 1),
lined AS (SELECT doc_id, list_filter(string_split(l0, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM t),
base AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(length(l0) - length(translate(l0, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
           CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
           length(l0) AS n_chars FROM t JOIN lined USING (doc_id) LEFT JOIN repeated USING (doc_id))),
c0 AS (SELECT * FROM t),
{", ".join(chain)},
hits AS (
  SELECT *, list_transform({bins}, lambda b: len(list_filter(low, lambda x: x = b))) AS h FROM (
    SELECT *, list_transform(w, lambda x: lower(x)) AS low FROM c{len(CLASSES)})),
shares AS (
  SELECT doc_id, lang, CASE WHEN length(l0) > 0 THEN list_transform([{", ".join(shares)}], lambda x: x / length(l0)) END AS chars,
         CASE WHEN len(w) > 0 AND h IS NOT NULL THEN list_transform(h || [len(w) - list_sum(h)], lambda x: x / len(w)) END AS words FROM hits),
{means("chars").strip()},
{means("words").strip()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_chars >= {MIN_CLASS_CHARS} AND coalesce(c.d, 0) > {MAX_CLASS_DISTANCE})
    AND NOT (n_words >= {MIN_WORD_WORDS} AND coalesce(v.d, 0) > {MAX_WORD_DISTANCE}) AS kept
FROM base LEFT JOIN chars_far c USING (doc_id) LEFT JOIN words_far v USING (doc_id)
"""


QUERIES: dict[str, Builder] = {"op9_distribution_divergence": op9_distribution_divergence}
SQL: dict[str, str] = {"op9_distribution_divergence": _sql()}
