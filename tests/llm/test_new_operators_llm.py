"""Line quality, collocations and hard negatives against brute force; documents whose columns have internal names."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspan.llm import decontaminate, hard_negatives, line_dedup, line_quality, mixing, phrases, simhash_dedup, toxicity

NAMES = [
    "_key", "_topic", "_source", "_lang", "_tokens", "_probability", "c_topic", "c_source", "c_lang", "gone", "_parts", "_kept",
    "_gone", "_unit", "_gone_id", "_gone_key", "_id", "_of", "_spans", "_piece", "_first", "_once", "id", "key", "first", "keep",
    "whole_row", "component", "score", "label", "n", "a", "b", "h1", "fp", "with.dot", "with`tick",
]


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with one column for every name that an operator uses inside."""
    rng = random.Random(2)
    line = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(n))
    shared, copy = line(12), "\n".join(line(15) for _ in range(3))
    texts = [shared + "\n" + line(30) for _ in range(4)] + [copy, copy + " more", None, "", line(25)]
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), *[f"{name}-{i}" for name in NAMES]) for i, t in enumerate(texts)]
    kinds = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(
        f"`{n.replace('`', '``')}` string" for n in NAMES)
    return spark.createDataFrame(rows, kinds).repartition(2), rows


@pytest.mark.parametrize("stage", ["lines", "copies", "prints", "clean", "cut", "sample", "drawn", "without", "toxic"])
def test_columns_with_internal_names_pass_untouched(spark, clashing, stage):
    docs, rows = clashing
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    made = {
        "lines": lambda: line_dedup.dedup_lines(docs), "copies": lambda: simhash_dedup.keep_similar_first(docs),
        "prints": lambda: simhash_dedup.keep_first(docs), "clean": lambda: decontaminate.clean_documents(docs, items),
        "cut": lambda: decontaminate.cut_spans(docs, items), "sample": lambda: mixing.sample(docs),
        "drawn": lambda: mixing.drawn(docs, topic="_topic"), "without": lambda: line_dedup.without(docs),
        "toxic": lambda: toxicity.reject(docs, toxicity.fit(docs, labels)),
    }[stage]()
    assert made.columns[: len(docs.columns)] == docs.columns
    got = [tuple(r) for r in made.collect()]
    assert got and len({r[0] for r in got}) == len(got)
    for r in got:
        assert r[5 : 5 + len(NAMES)] == rows[r[0]][5:]
    if stage == "drawn":
        assert made.columns[len(docs.columns):] == ["_tokens_", "_topic_", "_probability_"]
        assert all(r[-2] == f"_topic-{r[0]}" for r in got)
    if stage == "lines":
        assert all(r[4] == (len(r[1]) if r[1] is not None else None) for r in got)


# --- collocations -----------------------------------------------------------------

def tokens(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in ".,;:!?\n\x0b\x0c\r":
        text = text.replace(c, "\n")
    return [[w for w in piece.replace("\t", " ").split(" ") if w] for piece in text.split("\n")]


def counted(texts):
    out, total = Counter(), Counter()
    for lang, text in texts:
        for ws in tokens(text):
            total[lang or "und"] += len(ws)
            for m in (1, 2, 3):
                out.update((lang or "und", tuple(ws[i : i + m])) for i in range(len(ws) - m + 1))
    return out, total


def ranked(texts, top=2000):
    f, total = counted(texts)
    taken = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= 10}
    rows = []
    for (lang, ws), a in taken.items():
        inside = lambda long: any(long[i : i + len(ws)] == ws for i in range(len(long) - len(ws) + 1))
        if any(l == lang and len(long) > len(ws) and inside(long) and 100 * b >= 50 * a for (l, long), b in taken.items()):
            continue
        score, k = min((10**6 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws)))
        rows.append((lang, " ".join(ws), a, f[lang, ws[:k]], f[lang, ws[k:]], total[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        order = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(lang, n + 1, *r[1:]) for n, r in enumerate(order)]
    return sorted(out)


def phrase_texts():
    rng = random.Random(6)
    vocabulary = ["the", "of", "new", "york", "city", "été", "x\x00y", "日本", "a" * 300, "-", "é", "É", "the of"]
    texts = []
    for i in range(150):
        ws = rng.choices(vocabulary, weights=[9, 8, 5, 5, 4, 3, 2, 2, 1, 1, 1, 1, 1], k=rng.randint(0, 25))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! "]) for w in ws)
        texts.append((rng.choice(["en", "fr", None, "und"]), text.upper() if i % 9 == 0 else text))
    texts += [("en", None), (None, ""), ("en", " .,;"), ("fr", "New York City " * 3000), ("zz", "only a few words")]
    return texts + texts[:20]


@pytest.mark.parametrize("chunk, shard, top", [(1 << 19, 1 << 20, 2000), (500, 7, 2000), (64, 3, 4)])
def test_collocations_equal_brute_force(spark, monkeypatch, chunk, shard, top):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    texts = phrase_texts()
    if shard < 1000:
        texts = texts[:60] + texts[-25:]
        monkeypatch.setattr(phrases, "SHARD_PHRASES", shard * 20)
    docs = spark.createDataFrame([(i, t, lang, "x", None) for i, (lang, t) in enumerate(texts)],
                                 "doc_id long, text string, lang string, phrase string, f long").repartition(3)
    got = phrases.collocations(docs, top)
    assert sorted(tuple(r) for r in got.collect()) == ranked(texts, top)


def test_longer_phrases_of_many_shards_take_no_scan_each(spark, monkeypatch):
    texts, scans, joined = phrase_texts(), [], phrases.Trie.joined
    monkeypatch.setattr(phrases, "SHARD_PHRASES", 40)
    monkeypatch.setattr(phrases, "ROUTED_PHRASES", 20, raising=False)
    monkeypatch.setattr(phrases.Trie, "joined", lambda pieces: scans.append(1) or joined(pieces))
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(3)
    counts = {(r.lang, tuple(r.phrase.split(" "))): r.f for r in phrases.phrase_counts(docs)[0].collect()}
    want = {k: n for k, n in counted(texts)[0].items() if n >= phrases.LEAST}
    assert len(want) > 60 and counts == want and len(scans) == 1


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "one two", "en")], none.schema)).count() == 0


def test_trie_finds_every_phrase_and_nothing_else():
    rng = random.Random(8)
    for _ in range(30):
        keys = sorted({(rng.choice("pq"), " ".join("".join(rng.choice("abé\x00") for _ in range(rng.randint(1, 4)))
                        for _ in range(rng.randint(1, 3))).encode()) for _ in range(rng.randint(1, 60))})
        trie = phrases.Trie.of([k[0] for k in keys], [k[1] for k in keys])
        trie = phrases.Trie.joined(list(trie.pieces()))
        text = " ".join(rng.choice(["a", "ab", "b", "é", "a\x00", "aé\nb", "zz"]) for _ in range(200))
        f, _ = counted([("p", text)])
        for lang in "pqr":
            found = np.bincount(trie.found(phrases.Words.of(text.encode().translate(phrases._FOLD)), lang), minlength=trie.size)
            assert found.tolist() == [f["p", tuple(k.decode().split(" "))] if l == lang else 0 for l, k in keys]


# --- hard negatives ---------------------------------------------------------------

def mined(rows, every=50):
    """rows: distinct (id, label, ints)."""
    first = lambda found, k: sorted(found, key=lambda r: (-r[0], r[1] is None, r[1]))[:k]
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a in rows:
        if a[0] is None or a[0] % every:
            continue
        for score, number in first([(dot(a[2], b[2]), b[0]) for b in rows if b is not a and b[1] == a[1]], 5):
            far = [(s, b[0]) for b in rows if b[1] != a[1] for s in [dot(a[2], b[2])] if 50 * score <= 100 * s <= 95 * score]
            out += [(a[0], number, k + 1, i, score, s) for k, (s, i) in enumerate(first(far, 3))]
    return sorted(out, key=str)


@pytest.mark.parametrize("cells, leaf, scale", [(1 << 19, 48, 1.0), (40, 2, 1.0), (300, 4, 3000.0)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, cells, leaf, scale):
    rng = np.random.default_rng(3)
    vectors = (np.round(rng.normal(size=(400, 6)) + rng.normal(size=(400, 1)), 1) * scale).tolist()
    vectors[50:80] = [vectors[50]] * 30  # a common vector
    rows = [(i * 5 if i < 390 else None, v, int(rng.integers(0, 4))) for i, v in enumerate(vectors)]
    rows += [(50, None, 1), (100, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (150, [float("nan")] * 6, 0), (7, [float("inf")] * 6, 0),
             (200, vectors[3], None), (250, [1.5 * scale, 2.0], 2), (300, [], 1), rows[10], rows[10], (50, vectors[2], 3)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, anchor string").repartition(3)
    held = set()
    for i, v, y in rows:
        if y is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        held.add((i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, tuple(int(np.floor(256.0 * x)) for x in v)))
    width = max(len(h[2]) for h in held)
    want = mined([(i, y, v + (0,) * (width - len(v))) for i, y, v in held])
    monkeypatch.setattr(hard_negatives, "LEAF", leaf)
    monkeypatch.setattr(hard_negatives, "BLOCK_CELLS", cells)
    monkeypatch.setattr(hard_negatives, "ANCHOR_CELLS", max(cells, 60))
    got = hard_negatives.mine(table, label=hard_negatives.relabelled())
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and len(want) > 50


def test_hard_negatives_of_nothing_and_of_too_much(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(none).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(1, [1.0], 1)], none.schema)).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.mine(spark.createDataFrame([(50, [3e9], 1)], "vec_id long, embedding array<double>, label int"))


def test_cover_tree_keeps_its_bounds_and_skips():
    rng = np.random.default_rng(5)
    centres = rng.integers(-900, 900, size=(12, 4))
    rows = (centres[rng.integers(0, 12, 3000)] + rng.integers(-9, 9, size=(3000, 4))).astype(float)
    top = float(np.sqrt((rows * rows).sum(axis=1).max()))
    tree = hard_negatives.grow(0, rows, np.arange(3000), top)
    points = hard_negatives.lifted(tree.rows, top)
    for node, kids in enumerate(tree.children):
        under = points[tree.first[node] : tree.last[node]]
        assert np.sqrt(((under - points[tree.centre[node]]) ** 2).sum(axis=1)).max() <= tree.reach[node] + 1e-6
        held = [points[tree.centre[k]] for k in kids]  # centres of a level are further apart than its radius
        for p, q in itertools.combinations(held, 2):
            assert np.sqrt(((p - q) ** 2).sum()) > tree.reach[node] / hard_negatives.SHRINK - 1e-6
    assert sorted(map(tuple, tree.rows)) == sorted(map(tuple, rows))
    best = hard_negatives.Best(np.full((1, 1), hard_negatives._NONE + 1024.0), np.full((1, 1), 2.0**62), 5)
    seen = hard_negatives.search(tree, rows[:1], np.array([0]), best)
    assert seen < 1500  # clustered rows let the search skip most nodes
    assert best.score[0, 0].tolist() == sorted((rows @ rows[0]).tolist(), reverse=True)[:5]


# --- line quality -----------------------------------------------------------------

def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    offset = np.array([0, 4, 4, 5, 11])
    unary, tie = rng.normal(size=11), rng.normal(size=(2, 2))
    good, moves, total = line_quality.Chains(offset).pairs(unary, tie)
    for c in range(4):
        u = unary[offset[c] : offset[c + 1]]
        if not len(u):
            assert total[c] == 0
            continue
        paths = list(itertools.product((0, 1), repeat=len(u)))
        weight = np.exp([sum(u[t] for t in range(len(u)) if p[t]) + sum(tie[a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert np.isclose(total[c], np.log(weight.sum()))
        chance = (np.array(paths) * weight[:, None]).sum(axis=0) / weight.sum()
        assert np.allclose(good[offset[c] : offset[c + 1]], chance)
        both = sum(w * sum(1 for a, b in zip(p, p[1:]) if (a, b) == (0, 1)) for p, w in zip(paths, weight)) / weight.sum()
        assert np.isclose(moves[c, 0, 1], both)


def quality_texts(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(2, 9)))
    plain = lambda: " ".join(word() for _ in range(rng.randint(5, 20))).capitalize() + "."
    junk = [lambda: " ".join(word() + "***" for _ in range(12)), lambda: " ".join(word().upper() + "!!" for _ in range(12)),
            lambda: " ".join([word()] * 20), lambda: " | ".join(word() for _ in range(10))]
    rows = []
    for i in range(n):
        bad = rng.random() < 0.3
        lines = [plain() for _ in range(rng.randint(1, 6))]
        if bad:
            kind = rng.choice(junk)
            lines = lines[: rng.randint(0, 2)] + [kind() for _ in range(rng.randint(2, 5))] + lines[: rng.randint(0, 1)]
        rows.append((i, "\n".join(lines), int(not bad)))
    return rows


def test_quality_of_held_out_documents_and_odd_rows(spark):
    rows = quality_texts(700, 4)
    odd = [(9001, None), (9002, ""), (9003, " \n\t\n"), (None, "A line without an id."), (9004, "x\x00 y " * 3), (0, "Another text of a known id."),
           (9005, "\n".join(["word " * 30] * 5000)), (9006, "ends\r\n\r\n"), (9007, rows[0][1]), (9007, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "s", 1.0) for i, t, _ in rows] + [(i, t, None, None) for i, t in odd],
                                 "doc_id long, text string, label string, score double").repartition(3)
    labels = spark.createDataFrame(
        [(i, q, 0) for i, _, q in rows] + [(1, rows[1][2], 0), (None, 1, 0), (9001, None, 0), (9002, 0, 0)],
        "doc_id long, quality int, toxic int")
    model = line_quality.fit(docs, labels)
    found = line_quality.score(docs, model)
    got = [(r.doc_id, r.score, r.n_lines, r.bad_lines) for r in found.collect()]
    assert len(got) == docs.count() and all(0 <= s <= 1 for _, s, _, _ in got)
    held = {r.doc_id for r in docs.where(toxicity.held_out()).select("doc_id").collect()}
    truth = {i: q for i, _, q in rows if i}
    judged = [(truth[i], s >= line_quality.ACCEPT) for i, s, _, _ in got if i in truth and i in held]
    assert sum(q == p for q, p in judged) / len(judged) > 0.97 and len(judged) > 100
    assert {i for i, _, n, _ in got if n == 0} == {9001, 9002, 9003}
    empty = {s for i, s, n, _ in got if n == 0}
    assert len(empty) == 1
    twice = [s for i, s, _, _ in got if i == 9007]
    assert len(twice) == 2 and twice[0] == twice[1]
    texts = dict((i, t) for i, t, _ in rows if i)
    for i, _, _, bad in got:
        if i in texts and truth.get(i) == 0 and i in held:
            lines = texts[i].split("\n")
            wrong = {n for n, x in enumerate(lines, 1) if "***" in x or "!!" in x or " | " in x or len(set(x.split())) == 1 < len(x.split())}
            assert len(wrong ^ set(bad)) <= max(1, len(lines) // 3)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id int, text string")
    none = spark.createDataFrame([], "doc_id int, quality int")
    assert {r.score for r in line_quality.score(docs, line_quality.fit(docs, none)).collect()} == {0.5}
    same = spark.createDataFrame([(1, 1), (3, 1), (4, 1), (5, 1)], "doc_id int, quality int")
    assert all(r.score > 0.5 for r in line_quality.score(docs, line_quality.fit(docs, same)).collect())
    assert line_quality.score(docs.limit(0), line_quality.fit(docs.limit(0), same)).count() == 0


def test_lines_are_measured_alike_alone_and_together():
    texts = [t.encode() for _, t, _ in quality_texts(20, 9)] + [b"", b"\n\n", b"one", "é ü".encode()]
    whole = line_quality.measure(texts)
    for n, text in enumerate(texts):
        alone = line_quality.measure([text])
        assert (alone.features == whole.features[whole.offset[n] : whole.offset[n + 1]]).all()
        assert alone.number.tolist() == whole.number[whole.offset[n] : whole.offset[n + 1]].tolist()
    assert pa.array(np.diff(whole.offset)).to_pylist()[-4:] == [0, 0, 1, 1]
