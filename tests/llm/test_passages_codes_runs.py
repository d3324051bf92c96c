"""Passages of benchmarks, vector codes and periodic runs against plain versions of themselves, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import decontamination, periodic_runs, vector_codes
from driftline.llm.entries import QUERIES

DOCS = "doc_id long, text string, lang string, n_words string, items string, hits string"
ITEMS = "item_id string, text string, spans string"


def words_of(text):
    return [m.span() for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", text or "")]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_passages(docs, items, size=10):
    """Every window of every item looked for at every word of every document."""
    windows = []
    for item, text in items:
        w = [lowered(text)[a:b] for a, b in words_of(text)]
        windows += [(item, w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    out = []
    for doc, text in docs:
        at = words_of(text)
        w = [lowered(text)[a:b] for a, b in at]
        hit, found = set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    found |= {item} - {None}
        starts = sorted(h for h in hit if h - 1 not in hit)
        ends = sorted(h for h in hit if h + 1 not in hit)
        out.append((doc, len(w), len(hit), tuple(sorted(found)), tuple((at[a][0], at[b][1]) for a, b in zip(starts, ends))))
    return sorted(out, key=str)


def got_passages(found):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple((s.start, s.end) for s in r.spans)) for r in found.collect()), key=str)


PASSAGE = "One TWO three, four-five: six seven eight; nine ten eleven Straße"
ITEM_ROWS = [("b", PASSAGE), ("a", PASSAGE.upper().replace("SS", "ß")), ("c", "short item"), ("c", "short item"), ("d", None), ("e", " -- "), (None, "nameless words here"), ("f", "ten eleven straße tail of a longer item that goes on and on and on")]
DOC_ROWS = [
    (1, None),
    (2, ""),
    (3, "\x00\t-- !!"),
    (4, "before. " + PASSAGE + "! after"),
    (4, "before. " + PASSAGE + "! after"),
    (5, PASSAGE.replace("seven", "sieben")),
    (6, "a short ITEM, and a Short-item; shortitem"),
    (7, "nameless words here"),
    (None, "word " * 5 + PASSAGE + " " + PASSAGE),
    (8, "one two three four five six seven eight nine"),
    (9, "日本語 short item"),
    (10, ("short item " + "filler " * 30) * 300),
    (11, PASSAGE.lower()),
]


@pytest.fixture(scope="module")
def passages(spark):
    docs = spark.createDataFrame([(i, t, "x", "n", "m", "h") for i, t in DOC_ROWS], DOCS)
    return docs, spark.createDataFrame([(i, t, "s") for i, t in ITEM_ROWS], ITEMS)


@pytest.mark.parametrize("part", [decontamination.PART, 60])
def test_passages(passages, part):
    """One automaton, or several that read one after another; other columns of clashing names don't matter."""
    docs, items = passages
    assert got_passages(decontamination.find_passages(docs, items, part=part)) == plain_passages(DOC_ROWS, ITEM_ROWS)


def test_passages_of_random_words(spark):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs, items = [(i, text(rng.randrange(60))) for i in range(60)], [(str(i), text(rng.randrange(1, 14))) for i in range(30)]
    found = decontamination.find_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id string, text string"), window=5)
    assert got_passages(found) == plain_passages(docs, items, 5)


def test_long_items_are_cut_into_pieces_that_hold_each_window_once(spark):
    words = [f"w{i}" for i in range(25)]
    items = spark.createDataFrame([("a", " ".join(words)), ("b", "x y"), ("c", None)], "item_id string, text string")
    pieces = [tuple(r.words) for r in decontamination.pieces_of(items, window=4, piece=3).where("item = 'a'").collect()]
    windows = [p[i : i + 4] for p in pieces for i in range(len(p) - 3)]
    assert sorted(windows) == sorted(tuple(words[i : i + 4]) for i in range(22))


def test_passages_of_empty_tables(passages):
    docs, items = passages
    assert decontamination.find_passages(docs.limit(0), items).count() == 0
    assert {(r.n_hit, len(r.spans)) for r in decontamination.find_passages(docs, items.limit(0)).collect()} == {(0, 0)}
    digest = decontamination.digests(decontamination.find_passages(docs, items.limit(0))).first()
    assert digest.items_sha256 == hashlib.sha256(b"").hexdigest() and not digest.contaminated


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """Lloyd's rounds over all vectors, one by one; rows of (id, label, integers)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    step = len(rows[0][2]) // parts if rows else 0
    cut = lambda v, p: v[p * step : (p + 1) * step]
    books = [[cut(r[2], p) for r in rows[:entries]] for p in range(parts)]

    def near(v, book):
        far = [sum((a - b) ** 2 for a, b in zip(v, e)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p, book in enumerate(books):
            found = [near(cut(r[2], p), book)[0] for r in rows]
            for k in range(len(book)):
                mine = [cut(r[2], p) for r, f in zip(rows, found) if f == k]
                if mine:
                    book[k] = [sum(x) // len(mine) for x in zip(*mine)]
    out, labels = [], {}
    for r in rows:
        best = [near(cut(r[2], p), books[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{k:02x}" for k, _ in best), sum(d for _, d in best), r[1]))
        labels[r[1]] = labels.get(r[1], 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, labels[lab], digest) for i, c, e, lab in out), key=str)


def got_codes(vectors, **how):
    found = vector_codes.with_label_error(vector_codes.compress(vectors, carry=("label",), **how))
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found.collect()), key=str)


VECTORS = "vec_id long, embedding array<float>, label int, code string, error string"


def as_integers(v):
    return [math.floor(1024 * float(np.float32(x))) for x in v]


@pytest.mark.parametrize("entries", [256, 5])
def test_codes(spark, entries):
    rng = np.random.default_rng(3)
    good = [(int(i), rng.normal(0, 1, 8).tolist(), int(rng.integers(3)) or None) for i in rng.permutation(60)]
    good += [(i, [0.25] * 4 + [-0.0001] * 4, None) for i in range(60, 110)]  # one vector, many times
    good += [(None, [0.5] * 8, 7), (3, [-1.0] * 8, 7), (3, [-1.0] * 8, 7)]
    bad = [(200, None, 1), (201, [None] + [0.0] * 7, 1), (-202, [math.nan] * 8, 1), (203, [math.inf] + [0.0] * 7, 1), (204, [], 1), (205, [1.0] * 4, 1), (206, [1.0] * 7, 1)]
    vectors = spark.createDataFrame([(*r, "x", "y") for r in good + bad], VECTORS)
    want = plain_codes([(i, lab, as_integers(v)) for i, v, lab in good], entries=entries)
    assert got_codes(vectors, entries=entries) == want
    assert got_codes(vectors.repartition(7), entries=entries) == want


def test_codes_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert got_codes(empty) == []
    assert got_codes(spark.createDataFrame([(1, [1.0] * 6, 1, "", "")], VECTORS)) == []  # six components don't make four parts
    huge = spark.createDataFrame([(1, [3e38, -3e38, 0.0, 0.0], 1, "", ""), (2, [1e5, 0.0, 0.0, 0.0], 1, "", "")], VECTORS)
    assert [r[1:3] for r in got_codes(huge, entries=1)] == [("00000000", 2**46)] * 2  # both parts of the first position count 2^24 - 1 or so apart
    

def test_nearest_is_exact_beyond_doubles():
    rng = np.random.default_rng(5)
    rows, book = rng.integers(-(1 << 24), 1 << 24, (50, 16)), rng.integers(-(1 << 24), 1 << 24, (9, 16))
    best, far = vector_codes.nearest(rows, book)
    exact = [[sum(int(a - b) ** 2 for a, b in zip(r, e)) for e in book] for r in rows]
    assert best.tolist() == [x.index(min(x)) for x in exact] and far.tolist() == [min(x) for x in exact]


def test_decoded_vectors_are_the_entries(spark):
    vectors = spark.createDataFrame([(i, [i / 4, -i / 4, 0.0, 1.0], 1, "", "") for i in range(5)], VECTORS)
    for r in vector_codes.decoded(vector_codes.compress(vectors, carry=("embedding",))).collect():
        assert r.decoded == r.embedding and r.error == 0


def test_join_counted_splits_hot_keys(spark):
    from driftline.llm.columns import join_counted

    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 1).otherwise(F.col("id")).alias("key"))
    known = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("most"))
    joined = join_counted(rows, known, ["key"], "n", 3000)
    most = {r.key: r.most for r in known.collect()}
    assert sorted((r.id, r.most) for r in joined.collect()) == sorted((r.id, most[r.key]) for r in rows.collect())


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_planted(doc_id, text):
    w = WORD.findall(text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def plain_runs(w, least=24):
    """All stretches with each period, from the definition."""
    n, found = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, q, length) for (s, length), q in found.items())


def plain_rows(docs, least=24):
    out = []
    for doc_id, text in docs:
        w = plain_planted(doc_id, text)
        runs = plain_runs(w, least)
        drop = {i for s, q, length in runs for i in range(s + q, s + length)}
        out.append((doc_id, len(w), tuple((s, length, q) for s, q, length in runs), " ".join(x for i, x in enumerate(w) if i not in drop)))
    return sorted(out, key=str)


def got_runs(docs, **how):
    found = periodic_runs.periodic_runs(periodic_runs.planted(docs), **how)
    return sorted(((r.doc_id, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed) for r in found.collect()), key=str)


def run_docs():
    rng = random.Random(11)
    out = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 23), (5, "a " * 24), (6, "A a " * 40), (7, "x " + "a b c " * 8 + "a y"), (None, "q r " * 30), (8, "\x1c  b " * 30), (8, "\x1c  b " * 30)]
    for i in range(10, 160):
        n = rng.randrange(1, 300)
        w = [rng.choice("ab" if i % 3 else "abcdefgh") for _ in range(n)]
        if i % 2:
            a, p = rng.randrange(n), rng.randrange(1, 30)
            w[a:] = [w[a + (j - a) % p] if a + (j - a) % p < n else w[a] for j in range(a, n)]
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("how", [{}, {"long": 100, "work": 200}, {"long": 0, "work": 1}], ids=["whole", "long texts dealt out", "all texts dealt out"])
def test_runs(spark, how):
    docs = run_docs() if how.get("work") != 1 else run_docs()[:40]
    frame = spark.createDataFrame([(i, t, "r", "c") for i, t in docs], "doc_id long, text string, runs string, collapsed string")
    assert got_runs(frame, **how) == plain_rows(docs)


def test_short_runs_without_the_shortcut(spark):
    docs = run_docs()
    assert got_runs(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), least=4) == plain_rows(docs, 4)


def test_run_digests(spark):
    docs = run_docs()
    found = periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.planted(spark.createDataFrame(docs, "doc_id long, text string"))))
    want = []
    for doc_id, _, runs, collapsed in plain_rows(docs):
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        text = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(collapsed.encode()).hexdigest()))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_of_an_empty_table(spark):
    assert got_runs(spark.createDataFrame([], "doc_id long, text string")) == []


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_vector_codes", "op13_periodic_runs"])
def test_same_rows_however_the_input_is_split(spark, small, name, tmp_path):
    for t in ("documents", "benchmark", "embeddings"):
        spark.read.parquet(f"{small}/{t}.parquet").repartition(5).write.parquet(f"{tmp_path}/{t}.parquet")
    key = lambda rows: sorted(map(str, rows))
    assert key(QUERIES[name](spark, str(tmp_path)).collect()) == key(QUERIES[name](spark, small).collect())
