"""Quality rules: base rules plus a hashed n-gram log-likelihood ratio.

Every word and every pair of adjacent words is hashed into one of ``BUCKETS``
features. Two multinomials are counted over them, one on all documents (raw) and
one on trusted documents (target); the score of a document is the sum of
``log(target / raw)`` over its features, divided by their number. A document is
kept if it passes the base rules and its score reaches the threshold; nothing is
drawn at random.

Only DataFrame functions are used. What passes through the driver is
the threshold and the table of ``BUCKETS`` ratios, whose size doesn't depend on the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.columns import WHITE, let, words_of
from driftline.session import written

#: Features of the multinomials.
BUCKETS = 10_000
#: Weight of the raw multinomial in the target's, in features.
PRIOR = 10_000.0
#: The part of trusted documents that may score below the threshold.
LEAST = 0.001
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Places in the sieve of trusted ids, a bit each: 4 MB.
PLACES = 2**25
SYMBOLS = r"[#*$%&|<>]+"


def _feature(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _joined(hashes: Column, step: int) -> Column:
    """``hash(h[i], h[i + step])`` for each i: from hashes of n words those of n + step words."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, step + 1, n), lambda a, b: F.xxhash64(a, b))


def _repeat_words(pairs: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text."""

    def covered(found: Column) -> Column:
        same = lambda i, j: F.get(found, i)["h"] == F.get(found, j)["h"]
        places = F.sequence(F.lit(0), F.size(found) - 1)
        twice = F.filter(places, lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        starts = F.array_sort(F.transform(twice, lambda i: F.get(found, i)["at"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            starts,
            zero,
            lambda s, at: F.struct((at + WINDOW).alias("end"), (s["n"] + WINDOW - F.greatest(F.lit(0), s["end"] - at)).alias("n")),
            lambda s: s["n"],
        )

    def counted(windows: Column) -> Column:
        sorted_pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), none).otherwise(let(sorted_pairs, covered))

    def quads(fours: Column) -> Column:  # if no 4 words come twice, no 8 do
        return F.when(F.size(F.array_distinct(fours)) == F.size(fours), none).otherwise(let(_joined(fours, 4), counted))

    none = F.lit(0).cast("long")
    return let(_joined(pairs, 2), quads)


def _with_hashes(docs: DataFrame, text: str) -> DataFrame:
    """Add the words, their hashes, and the hashes of adjacent words."""
    hashed = docs.withColumn("__words", words_of(F.col(text))).withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    return hashed.withColumn("__pairs", _joined(F.col("__hashes"), 1))


def base_counts(text: Column, words: Column, pairs: Column) -> dict[str, Column]:
    """The counts of the base rules, all long."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.char_length(whole) - F.char_length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(pairs).cast("long"),
    }


def _counts(tallied: DataFrame, rest: DataFrame, text: str) -> tuple[list[int], list[int]]:
    """How often each feature occurs in all documents, which lie in ``tallied`` or ``rest``, and in the trusted ones."""
    words = rest.select(words_of(F.col(text)).alias("word")).where(F.size("word") > 0)
    words = words.withColumn("before", F.concat(F.array(F.lit(None).cast("string")), F.slice("word", 1, F.size("word") - 1)))
    hashes = words.select(F.inline(F.arrays_zip("word", "before"))).select("before", F.xxhash64("word").alias("h"))
    pair = F.when(F.col("before").isNotNull(), _feature(F.xxhash64(F.xxhash64("before"), F.col("h"))))
    features = hashes.select(F.stack(F.lit(2), _feature(F.col("h")), pair).alias("feature")).where(F.col("feature").isNotNull())
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for row in features.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect():  # BUCKETS rows at most
        raw[row.feature] = row.n
    known = _each(tallied, "__trusted").groupBy("feature")
    for row in known.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("__trusted"), F.col("n")).otherwise(0)).alias("trusted")).collect():
        raw[row.feature] += row.n
        target[row.feature] = row.trusted
    return raw, target


def count_features(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[list[int], list[int]]:
    """How often each feature occurs in all documents, and in the trusted ones, of which ``trusted`` holds the ids."""
    return _counts(*_split(docs, trusted, id_col, text), text)


def _raw_shares(raw: list[int]) -> list[float]:
    total = sum(raw) + BUCKETS
    return [(r + 1) / total for r in raw]


def ratios(raw: list[int], target: list[int]) -> list[float]:
    """``log(target / raw)`` of each feature; 0 where nothing is trusted. The target leans on the raw multinomial with PRIOR features."""
    all_target = sum(target)
    if not all_target:
        return [0.0] * BUCKETS
    return [round(math.log((t + PRIOR * p) / (all_target + PRIOR) / p), 4) for t, p in zip(target, _raw_shares(raw), strict=True)]


def _constant(values: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")  # folded into one constant


def _score(hashes: Column, pairs: Column, fitted: list[float]) -> Column:
    table = _constant(fitted)
    ratio = lambda h: F.get(table, _feature(h))
    both = F.zip_with(hashes, pairs, lambda h, p: F.when(p.isNull(), ratio(h)).otherwise(ratio(h) + ratio(p)))
    total = F.aggregate(both, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(hashes) == 0, F.lit(0.0)).otherwise(total / (F.size(hashes) + F.size(pairs)))


def _with_tally(hashed: DataFrame) -> DataFrame:
    """Add ``features``, those of a text in ascending order, and ``times``, how often each occurs."""
    some = lambda h: F.coalesce(_feature(h), F.lit(0))  # noqa: E731  # never null, and known not to be: arrays of such integers are sorted fast
    every = hashed.withColumn("__every", F.sort_array(F.concat(F.transform("__hashes", some), F.transform("__pairs", some))))
    starts = F.filter(F.transform("__every", lambda f, i: F.when((i == 0) | (f != F.get("__every", i - 1)), i)), F.isnotnull)
    bounds = every.withColumn("features", F.array_distinct("__every")).withColumn("__starts", starts)
    ends = F.concat(F.slice("__starts", 2, F.greatest(F.size("__starts") - 1, F.lit(0))), F.array(F.size("__every")))
    return bounds.withColumn("times", F.when(F.size("features") > 0, F.zip_with(ends, "__starts", lambda end, start: end - start)))


def _each(tallied: DataFrame, *columns: str) -> DataFrame:
    """A row for each feature of a text, with the ``n`` times that it occurs."""
    return tallied.select(*columns, "times", F.posexplode("features").alias("i", "feature")).select(*columns, "feature", F.get("times", F.col("i")).alias("n"))


def _scores_without(tallied: DataFrame, raw: list[int], target: list[int]) -> DataFrame:
    """The scores that trusted documents would have if they weren't: the own features of each are taken out of the target."""
    shares = _raw_shares(raw)
    log_share, lean = _constant([math.log(p) for p in shares]), _constant([t + PRIOR * p for t, p in zip(target, shares, strict=True)])
    each = F.col("n") * (F.log(F.get(lean, F.col("feature")) - F.col("n")) - F.get(log_share, F.col("feature")))
    sums = _each(tallied.withColumn("__row", F.monotonically_increasing_id()), "__row").groupBy("__row").agg(F.sum(each).alias("total"), F.sum("n").alias("n"))
    return sums.select((F.col("total") / F.col("n") - F.log(F.lit(sum(target) + PRIOR) - F.col("n"))).alias("score"))


def _sifted(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Add ``__likely``: true of all documents with one of the ids and, by chance, of some others, whose id shares one of PLACES places with such an id.

    What is broadcast is a bit for each place, in rows of 64: PLACES / 64 rows at most, however many ids there are.
    """
    if docs.schema[id_col].dataType != ids.schema[id_col].dataType:  # equal ids may have different hashes
        return docs.withColumn("__likely", F.lit(True))
    place = F.pmod(F.xxhash64(id_col), F.lit(PLACES))
    row, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    taken = ids.select(row.alias("__row"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("__bit")).groupBy("__row").agg(F.bit_or("__bit").alias("__bits"))
    likely = F.coalesce(F.bit_get("__bits", bit) == 1, F.lit(False))
    return docs.join(F.broadcast(taken), row == F.col("__row"), "left").withColumn("__likely", likely).drop("__row", "__bits")


def _split(docs: DataFrame, trusted: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``n_words``, ``features`` with their ``times``, and ``__trusted`` of all trusted documents and some others; the texts of the rest.

    Texts meet the ids, of which ``trusted`` has the rows, by a shuffle at any size, but only those that a bounded sieve of the ids lets pass.
    """
    ids = trusted.select(F.col(id_col)).where(F.col(id_col).isNotNull())
    sifted = _sifted(docs.select(id_col, text), ids, id_col)
    known = ids.distinct().select(F.col(id_col).alias("__trusted")).hint("merge")
    met = sifted.where("__likely").join(known, F.col(id_col) == F.col("__trusted"), "left").withColumn("__trusted", F.col("__trusted").isNotNull())
    tallied = _with_tally(_with_hashes(met, text)).select(F.size("__words").alias("n_words"), "features", "times", "__trusted")
    return tallied, sifted.where(~F.col("__likely")).select(text)


def fit_threshold(tallied: DataFrame, raw: list[int], target: list[int]) -> float:
    """The least score of a kept document: the LEAST quantile of the scores of the trusted documents, which ``tallied`` holds.

    A trusted document scores higher than its like by ratios that it has a part in,
    so each is scored with its own features taken out of the target; that is how a
    document that isn't trusted is scored. Those under MIN_WORDS words don't count.
    Without trusted documents everything is kept.
    """
    if not any(target):
        return -math.inf
    return _least_quantile(written(_scores_without(tallied.where(F.col("n_words") >= MIN_WORDS), raw, target), "scores"))


def _least_quantile(scored: DataFrame) -> float:
    """The exact LEAST quantile, between two scores in proportion; of all scores only the lowest are sorted."""
    n = scored.count()
    if not n:
        return -math.inf
    place = LEAST * (n - 1)
    bound = scored.agg(F.percentile_approx("score", min(1.0, 2 * LEAST + 2 / n))).first()[0]  # not exact, but beyond the place
    low = [r.score for r in scored.where(F.col("score") <= bound).orderBy("score").offset(int(place)).limit(2).collect()]
    return low[0] if len(low) == 1 else (int(place) + 1 - place) * low[0] + (place - int(place)) * low[1]


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Add the counts of the base rules, ``score``, ``base_failed`` and ``kept`` to every document.

    A null or blank text has no words and fails the base rules (fewer than
    MIN_WORDS words). Repeated rows are judged alike; an empty table gives an
    empty result; columns of the result replace columns of ``docs`` that have the
    same names.
    """
    met, rest = _split(docs, trusted, id_col, text)
    tallied = written(met, "tallied")  # so that texts meet the ids once
    raw, target = _counts(tallied, rest, text)
    fitted = ratios(raw, target)
    threshold = fit_threshold(tallied.where("__trusted"), raw, target)
    hashed = _with_hashes(docs, text)
    counts = base_counts(F.col(text), F.col("__words"), F.col("__pairs"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    found = counts | {"score": _score(F.col("__hashes"), F.col("__pairs"), fitted)}
    # a generated row: no filter on the verdict is pushed below it, where it would count everything again
    result = F.inline(F.array(F.struct(*[c.alias(n) for n, c in found.items()])))
    judged = hashed.select(*[c for c in docs.columns if c not in (*found, "base_failed", "kept")], result)
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))
