"""Runs of words that repeat with a period.

A run is a stretch of words with smallest period q (words q apart are equal), at
least LEAST and MIN_EXP * q words long, that no neighbouring word extends.

Every lag up to n / MIN_EXP is scanned: the array of word numbers is compared with
itself shifted by the lag, and the stretches of equal words are measured. A lag
that is a multiple of a run's period finds the run again, with the same ends;
of equal ends the smallest lag is the period.

Texts of similar length are laid end to end, their words numbered apart, so that
one comparison serves many of them. The work on a text grows with the square of its
length: a text of over LONG characters is dealt out as ranges of lags, and what the
ranges find is brought together again by its row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.columns import WHITE, let, words_of
from driftline.llm.words import distinct_words, slices
from driftline.session import written

LEAST = 24
MIN_EXP = 3
#: Characters beyond which a text is dealt out, and comparisons of words in one range of its lags.
LONG = 1 << 18
WORK = 1 << 32
#: Words that are compared in one go; numbers of theirs fit into 16 bits.
GROUP = 1 << 16
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"

_ONES = np.uint64(0x0101010101010101)

Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def stretches(ids: np.ndarray, sizes: np.ndarray, least: int = LEAST, min_exp: int = MIN_EXP, lags: tuple[int, int] | None = None) -> Found:
    """Start in ``ids``, length and lag of each maximal stretch that is long enough for its lag.

    ``ids`` holds texts of ``sizes`` words end to end, the longest first; no two
    texts share a number.
    """
    ends = np.cumsum(sizes)
    low, high = lags or (1, int(sizes[0]) // min_exp)
    buffer = np.zeros(len(ids) + 16, np.bool_)
    found: list[Found] = []
    for lag in range(low, min(high, int(sizes[0]) // min_exp) + 1):
        texts = int(np.searchsorted(-sizes, -max(least, min_exp * lag), side="right"))
        if not texts:
            break
        n = int(ends[texts - 1]) - lag
        equal = np.equal(ids[lag : lag + n], ids[:n], out=buffer[:n])
        buffer[n : n + 16] = False
        need = max(1, least - lag, (min_exp - 1) * lag)
        if need >= 15:  # such a stretch fills one aligned group of 8 at least
            begin, length = _around_full_groups(buffer, n)
        else:
            turns = np.flatnonzero(np.diff(equal.view(np.int8), prepend=0, append=0))
            begin, length = turns[::2], turns[1::2] - turns[::2]
        long = length >= need
        if long.any():
            found.append((begin[long], length[long] + lag, np.full(int(long.sum()), lag, np.int64)))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 3


def _around_full_groups(equal: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the stretches of ``equal[:n]`` that fill an aligned group of 8; 16 values after these are false."""
    full = np.flatnonzero(equal[: (n + 7) // 8 * 8].view(np.uint64) == _ONES)
    if not len(full):
        return full, full
    apart = np.flatnonzero(np.diff(full) > 1)
    begin = full[np.concatenate(([0], apart + 1))] * 8
    end = full[np.concatenate((apart, [len(full) - 1]))] * 8 + 8
    step = np.arange(7)
    begin = begin - np.cumprod(equal[begin[:, None] - 1 - step], 1).sum(1)  # before the first value lies the last of the buffer, which is false
    end = end + np.cumprod(equal[end[:, None] + step], 1).sum(1)
    return begin, end - begin


def primitive(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> Found:
    """Of stretches with the same ends the one with the smallest lag; by start, then period."""
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), np.bool_)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _runs(number: np.ndarray, bounds: np.ndarray, least: int, min_exp: int) -> Found:
    """The runs of texts whose words ``number`` holds; starts count from the first word of the first text."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= least]
    found: list[Found] = []
    at, total = 0, np.concatenate(([0], np.cumsum(sizes[order])))
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(total, total[at] + GROUP, side="right")) - 1)
        some = order[at:to]
        where = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in some])
        owner = np.repeat(np.arange(len(some)), sizes[some])
        _, ids = np.unique(owner * (int(number.max()) + 1) + number[where], return_inverse=True)
        ids = ids.astype(np.uint16 if len(ids) <= GROUP else np.int32)
        start, length, period = stretches(ids, sizes[some], least, min_exp)
        found.append((where[start], length, period))
        at = to
    return primitive(*map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 3


def _rows(key: pa.Array, words: pa.Array, number: np.ndarray, bounds: np.ndarray, runs: Found) -> pa.RecordBatch:
    """What is returned of each text, given the runs of all of them by start."""
    start, length, period = runs
    text = np.searchsorted(bounds, start, side="right") - 1
    lists = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(text, np.arange(len(bounds))), pa.int32()),
        pa.StructArray.from_arrays([pa.array(start - bounds[text]), pa.array(length), pa.array(period)], names=["start", "length", "period"]),
    )
    step = np.bincount(start + period, minlength=len(number) + 1) - np.bincount(start + length, minlength=len(number) + 1)
    kept = np.cumsum(step)[: len(number)] == 0
    left = np.concatenate(([0], np.cumsum(kept)))[bounds]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.take(pa.array(number[kept]))), pa.scalar(" ", pa.large_string()))
    return pa.RecordBatch.from_arrays([key, pa.array(np.diff(bounds)), lists, collapsed.cast(pa.string())], names=["key", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, min_exp: int = MIN_EXP, long: int = LONG, work: int = WORK) -> DataFrame:
    """One row per row: the id, ``n_words``, ``runs`` (``start``, ``length``, ``period``; by start, then period) and ``collapsed``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``collapsed`` is the text
    without the words that a run holds after its first period, joined by one space.
    A null, empty or blank text has no words, no runs and an empty ``collapsed``.
    Rows with null, equal or repeated ids each get their own row. An empty table
    gives an empty result; columns other than the id and the text aren't read.
    """
    rows = docs.select(F.col(id_col).alias("key"), F.col(text).alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_words bigint, runs {RUNS}, collapsed string"

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 4096, 1 << 23, column=1):
                words, number, bounds = distinct_words(some.column(1), as_array=True, lower=False)
                yield _rows(some.column(0), words, number, bounds, _runs(number, bounds, least, min_exp))

    def ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1, column=1):
                _, number, _ = distinct_words(some.column(1), as_array=True, lower=False)
                if len(number):
                    found = stretches(number.astype(np.int32), np.array([len(number)]), least, min_exp, (some.column(2)[0].as_py(), some.column(3)[0].as_py()))
                    start, length, period = primitive(*found)
                    yield pa.RecordBatch.from_arrays([pa.repeat(some.column(0)[0], len(start)), pa.array(start), pa.array(length), pa.array(period)], names=["row", "start", "length", "period"])

    def collapse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1, column=1):
                words, number, bounds = distinct_words(some.column(1), as_array=True, lower=False)
                found = some.column(2).flatten()
                yield _rows(some.column(0), words, number, bounds, tuple(pc.struct_field(found, i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)))

    characters = F.coalesce(F.length("text"), F.lit(0))
    short = rows.where(characters <= long).mapInArrow(whole, schema)
    big = written(rows.where(characters > long).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    lags = (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) / min_exp).cast("bigint")
    width = F.greatest(F.lit(1), (work / (lags * min_exp)).cast("bigint"))
    units = big.withColumns({"lags": lags}).where("lags > 0").withColumn("width", width).withColumn("low", F.explode(F.expr("sequence(1, lags, width)")))
    units = units.select("row", "text", "low", (F.col("low") + F.col("width") - 1).alias("high")).repartition("row", "low")
    found = units.mapInArrow(ranges, "row bigint, start bigint, length bigint, period bigint")
    # runs and the lags that find them are fewer than a few times the words of the text
    runs = found.groupBy("row", "start", "length").agg(F.min("period").alias("period")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("found"))
    ordered = F.transform(F.coalesce("found", F.array()), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
    whole_again = big.join(runs, "row", "left").select("key", "text", ordered.alias("found")).mapInArrow(collapse, schema)
    return short.unionByName(whole_again).withColumnRenamed("key", id_col)


def planted(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The id and the text, in which every tenth document (by the CRC-32 of its decimal id) repeats itself from some word on.

    With h the CRC-32 and g = floor(h / 10), each word i >= a = g % n becomes the
    original word a + (i - a) % p with p = 1 + floor((n - a) / (3 + g % 8)). Documents
    without an id or without words stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = g % n
        p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("bigint")
        return let(F.struct(a.alias("a"), p.alias("p")), lambda s: F.transform(words, lambda w, i: F.when(i < s["a"], w).otherwise(F.get(words, (s["a"] + (i - s["a"]) % s["p"]).cast("int")))))

    chosen = (h % 10 == 0) & (F.btrim(F.col(text), F.lit(WHITE)) != "")
    return docs.select(id_col, F.when(chosen, F.array_join(let(words_of(F.col(text)), repeated), " ")).otherwise(F.col(text)).alias(text))


def strongest(runs: Column) -> Column:
    """The run with the greatest exact ratio of length to period; of equal ones the first. Null if there is none."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def digests(found: DataFrame) -> DataFrame:
    """The columns of ``periodic_runs`` as figures and hashes: the number of runs, the strongest one, and SHA-256 of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        *[c for c in found.columns if c not in ("n_words", "runs", "collapsed")],
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
