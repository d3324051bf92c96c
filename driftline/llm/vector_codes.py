"""Codes of vectors: four codebooks of at most 256 integer entries, fitted by Lloyd's rounds.

Components become integers floor(1024 x), vectors four parts. Equal parts at one
position are brought together first, as one row with the number of vectors that hold
it; the rounds run over these rows and weigh them. A round sends the codebooks to
all tasks (4 x 256 entries, whatever the input) and gets back one sum for each entry
and component. The codes and errors of the distinct parts are joined back to the vectors.

A part that very many vectors share is a hot key of that join, a label of theirs one
of the join that gives its error: see ``join_counted``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.columns import join_counted
from driftline.session import written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Integer components beyond this count as this, so that all sums of squares fit into 64 bits.
LARGEST = 1 << 24


class Codes(NamedTuple):
    """``rows``: the columns of the vectors but the vector, with ``code``, ``codes`` and ``error``. ``books``: entries by position, entry, component."""

    rows: DataFrame
    books: np.ndarray


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row by squared distance, ties to the lower index, and that distance; exact."""
    most = int(max(np.abs(rows).max(initial=0), np.abs(book).max(initial=0)))
    exact = np.float64 if 4 * most * most * max(1, rows.shape[1]) < 1 << 53 else np.int64
    far = (book * book).sum(1) - 2 * (rows.astype(exact) @ book.astype(exact).T)
    best = far.argmin(1)
    return best, far[np.arange(len(rows)), best].astype(np.int64) + (rows * rows).sum(1)


def integer_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows that have a code, with ``whole``: their integer components.

    Left out are null and empty vectors and those with a component that is null or
    not finite. A component beyond LARGEST after scaling counts as LARGEST.
    """
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clipped = F.transform(F.when(fine, F.col(vector)), lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * SCALE))).cast("int"))
    return vectors.withColumn("__whole", clipped).where(F.col("__whole").isNotNull())


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", carry: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Fit codebooks to all vectors and encode all of them.

    A codebook begins with the parts of the ``entries`` vectors with the smallest ids
    (equal ids by vector; null ids last). Each round assigns every part to its nearest entry
    and replaces an entry by floor(sum / count) of its parts; entries without parts stay.

    All vectors have the length of the one with the smallest id; others, and all
    if that isn't a multiple of ``parts``, have no code and are left out like those that
    ``integer_vectors`` leaves out. Fewer vectors than entries make shorter codebooks,
    none give no rows. Null and repeated ids are vectors like any others.
    """
    spark = vectors.sparkSession
    named = integer_vectors(vectors.select(F.col(id_col).alias("__id"), F.col(vector).alias("__vector"), *[F.col(c).alias(f"__carry_{c}") for c in carry]), "__vector")
    kept = written(named.drop("__vector").withColumn("__row", F.monotonically_increasing_id()), "integer-vectors")
    begin = [r["__whole"] for r in kept.orderBy(F.asc_nulls_last("__id"), "__whole").select("__whole").limit(entries).collect()]
    width = len(begin[0]) if begin else parts
    if width % parts:
        width = 0
    begin = [v for v in begin if len(v) == width]
    if len(begin) < entries and width:  # vectors of other lengths stood among the first
        begin = [r["__whole"] for r in kept.where(F.size("__whole") == width).orderBy(F.asc_nulls_last("__id"), "__whole").select("__whole").limit(entries).collect()]
    kept = kept.where(F.size("__whole") == width)
    books = np.array(begin, np.int64).reshape(len(begin), parts, width // parts).transpose(1, 0, 2)

    step = width // parts
    cut = F.array(*[F.struct(F.lit(p).alias("position"), F.slice("__whole", p * step + 1, step).alias("part")) for p in range(parts)])
    pieces = kept.select("__row", F.inline(cut)) if step else kept.select("__row", F.lit(0).alias("position"), F.col("__whole").alias("part"))
    distinct = written(pieces.groupBy("position", "part").agg(F.count(F.lit(1)).alias("weight")), "distinct-parts")
    for _ in range(rounds if len(begin) else 0):
        books = _replaced(distinct, books)

    assigned = written(_assigned(distinct, books), "part-codes")
    n = kept.count()
    joined = join_counted(pieces, assigned, ["position", "part"], "weight", n * parts)
    both = joined.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("position", "entry"))).alias("found"), F.sum("distance").alias("error"))
    rows = kept.drop("__whole").join(both, "__row")
    out = rows.select(
        F.col("__id").alias(id_col),
        *[F.col(f"__carry_{c}").alias(c) for c in carry],
        F.lower(F.array_join(F.transform("found", lambda x: F.lpad(F.hex(x["entry"]), 2, "0")), "")).alias("code"),
        F.transform("found", lambda x: x["entry"]).alias("codes"),
        "error",
    )
    return Codes(out, books)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, width)


def _replaced(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each task adds up the weighted parts of each entry, Spark adds up the tasks."""
    parts, entries, width = books.shape
    sent = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, books = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), sent.value
        for batch in batches:
            position, weight = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            rows = _matrix(batch.column(1), width)
            for p in range(parts):
                here = position == p
                entry, _ = nearest(rows[here], books[p])
                np.add.at(sums[p], entry, rows[here] * weight[here, None])
                np.add.at(counts[p], entry, weight[here])
        at, k = np.nonzero(counts)
        for some in np.array_split(np.arange(len(at)), max(1, len(at) // 64)):
            x = sums[at[some], k[some]]
            place = np.repeat(some, width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (at[place], k[place], np.tile(np.arange(width), len(some)), x.ravel(), counts[at[place], k[place]])],
                names=["position", "entry", "component", "sum", "count"],
            )

    summed = distinct.mapInArrow(run, "position bigint, entry bigint, component bigint, sum bigint, count bigint").groupBy("position", "entry", "component").agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"))
    books = books.copy()
    found = summed.toArrow()  # at most a row for each component of the codebooks
    p, k, j, total, count = (found.column(c).to_numpy() for c in ("position", "entry", "component", "sum", "count"))
    books[p, k, j] = total // count
    sent.destroy()
    return books


def _assigned(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """The distinct parts with ``entry`` and ``distance``."""
    parts, _, width = books.shape
    sent = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in batches:
            position, rows = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            entry, distance = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            for p in range(parts):
                here = position == p
                entry[here], distance[here] = nearest(rows[here], books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(entry), pa.array(distance)], names=["position", "part", "weight", "entry", "distance"])

    return distinct.mapInArrow(run, "position int, part array<int>, weight bigint, entry bigint, distance bigint")


def books_sha256(books: np.ndarray) -> str:
    """SHA-256 of all entries' components as decimal numbers by position, entry and component, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(codes: Codes, label: str = "label") -> DataFrame:
    """Add ``label_error`` (errors summed over rows with an equal label, null being one) and ``codebooks_sha256``."""
    rows = written(codes.rows, "codes")
    totals = rows.groupBy(label).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("weight"))
    joined = join_counted(rows, written(totals, "label-errors"), [label], "weight", rows.count())
    return joined.drop("weight").withColumn("codebooks_sha256", F.lit(books_sha256(codes.books)))


def decoded(codes: Codes) -> DataFrame:
    """The rows with ``decoded``: the vector that the code stands for."""
    rows = codes.rows
    sent = rows.sparkSession.sparkContext.broadcast(codes.books / SCALE)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in batches:
            entry = _matrix(batch.column("codes"), len(books))
            whole = np.concatenate([book[entry[:, p]] for p, book in enumerate(books)], 1)
            ends = np.arange(len(whole) + 1) * whole.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(whole.ravel()))], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, f"{fields}, decoded array<double>")
