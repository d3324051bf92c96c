"""Embedding near-duplicates by the epsilon grid order join.

Vectors of length 1 with cosine ``t`` or more lie within ``eps = sqrt(2 (1 - t))``
of each other. Vectors are turned onto their principal axes, put into grid cells
of side ``eps`` on the leading ones, and sorted by cell (the epsilon grid order).
The sequence is cut into blocks; intervals of blocks are joined recursively, level
by level, and a pair of intervals whose bounding boxes are over ``eps`` apart is
left out with all that lies below it. A box has the leading axes and the length of
what is left of a vector beyond them. The pairs of blocks that remain go by tiles of
TILE by TILE blocks, so that a block travels once to a tile; there the recursion
goes on down to PART rows, with boxes over all axes, and what remains is compared in
double precision.

Exact copies (by 128 bits of hash) are one vector with a multiplicity meanwhile. A pair of blocks gives
the number of links of each vector and a spanning forest, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.llm.components import components
from driftline.session import written

THRESHOLD = 0.95
#: Principal axes that have grid cells and bounding boxes.
AXES = 8
BLOCK = 1024
#: Blocks on each side of a tile.
TILE = 8
#: Rows of the smallest intervals, inside a block.
PART = 64
#: Intervals that are joined to one on the next level.
FAN = 8


def _valid(embedding: str) -> Column:
    finite = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(F.col(embedding).isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _axes(vectors: DataFrame, dim: int, n: int = AXES) -> np.ndarray:
    """The ``n`` leading principal axes, from the moments of all vectors; dim * (dim + 1) sums reach the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            x = _unit(_matrix(batch.column(0)))
            n, total, square = n + len(x), total + x.sum(axis=0), square + x.T @ x
        sums = np.concatenate(([float(n)], total, square.ravel()))
        yield pa.RecordBatch.from_pydict({"cell": np.arange(len(sums)), "x": sums})

    rows = vectors.select("embedding").mapInArrow(moments, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()
    sums = np.zeros(1 + dim + dim * dim)
    for row in rows:
        sums[row.cell] = row.x
    mean = sums[1 : dim + 1] / sums[0]
    _, vectors_of = np.linalg.eigh(sums[dim + 1 :].reshape(dim, dim) / sums[0] - np.outer(mean, mean))
    return vectors_of[:, ::-1][:, : min(n, dim)]


def _grid_order(vectors: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """Add ``cell``: the grid cells as bytes that sort like the tuple of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.floor(_unit(_matrix(batch.column(1))) @ axes / eps).astype(np.int64) + (1 << 31)
            keys = [row.tobytes() for row in cells.astype(">u4")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "cell"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("node", "embedding", "copies").mapInArrow(run, f"node long, embedding {kind}, copies long, cell binary")


def _boxes(k: int) -> list[str]:
    return [f"{side}{i}" for i in range(k) for side in ("lo", "hi")]


def _projected(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The coordinates on the axes, and the length of the rest."""
    p = unit @ axes
    return np.column_stack((p, np.sqrt(np.maximum(0.0, 1.0 - (p * p).sum(axis=1)))))


def _blocks(ordered: DataFrame, axes: np.ndarray, parts: int) -> DataFrame:
    """The sequence in written blocks with their bounding boxes, numbered without gap."""
    k = axes.shape[1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        nodes, copies, rows = [], [], []

        def flush(n: int) -> pa.RecordBatch:
            nonlocal serial, nodes, copies, rows
            a, b, x = np.concatenate(nodes), np.concatenate(copies), np.concatenate(rows)
            p = _projected(_unit(x[:n].astype(np.float64)), axes)
            made = {"place": [(part << 32) + serial], "nodes": [a[:n].tobytes()], "copies": [b[:n].tobytes()], "vectors": [x[:n].tobytes()]}
            made |= {f"lo{i}": [float(p[:, i].min())] for i in range(k)} | {f"hi{i}": [float(p[:, i].max())] for i in range(k)}
            nodes, copies, rows, serial = [a[n:]], [b[n:]], [x[n:]], serial + 1
            return pa.RecordBatch.from_pydict(made)

        held = 0
        for batch in batches:
            nodes.append(batch.column(0).to_numpy())
            copies.append(batch.column(2).to_numpy())
            flat = batch.column(1).flatten().to_numpy()
            rows.append(flat.reshape(batch.num_rows, -1))
            held += batch.num_rows
            while held >= BLOCK:
                yield flush(BLOCK)
                held -= BLOCK
        if held:
            yield flush(held)

    schema = "place long, nodes binary, copies binary, vectors binary, " + ", ".join(f"{c} double" for c in [f"lo{i}" for i in range(k)] + [f"hi{i}" for i in range(k)])
    order = ["cell", "node"]
    made = written(ordered.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("node", "embedding", "copies").mapInArrow(run, schema), "grid-blocks")
    numbers = made.select("place", (F.row_number().over(Window.orderBy("place")) - 1).cast("long").alias("block"))
    return made.join(numbers, "place").drop("place")


def _block_pairs(blocks: DataFrame, k: int, eps: float) -> DataFrame:
    """(i, j), i <= j: the pairs of blocks that can hold a link, by joining intervals from the whole sequence downwards."""
    boxes = written(blocks.select("block", *_boxes(k)), "boxes")
    levels = [boxes]
    while (n := levels[-1].count()) > 1:
        up = levels[-1].withColumn("block", F.expr(f"block div {FAN}"))
        extremes = [F.min(f"lo{i}").alias(f"lo{i}") for i in range(k)] + [F.max(f"hi{i}").alias(f"hi{i}") for i in range(k)]
        levels.append(written(up.groupBy("block").agg(*extremes), f"boxes-{n}"))
    pairs = blocks.sparkSession.range(1).select(F.col("id").alias("i"), F.col("id").alias("j"))
    for level in reversed(levels[:-1]):
        left = level.select(F.expr(f"block div {FAN}").alias("i"), *[F.col(c).alias(f"a_{c}") for c in ("block", *_boxes(k))])
        right = level.select(F.expr(f"block div {FAN}").alias("j"), *[F.col(c).alias(f"b_{c}") for c in ("block", *_boxes(k))])
        both = pairs.join(left, "i").join(right, "j").where(F.col("a_block") <= F.col("b_block"))
        apart = F.lit(0.0)
        for i in range(k):
            gap = F.greatest(F.lit(0.0), F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}"))
            apart = apart + gap * gap
        pairs = written(both.where(apart <= eps * eps * (1 + 1e-6) + 1e-9).select(F.col("a_block").alias("i"), F.col("b_block").alias("j")), "interval-pairs")
    return pairs


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n points the smallest point that the links i - j connect it to."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least square of a distance between the boxes of parts of ``a`` and of ``b``, PART rows each."""
    boxes = []
    for x in (a, b):
        firsts = np.arange(0, len(x), PART)
        boxes.append((np.minimum.reduceat(x, firsts), np.maximum.reduceat(x, firsts)))
    (a_lo, a_hi), (b_lo, b_hi) = boxes
    gap = np.maximum(0.0, np.maximum(a_lo[:, None] - b_hi[None], b_lo[None] - a_hi[:, None]))
    return (gap * gap).sum(axis=2)


def _close(a: np.ndarray, b: np.ndarray, least: float, eps: float, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, row and cosine of the pairs of unit vectors with a cosine of ``least`` or more."""
    near = _apart(a @ axes, b @ axes) <= eps * eps * (1 + 1e-6) + 1e-9
    if near.mean() > 0.5:  # one product costs less than its parts
        cosines = a @ b.T
        i, j = np.nonzero(cosines >= least)
        return i, j, cosines[i, j]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for k in np.flatnonzero(near.any(axis=1)):
        rows = np.flatnonzero(np.repeat(near[k], PART)[: len(b)])
        cosines = a[k * PART : (k + 1) * PART] @ b[rows].T
        i, j = np.nonzero(cosines >= least)
        found.append((i + k * PART, rows[j], cosines[i, j]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _compare(kind: str, threshold: float, eps: float, axes: np.ndarray):
    """Compare the pairs of blocks of one tile. A block comes once, with the blocks that it is compared to."""

    def run(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        got, pairs = {}, set()
        for row in sent.to_pylist():
            nodes = np.frombuffer(row["nodes"], "<i8")
            vectors = np.frombuffer(row["vectors"], kind).reshape(len(nodes), -1).astype(np.float64)
            got[row["block"]] = nodes, np.frombuffer(row["copies"], "<i8"), vectors, _unit(vectors)
            pairs.update((row["block"], j) for j in row["others"])
        numbers = sorted(got)
        first = dict(zip(numbers, np.cumsum([0, *(len(got[x][0]) for x in numbers)]).tolist(), strict=False))
        nodes, copies = (np.concatenate([got[x][c] for x in numbers]) for c in (0, 1))
        left, right, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(nodes), np.int64)
        for x, y in sorted(pairs):
            a, b, same = got[x], got[y], x == y
            i, j, close = _close(a[3], b[3], threshold - 1e-9, eps, axes)
            for e in np.flatnonzero(np.abs(close - threshold) < 1e-9):  # as the definition has it
                v, w = a[2][i[e]], b[2][j[e]]
                close[e] = np.dot(v, w) / (np.sqrt(np.dot(v, v)) * np.sqrt(np.dot(w, w)))
            stay = close >= threshold
            if same:
                stay &= i != j
            i, j = i[stay] + first[x], j[stay] + first[y]
            links += np.bincount(i, copies[j], minlength=len(nodes)).astype(np.int64)
            if not same:
                links += np.bincount(j, copies[i], minlength=len(nodes)).astype(np.int64)
            label = _forest(i, j, len(nodes))  # a spanning forest takes the place of all links
            some = np.flatnonzero(label != np.arange(len(nodes)))
            left.append(some)
            right.append(label[some])
        label = _forest(np.concatenate(left), np.concatenate(right), len(nodes))
        some = np.flatnonzero(links)
        return pa.table({"node": nodes[some], "root": nodes[label[some]], "links": links[some]})

    return run


def links_of(vectors: DataFrame, dim: int, threshold: float = THRESHOLD) -> DataFrame:
    """``node``, ``root`` and ``links`` from each pair of blocks: to be summed by node, and edges of a spanning forest.

    ``vectors``: ``node``, ``embedding`` (of ``dim`` valid components), ``copies``.
    """
    spark = vectors.sparkSession
    eps = float(np.sqrt(2 * (1 - threshold))) + 1e-9
    all_axes = _axes(vectors, dim, dim)
    axes = all_axes[:, :AXES]
    blocks = _blocks(_grid_order(vectors, axes, eps), axes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = _block_pairs(blocks, axes.shape[1] + 1, eps)
    pairs = pairs.withColumns({"ti": F.expr(f"i div {TILE}"), "tj": F.expr(f"j div {TILE}")})
    sides = pairs.select("ti", "tj", F.col("i").alias("block"), F.col("j").alias("other")).union(pairs.where("i < j").select("ti", "tj", F.col("j").alias("block"), F.lit(None).cast("long").alias("other")))
    asked = sides.groupBy("ti", "tj", "block").agg(F.collect_list("other").alias("others"))  # TILE others at most
    sent = asked.join(blocks.select("block", "nodes", "copies", "vectors"), "block")
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    return sent.groupBy("ti", "tj").applyInArrow(_compare(kind, threshold, eps, all_axes), "node long, root long, links long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Vectors that are null, zero or hold null or non-finite components link with
    nothing and are their own component; vectors of different lengths don't link.
    Repeated rows are vectors that link with each other. A component without a
    known id has a null ``component_id``; a row with a null id is not kept. An
    empty table gives an empty result; other columns, labels too, aren't read.
    """
    kind = rows.schema[embedding].dataType.elementType
    cast = F.col(embedding) if kind.typeName() in ("float", "double") else F.col(embedding).cast("array<double>")
    known = rows.select(F.col(id_col).cast("long").alias("vec_id"), cast.alias("embedding"))
    valid = known.where(_valid("embedding")).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    distinct = valid.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    found = None
    for row in distinct.groupBy(F.size("embedding").alias("dim")).count().collect():  # a row for each length
        part = links_of(distinct.where(F.size("embedding") == row["dim"]), row["dim"], threshold)
        found = part if found is None else found.union(part)
    if found is None:
        return known.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = written(found, "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found, "node", "root").withColumnRenamed("node", "__node")
    nodes = distinct.join(counts, "node", "left").join(roots, F.col("node") == F.col("__node"), "left")
    nodes = written(nodes.select("h1", "h2", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), "linked-vectors")
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = nodes.join(least, "root").select("h1", "h2", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    inside = valid.select("vec_id", "h1", "h2").join(linked, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    outside = known.where(~_valid("embedding")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.unionByName(outside).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
