"""Packing: concatenate and cut.

All documents, end to end, make one row of tokens. The first pass encodes them
and writes the ids with each document's place in its partition; the totals of the
partitions, summed up in order, give each partition its global offset. The second
pass cuts the row into fixed windows; a document that crosses a boundary leaves a
record on either side. Only the last window can be short.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.llm.tokens import map_tokens, token_counts
from driftline.session import written

WINDOW = 4096
END_ID = 2
#: Partitions whose offsets are broadcast at most (16 bytes each); more are joined by shuffling.
BROADCAST_PARTS = 1_000_000


def _placed() -> Callable[[pa.RecordBatch, pa.Array], list[pa.Array]]:
    """Ids with the number of tokens, the partition, and the tokens before the document in its partition."""
    part, before = TaskContext.get().partitionId(), 0

    def build(rows: pa.RecordBatch, ids: pa.Array) -> list[pa.Array]:
        nonlocal before
        tokens = token_counts(ids)
        starts = before + np.cumsum(tokens) - tokens
        before += int(tokens.sum())
        return [ids, pa.array(tokens), pa.array(np.full(len(tokens), part, np.int64)), pa.array(starts)]

    return build


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The first pass, written: ``doc_id``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``part``, ``before``."""
    made = map_tokens(docs, id_col, text, tokenizer, end_id, _placed, "ids binary, doc_tokens long, part long, before long", ["ids", "doc_tokens", "part", "before"])
    return written(made, "encoded")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document, with its ids.

    Returns ``doc_id``, ``start`` (the document's ids before the piece),
    ``length``, ``ids``, ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and
    ``offset`` (the piece's place in its sequence). Each id lies in one piece and
    the offsets of a sequence have no gap.

    A null or empty text is the end id alone. Documents with null or equal ids are
    packed like any others. An empty table gives an empty result; columns other
    than the id and the text aren't read.
    """
    rows = encoded(docs, tokenizer, end_id, id_col, text)
    totals = written(rows.groupBy("part").agg(F.sum("doc_tokens").alias("tokens")), "totals")
    base = totals.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    if totals.count() <= BROADCAST_PARTS:
        base = F.broadcast(base)
    placed = rows.join(base, "part").withColumn("at", F.col("base") + F.col("before"))
    cut = placed.withColumn("sequence_id", F.explode(F.sequence(F.expr(f"at div {window}"), F.expr(f"(at + doc_tokens - 1) div {window}"))))
    first = F.greatest(F.col("at"), F.col("sequence_id") * window)
    last = F.least(F.col("at") + F.col("doc_tokens"), (F.col("sequence_id") + 1) * window)
    pieces = cut.withColumns({"start": first - F.col("at"), "length": last - first, "offset": first - F.col("sequence_id") * window})
    pieces = pieces.withColumn("ids", F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")))
    return pieces.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """``sequence_id``, ``length`` and ``ids`` of each sequence. A short one is padded to ``window``, except at a power of two."""
    joined = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("hex")))).alias("parts"),  # at most ``window`` pieces
    )
    pad = F.hex(F.lit(pad_id.to_bytes(4, "little")))
    whole = (F.bit_count("length") == 1) | (F.col("length") >= window)
    text = F.array_join(F.transform("parts", lambda p: p["hex"]), "")
    return joined.select("sequence_id", "length", F.unhex(F.when(whole, text).otherwise(F.concat(text, F.repeat(pad, (F.lit(window) - F.col("length")).cast("int"))))).alias("ids"))
