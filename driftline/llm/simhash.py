"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints link at RADIUS = 3 or fewer differing bits. Every distinct
fingerprint emits variants of itself within half the radius, the variants are
shuffled, and those who meet at a variant are compared. Half of 3 is not whole:
flipping a bit turns the parity, so fingerprints at an odd distance differ in
parity, and only the even ones go two bits far, the odd ones one bit:

* distance 2: both flip one of the two bits and meet;
* distance 1: the odd one flips the bit and meets the even one itself;
* distance 3: two of the three bits lie in the same half of the word. The even one
  flips these, the odd one the third, and they meet.

So an even fingerprint emits 1 + 64 + 2 * C(32, 2) = 1057 variants, an odd one 65,
whatever the data. Those who come to a variant with at most one flip (its core)
are at most 2 bits apart, and everyone else there is at most 3 bits from each of
the core; linking all to the smallest of the core keeps every component and needs
no pairs within a group. Texts with equal fingerprints are joined to them at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.llm.components import components
from driftline.session import written

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Shingles of a text that are held at once.
CHUNK = 1 << 16
#: Distinct fingerprints whose variants one task makes.
FINGERPRINTS_PER_TASK = 20_000


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text: a bit is 1 if over half of the shingles' hashes set it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, ASCII white space
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    shingles = map(b" ".join, zip(*(words[i : i + n] for i in range(SHINGLE)), strict=True)) if len(words) >= SHINGLE else iter([b" ".join(words)])
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    ones, left = np.zeros(64, dtype=np.int64), n
    while left:
        part = np.fromiter(hashes, dtype="<u8", count=min(CHUNK, left))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        left -= len(part)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fp``, the fingerprint as a signed long, and ``content``, a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), batch.column(2)], names=["doc_id", "fp", "content"])

    return docs.select(F.col(id_col).cast("long"), text, F.xxhash64(text)).mapInArrow(run, "doc_id long, fp long, content long")


def _flips() -> list[tuple[int, int, int, int]]:
    """(parity, bits, i, j): which bits a fingerprint of the parity flips; the first ``bits`` of i and j count."""
    near = [(0, 0, 0), *((1, i, 0) for i in range(64))]
    far = [(2, i, j) for half in (range(32), range(32, 64)) for i, j in combinations(half, 2)]
    return [(0, *f) for f in near + far] + [(1, *f) for f in near]


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints of column ``fp``, enough of them to connect every component, and none between fingerprints over RADIUS bits apart.

    A variant is shuffled with 14 bits that say what was flipped, which gives the
    fingerprint back; random 64-bit numbers are what a shuffle compresses worst.
    """
    flips = fps.sparkSession.createDataFrame(_flips(), "parity int, bits int, i int, j int")
    flips = flips.select("parity", (F.col("bits") * 4096 + F.col("i") * 64 + F.col("j")).cast("short").alias("flip"))
    bits = F.shiftright("flip", 12)
    bit = lambda c: F.expr(f"shiftleft(1L, {c})")
    flipped = F.when(bits == 0, F.lit(0)).when(bits == 1, bit("(flip >> 6) & 63")).otherwise(bit("(flip >> 6) & 63").bitwiseXOR(bit("flip & 63")))
    parity = F.pmod(F.bit_count("fp"), F.lit(2))
    spread = fps.repartition(fps.count() // FINGERPRINTS_PER_TASK + 1, "fp").withColumn("parity", parity)
    met = spread.join(F.broadcast(flips), "parity")  # 1122 rows, always
    variants = met.select(F.col("fp").bitwiseXOR(flipped).alias("key"), "flip").repartition("key").withColumn("fp", F.col("key").bitwiseXOR(flipped))
    core = F.min(F.when(bits <= 1, F.col("fp"))).over(Window.partitionBy("key"))
    pairs = variants.withColumn("core", core).where(F.col("core") != F.col("fp")).select(F.col("fp").alias("a"), F.col("core").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id that is reachable over links, the
    document's own included; it is null if all ids of the component are null.
    Null, empty and blank texts have fingerprint zero and link like any other.
    Texts under three words are one shingle. Repeated rows fall into one
    component. An empty table gives an empty result; other columns aren't read.
    """
    known, rooted = _rooted(docs, id_col, text)
    least = rooted.groupBy("root").agg(F.min("least.doc_id").alias("component_id"))
    ids = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return known.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The fingerprint of every document, and for each distinct one the ``root`` of its component and ``least``, the smallest (doc_id, content) with an id that has it."""
    known = written(fingerprints(docs, id_col, text), "fingerprints")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "content")))
    distinct = written(known.groupBy("fp").agg(first.alias("least")), "distinct-fingerprints")
    found = components(links(distinct.select("fp")), "a", "b")
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return known, written(rooted, "rooted")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: that with the smallest id and, if several texts bear it, the smallest hash of the text.

    Of rows that are repeated with id and text one stays. Rows without an id all stay.
    """
    _, rooted = _rooted(docs, id_col, text)
    chosen = rooted.groupBy("root").agg(F.min("least").alias("first")).select(F.col("first.doc_id").alias("__kept"), F.col("first.content").alias("__content"))
    marked = docs.withColumn("__hash", F.xxhash64(text))
    first = marked.join(chosen, (F.col(id_col) == F.col("__kept")) & (F.col("__hash") == F.col("__content")), "left_semi").dropDuplicates([id_col, "__hash"])
    return first.drop("__hash").unionByName(docs.where(F.col(id_col).isNull()))
