"""Token ids in binary files that can be read document by document.

A file is a series of independent zstandard frames, so that any zstandard tool
reads it. The frames hold little-endian unsigned 32-bit ids, a document's ids in
one frame if they fit. Two skippable frames follow:

* the index: for each document its id, its first token in the file and its number
  of tokens (``doc_id`` null as the flag 0), compressed;
* the seek table of the public seekable format: for each frame its compressed and
  decompressed size and the low 32 bits of the XXH64 of its content, then the
  number of frames, a flag byte and the magic number 0x8F92EAB1.

A reader opens the tail, finds the frames of the documents that it wants, and
decompresses and verifies these only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.llm.tokens import map_tokens
from driftline.session import scratch_path, written

END_ID = 1
#: Bytes of ids in a frame; a longer document goes on in further frames.
FRAME = 1 << 18
#: Bytes of text whose ids make a file, about.
FILE_BYTES = 1 << 25
#: Files at most: beyond MOST_FILES * FILE_BYTES of text they grow instead.
MOST_FILES = 1 << 16
#: Keys for each file from which the files' ends are read off, and keys in all at most, about.
SAMPLED, SAMPLED_IN_ALL = 200, 1 << 20
#: Documents whose places a writer holds as Python objects.
HELD = 1 << 14
INDEX_MAGIC, TABLE_MAGIC, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FOOTER, ENTRY = struct.Struct("<IBI"), np.dtype([("packed", "<u4"), ("size", "<u4"), ("sum", "<u4")])
INDEX = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("start", "<u8"), ("n_tokens", "<u8")])


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class TokenFileWriter:
    def __init__(self, out):
        self.out, self.frames, self.index, self.recent, self.tokens, self.held = out, [], [], [], 0, bytearray()
        self.packer = zstandard.ZstdCompressor(level=3)

    def _frame(self, content: bytes) -> None:
        packed = self.packer.compress(content)
        self.frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.out.write(packed)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit."""
        if self.held and len(self.held) + len(ids) > FRAME:
            self._flush()
        self.recent.append((doc_id is not None, doc_id or 0, self.tokens, len(ids) // 4))
        if len(self.recent) >= HELD:
            self._settle()
        self.tokens += len(ids) // 4
        self.held += ids
        while len(self.held) >= FRAME:
            self._frame(bytes(self.held[:FRAME]))
            del self.held[:FRAME]

    def _flush(self) -> None:
        if self.held:
            self._frame(bytes(self.held))
            self.held.clear()

    def _settle(self) -> None:
        self.index.append(np.array(self.recent, dtype=INDEX))
        self.recent = []

    def close(self) -> None:
        self._flush()
        self._settle()
        index = self.packer.compress(np.concatenate(self.index).tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index) + 4) + index + struct.pack("<I", len(index)))
        table = np.array(self.frames, dtype=ENTRY).tobytes()
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table) + FOOTER.size) + table + FOOTER.pack(len(self.frames), 0x80, SEEKABLE))


class TokenFileReader:
    """Random access to a file; ``source`` can seek."""

    def __init__(self, source):
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        end = source.seek(0, 2)
        n, flags, magic = FOOTER.unpack(self._at(end - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table")
        table_at = end - FOOTER.size - n * ENTRY.itemsize
        self.frames = np.frombuffer(self._at(table_at, n * ENTRY.itemsize), dtype=ENTRY)
        self.offsets = np.concatenate(([0], np.cumsum(self.frames["packed"], dtype=np.int64)))
        self.firsts = np.concatenate(([0], np.cumsum(self.frames["size"], dtype=np.int64)))
        (size,) = struct.unpack("<I", self._at(table_at - 12, 4))
        self.index = np.frombuffer(self.unpack.decompress(self._at(table_at - 12 - size, size)), dtype=INDEX)
        self.cached: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def _frame(self, k: int) -> bytes:
        if self.cached[0] != k:
            content = self.unpack.decompress(self._at(int(self.offsets[k]), int(self.frames["packed"][k])), max_output_size=int(self.frames["size"][k]))
            if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.frames["sum"][k]:
                raise ValueError(f"frame {k} is damaged")
            self.cached = (k, content)
        return self.cached[1]

    def ids(self, row: int) -> bytes:
        """The ids of the ``row``-th document of the file."""
        low = int(self.index["start"][row]) * 4
        high = low + int(self.index["n_tokens"][row]) * 4
        k, parts = int(np.searchsorted(self.firsts, low, side="right")) - 1, []
        while low < high:
            first = int(self.firsts[k])
            part = self._frame(k)[low - first : high - first]
            parts.append(part)
            low, k = low + len(part), k + 1
        return b"".join(parts)


@dataclass
class TokenFiles:
    """A written set of files. ``manifest``: ``part``, ``path``, ``tokens`` and ``base``, the tokens in earlier files."""

    folder: str
    manifest: DataFrame


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text", parts: int | None = None) -> TokenFiles:
    """Encode ``docs`` and write the ids in ascending order of the id, null first.

    Texts are encoded where they lie; only ids are dealt out by range. Documents
    with equal ids come in the order of their texts' hashes. A null text is empty;
    an empty table makes no file. There are about FILE_BYTES of text to a file, more
    where that would make over MOST_FILES files,
    unless ``parts`` says how many files there are. Where files end is read off a
    sample of keys; a key is the id, the text's hash and the row's place. A file bears the name of the
    task attempt that wrote it, and the manifest lists those of the attempts that
    ended well, so that a task that is run again does no harm.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    keys = [F.col(id_col).cast("long"), F.xxhash64(text), F.monotonically_increasing_id()]
    keyed = docs.select(F.col(text), *[k.alias(f"__k{i}") for i, k in enumerate(keys)])
    bounds = _bounds(keyed, text, parts)
    sent = spark.sparkContext.broadcast(bounds)  # 32 bytes for each of MOST_FILES files at most

    def dealt() -> Callable[[pa.RecordBatch, pa.Array], list[pa.Array]]:
        return lambda rows, ids: [rows.column(2), rows.column(3), pa.array(_range_of(sent.value, rows)), ids]

    made = map_tokens(keyed, "__k0", text, tokenizer, end_id, dealt, "k1 long, k2 long, range int, ids binary", ["k1", "k2", "range", "ids"], carry=("__k1", "__k2"))
    placed = made.repartitionById(len(bounds[0]) + 1, "range").sortWithinPartitions(F.asc_nulls_first("doc_id"), "k1", "k2")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, writer = TaskContext.get(), None
        name = f"{folder}/part-{task.partitionId():08d}-{task.taskAttemptId()}.tokens"
        where, path = _opened(name)
        for batch in batches:
            if writer is None and batch.num_rows:
                where.create_dir(path.rpartition("/")[0], recursive=True)
                writer = TokenFileWriter(where.open_output_stream(path))
            for at in range(0, batch.num_rows, 256):
                for doc_id, tokens in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    writer.add(doc_id, tokens)
        if writer is not None:
            writer.close()
            writer.out.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [name], "docs": [sum(map(len, writer.index))], "tokens": [writer.tokens]})

    manifest = written(placed.select("doc_id", "ids").mapInArrow(run, "part long, path string, docs long, tokens long"), "manifest")
    base = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return TokenFiles(folder, manifest.withColumn("base", base))


def _bounds(keyed: DataFrame, text: str, parts: int | None) -> list[np.ndarray]:
    """Where one file ends and the next begins: of about SAMPLED keys a file (SAMPLED_IN_ALL in all), drawn from all rows, every so many-th."""
    n, size = keyed.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    parts = min(MOST_FILES, parts or (size or 0) // FILE_BYTES + 1)
    if parts == 1:
        return [np.zeros(0, np.int64)] * 4
    share = min(1.0, min(SAMPLED * parts, SAMPLED_IN_ALL) / max(n, 1))
    drawn = keyed.where(F.pmod(F.xxhash64("__k0", "__k1", "__k2"), F.lit(1 << 20)) < F.lit(round(share * (1 << 20)))) if share < 1 else keyed
    table = drawn.select(F.col("__k0").isNotNull().cast("long"), F.coalesce("__k0", F.lit(0)), "__k1", "__k2").toArrow()
    keys = [c.to_numpy() for c in table.columns]
    order = np.lexsort(keys[::-1])
    at = order[np.unique(np.arange(1, parts) * len(order) // parts)] if len(order) else order
    return [k[at] for k in keys]


def _range_of(bounds: list[np.ndarray], rows: pa.RecordBatch) -> np.ndarray:
    """How many bounds a row's key reaches."""
    known = rows.column(0).is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
    keys = [known, *(pc.fill_null(rows.column(i), 0).to_numpy() for i in (0, 2, 3))]
    n = len(bounds[0])
    order = np.lexsort([np.concatenate((b, k)) for b, k in zip(bounds, keys, strict=True)][::-1])  # stable: a bound comes before a row like it
    out = np.zeros(len(known), np.int32)
    here = order >= n
    out[order[here] - n] = np.cumsum(~here)[here]
    return out


def read_tokens(files: TokenFiles, with_ids: bool = False, wanted: list[int] | None = None) -> DataFrame:
    """Read the files back: ``doc_id``, ``start`` (tokens of all documents before it), ``n_tokens``, ``ids_crc32`` and perhaps ``ids``.

    With ``wanted`` only the frames that hold these documents are decompressed.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                where, name = _opened(path)
                with where.open_input_file(name) as source:
                    reader = TokenFileReader(source)
                    rows = np.arange(len(reader.index)) if wanted is None else np.flatnonzero(np.isin(reader.index["doc_id"], wanted) & (reader.index["known"] == 1))
                    for at in range(0, len(rows), 512):
                        some = rows[at : at + 512]
                        ids = [reader.ids(int(r)) for r in some]
                        index = reader.index[some]
                        columns = [pa.array(index["doc_id"], mask=index["known"] == 0), pa.array(index["start"].astype(np.int64) + base), pa.array(index["n_tokens"].astype(np.int64)), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    manifest = files.manifest.select("path", "base")
    return manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(run, schema)
