"""Passages of benchmark items in documents, by an Aho-Corasick automaton.

Items and documents are normalised alike: A-Z are lowered and words are runs of
0-9, a-z and all code points beyond ASCII. Every WINDOW consecutive words of an item
are a pattern; an item of fewer words is one pattern. The automaton reads words, not
letters: each word of the items is a symbol, every other word one more symbol. It reads a
document once, and what it finds is mapped back to places in the original text.

The items of one automaton are broadcast, PART characters of them at most. A
benchmark of more is cut into parts, whose automata read the documents one after
another; long items are cut into pieces that overlap by a window less one word.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.columns import running_start
from driftline.llm.words import distinct_words, slices
from driftline.session import written

WINDOW = 10
#: Characters of normalised items in one automaton, which has at most WINDOW states for each of their words.
PART = 1 << 20
#: Windows that begin in one piece of an item.
PIECE = 1 << 12

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
#: Symbols are private and higher code points, so that a text of symbols is a Python string. The first is any unknown word.
_FIRST = 0xE000
_NORMAL = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or b >= 97 and b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)

HITS = "array<struct<first:bigint,last:bigint>>"
SPANS = "spans array<struct<start:bigint,end:bigint>>"


class Automaton:
    """The windows of some items: ``items`` has their ids, ``of`` the items of each window, one after another from ``begin`` on."""

    def __init__(self, pieces: list[tuple[str | None, list[str]]], window: int = WINDOW):
        self.vocabulary = pa.array(sorted({w for _, words in pieces for w in words}), pa.large_string())
        symbol = {w: chr(_FIRST + 1 + k) for k, w in enumerate(self.vocabulary.to_pylist())}
        names: dict[str, int] = {}
        owners: dict[str, set[int]] = {}
        for name, words in pieces:
            text = "".join(symbol[w] for w in words)
            item = None if name is None else names.setdefault(name, len(names))
            for at in range(max(1, len(text) - window + 1)):
                owners.setdefault(text[at : at + window], set()).update(() if item is None else (item,))
        self.items = pa.array(list(names), pa.string())
        self.begin = np.cumsum([0, *map(len, owners.values())])
        self.of = np.array([i for found in owners.values() for i in found], np.int64)
        self.length = np.array([len(w) for w in owners], np.int64)
        self.machine = ahocorasick.Automaton()
        for k, text in enumerate(owners):
            self.machine.add_word(text, k)
        if owners:
            self.machine.make_automaton()

    def find(self, number: np.ndarray, words: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, last word (counted over all texts) and window of each occurrence."""
        none = (np.zeros(0, np.int64),) * 3
        if not len(self.machine) or not len(number):
            return none
        known = pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy().astype("<u4") + 1  # -1 wraps to 0
        texts = len(bounds) - 1
        place = np.arange(len(number)) + np.repeat(np.arange(texts), np.diff(bounds))  # a gap after each text
        symbols = np.full(len(number) + texts, _FIRST, "<u4")
        symbols[place] = _FIRST + known[number]
        found = list(self.machine.iter(symbols.tobytes().decode("utf-32-le")))
        if not found:
            return none
        last, window = np.array(found, np.int64).T
        text = np.searchsorted(bounds + np.arange(texts + 1), last, side="right") - 1
        return text, last - text, window


#: The automaton that this worker built last, by the name of its part.
_BUILT: dict[str, Automaton] = {}


def _automaton(name: str, pieces: Broadcast, window: int) -> Automaton:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(pieces.value, window)
    return _BUILT[name]


def normalised(texts: pa.Array) -> pa.Array:
    """A-Z lowered and all between words turned into spaces, byte by byte: other code points keep their bytes."""
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = np.frombuffer(filled.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return pa.LargeStringArray.from_buffers(len(filled), pa.py_buffer(ends - ends[0]), pa.py_buffer(_NORMAL[data]))


def pieces_of(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """``item`` (its id as text) and ``words`` of pieces that hold each window of an item once; an item without words has none."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.btrim(F.regexp_replace(F.translate(text, upper, upper.lower()), _BETWEEN, " "))
    words = items.select(F.col(item_id).cast("string").alias("item"), F.when(plain != "", F.split(plain, " ")).alias("all")).where(F.col("all").isNotNull())
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)), F.lit(piece))
    return words.withColumn("at", F.explode(starts)).select("item", F.slice("all", F.col("at") + 1, F.lit(piece + window - 1)).alias("words"))


def _parts(items: DataFrame, item_id: str, text: str, window: int, part: int) -> Iterator[tuple[list[tuple[str | None, list[str]]], bool]]:
    """The pieces of one automaton after another, each of about ``part`` characters, and whether it is the last; an empty benchmark is one empty part."""
    pieces = written(pieces_of(items, item_id, text, window).withColumn("size", F.length(F.array_join("words", " ")) + 1), "benchmark-pieces")
    total = pieces.agg(F.sum("size")).first()[0] or 0
    if total > part:
        dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("item", "words"), F.lit(4096)))
        placed = running_start(dealt, [], "bucket", [F.col("item"), F.col("words")], "size", "start")
        pieces = written(placed.withColumn("part", F.expr(f"start div {part}")), "benchmark-parts")
    parts = max(1, -(-total // part))
    for k in range(parts):
        some = pieces.where(F.col("part") == k) if parts > 1 else pieces
        yield [(r.item, list(r.words)) for r in some.select("item", "words").toLocalIterator()], k == parts - 1


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, part: int = PART) -> DataFrame:
    """One row per document: the id, ``n_words``, ``n_hit``, ``items`` and ``spans``.

    A word is hit if it lies in an occurrence of a window. ``items`` are the ids, as
    sorted text, of the items with an occurring window, each once; ``spans`` are the
    stretches of hit words as code points of the original text (``start``, ``end``).

    A null or empty document has no words. An item without words has no window; one
    without an id counts for hits, but isn't named; items with equal ids are one. An
    empty benchmark hits nothing, an empty table of documents gives an empty result.
    Rows with null or repeated ids each get their own row. Other columns aren't read.
    """
    spark = docs.sparkSession
    key = f"key {docs.schema[id_col].dataType.simpleString()}"
    rows = docs.select(F.col(id_col).alias("key"), F.col(text).alias("text"), F.array().cast(HITS).alias("hits"), F.array().cast("array<string>").alias("items"))
    for pieces, last in _parts(benchmark, item_id, item_text, window, part):
        shape = f"{key}, n_words bigint, n_hit bigint, {SPANS}" if last else f"{key}, text string, hits {HITS}"
        read = rows.mapInArrow(_reader(uuid.uuid4().hex, spark.sparkContext.broadcast(pieces), window, last), f"{shape}, items array<string>, more array<string>")
        rows = read.withColumn("items", F.array_union("items", "more")).drop("more")
        if not last:
            rows = written(rows, "passages-so-far")
    return rows.select(F.col("key").alias(id_col), "n_words", "n_hit", F.array_sort("items").alias("items"), "spans")


def _lists(row: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """A list for each of ``n`` rows, of the values whose ``row`` (ascending) it is."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), values)


def _pairs(a: np.ndarray, b: np.ndarray, names: list[str]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=names)


def _reader(name: str, pieces: Broadcast, window: int, last: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads documents by the automaton of one part, beside what earlier parts have found."""

    def read(some: pa.RecordBatch, automaton: Automaton) -> pa.RecordBatch:
        key, texts, hits, items = some.columns
        words, number, bounds = distinct_words(normalised(texts), as_array=True, lower=False)
        n, rows = len(number), some.num_rows
        text, to, found = automaton.find(number, words, bounds)
        earlier = hits.flatten()
        owner = np.repeat(np.arange(rows), pc.list_value_length(hits).to_numpy())
        begin = np.concatenate((to - automaton.length[found] + 1, bounds[owner] + pc.struct_field(earlier, 0).to_numpy()))
        end = np.concatenate((to, bounds[owner] + pc.struct_field(earlier, 1).to_numpy())) + 1
        hit = np.cumsum(np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n] > 0
        edge = np.zeros(n + 1, np.bool_)
        edge[bounds] = True
        first = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate(([False], hit[:-1]))))
        final = np.flatnonzero(hit & (edge[1:] | ~np.concatenate((hit[1:], [False]))))
        of = np.searchsorted(bounds, first, side="right") - 1
        windows = np.unique(text * len(automaton.length) + found) if len(found) else found
        text, found = np.divmod(windows, max(1, len(automaton.length)))
        n_items = automaton.begin[found + 1] - automaton.begin[found]
        at = np.repeat(automaton.begin[found] - np.concatenate(([0], np.cumsum(n_items)[:-1])), n_items) + np.arange(n_items.sum()) if len(found) else found
        named = np.unique(np.repeat(text, n_items) * max(1, len(automaton.items)) + automaton.of[at])
        text, item = np.divmod(named, max(1, len(automaton.items)))
        more = _lists(text, rows, automaton.items.take(pa.array(item)))
        if not last:
            return pa.RecordBatch.from_arrays([key, texts, _lists(of, rows, _pairs(first - bounds[of], final - bounds[of], ["first", "last"])), items, more], names=["key", "text", "hits", "items", "more"])
        places = [np.zeros((0, 2), np.int64)]
        for row in np.unique(of):
            spans = np.array([m.span() for m in _WORD.finditer(texts[int(row)].as_py())], np.int64)
            here = of == row
            places.append(np.stack((spans[first[here] - bounds[row], 0], spans[final[here] - bounds[row], 1]), 1))
        start, stop = np.concatenate(places).T
        n_hit = np.diff(np.concatenate(([0], np.cumsum(hit)))[bounds])
        return pa.RecordBatch.from_arrays([key, pa.array(np.diff(bounds)), pa.array(n_hit), _lists(of, rows, _pairs(start, stop, ["start", "end"])), items, more], names=["key", "n_words", "n_hit", "spans", "items", "more"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            automaton = _automaton(name, pieces, window)
            for some in slices(batch, 8192, 1 << 23, column=1):
                yield read(some, automaton)

    return run


def digests(found: DataFrame) -> DataFrame:
    """``find_passages`` as figures and a hash of the items' ids, joined by commas."""
    return found.select(
        *[c for c in found.columns if c not in ("n_words", "n_hit", "items", "spans")],
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
