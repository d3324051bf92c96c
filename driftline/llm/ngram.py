"""Language-model scores by a weighted backoff automaton.

The model is a trigram model over all training text, smoothed by absolute
discounting and backed off by way of bigrams to the smoothed unigrams:

* a state is the last two tokens or the last one; its arcs are all n-grams that
  training text holds after it, with probability
  ``(c(h, w) - DISCOUNT) / c(h) + b(h) P(w after the shorter history)``;
* its failure arc has weight ``b(h) = DISCOUNT * arcs(h) / c(h)`` and leads from two
  tokens to the last of them, from one to the root, whose arcs are the unigrams,
  with ``(c(w) + 0.1) / (N + 0.1 (V + 1))``, an unknown token being one more with c = 0.

The probabilities of a state sum to 1. A text begins in the state of the end
token and is read once from left to right; histories don't cross its beginning.
Nothing is pruned.

The automaton grows with the corpus and is never brought together. Documents are
cut into blocks; every block says which n-grams it holds, the counts are summed
where these meet by hash, and each block gets back the part of the automaton that
its own texts can reach. This is done for trigrams, then bigrams, then tokens: one
of the blocks that hold an n-gram of training text is told to be its owner and
counts it among the arcs of its history when it asks for that. The blocks lie in a
table that is bucketed by block, so that they stay where they are while the answers
come to them.

Hashes meet in buckets, of which there is one for every two blocks, so that what
a bucket holds doesn't grow with the corpus. A block sends a bucket one message
with all that it asks there, and none if it asks nothing: there are never more
messages than entries, and entries grow with the text. Within a block n-grams are
known by 64-bit hashes, within a bucket by HASH_BITS of them beyond the bucket's own;
tokens, whose counts have to be exact, by all 64. A shuffle partition holds many buckets
where there would be over MOST_PARTITIONS, and meets them one after another.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import bucketed, written

DISCOUNT = 0.75
ADD = 0.1
#: Tokens of a block, but for one document that is longer.
BLOCK_TOKENS = 1_500_000
#: Text for a bucket of the table of blocks, which has as many buckets as there are shuffle partitions at least.
BUCKET_BYTES = 1 << 28
HASH_BITS = 46
#: Shuffle partitions at most; beyond MOST_PARTITIONS buckets each has several.
MOST_PARTITIONS = 20_000
#: The end token holds white space and so is no word.
END = b" "
FOLDS = 10


_HEAD = struct.Struct("<QB")
_TYPES = {np.dtype(t).num: np.dtype(t) for t in ("i4", "u4", "i8", "u8", "?")}


def held_out(id_col: str, folds: int = FOLDS):
    """Whether the CRC-32 of the id, written as text, is a multiple of ``folds``. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstandard frame: their number, the length and type of each, and the entries: all first bytes, all second ones and so on, which compress."""
    head = bytes([len(arrays)]) + b"".join(_HEAD.pack(len(a), a.dtype.num) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).view("u1").reshape(len(a), a.itemsize).T.tobytes() for a in arrays))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, out = zstandard.ZstdDecompressor().decompress(data), []
    at = 1 + raw[0] * _HEAD.size
    for size, kind in _HEAD.iter_unpack(raw[1:at]):
        width = _TYPES[kind].itemsize
        planes = np.frombuffer(raw, "u1", size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).ravel().view(_TYPES[kind]))
        at += size * width
    return out


def _pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ordered pairs of hashes."""
    x = (u * np.uint64(0x9E3779B97F4A7C15)) ^ (w + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Block:
    """Documents as token numbers, and the hash of each number. While it grows the end token is number 0; packed, the numbers ascend by hash."""

    def __init__(self):
        self.numbers = {END: 0}
        self.ids, self.known_id, self.train, self.lengths, self.tokens = [], [], [], [], []
        self.size = 0

    def add(self, doc_id: int | None, train: bool, text: str | None) -> None:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, ASCII white space
        numbers = self.numbers
        fresh = [w for w in dict.fromkeys(words) if w not in numbers]
        numbers.update(zip(fresh, range(len(numbers), len(numbers) + len(fresh)), strict=True))
        self.tokens.append(np.fromiter(map(numbers.__getitem__, words), dtype="<i4", count=len(words)))
        self.tokens.append(np.zeros(1, dtype="<i4"))
        self.ids.append(doc_id or 0)
        self.known_id.append(doc_id is not None)
        self.train.append(train)
        self.lengths.append(len(words) + 1)
        self.size += len(words) + 1

    def packed(self) -> tuple[bytes, bytes]:
        """The documents, and the hashes of the tokens."""
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.numbers), dtype="<u8", count=len(self.numbers))
        order = np.argsort(hashes, kind="stable")
        number = np.empty(len(order), "<i4")
        number[order] = np.arange(len(order), dtype="<i4")
        return pack(np.array(self.ids, "<i8"), np.array(self.known_id, "?"), np.array(self.train, "?"), np.array(self.lengths, "<i8"), number[np.concatenate(self.tokens)]), pack(hashes[order])


class Grams(NamedTuple):
    """The distinct n-grams of a block for one n."""

    #: Their hashes, ascending.
    hashes: np.ndarray
    #: For each position of the block's text the number of the n-gram that ends there, and -1 where the text has too few tokens before it.
    at: np.ndarray
    #: The number of the (n-1)-gram that each begins with, and of the one that it ends with.
    history: np.ndarray | None = None
    suffix: np.ndarray | None = None


def _distinct(hashes: np.ndarray, places: np.ndarray | slice, history: np.ndarray, shorter: np.ndarray) -> Grams:
    distinct, inverse = np.unique(hashes, return_inverse=True)
    at = np.full(len(shorter), -1, np.int32)
    at[places] = inverse
    begins, ends = np.empty(len(distinct), np.int32), np.empty(len(distinct), np.int32)
    begins[inverse], ends[inverse] = history, shorter[places]
    return Grams(distinct, at, begins, ends)


def grams(tokens: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, most: int = 3) -> list[Grams]:
    """Tokens, bigrams and, if ``most`` is 3, trigrams. The history of a text's first bigram is the end token, which is the last one of any block."""
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    before = np.roll(tokens, 1)
    before[firsts] = tokens[-1]
    own = hashes[tokens]
    pairs = _pair_hash(hashes[before], own)
    found = [Grams(hashes, tokens), _distinct(pairs, slice(None), before, tokens)]
    if most == 3:
        inside = np.ones(len(tokens), bool)
        inside[firsts] = False
        places = np.flatnonzero(inside)
        found.append(_distinct(_pair_hash(pairs[places - 1], own[places]), places, found[1].at[places - 1], found[1].at))
    return found


def blocks(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """The documents as blocks: ``block``, ``data``, ``hashes``; a table bucketed by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, block = TaskContext.get().partitionId(), 0, Block()

        def flush() -> pa.RecordBatch:
            data, hashes = block.packed()
            return pa.RecordBatch.from_pydict({"block": [(part << 32) + serial], "data": [data], "hashes": [hashes]})

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    block.add(*row)
                    if block.size >= BLOCK_TOKENS:
                        yield flush()
                        serial, block = serial + 1, Block()
        if block.size:
            yield flush()

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), (~held_out(id_col)).alias("train"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // BUCKET_BYTES, 100_000))
    return bucketed(chosen.mapInArrow(run, "block long, data binary, hashes binary"), "blocks", "block", buckets)


def _cuts(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n buckets begins in ascending hashes."""
    return np.searchsorted(((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))


def _steps(hashes: np.ndarray, n: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes, of n-grams beyond tokens without the last bits: the first one, and the differences of the others."""
    short = hashes >> np.uint64(0 if order == 1 else max(0, 64 - HASH_BITS - (n.bit_length() - 1)))
    steps = np.diff(short)
    return short[:1], steps.astype("<u4") if not len(steps) or steps.max() < 1 << 32 else steps


ASKED = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])
ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _blocks_of(own: pa.Table) -> Iterator[list[np.ndarray]]:
    for data, hashes in zip(own.column("data").to_pylist(), own.column("hashes").to_pylist(), strict=True):
        yield [*unpack(data), *unpack(hashes)]


def _heard(heard: pa.Table, which: Grams, n: int) -> list[np.ndarray]:
    """Of each n-gram the count in training text, the number of arcs of its state, and whether the block owns it."""
    got = [np.zeros(len(which.hashes), t) for t in ("<i8", "<i8", "?")]
    cuts = _cuts(which.hashes, n)
    for b, blob in zip(heard.column("bucket").to_pylist(), heard.column("data").to_pylist(), strict=True):
        for to, part in zip(got, unpack(blob), strict=True):
            to[cuts[b] : cuts[b + 1]] = part
    return got


def _ask(order: int, n: int):
    """The distinct n-grams of each block by bucket: hashes, counts in training text, and arcs of their states, of which a block counts those that it owns."""

    def answered(key: tuple[pa.Scalar, ...], own: pa.Table, heard: pa.Table | None) -> pa.Table:
        rows = []
        for _, _, train, lengths, tokens, hashes in _blocks_of(own):
            found = grams(tokens, lengths, hashes, min(order + 1, 3))
            mine = found[order - 1]
            learned = mine.at[np.repeat(train, lengths)]
            counts = np.bincount(learned[learned >= 0], minlength=len(mine.hashes)).astype("<i8")
            arcs = np.zeros(len(mine.hashes), "<i8")
            if heard is not None:
                owned = _heard(heard, found[order], n)[2]
                arcs += np.bincount(found[order].history[owned], minlength=len(arcs))
            cuts = _cuts(mine.hashes, n)
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                here = slice(cuts[b], cuts[b + 1])
                rows.append((b, key[0].as_py(), pack(*_steps(mine.hashes[here], n, order), counts[here], arcs[here])))
        return _rows(ASKED, rows)

    def alone(key: tuple[pa.Scalar, ...], own: pa.Table) -> pa.Table:
        return answered(key, own, None)

    return alone if order == 3 else answered


def _meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Sum up the n-grams of one bucket; each block hears the sums in the order in which it asked, and what it owns. Block -1: how many n-grams training text has here, and how many different ones."""
    asked = [(b, *unpack(d)) for b, d in zip(table.column("block").to_pylist(), table.column("data").to_pylist(), strict=True)]
    hashes = np.concatenate([np.cumsum(np.concatenate((first, steps)), dtype=np.uint64) for _, first, steps, _, _ in asked])
    order = np.argsort(hashes)
    ascending = hashes[order]
    fresh = np.concatenate(([True], ascending[1:] != ascending[:-1]))
    firsts, place = np.flatnonzero(fresh), np.empty(len(order), np.int64)
    place[order] = np.cumsum(fresh) - 1
    counts, arcs = (np.add.reduceat(np.concatenate([a[i] for a in asked])[order], firsts) for i in (3, 4))
    owned = np.zeros(len(order), bool)
    owned[order[firsts]] = counts > 0
    bucket, at = key[0].as_py(), 0
    rows = [(-1, bucket, pack(np.array([counts.sum(), (counts > 0).sum()], "<i8")))]
    for block, _, _, c, _ in asked:
        mine = place[at : at + len(c)]
        rows.append((block, bucket, pack(counts[mine], arcs[mine], owned[at : at + len(c)])))
        at += len(c)
    return _rows(ANSWER, rows)


def traverse(tokens: list[int], bigrams: list[int], far: list[float], near: list[float], fail_far: list[float], fail_near: list[float], root: list[float]) -> float:
    """log10 probability of a text, read from left to right: along the state's arc for the token, or by failure arcs along that of a shorter state or the root.

    ``far`` and ``near`` hold for each position the weight of the arc that the
    states of two tokens and of one before it have for the token, 1 where there is
    none. The state after a token is its bigram; -1 is that of the end token alone.
    """
    state, last, total = -1, -1, 0.0
    for token, bigram, two, one in zip(tokens, bigrams, far, near, strict=True):
        if two <= 0.0:
            total += two
        else:
            if state >= 0:
                total += fail_far[state]
            total += one if one <= 0.0 else fail_near[last] + root[token]
        state, last = bigram, token
    return total


def _log(p: np.ndarray) -> np.ndarray:
    return np.log10(np.clip(p, 1e-300, 1.0))


def _score_block(n: int, all_tokens: int, distinct_tokens: int):
    denominator = all_tokens + ADD * (distinct_tokens + 1)

    def run(key: tuple[pa.Scalar, ...], own: pa.Table, heard: pa.Table) -> pa.Table:
        out = []
        answers = [heard.filter(pc.equal(heard.column("n"), k)) for k in (1, 2, 3)]
        for ids, known_id, train, lengths, tokens, hashes in _blocks_of(own):
            found = grams(tokens, lengths, hashes)
            count, arcs, _ = zip(*(_heard(a, g, n) for a, g in zip(answers, found, strict=True)), strict=True)
            p, fails, weights = [(count[0] + ADD) / denominator], [], []
            for k in (1, 2):
                c, lower, history = count[k], np.maximum(count[k - 1], 1), found[k].history
                backoff = np.where(count[k - 1] > 0, DISCOUNT * arcs[k - 1] / lower, 1.0)
                p.append(np.where(c > 0, c - DISCOUNT, 0.0) / lower[history] + backoff[history] * p[k - 1][found[k].suffix])
                fails.append(_log(backoff).tolist())
                weights.append(np.append(np.where(c > 0, _log(p[k]), 1.0), 1.0)[found[k].at])  # the last is for -1
            root = _log(p[0])
            listed, firsts = root.tolist(), np.concatenate(([0], np.cumsum(lengths)))
            fails[0].append(fails[0][tokens[-1]])  # of state -1, the end token alone
            score = [
                traverse(tokens[a:z].tolist(), found[1].at[a:z].tolist(), weights[1][a:z].tolist(), weights[0][a:z].tolist(), fails[1], fails[0], listed)
                for a, z in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)
            ]
            base, known = np.add.reduceat(root[tokens], firsts[:-1]), np.add.reduceat((count[0] > 0)[tokens].astype(np.int64), firsts[:-1])
            out.append(pa.table([pa.array(ids, mask=~known_id), pa.array(~train), pa.array(lengths), pa.array(known), pa.array(np.full(len(ids), all_tokens)), pa.array(base), pa.array(score, pa.float64())], schema=_SCORES))
        return pa.concat_tables(out) if out else _SCORES.empty_table()

    return run


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [unpack(d)[0] for d in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_pydict({"n": [int(x[0]) for x in got], "v": [int(x[1]) for x in got]})


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from the documents that aren't held out and score all.

    Returns ``doc_id``, ``held_out``, ``n_tokens`` (end included), ``n_known``,
    ``train_tokens``, ``base_score`` (unigrams) and ``score`` (the automaton), both
    log10. A null or empty text is the end token alone. Documents with null or
    equal ids are scored one by one; a null id is held out by the CRC-32 of no
    bytes. An empty table gives an empty result; other columns aren't read.
    """
    own = blocks(docs, id_col, text)
    n = own.count() // 2 + 1  # so a bucket gets what two blocks hold, whatever the size
    asked, answer = "bucket long, block long, data binary", "block long, bucket long, data binary"
    answers = {}
    for order in (3, 2, 1):
        mine = own.groupBy("block")
        if order < 3:
            asks = mine.cogroup(answers[order + 1].where("block >= 0").groupBy("block")).applyInArrow(_ask(order, n), asked)
        else:
            asks = mine.applyInArrow(_ask(order, n), asked)
        met = asks.repartition(min(n, MOST_PARTITIONS), "bucket").groupBy("bucket").applyInArrow(_meet, answer)
        answers[order] = written(met, f"{order}-grams")
    sizes = answers[1].where("block = -1").select("data").mapInArrow(_sizes, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    if sizes[0] is None:
        return docs.sparkSession.createDataFrame([], _RESULT)
    parts = [answers[k].where("block >= 0").withColumn("n", F.lit(k)) for k in (1, 2, 3)]
    return own.groupBy("block").cogroup(parts[0].union(parts[1]).union(parts[2]).groupBy("block")).applyInArrow(_score_block(n, *sizes), _RESULT)
