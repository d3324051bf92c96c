"""Token ids of whole texts, by a public tokenizer file."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.words import distinct_words, slices

#: Words whose ids a worker remembers, and those of one more slice of texts.
REMEMBERED = 400_000
#: Words that are encoded at once, with SEPARATOR between them.
TOGETHER = 1_000
SEPARATOR = "▁"
#: Texts that are encoded at once, and bytes of text, about.
TEXTS, BYTES = 1 << 14, 1 << 22
#: Lower-case letters of ASCII and Latin-1, which no normal form or lower-casing changes.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
#: ASCII punctuation without the apostrophe.
POINTS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")


class WordEncoder:
    """Ids of texts for tokenizers that drop white space and lower-case, so that each word can be encoded alone.

    Of a slice of texts Arrow's kernels find the distinct words, with A-Z lowered;
    only these pass through Python, and the ids of all words are gathered from
    theirs by arrays. A word of letters with
    punctuation behind it has the ids of the letters and those of the punctuation,
    if the tokenizer parts the two. Words of letters that its normalizer leaves as
    they are go past the normalizer and are cut where a token ends a word. A text
    that holds ``<|``, and so perhaps a special token, is encoded whole by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._forget()
        probe = lambda *texts: [e.ids for e in self.tokenizer.encode_batch(list(texts), add_special_tokens=False)]
        both, ab, a = probe("Ab a", "ab", "a")
        self.by_word = both == ab + a
        self.mark = np.array(probe(SEPARATOR)[0], dtype="<u4")
        self.parts = self.by_word and all(x == y + z for x, y, z in (probe(f"ab{t}", "ab", t) for t in (",", ".", "...", ");", "%%%", "-", '".', "$&#*")))
        self.bare = self._without_normalizer(path)

    def _without_normalizer(self, path: str):
        """The tokenizer without a normalizer, and which tokens end a word; None if its parts aren't known to leave lower-case letters as they are."""
        with open(path, encoding="utf-8") as source:
            made = json.load(source)
        kinds = [x["type"] for x in ((made.get("normalizer") or {}).get("normalizers") or [{"type": None}])]
        suffix = made["model"].get("end_of_word_suffix")
        if not self.parts or not suffix or not {"NFC", "Lowercase", "Replace"} >= set(kinds):
            return None
        bare = type(self.tokenizer).from_file(path)
        bare.no_truncation()
        bare.no_padding()
        bare.normalizer = None
        ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
        ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        plain = "abz naïve éß"
        return (bare, ends) if bare.encode(plain, add_special_tokens=False).ids == self.tokenizer.encode(plain, add_special_tokens=False).ids else None

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.ids, self.lengths = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts end to end, and how many each has."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), "<u4"), np.fromiter(map(len, got), np.int64, len(got))

    def _letters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_whole`` for words of LETTERS."""
        if self.bare is None:
            return self._words(texts)
        bare, ends = self.bare
        ids = np.array(bare.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(ends[ids]) + 1
        if len(cuts) != len(texts) or cuts[-1] != len(ids):
            return self._words(texts)
        return ids, np.diff(cuts, prepend=0)

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_whole`` for any words. They are encoded together and cut where the separator's ids stand, which no word without the separator has."""
        joined = f" {SEPARATOR} ".join(texts)
        if len(self.mark) < 2 or joined.count(SEPARATOR) != len(texts) - 1:
            return self._whole(texts)
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        n = len(self.mark)
        hit = np.ones(max(0, len(ids) - n + 1), dtype=bool)
        for k in range(n):
            hit &= ids[k : len(hit) + k] == self.mark[k]
        cuts = np.flatnonzero(hit)
        if len(cuts) != len(texts) - 1:
            return self._whole(texts)
        marks = np.zeros(len(ids), dtype=bool)
        for k in range(n):
            marks[cuts + k] = True
        return ids[~marks], np.append(cuts, len(ids)) - np.concatenate(([0], cuts + n))

    def _rows(self, words: pa.Array, encode) -> np.ndarray:
        """The rows of distinct words in the table of ids; ``encode`` gives the ids of those that it lacks."""
        names = words.to_pylist()
        missing = [w for w in names if w not in self.rows]
        n = len(self.rows)
        self.rows.update(zip(missing, range(n, n + len(missing)), strict=True))
        parts = [encode(missing[at : at + TOGETHER]) for at in range(0, len(missing), TOGETHER)]
        self.ids = np.concatenate([self.ids, *(p[0] for p in parts)])
        self.lengths = np.concatenate([self.lengths, *(p[1] for p in parts)])
        return np.fromiter(map(self.rows.__getitem__, names), np.int64, len(names))

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words end to end, and how many each has."""
        stems = pc.utf8_rtrim(words, characters=POINTS)
        plain = pc.and_(pc.equal(pc.utf8_trim(stems, characters=LETTERS), ""), pc.not_equal(stems, ""))
        if not self.parts:
            plain = pa.array(np.zeros(len(words), bool))
        rows = np.full((len(words), 2), -1)
        for column, some, texts, encode in (
            (0, plain, stems, self._letters),
            (0, pc.invert(plain), words, self._words),
            (1, pc.and_(plain, pc.not_equal(stems, words)), pc.utf8_ltrim(words, characters=LETTERS), self._whole),
        ):
            encoded = texts.filter(some).dictionary_encode()
            rows[some.to_numpy(zero_copy_only=False), column] = self._rows(encoded.dictionary, encode)[encoded.indices.to_numpy()]
        firsts = np.concatenate(([0], np.cumsum(self.lengths)))
        flat = rows.ravel()
        lengths = np.append(self.lengths, 0)[flat]  # row -1: no punctuation
        return self.ids[_runs(firsts[flat], lengths)], lengths.reshape(-1, 2).sum(axis=1)

    def encode_array(self, texts: pa.Array, end: tuple[int, ...] = ()) -> pa.Array:
        """The ids of each text, and ``end``, as little-endian unsigned 32-bit integers; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False) if self.by_word else np.ones(len(texts), bool)
        words, number, bounds = distinct_words(pc.if_else(pa.array(whole), "", texts), as_array=True)
        ids, lengths = self._table(words)
        firsts = np.concatenate(([0], np.cumsum(lengths)))
        ids = np.append(ids, np.array(end, "<u4"))  # the end ids are one more word, behind each text's last
        firsts, lengths, end_row = np.append(firsts, firsts[-1])[: len(lengths) + 1], np.append(lengths, len(end)), len(lengths)
        number = np.insert(number.astype(np.int64), bounds[1:], end_row)
        each = lengths[number]
        made = ids[_runs(firsts[number], each)]
        offsets = 4 * np.concatenate(([0], np.cumsum(each)))[bounds + np.arange(len(bounds))]
        if len(self.rows) > REMEMBERED:
            self._forget()
        out = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(made)])
        if not whole.any():
            return out.cast(pa.binary())
        parts, tail = out.to_pylist(), np.array(end, "<u4").tobytes()
        for k in np.flatnonzero(whole).tolist():
            parts[k] = self._whole([texts[k].as_py()])[0].tobytes() + tail
        return pa.array(parts, pa.binary())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.string())).to_pylist()


def _runs(firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``first``, ``first + 1`` and so on for each first, ``length`` numbers each."""
    ends = np.cumsum(lengths)
    return np.repeat(firsts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for a worker process; it outlives tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path)


def encoded_parts(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of (doc_id, text, ...) batches, each with the ids of its texts, the end id included."""
    for batch in batches:
        for part in slices(batch, TEXTS, BYTES, column=1):
            yield part, encoder(path).encode_array(part.column(1), (end_id,))


def map_tokens(docs: DataFrame, id_col: str, text: str, path: str, end_id: int, make: Callable[[], Callable[[pa.RecordBatch, pa.Array], list[pa.Array]]], schema: str, names: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id`` and what ``make`` builds from the rows (id, text, ``carry``) and ids (with the end id) of a batch of documents.

    ``make`` is called once per task, so that it can keep a running total: it
    returns the function for the batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        build = make()
        for part, ids in encoded_parts(batches, path, end_id):
            yield pa.RecordBatch.from_arrays([part.column(0), *build(part, ids)], names=["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text), *carry).mapInArrow(run, f"doc_id long, {schema}")


def token_counts(ids: pa.Array) -> np.ndarray:
    return pc.binary_length(ids).to_numpy().astype(np.int64) // 4
