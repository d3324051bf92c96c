"""Language identification by segmentation-marginalised unigrams.

The pieces come from a fixed public vocabulary; each language has a probability
for every piece. The probability of a word is the sum over all its segmentations
into pieces of the product of the pieces' probabilities, found by a forward pass
over the word's positions. A text's words are the runs of its letters, lowered,
with the vocabulary's mark for the beginning of a word.

The probabilities are fitted by expectation maximisation on a bounded sample of
labelled documents (TRAIN_DOCS a language, chosen by the hash of the id): each
round is a Spark job that distributes the words and sums expected piece counts,
of which there are at most languages * pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.words import distinct_words, slices
from driftline.session import written

#: Documents of a language that are learned from, in expectation.
TRAIN_DOCS = 4_000
ROUNDS = 3
SMOOTHING = 0.01
#: The sums of longer words (mark included) are taken in logarithms.
SHORT = 33
#: Positions of a word that are summed up at once; the sums of a longer one go from window to window.
WINDOW = 1 << 16
#: Cells (words by positions) of lattices that are summed up at once.
CELLS = 1 << 20
#: Words whose probabilities a worker remembers (twice this many at most).
REMEMBERED = 50_000
MARK = "▁"
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"
#: Texts that are scored at once.
TEXTS = 200
#: Words whose lattices are built at once.
TOGETHER = 2_048
SEED = 71
#: A text is of no learned language if its log-probability is below TIMES the POOR quantile of labelled ones, by SLACK or more.
POOR, TIMES, SLACK = 0.01, 2.0, 30.0


@dataclass(frozen=True)
class Pieces:
    """The vocabulary's pieces made of letters, with or without the mark; the number after the last stands for a letter that is no piece.

    Pieces are found by a polynomial hash of their code points modulo 2^64; of
    ``hashes``, sorted, ``numbers`` are the pieces, and ``perhaps`` tells by the
    top bits of a hash whether any piece has these.
    """

    count: int
    longest: int
    hashes: np.ndarray
    numbers: np.ndarray
    perhaps: np.ndarray


STEP = np.uint64(0x9E3779B97F4A7C15)
TOP = np.uint64(44)


def _hash(codes: np.ndarray) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for c in codes:
        h = (h + np.uint64(c)) * STEP
    return h[0]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = [p for p in (model.id_to_piece(i) for i in range(model.get_piece_size())) if (p.replace(MARK, "", 1) or MARK).replace(MARK, "a").isalpha()]
    hashes = np.array([_hash(np.frombuffer(p.encode("utf-32-le"), "<u4")) for p in found], np.uint64)
    order = np.argsort(hashes)
    if (hashes[order][1:] == hashes[order][:-1]).any():
        raise ValueError("two pieces have one hash")
    perhaps = np.zeros(1 << 20, bool)
    perhaps[(hashes >> TOP).astype(np.int64)] = True
    return Pieces(len(found), max(map(len, found)), hashes[order], order, perhaps)


def lattice(words: list[str], path: str) -> tuple[np.ndarray, ...]:
    """All edges of the words' segmentation lattices: word, first position, end, piece. And the words' lengths."""
    v = pieces(path)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    of = np.repeat(np.arange(len(words)), lengths)
    ends = np.cumsum(lengths)
    left = ends[of] - np.arange(len(codes))  # letters from a position to the end of its word
    places, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for size in range(1, v.longest + 1):
        h = (h + codes[places + size - 1]) * STEP
        some = np.flatnonzero(v.perhaps[(h >> TOP).astype(np.int64)])
        at = np.minimum(np.searchsorted(v.hashes, h[some]), v.count - 1)
        hit = v.hashes[at] == h[some]
        found.append((places[some[hit]], np.full(int(hit.sum()), size), v.numbers[at[hit]]))
        if size == 1:
            none = np.ones(len(codes), bool)
            none[found[0][0]] = False
            rest = np.flatnonzero(none)
            found.append((rest, np.ones(len(rest), np.int64), np.full(len(rest), v.count)))
        goes_on = left[places] > size
        places, h = places[goes_on], h[goes_on]
    place, size, what = (np.concatenate(x) for x in zip(*found, strict=True))
    low = place - (ends - lengths)[of[place]]
    return of[place], low, low + size, what, lengths


def _sweep(steps: np.ndarray, word: np.ndarray, source: np.ndarray, weight: np.ndarray, table: np.ndarray, backward: bool = False, logs: bool = False) -> None:
    """For one position of all words after the other, set ``table[word, position]`` to the sum of ``table[word, source] * weight`` over the edges that meet there; ``logs``: all of it in logarithms."""
    join, total = (np.add, np.logaddexp) if logs else (np.multiply, np.add)
    n = len(table)
    order = np.argsort(steps * n + word, kind="stable")
    key = (steps * n + word)[order]
    word, source, weight = word[order], source[order], weight[order]
    groups = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    position = key[groups] // n
    cuts = np.flatnonzero(np.concatenate(([True], position[1:] != position[:-1], [True]))) if len(groups) else np.zeros(1, np.int64)
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    for a, b in reversed(spans) if backward else spans:
        first, last = groups[a], groups[b] if b < len(groups) else len(key)
        part = join(table[word[first:last], source[first:last]], weight[first:last])
        table[word[groups[a:b]], position[a]] = total.reduceat(part, groups[a:b] - first, axis=0)


def forward(words: list[str], probabilities: np.ndarray, path: str) -> np.ndarray:
    """log P(word | language), a row for each word; ``probabilities`` has a row for each piece."""
    out = np.zeros((len(words), probabilities.shape[1]))
    rows = [k for k, word in enumerate(words) if len(word) <= SHORT]
    if rows:
        of, low, high, what, lengths = lattice([words[k] for k in rows], path)
        # an edge is lifted by 2^8 for each of its letters, so that long words don't vanish
        weight = probabilities[what] * (256.0 ** (high - low))[:, None]
        alpha = np.zeros((len(rows), int(lengths.max()) + 1, probabilities.shape[1]))
        alpha[:, 0] = 1.0
        _sweep(high, of, low, weight, alpha)
        out[rows] = np.log(alpha[np.arange(len(rows)), lengths]) - (lengths * np.log(256.0))[:, None]
    with np.errstate(divide="ignore"):
        logs = np.log(probabilities)
    for rows in _groups(words, [k for k, word in enumerate(words) if SHORT < len(word) <= WINDOW]):
        of, low, high, what, lengths = lattice([words[k] for k in rows], path)
        alpha = np.full((len(rows), int(lengths.max()) + 1, probabilities.shape[1]), -np.inf)
        alpha[:, 0] = 0.0
        _sweep(high, of, low, logs[what], alpha, logs=True)
        out[rows] = alpha[np.arange(len(rows)), lengths]
    for k, word in enumerate(words):
        if len(word) > WINDOW:
            out[k] = _long(word, logs, path)
    return out


def _groups(words: list[str], rows: list[int]) -> Iterator[list[int]]:
    """Words of like length together, CELLS cells at most to a group, or one word."""
    group: list[int] = []
    for k in sorted(rows, key=lambda k: len(words[k])):
        if group and (len(group) + 1) * len(words[k]) > CELLS:
            yield group
            group = []
        group.append(k)
    if group:
        yield group


def _long_forward(word: str, at: int, last: np.ndarray, logs: np.ndarray, path: str) -> tuple[np.ndarray, int, int]:
    """Forward sums of the window that begins at ``at``, and the positions of the first and the last; ``last``: those of as many positions before as a piece is long."""
    first, end = max(0, at - pieces(path).longest), min(len(word), at + WINDOW)
    _, low, high, what, _ = lattice([word[first:end]], path)
    new = high > at - first
    alpha = np.full((1, end - first + 1, logs.shape[1]), -np.inf)
    alpha[0, : at - first + 1] = last[-(at - first + 1) :]
    _sweep(high[new], np.zeros(int(new.sum()), np.int64), low[new], logs[what[new]], alpha, logs=True)
    return alpha, first, end


def _long(word: str, logs: np.ndarray, path: str) -> np.ndarray:
    """One word in windows; from one to the next go the sums of as many positions as a piece is long."""
    last = np.zeros((1, logs.shape[1]))
    for at in range(0, len(word), WINDOW):
        alpha, _, _ = _long_forward(word, at, last, logs, path)
        last = alpha[0, -(pieces(path).longest + 1) :]
    return last[-1]


def _long_expected(word: str, logs: np.ndarray, path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces and their expected uses in one word of one language (``logs`` has one column), window by window.

    Forward sums are kept at the beginning of each window only; from the last window
    to the first they are taken again, and met by the backward sums.
    """
    longest = pieces(path).longest
    begins, kept, last = range(0, len(word), WINDOW), [], np.zeros((1, 1))
    for at in begins:
        kept.append(last)
        alpha, _, _ = _long_forward(word, at, last, logs, path)
        last = alpha[0, -(longest + 1) :]
    whole, after = last[-1, 0], np.zeros((1, 1))
    for at, before in zip(reversed(begins), reversed(kept), strict=True):
        alpha, first, end = _long_forward(word, at, before, logs, path)
        stop = min(len(word), end + longest)
        _, low, high, what, _ = lattice([word[at:stop]], path)
        own = low < end - at
        low, high, what = low[own], high[own], what[own]
        beta = np.full((1, stop - at + 1, 1), -np.inf)
        beta[0, end - at :] = after[: stop - end + 1]
        _sweep(low, np.zeros(len(low), np.int64), high, logs[what], beta, backward=True, logs=True)
        yield what, np.exp(alpha[0, low + at - first, 0] + logs[what, 0] + beta[0, high, 0] - whole)
        after = beta[0, : longest + 1]


def expected(words: list[str], counts: np.ndarray, langs: np.ndarray, probabilities: np.ndarray, path: str) -> np.ndarray:
    """Expected uses of each piece by each language, by forward and backward sums over the words' lattices."""
    n = probabilities.shape
    total = np.zeros(n[0] * n[1])
    short = [k for k, word in enumerate(words) if len(word) <= SHORT]
    long = _groups(words, [k for k, word in enumerate(words) if SHORT < len(word) <= WINDOW])
    for logs, rows in [*([(False, short)] if short else []), *((True, g) for g in long)]:
        of, low, high, what, lengths = lattice([words[k] for k in rows], path)
        lang = langs[rows][of]
        zero, one = (-np.inf, 0.0) if logs else (0.0, 1.0)
        weight = np.log(probabilities[what, lang])[:, None] if logs else (probabilities[what, lang] * 256.0 ** (high - low))[:, None]
        alpha = np.full((len(rows), int(lengths.max()) + 1, 1), zero)
        beta = alpha.copy()
        alpha[:, 0], beta[np.arange(len(rows)), lengths] = one, one
        _sweep(high, of, low, weight, alpha, logs=logs)
        _sweep(low, of, high, weight, beta, backward=True, logs=logs)
        parts = alpha[of, low, 0], weight[:, 0], beta[of, high, 0], alpha[of, lengths[of], 0]
        use = np.exp(parts[0] + parts[1] + parts[2] - parts[3]) if logs else parts[0] * parts[1] * parts[2] / parts[3]
        total += np.bincount(what * n[1] + lang, use * counts[rows][of], minlength=len(total))
    for k, word in enumerate(words):
        if len(word) > WINDOW:
            for what, use in _long_expected(word, np.log(probabilities[:, langs[k] : langs[k] + 1]), path):
                total += np.bincount(what * n[1] + langs[k], use * counts[k], minlength=len(total))
    return total.reshape(n)


def words_of(text: str) -> list[str]:
    """The runs of letters of a lowered text, for learning."""
    return [MARK + w for w in LETTERS.findall(text)]


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    probabilities: np.ndarray
    prior: np.ndarray
    path: str
    key: str


def held_out(id_col: str, folds: int = 5):
    """Whether the CRC-32 of the id, written as text, is a multiple of ``folds``. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel | None:
    """Fit on the labelled documents of ``docs``; None if there are none with a letter."""
    spark = docs.sparkSession
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}  # a row for each language
    langs = sorted(sizes)
    if not langs:
        return None
    share = F.create_map(*[F.lit(x) for n in langs for x in (n, min(1.0, TRAIN_DOCS / sizes[n]))])
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(SEED)), F.lit(1_000_003)) / 1_000_003.0
    sample = labelled.where(draw < share[F.col(lang)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for part in slices(batch, TEXTS, column=1):
                for name in part.column(0).unique().to_pylist():
                    raw, number, _ = distinct_words(part.column(1).filter(pc.equal(part.column(0), name)), ascii=False)
                    own = seen.setdefault(name, Counter())
                    for word, n in zip(raw, np.bincount(number, minlength=len(raw)).tolist(), strict=True):
                        for piece in words_of(word):
                            own[piece] += n
        for name, words in seen.items():
            yield pa.RecordBatch.from_pydict({"lang": [langs.index(name)] * len(words), "word": list(words), "n": list(words.values())}, schema=pa.schema([("lang", pa.int32()), ("word", pa.string()), ("n", pa.int64())]))

    words = sample.select(lang, text).mapInArrow(count, "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = written(words, "words")
    n_pieces = pieces(path).count + 1
    shape = (n_pieces, len(langs))
    now = np.full(shape, 1.0 / n_pieces)
    for _ in range(ROUNDS):
        holder = spark.sparkContext.broadcast(now)  # languages * pieces

        def sums(batches: Iterator[pa.RecordBatch], holder=holder) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for at in range(0, batch.num_rows, TOGETHER):
                    part = batch.slice(at, TOGETHER)
                    total += expected(part.column(1).to_pylist(), part.column(2).to_numpy(), part.column(0).to_numpy(), holder.value, path)
            where = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"cell": where, "n": total.ravel()[where]})

        found = words.mapInArrow(sums, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        if not found:
            return None
        total = np.zeros(n_pieces * len(langs))
        for row in found:
            total[row.cell] = row.n
        total = total.reshape(shape) + SMOOTHING
        now = total / total.sum(axis=0)
        holder.unpersist()
    prior = np.array([sizes[n] for n in langs], dtype=float)
    import uuid

    return LanguageModel(tuple(langs), now, np.log(prior / prior.sum()), path, uuid.uuid4().hex)


class _Scorer:
    """Scores of texts; it remembers those of words as they stand between white space.

    A row of scores ends with the number of letters (marks included) that it is of.
    """

    def __init__(self, model: LanguageModel):
        self.model = model
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.langs) + 1))
        self.old = (self.rows, self.scores)

    def _learn(self, raw: list[str]) -> np.ndarray:
        """The scores of words: of each run of letters in them, summed up."""
        runs = [[MARK + r] if r.isalpha() else [MARK + x for x in LETTERS.findall(r)] for r in raw]
        flat = list({w for ws in runs for w in ws})
        number = {w: k for k, w in enumerate(flat)}
        scores = [forward(flat[a : a + TOGETHER], self.model.probabilities, self.model.path) for a in range(0, len(flat), TOGETHER)]
        scores = np.concatenate([*scores, np.zeros((1, len(self.model.langs)))])  # the last: a word without letters
        scores = np.column_stack((scores, [*map(len, flat), 0]))
        firsts = np.fromiter((number[ws[0]] if ws else len(flat) for ws in runs), np.int64, len(runs))
        out = scores[firsts]
        for k, ws in enumerate(runs):
            if len(ws) > 1:
                out[k] = scores[[number[w] for w in ws]].sum(axis=0)
        return out

    def totals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Summed log-probabilities of texts, the number of their letters, and whether a text has a letter."""
        words, number, bounds = distinct_words(texts, ascii=False)
        table = np.zeros((len(words), len(self.model.langs) + 1))
        fresh = [k for k, w in enumerate(words) if w not in self.rows]
        have = np.ones(len(words), bool)
        have[fresh] = False
        known = np.flatnonzero(have)
        if len(known):
            table[known] = self.scores[[self.rows[words[k]] for k in known]]
        rows, scores = self.old
        again = [k for k in fresh if words[k] in rows]
        if again:
            table[again] = scores[[rows[words[k]] for k in again]]
            fresh = [k for k in fresh if words[k] not in rows]
        if fresh:
            table[fresh] = self._learn([words[k] for k in fresh])
        n, more = len(self.rows), again + fresh
        self.rows.update(zip((words[k] for k in more), range(n, n + len(more)), strict=True))
        self.scores = np.concatenate([self.scores, table[more]]) if more else self.scores
        lettered = np.fromiter((any(map(str.isalpha, w)) for w in words), bool, len(words))
        # each text alone, so that its sums don't depend on its neighbours
        sums = np.add.reduceat(np.concatenate([table[number], np.zeros((1, table.shape[1]))]), bounds[:-1], axis=0)
        sums[bounds[1:] == bounds[:-1]] = 0.0
        counts = np.concatenate(([0], np.cumsum(lettered[number])))
        if len(self.rows) > REMEMBERED:
            self.old = (self.rows, self.scores)
            self.rows, self.scores = {}, self.scores[:0]
        return sums[:, :-1], sums[:, -1], counts[bounds[1:]] > counts[bounds[:-1]]


_scorers: dict[str, _Scorer] = {}


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score``, the columns ``carry``, and ``__fit`` and ``__letters``.

    ``score`` is the posterior probability of the predicted language, which says
    nothing of languages that weren't learned; ``__fit`` is the log-probability of the
    text under it, of ``__letters`` letters (marks of words included). A null text,
    one without a letter, and every text where no model could be fitted, gets
    ``und`` with score 0.
    """
    spark = docs.sparkSession
    holder = spark.sparkContext.broadcast(model)  # languages * pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = holder.value
        if model is not None and model.key not in _scorers:
            _scorers.clear()
            _scorers[model.key] = _Scorer(model)
        for batch in batches:
            for part in slices(batch, TEXTS):
                names, scores = [UNKNOWN] * part.num_rows, [0.0] * part.num_rows
                fit, letters = np.zeros(part.num_rows), np.zeros(part.num_rows)
                if model is not None:
                    alone, letters, lettered = _scorers[model.key].totals(part.column(0))
                    total = alone + model.prior
                    best = total.argmax(axis=1)
                    fit = alone[np.arange(len(best)), best]
                    sure = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    for k in np.flatnonzero(lettered).tolist():
                        names[k], scores[k] = model.langs[best[k]], float(sure[k])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(fit, pa.float64()), pa.array(letters, pa.float64())], names=[*part.schema.names[1:], "lang_pred", "score", "__fit", "__letters"])

    chosen = docs.select(F.col(text).alias("__text"), F.col(id_col).alias("doc_id"), *carry)
    return chosen.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:]) + ", lang_pred string, score double, __fit double, __letters double")


def plausible(known: DataFrame, lang: str = "lang") -> Column:
    """Whether a predicted text reads like its language at all, which the posterior can't tell: it only weighs the learned languages.

    The bound of a language is TIMES the POOR quantile of the log-probabilities a
    letter over all of its labelled documents that are predicted so, and SLACK lower for a whole
    text. A language without such documents has none.
    """
    right = known.where((F.col(lang) == F.col("lang_pred")) & (F.col("__letters") > 0))
    found = right.groupBy("lang_pred").agg(F.percentile_approx(F.col("__fit") / F.col("__letters"), POOR).alias("x")).collect()  # a row for each language
    ok = F.lit(True)
    for row in found:
        ok = F.when(F.col("lang_pred") == row.lang_pred, F.col("__fit") >= TIMES * row.x * F.col("__letters") - SLACK).otherwise(ok)
    return ok


def identify(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Fit on the documents that aren't held out and predict all: ``doc_id``, ``held_out``, ``lang_pred``, ``score``.

    The label is used for fitting only. Null ids are held out by the CRC-32 of no
    bytes, 0. An empty table gives an empty result; rows that are repeated are
    predicted alike; other columns aren't read.
    """
    model = fit(docs.where(~held_out(id_col)), path, id_col, text, lang)
    return predict(docs, model, id_col, text).withColumn("held_out", held_out("doc_id")).select("doc_id", "held_out", "lang_pred", "score")
