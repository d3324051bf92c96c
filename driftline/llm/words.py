"""Words of many texts at once, by Arrow's string kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, rows: int, size: int = 1 << 24, column: int = 0) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows and about ``size`` bytes of text, of one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.concatenate(([0], np.cumsum(lengths))), 0
    while at < batch.num_rows:
        end = min(at + rows, max(at + 1, int(np.searchsorted(total, total[at] + size, side="right")) - 1))
        yield batch.slice(at, end - at)
        at = end


def distinct_words(texts: pa.Array, ascii: bool = True, as_array: bool = False, lower: bool = True) -> tuple[list[str] | pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, the number of each position's word, and where each text begins (and the last one ends).

    ``ascii``: A-Z are lowered (unless ``lower`` is false) and words end at ASCII
    white space; else all letters and white space. A null text has no words.
    """
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    if ascii:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(filled) if lower else filled)
    else:
        lists = pc.utf8_split_whitespace(pc.utf8_lower(filled))
    encoded = lists.flatten().dictionary_encode()
    words, number = encoded.dictionary, encoded.indices.to_numpy()
    bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))))
    empty = pc.index(words, "").as_py()
    if empty >= 0:  # what white space at an end of a text leaves
        real = number != empty
        bounds = np.concatenate(([0], np.cumsum(real)))[bounds]
        number = number[real]
        number = number - (number > empty)
        words = words.filter(pc.not_equal(words, ""))
    return words if as_array else words.to_pylist(), number, bounds
