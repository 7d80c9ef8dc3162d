"""Vectorised words of whole texts.

A word is a run of `[^\\x20\\x09-\\x0D]`. Words, n-grams and windows become 64-bit hashes by polynomial sums over the bytes of an Arrow string column, so no Python object is made per word. Memory per call is bounded: `slices` cuts a batch into runs of documents of about `limit` bytes (one longer document makes a run of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASK = (1 << 64) - 1
BASE, WORD_BASE, WINDOW_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: White space and ASCII punctuation, for operators that compare words without their punctuation.
PUNCTUATION = SPACES.copy()
PUNCTUATION[[b for b in range(128) if not chr(b).isalnum()]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
#: A-Z have the codes of a-z.
FOLDED = TABLE.copy()
FOLDED[65:91] = TABLE[97:123]


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 23:
            _powers[base] = have
    return have[:n]


def window_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair, independent of where the window lies."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=total[1:])
    inverse = pow(base, -1, 1 << 64)
    return (total[ends] - total[starts]) * powers(inverse, n + 1)[starts]


class Words:
    """Words of a run of documents: `hashes` of all words, `first[d]:first[d + 1]` those of document d."""

    def __init__(self, texts: pa.Array, fold: bool = False, gaps: np.ndarray = SPACES):
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        n = len(self.data)
        inside = ~gaps[self.data]
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], after[-1] = True, True
            before[1:] = ~inside[:-1] | cut[1:-1]
            after[:-1] = ~inside[1:] | cut[1:-1]
        self.starts = np.flatnonzero(inside & before)
        self.ends = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = mix(window_sums((FOLDED if fold else TABLE)[self.data], self.starts, self.ends, BASE)) if n else np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words that stay inside a document, and for each document where its own begin (one more at the end)."""
        counts = np.maximum(np.diff(self.first) - k + 1, 0)
        begin = np.concatenate(([0], np.cumsum(counts)))
        at = np.arange(begin[-1]) + np.repeat(self.first[:-1] - begin[:-1], counts)
        out = np.zeros(len(at), np.uint64)
        for j in range(k):
            out = out * np.uint64(WORD_BASE) + self.hashes[at + j]
        return mix(out), begin


def slices(texts: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs [begin, end) of documents of about `limit` bytes."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)) if len(texts) else np.zeros(0, np.int64)
    begin = 0
    while begin < len(texts):
        base = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, base + limit, "right")))
        yield begin, end
        begin = end


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as non-null strings: null counts as empty."""
    return pc.fill_null(batch.column(name), "")


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
