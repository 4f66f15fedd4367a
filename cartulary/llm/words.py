"""Words and their hashes for whole Arrow batches, in numpy.

A word is a run of bytes outside \\x20 and \\x09-\\x0D of one document. Its hash is made of its blocks of eight bytes, each mixed with
its number; equal words have equal hashes wherever they stand. A polynomial of the bytes modulo 2**64 would not do: whatever its
base, it gives one value to different words of 1,024 bytes and more that follow Thue and Morse's pattern.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLOCK = np.uint64(0x9E3779B97F4A7C15)
#: By bytes that a block has: those of its eight that count.
_INSIDE = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_RUNS = 0xAEF17502108EF2D9
_RUNS_INVERSE = pow(_RUNS, -1, 1 << 64)
_KGRAM = np.uint64(0xD1342543DE82EF95)
#: Texts are handled in groups of about so many bytes, which bounds the arrays' memory.
CHUNK_BYTES = 2 << 20
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64; the table is kept up to one chunk's length."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.ones(1 << max(16, int(n - 1).bit_length()), np.uint64)
        done = 1
        while done < len(out):
            out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        have = out
        if len(out) <= 4 * CHUNK_BYTES:
            _powers[base] = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: all bits of the result depend on all bits of h."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word, bytes start to end of data."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 7, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(len(data), "<u8", padded, strides=(1,))  # the eight bytes from each place
    size = end - start
    out = mix((eights[start] & _INSIDE[np.minimum(size, 8)]) + _BLOCK)
    long = np.flatnonzero(size > 8)
    if len(long):
        n = (size[long] - 1) // 8  # blocks after the first
        first = np.cumsum(n) - n
        i = np.arange(first[-1] + n[-1]) - np.repeat(first - 1, n)
        at = np.repeat(start[long], n) + 8 * i
        block = eights[at] & _INSIDE[np.minimum(np.repeat(end[long], n) - at, 8)]
        out[long] += np.add.reduceat(mix(block + (i + 1).astype(np.uint64) * _BLOCK), first)
    return mix(out + size.astype(np.uint64) * _KGRAM)


class Words:
    """The words of some texts. start, end: byte offsets in data; doc: index of the text; first[d]: index of text d's first word."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if lower:
            self.data = self.data + ((self.data >= 65) & (self.data <= 90)).astype(np.uint8) * np.uint8(32)
        inside = ~((self.data == 32) | ((self.data >= 9) & (self.data <= 13)))
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(inside))]
        before[cuts] = False
        after[cuts - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = _word_hashes(self.data, self.start, self.end)


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, by the index of the first; also across texts, which the caller masks."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _KGRAM
        out += h[j : j + n]
    return mix(out)


def run_digests(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Digest of each run of words first to end-1, from one running sum; runs of other lengths have other digests."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power(_RUNS, len(h)), out=sums[1:])
    return mix((sums[end] - sums[first]) * _power(_RUNS_INVERSE, len(h) + 1)[first] + (end - first).astype(np.uint64))


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of about CHUNK_BYTES of text, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > CHUNK_BYTES:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += n
    if len(sizes) > lo:
        yield batch.slice(lo)
