"""Token-ID output: best-fit-decreasing packing into rows of fixed length.

Texts are tokenised by a given byte-level BPE vocabulary (a file of ranks; never trained here) and end with the end-of-text id.
A partition's documents are packed in blocks of about BLOCK_TOKENS tokens, so memory is bounded however large the partition is,
and no shuffle is needed. A document longer than a row is cut into whole rows and a remainder, none of it lost. The pieces of a
block go, longest first, each into the row with the least free space that still holds it; a segment tree over free capacities
finds that row in O(log length).

A row has `tokens` (ids, little-endian, padded with the end-of-text id to the full length), `cu_seqlens` (0 and the end of each
segment), `positions` (they restart at 0 in each segment, and are 0 in the padding), and for each segment its doc_id and the
offset of its first token in the document. Null texts are empty and have the end-of-text id alone. Rows that repeat are packed
each. Packs depend on how the input is split into partitions, their contents on nothing else.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cartulary.llm.shared import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are cut before merging (a public constant that goes with the file).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROW_TOKENS = 2048
BLOCK_TOKENS = 2 << 20
SCHEMA = "pack_id long, n_tokens int, doc_ids array<long>, starts array<int>, cu_seqlens array<int>, tokens binary, positions binary"


class Capacities:
    """Open rows by free capacity; a segment tree tells the least capacity of at least n that some row has."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.tree = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, row: int, free: int) -> None:
        self.rows[free].append(row)
        i = free + self.width
        while i:
            self.tree[i] += 1
            i >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """The row with the least free capacity >= n, and that capacity."""
        i = n + self.width
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):  # up, until a right sibling has a row
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        free = i - self.width
        row = self.rows[free].pop()
        while i:
            self.tree[i] -= 1
            i >>= 1
        return row, free


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of lengths, by row; each length is from 1 to capacity."""
    open_rows, rows = Capacities(capacity), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = open_rows.take(lengths[k])
        if found is None:
            rows.append([])
            found = len(rows) - 1, capacity
        row, free = found
        rows[row].append(k)
        if free > lengths[k]:
            open_rows.add(row, free - lengths[k])
    return rows


def _pack(vocabulary, length: int):
    def rows_of(block: list[tuple[int | None, np.ndarray]], end: int, first_id: int) -> Iterator[pa.RecordBatch]:
        pieces = [(doc, at, ids[at : at + length]) for doc, ids in block for at in range(0, len(ids), length)]
        packs = best_fit_decreasing([len(p[2]) for p in pieces], length)
        for lo in range(0, len(packs), 256):
            columns: list[list] = [[] for _ in range(7)]
            for n, pack in enumerate(packs[lo : lo + 256], lo):
                parts = [pieces[k] for k in pack]
                cuts = np.cumsum([0, *(len(p[2]) for p in parts)])
                tokens = np.full(length, end, parts[0][2].dtype)
                tokens[: cuts[-1]] = np.concatenate([p[2] for p in parts])
                positions = np.zeros(length, np.uint32 if length > 1 << 16 else np.uint16)
                positions[: cuts[-1]] = np.arange(cuts[-1]) - np.repeat(cuts[:-1], np.diff(cuts))
                for column, x in zip(columns, (first_id + n, int(cuts[-1]), [p[0] for p in parts], [p[1] for p in parts], cuts.tolist(), tokens.tobytes(), positions.tobytes()), strict=True):
                    column.append(x)
            types = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["pack_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", "tokens", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoding(vocabulary.value)
        kind = np.uint16 if end < 1 << 16 else np.uint32
        next_id, block, total = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.array([*coder.encode_ordinary(text.as_py() or ""), end], kind)
                block.append((doc, ids))
                total += len(ids)
                if total >= BLOCK_TOKENS:
                    for out in rows_of(block, end, next_id):
                        next_id += out.num_rows
                        yield out
                    block, total = [], 0
        if block:
            yield from rows_of(block, end, next_id)

    return run


def encoding(vocabulary: bytes):
    """The tokenizer of a vocabulary file's contents, and the end-of-text id (the first free one)."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, row_tokens: int = ROW_TOKENS) -> DataFrame:
    """Packed rows (SCHEMA) of docs. The driver reads the vocabulary (under a megabyte) and sends it to the executors."""
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    return docs.select("doc_id", "text").mapInArrow(_pack(ranks, row_tokens), SCHEMA)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens, packed."""
    return pack(table(spark, sf_dir, "documents"))
