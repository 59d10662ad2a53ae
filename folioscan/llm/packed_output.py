"""Token ids in packed matrices.

Documents are tokenized, ended by a token, and cut into pieces where they are
longer than a row; no id is lost.  Pieces are packed into rows of ``capacity``
ids by best-fit decreasing: the longest piece first, into the row with the
least free space that is enough.  That row is found by a segment tree over the
amounts of free space, each node of which knows whether any row below it is
open.

Each task packs the documents of its split in blocks of about ``block`` tokens,
so that memory is bounded and no ids are shuffled; only the last rows of a block
are less than full.  A row of the result is a row of the id matrix with its
cumulative segment lengths and its positions, which begin anew at each segment.

Defined results: a null or empty text is the end token alone; repeated rows and
equal or null doc_ids are packed one by one; pieces of equal length keep the
order of the input; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from folioscan.llm import tokens

CAPACITY, END, PAD = 4096, 50256, 0
BLOCK = 1 << 22


class FreeSpace:
    """Open rows by free space, in a segment tree over 0 to ``capacity``."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)  # rows below each node
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _count(self, space: int, change: int) -> None:
        node = self.leaves + space
        while node:
            self.open[node] += change
            node >>= 1

    def add(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        self._count(space, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The tightest row with at least ``least`` free: (free space, row)."""
        node = self.leaves + least
        while not self.open[node]:
            while node & 1:  # a right child: go up
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        space = node - self.leaves
        row = self.rows[space].pop()
        self._count(space, -1)
        return space, row


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Rows of indices into ``lengths``."""
    rows: list[list[int]] = []
    free = FreeSpace(capacity)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = free.take(lengths[i])
        if found is None:
            found = capacity, len(rows)
            rows.append([])
        space, row = found
        rows[row].append(i)
        free.add(space - lengths[i], row)
    return rows


SCHEMA = ("sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, starts array<long>, input_ids array<int>, "
          "cu_seqlens array<int>, position_ids array<int>")


def _matrix(pieces: list[tuple], capacity: int, first: int) -> pa.RecordBatch:
    rows = best_fit_decreasing([len(ids) for *_, ids in pieces], capacity)
    ids = np.full((len(rows), capacity), PAD, np.int32)
    positions = np.zeros((len(rows), capacity), np.int32)
    bounds, used = [], []
    for line, row in enumerate(rows):
        ends = np.cumsum([0] + [len(pieces[i][3]) for i in row]).astype(np.int32)
        ids[line, :ends[-1]] = np.concatenate([pieces[i][3] for i in row])
        positions[line, :ends[-1]] = np.concatenate([np.arange(n, dtype=np.int32) for n in np.diff(ends)])
        bounds.append(ends)
        used.append(int(ends[-1]))
    fixed = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * capacity)

    def each(part: int, kind: pa.DataType) -> pa.Array:
        return pa.array([[pieces[i][part] for i in row] for row in rows], pa.list_(kind))

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([
        pa.array(np.arange(first, first + len(rows))), pa.array(used, pa.int32()), each(0, pa.int64()), each(1, pa.int32()),
        each(2, pa.int64()), pa.ListArray.from_arrays(fixed, pa.array(ids.ravel())), pa.array(bounds, pa.list_(pa.int32())),
        pa.ListArray.from_arrays(fixed, pa.array(positions.ravel()))], names)


def _packer(tokenizer: str, pattern: str, capacity: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        encode = tokens.byte_bpe_all(tokenizer, pattern)
        first = TaskContext.get().partitionId() << 33
        end = np.array([END], np.int32)
        pieces: list[tuple] = []
        held = 0

        def packed():
            nonlocal first
            # A few hundred rows at a time leave the task.
            batch = _matrix(pieces, capacity, first)
            first += batch.num_rows
            pieces.clear()
            for at in range(0, batch.num_rows, 256):
                yield batch.slice(at, 256)

        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts)):
                ids = np.concatenate([ids, end])
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    pieces.append((doc, piece, at, ids[at:at + capacity]))
                held += len(ids)
                if held >= block:
                    yield from packed()
                    held = 0
        if pieces:
            yield from packed()

    return run


def packed_matrices(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """One row for each row of the matrix.  ``doc_ids``, ``pieces`` and
    ``starts`` name the segments; the ids from ``n_tokens`` on are padding."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_packer(tokenizer, pattern, capacity, block), SCHEMA)


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = []
        for name in ("input_ids", "position_ids", "cu_seqlens"):
            lists = batch.column(name)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
            raw.append(pa.array([values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), *raw], ["sequence_id", "ids", "positions", "cu_seqlens"])


def write_binary(matrices: DataFrame, path: str) -> None:
    """Writes the matrices as rows of little-endian unsigned 32-bit numbers."""
    rows = matrices.select("sequence_id", "input_ids", "position_ids", "cu_seqlens")
    rows.mapInArrow(_raw, "sequence_id long, ids binary, positions binary, cu_seqlens binary").write.parquet(path)
