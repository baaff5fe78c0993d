"""Packing by best-fit decreasing, with token-id matrices as output.

Each task encodes its documents into a buffer of bounded size, cuts overlong documents into full
windows and a rest, and places the pieces, longest first, into the fullest window that still has
room, found by descending a segment tree over the capacities left. No shuffle is needed, and a lost
task is simply run again.

Cases: null and empty texts hold only the closing id (nothing where there is none); equal documents
are packed once each; an empty table gives no windows; null document ids are kept; documents of any
length are split without loss; ties go to the earlier piece; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import encoder
from ._common import id_and_text, small

SEQUENCES = "sequence_id long, n_tokens int, n_segments int, doc_ids array<long>, seg_starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"
BUFFER_TOKENS = 2_000_000


class CapacityTree:
    """Bins by the room they have left; the tightest bin with enough room in log(capacity) steps."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) with the least room that is ``need`` or more."""
        i = need + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i + (not self.count[2 * i])
        room = i - self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, self.bins[room].pop()


def place(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of piece numbers by best-fit decreasing; no piece is longer than ``capacity``."""
    bins: list[list[int]] = []
    tree = CapacityTree(capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        found = tree.take(size) if size < capacity else None
        room, b = found or (capacity, len(bins))
        if found is None:
            bins.append([])
        bins[b].append(i)
        if room > size:
            tree.add(room - size, b)
    return bins


def _matrix(docs: list[int | None], ids: list[np.ndarray], length: int, pad_id: int, base: int) -> pa.RecordBatch:
    n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    counts = -(-n // length)
    doc = np.repeat(np.arange(len(n)), counts)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * length
    size = np.minimum(length, n[doc] - start)
    bins = place(size, length)
    rows = []
    for k, pieces in enumerate(bins):
        matrix, positions = np.full(length, pad_id, dtype="<u4"), np.zeros(length, dtype="<u4")
        cuts = [0]
        for p in pieces:
            a, b = cuts[-1], cuts[-1] + int(size[p])
            matrix[a:b] = ids[doc[p]][start[p] : start[p] + size[p]]
            positions[a:b] = np.arange(b - a)
            cuts.append(b)
        rows.append((base + k, cuts[-1], len(pieces), [docs[doc[p]] for p in pieces], [int(start[p]) for p in pieces], cuts, matrix.tobytes(), positions.tobytes()))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in SEQUENCES.split(", ")]
    return pa.record_batch([pa.array(list(c), type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def pack(docs: DataFrame, tokenizer: str, pattern: str, length: int = 1024, end_id: int | None = 50256, pad_id: int = 0, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """One row per packed window: its documents and where in them each segment starts, cumulative
    segment lengths, the padded id row and the positions, which start at 0 in every segment
    (both little-endian uint32). ``buffer_tokens`` bounds what a task holds; it costs at most the
    rest of a window per buffer."""
    closing = np.array([] if end_id is None else [end_id], dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, base = encoder(tokenizer, pattern), TaskContext.get().partitionId() << 33
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0
        for batch in small(batches):
            for doc, x in zip(batch.column(0).to_pylist(), bpe.encode(batch.column(1).to_pylist()), strict=True):
                names.append(doc)
                ids.append(np.concatenate((x, closing)))
                held += len(ids[-1])
                if held >= buffer_tokens:
                    out = _matrix(names, ids, length, pad_id, base)
                    base, names, ids, held = base + out.num_rows, [], [], 0
                    yield out
        if held:
            yield _matrix(names, ids, length, pad_id, base)

    return id_and_text(docs).mapInArrow(run, SEQUENCES)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write id matrices, cumulative segment lengths and positions as Parquet, one row a window."""
    packed.write.option("compression", "zstd").parquet(path)
