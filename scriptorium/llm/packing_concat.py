"""Packing by concatenation and cutting.

Pass one encodes every document once and writes its ids with its place in its partition. The
partitions' token totals, one number each, are summed to global offsets, and pass two cuts
fixed windows row by row. Neither pass shuffles: a document's pieces follow from its global offset.

Cases: a null or empty text holds only the closing id; equal documents are packed once each; an
empty table gives no pieces; documents of any length are cut over as many windows as they need;
null document ids are kept; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import encoder
from ._common import held, id_and_text, small, written

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, opens boolean, closes boolean"


def encoded(docs: DataFrame, tokenizer: str, pattern: str, end_id: int | None = None) -> DataFrame:
    """doc_id, part, local_start, doc_tokens, ids (little-endian uint32), map-only."""
    closing = np.array([] if end_id is None else [end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, upto = encoder(tokenizer, pattern), TaskContext.get().partitionId(), 0
        for batch in small(batches):
            ids = [np.concatenate((x, closing)) for x in bpe.encode(batch.column(1).to_pylist())]
            n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            starts = upto + np.cumsum(n) - n
            upto += int(n.sum())
            yield pa.record_batch(
                [batch.column(0), pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(starts), pa.array(n), pa.array([x.astype("<u4").tobytes() for x in ids], type=pa.binary())],
                names=["doc_id", "part", "local_start", "doc_tokens", "ids"],
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, part int, local_start long, doc_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str, pattern: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """The pieces (see PIECES) of all documents: sequence ``sequence_id`` holds, from ``offset`` on,
    the ids ``start`` .. ``start + length`` of a document. ``opens`` and ``closes`` are the boundary
    records: whether the piece holds its document's first and last id. Only the last sequence of all
    is shorter than ``length``."""
    tokens = written(encoded(docs, tokenizer, pattern, end_id), "pack-ids")
    totals = {r.part: r.n for r in tokens.groupBy("part").agg(F.max(F.col("local_start") + F.col("doc_tokens")).alias("n")).collect()}
    bases, upto = {}, 0
    for part in sorted(totals):
        bases[part], upto = upto, upto + totals[part]
    shared = docs.sparkSession.sparkContext.broadcast(bases)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        base = shared.value
        for batch in small(batches):
            n = batch.column(3).to_numpy()
            begin = np.array([base[p] for p in batch.column(1).to_pylist()], dtype=np.int64) + batch.column(2).to_numpy()
            first, pieces = begin // length, (begin + n - 1) // length - begin // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            window = first[row] + nth
            left = np.maximum(window * length, begin[row])
            right = np.minimum((window + 1) * length, (begin + n)[row])
            start = left - begin[row]
            raw = batch.column(4).to_pylist()
            ids = [raw[r][4 * s : 4 * (s + k)] for r, s, k in zip(row.tolist(), start.tolist(), (right - left).tolist(), strict=True)]
            yield pa.record_batch(
                [batch.column(0).take(pa.array(row)), *map(pa.array, (start, right - left, n[row], window, left - window * length)), pa.array(ids, type=pa.binary()), pa.array(nth == 0), pa.array(nth == pieces[row] - 1)],
                names=[x.split()[0] for x in PIECES.split(", ")],
            )

    return tokens.select("doc_id", "part", "local_start", "doc_tokens", "ids").mapInArrow(cut, PIECES)


def sequences(pieces: DataFrame, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """sequence_id, tokens, ids (``length`` ids, padded), cu_seqlens: each group holds one window."""
    def build(key, pieces):  # noqa: ANN001, ANN202
        pieces = pieces.sort_values("offset")
        ids = np.concatenate([np.frombuffer(x, dtype="<u4") for x in pieces["ids"]])
        full = np.full(length, pad_id, dtype="<u4")
        full[: len(ids)] = ids
        return pieces.head(1).assign(sequence_id=key[0], tokens=len(ids), ids=full.tobytes(), cu_seqlens=[[*pieces["offset"].tolist(), len(ids)]])[["sequence_id", "tokens", "ids", "cu_seqlens"]]

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(build, "sequence_id long, tokens long, ids binary, cu_seqlens array<long>")
