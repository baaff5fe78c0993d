"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A text is halved until its parts are short (LEAF_CHARS, well below a usual text's length), the parts are encoded, and neighbours are
joined up the tree, level by level for all texts of a batch. Joining encodes a window around the seam anew. The window grows on either side until it
starts and ends at a stable place: a white-space character right after another character. No
pre-token of the pattern reaches over such a place from the left (white space never follows another
character within a match, and the pattern's only look-ahead stands behind white space), and the
pattern has no look-behind, so all tokens outside the window are those of the whole text. Where a
side has no such place the window covers that side. Decoding concatenates bytes up the tree.

Cases: null and empty texts have no ids and decode to no bytes; equal texts give equal ids; an empty
table gives no rows; null document ids are kept; a text without white space is encoded whole at its
top join; texts with special-token strings are ordinary text; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import SPACES, BatchBPE, encoder
from ._common import id_and_text, small

LEAF_CHARS = 256
LEAF_IDS = 128
BLANK = frozenset(map(chr, SPACES))


Span = tuple[int, int, int]


def levels(sizes: list[int], leaf: int) -> list[list[Span]]:
    """The nodes (text, from, to) of all texts' trees, from the roots down; nodes of more than ``leaf`` characters are halved."""
    out, level = [], [(t, 0, n) for t, n in enumerate(sizes)]
    while level:
        out.append(level)
        level = [half for t, lo, hi in level if hi - lo > leaf for half in ((t, lo, (lo + hi) // 2), (t, (lo + hi) // 2, hi))]
    return out


def stable_before(text: str, lo: int, seam: int) -> int:
    """The last stable place in (lo, seam], else lo."""
    window, p = 32, seam
    while p > lo:
        for p in range(p, max(lo, seam - window), -1):
            if p < len(text) and text[p] in BLANK and text[p - 1] not in BLANK:
                return p
        p, window = p - 1, 2 * window
    return lo


def stable_after(text: str, seam: int, hi: int) -> int:
    """The first stable place in [seam, hi), else hi. At the seam itself it must hold there too."""
    window, p = 32, seam
    while p < hi:
        for p in range(p, min(hi, seam + window)):
            if p and text[p] in BLANK and text[p - 1] not in BLANK:
                return p
        p, window = p + 1, 2 * window
    return hi


def _tail(ids: np.ndarray, size: int, widths: list[int]) -> int:
    """How many ids at the end make up ``size`` bytes."""
    k = 0
    while size > 0:
        if k == len(ids):
            break
        k += 1
        size -= widths[ids.item(len(ids) - k)]
    if size:
        raise ValueError("tokens do not meet a stable place")
    return k


def join(text: str, window: tuple[int, int, int], left: np.ndarray, middle: np.ndarray, right: np.ndarray, widths: list[int]) -> np.ndarray:
    """The ids of two neighbours together: those of the ``window`` (from, seam, to) are ``middle``, the others stay."""
    a, seam, b = window
    if a == b:
        return np.concatenate((left, right))
    cut = len(left) - _tail(left, len(text[a:seam].encode()), widths)
    skip = _tail(right[::-1], len(text[seam:b].encode()), widths)
    return np.concatenate((left[:cut], middle, right[skip:]))


def encode_all(texts: list[str], bpe: BatchBPE, leaf: int = LEAF_CHARS) -> list[np.ndarray]:
    """The ids of each text. All leaves are encoded together, and so are all windows of a level."""
    widths, nodes = bpe.widths, levels([len(t) for t in texts], leaf)
    leaves = [n for level in nodes for n in level if n[2] - n[1] <= leaf]
    done: dict[Span, np.ndarray] = dict(zip(leaves, bpe.encode([texts[t][lo:hi] for t, lo, hi in leaves]), strict=True))
    for level in reversed(nodes):
        inner = [n for n in level if n[2] - n[1] > leaf]
        windows = []
        for t, lo, hi in inner:
            mid = (lo + hi) // 2
            windows.append((stable_before(texts[t], lo, mid), mid, stable_after(texts[t], mid, hi)))
        for (t, lo, hi), window, middle in zip(inner, windows, bpe.encode([texts[n[0]][a:b] for n, (a, _, b) in zip(inner, windows, strict=True)]), strict=True):
            mid = window[1]
            done[t, lo, hi] = join(texts[t], window, done.pop((t, lo, mid)), middle, done.pop((t, mid, hi)), widths)
    return [done[t, 0, len(x)] for t, x in enumerate(texts)]


def decode(ids: np.ndarray, pieces: list[bytes], leaf: int = LEAF_IDS) -> bytes:
    if len(ids) <= leaf:
        return b"".join([pieces[i] for i in ids.tolist()])
    mid = len(ids) // 2
    return decode(ids[:mid], pieces, leaf) + decode(ids[mid:], pieces, leaf)


def encode_decode(docs: DataFrame, ranks: str, pattern: str, leaf: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32), decoded (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks, pattern)
        for some in small(batches):
            ids = encode_all([t or "" for t in some.column(1).to_pylist()], bpe, leaf)
            yield pa.record_batch(
                [some.column(0), pa.array([len(x) for x in ids], type=pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], type=pa.binary()), pa.array([decode(x, bpe.pieces) for x in ids], type=pa.binary())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
