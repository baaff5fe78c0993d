"""Words of whole texts as hashed arrays: no Python object per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ._common import MASK, SpanHasher, mix

#: ASCII white space, which ends words: space, and tab to carriage return.
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters and digits by kind, all else as it is: one symbol each.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58], SHAPE[128:] = ord("a"), ord("A"), ord("0"), ord("a")
HASHER = SpanHasher(256)


@dataclass
class Words:
    """words[k] is the hash of word k; document d has words first[d] .. first[d + 1]."""

    words: np.ndarray
    first: np.ndarray
    doc: np.ndarray
    shapes: np.ndarray | None = None


def words(texts: list[str | None], lower: bool = True, shapes: bool = False) -> Words:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1
    blank = BLANK[data]
    start = ~blank
    start[1:] &= blank[:-1]
    begin = np.flatnonzero(start)
    stop = blank.copy()
    stop[0] = False
    stop[1:] &= ~blank[:-1]
    end = np.flatnonzero(stop)
    first = np.searchsorted(begin, np.concatenate(([0], np.cumsum(sizes))))
    hashed = HASHER.spans(LOWER[data] if lower else data, begin, end)
    doc = np.repeat(np.arange(len(raw)), np.diff(first))
    out = Words(hashed, first, doc)
    if shapes:
        kind = SHAPE[data]
        keep = start.copy()
        keep[1:] |= kind[1:] != kind[:-1]
        upto = np.concatenate(([0], np.cumsum(keep)))
        out.shapes = HASHER.spans(kind[keep], upto[begin], upto[end])
    return out


def shingles(w: Words, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each document's word shingles; a document with fewer words has
    its whole sequence as its only shingle, one without words has none."""
    x, first = w.words, w.first
    with np.errstate(over="ignore"):
        n = max(0, len(x) - size + 1)
        joint = np.full(n, size, dtype=np.uint64)
        for k in range(size):
            joint = joint * np.uint64(0xD6E8FEB86659FD93) + x[k : k + n]
        joint = mix(joint)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(joint[a : b - size + 1])
            fresh = np.empty(len(own), dtype=bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            out.append(own[fresh])
        elif b > a:
            h = b - a
            for v in x[a:b].tolist():
                h = (h * 0xD6E8FEB86659FD93 + v) & MASK
            out.append(mix(np.array([h], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
