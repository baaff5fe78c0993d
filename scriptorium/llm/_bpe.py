"""Batch byte-level BPE encoding.

Pre-tokens are cut for a whole batch with array operations, and each distinct pre-token is
encoded once per Python worker; a document's ids are then gathered from that store. Pre-tokens are told apart by two
64-bit hashes, from unrelated tables, and their lengths; a text with one that agrees in the first hash alone goes through the
tokenizer library, as do scripts whose letter classes differ between Unicode versions.
"""

from __future__ import annotations

import base64
import json
import unicodedata
from itertools import chain

import numpy as np
import tiktoken

from ._common import SpanHasher, held, ragged, slices

OTHER, LETTER, NUMBER, SPACE, ODD = 0, 1, 2, 3, 4
#: White_Space code points.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
PLAIN = 0x2100
# Fixed value: the one pre-token pattern that _cut follows.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHARS_A_SLICE = 1 << 17
MOST_KEPT = 750_000
#: Slots of the store's hash table, a power of two: more than two for each pre-token.
SLOTS = 1 << 21


def _classes() -> np.ndarray:
    out = np.full(PLAIN, ODD, dtype=np.uint8)
    for cp in [*range(0x500), *range(0x2000, 0x2070), *range(0x20A0, 0x20C0)]:
        kind = unicodedata.category(chr(cp))
        out[cp] = {"L": LETTER, "N": NUMBER}.get(kind[0], ODD if kind == "Cn" else OTHER)
    out[[s for s in SPACES if s < PLAIN]] = SPACE
    return out


def ranks_from_tiktoken(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def ranks_from_tokenizer_json(path: str) -> dict[bytes, int]:
    """Bytes to id, from a byte-level tokenizer's JSON; its merges follow the id order."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}


class BatchBPE:
    """encode(texts) gives one uint32 array of ids per text (null text: no ids)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if pattern != PATTERN:
            raise ValueError("pre-tokens are cut by one pattern only (see PATTERN)")
        self.encoding = tiktoken.Encoding("batch", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.classes, self.hasher, self.second = _classes(), SpanHasher(PLAIN), SpanHasher(PLAIN, seed=20240607)
        self._forget()
        size = max(ranks.values()) + 1
        self.token_bytes = np.zeros(size, dtype=np.int64)
        self.pieces = [b""] * size
        for piece, i in ranks.items():
            self.token_bytes[i] = len(piece)
            self.pieces[i] = piece
        self.widths = self.token_bytes.tolist()

    def _forget(self, coming: int = 0) -> None:
        """Empty the store; a text of very many pre-tokens has a larger table."""
        self.kept = self.used = 0
        self.slots = np.full(max(SLOTS, 1 << (2 * coming).bit_length()), -1, dtype=np.int32)
        self.keys, self.checks = np.zeros(1024, dtype=np.uint64), np.zeros(1024, dtype=np.uint64)
        self.at, self.n = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.flat = np.zeros(4096, dtype=np.uint32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for a, b in slices((len(t or "") for t in texts), CHARS_A_SLICE):
            out += self._slice([t or "" for t in texts[a:b]])
        return out

    def _slice(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        first = np.cumsum(lengths) - lengths
        cp = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        kind = np.where(cp < PLAIN, self.classes[np.minimum(cp, PLAIN - 1)], ODD)
        if (odd := np.flatnonzero(kind == ODD)).size:
            owner = np.unique(np.searchsorted(first, odd, side="right") - 1)
            owner = {int(i) for i in owner}
            plain = [i for i in range(len(texts)) if i not in owner]
            out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
            for i, ids in zip(plain, self._slice([texts[i] for i in plain]) if plain else [], strict=True):
                out[i] = ids
            for i in owner:
                out[i] = np.array(self.encoding.encode_ordinary(texts[i]), dtype=np.uint32)
            return out
        if not len(cp):
            return [np.zeros(0, dtype=np.uint32) for _ in texts]
        start = self._cut(cp, kind, first[lengths > 0])
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(cp))
        check = self.second.spans(cp, begin, end) ^ (end - begin).astype(np.uint64)
        row = self._look_up(joined, self.hasher.spans(cp, begin, end), check, begin, end)
        ids = self.flat[ragged(self.at[row], self.n[row])]
        upto = np.concatenate(([0], np.cumsum(self.n[row])))
        cuts = upto[np.searchsorted(begin, np.append(first, len(cp)))]
        out = [ids[cuts[i] : cuts[i + 1]] for i in range(len(texts))]
        for i in set((np.searchsorted(first, begin[self.checks[row] != check], side="right") - 1).tolist()):
            out[i] = np.array(self.encoding.encode_ordinary(texts[i]), dtype=np.uint32)
        return out

    @staticmethod
    def _cut(cp: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
        """True where a pre-token starts."""
        start = np.empty(len(cp), dtype=bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start[first] = True
        opens = np.zeros(len(cp), dtype=bool)
        opens[first] = True
        # The last blank before a word stands alone, and a simple space joins the word.
        after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~opens[1:]) + 1
        start[after - 1] = True
        joined = after[cp[after - 1] == 32]
        start[joined] = False
        # Contractions, where an apostrophe opens a pre-token.
        for i in np.flatnonzero((cp == 39) & start):
            tail = cp[i + 1 : i + 3]
            if not len(tail) or opens[i + 1]:
                continue
            if chr(tail[0]) in "stmd":
                size = 1
            elif len(tail) == 2 and not opens[i + 2] and "".join(map(chr, tail)) in ("re", "ve", "ll"):
                size = 2
            else:
                continue
            start[i + 1 : i + 1 + size] = False
            start[i + 1 + size : i + 2 + size] = True
        return start

    def _look_up(self, joined: str, hashes: np.ndarray, check: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Row of each pre-token in the store; encodes what isn't there yet."""
        row = self._find(hashes)
        if (missing := np.flatnonzero(row < 0)).size:
            new, where = np.unique(hashes[missing], return_index=True)
            if self.kept + len(new) > MOST_KEPT:
                missing = np.arange(len(hashes))
                new, where = np.unique(hashes, return_index=True)
                self._forget(len(new))
            where = missing[where]
            words = [joined[a:b] for a, b in zip(begin[where].tolist(), end[where].tolist(), strict=True)]
            encoded = [self.encoding._core_bpe.encode_single_piece(w.encode()) for w in words]
            n = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
            ids = np.fromiter(chain.from_iterable(encoded), dtype=np.uint32, count=int(n.sum()))
            old, self.kept = self.kept, self.kept + len(new)
            self.keys, self.checks, self.at, self.n = (_added(x, old, more) for x, more in ((self.keys, new), (self.checks, check[where]), (self.at, self.used + np.cumsum(n) - n), (self.n, n)))
            self.flat, self.used = _added(self.flat, self.used, ids), self.used + len(ids)
            self._enter(new, np.arange(old, self.kept, dtype=np.int32))
            row[missing] = self._find(hashes[missing])
        return row

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash in the store, -1 where it has none: a hash is in the first slot after its own that is free of others."""
        last = len(self.slots) - 1
        slot = (hashes & np.uint64(last)).astype(np.int64)
        row = self.slots[slot]
        other = np.flatnonzero((self.keys[row] != hashes) & (row >= 0))
        while other.size:
            slot[other] = (slot[other] + 1) & last
            row[other] = self.slots[slot[other]]
            other = other[(self.keys[row[other]] != hashes[other]) & (row[other] >= 0)]
        return row

    def _enter(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        """Slots for hashes that have none; of several that want one, one gets it and the others go on."""
        last = len(self.slots) - 1
        slot = (hashes & np.uint64(last)).astype(np.int64)
        while rows.size:
            free = self.slots[slot] < 0
            self.slots[slot[free]] = rows[free]
            left = self.slots[slot] != rows
            slot, rows = (slot[left] + 1) & last, rows[left]


def _added(store: np.ndarray, upto: int, more: np.ndarray) -> np.ndarray:
    """``store`` with ``more`` from ``upto`` on; it doubles when it is full, so that it is seldom copied."""
    if upto + len(more) > len(store):
        store = np.concatenate((store[:upto], np.zeros(max(upto, 2 * len(more)), dtype=store.dtype)))
    store[upto : upto + len(more)] = more
    return store


def encoder(path: str, pattern: str) -> BatchBPE:
    """One per Python worker, for the file and pattern of its current stage."""
    load = ranks_from_tokenizer_json if path.endswith(".json") else ranks_from_tiktoken
    return held((path, pattern), lambda: BatchBPE(load(path), pattern))
