"""Token counts of sections: each document is encoded once as a whole, and its tokens' spans are
interval-joined to the spans of its sections.

A section is a line with its line break, so that sections cover the text. A token that crosses a
boundary goes to one section by a rule: ``start`` (default), the section of its first byte, or
``majority``, the section that holds most of its bytes, ties to the earlier one.

Cases: null and empty texts have one empty section; a document's counts always add up to its number
of tokens; empty lines are sections of their own; equal documents are counted alike; null document
ids are kept; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import encoder
from ._common import id_and_text, small

RULES = ("start", "majority")
COUNTS = "doc_id long, section int, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"


def allot(widths: np.ndarray, sizes: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and those of them that cross a boundary, by section; ``widths`` and ``sizes`` are the
    tokens' and sections' lengths in bytes and have the same sum."""
    ends = np.cumsum(sizes)
    right = np.cumsum(widths)
    left = right - widths
    first = np.searchsorted(ends, left, side="right")
    last = np.searchsorted(ends, right - 1, side="right")
    owner = first
    crossing = last > first
    if rule == "majority":
        owner = first.copy()
        for t in np.flatnonzero(crossing):
            k = np.arange(first[t], last[t] + 1)
            held = np.minimum(ends[k], right[t]) - np.maximum(ends[k] - sizes[k], left[t])
            owner[t] = k[np.argmax(held)]
    n = len(sizes)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def attribute(docs: DataFrame, tokenizer: str, pattern: str, rule: str = "start") -> DataFrame:
    """One row per document and section (see COUNTS); char_start and char_end count characters."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer, pattern)
        for some in small(batches):
            if some.num_rows:
                texts = [t or "" for t in some.column(1).to_pylist()]
                rows, chars, tokens, crossing = [], [], [], []
                for text, ids in zip(texts, bpe.encode(texts), strict=True):
                    lines = text.split("\n")
                    own = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines)) + 1
                    own[-1] -= 1
                    sizes = own if text.isascii() else np.fromiter((len(x.encode()) for x in lines), dtype=np.int64, count=len(lines)) + 1
                    if sizes is not own:
                        sizes[-1] -= 1
                    counts = allot(bpe.token_bytes[ids], sizes, rule)
                    rows.append(len(lines))
                    chars.append(own)
                    tokens.append(counts[0])
                    crossing.append(counts[1])
                n = np.array(rows)
                doc = np.repeat(np.arange(len(n)), n)
                length = np.concatenate(chars)
                upto = np.cumsum(length)
                begin = upto - length
                begin -= np.repeat(begin[np.cumsum(n) - n], n)
                whole = np.array([int(x.sum()) for x in tokens], dtype=np.int64)
                section = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.record_batch(
                    [some.column(0).take(pa.array(doc)), pa.array(section.astype(np.int32)), pa.array(begin), pa.array(begin + length), pa.array(np.concatenate(tokens)), pa.array(np.concatenate(crossing)), pa.array(whole[doc])],
                    names=[x.split()[0] for x in COUNTS.split(", ")],
                )

    return id_and_text(docs).mapInArrow(run, COUNTS)
