"""Exact top-k inner-product search by no-random-access aggregation over sorted lists.

Candidates are cut into blocks. In a block, each dimension is a list sorted by value, built once. A query reads it
from the top where its own component is positive and from the bottom where it is negative, a step of entries at a time, and deeper in
the lists that matter more to it: by its component's size times the list's spread. What it has read gives each candidate seen
a lower bound (components not read are at the list's far end) and an upper bound (they are where the reading has come to). A candidate
never seen is bounded by the sum of the places the reading has come to. Candidates whose upper bound is below the k-th best lower bound,
which includes the k best of earlier blocks, are closed for good. When that sum falls below it no outsider can
qualify, and reading stops as soon as few candidates are open; only these are resolved to final scores. Where the bounds don't close
the lists are read to their end, which is the final score, so results are exact for any data.

Queries whose lists pull about evenly gain little from depths of their own: they read together, every list as deep for all of them, so
that a block's entries are read once for many queries, and stop each by its own bounds.

Blocks of queries meet blocks of candidates by an equi-join on block numbers; each group of candidate
blocks passes on k rows a query. Nothing is broadcast.

Cases: vectors that are null, or hold null or non-finite components, take no part, as do rows without an id; vectors of
different lengths only meet their own length; ties go to the smaller id; repeated rows with one id take
part once each as candidates, never as their own query's; empty vectors score 0; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import ragged

BLOCK = 2048
QUERY_BLOCK = 1024
#: Blocks of queries whose results a task keeps at a time.
HELD = 32
#: Steps in which all lists would be read to their end.
STEPS = 12
#: Open candidates, for each of the k, at which reading stops and final scores are resolved.
RESOLVED = 6
#: Evenness of a query's lists from which on it reads together with others, and how many queries do.
EVEN, TOGETHER = 0.4, 512
PACKED = "block long, dims int, ids binary, data binary"


def packed(vectors: DataFrame, size: int, scale: float) -> DataFrame:
    """Blocks of at most ``size`` vectors (vec_id, embedding) of one length, with components floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held = TaskContext.get().partitionId() << 32, {}
        count = 0

        def flush(dims: int) -> pa.RecordBatch:
            nonlocal count
            rows = held.pop(dims)
            ids, data = np.array([i for i, _ in rows], dtype=np.int64), np.array([v for _, v in rows], dtype=np.float64).reshape(len(rows), dims)
            count += 1
            return pa.RecordBatch.from_pylist([{"block": base + count, "dims": dims, "ids": ids.tobytes(), "data": np.floor(scale * data).tobytes()}], schema=pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())]))

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= size:
                    yield flush(len(v))
        for dims in list(held):
            yield flush(dims)

    return vectors.mapInArrow(run, PACKED)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.k = k
        #: Of each query: list entries read, candidates resolved, list entries there are.
        self.read = np.zeros((queries, 3), dtype=np.int64)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate((self.score[q], scores)), np.concatenate((self.id[q], ids))
        order = np.lexsort((i, -s))[: self.k]
        self.score[q], self.id[q] = s[order], i[order]


class Lists:
    """The sorted lists of a block: of each dimension the candidates' rows and values, the largest first."""

    def __init__(self, x: np.ndarray):
        self.x, (self.n, self.dims) = x, x.shape
        rows = np.argsort(-x, axis=0, kind="stable").T
        self.rows = np.ascontiguousarray(rows).ravel()
        self.values = np.take_along_axis(x.T, rows, axis=1).ravel()


UNSEEN, OPEN, CLOSED = 0, 1, 2


def search(lists: Lists, query: np.ndarray, out: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(rows that may be among the k best, their scores, entries read, candidates resolved). Rows that are ``out`` take no part,
    nor do scores below ``floor``."""
    n, use = lists.n, np.flatnonzero(query)
    weight = query[use]
    forward = np.where(weight > 0, 1, -1)
    begin = use * n + np.where(weight > 0, 0, n - 1)
    front = weight * lists.values[begin]
    far = weight * lists.values[begin + forward * (n - 1)]
    pull = front - far
    depth = np.zeros(len(use), dtype=np.int64)
    known = np.zeros(n)
    seen = np.zeros((n, len(use)))
    state = np.where(out, CLOSED, UNSEEN).astype(np.uint8)
    open_ = np.zeros(0, dtype=np.int64)
    outsiders = True
    step = n * len(use) / STEPS
    read = 0
    while True:
        left = np.where(pull > 0, n - depth, 0)
        if not left.any():  # what is not read is the same for all
            rows = np.flatnonzero(state < CLOSED) if outsiders else open_
            return rows, known[rows] + front.sum() - seen[rows] @ front, read, 0
        share = np.where(left > 0, pull, 0)
        take = np.minimum(left, np.ceil(step * share / share.sum()).astype(np.int64))
        read += int(take.sum())
        column = np.repeat(np.arange(len(use)), take)
        at = ragged(np.zeros(len(use), dtype=np.int64), take) * forward[column] + (begin + forward * depth)[column]
        row = lists.rows[at]
        fits = state[row] < CLOSED if outsiders else state[row] == OPEN
        row, column, value = row[fits], column[fits], lists.values[at[fits]]
        known += np.bincount(row, weights=weight[column] * value, minlength=n)
        seen[row, column] = 1
        depth += take
        moved = take > 0
        front[moved] = weight[moved] * lists.values[(begin + forward * (depth - 1))[moved]]
        if outsiders:
            state[row] = OPEN
            open_ = np.flatnonzero(state == OPEN)
        bounds = seen[open_] @ np.stack((front, far), axis=1)
        upper, lower = known[open_] + front.sum() - bounds[:, 0], known[open_] + far.sum() - bounds[:, 1]
        if len(open_) >= k:
            floor = max(floor, float(np.partition(lower, len(open_) - k)[len(open_) - k]))
        gone = upper < floor
        state[open_[gone]] = CLOSED
        open_ = open_[~gone]
        outsiders = outsiders and front.sum() >= floor
        if not outsiders and len(open_) <= RESOLVED * k:
            return open_, lists.x[open_] @ query, read, len(open_)


def evenness(lists: Lists, queries: np.ndarray) -> np.ndarray:
    """Of each query, how evenly its lists pull: 1 where all pull alike, 1 / dims where one does; 0 where none does."""
    pull = np.abs(queries) * spreads(lists)
    squares = pull.shape[1] * (pull**2).sum(axis=1)
    return np.where(squares > 0, pull.sum(axis=1) ** 2 / np.where(squares > 0, squares, 1), 0)


def spreads(lists: Lists) -> np.ndarray:
    values = lists.values.reshape(lists.dims, lists.n)
    return values[:, 0] - values[:, -1]


def search_together(lists: Lists, queries: np.ndarray, out: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]:
    """(query, and what search gives of it) of each of ``queries``, which read the lists in step: every list as deep from the top, for positive
    components, as from the bottom, for negative ones. What is read is kept once for all of them, and all bounds of a step are two products of
    matrices; a query stops as soon as its own bounds close. ``out`` has a row for each query."""
    n, d = lists.n, lists.dims
    values, order, spread = lists.values.reshape(d, n), lists.rows.reshape(d, n), spreads(lists)
    # Integers below 2 ** 24 are exact in single precision, in whatever order they are added up.
    whole = np.abs(queries).max(axis=0) @ np.abs(values[:, [0, -1]]).max(axis=1) < 2**24
    kind = np.float32 if whole and (queries == np.floor(queries)).all() and (values == np.floor(values)).all() else np.float64
    both = np.concatenate((np.maximum(queries, 0), np.minimum(queries, 0)), axis=1).astype(kind)
    front = np.concatenate((values[:, 0], values[:, -1])).astype(kind)
    far = np.concatenate((front[d:], front[:d]))
    high, low, unread = np.tile(front, (n, 1)), np.tile(far, (n, 1)), np.ones((n, 2 * d), dtype=bool)
    weight = np.abs(queries)
    weight = weight / (weight @ spread)[:, None]
    depth, alive, floor, step = np.zeros(d, dtype=np.int64), np.arange(len(queries)), floors.astype(np.float64), n * d / STEPS
    bounded = np.isfinite(floor)
    while len(alive):
        share = np.where(depth < n, weight[alive].mean(axis=0) * spread, 0)
        if not share.any():  # what is not read is the same for all
            scores = both[alive] @ high.T
            for a, q in enumerate(alive.tolist()):
                rows = np.flatnonzero(~out[q])
                yield q, rows, scores[a, rows].astype(np.float64), int(depth[queries[q] != 0].sum()), 0
            return
        take = np.minimum(n - depth, np.ceil(step * share / share.sum()).astype(np.int64))
        column, place = np.repeat(np.arange(d), take), ragged(depth, take)
        for at, to in ((place, column), (n - 1 - place, column + d)):
            rows = order[column, at]
            high[rows, to] = low[rows, to] = values[column, at]
            unread[rows, to] = False
        depth += take
        at = np.maximum(depth, 1) - 1
        front = np.concatenate((values[np.arange(d), at], values[np.arange(d), n - 1 - at])).astype(kind)
        np.copyto(high, front, where=unread)
        # A floor of earlier blocks is seldom raised before the bounds close, and one that isn't raised holds as well.
        raising = np.flatnonzero(~bounded[alive])
        if len(raising) and n >= k:
            lower = both[alive[raising]] @ low.T
            lower[out[alive[raising]]] = -np.inf
            floor[alive[raising]] = np.maximum(floor[alive[raising]], np.partition(lower, n - k, axis=1)[:, n - k])
        own = floor[alive]
        open_ = both[alive] @ high.T >= own[:, None]
        open_ &= ~out[alive]
        done = (open_.sum(axis=1) <= RESOLVED * k) & (both[alive] @ front < own)
        for a in np.flatnonzero(done).tolist():
            q, rows = int(alive[a]), np.flatnonzero(open_[a])
            yield q, rows, lists.x[rows] @ queries[q], int(depth[queries[q] != 0].sum()), len(rows)
        alive = alive[~done]


def search_block(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Merge a block's candidates into ``best``, with the entries that were read. Queries whose lists pull evenly read them together, others
    each to its own depths."""
    if not len(x):
        return
    lists = Lists(x)
    even = evenness(lists, queries) >= EVEN
    for lo in range(0, len(queries), TOGETHER):
        some = lo + np.flatnonzero(even[lo : lo + TOGETHER])
        if len(some):
            for q, rows, scores, read, resolved in search_together(lists, queries[some], query_ids[some][:, None] == ids, best.score[some, -1], best.k):
                best.add(some[q], scores, ids[rows])
                best.read[some[q]] += (read, resolved, x.size)
    for i in np.flatnonzero(~even).tolist():
        rows, scores, read, resolved = search(lists, queries[i], ids == query_ids[i], best.score[i, -1], best.k)
        best.add(i, scores, ids[rows])
        best.read[i] += (read, resolved, x.size)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows; read_share and resolved tell of the query which share of the
    lists' entries it read and how many candidates were resolved. Queries are rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    e = F.col("embedding").cast("array<double>")
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    asked = usable.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n = asked.count()
    blocks = max(1, -(-n // query_block))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    queries = packed(asked.repartition(blocks, "vec_id"), query_block, scale)
    candidates = packed(usable, block, scale)
    groups = max(width, 1)
    meeting = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")
    left = candidates.withColumn("grp", meeting)
    # Every candidate block goes once to each block of queries: the rows sent are candidates times query blocks.
    right = queries.select(F.col("block").alias("q_block"), "dims", F.col("ids").alias("q_ids"), F.col("data").alias("q_data")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = left.hint("merge").join(right, ["grp", "dims"]).select("q_block", "block", "dims", "ids", "data", "q_ids", "q_data")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray, Best]] = {}

        def results() -> Iterator[pd.DataFrame]:
            for q_ids, _, best in held.values():
                row, col = np.nonzero(best.score > -np.inf)
                told = np.where((col == 0)[:, None], best.read[row], 0)
                yield pd.DataFrame({"query_id": q_ids[row], "vec_id": best.id[row, col], "score": best.score[row, col].astype(np.int64), "read": told[:, 0], "resolved": told[:, 1], "entries": told[:, 2]})
            held.clear()

        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.q_block not in held:
                    if len(held) >= HELD:
                        yield from results()
                    ids = np.frombuffer(r.q_ids, dtype=np.int64)
                    held[r.q_block] = ids, np.frombuffer(r.q_data).reshape(len(ids), r.dims), Best(len(ids), k)
                q_ids, q, best = held[r.q_block]
                ids = np.frombuffer(r.ids, dtype=np.int64)
                search_block(q, q_ids, np.frombuffer(r.data).reshape(len(ids), r.dims), ids, best)
        yield from results()

    found = pairs.mapInPandas(run, "query_id long, vec_id long, score long, read long, resolved long, entries long")
    of = Window.partitionBy("query_id")
    ranked = found.withColumn("rank", F.row_number().over(of.orderBy(F.desc("score"), "vec_id")).cast("int"))
    ranked = ranked.withColumns({"read_share": F.coalesce(F.try_divide(F.sum("read").over(of), F.sum("entries").over(of)), F.lit(0.0)), "resolved": F.sum("resolved").over(of)})
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "read_share", "resolved")
