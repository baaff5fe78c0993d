"""Near-duplicate vectors by an inverted multi-index.

Vectors are scaled to unit length and cut in halves, and each half has its own codebook of k-means centres,
fitted on a bounded sample. Pairs of centres are the cells of a product grid, in which every vector is stored.
A vector visits cells in the order of its distance to them (the squared distances to the bisecting
planes of both halves, summed): both halves' sequences are walked by a heap of cells whose neighbours have been visited. It stops
beyond a reach. The reach is set on the sample:
vectors are moved in random directions to exactly the threshold's similarity, and the reach is what finds the
cell of the ``recall`` share of them. Pairs met in a cell are verified by their cosine in double precision.

Equal vectors are one class with a weight. Of two cells only the lower one's vectors visit the other, so a
pair is met once. Cells of any size are met in blocks of bounded size, and a block passes on counts
and a spanning forest, never its pairs.

Cases: vectors that are null, zero or hold null or non-finite components, and rows without a label or
an id, link with nothing and are their own component; vectors of different lengths don't link; repeated
rows of one vector link with one another (n_links counts rows); an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, held, joined_by_group, written
from ._graph import Union, components

#: Vectors the codebooks are fitted on: at least, for each centre, and at most.
SAMPLE, SAMPLE_EACH, MOST_SAMPLE = 8192, 32, 131_072
#: Vectors a cell of one label should hold, about; and centres of a half, at most (16 million cells a label).
OCCUPANCY, MOST_CENTRES = 24, 4096
MEMBERS, VISITORS = 1024, 2048
#: Rows that one call compares.
ROWS_A_CALL = 16384
#: Components whose smallest ids are broadcast, at most; above that a salted join takes over.
BROADCAST_COMPONENTS = 200_000
SALTS = 16


@dataclass
class Index:
    dims: int
    first: np.ndarray
    second: np.ndarray
    reach: float

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to each centre's region, by the plane halfway to it, for both halves."""
        cut = self.dims // 2
        return _planes(x[:, :cut], self.first), _planes(x[:, cut:], self.second)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home cell of each row, row of each visit, cell of each visit), cells not below the home cell."""
        a, b = self.halves(x)
        n2 = len(self.second)
        home = a.argmin(1) * n2 + b.argmin(1)
        rows, cells = [], []
        for r in range(len(x)):
            for i, j in multi_sequence(a[r], b[r], self.reach):
                if (c := i * n2 + j) >= home[r]:
                    rows.append(r)
                    cells.append(c)
        return home, np.array(rows, dtype=np.int64), np.array(cells, dtype=np.int64)


def multi_sequence(a: np.ndarray, b: np.ndarray, reach: float) -> Iterator[tuple[int, int]]:
    """Grid cells (i, j) by ascending a[i] + b[j], up to ``reach``. A cell joins the heap when those before it in its row and in its
    column have been visited, so the heap holds one cell a row at most."""
    near_a, near_b = np.flatnonzero(a <= reach), np.flatnonzero(b <= reach)
    left, right = near_a[np.argsort(a[near_a], kind="stable")], near_b[np.argsort(b[near_b], kind="stable")]
    sa, sb = a[left].tolist(), b[right].tolist()
    heap = [(sa[0] + sb[0], 0, 0)] if sa and sb else []
    upto = [0] * len(sa)  # how many cells of each row have been visited
    while heap:
        distance, p, q = heappop(heap)
        if distance > reach:
            return
        yield int(left[p]), int(right[q])
        upto[p] = q + 1
        if q + 1 < len(sb) and (p == 0 or upto[p - 1] > q + 1):
            heappush(heap, (sa[p] + sb[q + 1], p, q + 1))
        if p + 1 < len(sa) and upto[p + 1] == q:
            heappush(heap, (sa[p + 1] + sb[q], p + 1, q))


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)


def _planes(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = _squares(x, centres)
    own = d.argmin(1)
    apart = np.sqrt(np.maximum(_squares(centres, centres), 1e-12))
    h = np.maximum(d - d[np.arange(len(x)), own][:, None], 0) / (2 * apart[own])
    h[np.arange(len(x)), own] = 0
    return h**2


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 10) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        own = np.concatenate([_squares(x[lo : lo + 4096], centres).argmin(1) for lo in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit(sample: np.ndarray, centres: int, similarity: float, recall: float, seed: int = 11) -> Index:
    """Codebooks and reach from unit vectors."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    cut = dims // 2
    index = Index(dims, _k_means(sample[:, :cut], centres, rng), _k_means(sample[:, cut:], centres, rng), 0.0)
    x = sample[rng.choice(len(sample), min(4096, len(sample)), replace=False)]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    moved = similarity * x + np.sqrt(1 - similarity**2) * z
    a, b = index.halves(x)
    to_a, to_b = index.halves(moved)
    at = np.arange(len(x))
    index.reach = float(np.quantile(a[at, to_a.argmin(1)] + b[at, to_b.argmin(1)], recall, method="higher"))
    return index


def _linked(q: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    s = q @ m.T
    out = s >= similarity
    for i, j in zip(*np.nonzero(np.abs(s - similarity) < 1e-9), strict=True):
        out[i, j] = q[i] @ m[j] / np.sqrt((q[i] @ q[i]) * (m[j] @ m[j])) >= similarity
    return out


def _compare(frame: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Counts of links and a spanning forest of the blocks in ``frame``."""
    held(None)
    out = []
    for _, block in frame.groupby(["label", "dims", "cell", "qb", "mb"], sort=True):
        q, m = block[block["visit"]], block[~block["visit"]]
        if not len(q) or not len(m):
            continue
        x, y = (np.stack([np.frombuffer(v) for v in part["unit"]]) for part in (q, m))
        link = _linked(x, y, similarity)
        same = q["home"].to_numpy()[:, None] == m["home"].to_numpy()[None, :]
        link &= ~same | (q["cls"].to_numpy()[:, None] < m["cls"].to_numpy()[None, :])
        i, j = np.nonzero(link)
        if not len(i):
            continue
        ids, where = np.unique(np.concatenate((q["cls"].to_numpy(), m["cls"].to_numpy())), return_inverse=True)
        qi, mi = where[: len(q)], where[len(q) :]
        counts = np.bincount(qi[i], weights=m["weight"].to_numpy()[j], minlength=len(ids)) + np.bincount(mi[j], weights=q["weight"].to_numpy()[i], minlength=len(ids))
        forest = Union(len(ids))
        for r in np.flatnonzero(link.any(1)):
            for c in np.unique(mi[link[r]]):
                forest.join(int(qi[r]), int(c))
        has = np.flatnonzero(counts)
        out.append(pd.DataFrame({"cls": ids[has], "links": counts[has].astype(np.int64), "root": ids[forest.roots()[has]]}))
    return pd.concat(out) if out else pd.DataFrame({"cls": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})


def near_duplicates(vectors: DataFrame, similarity: float = 0.98, recall: float = 0.995) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"), F.col("label").cast("string").alias("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    keyed = rows.withColumn("h1", F.when(good, F.xxhash64("label", "embedding"))).withColumn("h2", F.when(good, F.hash("label", "embedding")))
    classes = written(keyed.where(F.col("h1").isNotNull()).groupBy("h1", "h2").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"), F.first("label").alias("label")).withColumn("cls", F.monotonically_increasing_id()), "classes")
    bound_batches(spark)
    lengths = classes.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).collect()
    indexes: dict[int, Index] = {}
    for r in sorted(lengths):
        if r.dims < 2:
            indexes[r.dims] = Index(r.dims, np.zeros((1, r.dims // 2)), np.zeros((1, r.dims - r.dims // 2)), np.inf)
            continue
        centres = int(np.clip(np.ceil(np.sqrt(r.n / max(1, r.labels) / OCCUPANCY)), 1, MOST_CENTRES))
        sample = classes.where(F.size("embedding") == r.dims).orderBy(F.xxhash64("low"), "low", "h1", "h2").limit(min(MOST_SAMPLE, max(SAMPLE, SAMPLE_EACH * centres))).select("embedding").toPandas()["embedding"]
        x = np.stack(sample.to_list())
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        indexes[r.dims] = fit(x, centres, similarity, recall)
    shared = spark.sparkContext.broadcast(indexes)

    def index_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held(None)
        for frame in frames:
            for dims, own in frame.groupby(frame["embedding"].map(len)):
                x = np.stack(own["embedding"].to_list()).astype(float)
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                home, row, cell = shared.value[dims].visits(x)
                unit = np.array([v.tobytes() for v in x], dtype=object)
                base = own[["cls", "weight", "label"]].assign(dims=np.int32(dims), home=home, unit=unit)
                yield pd.concat((base.iloc[row].assign(cell=cell, visit=True), base.assign(cell=home, visit=False)))

    stored = written(classes.select("cls", "weight", "label", "embedding").mapInPandas(index_rows, "cls long, weight long, label string, dims int, home long, unit binary, cell long, visit boolean"), "cells")
    key = ["label", "dims", "cell"]
    sizes = stored.groupBy(*key).agg(F.ceil(F.count_if("visit") / VISITORS).cast("int").alias("qn"), F.ceil(F.count_if(~F.col("visit")) / MEMBERS).cast("int").alias("mn"), F.count("*").alias("n")).where("qn > 0 and mn > 0 and n > 2")
    sizes = written(sizes, "cell-sizes")
    total = sizes.agg(F.sum(F.col("n") * F.greatest("qn", "mn"))).first()[0] or 0
    calls = max(1, -(-int(total) // ROWS_A_CALL))
    split = stored.join(sizes, key).withColumns({"own_q": F.pmod(F.xxhash64("cls"), F.col("qn")).cast("int"), "own_m": F.pmod(F.xxhash64("cls", F.lit(1)), F.col("mn")).cast("int")})
    blocks = split.withColumn("qb", F.explode(F.when(F.col("visit"), F.array("own_q")).otherwise(F.sequence(F.lit(0), F.col("qn") - 1))))
    blocks = blocks.withColumn("mb", F.explode(F.when(F.col("visit"), F.sequence(F.lit(0), F.col("mn") - 1)).otherwise(F.array("own_m"))))
    blocks = blocks.withColumn("call", F.pmod(F.xxhash64(*key, "qb", "mb"), F.lit(calls)))
    found = written(blocks.select("call", *key, "qb", "mb", "cls", "weight", "home", "visit", "unit").groupBy("call").applyInPandas(lambda f: _compare(f, similarity), "cls long, links long, root long"), "links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    whole = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    linked = written(classes.select("h1", "h2", "cls", "low", "weight").join(links, "cls", "left").join(whole.withColumnRenamed("id", "cls"), "cls", "left"), "linked")
    lowest = written(linked.where("component is not null").groupBy("component").agg(F.min("low").alias("lowest")), "lowest")
    if lowest.count() <= BROADCAST_COMPONENTS:
        named = linked.join(F.broadcast(lowest), "component", "left")
    else:
        salted = lowest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        named = linked.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).join(salted, ["component", "salt"], "left")
    done = named.select(F.struct("h1", "h2").alias("h"), "weight", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("lowest", "low").alias("component_id"))
    usable, rest = keyed.where("h1 is not null").select("vec_id", F.struct("h1", "h2").alias("h")), keyed.where("h1 is null").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    out = joined_by_group(usable, done, "h", "weight", rows.count()).drop("h").unionByName(rest)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
