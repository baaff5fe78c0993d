"""Shared plumbing of the training-data operators: tables, shared folder, hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only a local master, whose tasks share the driver's disk, may go
    without one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="scriptorium-")
        sc.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, ``name`` where it can be."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def free_prefix(df: DataFrame, prefix: str) -> str:
    """A prefix that no column name of ``df`` begins with, ``prefix`` where it can be."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def slices(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes sum to ``limit`` at most (one item may exceed it)."""
    start = total = end = 0
    for size in sizes:
        if end > start and total + size > limit:
            yield start, end
            start, total = end, 0
        total += size
        end += 1
    if end > start:
        yield start, end


def small(batches: Iterable, rows: int = 500) -> Iterator:
    """Arrow batches of few rows, so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def by_texts(column: pa.Array, make: Callable[[list[str | None]], list], kind: pa.DataType, rows: int = 500) -> pa.Array:
    """``make`` of the texts of ``column``, a few at a time, as one array."""
    parts = [pa.array(make(column.slice(lo, rows).to_pylist()), type=kind) for lo in range(0, len(column), rows)]
    return pa.concat_arrays(parts) if parts else pa.array([], type=kind)


#: Rows and bytes of an Arrow batch of texts, at most; one text may exceed the bytes.
ARROW_ROWS, ARROW_BYTES = 500, 2 << 20


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text for a Python task. The session's Arrow batches are bounded, as a batch is held several times over: in the JVM,
    in the worker and as strings."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def bound_batches(spark: SparkSession) -> None:
    conf = "spark.sql.execution.arrow."
    spark.conf.set(conf + "maxRecordsPerBatch", str(min(int(spark.conf.get(conf + "maxRecordsPerBatch")), ARROW_ROWS)))
    spark.conf.set(conf + "maxBytesPerBatch", f"{ARROW_BYTES}b")


_held: dict[Hashable, Any] = {}
_lean = False
#: From so many bytes on, an allocation is given back to the system when it is freed.
MAPPED = 2 << 20


def _be_lean() -> None:
    """Python workers outlive stages and share an executor's memory with its JVM: have freed arrays given back."""
    global _lean
    if not _lean:
        _lean = True
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            libc = ctypes.CDLL(None)
            libc.mallopt(-3, MAPPED)  # M_MMAP_THRESHOLD, which else grows with what is freed
            libc.mallopt(-1, MAPPED)  # M_TRIM_THRESHOLD
        except (AttributeError, OSError):  # a C library without it keeps the pages
            pass


def give_back() -> None:
    """Give what is freed back to the system. The driver does so after a fit, as its Python and its JVM share a limit."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it keeps the pages
        pass


def held(key: Hashable, make: Callable[[], Any] | None = None) -> Any:
    """What ``make`` gives, kept by the Python worker for its next tasks; every task asks first. One object is kept at a time:
    asking for another, or for none, frees the last one."""
    _be_lean()
    if key not in _held:
        if _held:
            _held.clear()
            give_back()
        if make is None:
            return None
        _held[key] = make()
    return _held[key]


#: Keys that are broadcast for holding many rows, at most; and the rows a key must hold for it, at least.
MOST_HOT, LEAST_HOT = 2000, 2000


def joined_by_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` (left) with the columns of ``groups``, which has a row for each ``key`` and in ``size`` how many of the ``total`` rows have
    it. Keys of more than one in MOST_HOT of all rows, so MOST_HOT of them at most, are broadcast, and their rows are dealt
    out evenly instead of meeting in one task. Where all rows together are too few for such a key, nothing is broadcast."""
    others = [c for c in groups.columns if c not in (key, size)]
    limit = max(LEAST_HOT, total // MOST_HOT)
    hot, cold = free_prefix(rows, "_hot"), free_prefix(rows, "_cold")
    if total <= limit:
        found = groups.select(F.col(key).alias(f"{cold}_key"), F.struct(*others).alias(cold))
        return rows.join(found, F.col(key) == F.col(f"{cold}_key"), "left").select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(cold)[c].alias(c) for c in others])
    many = groups.where(F.col(size) > limit).select(F.col(key).alias(f"{hot}_key"), F.struct(*others).alias(hot))
    few = groups.where(F.col(size) <= limit).select(F.col(key).alias(f"{cold}_key"), F.lit(-1).cast("long").alias(f"{cold}_number"), F.struct(*others).alias(cold))
    marked = rows.join(F.broadcast(many), F.col(key) == F.col(f"{hot}_key"), "left")
    spread = F.col(f"{hot}_key").isNotNull() | F.col(key).isNull()
    # Rows that have what they need get a number of their own, which no group has.
    number = F.when(spread, F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("long"))
    at = F.when(~spread, F.col(key))
    both = marked.withColumns({f"{hot}_at": at, f"{hot}_number": number}).join(few, F.col(f"{hot}_at").eqNullSafe(F.col(f"{cold}_key")) & (F.col(f"{hot}_number") == F.col(f"{cold}_number")), "left")
    return both.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.coalesce(F.col(hot)[c], F.col(cold)[c]).alias(c) for c in others])


def bounded_texts(docs: DataFrame, chosen: list[tuple[int, Any]], most: int, label: Column | None = None) -> list[tuple[str, Any]]:
    """(text, label) of the ``chosen`` (doc_id, label), in that order: whole texts, of each label as many as hold ``most`` bytes.
    With a ``label`` column only rows that carry the label count. Where an id repeats, its shortest text counts, the first of equal
    ones. Null texts are left out."""
    spark, text = docs.sparkSession, F.col("text").cast("string")
    of = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).alias("size"), (F.lit("") if label is None else label.cast("string")).alias("label")).where("text is not null")
    picked = spark.createDataFrame([(i, "" if label is None else str(y), k) for k, (i, y) in enumerate(chosen)], "doc_id long, label string, place long")
    sizes = of.select("doc_id", "label", "size").join(F.broadcast(picked), ["doc_id", "label"]).groupBy("place").agg(F.min("size").alias("size")).orderBy("place").collect()
    upto, kept = dict.fromkeys((y for _, y in chosen), 0), []
    for r in sizes:
        i, y = chosen[r.place]
        if upto[y] + r["size"] <= most:
            upto[y] += r["size"]
            kept.append((i, "" if label is None else str(y), r.place, r["size"]))
    kept = spark.createDataFrame(kept, "doc_id long, label string, place long, size int")
    found = of.join(F.broadcast(kept), ["doc_id", "label", "size"]).groupBy("place").agg(F.min("text").alias("text")).orderBy("place").collect()
    return [(r.text, chosen[r.place][1]) for r in found]


MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)


class SpanHasher:
    """64-bit polynomial hashes of spans of a symbol array, from one running sum."""

    def __init__(self, symbols: int = 256, seed: int = 20240131):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, MASK, size=symbols, dtype=np.uint64, endpoint=True)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            up = np.full(size, BASE, dtype=np.uint64)
            down = np.full(size, BASE_INV, dtype=np.uint64)
            up[0] = down[0] = 1
            with np.errstate(over="ignore"):
                self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def spans(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._grow(len(symbols) + 1)
        with np.errstate(over="ignore"):
            run = np.zeros(len(symbols) + 1, dtype=np.uint64)
            np.cumsum(self.table[symbols] * self.up[: len(symbols)], dtype=np.uint64, out=run[1:])
            return mix((run[end] - run[start]) * self.down[start] + (end - start).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that their order looks random (a public xor-shift-multiply finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... for each run of the given length, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def softmax(z: Column) -> Column:
    def shares(z: Column) -> Column:
        return let(F.array_max(z), lambda top: let(F.transform(z, lambda v: F.exp(v - top)), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda v: v / total))))

    return let(z, shares)
