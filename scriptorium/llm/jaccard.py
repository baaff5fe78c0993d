"""Similarity join on word shingles by a token-group matrix.

A document is the set of its distinct five-word shingles; two link at a Jaccard similarity of 0.75 or more.
Links only matter up to connectivity, so groups that are connected already are never compared again.

1. One scan makes the sets and tells, from 32-bit prints dealt out by value, how many of a document's
   shingles any other text has. Every partner of a document holds three quarters of its shingles, so
   a document with fewer shared shingles links with nothing. Within a task shingles are summed first,
   and a shingle known to be shared sends one witness only.
2. A second scan fetches the whole sets of the remaining texts, once for each distinct set.
3. Similar sets are partitioned into groups of bounded size (by their smallest, then by their largest hash, large
   groups dealt out at random), members are joined where they link, and joined groups are contracted. The union
   of a group's shingles is its column of the matrix; a set goes on only if three quarters
   of its shingles lie in columns of other components.
4. What is left is compared exactly: the rarest shingles of a key's sets (so many of each that one of them must be
   shared) find the keys whose groups its sets may link with, the overlap with a group's column bounds the overlap with any
   member, and only qualifying groups are opened.

Cases: null and empty texts have no shingles and link with nothing; with fewer than five words the whole
sequence is the one shingle; equal sets are one set, joined without comparison; rows with a null id keep
their links, and component_id is the smallest id that is not null; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import by_texts, fresh, held, id_and_text, joined_by_group, mix, slices, small, written
from ._graph import Union, components
from ._words import shingles, words

CHARS = 1 << 17
#: Shingles that a task sums up before it sends them, and texts at most (their numbers are 16-bit).
CHUNK_SHINGLES, CHUNK_TEXTS = 1_000_000, 60_000
#: Shingles that one call looks at, about.
BUCKET_SHINGLES = 500_000
#: Bytes of text to one shingle, at least, for the number of buckets.
BYTES_A_SHINGLE = 5
WITNESS = 65_535
GROUP, CALL_SETS, ASKING = 256, 1_000, 512
#: Bits of the bitmap of wanted texts: at least, for each of them, and at most (128 MB).
LEAST_BITS, BITS_EACH, MOST_BITS = 1 << 26, 16, 1 << 30
SCANNED = "kind int, bucket long, doc_id long, n long, sig long, chunk long, idx int, own long, prints binary, owners binary, subs binary"
MET = "kind int, doc_id long, n long, sig long, chunk long, idx int, own long, owners binary, counts binary"
#: Buckets that a chunk is dealt out to, at most, so that packets stay long however large the input is; beyond that buckets are cut
#: into parts where they have been received.
WIDE = 2048
#: Shingles that a task cuts into parts at a time, and counts it adds up before it passes them on.
CUT_SHINGLES, ADDED_COUNTS = 8_000_000, 2_000_000
KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _schema(columns: str) -> pa.Schema:
    return pa.schema([(x.split()[0], KINDS[x.split()[1]]) for x in columns.split(", ")])


def signature(own: np.ndarray) -> int:
    """64 bits of a set of hashes."""
    if not len(own):
        return 0
    with np.errstate(over="ignore"):
        both = np.array([np.add.reduce(mix(own + np.uint64(1))), np.uint64(len(own))], dtype=np.uint64)
        return int(mix(both[:1] * np.uint64(0x9E3779B97F4A7C15) + mix(both[1:])).view(np.int64)[0])


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for a, b in slices((len(t or "") for t in texts), CHARS):
        yield from zip(ids[a:b], shingles(words(texts[a:b])), strict=True)


def _scan(docs: DataFrame, buckets: int, parts: int = 1) -> DataFrame:
    """Rows of documents (kind 0), and packed prints with their owners by bucket (kind 1), in the order of the bucket's ``parts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        part, chunks = TaskContext.get().partitionId() << 24, 0
        rows: list[tuple] = []
        sets: list[np.ndarray] = []
        number: dict[int, int] = {}
        kept = 0

        def flush() -> pa.RecordBatch:
            nonlocal kept, chunks
            chunk = part + chunks
            chunks += 1
            lengths = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            tokens = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), lengths)
            order = np.argsort(tokens)
            tokens, owner = tokens[order], owner[order]
            fresh = np.ones(len(tokens), dtype=bool)
            fresh[1:] = tokens[1:] != tokens[:-1]
            size = np.diff(np.append(np.flatnonzero(fresh), len(tokens)))
            shared = np.repeat(size > 1, size)
            own = np.bincount(owner[shared], minlength=len(sets))
            owner = np.where(shared, np.uint16(WITNESS), owner)[fresh]
            tokens = tokens[fresh]
            # A bucket is a range of the upper half, a part is a range of the bucket, and the print is the lower half.
            upper = (tokens >> np.uint64(32)) * np.uint64(buckets)
            bucket, sub = (upper >> np.uint64(32)).astype(np.int64), ((upper & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype("<u4")
            by = np.lexsort((tokens & np.uint64(0xFFFFFFFF), sub, bucket))
            bucket, sub, prints, owner = bucket[by], sub[by], tokens[by].astype(np.uint32), owner[by]
            edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, dtype=np.int64)
            records = [dict(kind=0, bucket=-1 - ((chunk >> 24) + (chunk & 0xFFFFFF)) % buckets, doc_id=d, n=n, sig=s, chunk=chunk, idx=i, own=int(own[i]) if i >= 0 else 0) for d, n, s, i in rows]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                planes = prints[a:b].view(np.uint8).reshape(-1, 4)[:, ::-1].T
                records.append(dict(kind=1, bucket=int(bucket[a]), chunk=chunk, prints=planes.tobytes(), owners=owner[a:b].tobytes(), subs=sub[a:b].tobytes() if parts > 1 else None))
            rows.clear()
            sets.clear()
            number.clear()
            kept = 0
            return pa.RecordBatch.from_pylist(records, schema=schema)

        for batch in small(batches):
            for doc, own in _sets(batch):
                sig = signature(own)
                idx = -1
                if len(own):
                    idx = number.setdefault(sig, len(sets))
                    if idx == len(sets):
                        sets.append(own)
                        kept += len(own)
                rows.append((doc, len(own), sig, idx))
                if kept >= CHUNK_SHINGLES or len(rows) >= CHUNK_TEXTS:
                    yield flush()
        if rows:
            yield flush()

    schema = _schema(SCANNED)
    return id_and_text(docs).mapInArrow(run, SCANNED)


def _prints(packed: bytes) -> np.ndarray:
    """Prints from their byte planes, the highest bytes first."""
    return np.ascontiguousarray(np.frombuffer(packed, dtype=np.uint8).reshape(4, -1)[::-1].T).view(np.uint32).ravel()


def _shared(prints: np.ndarray, owners: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """source * 65536 + owner of each text that shares prints with another, and how many."""
    order = np.argsort(prints, kind="stable")
    same = prints[order][1:] == prints[order][:-1]
    hit = order[np.append(same, False) | np.append(False, same)]
    hit = hit[owners[hit] != WITNESS]
    return np.unique(source[hit] * 65536 + owners[hit], return_counts=True)


def _meet(frame: pd.DataFrame) -> pd.DataFrame:
    """Documents as they are; of a bucket, how many of each text's prints another text has: one row a chunk,
    with the texts' numbers and their counts packed."""
    held(None)
    keep = ["kind", "doc_id", "n", "sig", "chunk", "idx", "own", "owners", "counts"]
    packed = frame[frame["kind"] == 1]
    documents = frame[frame["kind"] == 0].reindex(columns=keep)
    if not len(packed):
        return documents
    owners = np.concatenate([np.frombuffer(o, dtype=np.uint16) for o in packed["owners"]])
    source = np.repeat(np.arange(len(packed)), [len(o) // 2 for o in packed["owners"]])
    code, count = _shared(np.concatenate([_prints(p) for p in packed["prints"]]), owners, source)
    cuts = np.searchsorted(code, np.arange(len(packed) + 1) * 65536)
    found = [(c, (code[a:b] % 65536).astype(np.uint16).tobytes(), count[a:b].astype(np.uint32).tobytes()) for c, a, b in zip(packed["chunk"], cuts[:-1], cuts[1:], strict=True) if b > a]
    out = pd.DataFrame(found, columns=["chunk", "owners", "counts"]).assign(kind=np.int32(1))
    return pd.concat((documents, out.reindex(columns=keep)))


CUT = "kind int, bucket long, sub long, doc_id long, n long, sig long, chunk long, idx int, own long, prints binary, owners binary, chunks binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as they are; received packets, many at a time, cut anew by bucket and part, each print with its chunk."""
    held(None)
    schema, waiting, size = _schema(CUT), [], 0

    def flush() -> pa.RecordBatch:
        nonlocal waiting, size
        n = [len(r["owners"]) // 2 for r in waiting]
        bucket, chunk = (np.repeat(np.array([r[k] for r in waiting], dtype=np.int64), n) for k in ("bucket", "chunk"))
        prints, owners, subs = np.concatenate([_prints(r["prints"]) for r in waiting]), *(np.concatenate([np.frombuffer(r[k], dtype=t) for r in waiting]) for k, t in (("owners", np.uint16), ("subs", "<u4")))
        by = np.lexsort((subs, bucket))
        bucket, chunk, prints, owners, subs = (x[by] for x in (bucket, chunk, prints, owners, subs))
        edges = np.append(np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (subs[1:] != subs[:-1]))), len(bucket)).tolist()
        out = [dict(kind=1, bucket=int(bucket[a]), sub=int(subs[a]), prints=prints[a:b].tobytes(), owners=owners[a:b].tobytes(), chunks=chunk[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        waiting, size = [], 0
        return pa.RecordBatch.from_pylist(out, schema=schema)

    for batch in batches:
        documents = []
        for r in batch.to_pylist():
            if r["kind"] == 0:
                documents.append(r | {"sub": -1, "prints": None, "owners": None})
                continue
            waiting.append(r)
            size += len(r["owners"]) // 2
            if size >= CUT_SHINGLES:
                yield flush()
        if documents:
            yield pa.RecordBatch.from_pylist(documents, schema=schema)
    if waiting:
        yield flush()


def _meet_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _meet, over rows sorted by bucket and part: one part is held at a time, and counts are added up by chunk over many parts."""
    held(None)
    schema = _schema(MET)
    codes: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    numbers: dict[int, int] = {}
    part: tuple[int, int] | None = None
    own: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def meet() -> None:
        prints, owners, chunks = (np.concatenate(x) for x in zip(*own, strict=True))
        here, at = np.unique(chunks, return_inverse=True)
        source = np.array([numbers.setdefault(c, len(numbers)) for c in here.tolist()], dtype=np.int64)[at]
        code, count = _shared(prints, owners, source)
        codes.append(code)
        counts.append(count)
        own.clear()

    def flush() -> pa.RecordBatch:
        code, at = np.unique(np.concatenate(codes), return_inverse=True)
        count = np.bincount(at, weights=np.concatenate(counts), minlength=len(code)).astype(np.uint32)
        names, edges = list(numbers), np.searchsorted(code, np.arange(len(numbers) + 1) * 65536).tolist()
        out = [dict(kind=1, chunk=c, owners=(code[a:b] % 65536).astype(np.uint16).tobytes(), counts=count[a:b].tobytes()) for c, a, b in zip(names, edges[:-1], edges[1:], strict=True) if b > a]
        codes.clear()
        counts.clear()
        numbers.clear()
        return pa.RecordBatch.from_pylist(out, schema=schema)

    for batch in batches:
        documents = []
        for r in batch.to_pylist():
            if r["kind"] == 0:
                documents.append({k: r[k] for k in ("kind", "doc_id", "n", "sig", "chunk", "idx", "own")})
                continue
            if own and part != (r["bucket"], r["sub"]):
                meet()
                if sum(map(len, codes)) >= ADDED_COUNTS:
                    yield flush()
            part = r["bucket"], r["sub"]
            own.append((np.frombuffer(r["prints"], dtype=np.uint32), np.frombuffer(r["owners"], dtype=np.uint16), np.frombuffer(r["chunks"], dtype=np.int64)))
        if documents:
            yield pa.RecordBatch.from_pylist(documents, schema=schema)
    if own:
        meet()
    if codes:
        yield flush()


def _met(docs: DataFrame, buckets: int) -> DataFrame:
    """Documents and the packed counts of their shared prints (see MET). Buckets hold about BUCKET_SHINGLES each; where there are more than
    WIDE of them, their parts take their place."""
    parts = -(-buckets // WIDE)
    if parts == 1:
        return _scan(docs, buckets).groupBy("bucket").applyInPandas(_meet, MET)
    received = _scan(docs, WIDE, parts).repartition(WIDE, "bucket")
    return received.mapInArrow(_cut, CUT).sortWithinPartitions("bucket", "sub").mapInArrow(_meet_parts, MET)


def _add_up(frame: pd.DataFrame) -> pd.DataFrame:
    """All of a chunk's counts."""
    held(None)
    total = np.zeros(WITNESS + 1, dtype=np.int64)
    for owners, counts in zip(frame["owners"], frame["counts"], strict=True):
        total[np.frombuffer(owners, dtype=np.uint16)] += np.frombuffer(counts, dtype=np.uint32)
    idx = np.flatnonzero(total)
    return pd.DataFrame({"chunk": frame["chunk"].iloc[0], "idx": idx.astype(np.int32), "more": total[idx]})


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sig, n, tokens of the texts whose signature is in ``wanted``. They are found by a bitmap of bounded
    size; a false hit only adds a set that joins nothing."""
    wanted = written(wanted, "wanted")
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * wanted.count()).bit_length()))
    at = F.pmod(F.col("sig"), F.lit(size)) + 1  # these bitmaps count from one
    parts = wanted.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    bitmap = np.zeros(size // 8, dtype=np.uint8)
    for r in parts:
        bitmap[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.bits, dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        bits, seen = shared.value, set()
        for batch in small(batches):
            out = []
            for _, own in _sets(batch):
                sig = signature(own)
                bit = sig % size
                if len(own) and bits[bit >> 3] >> (bit & 7) & 1 and sig not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(sig)
                    out.append((sig, len(own), own.tobytes()))
            if out:
                yield pa.record_batch([pa.array([x[k] for x in out], type=t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["sig", "n", "tokens"])

    return id_and_text(docs).mapInArrow(run, "sig long, n long, tokens binary").groupBy("sig").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))


def overlaps(query: np.ndarray, tokens: np.ndarray, owner: np.ndarray, members: int) -> np.ndarray:
    """How many of ``query`` each member has; ``tokens`` is the sorted postings of a group."""
    lo, hi = np.searchsorted(tokens, query, side="left"), np.searchsorted(tokens, query, side="right")
    n = hi - lo
    if not n.any():
        return np.zeros(members, dtype=np.int64)
    at = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
    return np.bincount(owner[at], minlength=members)


def _postings(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    return tokens[order], owner[order]


def _join_group(frame: pd.DataFrame) -> pd.DataFrame:
    """sig and the root it is joined to, for the groups in ``frame``."""
    held(None)
    out = []
    for _, group in frame.groupby(["key", "sub"], sort=True):
        if len(group) < 2:
            continue
        sets, n, sig = [np.frombuffer(t, dtype=np.uint64) for t in group["tokens"]], group["n"].to_numpy(), group["sig"].to_numpy()
        tokens, owner = _postings(sets)
        forest = Union(len(sets))
        for i, own in enumerate(sets):
            if i and len({forest.find(j) for j in range(len(sets))}) == 1:
                break
            both = overlaps(own, tokens, owner, len(sets))
            for j in np.flatnonzero(7 * both >= 3 * (n + n[i])):
                forest.join(i, int(j))
        roots = forest.roots()
        moved = np.flatnonzero(roots != np.arange(len(sets)))
        out.append(pd.DataFrame({"a": sig[moved], "b": sig[roots[moved]]}))
    return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})


def _grouped_links(sets: DataFrame, key: Column, salt: int) -> DataFrame:
    """Edges within groups of sets that agree in ``key``; a group of more than GROUP is dealt out at random."""
    keyed = sets.select("sig", "n", "tokens", key.alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key", F.ceil(F.col("k") / GROUP).cast("int").alias("subs"), "k")
    total = sizes.agg(F.sum("k")).first()[0] or 0
    calls = max(1, -(-total // CALL_SETS))
    dealt = keyed.join(sizes.drop("k"), "key").withColumn("sub", F.pmod(F.xxhash64("sig", F.lit(salt)), F.col("subs")).cast("int"))
    return dealt.withColumn("call", F.pmod(F.xxhash64("key", "sub"), F.lit(calls))).select("call", "key", "sub", "sig", "n", "tokens").groupBy("call").applyInPandas(_join_group, "a long, b long")


def _open_shingles(sets: DataFrame) -> DataFrame:
    """Sets (sig, n, comp, tokens) of which three quarters lie in other components, with those shingles only
    and, for each, how many sets hold it."""
    def explode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        for batch in frames:
            own = [np.frombuffer(t, dtype=np.int64) for t in batch.column(3).to_pylist()]
            for lo, hi in slices(map(len, own), 50_000):
                some = own[lo:hi]
                row = pa.array(np.repeat(np.arange(lo, hi), [len(x) for x in some]))
                yield pa.record_batch([*(batch.column(c).take(row) for c in range(3)), pa.array(np.concatenate(some))], names=["sig", "n", "comp", "t"])

    rows = sets.select("sig", "n", "comp", "tokens").mapInArrow(explode, "sig long, n long, comp long, t long")
    among = rows.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("sets")).where("lo < hi").select("t", "sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    back = joined_by_group(rows, among.withColumn("of", F.col("sets")), "t", "of", int(total)).where("sets is not null").groupBy("sig").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), F.collect_list(F.struct("sets", "t")).alias("open"))
    return back.where(4 * F.size("open") >= 3 * F.col("n"))


def _with_components(sets: DataFrame, labels: DataFrame) -> DataFrame:
    return sets.join(labels.withColumnRenamed("id", "sig"), "sig", "left").withColumn("comp", F.coalesce("component", "sig")).drop("component")


def _key_pairs(sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """key, asked: keys whose sets (key, prefix) may link, each pair once, the key of fewer sets (``sizes``: key, k) first, and each key with itself.

    The rarest shingle that two linked sets share lies in the prefixes of both, so their keys have it in common; a key has a shingle
    once, however many of its sets do."""
    heads = written(sets.select("key", F.explode("prefix.t").alias("t")).distinct().join(sizes.select("key", "k"), "key"), "heads")
    asked = heads.select("t", F.col("key").alias("asked"), F.col("k").alias("of"))
    return heads.join(asked, "t").where("k < of or k = of and key <= asked").select("key", "asked").distinct()


def _exact_links(left: DataFrame) -> DataFrame:
    """Links between different components among the sets of ``left`` (see _open_shingles), as many as join what is linked.

    Groups are of similar sets, whatever their components, so that they are few for many sets alike."""
    need = F.ceil(3 * F.col("n") / 4).cast("int")
    sets = left.withColumn("open", F.array_sort("open")).withColumn("prefix", F.slice("open", 1, F.size("open") - need + 1)).withColumn("key", F.array_min("open.t"))
    sizes = written(sets.groupBy("key").agg(F.count("*").alias("k")), "key-sizes").withColumn("subs", F.ceil(F.col("k") / GROUP).cast("int"))
    sets = written(sets.join(sizes.drop("k"), "key").withColumn("sub", F.pmod(F.xxhash64("sig"), F.col("subs")).cast("int")).drop("subs"), "left")
    pairs = written(_key_pairs(sets, sizes), "key-pairs")
    # Every set of the asking key asks each of the asked key's groups; a group that many sets ask for is opened once for each part
    # of them, so that a call is bounded.
    asking = pairs.join(sizes.drop("subs"), "key").groupBy("asked").agg(F.ceil(F.sum("k") / ASKING).cast("int").alias("parts"))
    parts = asking.join(sizes.select(F.col("key").alias("asked"), "subs"), "asked").select("asked", "parts", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    asked = pairs.join(parts, "asked").groupBy("key").agg(F.collect_list(F.struct("asked", "sub", "parts")).alias("groups"))
    of = asked.join(sizes.drop("subs"), "key")
    dealt = joined_by_group(sets.select("sig", "n", "comp", "open.t", "key"), of, "key", "k", sets.count()).select("sig", "n", "comp", "t", F.explode("groups").alias("g"))
    queries = written(dealt.select(F.col("g.asked").alias("key"), "g.sub", F.pmod(F.xxhash64("sig"), F.col("g.parts")).cast("int").alias("part"), "sig", "n", "comp", "t"), "queries")

    def opened(key, queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:  # noqa: ANN001
        held(None)
        edges: list[tuple[int, int]] = []
        if len(queries) and len(members):
            own = [np.array(t, dtype=np.int64) for t in members["t"]]
            tokens, owner = _postings(own)
            column, n, sig = np.unique(tokens), members["n"].to_numpy(), members["sig"].to_numpy()
            names, at = np.unique(np.concatenate((queries["comp"].to_numpy(), members["comp"].to_numpy())), return_inverse=True)
            mine, theirs = at[: len(queries)], at[len(queries) :]
            forest = Union(len(names))
            for k, (q, m, t) in enumerate(zip(queries["sig"], queries["n"], queries["t"], strict=True)):
                t = np.array(t, dtype=np.int64)
                if 4 * np.isin(t, column).sum() < 3 * m:
                    continue
                for j in np.flatnonzero(7 * overlaps(t, tokens, owner, len(own)) >= 3 * (n + m)).tolist():
                    if forest.find(int(mine[k])) != forest.find(int(theirs[j])):
                        forest.join(int(mine[k]), int(theirs[j]))
                        edges.append((q, int(sig[j])))
        return pd.DataFrame(np.array(edges, dtype=np.int64).reshape(-1, 2), columns=["a", "b"])

    members = sets.join(parts.withColumnRenamed("asked", "key"), ["key", "sub"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", "sub", "part", "sig", "n", "comp", "open.t")
    return queries.groupBy("key", "sub", "part").cogroup(members.groupBy("key", "sub", "part")).applyInPandas(opened, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, sig and component (of signatures): a row for each of ``docs``."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(8, -(-int(size) // (BYTES_A_SHINGLE * BUCKET_SHINGLES)))
    met = written(_met(docs, buckets), "met")
    rows = met.where("kind = 0").select("doc_id", "n", "sig", "chunk", "idx", "own")
    counts = met.where("kind = 1").select("chunk", "owners", "counts").groupBy("chunk").applyInPandas(_add_up, "chunk long, idx int, more long")
    texts = rows.where("n > 0").groupBy("chunk", "idx").agg(F.first("sig").alias("sig"), F.first("n").alias("n"), F.first("own").alias("own"))
    wanted = texts.join(counts, ["chunk", "idx"], "left").where(4 * (F.col("own") + F.coalesce("more", F.lit(0))) >= 3 * F.col("n")).select("sig")
    sets = written(_fetch(docs, wanted), "sets")
    # A set's hashes are sorted, so its ends are its smallest and its largest.
    edges = written(_grouped_links(sets, F.substring("tokens", 1, 8), 0), "links")
    labels = components(edges)
    left = written(_open_shingles(_with_components(sets, labels)), "open")
    if not left.isEmpty():
        again = _grouped_links(sets.join(left.select("sig"), "sig", "left_semi"), F.substring("tokens", -8, 8), 1)
        edges = written(edges.unionByName(again), "links")
        labels = components(edges)
        left = written(_open_shingles(_with_components(sets.join(left.select("sig"), "sig", "left_semi"), labels)), "open")
        if not left.isEmpty():
            edges = edges.unionByName(_exact_links(left))
            labels = components(edges)
    # Copies share a signature, and so do all texts without words.
    copies = rows.where("n > 0").groupBy("sig").agg(F.count("*").alias("of")).join(labels.withColumnRenamed("id", "sig"), "sig")
    return joined_by_group(rows, copies, "sig", "of", rows.count()).select("doc_id", F.col("n").alias("n_shingles"), "sig", F.coalesce("component", "sig").alias("component"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each of ``docs``."""
    found = written(classes(docs), "classes")
    lowest = found.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("lowest"), F.count("*").alias("of"))
    return joined_by_group(found, lowest, "component", "of", found.count()).select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id"))


#: Ids that are broadcast, at most; above that the join shuffles.
BROADCAST_IDS = 200_000


def _bounded(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def distinct(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: one with the component's smallest id, or, where no row of
    it has an id, any one. Rows without words all stay."""
    name = fresh(docs, "_id")
    found = written(classes(docs), "classes").where("n_shingles > 0")
    lowest = found.groupBy("component").agg(F.min("doc_id").alias("lowest"), F.count("*").alias("of"))
    placed = written(joined_by_group(found, lowest, "component", "of", found.count()).select("doc_id", "component", "lowest", "sig"), "placed")
    worded = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.withColumn(name, F.col("doc_id").cast("long"))
    known = rows.where(worded & F.col(name).isNotNull())
    of, group = fresh(docs, "_sig"), fresh(docs, "_component")

    @F.arrow_udf("long")
    def sign(texts: pa.Array) -> pa.Array:
        held(None)
        return by_texts(texts, lambda some: [signature(own) for own in shingles(words(some))], pa.int64())

    def one_each(rows: DataFrame, on: list[str], chosen: DataFrame) -> DataFrame:
        return rows.withColumn(of, sign(F.col("text").cast("string"))).join(chosen, on).dropDuplicates([group]).select(*[F.col(f"`{c}`") for c in docs.columns])

    by_id = placed.where("doc_id is not null").groupBy(F.col("doc_id").alias(name)).agg(F.bool_or(F.col("doc_id") == F.col("lowest")).alias("first"), F.count("*").alias("rows"))
    kept = known.join(_bounded(by_id.where("not first").select(name)), name, "left_anti")
    # An id of several rows says nothing of a row: its text does.
    repeated = written(by_id.where("first and rows > 1").select(name), "repeated")
    some = not repeated.isEmpty()
    if some:
        several = kept.join(_bounded(repeated), name, "left_semi")
        kept = kept.join(_bounded(repeated), name, "left_anti")
    out = kept.drop(name).unionByName(docs.where(~worded))
    if some:
        named = placed.where("doc_id = lowest").join(_bounded(repeated), F.col("doc_id") == F.col(name), "left_semi")
        out = out.unionByName(one_each(several, [name, of], named.groupBy(F.col("doc_id").alias(name), F.col("sig").alias(of)).agg(F.first("component").alias(group))))
    nameless = placed.where("lowest is null").groupBy(F.col("sig").alias(of)).agg(F.first("component").alias(group))
    if not nameless.isEmpty():
        out = out.unionByName(one_each(rows.where(worded & F.col(name).isNull()), [of], nameless))
    return out
