"""Joins by group, components and the multi-index on hot keys, and the registered queries against their SQL."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from scriptorium.llm import _common, _graph, embedding_dedup, jaccard
from scriptorium.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("least", [1, 5, 10**6])
def test_join_by_group(spark, monkeypatch, least):
    monkeypatch.setattr(_common, "LEAST_HOT", least)
    monkeypatch.setattr(_common, "MOST_HOT", 100)
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, None, 77]), i) for i in range(300)]
    n = Counter(k for k, _ in rows)
    groups = [(k, n[k], f"g{k}", None if k == 3 else k * 10) for k in (1, 2, 3, 4, 99)]
    got = _common.joined_by_group(spark.createDataFrame(rows, "k long, i long").withColumn("_hot", F.lit("clash")), spark.createDataFrame(groups, "k long, of long, a string, b long"), "k", "of", 300)
    assert got.columns == ["k", "i", "_hot", "a", "b"]
    named = {k: (a, b) for k, _, a, b in groups}
    assert sorted((r.i, r.k, r.a, r.b) for r in got.collect()) == sorted((i, k, *named.get(k, (None, None))) for k, i in rows)


def test_join_by_group_of_few_rows_has_one_join(spark):
    rows, groups = spark.range(300).select((F.col("id") % 7).alias("k"), F.col("id").alias("i")), spark.range(7).select(F.col("id").alias("k"), (F.col("id") + 43).alias("of"), F.lit("a").alias("a"))
    joins = [_common.joined_by_group(rows, groups, "k", "of", total)._jdf.queryExecution().optimizedPlan().toString().count("Join ") for total in (300, _common.LEAST_HOT, _common.LEAST_HOT + 1)]
    assert joins == [1, 1, 2]


def test_components_with_one_huge_parent(spark, monkeypatch):
    monkeypatch.setattr(_common, "LEAST_HOT", 3)
    rng = random.Random(2)
    edges = [(0, i) for i in range(1, 200)] + [(rng.randint(300, 420), rng.randint(300, 420)) for _ in range(90)] + [(i, i + 1) for i in range(500, 540)]
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in _graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in {x for e in edges if e[0] != e[1] for x in e}}


def test_cells_come_in_ascending_order():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 9)) / 2, rng.integers(0, 6, rng.integers(1, 9)) / 2
        reach = float(rng.integers(0, 6))
        got = list(embedding_dedup.multi_sequence(a, b, reach))
        sums = [a[i] + b[j] for i, j in got]
        assert sums == sorted(sums) and len(set(got)) == len(got)
        assert set(got) == {(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] + b[j] <= reach}


def test_join_with_hot_shingles_and_copies(spark, duck, monkeypatch, tmp_path):
    monkeypatch.setattr(_common, "LEAST_HOT", 2)
    rng = random.Random(5)
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(i, shared) for i in range(30)] + [(100 + i, shared + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.choice([3, 200])))) for i in range(40)] + [(200, ""), (201, None), (202, ""), (203, "a b"), (204, "A  B")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in QUERIES["op5_ngram_join"](spark, str(tmp_path)).collect())
    duck.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    try:
        assert got == sorted(duck.sql(ORACLES["op5_ngram_join"]).fetchall())
    finally:
        duck.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    assert jaccard.LEAST_BITS >= 1 << 26


def test_planted_vectors_equal_the_sql(spark, duck, tmp_path):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 64))
    rows = [(i, (base[i % 30] + (rng.normal(size=64) * 0.08 if i % 4 else 0)).tolist(), i % 30 % 4) for i in range(300)] + [(300, None, 1), (301, [0.0] * 64, 1), (302, base[0].tolist(), None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in QUERIES["op10_embedding_dedup"](spark, str(tmp_path)).collect())
    duck.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    try:
        want = sorted(duck.sql(ORACLES["op10_embedding_dedup"]).fetchall())
    finally:
        duck.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM read_parquet('{DATA}/embeddings.parquet')")
    assert sum(r[1] for r in want) > 1000 and got == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    found = duck.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(df.columns)
    order = [found.columns.index(c) for c in sorted(found.columns)]
    assert sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) == sorted(tuple(r[i] for i in order) for r in found.fetchall())


@pytest.mark.parametrize("name", ["op1_token_output", "op4_token_counts", "op9_licenses"])
def test_registered_queries_run(spark, name):
    df = QUERIES[name](spark, str(DATA))
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    rows = df.collect()
    if name == "op1_token_output":
        assert len({d for r in rows for d in r.doc_ids}) == n and all(r.cu_seqlens[-1] == r.n_tokens <= 1024 for r in rows)
    elif name == "op4_token_counts":
        assert len({r.doc_id for r in rows}) == n
    else:
        assert all(r.confirmed == (r.similarity is not None and r.similarity >= 0.6) for r in rows)


def test_buckets_in_parts_count_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    wide = sorted((tuple(r) for r in jaccard.join(docs).collect()), key=str)
    for name, value in (("WIDE", 3), ("BUCKET_SHINGLES", 4000), ("CUT_SHINGLES", 20_000), ("ADDED_COUNTS", 1000), ("CHUNK_SHINGLES", 9000)):
        monkeypatch.setattr(jaccard, name, value)
    seen = []
    met = jaccard._met
    monkeypatch.setattr(jaccard, "_met", lambda docs, buckets: seen.append(buckets) or met(docs, buckets))
    assert sorted((tuple(r) for r in jaccard.join(docs).collect()), key=str) == wide and seen[0] > 3 * 3


def joined_on_shingles(spark):
    """Rows that joins on shingles have made so far in this session."""
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() and re.search(r"\[t#\d+L?\], \[t#\d+L?\], Inner", node.desc()):
                metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
                made += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId()))
    return made


def test_sets_with_the_same_shingles_dont_multiply(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 64)
    monkeypatch.setattr(jaccard, "ASKING", 100)
    rng = random.Random(9)
    sets = [frozenset(rng.sample(range(40), rng.randint(28, 32))) for _ in range(500)] + [frozenset(range(1000 + 30 * i, 1030 + 30 * i)) | {1} for i in range(5)]
    of = Counter(t for s in sets for t in s)
    left = spark.createDataFrame([(i, len(s), i, [(of[t], t) for t in s]) for i, s in enumerate(sets)], "sig long, n long, comp long, open array<struct<sets: long, t: long>>")
    before = joined_on_shingles(spark)
    edges = [tuple(r) for r in jaccard._exact_links(left).collect()]
    made = joined_on_shingles(spark) - before
    assert all(100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a, b in edges)
    want, got = _graph.Union(len(sets)), _graph.Union(len(sets))
    for a, b in edges:
        got.join(a, b)
    for a, x in enumerate(sets):
        for b in range(a):
            if 100 * len(x & sets[b]) >= 75 * len(x | sets[b]):
                want.join(a, b)
    assert got.roots().tolist() == want.roots().tolist() and 1 < len(set(want.roots().tolist())) < len(sets)
    assert 0 < made < 5 * len(sets)
