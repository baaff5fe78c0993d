"""What each stage of the pipeline does to odd rows, and the pipeline as it is registered."""

import gc
import tracemalloc
from collections import Counter, defaultdict

import pytest
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import quality

CLASH = ("_language_id", "_language_text", "_quality_score", "_id", "_sig", "_component", "score", "text_id")


@pytest.fixture(scope="module")
def table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = docs.join(spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1"), "doc_id", "left_semi").where("n_chars between 800 and 3000").orderBy("doc_id").first()
    rows = [(None, good.text), (9001, None), (9002, ""), (9003, "123 !! 456"), (9004, good.text), (9004, good.text), (9005, (good.text + "\n") * 30), (9006, " \n\t")]
    odd = spark.createDataFrame([(i, t, good.lang, "src1", len(t or "")) for i, t in rows], docs.schema)
    return good, docs.unionByName(odd).withColumns({c: F.lit("mine") for c in CLASH})


def test_stages_on_odd_rows(spark, table):
    good, docs = table
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(DATA))
        assert docs.columns == before.columns and docs.where("_language_id <> 'mine' or score <> 'mine'").count() == 0, name
        counts.append(Counter(r.doc_id for r in docs.select("doc_id").collect()))
    language, quality, distinct = counts
    assert not {9001, 9002, 9003, 9006} & set(language) and language[9004] == 2 and language[None] == language[9005] == language[good.doc_id] == 1
    assert quality[9004] == 2 and quality[None] == quality[good.doc_id] == 1
    assert not {None, 9004, 9005} & set(distinct) and max(distinct.values()) == 1 and min(good.doc_id, *distinct) in distinct
    whole = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert sum(n for i, n in language.items() if i and i < 9000) >= 0.98 * whole
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA)).collect()
    of = defaultdict(list)
    for p in pieces:
        of[p.doc_id].append((p.start, p.length, p.doc_tokens))
    assert set(of) == set(distinct) and all(sum(n for _, n, _ in own) == own[0][2] for own in of.values())


def test_empty_and_wordless_tables(spark, table):
    docs = table[1]
    for start in (docs.limit(0), docs.where("doc_id in (9001, 9002, 9003, 9006)")):
        for _, stage in corpus_pipeline.STAGES:
            start = stage(spark, start, str(DATA))
        assert start.count() == 0


def test_registered_pipeline(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["pipeline"](spark, str(DATA)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        upto = 0
        for offset, n in sorted(own):
            assert offset == upto
            upto += n
        assert upto <= 1024
    assert {r.doc_id for r in rows} <= {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}


def test_driver_gives_back_what_fits_held(spark, table, monkeypatch):
    calls, collect = [], gc.collect
    monkeypatch.setattr(gc, "collect", lambda *a: calls.append(1) or collect(*a))
    for _, stage in corpus_pipeline.STAGES[:2]:
        before = len(calls)
        stage(spark, table[1], str(DATA))
        assert len(calls) > before


def test_context_vectors_hold_few_tables_at_a_time():
    texts = ["one two three four five"] * 50
    quality.context_vectors(texts)
    tracemalloc.start()
    quality.context_vectors(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.5 * quality.ROWS * quality.DIM * 8
