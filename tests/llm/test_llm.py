"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import _bpe, _graph, bpe_tree, embedding_dedup, jaccard, language, licenses, packing_bfd, packing_concat, quality, token_counts, topk
from scriptorium.llm.queries import ORACLES, QUERIES

JSON, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
W = "one two three four five six seven eight nine ten eleven twelve thirteen"
ODD = [(1, W, "x"), (1, W, "x"), (2, None, "x"), (3, "", "x"), (4, " \n\t", "x"), (None, W + " more", "x"), (5, "ab " * 30_000, "x"), (6, "x" * 20_000, "x"), (7, "It's 'tis don't!\r\n\r\n  日本 …", "x")]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, score string").withColumns({c: F.lit("y") for c in ("ids", "n", "sig", "_key", "part")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_batch_encoder_equals_the_library(tokenizer):
    rng = random.Random(3)
    bits = ["'", "s", "'s", "'re", "ll", " ", "  ", "\n", "a", "B", "é", "1", "!", "\t", "<|endoftext|>", "日", "ß", "'d ", "\r\n", "…"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(4000)] + [None, ""]
    for t, ids in zip(texts, _bpe.encoder(JSON, PATTERN).encode(texts), strict=True):
        assert tokenizer.encode(t or "", add_special_tokens=False).ids == ids.tolist()


@pytest.mark.parametrize("leaf", [3, 17, 4096])
def test_tree_encoding_equals_whole_encoding(leaf):
    import tiktoken

    whole = tiktoken.Encoding("w", pat_str=PATTERN, mergeable_ranks=_bpe.ranks_from_tiktoken(RANKS), special_tokens={})
    rng = random.Random(leaf)
    bits = ["'s", " ", "  ", "\n", "word", "Anre", "é", "12", "!", "日本", "\t", "xyz"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(400)] + ["a" * 300, " " * 50]
    bpe = _bpe.encoder(RANKS, PATTERN)
    for t, ids in zip(texts, bpe_tree.encode_all(texts, bpe, leaf), strict=True):
        assert ids.tolist() == whole.encode_ordinary(t)
        assert bpe_tree.decode(ids, bpe.pieces, leaf) == t.encode()


def test_op7(spark, odd, none, tokenizer):
    rows = QUERIES["op7_bpe"](spark, str(DATA)).collect()
    texts = {r.doc_id: r.text for r in docs(spark).collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, dtype="<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())
    got = bpe_tree.encode_decode(odd, RANKS, PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t, _ in ODD)
    assert bpe_tree.encode_decode(none, RANKS, PATTERN).count() == 0


def test_op6(spark, odd, none, tokenizer):
    texts = {r.doc_id: r.text for r in docs(spark).collect()}
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for i, t in texts.items()}
    rows = QUERIES["op6_packing"](spark, str(DATA)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own, whole in [(by_doc[i], len(x)) for i, x in ids.items()] + [(v, None) for v in by_sequence.values()]:
        upto = 0
        for start, n in sorted(own):
            assert start == upto
            upto += n
        assert upto == whole if whole is not None else upto <= 1024
    assert len(by_sequence) == -(-sum(map(len, ids.values())) // 1024)
    pieces = packing_concat.pack(odd, JSON, PATTERN, length=64)
    packed = packing_concat.sequences(pieces, 64).collect()
    assert all(len(r.ids) == 256 and r.cu_seqlens[-1] == r.tokens for r in packed) and sum(r.tokens for r in packed) == pieces.agg(F.sum("length")).first()[0]
    assert pieces.where("doc_id = 2").count() == 1 and packing_concat.pack(none, JSON, PATTERN).count() == 0


def test_op1(spark, odd, none, tokenizer, tmp_path):
    assert [sorted(b) for b in packing_bfd.place(np.array([3, 7, 5, 2]), 10)] == [[0, 1], [2, 3]]
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 500)
    bins: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):  # best fit by looking at every bin
        fits = [b for b, room in enumerate(bins) if room >= sizes[i]]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= sizes[i]
        else:
            bins.append(100 - sizes[i])
    placed = packing_bfd.place(sizes, 100)
    assert sorted(100 - sizes[b].sum() for b in map(np.array, placed)) == sorted(bins)
    out = str(tmp_path / "packed")
    packing_bfd.write_packed(packing_bfd.pack(docs(spark), JSON, PATTERN), out)
    back = defaultdict(dict)
    for r in spark.read.parquet(out).collect():
        ids, positions = np.frombuffer(r.input_ids, dtype="<u4"), np.frombuffer(r.position_ids, dtype="<u4")
        assert len(ids) == 1024 and r.cu_seqlens[-1] == r.n_tokens and len(r.doc_ids) == r.n_segments
        for d, s, a, b in zip(r.doc_ids, r.seg_starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert positions[a:b].tolist() == list(range(b - a))
            back[d][s] = ids[a:b].tolist()
    for r in docs(spark).collect():
        assert sum((back[r.doc_id][s] for s in sorted(back[r.doc_id])), []) == [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 50256]
    assert packing_bfd.pack(odd, JSON, PATTERN).agg(F.sum(F.size("doc_ids"))).first()[0] >= len(ODD)
    assert packing_bfd.pack(none, JSON, PATTERN).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_op4(spark, odd, none, tokenizer, rule):
    few = docs(spark).limit(60)
    texts = {r.doc_id: r.text for r in few.collect()}
    bpe = _bpe.encoder(JSON, PATTERN)
    got = defaultdict(dict)
    for r in token_counts.attribute(few, JSON, PATTERN, rule).collect():
        got[r.doc_id][r.section] = r
    for i, t in texts.items():
        sections = t.split("\n")
        owner = sum(([k] * (len(s.encode()) + (k < len(sections) - 1)) for k, s in enumerate(sections)), [])
        want, at = [0] * len(sections), 0
        for x in bpe.encode([t])[0]:
            span = owner[at : at + len(bpe.pieces[x])]
            want[span[0] if rule == "start" else max(sorted(set(span)), key=span.count)] += 1
            at += len(bpe.pieces[x])
        assert [got[i][k].n_tokens for k in range(len(sections))] == want
        assert all(t[got[i][k].char_start : got[i][k].char_end].rstrip("\n") == s for k, s in enumerate(sections))
    sums = token_counts.attribute(odd, JSON, PATTERN, rule).groupBy("doc_id", "doc_tokens").agg(F.sum("n_tokens").alias("n")).collect()
    assert all(r.n % max(1, r.doc_tokens) == 0 for r in sums) and token_counts.attribute(none, JSON, PATTERN).count() == 0
    assert [list(x) for x in token_counts.allot(np.array([1, 3, 2]), np.array([2, 4]), rule)] == ([[2, 1], [1, 0]] if rule == "start" else [[1, 2], [0, 1]])


def test_op2_held_out_accuracy(spark, odd, none):
    rows = QUERIES["op2_quality"](spark, str(DATA)).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.9
    model = quality.fit(["good text here", "bad bad bad bad"] * 40, np.array([1, 0] * 40))
    texts = ["good text here", "bad bad bad bad", None, "", "x" * 50_000]
    scores = model.score(texts)
    assert scores[0] > 0.8 > 0.2 > scores[1] and scores[2] == scores[3] and np.isfinite(scores).all()
    alone = quality.fit([], np.array([]))
    assert alone.score(["a"]).tolist() == [0.5] and quality.fit(["a"], np.array([1])).score(["a"])[0] == pytest.approx(2 / 3)
    assert quality.scored(odd, model, "mine").where("mine is not null and score = 'x'").count() == len(ODD) and quality.scored(none, model, "mine").count() == 0


def test_op3(spark, none):
    model = language.fit(*language.training_rows(docs(spark).where("doc_id % 2 = 0")))
    held = docs(spark).where("doc_id % 2 = 1")
    got = language.identify(held, model, F.col("text"), F.lit(None), F.lit(None)).collect()
    assert np.mean([r.lang_id == r.lang for r in got]) > 0.95
    rows = [(1, "", None, "a.de"), (2, None, "fr", None), (3, "###", None, None), (4, "the thing of the onthe", "en", "x.b.com")] + [(10 + i, "die und das der verber ungheit", "de", "h.example.net") for i in range(8)] + [(30, "", None, "h.example.net"), (31, "", None, "g.example.net")]
    odd = spark.createDataFrame(rows, "page_id long, text string, declared string, host string")
    want = {1: "de", 2: "fr", 3: None, 30: "de", 31: "de"}
    for name, most in (("broadcast", language.BROADCAST_HOSTS), ("salted", 0)):
        old, language.BROADCAST_HOSTS = language.BROADCAST_HOSTS, most
        try:
            found = {r.page_id: r.lang_id for r in language.identify(odd, model, F.col("text"), F.col("declared"), F.col("host")).collect()}
        finally:
            language.BROADCAST_HOSTS = old
        assert len(found) == len(rows) and {k: found[k] for k in want} == want, name
    assert language.identify(odd.limit(0), model, F.col("text"), F.col("declared"), F.col("host")).count() == 0
    pages = spark.createDataFrame([(1, "https://u@A.example.fr:80/x", "<html lang='fr-CA'><p>bon<script>x()</script> jour</p>"), (2, None, None), (3, "", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.declared, r.host, r.text and r.text.split()) for r in language.page_columns(pages).collect()}
    assert got == {1: ("fr", "A.example.fr", ["bon", "jour"]), 2: (None, None, None), 3: (None, None, "")}
    assert QUERIES["op3_language_id"](spark, str(DATA)).count() == spark.read.parquet(f"{DATA}/pages.parquet").count()


FOREIGN = (
    "Все люди рождаются свободными и равными в своем достоинстве и правах", "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
    "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti e sono dotati di ragione", "xqzj wvkp qjxz bnmw zxcv qwpf jklz vbnq xkcd pqwz" * 3,
)


def test_texts_in_no_known_language_go(spark):
    held = docs(spark).where("doc_id % 2 = 1 and n_chars >= 200")
    strange = spark.createDataFrame([(-1 - i, t, "en", "src1", len(t)) for i, t in enumerate(FOREIGN)], "doc_id long, text string, lang string, source string, n_chars long")
    table = docs(spark).where("doc_id % 2 = 0").unionByName(held.select(*docs(spark).columns)).unionByName(strange.select(*docs(spark).columns))
    model = language.fit(*language.training_rows(docs(spark).where("doc_id % 2 = 0")))
    seen = language.identify(strange.unionByName(held.select(*strange.columns)), model, F.col("text"), F.lit(None), F.lit(None)).collect()
    assert all(r.lang_id == r.lang_text_id == language.OTHER for r in seen if r.doc_id < 0)
    assert np.mean([r.lang_id == r.lang for r in seen if r.doc_id >= 0]) > 0.95
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, table, str(DATA)).collect()}
    assert not [i for i in kept if i < 0] and len({r.doc_id for r in held.collect()} - kept) <= 1
    alone = language.fit(["one two three"] * 3, ["en"] * 3)
    assert alone.background == pytest.approx(-np.log(language.BUCKETS)) and alone.evidence(["", "12", None]).tolist() == [[0.0] * 5] * 3


def brute_components(rows):
    """Every pair of distinct sets that share a shingle, one by one."""
    sets, own = {}, []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        own.append((i, s))
        sets.setdefault(s, len(sets))
    listed, up, holders = list(sets), list(range(len(sets))), defaultdict(list)

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for k, s in enumerate(listed):
        shared = defaultdict(int)
        for t in s:
            for j in holders[t]:
                shared[j] += 1
            holders[t].append(k)
        for j, c in shared.items():
            if 100 * c >= 75 * (len(s) + len(listed[j]) - c):
                a, b = find(k), find(j)
                up[max(a, b)] = min(a, b)
    low = {}
    for i, s in own:
        r = find(sets[s])
        low[r] = min((x for x in (low.get(r), i) if x is not None), default=None)
    return sorted(((i, len(s), low[find(sets[s])] if s else i) for i, s in own), key=str)


def test_op5(spark, odd, none):
    got = sorted((tuple(r) for r in QUERIES["op5_ngram_join"](spark, str(DATA)).collect()), key=str)
    assert got == brute_components([(r.doc_id, r.text) for r in docs(spark).collect()])
    rng = random.Random(2)
    rows = []
    for family in range(6):
        base = [f"w{family}_{rng.randint(0, 400)}" for _ in range(120)]
        for k in range(25):
            words = [w if rng.random() > 0.005 * (k % 8) else f"e{rng.randint(0, 10**6)}" for w in base]
            rows.append((len(rows), " ".join(words + ["common passage of many words here"] * (k % 2))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old, jaccard.GROUP = jaccard.GROUP, 4  # many small groups, so that all stages have work
    try:
        found = sorted((tuple(r) for r in jaccard.join(df).collect()), key=str)
    finally:
        jaccard.GROUP = old
    assert found == brute_components(rows)
    assert sorted((tuple(r) for r in jaccard.join(odd).collect()), key=str) == brute_components([(i, t) for i, t, _ in ODD])
    assert jaccard.join(none).count() == 0
    kept = jaccard.distinct(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7]
    nameless = spark.createDataFrame([(None, W), (None, W), (None, W + " z")], "doc_id long, text string")
    assert jaccard.distinct(nameless).count() == 1


def test_distinct_keeps_one_row_of_each_component_whatever_the_ids(spark):
    other, third = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "red green blue black white grey pink brown orange violet"
    rows = [(1, W), (1, other), (1, other), (2, W), (2, third), (3, third), (0, "lone words of one text that nobody else has at all"), (2, other), (None, third)]
    kept = jaccard.distinct(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, W), (1, other), (2, third), rows[6]])


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in _graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in up if any(i in e and e[0] != e[1] for e in edges)}


def test_op8(spark, duck):
    rows = sorted(tuple(r) for r in QUERIES["op8_exact_topk"](spark, str(DATA)).select("query_id", "rank", "vec_id", "score").collect())
    assert rows == sorted(duck.sql(f"SELECT query_id, rank, vec_id, score FROM ({ORACLES['op8_exact_topk']})").fetchall())
    bad = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (50, [-1.0, 0.0]), (51, [1.0]), (52, [float("inf"), 0.0])]
    df = spark.createDataFrame(bad, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = sorted((r.query_id, r.rank, r.vec_id) for r in topk.top_k(df).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert topk.top_k(df.limit(0)).count() == 0
    rng = np.random.default_rng(5)
    x, ids = np.floor(rng.normal(size=(700, 8)) * 40), np.arange(700)
    best = topk.Best(20, 5)
    for a in range(0, 700, 100):
        topk.search_block(x[:20], ids[:20], x[a : a + 100], ids[a : a + 100], best)
    for q in range(20):
        s = x @ x[q]
        s[q] = -np.inf
        order = np.lexsort((ids, -s))[:5]
        assert best.id[q].tolist() == order.tolist() and best.score[q].tolist() == s[order].tolist()


def test_op9(spark, odd, none):
    model = licenses.train()
    for family, notices in licenses.NOTICES.items():
        for n in notices:
            assert model.families[int(model.probabilities(n).argmax())] == family
    texts = [(i, f"Some words.\n{n}\nmore") for i, n in enumerate(n for ns in licenses.NOTICES.values() for n in ns)] + [(None, None), (99, ""), (98, "The driver lost his license."), (98, "The driver lost his license.")]
    got = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string").withColumn("family", F.lit("clash")), model).collect()
    for r in got:
        p = model.probabilities(dict(texts)[r.doc_id].split("\n")[r.paragraph])
        assert r.probability == pytest.approx(p.max(), abs=1e-5) and r.family == (model.families[int(p.argmax())] if p.max() >= 0.5 else "unknown")
    assert sum(r.confirmed for r in got) == len(texts) - 4 and sum(r.family == "unknown" for r in got) == 2
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0
    plan = licenses.scan(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_wrapped_notices_are_one_paragraph(spark):
    model = licenses.train()
    bsd = "Redistribution and use in source and binary forms, with or without"
    texts = {
        1: f" * {bsd}\n * modification, are permitted provided that the following\n * conditions are met\n * Some words.", 2: "Text.\n\nThis work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.\nMore.",
        3: "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", 4: f"{bsd}\n\nmodification, are permitted", 5: "x" * 30_000 + "\nReleased under the\nMIT License.\n",
    }
    got = sorted((r.doc_id, r.paragraph, r.family, r.confirmed) for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect())
    assert got == [(1, 0, "BSD", True), (2, 2, "CC-BY-NC", True), (3, 0, "Apache-2.0", True), (3, 1, "MIT", True), (4, 0, "BSD", False), (5, 1, "MIT", True)]


def test_op10(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 16))
    rows = []
    for i in range(600):
        v = base[i % 40] + rng.normal(size=16) * (0.04 if i % 3 else 1.0)
        rows.append((i, v.tolist(), i % 40 % 3))
    rows += [(700, rows[0][1], 0), (701, None, 0), (702, [0.0] * 16, 0), (703, [float("nan")] * 16, 0), (704, rows[0][1], None), (705, [1.0], 0), (706, [2.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cls", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    good = [(i, np.array(v) / np.linalg.norm(v), y) for i, v, y in rows if i is not None and v is not None and y is not None and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    links, up = defaultdict(set), {i: i for i, _, _ in good}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, v, y) in enumerate(good):
        for j, u, z in good[:k]:
            if y == z and len(u) == len(v) and u @ v >= 0.98:
                links[i].add(j)
                links[j].add(i)
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    assert len(got) == len(rows)
    total = sum(map(len, links.values()))
    assert total and sum(n for n, _, _ in got.values()) >= 0.9 * total
    assert all(n <= len(links[i]) for i, (n, _, _) in got.items())
    assert np.mean([got[i][1] == find(i) for i, _, _ in good]) > 0.95
    assert all(got[i] == (0, i, True) for i in (701, 702, 703, 704)) and got[700][0] == got[0][0] and got[706][1] == 705
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [embedding_dedup.BROADCAST_COMPONENTS, 0])
def test_op10_with_repeated_ids(spark, monkeypatch, most):
    monkeypatch.setattr(embedding_dedup, "BROADCAST_COMPONENTS", most)
    a, b, c = [1.0, 0.0, 0.0, 0.0], [1.0, 0.05, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    rows = [(7, a), (7, b), (7, c), (8, c), (3, [0.0, 0.0, 1.0, 0.05])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == sorted([(7, 1, 7), (7, 1, 7), (7, 2, 3), (8, 2, 3), (3, 2, 3)])


def test_pipeline_stages_read_what_the_stage_before_wrote(spark, monkeypatch):
    read = []

    def stage(spark, docs, sf_dir):
        read.append(docs.inputFiles())
        return docs.where("doc_id % 2 = 0")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stage), ("b", stage), ("c", stage)])
    assert corpus_pipeline.run(spark, str(DATA)).count() == docs(spark).where("doc_id % 2 = 0").count()
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    assert [all(shared in f for f in files) for files in read] == [False, True, True] and len({tuple(f) for f in read}) == 3


def test_pipeline(spark, odd, none):
    table = docs(spark)
    for (name, stage), size in zip(corpus_pipeline.STAGES, (200, 100, 50, 1), strict=True):
        before, table = table, stage(spark, table, str(DATA))
        assert table.count() >= size, name
        if name != "packing":
            assert table.columns == before.columns
        if name == "n-gram Jaccard join":
            want = brute_components([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in table.collect()) == sorted(i for i, _, low in want if i == low)
    extra = odd.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"), "score")
    for start in (extra, extra.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            start = stage(spark, start, str(DATA))
        start.count()
