"""Operators against plain Python on small inputs."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import maths as M
from scriptorium.functions import text as T
from scriptorium.operators import geometry, images, scoring, sequences, sets, splits
from scriptorium.plans import optimize, params
from scriptorium.plans.queries import QUERIES
from scriptorium.sources import readers, sinks
from scriptorium.streaming import flows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_error_rates(spark):
    rng = random.Random(3)
    words = ["a", "b", "ä", "nicht", "Ω", "x y", " ", " q"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 9))), " ".join(rng.choices(words, k=rng.randint(0, 9)))) for _ in range(60)] + [("", ""), ("x", ""), ("", "x")]
    df = spark.createDataFrame(rows, "g string, t string")
    got = df.select("g", "t", T.char_error_rate(F.col("g"), F.col("t")).alias("cer"), T.word_error_rate(F.col("g"), F.col("t")).alias("wer")).collect()
    for r in got:
        g, t = (" ".join(x.lower().split()) for x in (r.g, r.t))
        for value, a, b in ((r.cer, g, t), (r.wer, g.split(), t.split())):
            want = distance(a, b) / len(b) if b else float(bool(a))
            assert value == pytest.approx(want)


def test_word_distance_beyond_the_basic_plane(spark):
    rng = random.Random(4)
    rows = [([rng.choice("abcdefg") for _ in range(rng.randint(0, 9))], [rng.choice("abcdefg") for _ in range(rng.randint(0, 9))]) for _ in range(60)] + [([], []), (["x"], []), ([], ["x"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for r in df.select("a", "b", T.word_distance(F.col("a"), F.col("b")).alias("coded"), T.word_distance(F.col("a"), F.col("b"), 4).alias("some"), T.array_distance(F.col("a"), F.col("b")).alias("plain")).collect():
        assert r.coded == r.some == r.plain == distance(r.a, r.b)
    # Words numbered around the surrogates and past the basic plane, whose code points must differ.
    n = 66_000
    a = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string"))
    seen = spark.range(1).select(a.alias("a")).select(T.word_codes(F.slice("a", n - 20, 20), F.col("a"), 0).alias("high"), T.word_codes(F.slice("a", 55_030, 20), F.col("a"), 0).alias("low"), T.word_codes(F.array(F.lit("no")), F.col("a"), 1).alias("alone")).first()
    assert [ord(c) for c in seen.high] == [0x101 + i + 0x800 for i in range(n - 20, n)] and min(map(ord, seen.high)) > 0xFFFF and ord(seen.alone) == 0x101
    assert [ord(c) for c in seen.low] == [0x101 + i + (0x800 if 0x101 + i >= 0xD800 else 0) for i in range(55_030, 55_050)]
    assert spark.createDataFrame([(seen.high, seen.high[1:])], "a string, b string").select(F.levenshtein("a", "b")).first()[0] == 1


def test_unfolded_char_error_rates_tell_accented_letters_apart(spark, tmp_path):
    rng = random.Random(9)
    words = ["é", "è", "ñandú", "über", "uber", "Ärger", "œ", "日本", "本", " ", "\u00a0", "plain", "😀"]
    texts = [["été", "ètè"], ["日", "本"]] + [[" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(6)] for _ in range(20)]
    rows = [(i, j, "user", t) for i, own in enumerate(texts) for j, t in enumerate(own)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): (r.cer, r.guess_length, r.truth_length) for r in QUERIES["char_error_rates"](spark, str(tmp_path)).collect()}
    assert len(got) == sum(len(own) - 1 for own in texts) and got[0, 1][0] == pytest.approx(2 / 3, abs=1e-6) and got[1, 1][0] == 1
    for (i, j), found in got.items():
        g, t = (" ".join(x.lower().split()) for x in texts[i][j - 1 : j + 1])
        assert found == (pytest.approx(distance(g, t) / len(t) if t else float(bool(g)), abs=1e-6), len(g), len(t))


def test_robust_score_without_rows_and_modes(spark):
    empty = spark.createDataFrame([], "k int, pos int, cer double, wer double, length_ratio double, underproduction double, is_empty boolean, is_very_short boolean")
    only = scoring.robust_score(empty, []).first()
    assert only.score == 10 and not only.feasible
    rows = spark.createDataFrame([(1, 1, 0.1, 0.2, 1.0, 0.0, False, False), (1, 2, 0.3, 0.9, 1.0, 0.0, False, False), (2, 1, 0.5, 0.5, 1.0, 0.0, False, False)], empty.schema)
    custom = {r.k: r.score for r in scoring.iteration_scores(rows, ["k"], "customWER", ["pos"]).collect()}
    assert custom[1] == pytest.approx(0.2) and custom[2] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        scoring.iteration_scores(rows, ["k"], "other", ["pos"])


def test_text_functions(spark):
    one = spark.createDataFrame([(" 'No Text' ", "Body", "img.GT.json", "data:x;base64,YWI=", "abc")], "a string, label string, f string, u string, s string")
    got = one.select(T.clean_answer(F.col("a"), F.col("label")).alias("a"), T.stem(F.col("f")).alias("f"), T.data_url_bytes(F.col("u")).alias("u"), T.fnv1a(F.col("s")).alias("h"), T.most_tokens(F.col("label")).alias("m"), T.writable_name(F.lit("a..ts")).alias("w"), T.is_gpu_error(F.lit("no WebGPU here")).alias("e")).first()
    assert got.a == "" and got.f == "img" and bytes(got.u) == b"ab" and got.h == splits.fnv("abc") == 0x1A47E90B and got.m == 6000 and not got.w and got.e


def test_erf_and_expected_improvement(spark):
    rows = spark.createDataFrame([(x / 4,) for x in range(-12, 13)], "x double").select("x", M.erf(F.col("x")).alias("e")).collect()
    assert all(abs(r.e - math.erf(r.x)) < 2e-7 for r in rows)


def test_suppression_and_order_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, b, float(rng.randint(0, 60)), float(rng.randint(0, 60)), float(rng.randint(1, 40)), float(rng.randint(1, 40)), rng.random()) for i in range(20) for b in range(8)]
    df = spark.createDataFrame(rows, "image_id long, box_id int, x double, y double, width double, height double, score double")
    kept = {}
    for r in geometry.non_maximum_suppression(df, "image_id", "box_id").collect():
        kept.setdefault(r.image_id, set()).add(r.box_id)
    for i in range(20):
        own = sorted((r for r in rows if r[0] == i), key=lambda r: -r[6])
        want: list = []
        for r in own:
            clash = False
            for k in want:
                w = min(r[2] + r[4], k[2] + k[4]) - max(r[2], k[2])
                h = min(r[3] + r[5], k[3] + k[5]) - max(r[3], k[3])
                both = max(w, 0) * max(h, 0)
                clash |= both / (r[4] * r[5] + k[4] * k[5] - both) > 0.5 or both / (r[4] * r[5]) >= 0.9 or both / (k[4] * k[5]) >= 0.9
            if not clash:
                want.append(r)
        assert kept[i] == {r[1] for r in want}
    places = geometry.ordered(df, "image_id", "box_id").groupBy("image_id").agg(F.sort_array(F.collect_list("place")).alias("p")).collect()
    assert all(r.p == list(range(1, 9)) for r in places)
    two_columns = [(0, 0, 10, 10), (0, 20, 10, 10), (40, 0, 10, 10), (40, 20, 10, 10)]
    assert geometry.reading_order(two_columns, origin="bbox") == [0, 1, 2, 3]
    assert geometry.rectangles({(0, 0), (0, 1), (1, 0), (1, 1), (3, 3)}, 4, 4) == [(0, 0, 2, 2), (3, 3, 1, 1)]


def test_sequences(spark):
    one = spark.createDataFrame([([1.0, 2.0, 9.0, 30.0, 31.0], [(0, 0.5), (90, 0.55), (180, 0.9)])], "v array<double>, r array<struct<angle:int,score:double>>")
    got = one.select(sequences.anchored_clusters(F.col("v"), 5.0).alias("a"), sequences.mean_clusters(F.col("v"), 5.0).alias("m"), sequences.nearest(F.col("v"), F.lit(5.5)).alias("n"), sequences.best_rotation(F.col("r"), 0.8, 0.1).alias("b")).first()
    assert got.a == [1.0, 9.0, 30.0] and got.m == [1.5, 9.0, 30.5] and got.n == 1 and got.b == 180


def test_splits(spark):
    import pandas as pd

    rows = pd.DataFrame({"filename": [f"f{i}" for i in range(31)], "source": ["a"] * 20 + ["b"] * 11, "document_type": "x", "condition": ["c", "d", "e"] * 10 + ["c"]})
    done = splits.globally_balanced(rows)
    assert done["split"].value_counts().to_dict() == {"train": 19, "val": 6, "test": 6}
    assert splits.globally_balanced(rows)["split"].tolist() == done["split"].tolist()
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "id long, s int")
    a = {r.id: r.split for r in splits.stratified(df, ["s"], "id").collect()}
    assert a == {r.id: r.split for r in splits.stratified(df.repartition(7), ["s"], "id").collect()}
    over = splits.overridden(spark.createDataFrame([("a", "x", "y")], "k string, p string, q string"), spark.createDataFrame([("a", None, "z")], "k string, p string, q string"), "k").first()
    assert (over.p, over.q) == ("x", "z")


def test_params(spark):
    assert params.merged({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}
    assert params.applied({}, {"a.b": "1.5", "a.c": "true", "d": "x"}) == {"a": {"b": 1.5, "c": True}, "d": "x"}
    assert params.flatten({"a": {"b": 1}, "c": [2]}) == {"a.b": 1, "c": [2]}
    dims = [("a", ["1", "2"]), ("b", ["x", "y", "z"])]
    assert params.grid(spark, dims).count() == 6 == params.space_size(dims)
    assert "a: {" in params.as_source({"a": {"b": 1}})
    assert params.values_of({"enabled": True, "min": 0, "max": 1, "steps": 4}) == ["0", "0.333", "0.667", "1"]
    keyed = params.grid(spark, dims).withColumn("key", T.parameter_key(F.col("parameters")))
    assert params.unseen(keyed, keyed.limit(2)).count() == 4
    assert params.clamped_settings(0, 9, 1) == {"iterations": 1, "initialSamples": 1, "candidateSamples": 50}


def test_search_finds_the_minimum_and_resumes(spark):
    dims = [("a", [str(i) for i in range(6)]), ("b", [str(i) for i in range(6)])]
    cost = lambda i, p: (int(p["a"]) - 4) ** 2 + (int(p["b"]) - 1) ** 2
    first = optimize.search(spark, dims, cost, iterations=6, initial=4, candidates=60)
    more = optimize.search(spark, dims, cost, iterations=12, initial=4, candidates=60, history=first)
    assert more[:6] == first and len({json.dumps(r["parameters"]) for r in more}) == 12
    assert min(r["score"] for r in more) <= min(r["score"] for r in first)


def test_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    box = {"x": 0, "y": 0, "width": 1, "height": 1}
    (folder / "A.png").write_bytes(b"png")
    (folder / "b.JPG").write_bytes(b"jpg")
    (folder / "c.png:Zone.Identifier").write_bytes(b"")
    (folder / "a.gt.json").write_text(json.dumps({"regions": [{"id": "1", "bbox": box, "text": " one "}, {"id": "2", "text": "no box"}, {"id": "3", "bbox": box, "text": "two"}]}))
    (folder / "b.gt.json").write_text("{broken")
    (folder / "b.txt").write_text("plain")
    rows = readers.with_ground_truth(readers.images(spark, str(folder)), readers.ground_truth(spark, str(folder)), readers.text_files(spark, str(folder)))
    assert {r.key: r.truth for r in rows.collect()} == {"a": "one\ntwo", "b": "plain"}
    for k, body in enumerate(({"splits": {"train": ["x"], "val": ["y"]}}, {"images": [{"filename": "x", "split": "train"}, {"filename": "y", "split": "val"}]}, {"assignments": {"x": "train", "y": "val"}})):
        (tmp_path / f"m{k}.json").write_text(json.dumps(body))
        assert {r.filename: r.split for r in readers.split_manifest(spark, str(tmp_path / f"m{k}.json")).collect()} == {"x": "train", "y": "val"}
    (tmp_path / "lines.txt").write_text("a.png some text\n\nnospace\nb.png t\n")
    assert [tuple(r) for r in readers.line_dataset(spark, str(tmp_path / "lines.txt")).collect()] == [("a.png", "some text"), ("b.png", "t")]
    (tmp_path / "run.json").write_text(json.dumps({"results": [{"id": 2, "combinedScore": 0.5}, {"id": 1, "combinedScore": 0.7}]}))
    assert [r.id for r in readers.run_results(spark, str(tmp_path / "run.json")).collect()] == [1, 2]
    out = str(tmp_path / "out")
    sinks.json_rows(spark.createDataFrame([(1, None)], "a int, b string"), out)
    assert spark.read.text(out).first().value == '{"a":1}'
    for run in range(2):
        sinks.snapshot(spark.createDataFrame([(run,)], "id int"), str(tmp_path / "it"), "r1")
    assert spark.read.parquet(str(tmp_path / "it")).count() == 2
    with pytest.raises(ValueError):
        sinks.checked_path("a/..", "x.json")
    assert sinks.saved(rows, [("bad", lambda df: 1 / 0), ("good", lambda df: None)]) == "good"


def test_sets(spark):
    one = spark.createDataFrame([({"val": 1, "all": 2},)], "m map<string,int>")
    assert one.select(sets.primary_split(F.col("m"), "dev").alias("s")).first().s == "val"
    yes, no = sets.divided(spark.createDataFrame([(1,), (None,), (3,)], "a int"), F.col("a") > 1)
    assert (yes.count(), no.count()) == (1, 2)


def test_images(spark):
    rng = np.random.default_rng(1)
    dark = rng.integers(0, 60, (32, 32), dtype=np.uint8)
    assert images.mean_luminance(images.inverted_if_dark(dark)) > 128
    assert images.equalised(dark).std() > dark.std()
    mask = np.zeros((10, 10))
    mask[2:6, 3:8] = 0.9
    (x, y, w, h, score), = images.text_boxes(mask)
    assert score == pytest.approx(0.9) and w > 5 and h > 4
    df = spark.createDataFrame([(1, 32, 32, bytearray(dark.tobytes()))], "image_id long, width int, height int, data binary")
    assert images.preprocessed(df, [("inversion", {}), ("clahe", {}), ("otsu", {})]).first().luminance > 0
    text = spark.createDataFrame([(1, "some text")], "input_id long, content string")
    assert images.recognised(text, "noisy").first().confidence == pytest.approx(0.9)


def test_streams(spark, tmp_path):
    folder = tmp_path / "msgs"
    folder.mkdir()
    lines = [{"type": "ack", "msg_id": "1", "stream_id": "s", "seq": 1, "ts": "2024-01-01T00:00:00Z"}, {"type": "other"}, {"type": "ack", "msg_id": "1", "stream_id": "s", "seq": 1, "ts": "2024-01-01T00:00:01Z"}]
    (folder / "a.json").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    got = []
    assert flows.run_to_end(flows.once_each(flows.messages(spark, str(folder))), str(tmp_path / "cp"), lambda df, _: got.extend(df.collect()))
    assert [r.msg_id for r in got] == ["1"]
    best = []
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame([(1, None, 1, "a", 5.0), (2, None, 1, "a", 3.0), (3, None, 1, "b", 4.0)], schema).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "ev"))
    flows.run_to_end(flows.best_so_far(stream, "event_type", "value", "event_id"), str(tmp_path / "cp2"), lambda df, _: best.extend(df.collect()), mode="complete")
    assert {r.event_type: (r.n, r.best, r.best_at) for r in best} == {"a": (2, 3.0, 2), "b": (1, 4.0, 3)}
