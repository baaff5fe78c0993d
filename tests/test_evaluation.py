"""The evaluation operators, null handling and ranges against plain Python."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import maths as M
from scriptorium.functions import text as T
from scriptorium.operators import evaluation, geometry, scoring, sequences
from scriptorium.plans import params


def test_nulls_stay_null(spark):
    n = F.lit(None).cast("double")
    one = spark.range(1).select(
        M.clamp(n, 0.0, 1.0).alias("a"), T.underproduction(n, F.lit(5)).alias("b"), T.length_ratio(F.lit(5), n).alias("c"), T.error_rate(n, F.lit(3), F.lit(3), clamp=True).alias("d"), M.iou(n, *[F.lit(1.0)] * 7).alias("e"),
        M.rectification_confidence(n, F.lit(2.0)).alias("f"), M.dpi_scale(n, 20, 4).alias("g"), *[c.alias(f"s{i}") for i, c in enumerate(geometry.sanitised(n, n, n, n, F.lit(1.0), F.lit(1.0), F.lit(100), F.lit(80)))],
        M.contained(n, *[F.lit(1.0)] * 7).alias("h"), M.clamp(F.lit(7.0), 0.0, 1.0).alias("known"),
    ).first()
    assert one.known == 1.0 and [k for k, v in one.asDict().items() if v is not None and k != "known"] == []
    rows = [(0.1, 0.1), (0.1, None), (None, 0.1)]
    df = spark.createDataFrame([(1, c, w, 1.0, 0.0, False, False) for c, w in rows], "run int, cer double, wer double, length_ratio double, underproduction double, is_empty boolean, is_very_short boolean")
    assert scoring.robust_score(df, ["run"]).first().base == pytest.approx(0.1)


def events_order(boxes, span, gap, depth, width):
    """Reading order by a sweep over starts and ends."""

    def by_top(own):
        return sorted(own, key=lambda i: boxes[i][1])

    def best(own, axis):
        marks = sorted([(boxes[i][axis], 0) for i in own] + [(boxes[i][axis] + boxes[i][axis + 2], 1) for i in own])
        open_, reached, found = 0, 0.0, (0.0, 0.0)
        for at, end in marks:
            if not end and open_ == 0 and at - reached > found[0]:
                found = (at - reached, reached + (at - reached) / 2)
            open_ += -1 if end else 1
            if open_ == 0:
                reached = at
        return found

    def cut(own, level):
        if len(own) < 2 or level >= depth:
            return by_top(own)
        (h, hp), (v, vp) = best(own, 1), best(own, 0)
        if max(h, v) < gap:
            return by_top(own)
        axis, at = (1, hp) if h >= v else (0, vp)
        first = [i for i in own if boxes[i][axis] + boxes[i][axis + 2] / 2 < at]
        rest = [i for i in own if i not in first]
        return cut(first, level + 1) + cut(rest, level + 1) if first and rest else by_top(own)

    wide = by_top([i for i, b in enumerate(boxes) if b[2] >= span * width])
    out = []
    for i in cut([i for i, b in enumerate(boxes) if b[2] < span * width], 0):
        while wide and boxes[wide[0]][1] + boxes[wide[0]][3] <= boxes[i][1] + boxes[i][3] * 0.3:
            out.append(wide.pop(0))
        out.append(i)
    return out + wide


def test_reading_order_equals_a_sweep():
    rng = random.Random(8)
    for _ in range(600):
        boxes = [(float(rng.randint(0, 20) * 10), float(rng.randint(0, 20) * 10), float(rng.choice([20, 40, 150])), float(rng.randint(1, 4) * 10)) for _ in range(rng.randint(0, 9))]
        gap = rng.choice([0, 10, 30])
        assert geometry.reading_order(boxes, 0.7, 200.0, gap, 14) == events_order(boxes, 0.7, gap, 14, 200.0)
    assert geometry.reading_order([(40.0, 0.0, 10.0, 10.0), (0.0, 0.0, 10.0, 10.0)]) == [1, 0]  # a gap of 30 is wide enough
    assert geometry.reading_order([(39.0, 0.0, 10.0, 10.0), (0.0, 0.0, 10.0, 10.0)]) == [0, 1]


def test_uncovered_cells_on_wide_grids(spark):
    rng = random.Random(2)
    rows = [(i, float(rng.randint(-10, 1500)), float(rng.randint(-10, 60)), float(rng.choice([-1, 0, 5, 30, 900])), float(rng.randint(0, 20))) for i in range(6) for _ in range(5)] + [(9, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "i int, x double, y double, width double, height double")
    got = {(r.i, r.row, r.col) for r in geometry.uncovered_cells(df, "i", 10, 140, 5).collect()}
    want = set()
    for i in {r[0] for r in rows}:
        for r in range(5):
            for c in range(140):
                if not any(x is not None and w > 0 and h > 0 and x < 10 * (c + 1) and x + w > 10 * c and y < 10 * (r + 1) and y + h > 10 * r for j, x, y, w, h in rows if j == i):
                    want.add((i, r, c))
    assert got == want
    areas = geometry.uncovered_areas(df, "i", 10, 1400, 50).collect()
    assert sum(r.width * r.height for r in areas) == 100 * len(want)


def test_ranges_equal_plain_windows(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(30)]), i, rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, i int, v double")
    plain = sequences.with_previous(sequences.ranked(df, ["g"], ["o", "i"]), ["g"], ["o", "i"], "v", "p").orderBy("i").collect()
    ranged = sequences.ranked_in_ranges(df, ["g"], ["o", "i"], parts=7)
    ranged = sequences.with_previous_in_ranges(ranged, ["g"], ["o", "i"], "v", "p", parts=5).orderBy("i").collect()
    assert [(r.i, r["rank"], r.p) for r in ranged] == [(r.i, r["rank"], r.p) for r in plain]
    assert sequences.ranked_in_ranges(df.limit(0), [], ["o", "i"]).count() == 0
    first = {r.i: (r.vs_first, r.vs_previous) for r in sequences.deltas(df, ["g"], ["o", "i"], "v").collect()}
    assert len(first) == 400 and sum(p is None for _, p in first.values()) == 3


CONFIG = {"configs": [{"id": "A", "parameters": {"k": 1}}, {"label": "B", "parameters": [{"path": "k", "value": 2}, {"value": 3}, None]}, {}]}
RATES = lambda p: F.struct((F.coalesce(F.try_element_at(p, F.lit("k")).cast("double"), F.lit(1.0)) * F.col("w")).alias("wer"), F.col("w").alias("cer"))


def test_candidates_and_ranking(spark):
    listed = evaluation.candidates(CONFIG)
    assert [(c["id"], c["parameters"]) for c in listed] == [("A", {"k": "1"}), ("B", {"k": "2"}), ("unnamed", {})]
    with pytest.raises(ValueError, match="no candidates"):
        evaluation.candidates({"configs": []})
    assert evaluation.tuning_settings({"baseConfig": {"engine": "x"}, "tuneSplit": "val"})["engine"] == "tesseract"
    docs = spark.createDataFrame([(1, 0.1, "train"), (2, 0.5, "train"), (3, 0.2, "test"), (4, 0.9, "test"), (5, 0.3, "all")], "doc int, w double, split string")
    every = evaluation.evaluated(docs, listed, RATES)
    assert every.count() == 15
    metrics = evaluation.by_split(every, ["position", "candidate"], "doc", "doc")
    ranked = evaluation.ranking(metrics)
    assert [(r["rank"], r.candidate, r.primary_split) for r in ranked.orderBy("rank").collect()] == [(1, "A", "test"), (2, "unnamed", "test"), (3, "B", "test")]  # equal ones in the list's order
    broken = every.withColumn("error", F.when((F.col("candidate") == "A") & (F.col("split") == "test"), F.concat(F.lit("page "), F.col("doc"))))
    failed = evaluation.by_split(broken, ["position", "candidate"], "doc", "doc")
    row = failed.where("candidate = 'A' and split = 'test'").first()
    assert row.error == "page 3" and row.wer_mean is None
    assert evaluation.ranking(failed).where("candidate = 'A'").first().primary_split == "train"
    report = json.loads(evaluation.comparison_report(ranked, metrics).first().value)
    assert [r["candidate"] for r in report["ranking"]] == ["A", "unnamed", "B"] and len(report["candidates"][0]["metricsBySplit"]) == 3
    best, own = evaluation.two_phase(every, "train", "doc", "doc")
    assert best.where("rank = 1").first().candidate == "A" and own.count() == 3
    run = json.loads(evaluation.run_report(best, own, 5).first().value)
    assert run["status"]["incomplete"] and run["best"]["candidate"] == "A" and [r["rank"] for r in run["allResults"]] == [1, 2, 3]


def test_grid_search_equals_a_loop(spark):
    docs = spark.createDataFrame([(i, 0.1 * i) for i in range(1, 6)], "doc int, w double")
    dims = params.dimensions({"k": {"enabled": True, "selectedValues": [3, 1, 2]}, "m": {"enabled": True}})
    got = evaluation.grid_search(docs, dims, RATES, ["doc"]).orderBy("rank").collect()
    want = sorted((float(k) * sum(0.1 * i for i in range(1, 5)) / 4, n) for n, k in enumerate([3, 3, 1, 1, 2, 2]))
    assert [(round(r.wer_drop1, 9), r.permutation) for r in got] == [(round(w, 9), n) for w, n in want] and dict(got[0].parameters) == {"k": "1", "m": "true"}


def test_region_metrics(spark):
    pages = spark.createDataFrame([(1, 100, 200), (2, 100, 200)], "page int, width int, height int")
    truths = spark.createDataFrame([(1, "header", None, "abc"), (1, "body", "Footer", "x y")], "page int, region string, label string, truth string")
    texts = spark.createDataFrame([(1, "header", " abd "), (1, "meta", "noise")], "page int, region string, guess string")
    scored, weighted = evaluation.region_metrics(pages, truths, texts, "page")
    rows = {r.region: r for r in scored.collect()}
    assert len(rows) == 5 and (rows["header"].cer, rows["meta"].cer, rows["address"].cer, rows["body"].wer) == (pytest.approx(1 / 3), 1.0, 0.0, 1.0) and rows["body"].label == "Footer"
    w = {"header": 0.15, "address": 0.2, "meta": 0.15, "body": 0.1, "footer": 0.1}
    assert weighted.count() == 1 and weighted.first().cer == pytest.approx(sum(w[k] * rows[k].cer for k in w) / sum(w.values()))


def test_small_ones(spark):
    points = "array<struct<x:double,y:double>>"
    one = spark.createDataFrame([([(9.0, 8.0), (0.0, 1.0), (10.0, 0.0), (1.0, 9.0)], [1, 2, 3, 4, 5])], f"p {points}, v array<int>")
    c = one.select(evaluation.ordered_corners(F.col("p")).alias("c"), evaluation.box_points(F.col("p")).alias("b"), evaluation.preview(F.col("v")).alias("t"), evaluation.detection_size(F.lit(1000), F.lit(333), 960).alias("s"), evaluation.normalised_channels(F.array(F.lit(255), F.lit(0), F.lit(0))).alias("n")).first()
    assert (c.c.topLeft.x, c.c.topRight.x, c.c.bottomRight.x, c.c.bottomLeft.x) == (0.0, 10.0, 9.0, 1.0) and [p.x for p in c.b] == [0.0, 10.0, 9.0, 1.0]
    assert c.t == "1, 2, 3 +2" and c.s.asDict() == {"scale": 0.96, "width": 960, "height": 320, "padded_width": 960, "padded_height": 320} and c.n[0] == pytest.approx((1 - 0.485) / 0.229)
    assert [evaluation.run_state("idle", w) for w in ("paused", "running")] == ["idle", "running"]
    gate = evaluation.Gate()
    assert gate.passed()
    gate.pause()
    assert not gate.passed(0.01)
    gate.go_on()
    assert gate.passed()
    gate.stop()
    assert not gate.passed()
    assert evaluation.default_value({"a": {"b": 2.0, "c": None}}, "a.b") == "2" and evaluation.default_value({"a": {}}, "a.b") == "-" and evaluation.default_value({"a": {"c": None}}, "a.c") == "-"
    messages = spark.createDataFrame([("s", 3, "c"), ("s", 1, "a"), ("s", 1, "a"), ("t", 7, "x"), ("s", 2, "b"), ("s", 5, "e")], "stream_id string, seq long, payload string")
    assert [(r.seq, r.place, r.gap) for r in evaluation.in_sequence(messages).where("stream_id = 's'").orderBy("seq").collect()] == [(1, 1, False), (2, 2, False), (3, 3, False), (5, 4, True)]
    joined = evaluation.handled(messages, lambda own: [("".join(p for p, _ in own),)], ["payload"], "text string").collect()
    assert {r.stream_id: r.text for r in joined} == {"s": "aabce", "t": "x"}
    steps = spark.createDataFrame([(0,), (5,), (99,), (None,)], "n int").select(params.bounded_steps(F.col("n")).alias("b")).collect()
    assert [r.b for r in steps] == [1, 5, 20, None]


def test_table_grid(spark):
    words = [("t", 0, "a", 0.0, 0.0), ("t", 1, "b", 5.0, 4.0), ("t", 2, "c", 60.0, 2.0), ("t", 3, "d", 2.0, 40.0), ("u", 0, "z", 1.0, 1.0)]
    df = spark.createDataFrame(words, "page string, k int, text string, x double, y double").withColumns({"width": F.lit(10.0), "height": F.lit(10.0)})
    got = {r.page: r for r in evaluation.table_grid(df, "page", "k").collect()}
    assert got["t"].grid == [["a b", "c"], ["d", ""]] and got["t"].tsv == "a b\tc\nd\t" and got["u"].markdown == "| z |\n| --- |"
    by = defaultdict(int)
    for r in words:
        by[r[0]] += 1
    assert set(got) == set(by)


def test_images_in_and_out():
    import numpy as np

    from scriptorium.operators import images

    rng = np.random.default_rng(1)
    for shape in ((5, 7), (4, 3, 3), (6, 2, 4)):
        im = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (images.from_png(images.to_png(im)) == im).all()
    with pytest.raises(ValueError, match="PNG"):
        images.from_png(b"GIF89a")
    im = rng.integers(0, 256, (30, 40), dtype=np.uint8)
    assert images.crop(im, -3, 2.7, 10, 5).shape == (5, 10) and images.crop(im, 35, 25, 100, 100, 2).shape == (7, 7) and images.crop(im, 99, 99, 1, 1).shape == (1, 1)
    assert (images.smoothly_resized(im, 40, 30) == im).all() and images.smoothly_resized(im, 80, 45).shape == (45, 80)
    flat = np.full((20, 20), 90, np.uint8)
    assert (images.bilateral(flat) == 90).all() and (images.adaptive(flat) == 255).all() and (images.gain(flat, 3) == 255).all() and (images.binary(flat, 90) == 0).all()
    # Black bars of 8 pixels: capitals that must be doubled and a half.
    bars = np.full((100, 60), 255, np.uint8)
    bars[10:18], bars[40:48] = 0, 0
    assert images.capital_height(bars) == 8 and images.enlarged(bars, 20, 4).shape == (250, 150) and images.enlarged(bars, 8.2).shape == bars.shape and images.capital_height(flat) == 20
    steps = images.chain({"enabled": True, "contrastBoost": 1.5, "clahe": {"enabled": True}, "threshold": {"enabled": True, "type": "binary", "value": 99}, "dpiScaling": {"enabled": True}})
    assert [n for n, _ in steps] == ["dpi", "grey", "clahe", "gain", "binary"] and images.chain({}) == [] and set(np.unique(images.preprocess(bars, steps))) <= {0, 255}


def test_slanted_boxes_are_the_smallest():
    import numpy as np

    from scriptorium.operators import images

    rng = np.random.default_rng(2)
    for _ in range(40):
        points = rng.integers(0, 30, (rng.integers(3, 12), 2))
        x, y, w, h, t = images.smallest_box(points)
        turn = np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])
        own = (points - [x, y]) @ turn.T
        assert (np.abs(own) <= np.array([w, h]) / 2 + 1e-6).all()
        areas = [np.prod(np.ptp(points @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]).T, axis=0)) for a in np.linspace(0, np.pi / 2, 400)]
        assert w * h <= min(areas) + 1e-6
    mask = np.zeros((20, 30))
    mask[5:9, 4:20] = 0.9
    (corners, score), = images.slanted_boxes(mask, unclip=0)
    assert corners.tolist() == [[4, 5], [20, 5], [20, 9], [4, 9]] and score == pytest.approx(0.9) and images.line_confidence([0.5, 0.9], 1) == 1 and images.line_confidence([], 0) == 0


def test_regions_are_read_in_order(spark):
    from scriptorium.operators import images

    class Plain(images.NoisyEngine):
        def recognise(self, content, options):
            return content.decode(), 0.5

    images.register("plain", Plain)
    rows = [(1, 2, b"second"), (1, 1, b" first "), (1, 3, b"  "), (2, 1, b"")]
    got = {r.image_id: (r.text, r.confidence, r.regions) for r in images.read_regions(spark.createDataFrame(rows, "image_id long, place int, content binary"), "plain").collect()}
    assert got == {1: ("first\nsecond", 0.5, 2), 2: ("", 0.0, 0)}


def test_resumed_run(spark, tmp_path):
    from scriptorium.plans import optimize
    from scriptorium.sources import readers

    result = lambda i, v: {"id": i, "parameters": [{"path": "a", "value": v}], "combinedScore": 1.0 - 0.1 * i, "imageScores": [{"filename": "x.png"}, {"filename": "y.png"}]}
    meta = {"runDirectory": "run_1", "selectedEngine": "tesseract", "scoringMode": "other", "parameterConfigs": {"a": {"enabled": True}}, "optimizerSettings": {"iterations": 9, "initialSamples": 99, "candidateSamples": 3}}

    def write(name, value):
        (tmp_path / name).write_text(json.dumps(value))

    with pytest.raises(ValueError, match="run_meta"):
        write("other.json", {})
        readers.resumed(spark, str(tmp_path))
    write("run_meta.json", meta)
    write("all_results.json", {"results": [result(1, True), result(0, False)], "totalIterations": 4.0})
    write("run_inputs.json", {"images": [{"filename": "x.png", "mimeType": "image/png", "dataUrl": "data:,"}, {"filename": 3}]})
    run = readers.resumed(spark, str(tmp_path))
    assert (run["iterations"], run["initialSamples"], run["candidateSamples"], run["scoringMode"], run["images"], len(run["inputs"])) == (4, 4, 50, "fulltext", ["x.png", "y.png"], 1)
    history = readers.replayed(run)
    assert [h["id"] for h in history] == [0, 1] and history[1]["parameters"] == {"a": "true"}
    done = optimize.search(spark, params.dimensions({"a": {"enabled": True}, "b": {"enabled": True, "selectedValues": [1, 2]}}), lambda i, p: 0.5, 4, 1, candidates=8, history=history)
    assert len(done) == 4 and done[:2] == history
    for wrong in ({"selectedEngine": "x"}, {"parameterConfigs": []}, {"runDirectory": "../x"}):
        write("run_meta.json", meta | wrong)
        with pytest.raises(ValueError):
            readers.resumed(spark, str(tmp_path))


def test_continuous_search_and_nearest_surrogate(spark):
    from scriptorium.plans import optimize

    ranges = [("a", 0.0, 2.0, 0.25, False), ("b", 1.0, 9.0, None, True)]
    found = optimize.search_continuous(spark, ranges, lambda i, p: (p["a"] - 1) ** 2 + (p["b"] - 5) ** 2 / 16, 10, 4, candidates=60)
    assert len(found) == 10 and all(r["parameters"]["a"] % 0.25 == 0 and r["parameters"]["b"] == int(r["parameters"]["b"]) for r in found)
    assert min(r["score"] for r in found[4:]) <= min(r["score"] for r in found[:4]) + 1e-9
    points = spark.createDataFrame([([0.0, 0.0],), ([1.0, 1.0],)], "x array<double>")
    seen = spark.createDataFrame([([0.0, 0.0], 0.5), ([0.0, 1.0], 0.9)], "x array<double>, y double")
    got = [r.value for r in optimize.nearest_surrogate(points, seen).collect()]
    assert got == pytest.approx([0.05, 0.5]) and optimize.nearest_surrogate(points, seen.limit(0)).where("value is not null").count() == 0


def test_reports_name_every_column_of_ranges(spark):
    need = spark.createDataFrame([("b", 5), ("a", 9)], "filename string, pos int")
    from scriptorium.sources import readers

    rows = readers.in_required_order(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "filename string, v int"), need).collect()
    assert [(r.filename, r.pos) for r in rows] == [("b", 1), ("a", 2)]


def test_detections_crops_and_texts(spark):
    rows = [(0.1, 0.1, 0.5, 0.2, 0.9, 9.0), (0.1, 0.1, 0.5, 0.2, 0.1, 9.0), (0.0, 0.0, 1.0, 1.0, 0.8, 8.4), (0.1, 0.1, 0.2, 0.2, 0.9, 40.0), (0.1, 0.1, 0.2, 0.2, 0.9, None)]
    df = spark.createDataFrame(rows, "xmin double, ymin double, xmax double, ymax double, score double, id double")
    found = geometry.detections(df, 0.3, F.lit(1000), F.lit(500))
    got = sorted((r.label, r.x, r.y, r.width, r.height) for r in found.collect())
    assert got == [("Table", 2, 2, 996, 496), ("Text", 100, 50, 400, 50)] and geometry.table_regions(found).count() == 1 and geometry.text_regions(found).count() == 2
    safe, plain = geometry.safely_cropped(*map(F.lit, (-5.0, 96.0, 3.0, 50.0, 100, 100)), padding=4), geometry.table_cropped(*map(F.lit, (-5.0, 96.0, 3.0, 50.0, 100, 100)), padding=4)
    one = spark.range(1).select(*[c.cast("int").alias(f"s{i}") for i, c in enumerate(safe)], *[c.cast("int").alias(f"t{i}") for i, c in enumerate(plain)], T.joined_answer(F.array(F.lit(" a"), F.lit(""), F.lit(None), F.lit("b "))).alias("j")).first()
    assert tuple(one) == (2, 88, 11, 10, 0, 92, 11, 8, "a\nb")
    assert params.space_text({}) == "1 Iteration (Standard-Konfiguration)" and params.space_text({"x.k": {"enabled": True, "selectedValues": [1, 2, 3]}, "m": {"enabled": True}, "n": {"enabled": False}}) == "6 Iterationen (3 k × 2 m)"
    text = params.export({"a": {"b-c": 1}}, ["x.png"], 0.125, 0.5, "2020-01-01", [("x.png", 0.1, 0.2)])
    assert text.startswith("// Images: x.png\n// CER: 12.50%, WER: 50.00%\n") and '"b-c": 1' in text and "// x.png: CER 10.00%, WER 20.00%" in text
    regions = spark.createDataFrame([(1, 2, " b "), (1, 1, "a"), (1, 3, " "), (1, 4, None), (2, 1, None)], "page int, ordinal int, text string")
    assert {r.page: (r.full_text, r.regions) for r in evaluation.written_truth(regions, ["page"]).collect()} == {1: ("a\nb", 2), 2: ("", 0)}
    assert evaluation.of_scripts(spark.createDataFrame([("Print",), ("handwriting",), (None,)], "script string"), ("print",)).count() == 1


def test_session(spark):
    from scriptorium.plans.session import DEFAULTS, Session, register_table_functions

    s = Session(spark)
    s.preset("fastMode")
    assert s.config["layout"]["enabled"] is False and s.config["paddleocr"]["version"] == "v3" and s.config["rotation"]["skipThreshold"] == 65
    assert s.reset() == DEFAULTS and s.set_base({"engine": "noisy"})["engine"] == "noisy" and s.default("layout.xyCut.maxDepth") == "14" and s.default("a.b") == "-"
    s.tuning_preset("recall-rescue")
    assert s.config["engine"] == "tesseract" and s.settings["iterations"] == 120 and params.space_size(params.dimensions(s.space)) == 960
    s.space, s.settings = {"k": {"enabled": True, "selectedValues": [3, 1, 2]}}, {"iterations": 3, "initialSamples": 3, "candidateSamples": 5}
    docs = spark.createDataFrame([(1, 0.1), (2, 0.3)], "doc int, w double")
    rates = lambda p: F.struct((F.try_element_at(p, F.lit("k")).cast("double") * F.col("w")).alias("wer"), F.col("w").alias("cer"), F.lit(1.0).alias("length_ratio"), F.lit(0.0).alias("underproduction"), F.lit(False).alias("is_empty"), F.lit(False).alias("is_very_short"))
    assert s.become("paused") == "idle"
    done = s.run(docs, rates)
    assert s.state == "completed" and len(done) == 3 and s.best()["parameters"] == {"k": "1"} and s.best()["score"] == pytest.approx(0.2)
    assert s.become("idle") == "idle" and s.best() is None
    register_table_functions(spark)
    assert [r.value for r in spark.sql("SELECT value FROM linspace(1.5, 2.5, 3) ORDER BY place").collect()] == [1.5, 2.0, 2.5]
    assert [r.key for r in spark.sql("""SELECT key FROM permutations('{"a": {"enabled": true}, "b": {"enabled": true, "selectedValues": [1, 2]}}') ORDER BY permutation""").collect()] == ["a=true|b=1", "a=true|b=2", "a=false|b=1", "a=false|b=2"]
    assert spark.sql("SELECT count(*) AS n FROM VALUES (0.0D, 5.0D, 20.0D, 10.0D), (NULL, 1.0D, 1.0D, 1.0D) AS b(x, y, w, h), LATERAL cells(x, y, w, h, 10.0D)").first().n == 4
