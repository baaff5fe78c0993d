"""Evaluating candidates, permutations and regions (survey ids B8, B10, B12, B13, B15, J5-J8, I14, I22, I23, A16, A23, A24, K8-K10, O11, O12, O14, P11, P20, P23, P26, S12, S13, T1, T8, T9, M19).

An evaluation is a function of Columns: it takes a map of parameters and gives a struct with at least ``cer`` and ``wer``, so
that every candidate on every document is one map-side pass and no pairs are joined.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.maths import grid_value, half_up
from ..plans.params import canonical, decoded, space_size
from . import geometry, scoring, sequences, sets

Evaluate = Callable[[Column], Column]
# What a tuning run's and a comparison's settings are where they don't say.
OPTIMIZER = {"iterations": 60, "initialSamples": 15, "candidateSamples": 400}
SHARED = {"imagesDir": "./ocr_trainingdata/sel_gt", "splitManifest": None, "tuneSplit": "train", "scoringMode": "customWER"}
RANK_SPLIT = "test"
ENGINES = ("tesseract", "paddleocr")


def tuning_settings(config: dict) -> dict:
    """A tuning run's settings with defaults; an engine that isn't known is the first one."""
    base = config.get("baseConfig") or {}
    engine = base.get("engine") if base.get("engine") in ENGINES else ENGINES[0]
    return SHARED | {"iterateParams": {}, "optimizer": OPTIMIZER} | {k: v for k, v in config.items() if k != "baseConfig"} | {"baseConfig": base, "engine": engine}


def candidates(config: dict) -> list[dict]:
    """Id, label, notes and parameters (texts by path) of each candidate, whose parameters may be a list or an object."""
    listed = config.get("configs")
    if not isinstance(listed, list) or not listed:
        raise ValueError("the comparison lists no candidates")
    out = []
    for c in listed:
        own = c.get("parameters") or {}
        pairs = own.items() if isinstance(own, dict) else [(p["path"], p.get("value")) for p in own if isinstance(p, dict) and isinstance(p.get("path"), str)]
        out.append({"id": c.get("id") or c.get("label") or "unnamed", "label": c.get("label"), "notes": c.get("notes"), "parameters": {k: canonical(v) for k, v in pairs}})
    return out


def evaluated(docs: DataFrame, listed: list[dict], evaluate: Evaluate) -> DataFrame:
    """``docs`` once for each candidate, with ``position`` (its place in the list), ``candidate`` and what ``evaluate`` gives. The list
    is a config's and goes along as a constant."""
    of = lambda c: F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in c["parameters"].items()])) if c["parameters"] else F.create_map().cast("map<string,string>")
    constants = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c["id"]).alias("candidate"), of(c).alias("parameters")) for i, c in enumerate(listed)])
    return docs.select("*", F.inline(constants)).withColumn("_e", evaluate(F.col("parameters"))).select("*", "_e.*").drop("_e")


def by_split(scores: DataFrame, by: list[str], name: str, position: str) -> DataFrame:
    """Metrics of each of ``by`` on each split; rows whose ``error`` is not null make that split fail with the first message."""
    failed = F.min(F.struct(position, "error")) if "error" in scores.columns else F.lit(None).cast("struct<p:int,error:string>")
    good = scores.where(F.col("error").isNull()) if "error" in scores.columns else scores
    metrics = scoring.split_metrics(good, name, position, by)
    if "error" not in scores.columns:
        return metrics.withColumn("error", F.lit(None).cast("string"))
    errors = scores.where(F.col("error").isNotNull()).groupBy(*by, "split").agg(failed.alias("_f")).select(*by, "split", "_f.error")
    both = metrics.join(errors, [*by, "split"], "full")
    return both.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in metrics.columns if c not in (*by, "split", "n")})


def primary(metrics: DataFrame, by: list[str], rank_split: str) -> DataFrame:
    """``by`` with the split that it is ranked on and its mean wer (infinite where there is none)."""
    usable = metrics.where(F.col("error").isNull() & F.col("wer_mean").isNotNull())
    maps = metrics.select(*by).distinct().join(usable.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("split", "wer_mean"))).alias("m")), by, "left")
    m = F.coalesce("m", F.create_map().cast("map<string,double>"))
    return maps.withColumn("primary_split", sets.primary_split(m, rank_split)).withColumn("wer_mean", F.coalesce(F.try_element_at(m, F.col("primary_split")), F.lit(float("inf")))).drop("m")


def ranking(metrics: DataFrame, rank_split: str = RANK_SPLIT) -> DataFrame:
    """Candidates by the mean wer on their primary split; equal ones keep the list's order."""
    first = primary(metrics, ["position", "candidate"], rank_split)
    return sequences.ranked(first, [], ["wer_mean", "position"]).select("rank", "candidate", "primary_split", "wer_mean")


def comparison_report(ranked: DataFrame, metrics: DataFrame) -> DataFrame:
    """K9: one JSON text with the ranking and each candidate's metrics by split. Its rows are a config's candidates."""
    order = F.array_sort(F.collect_list(F.struct("rank", "candidate", "primary_split", F.nullif("wer_mean", F.lit(float("inf"))).alias("wer_mean")))).alias("ranking")
    of = metrics.groupBy("position", "candidate").agg(F.array_sort(F.collect_list(F.struct("split", "n", "wer_mean", "cer_mean", "wer_drop1", "cer_drop1", "dropped", "error"))).alias("metricsBySplit"))
    all_of = of.agg(F.array_sort(F.collect_list(F.struct("position", "candidate", "metricsBySplit"))).alias("candidates"))
    return ranked.agg(order).join(F.broadcast(all_of)).select(F.to_json(F.struct("ranking", "candidates")).alias("value"))


def two_phase(scores: DataFrame, tune_split: str, name: str, position: str) -> tuple[DataFrame, DataFrame]:
    """The candidates by their drop-one wer on the split they were tuned on (the best one first), and the best one's metrics on
    every split."""
    tuned = scoring.split_metrics(scores.where(F.col("split") == tune_split), name, position, ["position", "candidate"])
    ranked = sequences.ranked(tuned, [], ["wer_drop1", "position"])
    best = ranked.where("rank = 1").select("position")
    return ranked, by_split(scores.join(F.broadcast(best), "position", "left_semi"), ["candidate"], name, position)


def run_report(ranked: DataFrame, metrics: DataFrame, configured: int, timed_out: bool = False) -> DataFrame:
    """K8: one JSON text with the best result, its metrics by split, all results and whether the run is incomplete."""
    results = ranked.agg(
        F.count("*").alias("completed"), F.min_by(F.struct("candidate", "wer_drop1", "cer_drop1", "dropped"), "rank").alias("best"),
        F.array_sort(F.collect_list(F.struct("rank", "candidate", "wer_drop1", "cer_drop1"))).alias("allResults"),
    )
    splits = metrics.agg(F.array_sort(F.collect_list(F.struct("split", "n", "wer_mean", "cer_mean", "wer_drop1", "cer_drop1", "error"))).alias("metricsBySplit"))
    status = F.struct(F.col("completed").alias("completedIterations"), F.lit(configured).alias("configuredIterations"), F.lit(timed_out).alias("timedOut"), (F.lit(timed_out) | (F.col("completed") < configured)).alias("incomplete"))
    return results.join(F.broadcast(splits)).select(F.to_json(F.struct(status.alias("status"), "best", "metricsBySplit", "allResults")).alias("value"))


def grid_search(docs: DataFrame, dims: list[tuple[str, list[str]]], evaluate: Evaluate, position: list[str]) -> DataFrame:
    """Every permutation's drop-one rates over all documents, the best first. Permutations are numbers that are decoded beside each
    document, and their rates are added up before anything is shuffled."""
    every = docs.withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(space_size(dims) - 1)))).withColumn("parameters", decoded(dims, F.col("permutation")))
    rates = scoring.drop_worst(every.withColumn("_e", evaluate(F.col("parameters"))).select("permutation", *position, "_e.*"), ["permutation"], position)
    return sequences.ranked(rates, [], ["wer_drop1", "permutation"]).withColumn("parameters", decoded(dims, F.col("permutation")))


def archived(ranked: DataFrame, n: int = 5) -> DataFrame:
    """A run's best results."""
    return ranked.where(F.col("rank") <= n)


def scored_images(images: DataFrame, scores: DataFrame, chosen: Column, key: str = "filename") -> DataFrame:
    """Images with the scores that the chosen result gave them, null where it has none."""
    return images.join(scores.where(chosen).select(key, "cer", "wer"), key, "left")


def region_metrics(pages: DataFrame, truths: DataFrame, texts: DataFrame, page: str) -> tuple[DataFrame, DataFrame]:
    """Scores of each macro region, and each page's weighted rates. ``truths`` (page, region, label, truth) names regions
    and ``texts`` (page, region, guess) has what was read; pages without any truth have no rows, regions without one an empty truth."""
    known = pages.join(truths.select(page).distinct(), page, "left_semi")
    regions = geometry.macro_regions(known)
    t = truths.select(page, "region", F.col("label").alias("_label"), "truth")
    both = regions.join(t, [page, "region"], "left").join(texts.select(page, "region", "guess"), [page, "region"], "left")
    both = both.withColumns({"label": F.coalesce("_label", "label"), "truth": F.coalesce("truth", F.lit("")), "guess": T.trimmed(F.coalesce("guess", F.lit("")))})
    scored = both.withColumns({"weight": geometry.region_weight(F.col("label")), "cer": T.char_error_rate(F.col("guess"), F.col("truth")), "wer": T.word_error_rate(F.col("guess"), F.col("truth"))})
    scored = scored.select(page, "ordinal", "region", "label", "weight", "guess", "truth", "cer", "wer")
    return scored, scoring.weighted_rates(scored, [page])


def written_truth(regions: DataFrame, by: list[str], order: str = "ordinal", text: str = "text") -> DataFrame:
    """A page's ground truth from the answers for its macro regions: the trimmed texts in order, a line each, without empty ones."""
    own = regions.withColumn("_t", T.trimmed(F.col(text)))
    listed = F.array_sort(F.collect_list(F.when(F.col("_t") != "", F.struct(order, "_t"))))
    return own.groupBy(*by).agg(F.array_join(F.transform(listed, lambda r: r["_t"]), "\n").alias("full_text"), F.count_if(F.col("_t") != "").alias("regions"))


def of_scripts(images: DataFrame, scripts: tuple[str, ...]) -> DataFrame:
    """Images whose script is one of these."""
    return images.where(F.lower("script").isin(*[s.lower() for s in scripts]))


def mean_confidence(rows: DataFrame, by: list[str], value: str = "confidence") -> DataFrame:
    """0 where nothing was read."""
    return rows.groupBy(*by).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias(value))


def next_index(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """One more than the largest; 0 for none."""
    return rows.groupBy(*by).agg((F.coalesce(F.max(value), F.lit(-1)) + 1).alias("next"))


def distinct_names(results: DataFrame, by: list[str], nested: str, field: str = "filename") -> DataFrame:
    """The names that occur in nested results, once each."""
    return results.select(*by, F.explode(F.transform(nested, lambda r: r[field])).alias(field)).distinct()


def preview(values: Column, n: int = 3) -> Column:
    """The first few, and how many more there are."""
    rest = F.size(values) - n
    return F.concat(F.array_join(F.slice(values, 1, n), ", "), F.when(rest > 0, F.concat(F.lit(" +"), rest.cast("string"))).otherwise(""))


def ordered_corners(points: Column) -> Column:
    """topLeft, topRight, bottomRight and bottomLeft of four points (x, y), by the sum and the difference of their coordinates; the
    earlier of equal ones is first."""
    by = lambda value: F.array_sort(F.transform(points, lambda p, i: F.struct(value(p).alias("v"), i.alias("i"), p.alias("p"))))
    sums, diffs = by(lambda p: p["x"] + p["y"]), by(lambda p: p["y"] - p["x"])
    at = lambda a, i: F.get(a, F.lit(i))["p"]
    return F.struct(at(sums, 0).alias("topLeft"), at(diffs, 0).alias("topRight"), at(sums, 3).alias("bottomRight"), at(diffs, 3).alias("bottomLeft"))


def box_points(points: Column) -> Column:
    """The four points of a box clockwise from the top left: the two highest by x, then the two lowest from the right."""
    by_y = F.array_sort(F.transform(points, lambda p, i: F.struct(p["y"].alias("y"), i.alias("i"), p.alias("p"))))
    half = lambda a: F.transform(F.array_sort(F.transform(a, lambda s, i: F.struct(s["p"]["x"].alias("x"), i.alias("i"), s["p"].alias("p")))), lambda s: s["p"])
    return F.concat(half(F.slice(by_y, 1, 2)), F.reverse(half(F.slice(by_y, 3, 2))))


# The mean and the deviation of the channels of a detector's input.
CHANNEL_MEAN, CHANNEL_DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def detection_size(width: Column, height: Column, most: int, limit: str = "max", multiple: int = 32) -> Column:
    """Scale (at most 1, by the longer or the shorter side), the resized and the padded size of a detector's input."""
    side = F.greatest(width, height) if limit == "max" else F.least(width, height)
    scale = F.when(side.isNotNull(), F.least(F.lit(float(most)) / side, F.lit(1.0)))
    w, h = half_up(width * scale), half_up(height * scale)
    padded = lambda v: (F.ceil(v / multiple) * multiple).cast("long")
    return F.struct(scale.alias("scale"), w.alias("width"), h.alias("height"), padded(w).alias("padded_width"), padded(h).alias("padded_height"))


def normalised_channels(rgb: Column) -> Column:
    """A pixel's channels (0 to 255) as a detector takes them."""
    return F.array(*[(F.get(rgb, F.lit(i)) / 255 - m) / s for i, (m, s) in enumerate(zip(CHANNEL_MEAN, CHANNEL_DEVIATION, strict=True))])


def table_grid(words: DataFrame, by: str, order: str, row_tolerance: float = 15, column_tolerance: float = 30) -> DataFrame:
    """The cells of a table from its words (text and box, in reading order): rows and columns are clusters of the boxes' middles, and
    words of one cell are joined by spaces. ``grid`` with its Markdown and tab-separated forms; a table's words are few."""
    middle = words.withColumns({"_x": F.col("x") + F.col("width") / 2, "_y": F.col("y") + F.col("height") / 2})
    own = middle.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "text", "_x", "_y"))).alias("w"))
    clusters = lambda name, tolerance: sequences.anchored_clusters(F.array_distinct(F.transform("w", lambda s: s[name])), float(tolerance))
    own = own.withColumns({"_rows": clusters("_y", row_tolerance), "_columns": clusters("_x", column_tolerance)})
    placed = F.transform("w", lambda s: F.struct(sequences.nearest(F.col("_rows"), s["_y"]).alias("row"), sequences.nearest(F.col("_columns"), s["_x"]).alias("col"), s["text"].alias("text")))
    own = own.withColumn("cells", placed)
    upto = lambda name: F.coalesce(F.array_max(F.transform("cells", lambda c: c[name])), F.lit(-1)) + 1
    own = own.withColumns({"n_rows": upto("row"), "n_columns": upto("col")})
    count = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda r, c: F.array_join(F.transform(F.filter("cells", lambda x: (x["row"] == r) & (x["col"] == c)), lambda x: x["text"]), " ")
    own = own.withColumn("grid", F.transform(count("n_rows"), lambda r: F.transform(count("n_columns"), lambda c: cell(r, c))))
    return own.select(by, "n_rows", "n_columns", "grid", T.markdown(F.col("grid")).alias("markdown"), T.tab_separated(F.col("grid")).alias("tsv"))


#: Fields of a saved result's image scores.
SCORE_FIELDS = ("filename", "cer", "wer", "ocrLength", "groundTruthLength", "lengthRatio", "underproductionRate", "isEmptyOutput", "isVeryShortOutput")


def serialised(results: DataFrame, nested: str = "imageScores", fields: tuple[str, ...] = SCORE_FIELDS) -> DataFrame:
    """Results whose image scores have these fields only."""
    return results.withColumn(nested, F.transform(nested, lambda s: F.struct(*[s[f].alias(f) for f in fields])))


def per_document(scores: DataFrame, by: list[str], position: str, fields: tuple[str, ...]) -> DataFrame:
    """Each group's documents in order, as an array of the fields."""
    return scores.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(position, F.struct(*fields).alias("d")))), lambda s: s["d"]).alias("documents"))


# The states of a run that each state may be followed by.
RUN_STATES = {"idle": ("running",), "running": ("paused", "completed", "error", "idle"), "paused": ("running", "idle"), "completed": ("idle", "running"), "error": ("idle", "running")}


def run_state(current: str, wanted: str) -> str:
    """The state of a run after a wish: the wish where it may follow, else the current one."""
    return wanted if wanted in RUN_STATES.get(current, ()) else current


def run_states(wishes: DataFrame, by: list[str], order: list[str], wish: str) -> DataFrame:
    """The state that each group's wishes lead to, from idle, and how many were refused; a run's wishes are few."""
    follows = F.lit(False)
    step = lambda s, w: follows_any(s["state"], w)

    def follows_any(state: Column, w: Column) -> Column:
        out = follows
        for a, nexts in RUN_STATES.items():
            out = out | ((state == a) & w.isin(*nexts))
        return F.coalesce(out, F.lit(False))

    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(wish).alias("_w")))), lambda s: s["_w"])
    start = F.struct(F.lit("idle").alias("state"), F.lit(0).alias("refused"))
    fold = F.aggregate(listed, start, lambda s, w: F.struct(F.when(step(s, w), w).otherwise(s["state"]).alias("state"), (s["refused"] + F.when(step(s, w), 0).otherwise(1)).alias("refused")))
    return wishes.groupBy(*by).agg(fold.alias("_s")).select(*by, "_s.state", "_s.refused")


class Gate:
    """A run's pause and stop flags, asked between evaluations."""

    def __init__(self) -> None:
        self._open, self._stop = threading.Event(), threading.Event()
        self._open.set()

    def pause(self) -> None:
        self._open.clear()

    def go_on(self) -> None:
        self._open.set()

    def stop(self) -> None:
        self._stop.set()
        self._open.set()

    def passed(self, timeout: float | None = None) -> bool:
        """Whether the run may go on; waits while it is paused."""
        return self._open.wait(timeout) and not self._stop.is_set()


def in_sequence(messages: DataFrame, stream: str = "stream_id", seq: str = "seq") -> DataFrame:
    """Messages with their place in their stream and whether one is missing before them; of repeated numbers one counts."""
    once = messages.dropDuplicates([stream, seq])
    w = Window.partitionBy(stream).orderBy(seq)
    return once.withColumns({"place": F.row_number().over(w), "gap": F.coalesce(F.col(seq) - F.lag(seq).over(w) > 1, F.lit(False))})


def handled(messages: DataFrame, handle: Callable[[list[tuple]], list[tuple]], fields: list[str], kinds: str, stream: str = "stream_id", seq: str = "seq") -> DataFrame:
    """``handle`` on each stream's messages in order, one stream after the other in a task."""
    return geometry.per_image(messages.select(stream, *fields, seq), stream, [seq], handle, kinds)


def default_value(defaults: dict, path: str) -> str:
    """P20: the text of the default at a dot path; a dash where there is none."""
    from ..plans.params import canonical, decoded, space_size

    for key in path.split("."):
        if not isinstance(defaults, dict) or key not in defaults:
            return "-"
        defaults = defaults[key]
    return "-" if defaults is None else canonical(defaults)


def denormalised(shares: DataFrame, ranges: list[tuple[str, float, float, float | None, bool]]) -> DataFrame:
    """Points of the unit cube (array ``x``) as a map ``parameters`` of values on each range's (path, low, high, step, whole) grid."""
    entries = [F.struct(F.lit(path).alias("key"), grid_value(F.get("x", F.lit(i)), low, high, step, whole).cast("double").alias("value")) for i, (path, low, high, step, whole) in enumerate(ranges)]
    return shares.withColumn("parameters", F.map_from_entries(F.array(*entries)))


def random_points(spark: SparkSession, n: int, dims: int, seed: int) -> DataFrame:
    """N points of the unit cube; a coordinate depends on the seed, the point's number and its own alone."""
    unit = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "draw"), F.lit(1 << 40)) / float(1 << 40)
    return spark.range(n).withColumnRenamed("id", "draw").withColumn("x", F.array(*map(unit, range(dims))))
