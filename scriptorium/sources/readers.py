"""Sources (survey ids S1-S11, O13, J1, J2, J19, P1, P9): images, ground truth, datasets, manifests and runs as DataFrames."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_space_split, stem, trimmed
from ..operators.sequences import ranked_in_ranges

IMAGE_NAMES = r"(?i)\.(jpe?g|png|gif|bmp|webp|tiff?)$"
BOX = "struct<x:double,y:double,width:double,height:double>"
GROUND_TRUTH = f"schema string, fullText string, rotation double, image struct<filename:string,width:double,height:double>, regions array<struct<id:string,label:string,bbox:{BOX},text:string,order:int>>"


def _named(df: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return df.withColumn("filename", F.url_decode(F.regexp_replace(name, r"\+", "%2B"))).withColumn("key", stem(F.col("filename")))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Image files without marker streams; content is read only where it is used."""
    return _named(spark.read.format("binaryFile").load(folder)).where(F.col("filename").rlike(IMAGE_NAMES) & ~F.col("path").contains(":Zone.Identifier"))


def full_text(text: Column, regions: Column) -> Column:
    """S3: the text field, else the trimmed texts of usable regions, one a line."""
    return F.coalesce(text, trimmed(F.array_join(F.transform(regions, lambda r: trimmed(r["text"])), "\n")))


def ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """S3: .gt.json files; regions need a box and a text. A file that can't be parsed has null fields."""
    raw = _named(spark.read.option("wholetext", True).option("pathGlobFilter", "*.gt.json").text(folder).withColumn("path", F.input_file_name()))
    read = raw.withColumn("j", F.from_json("value", GROUND_TRUTH))
    good = read.withColumn("regions", F.filter("j.regions", lambda r: r["bbox"].isNotNull() & r["text"].isNotNull()))
    return good.select("key", "filename", full_text(F.col("j.fullText"), F.col("regions")).alias("full_text"), "regions", F.col("j.rotation").alias("rotation"), F.col("j.image.width").alias("width"), F.col("j.image.height").alias("height"))


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """S4."""
    return _named(spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").text(folder).withColumn("path", F.input_file_name())).select("key", "filename", F.col("value").alias("full_text"))


def with_ground_truth(images: DataFrame, truth: DataFrame, texts: DataFrame, prefer: str = "json") -> DataFrame:
    """Images with their truth by key, JSON before text files, or the other way round."""
    j, t = truth.select("key", F.col("full_text").alias("_j"), "regions"), texts.select("key", F.col("full_text").alias("_t"))
    both = images.join(j, "key", "left").join(t, "key", "left")
    first, second = ("_j", "_t") if prefer == "json" else ("_t", "_j")
    return both.withColumn("truth", F.coalesce(first, second)).withColumn("has_truth", F.col("truth").isNotNull()).drop("_j", "_t")


def line_dataset(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Lines of a file name, a space and a text; other lines are left out."""
    name, text = first_space_split(F.col("value"))
    out = spark.read.text(path).select(name.alias("filename"), text.alias("truth")).where(F.col("filename").isNotNull())
    return out if limit is None else out.limit(limit)


def sampled_lines(spark: SparkSession, path: str, n: int, seed: int | None = None) -> DataFrame:
    """The first n lines, or n lines in a seeded order."""
    lines = spark.read.text(path).withColumn("_n", F.monotonically_increasing_id())
    order = ["_n"] if seed is None else [F.xxhash64("value", F.lit(seed)), "_n"]
    return lines.orderBy(*order).limit(n).drop("_n")


def numbered(images: DataFrame, texts: DataFrame, first: int, last: int) -> DataFrame:
    """Documents with six-digit names that have both an image and a text."""
    wanted = images.sparkSession.range(first, last + 1).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("key"))
    return wanted.join(images, "key").join(texts.select("key", F.col("full_text").alias("truth")), "key")


def split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Filename and split from a manifest in any of its three shapes, the first that is there."""
    shape = "splits map<string,array<string>>, images array<struct<filename:string,split:string>>, assignments map<string,string>"
    read = spark.read.option("wholetext", True).text(path).select(F.from_json("value", shape).alias("j"))
    of_splits = F.flatten(F.transform(F.map_entries("j.splits"), lambda e: F.transform(e["value"], lambda f: F.struct(f.alias("filename"), e["key"].alias("split")))))
    of_map = F.transform(F.map_entries("j.assignments"), lambda e: F.struct(e["key"].alias("filename"), e["value"].alias("split")))
    rows = F.coalesce(of_splits, F.transform("j.images", lambda i: F.struct(i["filename"].alias("filename"), i["split"].alias("split"))), of_map, F.raise_error(F.lit("no assignments in the manifest")).cast("array<struct<filename:string,split:string>>"))
    return read.select(F.inline(rows))


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """Overriding fields by lower-case file name, from rows or a map."""
    fields = "source string, documentType string, condition string, script string"
    raw = spark.read.option("wholetext", True).text(path)
    row = f"array<struct<filename:string,{', '.join(f.replace(' ', ':') for f in fields.split(', '))}>>"
    plain = f"map<string,struct<{', '.join(f.replace(' ', ':') for f in fields.split(', '))}>>"
    from_map = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("filename"), *[e["value"][f.split()[0]].alias(f.split()[0]) for f in fields.split(", ")]))
    listed = F.transform(F.from_json("value", row), lambda r: F.struct(F.lower(r["filename"]).alias("filename"), *[r[f.split()[0]].alias(f.split()[0]) for f in fields.split(", ")]))
    inner = F.from_json(F.get_json_object("value", "$.images"), plain)
    return raw.select(F.inline(F.when(F.trim("value").startswith("["), listed).when(inner.isNotNull(), from_map(inner)).otherwise(from_map(F.from_json("value", plain)))))


def run_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of an earlier run in the order of their ids."""
    shape = "id long, parameters array<struct<path:string,value:string>>, combinedScore double, averageCER double, averageWER double"
    raw = spark.read.option("wholetext", True).text(path)
    listed = F.coalesce(F.from_json(F.get_json_object("value", "$.results"), f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in ('id long', 'parameters array<struct<path:string,value:string>>', 'combinedScore double', 'averageCER double', 'averageWER double'))}>>"), F.from_json("value", f"array<struct<{shape.replace('id long', 'id:long').replace('parameters array', 'parameters:array').replace('combinedScore double', 'combinedScore:double').replace('averageCER double', 'averageCER:double').replace('averageWER double', 'averageWER:double')}>>"))
    return raw.select(F.inline(listed)).orderBy("id")


# Engines, scoring modes and what a run folder's settings are where they don't say.
ENGINES, MODES = ("tesseract", "paddleocr"), ("regions", "customWER")
FIRST_SAMPLES, CANDIDATES, LEAST_CANDIDATES = 1, 600, 50


def _json_file(spark: SparkSession, folder: str, name: str) -> dict | None:
    """One file's object; None where there is no such file."""
    found = spark.read.option("wholetext", True).option("pathGlobFilter", name).text(folder).first()
    return None if found is None else json.loads(found.value)


def resumed(spark: SparkSession, folder: str) -> dict:
    """What an earlier run's folder says for going on with it; ValueError where it isn't usable. The number of iterations is the
    saved results', else the settings'. ``images`` are the names the run needs, from its settings or, else, its results."""
    meta, saved = _json_file(spark, folder, "run_meta.json"), _json_file(spark, folder, "all_results.json")
    if meta is None or saved is None:
        raise ValueError("the folder has no run_meta.json and all_results.json")
    name = meta["runDirectory"] if isinstance(meta.get("runDirectory"), str) else folder.rstrip("/").rsplit("/", 1)[-1]
    if not name or "/" in name or "\\" in name or ".." in name:
        raise ValueError("not a run folder's name")
    if meta.get("selectedEngine") not in ENGINES:
        raise ValueError("not a known engine")
    if not isinstance(meta.get("parameterConfigs"), dict):
        raise ValueError("no parameter configs")
    settings = meta.get("optimizerSettings") or {}
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)
    totals = [v for v in (saved.get("totalIterations"), settings.get("totalIterations"), settings.get("iterations")) if number(v)]
    total = math.floor(totals[0]) if totals else 0
    if total <= 0:
        raise ValueError("no number of iterations")
    results = sorted(saved["results"] if isinstance(saved.get("results"), list) else [], key=lambda r: r["id"])
    first, most = (v if number(v) else d for v, d in ((settings.get("initialSamples"), FIRST_SAMPLES), (settings.get("candidateSamples"), CANDIDATES)))
    images = [i["filename"] for i in meta.get("images") or [] if isinstance(i.get("filename"), str) and i["filename"]]
    images = images or list(dict.fromkeys(s["filename"] for r in results for s in r.get("imageScores") or []))
    inputs = (_json_file(spark, folder, "run_inputs.json") or {}).get("images")
    usable = [i for i in inputs if isinstance(i, dict) and all(isinstance(i.get(k), str) for k in ("filename", "mimeType", "dataUrl"))] if isinstance(inputs, list) else []
    return {
        "run": name, "engine": meta["selectedEngine"], "scoringMode": meta["scoringMode"] if meta.get("scoringMode") in MODES else "fulltext", "parameterConfigs": meta["parameterConfigs"],
        "iterations": total, "initialSamples": min(max(1, math.floor(first)), total), "candidateSamples": max(LEAST_CANDIDATES, math.floor(most)), "results": results, "images": images, "inputs": usable,
    }


def replayed(run: dict) -> list[dict]:
    """A resumed run's results as a search's history."""
    return [{"id": r["id"], "parameters": {p["path"]: str(p["value"]) if not isinstance(p["value"], bool) else str(p["value"]).lower() for p in r.get("parameters") or []}, "score": r["combinedScore"]} for r in run["results"]]


def missing(required: DataFrame, available: DataFrame, key: str = "filename") -> DataFrame:
    """Required names that aren't there."""
    return required.select(key).join(available.select(key), key, "left_anti")


def in_required_order(rows: DataFrame, required: DataFrame, key: str = "filename") -> DataFrame:
    """Rows by the place of their name in ``required`` (key, pos)."""
    return ranked_in_ranges(rows.join(required.select(key, F.col("pos").alias("_pos")), key), [], ["_pos", key], "pos").drop("_pos").orderBy("pos")


def line_words(result: Column, least_word: float, least_line: float, least_length: int) -> Column:
    """The kept lines of a recognition result: words by confidence, joined; then lines by length and confidence."""
    words = lambda line: F.array_join(F.filter(F.transform(F.filter(line["words"], lambda w: w["confidence"] >= least_word), lambda w: trimmed(w["text"])), lambda t: t != ""), " ")
    lines = F.transform(result, lambda line: F.struct(F.coalesce(words(line), trimmed(line["text"])).alias("text"), line["confidence"].alias("confidence")))
    return F.filter(lines, lambda line: (F.length(line["text"]) >= least_length) & (line["confidence"] >= least_line))
