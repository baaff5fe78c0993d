"""Parameter spaces as DataFrames."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = "path string, kind string, group string, engine string, low double, high double, step double, options array<string>"


def values_of(config: dict) -> list[str]:
    """M2: canonical strings of a parameter's values; a number's are evenly spaced and rounded to three decimals."""
    if not config.get("enabled"):
        return []
    if "steps" in config:
        n = config["steps"]
        if n <= 0:
            return []
        gap = 0 if n == 1 else (config["max"] - config["min"]) / (n - 1)
        return [canonical(math.floor((config["min"] + gap * i) * 1000 + 0.5) / 1000) for i in range(n)] if n > 1 else [canonical(config["min"])]
    if "selectedValues" in config:
        return [canonical(v) for v in config["selectedValues"]]
    return ["true", "false"]


def canonical(value: object) -> str:
    """A parameter value as text; whole numbers have no decimals."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def typed(text: str) -> bool | int | float | str:
    if text in ("true", "false"):
        return text == "true"
    try:
        number = float(text)
    except ValueError:
        return text
    return int(number) if number.is_integer() and "." not in text else number


def dimensions(configs: dict[str, dict]) -> list[tuple[str, list[str]]]:
    """B1: enabled parameters with at least one value."""
    return [(path, values) for path, config in configs.items() if (values := values_of(config))]


def enabled_paths(configs: dict[str, dict]) -> list[str]:
    """P3."""
    return [path for path, config in configs.items() if config.get("enabled")]


def space_text(configs: dict[str, dict]) -> str:
    """the size of a space and what it is made of."""
    if not enabled_paths(configs):
        return "1 Iteration (Standard-Konfiguration)"
    dims = dimensions(configs)
    return f"{space_size(dims)} Iterationen ({' × '.join(f'{len(values)} {path.rsplit(chr(46), 1)[-1]}' for path, values in dims)})"


def space_size(dims: list[tuple[str, list[str]]]) -> int:
    """1 for an empty space."""
    return math.prod(len(v) for _, v in dims)


def decoded(dims: list[tuple[str, list[str]]], number: Column) -> Column:
    """The combination of a number, as a map; the last dimension varies fastest."""
    below, entries = space_size(dims), []
    for path, values in dims:
        below //= len(values)
        at = F.pmod(F.floor(number / below), F.lit(len(values))).cast("int") + 1
        entries.append(F.struct(F.lit(path).alias("key"), F.element_at(F.array(*map(F.lit, values)), at).alias("value")))
    return F.map_from_entries(F.array(*entries)) if entries else F.create_map().cast("map<string,string>")


def grid(spark: SparkSession, dims: list[tuple[str, list[str]]]) -> DataFrame:
    """Every combination, decoded from its number, so that nothing is crossed or kept."""
    return spark.range(space_size(dims)).withColumnRenamed("id", "permutation").withColumn("parameters", decoded(dims, F.col("permutation")))


def sample(spark: SparkSession, dims: list[tuple[str, list[str]]], n: int, seed: int) -> DataFrame:
    """N seeded draws; each value depends on the draw's number and the path alone."""
    draws = spark.range(n).withColumnRenamed("id", "draw")
    entries = [F.struct(F.lit(p).alias("key"), F.element_at(F.array(*map(F.lit, v)), F.pmod(F.xxhash64(F.lit(seed), F.lit(p), "draw"), F.lit(len(v))).cast("int") + 1).alias("value")) for p, v in dims]
    return draws.withColumn("parameters", F.map_from_entries(F.array(*entries)) if entries else F.create_map().cast("map<string,string>"))


def unseen(candidates: DataFrame, seen: DataFrame, key: str = "key") -> DataFrame:
    """U4."""
    return candidates.join(seen.select(key).distinct(), key, "left_anti")


def for_engine(registry: DataFrame, engine: str) -> DataFrame:
    """Parameters of any engine or of this one."""
    return registry.where(F.col("engine").isNull() | (F.col("engine") == engine))


def parameter(registry: DataFrame, path: str) -> DataFrame:
    """The parameter with a path, none if there is no such."""
    return registry.where(F.col("path") == path)


def in_group(registry: DataFrame, group: str, engine: str) -> DataFrame:
    """A group's parameters that the engine has."""
    return registry.where(F.col("group") == group).join(for_engine(registry, engine).select("path"), "path", "left_semi")


def flatten(config: dict, prefix: str = "") -> dict[str, object]:
    """A nested config as dot paths; arrays are values."""
    out: dict[str, object] = {}
    for k, v in config.items():
        out |= flatten(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def set_path(config: dict, path: str, value: object) -> dict:
    """A copy with the value at a dot path; missing parents are made."""
    head, _, rest = path.partition(".")
    inner = config.get(head)
    return config | {head: set_path(inner if isinstance(inner, dict) else {}, rest, value) if rest else value}


def merged(*configs: dict) -> dict:
    """Objects are merged, arrays and scalars replaced, the later ones win."""
    out: dict = {}
    for config in configs:
        for k, v in config.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def applied(config: dict, parameters: dict[str, str]) -> dict:
    """A permutation's values set in a config."""
    for path, value in parameters.items():
        config = set_path(config, path, typed(value))
    return config


def merged_maps(base: str, over: str):  # noqa: ANN201
    """P17 on flat maps in a DataFrame: entries of ``over`` win."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k))
    return F.map_concat(kept, F.col(over))


def export(config: dict, images: list[str], cer: float, wer: float, date: str, scores: list[tuple[str, float, float]] = (), name: str = "TUNED_CONFIG") -> str:
    """K6: a tuned config as a TypeScript file, with what it was tuned on and each image's rates as comments."""
    rate = lambda x: f"{x * 100:.2f}%"
    head = [f"Images: {', '.join(images)}", f"CER: {rate(cer)}, WER: {rate(wer)}", f"Date: {date}", *[f"{n}: CER {rate(c)}, WER {rate(w)}" for n, c, w in scores]]
    return "".join(f"// {line}\n" for line in head) + "\n" + as_source(config, name)


def as_source(config: dict, name: str = "config") -> str:
    """A config as a TypeScript constant."""

    def text(v: object, indent: int) -> str:
        pad = "    " * (indent + 1)
        if isinstance(v, dict):
            if not v:
                return "{}"
            return "{\n" + "".join(f"{pad}{k if k.isidentifier() else json.dumps(k)}: {text(x, indent + 1)},\n" for k, x in v.items()) + "    " * indent + "}"
        return json.dumps(v, ensure_ascii=False)

    return f"export const {name} = {text(config, 0)};\n"


def by_prefix(parameters: dict[str, object], prefixes: tuple[str, ...] = ("nms", "fallback", "xyCut")) -> dict[str, dict]:
    """Flat keys like prefix_rest grouped by prefix."""
    out: dict[str, dict] = {}
    for key, value in parameters.items():
        head, _, rest = key.partition("_")
        out.setdefault(head, {})[rest] = value if head in prefixes else value
        if head not in prefixes or not rest:
            out[head].pop(rest)
            out.setdefault("other", {})[key] = value
    return {k: v for k, v in out.items() if v}


def clamped_settings(iterations: int, initial: int, candidates: int) -> dict[str, int]:
    """P27."""
    iterations = min(max(iterations, 1), 10_000)
    return {"iterations": iterations, "initialSamples": min(max(initial, 1), iterations), "candidateSamples": max(candidates, 50)}


# The three presets, each with its engine, its search settings and the parameters it varies.
PRESETS = {
    "tesseract-balanced": ("tesseract", {"iterations": 80, "initialSamples": 20, "candidateSamples": 400}, {
        "preprocessing.contrastBoost": {"enabled": True, "min": 1.5, "max": 2.5, "steps": 3},
        "preprocessing.dpiScaling.minCapitalHeightPx": {"enabled": True, "min": 18, "max": 30, "steps": 4},
        "preprocessing.dpiScaling.maxScale": {"enabled": True, "min": 3, "max": 5, "steps": 3},
        "preprocessing.clahe.enabled": {"enabled": True},
        "preprocessing.threshold.enabled": {"enabled": True},
        "output.minTextLength": {"enabled": True, "min": 1, "max": 2, "steps": 2},
        "output.minLineConfidence": {"enabled": True, "min": 0.2, "max": 0.45, "steps": 4},
    }),
    "paddle-focus": ("paddleocr", {"iterations": 120, "initialSamples": 30, "candidateSamples": 600}, {
        "paddleocr.language": {"enabled": True, "selectedValues": ["german", "latin"]},
        "paddleocr.detThreshold": {"enabled": True, "min": 0.2, "max": 0.45, "steps": 4},
        "paddleocr.boxThreshold": {"enabled": True, "min": 0.45, "max": 0.7, "steps": 4},
        "paddleocr.detInputSize": {"enabled": True, "min": 960, "max": 1600, "steps": 3},
        "paddleocr.unclipRatio": {"enabled": True, "min": 1.6, "max": 2.1, "steps": 3},
        "preprocessing.clahe.enabled": {"enabled": True},
    }),
    "recall-rescue": ("tesseract", {"iterations": 120, "initialSamples": 30, "candidateSamples": 600}, {
        "layout.enabled": {"enabled": True},
        "fallback.enabled": {"enabled": True},
        "rotation.enabled": {"enabled": True},
        "preprocessing.threshold.enabled": {"enabled": True},
        "preprocessing.threshold.type": {"enabled": True, "selectedValues": ["otsu", "adaptive"]},
        "preprocessing.contrastBoost": {"enabled": True, "min": 1.25, "max": 2.25, "steps": 5},
        "output.minTextLength": {"enabled": True, "min": 1, "max": 2, "steps": 2},
        "output.minLineConfidence": {"enabled": True, "min": 0.15, "max": 0.35, "steps": 3},
    }),
}
#: Steps of a number that is switched on, and the most it may have.
FIRST_STEPS, MOST_STEPS = 3, 20


def presets(spark: SparkSession) -> DataFrame:
    """A row for each preset's parameter with its values, and the size of the preset's space."""
    rows = [(name, engine, settings["iterations"], path, values, space_size(dims)) for name, (engine, settings, configs) in PRESETS.items() for dims in [dimensions(configs)] for path, values in dims]
    return spark.createDataFrame(rows, "preset string, engine string, iterations int, path string, values array<string>, space long")


def switched_on(registry: DataFrame) -> DataFrame:
    """The config that each parameter of a registry gets when it is switched on: a number its bounds (0 and 1 where it has none) and
    FIRST_STEPS steps, a choice all its options."""
    number, choice = F.col("kind") == "number", F.col("kind") == "enum"
    return registry.select(
        "path", "kind", F.when(number, F.coalesce("low", F.lit(0.0))).alias("min"), F.when(number, F.coalesce("high", F.lit(1.0))).alias("max"), F.when(number, FIRST_STEPS).alias("steps"),
        F.when(choice, F.coalesce("options", F.array().cast("array<string>"))).alias("selected"),
    )


def bounded_steps(steps: Column) -> Column:
    """The steps a number may have."""
    return F.when(steps.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(MOST_STEPS), steps)))
