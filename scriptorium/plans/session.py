"""A session: the current config, its presets and a run's life (survey ids B7, P20, T1, T8, section 2.13), and table functions for SQL."""

from __future__ import annotations

import copy
import json
import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, images, scoring
from . import optimize, params

# The config that a session begins with.
DEFAULTS = {
    "engine": "paddleocr",
    "paddleocr": {"version": "v5", "language": "german", "useWebGPU": True, "detThreshold": 0.3, "boxThreshold": 0.55, "detInputSize": 960, "limitType": "max", "recInputHeight": 48, "unclipRatio": 1.9, "regionPadding": 4},
    "rectification": {"enabled": True, "minContourConfidence": 0.8, "minDocumentArea": 0.475, "cannyLow": 195.5, "cannyHigh": 96.333, "blurSize": 1, "useAdaptiveThreshold": True},
    "preprocessing": {
        "enabled": True, "grayscale": True, "contrastBoost": 1.149, "dpiScaling": {"enabled": True, "minCapitalHeightPx": 46, "maxScale": 3.25}, "inversionDetection": {"enabled": True, "brightnessThreshold": 106.667},
        "clahe": {"enabled": True, "clipLimit": 0.5, "tileSize": 32}, "bilateralFilter": {"enabled": False, "diameter": 5, "sigmaColor": 75, "sigmaSpace": 75}, "threshold": {"enabled": False, "type": "otsu", "value": 128},
    },
    "layout": {
        "enabled": True, "detectionThreshold": 0.175, "regionPadding": 14, "internalPadding": 4,
        "textRegionTypes": ["Text", "Title", "Section-header", "Caption", "List-item", "Page-header", "Page-footer", "Footnote", "Table"],
        "psmModes": {"default": 6, "regionOverrides": {"Caption": 3, "Footnote": 3, "Page-header": 11, "Page-footer": 7}},
        "nms": {"iouThreshold": 0.6, "containmentThreshold": 0.3}, "xyCut": {"enabled": True, "minGapThreshold": 30, "spanningThreshold": 0.7, "maxDepth": 14},
    },
    "rotation": {"enabled": True, "fastMode": True, "skipThreshold": 65, "minImprovement": 3, "angleStep": 90},
    "fallback": {"enabled": True, "gridSize": 120, "minAreaRatio": 0.053, "minConfidence": 0.4},
    "table": {"enabled": False, "outputFormat": "markdown", "rowClusterTolerance": 15, "colClusterTolerance": 30},
    "output": {"minTextLength": 1, "minLineConfidence": 0.6, "minWordConfidence": 0.45},
    "debug": {"logTiming": True, "verbose": True},
}
# The config console's presets.
CONFIG_PRESETS = {
    "paddleV5": {"engine": "paddleocr", "paddleocr": {"version": "v5", "useWebGPU": True}, "debug": {"logTiming": True}},
    "paddleV3": {"engine": "paddleocr", "paddleocr": {"version": "v3", "useWebGPU": True}, "debug": {"logTiming": True}},
    "debug": {"debug": {"logTiming": True, "verbose": True}},
    "photoMode": {"rectification": {"enabled": True}, "preprocessing": {"clahe": {"enabled": True}}},
    "fastMode": {"engine": "paddleocr", "paddleocr": {"version": "v3"}, "layout": {"enabled": False}, "rotation": {"fastMode": True}, "fallback": {"enabled": False}},
}


class Session:
    """A config with its defaults, a parameter space and one run at a time. Evaluations are Columns (see operators.evaluation), so that a
    permutation is scored on all documents in one distributed pass."""

    def __init__(self, spark: SparkSession, defaults: dict | None = None):
        self.spark, self.defaults = spark, copy.deepcopy(defaults or DEFAULTS)
        self.config = copy.deepcopy(self.defaults)
        self.space: dict[str, dict] = {}
        self.settings = {"iterations": 60, "initialSamples": 15, "candidateSamples": 400}
        self.state, self.gate, self.results = "idle", evaluation.Gate(), []

    def set(self, partial: dict) -> dict:
        self.config = params.merged(self.config, partial)
        return self.config

    def reset(self) -> dict:
        self.config = copy.deepcopy(self.defaults)
        return self.config

    def preset(self, name: str) -> dict:
        return self.set(CONFIG_PRESETS[name])

    def set_base(self, partial: dict) -> dict:
        """New defaults, which hold at once."""
        self.defaults = params.merged(self.defaults, partial)
        return self.reset()

    def default(self, path: str) -> str:
        """P20."""
        return evaluation.default_value(self.defaults, path)

    def tuning_preset(self, name: str) -> None:
        """A preset's engine, space and settings take the place of the current ones."""
        engine, settings, configs = params.PRESETS[name]
        self.set({"engine": engine})
        self.space, self.settings = copy.deepcopy(configs), dict(settings)

    def become(self, wanted: str) -> str:
        """The state after a wish; pausing and going on open and close the gate that a run asks between evaluations."""
        before, self.state = self.state, evaluation.run_state(self.state, wanted)
        if (before, self.state) == ("running", "paused"):
            self.gate.pause()
        elif (before, self.state) == ("paused", "running"):
            self.gate.go_on()
        elif self.state == "idle":
            self.gate.stop()
            self.results = []
        return self.state

    def run_single(self, docs: DataFrame, evaluate: evaluation.Evaluate, parameters: dict[str, str]) -> dict:
        """One permutation on all documents; ``evaluate`` gives what robust_score aggregates."""
        scored = evaluation.evaluated(docs, [{"id": "single", "parameters": parameters}], evaluate)
        return scoring.robust_score(scored, ["candidate"]).first().asDict()

    def run(self, docs: DataFrame, evaluate: evaluation.Evaluate, resume: list[dict] | None = None, seed: int = 7) -> list[dict]:
        """Search the space, from a resumed run's results on; the best result is the first of those with the least score."""
        if self.become("running") != "running":
            raise ValueError(f"a run that is {self.state} can't start")
        self.gate = evaluation.Gate()

        def score(i: int, parameters: dict[str, str]) -> float:
            if not self.gate.passed():
                raise InterruptedError("stopped")
            return self.run_single(docs, evaluate, parameters)["score"]

        try:
            self.results = optimize.search(self.spark, params.dimensions(self.space), score, self.settings["iterations"], self.settings["initialSamples"], self.settings["candidateSamples"], seed, resume)
        except Exception:
            self.become("error")
            raise
        self.become("completed")
        return self.results

    def best(self) -> dict | None:
        return min(self.results, key=lambda r: r["score"], default=None)

    def recognise(self, inputs: DataFrame, engine: str | None = None, options: dict | None = None) -> DataFrame:
        """Section 2.13: text and confidence of each row's content by a registered engine, the config's where none is named."""
        return images.recognised(inputs, engine or self.config["engine"], options)


class _Linspace:
    def eval(self, low: float, high: float, steps: int) -> Iterator[tuple[int, float]]:
        for i, v in enumerate(params.values_of({"enabled": True, "min": float(low), "max": float(high), "steps": int(steps)})):
            yield i, float(v)


class _Permutations:
    def eval(self, configs: str) -> Iterator[tuple[int, str]]:
        dims = params.dimensions(json.loads(configs))
        for number in range(params.space_size(dims)):
            left, own = number, {}
            for path, values in reversed(dims):
                left, at = divmod(left, len(values))
                own[path] = values[at]
            yield number, "|".join(sorted(f"{k}={v}" for k, v in own.items()))


class _Cells:
    def eval(self, x: float, y: float, width: float, height: float, cell: float) -> Iterator[tuple[int, int]]:
        if None in (x, y, width, height) or width <= 0 or height <= 0:
            return
        x, y, width, height, cell = map(float, (x, y, width, height, cell))
        for row in range(math.floor(y / cell), math.ceil((y + height) / cell)):
            for column in range(math.floor(x / cell), math.ceil((x + width) / cell)):
                yield row, column


TABLE_FUNCTIONS: dict[str, tuple[Callable, str]] = {"linspace": (_Linspace, "place int, value double"), "permutations": (_Permutations, "permutation long, key string"), "cells": (_Cells, "row int, col int")}


def register_table_functions(spark: SparkSession) -> None:
    """Section 2.13: linspace(low, high, steps), permutations(configs as JSON) and cells(x, y, width, height, cell) for SQL."""
    for name, (cls, schema) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(cls, returnType=schema))
