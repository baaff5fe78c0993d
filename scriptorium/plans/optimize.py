"""Seeded surrogate search whose evaluations are distributed."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.maths import expected_improvement
from ..functions.text import parameter_key
from ..operators.evaluation import denormalised, random_points
from .params import sample, space_size, unseen


class GaussianProcess:
    """Zero-mean regression with a squared-exponential kernel; variances have a floor."""

    def __init__(self, length: float = 0.5, variance: float = 1.0, noise: float = 0.1, floor: float = 1e-4):
        self.length, self.variance, self.noise, self.floor = length, variance, noise, floor
        self.x, self.y = np.zeros((0, 0)), np.zeros(0)

    def kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = ((a[:, None] - b[None]) ** 2).sum(2)
        return self.variance * np.exp(-0.5 * d / self.length**2)

    def observe(self, x: list[float], y: float) -> None:
        row = np.atleast_2d(np.asarray(x, dtype=float))
        self.x = row if not len(self.y) else np.vstack((self.x, row))
        self.y = np.append(self.y, y)
        self.solved: tuple[np.ndarray, np.ndarray] | None = None

    def solve(self) -> tuple[np.ndarray, np.ndarray]:
        """The inverse of the observations' kernel and its product with their values; solved once for all batches of candidates."""
        if getattr(self, "solved", None) is None:
            inverse = np.linalg.inv(self.kernel(self.x, self.x) + self.noise * np.eye(len(self.y)))
            self.solved = inverse, inverse @ self.y
        return self.solved

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.y):
            return np.zeros(len(x)), np.full(len(x), self.variance)
        inverse, weights = self.solve()
        cross = self.kernel(x, self.x)
        return cross @ weights, np.maximum(self.variance - ((cross @ inverse) * cross).sum(1), self.floor)


#: Draws in which an unseen random permutation is looked for.
DRAWS = 21


def position(parameters: dict[str, str], dims: list[tuple[str, list[str]]]) -> list[float]:
    """M5: each value's place in its dimension, from 0 to 1; unknown values are at 0."""
    out = []
    for path, values in dims:
        v = parameters.get(path)
        out.append(values.index(v) / (len(values) - 1) if v in values and len(values) > 1 else 0.0)
    return out


def with_improvement(spark: SparkSession, gp: GaussianProcess, points: DataFrame, at: Callable[[object], list[float]], column: str, best: float) -> DataFrame:
    """``points`` (draw, ...) with ``ei``: the expected improvement at each point, which ``at`` makes of ``column``; batches go to the executors."""
    if len(gp.y):
        gp.solve()
    model = spark.sparkContext.broadcast(gp)

    def score(frames):  # noqa: ANN001, ANN202
        for f in frames:
            mean, variance = model.value.predict(np.array([at(v) for v in f[column]]))
            yield f.assign(mean=mean, deviation=np.sqrt(variance))

    schema = ", ".join(f"{n} {t}" for n, t in points.dtypes) + ", mean double, deviation double"
    return points.mapInPandas(score, schema).withColumn("ei", expected_improvement(F.col("mean"), F.col("deviation"), F.lit(float(best))))


def suggest(spark: SparkSession, gp: GaussianProcess, dims: list[tuple[str, list[str]]], best: float, seen: set[str], candidates: int, seed: int) -> dict[str, str]:
    """The unseen candidate with the largest expected improvement, the first draw of equal ones; some
    candidate if all are seen."""
    drawn = sample(spark, dims, candidates, seed).withColumn("key", parameter_key(F.col("parameters")))
    scored = with_improvement(spark, gp, drawn, lambda p: position(dict(p), dims), "parameters", best)
    order = [F.desc("ei"), "draw"]
    top = unseen(scored, spark.createDataFrame([(k,) for k in seen], "key string")).orderBy(*order).select("parameters").first() if seen else None
    return dict((top or scored.orderBy(*order).select("parameters").first()).parameters)


def search(spark: SparkSession, dims: list[tuple[str, list[str]]], evaluate: Callable[[int, dict[str, str]], float], iterations: int, initial: int, candidates: int = 600, seed: int = 7, history: list[dict] | None = None) -> list[dict]:
    """Random draws first, then suggestions; a repeated draw is drawn again up to 20 times; failing
    evaluations leave no result. ``history`` resumes an earlier run at its number of results."""
    results = list(history or [])
    gp, seen = GaussianProcess(), set()
    key = lambda p: "|".join(sorted(f"{k}={v}" for k, v in p.items()))
    for r in results:
        gp.observe(position(r["parameters"], dims), r["score"])
        seen.add(key(r["parameters"]))
    for i in range(len(results), iterations):
        if len(seen) >= space_size(dims):
            break
        best = min((r["score"] for r in results), default=math.inf)
        if i < initial or not results:
            drawn = [dict(r.parameters) for r in sample(spark, dims, DRAWS, seed * 1_000_003 + i).orderBy("draw").select("parameters").collect()]
            chosen = next((p for p in drawn if key(p) not in seen), drawn[-1])
        else:
            chosen = suggest(spark, gp, dims, best, seen, candidates, seed * 1_000_003 + i)
        try:
            score = float(evaluate(i, chosen))
        except Exception:  # noqa: BLE001  a failing evaluation is skipped, as the run goes on
            continue
        seen.add(key(chosen))
        gp.observe(position(chosen, dims), score)
        results.append({"id": i, "parameters": chosen, "score": score})
    return results


Range = tuple[str, float, float, float | None, bool]


def search_continuous(spark: SparkSession, ranges: list[Range], evaluate: Callable[[int, dict[str, float]], float], iterations: int, initial: int, candidates: int = 1000, seed: int = 7) -> list[dict]:
    """As ``search`` over ranges (path, low, high, step, whole) instead of listed values: random points of the unit cube are scored
    and the chosen one's values are put on each range's grid."""
    results, gp = [], GaussianProcess()
    for i in range(iterations):
        first = i < initial or not results
        points = random_points(spark, 1 if first else candidates, len(ranges), seed * 1_000_003 + i)
        if not first:
            points = with_improvement(spark, gp, points, list, "x", min(r["score"] for r in results)).orderBy(F.desc("ei"), "draw")
        values = dict(denormalised(points.limit(1), ranges).first().parameters)
        try:
            score = float(evaluate(i, values))
        except Exception:  # noqa: BLE001  a failing evaluation is skipped, as the run goes on
            continue
        gp.observe([0.0 if high == low else (values[path] - low) / (high - low) for path, low, high, _, _ in ranges], score)
        results.append({"id": i, "parameters": values, "score": score})
    return results


#: Observations that a nearest-neighbour surrogate takes, at most.
MOST_OBSERVED = 2000


def nearest_surrogate(candidates: DataFrame, observed: DataFrame, vector: str = "x") -> DataFrame:
    """Half the root of the distance to the nearest observation, and half what it promises below the best.
    ``observed`` (x, y) is the search's own history, MOST_OBSERVED rows at most, which goes along as a constant; none leaves value null."""
    history = observed.select(vector, "y").limit(MOST_OBSERVED + 1).collect()
    if len(history) > MOST_OBSERVED:
        raise ValueError(f"more than {MOST_OBSERVED} observations")
    constant = F.from_json(F.lit(json.dumps([{"x": [float(v) for v in r[0]], "y": float(r[1])} for r in history])), "array<struct<x:array<double>,y:double>>")
    near = F.array_min(F.transform(constant, lambda o: F.struct(F.sqrt(F.aggregate(F.zip_with(o["x"], F.col(vector), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)).alias("d"), o["y"].alias("y"))))
    best = min((float(r[1]) for r in history), default=math.nan)
    return candidates.withColumn("_n", near).withColumn("value", 0.5 * F.sqrt(F.col("_n.d")) + 0.5 * F.greatest(F.lit(0.0), F.lit(best) - F.col("_n.y") + 0.1)).drop("_n")
