"""Scores of text-recognition runs as grouped aggregates (survey ids A1-A10, Q6, Q9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.maths import clamp, least, sql_round
from .sequences import MOST_GROUPS, matched

# Weights, bounds and limits of the robust score.
CER_WEIGHT, WER_WEIGHT, CAP = 0.6, 0.4, 2.5
UNDER, OVER, MEDIAN, EMPTY, SHORT = 0.7, 0.2, 0.5, 1.1, 0.45
MEDIAN_GOAL, MEDIAN_MOST, INFEASIBLE = 0.85, 1.2, 0.8
MOST_EMPTY, LEAST_MEDIAN, MOST_SHORT, MOST_UNDER = 0.25, 0.45, 0.5, 0.65
NO_ROWS = 10.0
MODES = ("fulltext", "regions", "customWER")


def legacy_score(cer: Column, wer: Column, cer_weight: float = 0.7, wer_weight: float = 0.3) -> Column:
    """A2."""
    return cer * cer_weight + wer * wer_weight


def scored_pairs(pairs: DataFrame, guess: str, truth: str) -> DataFrame:
    """``pairs`` with cer, wer and the length diagnostics. Rows whose truth is null or empty go."""
    g, t = T.normalise(F.coalesce(F.col(guess), F.lit(""))), T.normalise(F.col(truth))
    rows = pairs.where(F.col(truth).isNotNull() & (F.col(truth) != "")).withColumns({"_g": g, "_t": t})
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    rows = rows.withColumns({"_gw": words("_g"), "_tw": words("_t"), "guess_length": F.length("_g"), "truth_length": F.length("_t")})
    gl, tl = F.col("guess_length"), F.col("truth_length")
    return rows.withColumns({
        "cer": T.error_rate(F.levenshtein("_g", "_t"), tl, gl),
        "wer": T.error_rate(T.word_distance(F.col("_gw"), F.col("_tw")), F.size("_tw"), F.size("_gw")),
        "length_ratio": T.length_ratio(gl, tl), "underproduction": T.underproduction(gl, tl),
        "is_empty": gl == 0, "is_very_short": T.very_short(gl, tl),
    }).drop("_g", "_t", "_gw", "_tw")


def robust_score(rows: DataFrame, by: list[str]) -> DataFrame:
    """One aggregate per group over cer, wer, length_ratio, underproduction, is_empty and is_very_short.
    Without ``by`` an empty input scores NO_ROWS and is infeasible. Rows with a null rate are left out of that rate's mean."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(CER_WEIGHT * least(F.col("cer"), F.lit(CAP)) + WER_WEIGHT * least(F.col("wer"), F.lit(CAP))).alias("base"),
        F.avg("underproduction").alias("under"), F.avg(clamp(F.col("length_ratio") - 1, 0.0, 2.0)).alias("over"),
        F.median("length_ratio").alias("median_ratio"), share("is_empty").alias("empty_rate"), share("is_very_short").alias("short_rate"),
    )
    out = out.withColumn("feasible", F.coalesce((F.col("empty_rate") <= MOST_EMPTY) & (F.col("median_ratio") >= LEAST_MEDIAN) & (F.col("short_rate") <= MOST_SHORT) & (F.col("under") <= MOST_UNDER), F.lit(False)))
    score = F.col("base") + UNDER * F.col("under") + OVER * F.col("over") + MEDIAN * clamp((MEDIAN_GOAL - F.col("median_ratio")) / MEDIAN_GOAL, 0.0, MEDIAN_MOST) + EMPTY * F.col("empty_rate") + SHORT * F.col("short_rate")
    return out.withColumn("score", F.when(F.col("n") == 0, NO_ROWS).otherwise(score + F.when(F.col("feasible"), 0.0).otherwise(INFEASIBLE)))


def rounded_means(rows: DataFrame, by: list[str], values: list[str], position: dict[str, Column], digits: int = 6) -> DataFrame:
    """A1: means of doubles, rounded as if each group's values were added up one by one by ``position`` (new names and their columns).
    Groups are summed in any order first; only those with a mean so near to half a last digit that the order may decide it are sorted
    and summed again."""
    found = rows.groupBy(*by).agg(*[c for v in values for c in (F.avg(v).alias(v), F.avg(F.abs(F.col(v))).alias(f"_abs_{v}"), F.count(v).alias(f"_n_{v}"))])
    near = F.lit(False)
    for v in values:
        # Two orders of n doubles differ by 2n roundings of at most 2^-53 of the sum of magnitudes; this is twice that, and some for the quotient.
        scaled, slack = F.col(v) * 10.0**digits, F.col(f"_abs_{v}") * 10.0**digits * (F.col(f"_n_{v}") + 8) * 2.0**-51
        near = near | F.coalesce(F.abs(F.abs(scaled) % 1.0 - 0.5) <= slack, F.lit(False))
    upto = Window.partitionBy(*by).orderBy(*position).rowsBetween(Window.unboundedPreceding, 0)
    sums = matched(rows.select(*by, *values, *[c.alias(p) for p, c in position.items()]), found.where(near).select(*by), by).select(*by, F.struct(*position).alias("_at"), *[F.sum(v).over(upto).alias(v) for v in values])
    sums = sums.groupBy(*by).agg(F.max_by(F.struct(*values), "_at").alias("_sums")).select(*[F.col(k).alias(f"_key_{k}") for k in by], "_sums")
    few = sums.limit(MOST_GROUPS + 1).collect()  # as a table of their own they aren't summed again by each later job
    sums = F.broadcast(rows.sparkSession.createDataFrame(few, sums.schema)) if len(few) <= MOST_GROUPS else sums
    on = F.lit(True)
    for i, k in enumerate(by):
        on = F.col(k).eqNullSafe(F.col(f"_key_{k}")) if not i else on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    both = found.join(sums, on, "left")
    return both.select(*by, *[sql_round(F.coalesce(F.col(f"_sums.{v}") / F.col(f"_n_{v}"), F.col(v)), digits).alias(v) for v in values])


def worst_first(by: list[str], value: str, position: list[str]) -> Column:
    """1 for a group's worst row; ties go to the earlier position."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), *position))


def drop_worst(rows: DataFrame, by: list[str], position: list[str]) -> DataFrame:
    """Three means that leave out a group's worst row.

    wer_drop_max leaves out the largest wer where there are two rows or more; wer_drop1 and cer_drop1 leave out
    the row with the largest wer, but keep a single one; mixed_drop leaves out the row with the
    largest legacy score. All are aggregates by position of an arg-max, so no group is sorted or gathered."""
    wide = rows.withColumn("_mix", legacy_score(F.col("cer"), F.col("wer")))
    order = F.struct(*[(-F.col(p)).alias(p) for p in position])
    agg = wide.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("wer").alias("_w"), F.sum("cer").alias("_c"), F.sum("_mix").alias("_m"), F.max("wer").alias("_mw"),
        F.max(F.struct(F.col("wer"), order.alias("o"), F.col("cer"))).alias("_a"), F.max("_mix").alias("_mm"),
    )
    rest = lambda total, worst: F.when(F.col("n") > 1, (total - worst) / (F.col("n") - 1)).otherwise(total)
    return agg.select(*by, "n", rest(F.col("_w"), F.col("_mw")).alias("wer_drop_max"), rest(F.col("_w"), F.col("_a.wer")).alias("wer_drop1"), rest(F.col("_c"), F.col("_a.cer")).alias("cer_drop1"), rest(F.col("_m"), F.col("_mm")).alias("mixed_drop"))


def split_metrics(scores: DataFrame, name: str = "filename", position: str = "pos", by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Per split (of each of ``by``) the count, means, drop-one means and the document dropped."""
    worst = F.max(F.struct(F.col("wer"), (-F.col(position)).alias("p"), F.col("cer"), F.col(name).alias("name")))
    agg = scores.groupBy(*by, "split").agg(F.count("*").alias("n"), F.sum("wer").alias("_w"), F.sum("cer").alias("_c"), worst.alias("_x"))
    rest = lambda total, x: F.when(F.col("n") > 1, (total - x) / (F.col("n") - 1)).otherwise(total)
    return agg.select(*by, "split", "n", (F.col("_w") / F.col("n")).alias("wer_mean"), (F.col("_c") / F.col("n")).alias("cer_mean"), rest(F.col("_w"), F.col("_x.wer")).alias("wer_drop1"), rest(F.col("_c"), F.col("_x.cer")).alias("cer_drop1"), F.col("_x.name").alias("dropped"), F.col("_x.wer").alias("dropped_wer"))


def weighted_rates(rows: DataFrame, by: list[str], weight: str = "weight") -> DataFrame:
    """Weighted means of cer and wer; 1 where no weight is left."""
    total = F.sum(weight)
    mean = lambda c: F.when(total > 0, F.sum(F.col(weight) * F.col(c)) / total).otherwise(1.0)
    return rows.groupBy(*by).agg(mean("cer").alias("cer"), mean("wer").alias("wer"))


def iteration_scores(rows: DataFrame, by: list[str], mode: str, position: list[str]) -> DataFrame:
    """A10: the score of each iteration by mode. In mode customWER it is the mean wer without the worst, but a
    single row gets the robust score (Q6); in mode fulltext and regions it is the robust score."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    robust = robust_score(rows, by)
    if mode != "customWER":
        return robust
    custom = drop_worst(rows, by, position).select(*by, F.col("wer_drop_max").alias("_custom"))
    return robust.join(custom, by).withColumn("score", F.when(F.col("n") > 1, F.col("_custom")).otherwise(F.col("score"))).drop("_custom")


def best_row(rows: DataFrame, by: list[str], score: str, position: str) -> DataFrame:
    """The row with the smallest score, the first of equal ones."""
    fields = [c for c in rows.columns if c not in (*by, score, position)]
    best = F.min(F.struct(score, position, *fields)).alias("_b")
    return rows.groupBy(*by).agg(best).select(*by, "_b.*")


def upper_median(values: Column) -> Column:
    """A5: the upper one of the middle values."""
    return F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)
