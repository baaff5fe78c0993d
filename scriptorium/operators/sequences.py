"""Window and sequence operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """Places from 1 within groups; ``order`` must end in a tie-break."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


#: Groups whose first rows are broadcast, at most; above that the join shuffles.
MOST_GROUPS = 10_000
PLACE, RANGE = "_range_place", "_range"


def in_ranges(rows: DataFrame, by: str, parts: int | None = None, nulls_last: bool = False) -> DataFrame:
    """``rows`` with a number RANGE that never falls as ``by`` grows (nulls come first, as in a sort, or last), cut at quantiles, so that a
    sort of few large groups is many sorts of ranges. Equal values share a range."""
    parts = parts or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    value = (F.unix_micros(F.col(by).cast("timestamp")) if dict(rows.dtypes)[by].startswith("timestamp") else F.col(by)).cast("double")
    cuts = rows.select(value.alias("v")).where("v is not null").approxQuantile("v", [i / parts for i in range(1, parts)], 0.01)
    cuts = sorted(set(cuts))
    above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value)) if cuts else F.lit(0)
    return rows.withColumn(RANGE, F.when(F.col(by).isNull(), len(cuts) + 1 if nulls_last else -1).otherwise(above))


def ranked_in_ranges(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "rank", parts: int | None = None, nulls_last: bool = False) -> DataFrame:
    """W1 for few or huge groups: as ``ranked``, with rows sorted in ranges of the first of ``order`` (a rising numeric column) and each
    range's place in its group from the counts of those before it. With ``nulls_last`` nulls end each of ``order`` (all names), as in SQL."""
    placed = rows if RANGE in rows.columns else in_ranges(rows, order[0], parts, nulls_last)
    order = [F.asc_nulls_last(c) for c in order] if nulls_last else order
    before = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*by, RANGE).agg(F.count("*").alias("n")).select(*by, RANGE, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(PLACE))
    joined = matched(placed, offsets, [*by, RANGE])
    inside = F.row_number().over(Window.partitionBy(*by, RANGE).orderBy(*order))
    return joined.withColumn(name, (inside + F.col(PLACE)).cast("int")).drop(PLACE, RANGE)


def matched(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``groups`` (one row for each of the keys), null keys too. Broadcast below a checked count."""
    other = groups.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *[c for c in groups.columns if c not in keys])
    few = other.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = F.col(k).eqNullSafe(F.col(f"_key_{i}")) if not i else on & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return rows.join(F.broadcast(other) if few else other, on).drop(*[f"_key_{i}" for i in range(len(keys))])


def with_previous(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The value of the row before, null on a group's first row."""
    return rows.withColumn(name, F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))


def with_previous_in_ranges(rows: DataFrame, by: list[str], order: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """As ``with_previous`` for few or huge groups: rows are sorted in ranges of the first of ``order``, and a range's first row takes the
    last value of the range before it, one row a group and range."""
    placed = in_ranges(rows, order[0], parts)
    ends = placed.groupBy(*by, RANGE).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("end"))
    ends = ends.select(*by, RANGE, F.lag("end").over(Window.partitionBy(*by).orderBy(RANGE)).alias(PLACE))
    joined = matched(placed, ends, [*by, RANGE])
    w = Window.partitionBy(*by, RANGE).orderBy(*order)
    return joined.withColumn(name, F.when(F.row_number().over(w) == 1, F.col(f"{PLACE}.v")).otherwise(F.lag(value).over(w))).drop(PLACE, RANGE)


def running_best(rows: DataFrame, by: list[str], order: list[str], value: str, name: str = "best") -> DataFrame:
    """The smallest value so far, and whether this row sets it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.min(value).over(w)).withColumn("improves", F.coalesce(F.col(value) < F.min(value).over(before), F.lit(True)))


def early_stop(rows: DataFrame, by: list[str], order: list[str], value: str, patience: int = 12, least: float = 0.003) -> DataFrame:
    """Rows since the last improvement by ``least`` or more over the best before, and whether to stop there."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    at = at.withColumn("_up", F.when(F.coalesce(F.min(value).over(before) - F.col(value) >= least, F.lit(True)), F.col("_n")))
    return at.withColumn("since", F.col("_n") - F.max("_up").over(upto)).withColumn("stop", F.col("since") >= patience).drop("_n", "_up")


def progress(rows: DataFrame, by: list[str], order: str, total: int) -> DataFrame:
    """Done, percent, elapsed seconds and the seconds left at the mean pace so far."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    done = F.count("*").over(w)
    at = F.col(order).cast("timestamp")
    elapsed = F.unix_micros(at) / 1e6 - F.unix_micros(F.min(at).over(w)) / 1e6
    return rows.withColumns({"done": done, "percent": 100.0 * done / total, "elapsed": elapsed, "eta": elapsed / done * (total - done)})


def deltas(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Difference to the first row and to the row before; groups may be few and huge."""
    firsts = rows.groupBy(*by).agg(F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_first"))
    seen = with_previous_in_ranges(rows, by, order, value, "_previous")
    both = matched(seen, firsts, by)
    return both.withColumns({"vs_first": F.col(value) - F.col("_first.v"), "vs_previous": F.col(value) - F.col("_previous")}).drop("_first", "_previous")


def stability(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Range of repeats; the smaller one breaks ties of the mean."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), (F.max(value) - F.min(value)).alias("spread"))


def largest_gap(boxes: DataFrame, by: list[str], start: str, size: str, origin: str | None = None) -> DataFrame:
    """Per group the largest gap between the boxes' spans on one axis, where no span is open, and its middle.
    With an ``origin`` column the space before the first span counts too. The first of equal gaps wins."""
    ends = boxes.select(*by, F.col(start).alias("_s"), (F.col(start) + F.col(size)).alias("_e"))
    w = Window.partitionBy(*by).orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max("_e").over(w)
    if origin is not None:
        ends = boxes.select(*by, F.col(start).alias("_s"), (F.col(start) + F.col(size)).alias("_e"), F.col(origin).alias("_o"))
        reached = F.coalesce(reached, F.col("_o"))
    gaps = ends.withColumn("_r", reached).where(F.col("_s") > F.col("_r")).select(*by, (F.col("_s") - F.col("_r")).alias("gap"), ((F.col("_s") + F.col("_r")) / 2).alias("cut"))
    return gaps.groupBy(*by).agg(F.max(F.struct("gap", (-F.col("cut")).alias("c"))).alias("_b")).select(*by, "_b.gap", (-F.col("_b.c")).alias("cut"))


def anchored_clusters(values: Column, tolerance: float) -> Column:
    """Starts of clusters of a sorted array; a value further than ``tolerance`` from the start opens the next."""
    none = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(values), none, lambda a, v: F.when((F.size(a) == 0) | (v - F.element_at(a, -1) > tolerance), F.concat(a, F.array(v))).otherwise(a))


def mean_clusters(values: Column, tolerance: float) -> Column:
    """Centres of clusters of a sorted array; a value joins while within ``tolerance`` of the running mean."""
    start = F.array().cast("array<struct<sum:double,n:double>>")

    def step(a: Column, v: Column) -> Column:
        last = F.element_at(a, -1)
        fits = (F.size(a) > 0) & (F.abs(v - last["sum"] / last["n"]) <= tolerance)
        grown = F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct((last["sum"] + v).alias("sum"), (last["n"] + 1.0).alias("n"))))
        return F.when(fits, grown).otherwise(F.concat(a, F.array(F.struct(v.alias("sum"), F.lit(1.0).alias("n")))))

    return F.transform(F.aggregate(F.array_sort(values), start, step), lambda c: c["sum"] / c["n"])


def nearest(values: Column, x: Column) -> Column:
    """Index (from 0) of the nearest value, the first of equally near ones; null for none."""
    apart = F.transform(values, lambda v: F.abs(v - x))
    return F.nullif(F.array_position(apart, F.array_min(apart)).cast("int"), F.lit(0)) - 1


def runs(rows: DataFrame, by: list[str], order: list[str], flag: Column, least: int = 1, most: int | None = None) -> DataFrame:
    """Maximal runs of rows with ``flag``, by gaps and islands: place of the first row and length."""
    w = Window.partitionBy(*by).orderBy(*order)
    placed = rows.withColumn("_n", F.row_number().over(w)).withColumn("_f", F.coalesce(flag, F.lit(False)))
    islands = placed.withColumn("_i", F.col("_n") - F.sum(F.col("_f").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_f")
    out = islands.groupBy(*by, "_i").agg(F.min("_n").alias("first_row"), F.count("*").alias("length")).drop("_i")
    return out.where((F.col("length") >= least) & (F.lit(True) if most is None else F.col("length") <= most))


def ctc_decode(steps: DataFrame, by: list[str], order: str, index: str, dictionary: list[str]) -> DataFrame:
    """The text of best indices per step: blanks (0) and repeats of the step before go, and indices beyond the dictionary are
    passed over. Sequences that decode to nothing have an empty text."""
    before = F.lag(index).over(Window.partitionBy(*by).orderBy(order))
    letters = F.array(*map(F.lit, dictionary))
    emitted = (F.col(index) != 0) & F.coalesce(F.col(index) != before, F.lit(True)) & (F.col(index) <= len(dictionary))
    kept = steps.withColumn("_c", F.when(emitted, F.element_at(letters, F.col(index).cast("int"))))
    return kept.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_c").isNotNull(), F.struct(F.col(order), F.col("_c"))))), lambda s: s["_c"]), "").alias("text"))


def cumulative(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Running sum and its share of the whole."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(value).over(w)).withColumn("share", F.col("running") / F.sum(value).over(Window.partitionBy(*by)))


def best_rotation(scores: Column, skip: float, least: float) -> Column:
    """The angle of an ordered array of (angle, score): the first one stands if it reaches ``skip``, else a later
    one replaces the best by more than ``least``."""
    first = scores[0]
    fold = F.aggregate(scores, first, lambda a, s: F.when((a["score"] < skip) & (s["score"] > a["score"] + least), s).otherwise(a))
    return F.when(first["score"] >= skip, first["angle"]).otherwise(fold["angle"])


def joined_text(rows: DataFrame, by: list[str], order: str, text: str, separator: str) -> DataFrame:
    """Texts in order; null texts are left out."""
    kept = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.where(F.col(text).isNotNull()).groupBy(*by).agg(F.array_join(F.transform(kept, lambda s: s[text]), separator).alias("text"))
