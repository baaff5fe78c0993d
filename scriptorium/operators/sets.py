"""Set operations, limits and small predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present_and_missing(required: DataFrame, available: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The required rows that are there, and those that aren't."""
    known = available.select(key).distinct()
    return required.join(known, key, "left_semi"), required.join(known, key, "left_anti")


def dataset_modes(datasets: dict[str, DataFrame], combined: str = "combined") -> DataFrame:
    """Every dataset under its name, and all of them again as one; duplicates stay."""
    named = [df.withColumn("dataset", F.lit(n)) for n, df in datasets.items()]
    return reduce(DataFrame.unionByName, named + [df.withColumn("dataset", F.lit(combined)) for df in datasets.values()])


def first_of_each(rows: DataFrame, key: str, position: str) -> DataFrame:
    """U7."""
    return rows.groupBy(key).agg(F.min(position).alias(position), F.count("*").alias("n"))


def divided(rows: DataFrame, flag: Column) -> tuple[DataFrame, DataFrame]:
    """U8: rows with the flag, and the others, nulls among them."""
    known = F.coalesce(flag, F.lit(False))
    return rows.where(known), rows.where(~known)


def side_by_side(rows: DataFrame, by: str, variant: str, names: dict[str, object], value: str, digits: int = 6) -> DataFrame:
    """Mean of a value by variant, a column for each."""
    return rows.groupBy(by).agg(*[F.round(F.avg(F.when(F.col(variant) == v, F.col(value))), digits).alias(n) for n, v in names.items()])


def rate_class(rate: Column, good: float, fair: float) -> Column:
    """P15."""
    return F.when(rate <= good, "good").when(rate <= fair, "fair").otherwise("poor")


def accepted(text: Column, confidence: Column, least: float) -> Column:
    """P10: a fallback result with some text and enough confidence."""
    return (F.length(F.trim(text)) > 0) & (confidence >= least)


def segmentation_mode(label: Column, overrides: dict[str, int], default: int) -> Column:
    """P19."""
    out = F.lit(default)
    for name, mode in overrides.items():
        out = F.when(label == name, mode).otherwise(out)
    return out


def primary_split(by_split: Column, preferred: str) -> Column:
    """The first split there is among the preferred one, test, val, train, all, and else any, by name."""
    known = F.map_keys(by_split)
    order = [preferred, "test", "val", "train", "all"]
    return F.coalesce(*[F.when(F.array_contains(known, s), F.lit(s)) for s in order], F.array_min(known))


def with_more(rows: DataFrame, order: list, n: int = 50) -> tuple[DataFrame, int]:
    """O2: the first n rows, and how many more there are."""
    return rows.orderBy(*order).limit(n), max(0, rows.count() - n)


def sampled(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """N rows in an order that depends on the seed and the key alone."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def by_name(rows: DataFrame, name: str) -> DataFrame:
    """Names in the order of their language-neutral collation, then their bytes."""
    return rows.orderBy(F.collate(F.col(name), "UNICODE"), name)


def start_refused(images: DataFrame, parameters: DataFrame) -> str | None:
    """Why a run can't start."""
    if images.where("has_truth").isEmpty():
        return "no images with ground truth"
    return "no enabled parameters" if parameters.where("enabled").isEmpty() else None
