"""Sinks (survey ids K1, K2, K4, K5, K7, K11-K14): reports, snapshots and ground truth as JSON, text and Parquet."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent

# A name that may be written, of a script or a JSON file.
NAME = re.compile(r"^[a-zA-Z0-9][\w\-.]*\.(ts|json)$")


def checked_path(folder: str, name: str) -> str:
    """The path of an output file; names and folders that lead elsewhere are refused."""
    if not NAME.match(name) or ".." in name or ".." in folder.split("/"):
        raise ValueError(f"not a permitted name: {folder}/{name}")
    return f"{folder.rstrip('/')}/{name}"


def json_rows(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line; null fields are left out."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value")).write.mode(mode).text(path)


def snapshot(iteration: DataFrame, path: str, run_id: str) -> None:
    """K2: append an iteration to its run's folder; what is there stays."""
    iteration.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def saved(df: DataFrame, writers: list) -> str:  # noqa: ANN001
    """K4: the first of the (name, writer) pairs that works; the last one's error if none does."""
    error: Exception | None = None
    for name, write in writers:
        try:
            write(df)
            return name
        except Exception as e:  # noqa: BLE001  the next writer is the remedy
            error = e
    raise error or ValueError("no writers")


def ground_truth_files(rows: DataFrame, path: str) -> None:
    """One text file's content a row, by name, as JSON lines (name, fullText, regions)."""
    json_rows(rows.select("filename", "fullText", "regions"), path)


def dry_run(df: DataFrame, path: str, dry: bool = False) -> DataFrame:
    """Write a manifest as JSON, or with ``dry`` only give what would be written."""
    if not dry:
        json_rows(df, path, "overwrite")
    return df


def concatenated(rows: DataFrame, order: str, text: str) -> DataFrame:
    """K7: all texts of a report in order. A report's rows are few; larger tables keep their rows."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "\n\n").alias("value"))


def summary_lines(rates: DataFrame, name: str) -> DataFrame:
    """A padded line for each row with its rates in percent."""
    return rates.select(name, F.concat(F.rpad(F.col(name).cast("string"), 24, " "), F.lpad(percent(F.col("cer")), 10, " "), F.lpad(percent(F.col("wer")), 10, " ")).alias("line"))
