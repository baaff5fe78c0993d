"""Structured Streaming (survey ids S18, K3, T2-T6, T10, J15): message intake, progress and windows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

ENVELOPE = "type string, session_id string, msg_id string, stream_id string, seq long, payload string, ts timestamp"


def messages(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("save_tuning_result", "ack"), files_a_trigger: int = 100) -> DataFrame:
    """Envelopes from lines of JSON; what can't be parsed and other kinds are dropped."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_trigger).text(folder)
    return lines.select(F.from_json("value", ENVELOPE).alias("m")).where(F.col("m.type").isin(*kinds)).select("m.*")


def once_each(stream: DataFrame, late: str = "10 seconds") -> DataFrame:
    """T5: one message for each stream and sequence number."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["stream_id", "seq"])


def answered(requests: DataFrame, replies: DataFrame, seconds: int = 10) -> DataFrame:
    """Requests with their reply by message id within the time limit; later ones have none."""
    a = requests.withWatermark("ts", f"{seconds} seconds").alias("q")
    b = replies.select(F.col("msg_id").alias("reply_to"), F.col("ts").alias("reply_ts")).withWatermark("reply_ts", f"{seconds} seconds").alias("r")
    within = F.expr(f"msg_id = reply_to AND reply_ts BETWEEN ts AND ts + INTERVAL {seconds} SECONDS")
    return a.join(b, within, "left_outer")


def tumbling(events: DataFrame, length: str, late: str | None = None, by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums by window; works on tables and streams alike."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    return rows.groupBy(F.window("ts", length), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), *by, "n", "total")


def sliding(events: DataFrame, length: str, slide: str, late: str | None = None, by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """As ``tumbling``, over windows that overlap."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    return rows.groupBy(F.window("ts", length, slide), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None, by: str = "user_id") -> DataFrame:
    """Sessions that end after a gap without events."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def best_so_far(events: DataFrame, by: str, score: str, position: str) -> DataFrame:
    """The best row and the count of each group, for the update mode."""
    return events.groupBy(by).agg(F.count("*").alias("n"), F.min(F.struct(score, position)).alias("b")).select(by, "n", F.col(f"b.{score}").alias("best"), F.col(f"b.{position}").alias("best_at"))


class Progress(StreamingQueryListener):
    """Tells ``changed`` of the rows done so far, when their number has changed."""

    def __init__(self, changed: Callable[[int], None]):
        self.changed, self.rows = changed, 0

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        """Nothing is done yet."""

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        if event.progress.numInputRows:
            self.rows += event.progress.numInputRows
            self.changed(self.rows)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        """Nothing has changed."""

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        """The caller sees the end itself."""


def watched(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], configured: int, every: str = "5 seconds", timeout: int = 7200, mode: str = "append") -> dict:
    """Process a stream until ``configured`` rows are done or ``timeout`` seconds are over, and tell what was done: a run that timed out or
    has fewer rows is incomplete, and its partial results stay."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(processingTime=every).start()
    end = time.monotonic() + timeout
    seen: dict[int, int] = {}
    while query.isActive and time.monotonic() < end and sum(seen.values()) < configured:
        query.awaitTermination(0.2)
        seen |= {p["batchId"]: p["numInputRows"] for p in query.recentProgress if p["numInputRows"]}
    error = query.exception()
    timed_out = sum(seen.values()) < configured and error is None
    query.stop()
    done = sum(seen.values())
    return {"completed": done, "configured": configured, "timedOut": timed_out, "incomplete": done < configured, "error": None if error is None else str(error)}


def run_to_end(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append", timeout: int | None = None) -> bool:
    """Process all that is there and stop; a rerun goes on from the checkpoint. False after a timeout."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    done = query.awaitTermination(timeout) if timeout else (query.awaitTermination() or True)
    if not done:
        query.stop()
    return bool(done)
