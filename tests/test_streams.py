"""Streams over folders of files: replies, repeats, late rows, windows and watched runs."""

import datetime
import json
import os

from pyspark.sql import functions as F

from scriptorium.streaming import flows

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return (T0 + datetime.timedelta(seconds=seconds)).isoformat() + "Z"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def collected(spark, stream, tmp_path, mode="append"):
    out = []
    flows.run_to_end(stream, str(tmp_path / f"check-{len(list(tmp_path.iterdir()))}"), lambda df, _: out.extend(df.collect()), mode)
    return out


def test_messages_once_each(spark, tmp_path):
    row = lambda seq, kind="ack", second=0: {"type": kind, "session_id": "s", "msg_id": f"m{seq}", "stream_id": "x", "seq": seq, "payload": "{}", "ts": at(second)}
    put(tmp_path / "in", "a.json", [row(1), row(1), row(2), row(3, "other")])
    (tmp_path / "in" / "b.json").write_text("not json\n")
    got = collected(spark, flows.once_each(flows.messages(spark, str(tmp_path / "in"))), tmp_path)
    assert sorted(r.seq for r in got) == [1, 2]


def test_replies_within_the_limit(spark, tmp_path):
    ask = lambda i, s: {"type": "save_tuning_result", "session_id": "s", "msg_id": f"m{i}", "stream_id": "x", "seq": i, "payload": "q", "ts": at(s)}
    reply = lambda i, s: ask(i, s) | {"type": "ack", "payload": "r"}
    put(tmp_path / "in", "a.json", [ask(1, 0), ask(2, 0), ask(3, 0), reply(1, 5), reply(2, 30)])
    put(tmp_path / "in", "b.json", [ask(9, 500), reply(9, 501)])
    put(tmp_path / "in", "c.json", [ask(10, 900), reply(10, 901)])
    every = flows.messages(spark, str(tmp_path / "in"), files_a_trigger=1)
    pairs = flows.answered(every.where("type = 'save_tuning_result'"), every.where("type = 'ack'"))
    got = {r.msg_id: r.reply_to for r in collected(spark, pairs.select("msg_id", "reply_to"), tmp_path)}
    assert got["m1"] == "m1" and got["m2"] is None and got["m3"] is None and got["m9"] == "m9"


def test_late_rows_and_sliding_windows(spark, tmp_path):
    row = lambda s, v=1.0: {"ts": at(s), "event_type": "a", "value": v}
    put(tmp_path / "in", "a.json", [row(10), row(70), row(400)])
    put(tmp_path / "in", "b.json", [row(410)])
    put(tmp_path / "in", "c.json", [row(20), row(1000)])
    for i, name in enumerate("abc"):
        os.utime(tmp_path / "in" / f"{name}.json", (10 * i, 10 * i))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = {r.window_start.minute: r.n for r in collected(spark, flows.tumbling(stream, "1 minute", "30 seconds"), tmp_path)}
    assert got[0] == 1 and got[1] == 1 and got[6] == 2  # the third file's row at 20 s is late
    table = spark.read.schema("ts timestamp, event_type string, value double").json(str(tmp_path / "in"))
    slid = flows.sliding(table, "2 minutes", "1 minute").where("event_type = 'a'").orderBy("window_start").collect()
    assert sum(r.n for r in slid) == 2 * table.count() and max(r.n for r in slid) == 3
    assert flows.sessions(table.withColumn("user_id", F.lit(1)), "2 minutes").count() == 3


def test_watched_runs(spark, tmp_path):
    put(tmp_path / "in", "a.json", [{"ts": at(i), "event_type": "a", "value": 1.0} for i in range(7)])
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").json(str(tmp_path / "in"))
    rows, told = [], []
    listener = flows.Progress(told.append)
    spark.streams.addListener(listener)
    try:
        whole = flows.watched(stream, str(tmp_path / "c1"), lambda df, _: rows.extend(df.collect()), 7, "0 seconds", 60)
    finally:
        spark.streams.removeListener(listener)
    assert whole == {"completed": 7, "configured": 7, "timedOut": False, "incomplete": False, "error": None} and len(rows) == 7
    part = flows.watched(stream, str(tmp_path / "c2"), lambda df, _: rows.extend(df.collect()), 99, "0 seconds", 6)
    assert part["timedOut"] and part["incomplete"] and part["completed"] == 7
