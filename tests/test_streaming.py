"""Streams in several micro-batches give the rows of the batch form."""

import random

import pytest
from pyspark.sql import functions as F

from parley.operators import controller, conversation, emotion, sessions
from parley.session import new_folder
from parley.sources import files, sinks
from parley.streaming import operators as streams
from parley.streaming import trackers


def stream_of(spark, df, parts):
    """``df`` as files, read one per micro-batch in the order of ``parts``."""
    path = new_folder(spark, "in")
    for condition in parts:
        df.filter(condition).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finished(spark, stream):
    path = new_folder(spark, "out")
    query = streams.run_to_table(stream, path, new_folder(spark, "state"))
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) >= 3
    return spark.read.schema(stream.schema).parquet(path)


def same(a, b):
    columns = sorted(a.columns)
    assert sorted(b.columns) == columns
    left, right = (sorted(map(repr, d.select(*columns).collect())) for d in (a, b))
    assert left == right


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(9)
    data = [
        (k, t, float(rng.randrange(4000)), [rng.random() for _ in range(7)])
        for k, n in {"a": 60, "b": 5, "c": 33}.items()
        for t in range(n)
    ]
    return spark.createDataFrame(data, "k string, t long, ms double, seen array<double>").withColumn(
        "ts", F.timestamp_seconds(F.col("t") * 20)
    )


PARTS = ["t < 7", "t BETWEEN 7 AND 20", "t BETWEEN 21 AND 40", "t > 40"]


def test_response_mode(spark, turns):
    out = finished(
        spark, streams.response_mode(stream_of(spark, turns, PARTS), ["k"], ["t"], "ms")
    )
    same(out, controller.response_mode(turns, ["k"], ["t"], "ms"))


DAY = 86_400


def test_idle_sessions_go(spark):
    """Once the stream's time has passed a session by, it starts anew; rows that late are counted."""
    rows = [(0, "a", 0), (0, "a", 10), (1, "b", 1000), (2, "b", 2000), (2, "b", 2010), (3, "a", 2020), (3, "a", 5)]
    df = spark.createDataFrame(rows, "part int, k string, t long").select(
        "part", "k", F.timestamp_seconds(F.col("t") + DAY).alias("ts"), F.lit(1000.0).alias("ms")
    )
    stream = stream_of(spark, df, [f"part = {i}" for i in range(4)])
    out = streams.response_mode(stream, ["k"], ["ts"], "ms", ts="ts", idle_seconds=100)
    path = new_folder(spark, "out")
    query = streams.run_to_table(out, path, new_folder(spark, "state"))
    written = spark.read.schema(out.schema).parquet(path).orderBy("ts")
    got = written.select("k", F.unix_seconds("ts") - DAY, "session_turn").collect()
    assert [tuple(r) for r in got] == [
        ("a", 0, 1), ("a", 10, 2), ("b", 1000, 1), ("b", 2000, 2), ("b", 2010, 3), ("a", 2020, 1)
    ]
    states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == 1
    assert sum(s["numRowsRemoved"] for s in states) >= 1


def test_emotion_decay(spark, turns):
    stream = stream_of(spark, turns, PARTS)
    out = finished(spark, streams.emotion_decay(stream, ["k"], "ts", ["ts", "t"], "seen", 0.01))
    batch = emotion.emotion_decay(turns, ["k"], "ts", ["ts", "t"], "seen", 0.01)
    rounded = [d.withColumn("scores", F.transform("scores", lambda s: F.round(s, 9))) for d in (out, batch)]
    same(*rounded)


def test_throttle(spark, turns):
    stream = stream_of(spark, turns, PARTS)
    out = finished(spark, streams.throttle_emit(stream, ["k"], "ts", "t", 70))
    same(out, sessions.throttle_emit(turns, ["k"], "ts", "t", 70))


@pytest.fixture(scope="module")
def talk(spark):
    rng = random.Random(10)
    data = [
        (c, t, rng.choice(["user", "assistant"]), " ".join(["w"] * rng.randrange(40)))
        for c, n in enumerate([60, 4, 33])
        for t in range(n)
    ]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


TALK_PARTS = [p.replace("t ", "turn ") for p in PARTS]


def test_topic_segments(spark, talk):
    out = finished(spark, streams.topic_segments(stream_of(spark, talk, TALK_PARTS)))
    same(out, conversation.topic_segments(talk))


def test_turn_pairs(spark, talk):
    out = finished(spark, streams.turn_pairs(stream_of(spark, talk, TALK_PARTS)))
    same(out, conversation.turn_pairs(talk))


def test_frames_come_out_when_their_slot_is_over(spark, turns):
    stream = streams.latest_frame_sample(
        stream_of(spark, turns, PARTS), ["k"], "ts", "60 seconds", "t", ["ms"], "1 second"
    )
    batch = emotion.latest_frame_sample(turns, ["k"], "ts", "60 seconds", "t", ["ms"])
    end = turns.agg(F.max("ts")).first()[0]
    over = batch.filter(F.col("slot") + F.expr("INTERVAL 61 SECONDS") <= F.lit(end))
    same(finished(spark, stream), over)


def test_utterances_come_out_when_their_silence_is_over(spark, turns):
    voiced = turns.filter("t % 5 <> 0")
    stream = streams.utterance_sessions(
        stream_of(spark, voiced, PARTS), ["k"], "ts", "30 seconds", "1 second"
    )
    batch = sessions.utterance_sessions(voiced, ["k"], "ts", 30).drop("piece")
    end = voiced.agg(F.max("ts")).first()[0]
    over = batch.filter(F.col("end_ts") + F.expr("INTERVAL 31 SECONDS") <= F.lit(end))
    same(finished(spark, stream), over)


def test_message_stream(spark):
    path = new_folder(spark, "messages")
    kind = F.when(F.col("id") % 2 == 0, files.SPEAK).otherwise(files.TRANSCRIPT)
    messages = spark.range(10).select(files.message_json(kind, F.struct("id")).alias("m"))
    messages.repartition(4).write.json(path)
    stream = files.read_message_stream(spark, path, "m string", maxFilesPerTrigger="1")
    spoken = files.messages_of_type(stream, "m", files.SPEAK, "struct<id: long>", [])
    out = finished(spark, spoken.select("data.id")).collect()
    assert sorted(r.id for r in out) == [0, 2, 4, 6, 8]


def test_summary_stream_writes_a_repeated_batch_once(spark):
    path, columns = new_folder(spark, "sessions"), sinks.SUMMARY
    summary = spark.range(6).select("id", *[F.lit(1.0).alias(c) for c in columns])
    stream = stream_of(spark, summary, ["id < 2", "id BETWEEN 2 AND 3", "id > 3"])
    for _ in range(2):  # the second run, from an empty checkpoint, does all batches again
        sinks.stream_session_summary(stream, path, "id", new_folder(spark, "state")).awaitTermination()
    out = spark.read.parquet(path)
    assert sorted(r.id for r in out.collect()) == list(range(6))
    assert {r.q1_rating for r in out.collect()} == {0}


def test_throttle_state_survives(spark):
    first = trackers.ThrottleTracker(None, 10)
    import pandas as pd

    assert first.feed(pd.DataFrame({"_us": [0, 5, 10]}))["_us"].tolist() == [0, 10]
    again = trackers.ThrottleTracker(first.dump(), 10)
    assert again.feed(pd.DataFrame({"_us": [19, 20]}))["_us"].tolist() == [20]


@pytest.fixture(scope="module")
def spoken(spark):
    """Turns and interrupts of a busy and two quiet sessions: (part, k, id, us, end_us), end_us 0 for an interrupt."""
    rng = random.Random(14)
    rows = []
    for key, n in {"hot": 120, "b": 4, None: 20}.items():
        for i in range(n):
            at = rng.randrange(1000)
            length = rng.choice([0, 5, 40, 600])
            rows.append((at // 250, key, 2**60 + len(rows), at, at + length if rng.random() < 0.6 else -1))
    rows += [(0, "edge", 1, 10, 20), (0, "edge", 2, 20, -1), (1, "edge", 3, 300, 310), (1, "edge", 4, 311, -1)]
    schema = "part int, k string, id long, at long, stop long"
    return spark.createDataFrame(rows, schema).withColumns(
        {c: F.timestamp_seconds(F.col(o) + DAY) for c, o in {"ts": "at", "over": "stop"}.items()}
    )


@pytest.mark.parametrize("interrupted", [False, True])
def test_turns_come_out_when_they_are_over_or_interrupted(spark, spoken, interrupted):
    def split(df):
        return df.where("stop >= 0").drop("part"), df.where("stop < 0").select("k", "ts")

    parts = [f"part = {i}" for i in range(4)]
    names = dict(keys=["k"], start="ts", end="over", ts="ts", interrupted=interrupted)
    stream = streams.interrupted_turns(
        *split(stream_of(spark, spoken, parts)), turn="id", delay="1 second", **names
    )
    turns, cuts = split(spoken)
    now = min(d.agg(F.max("ts")).first()[0] for d in (turns, cuts))
    batch = sessions.interrupted_turns(turns, cuts, **names).select("k", "id", "ts", "over")
    if not interrupted:
        batch = batch.where(F.col("over") + F.expr("INTERVAL 1 SECOND") <= F.lit(now))
    assert batch.count() > 5
    same(finished(spark, stream), batch)


def test_state_of_turns_goes(spark, spoken):
    """After a last row far ahead nothing is held but that row."""
    far = spark.createDataFrame([(4, "b", 7, 90_000, 90_001), (4, "b", 8, 90_000, -1)], spoken.schema[:5])
    later = far.withColumns({c: F.timestamp_seconds(F.col(o) + DAY) for c, o in {"ts": "at", "over": "stop"}.items()})
    stream = stream_of(spark, spoken.unionByName(later), [f"part = {i}" for i in range(5)])
    out = streams.interrupted_turns(
        stream.where("stop >= 0"), stream.where("stop < 0"), ["k"], "id", "ts", "over", "ts", "1 second"
    )
    query = streams.run_to_table(out, new_folder(spark, "out"), new_folder(spark, "state"))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


@pytest.mark.parametrize("cap", [70, 1000])
def test_capped_utterances_equal_the_batch_form(spark, turns, cap):
    voiced = turns.filter("t % 5 <> 0")
    out = finished(
        spark,
        streams.capped_utterances(stream_of(spark, voiced, PARTS), ["k"], "ts", 30, cap, "1 second"),
    )
    batch = sessions.utterance_sessions(voiced, ["k"], "ts", 30, cap)
    batch = batch.withColumn("piece", F.col("piece").cast("long"))
    end = voiced.agg(F.max("ts")).first()[0]
    over = batch.filter(F.col("end_ts") + F.expr("INTERVAL 31 SECONDS") <= F.lit(end))
    got = {tuple(r) for r in out.select(*sorted(out.columns)).collect()}
    assert {tuple(r) for r in over.select(*sorted(over.columns)).collect()} <= got
    assert got <= {tuple(r) for r in batch.select(*sorted(batch.columns)).collect()}
    assert out.count() == len(got)


def test_keys_are_put_in_order_without_sorting_frames(monkeypatch):
    """A key has a few rows in a batch, so what pandas costs for each frame is the cost of a stream."""
    import pandas as pd

    times = pd.to_datetime([3, 1, 2, 1], unit="s")
    rows = pd.DataFrame({"ts": times, "id": [1, 9, 3, 4], "v": list("abcd")})
    expected = rows.sort_values(["ts", "id"], ignore_index=True)
    text = rows.sort_values(["v"], ascending=False)
    monkeypatch.setattr(pd.DataFrame, "sort_values", None)
    got = streams.in_order(rows, ["ts", "id"])
    assert got.equals(expected) and streams.in_order(got, ["ts", "id"]) is got
    monkeypatch.undo()
    assert streams.in_order(text, ["v"])["v"].tolist() == list("abcd")


def test_keys_that_settle_nothing_make_no_frames():
    import pandas as pd

    rows = pd.DataFrame({"_cut": [True], "_turn": [None], "_us": [5], "_end_us": [0]})
    tables = []
    for tracker in (trackers.InterruptTracker(None), trackers.InterruptTracker(None)):
        tracker.feed(rows)
        tables.append(tracker.settled(0))
        assert tracker.dump() == ([], [5])
    assert tables[0] is tables[1] and not len(tables[0])
