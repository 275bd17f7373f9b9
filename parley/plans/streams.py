"""Streaming forms, run to the end of the input and read back.

The tables are written as files in time order, a few for each micro-batch, so
that state has to survive from batch to batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.plans import conversations as conv_plans
from parley.plans import fixtures as fx
from parley.plans import ordered
from parley.plans.registry import query
from parley.plans.texts import typed_messages
from parley.session import new_folder
from parley.sources import files, sinks
from parley.streaming import operators as ops

BATCHES, FILES = 3, 4


def as_stream(spark: SparkSession, df: DataFrame, batch: Column) -> DataFrame:
    """``df`` as a stream of ``BATCHES`` groups of files; ``batch`` numbers rows from 0.

    Rows are dealt evenly to ``FILES`` files a batch, so that a trigger of as many
    files takes one batch.
    """
    path = new_folder(spark, "stream-in")
    numbered = df.withColumn("_batch", F.least(batch, F.lit(BATCHES - 1)))
    for i in range(BATCHES):
        folder = f"{path}/batch={i}"
        numbered.filter(F.col("_batch") == i).drop("_batch").repartition(FILES).write.parquet(folder)
        files = len(spark.read.schema(df.schema).parquet(folder).inputFiles())
        if files != FILES:
            raise RuntimeError(f"batch {i} has {files} files, not {FILES}")
    reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES)
    return reader.parquet(f"{path}/*")


def finished(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What the stream wrote; fails unless its input came in several micro-batches."""
    path = new_folder(spark, "stream-out")
    query = ops.run_to_table(stream, path, new_folder(spark, "stream-state"))
    fed = sum(p["numInputRows"] > 0 for p in query.recentProgress)
    if fed < BATCHES:
        raise RuntimeError(f"input came in {fed} micro-batches")
    return spark.read.schema(stream.schema).parquet(path)


def event_stream(spark: SparkSession, sf: str, shape: Callable[[DataFrame], DataFrame]) -> DataFrame:
    events = fx.table(spark, sf, "events")
    days = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return shape(as_stream(spark, events, F.floor(days / 10)))


@query("stream_response_mode", ordered.MODE_SQL)
def stream_response_mode(spark: SparkSession, sf: str) -> DataFrame:
    def shape(events: DataFrame) -> DataFrame:
        turns = events.withColumn("latency_ms", F.col("value") * 40)
        return ops.response_mode(turns, ["user_id"], fx.TURN_ORDER, "latency_ms")

    rows = finished(spark, event_stream(spark, sf, shape))
    return rows.select("user_id", "event_id", "session_turn", "mode")


@query("stream_ewma_latency", ordered.EWMA_SQL)
def stream_ewma_latency(spark: SparkSession, sf: str) -> DataFrame:
    def shape(events: DataFrame) -> DataFrame:
        turns = events.withColumn("latency_ms", F.col("value") * 40)
        return ops.response_mode(turns, ["user_id"], fx.TURN_ORDER, "latency_ms")

    rows = finished(spark, event_stream(spark, sf, shape))
    return rows.select("user_id", "event_id", "ewma")


@query("stream_emotion_decay", ordered.DECAY_SQL)
def stream_emotion_decay(spark: SparkSession, sf: str) -> DataFrame:
    observations = ordered.observations(spark, sf)
    days = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    stream = as_stream(spark, observations, F.floor(days / 10))
    decayed = ops.emotion_decay(
        stream, ["user_id"], "ts", fx.TURN_ORDER, "observed", ordered.RATE
    )
    return ordered.spread(finished(spark, decayed))


@query("stream_throttle_emit", ordered.THROTTLE_SQL)
def stream_throttle_emit(spark: SparkSession, sf: str) -> DataFrame:
    return finished(
        spark,
        event_stream(
            spark,
            sf,
            lambda events: ops.throttle_emit(
                events, ["user_id"], "ts", "event_id", 6 * ordered.HOUR
            ),
        ),
    )


@query(
    "stream_latest_frames",
    """WITH slots AS (
      SELECT user_id, date_trunc('hour', ts) AS slot, max(ts) AS ts,
             arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value
      FROM events GROUP BY ALL)
    SELECT * FROM slots WHERE slot + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE""",
)
def stream_latest_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The slots that are over by the watermark."""
    rows = finished(
        spark,
        event_stream(
            spark,
            sf,
            lambda events: ops.latest_frame_sample(
                events, ["user_id"], "ts", "1 hour", "event_id", ["value"], "1 minute"
            ),
        ),
    )
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("slot", "ts")})


@query(
    "stream_utterance_sessions",
    f"""SELECT user_id, start_ts, end_ts, frames FROM ({ordered.utterances_sql(2)})
    WHERE end_ts + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE""",
)
def stream_utterance_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The utterances whose silence is over by the watermark."""
    rows = finished(
        spark,
        event_stream(
            spark,
            sf,
            lambda events: ops.utterance_sessions(
                events, ["user_id"], "ts", "2 hours", "1 minute"
            ),
        ),
    )
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_ts", "end_ts")})


@query(
    "stream_utterance_sessions_capped",
    f"""SELECT user_id, piece, start_ts, end_ts, frames
    FROM ({ordered.utterances_sql(2, ordered.PIECES, ", start")})
    WHERE least(end_ts + INTERVAL 2 HOUR, start + to_hours(5 * (piece + 1)))
      <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE""",
)
def stream_utterance_sessions_capped(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces whose time or silence is over by the watermark."""
    rows = finished(
        spark,
        event_stream(
            spark,
            sf,
            lambda events: ops.capped_utterances(
                events, ["user_id"], "ts", 2 * ordered.HOUR, 5 * ordered.HOUR, "1 minute"
            ),
        ),
    )
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_ts", "end_ts")})


@query("stream_topic_segments", conv_plans.SEGMENTS_SQL)
def stream_topic_segments(spark: SparkSession, sf: str) -> DataFrame:
    stream = as_stream(spark, fx.messages(spark, sf), F.floor(F.col("turn") / 2))
    return finished(spark, ops.topic_segments(stream))


@query("stream_turn_pairs", conv_plans.PAIRS_SQL)
def stream_turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    turns = fx.table(spark, sf, "conversations")
    stream = as_stream(spark, turns, F.floor((F.col("turn") + 1) / 2))
    return finished(spark, ops.turn_pairs(stream))


@query(
    "stream_messages",
    "SELECT event_id, user_id, value FROM events WHERE event_type = 'click'",
)
def stream_messages(spark: SparkSession, sf: str) -> DataFrame:
    """JSON message files as a stream, one type kept."""
    path = new_folder(spark, "messages")
    typed_messages(spark, sf).repartition(BATCHES).write.json(path)
    stream = files.read_message_stream(
        spark, path, "event_id long, message string", maxFilesPerTrigger="1"
    )
    spoken = files.messages_of_type(
        stream, "message", files.SPEAK, "struct<user_id: long, value: double>", ["event_id"]
    )
    return finished(spark, spoken.select("event_id", "data.user_id", "data.value"))


TOLD = """turns AS (
  SELECT user_id, event_id, ts AS start_ts, ts + INTERVAL 8 HOUR AS end_ts, EXISTS (
    SELECT 1 FROM events i WHERE i.user_id = t.user_id AND i.event_type = 'error'
      AND i.ts BETWEEN t.ts AND t.ts + INTERVAL 8 HOUR) AS hit
  FROM events t WHERE event_type = 'click'),
passed AS (
  SELECT least(max(ts) FILTER (WHERE event_type = 'click'), max(ts) FILTER (WHERE event_type = 'error'))
    - INTERVAL 1 MINUTE AS now FROM events)"""


def told_turns(spark: SparkSession, sf: str, interrupted: bool) -> DataFrame:
    def shape(events: DataFrame) -> DataFrame:
        turns = events.filter("event_type = 'click'").select(
            "user_id",
            "event_id",
            F.col("ts").alias("start_ts"),
            (F.col("ts") + F.expr("INTERVAL 8 HOURS")).alias("end_ts"),
        )
        cuts = events.filter("event_type = 'error'").select("user_id", "ts")
        return ops.interrupted_turns(
            turns, cuts, ["user_id"], "event_id", "start_ts", "end_ts", "ts", "1 minute", interrupted
        )

    return finished(spark, event_stream(spark, sf, shape)).select("user_id", "event_id")


@query("stream_interrupted_turns", f"WITH {TOLD} SELECT user_id, event_id FROM turns WHERE hit")
def stream_interrupted_turns(spark: SparkSession, sf: str) -> DataFrame:
    return told_turns(spark, sf, interrupted=True)


@query(
    "stream_interrupted_turns_kept",
    f"WITH {TOLD} SELECT user_id, event_id FROM turns, passed WHERE NOT hit AND end_ts <= now",
)
def stream_interrupted_turns_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The kept turns that are over by the watermark."""
    return told_turns(spark, sf, interrupted=False)


@query(
    "stream_session_summary",
    f"""SELECT *, 0 AS q1_rating, 0 AS q2_rating, 0 AS q3_rating, 0 AS q4_rating, '' AS q5_answer
    FROM ({ordered.SUMMARY_SQL})""",
)
def stream_session_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Finished sessions arrive as a stream and are stored batch by batch."""
    done = ordered.summaries(spark, sf)
    stream = as_stream(spark, done, F.col("user_id") % BATCHES)
    path = new_folder(spark, "sessions")
    sinks.stream_session_summary(
        stream, path, "user_id", new_folder(spark, "stream-state")
    ).awaitTermination()
    return spark.read.parquet(path).drop("batch")
