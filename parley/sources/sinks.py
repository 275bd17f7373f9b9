"""Writers: split JSON lines, session summaries, masked transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.operators.sessions import masked_transcripts

SUMMARY = [
    "mean_latency_ms",
    "max_latency_ms",
    "min_latency_ms",
    "session_duration_s",
    "session_turns",
]


def sink_jsonl_splits(df: DataFrame, path: str, split: str = "split", mode: str = "error") -> None:
    """One folder of JSON lines per split; text is written as is, not escaped.

    A path that exists is an error, unless ``mode`` says otherwise.
    """
    df.write.mode(mode).partitionBy(split).option("ignoreNullFields", "false").json(path)


def new_session_rows(summary: DataFrame, key: str) -> DataFrame:
    """Session rows as they are first stored: ratings 0, no answer, no transcript."""
    ratings = [F.lit(0).alias(f"q{i}_rating") for i in range(1, 5)]
    return summary.select(key, *SUMMARY, *ratings, F.lit("").alias("q5_answer"))


def sink_session_summary(summary: DataFrame, path: str, key: str) -> None:
    """Append session rows."""
    new_session_rows(summary, key).write.mode("append").parquet(path)


def stream_session_summary(
    summary: DataFrame, path: str, key: str, checkpoint: str
) -> StreamingQuery:
    """The same from a stream. Each batch has its own folder, so a batch that is
    run again replaces itself and appends nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        rows = new_session_rows(batch, key)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        summary.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def sink_transcripts(
    sessions: DataFrame,
    messages: DataFrame,
    path: str,
    key: str,
    turn: str,
    actor: str,
    message: str,
) -> None:
    """Write the session rows and their masked transcripts, two tables in a new folder.

    ``sessions`` has one row per session, ``transcripts`` one per session and part.
    Nothing that is there already is replaced.
    """
    sessions.drop("transcripts").write.parquet(f"{path}/sessions")
    safe = masked_transcripts(messages, key, turn, actor, message)
    safe.write.parquet(f"{path}/transcripts")


def read_transcripts(spark: SparkSession, path: str, key: str) -> DataFrame:
    """What ``sink_transcripts`` wrote: a row per session, its parts in order, or null."""
    parts = spark.read.parquet(f"{path}/transcripts")
    whole = parts.groupBy(key).agg(F.flatten(F.sort_array(F.collect_list(F.struct("part", "transcripts")))["transcripts"]).alias("transcripts"))
    return spark.read.parquet(f"{path}/sessions").join(whole, key, "left")
