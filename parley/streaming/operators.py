"""Structured Streaming forms of the ordered operators.

They give the rows of the batch form for input that arrives in order; inside
a micro-batch rows are put in order first. The state of a key is a few
numbers, and a micro-batch holds what the source's rate limit
(``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) lets through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from parley.functions import text
from parley.functions.labels import FACE_EMOTIONS
from parley.operators import controller, conversation, emotion
from parley.streaming import trackers

Names = list[str]


def keyed(
    df: DataFrame,
    keys: Names,
    order: Names,
    schema: str,
    state: str,
    make: Callable[[tuple | None], Any],
    ts: str | None = None,
    idle_seconds: float | None = None,
) -> DataFrame:
    """Pass each key's rows, in order, through the tracker that ``make`` restores.

    With ``idle_seconds`` the state of a key goes when the stream's time, by
    ``ts``, is so far past its last row, and it starts anew if it comes again. Rows
    that are later than that are dropped; Spark counts them as
    ``numRowsDroppedByWatermark``. Without, every key keeps its few numbers.
    """
    columns = StructType.fromDDL(schema).names
    if idle_seconds is not None:
        event = F.col(ts).cast("timestamp")
        df = df.withColumn("_event", event).withWatermark("_event", f"{idle_seconds} seconds")

    def run(
        key: tuple, batches: Iterator[pd.DataFrame], saved: GroupState
    ) -> Iterator[pd.DataFrame]:
        if saved.hasTimedOut:
            saved.remove()
            return
        parts = list(batches)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        rows = in_order(rows, order)
        tracker = make(saved.get if saved.exists else None)
        result = tracker.feed(rows)
        saved.update(tracker.dump())
        if idle_seconds is not None:
            last = int(rows["_event"].max().timestamp() * 1000)
            saved.setTimeoutTimestamp(last + int(idle_seconds * 1000))
        if len(result):
            yield result if list(result.columns) == columns else result[columns]

    timeout = (
        GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.EventTimeTimeout
    )
    return df.groupBy(*keys).applyInPandasWithState(run, schema, state, "append", timeout)


def in_order(rows: pd.DataFrame, order: Names) -> pd.DataFrame:
    """A key's rows in order; most have a few in a batch, often in order already."""
    if len(rows) < 2:
        return rows
    columns = [rows[c].to_numpy() for c in reversed(order)]
    if any(c.dtype == object for c in columns):
        return rows.sort_values(order, ignore_index=True)
    places = np.lexsort(columns)
    return rows if (places[1:] > places[:-1]).all() else rows.take(places).reset_index(drop=True)


def _ddl(df: DataFrame, names: Names) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def response_mode(
    df: DataFrame,
    keys: Names,
    order: Names,
    latency: str,
    target: float = controller.TARGET_MS,
    upper: float = controller.UPPER,
    lower: float = controller.LOWER,
    ts: str | None = None,
    idle_seconds: float | None = None,
) -> DataFrame:
    """As in batch; ``ts``, a column of ``order``, times the end of idle sessions."""
    rows = df.select(*keys, *order, F.col(latency).cast("double").alias(latency))
    schema = _ddl(rows, rows.columns) + ", session_turn long, ewma double, p80 double, mode string"
    return keyed(
        rows,
        keys,
        order,
        schema,
        trackers.ModeTracker.state,
        lambda saved: trackers.ModeTracker(saved, latency, target, upper, lower),
        ts,
        idle_seconds,
    )


def emotion_decay(
    df: DataFrame,
    keys: Names,
    ts: str,
    order: Names,
    observed: str,
    decay_rate: float = emotion.DECAY_RATE,
    classes: int = len(FACE_EMOTIONS),
    idle_seconds: float | None = None,
) -> DataFrame:
    """As in batch; ``order`` begins with ``ts``."""
    rows = df.select(*keys, *order, observed, _micros(ts).alias("_us"))
    return keyed(
        rows,
        keys,
        order,
        _ddl(rows, [*keys, *order]) + ", scores array<double>",
        trackers.EmotionTracker.state,
        lambda saved: trackers.EmotionTracker(saved, observed, decay_rate, classes),
        ts,
        idle_seconds,
    )


def throttle_emit(
    df: DataFrame,
    keys: Names,
    ts: str,
    tie: str,
    interval_seconds: float,
    idle_seconds: float | None = None,
) -> DataFrame:
    """As in batch; a key that was idle for longer than the interval emits either way."""
    rows = df.select(*keys, tie, ts, _micros(ts).alias("_us"))
    interval = int(interval_seconds * 1_000_000)
    return keyed(
        rows,
        keys,
        ["_us", tie],
        _ddl(rows, [*keys, tie, ts]),
        trackers.ThrottleTracker.state,
        lambda saved: trackers.ThrottleTracker(saved, interval),
        ts,
        idle_seconds,
    )


def topic_segments(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    message: str = "text",
    min_words: int = conversation.TOPIC_WORDS,
    advance: str = "length",
) -> DataFrame:
    rows = df.select(conv, turn, text.word_count(F.col(message)).alias("_words"))
    return keyed(
        rows,
        [conv],
        [turn],
        _ddl(rows, [conv]) + ", segment long, start_pos long, end_pos long",
        trackers.SegmentTracker.state,
        lambda saved: trackers.SegmentTracker(saved, "_words", min_words, advance),
    )


def turn_pairs(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    message: str = "text",
) -> DataFrame:
    rows = df.select(conv, turn, role, message)
    return keyed(
        rows,
        [conv],
        [turn],
        _ddl(rows, [conv, turn]) + ", user_text string, assistant_text string",
        trackers.PairTracker.state,
        lambda saved: trackers.PairTracker(saved, turn, role, message),
    )


def latest_frame_sample(
    df: DataFrame, keys: Names, ts: str, width: str, tie: str, values: Names, delay: str
) -> DataFrame:
    """As in batch, with a watermark; a slot comes out when it is over."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return emotion.latest_frame_sample(timed, keys, ts, width, tie, values)


def utterance_sessions(
    df: DataFrame, keys: Names, ts: str, gap: str, delay: str
) -> DataFrame:
    """Gap sessions with a watermark; one comes out when its silence is over."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return (
        timed.groupBy(*keys, F.session_window(ts, gap).alias("_w"))
        .agg(
            F.min(ts).alias("start_ts"),
            F.max(ts).alias("end_ts"),
            F.count(F.lit(1)).alias("frames"),
        )
        .drop("_w")
    )


def awaited(
    df: DataFrame,
    keys: Names,
    schema: str,
    state: str,
    make: Callable[[tuple | None], Any],
) -> DataFrame:
    """Pass each key's rows through a tracker that settles them by the stream's time.

    ``df`` has a watermark. Arrow batches of a key are fed one after the other. What
    the tracker holds comes out when the watermark passes it, by a timer if the key
    has no new rows; then its state goes.
    """
    columns = StructType.fromDDL(schema).names

    def run(
        key: tuple, batches: Iterator[pd.DataFrame], saved: GroupState
    ) -> Iterator[pd.DataFrame]:
        tracker = make(saved.get if saved.exists else None)
        if not saved.hasTimedOut:
            for rows in batches:
                tracker.feed(rows)
        now = saved.getCurrentWatermarkMs()
        result = tracker.settled(now * 1000)
        due = tracker.due()
        if due is not None:
            saved.update(tracker.dump())
            saved.setTimeoutTimestamp(max(due // 1000, now + 1))
        elif saved.exists:
            saved.remove()
        if len(result):
            for name, value in zip(keys, key, strict=True):
                result[name] = value
            yield result[columns]

    return df.groupBy(*keys).applyInPandasWithState(
        run, schema, state, "append", GroupStateTimeout.EventTimeTimeout
    )


def capped_utterances(
    df: DataFrame, keys: Names, ts: str, gap_seconds: float, max_seconds: float, delay: str
) -> DataFrame:
    """Utterances with a maximum length, as ``sessions.utterance_sessions`` cuts them.

    A piece comes out when its time or the silence after it is over. Frames may come
    in any order within ``delay``; the state of a key holds those of that time and
    one open piece, and goes with the silence. Frames without a time are left out.
    """
    event = F.col(ts).cast("timestamp")
    rows = df.where(event.isNotNull()).select(*keys, event.alias("_at"), _micros(ts).alias("_us"))
    gap, longest = int(gap_seconds * 1_000_000), int(max_seconds * 1_000_000)
    pieces = awaited(
        rows.withWatermark("_at", delay),
        keys,
        _ddl(rows, keys) + ", piece long, _start long, _stop long, frames long",
        trackers.UtteranceTracker.state,
        lambda saved: trackers.UtteranceTracker(saved, gap, longest),
    )
    return pieces.select(
        *keys,
        "piece",
        F.timestamp_micros("_start").alias("start_ts"),
        F.timestamp_micros("_stop").alias("end_ts"),
        "frames",
    )


def interrupted_turns(
    turns: DataFrame,
    interrupts: DataFrame,
    keys: Names,
    turn: str,
    start: str,
    end: str,
    ts: str,
    delay: str,
    interrupted: bool = False,
) -> DataFrame:
    """Turns in whose time, ends included, no interrupt falls; or the others.

    Gives ``keys``, the turn's id, its start and its end. A kept turn comes out when
    the stream's time has passed its end, however long it is; an interrupted one with
    its first interrupt. State is held for turns that are not over and for interrupts
    not older than the stream's time, which is the slower of both streams' less
    ``delay``. Rows without a start, an end or a time are left out. The id is kept as
    text meanwhile, so it has a type that text can be cast to.
    """
    spans = turns.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(
        *keys,
        F.col(start).cast("timestamp").alias("_at"),
        _micros(start).alias("_us"),
        _micros(end).alias("_end_us"),
        F.lit(False).alias("_cut"),
        F.col(turn).cast("string").alias("_turn"),
    )
    cuts = interrupts.where(F.col(ts).isNotNull()).select(
        *keys,
        F.col(ts).cast("timestamp").alias("_at"),
        _micros(ts).alias("_us"),
        F.lit(0).cast("long").alias("_end_us"),
        F.lit(True).alias("_cut"),
        F.lit(None).cast("string").alias("_turn"),
    )
    told = awaited(
        spans.withWatermark("_at", delay).unionByName(cuts.withWatermark("_at", delay)),
        keys,
        _ddl(spans, keys) + ", _turn string, _start long, _stop long, _hit boolean",
        trackers.InterruptTracker.state,
        trackers.InterruptTracker,
    )
    return told.where(F.col("_hit") if interrupted else ~F.col("_hit")).select(
        *keys,
        F.col("_turn").cast(dict(turns.dtypes)[turn]).alias(turn),
        F.timestamp_micros("_start").alias(start),
        F.timestamp_micros("_stop").alias(end),
    )


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there into a Parquet folder, then stop."""
    query = (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
