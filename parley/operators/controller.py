"""Response-length control by latency.

Turns of a session, in order, carry the latency of the response in ms. A
smoothed latency and the 80th percentile of the last 15 turns give a signal,
the signal asks for a mode, and hysteresis decides when the mode follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.sequence import (
    FOLD_ROWS,
    Fold,
    Names,
    fold,
    framed,
    table_fold,
    with_position,
)
from parley.session import pinned

# Smoothing, window, warm-up and hysteresis.
KEEP, TAKE = 0.85, 0.15
WINDOW = 15
WARM_UP = 4
DOWN, OTHER = 1, 4
MODES = ["long", "medium", "short"]
START_MODE = "medium"

# Settings if the caller gives none.
TARGET_MS = 2000.0
UPPER, LOWER = 1.30, 0.80


def waterfall_latency(waterfall: Column, start: str = "stt_out", end: str = "tts_out") -> Column:
    """ms between the first entries of two components; null if one is missing."""

    def first(component: str) -> Column:
        return F.get(F.filter(waterfall, lambda s: s["component"] == component), F.lit(0))["time"]

    return (first(end) - first(start)) * 1000


# -- smoothed latency ------------------------------------------------------


def smoothing(latency: str, target: float) -> Fold:
    """e <- 0.85 e + 0.15 x, starting at the target.

    A run of rows multiplies the state by a and adds b.
    """

    def line(a: Column, b: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"))

    return Fold(
        initial=F.lit(float(target)),
        step=lambda e, r: e * KEEP + r[latency] * TAKE,
        identity=line(F.lit(1.0), F.lit(0.0)),
        extend=lambda f, r: line(f["a"] * KEEP, f["b"] * KEEP + r[latency] * TAKE),
        compose=lambda f, g: line(f["a"] * g["a"], f["b"] * g["a"] + g["b"]),
        apply=lambda f, e: f["a"] * e + f["b"],
    )


def ewma_latency(
    df: DataFrame,
    keys: Names,
    order: Names,
    latency: str,
    target: float = TARGET_MS,
    limit: int = FOLD_ROWS,
    dense: str | None = None,
) -> DataFrame:
    """Keys, order, latency and ``ewma`` after each turn."""
    kept = [dense] if dense and dense not in order else []
    rows = fold(
        df.withColumn(latency, F.col(latency).cast("double")),
        keys,
        order,
        [latency, *kept],
        smoothing(latency, target),
        after="ewma",
        limit=limit,
        dense=dense,
    )
    return rows.drop("_before")


def rolling_p80(
    df: DataFrame,
    keys: Names,
    order: Names,
    latency: str,
    out: str = "p80",
    size: int = WINDOW,
    **how: int | str | None,
) -> DataFrame:
    """Of the last ``size`` latencies in ascending order, the one at 0.8 n, from 0."""

    def build(w):
        return {"_last": F.collect_list(latency).over(w.rowsBetween(1 - size, 0))}

    rows = framed(df, keys, order, size - 1, 0, build, **how)
    place = F.floor(F.size("_last") * 4 / 5).cast("int")
    return rows.withColumn(out, F.get(F.sort_array("_last"), place)).drop("_last")


# -- mode ------------------------------------------------------------------

_COUNTS = OTHER
_STATES = len(MODES) * len(MODES) * _COUNTS
_NO_SIGNAL = len(MODES)


def encode_state(mode: int, pending: int, count: int) -> int:
    return (mode * len(MODES) + pending) * _COUNTS + count


def next_state(state: int, asked: int) -> int:
    """The hysteresis rule on an encoded (mode, pending, stable count)."""
    if asked == _NO_SIGNAL:
        return state
    rest, count = divmod(state, _COUNTS)
    mode, pending = divmod(rest, len(MODES))
    count = count + 1 if asked == pending else 1
    needed = DOWN if asked > mode else OTHER
    if count >= needed:
        return encode_state(asked, asked, 0)
    return encode_state(mode, asked, count)


def hysteresis(asked: str) -> Fold:
    """The rule as a table over 36 states and 4 inputs (the last: warm-up)."""
    inputs = len(MODES) + 1
    table = F.array(
        *[F.lit(next_state(s, a)) for s in range(_STATES) for a in range(inputs)]
    )
    start = MODES.index(START_MODE)

    def move(state: Column, row: Column) -> Column:
        return F.get(table, state * inputs + row[asked])

    return table_fold(encode_state(start, start, 0), _STATES, move)


def mode_name(state: Column) -> Column:
    names = F.array(*[F.lit(m) for m in MODES])
    return F.get(names, F.floor(state / (len(MODES) * _COUNTS)).cast("int"))


def response_mode(
    df: DataFrame,
    keys: Names,
    order: Names,
    latency: str,
    target: float = TARGET_MS,
    upper: float = UPPER,
    lower: float = LOWER,
    limit: int = FOLD_ROWS,
) -> DataFrame:
    """Turn number, smoothed latency, p80 and the mode after each turn."""
    # Narrow rows, stored because both folds and the window read their places.
    numbered = pinned(with_position(df.select(*keys, *order, latency), keys, order, "_turn"))
    smooth = ewma_latency(numbered, keys, order, latency, target, limit, "_turn")
    scored = rolling_p80(smooth, keys, order, latency, position="_at", dense="_turn")
    signal = F.greatest("ewma", "p80")
    asked = (
        F.when(F.col("_at") < WARM_UP, _NO_SIGNAL)
        .when(signal < target * lower, 0)
        .when(signal < target * upper, 1)
        .otherwise(2)
    )
    values = ["_at", latency, "ewma", "p80", "_asked"]
    rows = fold(
        scored.withColumn("_asked", asked),
        keys,
        order,
        values,
        hysteresis("_asked"),
        limit=limit,
        dense="_at",
    )
    return rows.select(
        *keys,
        *order,
        (F.col("_at") + 1).alias("session_turn"),
        latency,
        "ewma",
        "p80",
        mode_name(F.col("_after")).alias("mode"),
    )


# -- sessions --------------------------------------------------------------


def session_summary(
    sessions: DataFrame, turns: DataFrame, key: str, latency: str, ts: str
) -> DataFrame:
    """Latency range, duration and turn count of every session; 0 without turns."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    totals = turns.groupBy(key).agg(
        F.avg(latency).alias("mean_latency_ms"),
        F.max(latency).alias("max_latency_ms"),
        F.min(latency).alias("min_latency_ms"),
        ((F.max(micros) - F.min(micros)) / 1e6).alias("session_duration_s"),
        F.count(F.lit(1)).alias("session_turns"),
    )
    filled = [
        F.coalesce(c, F.lit(0.0)).alias(c)
        for c in ("mean_latency_ms", "max_latency_ms", "min_latency_ms", "session_duration_s")
    ]
    turns_count = F.coalesce("session_turns", F.lit(0)).cast("long").alias("session_turns")
    return sessions.select(key).join(totals, key, "left").select(key, *filled, turns_count)
