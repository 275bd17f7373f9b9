"""Emotion scores over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.labels import FACE_EMOTIONS
from parley.operators.sequence import (
    FOLD_ROWS,
    Fold,
    Names,
    fold,
    framed,
    with_position,
)

DECAY_RATE = 7.0


def scores_array(scores: Column, classes: list[str] | None = None) -> Column:
    """A score map as an array in class order; missing classes are 0."""
    return F.array(
        *[F.coalesce(scores[c], F.lit(0.0)).cast("double") for c in classes or FACE_EMOTIONS]
    )


def decay(alpha: str, observed: str, classes: int) -> Fold:
    """s <- (1 - alpha) s + alpha * observed, for each class.

    A run of rows multiplies all scores by a and adds b.
    """
    zeros = F.array(*[F.lit(0.0)] * classes)

    def line(a: Column, b: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"))

    def moved(a: Column, scores: Column, added: Column) -> Column:
        return F.zip_with(scores, added, lambda s, x: a * s + x)

    return Fold(
        initial=zeros,
        step=lambda s, r: F.zip_with(
            s, r[observed], lambda p, o: (1.0 - r[alpha]) * p + r[alpha] * o
        ),
        identity=line(F.lit(1.0), zeros),
        extend=lambda f, r: line(
            f["a"] * (1.0 - r[alpha]),
            F.zip_with(f["b"], r[observed], lambda s, o: (1.0 - r[alpha]) * s + r[alpha] * o),
        ),
        compose=lambda f, g: line(f["a"] * g["a"], moved(g["a"], f["b"], g["b"])),
        apply=lambda f, s: moved(f["a"], s, f["b"]),
    )


def emotion_decay(
    df: DataFrame,
    keys: Names,
    ts: str,
    order: Names,
    observed: str,
    decay_rate: float = DECAY_RATE,
    start: str | None = None,
    classes: int = len(FACE_EMOTIONS),
    limit: int = FOLD_ROWS,
) -> DataFrame:
    """Decayed scores after each observation.

    ``order`` begins with ``ts`` and identifies the row. alpha = 1 - exp(-k dt),
    dt in seconds since the row before; the first row counts from ``start``, or
    from itself if there is none.
    """
    numbered = with_position(df, keys, order, "_at")
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    origin = F.unix_micros(F.col(start).cast("timestamp")) if start else micros
    timed = framed(
        numbered.withColumn("_us", micros),
        keys,
        order,
        1,
        0,
        lambda w: {"_dt": (F.col("_us") - F.coalesce(F.lag("_us").over(w), origin)) / 1e6},
        dense="_at",
    )
    weighted = timed.withColumn("_alpha", 1.0 - F.exp(-decay_rate * F.col("_dt")))
    rows = fold(
        weighted,
        keys,
        order,
        ["_alpha", observed, "_at"],
        decay("_alpha", observed, classes),
        after="scores",
        limit=limit,
        dense="_at",
    )
    return rows.select(*keys, *order, "scores")


def dominant_emotion(scores: Column, classes: list[str] | None = None) -> Column:
    """The class with the greatest score; the first in class order on ties."""
    names = F.array(*[F.lit(c) for c in classes or FACE_EMOTIONS])
    return F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))


def latest_frame_sample(
    df: DataFrame, keys: Names, ts: str, width: str, tie: str, values: Names
) -> DataFrame:
    """The newest row of each key and time slot; older ones are dropped.

    A partial maximum per task, so a busy key costs no more than others.
    """
    slot = F.window(F.col(ts), width)
    newest = F.max_by(F.struct(ts, tie, *values), F.struct(ts, tie))
    return (
        df.groupBy(*keys, slot.alias("_slot"))
        .agg(newest.alias("_row"))
        .select(*keys, F.col("_slot.start").alias("slot"), "_row.*")
    )
