"""Turns of a conversation: pairs, context, topic segments, live prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import prompts, text
from parley.operators.sequence import (
    FOLD_ROWS,
    Fold,
    as_of,
    fold,
    framed,
    join_on,
    key_rows,
    last_known,
    running_sum,
    with_position,
)
from parley.session import pinned

TOPIC_WORDS = 50
CONTEXT_TURNS = 2


def turn_pairs(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    message: str = "text",
    **how: int | None,
) -> DataFrame:
    """Each user turn whose next turn is the assistant's, with both texts."""
    following = F.struct(F.col(role).alias("role"), F.col(message).alias("text"))
    nexts = framed(
        df.select(conv, turn, role, message),
        [conv],
        [turn],
        0,
        1,
        lambda w: {"_next": F.lead(following).over(w)},
        **how,
    )
    paired = (F.col(role) == "user") & (F.col("_next.role") == "assistant")
    return nexts.filter(paired).select(
        conv, turn, F.col(message).alias("user_text"), F.col("_next.text").alias("assistant_text")
    )


def context_turns(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    message: str = "text",
    count: int = CONTEXT_TURNS,
    **how: int | None,
) -> DataFrame:
    """For each user turn, the ``count`` turns before it, oldest first."""
    entry = F.struct(F.col(role).alias("actor"), F.col(message).alias("message"))
    rows = framed(
        df.select(conv, turn, role, message),
        [conv],
        [turn],
        count,
        0,
        lambda w: {"extra_turns": F.collect_list(entry).over(w.rowsBetween(-count, -1))},
        **how,
    )
    return rows.filter(F.col(role) == "user").drop(role)


# -- topic segments --------------------------------------------------------


def suffix_starts(
    df: DataFrame,
    conv: str,
    position: str,
    words: str,
    min_words: int,
    sized: DataFrame,
    **window: int,
) -> DataFrame:
    """``conv, position`` and ``_from``: where the shortest run of newest
    messages with ``min_words`` words begins, null if there are not so many yet.

    That is the last message with at least ``min_words`` fewer words before it
    than there are up to this one, so both kinds of sums are merged in order
    and each message takes the last beginning it meets.
    """
    summed = running_sum(df, [conv], [position], F.col(words), "_before", sized=sized, **window)
    begin = F.struct(
        F.col("_before").alias("_at"), F.lit(0).alias("_asks"), F.col(position).alias("_start")
    )
    ask = F.struct(
        (F.col("_before") + F.col(words) - min_words).alias("_at"),
        F.lit(1).alias("_asks"),
        F.lit(None).cast("long").alias("_start"),
    )
    merged = summed.select(conv, position, F.inline(F.array(begin, ask)))
    filled = last_known(
        merged,
        [conv],
        ["_at", "_asks", position],
        F.col("_start"),
        "_from",
        sized=sized.withColumn("_n", F.col("_n") * 2),
        **window,
    )
    return filled.filter("_asks = 1").select(conv, position, "_from")


# Beyond any number of messages of a conversation.
NO_END = 1 << 60


def lag_fold(length: str, advance: str) -> Fold:
    """How many messages the index lags behind, before and after a message.

    A run of messages is summarised by the ranges of lags on which it acts alike:
    from ``lo`` up to ``hi`` it gives ``keep`` (0 or 1) times the lag, plus ``add``.
    A message cuts at most one range in two, where a segment begins to be found, so
    a summary is no longer than its run, and a message without a segment cuts none.
    """

    def piece(lo: Column, hi: Column, keep: Column, add: Column) -> Column:
        cast = lambda c: c.cast("long")
        return F.struct(cast(lo).alias("lo"), cast(hi).alias("hi"), cast(keep).alias("keep"), cast(add).alias("add"))

    def present(pieces: Column) -> Column:
        return F.filter(pieces, lambda p: p["lo"] < p["hi"])

    def after(lag: Column, row: Column) -> Column:
        return lag + 1 - row[length] if advance == "length" else F.lit(0).cast("long")

    def moved(lag: Column, row: Column) -> Column:
        return F.when(row[length] <= lag + 1, after(lag, row)).otherwise(lag + 1)

    def split(p: Column, row: Column) -> Column:
        # From which lag on a segment is found.
        whole = F.when(p["add"] >= row[length] - 1, p["lo"]).otherwise(p["hi"])
        at = F.when(p["keep"] == 1, row[length] - 1 - p["add"]).otherwise(whole)
        at = F.coalesce(F.greatest(p["lo"], F.least(p["hi"], at)), p["hi"])
        kept = p["keep"] if advance == "length" else F.lit(0)
        found = F.coalesce(after(p["add"], row), F.lit(0))
        return F.array(piece(p["lo"], at, p["keep"], p["add"] + 1), piece(at, p["hi"], kept, found))

    def follow(f: Column, g: Column) -> Column:
        # The part of f's range that f sends into g's.
        inside = (g["lo"] <= f["add"]) & (f["add"] < g["hi"])
        lo = F.when(f["keep"] == 1, F.greatest(f["lo"], g["lo"] - f["add"])).otherwise(f["lo"])
        hi = F.when(f["keep"] == 1, F.least(f["hi"], g["hi"] - f["add"])).otherwise(
            F.when(inside, f["hi"]).otherwise(f["lo"])
        )
        return piece(lo, hi, f["keep"] * g["keep"], g["keep"] * f["add"] + g["add"])

    def apply(pieces: Column, lag: Column) -> Column:
        own = F.get(F.filter(pieces, lambda p: (p["lo"] <= lag) & (lag < p["hi"])), F.lit(0))
        return own["keep"] * lag + own["add"]

    zero, one = F.lit(0), F.lit(1)
    return Fold(
        initial=F.lit(0).cast("long"),
        step=moved,
        identity=F.array(piece(zero, F.lit(NO_END), one, zero)),
        extend=lambda f, row: present(F.flatten(F.transform(f, lambda p: split(p, row)))),
        compose=lambda f, g: present(
            F.flatten(F.transform(f, lambda p: F.transform(g, lambda q: follow(p, q))))
        ),
        apply=apply,
    )


def topic_segments(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    message: str = "text",
    min_words: int = TOPIC_WORDS,
    advance: str = "length",
    limit: int = FOLD_ROWS,
    **window: int,
) -> DataFrame:
    """Segments: ``conv, segment, start_pos, end_pos`` (0-based message places).

    After each message the shortest run of newest messages with ``min_words``
    words is looked for, among the messages from the index on. If there is one
    it is a segment, and the index moves on by its length; with
    ``advance="end"`` it moves past the segment.
    """
    if advance not in ("length", "end"):
        raise ValueError(f"advance must be 'length' or 'end', not {advance!r}")
    # Counts of words are costly and positions are read often, so narrow tables of
    # whole numbers are stored on the way.
    counted = pinned(df.select(conv, turn, text.word_count(F.col(message)).alias("_words")))
    sized = key_rows(counted, [conv])
    numbered = pinned(with_position(counted, [conv], [turn], "end_pos", sized=sized, **window))
    placed = suffix_starts(numbered, conv, "end_pos", "_words", min_words, sized, **window)
    measured = pinned(
        placed.select(
            conv,
            "end_pos",
            F.col("_from").alias("start_pos"),
            (F.col("end_pos") - F.col("_from") + 1).cast("long").alias("_length"),
        )
    )
    lags = fold(
        measured,
        [conv],
        ["end_pos"],
        ["start_pos", "_length"],
        lag_fold("_length", advance),
        limit=limit,
        dense="end_pos",
    )
    found = lags.filter(F.col("_length") <= F.col("_before") + 1)
    return with_position(
        found.select(conv, "start_pos", "end_pos"), [conv], ["end_pos"], "segment", sized=sized, **window
    )


def render_conversation(
    df: DataFrame,
    segments: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    message: str = "text",
    **how: int | None,
) -> DataFrame:
    """The messages of each segment as text, and the question about its topic."""
    numbered = with_position(
        df.select(conv, turn, role, message), [conv], [turn], "_pos", **how
    )
    places = segments.select(
        conv, "segment", F.explode(F.sequence("start_pos", "end_pos")).alias("_pos")
    )
    entry = F.struct("_pos", F.col(role).alias("actor"), F.col(message).alias("message"))
    rendered = (
        join_on(places, numbered, [conv, "_pos"])
        .groupBy(conv, "segment")
        .agg(F.sort_array(F.collect_list(entry)).alias("_m"))
        .select(conv, "segment", prompts.render_messages(F.col("_m")).alias("conversation"))
    )
    return rendered.withColumn("prompt", prompts.topic_prompt(F.col("conversation")))


def live_prompt(
    contexts: DataFrame,
    situations: DataFrame,
    modes: DataFrame,
    emotions: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    message: str = "text",
    at: str | None = None,
    tie: str | None = None,
    **how: int,
) -> DataFrame:
    """The prompt of each user turn, with the mode and the emotion of that moment.

    ``contexts`` comes from ``context_turns``; ``situations`` has one row per
    conversation. ``modes`` and ``emotions`` are changes over time: a turn gets the
    latest one that is not after it by ``at`` (the turn, unless another column of all
    three tables is named; ``tie`` settles changes of one time). What is missing is
    left out; the mode is then ``medium``.
    """
    at = at or turn
    told = contexts.join(situations.select(conv, "situation"), conv, "left")
    # Only the moments are merged with the changes; the texts stay where they are.
    moment = list(dict.fromkeys([conv, turn, at]))
    moments = pinned(contexts.select(*moment).distinct())
    for changes, value in ((modes, "mode"), (emotions, "emotion")):
        told = join_on(told, as_of(moments, changes, [conv], at, value, tie, **how), moment)
    prompt = prompts.build_prompt(
        F.col("situation"),
        F.col(message),
        F.col("emotion"),
        F.coalesce("mode", F.lit("medium")),
        extra_turns=F.col("extra_turns"),
    )
    return told.select(conv, turn, prompt.alias("prompt"))
