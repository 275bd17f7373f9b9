"""Users, characters, sessions, feedback, utterances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import privacy, text
from parley.operators.sequence import (
    Fold,
    Names,
    fold,
    framed,
    key_rows,
    last_known,
)

# The voices and faces there are; the first is the default.
VOICES = ["af_bella"]
FACES = ["julia"]
RATINGS = ["q1", "q2", "q3", "q4"]


# -- lookups ---------------------------------------------------------------


def owned_characters(
    df: DataFrame, owner: str, owner_id: Column | int, key: str, key_id: int | None = None
) -> DataFrame:
    """The caller's rows in insertion order; with ``key_id`` that one or none."""
    rows = df.filter(F.col(owner) == owner_id)
    if key_id is not None:
        return rows.filter(F.col(key) == key_id).limit(1)
    return rows.orderBy(key)


def user_by_name(df: DataFrame, username: str, value: str) -> DataFrame:
    return df.filter(F.col(username) == value)


def all_sessions(df: DataFrame) -> DataFrame:
    """Every session: a plain scan, columns pruned by whoever reads it."""
    return df


def drop_empty_responses(df: DataFrame, transcript: str, response: str) -> DataFrame:
    """Rows with a transcript (empty is one, null is not) and a non-empty response."""
    return df.filter(F.col(transcript).isNotNull() & (F.col(response) != ""))


# -- validation ------------------------------------------------------------


def _blank(c: Column) -> Column:
    return c.isNull() | (text.strip(c) == "")


def reject_reason(
    rules: str = "server",
    username: str = "username",
    name: str = "name",
    prompt: str | None = None,
    ratings: Names | None = None,
) -> Column:
    """Why a row is rejected, or null.

    ``server`` asks only for a username that is not blank. ``form`` also wants
    three characters, a name, a prompt and ratings from 1 to 5.
    """
    if rules not in ("server", "form"):
        raise ValueError(f"rules must be 'server' or 'form', not {rules!r}")
    reason = F.when(_blank(F.col(username)), "username empty")
    if rules == "form":
        reason = reason.when(F.length(F.col(username)) < 3, "username short")
        reason = reason.when(_blank(F.col(name)), "name empty")
        if prompt:
            reason = reason.when(_blank(F.col(prompt)), "prompt empty")
        for rating in ratings or []:
            wrong = ~F.coalesce(F.col(rating).between(1, 5), F.lit(False))
            reason = reason.when(wrong, f"{rating} out of range")
    return reason


def validate_rows(df: DataFrame, **rules: str | Names | None) -> DataFrame:
    """Adds ``reject_reason``; null means accepted. Filter on it for the two halves."""
    return df.withColumn("reject_reason", reject_reason(**rules))


def fill_agent_defaults(
    df: DataFrame, voice: str = "voice", face: str = "face", prompt: str = "prompt"
) -> DataFrame:
    """Defaults for missing values; ``valid`` is false for unknown ones."""
    filled = df.withColumns(
        {
            voice: F.coalesce(F.col(voice), F.lit(VOICES[0])),
            face: F.coalesce(F.col(face), F.lit(FACES[0])),
            prompt: F.coalesce(F.col(prompt), F.lit("")),
        }
    )
    return filled.withColumn("valid", F.col(voice).isin(VOICES) & F.col(face).isin(FACES))


# -- joins -----------------------------------------------------------------


def character_owner_join(
    characters: DataFrame, users: DataFrame, owner: str, user_id: str, keep_users: bool = False
) -> DataFrame:
    """Characters with their owners; ``keep_users`` adds users who own none.

    One user may own a large part of the characters. In an inner join AQE can
    split that user's partition; in an outer join that keeps the users it could
    not, so users without characters are added from an anti join on owners.
    """
    owned = characters.join(users, F.col(owner) == F.col(user_id), "inner")
    if not keep_users:
        return owned
    owners = characters.select(owner).distinct()
    without = users.join(owners, F.col(user_id) == F.col(owner), "left_anti")
    return owned.select(*users.columns, *characters.columns).unionByName(
        without, allowMissingColumns=True
    )


def ownership_semi_join(
    requests: DataFrame, characters: DataFrame, owner: str, key: str, denied: bool = False
) -> DataFrame:
    """Requests ``(owner, key)`` that may be served, or the others."""
    how = "left_anti" if denied else "left_semi"
    return requests.join(characters.select(owner, key), [owner, key], how)


def feedback_upsert(
    sessions: DataFrame, feedback: DataFrame, key: str, arrival: str, rejected: bool = False
) -> DataFrame:
    """Sessions with the answers of the last feedback on each.

    ``rejected`` gives the feedback on sessions that do not exist instead.
    """
    if rejected:
        return feedback.join(sessions.select(key), key, "left_anti")
    answers = [*RATINGS, "q5"]
    latest = feedback.groupBy(key).agg(
        F.max_by(F.struct(*answers), F.col(arrival)).alias("_given")
    )
    new = [
        *[F.coalesce(F.col("_given")[q], F.col(f"{q}_rating")).alias(f"{q}_rating") for q in RATINGS],
        F.when(F.col("_given").isNotNull(), F.coalesce(F.col("_given.q5"), F.lit("")))
        .otherwise(F.col("q5_answer"))
        .alias("q5_answer"),
    ]
    changed = {f"{q}_rating" for q in RATINGS} | {"q5_answer"}
    kept = [c for c in sessions.columns if c not in changed]
    return sessions.join(latest, key, "left").select(*kept, *new)


def unique_usernames(
    df: DataFrame, username: str, arrival: str, rejected: bool = False
) -> DataFrame:
    """The first row of each username, or the later ones.

    ``arrival`` is unique. The first is found by a partial minimum, and rows
    meet it by their unique arrival, so a frequent name is not a hot key.
    """
    first = df.groupBy(username).agg(F.min(arrival).alias(arrival)).select(arrival)
    return df.join(first, arrival, "left_anti" if rejected else "left_semi")


def interrupted_turns(
    turns: DataFrame,
    interrupts: DataFrame,
    keys: Names,
    start: str,
    end: str,
    ts: str,
    interrupted: bool = False,
    **how: int | None,
) -> DataFrame:
    """Turns in whose time, ends included, no interrupt falls; or the others.

    Each turn is given the first interrupt at or after its start by filling
    backwards through the merged sequence: no turn meets every interrupt of
    its session.
    """
    marked = turns.withColumns({"_at": F.col(start), "_mark": F.lit(0)})
    cuts = interrupts.select(
        *keys, F.col(ts).alias("_at"), F.lit(1).alias("_mark"), F.col(ts).alias("_cut")
    )
    merged = marked.unionByName(cuts, allowMissingColumns=True)
    # Read backwards, an interrupt comes before a turn that starts with it.
    filled = last_known(merged, keys, ["_at", "_mark"], F.col("_cut"), "_next", backwards=True, **how)
    hit = F.coalesce(F.col("_next") <= F.col(end), F.lit(False))
    rows = filled.filter(F.col("_mark") == 0)
    return rows.filter(hit if interrupted else ~hit).select(*turns.columns)


# -- speech ----------------------------------------------------------------


def endpoint_latency(
    df: DataFrame, keys: Names, ts: str, voiced: Column
) -> DataFrame:
    """Seconds from the last voiced frame (else the first frame) to the last."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.select(*keys, micros.alias("_us"), voiced.alias("_voiced"))
    spoken = F.max(F.when(F.col("_voiced"), F.col("_us")))
    silence = F.max("_us") - F.coalesce(spoken, F.min("_us"))
    return rows.groupBy(*keys).agg((silence / 1e6).alias("endpoint_latency"))


def utterance_sessions(
    df: DataFrame,
    keys: Names,
    ts: str,
    gap_seconds: float,
    max_seconds: float | None = None,
    **window: int,
) -> DataFrame:
    """Voiced frames grouped into utterances that end with a silence.

    A frame ``gap_seconds`` or more after the one before starts an utterance;
    ``max_seconds`` cuts long ones into pieces of that length from their start.
    """
    sized = key_rows(df, keys)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    frames = df.select(*keys, ts, micros.alias("_us"))
    since = framed(
        frames,
        keys,
        [ts],
        1,
        0,
        lambda w: {"_since": F.col("_us") - F.lag("_us").over(w)},
        sized=sized,
        **window,
    )
    opens = F.col("_since").isNull() | (F.col("_since") >= int(gap_seconds * 1_000_000))
    started = last_known(
        since, keys, [ts], F.when(opens, F.col("_us")), "_start", sized=sized, **window
    )
    piece = F.lit(0)
    if max_seconds is not None:
        piece = F.floor((F.col("_us") - F.col("_start")) / int(max_seconds * 1_000_000))
    return (
        started.groupBy(*keys, "_start", piece.alias("piece"))
        .agg(
            F.min(ts).alias("start_ts"),
            F.max(ts).alias("end_ts"),
            F.count(F.lit(1)).alias("frames"),
        )
        .drop("_start")
    )


# Before any time in microseconds.
NEVER = -(1 << 62)


def throttle(interval: int, us: str) -> Fold:
    """The time of the last emitted row, before and after a row.

    A run of rows is summarised by ``pieces``: a last emission up to ``hi`` (and
    after the piece before) leads to ``exit``, a later one than all pieces stays.
    Only those up to the run's ``first`` time can be met, so there are no more
    pieces than rows in the first interval, and pieces of one exit that follow
    each other are one.
    """
    kind = "struct<first:bigint,pieces:array<struct<hi:bigint,exit:bigint>>>"

    def summary(first: Column, pieces: Column) -> Column:
        following = lambda i: F.get(pieces, i + 1)["exit"]
        joined = F.filter(pieces, lambda p, i: ~following(i).eqNullSafe(p["exit"]))
        return F.struct(first.alias("first"), joined.alias("pieces")).cast(kind)

    def highest(pieces: Column) -> Column:
        return F.coalesce(F.get(pieces, F.size(pieces) - 1)["hi"], F.lit(NEVER))

    def apply(f: Column, last: Column) -> Column:
        return F.coalesce(F.get(F.filter(f["pieces"], lambda p: p["hi"] >= last), F.lit(0))["exit"], last)

    def step(last: Column, row: Column) -> Column:
        return F.when(row[us] - last >= interval, row[us]).otherwise(last)

    def piece(hi: Column, exit_: Column) -> Column:
        return F.struct(hi.alias("hi"), exit_.alias("exit"))

    def extend(f: Column, row: Column) -> Column:
        first = F.coalesce(f["first"], row[us])
        low, high = highest(f["pieces"]), row[us] - interval
        moved = F.transform(f["pieces"], lambda p: piece(p["hi"], step(p["exit"], row)))
        new = F.filter(F.array(piece(high, row[us])), lambda p: (low < p["hi"]) & (low < first))
        return summary(first, F.concat(moved, new))

    def compose(f: Column, g: Column) -> Column:
        first = F.coalesce(f["first"], g["first"])
        low = highest(f["pieces"])
        moved = F.transform(f["pieces"], lambda p: piece(p["hi"], apply(g, p["exit"])))

        def begin(i: Column) -> Column:
            return F.greatest(low, F.coalesce(F.get(g["pieces"], i - 1)["hi"], F.lit(NEVER)))

        rest = F.filter(g["pieces"], lambda p, i: (p["hi"] > low) & (begin(i) < first))
        return summary(first, F.concat(moved, rest))

    nothing = F.struct(F.lit(None).cast("long").alias("first"), F.array().alias("pieces")).cast(kind)
    return Fold(F.lit(NEVER), step, nothing, extend, compose, apply)


def throttle_emit(
    df: DataFrame, keys: Names, ts: str, tie: str, interval_seconds: float, **how: int
) -> DataFrame:
    """Rows at least an interval after the last emitted row; the first always is.

    ``(ts, tie)`` identifies a row within its key.
    """
    interval = int(interval_seconds * 1_000_000)
    rows = df.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), tie)
    states = fold(rows, keys, ["_us", tie], [], throttle(interval, "_us"), **how)
    back = F.timestamp_micros("_us")
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        back = back.cast("timestamp_ntz")
    return states.filter(F.col("_us") - F.col("_before") >= interval).select(*keys, tie, back.alias(ts))


# -- stored sessions -------------------------------------------------------


def masked_transcripts(
    df: DataFrame,
    key: str,
    turn: str,
    actor: str,
    message: str,
    part_turns: int = 1_000,
) -> DataFrame:
    """Masked messages of each session as arrays: ``key, part, transcripts``.

    A part holds the turns of one range of turn numbers; an ordinary session
    has part 0 only, and no session is ever one unbounded value.
    """
    safe = df.select(
        key,
        turn,
        F.floor(F.col(turn) / part_turns).alias("part"),
        F.col(actor).alias("actor"),
        privacy.mask_pii(F.col(message)).alias("message"),
    )
    rows = F.sort_array(F.collect_list(F.struct(turn, "actor", "message")))
    entries = F.transform(
        rows, lambda m: F.struct(m["actor"].alias("actor"), m["message"].alias("message"))
    )
    return safe.groupBy(key, "part").agg(entries.alias("transcripts"))


def pii_counts(df: DataFrame, key: str, message: str) -> DataFrame:
    """Entities found per document and type, where there are any."""
    counts = [
        F.struct(F.lit(e).alias("entity"), privacy.count_found(F.col(message), e).alias("n"))
        for e in privacy.ENTITIES
    ]
    return (
        df.select(key, F.explode(F.array(*counts)).alias("_c"))
        .filter("_c.n > 0")
        .select(key, F.col("_c.entity").alias("entity"), F.col("_c.n").alias("n"))
    )
