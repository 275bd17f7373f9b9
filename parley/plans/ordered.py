"""Sequential operators over event sessions, and their split-key plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.labels import FACE_EMOTIONS
from parley.operators import controller, emotion, evaluation, sessions, speech
from parley.plans import fixtures as fx
from parley.plans.registry import query
from parley.plans.scores import LATENCY_STATS, STATS, sparse_latencies

SESSION = ["user_id"]


def events(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "events")


# -- controller ------------------------------------------------------------

EWMA = f"""{fx.TURNS}, smoothed AS (
  SELECT user_id, ts, event_id, n, 2000.0::DOUBLE * 0.85::DOUBLE + latency_ms * 0.15::DOUBLE AS ewma
  FROM turns WHERE n = 1
  UNION ALL
  SELECT t.user_id, t.ts, t.event_id, t.n, s.ewma * 0.85::DOUBLE + t.latency_ms * 0.15::DOUBLE
  FROM smoothed s JOIN turns t ON t.user_id = s.user_id AND t.n = s.n + 1)"""
EWMA_SQL = f"WITH RECURSIVE {EWMA} SELECT user_id, event_id, ewma FROM smoothed"
# Chunks add in another order than the recursion, so the last bits differ; compared
# in steps of 2^-20, whose midpoints are no values of decimal latencies.
EWMA_ROUNDED_SQL = f"""WITH RECURSIVE {EWMA}
SELECT user_id, event_id, CAST(round(ewma * 1048576) AS BIGINT) AS ewma_steps FROM smoothed"""


def smoothed(spark: SparkSession, sf: str, **how: int) -> DataFrame:
    rows = controller.ewma_latency(fx.turns(spark, sf), SESSION, fx.TURN_ORDER, "latency_ms", **how)
    return rows.select("user_id", "event_id", "ewma")


@query("ewma_latency", EWMA_SQL)
def ewma_latency(spark: SparkSession, sf: str) -> DataFrame:
    return smoothed(spark, sf)


@query("ewma_latency_split_sessions", EWMA_ROUNDED_SQL)
def ewma_latency_split_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = smoothed(spark, sf, limit=16)
    steps = F.round(F.col("ewma") * 1048576).cast("long")
    return rows.select("user_id", "event_id", steps.alias("ewma_steps"))


RANKED = """ranked AS (
  SELECT *, list_sort(list(latency_ms) OVER (
    PARTITION BY user_id ORDER BY n ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)) AS last
  FROM turns)"""
P80_SQL = f"WITH {fx.TURNS}, {RANKED} SELECT user_id, event_id, last[len(last) * 4 // 5 + 1] AS p80 FROM ranked"


@query("rolling_p80", P80_SQL)
def rolling_p80(spark: SparkSession, sf: str) -> DataFrame:
    rows = controller.rolling_p80(fx.turns(spark, sf), SESSION, fx.TURN_ORDER, "latency_ms")
    return rows.select("user_id", "event_id", "p80")


@query("rolling_p80_split_sessions", P80_SQL)
def rolling_p80_split_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = controller.rolling_p80(
        fx.turns(spark, sf), SESSION, fx.TURN_ORDER, "latency_ms", limit=20
    )
    return rows.select("user_id", "event_id", "p80")


# The controller step by step: smoothed latency, wish, pending wish, its count, mode.
MODE_SQL = f"""WITH RECURSIVE {EWMA}, {RANKED},
wishes AS (
  SELECT r.user_id, r.event_id, r.n,
         CASE WHEN signal < 2000.0 * 0.80::DOUBLE THEN 0 WHEN signal < 2000.0 * 1.30::DOUBLE THEN 1
              ELSE 2 END AS wish
  FROM (SELECT r.user_id, r.event_id, r.n,
               greatest(s.ewma, r.last[len(r.last) * 4 // 5 + 1]) AS signal
        FROM ranked r JOIN smoothed s ON s.user_id = r.user_id AND s.n = r.n) r),
controlled AS (
  SELECT user_id, event_id, n, 1 AS mode, 1 AS pending, 0 AS stable FROM wishes WHERE n = 1
  UNION ALL
  SELECT user_id, event_id, n,
         CASE WHEN n > 4 AND hits >= needed THEN wish ELSE mode END,
         CASE WHEN n > 4 THEN wish ELSE pending END,
         CASE WHEN n <= 4 THEN stable WHEN hits >= needed THEN 0 ELSE hits END
  FROM (SELECT w.user_id, w.event_id, w.n, w.wish, c.mode, c.pending, c.stable,
               CASE WHEN w.wish = c.pending THEN c.stable + 1 ELSE 1 END AS hits,
               CASE WHEN w.wish > c.mode THEN 1 ELSE 4 END AS needed
        FROM controlled c JOIN wishes w ON w.user_id = c.user_id AND w.n = c.n + 1))
SELECT user_id, event_id, n AS session_turn, ['long', 'medium', 'short'][mode + 1] AS mode
FROM controlled"""


def modes(spark: SparkSession, sf: str, **how: int) -> DataFrame:
    rows = controller.response_mode(fx.turns(spark, sf), SESSION, fx.TURN_ORDER, "latency_ms", **how)
    return rows.select("user_id", "event_id", "session_turn", "mode")


@query("response_mode", MODE_SQL)
def response_mode(spark: SparkSession, sf: str) -> DataFrame:
    return modes(spark, sf)


@query("response_mode_split_sessions", MODE_SQL)
def response_mode_split_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return modes(spark, sf, limit=16)


SUMMARY_SQL = f"""WITH {fx.TURNS}, totals AS (
  SELECT user_id, avg(latency_ms) AS mean, max(latency_ms) AS max, min(latency_ms) AS min,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds, count(*) AS n
  FROM turns GROUP BY user_id)
SELECT c_custkey AS user_id, round(coalesce(mean, 0.0), 6) AS mean_latency_ms,
       coalesce(max, 0.0) AS max_latency_ms, coalesce(min, 0.0) AS min_latency_ms,
       coalesce(seconds, 0.0) AS session_duration_s, coalesce(n, 0) AS session_turns
FROM customer LEFT JOIN totals ON user_id = c_custkey"""


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    everyone = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    rows = controller.session_summary(
        everyone, fx.turns(spark, sf), "user_id", "latency_ms", "ts"
    )
    return fx.rounded(rows, 6, "mean_latency_ms")


@query("session_summary", SUMMARY_SQL)
def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summaries(spark, sf)


# -- emotions --------------------------------------------------------------

# Events as observations of one face emotion each; two classes are never seen.
SEEN = {"error": "angry", "click": "happy", "view": "neutral", "signup": "surprise", "purchase": "sad"}
RATE = 1e-5


def observations(spark: SparkSession, sf: str) -> DataFrame:
    scores = F.create_map(
        *[F.lit(x) for pair in SEEN.items() for x in pair]
    )[F.col("event_type")]
    observed = emotion.scores_array(F.create_map(scores, F.col("value")))
    return events(spark, sf).select("user_id", "ts", "event_id", observed.alias("observed"))


def scores(spark: SparkSession, sf: str, **how: int) -> DataFrame:
    return emotion.emotion_decay(
        observations(spark, sf), SESSION, "ts", fx.TURN_ORDER, "observed", RATE, **how
    )


_OBS = {c: next((e for e, x in SEEN.items() if x == c), None) for c in FACE_EMOTIONS}
_SEEN_SQL = ", ".join(
    f"CASE WHEN event_type = '{e}' THEN value ELSE 0.0 END AS o_{c}" if e else f"0.0::DOUBLE AS o_{c}"
    for c, e in _OBS.items()
)
DECAY = f"""observed AS (
  SELECT user_id, ts, event_id, {_SEEN_SQL}, row_number() OVER w AS n,
         1.0::DOUBLE - exp(-{RATE}::DOUBLE * coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 0.0))
           AS alpha
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
decayed AS (
  SELECT user_id, event_id, n, {", ".join(f"alpha * o_{c} AS {c}" for c in FACE_EMOTIONS)}
  FROM observed WHERE n = 1
  UNION ALL
  SELECT o.user_id, o.event_id, o.n,
         {", ".join(f"(1.0 - alpha) * d.{c} + alpha * o_{c}" for c in FACE_EMOTIONS)}
  FROM decayed d JOIN observed o ON o.user_id = d.user_id AND o.n = d.n + 1)"""
DECAY_SQL = f"""WITH RECURSIVE {DECAY} SELECT user_id, event_id,
{", ".join(f"round({c}, 6) AS {c}" for c in FACE_EMOTIONS)} FROM decayed"""


def spread(rows: DataFrame) -> DataFrame:
    columns = [F.round(F.col("scores")[i], 6).alias(c) for i, c in enumerate(FACE_EMOTIONS)]
    return rows.select("user_id", "event_id", *columns)


@query("emotion_decay", DECAY_SQL)
def emotion_decay(spark: SparkSession, sf: str) -> DataFrame:
    return spread(scores(spark, sf))


@query("emotion_decay_split_sessions", DECAY_SQL)
def emotion_decay_split_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return spread(scores(spark, sf, limit=16))


TOP_SQL = f"""WITH RECURSIVE {DECAY}, top AS (
      SELECT *, greatest({", ".join(FACE_EMOTIONS)}) AS best FROM decayed)
    SELECT user_id, event_id, CASE {" ".join(f"WHEN {c} = best THEN '{c}'" for c in FACE_EMOTIONS)}
      END AS emotion FROM top"""


@query("dominant_emotion", TOP_SQL)
def dominant_emotion(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).select(
        "user_id", "event_id", emotion.dominant_emotion(F.col("scores")).alias("emotion")
    )


@query(
    "latest_frame_sample",
    """SELECT user_id, date_trunc('hour', ts) AS slot, max(ts) AS ts,
       arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value
    FROM events GROUP BY ALL""",
)
def latest_frame_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = emotion.latest_frame_sample(
        events(spark, sf), SESSION, "ts", "1 hour", "event_id", ["value"]
    )
    return rows.withColumn("slot", F.col("slot").cast("timestamp_ntz"))


# -- speech ----------------------------------------------------------------

HOUR = 3600
THROTTLE_SQL = f"""WITH RECURSIVE {fx.TURNS}, emitted AS (
  SELECT user_id, event_id, ts, n, ts AS last, true AS due FROM turns WHERE n = 1
  UNION ALL
  SELECT t.user_id, t.event_id, t.ts, t.n,
         CASE WHEN t.ts - e.last >= INTERVAL 6 HOUR THEN t.ts ELSE e.last END,
         t.ts - e.last >= INTERVAL 6 HOUR
  FROM emitted e JOIN turns t ON t.user_id = e.user_id AND t.n = e.n + 1)
SELECT user_id, event_id, ts FROM emitted WHERE due"""


def throttled(spark: SparkSession, sf: str, **how: int) -> DataFrame:
    return sessions.throttle_emit(events(spark, sf), SESSION, "ts", "event_id", 6 * HOUR, **how)


@query("throttle_emit", THROTTLE_SQL)
def throttle_emit(spark: SparkSession, sf: str) -> DataFrame:
    return throttled(spark, sf)


@query("throttle_emit_split_sessions", THROTTLE_SQL)
def throttle_emit_split_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return throttled(spark, sf, limit=2)


def utterances_sql(hours: int, pieces: str = "0", shown: str = "") -> str:
    return f"""WITH gaps AS (
      SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL {hours} HOUR, true) AS opens
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    started AS (
      SELECT user_id, ts, last_value(CASE WHEN opens THEN ts END IGNORE NULLS) OVER (
        PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS start
      FROM gaps)
    SELECT user_id, CAST({pieces} AS BIGINT) AS piece, min(ts) AS start_ts, max(ts) AS end_ts,
           count(*) AS frames{shown}
    FROM started GROUP BY user_id, start, piece"""


PIECES = f"(epoch_us(ts) - epoch_us(start)) // {5 * HOUR * 1_000_000}"


def utterances(spark: SparkSession, sf: str, **how: float) -> DataFrame:
    rows = sessions.utterance_sessions(events(spark, sf), SESSION, "ts", 2 * HOUR, **how)
    return rows.withColumn("piece", F.col("piece").cast("long"))


@query("utterance_sessions", utterances_sql(2))
def utterance_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return utterances(spark, sf)


@query("utterance_sessions_capped", utterances_sql(2, PIECES))
def utterance_sessions_capped(spark: SparkSession, sf: str) -> DataFrame:
    return utterances(spark, sf, max_seconds=5 * HOUR)


@query("utterance_sessions_split_sessions", utterances_sql(2))
def utterance_sessions_split_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return utterances(spark, sf, limit=16)


@query(
    "endpoint_latency",
    """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day,
       (epoch_us(max(ts)) - epoch_us(coalesce(max(ts) FILTER (WHERE value > 20), min(ts)))) / 1e6
         AS endpoint_latency
    FROM events GROUP BY ALL""",
)
def endpoint_latency(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).withColumn("day", F.to_date("ts").cast("string"))
    return sessions.endpoint_latency(rows, ["user_id", "day"], "ts", F.col("value") > 20)


CODES_SQL = """WITH coded AS (
  SELECT user_id, ts, event_id, CAST(event_id % 4200 - 50 AS INTEGER) AS code,
         row_number() OVER w AS n,
         list(CAST(event_id % 4200 - 50 AS INTEGER)) OVER (
           PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS codes
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
windows AS (SELECT user_id, n, codes FROM coded WHERE n % 7 = 0 AND n > 27)"""


def code_windows(spark: SparkSession, sf: str, **how: int) -> DataFrame:
    code = (F.col("event_id") % 4200 - 50).cast("int").alias("code")
    rows = events(spark, sf).select("user_id", "ts", "event_id", code)
    return speech.count_window(rows, SESSION, fx.TURN_ORDER, "code", **how)


COUNT_WINDOW_SQL = f"""{CODES_SQL}
SELECT user_id, n AS count, array_to_string(codes, ',') AS "values" FROM windows"""


def listed(values: str) -> F.Column:
    return F.array_join(F.col(values).cast("array<string>"), ",")


@query("count_window_28_7", COUNT_WINDOW_SQL)
def count_window_28_7(spark: SparkSession, sf: str) -> DataFrame:
    return code_windows(spark, sf).withColumn("values", listed("values"))


@query("count_window_split_sessions", COUNT_WINDOW_SQL)
def count_window_split_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return code_windows(spark, sf, limit=32).withColumn("values", listed("values"))


def _codes_at(places: str) -> str:
    return (
        "array_to_string(list_filter(codes, lambda c, i: (i - 1) % 7 IN "
        f"({places})), ',')"
    )


@query(
    "interleaved_codes",
    f"""{CODES_SQL} SELECT user_id, n AS count, {_codes_at("0")} AS codes_0,
    {_codes_at("1, 4")} AS codes_1, {_codes_at("2, 3, 5, 6")} AS codes_2,
    list_min(codes) >= 0 AND list_max(codes) <= 4096 AS valid FROM windows""",
)
def interleaved_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = code_windows(spark, sf)
    split = rows.withColumns(speech.interleaved_codes(F.col("values"))).drop("values")
    return split.withColumns({f"codes_{i}": listed(f"codes_{i}") for i in range(3)})


# Every fourth output is noise; some numbers are out of the range of their place.
TOKENS_SQL = """WITH RECURSIVE numbered AS (
  SELECT user_id, event_id, CAST(event_id * 37 % 40000 AS BIGINT) AS number,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events WHERE event_id % 4 <> 0),
placed AS (
  SELECT user_id, event_id, n, number, 0 AS place, number - 10 AS code FROM numbered WHERE n = 1
  UNION ALL
  SELECT user_id, event_id, n, number, place, number - 10 - place * 4096
  FROM (SELECT t.user_id, t.event_id, t.n, t.number,
               CASE WHEN p.code > 0 THEN (p.place + 1) % 7 ELSE p.place END AS place
        FROM placed p JOIN numbered t ON t.user_id = p.user_id AND t.n = p.n + 1))
SELECT user_id, event_id, CAST(place AS INTEGER) AS place, code FROM placed WHERE code > 0"""


def tokens(spark: SparkSession, sf: str, **how: int) -> DataFrame:
    number = (F.col("event_id") * 37 % 40000).cast("string")
    output = F.when(F.col("event_id") % 4 == 0, "noise").otherwise(
        F.concat(F.lit("<custom_token_1> <custom_token_"), number, F.lit("> "))
    )
    rows = events(spark, sf).select(
        "user_id", "ts", "event_id", speech.token_number(output).alias("number")
    )
    return speech.token_codes(rows, SESSION, fx.TURN_ORDER, "number", **how).drop("ts")


@query("token_codes", TOKENS_SQL)
def token_codes(spark: SparkSession, sf: str) -> DataFrame:
    return tokens(spark, sf)


@query("token_codes_split_sessions", TOKENS_SQL)
def token_codes_split_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return tokens(spark, sf, limit=16)


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
TIMELINE_SQL = f"""WITH timed AS (
  SELECT *, coalesce(sum(l_quantity * 25.0) OVER (
    PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS start FROM lineitem)
SELECT l_orderkey, {", ".join(LINE_ORDER)}, CAST(round_even(start, 0) AS DOUBLE) AS start_ms,
       CAST(round_even(start + l_quantity * 25.0, 0) AS DOUBLE) AS end_ms FROM timed"""


def timeline(spark: SparkSession, sf: str, **how: int) -> DataFrame:
    rows = fx.table(spark, sf, "lineitem").select("l_orderkey", *LINE_ORDER, "l_quantity")
    return speech.cumulative_timeline(rows, ["l_orderkey"], LINE_ORDER, "l_quantity", **how).drop(
        "l_quantity"
    )


@query("cumulative_timeline", TIMELINE_SQL)
def cumulative_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return timeline(spark, sf)


@query("cumulative_timeline_split_orders", TIMELINE_SQL)
def cumulative_timeline_split_orders(spark: SparkSession, sf: str) -> DataFrame:
    return timeline(spark, sf, limit=2)


# -- visemes ---------------------------------------------------------------

UTTERANCE = ["conv_id", "turn"]


def phonemes(spark: SparkSession, sf: str) -> DataFrame:
    """The letters of each turn as phonemes, ``h`` as the length mark.

    A letter lasts as many frames as its code modulo 5, plus one; silence of
    two and three frames stands before and after.
    """
    letters = F.split(F.regexp_replace("text", "h", speech.LENGTH_MARK), "")
    letter = F.struct(
        F.lit(None).cast("string").alias("phoneme"), F.lit(2.0).alias("duration")
    )
    tail = F.struct(F.lit(None).cast("string").alias("phoneme"), F.lit(3.0).alias("duration"))
    middle = F.transform(
        F.filter(letters, lambda p: p != ""),
        lambda p: F.struct(
            p.alias("phoneme"), (F.ascii(p) % 5 + 1).cast("double").alias("duration")
        ),
    )
    rows = F.concat(F.array(letter), middle, F.array(tail))
    return fx.texts(spark, sf, "conversations").select(
        *UTTERANCE, F.posexplode(rows).alias("i", "_r")
    ).select(*UTTERANCE, "i", "_r.phoneme", "_r.duration")


_VISEME_ROWS = ", ".join(f"('{p}', '{v}')" for p, v in speech.PHONEME_TO_VISEME.items())
PHONEMES = f"""letters AS (
  SELECT conv_id, turn, CAST(generate_subscripts(l, 1) AS INTEGER) AS i, unnest(l) AS phoneme
  FROM (SELECT conv_id, turn,
               list_filter(string_split(replace(text, 'h', '{speech.LENGTH_MARK}'), ''), lambda p: p <> '') AS l
        FROM conversations)),
counts AS (SELECT conv_id, turn, length(text) AS p FROM conversations),
durations AS (
  SELECT conv_id, turn, i, phoneme, CAST(unicode(phoneme) % 5 + 1 AS DOUBLE) AS duration FROM letters
  UNION ALL SELECT conv_id, turn, 0, NULL, 2.0 FROM conversations
  UNION ALL SELECT conv_id, turn, p + 1, NULL, 3.0 FROM counts),
visemes(phoneme, viseme) AS (VALUES {_VISEME_ROWS}),
timed AS (
  SELECT conv_id, turn, i, phoneme, viseme, duration,
         round_even(sum(duration * 25.0) OVER w - duration * 25.0, 0) AS start_ms,
         round_even(sum(duration * 25.0) OVER w, 0) AS end_ms
  FROM durations LEFT JOIN visemes USING (phoneme)
  WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING))"""
VISEME_SQL = f"""WITH {PHONEMES}, owned AS (
  SELECT *, last_value(CASE WHEN viseme IS NOT NULL THEN i END IGNORE NULLS) OVER (
    PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING) AS owner FROM timed),
grouped AS (
  SELECT conv_id, turn, owner AS i, arg_min(viseme, i) AS viseme, arg_min(start_ms, i) - 10 AS start,
         arg_max(end_ms, i) + 10 AS finish, count(*) AS n
  FROM owned WHERE owner IS NOT NULL AND (viseme IS NOT NULL OR phoneme = '{speech.LENGTH_MARK}')
  GROUP BY conv_id, turn, owner)
SELECT conv_id, turn, CAST(i AS INTEGER) AS i, viseme, CAST(greatest(start, 0) AS DOUBLE) AS vtime,
       CAST(greatest(finish - CASE WHEN n > 1 THEN greatest(start, 0) ELSE start END, 0) AS DOUBLE)
         AS vduration FROM grouped"""


def utterance_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each utterance, without making them."""
    turns = fx.table(spark, sf, "conversations").groupBy(*UTTERANCE)
    return turns.agg(F.sum(F.length("text") + 2).alias("_n"))


@query("viseme_timeline", VISEME_SQL)
def viseme_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return speech.viseme_timeline(
        phonemes(spark, sf), UTTERANCE, "i", "phoneme", "duration", sized=utterance_rows(spark, sf)
    )


@query("viseme_timeline_split_utterances", VISEME_SQL)
def viseme_timeline_split_utterances(spark: SparkSession, sf: str) -> DataFrame:
    return speech.viseme_timeline(
        phonemes(spark, sf), UTTERANCE, "i", "phoneme", "duration", limit=64
    )


@query(
    "word_timeline",
    rf"""WITH {PHONEMES}, places AS MATERIALIZED (
      SELECT conv_id, turn, list(start_ms ORDER BY i) AS begins FROM timed GROUP BY conv_id, turn),
    found AS MATERIALIZED (
      SELECT conv_id, turn, length(text) AS p, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS w
      FROM conversations),
    words AS (
      SELECT conv_id, turn, p, len(w) AS n, unnest(w) AS word,
             CAST(generate_subscripts(w, 1) AS INTEGER) - 1 AS k FROM found),
    spans AS (
      SELECT conv_id, turn, k, word, CAST(floor(k * (p / n)) AS BIGINT) AS a,
             CASE WHEN k + 1 = n THEN p ELSE CAST(floor((k + 1) * (p / n)) AS BIGINT) END AS b
      FROM words)
    SELECT s.conv_id, s.turn, k AS word_index, word,
           CAST(greatest(begins[a + 2] - 10, 0) AS DOUBLE) AS wtime,
           CAST(greatest(begins[b + 2] + 10 - (begins[a + 2] - 10), 0) AS DOUBLE) AS wduration
    FROM spans s JOIN places x ON x.conv_id = s.conv_id AND x.turn = s.turn""",
)
def word_timeline(spark: SparkSession, sf: str) -> DataFrame:
    turns = fx.table(spark, sf, "conversations").withColumn("phonemes", F.length("text"))
    spans = speech.word_boundaries(turns, UTTERANCE, "text", "phonemes")
    marked = speech.with_word_ends(phonemes(spark, sf), spans, UTTERANCE, "i", "duration")
    # A word has a letter and two ends, and what parts it from the next, so at most twice the rows.
    sized = utterance_rows(spark, sf).withColumn("_n", F.col("_n") * 2)
    timed = speech.cumulative_timeline(marked, UTTERANCE, speech.word_ends_first("i"), "duration", sized=sized)
    return speech.word_timeline(timed, None, UTTERANCE, "i")


# -- quantiles without a group in one place --------------------------------


@query("latency_stats_split_groups", LATENCY_STATS)
def latency_stats_split_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = sparse_latencies(spark, sf)
    stats = evaluation.latency_stats(rows, ["event_type"], "latency_ms", limit=16)
    return fx.rounded(stats, 6, *STATS)


@query(
    "tts_latency_summary_split",
    """SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50,
    round(quantile_cont(value, 0.95), 6) AS p95 FROM events""",
)
def tts_latency_summary_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("value")
    return fx.rounded(
        evaluation.tts_latency_summary(rows, [], "value", limit=16), 6, "mean", "p50", "p95"
    )
