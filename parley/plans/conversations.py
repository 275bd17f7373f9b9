"""Turns, context, topic segments, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.prompts import TOPIC_ANSWER, TOPIC_QUESTION
from parley.operators import controller, emotion
from parley.operators import conversation as ops
from parley.plans import fixtures as fx
from parley.plans import ordered
from parley.plans.registry import query

PAIRS_SQL = f"WITH {fx.PAIRS} SELECT conv_id, turn, user_text, assistant_text FROM pairs"


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "conversations")


@query("conversation_turn_pairs", PAIRS_SQL)
def conversation_turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return ops.turn_pairs(conversations(spark, sf))


@query("conversation_turn_pairs_split", PAIRS_SQL)
def conversation_turn_pairs_split(spark: SparkSession, sf: str) -> DataFrame:
    return ops.turn_pairs(conversations(spark, sf), limit=4)


CONTEXT = """contexts AS (
  SELECT conv_id, turn, role, text,
         coalesce(lag('### ' || role || ':' || chr(10) || text || chr(10), 2) OVER w, '') ||
         coalesce(lag('### ' || role || ':' || chr(10) || text || chr(10), 1) OVER w, '') AS extra
  FROM conversations WHERE role <> 'system'
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@query(
    "context_turns",
    f"WITH {CONTEXT} SELECT conv_id, turn, text, extra FROM contexts WHERE role = 'user'",
)
def context_turns(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops.context_turns(fx.messages(spark, sf))
    lines = F.transform(
        "extra_turns",
        lambda t: F.concat(F.lit("### "), t["actor"], F.lit(":\n"), t["message"], F.lit("\n")),
    )
    return rows.select("conv_id", "turn", "text", F.array_join(lines, "").alias("extra"))


# The tracker as a recursion over messages: for each the start of the shortest
# run of newest messages with 50 words, from sums of words, then the index.
SEGMENTS = f"""counted AS (
  SELECT conv_id, role, text, {fx.word_count_sql("text")} AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos
  FROM conversations WHERE role <> 'system'),
summed AS (
  SELECT conv_id, pos, sum(words) OVER (PARTITION BY conv_id ORDER BY pos) AS upto,
         sum(words) OVER (PARTITION BY conv_id ORDER BY pos) - words AS before
  FROM counted),
starts AS (
  SELECT a.conv_id, a.pos, max(b.pos) AS start
  FROM summed a LEFT JOIN summed b
    ON b.conv_id = a.conv_id AND b.pos <= a.pos AND a.upto - b.before >= 50
  GROUP BY a.conv_id, a.pos),
walked AS (
  SELECT conv_id, pos, start, coalesce(start >= 0, false) AS found,
         CASE WHEN start >= 0 THEN pos - start + 1 ELSE 0 END AS idx
  FROM starts WHERE pos = 0
  UNION ALL
  SELECT s.conv_id, s.pos, s.start, coalesce(s.start >= w.idx, false),
         CASE WHEN s.start >= w.idx THEN w.idx + s.pos - s.start + 1 ELSE w.idx END
  FROM walked w JOIN starts s ON s.conv_id = w.conv_id AND s.pos = w.pos + 1),
segments AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS segment,
         start AS start_pos, pos AS end_pos
  FROM walked WHERE found)"""
SEGMENTS_SQL = f"WITH RECURSIVE {SEGMENTS} SELECT conv_id, segment, start_pos, end_pos FROM segments"


@query("topic_segments", SEGMENTS_SQL)
def topic_segments(spark: SparkSession, sf: str) -> DataFrame:
    return ops.topic_segments(fx.messages(spark, sf))


@query("topic_segments_split", SEGMENTS_SQL)
def topic_segments_split(spark: SparkSession, sf: str) -> DataFrame:
    return ops.topic_segments(fx.messages(spark, sf), limit=2)


@query(
    "render_conversation",
    f"""WITH RECURSIVE {SEGMENTS}, rendered AS (
      SELECT s.conv_id, s.segment,
             string_agg(upper(c.role) || ': ' || c.text, chr(10) ORDER BY c.pos) AS conversation
      FROM segments s JOIN counted c ON c.conv_id = s.conv_id AND c.pos BETWEEN start_pos AND end_pos
      GROUP BY ALL)
    SELECT *, {fx.quoted(TOPIC_QUESTION)} || conversation || {fx.quoted(TOPIC_ANSWER)} AS prompt
    FROM rendered""",
)
def render_conversation(spark: SparkSession, sf: str) -> DataFrame:
    messages = fx.messages(spark, sf)
    return ops.render_conversation(messages, ops.topic_segments(messages))


# A conversation is the session of the user with its number; its turns are three
# days apart.
TURN_TIME = "TIMESTAMP '2024-01-01' + to_hours(conv_id % 24) + to_days(CAST(3 * turn AS INTEGER))"
PROMPTED = f"""{fx.DIALOGUES}, {CONTEXT}, modes AS ({ordered.MODE_SQL}), emotions AS ({ordered.TOP_SQL}),
    timed AS (SELECT *, {TURN_TIME} AS at FROM contexts WHERE role = 'user'),
    paces AS (SELECT user_id, ts, mode FROM events JOIN modes USING (user_id, event_id)),
    moods AS (SELECT user_id, ts, emotion FROM events JOIN emotions USING (user_id, event_id)),
    shown AS (
      SELECT t.conv_id, t.turn, t.text, t.extra, s.situation, p.mode, m.emotion
      FROM timed t ASOF LEFT JOIN paces p ON p.user_id = t.conv_id AND t.at >= p.ts
      ASOF LEFT JOIN moods m ON m.user_id = t.conv_id AND t.at >= m.ts
      LEFT JOIN situations s ON s.conv_id = t.conv_id)"""
PROMPT = fx.prompt_sql("coalesce(situation, '')", "text", "emotion", "coalesce(mode, 'medium')", extra="extra")


def prompted(spark: SparkSession, sf: str, **how: int) -> DataFrame:
    contexts = ops.context_turns(fx.messages(spark, sf))
    hours = F.make_dt_interval(3 * F.col("turn").cast("int"), (F.col("conv_id") % 24).cast("int"))
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    owner = F.col("user_id").alias("conv_id")
    paces = controller.response_mode(fx.turns(spark, sf), ["user_id"], fx.TURN_ORDER, "latency_ms")
    moods = ordered.scores(spark, sf)
    return ops.live_prompt(
        contexts.withColumn("ts", start + hours),
        fx.situations(spark, sf),
        paces.select(owner, *fx.TURN_ORDER, "mode"),
        moods.select(owner, *fx.TURN_ORDER, emotion.dominant_emotion(F.col("scores")).alias("emotion")),
        at="ts",
        tie="event_id",
        **how,
    )


LIVE_SQL = f"WITH {PROMPTED} SELECT conv_id, turn, {PROMPT} AS prompt FROM shown"


@query("live_prompt", LIVE_SQL)
def live_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return prompted(spark, sf)


@query("live_prompt_split", LIVE_SQL)
def live_prompt_split(spark: SparkSession, sf: str) -> DataFrame:
    return prompted(spark, sf, limit=4)
