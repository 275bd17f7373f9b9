"""The test tables in the roles the operators expect, in Spark and in SQL.

Sessions are the users of ``events`` (a turn's latency is ``value * 40`` ms);
dialogues are the user and assistant turns of ``conversations``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.labels import BASIC_EMOTION
from parley.functions.prompts import END_OF_SEQUENCE, INSTRUCTION
from parley.operators.conversation import turn_pairs
from parley.session import spread

# 2024-01-01, so that times in seconds keep their microseconds.
ORIGIN_US = 1_704_067_200_000_000
FINE_LABELS = [*BASIC_EMOTION, "bored"]
TURN_ORDER = ["ts", "event_id"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of texts, for work that is slow per text."""
    return spread(table(spark, sf, name))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# -- events ----------------------------------------------------------------


def turns(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return events.select("user_id", "ts", "event_id", (F.col("value") * 40).alias("latency_ms"))


TURNS = """turns AS (
  SELECT user_id, ts, event_id, value * 40 AS latency_ms, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events)"""


def stages(spark: SparkSession, sf: str) -> DataFrame:
    """One sample per user and day; a stage per event."""
    events = table(spark, sf, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        "user_id",
        F.to_date("ts").cast("string").alias("day"),
        "ts",
        "event_id",
        F.col("event_type").alias("component"),
        ((micros - ORIGIN_US) / 1e6).alias("time"),
    )


STAGES = f"""stages AS (
  SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, ts, event_id, event_type AS component,
         (epoch_us(ts) - {ORIGIN_US}) / 1e6 AS time
  FROM events)"""

DELTAS = f"""{STAGES}, steps AS (
  SELECT user_id, day, component, time,
         lead(component) OVER w AS next_component, lead(time) OVER w AS next_time
  FROM stages WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id)),
deltas AS (
  SELECT user_id, day, component || '->' || next_component AS component,
         (next_time - time) * 1000 AS latency_ms
  FROM steps WHERE next_component IS NOT NULL
  UNION ALL
  SELECT user_id, day, 'total',
         (arg_max(time, (ts, event_id)) - arg_min(time, (ts, event_id))) * 1000
  FROM stages GROUP BY user_id, day)"""


# -- conversations ---------------------------------------------------------


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """What is said; the system text is the situation, not a message."""
    return table(spark, sf, "conversations").filter("role <> 'system'")


def situations(spark: SparkSession, sf: str) -> DataFrame:
    system = table(spark, sf, "conversations").filter("role = 'system'")
    return system.groupBy("conv_id").agg(F.min_by("text", "turn").alias("situation"))


def fine_label() -> Column:
    labels = F.array(*[F.lit(x) for x in FINE_LABELS])
    place = (F.col("conv_id") * 7 + F.col("turn")) % len(FINE_LABELS)
    return F.element_at(labels, (place + 1).cast("int"))


def dialogues(spark: SparkSession, sf: str) -> DataFrame:
    pairs = turn_pairs(table(spark, sf, "conversations"))
    return pairs.join(situations(spark, sf), "conv_id", "left").select(
        F.concat_ws("-", "conv_id", "turn").alias("dialogue_id"),
        F.coalesce("situation", F.lit("")).alias("Situation"),
        fine_label().alias("emotion"),
        F.concat(F.lit("Customer : "), "user_text", F.lit("\nAgent:  ")).alias(
            "empathetic_dialogues"
        ),
        F.col("assistant_text").alias("labels"),
    )


SPACES = r"[\t\n\f\r ]"


def word_count_sql(text: str) -> str:
    return rf"CAST(len(regexp_extract_all({text}, '[^\t\n\f\r ]+')) AS INTEGER)"


def strip_sql(text: str) -> str:
    return rf"regexp_replace({text}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def normalize_sql(text: str) -> str:
    kept = rf"regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}_\t\n\f\r ]', '', 'g')"
    return f"trim(regexp_replace({kept}, '{SPACES}+', ' ', 'g'))"


def prompt_sql(
    situation: str,
    user: str,
    emotion: str = "''",
    answer_type: str = "'long'",
    agent: str = "''",
    extra: str = "''",
) -> str:
    shown = f"CASE WHEN coalesce({emotion}, '') = '' THEN '' ELSE '### Emotion:\n' || {emotion} || '\n' END"
    return (
        f"{quoted(INSTRUCTION)} || '### Situation:\n' || {situation} || '\n' || {shown} || {extra}"
        f" || '### User:\n' || {user} || '\n### Answer Type:\n' || {answer_type}"
        f" || '\n### You:\n' || {agent}"
    )


def case_sql(value: str, mapping: dict[str, str], other: str = "''") -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {value} {cases} ELSE {other} END"


PAIRS = """next_turns AS (
  SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (
  SELECT conv_id, turn, text AS user_text, next_text AS assistant_text
  FROM next_turns WHERE role = 'user' AND next_role = 'assistant')"""

_LABELS = "[" + ", ".join(f"'{x}'" for x in FINE_LABELS) + "]"
DIALOGUES = f"""{PAIRS}, situations AS (
  SELECT conv_id, arg_min(text, turn) AS situation
  FROM conversations WHERE role = 'system' GROUP BY conv_id),
dialogues AS (
  SELECT conv_id || '-' || turn AS dialogue_id, coalesce(situation, '') AS "Situation",
         {_LABELS}[(conv_id * 7 + turn) % {len(FINE_LABELS)} + 1] AS emotion,
         'Customer : ' || user_text || '\nAgent:  ' AS empathetic_dialogues,
         assistant_text AS labels
  FROM pairs LEFT JOIN situations USING (conv_id))"""

CLEAN = strip_sql(
    rf"regexp_replace(regexp_replace(empathetic_dialogues, '\bCustomer{SPACES}*:{SPACES}*', '', 'g'),"
    rf" '\bAgent{SPACES}*:{SPACES}*', '', 'g')"
)
BASIC = case_sql("emotion", BASIC_EMOTION)
PREPARED = f"""{DIALOGUES}, measured AS (
  SELECT *, {word_count_sql("labels")} AS label_word_len FROM dialogues),
bounds AS (
  SELECT quantile_cont(label_word_len, 0.33) AS q1, quantile_cont(label_word_len, 0.66) AS q2
  FROM measured),
formatted AS (
  SELECT dialogue_id, "Situation", {BASIC} AS emotion, {CLEAN} AS empathetic_dialogues, labels,
         label_word_len,
         CASE WHEN label_word_len <= q1 THEN 'short' WHEN label_word_len <= q2 THEN 'medium'
              ELSE 'long' END AS answer_type,
         CAST(('0x' || substr(md5('42:' || dialogue_id), 1, 8)) AS BIGINT) / 4294967296.0 AS bucket
  FROM measured, bounds),
prepared AS (
  SELECT * EXCLUDE (bucket),
         CASE WHEN bucket < 0.8 THEN 'train' WHEN bucket < 0.9 THEN 'dev' ELSE 'test' END AS split,
         {prompt_sql('"Situation"', "empathetic_dialogues", "emotion", "answer_type", "labels")}
           || '{END_OF_SEQUENCE}' AS text
  FROM formatted)"""
