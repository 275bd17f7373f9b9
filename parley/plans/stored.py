"""Users, characters, sessions and what is stored about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import sessions as ops
from parley.plans import fixtures as fx
from parley.plans.ordered import SUMMARY_SQL, summaries
from parley.plans.registry import query
from parley.plans.texts import mask_sql
from parley.session import new_folder
from parley.sources import sinks

CHARACTER = ["o_orderkey", "o_custkey", "o_totalprice"]


def characters(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "orders").select(*CHARACTER)


def users(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "customer").select("c_custkey", "c_name")


@query(
    "owned_characters",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey",
)
def owned_characters(spark: SparkSession, sf: str) -> DataFrame:
    return ops.owned_characters(characters(spark, sf), "o_custkey", 7, "o_orderkey")


@query(
    "owned_character",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 42) AND o_orderkey = 42""",
)
def owned_character(spark: SparkSession, sf: str) -> DataFrame:
    rows = characters(spark, sf)
    owner = rows.filter("o_orderkey = 42").select("o_custkey").scalar()
    return ops.owned_characters(rows, "o_custkey", owner, "o_orderkey", 42)


@query("user_by_name", "SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000007'")
def user_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return ops.user_by_name(users(spark, sf), "c_name", "Customer#000000007")


@query(
    "all_sessions",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders",
)
def all_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return ops.all_sessions(fx.table(spark, sf, "orders"))


@query(
    "drop_empty_responses",
    """SELECT conv_id, turn, text AS transcript, text AS response FROM conversations
    WHERE role <> 'system' AND turn % 3 <> 0""",
)
def drop_empty_responses(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("role") != "system", F.col("text")).alias("transcript"),
        F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")).alias("response"),
    )
    return ops.drop_empty_responses(rows, "transcript", "response")


USERNAME = """CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN '  '
  WHEN c_custkey % 11 = 0 THEN 'ab' ELSE c_name END"""


def registrations(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return fx.table(spark, sf, "customer").select(
        "c_custkey",
        F.when(key % 7 == 0, None)
        .when(key % 5 == 0, "  ")
        .when(key % 11 == 0, "ab")
        .otherwise(F.col("c_name"))
        .alias("username"),
        F.when(key % 13 == 0, "").otherwise(F.col("c_mktsegment")).alias("name"),
        F.when(key % 17 == 0, " ").otherwise("Be kind.").alias("prompt"),
        (key % 8).cast("int").alias("q1"),
    )


@query(
    "validate_rows",
    f"""SELECT c_custkey, CASE WHEN trim(coalesce(username, '')) = '' THEN 'username empty' END
      AS reject_reason FROM (SELECT c_custkey, {USERNAME} AS username FROM customer)""",
)
def validate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ops.validate_rows(registrations(spark, sf)).select("c_custkey", "reject_reason")


@query(
    "validate_rows_form",
    f"""SELECT c_custkey, CASE WHEN trim(coalesce(username, '')) = '' THEN 'username empty'
      WHEN length(username) < 3 THEN 'username short' WHEN c_custkey % 13 = 0 THEN 'name empty'
      WHEN c_custkey % 17 = 0 THEN 'prompt empty'
      WHEN c_custkey % 8 NOT BETWEEN 1 AND 5 THEN 'q1 out of range' END AS reject_reason
    FROM (SELECT c_custkey, {USERNAME} AS username FROM customer)""",
)
def validate_rows_form(spark: SparkSession, sf: str) -> DataFrame:
    checked = ops.validate_rows(
        registrations(spark, sf), rules="form", prompt="prompt", ratings=["q1"]
    )
    return checked.select("c_custkey", "reject_reason")


@query(
    "fill_agent_defaults",
    """SELECT o_orderkey, voice, face, prompt, voice = 'af_bella' AND face = 'julia' AS valid FROM (
      SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'zoe' ELSE 'af_bella' END AS voice,
             CASE WHEN o_orderkey % 9 = 0 THEN 'max' ELSE 'julia' END AS face,
             CASE WHEN o_orderkey % 4 < 2 THEN '' ELSE o_orderpriority END AS prompt FROM orders)""",
)
def fill_agent_defaults(spark: SparkSession, sf: str) -> DataFrame:
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    agents = fx.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(status == "P", "zoe").when(status == "O", "af_bella").alias("voice"),
        F.when(key % 9 == 0, "max").when(key % 2 == 0, "julia").alias("face"),
        F.when(key % 4 == 0, "").when(key % 4 != 1, F.col("o_orderpriority")).alias("prompt"),
    )
    return ops.fill_agent_defaults(agents)


@query(
    "character_owner_join",
    """SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_name
    FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def character_owner_join(spark: SparkSession, sf: str) -> DataFrame:
    return ops.character_owner_join(characters(spark, sf), users(spark, sf), "o_custkey", "c_custkey")


@query(
    "character_owner_outer",
    """SELECT c_custkey, c_name, o_orderkey, o_custkey, o_totalprice
    FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey""",
)
def character_owner_outer(spark: SparkSession, sf: str) -> DataFrame:
    open_ones = fx.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(*CHARACTER)
    return ops.character_owner_join(
        open_ones, users(spark, sf), "o_custkey", "c_custkey", keep_users=True
    )


REQUESTS = """SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey,
  o_orderkey FROM orders"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    return fx.table(spark, sf, "orders").select(asked.alias("o_custkey"), "o_orderkey")


@query(
    "ownership_semi_join",
    f"SELECT * FROM ({REQUESTS}) q WHERE EXISTS (SELECT 1 FROM orders o"
    " WHERE o.o_custkey = q.o_custkey AND o.o_orderkey = q.o_orderkey)",
)
def ownership_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    return ops.ownership_semi_join(
        requests(spark, sf), characters(spark, sf), "o_custkey", "o_orderkey"
    )


@query(
    "ownership_anti_join",
    f"SELECT * FROM ({REQUESTS}) q WHERE NOT EXISTS (SELECT 1 FROM orders o"
    " WHERE o.o_custkey = q.o_custkey AND o.o_orderkey = q.o_orderkey)",
)
def ownership_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return ops.ownership_semi_join(
        requests(spark, sf), characters(spark, sf), "o_custkey", "o_orderkey", denied=True
    )


# -- feedback --------------------------------------------------------------

FEEDBACK = """feedback AS (
  SELECT (event_id * 7) % 20000 AS session_id, CAST(event_id % 5 + 1 AS INTEGER) AS q1,
         CAST(event_id % 4 + 1 AS INTEGER) AS q2, CAST(event_id % 3 + 1 AS INTEGER) AS q3,
         CAST(event_id % 2 + 1 AS INTEGER) AS q4, nullif(event_type, 'error') AS q5, event_id
  FROM events)"""


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    event = F.col("event_id")
    ratings = [(event % (6 - i) + 1).cast("int").alias(f"q{i}") for i in range(1, 5)]
    return fx.table(spark, sf, "events").select(
        (event * 7 % 20000).alias("session_id"),
        *ratings,
        F.nullif(F.col("event_type"), F.lit("error")).alias("q5"),
        "event_id",
    )


def rated_sessions(spark: SparkSession, sf: str) -> DataFrame:
    ratings = [F.lit(0).alias(f"q{i}_rating") for i in range(1, 5)]
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("session_id"), *ratings, F.lit("").alias("q5_answer")
    )


@query(
    "feedback_upsert",
    f"""WITH {FEEDBACK}, latest AS (
      SELECT session_id, {", ".join(f"arg_max(q{i}, event_id) AS q{i}" for i in range(1, 5))},
             arg_max(coalesce(q5, ''), event_id) AS q5 FROM feedback GROUP BY session_id)
    SELECT o_orderkey AS session_id,
           {", ".join(f"coalesce(q{i}, 0) AS q{i}_rating" for i in range(1, 5))},
           coalesce(q5, '') AS q5_answer
    FROM orders LEFT JOIN latest ON session_id = o_orderkey""",
)
def feedback_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return ops.feedback_upsert(
        rated_sessions(spark, sf), feedback(spark, sf), "session_id", "event_id"
    )


@query(
    "feedback_rejected",
    f"""WITH {FEEDBACK} SELECT session_id, event_id FROM feedback
    WHERE session_id NOT IN (SELECT o_orderkey FROM orders)""",
)
def feedback_rejected(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops.feedback_upsert(
        rated_sessions(spark, sf), feedback(spark, sf), "session_id", "event_id", rejected=True
    )
    return rows.select("session_id", "event_id")


# -- names -----------------------------------------------------------------

NAMES = "SELECT c_custkey, c_mktsegment || c_nationkey AS username FROM customer"


def named_users(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "customer").select(
        "c_custkey", F.concat("c_mktsegment", "c_nationkey").alias("username")
    )


@query(
    "unique_usernames",
    f"SELECT min(c_custkey) AS c_custkey, username FROM ({NAMES}) GROUP BY username",
)
def unique_usernames(spark: SparkSession, sf: str) -> DataFrame:
    return ops.unique_usernames(named_users(spark, sf), "username", "c_custkey")


@query(
    "repeated_usernames",
    f"""SELECT c_custkey, username FROM (
      SELECT *, row_number() OVER (PARTITION BY username ORDER BY c_custkey) AS n FROM ({NAMES}))
    WHERE n > 1""",
)
def repeated_usernames(spark: SparkSession, sf: str) -> DataFrame:
    return ops.unique_usernames(named_users(spark, sf), "username", "c_custkey", rejected=True)


# -- interrupts ------------------------------------------------------------

INTERRUPTS = """SELECT user_id, event_id, ts AS start_ts, ts + INTERVAL 8 HOUR AS end_ts
FROM events t WHERE event_type = 'click' AND {test} (
  SELECT 1 FROM events i WHERE i.event_type = 'error' AND i.user_id = t.user_id
  AND i.ts BETWEEN t.ts AND t.ts + INTERVAL 8 HOUR)"""


def interrupts(spark: SparkSession, sf: str, **how: bool | int) -> DataFrame:
    events = fx.table(spark, sf, "events")
    turns = events.filter("event_type = 'click'").select(
        "user_id",
        "event_id",
        F.col("ts").alias("start_ts"),
        (F.col("ts") + F.expr("INTERVAL 8 HOURS")).alias("end_ts"),
    )
    cuts = events.filter("event_type = 'error'").select("user_id", "ts")
    return ops.interrupted_turns(turns, cuts, ["user_id"], "start_ts", "end_ts", "ts", **how)


@query("interrupted_turns", INTERRUPTS.format(test="NOT EXISTS"))
def interrupted_turns(spark: SparkSession, sf: str) -> DataFrame:
    return interrupts(spark, sf)


@query("interrupted_turns_dropped", INTERRUPTS.format(test="EXISTS"))
def interrupted_turns_dropped(spark: SparkSession, sf: str) -> DataFrame:
    return interrupts(spark, sf, interrupted=True)


@query("interrupted_turns_split_sessions", INTERRUPTS.format(test="NOT EXISTS"))
def interrupted_turns_split_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return interrupts(spark, sf, limit=8)


# -- stored sessions -------------------------------------------------------


@query(
    "sink_session_summary",
    f"""SELECT *, 0 AS q1_rating, 0 AS q2_rating, 0 AS q3_rating, 0 AS q4_rating, '' AS q5_answer
    FROM ({SUMMARY_SQL})""",
)
def sink_session_summary(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "sessions")
    sinks.sink_session_summary(summaries(spark, sf), path, "user_id")
    return spark.read.parquet(path)


@query(
    "sink_transcripts",
    f"""WITH masked AS (
      SELECT conv_id, string_agg(role || ': ' || {mask_sql("text")}, chr(10) ORDER BY turn) AS transcript,
             CAST(count(*) AS INTEGER) AS messages
      FROM conversations GROUP BY conv_id)
    SELECT o_orderkey AS conv_id, transcript, messages
    FROM orders LEFT JOIN masked ON conv_id = o_orderkey""",
)
def sink_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "transcripts")
    stored = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("conv_id"))
    messages = fx.texts(spark, sf, "conversations")
    sinks.sink_transcripts(stored, messages, path, "conv_id", "turn", "role", "text")
    lines = F.transform(
        "transcripts", lambda m: F.concat(m["actor"], F.lit(": "), m["message"])
    )
    return sinks.read_transcripts(spark, path, "conv_id").select(
        "conv_id",
        F.array_join(lines, "\n").alias("transcript"),
        F.when(F.col("transcripts").isNotNull(), F.size("transcripts")).alias("messages"),
    )
