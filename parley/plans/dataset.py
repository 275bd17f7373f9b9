"""Dataset preparation and file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.labels import BASIC_EMOTION, label_lookup_join
from parley.functions.text import word_count
from parley.operators import dataset as ops
from parley.plans import fixtures as fx
from parley.plans.registry import query
from parley.session import new_folder
from parley.sources import files, sinks


@query(
    "prepare_dialogues",
    f"""WITH {fx.PREPARED}
    SELECT dialogue_id, "Situation", emotion, empathetic_dialogues, labels, label_word_len,
           answer_type, split, text FROM prepared""",
)
def prepare_dialogues(spark: SparkSession, sf: str) -> DataFrame:
    return ops.prepare_dialogues(fx.dialogues(spark, sf), "dialogue_id")


@query(
    "scan_dialogues",
    f"""WITH {fx.DIALOGUES}
    SELECT nullif("Situation", '') AS "Situation", emotion, empathetic_dialogues, labels
    FROM dialogues""",
)
def scan_dialogues(spark: SparkSession, sf: str) -> DataFrame:
    """Written as CSV and read back; an empty field reads as null."""
    path = new_folder(spark, "dialogues")
    rows = fx.dialogues(spark, sf).drop("dialogue_id")
    rows.write.csv(
        path,
        header=True,
        escape='"',
        quoteAll=True,
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    return files.scan_dialogues(spark, path)


def write_in_order(df: DataFrame, key: str, path: str) -> None:
    """JSON lines whose file order is the order of ``key``."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.json(path)


@query(
    "scan_jsonl",
    "SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 2000",
)
def scan_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "samples")
    write_in_order(fx.table(spark, sf, "events"), "event_id", path)
    return files.scan_jsonl(spark, path, "event_id long, event_type string, value double", 2000)


@query("single_text_column", "SELECT text FROM documents ORDER BY doc_id LIMIT 101")
def single_text_column(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "texts")
    write_in_order(fx.table(spark, sf, "documents"), "doc_id", path)
    return files.single_text_column(spark, path, "text", 100)


@query(
    "scan_transcripts",
    r"""SELECT 'audio/' || doc_id || '.flac' AS audio,
       nullif(regexp_replace(replace(replace(text, chr(13), ' '), chr(10), ' '),
                             '[\t\f ]+$', ''), '') AS transcript
    FROM documents""",
)
def scan_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "transcripts")
    line = F.concat_ws(" ", "doc_id", F.regexp_replace("text", r"[\r\n]", " "))
    fx.table(spark, sf, "documents").select(line.alias("value")).write.text(path)
    return files.scan_transcripts(spark, path, "audio")


@query(
    "scan_emotion_pairs",
    """SELECT CASE WHEN role = 'system' THEN 'neutral' ELSE role END AS emotion, text
    FROM conversations""",
)
def scan_emotion_pairs(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "pairs")
    role = F.when(F.col("role") == "system", "").otherwise(F.col("role"))
    line = F.to_json(F.array(F.array(role, F.col("text"))))
    fx.table(spark, sf, "conversations").select(line).write.text(path)
    return files.scan_emotion_pairs(spark, path, whole=False)


@query(
    "parse_emotion_lines",
    f"""SELECT conv_id, turn,
       CASE WHEN turn % 3 = 0 THEN 'neutral' WHEN turn % 3 = 1 THEN role
            WHEN text LIKE '%:%' THEN {fx.strip_sql("split_part(text, ':', 1)")}
            ELSE 'neutral' END AS emotion,
       CASE WHEN turn % 3 < 2 OR text NOT LIKE '%:%' THEN {fx.strip_sql("text")}
            ELSE {fx.strip_sql("substr(text, strpos(text, ':') + 1)")} END AS text
    FROM conversations""",
)
def parse_emotion_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of three kinds: no emotion before the colon, one, and plain text."""
    named = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" : "), "text"))
        .when(F.col("turn") % 3 == 1, F.concat("role", F.lit(": "), "text"))
        .otherwise(F.col("text"))
    )
    lines = fx.table(spark, sf, "conversations").select("conv_id", "turn", named.alias("line"))
    return files.parse_emotion_lines(lines, "line").drop("line")


@query(
    "scan_media_files",
    "SELECT DISTINCT source, true AS has_bytes FROM documents",
)
def scan_media_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as files in a folder per source, listed by suffix."""
    path = new_folder(spark, "media")
    documents = fx.table(spark, sf, "documents")
    documents.select("doc_id", "text", F.col("source").alias("folder")).write.partitionBy(
        "folder"
    ).json(path)
    listed = files.scan_media_files(spark, path, ".json")
    source = F.regexp_extract("path", "/folder=([^/]+)/", 1)
    return listed.groupBy(source.alias("source")).agg((F.min("length") > 0).alias("has_bytes"))


@query(
    "sink_jsonl_splits",
    f"""WITH {fx.PREPARED}
    SELECT split, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS characters
    FROM prepared GROUP BY split""",
)
def sink_jsonl_splits(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "splits")
    sinks.sink_jsonl_splits(prepare_dialogues(spark, sf), path)
    written = spark.read.schema("text string, split string").json(path)
    return written.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("characters")
    )


@query("project_text", f"WITH {fx.PREPARED} SELECT text FROM prepared")
def project_text(spark: SparkSession, sf: str) -> DataFrame:
    return ops.project_text(prepare_dialogues(spark, sf))


@query("training_text", f"WITH {fx.PREPARED} SELECT dialogue_id, split, text FROM prepared")
def training_text(spark: SparkSession, sf: str) -> DataFrame:
    return prepare_dialogues(spark, sf).select("dialogue_id", "split", "text")


@query("limit_samples", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 1000")
def limit_samples(spark: SparkSession, sf: str) -> DataFrame:
    return ops.limit_samples(fx.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", 1000)


@query(
    "answer_length_quantiles",
    f"WITH {fx.PREPARED} SELECT round(q1, 6) AS q1, round(q2, 6) AS q2 FROM bounds",
)
def answer_length_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    lengths = measured(spark, sf)
    return fx.rounded(ops.answer_length_quantiles(lengths, "label_word_len"), 6, "q1", "q2")


def measured(spark: SparkSession, sf: str) -> DataFrame:
    return fx.dialogues(spark, sf).withColumn("label_word_len", word_count(F.col("labels")))


@query(
    "length_histogram",
    f"""WITH {fx.PREPARED}, ends AS (
      SELECT CAST(min(label_word_len) AS DOUBLE) AS lo, CAST(max(label_word_len) AS DOUBLE) AS hi
      FROM measured),
    filled AS (
      SELECT least(CAST(floor((label_word_len - lo) * 50 / (hi - lo)) AS INTEGER) + 1, 50) AS bin,
             count(*) AS n
      FROM measured, ends GROUP BY 1),
    grid AS (SELECT CAST(unnest(range(1, 51)) AS INTEGER) AS bin)
    SELECT bin, round(lo + (bin - 1) * (hi - lo) / 50, 6) AS lower,
           round(lo + bin * (hi - lo) / 50, 6) AS upper, coalesce(n, 0) AS count
    FROM grid CROSS JOIN ends LEFT JOIN filled USING (bin)""",
)
def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    bins = ops.length_histogram(measured(spark, sf), "label_word_len")
    return fx.rounded(bins, 6, "lower", "upper")


@query(
    "answer_type",
    f"WITH {fx.PREPARED} SELECT dialogue_id, label_word_len, answer_type FROM formatted",
)
def answer_type(spark: SparkSession, sf: str) -> DataFrame:
    binned = ops.with_answer_type(measured(spark, sf), "label_word_len")
    return binned.select("dialogue_id", "label_word_len", "answer_type")


@query(
    "split_80_10_10",
    """SELECT doc_id, CASE WHEN b < 0.8 THEN 'train' WHEN b < 0.9 THEN 'dev' ELSE 'test' END AS split
    FROM (SELECT doc_id, CAST(('0x' || substr(md5('42:' || doc_id), 1, 8)) AS BIGINT)
                         / 4294967296.0 AS b FROM documents)""",
)
def split_80_10_10(spark: SparkSession, sf: str) -> DataFrame:
    return ops.with_split(fx.table(spark, sf, "documents").select("doc_id"), "doc_id")


EVENT_EMOTIONS = {"click": "joy", "view": "neutral", "error": "anger"}


@query(
    "label_lookup_join",
    f"SELECT event_id, {fx.case_sql('event_type', EVENT_EMOTIONS)} AS emotion FROM events",
)
def event_label_lookup(spark: SparkSession, sf: str) -> DataFrame:
    events = fx.table(spark, sf, "events")
    joined = label_lookup_join(events, "event_type", "emotion", EVENT_EMOTIONS)
    return joined.select("event_id", "emotion")


@query(
    "basic_emotion",
    f"WITH {fx.DIALOGUES} SELECT dialogue_id, {fx.case_sql('emotion', BASIC_EMOTION)} AS emotion FROM dialogues",
)
def dialogue_label_lookup(spark: SparkSession, sf: str) -> DataFrame:
    fine = fx.dialogues(spark, sf).withColumnRenamed("emotion", "fine")
    return label_lookup_join(fine, "fine", "emotion").select("dialogue_id", "emotion")


@query(
    "eval_prompt",
    f"""WITH {fx.PREPARED}
    SELECT dialogue_id, labels AS ref, emotion,
           {fx.prompt_sql('"Situation"', "empathetic_dialogues", "emotion")} AS prompt
    FROM prepared""",
)
def eval_prompt(spark: SparkSession, sf: str) -> DataFrame:
    samples = ops.eval_samples(prepare_dialogues(spark, sf))
    return samples.select("dialogue_id", "ref", "emotion", "prompt")
