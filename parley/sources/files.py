"""Readers: dialogue CSV, JSON lines, transcripts, pairs, media, messages."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parley.functions.text import strip
from parley.sources.records import split_csv

DIALOGUE = "Situation string, emotion string, empathetic_dialogues string, labels string"

# Message types.
SPEAK = "AVATAR_SPEAK"
TRANSCRIPT = "SPEECH_TRANSCRIPT"
FEEDBACK = "SESSION_FEEDBACK"
INITIALIZE = "AVATAR_INITIALIZE"
INTERRUPT = "AVATAR_INTERRUPT"
OFFER = "SDP_OFFER"
ANSWER = "SDP_ANSWER"


def scan_dialogues(
    spark: SparkSession, path: str, schema: str = DIALOGUE, line_breaks: bool = True
) -> DataFrame:
    """Dialogue CSV with a header: the columns of ``schema`` by name, then any others as text.

    With ``line_breaks`` quoted fields may hold them. Large files are split either
    way; without, no borders of records have to be found.
    """
    rows = split_csv(spark, path) if line_breaks else spark.read.csv(path, header=True, escape='"')
    wanted = StructType.fromDDL(schema)
    others = [F.col(f"`{c}`") for c in rows.columns if c not in wanted.names]
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in wanted], *others)


def first_rows(read: Callable[[str | list[str]], DataFrame], path: str, n: int) -> DataFrame:
    """The first ``n`` rows of the files at ``path``, in the order of their names.

    Rows are counted in one file, then in two more, four more, until there are enough;
    later files are not opened. Of the file in which the n-th row lies, splits before it
    are taken whole and only the last is ordered.
    """
    df = read(path)
    file, split = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    # A read without columns counts blank lines, which are no rows.
    counted = [F.count(F.lit(1)).alias("n"), F.max(F.hash(*[F.col(f"`{c}`") for c in df.columns]))]
    # ``file:///x`` in the list is ``file:/x`` in the metadata.
    names = sorted(x.replace(":///", ":/", 1) for x in df.inputFiles())
    before, ahead = 0, 1
    for i in range(len(names) + 1):
        if i == len(names):
            return df
        if i == ahead - 1:
            now = read([_literal(x) for x in names[i : i + ahead]])
            rows_of = {r.file: r.n for r in now.groupBy(file.alias("file")).agg(*counted).collect()}
            ahead *= 2
        rows = rows_of.get(names[i], 0)
        if before + rows >= n:
            break
        before += rows
    last = read(_literal(names[i]))
    splits = last.groupBy(split.alias("split")).agg(*counted).collect()
    for r in sorted(splits):
        if before + r.n >= n:
            break
        before += r.n
    ends = last.where(split == r.split).withColumn("_row", F.monotonically_increasing_id())
    out = ends.orderBy("_row").limit(n - before).drop("_row")
    if r.split:
        out = last.where(split < r.split).unionByName(out)
    return read([_literal(x) for x in names[:i]]).unionByName(out) if i else out


def _literal(uri: str) -> str:
    """A listed file as a path to read: not encoded, and no pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def scan_jsonl(
    spark: SparkSession, path: str, schema: str, max_samples: int | None = None
) -> DataFrame:
    """JSON lines; with ``max_samples`` the first so many in file order."""
    read = spark.read.schema(schema).json
    return first_rows(read, path, max_samples) if max_samples else read(path)


def single_text_column(
    spark: SparkSession,
    path: str,
    column: str,
    max_samples: int = 100,
    one_more: bool = True,
) -> DataFrame:
    """One column of a JSON lines file.

    ``one_more`` keeps the established behaviour of giving ``max_samples + 1``
    rows.
    """
    count = max_samples + 1 if one_more else max_samples
    return scan_jsonl(spark, path, f"`{column}` string", count)


def scan_transcripts(spark: SparkSession, path: str, audio_folder: str) -> DataFrame:
    """Lines ``id text``: audio path and text, split at the first space."""
    line = strip(F.col("value"))
    parts = F.split(line, " ", 2)
    lines = spark.read.text(path, lineSep="\n")
    return lines.filter(line != "").select(
        F.concat(F.lit(audio_folder.rstrip("/") + "/"), parts[0], F.lit(".flac")).alias("audio"),
        F.get(parts, F.lit(1)).alias("transcript"),
    )


def _emotion_or(emotion: Column, missing: str | None) -> Column:
    return F.coalesce(F.nullif(emotion, F.lit("")), F.lit(missing).cast("string"))


def scan_emotion_pairs(
    spark: SparkSession, path: str, missing: str | None = "neutral", whole: bool = True
) -> DataFrame:
    """JSON ``[[emotion, text], ...]``: an array per file, or per line if not ``whole``.

    A file (or line) that is no such array fails the read.
    """
    files = spark.read.text(path, wholetext=whole).where(strip(F.col("value")) != "")
    pairs = F.from_json("value", "array<array<string>>", {"mode": "FAILFAST"})
    return files.select(F.explode(pairs).alias("_p")).select(
        _emotion_or(F.get("_p", F.lit(0)), missing).alias("emotion"),
        F.get("_p", F.lit(1)).alias("text"),
    )


def parse_emotion_lines(df: DataFrame, line: str, missing: str | None = "neutral") -> DataFrame:
    """``emotion: text`` or plain text lines, split at the first colon."""
    parts = F.split(F.col(line), ":", 2)
    named = F.size(parts) == 2
    emotion = _emotion_or(F.when(named, strip(parts[0])), missing)
    return df.withColumns(
        {"emotion": emotion, "text": strip(F.when(named, F.get(parts, F.lit(1))).otherwise(parts[0]))}
    )


def scan_media_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Path and size of the files with a suffix; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select("path", "length")


def messages_of_type(
    df: DataFrame, message: str, kind: str, data: str, keep: list[str]
) -> DataFrame:
    """The ``data`` of JSON messages ``{"type", "data"}`` of one type.

    Works on a batch or a stream. ``data`` is a DDL type.
    """
    parsed = F.from_json(F.col(message), f"struct<type: string, data: {data}>")
    return (
        df.select(*keep, parsed.alias("_m"))
        .filter(F.col("_m.type") == kind)
        .select(*keep, F.col("_m.data").alias("data"))
    )


def other_messages(df: DataFrame, message: str) -> DataFrame:
    """The rows whose message has no type: what ``messages_of_type`` gives for no type at all."""
    kind = F.get_json_object(F.col(message), "$.type")
    return df.filter(kind.isNull())


def message_json(kind: Column | str, data: Column) -> Column:
    """``{"type": ..., "data": {...}}``; fields without a value are written as null."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    whole = F.struct(kind.alias("type"), data.alias("data"))
    return F.to_json(whole, {"ignoreNullFields": "false"})


def read_message_stream(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """A folder of JSON message files as a stream."""
    return spark.readStream.options(**options).schema(StructType.fromDDL(schema)).json(path)
