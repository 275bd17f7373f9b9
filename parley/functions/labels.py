"""Emotion vocabularies."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fine emotion label -> basic emotion.
BASIC_EMOTION = {
    "angry": "anger",
    "furious": "anger",
    "annoyed": "anger",
    "disgusted": "disgust",
    "ashamed": "disgust",
    "embarrassed": "disgust",
    "afraid": "fear",
    "terrified": "fear",
    "anxious": "fear",
    "apprehensive": "fear",
    "joyful": "joy",
    "excited": "joy",
    "proud": "joy",
    "grateful": "joy",
    "hopeful": "joy",
    "content": "joy",
    "impressed": "joy",
    "confident": "joy",
    "anticipating": "joy",
    "prepared": "joy",
    "sad": "sadness",
    "lonely": "sadness",
    "guilty": "sadness",
    "disappointed": "sadness",
    "devastated": "sadness",
    "nostalgic": "sadness",
    "surprised": "surprise",
    "sentimental": "neutral",
    "faithful": "neutral",
    "caring": "neutral",
    "trusting": "neutral",
    "jealous": "neutral",
}

# Face emotions, in the order that settles ties.
FACE_EMOTIONS = ["angry", "disgust", "fear", "happy", "sad", "surprise", "neutral"]

# Optional: face emotion -> the name the training labels use.
FACE_TO_BASIC = {"angry": "anger", "happy": "joy", "sad": "sadness"}


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def basic_emotion(label: Column, mapping: dict[str, str] | None = None) -> Column:
    """The basic emotion of a fine label; unknown and null give ``""``."""
    return F.coalesce(literal_map(mapping or BASIC_EMOTION)[label], F.lit(""))


def harmonized_emotion(face: Column) -> Column:
    """Face emotion renamed to the training vocabulary."""
    return F.coalesce(literal_map(FACE_TO_BASIC)[face], face)


def label_lookup_join(
    df: DataFrame, label: str, out: str, mapping: dict[str, str] | None = None, default: str = ""
) -> DataFrame:
    """Left join with the label table; Spark broadcasts it if its size allows."""
    spark: SparkSession = df.sparkSession
    entries = list((mapping or BASIC_EMOTION).items())
    table = spark.createDataFrame(entries, "_label string, _mapped string")
    joined = df.join(table, df[label] == table["_label"], "left")
    return joined.withColumn(out, F.coalesce("_mapped", F.lit(default))).drop("_label", "_mapped")
