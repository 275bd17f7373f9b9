"""Dialogue dataset preparation: length bins, prompts, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import labels, prompts, text
from parley.operators.quantiles import quantiles

SEED = 42
SHORT, MEDIUM = 0.33, 0.66
BINS = 50


def project_text(df: DataFrame) -> DataFrame:
    """The one column training reads."""
    return df.select("text")


def limit_samples(df: DataFrame, order: str, count: int | None) -> DataFrame:
    """The first ``count`` samples; none or zero means all."""
    return df.orderBy(order).limit(count) if count else df


def answer_length_quantiles(df: DataFrame, length: str) -> DataFrame:
    """One row: the lengths that separate short, medium and long answers.

    Lengths are whole numbers no greater than the longest answer, so there are
    few distinct ones however many rows; they are not estimated first.
    """
    return quantiles(df, [], length, {"q1": SHORT, "q2": MEDIUM})


def with_answer_type(df: DataFrame, length: str, out: str = "answer_type") -> DataFrame:
    """Bin each answer by the quantiles of the whole column.

    The two numbers enter as a scalar subquery, so the big side is not joined.
    """
    bounds = answer_length_quantiles(df, length).select(F.struct("q1", "q2")).scalar()
    binned = df.withColumn("_bounds", bounds)
    kind = text.answer_type(F.col(length), F.col("_bounds.q1"), F.col("_bounds.q2"))
    return binned.withColumn(out, kind).drop("_bounds")


def length_histogram(df: DataFrame, length: str, bins: int = BINS) -> DataFrame:
    """Counts in equal-width bins from the least to the greatest length.

    Bins are closed on the left, the last on both sides; empty bins are kept.
    If all lengths are equal the range is widened by a half on either side.
    """
    counts = (
        df.filter(F.col(length).isNotNull())
        .groupBy(F.col(length).cast("double").alias("_x"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    low, high = F.min("_x"), F.max("_x")
    flat = low == high
    edges = counts.agg(
        F.when(flat, low - 0.5).otherwise(low).alias("_low"),
        F.when(flat, high + 0.5).otherwise(high).alias("_high"),
    )
    grid = edges.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins)))).withColumns(
        {
            "lower": F.col("_low") + (F.col("bin") - 1) * (F.col("_high") - F.col("_low")) / bins,
            "upper": F.col("_low") + F.col("bin") * (F.col("_high") - F.col("_low")) / bins,
        }
    )
    low, high = F.col("_range._low"), F.col("_range._high")
    guess = F.floor((F.col("_x") - low) * bins / (high - low)).cast("int") + 1
    filled = (
        counts.withColumn("_range", edges.select(F.struct("_low", "_high")).scalar())
        .withColumn("bin", F.least(guess, F.lit(bins)))
        .groupBy("bin")
        .agg(F.sum("_n").alias("_count"))
    )
    return grid.join(F.broadcast(filled), "bin", "left").select(
        "bin", "lower", "upper", F.coalesce("_count", F.lit(0)).cast("long").alias("count")
    )


def split_bucket(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the key alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2**32)


def with_split(df: DataFrame, key: str, seed: int = SEED, out: str = "split") -> DataFrame:
    """80/10/10 by hash of the row key: the same however the data is laid out."""
    bucket = split_bucket(F.col(key), seed)
    name = F.when(bucket < 0.8, "train").when(bucket < 0.9, "dev").otherwise("test")
    return df.withColumn(out, name)


def format_dialogues(df: DataFrame) -> DataFrame:
    """Clean the dialogue, map the label and add the training text."""
    return df.withColumns(
        {
            "empathetic_dialogues": text.clean_dialogue(F.col("empathetic_dialogues")),
            "emotion": labels.basic_emotion(F.col("emotion")),
        }
    ).withColumn(
        "text",
        prompts.training_text(
            F.col("Situation"),
            F.col("empathetic_dialogues"),
            F.col("emotion"),
            F.col("answer_type"),
            F.col("labels"),
        ),
    )


def prepare_dialogues(df: DataFrame, key: str) -> DataFrame:
    """The whole preparation: lengths, bins, prompts and split in one plan."""
    measured = df.withColumn("label_word_len", text.word_count(F.col("labels")))
    binned = with_answer_type(measured, "label_word_len")
    return with_split(format_dialogues(binned), key)


def eval_samples(df: DataFrame) -> DataFrame:
    """Prompt, reference and emotion, as models are scored on them."""
    prompt = prompts.eval_prompt(
        F.col("Situation"), F.col("empathetic_dialogues"), F.col("emotion")
    )
    return df.withColumns({"prompt": prompt, "ref": F.col("labels")})
