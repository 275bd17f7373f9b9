"""Model scores. Corpus scores are ratios of sums, one pass per table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text
from parley.operators.quantiles import aggregate_with_quantiles, quantiles
from parley.operators.sequence import Names, join_on

LATENCY_LEVELS = {
    "median": 0.5,
    "p90": 0.9,
    "q1": 0.25,
    "q3": 0.75,
    "whisker_low": 0.05,
    "whisker_high": 0.95,
}
# Token vectors of one side that are compared in one go.
TOKEN_BLOCK = 256
# Cosines that are computed in one product of several pairs.
CUBE_CELLS = 1 << 20


def ref_hyp_join(refs: DataFrame, hyps: DataFrame, on: Names) -> DataFrame:
    """Pair reference and hypothesis by sample id."""
    return refs.join(hyps, on, "inner")


def token_weighted_perplexity(df: DataFrame, by: Names, loss: str, tokens: str) -> DataFrame:
    """exp of the mean loss per token, batches weighted by their tokens."""
    total = F.sum(F.col(loss) * F.col(tokens)) / F.sum(tokens)
    return df.groupBy(*by).agg(F.exp(total).alias("perplexity"), F.sum(tokens).alias("tokens"))


# -- embedding match -------------------------------------------------------


def embedding_match_pairs(
    tokens: DataFrame, pair: Names, side: str, index: str, vector: str, block: int = TOKEN_BLOCK
) -> DataFrame:
    """Precision, recall and F1 of each pair of token sequences.

    ``side`` is ``hyp`` or ``ref``. Each hypothesis token takes its best cosine
    with a reference token (precision) and the other way round (recall). The
    tokens of a side are packed in blocks; the pairs of blocks of a batch are padded to
    one size and multiplied together, which yields only the best cosine per token. A pair with tokens on
    one side only scores 0.
    """
    packed = tokens.groupBy(*pair, side, F.floor(F.col(index) / block).alias("_block")).agg(
        F.collect_list(F.struct(F.col(index).alias("i"), F.col(vector).alias("v"))).alias("_tokens")
    )

    def of(name: str) -> DataFrame:
        return packed.filter(F.col(side) == name).select(
            *pair, F.col("_tokens.i").alias(f"_{name}_i"), F.col("_tokens.v").alias(f"_{name}_v")
        )

    both = of("hyp").join(of("ref"), pair)
    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema.fields}
    schema = ", ".join([*[f"{p} {kinds[p]}" for p in pair], "side string, i long, best double"])
    best = (
        both.mapInArrow(lambda batches: _best_cosines(batches, pair), schema)
        .groupBy(*pair, "side", "i")
        .agg(F.max("best").alias("best"))
    )
    scores = best.groupBy(*pair).agg(
        F.avg(F.when(F.col("side") == "hyp", F.col("best"))).alias("precision"),
        F.avg(F.when(F.col("side") == "ref", F.col("best"))).alias("recall"),
    )
    # A pair with an empty side has no cosine at all.
    one_sided = (
        tokens.groupBy(*pair)
        .agg(F.count_if(F.col(side) == "hyp").alias("_h"), F.count_if(F.col(side) == "ref").alias("_r"))
        .where("_h = 0 or _r = 0")
        .select(*pair, F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"))
    )
    scores = scores.unionByName(one_sided)
    p, r = F.col("precision"), F.col("recall")
    return scores.withColumn("f1", F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(0.0))


def _unit_vectors(column: pa.ListArray) -> np.ndarray:
    """All token vectors of a column of lists of vectors, one row each, of length 1."""
    tokens = column.flatten()
    values = tokens.flatten().to_numpy(zero_copy_only=False).astype("float64")
    matrix = values.reshape(len(tokens), -1)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _padded(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of each pair as one layer of a cube, and which rows of it are tokens."""
    counts = pc.list_value_length(column).to_numpy()
    places = np.arange(counts.max())
    real = places < counts[:, None]
    starts = np.cumsum(counts) - counts
    rows = np.where(real, starts[:, None] + places, 0)
    return _unit_vectors(column)[rows], real


def _best_cosines(batches: Iterator[pa.RecordBatch], pair: Names) -> Iterator[pa.RecordBatch]:
    names = [*pair, "side", "i", "best"]
    for batch in batches:
        longest = [pc.max(pc.list_value_length(batch[f"_{n}_v"])).as_py() or 1 for n in ("hyp", "ref")]
        step = max(1, CUBE_CELLS // (longest[0] * longest[1]))
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            hyps, is_hyp = _padded(part["_hyp_v"])
            refs, is_ref = _padded(part["_ref_v"])
            cosines = hyps @ refs.transpose(0, 2, 1)
            best = {
                "hyp": np.where(is_ref[:, None, :], cosines, -np.inf).max(axis=2)[is_hyp],
                "ref": np.where(is_hyp[:, :, None], cosines, -np.inf).max(axis=1)[is_ref],
            }
            for side, real in (("hyp", is_hyp), ("ref", is_ref)):
                pairs = part.select(pair).take(pa.array(np.nonzero(real)[0]))
                columns = [pairs[k] for k in pair]
                sides = pa.repeat(pa.scalar(side), len(pairs))
                places = part[f"_{side}_i"].flatten().cast(pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, sides, places, pa.array(best[side])], names)


def embedding_match_score(pairs: DataFrame, by: Names) -> DataFrame:
    """Mean precision, recall and F1 over pairs (F1 is averaged, not recomputed)."""
    return pairs.groupBy(*by).agg(
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
        F.count(F.lit(1)).alias("pairs"),
    )


# -- classification --------------------------------------------------------


def confusion_counts(df: DataFrame, by: Names, ref: str, pred: str) -> DataFrame:
    return df.groupBy(*by, ref, pred).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, ref: str, pred: str, classes: list) -> DataFrame:
    """One row per reference class, one column per predicted class of the list.

    ``pred_other`` counts the predictions that are not on it, null included, so
    that the rows add up to all answers.
    """
    known = F.coalesce(F.col(pred).isin(classes), F.lit(False))
    return df.groupBy(F.col(ref).alias("ref")).agg(
        *[F.count_if(F.col(pred) == F.lit(c)).alias(f"pred_{c}") for c in classes],
        F.count_if(~known).alias("pred_other"),
    )


def class_scores(df: DataFrame, by: Names, ref: str, pred: str) -> DataFrame:
    """F1 of every class that occurs in the references or the predictions."""
    cell = F.explode(
        F.array(
            F.struct(F.col(ref).alias("class"), F.col("n").alias("r"), F.lit(0).alias("p")),
            F.struct(F.col(pred).alias("class"), F.lit(0).alias("r"), F.col("n").alias("p")),
        )
    )
    counts = confusion_counts(df, by, ref, pred)
    hits = F.when(F.col(ref) == F.col(pred), F.col("n")).otherwise(0)
    margins = (
        counts.select(*by, hits.alias("_hits"), cell.alias("_c"))
        .groupBy(*by, F.col("_c.class").alias("class"))
        .agg(
            F.sum("_c.r").alias("support"),
            F.sum("_c.p").alias("predicted"),
            # A hit stands in both of its cell's entries; count it once.
            F.sum(F.when(F.col("_c.p") > 0, F.col("_hits")).otherwise(0)).alias("tp"),
        )
    )
    # 2tp + fp + fn = support + predicted, never 0 for a class that occurs.
    f1 = 2 * F.col("tp") / (F.col("support") + F.col("predicted"))
    return margins.withColumn("f1", f1)


def macro_f1(df: DataFrame, by: Names, ref: str, pred: str) -> DataFrame:
    """Unweighted mean of the class F1s."""
    scores = class_scores(df, by, ref, pred)
    return scores.groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("classes")
    )


# -- word error rate -------------------------------------------------------


def word_edits(ref_words: Column, hyp_words: Column) -> Column:
    """Word-level edit distance of two arrays of words.

    Each distinct word of the pair becomes one character above U+FFFF, so the
    built-in character distance counts words. Room for a million of them.
    """

    def coded(words: Column, table: Column) -> Column:
        def character(word: Column) -> Column:
            code = F.hex(F.array_position(table, word) + 0xFFFF)
            return F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")

        return F.array_join(F.transform(words, character), "")

    table = F.array(F.array_distinct(F.concat(ref_words, hyp_words)))
    return F.transform(
        table, lambda t: F.levenshtein(coded(ref_words, t), coded(hyp_words, t))
    )[0]


def word_error_rate(df: DataFrame, by: Names, ref: str, hyp: str) -> DataFrame:
    """Edits over reference words, summed over all pairs of normalised texts.

    A missing text is an empty one: without a hypothesis all reference words are
    edits.
    """
    worded = df.select(
        *by,
        text.words(text.normalize_text(F.coalesce(F.col(ref), F.lit("")))).alias("_ref"),
        text.words(text.normalize_text(F.coalesce(F.col(hyp), F.lit("")))).alias("_hyp"),
    )
    counted = worded.select(
        *by,
        word_edits(F.col("_ref"), F.col("_hyp")).cast("long").alias("_edits"),
        F.size("_ref").cast("long").alias("_words"),
    )
    edits, words = F.sum("_edits"), F.sum("_words")
    return counted.groupBy(*by).agg(
        edits.alias("edits"), words.alias("ref_words"), (edits / words).alias("wer")
    )


# -- latency ---------------------------------------------------------------


def real_time_factor(df: DataFrame, by: Names, processing: str, audio: str) -> DataFrame:
    """Total processing time over total audio time."""
    return df.groupBy(*by).agg((F.sum(processing) / F.sum(audio)).alias("rtf"))


def row_real_time_factor(df: DataFrame, processing: str, audio: str) -> DataFrame:
    """Processing over audio time of each row; null without audio."""
    ratio = F.when(F.col(audio) != 0, F.col(processing) / F.col(audio))
    return df.withColumn("rtf", ratio)


def latency_stats(df: DataFrame, by: Names, latency: str, **how: int | None) -> DataFrame:
    """Mean, range and percentiles, nulls dropped.

    The raw values stay rows of ``df``; they are not gathered per group.
    """
    simple = {
        "mean": F.avg(latency),
        "min": F.min(latency),
        "max": F.max(latency),
        "n": F.count(latency),
    }
    return aggregate_with_quantiles(df, by, latency, simple, LATENCY_LEVELS, **how)


def tts_latency_summary(df: DataFrame, by: Names, latency: str, **how: int | None) -> DataFrame:
    levels = {"p50": 0.5, "p95": 0.95}
    return aggregate_with_quantiles(df, by, latency, {"mean": F.avg(latency)}, levels, **how)


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: least-squares slope and intercept of y on x."""
    return df.agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
    )


def length_latency_trend(df: DataFrame, length: str, latency: str) -> DataFrame:
    """Adds the fitted latency of each row."""
    line = trend_line(df, length, latency).select(F.struct("slope", "intercept")).scalar()
    return df.withColumn("_line", line).select(
        *df.columns,
        "_line.slope",
        "_line.intercept",
        (F.col(length) * F.col("_line.slope") + F.col("_line.intercept")).alias("fitted"),
    )


def box_plot(df: DataFrame, by: Names, value: str) -> DataFrame:
    """Quartiles, mean, whiskers at 1.5 times their distance, and outliers.

    A whisker is the farthest value inside its fence, and never inside the box.
    """
    levels = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    bounds = quantiles(df, by, value, levels)
    x = F.col(value)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = x.between(F.col("q1") - reach, F.col("q3") + reach)
    # One row per component against all values: AQE broadcasts it by its size.
    return (
        join_on(df.filter(x.isNotNull()), bounds, by)
        .groupBy(*by)
        .agg(
            F.avg(x).alias("mean"),
            *[F.first(name).alias(name) for name in levels],
            F.least(F.min(F.when(inside, x)), F.first("q1")).alias("whisker_low"),
            F.greatest(F.max(F.when(inside, x)), F.first("q3")).alias("whisker_high"),
            F.count(F.when(~inside, x)).alias("outliers"),
        )
    )


def first_token_latencies(
    df: DataFrame, start: str, first: str, end: str
) -> DataFrame:
    """Seconds to the first token (null if there was none) and to the end."""

    def seconds(name: str) -> Column:
        return F.unix_micros(F.col(name).cast("timestamp"))

    return df.withColumns(
        {
            "ttft": (seconds(first) - seconds(start)) / 1e6,
            "e2e": (seconds(end) - seconds(start)) / 1e6,
        }
    )


def ttft_e2e_profile(df: DataFrame, by: Names) -> DataFrame:
    """Counts and means per model; the lists themselves stay as rows."""
    return df.groupBy(*by).agg(
        F.count("ttft").alias("n_ttft"),
        F.avg("ttft").alias("mean_ttft"),
        F.count("e2e").alias("n_e2e"),
        F.avg("e2e").alias("mean_e2e"),
    )


# -- comparison ------------------------------------------------------------


def union_model_results(results: list[DataFrame]) -> DataFrame:
    """Result tables of several models, stacked; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)


def model_comparison(scores: list[DataFrame], model: str = "model") -> DataFrame:
    """All scores of each model side by side; a model missing a score has null."""
    return reduce(lambda a, b: a.join(b, model, "full"), scores)


def tradeoff(comparison: DataFrame, cost: str, quality: str, model: str = "model") -> DataFrame:
    """Two scores against each other, cheapest first."""
    return comparison.select(model, cost, quality).orderBy(cost, model)
