"""Mixing sources to target weights by repeating or thinning their documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import numbered, word_count
from parley.session import pinned


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float, most: float
) -> DataFrame:
    """Per source ``_source``, ``_size``: its weight, ``_target`` and ``_rate``.

    Weights are dealt in turn to the sources in code point order, null last.
    The targets share ``share`` times all sizes by weight; a target stops at
    ``most`` times its source's size and the excess goes to the others by weight,
    until none is above. Only sums leave the cluster: every round is one
    aggregate over the table of sources.
    """
    place = F.pmod(F.col("_place"), F.lit(len(weights))).cast("int")
    table = pinned(
        numbered(sizes, [F.col("_source").asc_nulls_last()], "_place").withColumn(
            "_weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), place)
        )
    )
    total = share * (table.agg(F.sum("_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        full = F.lit(level) * F.col("_weight") >= F.lit(most) * F.col("_size")
        n, taken, weight = table.agg(
            F.count(F.when(full, 1)),
            F.coalesce(F.sum(F.when(full, F.lit(most) * F.col("_size"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0)),
        ).first()
        if n == stopped or not weight:
            break
        level, stopped = max(level, (total - taken) / weight), n
    target = F.least(F.lit(level) * F.col("_weight"), F.lit(most) * F.col("_size"))
    return table.withColumn("_target", target).withColumn(
        "_rate", F.when(F.col("_size") > 0, F.col("_target") / F.col("_size")).otherwise(0.0)
    )


def rates(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per source its words, target and rate, as ``source_targets`` gives them."""
    sizes = docs.groupBy(F.col(source_col).alias("_source")).agg(
        F.sum(word_count(F.col(text_col))).alias("_size")
    )
    return pinned(source_targets(sizes, weights, share, most))


def drawn(rows: DataFrame, targets: DataFrame, id_col: str, source_col: str, seed: str) -> DataFrame:
    """``rows`` with their source's ``_size``, ``_target`` and their own ``_copies``.

    floor(rate) copies, and one more if a number in [0, 1) made of the seed and
    the id lies below the rate's fraction, so reruns agree however rows are dealt.
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    whole = F.floor("_rate")
    copies = whole + F.when(draw < F.col("_rate") - whole, 1).otherwise(0)
    return rows.join(
        targets, rows[source_col].eqNullSafe(targets["_source"])
    ).withColumn("_copies", copies)


def copy_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
    **options,
) -> DataFrame:
    """Per input row: id, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    Words are summed per source with partial sums, so a hot source is no hot
    task. ``options`` are those of ``rates``.

    Defined cases: a null text has size 0; a null source is a source of its own;
    rows that repeat an id share its draw; sources without words have target 0
    and no copies; an empty table gives an empty result. Other columns are not
    read.
    """
    sized = pinned(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).alias("_from"),
            word_count(F.col(text_col)).alias("_words"),
        )
    )
    sizes = sized.groupBy(F.col("_from").alias("_source")).agg(F.sum("_words").alias("_size"))
    targets = pinned(source_targets(sizes, **{"weights": (5, 2, 1), "share": 1.5, "most": 2.0, **options}))
    return drawn(sized, targets, "_id", "_from", seed).select(
        F.col("_id").alias(id_col),
        F.col("_words").alias("size"),
        F.col("_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("_words")).alias("taken"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
    **options,
) -> DataFrame:
    """The mix itself: every row of ``docs``, as many times as it is taken.

    Texts do not move: rows meet the table of sources. Columns named like the
    helper columns (leading underscore) may be present in ``docs``.
    """
    targets = rates(docs, text_col=text_col, source_col=source_col, **options)
    held = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
        docs[id_col].alias("_id"),
        docs[source_col].alias("_from"),
    )
    taken = drawn(held, targets, "_id", "_from", seed)
    return taken.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select(
        *[F.col("_row").getField(c).alias(c) for c in docs.columns]
    )
