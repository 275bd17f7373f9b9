"""Exact quantiles with linear interpolation, by group.

One plan for any number of values: equal values are counted together with
partial counts, the counts are summed in value order within blocks of a group,
and the two values around each wanted rank are picked out. No group is ever in
one buffer, and no estimate decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.sequence import BLOCK_ROWS, Names, join_on, running_sum
from parley.session import pinned


def quantiles(
    df: DataFrame, by: Names, value: str, wanted: dict[str, float], limit: int = BLOCK_ROWS
) -> DataFrame:
    """One row per group with a column per entry of ``wanted``; nulls ignored."""
    return aggregate_with_quantiles(df, by, value, {}, wanted, limit)


def aggregate_with_quantiles(
    df: DataFrame,
    by: Names,
    value: str,
    others: dict[str, Column],
    wanted: dict[str, float],
    limit: int = BLOCK_ROWS,
) -> DataFrame:
    """Quantiles beside other aggregates of the rows whose value is not null."""
    # Without groups there is one row either way, and aggregates skip nulls.
    present = df.filter(F.col(value).isNotNull()) if by else df
    values = present.select(*by, F.col(value).cast("double").alias("_x"))
    found = _by_rank(values.filter(F.col("_x").isNotNull()), by, wanted, limit)
    if not others:
        return found
    simple = present.groupBy(*by).agg(*[c.alias(name) for name, c in others.items()])
    if by:
        return join_on(simple, found, by)
    row = found.select(F.struct(*wanted)).scalar()
    return simple.withColumn("_found", row).select(*others, "_found.*")


def _by_rank(values: DataFrame, by: Names, wanted: dict[str, float], limit: int) -> DataFrame:
    # One row per value of a group; stored, as its blocks and its sums all read it.
    counts = pinned(values.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_n")))
    # A value a row here, so the groups' distinct values make them long.
    sized = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sum(counts, by, ["_x"], F.col("_n"), "_below", limit, sized)
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    if by:
        located = join_on(ranked, totals, by)
    else:
        located = ranked.withColumn("_total", totals.select("_total").scalar())

    def at(rank: Column) -> Column:
        here = (F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_n"))
        return F.max(F.when(here, F.col("_x")))

    picked, results = [], []
    for i, (name, level) in enumerate(wanted.items()):
        place = (F.col("_total") - 1) * F.lit(float(level))
        picked += [
            at(F.floor(place)).alias(f"_lo{i}"),
            at(F.ceil(place)).alias(f"_hi{i}"),
            F.max(place - F.floor(place)).alias(f"_f{i}"),
        ]
        low, high, share = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_f{i}")
        results.append((low + (high - low) * share).alias(name))
    return located.groupBy(*by).agg(*picked).select(*by, *results)
