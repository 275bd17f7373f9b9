"""Where the time of a response goes: stages, summaries, bottleneck.

A stage row is ``(sample, pos, component, time)`` with the time in seconds;
``pos`` is the place in the waterfall, which need not be in time order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.quantiles import aggregate_with_quantiles
from parley.operators.sequence import Names, framed

TOTAL = "total"
WATERFALL = "array<struct<component: string, time: double>>"


def _parsed(payload: str) -> Column:
    return F.from_json(F.col(payload), f"struct<waterfall: {WATERFALL}>")["waterfall"]


def parse_waterfall(df: DataFrame, payload: str, keep: Names) -> DataFrame:
    """Stage rows out of a JSON payload ``{"waterfall": [...]}``.

    Payloads without stages give no rows; ``waterfall_rejects`` has them.
    """
    return df.select(*keep, F.posexplode(_parsed(payload)).alias("pos", "_s")).select(
        *keep, "pos", F.col("_s.component").alias("component"), F.col("_s.time").alias("time")
    )


def waterfall_rejects(df: DataFrame, payload: str, keep: Names) -> DataFrame:
    """The rows that ``parse_waterfall`` gets no stages from, with the payload and a reason.

    ``no payload`` is a null one, ``malformed`` no JSON, ``no stages`` a payload
    without a waterfall, with an empty one, or with one of another form.
    """
    text, stages = F.col(payload), F.col("_stages")
    reason = (
        F.when(text.isNull(), "no payload")
        .when(F.try_parse_json(text).isNull(), "malformed")
        .otherwise("no stages")
    )
    parsed = df.select(*keep, payload, _parsed(payload).alias("_stages"))
    return parsed.where(stages.isNull() | (F.size(stages) == 0)).select(
        *keep, payload, reason.alias("reason")
    )


def waterfall_deltas(waterfall: Column) -> Column:
    """Deltas of one waterfall array, the total last. No shuffle."""
    count = F.size(waterfall)
    heads = F.slice(waterfall, F.lit(1), F.greatest(count - 1, F.lit(0)))
    tails = F.slice(waterfall, F.lit(2), F.greatest(count - 1, F.lit(0)))
    steps = F.zip_with(
        heads,
        tails,
        lambda a, b: F.struct(
            F.concat(a["component"], F.lit("->"), b["component"]).alias("component"),
            ((b["time"] - a["time"]) * 1000).alias("latency_ms"),
        ),
    )
    total = F.struct(
        F.lit(TOTAL).alias("component"),
        ((F.element_at(waterfall, -1)["time"] - waterfall[0]["time"]) * 1000).alias("latency_ms"),
    )
    return F.when(count > 0, F.concat(steps, F.array(total)))


def explode_deltas(df: DataFrame, waterfall: str, keep: Names) -> DataFrame:
    """One row per stage delta of a waterfall column."""
    return df.select(*keep, F.inline(waterfall_deltas(F.col(waterfall))))


def stage_deltas(
    stages: DataFrame,
    sample: Names,
    order: Names,
    component: str = "component",
    time: str = "time",
    **limits: int,
) -> DataFrame:
    """The same from stage rows: each stage to the next, and first to last.

    A sample may be of any length; the total needs its end points only.
    """
    stages = stages.select(*sample, *order, F.col(component).alias("_c"), F.col(time).alias("_t"))
    nexts = framed(
        stages,
        sample,
        order,
        0,
        1,
        lambda w: {"_next": F.lead(F.struct("_c", "_t")).over(w)},
        **limits,
    )
    deltas = nexts.filter(F.col("_next").isNotNull()).select(
        *sample,
        F.concat("_c", F.lit("->"), F.col("_next._c")).alias("component"),
        ((F.col("_next._t") - F.col("_t")) * 1000).alias("latency_ms"),
    )
    place = F.struct(*order)
    span = F.max_by("_t", place) - F.min_by("_t", place)
    totals = stages.groupBy(*sample).agg((span * 1000).alias("latency_ms"))
    return deltas.unionByName(totals.withColumn("component", F.lit(TOTAL)))


def component_summary(df: DataFrame, by: str = "component", value: str = "latency_ms") -> DataFrame:
    """Mean, median, sample deviation and maximum per component, slowest first."""
    simple = {"mean": F.avg(value), "std": F.stddev_samp(value), "max": F.max(value)}
    table = aggregate_with_quantiles(df, [by], value, simple, {"median": 0.5})
    return table.select(by, "mean", "median", "std", "max").orderBy(F.desc("mean"), by)


def sorted_means(df: DataFrame, by: str = "component", value: str = "latency_ms") -> DataFrame:
    """The mean of every component, slowest first."""
    return df.groupBy(by).agg(F.avg(value).alias("mean")).orderBy(F.desc("mean"), by)


def bottleneck(
    df: DataFrame, by: str = "component", value: str = "latency_ms", include_total: bool = True
) -> DataFrame:
    """The component with the greatest mean.

    The total is a component too and wins unless deltas are negative; leave it
    out to find the slowest stage.
    """
    rows = df if include_total else df.filter(F.col(by) != TOTAL)
    return sorted_means(rows, by, value).limit(1)


def distinct_components(df: DataFrame, by: str = "component") -> DataFrame:
    return df.select(by).distinct()


def latency_over_time(
    df: DataFrame,
    sample: Names,
    by: str = "component",
    value: str = "latency_ms",
) -> DataFrame:
    """The series of every component: one row per sample, component and value."""
    return df.select(*sample, by, value)
