"""CSV records that hold line breaks, read from files that are split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ends_quoted(line: Column, quoted: bool) -> Column:
    """Whether a line ends inside a quoted field, if it began inside one or not.

    A quote opens a field only at the field's start, and inside one two quotes are a
    character. So the text before each quote tells what it does: the fold is 1 inside,
    2 after a quote that ends the field or begins a pair, 0 elsewhere.
    """
    before = F.split(line, '"')
    first = F.get(before, F.lit(0))
    opens = (first == "") | first.endswith(",")
    start = F.lit(2) if quoted else F.when(opens, 1).otherwise(0)

    def step(state: Column, text: Column) -> Column:
        opens = text.endswith(",") | ((state == 2) & (text == ""))
        return F.when(state == 1, 2).when(opens, 1).otherwise(0)

    later = F.slice(before, F.lit(2), F.greatest(F.size(before) - 2, F.lit(0)))
    return F.when(F.size(before) == 1, F.lit(quoted)).otherwise(F.aggregate(later, start, step) == 1)


def with_states(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``_in0`` and ``_in1``: the state before each row of an ordered group entered outside or inside.

    ``_out0`` and ``_out1`` are the states after the row for the two states before it. A
    row keeps the state, turns it round, or sets it. So the state is what the last row
    that sets it made of it, turned by the rows since.
    """
    group = Window.partitionBy(*keys).orderBy(*order)
    upto = group.rowsBetween(Window.unboundedPreceding, 0)
    earlier = group.rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("_out0") & ~F.col("_out1")).cast("long")
    odd = F.col("_turns") % 2 == 1
    made = F.when(F.col("_out0") == F.col("_out1"), F.col("_out0") != odd)
    odd_before = (F.col("_turns") - turns) % 2 == 1
    return (
        df.withColumn("_turns", F.sum(turns).over(upto))
        .withColumn("_made", F.last(made, ignorenulls=True).over(earlier))
        .withColumns(
            {f"_in{i}": F.coalesce("_made", F.lit(i == 1)) != odd_before for i in (0, 1)}
        )
        .drop("_turns", "_made")
    )


def after(state: str) -> Column:
    return F.when(F.col(state), F.col("_out1")).otherwise(F.col("_out0"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files as text: ``record``, and ``header`` for the first of a file.

    Every split of a file is scanned by its own task. What a split makes of the two
    states it can be entered in – outside or inside a quoted field – is one row, and from
    these rows the state at each split and the record that reaches into it are found.
    Lines move once, by split; those of records of several lines once more. Blank lines
    outside quotes are no records. A record is held whole by one task.
    """
    split = ["_file", "_block"]
    lines = spark.read.text(path, lineSep="\n").select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    for i in (0, 1):
        lines = lines.withColumn(f"_out{i}", ends_quoted(F.col("value"), i == 1))
    lines = with_states(lines, split, ["_row"])

    text = F.regexp_replace("value", "\r$", "") != ""
    splits = lines.groupBy(*split).agg(
        *[F.max_by(after(f"_in{i}"), "_row").alias(f"_out{i}") for i in (0, 1)],
        *[F.max(F.when(~F.col(f"_in{i}"), F.col("_row"))).alias(f"_start{i}") for i in (0, 1)],
        *[F.min(F.when(~F.col(f"_in{i}") & text, F.col("_row"))).alias(f"_first{i}") for i in (0, 1)],
    )
    by_split = Window.partitionBy("_file").orderBy("_block")
    in_file = by_split.rowsBetween(Window.unboundedPreceding, -1)
    whole_file = by_split.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of_state = {x: F.when(F.col("_in0"), F.col(f"{x}1")).otherwise(F.col(f"{x}0")) for x in ("_start", "_first")}
    entered = with_states(splits, ["_file"], ["_block"]).select(
        *split,
        F.col("_in0").alias("_inside"),
        F.last(of_state["_start"], ignorenulls=True).over(in_file).alias("_carried"),
        F.first(of_state["_first"], ignorenulls=True).over(whole_file).alias("_header"),
    )
    inside = F.when(F.col("_inside"), F.col("_in1")).otherwise(F.col("_in0"))
    upto = Window.partitionBy(*split).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        lines.join(entered, split)
        .withColumn("_state", inside)
        .withColumn("_start", F.last(F.when(~F.col("_state"), F.col("_row")), ignorenulls=True).over(upto))
        .withColumn("_start", F.coalesce("_start", "_carried"))
    )
    single = ~F.col("_state") & ~F.col("_out0")
    alone = placed.where(single).select("value", "_start", "_header")
    parts = placed.where(~single).groupBy("_file", "_start").agg(
        F.sort_array(F.collect_list(F.struct("_block", "_row", "value"))).alias("_lines"),
        F.first("_header").alias("_header"),
    )
    several = parts.select(F.array_join("_lines.value", "\n").alias("value"), "_start", "_header")
    return (
        alone.unionByName(several)
        .select(
            F.regexp_replace("value", "\r$", "").alias("record"),
            (F.col("_start") == F.col("_header")).alias("header"),
        )
        .where("record != ''")
    )


def split_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header and line breaks in quoted fields, all columns as text.

    The rows are those of Spark's reader with ``multiLine``, in which a file is one
    task's work. Quotes inside a field are doubled.
    """
    options = {"escape": '"', "multiLine": "true"}
    names = spark.read.csv(path, header=True, **options).columns
    schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    rows = csv_records(spark, path).where(~F.col("header"))
    return rows.select(F.from_csv("record", schema, options).alias("_row")).select("_row.*")
