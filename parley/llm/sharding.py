"""K-d tree sharding: leaves of equal bytes by distributed weighted medians."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import pinned

#: Bits of a coordinate, of the tie-breaking hash below it, and of one histogram round.
PLACE_BITS, TIE_BITS, ROUND_BITS = 18, 18, 12
KEY_BITS = PLACE_BITS + TIE_BITS
#: Rows that share one numbering window when slots are dealt.
SLOT_ROWS = 20_000


@dataclass(frozen=True)
class Node:
    """A part of the tree: the rows for which ``where`` holds, to be cut in ``leaves``."""

    where: Column
    leaves: int


def coordinate(docs: DataFrame, name: str) -> Column:
    """A metadata column as a number whose order is the column's; strings by six bytes."""
    kind = dict(docs.dtypes)[name]
    if kind == "string":
        code = F.rpad(F.substring(F.hex(F.encode(docs[name], "UTF-8")), 1, 12), 12, "0")
        return F.conv(code, 16, 10).cast("double")
    return docs[name].cast("double")


def grid(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Each coordinate scaled to 0 .. 2^18 - 1 over its whole range; null lowest."""
    ends = rows.agg(*[f(c).alias(f"{f.__name__}{c}") for c in dims for f in (F.min, F.max)]).first()
    top = float((1 << PLACE_BITS) - 1)
    for c in dims:
        low, high = ends[f"min{c}"], ends[f"max{c}"]
        if low is None or high <= low:
            rows = rows.withColumn(c, F.lit(0).cast("long"))
        else:
            rows = rows.withColumn(
                c,
                F.coalesce(F.floor((F.col(c) - low) / F.lit(high - low) * top), F.lit(0)).cast("long"),
            )
    return rows


def chosen(nodes: Sequence[Node], values: Sequence[Column]) -> Column:
    """Per row the value of the node it lies in."""
    out = F.when(nodes[0].where, values[0])
    for node, value in zip(nodes[1:], values[1:], strict=True):
        out = out.when(node.where, value)
    return out


def split_level(rows: DataFrame, nodes: list[Node], dims: list[str]) -> list[Node]:
    """Cut every node of more than one leaf at the weighted quantile of its widest dimension.

    The quantile is found by histograms of 4,096 bins, each round inside the bin
    of the last one that holds it: three aggregates, whatever the number of rows.
    """
    inner = [n for n in nodes if n.leaves > 1]
    number = chosen(inner, [F.lit(i) for i in range(len(inner))])
    placed = rows.withColumn("_node", number).where("_node is not null")
    found = {
        r["_node"]: r
        for r in placed.groupBy("_node")
        .agg(
            F.sum("_size").alias("_size"),
            *[(F.max(c) - F.min(c)).alias(c) for c in dims],
        )
        .collect()
    }
    width = [max(dims, key=lambda c: (found[i][c] if i in found else 0, -dims.index(c))) for i in range(len(inner))]
    keys = [F.shiftleft(F.col(c), TIE_BITS) + F.col("_tie") for c in width]
    low = [0] * len(inner)
    wanted = [
        (found[i]["_size"] if i in found else 0) * (n.leaves // 2) / n.leaves
        for i, n in enumerate(inner)
    ]
    below = [0] * len(inner)
    for rest in range(KEY_BITS - ROUND_BITS, -1, -ROUND_BITS):
        bins = [F.shiftright(k - F.lit(lo), rest) for k, lo in zip(keys, low, strict=True)]
        inside = placed.withColumn("_bin", chosen(inner, bins)).where(
            f"_bin >= 0 and _bin < {1 << ROUND_BITS}"
        )
        sums: list[dict[int, int]] = [{} for _ in inner]
        for r in inside.groupBy("_node", "_bin").agg(F.sum("_size").alias("_size")).collect():
            sums[r["_node"]][r["_bin"]] = r["_size"]
        for i, histogram in enumerate(sums):
            pick = 0
            for b in sorted(histogram):
                pick = b
                if below[i] + histogram[b] > wanted[i]:
                    break
                below[i] += histogram[b]
            low[i] += pick << rest
    out, at = [], 0
    for node in nodes:
        if node.leaves == 1:
            out.append(node)
            continue
        left = node.leaves // 2
        out.append(Node(node.where & (keys[at] < F.lit(low[at])), left))
        out.append(Node(node.where & (keys[at] >= F.lit(low[at])), node.leaves - left))
        at += 1
    return out


def kd_shards(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    dims: Sequence[str] = ("n_chars", "source", "lang", "doc_id"),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, ``size``, ``text_crc32``, ``shard`` and ``slot``.

    Size is the UTF-8 bytes of the text plus 1. The table is cut at weighted
    medians of the widest metadata dimension (widths are shares of the whole
    range) until there are ``shards`` leaves, or leaves of ``target_bytes``. Rows
    with equal coordinates are told apart by a hash of id and text, so that a
    source or a group of copies of any size is cut where the bytes ask for it.
    Only histograms reach the driver: 4,096 sums for each node of a level.

    ``slot`` numbers the rows of a shard from 0 without gaps, in windows of
    about 20,000 rows that start at the sums of the windows before.

    Defined cases: a null text has size 1 and crc32 0; null coordinates come
    first; dimensions that the table lacks are left out; an empty table gives an
    empty result, equal rows may share a shard or not. Other columns are not read.
    """
    own = [c for c in dims if c in docs.columns]
    named = {c: f"_d{i}" for i, c in enumerate(own)}
    text = docs[text_col]
    plain = docs.select(
        docs[id_col].alias("_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("_size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("_crc"),
        *[coordinate(docs, c).alias(d) for c, d in named.items()],
    ).withColumn(
        "_tie", F.xxhash64("_id", "_crc").bitwiseAND((1 << TIE_BITS) - 1)
    )
    rows = pinned(plain)
    axes = list(named.values())
    if not axes:
        rows, axes = rows.withColumn("_d0", F.lit(0.0)), ["_d0"]
    rows = grid(rows, axes)
    total = rows.agg(F.sum("_size")).first()[0] or 0
    leaves = shards or max(1, -(-total // max(1, target_bytes or total or 1)))
    nodes = [Node(F.lit(True), leaves)]
    while any(n.leaves > 1 for n in nodes):
        nodes = split_level(rows, nodes, axes)
    placed = rows.withColumn("_shard", chosen(nodes, [F.lit(i) for i in range(len(nodes))]))
    return with_slots(placed).select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
    )


def with_slots(placed: DataFrame) -> DataFrame:
    """``_slot``: the place of a row in its shard, counted window by window."""
    parts = max(1, placed.count() // SLOT_ROWS)
    cut = placed.withColumn("_part", F.pmod(F.xxhash64("_tie", "_id"), F.lit(parts * 4)))
    group = Window.partitionBy("_shard", "_part")
    counts = pinned(cut.groupBy("_shard", "_part").agg(F.count("*").alias("_rows")))
    before = Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "_shard", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    inside = cut.withColumn(
        "_place", F.row_number().over(group.orderBy("_id", "_crc", "_size")) - 1
    )
    return inside.join(starts, ["_shard", "_part"]).withColumn(
        "_slot", F.col("_start") + F.col("_place")
    )
