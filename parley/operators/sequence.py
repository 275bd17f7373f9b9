"""Ordered work within a key, when one key may hold a large part of all rows.

There is one plan, whatever the lengths of the keys, and building it runs no job.
Keys with many rows are cut into blocks, ranges of their order. The borders of
the blocks are rows chosen by a hash, so every part of the plan finds the same
ones. A block has on average at least ``BLOCK_ROWS`` rows, and a key at most
``MOST_BLOCKS`` blocks, so the tables of borders and of what crosses them have at
most one row for ``BLOCK_ROWS`` rows (of 10**12 rows a million, some 50 MB) and are
broadcast; rows are shuffled once, by key and block. Where no key is long these
tables are empty, and adaptive execution takes their joins out. A caller's ``limit``
below ``SENT_ROWS`` makes tables that grow with the rows: these are never hinted as
broadcasts, and rows are shuffled by key to meet them. Where the order is a count of the
rows, blocks are ranges of it: no row looks for its block or meets a table, as what
is carried into a block is a row of it (``scanned_places``).

Sequential work is cut into chunks whose borders depend on the position within
the key alone, so a key's results are the same, bit for bit, whatever other keys
there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from parley.session import pinned

# Least rows of a block, and the most blocks of a key, both on average.
BLOCK_ROWS = 1 << 20
MOST_BLOCKS = 4096
# Least rows of a block whose tables (borders, totals) are broadcast. With smaller blocks they
# grow with the rows, so they are joined by a shuffle, and adaptive execution broadcasts small ones.
SENT_ROWS = 1 << 16
# Steps of the search among the borders of a key, which reaches twice the most blocks.
SEARCH_STEPS = [1 << i for i in range(12, -1, -1)]
# Rows of a chunk, which is one array. A key of one chunk has no summaries to
# compose, and chunk n starts from the same state in every plan.
FOLD_ROWS = 256
# Levels of chunks of chunks below the summaries of a whole key, and how many more
# chunks are summarised together than a chunk has rows.
FOLD_LEVELS, WIDER = 1, 4

Names = list[str]


def join_on(
    left: DataFrame, right: DataFrame, keys: Names, how: str = "inner"
) -> DataFrame:
    """Equi-join on columns of the same name in which null equals null."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], F.lit(True)
    )
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def _columns(names: Iterable[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def key_rows(df: DataFrame, keys: Names) -> DataFrame:
    """Rows of each key, as ``keys, _n``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def _same(keys: Names) -> Column:
    """That keys equal those of a table whose keys are called ``_r_…``; null equals null."""
    return reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], F.lit(True)
    )


def _renamed(keys: Names) -> list[Column]:
    return [F.col(k).alias(f"_r_{k}") for k in keys]


def _sent(table: DataFrame, limit: int) -> DataFrame:
    """A table of at most a row for ``limit`` rows, broadcast where that makes it small."""
    return F.broadcast(table) if limit >= SENT_ROWS else table


def _with_blocks(
    df: DataFrame,
    keys: Names,
    order: list[str | Column],
    limit: int = BLOCK_ROWS,
    sized: DataFrame | None = None,
) -> DataFrame:
    """``df`` with the number of the row's block in its key (``_block``), null in short keys.

    A row of a key with more rows than a block is a border if the hash of its
    place in the order says so, one in as many as a block has rows. ``_heads``
    are all borders of a key in order. ``_long`` tells that the key has blocks.
    """
    # A row without a place is before the first border, as nulls are first in order.
    parts = _columns(order)
    place = parts[0] if len(parts) == 1 else F.struct(*[c.alias(f"o{i}") for i, c in enumerate(parts)])
    counts = key_rows(df, keys) if sized is None else sized
    busy = counts.where(F.col("_n") > limit).select(*_renamed(keys), F.col("_n").alias("_r_n"))
    # One row in limit, and of a key with very many rows one in _r_n / MOST_BLOCKS.
    rows = df.select(*keys, place.alias("_o")).where(F.pmod(F.xxhash64("_o"), F.lit(limit)) == 0)
    times = F.greatest(F.lit(1), F.floor(F.col("_r_n") / (MOST_BLOCKS * limit))).cast("long")
    again = F.pmod(F.xxhash64(F.lit(1), "_o"), times) == 0
    chosen = rows.join(_sent(busy, limit), _same(keys)).where(again)
    heads = F.sort_array(F.collect_set("_o"))
    steps = F.filter(F.array(*map(F.lit, SEARCH_STEPS)), lambda step: step <= F.size(heads))
    borders = chosen.groupBy(*[f"_r_{k}" for k in keys]).agg(heads.alias("_heads"), steps.alias("_steps"))
    # Without keys there is a row of borders even where there are none.
    some = borders if keys else borders.where(F.size("_heads") > 0)

    def reached(at: Column, step: Column) -> Column:
        return F.when(F.get("_heads", at + step - 1) <= place, at + step).otherwise(at)

    # Binary search: the borders that are not after the row.
    number = F.aggregate("_steps", F.lit(0), reached)
    cut = F.col("_heads").isNotNull()
    # A filter on borders alone makes the join an inner one, which goes where there are no borders.
    # It may be turned round to stream the borders, so tables that are not broadcast are kept
    # on their side by a condition on the row too (a short key it lets through has no block).
    long = cut if limit >= SENT_ROWS else F.when(cut, True).otherwise(F.xxhash64(place) == 0)
    return df.join(_sent(some, limit), _same(keys), "left").select(
        *df.columns, F.when(cut, number).alias("_block"), long.alias("_long")
    )


def scanned(
    df: DataFrame,
    keys: Names,
    order: list[str | Column],
    sums: dict[str, Column] | None = None,
    fills: dict[str, Column] | None = None,
    limit: int = BLOCK_ROWS,
    sized: DataFrame | None = None,
    backwards: bool = False,
) -> DataFrame:
    """Running sums and fills over the same order, in one pass over the blocks of a key.

    ``sums`` are over the rows before this one, ``fills`` the latest non-null value up to and
    including this row; each block's are raised or filled from the key's earlier blocks.
    ``order`` is ascending; fills may read it ``backwards`` instead. ``sized`` gives the rows of
    each key (or more) as ``key_rows`` does, where they are cheaper to count elsewhere.
    """
    sums, fills = sums or {}, fills or {}
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_columns(order))])
    others, by = [f"_r_{k}" for k in keys], [*keys, "_block"]
    rows = _with_blocks(df, keys, order, limit, sized)

    def run(names: Names, ordering: list[Column]) -> WindowSpec:
        if backwards:
            ordering = [c.desc() for c in ordering]
        return Window.partitionBy(*names).orderBy(*ordering)

    before, upto = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, Window.currentRow)
    pick = F.min_by if backwards else F.max_by
    ends = rows.where("_long").groupBy(*_renamed(by)).agg(
        *[F.sum(v).alias(f"_e_{n}") for n, v in sums.items()],
        *[pick(v, F.when(v.isNotNull(), place)).alias(f"_e_{n}") for n, v in fills.items()],
    )
    earlier = run(others, [F.col("_r__block")]).rowsBetween(*before)
    carried = ends.select(
        *_columns([f"_r_{k}" for k in by]),
        *[F.sum(f"_e_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_e_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in fills],
    )
    values = [v.alias(f"_v_{n}") for n, v in (sums | fills).items()]
    within = run(by, _columns(order))
    local = rows.select(*df.columns, "_block", *values).select(
        *df.columns,
        "_block",
        *[F.coalesce(F.sum(f"_v_{n}").over(within.rowsBetween(*before)), F.lit(0)).alias(f"_l_{n}") for n in sums],
        *[F.last(f"_v_{n}", ignorenulls=True).over(within.rowsBetween(*upto)).alias(f"_l_{n}") for n in fills],
    )
    return local.join(_sent(carried, limit), _same(by), "left").select(
        *[c for c in df.columns if c not in sums and c not in fills],
        *[(F.col(f"_l_{n}") + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in fills],
    )


def _range_start(place: Column, limit: int) -> Column:
    """The first place of the block of a place.

    Blocks are ``limit`` places wide, and from ``MOST_BLOCKS`` of them on twice as wide each
    time the place doubles, so that a key has ``MOST_BLOCKS`` blocks, and half as many more
    for each doubling. All starts are multiples of the width.
    """
    at = place.cast("long")
    far = F.call_function("div", at, F.lit(limit * MOST_BLOCKS).cast("long"))
    wide = F.call_function("shiftleft", F.lit(limit).cast("long"), F.length(F.bin(far)))
    return at - F.pmod(at, F.when(far > 0, wide).otherwise(limit))


def scanned_places(
    df: DataFrame,
    keys: Names,
    place: str,
    sums: dict[str, Column] | None = None,
    fills: dict[str, Column] | None = None,
    limit: int = BLOCK_ROWS,
) -> DataFrame:
    """``scanned`` where ``place``, a whole number, counts the rows of a key.

    Rows are shuffled once, by key and block, together with a row for each block that holds
    what the earlier ones leave it. Gaps in the places only make blocks smaller. The result also
    has the start of the block (``_block``) and the row's own values (``_v_…``), and its rows lie by
    key and block, in order.
    """
    sums, fills = sums or {}, fills or {}
    by, at = [*keys, "_block"], F.col(place)
    rows = df.withColumn("_block", _range_start(at, limit))
    # Rows without a place are the first block.
    known = F.coalesce(at.cast("long"), F.lit(-(1 << 63)))
    ends = rows.groupBy(*by).agg(
        *[F.sum(v).alias(n) for n, v in sums.items()],
        *[F.max_by(v, F.when(v.isNotNull(), known)).alias(n) for n, v in fills.items()],
    )
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *by,
        F.struct(
            *[F.sum(n).over(earlier).alias(n) for n in sums],
            *[F.last(n, ignorenulls=True).over(earlier).alias(n) for n in fills],
        ).alias("_carried"),
    ).where(reduce(lambda a, b: a | b, [F.col("_carried")[n].isNotNull() for n in [*sums, *fills]]))
    # What is carried has no place, so it is the first row of its block.
    held = rows.unionByName(carried, allowMissingColumns=True).repartition(*by)
    own = F.col("_carried").isNull()
    values = {n: F.when(own, v).otherwise(F.col("_carried")[n]) for n, v in (sums | fills).items()}
    within = Window.partitionBy(*by).orderBy(place)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = [c for c in df.columns if c not in values]
    valued = held.select(*kept, "_block", *[v.alias(f"_v_{n}") for n, v in values.items()])
    # A row without a place that is not carried is in the block without a start.
    return valued.select(
        "*",
        *[F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)).alias(n) for n in sums],
        *[F.last(f"_v_{n}", ignorenulls=True).over(upto).alias(n) for n in fills],
    ).where(at.isNotNull() | F.col("_block").isNull())


def running_sum(
    df: DataFrame,
    keys: Names,
    order: list[str | Column],
    value: Column,
    out: str,
    limit: int = BLOCK_ROWS,
    sized: DataFrame | None = None,
) -> DataFrame:
    """Sum of ``value`` over the rows of the key that come before this one, as in ``scanned``."""
    return scanned(df, keys, order, sums={out: value}, limit=limit, sized=sized)


def with_position(
    df: DataFrame,
    keys: Names,
    order: list[str | Column],
    out: str = "_pos",
    limit: int = BLOCK_ROWS,
    sized: DataFrame | None = None,
) -> DataFrame:
    """0-based position of the row within its key."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), out, limit, sized)


def framed(
    df: DataFrame,
    keys: Names,
    order: list[str | Column],
    before: int,
    after: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    position: str | None = None,
    limit: int = BLOCK_ROWS,
    dense: str | None = None,
    sized: DataFrame | None = None,
) -> DataFrame:
    """Window columns that look at most ``before`` rows back and ``after`` ahead.

    ``build`` gets the ordered window and returns the columns to add. A key is
    cut by position; each piece also gets copies of the rows just outside it, so
    that all frames are whole inside one piece, and the copies are dropped
    afterwards. ``position`` names a column to add with the row's 0-based
    position; ``dense`` names one that is there already.
    """
    pos = dense or position or "_pos"
    size = max(limit, 4 * (before + after + 1))
    numbered = df if dense else with_position(df, keys, order, pos, limit, sized)
    first = F.floor(F.greatest(F.col(pos) - after, F.lit(0)) / size)
    last = F.floor((F.col(pos) + before) / size)
    copied = numbered.withColumn("_chunk", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    own = copied.withColumns(build(w)).filter(F.col("_chunk") == F.floor(F.col(pos) / size))
    if dense and position:
        own = own.withColumn(position, F.col(dense))
    return own.drop("_chunk") if dense or position else own.drop("_chunk", "_pos")


def last_known(
    df: DataFrame,
    keys: Names,
    order: list[str | Column],
    value: Column,
    out: str,
    limit: int = BLOCK_ROWS,
    sized: DataFrame | None = None,
    backwards: bool = False,
) -> DataFrame:
    """The latest non-null ``value`` up to and including this row, as in ``scanned``.

    ``backwards`` reads the (ascending) order from its end: the next value
    instead.
    """
    return scanned(df, keys, order, fills={out: value}, limit=limit, sized=sized, backwards=backwards)


def as_of(
    df: DataFrame,
    changes: DataFrame,
    keys: Names,
    at: str,
    value: str,
    tie: str | None = None,
    out: str | None = None,
    limit: int = BLOCK_ROWS,
) -> DataFrame:
    """Each row with the ``value`` of its key's latest change that is not after it.

    ``changes`` holds ``keys``, ``at``, ``value`` and, where a key may change twice
    at the same time, ``tie``, whose largest value is the latest. Rows and changes are
    merged in order of ``at`` and filled, so no row meets more than one change and
    a busy key is cut into blocks. A change to null is a change: rows after it
    have null, as have rows before the first one and rows without a time. Null keys
    are equal. Changes without a time are never the latest. The changes (narrow rows)
    are stored, as the plan reads them several times; ``df`` is read as often.
    """
    rows = df.select(
        *keys, F.col(at).alias("_at"), F.lit(1).alias("_mark"), F.struct(*df.columns).alias("_row")
    )
    timed = changes.where(F.col(at).isNotNull())
    rank = F.col(tie) if tie else F.lit(0)
    marks = pinned(
        timed.select(
            *keys,
            F.col(at).alias("_at"),
            F.lit(0).alias("_mark"),
            rank.alias("_tie"),
            F.struct(F.col(value).alias("v")).alias("_change"),
        )
    )
    merged = rows.unionByName(marks, allowMissingColumns=True)
    order = ["_at", "_mark", "_tie"]
    filled = last_known(merged, keys, order, F.col("_change"), "_latest", limit)
    kept = [F.col("_row")[c].alias(c) for c in df.columns if c != (out or value)]
    return filled.where("_mark = 1").select(*kept, F.col("_latest.v").alias(out or value))


@dataclass(frozen=True)
class Fold:
    """A sequential computation whose chunks can be summarised.

    ``step(state, row)`` is the next state. A summary stands for the effect of
    a run of rows on any state: ``extend(f, row)`` is that of the run and one
    row more, ``compose(f, g)`` that of f then g, ``apply(f, state)`` its
    effect.
    """

    initial: Column
    step: Callable[[Column, Column], Column]
    identity: Column
    extend: Callable[[Column, Column], Column]
    compose: Callable[[Column, Column], Column]
    apply: Callable[[Column, Column], Column]


def table_fold(initial: int, states: int, step: Callable[[Column, Column], Column]) -> Fold:
    """A fold whose state is one of the numbers 0 to ``states - 1``.

    A run of rows is summarised by where it leads from each of them.
    """
    return Fold(
        initial=F.lit(initial),
        step=step,
        identity=F.sequence(F.lit(0), F.lit(states - 1)),
        extend=lambda f, row: F.transform(f, lambda s: step(s, row)),
        compose=lambda f, g: F.transform(f, lambda s: F.get(g, s)),
        apply=lambda f, s: F.get(f, s),
    )


def fold(
    df: DataFrame,
    keys: Names,
    order: Names,
    values: Names,
    how: Fold,
    before: str = "_before",
    after: str = "_after",
    limit: int = FOLD_ROWS,
    dense: str | None = None,
    sized: DataFrame | None = None,
) -> DataFrame:
    """Run ``step(state, row)`` over each key's rows, of which there may be any number.

    Returns keys, order, values and the state before and after each row.
    ``order`` must identify a row within its key. A key is cut into chunks of
    ``limit`` rows by position. Each chunk's summary is composed in parallel, the
    starting state of each chunk follows from the summaries, and then all chunks
    run from their own start. Keys within one chunk need no summary, so they are
    not in those tables. ``dense`` names a column with 0-based positions, if there
    is one.
    """
    row = F.struct(*order, *values)
    numbered = df if dense else with_position(df, keys, order, "_pos", sized=sized)
    # As one value, keys may hold nulls and still join by plain equality, so that
    # chunks stay where they were gathered.
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_none"))
    chunked = numbered.select(
        key.alias("_key"), F.floor(F.col(dense or "_pos") / limit).alias("_chunk"), row.alias("_row")
    )
    by = ["_key", "_chunk"]
    rows = chunked.groupBy(*by).agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    several = (F.col("_chunk") > 0) | (F.size("_rows") >= limit)
    summary = F.aggregate("_rows", how.identity, how.extend).alias("_fn")
    starts = _chunk_starts(
        rows.where(several).select(*by, summary), "_chunk", how, WIDER * limit, FOLD_LEVELS
    )
    found = starts.select(*by, F.struct("_start").alias("_found"))
    begun = rows.join(found, by, "left").withColumn(
        "_start", F.when(F.col("_found").isNull(), how.initial).otherwise(F.col("_found._start"))
    )
    done = _unroll(begun, ["_key"], how.step, before, after)
    return done.select(*[F.col("_key")[k].alias(k) for k in keys], *[c for c in done.columns if c != "_key"])


def _unroll(
    rows: DataFrame, keys: Names, step: Callable[[Column, Column], Column], before: str, after: str
) -> DataFrame:
    """One output row per element of ``_rows``, with the states around it."""
    states = F.aggregate(
        "_rows",
        F.array("_start"),
        lambda s, r: F.concat(s, F.array(step(F.element_at(s, -1), r))),
    )
    count = F.size("_rows")
    zipped = F.arrays_zip(
        F.col("_rows").alias("row"),
        F.slice("_states", F.lit(1), count).alias("before"),
        F.slice("_states", F.lit(2), count).alias("after"),
    )
    return (
        rows.withColumn("_states", states)
        .select(*keys, F.explode(zipped).alias("_z"))
        .select(*keys, "_z.row.*", F.col("_z.before").alias(before), F.col("_z.after").alias(after))
    )


def _chunk_starts(
    summaries: DataFrame, chunk: str, how: Fold, limit: int, levels: int
) -> DataFrame:
    """The state in which each chunk starts: ``_key, chunk, _start``.

    On each level ``limit`` chunks are summarised together; the last level is
    one array for each key, of one entry for every ``limit`` chunks (262,144 rows).
    """
    row = F.struct(F.col(chunk), F.col("_fn"))

    def step(state: Column, r: Column) -> Column:
        return how.apply(r["_fn"], state)

    def unrolled(rows: DataFrame) -> DataFrame:
        return _unroll(rows, ["_key"], step, "_start", "_end").select("_key", chunk, "_start")

    # Only the chunk number is compared: it is unique within its key.
    gathered = F.array_sort(
        F.collect_list(row), lambda a, b: (a[chunk] - b[chunk]).cast("int")
    ).alias("_rows")
    if not levels:
        rows = summaries.groupBy("_key").agg(gathered)
        return unrolled(rows.withColumn("_start", how.initial))

    parent = f"{chunk}_of"
    by = ["_key", parent]
    rows = (
        summaries.withColumn(parent, F.floor(F.col(chunk) / limit)).groupBy(*by).agg(gathered)
    )
    composed = F.aggregate("_rows", how.identity, lambda f, r: how.compose(f, r["_fn"]))
    parents = rows.select(*by, composed.alias("_fn"))
    starts = _chunk_starts(parents, parent, how, limit, levels - 1)
    return unrolled(rows.join(starts, by))
