"""Importance resampling towards a target: bucket gains, array-scored weights, a distributed radix sort."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import release_memory
from parley.session import pinned, spread

#: Between words: every ASCII character but 0-9 and a-z (A-Z is lower-cased before).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that are worked on at a time.
BLOCK_BYTES = 4 << 20
#: Rows of a block of the sort, and the most bits of a digit.
BLOCK_ROWS, DIGIT_BITS = 1 << 16, 11


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``BLOCK_BYTES`` of text (column ``text``), whole texts."""
    for batch in batches:
        text = batch.column("text")
        ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            start = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, start + BLOCK_BYTES, "right")))
            yield batch.take(pa.array(range(at, to)))  # a copy: ascii_lower misreads slices
            at = to


def features(text: pa.Array, most: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row and string of every run of 1 to ``most`` words, and the words per row."""
    lower = pc.ascii_lower(pc.fill_null(text, "").cast(pa.large_string()))
    lists = pc.split_pattern_regex(lower, BETWEEN)
    rows = np.asarray(pc.list_parent_indices(lists))
    words = pc.list_flatten(lists)
    full = np.asarray(pc.greater(pc.binary_length(words), 0))
    rows, words = rows[full], words.filter(pa.array(full))
    found, names = [rows], [words]
    run, space = words, pa.scalar(" ", words.type)
    for n in range(2, most + 1):
        if len(words) < n:
            break
        whole = rows[n - 1 :] == rows[: len(rows) - n + 1]
        run = pc.binary_join_element_wise(run.slice(0, len(words) - n + 1), words.slice(n - 1), space)
        found.append(rows[n - 1 :][whole])
        names.append(run.filter(pa.array(whole)))
    counts = np.bincount(rows, minlength=len(text))
    return np.concatenate(found), pa.chunked_array(names).combine_chunks(), counts


def bucketed(names: pa.Array, buckets: int, memory: dict[str, int]) -> np.ndarray:
    """crc32 of each string modulo ``buckets``; ``memory`` keeps those of frequent strings."""
    kinds = names.dictionary_encode()
    if len(memory) > 1 << 18:
        memory.clear()
    codes = np.empty(len(kinds.dictionary), dtype=np.int64)
    for i, name in enumerate(kinds.dictionary.to_pylist()):
        code = memory.get(name)
        if code is None:
            code = memory[name] = zlib.crc32(name.encode()) % buckets
        codes[i] = code
    return codes[np.asarray(kinds.indices)] if len(codes) else codes


def bucket_counts(texts: DataFrame, text_col: str, most: int, buckets: int) -> DataFrame:
    """Features per bucket over whole texts: ``bucket``, ``n``. A task sends one sum per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, memory = np.zeros(buckets, dtype=np.int64), {}
        for block in blocks_of(batches):
            _, names, _ = features(block.column("text"), most)
            total += np.bincount(bucketed(names, buckets, memory), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])
        release_memory()

    rows = texts.select(F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(
    source: DataFrame, target: DataFrame, text_col: str, most: int, buckets: int
) -> np.ndarray:
    """Per bucket floor(1000 * ln of its smoothed share in the target over that in the source).

    One array of ``buckets`` whole numbers, the only thing the driver gets.
    """
    own = bucket_counts(spread(source), text_col, most, buckets).withColumnRenamed("n", "s")
    aim = bucket_counts(spread(target), text_col, most, buckets).withColumnRenamed("n", "t")
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in own.join(aim, "bucket", "full").collect():
        s[r["bucket"]], t[r["bucket"]] = r["s"] or 0, r["t"] or 0
    ratio = ((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(docs: DataFrame, id_col: str, text_col: str, most: int, gains: np.ndarray) -> DataFrame:
    """``id, n_words, n_features, weight`` of whole texts: the floored mean of the gains of its features."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, int] = {}
        for block in blocks_of(batches):
            at, names, words = features(block.column("text"), most)
            order = np.argsort(at, kind="stable")
            at, own = at[order], gains[bucketed(names, len(gains), memory)][order]
            sums = np.concatenate([[0], np.cumsum(own)])
            ends = np.searchsorted(at, np.arange(len(block) + 1))
            n = np.diff(ends)
            weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), pa.array(words.astype(np.int64)), pa.array(n), pa.array(weight)],
                ["id", "n_words", "n_features", "weight"],
            )
        release_memory()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))), with u from the first 32 bits of sha256 of ``seed:key``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def digits(value: Column, low: int, high: int) -> list[Column]:
    """Digits of ``value - low`` to hold up to ``high - low``, lowest first, of equal width."""
    bits = (high - low).bit_length()
    passes = -(-bits // DIGIT_BITS)
    width = -(-bits // passes) if passes else 0
    above = value - F.lit(low)
    return [
        F.shiftright(above, width * i).bitwiseAND((1 << width) - 1).cast("int") for i in range(passes)
    ]


def counting_pass(rows: DataFrame, digit: Column) -> DataFrame:
    """One stable counting sort of the order in ``_at`` by a digit.

    The order is cut into blocks. Digits are counted per block; a row goes to
    where the rows of smaller digits, those of its digit in earlier blocks and
    those of its digit before it in its block end. Blocks and digits are
    bounded, so no task gets more rows of a frequent digit than a block holds.
    """
    tagged = rows.withColumns({"_block": F.floor(F.col("_at") / BLOCK_ROWS), "_digit": digit})
    counts = tagged.groupBy("_block", "_digit").agg(F.count("*").alias("_n"))
    before = (Window.unboundedPreceding, -1)
    smaller = (
        counts.groupBy("_digit")
        .agg(F.sum("_n").alias("_all"))
        .select("_digit", F.coalesce(F.sum("_all").over(Window.orderBy("_digit").rowsBetween(*before)), F.lit(0)).alias("_base"))
    )
    earlier = F.sum("_n").over(Window.partitionBy("_digit").orderBy("_block").rowsBetween(*before))
    starts = (
        counts.withColumn("_earlier", F.coalesce(earlier, F.lit(0)))
        .join(smaller, "_digit")
        .select("_block", "_digit", (F.col("_base") + F.col("_earlier")).alias("_start"))
    )
    local = F.row_number().over(Window.partitionBy("_block", "_digit").orderBy("_at")) - 1
    placed = tagged.withColumn("_local", local).join(starts, ["_block", "_digit"])
    moved = placed.withColumn("_at", (F.col("_start") + F.col("_local")).cast("long"))
    return pinned(moved.drop("_block", "_digit", "_local", "_start"))


def radix_sorted(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``_at``, their place from 0 in ascending order of whole-number columns.

    The first column decides. Least significant digits first: each pass keeps
    the order of the one before among equal digits. As many digits are sorted
    as the values in the rows need. Nulls come last; rows equal in all columns
    take their places in any order.
    """
    keys = [f"_key{i}" for i in range(len(order))]
    held = pinned(
        rows.withColumns(dict(zip(keys, [c.cast("long") for c in order], strict=True)))
        .withColumn("_at", F.monotonically_increasing_id())
    )
    ends = held.agg(
        *[f(k).alias(f"{k}_{n}") for k in keys for n, f in (("low", F.min), ("high", F.max))],
        *[F.max(F.col(k).isNull()).alias(f"{k}_null") for k in keys],
        F.count("*").alias("n"),
    ).first()
    # A dense order first, also where no column tells rows apart.
    passes = [F.lit(0)]
    for k in reversed(keys):
        low, high = ends[f"{k}_low"], ends[f"{k}_high"]
        if low is not None:
            passes += digits(F.coalesce(F.col(k), F.lit(low)), low, high)
        if ends[f"{k}_null"]:
            passes.append(F.col(k).isNull().cast("int"))
    for digit in passes[1:] or passes:
        held = counting_pass(held, digit)
    return held.drop(*keys)


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    most: int = 1,
    buckets: int = 10_000,
    least_words: int = 20,
    percent: int = 10,
    seed: int = 2024,
) -> DataFrame:
    """One row per input row: id, ``n_features``, ``weight``, ``score``, ``rank``.

    Features are runs of 1 to ``most`` words of the whole lower-cased (A-Z) text,
    hashed into buckets. A bucket's gain compares its share among the features of
    all ``target`` texts with that among all ``docs``; a document's weight is the
    floored mean of the gains of its features, by look-up in one array. Adding
    Gumbel noise from a hash of the id and drawing the highest scores samples in
    proportion to exp(weight / 1000) without replacement. Of the N documents with
    at least ``least_words`` words, floor(percent * N / 100) are drawn; ``rank`` is
    1, 2, 3 ... by falling score, then id, then n_features.

    The ranks come from a radix sort of narrow rows. Rows that can't be drawn,
    because enough rows have a higher score, are found from the counts per score
    (whole numbers of a bounded range) and are not sorted.

    Defined cases: a null text has no words; a document without features has
    weight 0; a null id hashes as the empty string and comes last among equal
    scores; repeated rows count and are drawn each by itself, equal ones taking
    their ranks in any order; without target texts, or without any, gains compare
    with the smoothing alone; an empty table gives an empty result. Other columns
    are not read.
    """
    gains = bucket_gains(docs, target, text_col, most, buckets)
    found = weighed(spread(docs), id_col, text_col, most, gains)
    scored = pinned(found.withColumn("score", (F.col("weight") + gumbel(F.col("id"), seed)).cast("long")))
    enough = F.col("n_words") >= least_words
    steps = scored.where(enough).groupBy("score").agg(F.count("*").alias("n"))
    above = F.coalesce(
        F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    whole = scored.where(enough).count()
    wanted = whole * percent // 100
    cut = steps.withColumn("above", above).where(F.col("above") < wanted).agg(F.min("score")).first()[0]
    can = enough & (F.col("score") >= F.lit(cut).cast("long")) if cut is not None else F.lit(False)
    names = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    order = [-F.col("score"), F.col("id"), F.col("n_features")]
    drawn = radix_sorted(scored.where(can), order)
    rank = F.when(F.col("_at") < wanted, F.col("_at") + 1).cast("long")
    rest = scored.where(~F.coalesce(can, F.lit(False))).select(*names, F.lit(None).cast("long").alias("rank"))
    return drawn.select(*names, rank.alias("rank")).unionByName(rest)
