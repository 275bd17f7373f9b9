"""Texts in shards, and sums over keys of all shards in buckets.

Operators that compare every text with all others work in rounds. The rows of a
shard (by a hash of the id) meet in one task as compressed pieces. A shard sends
sorted keys to buckets by their leading bits; a bucket sees what all shards sent
for its keys and answers every shard. Both numbers grow with the bytes, so a
task's share does not, and a key that every text holds is sent once per shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import release_memory

#: Bytes of text to a shard and to a bucket, and the least number of either.
SHARD_BYTES, BUCKET_BYTES, LEAST = 4 << 20, 16 << 20, 64
#: Bytes of rows that are sorted by shard and packed at a time.
HELD_BYTES = 16 << 20
#: Bytes of text that are worked on at a time.
BLOCK_BYTES = 1 << 20

PIECE = "shard int, piece binary"
_OPTIONS = pa.ipc.IpcWriteOptions(compression="zstd")


def shares(docs: DataFrame, text_col: str, shard_bytes: int = SHARD_BYTES) -> tuple[int, int]:
    """Shards and buckets for a table, both in proportion to its bytes; buckets a power of two."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(LEAST, total // shard_bytes), max(LEAST, 1 << (total // BUCKET_BYTES).bit_length())


def pieces(docs: DataFrame, shards: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (shard, piece): what a task holds of a shard, as compressed Arrow rows (id, text).

    Null texts are empty. Compressed by the column, texts take less than half of
    what rows do in a shuffle.
    """
    rows = docs.select(
        F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int").alias("shard"),
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > HELD_BYTES:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return rows.mapInArrow(run, PIECE)


def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).sort_by("shard").combine_chunks()
    number = table.column("shard").to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
    own = table.select(["id", "text"])
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema, options=_OPTIONS) as stream:
            stream.write_table(own.slice(a, b - a))
        out.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(number[cuts[:-1]] if len(number) else [], pa.int32()), pa.array(out, pa.binary())],
        ["shard", "piece"],
    )


def unpacked(table: pa.Table) -> pa.Table:
    """All rows (id, text) of a shard in the order of id and text; null ids first."""
    release_memory()
    parts = [
        pa.ipc.open_stream(pa.py_buffer(p.as_py())).read_all() for p in table.column("piece")
    ]
    rows = pa.concat_tables(parts)
    order = pc.sort_indices(
        rows, sort_keys=[("id", "ascending"), ("text", "ascending")], null_placement="at_start"
    )
    return rows.take(order).combine_chunks()


def text_blocks(rows: pa.Table, most: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of whole texts: first row, bytes, and where each text starts (and the end).

    A block holds up to ``most`` bytes, or one text that is longer.
    """
    column = rows.column("text")
    texts = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[
        texts.offset : texts.offset + len(texts) + 1
    ].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        yield first, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    upper = (data >= 65) & (data <= 90)
    return data + upper.astype(np.uint8) * np.uint8(32)


# Hashing: every byte has a random value; a range of bytes is hashed by a polynomial
# in an odd number modulo 2^64, taken from prefix sums, and mixed at the end.
_RANDOM = np.random.default_rng(20240229)
_VALUES = _RANDOM.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, remembered."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            out = np.empty(size, np.uint64)
            out[0] = 1
            have = 1
            while have < size:
                out[have : 2 * have] = out[:have] * np.uint64(pow(base, have, 1 << 64))
                have *= 2
            _powers.append(out)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the word."""
    moved = x >> np.uint64(30)
    x = x ^ moved
    x *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(x, np.uint64(27), out=moved)
    x ^= moved
    x *= np.uint64(0x94D049BB133111EB)
    np.right_shift(x, np.uint64(31), out=moved)
    x ^= moved
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of the polynomial terms before each byte, and of all."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes wherever they stand."""
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_ranges(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of words before each text (and of all)."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1 if len(data) else starts
    return starts, ends, np.searchsorted(starts, bounds)


def bucket_slices(keys: np.ndarray, buckets: int) -> list[tuple[int, int]]:
    """Where each bucket's part of sorted keys lies; a bucket owns a range of leading bits."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    cuts = np.searchsorted(keys, np.arange(1, buckets, dtype=np.uint64) << shift)
    edges = [0, *cuts.tolist(), len(keys)]
    return list(zip(edges[:-1], edges[1:], strict=True))
