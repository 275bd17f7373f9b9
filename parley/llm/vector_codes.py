"""Product codes of vectors: Lloyd's rounds that compare parts with the entries that moved."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import release_memory
from parley.operators.sequence import join_on
from parley.session import new_folder, pinned, spread

#: Vectors of a block, which is one row between the rounds.
BLOCK_VECTORS = 4096

Codebooks = np.ndarray  # parts x entries x width, int64


def usable(vector: Column) -> Column:
    """Whether a vector is there, and all its components are and are finite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def whole_numbers(values: np.ndarray, scale: int, bound: int) -> np.ndarray:
    """floor(scale * x), held between -bound and bound."""
    return np.floor(np.clip(values.astype(np.float64) * scale, -bound, bound)).astype(np.int64)


def least_entries(
    vectors: np.ndarray, books: np.ndarray, entries: np.ndarray, best: np.ndarray, code: np.ndarray
) -> None:
    """Compare each column of ``vectors`` (width x n) with ``entries`` in rising order, in place.

    Of equal distances the lower entry stays, also against one held before.
    """
    for k in entries:
        gap = vectors - books[k][:, None]
        far = (gap * gap).sum(axis=0)
        nearer = (far < best) | ((far == best) & (k < code))
        best[nearer] = far[nearer]
        code[nearer] = k


def assigned(
    vectors: np.ndarray, books: Codebooks, moved: np.ndarray, code: np.ndarray, best: np.ndarray
) -> None:
    """Nearest entries of all parts of a block (parts x width x n), from the codes and distances before.

    A part whose entry stayed is as near to it as before, and no other entry that
    stayed can be nearer, so only the entries that moved are compared with the
    stored distance. The other parts are compared with all entries.
    """
    every = np.arange(books.shape[1])
    for p in range(len(books)):
        active = np.flatnonzero(moved[p])
        if not len(active):
            continue
        gone = moved[p][code[p]]
        for rows, entries in ((~gone, active), (gone, every)):
            if not rows.any():
                continue
            own, b, c = vectors[p][:, rows], best[p][rows], code[p][rows]
            if entries is every:
                b[:] = np.iinfo(np.int64).max
                c[:] = books.shape[1]
            least_entries(own, books[p], entries, b, c)
            best[p][rows], code[p][rows] = b, c


def part_sums(vectors: np.ndarray, code: np.ndarray, entries: int) -> np.ndarray:
    """Per part and entry the number of its parts and their sums: parts x entries x (1 + width)."""
    parts, width, n = vectors.shape
    out = np.zeros((parts, entries, 1 + width), dtype=np.int64)
    for p in range(parts):
        order = np.argsort(code[p], kind="stable")
        counts = np.bincount(code[p], minlength=entries)
        used = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[used]
        out[p, :, 0] = counts
        out[p, used, 1:] = np.add.reduceat(vectors[p][:, order], starts, axis=1).T
    return out


def block_schema(rows: DataFrame) -> T.StructType:
    kind = {f.name: f.dataType for f in rows.schema.fields}
    return T.StructType(
        [
            T.StructField("ids", T.ArrayType(kind["_id"])),
            T.StructField("labels", T.ArrayType(kind["_label"])),
            T.StructField("vectors", T.BinaryType()),
            T.StructField("code", T.BinaryType()),
            T.StructField("best", T.BinaryType()),
            T.StructField("sums", T.ArrayType(T.LongType())),
        ]
    )


def lists(values: pa.Array | list, kind: pa.DataType, n: int) -> pa.Array:
    """One list that holds all values."""
    own = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), own)


def block_row(ids: pa.Array, labels: pa.Array, vectors, code, best, sums) -> pa.RecordBatch:
    small = vectors.astype(np.int16) if np.abs(vectors).max(initial=0) < 1 << 15 else vectors
    columns = [
        lists(ids, ids.type, len(ids)),
        lists(labels, labels.type, len(labels)),
        pa.array([small.tobytes()], pa.binary()),
        pa.array([code.astype(np.uint8).tobytes()], pa.binary()),
        pa.array([best.tobytes()], pa.binary()),
        lists(sums.ravel(), pa.int64(), sums.size),
    ]
    return pa.RecordBatch.from_arrays(columns, ["ids", "labels", "vectors", "code", "best", "sums"])


def unpacked(batch: pa.RecordBatch, i: int, parts: int, width: int):
    """Ids, labels, vectors (parts x width x n), codes and distances of a stored block."""
    ids = batch.column("ids")[i].values
    labels = batch.column("labels")[i].values
    data = batch.column("vectors")[i].as_buffer()
    kind = np.int16 if data.size == 2 * parts * width * len(ids) else np.int64
    vectors = np.frombuffer(data, kind).reshape(parts, width, len(ids)).astype(np.int64)
    code = np.frombuffer(batch.column("code")[i].as_buffer(), np.uint8).reshape(parts, -1).astype(np.int64)
    best = np.frombuffer(batch.column("best")[i].as_buffer(), np.int64).reshape(parts, -1).copy()
    return ids, labels, vectors, code, best


def first_blocks(rows: DataFrame, books: Codebooks, scale: int, bound: int) -> DataFrame:
    """Blocks of whole-number vectors with their nearest first entries, all compared."""
    parts, entries, width = books.shape
    schema = block_schema(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_VECTORS):
                part = batch.slice(at, BLOCK_VECTORS)
                flat = np.asarray(pc.list_flatten(part.column("_vector")))
                whole = whole_numbers(flat, scale, bound).reshape(len(part), parts, width)
                vectors = np.ascontiguousarray(whole.transpose(1, 2, 0))
                code = np.zeros((parts, len(part)), dtype=np.int64)
                best = np.zeros((parts, len(part)), dtype=np.int64)
                assigned(vectors, books, np.ones((parts, entries), dtype=bool), code, best)
                sums = part_sums(vectors, code, entries)
                yield block_row(part.column("_id"), part.column("_label"), vectors, code, best, sums)
        release_memory()

    return rows.mapInArrow(run, schema)


def next_blocks(blocks: DataFrame, books: Codebooks, moved: np.ndarray) -> DataFrame:
    """The blocks after another assignment to ``books``, of which ``moved`` changed since the last one."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, labels, vectors, code, best = unpacked(batch, i, parts, width)
                assigned(vectors, books, moved, code, best)
                sums = part_sums(vectors, code, entries)
                yield block_row(ids, labels, vectors, code, best, sums)
        release_memory()

    return blocks.mapInArrow(run, blocks.schema)


def coded(blocks: DataFrame, books: Codebooks, moved: np.ndarray) -> DataFrame:
    """Rows ``_id, _label, code, error`` after the last assignment."""
    parts, _, width = books.shape
    kind = {f.name: f.dataType.elementType for f in blocks.schema.fields if f.name in ("ids", "labels")}
    schema = T.StructType(
        [
            T.StructField("_id", kind["ids"]),
            T.StructField("_label", kind["labels"]),
            T.StructField("code", T.StringType()),
            T.StructField("error", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, labels, vectors, code, best = unpacked(batch, i, parts, width)
                assigned(vectors, books, moved, code, best)
                digits = np.ascontiguousarray(code.astype(np.uint8).T).tobytes().hex()
                text = [digits[a : a + 2 * parts] for a in range(0, len(digits), 2 * parts)]
                columns = [ids, labels, pa.array(text, pa.string()), pa.array(best.sum(axis=0))]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "_label", "code", "error"])
        release_memory()

    return blocks.mapInArrow(run, schema)


def stored(blocks: DataFrame) -> tuple[DataFrame, str]:
    """The blocks written to the shared folder and read again, and where they are."""
    spark = blocks.sparkSession
    folder = new_folder(spark, "vector-codes")
    blocks.write.parquet(folder)
    return spark.read.schema(blocks.schema).parquet(folder), folder


def removed(blocks: DataFrame, folder: str) -> None:
    """Delete a folder of blocks that the next round has replaced."""
    context = blocks.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def updated(blocks: DataFrame, books: Codebooks) -> Codebooks:
    """Entries replaced by the floored mean of their parts; unused ones stay.

    The sums are added in Spark as decimals; the driver gets one number per
    entry and component, whatever the number of vectors.
    """
    parts, entries, width = books.shape
    spot = F.posexplode("sums").alias("place", "value")
    sums = blocks.select(spot).groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
    whole = [0] * (parts * entries * (1 + width))
    for r in sums.collect():
        whole[r["place"]] = int(r["total"])
    new = books.copy()
    for p in range(parts):
        for k in range(entries):
            at = (p * entries + k) * (1 + width)
            if whole[at]:
                new[p, k] = [x // whole[at] for x in whole[at + 1 : at + 1 + width]]
    return new


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
) -> DataFrame:
    """One row per usable vector: id, ``code``, ``error``, ``label_error``, ``codebooks_sha256``.

    Components become floor(scale * x); a vector is cut into ``parts`` equal
    parts. Each part has a codebook that starts from the ``entries`` vectors of
    smallest ids. A round assigns all parts to their nearest entries (of equal
    ones the lower) and replaces each entry by the floored mean of its parts;
    after ``rounds`` rounds parts are assigned once more. ``code`` has two hex
    digits per part, ``error`` the sum of the squared distances, ``label_error``
    its sum over rows of the same label.

    Vectors lie in blocks with the codes and exact distances of the last
    assignment. A part whose entry stayed compares only the entries that moved.
    A round reads the blocks of the last one and writes its own to the shared
    folder, then the old ones go, so a lost executor costs a part of a round. If
    no entry moves, later rounds would change nothing and are left out. The
    driver holds the codebooks and their sums alone.

    Defined cases: vectors that are null, empty, or hold null or non-finite
    components are dropped. The length of the usable vector with the smallest id,
    of those whose length can be cut into ``parts``, is the length of all; others
    are dropped. Nulls among ids come last, ids that repeat are ordered by their
    components; with fewer rows than ``entries`` a codebook has as many entries
    as rows. Whole-number components are held below the bound from which an
    error could pass a long; a ``label_error`` beyond a long is null. Null labels
    are one label. No usable row gives an empty result. Other columns are not
    read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code of two hex digits needs 1 to 256 entries")
    rows = vectors.select(
        F.col(id_col).alias("_id"), F.col(vector_col).alias("_vector"), F.col(label_col).alias("_label")
    ).where(usable(F.col("_vector")) & (F.size("_vector") % parts == 0))
    by_id = [F.col("_id").asc_nulls_last(), F.col("_vector")]
    head = rows.orderBy(*by_id).select("_vector").limit(entries).collect()
    names = [id_col, "code", "error", "label_error", "codebooks_sha256"]
    if not head:
        none = rows.select(
            F.col("_id").alias(id_col),
            F.lit("").alias("code"),
            *[F.lit(0).cast("long").alias(n) for n in ("error", "label_error")],
            F.lit("").alias("codebooks_sha256"),
        )
        return none.where(F.lit(False))
    length = len(head[0][0])
    rows = rows.where(F.size("_vector") == length)
    if any(len(r[0]) != length for r in head):
        head = rows.orderBy(*by_id).select("_vector").limit(entries).collect()
    bound = isqrt((1 << 63) // length) // 2 - 1
    first = np.array([r[0] for r in head], dtype=np.float64)
    books = whole_numbers(first, scale, bound).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()

    blocks, folder = stored(first_blocks(spread(rows), books, scale, bound))
    moved = np.zeros(books.shape[:2], dtype=bool)
    for left in range(rounds - 1, -1, -1):
        new = updated(blocks, books)
        moved = (new != books).any(axis=2)
        books = new
        if not left or not moved.any():
            break
        after, place = stored(next_blocks(blocks, books, moved))
        removed(after, folder)
        blocks, folder = after, place
    found = pinned(coded(blocks, books, moved))
    removed(found, folder)
    sums = found.groupBy("_label").agg(F.try_sum("error").alias("label_error"))
    return (
        join_on(found, sums, ["_label"])
        .withColumn("codebooks_sha256", F.lit(digest(books)))
        .withColumnRenamed("_id", id_col)
        .select(*names)
    )
