"""Exact duplicates by 128-bit content hash, with a byte comparison inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import ascii_lower
from parley.session import pinned


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest"
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when their bytes are, after lower-casing A-Z only. Of a
    group the row with the largest (or, with ``keep="smallest"``, the smallest)
    id stays.

    1. Rows are reduced to id and content hash (MD5), counted per hash with
       partial aggregates.
    2. Only rows of hashes that occur more than once carry their text on. It is
       compared with the text of the group's keeper, so a collision of the hash
       separates. The joins are plain inner or left joins of two shuffles, which
       Spark splits where one group is hot.
    3. Groups with a collision, none as a rule, are grouped anew by whole text.

    Defined cases: a null text equals the empty text. Null ids lose against any
    other id; a group of null ids keeps one of them under a null ``keep_id``.
    Rows that repeat id and text count in ``group_size``, and one of them is
    kept. An empty table gives an empty result. Other columns are not read.
    """
    best = F.max if keep == "largest" else F.min
    rows = docs.select(
        F.col(id_col).alias("_id"),
        ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"),
    ).withColumn("_hash", F.unhex(F.md5("_text")))
    keys = pinned(rows.select("_id", "_hash", F.sha2("_text", 256).alias("_sha")))
    repeated = pinned(
        keys.groupBy("_hash")
        .agg(best("_id").alias("_keep"), F.count("*").alias("_n"))
        .where("_n > 1")
    )
    members = pinned(rows.join(repeated, "_hash"))
    keepers = pinned(
        members.where(F.col("_id").eqNullSafe(F.col("_keep")))
        .groupBy("_hash")
        .agg(F.min("_text").alias("_kept_text"))
    )
    compared = pinned(
        members.join(keepers, "_hash", "left").select(
            "_id",
            "_hash",
            "_keep",
            "_n",
            F.sha2("_text", 256).alias("_sha"),
            F.when(F.col("_text") != F.col("_kept_text"), F.col("_text")).alias("_other"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    collided = compared.where("_other is not null").select("_hash").distinct()
    sound = compared.join(collided, "_hash", "left_anti").drop("_other")
    mixed = compared.join(collided, "_hash", "left_semi").drop("_keep", "_n")
    by_text = [F.col("_hash"), F.coalesce("_other", F.lit("")).alias("_other")]
    sizes = mixed.groupBy(*by_text).agg(best("_id").alias("_keep"), F.count("*").alias("_n"))
    mixed = (
        mixed.withColumn("_other", F.coalesce("_other", F.lit("")))
        .join(sizes, ["_hash", "_other"])
        .drop("_other")
    )
    single = keys.join(repeated, "_hash", "left_anti").select(
        "_id", "_hash", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_n"), "_sha"
    )
    # Of rows that repeat id and text the first one is marked, found by a partial
    # minimum: no task numbers the rows of a group. As one value, the key does not
    # tie the aggregate to the partitioning by hash of the joins before it.
    grouped = sound.unionByName(mixed)
    marked = (
        grouped.where(F.col("_id").eqNullSafe(F.col("_keep")))
        .groupBy(F.struct("_hash", "_sha", "_id").alias("_same"))
        .agg(F.min("_row").alias("_row"))
        .select("_row", F.lit(True).alias("_first"))
    )
    grouped = grouped.join(marked, "_row", "left").select(
        "_id", "_hash", "_keep", "_n", "_sha", F.coalesce("_first", F.lit(False)).alias("_kept")
    )
    return grouped.unionByName(single.withColumn("_kept", F.lit(True))).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_kept").alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns.

    Rows are found again by id and text hash. They are carried as one value, so
    columns of any name stay.
    """
    groups = exact_groups(docs, id_col, text_col, **options).where("kept")
    stay = groups.select(F.col(id_col).alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    norm = ascii_lower(F.coalesce(docs[text_col], F.lit("")))
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs[id_col].alias("id"),
        F.sha2(norm, 256).alias("sha"),
    )
    same = rows["id"].eqNullSafe(stay["kept_id"]) & (rows["sha"] == stay["kept_sha"])
    return rows.join(stay, same, "left_semi").dropDuplicates(["id", "sha"]).select("row.*")
