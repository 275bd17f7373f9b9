"""Stages of the corpus pipeline, each one of the operators applied to all rows it gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.byte_bpe import encode
from parley.llm.common import fold_of, numbered
from parley.llm.exact_dedup import without_copies
from parley.llm.jaccard_join import near_groups
from parley.llm.language_id import language_of, learn
from parley.llm.mixing import mix
from parley.llm.queries import vocabulary

#: Share of the likelihood below which no language is taken as found.
LEAST_SCORE = 0.5


def whole_row(docs: DataFrame) -> Column:
    """The row as one value, so that no helper column can meet a column of the table."""
    return F.struct(*[docs[c] for c in docs.columns])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a letter or without a clear language go.

    Null, empty and wordless texts go; repeated rows fare alike; of equally likely
    languages none is clear below the least score; without labelled rows, and for
    an empty table, nothing stays. All columns stay, whatever their names.
    """
    model = learn(docs, fold_of(F.col("doc_id"), 5) != 0)
    found = docs.select(whole_row(docs).alias("row"), language_of(F.col("text"), model).alias("language"))
    clear = (F.col("language.lang_pred") != "und") & (F.col("language.score") >= LEAST_SCORE)
    return found.where(clear).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the largest id stays.

    Null equals the empty text; null ids lose against any other; of rows that
    repeat id and text one stays, any of them if other columns differ; an empty
    table stays empty. All columns stay, whatever their names.
    """
    return without_copies(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Jaccard join: of each group of linked texts the row with the smallest id stays.

    Null ids come last. Rows without an id, or that share one, are told apart: if
    there are any, rows are numbered by id and hash of their text, and these
    numbers take the place of the ids, so unrelated texts all stay. Null and empty
    texts link with nothing and stay; an empty table stays empty. All columns stay,
    whatever their names.
    """
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").alias("key"), F.col("text").alias("text"))
    odd = F.col("key").isNull() | (F.col("n") > 1)
    if not rows.groupBy("key").agg(F.count("*").alias("n")).where(odd).isEmpty():
        order = [F.col("key").asc_nulls_last(), F.sha2(F.coalesce("text", F.lit("")), 256)]
        rows = numbered(rows, order, "number").withColumn("key", F.col("number"))
    groups = near_groups(rows.select("key", "text"), id_col="key")
    stay = groups.where("component_id = key").select(F.col("key").alias("stays"))
    return rows.join(stay, rows["key"] == stay["stays"], "left_semi").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as its source's target asks for.

    A null text has no words and a null source is one of its own; a source without
    words goes; rows that repeat an id share its draw; an empty table stays empty.
    All columns stay, whatever their names.
    """
    return mix(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: id, token ids and their number; fails if ids don't decode to their whole text.

    Null and empty texts have no ids; rows repeat as they come; an empty table
    stays empty. Columns but id and text are not read.
    """
    path, pattern = vocabulary()
    # One worker encodes and decodes, beside those of earlier stages, so it keeps less.
    coded = encode(docs, path, pattern, checked=True, remembered=1 << 16)
    broken = F.raise_error(F.lit("token ids do not decode to their text"))
    ids = F.when(F.col("whole"), F.col("ids")).otherwise(broken)
    return coded.select("doc_id", ids.alias("ids")).select("doc_id", "ids", F.size("ids").alias("n_tokens"))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode_texts),
]
