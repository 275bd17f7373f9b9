"""Rows with nulls, repeats, long texts and column names that operators use themselves."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators give to columns of their own
        T.StructField("size", T.StringType()),
        T.StructField("keep_id", T.StringType()),
        T.StructField("_id", T.LongType()),
        T.StructField("ids", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("_language", T.StringType()),
        T.StructField("_kept_text_sha", T.StringType()),
        T.StructField("_stays", T.LongType()),
        T.StructField("row", T.StringType()),
        T.StructField("key", T.StringType()),
    ]
)

PROSE = (
    "The keeper of the small harbour wrote every evening what the sea had brought: planks, nets, a barrel "
    "of salt, once a letter in a bottle that nobody could read, and he kept all of it in the order in which it came."
)


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), "x", "y", 7, "z", "s", "l", "h", 8, "r", "k")


ROWS = [
    row(1, PROSE),
    row(2, PROSE.upper()),
    row(3, PROSE + " He never threw anything away, not even the rope that had no end."),
    row(4, None, None, None),
    row(5, ""),
    row(6, " \n\t "),
    row(7, "one two three"),
    row(8, "One two THREE"),
    row(9, "Été à la plage, où les enfants jouent avec le sable et la mer.", "fr", "b"),
    row(9, "Été à la plage, où les enfants jouent avec le sable et la mer.", "fr", "b"),
    row(10, "12345 67890 #### !!!", "en", None),
    row(None, "a row without an id but with words in it", "en", "c"),
    row(11, " ".join(f"w{i % 977}" for i in range(30_000)), "en", "c"),
    row(12, "ab" * 40_000, "en", "c"),
    row(13, "x\x00y \r\n\r\n WARC/1.1\r\n\U0001f600 ﻿ end", "xx", "é"),
]
