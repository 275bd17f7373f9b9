"""Text functions. All are built-in column expressions.

Whitespace means what Python's ``str.split`` and ``\\s`` mean by it: Unicode
white space and the four separators U+001C to U+001F, which Java's ``\\s``
leaves out. Word characters are letters, numbers and the underscore.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"
SPACE_CHARACTERS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def word_count(text: Column) -> Column:
    """Number of words between runs of any white space."""
    return F.regexp_count(text, F.lit(rf"(?U){NOT_SPACE}+"))


def word_count_space(text: Column) -> Column:
    """Number of pieces between single spaces; empty pieces count."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.regexp_extract_all(text, F.lit(rf"(?U)({NOT_SPACE}+)"))


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def clean_dialogue(text: Column) -> Column:
    """Drop the speaker tags ``Customer :`` and ``Agent :``, then strip."""
    for speaker in ("Customer", "Agent"):
        text = F.regexp_replace(text, rf"(?U)(?<!{WORD}){speaker}{SPACE}*:{SPACE}*", "")
    return strip(text)


def normalize_text(text: Column) -> Column:
    """Lower case, no punctuation, single spaces: the form WER is taken on."""
    # The ASCII ranges come first because they settle most characters.
    kept = F.regexp_replace(F.lower(text), r"(?U)[^a-z0-9_ \p{L}\p{N}\s\x1c-\x1f]+", "")
    return strip(single_spaced(kept))


def single_spaced(text: Column) -> Column:
    """Runs of white space as one space each; single spaces are not touched."""
    return F.regexp_replace(text, rf"(?U)[\s\x1c-\x1f&&[^ ]]{SPACE}*| {SPACE}+", " ")


def ascii_lower(text: Column) -> Column:
    """Drop non-ASCII characters and lower; ends are left as they are."""
    return F.lower(F.regexp_replace(text, r"[^\x00-\x7F]+", ""))


def first_line(text: Column) -> Column:
    """The first line of a text, stripped."""
    return strip(F.substring_index(text, "\n", 1))


def answer_type(length: Column, q1: Column, q2: Column) -> Column:
    """``short`` up to q1, ``medium`` up to q2, ``long`` above."""
    return F.when(length <= q1, "short").when(length <= q2, "medium").otherwise("long")


def encode_audio(payload: Column) -> Column:
    """Base64 on a single line (Spark's own output breaks every 76 characters)."""
    return F.regexp_replace(F.base64(payload), r"[\r\n]", "")


def decode_audio(payload: Column) -> Column:
    return F.unbase64(payload)
