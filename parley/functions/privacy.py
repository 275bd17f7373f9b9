"""Detection and masking of personal data by pattern.

Entities are masked one type at a time in the order of ``ENTITIES``; each
match becomes ``<ENTITY_TYPE>``, so a later pattern cannot match inside an
earlier one's replacement. Patterns use no look-around and no Unicode classes.
Names and places need a model; plug one in with ``operators.models`` and mask what
it found with ``mask_spans``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, in masking order.
ENTITIES = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "URL": r"(?:https?|ftp)://[^\s<>]+",
    "CREDIT_CARD": r"\b[3-6][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{3,4}\b",
    "IBAN_CODE": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "US_SSN": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "IP_ADDRESS": (
        r"\b(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        r"(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}\b"
    ),
    "PHONE_NUMBER": (
        r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b"
    ),
}
# What a text must contain before a pattern is worth running. Each is part of
# every match of its pattern, so skipping a text without it changes nothing.
HINTS = {
    "EMAIL_ADDRESS": "@",
    "URL": "://",
    "CREDIT_CARD": r"[3-6][0-9]{3}[ -]?[0-9]{4}",
    "IBAN_CODE": r"[A-Z]{2}[0-9]{2}",
    "US_SSN": r"[0-9]-[0-9]{2}-[0-9]",
    "IP_ADDRESS": r"[0-9]\.[0-9]{1,3}\.[0-9]",
    "PHONE_NUMBER": r"[0-9]{3}[ .-][0-9]{4}",
}


def passes_luhn(card: Column) -> Column:
    """Check digit test of a card number written with spaces or dashes."""
    digits = F.reverse(F.regexp_replace(card, "[ -]", ""))
    numbers = F.transform(F.split(digits, ""), lambda d: d.cast("int"))

    def weighed(digit: Column, place: Column) -> Column:
        double = digit * 2
        doubled = F.when(double > 9, double - 9).otherwise(double)
        return F.when(place % 2 == 1, doubled).otherwise(digit)

    total = F.aggregate(F.transform(numbers, weighed), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def hinted(text: Column, entity: str) -> Column:
    """Whether a text can contain an entity at all: a cheap look first."""
    return text.rlike(HINTS[entity])


def found(text: Column, entity: str) -> Column:
    """The matches of one entity type in a text, in order."""
    matches = F.regexp_extract_all(text, F.lit(f"({ENTITIES[entity]})"))
    return F.filter(matches, passes_luhn) if entity == "CREDIT_CARD" else matches


def count_found(text: Column, entity: str) -> Column:
    """Number of matches of one entity type in a text."""
    if entity == "CREDIT_CARD":
        count = F.size(found(text, entity))
    else:
        count = F.regexp_count(text, F.lit(ENTITIES[entity]))
    return F.when(hinted(text, entity), count).otherwise(0)


def mask_entity(text: Column, entity: str) -> Column:
    mark = f"<{entity}>"
    if entity == "CREDIT_CARD":
        masked = _masked_cards(text, mark)
    else:
        masked = F.regexp_replace(text, ENTITIES[entity], mark)
    return F.when(hinted(text, entity), masked).otherwise(text)


def _masked_cards(text: Column, mark: str) -> Column:
    """Only some matches are replaced, so the text is rebuilt from its pieces."""
    pattern = ENTITIES["CREDIT_CARD"]
    masked = F.transform(
        F.regexp_extract_all(text, F.lit(f"({pattern})")),
        lambda m: F.when(passes_luhn(m), mark).otherwise(m),
    )
    return F.array_join(
        F.zip_with(
            F.split(text, pattern),
            masked,
            lambda piece, m: F.concat(piece, F.coalesce(m, F.lit(""))),
        ),
        "",
    )


def mask_pii(text: Column, entities: list[str] | None = None) -> Column:
    """``text`` with every entity replaced by its type in angle brackets."""
    for entity in entities or ENTITIES:
        text = _bound(text, entity)
    return text


def _bound(text: Column, entity: str) -> Column:
    """``mask_entity`` on a text that may be a long expression by now.

    The one-element array binds its value, which is used several times.
    """
    return F.transform(F.array(text), lambda t: mask_entity(t, entity))[0]


# -- given spans -----------------------------------------------------------

SPANS = "array<struct<start: int, end: int, entity: string>>"
UNNAMED = "MASKED"


def settled_spans(spans: Column, length: Column, best: str = "length") -> Column:
    """Spans without overlaps, in order, that cover what the given ones cover.

    ``spans`` is an array of ``struct<start, end, entity, score>``; places count
    characters from 0 and ``end`` is exclusive. The longest span comes first, or
    with ``best="score"`` the one with the highest score; then the other of the two,
    the start and the name of the entity decide. A later span keeps what no earlier
    one covers: nothing if it lies inside one, one end if they overlap, and two
    pieces if a better span lies inside it. Spans are cut to the text; empty ones and
    those without a start or an end go. A missing score is 0.

    Each span meets those already kept, so the work grows with the square of the
    spans of one text.
    """
    if best not in ("length", "score"):
        raise ValueError(f"best is length or score, not {best}")

    def ranked(span: Column) -> Column:
        start = F.greatest(span["start"].cast("int"), F.lit(0))
        end = F.least(span["end"].cast("int"), length)
        ranks = [start - end, -F.coalesce(span["score"].cast("double"), F.lit(0.0))]
        first, second = ranks if best == "length" else reversed(ranks)
        return F.struct(
            first.alias("first"),
            second.alias("second"),
            start.alias("start"),
            end.alias("end"),
            F.coalesce(span["entity"], F.lit(UNNAMED)).alias("entity"),
        )

    def uncovered(span: Column, over: Column) -> Column:
        starts = F.concat(F.array(span["start"]), F.transform(over, lambda k: k["end"]))
        ends = F.concat(F.transform(over, lambda k: k["start"]), F.array(span["end"]))
        gaps = F.zip_with(
            starts,
            ends,
            lambda a, b: F.struct(a.alias("start"), b.alias("end"), span["entity"].alias("entity")),
        )
        return F.filter(gaps, lambda g: g["start"] < g["end"])

    def add(kept: Column, span: Column) -> Column:
        over = F.array_sort(
            F.filter(kept, lambda k: (k["start"] < span["end"]) & (k["end"] > span["start"]))
        )
        return F.concat(kept, F.flatten(F.transform(F.array(over), lambda o: uncovered(span, o))))

    given = F.filter(spans, lambda s: s["start"].isNotNull() & s["end"].isNotNull())
    some = F.filter(F.transform(given, ranked), lambda s: s["start"] < s["end"])
    return F.array_sort(F.aggregate(F.array_sort(some), F.array().cast(SPANS), add))


def mask_spans(text: Column, spans: Column, best: str = "length") -> Column:
    """``text`` with each settled span (see ``settled_spans``) replaced by its entity.

    The spans come from elsewhere: a model, a list, people. Without spans the text
    stays; a null text stays null.
    """

    def rebuilt(given: Column, settled: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(settled, lambda s: s["end"]))
        starts = F.concat(F.transform(settled, lambda s: s["start"]), F.array(F.length(given)))
        between = F.zip_with(ends, starts, lambda a, b: F.substr(given, a + 1, b - a))
        marks = F.transform(settled, lambda s: F.concat(F.lit("<"), s["entity"], F.lit(">")))
        pieces = F.zip_with(between, marks, lambda t, m: F.concat(t, F.coalesce(m, F.lit(""))))
        return F.array_join(pieces, "")

    def masked(pair: Column) -> Column:
        settled = settled_spans(pair["spans"], F.length(pair["text"]), best)
        return F.transform(F.array(settled), lambda s: rebuilt(pair["text"], s))[0]

    # One-element arrays bind values that are used several times, as in ``_bound``.
    pair = F.array(F.struct(text.alias("text"), spans.alias("spans")))
    given = F.transform(
        pair,
        lambda p: F.when(p["text"].isNotNull() & (F.size(p["spans"]) > 0), masked(p)).otherwise(p["text"]),
    )
    return given[0]
