"""Short licence notices in texts: exact seeds, then bounded-error matching around them."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import release_memory
from parley.session import spread

#: Between words: every ASCII character but 0-9 and a-z (A-Z is lower-cased before).
BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Surroundings of seeds whose matches a task remembers; when full, the memory starts anew.
REMEMBERED = 1 << 16

SPANS = "array<struct<label:string,first_word:long,last_word:long,edits:int,share:double,base:boolean>>"


@dataclass(frozen=True)
class Notice:
    """Words of a notice, in brackets those that must be there as they are; and the edits allowed in the rest.

    Words are in lower case with one space between them. ``base`` notices are
    also reported by ``base_spans``, where they stand without an edit.
    """

    text: str
    label: str
    edits: int = 0
    base: bool = False

    @property
    def phrase(self) -> str:
        return re.sub(r"[\[\]]", "", self.text)


# Notices and their labels.
BASE = (
    Notice("under the [mit] license", "mit", 2, True),
    Notice("apache license version [2]", "apache-2", 3, True),
    Notice("[cc by nc]", "cc-by-nc", 0, True),
)
NOTICES = (
    *BASE,
    Notice("[mit] license", "mit", 1),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 8),
    Notice("licensed under the [apache] license", "apache-2", 3),
    Notice("spdx license identifier [mit]", "mit", 2),
    Notice("spdx license identifier [apache 2]", "apache-2", 2),
    Notice("creative commons attribution noncommercial", "cc-by-nc", 4),
    Notice("creative commons attribution sharealike", "cc-by-sa", 4),
    Notice("[cc by sa]", "cc-by-sa", 0),
    Notice("redistribution and use in source and binary forms", "bsd", 6),
    Notice("[gnu] general public license", "gpl", 3),
    Notice("[gnu] lesser general public license", "lgpl", 3),
    Notice("[mozilla] public license", "mpl", 2),
    Notice("all rights reserved", "all-rights-reserved", 2),
)


@dataclass
class Search:
    """A notice with its seeds (offset and exact piece) and its pattern."""

    notice: Notice
    seeds: list[tuple[int, str]]
    pattern: regex.Pattern
    memory: dict[str, list[tuple[int, int, int]]] = field(default_factory=dict)


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of the phrase with borders: one of them is whole in every match.

    The borders are the spaces around a match, which stand for themselves.
    """
    whole = f" {phrase} "
    n = edits + 1
    cuts = [len(whole) * i // n for i in range(n + 1)]
    return [(a, whole[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def pattern_of(notice: Notice) -> str:
    """The notice between two spaces, with at most ``edits`` edits outside of its brackets."""
    if not notice.edits:
        return f"(?<= )(?:{regex.escape(notice.phrase)})(?= )"
    parts = [x for x in re.split(r"(\[[^\]]*\])", notice.text) if x]
    if len(parts) == 1:
        return f"(?<= )(?:{regex.escape(notice.phrase)}){{e<={notice.edits}}}(?= )"
    # Edits are shared among the parts; each way to share them is a branch.
    loose = [x for x in parts if not x.startswith("[")]

    def ways(n: int, left: int) -> Iterator[tuple[int, ...]]:
        if n == 1:
            yield (left,)
            return
        for e in range(left + 1):
            for rest in ways(n - 1, left - e):
                yield (e, *rest)

    branches = []
    for way in ways(len(loose), notice.edits):
        own = iter(way)
        branch = ""
        for x in parts:
            if x.startswith("["):
                branch += regex.escape(x[1:-1])
            else:
                inner = regex.escape(x.strip())
                spaced = (" " if x.startswith(" ") else "", " " if x.endswith(" ") else "")
                most = next(own)
                bound = f"{{e<={most}}}" if most else ""
                branch += f"{spaced[0]}(?:{inner}){bound}{spaced[1]}"
        branches.append(branch)
    return f"(?<= )(?:{'|'.join(branches)})(?= )"


class Scanner:
    """All notices behind one automaton of their seeds."""

    def __init__(self, notices: tuple[Notice, ...]):
        self.searches = [
            Search(n, pieces(n.phrase, n.edits), regex.compile(pattern_of(n), regex.BESTMATCH)) for n in notices
        ]
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for i, search in enumerate(self.searches):
            for offset, piece in search.seeds:
                found.setdefault(piece, []).append((i, offset))
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """Notice, start, end and edits of the matches in a normalised text, by notice and start.

        Around each seed the match with the fewest edits counts. Of overlapping
        matches of a notice the one with the fewest edits stays, the earlier of
        equal ones; matches without an edit all stay.
        """
        if not self.searches:
            return []
        around: dict[tuple[int, int], None] = {}
        for end, (length, uses) in self.automaton.iter(text):
            for i, offset in uses:
                around[(i, end + 1 - length - offset)] = None
        matches: set[tuple[int, int, int, int]] = set()
        for i, at in around:
            search = self.searches[i]
            phrase, edits = search.notice.phrase, search.notice.edits
            # ``at`` is where the space before the phrase would be without an edit before the seed.
            if text.startswith(f" {phrase} ", at):
                matches.add((i, at + 1, at + 1 + len(phrase), 0))
                continue
            if not edits:
                continue
            low = max(0, at - edits)
            window = text[low : at + len(phrase) + 2 + edits]
            near = search.memory.get(window)
            if near is None:
                if len(search.memory) > REMEMBERED:
                    search.memory.clear()
                m = search.pattern.search(window)
                near = search.memory[window] = [(m.start(), m.end(), sum(m.fuzzy_counts))] if m else []
            for a, b, e in near:
                matches.add((i, low + a, low + b, e))
        return settled(matches)


def settled(matches: set[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Matches in order; of those that overlap and need an edit only the best."""
    out: list[tuple[int, int, int, int]] = []
    for m in sorted(matches):
        while out and out[-1][0] == m[0] and m[1] < out[-1][2] and m[3] < out[-1][3]:
            out.pop()
        if m[3] and out and out[-1][0] == m[0] and m[1] < out[-1][2]:
            continue
        out.append(m)
    return out


def normalised(text: str | None) -> str:
    """Words with one space between them and at both ends; a single space if there is none."""
    lower = (text or "").encode().lower().decode()  # of bytes, only A-Z
    return " " + BETWEEN.sub(" ", lower).strip(" ") + " "


def notices_in(text: Column, notices: tuple[Notice, ...] = NOTICES) -> Column:
    """Struct of ``n_words`` and ``spans`` of whole texts."""

    @F.pandas_udf(f"n_words long, spans {SPANS}")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(notices)
        for batch in batches:
            counts, found = [], []
            for text in batch:
                words = normalised(text)
                counts.append(words.count(" ") - 1 if len(words) > 2 else 0)
                matches = scanner.spans(words)
                starts = [m.start() for m in re.finditer(" ", words)] if matches else []
                rows = []
                for i, a, b, e in matches:
                    n = scanner.searches[i].notice
                    first, last = bisect_right(starts, a - 1) - 1, bisect_right(starts, b - 1) - 1
                    share = 1 - e / len(n.phrase)
                    rows.append((n.label, first, last, e, share, n.base and not e))
                found.append(rows)
            yield pd.DataFrame({"n_words": counts, "spans": found})
        release_memory()

    return run(text)


def scan(
    docs: DataFrame,
    notices: tuple[Notice, ...] = NOTICES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, ``n_words`` and ``spans`` (label, first and last word, edits, share, base).

    A notice with k edits is split into k + 1 pieces. Wherever it stands with at
    most k edits, one piece stands exactly, so an automaton of all pieces finds
    every place worth a look. The surroundings of a seed are matched with at most
    k edits outside of the words that must be as they are; ``share`` is one less
    the edits' share of the notice. ``base`` marks base notices without an edit.

    Defined cases: null, empty and wordless texts have no words and no spans; a
    notice begins and ends with whole words; equal notices overlap freely where
    they need no edit, else the fewest edits win; rows repeat as they come; an
    empty table, and no notices, give rows without spans. Other columns are not
    read.
    """
    rows = spread(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    found = rows.select(F.col("_id").alias(id_col), notices_in(F.col("_text"), notices).alias("_found"))
    return found.select(id_col, "_found.n_words", "_found.spans")


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``scan`` the counts and places of base notices, labels and the best share.

    Without a base notice ``n_base`` is 0 and the places are null; without a
    label the lists are empty strings and ``score`` is 0.
    """
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["first_word"])

    def labels(spans: Column | str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return found.select(
        id_col,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )
