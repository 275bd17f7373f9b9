"""Language identification: words first, shorter and shorter character n-grams for unseen ones."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import release_memory
from parley.session import pinned

LETTERS = r"\p{L}+"
#: n-grams of a word with its two borders marked, longest first.
ORDERS = (4, 3, 2, 1)
BORDERS = (2, 3)
#: Parts of the hash of an id by which rows are sampled.
PLACES = 1 << 40
#: Characters of text that are worked on at a time; a longer text is cut between words.
BLOCK_LETTERS = 1 << 19

#: Share of the probability that names a language does not have get together.
UNSEEN = 0.01

# Odd factors that spread bits; their values don't matter.
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


@dataclass
class Scores:
    """Log frequencies of names; only those above the one all absent names share are stored.

    The name with the sorted key ``keys[i]`` has ``values`` above ``floor`` in the
    languages ``columns`` at ``starts[i]`` to ``starts[i + 1]``.
    """

    keys: np.ndarray
    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    floor: float

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for those that are not known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def means(self, places: np.ndarray, owners: np.ndarray, count: int, languages: int) -> np.ndarray:
        """Mean log frequencies per owner of the names at ``places``; owners without names get the floor."""
        sizes = self.starts[places + 1] - self.starts[places]
        entries = np.repeat(self.starts[places], sizes) + ranks(sizes)
        cells = np.repeat(owners, sizes) * languages + self.columns[entries]
        sums = np.bincount(cells, self.values[entries], minlength=count * languages)
        names = np.maximum(np.bincount(owners, minlength=count), 1)
        return self.floor + sums.reshape(count, languages) / names[:, None]


@dataclass
class Model:
    """Per language log frequencies of words and of n-grams."""

    languages: list[str]
    prior: np.ndarray
    words: Scores
    grams: Scores

    def score(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Scores of words: known ones by themselves, else the mean over n-grams of the longest known order."""
        languages = len(self.languages)
        place = self.words.find(keys)
        out = np.zeros((len(place), languages))
        known = np.flatnonzero(place >= 0)
        if len(known):
            out[known] = self.words.means(place[known], np.arange(len(known)), len(known), languages)
        left = np.flatnonzero(place < 0)
        for n in ORDERS:
            if not len(left):
                break
            names, owners = gram_keys(codes, starts[left], ends[left], n)
            place = self.grams.find(names)
            place, owners = place[place >= 0], owners[place >= 0]
            some = np.bincount(owners, minlength=len(left)) > 0
            means = self.grams.means(place, owners, len(left), languages)
            out[left[some]] = means[some]
            left = left[~some]
        return out


def ranks(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size in turn."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


@cache
def is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def letter_runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters."""
    edge = np.diff(np.concatenate([[0], is_letter()[codes].view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_keys(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its spread code points.

    All words at once by one running sum: of the terms code * odd ** place, a
    word's are shifted to the start by the inverse power.
    """
    if not len(codes):
        return np.zeros(0, np.uint64)
    x = codes.astype(np.uint64) * _SPREAD[0]
    x ^= x >> np.uint64(29)
    x *= _SPREAD[1]
    x ^= x >> np.uint64(32)
    factor = int(_SPREAD[2])
    power = np.full(len(x) + 1, factor, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[:-1])])
    back = np.full(len(x) + 1, pow(factor, -1, 1 << 64), np.uint64)
    back[0] = 1
    key = (sums[ends] - sums[starts]) * np.cumprod(back)[starts]
    return key ^ (key >> np.uint64(31))


def gram_keys(
    codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int
) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of words with their borders as 16 bits a character, and their words.

    Code points beyond 16 bits are folded, so rare scripts may share keys there.
    """
    sizes = ends - starts + 2
    place = ranks(sizes)
    at = np.repeat(starts, sizes) + place - 1
    x = codes[np.clip(at, 0, max(0, len(codes) - 1))].astype(np.uint64)
    x = (x ^ ((x >> np.uint64(16)) * np.uint64(40503))) & np.uint64(0xFFFF)
    x[place == 0] = BORDERS[0]
    x[np.repeat(sizes, sizes) - 1 == place] = BORDERS[1]
    whole = np.flatnonzero(np.repeat(sizes, sizes) - place >= n)
    key = np.zeros(len(whole), np.uint64)
    for i in range(n):
        key = (key << np.uint64(16)) | x[whole + i]
    return key, np.repeat(np.arange(len(sizes)), sizes)[whole]


def log_frequencies(counts: pa.Table, totals: dict[int, int], languages: int) -> Scores:
    """Counts (lang, name, n) of whole numbers as log frequencies."""
    names = counts.column("name").to_numpy().view(np.uint64)
    order = np.argsort(names, kind="stable")
    keys, starts = np.unique(names[order], return_index=True)
    columns = counts.column("lang").to_numpy()[order].astype(np.int32)
    whole = np.array([max(1, totals.get(x, 0)) for x in range(languages)], dtype=float)
    absent = UNSEEN / max(1, len(keys))
    shares = counts.column("n").to_numpy()[order] / whole[columns]
    values = np.log((1 - UNSEEN) * shares + absent) - np.log(absent)
    return Scores(keys, np.append(starts, len(names)), columns, values.astype(np.float32), float(np.log(absent)))


def learn(
    docs: DataFrame,
    train: Column,
    sample_rows: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model | None:
    """A model of the rows where ``train`` holds and text and language are not null.

    Rows are counted per language over all data. A language is fitted on all its
    rows, or if it has more, on about ``sample_rows`` of them chosen by a hash of
    the id, of which there is always one; so every language is learned, however
    rare. Every word and n-gram of the sampled rows is known, words of any length;
    their number is bounded by the rows. Words are known by a 64-bit hash, n-grams
    by their characters; the driver gets whole numbers alone. How frequent a language is comes from the counts of all rows. None
    without such rows.
    """
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    place = F.pmod(F.xxhash64(id_col), F.lit(PLACES))
    found = rows.groupBy(F.col(lang_col).alias("lang")).agg(
        F.count("*").alias("n"), F.min(place).alias("first")
    )
    count = {r["lang"]: (r["n"], r["first"]) for r in found.collect()}
    if not count:
        return None
    languages = sorted(count)
    below = [max(count[x][1] + 1, -(-sample_rows * PLACES // count[x][0])) for x in languages]
    limits = F.create_map(
        *[x for lang, n in zip(languages, below, strict=True) for x in (F.lit(lang), F.lit(n).cast("long"))]
    )
    rows = rows.where(place < F.element_at(limits, F.col(lang_col)))
    words = pinned(
        rows.select(
            F.col(lang_col).alias("lang"),
            F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(LETTERS), F.lit(0))).alias("word"),
        )
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
    )
    grams = pinned(
        words.mapInArrow(grams_of, "lang string, kind int, name long, n long")
        .groupBy("lang", "kind", "name")
        .agg(F.sum("n").alias("n"))
    )
    hashed = words.mapInArrow(hashes_of, "lang string, kind int, name long, n long")
    total = sum(n for n, _ in count.values())
    return Model(
        languages,
        np.log([count[x][0] / total for x in languages]),
        known(hashed, languages),
        known(grams, languages),
    )


def joined(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words with a blank after each, their starts and ends."""
    codes = code_points(" ".join(words.to_pylist()) + " ")
    ends = np.flatnonzero(codes == 32)
    return codes, np.concatenate([[0], ends[:-1] + 1]), ends


def hashes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            name = pa.array(word_keys(*joined(batch.column("word"))).view(np.int64))
            kind = pa.array(np.zeros(len(batch), np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), kind, name, batch.column("n")], ["lang", "kind", "name", "n"]
            )


def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of words, each word counted once per language."""
    for batch in batches:
        if not len(batch):
            continue
        codes, starts, ends = joined(batch.column("word"))
        for n in ORDERS:
            keys, owners = gram_keys(codes, starts, ends, n)
            found = pa.table(
                {"lang": batch.column("lang").take(pa.array(owners)), "name": pa.array(keys.view(np.int64))}
            )
            found = found.group_by(["lang", "name"]).aggregate([([], "count_all")])
            found = found.append_column("kind", pa.array(np.full(len(found), n, np.int32)))
            found = found.append_column("n", found.column("count_all").cast(pa.int64()))
            yield from found.select(["lang", "kind", "name", "n"]).to_batches()


def known(counts: DataFrame, languages: list[str]) -> Scores:
    """Scores from the counts of all names, against the largest sum of a kind per language."""
    index = F.array_position(F.lit(languages), F.col("lang")).cast("int") - 1
    rows = pinned(counts.select(index.alias("lang"), "kind", "name", "n"))
    totals: dict[int, int] = {}
    for r in rows.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect():
        totals[r["lang"]] = max(r["n"], totals.get(r["lang"], 0))
    return log_frequencies(rows.select("lang", "name", "n").toArrow(), totals, len(languages))


def blocks(texts: pd.Series) -> Iterator[tuple[list[str], list[int]]]:
    """Pieces of texts, of about ``BLOCK_LETTERS`` characters together, and the texts' numbers.

    A longer text is cut after a character that is no letter.
    """
    held: list[str] = []
    owners: list[int] = []
    size = 0
    gap = re.compile(r"[\W\d_]")
    for i, text in enumerate(texts):
        text = (text or "").lower()
        at = 0
        while at < len(text):
            to = at + BLOCK_LETTERS
            cut = gap.search(text, to) if to < len(text) else None
            piece = text[at : cut.end() if cut else len(text)]
            at += len(piece)
            held.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= BLOCK_LETTERS:
                yield held, owners
                held, owners, size = [], [], 0
    if held:
        yield held, owners


def likelihoods(model: Model, texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Words and summed scores per language of whole texts."""
    languages = len(model.languages)
    words, sums = np.zeros(len(texts), np.int64), np.zeros((len(texts), languages))
    for held, owners in blocks(texts):
        codes = code_points(" ".join(held))
        starts, ends = letter_runs(codes)
        if not len(starts):
            continue
        begin = np.cumsum([0] + [len(x) + 1 for x in held[:-1]])
        piece = np.searchsorted(begin, starts, "right") - 1
        keys = word_keys(codes, starts, ends)
        _, first, kind = np.unique(keys, return_index=True, return_inverse=True)
        scores = model.score(codes, starts[first], ends[first], keys[first])
        own, at = np.unique(piece, return_index=True)
        text = np.array(owners)[own]
        np.add.at(sums, text, np.add.reduceat(scores[kind], at, axis=0))
        np.add.at(words, text, np.diff(np.append(at, len(piece))))
    return words, sums


def language_of(text: Column, model: Model | None) -> Column:
    """Struct of ``lang_pred`` and ``score`` for whole texts; nothing but the text decides."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            if own is None:
                yield pd.DataFrame({"lang_pred": ["und"] * len(batch), "score": [0.0] * len(batch)})
                continue
            words, total = likelihoods(own, batch)
            total += own.prior
            shares = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            names = np.array(own.languages, dtype=object)[total.argmax(axis=1)]
            names[words == 0] = "und"
            yield pd.DataFrame({"lang_pred": names, "score": np.where(words == 0, 0.0, shares)})
        release_memory()

    return run(text)


def predict(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, ``lang_pred`` and ``score``, its share of the likelihood.

    Defined cases: a text that is null or has no letter is ``und`` with score 0,
    and so is every text without a model; words without a known part say nothing,
    and the most frequent language wins ties; an empty table gives an empty
    result. Other columns are not read.
    """
    rows = docs.select(id_col, language_of(F.col(text_col), model).alias("_found"))
    return rows.select(id_col, "_found.lang_pred", "_found.score")
