"""Language-model scores of texts: a unigram base and a hidden Markov model.

Rounds: shards send their distinct tokens with training counts to buckets;
buckets answer with the counts over all texts; shards turn texts into sequences
of token classes. Baum-Welch then sums expected counts over partitions, and a
scaled forward pass over each whole text gives its exact likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.blocks import (
    bucket_slices,
    lowered,
    pieces,
    prefix_sums,
    range_hashes,
    shares,
    text_blocks,
    unpacked,
    word_ranges,
)
from parley.session import pinned

#: Bands of token frequency (by powers of two of the count) times parts by hash.
BANDS, PARTS = 44, 256
#: Classes: bands times parts, one for tokens never seen in training, one for the end.
UNSEEN, END = BANDS * PARTS, BANDS * PARTS + 1
CLASSES = END + 1
#: Key of the end token; no word has it but by chance of 2^-64.
END_KEY = np.uint64(0x5851F42D4C957F2D)
#: Tokens of whole texts that run side by side, or one text that is longer.
GROUP_TOKENS = 1 << 19
#: Probability that a state stays, before the first round.
STAYS = 0.97


def classes_of(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The class of a token, a function of its hash and its training count only."""
    band = np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), BANDS - 1)
    out = band * PARTS + (keys & np.uint64(PARTS - 1)).astype(np.int64)
    out[counts == 0] = UNSEEN
    out[keys == END_KEY] = END
    return out.astype(np.uint16)


def tokens(rows: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of token keys: first row, keys, and where each text's tokens start (and the end).

    A text's tokens are its words, A-Z lower-cased, and one end.
    """
    for first, data, bounds in text_blocks(rows):
        data = lowered(data)
        starts, ends, before = word_ranges(data, bounds)
        hashes = range_hashes(prefix_sums(data), starts, ends)
        n = len(bounds) - 1
        keys = np.insert(hashes, before[1:], END_KEY)
        yield first, keys, before + np.arange(n + 1)


def shard_keys(rows: pa.Table, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shard's distinct keys, sorted, and their counts in training texts."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for first, block, bounds in tokens(rows):
        taught = np.repeat(train[first : first + len(bounds) - 1], np.diff(bounds))
        new, inverse = np.unique(block, return_inverse=True)
        n = np.bincount(inverse, weights=taught, minlength=len(new)).astype(np.int64)
        both, inverse = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)
        keys = both
    return keys, counts


def trained(rows: pa.Table, folds: int, left_out: int) -> np.ndarray:
    """Which texts teach: those whose crc32 of the id as text leaves another remainder."""
    import zlib

    crc = [zlib.crc32(("" if x is None else str(x)).encode()) % folds for x in rows.column("id").to_pylist()]
    return np.array(crc, np.int64) != left_out


def bytes_of(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def send_keys(shards: DataFrame, buckets: int, folds: int, left_out: int) -> DataFrame:
    """Rows (bucket, shard, keys, counts), one for every bucket of every shard."""

    def run(table: pa.Table) -> pa.Table:
        rows = unpacked(table)
        keys, counts = shard_keys(rows, trained(rows, folds, left_out))
        shard = table.column("shard")[0].as_py()
        cuts = bucket_slices(keys, buckets)
        return pa.table(
            {
                "bucket": pa.array(range(buckets), pa.int32()),
                "shard": pa.array([shard] * buckets, pa.int32()),
                "keys": pa.array([bytes_of(keys[a:b]) for a, b in cuts], pa.binary()),
                "counts": pa.array([bytes_of(counts[a:b].astype(np.uint32)) for a, b in cuts], pa.binary()),
            }
        )

    return shards.groupBy("shard").applyInArrow(run, "bucket int, shard int, keys binary, counts binary")


def sum_counts(sent: DataFrame) -> DataFrame:
    """Answers (shard, bucket, counts), and per bucket one row of sums by class.

    The row of sums has no shard: the classes of the bucket's tokens, the sum of
    their counts and their number.
    """

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")]
        counts = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")]
        keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(
            inverse, weights=np.concatenate(counts).astype(np.float64), minlength=len(keys)
        ).astype(np.int64)
        ends = np.cumsum([len(p) for p in parts])
        kind = classes_of(keys, total)
        known = total > 0
        mass = np.bincount(kind[known], weights=total[known], minlength=CLASSES).astype(np.int64)
        types = np.bincount(kind[known], minlength=CLASSES)
        used = np.flatnonzero(types)
        n = len(parts)
        answers = [bytes_of(total[inverse[e - len(p) : e]]) for p, e in zip(parts, ends, strict=True)]
        return pa.table(
            {
                "shard": pa.array([*table.column("shard").to_pylist(), None], pa.int32()),
                "bucket": pa.array([*table.column("bucket").to_pylist(), None], pa.int32()),
                "counts": pa.array([*answers, None], pa.binary()),
                "kinds": pa.array([None] * n + [used.tolist()], pa.list_(pa.int32())),
                "mass": pa.array([None] * n + [mass[used].tolist()], pa.list_(pa.int64())),
                "types": pa.array([None] * n + [types[used].tolist()], pa.list_(pa.int64())),
            }
        )

    return sent.groupBy("bucket").applyInArrow(
        run,
        "shard int, bucket int, counts binary, kinds array<int>, mass array<long>, types array<long>",
    )


@dataclass
class Corpus:
    """Training tokens, distinct ones, and per class their counts and their number."""

    n: int
    v: int
    mass: np.ndarray
    types: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        """Per class the sum of count + 1; the one unseen token has count 0."""
        out = (self.mass + self.types).astype(float)
        out[UNSEEN] += 1
        return out

    @property
    def shares(self) -> np.ndarray:
        """Class shares to start and to smooth with; unseen tokens get the share of single ones."""
        out = self.weights + 1e-3
        out[UNSEEN] += self.mass[:PARTS].sum()
        return out / out.sum()


def corpus_of(answers: DataFrame) -> Corpus:
    sums = (
        answers.where("shard is null")
        .select(F.explode(F.arrays_zip("kinds", "mass", "types")).alias("x"))
        .groupBy("x.kinds")
        .agg(F.sum("x.mass").alias("mass"), F.sum("x.types").alias("types"))
        .collect()
    )
    mass, types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in sums:
        mass[r["kinds"]], types[r["kinds"]] = r["mass"], r["types"]
    return Corpus(int(mass.sum()), int(types.sum()), mass, types)


def code_texts(
    shards: DataFrame, answers: DataFrame, corpus: Corpus, kind: str, folds: int, left_out: int
) -> DataFrame:
    """Per text: counts, the base score, the log of its tokens' shares of their classes, and the classes."""
    weights = np.log10(np.maximum(corpus.weights, 1))
    whole = np.log10(corpus.n + corpus.v + 1)

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows = unpacked(table)
        train = trained(rows, folds, left_out)
        keys, _ = shard_keys(rows, train)
        order = np.argsort(replies.column("bucket").to_numpy())
        got = replies.column("counts")
        counts = np.concatenate([np.frombuffer(got[int(i)].as_py(), np.int64) for i in order])
        if len(counts) != len(keys):
            raise ValueError("the shard's answers do not fit its tokens")
        logs = np.log10(counts + 1)
        kinds = classes_of(keys, counts)
        n_tokens, n_known, base, inside, coded = [], [], [], [], []
        for _, block, bounds in tokens(rows):
            place = np.searchsorted(keys, block)
            log, kind_of = logs[place], kinds[place]
            n = np.diff(bounds)
            n_tokens.append(n)
            n_known.append(np.add.reduceat(counts[place] > 0, bounds[:-1], dtype=np.int64))
            base.append(np.add.reduceat(log, bounds[:-1]) - n * whole)
            inside.append(np.add.reduceat(log - weights[kind_of], bounds[:-1]))
            coded += [bytes_of(kind_of[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.table(
            {
                "id": rows.column("id"),
                "train": pa.array(train),
                "n_tokens": pa.array(np.concatenate(n_tokens), pa.int64()),
                "n_known": pa.array(np.concatenate(n_known), pa.int64()),
                "base_score": pa.array(np.concatenate(base), pa.float64()),
                "inside": pa.array(np.concatenate(inside), pa.float64()),
                "coded": pa.array(coded, pa.binary()),
            }
        )

    wanted = answers.where("shard is not null").select("shard", "bucket", "counts")
    return (
        shards.groupBy("shard")
        .cogroup(wanted.groupBy("shard"))
        .applyInArrow(
            run,
            f"id {kind}, train boolean, n_tokens long, n_known long, base_score double, "
            "inside double, coded binary",
        )
    )


@dataclass
class Markov:
    """Start, step and emission probabilities; ``emit`` has a row per class."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @classmethod
    def first(cls, corpus: Corpus, states: int) -> Markov:
        """Near the class shares of the corpus, each state leaning another way by fixed numbers.

        States mostly stay, so that a text as a whole leans to one of them.
        """
        random = np.random.default_rng(7)
        emit = corpus.shares[:, None] * random.uniform(0.5, 1.5, (CLASSES, states))
        step = np.full((states, states), (1 - STAYS) / max(1, states - 1))
        np.fill_diagonal(step, STAYS if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), step, emit / emit.sum(0))

    def next(self, sums: np.ndarray, corpus: Corpus) -> Markov:
        """From expected counts (start, step, emit and two more in one row), smoothed by the shares of the corpus.

        Training texts have no unseen tokens; a state expects as many as tokens seen once.
        """
        k = len(self.start)
        start = sums[:k] + 1e-2
        step = sums[k : k + k * k].reshape(k, k) + 1e-2
        emit = sums[k + k * k : -2].reshape(CLASSES, k) + corpus.shares[:, None]
        emit[UNSEEN] += emit[:PARTS].sum(0)
        return Markov(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


@dataclass
class Lanes:
    """Texts side by side, longest first: the tokens of all at place 0, then at place 1, ..."""

    tokens: np.ndarray
    row: np.ndarray
    alive: np.ndarray

    @classmethod
    def of(cls, texts: list[np.ndarray]) -> Lanes:
        lengths = np.array([len(x) for x in texts], np.int64)
        row = np.repeat(np.arange(len(texts)), lengths)
        place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        to = (np.cumsum(alive) - alive)[place] + row
        tokens, rows = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
        tokens[to], rows[to] = np.concatenate(texts), row
        return cls(tokens, rows, alive)


def forward(model: Markov, lanes: Lanes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emissions, scaled forward values and scales of every token."""
    given = model.emit[lanes.tokens]
    ahead, scale = np.empty_like(given), np.empty(len(given))
    at = last = 0
    for n in lanes.alive.tolist():
        here = slice(at, at + n)
        moved = ahead[last : last + n] @ model.step if at else model.start
        value = given[here] * moved
        size = value.sum(1)
        scale[here] = size
        np.divide(value, size[:, None], out=ahead[here])
        at, last = at + n, at
    return given, ahead, scale


def expected(model: Markov, lanes: Lanes) -> np.ndarray:
    """Expected starts, steps and emissions, the log likelihood and the tokens, in one row."""
    given, ahead, scale = forward(model, lanes)
    k = len(model.start)
    given /= scale[:, None]
    state = np.empty_like(ahead)
    turned = np.ascontiguousarray(model.step.T)
    at = len(given)
    back = np.ones((0, k))
    for n in lanes.alive[::-1].tolist():
        at -= n
        here = slice(at, at + n)
        if len(back) < n:
            back = np.concatenate([back, np.ones((n - len(back), k))])
        np.multiply(ahead[here], back, out=state[here])
        given[here] *= back
        back = given[here] @ turned
    first = int(lanes.alive[0])
    before = np.arange(first, len(given)) - np.repeat(lanes.alive[:-1], lanes.alive[1:])
    steps = (ahead[before].T @ given[first:]) * model.step
    by_token = np.stack(
        [np.bincount(lanes.tokens, weights=state[:, i], minlength=CLASSES) for i in range(k)], 1
    )
    tail = [np.log(scale).sum(), float(len(given))]
    return np.concatenate([state[:first].sum(0), steps.reshape(-1), by_token.reshape(-1), tail])


def groups(texts: list[np.ndarray]) -> Iterator[list[int]]:
    """Places of texts in groups of about as many tokens, longest first."""
    group: list[int] = []
    size = 0
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        if group and size + len(texts[i]) > GROUP_TOKENS:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(texts[i])
    if group:
        yield group


def classes_in(coded: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint16) for x in coded]


def baum_welch(coded: DataFrame, model: Markov, corpus: Corpus) -> tuple[Markov, float]:
    """One round over all training texts, and the likelihood of a token before it.

    Partitions add up, the sums reach the driver.
    """
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            texts = classes_in(batch.column(0))
            for group in groups(texts):
                sums = expected(shared.value, Lanes.of([texts[i] for i in group]))
                total = sums if total is None else total + sums
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array(total[used])], ["place", "value"]
            )

    sums = (
        coded.where("train")
        .select("coded")
        .mapInArrow(run, "place int, value double")
        .groupBy("place")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    k = len(model.start)
    values = np.zeros(k + k * k + CLASSES * k + 2)
    for r in sums:
        values[r["place"]] = r["value"]
    return model.next(values, corpus), values[-2] / max(values[-1], 1)


def log_likelihoods(model: Markov, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihoods of whole class sequences by the scaled forward recursion."""
    out = np.zeros(len(texts))
    for group in groups(texts):
        lanes = Lanes.of([texts[i] for i in group])
        scale = forward(model, lanes)[2]
        out[group] = np.bincount(lanes.row, weights=np.log(scale), minlength=len(group))
    return out


def score_texts(
    docs: DataFrame,
    folds: int = 7,
    left_out: int = 2,
    states: int = 4,
    rounds: int = 20,
    tolerance: float = 0.05,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score``.

    All texts are scored; those whose crc32 of the id modulo ``folds`` is not
    ``left_out`` teach. The base is the sum of log10((c + 1) / (N + V + 1)). The
    model is a hidden Markov model over token classes (frequency band and hash),
    trained by Baum-Welch over all training texts, each whole, until a round has gained
    no more than ``tolerance`` nats a token, with ``rounds`` as the most; within a class a token has the share (c + 1) / sum of (c + 1). So
    the model's size is fixed and every token, seen or not, has a probability.
    ``score`` is log10 of the probability of the whole text. Tokens are known by a
    64-bit hash.

    Defined cases: a null text is empty and has the end as its only token; a null
    id counts as empty text; rows that repeat an id are scored apart; without
    training texts all tokens are unseen; an empty table gives an empty result.
    Other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    count, buckets = shares(docs, text_col)
    shards = pieces(docs, count, id_col, text_col)
    answers = pinned(sum_counts(send_keys(shards, buckets, folds, left_out)))
    corpus = corpus_of(answers)
    coded = pinned(code_texts(shards, answers, corpus, kind, folds, left_out))
    model = Markov.first(corpus, states)
    reached = -np.inf
    for _ in range(rounds):
        model, likelihood = baum_welch(coded, model, corpus)
        if likelihood - reached <= tolerance:
            break
        reached = likelihood
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = log_likelihoods(shared.value, classes_in(batch.column(1)))
            scores = logs / np.log(10) + batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(~np.array(batch.column(3))), *batch.columns[4:], pa.array(scores)],
                ["id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    scored = coded.select("id", "coded", "inside", "train", "n_tokens", "n_known", "base_score").mapInArrow(
        run, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(corpus.n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
