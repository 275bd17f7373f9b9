"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import release_memory

#: Encoded pre-tokens that a worker remembers between its tasks; when full, the memory starts anew.
REMEMBERED = 3 << 17
#: Token ids in one batch of results.
BATCH_IDS = 1 << 20
#: Bits of the rank that choose within a word of the lower bitmap.
LOW, MASK = 8, 255


class Encoder:
    """Texts to token ids, each match of the pattern apart; remembers pre-tokens.

    The queue of a pre-token has a bucket per merge rank, which holds positions of
    the linked list of parts: none, one, or a heap that gives them from left to
    right. Bit r & 255 of ``bitmap[r >> 8]`` says that bucket r is not empty, bit w
    of ``top`` that ``bitmap[w]`` is not zero, so the lowest rank is two
    find-first-sets away. The queue is empty again after every pre-token.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED) -> None:
        self.ranks = ranks
        self.remembered = remembered
        self.find = regex.compile(pattern).findall
        size = max(ranks.values()) + 1
        self.bitmap = [0] * ((size >> LOW) + 1)
        self.buckets: list[int | list[int] | None] = [None] * size
        self.bits = [1 << i for i in range(max(MASK + 1, len(self.bitmap)))]
        self.pairs = [ranks.get(bytes((i >> 8, i & 255)), -1) for i in range(1 << 16)]
        self.memory: dict[str, tuple[int, ...]] = {}
        self.tokens = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token, by about n log n steps.

        An entry whose pair of neighbours has another rank by now is stale and is
        skipped. The pushes are written out: this is the inner loop of a corpus.
        """
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        rank_of, buckets, bitmap, bits, pairs = ranks.get, self.buckets, self.bitmap, self.bits, self.pairs
        n = len(piece)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        current = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
        current.append(-1)
        top = 0
        for i, rank in enumerate(current):
            if rank >= 0:
                held = buckets[rank]
                if held is None:
                    buckets[rank] = i
                    word = rank >> LOW
                    bitmap[word] |= bits[rank & MASK]
                    top |= bits[word]
                elif held.__class__ is int:
                    buckets[rank] = [held, i]
                else:
                    held.append(i)
        while top:
            word = (top & -top).bit_length() - 1
            low = bitmap[word] & -bitmap[word]
            rank = word << LOW | (low.bit_length() - 1)
            i = buckets[rank]
            if i.__class__ is not int:
                heap, i = i, heappop(i)
            if buckets[rank].__class__ is int or not heap:
                buckets[rank] = None
                bitmap[word] ^= low
                if not bitmap[word]:
                    top ^= bits[word]
            if current[i] != rank:
                continue
            gone = after[i]
            end = after[gone]
            after[i] = end
            current[gone] = current[i] = -1
            left = before[i]
            if end < n:
                before[end] = i
                new = rank_of(piece[i : after[end]])
                if new is not None:
                    current[i] = new
                    held = buckets[new]
                    if held is None:
                        buckets[new] = i
                        word = new >> LOW
                        bitmap[word] |= bits[new & MASK]
                        top |= bits[word]
                    elif held.__class__ is int:
                        buckets[new] = [held, i] if held < i else [i, held]
                    else:
                        heappush(held, i)
            if left >= 0:
                new = rank_of(piece[left:end])
                if new is None:
                    current[left] = -1
                    continue
                current[left] = new
                held = buckets[new]
                if held is None:
                    buckets[new] = left
                    word = new >> LOW
                    bitmap[word] |= bits[new & MASK]
                    top |= bits[word]
                elif held.__class__ is int:
                    buckets[new] = [held, left] if held < left else [left, held]
                else:
                    heappush(held, left)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        memory, out = self.memory, []
        for piece in self.find(text):
            ids = memory.get(piece)
            if ids is None:
                ids = tuple(self.merge(piece.encode("utf-8")))
                if len(piece) <= 64:
                    if len(memory) >= self.remembered:
                        memory.clear()
                    memory[piece] = ids
            out += ids
        return out


    def gives(self, ids: list[int], text: str) -> bool:
        """Whether token ids decode to a text."""
        return b"".join(map(self.tokens.__getitem__, ids)) == text.encode("utf-8")


_encoders: dict[tuple[str, str, int], Encoder] = {}


def encoder_of(ranks, path: str, pattern: str, remembered: int) -> Encoder:
    """The worker's encoder for a vocabulary, kept between tasks with what it remembers."""
    key = path, pattern, remembered
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks.value, pattern, remembered)
    return _encoders[key]


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    checked: bool = False,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """One row per input row: id and ``ids``, the token ids of the whole text.

    With ``checked`` the ids are decoded again, and ``whole`` says if they give the text.

    A worker keeps the ids of up to ``remembered`` pre-tokens; the results don't depend on it.

    The vocabulary file is read by the driver and broadcast; its size is that of
    the file (a few MB), whatever the corpus.

    Defined cases: null and empty texts have no ids; special tokens are ordinary
    text; a pre-token of any length takes about n log n steps; an empty table
    gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    kind = dict(docs.dtypes)[id_col]
    names = ["id", "ids", "whole"] if checked else ["id", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        encoder = encoder_of(ranks, path, pattern, remembered)
        for batch in batches:
            texts, at, values, offsets, whole = batch.column(1), 0, [], [0], []
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                ids = encoder.encode(text)
                if checked:
                    whole.append(encoder.gives(ids, text))
                values += ids
                offsets.append(len(values))
                if len(values) > BATCH_IDS or i == len(texts) - 1:
                    lists = pa.ListArray.from_arrays(
                        pa.array(offsets, pa.int32()), pa.array(values, pa.int32())
                    )
                    columns = [batch.column(0).slice(at, len(lists)), lists]
                    if checked:
                        columns.append(pa.array(whole))
                    yield pa.RecordBatch.from_arrays(columns, names)
                    at, values, offsets, whole = i + 1, [], [0], []

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, ids array<int>" + (", whole boolean" if checked else ""))
    return out.withColumnRenamed("id", id_col)


def decode(coded: DataFrame, path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``coded`` with the bytes its token ids stand for (binary); null ids give null."""
    spark = coded.sparkSession
    tokens = spark.sparkContext.broadcast({rank: token for token, rank in read_ranks(path).items()})
    place = coded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = tokens.value.__getitem__
        for batch in batches:
            lists = batch.column(place)
            values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            out = [
                b"".join(map(get, values[a:b].tolist())) if valid else None
                for a, b, valid in zip(at[:-1], at[1:], lists.is_valid().to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, name]
            )

    schema = T.StructType([*coded.schema.fields, T.StructField(name, T.BinaryType())])
    return coded.mapInArrow(run, schema)
