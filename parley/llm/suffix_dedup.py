"""Removal of long repeated passages by suffix arrays.

A passage is removed where a string of ``LENGTH`` bytes that covers it also
starts earlier. Rounds: (1) shards count anchors, the smallest hashed k-mers of
windows, over all texts, so that windows which occur once drop out; (2) a shard
sorts the suffixes of its remaining text and finds the windows it repeats itself;
(3) what is first in its shard meets the other shards' runs in buckets; (4) the
spans come back to their texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.blocks import (
    bucket_slices,
    mixed,
    pieces,
    powers,
    prefix_sums,
    range_hashes,
    shares,
    unpacked,
)
from parley.session import pinned

#: Bytes of a window, of a k-mer, and k-mers in a window.
LENGTH, KMER = 100, 32
SPAN = LENGTH - KMER + 1
#: Bytes of text to a shard; its task takes about a hundred bytes of memory for each.
SHARD_BYTES = 3 << 20
#: Occurrences from which an anchor is hot: its windows are then dealt one by one.
HOT = 512
#: Windows of a bucket that are compared at a time.
PART = 1 << 19
#: A byte that UTF-8 never has, between the pieces of text in a suffix array.
GAP = 255


def shard_text(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a shard's texts in order, and where each text starts (and the end)."""
    texts = rows.column("text").to_pylist()
    coded = [t.encode("utf-8") for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in coded])]).astype(np.int64)
    return np.frombuffer(b"".join(coded), np.uint8), bounds


def stretches(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, number of windows, key of the anchor.

    The anchor of a window is its leftmost k-mer of the smallest hash, so equal
    windows have equal anchors at equal places. No window crosses a text's end. As
    anchors have small hashes, their keys are mixed once more to fill all buckets.
    """
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = prefix_sums(data)
    _, down = powers(len(sums))
    hashes = sums[KMER:] - sums[:-KMER]
    del sums
    hashes *= down[: len(hashes)]
    hashes = mixed(hashes)
    key = hashes & np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    key = np.minimum(key[: n], key[SPAN - width : SPAN - width + n])
    anchor = key.astype(np.uint32)
    del key
    valid = np.zeros(n, bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        valid[a : max(a, b - LENGTH + 1)] = True
    change = np.ones(n, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    gaps = np.diff(bounds) >= LENGTH
    change[bounds[:-1][gaps]] = True
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, n))
    good = valid[first]
    first, count = first[good], count[good]
    return first, count, mixed(hashes[anchor[first]] ^ _ROUTE)


def suffix_array(text: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The places of a text in the order of the suffixes that start there.

    Larsson and Sadakane's refinement: suffixes are sorted by eight bytes; then the
    rank of the suffix h bytes on splits each group that is still open, and h
    doubles. Groups of one are never touched again.
    """
    m = len(text)
    kind = np.int32 if m < 1 << 30 else np.int64
    order = np.argsort(words[:m]).astype(kind)
    fresh = np.ones(m, bool)
    for i in range(1, m, 1 << 18):
        some = words[order[i - 1 : i + (1 << 18)]]
        fresh[i : i + len(some) - 1] = some[1:] != some[:-1]
    rank = np.zeros(m + 1, kind)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(m, dtype=kind), 0)) + 1
    single = fresh & np.append(fresh[1:], True)
    where = np.flatnonzero(~single)
    h = 8
    while len(where):
        open_ = order[where]
        key = rank[open_].astype(np.int64)
        key <<= 32
        key |= rank[np.minimum(open_ + h, m)]
        by = np.argsort(key)
        open_, key = open_[by], key[by]
        order[where] = open_
        fresh = np.ones(len(where), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[open_] = np.maximum.accumulate(np.where(fresh, where, 0)).astype(kind) + 1
        single = fresh & np.append(fresh[1:], True)
        where = where[~single]
        h *= 2
    return order


def packed_words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one big-endian number, zeros past the end."""
    out = np.zeros(len(text) + 2 * LENGTH + 8, np.uint64)
    out[: len(text)] = text
    for bits in (8, 16, 32):
        step = bits // 8
        out[:-step] = (out[:-step] << np.uint64(bits)) | out[step:]
    return out


def common_prefixes(order: np.ndarray, words: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order, up to ``most`` bytes.

    Kasai's rule: the next place in the text shares at least one byte less than
    this one. The text is walked in many lanes at once, eight bytes a step.
    """
    m = len(order)
    before = np.full(m, -1, order.dtype)
    before[order[1:]] = order[:-1]
    lanes = max(1, min(m, 1 << 13))
    stride = -(-m // lanes)
    out = np.zeros(m, np.int16)
    at = np.arange(lanes) * stride
    have = np.zeros(lanes, np.int64)
    for _ in range(stride):
        live = at < m
        if not live.all():
            at, have = at[live], have[live]
        other = before[at].astype(np.int64)
        have = np.where(other >= 0, np.maximum(have - 1, 0), most)
        todo = np.flatnonzero(have < most)
        while len(todo):
            k = have[todo]
            differ = words[at[todo] + k] ^ words[other[todo] + k]
            same = differ == 0
            for bits in (8, 16, 24, 32, 40, 48, 56):
                k += (differ >> np.uint64(bits)) == 0
            k += same
            have[todo] = np.minimum(k, most)
            todo = todo[same & (k < most)]
        have[other < 0] = 0
        out[at] = np.minimum(have, m - np.maximum(at, other))
        at = at + 1
    return out[order]


def runs_of(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of true values."""
    edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    first = np.flatnonzero(edge == 1)
    return first, np.flatnonzero(edge == -1) - first


def repeats_inside(data: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Of the marked windows those that occur earlier in the shard, by its suffix array."""
    first, count = runs_of(windows)
    out = np.zeros(len(windows), bool)
    if not len(first):
        return out
    sizes = count + LENGTH  # the windows' bytes and a gap
    starts = np.concatenate([[0], np.cumsum(sizes)])
    text = np.full(int(starts[-1]), GAP, np.uint8)
    is_window = np.zeros(len(text), bool)
    for a, n, s in zip(first.tolist(), count.tolist(), starts.tolist(), strict=False):
        text[s : s + n + LENGTH - 1] = data[a : a + n + LENGTH - 1]
        is_window[s : s + n] = True
    words = packed_words(text)
    order = suffix_array(text, words)
    group = np.cumsum(common_prefixes(order, words) < LENGTH, dtype=order.dtype)
    del words
    chosen = is_window[order]
    order, group = order[chosen], group[chosen]
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.repeat(np.minimum.reduceat(order, heads), np.diff(np.append(heads, len(order))))
    again = order[order != least]
    piece = np.searchsorted(starts, again, "right") - 1
    out[first[piece] + (again - starts[piece])] = True
    return out


def counted(shards: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, shard, keys, counts): the anchors of a shard."""

    def run(table: pa.Table) -> pa.Table:
        data, bounds = shard_text(unpacked(table))
        keys, counts = np.unique(stretches(data, bounds)[2], return_counts=True)
        cuts = bucket_slices(keys, buckets)
        shift = np.uint64(buckets.bit_length() - 1)
        brief = ((keys << shift) >> np.uint64(32)).astype(np.uint32)
        shard = table.column("shard")[0].as_py()
        return pa.table(
            {
                "bucket": pa.array(range(buckets), pa.int32()),
                "shard": pa.array([shard] * buckets, pa.int32()),
                "keys": pa.array([brief[a:b].tobytes() for a, b in cuts], pa.binary()),
                "counts": pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in cuts], pa.binary()),
            }
        )

    return shards.groupBy("shard").applyInArrow(run, "bucket int, shard int, keys binary, counts binary")


def answered(sent: DataFrame, hot: int) -> DataFrame:
    """Rows (shard, bucket, kinds), a byte for each anchor a shard sent: 0 once, 1 again in
    this shard only, 2 in other shards, 3 hot."""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("keys")]
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")])
        keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(keys))[inverse]
        kinds = np.where(total == counts, (counts > 1).astype(np.uint8), 2 + (total >= hot)).astype(np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        return pa.table(
            {
                "shard": table.column("shard"),
                "bucket": table.column("bucket"),
                "kinds": pa.array(
                    [kinds[e - len(p) : e].tobytes() for p, e in zip(parts, ends, strict=True)], pa.binary()
                ),
            }
        )

    return sent.groupBy("bucket").applyInArrow(run, "shard int, bucket int, kinds binary")


#: What a shard sends to a bucket. Stretches: id, row, place of the first window, number of
#: windows, and their bytes. Hot windows: two hashes, id, row and place. ``done``: row, place
#: and number of windows already known to repeat, passed through.
SENT = (
    "bucket int, shard int, id binary, row binary, place binary, count binary, data binary, "
    "hot_a binary, hot_b binary, hot_id binary, hot_row binary, hot_place binary, done binary"
)


def searched(shards: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """Each shard's own repeats, and what is first in it for the other shards."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows = unpacked(table)
        data, bounds = shard_text(rows)
        first, count, keys = stretches(data, bounds)
        order = np.argsort(replies.column("bucket").to_numpy())
        got = replies.column("kinds")
        kinds = np.concatenate([np.frombuffer(got[int(i)].as_py(), np.uint8) for i in order])
        known = np.unique(keys)
        if len(known) != len(kinds):
            raise ValueError("the shard's answers do not fit its anchors")
        kind = kinds[np.searchsorted(known, keys)]
        windows = np.zeros(max(0, len(data) - LENGTH + 1), bool)
        change = np.zeros(len(windows) + 1, np.int64)
        np.add.at(change, first[kind > 0], 1)
        np.add.at(change, (first + count)[kind > 0], -1)
        windows[:] = np.cumsum(change[:-1]) > 0
        repeated = repeats_inside(data, windows)
        ids = rows.column("id").to_pylist()
        id_of = np.array([np.iinfo(np.int64).min if x is None else x for x in ids], np.int64)
        new = np.concatenate([[0], np.cumsum(windows & ~repeated)])
        left = new[first + count] - new[first]
        meets = np.flatnonzero((kind == 2) & (left > 0))
        bucket = (keys[meets] >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        meets, bucket = meets[by], bucket[by]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        row = np.searchsorted(bounds, first, "right") - 1
        hot = np.zeros(len(windows) + 1, np.int64)
        np.add.at(hot, first[kind == 3], 1)
        np.add.at(hot, (first + count)[kind == 3], -1)
        hot_at = np.flatnonzero((np.cumsum(hot[:-1]) > 0) & ~repeated)
        sums = prefix_sums(data)
        hot_a = range_hashes(sums, hot_at, hot_at + LENGTH)
        hot_b = second_hashes(data, hot_at)
        by = np.argsort(hot_a)
        hot_at, hot_a, hot_b = hot_at[by], hot_a[by], hot_b[by]
        hot_row = np.searchsorted(bounds, hot_at, "right") - 1
        hot_cuts = bucket_slices(hot_a, buckets)
        shard = table.column("shard")[0].as_py()
        done_first, done_count = runs_of(repeated)
        done_row = np.searchsorted(bounds, done_first, "right") - 1
        done = np.stack([done_row, done_first - bounds[done_row], done_count], 1).astype(np.int64)
        out: dict[str, list] = {f.split()[0]: [] for f in SENT.split(", ")}
        for b in range(buckets):
            own = meets[cuts[b] : cuts[b + 1]]
            h0, h1 = hot_cuts[b]
            out["bucket"].append(b)
            out["shard"].append(shard)
            out["id"].append(id_of[row[own]].tobytes())
            out["row"].append(row[own].astype(np.int32).tobytes())
            out["place"].append((first[own] - bounds[row[own]]).tobytes())
            out["count"].append(count[own].astype(np.int32).tobytes())
            out["data"].append(
                b"".join(
                    data[a : a + n + LENGTH - 1].tobytes()
                    for a, n in zip(first[own].tolist(), count[own].tolist(), strict=True)
                )
            )
            out["hot_a"].append(hot_a[h0:h1].tobytes())
            out["hot_b"].append(hot_b[h0:h1].tobytes())
            out["hot_id"].append(id_of[hot_row[h0:h1]].tobytes())
            out["hot_row"].append(hot_row[h0:h1].astype(np.int32).tobytes())
            out["hot_place"].append((hot_at[h0:h1] - bounds[hot_row[h0:h1]]).tobytes())
            out["done"].append(done.tobytes() if b == shard % buckets else b"")
        return pa.table({k: pa.array(v, pa.int32() if k in ("bucket", "shard") else pa.binary()) for k, v in out.items()})

    return shards.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(run, SENT)


#: Mixed into the hash of an anchor.
_ROUTE = np.uint64(0xA0761D6478BD642F)
_SECOND = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def second_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Another hash of the windows that start at ``at``, by its own byte values."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SECOND[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[at + LENGTH] - sums[at]) * down[at])


def joined(table: pa.Table, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """A binary column of all runs as one array, and the run of each entry."""
    parts = [np.frombuffer(x.as_py(), kind) for x in table.column(name)]
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def not_first(runs: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Per entry (run after run) the least ``order`` of an entry with its key.

    The runs' keys are merged to one sorted table; every run is placed in it by
    binary search.
    """
    table = np.unique(np.concatenate(runs))
    place = np.concatenate([np.searchsorted(table, r) for r in runs])
    least = np.full(len(table), np.iinfo(np.int64).max)
    np.minimum.at(least, place, order)
    return least[place]


def stretch_hashes(data: np.ndarray, starts: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hashes of all windows of the stretches, about a million bytes at a time."""
    edges = np.unique(np.searchsorted(starts, np.arange(0, len(data), 1 << 20)))
    edges = np.append(edges[edges < len(starts)], len(starts))
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own, n = starts[a:b] - starts[a], count[a:b]
        sums = prefix_sums(data[starts[a] : starts[b - 1] + n[-1] + LENGTH - 1])
        at = np.repeat(own - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out.append(range_hashes(sums, at, at + LENGTH))
    return np.concatenate(out)


def cross_repeats(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a bucket's stretches that occur earlier: run, row, place, number (run lengths)."""
    ids, run = joined(table, "id", np.int64)
    if not len(ids):
        return (np.zeros(0, np.int64),) * 4
    row, place = joined(table, "row", np.int32)[0], joined(table, "place", np.int64)[0]
    count = joined(table, "count", np.int32)[0].astype(np.int64)
    data = joined(table, "data", np.uint8)[0]
    starts = np.concatenate([[0], np.cumsum(count + LENGTH - 1)])[:-1]
    total = int(count.sum())
    of = np.repeat(np.arange(len(count), dtype=np.int32), count)
    step = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    at, step = starts[of] + step, step.astype(np.int32)
    hashes = stretch_hashes(data, starts, count)
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((place, row, run, ids))] = np.arange(len(ids))
    stretch_of = np.argsort(rank)
    again = np.zeros(total, bool)
    parts = total // PART + 1
    for part in range(parts):
        own = np.flatnonzero(hashes % np.uint64(parts) == part) if parts > 1 else np.arange(total)
        some, where = hashes[own], at[own]
        order = (rank[of[own]] << 32) | step[own]
        cuts = np.searchsorted(run[of[own]], np.arange(1, int(run[-1]) + 1))
        first = not_first(np.split(some, cuts), order)
        found = np.flatnonzero(first != order)
        head = starts[stretch_of[first[found] >> 32]] + (first[found] & 0xFFFFFFFF)
        wrong = differing(data, where[found], head)
        again[own[found]] = True
        if wrong.any():  # windows of one hash that are not equal are told apart by their bytes
            clash = np.flatnonzero(np.isin(some, some[found[wrong]]))
            again[own[clash]] = by_bytes(data, where[clash], order[clash])
    begin, length = runs_of(again)
    return split_runs(begin, length, of, step, run, row, place)


def split_runs(begin, length, of, step, run, row, place):
    """Runs of windows cut where a stretch ends, with their place in their text."""
    last = begin + length
    cuts = np.flatnonzero(np.diff(of)) + 1
    inner = cuts[np.searchsorted(cuts, begin, "right").clip(0, len(cuts) - 1)] if len(cuts) else cuts
    if len(inner) and (inner < last).any():
        marked = np.zeros(len(of) + 1, bool)
        for a, b in zip(begin.tolist(), last.tolist(), strict=True):
            marked[a:b] = True
        edge = np.zeros(len(of) + 1, bool)
        edge[cuts] = True
        starts = marked[:-1] & (edge[:-1] | ~np.concatenate([[False], marked[:-2]]))
        begin = np.flatnonzero(starts)
        stop = marked[:-1] & (edge[1:] | ~marked[1:])
        last = np.flatnonzero(stop) + 1
    s = of[begin]
    return run[s], row[s].astype(np.int64), place[s] + step[begin], last - begin


def differing(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = 1 << 14) -> np.ndarray:
    """Whether the windows at a and b differ in any byte."""
    view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    out = np.zeros(len(a), bool)
    for i in range(0, len(a), most):
        out[i : i + most] = (view[a[i : i + most]] != view[b[i : i + most]]).any(1)
    return out


def by_bytes(data: np.ndarray, at: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which of the windows at ``at`` occur earlier in ``order``, byte by byte."""
    out = np.zeros(len(at), bool)
    seen: set[bytes] = set()
    for i in np.argsort(order).tolist():
        window = data[at[i] : at[i] + LENGTH].tobytes()
        out[i] = window in seen
        seen.add(window)
    return out


def hot_repeats(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hot windows of a bucket that occur in an earlier text: run, row and place."""
    a, run = joined(table, "hot_a", np.uint64)
    if not len(a):
        return (np.zeros(0, np.int64),) * 3
    b, ids = joined(table, "hot_b", np.uint64)[0], joined(table, "hot_id", np.int64)[0]
    row, place = joined(table, "hot_row", np.int32)[0].astype(np.int64), joined(table, "hot_place", np.int64)[0]
    by = np.lexsort((place, row, run, ids, b, a))
    same = np.zeros(len(by), bool)
    same[1:] = (a[by[1:]] == a[by[:-1]]) & (b[by[1:]] == b[by[:-1]])
    found = by[same]
    return run[found], row[found], place[found]


def merged(sent: DataFrame) -> DataFrame:
    """Rows (shard, spans): row, place and number of windows that occur earlier elsewhere."""

    def run(table: pa.Table) -> pa.Table:
        shard = np.array(table.column("shard").to_pylist(), np.int32)
        of, row, place, count = cross_repeats(table)
        hot_of, hot_row, hot_place = hot_repeats(table)
        spans = np.stack(
            [
                np.concatenate([row, hot_row]),
                np.concatenate([place, hot_place]),
                np.concatenate([count, np.ones(len(hot_of), np.int64)]),
            ],
            1,
        ).astype(np.int64)
        whose = np.concatenate([of, hot_of])
        by = np.argsort(whose, kind="stable")
        spans, whose = spans[by], whose[by]
        cuts = np.searchsorted(whose, np.arange(len(shard) + 1))
        done = table.column("done")
        return pa.table(
            {
                "shard": pa.array(shard),
                "spans": pa.array(
                    [
                        all_spans(spans[cuts[i] : cuts[i + 1]], done[i].as_py())
                        for i in range(len(shard))
                    ],
                    pa.binary(),
                ),
            }
        )

    return sent.groupBy("bucket").applyInArrow(run, "shard int, spans binary")


def all_spans(spans: np.ndarray, done: bytes) -> bytes:
    """Spans found here and those the shard knew, as bytes."""
    return np.concatenate([spans, np.frombuffer(done, np.int64).reshape(-1, 3)]).tobytes()


def removed(shards: DataFrame, spans: DataFrame, kind: str) -> DataFrame:
    """Per text its bytes, the removed ones and their runs, and the hash of what is left."""

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        rows = unpacked(table)
        data, bounds = shard_text(rows)
        change = np.zeros(len(data) + 1, np.int64)
        for x in found.column("spans"):
            own = np.frombuffer(x.as_py(), np.int64).reshape(-1, 3)
            begin = bounds[own[:, 0]] + own[:, 1]
            np.add.at(change, begin, 1)
            np.add.at(change, begin + own[:, 2] + LENGTH - 1, -1)
        gone = np.cumsum(change[:-1]) > 0
        n_removed, n_spans, sha, left = [], [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = gone[a:b]
            first, length = runs_of(own)
            kept = data[a:b][~own].tobytes() if len(first) else data[a:b].tobytes()
            n_removed.append(int(length.sum()))
            n_spans.append(len(first))
            sha.append(hashlib.sha256(kept).hexdigest())
            left.append(np.stack([first, first + length], 1).tolist())
        return pa.table(
            {
                "id": rows.column("id"),
                "n_bytes": pa.array(np.diff(bounds), pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "n_spans": pa.array(n_spans, pa.int64()),
                "kept_sha256": pa.array(sha, pa.string()),
                "spans": pa.array(left, pa.list_(pa.list_(pa.int64()))),
            }
        )

    return (
        shards.groupBy("shard")
        .cogroup(spans.groupBy("shard"))
        .applyInArrow(
            run,
            f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
            "spans array<array<bigint>>",
        )
    )


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT
) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``spans``.

    Texts are UTF-8 bytes. A byte goes if a string of 100 bytes that covers it also
    starts earlier: in a text of a smaller id, or further left in the same text.
    Overlaps count, and all strings are judged on the input. ``spans`` are the
    maximal removed runs (from, to); the hash is that of the bytes left.

    Stretches that meet are compared by hash and then byte by byte; windows of
    anchors with ``hot`` occurrences or more are compared by 128 bits of hash.

    Defined cases: null and empty texts have no bytes; null ids come first; rows
    that repeat an id are in the order of their texts; a text longer than a shard
    is a shard of its own; an empty table gives an empty result. Ids are integers.
    Other columns are not read.
    """
    shards, buckets = shares(docs, text_col, SHARD_BYTES)
    own = pieces(docs.withColumn(id_col, F.col(id_col).cast("long")), shards, id_col, text_col)
    answers = pinned(answered(counted(own, buckets), hot))
    found = merged(searched(own, answers, buckets))
    return removed(own, found, "bigint").withColumnRenamed("id", id_col)
