"""Similarity join of shingle sets by token-combination prefixes, exact at its threshold."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.blocks import (
    bucket_slices,
    lowered,
    mixed,
    pieces,
    prefix_sums,
    range_hashes,
    shares,
    text_blocks,
    unpacked,
    word_ranges,
)
from parley.llm.graph import components
from parley.session import pinned

#: Words of a shingle; similarity at least NUMERATOR / DENOMINATOR.
SHINGLE = 5
NUMERATOR, DENOMINATOR = 4, 5
#: From so many sets on that hold a token it is frequent.
FREQUENT = 8
#: Classes of a token as an answer gives them: no other set has it, rare, frequent.
ALONE, RARE, COMMON = 0, 1, 2

_MIX = np.random.default_rng(5).integers(1, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
_ROUTE = np.uint64(0xD6E8FEB86659FD93)
#: Bits of the filter that finds the texts whose whole sets are wanted.
FILTER_BITS = 1 << 23


def salt(mode: int) -> np.uint64:
    """Keeps apart what is indexed in different modes; 0 for single tokens."""
    return np.uint64(mode * int(_MIX[13]) % (1 << 64))


def shingle_sets(rows: pa.Table) -> Iterator[np.ndarray]:
    """Per text its distinct shingles as sorted 64-bit hashes."""
    for _, data, bounds in text_blocks(rows):
        data = lowered(data)
        starts, ends, before = word_ranges(data, bounds)
        words = range_hashes(prefix_sums(data), starts, ends)
        wide = max(0, len(words) - SHINGLE + 1)
        total = np.zeros(wide, np.uint64)
        for k in range(SHINGLE):
            total += words[k : k + wide] * _MIX[k]
        shingles = mixed(total)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                yield np.unique(shingles[a : b - SHINGLE + 1])
            elif b > a:
                own = words[a:b] * _MIX[: b - a]
                yield mixed(own.sum(keepdims=True, dtype=np.uint64) + _MIX[8 + b - a])
            else:
                yield np.zeros(0, np.uint64)


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share, whatever the order."""
    a = mixed(tokens + _MIX[14]).sum(dtype=np.uint64)
    b = mixed(tokens ^ _MIX[15]).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


@cache
def sizes(most: int) -> tuple[int, ...]:
    """Borders of the modes: whole numbers that grow by a quarter, up to one beyond ``most``."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, out[-1] * DENOMINATOR // NUMERATOR))
    return tuple(out)


def modes(n: int) -> list[tuple[int, int, int]]:
    """The modes in which a set of n tokens is indexed: (mode, groups, differences).

    Sets that may link meet in a mode: the larger one lies between its borders, and
    the smaller one has at least four fifths of its size. Two linked sets have at
    most a ninth of their tokens in all that only one of them has; ``differences`` is
    the most of these for a set of this size and a partner. There are more groups
    than differences of any pair of the mode.
    """
    borders = sizes(1 << max(8, (2 * n).bit_length()))
    out = []
    for mode, (low, high) in enumerate(zip(borders[:-1], borders[1:], strict=True)):
        if NUMERATOR * low <= DENOMINATOR * n and n < high:
            most = 2 * (high - 1) // (NUMERATOR + DENOMINATOR)
            out.append((mode + 1, most + 3 + most // 8, (n + high - 1) // (NUMERATOR + DENOMINATOR)))
    return out


def shard_sets(rows: pa.Table) -> tuple[dict[tuple[int, int, int], int], list[np.ndarray], list[int]]:
    """The distinct sets of a shard: their places by key, the sets, and each text's place (-1: empty)."""
    places: dict[tuple[int, int, int], int] = {}
    sets: list[np.ndarray] = []
    of_text: list[int] = []
    for tokens in shingle_sets(rows):
        if not len(tokens):
            of_text.append(-1)
            continue
        key = (*set_key(tokens), len(tokens))
        if key not in places:
            places[key] = len(sets)
            sets.append(tokens)
        of_text.append(places[key])
    return places, sets, of_text


def routed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Routing keys of all tokens, set after set, and where each set's begin (and the end)."""
    keys = mixed(np.concatenate(sets) ^ _ROUTE) if sets else np.zeros(0, np.uint64)
    return keys, np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def short(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The 32 bits after those that choose the bucket; enough to choose a class."""
    bits = buckets.bit_length() - 1
    return ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def ask(shards: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, shard, keys, counts): tokens and the number of the shard's sets that have them."""

    def run(table: pa.Table) -> pa.Table:
        _, sets, _ = shard_sets(unpacked(table))
        keys, counts = np.unique(routed(sets)[0], return_counts=True)
        cuts = bucket_slices(keys, buckets)
        brief = short(keys, buckets)
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


def answer(asked: DataFrame, frequent: int) -> DataFrame:
    """Rows (shard, bucket, classes): one byte for each token a shard asked about, in its order."""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("keys")]
        counts = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")]
        keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(keys))
        classes = np.searchsorted([2, frequent], total, "right").astype(np.uint8)[inverse]
        ends = np.cumsum([len(p) for p in parts])
        return pa.table(
            {
                "shard": table.column("shard"),
                "bucket": table.column("bucket"),
                "classes": pa.array(
                    [classes[e - len(p) : e].tobytes() for p, e in zip(parts, ends, strict=True)], pa.binary()
                ),
            }
        )

    return asked.groupBy("bucket").applyInArrow(run, "shard int, bucket int, classes binary")


def signatures(tokens: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """What a set is indexed by: rare tokens, and combinations of frequent ones; and its prefix length.

    ``tokens`` are in order: those that no other set has, rare ones, frequent ones,
    each by hash. At most d = n - ceil(4n / 5) tokens of a set are missing in a
    partner, so one of the first d + 1 is shared; and of two such prefixes the one
    that ends first lies in the other, as far as it is shared. Shared rare tokens are
    found in their lists. If the prefix reaches the frequent tokens, none of them may
    be shared, and it is extended to the whole set: its tokens are dealt into more
    groups than a partner can have differences, so one group is the same in both.
    The combination of all tokens of a group is indexed if all are frequent. If so
    many groups are empty that the one in common may be, the frequent tokens of the
    prefix are indexed alone.
    """
    n = len(tokens)
    length = n - -(-NUMERATOR * n // DENOMINATOR) + 1
    own, kind = tokens[:length], classes[:length]
    rare, common = np.unique(mixed(own[kind == RARE] + salt(0))), []
    if kind[-1] == COMMON:
        spread = mixed(tokens + _MIX[12])
        for mode, groups, differences in modes(n):
            group = (spread % np.uint64(groups)).astype(np.int64)
            filled = np.bincount(group, minlength=groups)
            whole = np.bincount(group[classes == COMMON], minlength=groups) == filled
            sums = np.zeros(groups, np.uint64)
            np.add.at(sums, group, spread * _MIX[mode % 8] + _MIX[9])
            common.append(mixed(sums[whole & (filled > 0)] + salt(mode)))
            if groups - differences - int((filled == 0).sum()) < 1:
                common.append(mixed(own[kind == COMMON] + salt(mode) + _MIX[11]))
    return rare, np.unique(np.concatenate(common)) if common else rare[:0], length


def in_order(kind: int, token: int) -> int:
    """The place of a token in the order as a signed number (62 bits of its hash)."""
    return (kind << 62 | token >> 2) - (1 << 63)


def parity(tokens: np.ndarray) -> np.ndarray:
    """256 bits: of each part of the tokens, whether it holds an odd number of them.

    Where the bits of two sets differ, at least one token is in one of them only.
    """
    parts = np.bincount((mixed(tokens ^ _MIX[10]) & np.uint64(255)).astype(np.int64), minlength=256)
    return np.packbits((parts & 1).astype(np.uint8)).view(np.int64)


INDEXED = (
    "node long, ids array<bigint>, n long, held long, often long, key_a long, key_b long, length long, last long, "
    "shared array<int>, rare array<bigint>, common array<bigint>, parity array<bigint>"
)


def indexed(shards: DataFrame, answers: DataFrame) -> DataFrame:
    """Per shard and distinct set: its node (the least id), ids, size, key, and its index.

    ``held`` is the number of its tokens that other sets have, ``often`` that of the
    frequent ones: the most that a partner shares which shares a rare one, or none.
    Of the prefix: its length, its last token, and 32 bits of the tokens that other
    sets have. ``parity`` says for 256 parts of all tokens whether their number is odd.
    Null where nothing can link.
    """

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows = unpacked(table)
        places, sets, of_text = shard_sets(rows)
        keys, bounds = routed(sets)
        order = np.argsort(replies.column("bucket").to_numpy())
        got = replies.column("classes")
        classes = np.concatenate([np.frombuffer(got[int(i)].as_py(), np.uint8) for i in order])
        known = np.unique(keys)
        if len(known) != len(classes):
            raise ValueError("the shard's answers do not fit its tokens")
        kinds = classes[np.searchsorted(known, keys)]
        ids: list[list] = [[] for _ in sets]
        empty = []
        for key, place in zip(rows.column("id").to_pylist(), of_text, strict=True):
            (ids[place] if place >= 0 else empty).append(key)
        out: dict[str, list] = {f.split()[0]: [] for f in INDEXED.split(", ")}
        for i, ((key_a, key_b, n), tokens) in enumerate(zip(places, sets, strict=True)):
            own = kinds[bounds[i] : bounds[i + 1]]
            by = np.argsort(own, kind="stable")
            tokens, own = tokens[by], own[by]
            rare, common, length = signatures(tokens, own)
            some = len(rare) or len(common)
            shared = tokens[:length][own[:length] != ALONE].astype(np.uint32)
            values = {
                "node": min((x for x in ids[i] if x is not None), default=None),
                "ids": ids[i],
                "n": n,
                "held": int((own != ALONE).sum()),
                "often": int((own == COMMON).sum()),
                "key_a": key_a,
                "key_b": key_b,
                "length": length,
                "last": in_order(int(own[length - 1]), int(tokens[length - 1])),
                "shared": shared.view(np.int32) if some else None,
                "rare": rare.view(np.int64) if len(rare) else None,
                "common": common.view(np.int64) if len(common) else None,
                "parity": parity(tokens) if len(common) else None,
            }
            for name, value in values.items():
                out[name].append(value)
        for name, value in {"ids": empty, "n": 0}.items():
            out[name].append(value)
        for name in out.keys() - {"ids", "n"}:
            out[name].append(None)
        lists = {c: pa.int64() for c in ("ids", "rare", "common", "parity")} | {"shared": pa.int32()}
        return pa.table({k: pa.array(v, pa.list_(lists[k]) if k in lists else pa.int64()) for k, v in out.items()})

    return shards.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(run, INDEXED)


def sides(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b) with the columns of both nodes, as a_... and b_..."""
    out = pairs.select("a", "b")
    for side in ("a", "b"):
        own = table.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        out = out.join(own, side)
    return out


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that may link by their prefixes: an upper bound of what they share reaches it.

    All common tokens up to the smaller of the last prefix tokens are in both
    prefixes; beyond it, the set whose prefix ends there has n - length tokens.
    """
    beyond = F.when(
        F.col("a_last") <= F.col("b_last"), F.col("a_n") - F.col("a_length")
    ).otherwise(F.col("b_n") - F.col("b_length"))
    # Tokens of a that fall together in 32 bits would be counted once.
    merged = F.size("a_shared") - F.size(F.array_distinct("a_shared"))
    most = F.size(F.array_intersect("a_shared", "b_shared")) + merged + beyond
    enough = (NUMERATOR + DENOMINATOR) * most >= NUMERATOR * (F.col("a_n") + F.col("b_n"))
    return sides(pairs, sets, ["n", "length", "last", "shared"]).where(enough).select("a", "b")


def chosen_bits(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of FILTER_BITS bits over the ids, two to an id; its size is fixed."""
    places = F.explode(F.array(*bit_places(F.col("id")))).alias("at")
    words = ids.select(places).groupBy(F.shiftright("at", 6).alias("word"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    for r in words.agg(F.bit_or(one).alias("bits")).collect():
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def bit_places(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(FILTER_BITS)) for i in range(2)]


def whole_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (node, tokens) of the texts with these ids, by a scan that moves no other text."""
    shared = docs.sparkSession.sparkContext.broadcast(chosen_bits(ids))
    first, second = bit_places(F.col("id"))
    rows = docs.select("id", "text").withColumns({"first": first, "second": second})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def hit(column: pa.Array) -> np.ndarray:
            at = column.to_numpy().astype(np.uint64)
            return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1

        for batch in batches:
            some = pa.Table.from_batches([batch.filter(pa.array(hit(batch.column(2)) & hit(batch.column(3))))])
            tokens = [x.view(np.int64) for x in shingle_sets(some.select(["id", "text"]).combine_chunks())]
            yield pa.RecordBatch.from_arrays(
                [some.column("id").combine_chunks(), pa.array(tokens, pa.list_(pa.int64()))], ["node", "tokens"]
            )

    found = rows.mapInArrow(run, "node long, tokens array<bigint>")
    return found.join(ids.withColumnRenamed("id", "node"), "node", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""
    ids = pinned(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    sets = pinned(whole_sets(docs, ids))
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    union = F.size("a_tokens") + F.size("b_tokens") - common
    both = sides(pairs, sets, ["tokens"])
    return pinned(both.where(DENOMINATOR * common >= NUMERATOR * union).select("a", "b"))


def fits(n: Column, held: Column, other_n: Column, other_held: Column) -> Column:
    """Whether two sets may link by their sizes and by what they could share at most."""
    return (NUMERATOR + DENOMINATOR) * F.least(held, other_held) >= NUMERATOR * (n + other_n)


def named(rows: DataFrame) -> DataFrame:
    """The entries with other names but for the mark, to meet themselves."""
    return rows.withColumnsRenamed({c: f"x_{c}" for c in rows.columns if c != "mark"})


def all_pairs(sets: DataFrame) -> DataFrame:
    """The pairs of every list of rare tokens; a list has fewer entries than a token is frequent from."""
    short = sets.select("node", "n", "held", F.explode("rare").alias("mark"))
    return (
        short.join(named(short), "mark")
        .where(F.col("node") < F.col("x_node"))
        .where(fits(*map(F.col, ("n", "held", "x_n", "x_held"))))
        .select(F.col("node").alias("a"), F.col("x_node").alias("b"))
        .distinct()
    )


def stars(sets: DataFrame) -> DataFrame:
    """Pairs of each long list's hub with its others: no more than there are entries.

    The hub is the set with the fewest tokens that are not frequent: of near copies
    the one with the fewest edits, to which most of them link.
    """
    long = sets.select("node", "n", "often", F.explode("common").alias("mark"))
    hub = F.min(F.struct((F.col("n") - F.col("often")).alias("own"), "node", "n", "often"))
    hubs = long.groupBy("mark").agg(hub.alias("hub"), F.count("*").alias("size")).where("size > 1")
    hubs = hubs.select("mark", *[F.col(f"hub.{c}").alias(f"x_{c}") for c in ("node", "n", "often")])
    return (
        long.join(pinned(hubs), "mark")
        .where("node != x_node")
        .where(fits(*map(F.col, ("n", "often", "x_n", "x_often"))))
        .select(F.least("node", "x_node").alias("a"), F.greatest("node", "x_node").alias("b"))
        .distinct()
    )


def crossing(sets: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of a long list whose nodes the links do not join yet.

    Lists of one component go first. Of the others the most frequent component
    meets the rest, but never itself. A set comes here if its prefix reaches the
    frequent tokens, so all its rare tokens are in it: sets that share one have met
    in a short list, and the others share frequent tokens only. Linked sets differ in
    at most a ninth of their tokens, so in no more bits of their parity.
    """
    bits = [f"p{i}" for i in range(4)]
    parts = [F.get("parity", F.lit(i)).alias(p) for i, p in enumerate(bits)]
    placed = (
        sets.where("common is not null")
        .select("node", "n", "often", *parts, "common")
        .join(components(links), "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .select("node", "n", "often", *bits, "component", F.explode("common").alias("mark"))
    )
    ends = placed.groupBy("mark").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    rest = pinned(placed.join(pinned(ends.where("low < high").select("mark")), "mark"))
    main = (
        rest.groupBy("mark", "component")
        .agg(F.count("*").alias("size"))
        .groupBy("mark")
        .agg(F.max_by("component", F.struct("size", "component")).alias("main"))
    )
    few = rest.join(pinned(main), "mark").where("component != main")
    differ = reduce(add, [F.bit_count(F.col(p).bitwiseXOR(F.col(f"x_{p}"))) for p in bits])
    return (
        named(few.drop("main"))
        .join(rest, "mark")
        .where("component != x_component")
        .where(fits(*map(F.col, ("n", "often", "x_n", "x_often"))))
        .where((NUMERATOR + DENOMINATOR) * differ <= F.col("n") + F.col("x_n"))
        .select(F.least("node", "x_node").alias("a"), F.greatest("node", "x_node").alias("b"))
        .distinct()
    )


def equal_sets(found: DataFrame) -> DataFrame:
    """Links of the nodes of one set in several shards."""
    key = ["key_a", "key_b", "n"]
    own = found.where("n > 0 and node is not null").select(*key, "node")
    several = own.groupBy(*key).agg(F.min("node").alias("a"), F.count("*").alias("size")).where("size > 1")
    return own.join(several, key).where("node != a").select("a", F.col("node").alias("b"))


def equal_ids(found: DataFrame) -> DataFrame:
    """Links of the nodes of an id that occurs with several texts; none as a rule."""
    own = found.where("n > 0 and node is not null").select("node", F.explode("ids").alias("id"))
    several = own.where("id is not null").groupBy("id").agg(F.collect_set("node").alias("all"))
    return several.where(F.size("all") > 1).select(F.array_min("all").alias("a"), F.explode("all").alias("b"))


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT
) -> DataFrame:
    """One row per input row: id, ``n_shingles`` and ``component_id``.

    A text's set are its distinct five-word shingles, A-Z lower-cased (with fewer
    words, all of them as one); sets link from a Jaccard similarity of 0.8 on;
    ``component_id`` is the smallest id that links reach.

    1. Equal sets of a shard are one node; those of different shards are linked.
    2. Tokens are counted over all sets, and every set is indexed by a prefix of its
       tokens, rarest first (see ``signatures``): those that no other set has need no
       entry, rare ones are entered alone, those that ``frequent`` sets have in
       combinations, for which the prefix is extended.
    3. All pairs of the short lists of rare tokens, and in each other list the pairs
       with its hub, are candidates: in proportion to the entries. Those
       whose prefixes rule a link out go; of the others the whole sets are taken
       from the texts and compared.
    4. Long lists that still hold several components give the pairs across them,
       which are compared in the same way.

    So no link between components is lost, while a large group of near copies
    never becomes all of its pairs.

    Defined cases: null and empty texts have no shingles and are their own
    component; rows that repeat an id are one node with all their texts' links;
    null ids have the component of their equals, or null; an empty table gives an
    empty result. Ids are integers. Other columns are not read. Shingles are known
    by 64-bit hashes.
    """
    count, buckets = shares(docs, text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    shards = pieces(rows, count, "id", "text")
    found = pinned(indexed(shards, answer(ask(shards, buckets), frequent)))
    sets = found.where("node is not null and shared is not null")
    first = pinned(all_pairs(sets).union(stars(sets)).distinct())
    links = verified(pinned(possible(first, sets)), rows).unionByName(equal_sets(found))
    others = crossing(sets, links).join(first, ["a", "b"], "left_anti")
    links = links.unionByName(verified(pinned(possible(others, sets)), rows))
    final = components(links.unionByName(equal_ids(found)))
    member = (
        found.where("n > 0")
        .select("n", "node", F.explode("ids").alias("id"))
        .join(final, "node", "left")
        .select("id", "n", F.coalesce("component", "node").alias("component"))
    )
    none = found.where("n = 0").select(F.explode("ids").alias("id")).select("id", F.lit(0).cast("long"), "id")
    return member.union(none).toDF(id_col, "n_shingles", "component_id")
