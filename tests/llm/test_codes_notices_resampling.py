"""Vector codes, licence notices and importance resampling against plain versions and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as driver
from parley.llm import importance, license_scan, vector_codes

import plain

NAMES = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# vector codes


def plain_codes(rows, parts, entries, rounds, scale):
    """Lloyd's rounds in which every part meets every entry; ``rows`` are (id, vector, label)."""
    kept = [r for r in rows if r[1] and len(r[1]) % parts == 0]
    kept = [r for r in kept if all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = [
        [tuple(math.floor(scale * x) for x in v[p * width : (p + 1) * width]) for p in range(parts)]
        for _, v, _ in kept
    ]
    books = [[row[p] for row in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for row in cut:
                members[nearest(row[p], books[p])[1]].append(row[p])
            books[p] = [
                tuple(sum(c) // len(members[k]) for c in zip(*members[k])) if members[k] else old
                for k, old in enumerate(books[p])
            ]
    found = [[nearest(row[p], books[p]) for p in range(parts)] for row in cut]
    sums = Counter()
    for (_, _, label), f in zip(kept, found):
        sums[label] += sum(d for d, _ in f)
    text = ",".join(str(x) for book in books for c in book for x in c)
    sha = hashlib.sha256(text.encode()).hexdigest()
    return [
        (i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), sums[label], sha)
        for (i, _, label), f in zip(kept, found)
    ]


VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("code", T.StringType()),
        T.StructField("_id", T.StringType()),
        T.StructField("_label", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def vector_rows(seed, n, places):
    draw = random.Random(seed)
    rows = [(i, [draw.choice(places) for _ in range(8)], draw.choice([0, 1, None])) for i in range(n)]
    rows += [
        (2000, None, 1),
        (2001, [], 1),
        (2002, [None] + [0.5] * 7, 1),
        (2003, [math.nan] * 8, 1),
        (2004, [math.inf] + [0.5] * 7, 1),
        (2005, [0.5] * 7, 1),
        (2006, [0.5] * 4, 1),
        (None, [0.25] * 8, 2),
        (5, [0.125] * 8, 2),
        (5, [0.125] * 8, 2),
    ]
    draw.shuffle(rows)
    return rows


def codes(spark, rows, **options):
    df = spark.createDataFrame([(*r, "c", "i", "l", "e") for r in rows], VECTORS).repartition(3)
    return by_id(tuple(r) for r in vector_codes.compress(df, **options).collect())


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:3]))


@pytest.mark.parametrize("places", [(-0.5, -0.25, 0.0, 0.25), tuple(x / 97 for x in range(-60, 60))])
def test_codes_match_plain_rounds(spark, monkeypatch, places):
    monkeypatch.setattr(vector_codes, "BLOCK_VECTORS", 7)
    rows = vector_rows(1, 60, places)
    options = {"parts": 4, "entries": 6, "rounds": 5, "scale": 64}
    assert codes(spark, rows, **options) == by_id(plain_codes(rows, **options))


def test_codes_of_few_and_of_no_vectors(spark):
    few = [(1, [0.5, 0.25], 0), (2, [-0.5, 0.25], None)]
    options = {"parts": 2, "entries": 16, "rounds": 6, "scale": 4096}
    assert codes(spark, few, **options) == by_id(plain_codes(few, **options))
    assert codes(spark, [], **options) == []
    assert codes(spark, [(1, None, 0)], **options) == []


def test_codes_of_huge_components(spark):
    rows = [(i, [x, 1.0], 0) for i, x in enumerate((1e300, -1e300, 0.0))]
    found = codes(spark, rows, parts=1, entries=1, rounds=0)
    bound = math.isqrt((1 << 63) // 2) // 2 - 1
    assert [r[2] for r in found] == [0, (2 * bound) ** 2, bound**2]
    assert found[0][3] is None or found[0][3] == sum(r[2] for r in found)


def test_query_codes_match_plain_rounds(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    found = driver.queries()["op11_vector_codes"](spark, sf).collect()
    assert sorted(map(tuple, found)) == sorted(plain_codes(rows, 8, 16, 6, 4096))


def test_only_moved_entries_are_compared(spark, monkeypatch):
    """The stored distances decide: parts whose entry stayed never meet an entry that stayed."""
    import numpy as np

    met = []
    plain_compare = vector_codes.least_entries

    def compare(vectors, books, entries, best, code):
        met.append((vectors.shape[1], list(entries)))
        plain_compare(vectors, books, entries, best, code)

    monkeypatch.setattr(vector_codes, "least_entries", compare)
    vectors = np.array([[[0, 1, 10, 11, 20]]])
    books = np.array([[[0], [9], [20]]])
    code, best = np.zeros((1, 5), dtype=np.int64), np.zeros((1, 5), dtype=np.int64)
    vector_codes.assigned(vectors, books, np.ones((1, 3), dtype=bool), code, best)
    assert code.tolist() == [[0, 0, 1, 1, 2]]
    met.clear()
    books[0, 1] = 1
    vector_codes.assigned(vectors, books, np.array([[False, True, False]]), code, best)
    assert met == [(3, [1]), (2, [0, 1, 2])]
    assert code.tolist() == [[0, 1, 1, 2, 2]] and best.tolist() == [[0, 0, 81, 81, 0]]


# licence notices


def plain_notices(text, notices=license_scan.NOTICES):
    """Words, base places, base labels, labels and best share, from the whole text at once."""
    words = NAMES.findall(plain.lower(text))
    line = " " + " ".join(words) + " " if words else "  "
    places, base, labels, best = [], set(), set(), 0.0
    for n in notices:
        phrase = n.text.replace("[", "").replace("]", "").split(" ")
        here = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        if n.base:
            places += here
            base |= {n.label} if here else set()
        m = regex.search(license_scan.pattern_of(n), line, flags=regex.BESTMATCH)
        if m:
            labels.add(n.label)
            best = max(best, 1 - sum(m.fuzzy_counts) / len(n.phrase))
    first, last = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), best


def fuzzed(seed):
    """Texts with notices of which some letters are lost, doubled or changed."""
    draw = random.Random(seed)
    filler = "under the sea by nc a license of version 2 apache cc mit licence rights".split()
    out = []
    for _ in range(150):
        words = []
        for _ in range(draw.randrange(1, 9)):
            words += draw.choices(filler, k=draw.randrange(0, 5))
            notice = list(draw.choice(license_scan.NOTICES).phrase)
            for _ in range(draw.randrange(0, 5)):
                at = draw.randrange(len(notice))
                notice[at] = draw.choice(["", notice[at] * 2, "x", " "])
            words.append("".join(notice))
        out.append(draw.choice([" ", ", ", "\n", " - "]).join(words))
    return out


TEXTS = [
    None,
    "",
    " \n ",
    "Released under the MIT License. Released under the MIT License.",
    "under the mit licence",
    "under the mpl license, under the m.i.t license, UNDER THE\tMIT LICENSE",
    "cc by nd; cc-by-nc; CC BY NC 4.0; ccbync",
    "Apache License, Version 1.1",
    "apache licence vresion 2 and Apache License Version 2.0",
    "xunder the mit license, under the mit licenses",
    "Été under the mit license été",
    "Kunder the mit license İ under the mit\x7flicense",
    "under the mit " * 500 + "license",
    "a" * 300_000 + " all rights reserv",
]


def test_notices_match_whole_text_search(spark, monkeypatch):
    texts = TEXTS + fuzzed(7)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: tuple(r)[1:] for r in license_scan.summary(license_scan.scan(df)).collect()}
    for i, text in enumerate(texts):
        expected = plain_notices(text)
        assert found[i][:-1] == expected[:-1], text
        assert found[i][-1] == pytest.approx(expected[-1]), text


def test_query_notices_match_whole_text_search(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = driver.queries()["op12_license_scan"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected = plain_notices(texts[r["doc_id"]])
        assert tuple(r)[1:-1] == expected[:-1] and r["score"] == pytest.approx(expected[-1])


def test_notice_spans(spark):
    text = "Code is under the MIT licence, docs under the mit license; apache license version 2"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = license_scan.scan(df, license_scan.BASE).collect()
    spans = [(s["label"], s["first_word"], s["last_word"], s["edits"], s["base"]) for s in row["spans"]]
    assert spans == [("mit", 2, 5, 1, False), ("mit", 7, 10, 0, True), ("apache-2", 11, 14, 0, True)]
    (row,) = license_scan.scan(df, ()).collect()
    assert row["spans"] == [] and row["n_words"] == 15


def test_other_licences_are_left_alone():
    scanner = license_scan.Scanner(license_scan.NOTICES)
    for text in ("under the isc license", "under the mpl license", "cc by nd", "apache license version 1", "mit libraries"):
        assert scanner.spans(license_scan.normalised(text)) == [], text


def test_notices_of_awkward_rows(awkward, empty):
    found = license_scan.summary(license_scan.scan(awkward))
    rows = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == awkward.count()
    for r in awkward.collect():
        assert rows[r["doc_id"]]["n_words"] == len(NAMES.findall(plain.lower(r["text"])))
    assert license_scan.summary(license_scan.scan(empty)).count() == 0


# importance resampling


def plain_resample(docs, target, most=1, buckets=10_000, least=20, percent=10, seed=2024):
    def runs(text):
        words = NAMES.findall(plain.lower(text))
        return len(words), [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]

    def bucket(x):
        return zlib.crc32(x.encode()) % buckets

    own = [(i, *runs(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, found in own:
        s.update(map(bucket, found))
    for x in target:
        t.update(map(bucket, runs(x)[1]))
    top, low = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for i, words, found in own:
        gains = [math.floor(1000 * math.log(((t[b] + 1) * top) / ((s[b] + 1) * low))) for b in map(bucket, found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(found), weight, score, words))
    can = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = can[: len(can) * percent // 100]
    out = [(*r[:4], n) for n, r in enumerate(drawn, 1)]
    left = Counter(rows) - Counter(drawn)
    return out + [(*r[:4], None) for r in left.elements()]


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, x or 0) for x in r])


@pytest.mark.parametrize("options", [{}, {"most": 3, "buckets": 97, "least": 2, "percent": 60, "seed": 7}])
def test_resampling_matches_plain_version(spark, awkward, monkeypatch, options):
    monkeypatch.setattr(importance, "BLOCK_BYTES", 1000)
    draw = random.Random(3)
    names = [f"w{i}" for i in range(40)] + ["Été", "\U0001f600", "x\x00y"]
    texts = [(draw.randrange(-40, 60), " ".join(draw.choices(names, k=draw.randrange(60)))) for _ in range(120)]
    texts += [(3, "same words " * 15)] * 4
    rows = awkward.select("doc_id", "text").unionByName(
        spark.createDataFrame(texts, "doc_id long, text string")
    )
    target = ["w1 w2 w3", None, "", "w1 W1 the sea"]
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    docs = [tuple(r) for r in rows.collect()]
    own = {"least_words" if k == "least" else k: v for k, v in options.items()}
    found = importance.resample(rows.withColumn("weight", F.lit("x")).withColumn("id", F.lit(1)), aim, **own)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert in_order(found.collect()) == in_order(plain_resample(docs, target, **options))


def test_words_of_blocks_of_a_batch(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(importance, "BLOCK_BYTES", 30)
    texts = ["Aäx bc d", None, "", "ÉÉ ß", "x" * 99, "Gg hß 1-2"] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    found, counts = [], []
    for block in importance.blocks_of(iter([batch.slice(1), batch])):
        _, names, n = importance.features(block.column("text"), 1)
        found += names.to_pylist()
        counts += n.tolist()
    expected = [NAMES.findall(plain.lower(t)) for t in texts[1:] + texts]
    assert found == [w for ws in expected for w in ws]
    assert counts == [len(ws) for ws in expected]


def test_resampling_of_empty_tables(spark, empty, awkward):
    assert importance.resample(empty, empty).count() == 0
    found = importance.resample(awkward, empty, least_words=1, percent=100)
    assert found.where("rank is not null").count() == found.where("n_features > 0").count()
    assert importance.resample(awkward, empty, least_words=10**9).where("rank is not null").count() == 0


def test_radix_sort(spark, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_ROWS", 16)
    monkeypatch.setattr(importance, "DIGIT_BITS", 3)
    draw = random.Random(5)
    rows = [(draw.choice([-7, 0, 3, 900]), draw.choice([None, -3, 5, 1 << 40]), i) for i in range(300)]
    rows += [(3, 5, 1000)] * 50
    df = spark.createDataFrame(rows, "a long, b long, i long").repartition(5)
    found = importance.radix_sorted(df, [F.col("a"), F.col("b"), F.col("i")]).orderBy("_at").collect()
    assert [r["_at"] for r in found] == list(range(350))
    expected = sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2]))
    assert [(r["a"], r["b"], r["i"]) for r in found] == expected
    same = spark.createDataFrame([(1,)] * 20, "a long")
    assert sorted(r["_at"] for r in importance.radix_sorted(same, [F.col("a")]).collect()) == list(range(20))
    assert importance.radix_sorted(same.limit(0), [F.col("a")]).count() == 0


def test_query_resampling_matches_plain_version(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = driver.queries()["op13_importance_resampling"](spark, sf).collect()
    assert in_order(rows) == in_order(plain_resample(docs, target))
