"""Operators on awkward rows, on other parameters, and their parts."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import plain
from awkward_rows import PROSE, ROWS
from parley.llm import blocks, jaccard_join, language_id, stages, suffix_dedup
from parley.llm.byte_bpe import Encoder, decode, encode, read_ranks
from parley.llm.exact_dedup import exact_groups, without_copies
from parley.llm.graph import components
from parley.llm.hmm_lm import score_texts
from parley.llm.jaccard_join import near_groups
from parley.llm.language_id import learn, predict
from parley.llm.mixing import copy_counts, mix
from parley.llm.quality_rules import judge, learn_rules, text_statistics
from parley.llm.queries import vocabulary
from parley.llm.sharding import kd_shards
from parley.llm.suffix_dedup import repeated_passages
from parley.llm.warc import LoserTree, archive_pages, read_archives, write_archives

TEXT = {r[0]: r[1] for r in ROWS}


def test_suffix_dedup_awkward(awkward):
    rows = repeated_passages(awkward).collect()
    in_order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected = plain.repeated_bytes([r[1] for r in in_order])
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)
    assert got == sorted(expected)


@pytest.mark.parametrize("hot", [2, 512])
def test_suffix_dedup_passages(spark, hot):
    """Passages of all lengths around the limit, dealt over texts, with hot and plain anchors."""
    rng = random.Random(hot)
    letters = "abcdefghij "
    passage = ["".join(rng.choice(letters) for _ in range(n)) for n in (99, 100, 101, 150, 400)]
    texts = []
    for _ in range(120):
        parts = [rng.choice(passage) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(60))]
        parts += ["".join(rng.choice(letters) for _ in range(rng.randrange(80))), rng.choice(passage)[rng.randrange(30) :]]
        texts.append("".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(repeated_passages(docs, hot=hot).collect())
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == plain.repeated_bytes(texts)
    for r, text in zip(rows, texts, strict=True):
        data, at, rest = text.encode(), 0, b""
        for a, b in r.spans:
            rest, at = rest + data[at:a], b
        assert hashlib.sha256(rest + data[at:]).hexdigest() == r.kept_sha256


@settings(max_examples=60, deadline=None)
@given(st.text("ab", min_size=1, max_size=300))
def test_suffix_array(text):
    data = np.frombuffer(text.encode(), np.uint8)
    words = suffix_dedup.packed_words(data)
    order = suffix_dedup.suffix_array(data, words)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    common = suffix_dedup.common_prefixes(order, words)
    for k in range(1, len(text)):
        a, b = text[order[k - 1] :], text[order[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[k] == min(n, suffix_dedup.LENGTH)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    """With a hash of few values the bytes decide."""
    import pyarrow as pa

    weak = lambda sums, a, b: blocks.range_hashes(sums, a, b) % np.uint64(3)
    monkeypatch.setattr(suffix_dedup, "range_hashes", weak)
    rng = np.random.default_rng(1)
    base = rng.integers(97, 123, 140).astype(np.uint8)
    other = rng.integers(97, 123, 140).astype(np.uint8)
    runs = [(5, base), (3, other), (4, base)]
    table = pa.table(
        {
            "id": [np.int64(i).tobytes() for i, _ in runs],
            "row": [np.int32(0).tobytes()] * 3,
            "place": [np.int64(10).tobytes()] * 3,
            "count": [np.int32(41).tobytes()] * 3,
            "data": [d.tobytes() for _, d in runs],
        }
    )
    run, row, place, number = suffix_dedup.cross_repeats(table)
    assert (run.tolist(), row.tolist(), place.tolist(), number.tolist()) == ([0], [0], [10], [41])


def test_statistics_awkward(awkward):
    for r in text_statistics(awkward).collect():
        if r.doc_id is not None:
            got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert got == plain.statistics(TEXT[r.doc_id])


def test_quality_without_labels(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = judge(awkward, none).collect()
    assert len(rows) == len(ROWS) and all(r.kept == (not r.base_failed) for r in rows)
    labels = spark.createDataFrame([(1, 0), (1, None), (3, 1), (None, 0), (99, 0)], "doc_id long, quality int")
    assert judge(awkward, labels).count() == len(ROWS)
    assert judge(empty, labels).count() == 0


def test_rules_find_planted_thresholds(spark):
    """Bad rows are those of many symbols, or of long words with capitals."""
    rows = spark.range(6000).select(
        F.lit(100).alias("n_words"),
        (F.lit(300) + F.pmod(F.xxhash64("id"), F.lit(600))).alias("word_chars"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)).alias("n_symbols"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(90)).alias("n_upper"),
        *[F.lit(10).alias(c) for c in ("n_lines", "n_dup_lines", "n_repeat_words", "n_marks", "n_digits")],
    )
    bad = F.expr("n_symbols / word_chars > 0.12 or (word_chars > 700 and n_upper > 60)")
    rules = learn_rules(rows.withColumn("_bad", bad))
    from parley.llm.quality_rules import verdict

    wrong = rows.where(verdict(rules) == bad).count()
    assert rules and wrong < 0.06 * 6000
    assert {t.feature for r in rules for t in r} >= {"symbol_share"}


def planted_rules(spark, rows, bad, **options):
    """The rules for rows of 100 words, 300 letters and 10 lines; other counts are 0 unless given."""
    base = {"n_words": 100, "word_chars": 300, "n_lines": 10}
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits")
    rows = rows.select("id", *[rows[c] if c in rows.columns else F.lit(base.get(c, 0)).alias(c) for c in names])
    return rows, learn_rules(rows.withColumn("_bad", F.expr(bad)), **options)


def test_rules_find_rare_kinds(spark):
    """Repeated lines in one of 200 texts, all others without any."""
    from parley.llm.quality_rules import verdict

    rare = "id % 200 = 7"
    rows, rules = planted_rules(
        spark,
        spark.range(8000).select(
            "id",
            F.expr(f"if({rare}, 3 + id % 5, 0)").alias("n_dup_lines"),
            F.pmod(F.xxhash64("id"), F.lit(90)).alias("n_upper"),
            F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3000)).cast("long").alias("n_repeat_words"),
        ),
        rare,
    )
    assert rows.where(verdict(rules) == F.expr(rare)).count() == 0


def test_rules_go_on(spark):
    """Nine separate ranges of bad rows, and some with digits."""
    from parley.llm.quality_rules import verdict

    bad = "(n_upper div 10) % 2 = 1 or n_digits > 0"
    rows, rules = planted_rules(
        spark,
        spark.range(6000).select(
            "id",
            F.pmod(F.xxhash64("id"), F.lit(180)).alias("n_upper"),
            F.expr("if(id % 200 = 3, 9, 0)").alias("n_digits"),
            F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3000)).cast("long").alias("n_repeat_words"),
        ),
        bad,
        max_tests=2,
    )
    assert len(rules) > 8
    assert rows.where(verdict(rules) == F.expr(bad)).count() < 0.02 * 6000


def test_exact_groups_awkward(awkward, empty):
    rows = exact_groups(awkward).collect()
    assert len(rows) == len(ROWS)
    by = {(r.doc_id, r.keep_id): r for r in rows}
    assert by[1, 2].group_size == 2 and not by[1, 2].kept and by[2, 2].kept
    assert by[4, 5].group_size == 2 and by[5, 5].kept
    assert by[7, 8].group_size == 2
    nine = [r for r in rows if r.doc_id == 9]
    assert [r.group_size for r in nine] == [2, 2] and sorted(r.kept for r in nine) == [False, True]
    assert exact_groups(empty).count() == 0
    stay = without_copies(awkward)
    assert stay.columns == awkward.columns
    assert stay.count() == sum(r.kept for r in rows) == len(ROWS) - 4


def test_exact_groups_keep_smallest(awkward):
    kept = {r.doc_id for r in exact_groups(awkward, keep="smallest").collect() if r.kept}
    assert {1, 4, 7} <= kept and not {2, 5, 8} & kept


def test_exact_groups_split_collisions(spark, monkeypatch):
    """With a hash that always collides the texts decide."""
    monkeypatch.setattr(F, "md5", lambda text: F.lit("00"))
    docs = spark.createDataFrame([(1, "a"), (2, "B"), (3, "b"), (4, "c"), (5, "A")], "doc_id long, text string")
    rows = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_groups(docs).collect()}
    assert rows == {
        1: (5, 2, False),
        5: (5, 2, True),
        2: (3, 2, False),
        3: (3, 2, True),
        4: (4, 1, True),
    }


def test_language_awkward(awkward, empty):
    model = learn(awkward, F.lit(True))
    rows = predict(awkward, model).collect()
    found = {r.doc_id: r.lang_pred for r in rows}
    assert len(rows) == len(ROWS) and found[4] == found[5] == found[6] == found[10] == "und"
    assert found[9] == "fr" and found[1] == "en"
    assert learn(empty, F.lit(True)) is None
    assert {r.lang_pred for r in predict(awkward, None).collect()} == {"und"}


def test_unseen_words_fall_back_to_ngrams(spark):
    docs = spark.createDataFrame(
        [(i, t, x) for i in range(40) for t, x in (("waren wichtig richtig", "de"), ("where which when", "en"))],
        "doc_id long, text string, lang string",
    )
    model = learn(docs, F.lit(True))
    ask = spark.createDataFrame([(1, "nichtig"), (2, "whenever"), (3, "qqq")], "doc_id long, text string")
    assert [r.lang_pred for r in predict(ask, model).orderBy("doc_id").collect()][:2] == ["de", "en"]


def test_rare_languages_are_learned(spark):
    """One in 1,000 rows is Icelandic, and a word is one in 30,000 of the English ones."""
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.expr(
            "case when id % 1000 = 7 then 'þetta er íslenska' when id = 11 then 'ceterum' "
            "else 'where which when this that these those other' end"
        ).alias("text"),
        F.expr("if(id % 1000 = 7, 'is', 'en')").alias("lang"),
    )
    ask = spark.createDataFrame([(1, "þetta er"), (2, "which ceterum")], "doc_id long, text string")
    for sample in (100, 20_000):
        model = learn(docs, F.lit(True), sample_rows=sample)
        assert model.languages == ["en", "is"]
        assert [r.lang_pred for r in predict(ask, model).orderBy("doc_id").collect()] == ["is", "en"]
    codes = language_id.code_points("ceterum")
    assert model.words.find(language_id.word_keys(codes, np.array([0]), np.array([7]))) >= 0
    same = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert learn(same, F.lit(True), sample_rows=1).languages == ["en", "is"]


PAGES = [
    (5, "https://www.Example.org/b?x=1#top", "<p>same</p>"),
    (2, "http://example.org/a", "<p>same</p>"),
    (3, None, None),
    (4, "http://b.example.org/ \n space", ""),
    (6, "http://example.org/a", "head\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n é\U0001f600"),
    (7, "http://example.org/a", "head\r\n\r\n" * 20_000),
]


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = archive_pages(pages, f"file://{tmp_path}/warc").orderBy("place").collect()
    assert [r.place for r in rows] == list(range(6))
    assert [(r.url_key, r.ts, r.page_id) for r in rows] == sorted((r.url_key, r.ts, r.page_id) for r in rows)
    by = {r.page_id: r for r in rows}
    assert (by[2].record_type, by[5].record_type, by[5].refers_to) == ("response", "revisit", 2)
    assert (by[3].record_type, by[4].record_type, by[4].refers_to) == ("response", "revisit", 3)
    assert by[5].url_key == "org,example)/b?x=1" and by[3].url_key == ""
    assert {i: by[i].payload_bytes for i in by} == {p: len((h or "").encode()) for p, _, h in PAGES}
    import base64

    for p, _, h in PAGES:
        assert by[p].payload_digest == base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()


def test_archives_least_payload(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    write_archives(pages, f"file://{tmp_path}/warc", least=5)
    kinds = {r.page_id: r.record_type for r in read_archives(spark, f"file://{tmp_path}/warc").collect()}
    assert kinds == {5: "revisit", 2: "response", 3: "response", 4: "response", 6: "response", 7: "response"}


def test_archives_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert archive_pages(pages, f"file://{tmp_path}/warc").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50)), max_size=9))
def test_loser_tree(runs):
    assert list(LoserTree([iter(sorted(r)) for r in runs])) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("frequent", [2, 16])
def test_near_groups(spark, frequent):
    """Chains of edits, shared passages and short texts, with rare and frequent tokens."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(25):
        text = [rng.choice(words) for _ in range(rng.choice([3, 6, 30, 90, 300, 700]))]
        for _ in range(8):
            texts.append(" ".join(text + (passage if rng.random() < 0.3 else [])))
            for _ in range(max(1, len(text) // 60)):
                text = list(text)
                text[rng.randrange(len(text))] = rng.choice(words)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_groups(docs, frequent=frequent).collect()
    expected = plain.groups(list(enumerate(texts)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected


def test_near_groups_awkward(awkward, empty):
    rows = near_groups(awkward).collect()
    assert len(rows) == len(ROWS)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert found[2] == (found[1][0], 1) and found[8] == (1, 7) and found[5] == (0, 5) and found[4] == (0, 4)
    assert found[None][1] is None
    assert near_groups(empty).count() == 0


def test_modes_keep_their_promise():
    """Linked sizes meet in a mode, which has more groups than they have differences."""
    for n in range(1, 3000):
        own = {m: (g, d) for m, g, d in jaccard_join.modes(n)}
        assert 1 <= len(own) <= 3
        for other in range(-(-4 * n // 5), n + 1):
            both = [m for m, _, _ in jaccard_join.modes(other) if m in own]
            assert any(own[m][0] > own[m][1] >= (n + other) // 9 for m in both)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    expected = {x: find(x) for link in links if link[0] != link[1] for x in link}
    assert {r.node: r.component for r in rows} == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shards_awkward(awkward, empty):
    rows = kd_shards(awkward, shards=4).collect()
    assert len(rows) == len(ROWS) and sum(r.size for r in rows) == sum(len((r[1] or "").encode()) + 1 for r in ROWS)
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert kd_shards(empty, shards=16).count() == 0


def test_shards_are_even_whatever_the_metadata(spark):
    """One source holds all rows, many texts are equal; leaves of a number that is no power of two."""
    docs = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.lit("x" * 50).alias("text"), F.lit("s").alias("source"), F.lit(50).alias("n_chars")
    )
    sizes = [r["n"] for r in kd_shards(docs, shards=7).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) < 0.02 * sum(sizes) / 7
    again = kd_shards(docs, target_bytes=51 * 700, dims=["source"])
    assert again.select("shard").distinct().count() == 8


def test_mix_awkward(awkward, empty):
    rows = copy_counts(awkward).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.source_size, r.target)
        assert 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size
    out = mix(awkward)
    assert out.columns == awkward.columns
    assert out.count() == sum(r.copies for r in rows)
    assert copy_counts(empty).count() == 0 and mix(empty).count() == 0


def test_mix_rates(spark):
    """Two of three sources stop at twice their size; the rest goes to the third."""
    docs = spark.createDataFrame(
        [(i, "w " * 10, "a" if i < 10 else "b" if i < 40 else "c") for i in range(1000)],
        "doc_id long, text string, source string",
    )
    rows = copy_counts(docs).collect()
    target = {r.source_size: r.target for r in rows}
    assert target == {100: 200.0, 300: 600.0, 9600: pytest.approx(15000 - 800)}
    assert sum(r.taken for r in rows) == pytest.approx(15000, rel=0.05)


@pytest.fixture(scope="module")
def coder():
    import tiktoken

    path, pattern = vocabulary()
    ranks = read_ranks(path)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return Encoder(ranks, pattern), own


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text("aab nst'\n1é", max_size=400)))
def test_encoder(coder, text):
    text = text.encode("utf-8", "ignore").decode()
    assert coder[0].encode(text) == coder[1].encode_ordinary(text)


def test_long_pretoken(coder):
    for text in ("ab" * 20_000, "a" * 30_000, "thequickbrownfox" * 2_000):
        assert coder[0].encode(text) == coder[1].encode_ordinary(text)


def test_encode_awkward(awkward, empty, coder):
    path, pattern = vocabulary()
    coded = decode(encode(awkward, path, pattern), path)
    rows = coded.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        text = TEXT[r.doc_id] or ""
        assert r.ids == coder[1].encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert encode(empty, path, pattern).count() == 0


def test_language_model_awkward(awkward, empty):
    rows = score_texts(awkward).collect()
    assert len(rows) == len(ROWS)
    assert {r.doc_id: r.n_tokens for r in rows}[4] == 1
    assert all(np.isfinite([r.base_score, r.score]).all() for r in rows)
    assert score_texts(empty).count() == 0


def test_likelihoods_sum_to_one():
    """Probabilities of all texts of a length make one; expected counts are those of all paths."""
    from itertools import product

    from parley.llm.hmm_lm import CLASSES, Lanes, Markov, expected, log_likelihoods

    rng = np.random.default_rng(0)
    emit = np.zeros((CLASSES, 2))
    emit[:4] = rng.random((4, 2))
    emit /= emit.sum(0)
    model = Markov(np.array([0.3, 0.7]), np.array([[0.8, 0.2], [0.4, 0.6]]), emit)
    every = [np.array(x, np.uint16) for x in product(range(4), repeat=4)]
    assert np.exp(log_likelihoods(model, every)).sum() == pytest.approx(1)
    texts = [rng.integers(0, 4, n).astype(np.uint16) for n in (6, 5, 5, 1)]
    by_token, starts, steps, total = np.zeros((4, 2)), np.zeros(2), np.zeros((2, 2)), 0.0
    for text in texts:
        paths = list(product(range(2), repeat=len(text)))
        weight = []
        for p in paths:
            w = model.start[p[0]] * emit[text[0], p[0]]
            for t in range(1, len(text)):
                w *= model.step[p[t - 1], p[t]] * emit[text[t], p[t]]
            weight.append(w)
        total += np.log(sum(weight))
        for p, w in zip(paths, np.array(weight) / sum(weight), strict=True):
            starts[p[0]] += w
            for t, x in enumerate(text):
                by_token[x, p[t]] += w
                if t:
                    steps[p[t - 1], p[t]] += w
    sums = expected(model, Lanes.of(texts))
    assert sums[:6] == pytest.approx([*starts, *steps.ravel()])
    assert sums[6:14] == pytest.approx(by_token.ravel()) and not sums[14:-2].any()
    assert sums[-2:] == pytest.approx([total, 17])


def test_prose_is_clean(awkward):
    rows = {r.doc_id: r for r in predict(awkward, learn(awkward, F.lit(True))).collect()}
    assert rows[1].score > 0.5 and PROSE


def test_stage_decodes(spark, awkward, monkeypatch):
    """The last stage gives all rows, and fails when a token is missing."""
    whole = stages.encode_texts(spark, awkward, "")
    assert whole.columns == ["doc_id", "ids", "n_tokens"] and len(whole.collect()) == len(ROWS)
    real = stages.encode
    monkeypatch.setattr(
        stages, "encode", lambda *a, **b: real(*a, **b).withColumn("whole", F.col("whole") & (F.size("ids") < 99))
    )
    with pytest.raises(Exception, match="do not decode"):
        stages.encode_texts(spark, awkward, "").collect()
    path, pattern = vocabulary()
    coder = Encoder(read_ranks(path), pattern)
    ids = coder.encode("Été à la plage \U0001f600")
    assert coder.gives(ids, "Été à la plage \U0001f600") and coder.gives([], "")
    assert not coder.gives(ids[1:], "Été à la plage \U0001f600") and not coder.gives(ids + [0], "Été à la plage \U0001f600")


def test_stages_keep_columns(spark, awkward, empty):
    """No stage but the last loses a column or a value, whatever the names; empty tables stay empty."""
    for name, stage in stages.STAGES[:-1]:
        out = stage(spark, awkward, "")
        assert out.schema.fieldNames() == awkward.schema.fieldNames(), name
        given = {tuple(r) for r in awkward.collect()}
        assert {tuple(r) for r in out.collect()} <= given, name
        assert stage(spark, empty, "").count() == 0, name


def test_near_copies_without_or_with_shared_ids(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[a : a + 60]) for a in range(0, 300, 60)]
    near = texts[0] + " end"
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (6, near), (5, None), (7, near), (5, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = stages.drop_near_copies(spark, docs, "")
    expected = [(None, texts[1]), (5, None), (5, texts[2]), (5, texts[3]), (6, near)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(map(tuple, kept.collect()), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("letters", [40, 1 << 19])
def test_language_matches_plain_backoff(spark, sf, awkward, monkeypatch, letters):
    monkeypatch.setattr(language_id, "BLOCK_LETTERS", letters)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(awkward.select("doc_id", "text", "lang").where("doc_id <> 11 or text is null"))
    rows = [tuple(r) for r in docs.collect()]
    learned = [(t, x) for i, t, x in rows if i is not None and i % 3]
    expected = plain.languages(learned, [t for _, t, _ in rows])
    model = learn(docs, F.col("doc_id") % 3 != 0)
    found = {(r[0], r[1]): (r["lang_pred"], r["score"]) for r in docs.select("doc_id", "text", language_id.language_of(F.col("text"), model).alias("x")).select("doc_id", "text", "x.*").collect()}
    for (i, t, _), (name, score) in zip(rows, expected):
        assert found[i, t][0] == name and found[i, t][1] == pytest.approx(score, abs=1e-4), (i, name)


def test_unspaced_scripts(spark):
    """Words of 120 letters teach their n-grams, however long they are."""
    draw = random.Random(2)
    thai, lao = [chr(c) for c in range(0x0E01, 0x0E2F)], [chr(c) for c in range(0x0E81, 0x0EAF) if chr(c).isalpha()]

    def run(letters):
        return "".join(draw.choices(letters, k=120))

    rows = [(run(thai), "th") for _ in range(200)] + [(run(lao), "lo") for _ in range(40)]
    rows += [("where which when this that these those other", "en")] * 400
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    ask = spark.createDataFrame([(1, run(thai)), (2, run(lao)), (3, "which other")], "doc_id long, text string")
    found = predict(ask, learn(docs, F.lit(True))).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in found] == ["th", "lo", "en"] and all(r["score"] > 0.5 for r in found)


def test_word_keys_tell_words_apart():
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("", *"klmnopqrstuvwxyz")] + ["ab" * 9, "ba" * 9, "a" * 99]
    codes = language_id.code_points(" ".join(words))
    starts, ends = language_id.letter_runs(codes)
    keys = language_id.word_keys(codes, starts, ends)
    assert len(set(keys.tolist())) == len(set(words)) == len(keys)
    for w, k in zip(words, keys):
        own = language_id.code_points(w)
        assert language_id.word_keys(own, np.array([0]), np.array([len(w)])).tolist() == [k]
