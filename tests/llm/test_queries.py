"""The registered queries against their SQL or a plain version, on the smallest tables."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as driver
from parley.llm import hmm_lm
from parley.llm import queries as corpus
from parley.plans.check import comparable, connect

import plain


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def result(spark, sf, name):
    return driver.queries()[name](spark, sf).collect()


@pytest.mark.parametrize("name", list(corpus.oracles()))
def test_query_matches_sql(spark, sf, name):
    rows = driver.queries()[name](spark, sf)
    names = sorted(rows.columns)
    answer = connect(sf).execute(driver.oracle_sql()[name])
    place = {d[0]: i for i, d in enumerate(answer.description)}
    assert sorted(place) == names
    expected = sorted(tuple(comparable(r[place[c]]) for c in names) for r in answer.fetchall())
    assert sorted(tuple(comparable(r[c]) for c in names) for r in rows.collect()) == expected


def test_every_operator_has_one_query():
    found = [n.split("_")[0] for n in corpus.queries()]
    assert sorted(found) == sorted(f"op{i}" for i in range(1, 14))
    assert "pipeline" in driver.queries()


def test_suffix_dedup(spark, sf, documents):
    rows = sorted(result(spark, sf, "op1_suffix_dedup"), key=lambda r: r.doc_id)
    texts = [r.text for r in sorted(documents, key=lambda r: r.doc_id)]
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == plain.repeated_bytes(texts)


def test_quality_statistics(spark, sf, documents):
    text = {r.doc_id: r.text for r in documents}
    for r in result(spark, sf, "op2_quality_rules"):
        expected = plain.statistics(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_language_accuracy(spark, sf, documents):
    lang = {r.doc_id: r.lang for r in documents}
    rows = result(spark, sf, "op4_language_id")
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in rows)


def test_jaccard_groups(spark, sf, documents):
    expected = plain.groups([(r.doc_id, r.text) for r in documents])
    rows = result(spark, sf, "op6_ngram_jaccard")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected


def test_shards(spark, sf, documents):
    rows = result(spark, sf, "op7_kd_sharding")
    text = {r.doc_id: (r.text or "").encode() for r in documents}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id])) for r in rows)
    total, most = sum(r.size for r in rows), max(r.size for r in rows)
    for shard in range(16):
        own = [r for r in rows if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 16) <= 4 * most
    assert {r.law for r in rows} == {"bytes"}


def test_byte_bpe(spark, sf, documents):
    import tiktoken

    from parley.llm.byte_bpe import read_ranks

    path, pattern = corpus.vocabulary()
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    text = {r.doc_id: r.text or "" for r in documents}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in result(spark, sf, "op9_byte_bpe"):
        ids = coder.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()))
        assert r.decoded_sha256 == sha(text[r.doc_id].encode())


def test_language_model(spark, sf, documents):
    n, expected = plain.base_scores([(r.doc_id, r.text) for r in documents])
    rows = result(spark, sf, "op10_hmm_scores")
    for r in rows:
        held, tokens, known, base = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, n)
        assert r.base_score == pytest.approx(base)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in rows)
    texts = [(r.doc_id, [*plain.WORD.findall(plain.lower(r.text or "")), None]) for r in documents]
    words = sorted({w for _, x in texts for w in x[:-1]})
    key = {w: k[0] for w in words for _, k, _ in hmm_lm.tokens(pa.table({"text": [w]}))}
    key[None] = hmm_lm.END_KEY

    def class_of(word, count):
        return int(hmm_lm.classes_of(np.array([key[word]], np.uint64), np.array([count]))[0])

    def first(share):
        emit = np.array(share)[:, None] * np.random.default_rng(7).uniform(0.5, 1.5, (len(share), 4))
        step = np.full((4, 4), 0.01) + 0.96 * np.eye(4)
        return [0.25] * 4, step.tolist(), (emit / emit.sum(0)).tolist()

    scores, rounds = plain.hidden_markov(texts, class_of, first, hmm_lm.CLASSES, hmm_lm.PARTS, 0.05)
    assert rounds > 2
    for r in rows:
        assert r.score == pytest.approx(scores[r.doc_id], rel=1e-9)


def test_pipeline(spark, sf, documents):
    """Its rows against the plain versions, stage after stage."""
    docs = {r.doc_id: r for r in documents if any(c.isalpha() for c in r.text or "")}
    last = {}
    for i in sorted(docs):
        last[plain.lower(docs[i].text)] = i
    docs = {i: docs[i] for i in last.values()}
    component = plain.groups([(i, r.text) for i, r in docs.items()])
    docs = {i: r for i, r in docs.items() if component[i][1] == i}
    rows = driver.queries()["pipeline"](spark, sf).collect()
    assert {r.doc_id for r in rows} <= set(docs)
    words = {i: len(plain.WORD.findall(r.text)) for i, r in docs.items()}
    sources = sorted({r.source for r in docs.values()})
    size = {s: sum(words[i] for i, r in docs.items() if r.source == s) for s in sources}
    taken = {s: sum(words[r.doc_id] for r in rows if docs[r.doc_id].source == s) for s in sources}
    assert all(taken[s] <= 2 * size[s] for s in sources)
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.15)
    assert {i for i, r in docs.items() if r.source == sources[0]} <= {r.doc_id for r in rows}
