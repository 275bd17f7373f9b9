import math
import random

import numpy as np
import pytest

from parley.operators import dataset, evaluation, models, profiling, speech


# -- word errors -----------------------------------------------------------


def edits(ref, hyp):
    row = list(range(len(hyp) + 1))
    for i, r in enumerate(ref, 1):
        last, row[0] = row[0], i
        for j, h in enumerate(hyp, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (r != h))
    return row[-1]


def test_word_error_rate_equals_the_table_method(spark):
    rng = random.Random(1)
    words = ["a", "b", "ab", "ba", "ça", "x1", "longer", "été"]
    pairs = [
        (i % 2, " ".join(rng.choices(words, k=rng.randrange(1, 30))), " ".join(rng.choices(words, k=rng.randrange(30))))
        for i in range(60)
    ]
    # More distinct words than the basic plane has characters to spare for.
    wide = [f"w{i}" for i in range(3000)]
    pairs.append((0, " ".join(wide), " ".join(wide[5:])))
    df = spark.createDataFrame(pairs, "m int, r string, h string")
    got = {r.m: (r.edits, r.ref_words) for r in evaluation.word_error_rate(df, ["m"], "r", "h").collect()}
    for m in (0, 1):
        chosen = [(r.split(), h.split()) for k, r, h in pairs if k == m and len(r) < 1000]
        total = sum(edits(r, h) for r, h in chosen)
        count = sum(len(r) for r, _ in chosen)
        if m == 0:
            total, count = total + 5, count + 3000
        assert got[m] == (total, count)


def test_word_error_rate_is_a_ratio_of_sums(spark):
    df = spark.createDataFrame([("a b c d", "a b c d"), ("x", "Y!")], "r string, h string")
    row = evaluation.word_error_rate(df, [], "r", "h").first()
    assert (row.edits, row.ref_words, row.wer) == (1, 5, 0.2)


def test_missing_hypotheses_are_edits(spark):
    df = spark.createDataFrame([("a b", None), ("c", ""), ("d", "d"), (None, "x")], "r string, h string")
    row = evaluation.word_error_rate(df, [], "r", "h").first()
    assert (row.edits, row.ref_words, row.wer) == (4, 4, 1.0)


# -- classes ---------------------------------------------------------------


def test_macro_f1_counts_classes_of_either_side(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("a", "a"), ("b", "d")]
    df = spark.createDataFrame(pairs, "r string, p string")
    f1 = {"a": 2 * 2 / 6, "b": 2 * 1 / 4, "c": 0.0, "d": 0.0}
    row = evaluation.macro_f1(df, [], "r", "p").first()
    assert row.classes == 4
    assert math.isclose(row.macro_f1, sum(f1.values()) / 4)
    scores = {r["class"]: r.f1 for r in evaluation.class_scores(df, [], "r", "p").collect()}
    assert scores == pytest.approx(f1)


def test_confusion_matrix(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "r string, p string")
    out = evaluation.confusion_matrix(df, "r", "p", ["a", "b"]).orderBy("ref").collect()
    assert [tuple(r) for r in out] == [("a", 1, 1, 0), ("b", 0, 1, 0)]
    odd = spark.createDataFrame([("a", "c"), ("a", None), ("a", "a"), (None, "b")], "r string, p string")
    out = evaluation.confusion_matrix(odd, "r", "p", ["a", "b"]).orderBy("ref").collect()
    assert [tuple(r) for r in out] == [(None, 0, 1, 0), ("a", 1, 0, 2)]


# -- embeddings ------------------------------------------------------------


@pytest.mark.parametrize("block", [256, 3])
def test_embedding_match_equals_numpy(spark, block):
    rng = np.random.default_rng(4)
    sides = {k: (rng.normal(size=(n, 5)), rng.normal(size=(m, 5))) for k, (n, m) in enumerate([(7, 4), (1, 9)])}
    data = [
        (k, name, i, [float(x) for x in v])
        for k, both in sides.items()
        for name, vectors in zip(("hyp", "ref"), both, strict=True)
        for i, v in enumerate(vectors)
    ]
    df = spark.createDataFrame(data, "pair long, side string, i long, v array<double>")
    out = {r.pair: r for r in evaluation.embedding_match_pairs(df, ["pair"], "side", "i", "v", block).collect()}
    for k, (hyp, ref) in sides.items():
        unit = [m / np.linalg.norm(m, axis=1, keepdims=True) for m in (hyp, ref)]
        cosines = unit[0] @ unit[1].T
        p, r = cosines.max(axis=1).mean(), cosines.max(axis=0).mean()
        assert np.allclose([out[k].precision, out[k].recall, out[k].f1], [p, r, 2 * p * r / (p + r)])


def test_a_pair_with_an_empty_side_scores_nothing(spark):
    df = spark.createDataFrame(
        [(1, "ref", 0, [1.0]), (2, "hyp", 0, [1.0]), (3, "ref", 0, [2.0]), (3, "hyp", 0, [3.0])],
        "pair long, side string, i long, v array<double>",
    )
    out = {r.pair: r.f1 for r in evaluation.embedding_match_pairs(df, ["pair"], "side", "i", "v").collect()}
    assert out == {1: 0.0, 2: 0.0, 3: 1.0}


# -- sums and latencies ----------------------------------------------------


def test_perplexity_weights_by_tokens(spark):
    df = spark.createDataFrame([("m", 1.0, 10), ("m", 3.0, 30)], "m string, l double, n long")
    row = evaluation.token_weighted_perplexity(df, ["m"], "l", "n").first()
    assert math.isclose(row.perplexity, math.exp((10 + 90) / 40))


def test_real_time_factor(spark):
    df = spark.createDataFrame([("m", 1.0, 4.0), ("m", 3.0, 4.0), ("m", 1.0, 0.0)], "m string, p double, a double")
    assert evaluation.real_time_factor(df, ["m"], "p", "a").first().rtf == 5 / 8
    rows = evaluation.row_real_time_factor(df, "p", "a").collect()
    assert [r.rtf for r in rows] == [0.25, 0.75, None]


def test_latency_stats_drop_nulls(spark):
    values = [5.0, 1.0, 9.0, 2.0, 2.0, 8.5]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    row = evaluation.latency_stats(df, [], "v").first()
    assert (row["min"], row["max"], row["n"]) == (1.0, 9.0, 6)
    for name, level in evaluation.LATENCY_LEVELS.items():
        assert math.isclose(row[name], np.quantile(values, level))


def test_box_plot(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 50.0, -40.0]
    df = spark.createDataFrame([("c", v) for v in values], "c string, v double")
    row = evaluation.box_plot(df, ["c"], "v").first()
    assert (row.q1, row.median, row.q3) == (1.5, 3.0, 4.5)
    assert (row.whisker_low, row.whisker_high, row.outliers) == (1.0, 5.0, 2)


def test_trend_equals_polyfit(spark):
    data = [(1, 2.0), (2, 2.5), (4, 5.0), (9, 9.5)]
    df = spark.createDataFrame(data, "w int, l double")
    slope, intercept = np.polyfit(*zip(*data, strict=True), 1)
    for r in evaluation.length_latency_trend(df, "w", "l").collect():
        assert np.allclose([r.slope, r.intercept, r.fitted], [slope, intercept, slope * r.w + intercept])


def test_union_and_comparison(spark):
    a = spark.createDataFrame([("m", 1.0)], "model string, wer double")
    b = spark.createDataFrame([("m", 2.0), ("n", 3.0)], "model string, rtf double")
    assert evaluation.union_model_results([a, b]).count() == 3
    table = {r.model: (r.wer, r.rtf) for r in evaluation.model_comparison([a, b]).collect()}
    assert table == {"m": (1.0, 2.0), "n": (None, 3.0)}


# -- dataset ---------------------------------------------------------------


def test_histogram_equals_numpy(spark):
    rng = random.Random(8)
    lengths = [rng.choice([3, 7, 7, 50, rng.randrange(1, 200)]) for _ in range(300)]
    df = spark.createDataFrame([(n,) for n in lengths], "n int")
    out = dataset.length_histogram(df, "n").orderBy("bin").collect()
    counts, edges = np.histogram(lengths, bins=50)
    assert [r["count"] for r in out] == counts.tolist()
    assert np.allclose([r.lower for r in out], edges[:-1])
    assert np.allclose([r.upper for r in out], edges[1:])


def test_histogram_of_equal_lengths(spark):
    df = spark.createDataFrame([(4,)] * 3, "n int")
    out = dataset.length_histogram(df, "n").orderBy("bin").collect()
    counts, edges = np.histogram([4] * 3, bins=50)
    assert [r["count"] for r in out] == counts.tolist()
    assert (out[0].lower, out[-1].upper) == (3.5, 4.5)


def test_split_does_not_depend_on_layout(spark):
    df = spark.range(2000)
    one = dataset.with_split(df, "id").collect()
    other = dataset.with_split(df.repartition(7), "id").collect()
    assert {r.id: r.split for r in one} == {r.id: r.split for r in other}
    counts = {s: sum(r.split == s for r in one) / 2000 for s in ("train", "dev", "test")}
    assert counts["train"] == pytest.approx(0.8, abs=0.03)
    assert counts["dev"] == pytest.approx(0.1, abs=0.03)
    reseeded = dataset.with_split(df, "id", seed=1).collect()
    assert {r.id: r.split for r in one} != {r.id: r.split for r in reseeded}


def test_limit_of_zero_means_all(spark):
    df = spark.range(5)
    assert dataset.limit_samples(df, "id", 0).count() == 5
    assert dataset.limit_samples(df, "id", None).count() == 5
    assert [r.id for r in dataset.limit_samples(df, "id", 2).collect()] == [0, 1]


# -- profile ---------------------------------------------------------------


def waterfall_rows(waterfall):
    steps = [
        (f"{a[0]}->{b[0]}", (b[1] - a[1]) * 1000) for a, b in zip(waterfall, waterfall[1:], strict=False)
    ]
    return [*steps, ("total", (waterfall[-1][1] - waterfall[0][1]) * 1000)]


WATERFALLS = {
    1: [("stt_out", 1.0), ("llm_out", 1.5), ("tts_out", 1.25)],
    2: [("stt_out", 4.0)],
    3: [("a", 0.0), ("b", 1.0)] * 20,
}


@pytest.mark.parametrize("limit", [10**6, 4])
def test_stage_deltas_follow_list_order(spark, limit):
    data = [(k, i, c, t) for k, w in WATERFALLS.items() for i, (c, t) in enumerate(w)]
    df = spark.createDataFrame(data, "s long, pos long, component string, time double")
    out = profiling.stage_deltas(df, ["s"], ["pos"], limit=limit)
    expected = sorted((k, *row) for k, w in WATERFALLS.items() for row in waterfall_rows(w))
    assert sorted((r.s, r.component, r.latency_ms) for r in out.collect()) == expected


def test_array_deltas_equal_row_deltas(spark):
    df = spark.createDataFrame(
        list(WATERFALLS.items()), "s long, w array<struct<component:string,time:double>>"
    )
    out = profiling.explode_deltas(df, "w", ["s"]).collect()
    expected = sorted((k, *row) for k, w in WATERFALLS.items() for row in waterfall_rows(w))
    assert sorted((r.s, r.component, r.latency_ms) for r in out) == expected


def test_bottleneck(spark):
    df = spark.createDataFrame(
        [("a->b", 5.0), ("a->b", 7.0), ("b->c", 3.0), ("total", 9.0)], "component string, latency_ms double"
    )
    assert profiling.bottleneck(df).first().component == "total"
    assert profiling.bottleneck(df, include_total=False).first().component == "a->b"
    summary = profiling.component_summary(df).collect()
    assert [r.component for r in summary] == ["total", "a->b", "b->c"]
    assert summary[1].std == pytest.approx(math.sqrt(2))
    assert summary[0].std is None


# -- speech ----------------------------------------------------------------


# Worked by hand at 25 ms a frame: phonemes, durations with one before and one after,
# and the visemes as (row, viseme, start, duration).
TIMELINES = {
    "plain": (["p", "a"], [2, 4, 3, 1], [(1, "PP", 40, 120), (2, "aa", 140, 95)]),
    "mark after a viseme": (["a", "ː"], [0, 4, 2, 0], [(1, "aa", 0, 160)]),
    "mark first": (["ː", "p"], [0, 2, 2, 0], [(2, "PP", 40, 70)]),
    "mark after an unmapped sound": (["a", ".", "ː"], [1, 2, 1, 1, 0], [(1, "aa", 15, 120)]),
    "start floored": (["p"], [0, 4, 0], [(1, "PP", 0, 120)]),
    "nothing to see": (["."], [1, 1, 1], []),
}


@pytest.mark.parametrize("limit", [10**6, 2])
def test_visemes_by_hand(spark, limit):
    data = [
        (u, i, p, float(d))
        for u, (phonemes, durations, _) in TIMELINES.items()
        for i, (p, d) in enumerate(zip([None, *phonemes, None], durations, strict=True))
    ]
    df = spark.createDataFrame(data, "u string, i long, p string, d double")
    out = speech.viseme_timeline(df, ["u"], "i", "p", "d", limit=limit).collect()
    expected = {(u, *v) for u, (*_, shown) in TIMELINES.items() for v in shown}
    assert {(r.u, r.i, r.viseme, r.vtime, r.vduration) for r in out} == expected


@pytest.mark.parametrize("limit", [10**6, 2])
def test_words_by_hand(spark, limit):
    durations = {"u": [1, 2, 2, 2, 2, 1], "v": [0, 4, 4, 0]}
    data = [(u, i, float(d)) for u, row in durations.items() for i, d in enumerate(row)]
    df = spark.createDataFrame(data, "u string, i long, d double")
    timed = speech.cumulative_timeline(df, ["u"], ["i"], "d", limit=limit)
    texts = spark.createDataFrame(
        [("u", "hello, world!", 4), ("v", "one", 2), ("w", "no sounds", 0)], "u string, t string, n long"
    )
    spans = speech.word_boundaries(texts, ["u"], "t", "n")
    got = speech.word_timeline(timed, spans, ["u"], "i").collect()
    assert {(r.u, r.word_index, r.word, r.wtime, r.wduration) for r in got} == {
        ("u", 0, "hello", 15, 120),
        ("u", 1, "world", 115, 120),
        ("v", 0, "one", 0, 220),
    }


def test_fixed_values_by_hand():
    """A slip in the tables would not be seen by SQL made of them."""
    assert len(speech.PHONEME_TO_VISEME) == 82
    for phoneme, viseme in {"ɑ": "aa", "œ": "E", "ʎ": "RR", "ᵻ": "I", "Q": "O", "ɰ": "U", "θ": "TH"}.items():
        assert speech.PHONEME_TO_VISEME[phoneme] == viseme


def test_rounding_halves_to_even(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 1.0), (2, 1.0)], "i long, d double")
    out = speech.cumulative_timeline(df, [], ["i"], "d", frame_rate=1000).orderBy("i").collect()
    assert [r.end_ms for r in out] == [0.0, 2.0, 2.0]


# -- models ----------------------------------------------------------------


def test_generation_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(i, "w " * i) for i in range(500)], "i long, prompt string")
    out = models.batch_generate(df.repartition(3), batch=7)
    assert {r.i: r.pred for r in out.collect()} == {i: f"I read {i} words." for i in range(500)}


def test_classify_emotion(spark):
    df = spark.createDataFrame([("so happy and glad",), ("hate",), ("",), (None,)], "t string")
    out = [r.emotion for r in models.classify_emotion(df, "t").collect()]
    assert out == ["joy", "anger", "neutral", "neutral"]




def test_waterfall_rejects_and_stages_make_up_all_payloads(spark):
    good = '{"waterfall": [{"component": "stt_out", "time": 1.5}]}'
    data = [
        (0, good),
        (1, None),
        (2, good[:-2]),
        (3, "{}"),
        (4, '{"waterfall": []}'),
        (5, '{"waterfall": "late"}'),
        (6, ""),
        (7, good),
    ]
    df = spark.createDataFrame(data, "id int, payload string")
    stages = profiling.parse_waterfall(df, "payload", ["id"]).collect()
    assert sorted(tuple(r) for r in stages) == [(i, 0, "stt_out", 1.5) for i in (0, 7)]
    rejects = profiling.waterfall_rejects(df, "payload", ["id"]).collect()
    assert {r.id: r.reason for r in rejects} == {
        1: "no payload", 2: "malformed", 3: "no stages", 4: "no stages", 5: "no stages", 6: "malformed"
    }
