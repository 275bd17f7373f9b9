"""Model scores and stage profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import word_count
from parley.operators import evaluation as ops
from parley.operators import profiling
from parley.operators.sequence import framed
from parley.plans import fixtures as fx
from parley.plans.registry import query


def events(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "events")


@query(
    "ref_hyp_join",
    """SELECT r.conv_id, r.turn, r.text AS ref, h.text AS hyp
    FROM conversations r JOIN conversations h ON h.conv_id = r.conv_id AND h.turn = r.turn + 1
    WHERE r.role = 'user' AND h.role = 'assistant'""",
)
def ref_hyp_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.texts(spark, sf, "conversations")
    refs = rows.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("ref"))
    hyps = rows.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).cast("long").alias("turn"), F.col("text").alias("hyp")
    )
    return ops.ref_hyp_join(refs, hyps, ["conv_id", "turn"])


LOSSES = "value / 100 AS loss, event_id % 50 + 1 AS tokens"
PERPLEXITY = f"""SELECT event_type AS model, exp(sum(loss * tokens) / sum(tokens)) AS perplexity,
  CAST(sum(tokens) AS BIGINT) AS tokens
  FROM (SELECT event_type, {LOSSES} FROM events) GROUP BY event_type"""


def perplexities(spark: SparkSession, sf: str) -> DataFrame:
    batches = events(spark, sf).select(
        F.col("event_type").alias("model"),
        (F.col("value") / 100).alias("loss"),
        (F.col("event_id") % 50 + 1).alias("tokens"),
    )
    return ops.token_weighted_perplexity(batches, ["model"], "loss", "tokens")


@query(
    "token_weighted_perplexity",
    f"SELECT model, round(perplexity, 6) AS perplexity, tokens FROM ({PERPLEXITY})",
)
def token_weighted_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    return fx.rounded(perplexities(spark, sf), 6, "perplexity")


# Sixteen vectors make a pair: odd ones the hypothesis, even ones the reference.
EMBEDDING_PAIRS = """tokens AS (
  SELECT vec_id // 16 AS pair, vec_id % 2 AS hyp, vec_id, CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings),
cosines AS (
  SELECT h.pair, h.vec_id AS hyp_id, r.vec_id AS ref_id, list_cosine_similarity(h.v, r.v) AS c
  FROM tokens h JOIN tokens r ON r.pair = h.pair AND h.hyp = 1 AND r.hyp = 0),
scored AS (
  SELECT pair, p AS precision, r AS recall, CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1
  FROM (SELECT pair, avg(c) AS p FROM (SELECT pair, max(c) AS c FROM cosines GROUP BY pair, hyp_id)
        GROUP BY pair)
  JOIN (SELECT pair, avg(c) AS r FROM (SELECT pair, max(c) AS c FROM cosines GROUP BY pair, ref_id)
        GROUP BY pair) USING (pair))"""


def embedding_pairs(spark: SparkSession, sf: str) -> DataFrame:
    tokens = fx.table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 16).alias("pair"),
        F.when(F.col("vec_id") % 2 == 1, "hyp").otherwise("ref").alias("side"),
        F.floor(F.col("vec_id") % 16 / 2).alias("i"),
        "embedding",
    )
    return ops.embedding_match_pairs(tokens, ["pair"], "side", "i", "embedding")


@query(
    "embedding_match_score",
    f"""WITH {EMBEDDING_PAIRS}
    SELECT pair % 3 AS model, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
           round(avg(f1), 6) AS f1, count(*) AS pairs FROM scored GROUP BY 1""",
)
def embedding_match_score(spark: SparkSession, sf: str) -> DataFrame:
    pairs = embedding_pairs(spark, sf).withColumn("model", F.col("pair") % 3)
    scores = ops.embedding_match_score(pairs, ["model"])
    return fx.rounded(scores, 6, "precision", "recall", "f1")


@query(
    "embedding_match_pairs",
    f"""WITH {EMBEDDING_PAIRS} SELECT pair, round(precision, 6) AS precision,
        round(recall, 6) AS recall, round(f1, 6) AS f1 FROM scored""",
)
def embedding_match_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return fx.rounded(embedding_pairs(spark, sf), 6, "precision", "recall", "f1")


def macro_f1_sql(rows: str, by: str = "") -> str:
    """F1 per class from the margins of ``rows(ref, pred)``, then the mean."""
    keys = f"{by}, " if by else ""
    using = f"USING ({keys}class)"
    return f"""WITH rows AS ({rows}),
    refs AS (SELECT {keys}ref AS class, count(*) AS r FROM rows GROUP BY ALL),
    preds AS (SELECT {keys}pred AS class, count(*) AS p FROM rows GROUP BY ALL),
    hits AS (SELECT {keys}ref AS class, count(*) AS tp FROM rows WHERE ref = pred GROUP BY ALL),
    scored AS (
      SELECT {keys}class, 2.0 * coalesce(tp, 0) / (coalesce(r, 0) + coalesce(p, 0)) AS f1
      FROM refs FULL JOIN preds {using} LEFT JOIN hits {using})
    SELECT {keys}round(avg(f1), 6) AS macro_f1, count(*) AS classes FROM scored GROUP BY ALL"""


@query("macro_f1", macro_f1_sql("SELECT quality AS ref, toxic AS pred FROM labels"))
def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return fx.rounded(
        ops.macro_f1(fx.table(spark, sf, "labels"), [], "quality", "toxic"), 6, "macro_f1"
    )


LANGS = """SELECT source, lang AS ref, CASE WHEN doc_id % 5 = 0 THEN 'en' WHEN doc_id % 7 = 0 THEN 'it'
  ELSE lang END AS pred FROM documents"""


def guessed_langs(spark: SparkSession, sf: str) -> DataFrame:
    guess = (
        F.when(F.col("doc_id") % 5 == 0, "en")
        .when(F.col("doc_id") % 7 == 0, "it")
        .otherwise(F.col("lang"))
    )
    documents = fx.table(spark, sf, "documents")
    return documents.select("source", F.col("lang").alias("ref"), guess.alias("pred"))


@query("macro_f1_by_source", macro_f1_sql(LANGS, "source"))
def macro_f1_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return fx.rounded(
        ops.macro_f1(guessed_langs(spark, sf), ["source"], "ref", "pred"), 6, "macro_f1"
    )


CLASSES = ["de", "en", "es", "fr", "it"]


@query(
    "confusion_matrix",
    "SELECT ref, "
    + ", ".join(f"count(*) FILTER (WHERE pred = '{c}') AS pred_{c}" for c in CLASSES)
    + ", count(*) FILTER (WHERE pred IS NULL OR pred NOT IN ('de', 'en', 'es', 'fr', 'it')) AS pred_other"
    + f" FROM ({LANGS}) GROUP BY ref",
)
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return ops.confusion_matrix(guessed_langs(spark, sf), "ref", "pred", CLASSES)


# Word edit distance by rows of the distance table: row j holds the distances of
# the first j hypothesis words to all prefixes of the reference. A running
# minimum of (cell - place) settles insertions.
EDITS = f"""{fx.PAIRS}, worded AS (
  SELECT conv_id, turn, string_split({fx.normalize_sql("user_text")}, ' ') AS r0,
         string_split({fx.normalize_sql("assistant_text")}, ' ') AS h0 FROM pairs),
sides AS (
  SELECT conv_id, turn, list_filter(r0, lambda w: w <> '') AS r,
         list_filter(h0, lambda w: w <> '') AS h FROM worded),
steps AS (
  SELECT conv_id, turn, r, h, 0 AS j, range(len(r) + 1) AS d FROM sides
  UNION ALL
  SELECT conv_id, turn, r, h, j + 1,
    list_transform(range(1, len(r) + 2), lambda k: k - 1 + list_min(list_transform(range(1, k + 1),
      lambda i: CASE WHEN i = 1 THEN d[1] + 1
        ELSE least(d[i] + 1, d[i - 1] + CASE WHEN r[i - 1] = h[j + 1] THEN 0 ELSE 1 END) - (i - 1) END)))
  FROM steps WHERE j < len(h)),
edits AS (
  SELECT conv_id, turn, CAST(d[len(d)] AS BIGINT) AS edits, CAST(len(r) AS BIGINT) AS ref_words
  FROM steps WHERE j = len(h))"""


@query(
    "word_error_rate",
    f"""WITH RECURSIVE {EDITS}
    SELECT conv_id % 3 AS model, CAST(sum(edits) AS BIGINT) AS edits,
           CAST(sum(ref_words) AS BIGINT) AS ref_words,
           round(sum(edits) / sum(ref_words), 6) AS wer
    FROM edits GROUP BY 1""",
)
def word_error_rate(spark: SparkSession, sf: str) -> DataFrame:
    return fx.rounded(word_errors(spark, sf), 6, "wer")


def word_errors(spark: SparkSession, sf: str) -> DataFrame:
    pairs = ref_hyp_join(spark, sf).withColumn("model", F.col("conv_id") % 3)
    return ops.word_error_rate(pairs, ["model"], "ref", "hyp")


@query(
    "real_time_factor",
    """SELECT l_returnflag AS model, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS rtf
    FROM lineitem GROUP BY 1""",
)
def real_time_factor(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("model"),
        (F.col("l_quantity") * F.col("l_discount")).alias("processing"),
        F.col("l_quantity").alias("audio"),
    )
    return fx.rounded(ops.real_time_factor(rows, ["model"], "processing", "audio"), 6, "rtf")


@query(
    "row_real_time_factor",
    """SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN value / (event_id % 10) END AS rtf
    FROM events""",
)
def row_real_time_factor(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).withColumn("audio", (F.col("event_id") % 10).cast("double"))
    return ops.row_real_time_factor(rows, "value", "audio").select("event_id", "rtf")


# -- latency ---------------------------------------------------------------

SPARSE = "SELECT event_type, CASE WHEN event_id % 10 <> 0 THEN value * 40 END AS latency_ms FROM events"


def sparse_latencies(spark: SparkSession, sf: str) -> DataFrame:
    latency = F.when(F.col("event_id") % 10 != 0, F.col("value") * 40)
    return events(spark, sf).select("event_type", latency.alias("latency_ms"))


STATS = ["mean", *ops.LATENCY_LEVELS]
LATENCY_STATS = f"""SELECT event_type, round(avg(latency_ms), 6) AS mean, min(latency_ms) AS min,
  max(latency_ms) AS max, count(latency_ms) AS n, {", ".join(
      f"round(quantile_cont(latency_ms, {p}), 6) AS {name}" for name, p in ops.LATENCY_LEVELS.items())}
  FROM ({SPARSE}) GROUP BY event_type"""


@query("latency_stats", LATENCY_STATS)
def latency_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = ops.latency_stats(sparse_latencies(spark, sf), ["event_type"], "latency_ms")
    return fx.rounded(stats, 6, *STATS)


@query(
    "tts_latency_summary",
    """SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50,
    round(quantile_cont(value, 0.95), 6) AS p95 FROM events""",
)
def tts_latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = ops.tts_latency_summary(events(spark, sf).select("value"), [], "value")
    return fx.rounded(summary, 6, "mean", "p50", "p95")


@query(
    "length_latency_trend",
    f"""WITH worded AS (SELECT doc_id, {fx.word_count_sql("text")} AS words, n_chars FROM documents),
    line AS (SELECT regr_slope(n_chars, words) AS slope, regr_intercept(n_chars, words) AS intercept
             FROM worded)
    SELECT doc_id, words, round(slope, 6) AS slope, round(intercept, 5) AS intercept,
           round(words * slope + intercept, 5) AS fitted FROM worded, line""",
)
def length_latency_trend(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "documents").select(
        "doc_id", word_count(F.col("text")).alias("words"), "n_chars"
    )
    fitted = ops.length_latency_trend(rows, "words", "n_chars").drop("n_chars")
    return fx.rounded(fx.rounded(fitted, 6, "slope"), 5, "intercept", "fitted")


@query(
    "distribution_by_component",
    """WITH boxes AS (
      SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type),
    fenced AS (
      SELECT *, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM events JOIN boxes USING (event_type))
    SELECT event_type, round(avg(value), 6) AS mean, round(any_value(q1), 6) AS q1,
           round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
           round(least(min(value) FILTER (WHERE inside), any_value(q1)), 6) AS whisker_low,
           round(greatest(max(value) FILTER (WHERE inside), any_value(q3)), 6) AS whisker_high,
           count(*) FILTER (WHERE NOT inside) AS outliers
    FROM fenced GROUP BY event_type""",
)
def distribution_by_component(spark: SparkSession, sf: str) -> DataFrame:
    boxes = ops.box_plot(events(spark, sf), ["event_type"], "value")
    return fx.rounded(boxes, 6, "mean", "q1", "median", "q3", "whisker_low", "whisker_high")


TOKEN_TIMES = """timed AS (
  SELECT user_id, event_id, event_type AS model, ts,
         CASE WHEN event_type <> 'error' THEN lead(ts, 1) OVER w END AS first_ts,
         lead(ts, 2) OVER w AS end_ts, row_number() OVER w - 1 AS place
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
profiled AS (
  SELECT user_id, event_id, model, (epoch_us(first_ts) - epoch_us(ts)) / 1e6 AS ttft,
         (epoch_us(end_ts) - epoch_us(ts)) / 1e6 AS e2e
  FROM timed WHERE place % 3 = 0 AND end_ts IS NOT NULL)"""


def token_times(spark: SparkSession, sf: str) -> DataFrame:
    """Every three events of a user are the start, first token and end of one answer."""
    rows = framed(
        events(spark, sf).select("user_id", "event_id", "event_type", "ts"),
        ["user_id"],
        fx.TURN_ORDER,
        0,
        2,
        lambda w: {"first_ts": F.lead("ts", 1).over(w), "end_ts": F.lead("ts", 2).over(w)},
        position="at",
    )
    answers = rows.filter((F.col("at") % 3 == 0) & F.col("end_ts").isNotNull())
    return ops.first_token_latencies(
        answers.withColumn("first_ts", F.when(F.col("event_type") != "error", F.col("first_ts"))),
        "ts",
        "first_ts",
        "end_ts",
    ).select("user_id", "event_id", F.col("event_type").alias("model"), "ttft", "e2e")


@query(
    "first_token_latencies",
    f"WITH {TOKEN_TIMES} SELECT * FROM profiled",
)
def first_token_latencies(spark: SparkSession, sf: str) -> DataFrame:
    return token_times(spark, sf)


@query(
    "ttft_e2e_profile",
    f"""WITH {TOKEN_TIMES} SELECT model, count(ttft) AS n_ttft, round(avg(ttft), 5) AS mean_ttft,
    count(e2e) AS n_e2e, round(avg(e2e), 5) AS mean_e2e FROM profiled GROUP BY model""",
)
def ttft_e2e_profile(spark: SparkSession, sf: str) -> DataFrame:
    profile = ops.ttft_e2e_profile(token_times(spark, sf), ["model"])
    return fx.rounded(profile, 5, "mean_ttft", "mean_e2e")


# -- comparison ------------------------------------------------------------


@query(
    "union_model_results",
    """SELECT 'events' AS model, event_type AS part, round(avg(value), 6) AS score, NULL::BIGINT AS words
    FROM events GROUP BY ALL
    UNION ALL
    SELECT 'documents', lang, NULL, CAST(sum(n_chars) AS BIGINT) FROM documents GROUP BY ALL""",
)
def union_model_results(spark: SparkSession, sf: str) -> DataFrame:
    first = events(spark, sf).groupBy(F.lit("events").alias("model"), F.col("event_type").alias("part"))
    second = fx.table(spark, sf, "documents").groupBy(
        F.lit("documents").alias("model"), F.col("lang").alias("part")
    )
    return ops.union_model_results(
        [
            first.agg(F.round(F.avg("value"), 6).alias("score")),
            second.agg(F.sum("n_chars").alias("words")),
        ]
    )


MODELS = ["click", "error", "purchase", "signup", "view"]
MODEL_LIST = "[" + ", ".join(f"'{m}'" for m in MODELS) + "]"
MODEL_F1 = """guesses AS (
  SELECT event_type AS model, event_id % 4 AS ref, (event_id // 3) % 4 AS pred FROM events),
refs AS (SELECT model, ref AS class, count(*) AS r FROM guesses GROUP BY ALL),
preds AS (SELECT model, pred AS class, count(*) AS p FROM guesses GROUP BY ALL),
hits AS (SELECT model, ref AS class, count(*) AS tp FROM guesses WHERE ref = pred GROUP BY ALL),
f1s AS (
  SELECT model, avg(2.0 * coalesce(tp, 0) / (coalesce(r, 0) + coalesce(p, 0))) AS macro_f1
  FROM refs FULL JOIN preds USING (model, class) LEFT JOIN hits USING (model, class) GROUP BY model)"""
# The tables of scores; conversations and pairs of vectors belong to models in turn.
COMPARISON = f"""WITH RECURSIVE {TOKEN_TIMES}, {EDITS}, {EMBEDDING_PAIRS}, perplexities AS ({PERPLEXITY}),
latencies AS (SELECT model, avg(e2e) AS mean_e2e FROM profiled GROUP BY model),
factors AS (SELECT event_type AS model, sum(value) / sum(event_id % 60 + 1) AS rtf FROM events GROUP BY 1),
matches AS (SELECT {MODEL_LIST}[pair % 5 + 1] AS model, avg(f1) AS match_f1 FROM scored GROUP BY 1),
errors AS (SELECT {MODEL_LIST}[conv_id % 5 + 1] AS model, sum(edits) / sum(ref_words) AS wer FROM edits GROUP BY 1),
{MODEL_F1},
comparison AS (
  SELECT * FROM perplexities FULL JOIN f1s USING (model) FULL JOIN factors USING (model)
  FULL JOIN latencies USING (model) FULL JOIN matches USING (model) FULL JOIN errors USING (model))"""


def model_of(number: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(m) for m in MODELS]), (number % len(MODELS) + 1).cast("int"))


def model_f1(spark: SparkSession, sf: str) -> DataFrame:
    guesses = events(spark, sf).select(
        F.col("event_type").alias("model"),
        (F.col("event_id") % 4).alias("ref"),
        (F.floor(F.col("event_id") / 3) % 4).alias("pred"),
    )
    return ops.macro_f1(guesses, ["model"], "ref", "pred").select("model", "macro_f1")


def model_rtf(spark: SparkSession, sf: str) -> DataFrame:
    timings = events(spark, sf).select(
        F.col("event_type").alias("model"), "value", (F.col("event_id") % 60 + 1).alias("audio")
    )
    return ops.real_time_factor(timings, ["model"], "value", "audio")


def model_latency(spark: SparkSession, sf: str) -> DataFrame:
    return ops.ttft_e2e_profile(token_times(spark, sf), ["model"]).select("model", "mean_e2e")


def model_match(spark: SparkSession, sf: str) -> DataFrame:
    pairs = embedding_pairs(spark, sf).withColumn("model", model_of(F.col("pair")))
    return ops.embedding_match_score(pairs, ["model"]).select("model", F.col("f1").alias("match_f1"))


def model_wer(spark: SparkSession, sf: str) -> DataFrame:
    pairs = ref_hyp_join(spark, sf).withColumn("model", model_of(F.col("conv_id")))
    return ops.word_error_rate(pairs, ["model"], "ref", "hyp").select("model", "wer")


SCORES = {"perplexity": 6, "macro_f1": 6, "rtf": 6, "mean_e2e": 5, "match_f1": 6, "wer": 6}
SCORED = {
    "perplexity": lambda spark, sf: perplexities(spark, sf).drop("tokens"),
    "macro_f1": model_f1,
    "rtf": model_rtf,
    "mean_e2e": model_latency,
    "match_f1": model_match,
    "wer": model_wer,
}


def comparison(spark: SparkSession, sf: str, scores: list[str]) -> DataFrame:
    return ops.model_comparison([SCORED[name](spark, sf) for name in scores])


def rounded_scores_sql(names: list[str]) -> str:
    return ", ".join(f"round({c}, {SCORES[c]}) AS {c}" for c in names)


@query(
    "model_comparison",
    f"{COMPARISON} SELECT model, {rounded_scores_sql(list(SCORES))} FROM comparison",
)
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    table = comparison(spark, sf, list(SCORES))
    return table.withColumns({c: F.round(c, d) for c, d in SCORES.items()})


def tradeoff_sql(cost: str, quality: str) -> str:
    return (
        f"{COMPARISON} SELECT model, {rounded_scores_sql([cost, quality])} FROM comparison"
        f" WHERE {cost} IS NOT NULL OR {quality} IS NOT NULL"
    )


def tradeoff(spark: SparkSession, sf: str, cost: str, quality: str) -> DataFrame:
    table = ops.tradeoff(comparison(spark, sf, [cost, quality]), cost, quality)
    return table.withColumns({c: F.round(c, SCORES[c]) for c in (cost, quality)})


@query("model_tradeoff", tradeoff_sql("perplexity", "macro_f1"))
def model_tradeoff(spark: SparkSession, sf: str) -> DataFrame:
    return tradeoff(spark, sf, "perplexity", "macro_f1")


@query("latency_match_tradeoff", tradeoff_sql("mean_e2e", "match_f1"))
def latency_match_tradeoff(spark: SparkSession, sf: str) -> DataFrame:
    return tradeoff(spark, sf, "mean_e2e", "match_f1")


@query("speech_tradeoff", tradeoff_sql("wer", "rtf"))
def speech_tradeoff(spark: SparkSession, sf: str) -> DataFrame:
    return tradeoff(spark, sf, "wer", "rtf")


# -- profile ---------------------------------------------------------------


@query(
    "parse_waterfall",
    """SELECT event_id, CAST(k AS INTEGER) AS pos, ['stt_out', 'llm_out', 'tts_out'][k + 1] AS component,
           value + [0.0, 0.5, 1.25][k + 1] AS time
    FROM events, range(3) AS r(k)""",
)
def parse_waterfall(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.parse_waterfall(payloads(spark, sf), "payload", ["event_id"])


@query(
    "waterfall_rejects",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'malformed' WHEN event_id % 11 = 0 THEN 'no stages'
      ELSE 'no payload' END AS reason
    FROM events WHERE event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0""",
)
def waterfall_rejects(spark: SparkSession, sf: str) -> DataFrame:
    rows = payloads(spark, sf)
    event = F.col("event_id")
    broken = (
        F.when(event % 7 == 0, F.expr("left(payload, length(payload) - 2)"))
        .when(event % 11 == 0, F.lit('{"waterfall": []}'))
        .when(event % 13 != 0, F.col("payload"))
    )
    return profiling.waterfall_rejects(
        rows.withColumn("payload", broken), "payload", ["event_id"]
    ).drop("payload")


def waterfall_array() -> F.Column:
    def stage(name: str, late: float) -> F.Column:
        return F.struct(F.lit(name).alias("component"), (F.col("value") + late).alias("time"))

    return F.array(stage("stt_out", 0.0), stage("llm_out", 0.5), stage("tts_out", 1.25))


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.to_json(F.struct(waterfall_array().alias("waterfall")))
    return events(spark, sf).select("event_id", payload.alias("payload"))


@query(
    "waterfall_deltas",
    """WITH times AS (SELECT event_id, value AS a, value + 0.5 AS b, value + 1.25 AS c FROM events)
    SELECT event_id, 'stt_out->llm_out' AS component, (b - a) * 1000 AS latency_ms FROM times
    UNION ALL SELECT event_id, 'llm_out->tts_out', (c - b) * 1000 FROM times
    UNION ALL SELECT event_id, 'total', (c - a) * 1000 FROM times""",
)
def waterfall_deltas(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("event_id", waterfall_array().alias("waterfall"))
    return profiling.explode_deltas(rows, "waterfall", ["event_id"])


def deltas(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.stage_deltas(fx.stages(spark, sf), ["user_id", "day"], fx.TURN_ORDER)


@query(
    "stage_deltas",
    f"""WITH {fx.DELTAS}
    SELECT user_id, day, component, round(latency_ms, 6) AS latency_ms FROM deltas""",
)
def stage_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return fx.rounded(deltas(spark, sf), 6, "latency_ms")


SUMMARY = f"""WITH {fx.DELTAS}
  SELECT component, avg(latency_ms) AS mean, quantile_cont(latency_ms, 0.5) AS median,
         stddev_samp(latency_ms) AS std, max(latency_ms) AS max FROM deltas GROUP BY component"""
ROUNDED_SUMMARY = ", ".join(f"round({c}, 4) AS {c}" for c in ("mean", "median", "std", "max"))


@query("component_summary", f"SELECT component, {ROUNDED_SUMMARY} FROM ({SUMMARY})")
def component_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = profiling.component_summary(deltas(spark, sf))
    return fx.rounded(summary, 4, "mean", "median", "std", "max")


@query(
    "sorted_summary",
    f"""SELECT component, round(mean, 4) AS mean
    FROM ({SUMMARY}) ORDER BY mean DESC, component""",
)
def sorted_summary(spark: SparkSession, sf: str) -> DataFrame:
    return fx.rounded(profiling.sorted_means(deltas(spark, sf)), 4, "mean")


@query(
    "bottleneck",
    f"SELECT component, round(mean, 4) AS mean FROM ({SUMMARY}) ORDER BY mean DESC LIMIT 1",
)
def bottleneck(spark: SparkSession, sf: str) -> DataFrame:
    return fx.rounded(profiling.bottleneck(deltas(spark, sf)), 4, "mean")


@query(
    "bottleneck_stage",
    f"""SELECT component, round(mean, 4) AS mean FROM ({SUMMARY})
    WHERE component <> 'total' ORDER BY mean DESC LIMIT 1""",
)
def bottleneck_stage(spark: SparkSession, sf: str) -> DataFrame:
    return fx.rounded(profiling.bottleneck(deltas(spark, sf), include_total=False), 4, "mean")


@query("distinct_components", f"WITH {fx.DELTAS} SELECT DISTINCT component FROM deltas")
def distinct_components(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.distinct_components(deltas(spark, sf))


@query(
    "latency_over_time",
    f"WITH {fx.DELTAS} SELECT user_id, day, component, round(latency_ms, 6) AS latency_ms FROM deltas",
)
def latency_over_time(spark: SparkSession, sf: str) -> DataFrame:
    series = profiling.latency_over_time(deltas(spark, sf), ["user_id", "day"])
    return fx.rounded(series, 6, "latency_ms")
