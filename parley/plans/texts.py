"""Text functions, masking, messages, models."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import privacy, prompts, text
from parley.operators import models, sessions
from parley.operators.conversation import turn_pairs
from parley.plans import fixtures as fx
from parley.plans.dataset import eval_prompt
from parley.plans.registry import query
from parley.sources import files


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "documents")


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "conversations")


@query("word_count", f"SELECT doc_id, {fx.word_count_sql('text')} AS words FROM documents")
def word_count(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", text.word_count(F.col("text")).alias("words"))


@query(
    "word_count_space",
    "SELECT doc_id, CAST(len(string_split(text, ' ')) AS INTEGER) AS words FROM documents",
)
def word_count_space(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        "doc_id", text.word_count_space(F.col("text")).alias("words")
    )


@query("clean_dialogue", f"WITH {fx.DIALOGUES} SELECT dialogue_id, {fx.CLEAN} AS text FROM dialogues")
def clean_dialogue(spark: SparkSession, sf: str) -> DataFrame:
    return fx.dialogues(spark, sf).select(
        "dialogue_id", text.clean_dialogue(F.col("empathetic_dialogues")).alias("text")
    )


@query("normalize_text", f"SELECT doc_id, {fx.normalize_sql('text')} AS text FROM documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return fx.texts(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("text"))


@query(
    "ascii_lower",
    r"SELECT conv_id, turn, lower(regexp_replace(text, '[^\x00-\x7F]+', '', 'g')) AS text FROM conversations",
)
def ascii_lower(spark: SparkSession, sf: str) -> DataFrame:
    return conversations(spark, sf).select(
        "conv_id", "turn", text.ascii_lower(F.col("text")).alias("text")
    )


@query(
    "first_line",
    f"SELECT doc_id, {fx.strip_sql('split_part(text, chr(10), 1)')} AS line FROM documents",
)
def first_line(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", text.first_line(F.col("text")).alias("line"))


@query(
    "audio_payload",
    "SELECT doc_id, to_base64(encode(text)) AS payload, true AS same FROM documents",
)
def audio_payload(spark: SparkSession, sf: str) -> DataFrame:
    encoded = documents(spark, sf).select(
        "doc_id", "text", text.encode_audio(F.encode("text", "UTF-8")).alias("payload")
    )
    same = F.decode(text.decode_audio(F.col("payload")), "UTF-8") == F.col("text")
    return encoded.select("doc_id", "payload", same.alias("same"))


@query(
    "build_prompt",
    f"""WITH {fx.PAIRS}
    SELECT conv_id, turn,
           {fx.prompt_sql("'Turn ' || turn", "user_text",
                          "CASE WHEN turn % 4 = 0 THEN 'joy' WHEN turn % 4 = 1 THEN '' END",
                          "CASE WHEN turn % 2 = 0 THEN 'short' ELSE 'medium' END",
                          "CASE WHEN turn % 3 = 0 THEN assistant_text ELSE '' END")} AS prompt
    FROM pairs""",
)
def build_prompt(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("turn")
    prompt = prompts.build_prompt(
        F.concat(F.lit("Turn "), turn),
        F.col("user_text"),
        F.when(turn % 4 == 0, "joy").when(turn % 4 == 1, ""),
        F.when(turn % 2 == 0, "short").otherwise("medium"),
        F.when(turn % 3 == 0, F.col("assistant_text")),
    )
    return turn_pairs(conversations(spark, sf)).select("conv_id", "turn", prompt.alias("prompt"))


# -- personal data ---------------------------------------------------------


def luhn_sql(card: str) -> str:
    """Sum of digits from the right, every second one doubled, divisible by 10."""
    return (
        f"list_sum(list_transform(string_split(reverse(regexp_replace({card}, '[ -]', '', 'g')), ''),"
        " lambda d, i: CASE WHEN i % 2 = 1 THEN CAST(d AS INTEGER)"
        " WHEN CAST(d AS INTEGER) > 4 THEN CAST(d AS INTEGER) * 2 - 9"
        " ELSE CAST(d AS INTEGER) * 2 END)) % 10 = 0"
    )


def mask_sql(column: str) -> str:
    """The masking chain as nested SQL; cards are rebuilt from their pieces."""
    masked = column
    for entity, pattern in privacy.ENTITIES.items():
        if entity == "CREDIT_CARD":
            # The chain so far contains no card mark, so a masked card can be
            # told from a kept one after all matches are looked at.
            masked = (
                f"list_aggregate(list_transform(list_zip(regexp_split_to_array({masked}, '{pattern}'),"
                f" regexp_extract_all({masked}, '{pattern}')), lambda z:"
                f" z[1] || CASE WHEN z[2] IS NULL THEN '' WHEN {luhn_sql('z[2]')}"
                f" THEN '<CREDIT_CARD>' ELSE z[2] END), 'string_agg', '')"
            )
        else:
            masked = f"regexp_replace({masked}, '{pattern}', '<{entity}>', 'g')"
    return masked


@query("mask_pii", f"SELECT doc_id, {mask_sql('text')} AS text FROM documents")
def mask_pii(spark: SparkSession, sf: str) -> DataFrame:
    return fx.texts(spark, sf, "documents").select("doc_id", privacy.mask_pii(F.col("text")).alias("text"))


# Six spans a text, by arithmetic on its id and length: some overlap, touch, lie in
# each other, are empty or reach past the end.
SPAN_NAMES = ["PERSON", "LOCATION", "DATE_TIME", "NRP", "ORGANIZATION", "PERSON"]
SPANNED = f"""given AS (
  SELECT doc_id, length(text) AS n, k, {SPAN_NAMES}[k + 1] AS entity,
         (doc_id * 7 + k * k * 11) % (length(text) + 1) AS start,
         least((doc_id * 7 + k * k * 11) % (length(text) + 1) + (doc_id + 13 * k) % 40, length(text)) AS stop,
         ((doc_id * 31 + k * 17) % 100) / 100 AS score
  FROM documents, range(6) AS r(k)),
places AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT doc_id, start AS p FROM given UNION ALL SELECT doc_id, stop FROM given
    UNION ALL SELECT doc_id, 0 FROM documents UNION ALL SELECT doc_id, length(text) FROM documents)),
parts AS (
  SELECT doc_id, p AS a, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS b FROM places
  QUALIFY b IS NOT NULL),
owned AS (
  SELECT parts.doc_id, a, b, arg_min((k, entity), (RANKS, start, entity)) FILTER (WHERE k IS NOT NULL) AS best
  FROM parts LEFT JOIN given
    ON given.doc_id = parts.doc_id AND start < stop AND start <= a AND stop >= b
  GROUP BY ALL),
pieces AS (
  SELECT d.doc_id, a, CASE WHEN best IS NULL THEN substr(text, a + 1, b - a)
    WHEN best[1] IS NOT DISTINCT FROM lag(best[1]) OVER (PARTITION BY d.doc_id ORDER BY a) THEN ''
    ELSE '<' || best[2] || '>' END AS piece
  FROM owned o JOIN documents d ON d.doc_id = o.doc_id)
SELECT doc_id, coalesce(string_agg(piece, '' ORDER BY a), any_value(text)) AS text
FROM documents LEFT JOIN pieces USING (doc_id) GROUP BY doc_id"""


def span_masked(spark: SparkSession, sf: str, best: str) -> DataFrame:
    doc, size = F.col("doc_id"), F.length("text")

    def span(k: int, entity: str) -> F.Column:
        start = (doc * 7 + k * k * 11) % (size + 1)
        return F.struct(
            start.alias("start"),
            (start + (doc + 13 * k) % 40).alias("end"),
            F.lit(entity).alias("entity"),
            ((doc * 31 + k * 17) % 100 / 100).alias("score"),
        )

    spans = F.array(*[span(k, entity) for k, entity in enumerate(SPAN_NAMES)])
    given = fx.texts(spark, sf, "documents").select("doc_id", "text", spans.alias("spans"))
    return given.select("doc_id", privacy.mask_spans(F.col("text"), F.col("spans"), best).alias("text"))


@query("mask_spans", "WITH " + SPANNED.replace("RANKS", "start - stop, -score"))
def mask_spans(spark: SparkSession, sf: str) -> DataFrame:
    return span_masked(spark, sf, "length")


@query("mask_spans_by_score", "WITH " + SPANNED.replace("RANKS", "-score, start - stop"))
def mask_spans_by_score(spark: SparkSession, sf: str) -> DataFrame:
    return span_masked(spark, sf, "score")


def found_sql(entity: str, pattern: str) -> str:
    matches = f"regexp_extract_all(text, '{pattern}')"
    if entity == "CREDIT_CARD":
        matches = f"list_filter({matches}, lambda m: {luhn_sql('m')})"
    return f"SELECT doc_id, '{entity}' AS entity, CAST(len({matches}) AS INTEGER) AS n FROM documents"


@query(
    "pii_counts",
    "SELECT * FROM ("
    + " UNION ALL ".join(found_sql(e, p) for e, p in privacy.ENTITIES.items())
    + ") WHERE n > 0",
)
def pii_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.pii_counts(fx.texts(spark, sf, "documents"), "doc_id", "text")


# -- messages --------------------------------------------------------------

KINDS = {"click": files.SPEAK, "view": files.TRANSCRIPT, "error": files.INTERRUPT}


def typed_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Events as JSON messages whose type follows from the event type."""
    kind = F.lit(files.FEEDBACK)
    for event_type, name in KINDS.items():
        kind = F.when(F.col("event_type") == event_type, name).otherwise(kind)
    return fx.table(spark, sf, "events").select(
        "event_id", files.message_json(kind, F.struct("user_id", "value")).alias("message")
    )


@query(
    "message_stream",
    "SELECT event_id, user_id, value FROM events WHERE event_type = 'click'",
)
def message_stream(spark: SparkSession, sf: str) -> DataFrame:
    spoken = files.messages_of_type(
        typed_messages(spark, sf),
        "message",
        files.SPEAK,
        "struct<user_id: long, value: double>",
        ["event_id"],
    )
    return spoken.select("event_id", "data.user_id", "data.value")


@query(
    "message_json",
    """SELECT conv_id, turn, '{"type":"SPEECH_TRANSCRIPT","data":{"actor":' || to_json(role)
       || ',"message":' || to_json(text) || '}}' AS message FROM conversations""",
)
def message_json(spark: SparkSession, sf: str) -> DataFrame:
    data = F.struct(F.col("role").alias("actor"), F.col("text").alias("message"))
    return conversations(spark, sf).select(
        "conv_id", "turn", files.message_json(files.TRANSCRIPT, data).alias("message")
    )


# -- models ----------------------------------------------------------------


@query(
    "batch_generate",
    f"""WITH {fx.PREPARED}
    SELECT dialogue_id, labels AS ref, emotion, 'I read ' || {fx.word_count_sql(
        "(" + fx.prompt_sql('"Situation"', "empathetic_dialogues", "emotion") + ")")}
      || ' words.' AS pred FROM prepared""",
)
def batch_generate(spark: SparkSession, sf: str) -> DataFrame:
    return models.batch_generate(eval_prompt(spark, sf)).drop("prompt")


# Words the invented texts do contain.
KEYWORDS = {"anger": "und der", "joy": "the in", "sadness": "le la"}


def keyword_sql(words: str) -> str:
    listed = ", ".join(f"'{w}'" for w in words.split())
    return f"len(list_filter(words, lambda w: w IN ({listed})))"


@query(
    "classify_emotion",
    f"""WITH split_texts AS (
      SELECT doc_id, regexp_extract_all(lower(text), '[^\\t\\n\\f\\r ]+') AS words FROM documents),
    hits AS (
      SELECT doc_id, {", ".join(f"{keyword_sql(w)} AS {k}" for k, w in KEYWORDS.items())}
      FROM split_texts)
    SELECT doc_id, CASE WHEN greatest(anger, joy, sadness) = 0 THEN 'neutral'
      WHEN anger >= joy AND anger >= sadness THEN 'anger'
      WHEN joy >= sadness THEN 'joy' ELSE 'sadness' END AS emotion FROM hits""",
)
def classify_emotion(spark: SparkSession, sf: str) -> DataFrame:
    labelled = models.classify_emotion(
        documents(spark, sf).select("doc_id", "text"),
        "text",
        model=partial(models.KeywordEmotions, KEYWORDS),
    )
    return labelled.select("doc_id", "emotion")
