import random
import re

import pytest
from pyspark.sql import functions as F

from parley.functions import labels, privacy, prompts, text

TEXTS = [
    "",
    " ",
    "one",
    "  two  words ",
    "tab\tand\nline\r\nbreaks",
    "non breaking em　wide",
    "sep\x1carators\x1d here\x1f",
    "Ünïcode, naïve: café! ²½ Ⅷ x_y",
    "é combining",
    "MIXED Case; don't-stop",
    "Customer : hi Agent: there  Customer:",
    "éCustomer: x Customer : y",
    "first line \n second line",
]


def applied(spark, function, values=TEXTS):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()
    return [r.out for r in rows]


def test_word_count(spark):
    assert applied(spark, text.word_count) == [len(t.split()) for t in TEXTS]


def test_words(spark):
    assert applied(spark, text.words) == [t.split() for t in TEXTS]


def test_word_count_space(spark):
    assert applied(spark, text.word_count_space) == [len(t.split(" ")) for t in TEXTS]


def test_strip(spark):
    assert applied(spark, text.strip) == [t.strip() for t in TEXTS]


def test_normalize_text(spark):
    def expected(t):
        t = re.sub(r"[^\w\s]", "", t.lower())
        return re.sub(r"\s+", " ", t).strip()

    assert applied(spark, text.normalize_text) == [expected(t) for t in TEXTS]


def test_clean_dialogue(spark):
    def expected(t):
        for speaker in ("Customer", "Agent"):
            t = re.sub(rf"\b{speaker}\s*:\s*", "", t)
        return t.strip()

    assert applied(spark, text.clean_dialogue) == [expected(t) for t in TEXTS]


def test_ascii_lower(spark):
    expected = ["".join(c for c in t if ord(c) < 128).lower() for t in TEXTS]
    assert applied(spark, text.ascii_lower) == expected


def test_first_line(spark):
    assert applied(spark, text.first_line) == [t.split("\n")[0].strip() for t in TEXTS]


def test_answer_type_bounds_belong_to_the_lower_bin(spark):
    df = spark.createDataFrame([(1,), (3,), (4,), (7,), (8,)], "n int")
    kinds = df.select(text.answer_type(F.col("n"), F.lit(3.0), F.lit(7.0)).alias("k"))
    assert [r.k for r in kinds.collect()] == ["short", "short", "medium", "medium", "long"]


def test_audio_payload_is_one_line(spark):
    df = spark.createDataFrame([(bytearray(range(200)),)], "b binary")
    coded = df.select("b", text.encode_audio(F.col("b")).alias("e"))
    row = coded.select("e", text.decode_audio(F.col("e")).alias("d")).first()
    assert "\n" not in row.e and "\r" not in row.e
    assert bytes(row.d) == bytes(range(200))


# -- prompts ---------------------------------------------------------------


def prompt_of(spark, **columns):
    df = spark.createDataFrame([(1,)], "i int")
    return df.select(prompts.build_prompt(**columns).alias("p")).first().p


def test_prompt_sections(spark):
    p = prompt_of(
        spark,
        situation=F.lit("At home."),
        user=F.lit("Hello"),
        emotion=F.lit("joy"),
        answer_type=F.lit("short"),
        agent=F.lit("Hi!"),
    )
    assert p == (
        prompts.INSTRUCTION + "### Situation:\nAt home.\n### Emotion:\njoy\n### User:\nHello\n"
        "### Answer Type:\nshort\n### You:\nHi!"
    )


@pytest.mark.parametrize("emotion", ["", None])
def test_prompt_without_emotion(spark, emotion):
    p = prompt_of(
        spark,
        situation=F.lit("s"),
        user=F.lit("u"),
        emotion=F.lit(emotion).cast("string"),
        agent=F.lit(None).cast("string"),
    )
    assert "### Emotion" not in p
    assert p.endswith("### Answer Type:\nlong\n### You:\n")


def test_prompt_extra_turns_come_before_the_user(spark):
    turn = F.struct(F.lit("assistant").alias("actor"), F.lit("Yes?").alias("message"))
    p = prompt_of(spark, situation=F.lit("s"), user=F.lit("u"), extra_turns=F.array(turn))
    assert "### Situation:\ns\n### assistant:\nYes?\n### User:\nu\n" in p


def test_render_messages(spark):
    df = spark.createDataFrame(
        [([("user", "Hi"), ("assistant", "Hello")],)], "m array<struct<actor:string,message:string>>"
    )
    assert df.select(prompts.render_messages(F.col("m")).alias("t")).first().t == (
        "USER: Hi\nASSISTANT: Hello"
    )


# -- labels ----------------------------------------------------------------


def test_basic_emotion(spark):
    out = applied(spark, labels.basic_emotion, ["furious", "caring", "bored", None, ""])
    assert out == ["anger", "neutral", "", "", ""]


def test_basic_emotion_covers_32_labels():
    assert len(labels.BASIC_EMOTION) == 32
    assert set(labels.BASIC_EMOTION.values()) == {
        "anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise",
    }


def test_lookup_join_equals_the_literal_map(spark):
    df = spark.createDataFrame([("sad",), ("x",), (None,)], "l string")
    joined = labels.label_lookup_join(df, "l", "e").select("e").collect()
    assert sorted(r.e for r in joined) == ["", "", "sadness"]


def test_harmonized_emotion(spark):
    assert applied(spark, labels.harmonized_emotion, ["happy", "fear"]) == ["joy", "fear"]


# -- personal data ---------------------------------------------------------

PRIVATE = {
    "write to jo.do+x@mail.example.com now": "write to <EMAIL_ADDRESS> now",
    "see https://a.example/b?c=d, ok": "see <URL> ok",
    "card 4111 1111 1111 1111.": "card <CREDIT_CARD>.",
    "not a card 4111 1111 1111 1112": "not a card 4111 1111 1111 1112",
    "4111-1111-1111-1111 and 4111111111111112": "<CREDIT_CARD> and 4111111111111112",
    "pay DE89 3704 0044 0532 0130 00 today": "pay <IBAN_CODE> today",
    "ssn 078-05-1120": "ssn <US_SSN>",
    "host 10.0.255.1 up": "host <IP_ADDRESS> up",
    "host 10.0.256.1 up": "host 10.0.256.1 up",
    "call +1 (743) 555-3824": "call <PHONE_NUMBER>",
    "call 743-555-3824 or 743 555 3824": "call <PHONE_NUMBER> or <PHONE_NUMBER>",
    "nothing here": "nothing here",
    "": "",
}


def test_mask_pii(spark):
    assert applied(spark, privacy.mask_pii, list(PRIVATE)) == list(PRIVATE.values())


def test_hints_are_part_of_every_match():
    for found, masked in PRIVATE.items():
        for entity, pattern in privacy.ENTITIES.items():
            if re.search(pattern, found):
                assert re.search(privacy.HINTS[entity], found), (entity, found, masked)


def mask_by_place(text, spans, best):
    """Each character belongs to the best span over it; runs of one owner are one mark."""
    if text is None:
        return None
    some = [
        (max(s, 0), min(e, len(text)), name or "MASKED", score or 0.0)
        for s, e, name, score in spans or []
        if s is not None and e is not None
    ]

    def rank(i):
        start, end, name, score = some[i]
        first, second = start - end, -score
        return (first, second, start, end, name, i) if best == "length" else (second, first, start, end, name, i)

    out, last = "", None
    for place, letter in enumerate(text):
        over = [i for i, s in enumerate(some) if s[0] <= place < s[1]]
        owner = min(over, key=rank) if over else None
        if owner is None:
            out += letter
        elif owner != last:
            out += f"<{some[owner][2]}>"
        last = owner
    return out


SPAN_CASES = [
    ("Ann met Bob in Łódź", [(0, 3, "PERSON", 0.9), (8, 11, "PERSON", 0.5), (15, 19, "LOCATION", 0.8)]),
    ("overlapping", [(0, 6, "A", 0.1), (4, 9, "B", 0.9)]),
    ("touching", [(0, 3, "A", 0.5), (3, 5, "A", 0.5)]),
    ("nested spans", [(0, 12, "OUTER", 0.2), (3, 6, "INNER", 0.9)]),
    ("between two", [(0, 5, "A", 0.5), (6, 11, "B", 0.5), (4, 8, "C", 0.1)]),
    ("same place", [(0, 4, "B", 0.5), (0, 4, "A", 0.5), (0, 4, "C", 0.7)]),
    ("empty and past", [(2, 2, "E", 1.0), (5, 3, "R", 1.0), (-4, 1, "N", 1.0), (12, 99, "P", 1.0)]),
    ("no name or score", [(0, 2, None, None), (None, 4, "A", 1.0), (1, None, "A", 1.0)]),
    ("\U0001f600 astral \U0001f600", [(0, 1, "FACE", 1.0), (9, 10, "FACE", 1.0)]),
    ("none", []),
    ("null", None),
    ("", [(0, 1, "A", 1.0)]),
    (None, [(0, 1, "A", 1.0)]),
]


@pytest.mark.parametrize("best", ["length", "score"])
def test_mask_spans(spark, best):
    rng = random.Random(5)
    cases = SPAN_CASES + [
        ("abcdefghijklmnopqrst", [
            (s := rng.randrange(20), s + rng.randrange(8), f"E{k}", rng.randrange(10) / 10) for k in range(rng.randrange(9))
        ])
        for _ in range(200)
    ]
    schema = "id int, text string, spans array<struct<start: int, end: int, entity: string, score: double>>"
    df = spark.createDataFrame([(i, *case) for i, case in enumerate(cases)], schema)
    out = df.select("id", privacy.mask_spans(F.col("text"), F.col("spans"), best).alias("m")).collect()
    got = {r.id: r.m for r in out}
    assert [got[i] for i in range(len(cases))] == [mask_by_place(*case, best) for case in cases]
