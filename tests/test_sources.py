import json
from pathlib import Path
from random import Random

import pytest
from pyspark.sql import functions as F

from parley.operators import sessions
from parley.session import new_folder, shared_folder
from parley.sources import files, sinks
from parley.sources import records as records_module


def write(path: Path, text: str) -> str:
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_dialogue_csv_with_line_breaks_and_quotes(spark, tmp_path):
    path = write(
        tmp_path / "d.csv",
        'Situation,emotion,empathetic_dialogues,labels\n"a ""b"", c",sad,"Customer : x\nAgent :",ok\n',
    )
    row = files.scan_dialogues(spark, path).first()
    assert tuple(row) == ('a "b", c', "sad", "Customer : x\nAgent :", "ok")


def test_dialogues_are_read_by_name(spark, tmp_path):
    text = "id,labels,Situation,emotion,empathetic_dialogues,more\n7,ok,s,sad,d,x\n"
    row = files.scan_dialogues(spark, write(tmp_path / "e.csv", text)).first()
    assert row.asDict() == {
        "Situation": "s", "emotion": "sad", "empathetic_dialogues": "d", "labels": "ok", "id": "7", "more": "x"
    }


def test_jsonl_limit_in_file_order(spark, tmp_path):
    lines = "".join(json.dumps({"text": f"t{i}"}) + "\n" for i in range(300))
    path = write(tmp_path / "s.jsonl", lines)

    def texts(df):
        return [r.text for r in df.collect()]

    assert texts(files.scan_jsonl(spark, path, "text string", 5)) == [f"t{i}" for i in range(5)]
    for none in (None, 0):
        assert files.scan_jsonl(spark, path, "text string", none).count() == 300
    assert len(texts(files.single_text_column(spark, path, "text"))) == 101
    assert len(texts(files.single_text_column(spark, path, "text", one_more=False))) == 100


def test_first_rows_open_no_later_file(spark, tmp_path):
    folder = tmp_path / "with [blank] 100% é"
    folder.mkdir()
    for name, first in (("a", 0), ("b", 100), ("c", 200)):
        write(folder / f"{name}.jsonl", "\n".join(json.dumps({"t": i}) + "\n" for i in range(first, first + 100)))
    (folder / "d.jsonl.gz").write_bytes(b"no archive")
    (tmp_path / "x").mkdir()
    path = str(tmp_path / "with*")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        for n in (1, 30, 99, 100, 101, 150, 200, 260, 300):
            out = files.scan_jsonl(spark, path, "t long", n)
            assert sorted(r.t for r in out.collect()) == list(range(n)), n
            assert "Sort [" not in out._jdf.queryExecution().executedPlan().toString()
        with pytest.raises(Exception, match="(?i)gzip"):
            files.scan_jsonl(spark, path, "t long", 301).collect()
        few = files.scan_jsonl(spark, path.replace("with*", "with*/[a-c]*"), "t long", 301)
        assert few.count() == 300
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [7, 40, 200, 100_000])
def test_split_csv_reads_what_the_whole_reader_reads(spark, tmp_path, size):
    for name in ("a", "b"):
        lines = ["\n" * (name == "b") + "a b,c,`d`"]
        for i in range(12):
            records = ['plain,"b",c', '"one, ""two""",x,"\nthree"",y"', '"a\n\nb\nc",,"\n"', '5" pipe,6" pipe,"""\n"""', '"","""",",\n,"', "", '"été","line\n,two",end', '"' + "long, \n" * 90 + '",1,2', "short"]
            Random(i).shuffle(records)
            lines += records
        write(tmp_path / f"{name}.csv", "\n".join(lines) + "\n" * (name == "a"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        whole = spark.read.csv(str(tmp_path), header=True, multiLine=True, escape='"')
        split = records_module.split_csv(spark, str(tmp_path))
        assert split.columns == whole.columns == ["a b", "c", "`d`"]
        order = lambda df: sorted(map(repr, df.collect()))
        assert order(split) == order(whole) and split.count() == 12 * 8 * 2
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > (1 if size < 1000 else 0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_ends_of_lines_in_quotes(spark):
    lines = ['a', '', '"', '""', '"""', 'a"', 'a,"', ',""",', '"a","b', '"a"x"', '"a"x,"', '",', '","', 'x","y"']
    df = spark.createDataFrame([(x,) for x in lines], "v string")
    got = df.select("v", *[records_module.ends_quoted(F.col("v"), q) for q in (False, True)]).collect()

    def ends(line, quoted):
        at_start, i = not quoted, 0
        while i < len(line):
            if quoted and line[i] == '"':
                if line[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    quoted = False
            elif not quoted and line[i] == '"' and at_start:
                quoted = True
            at_start = not quoted and line[i] == ","
            i += 1
        return quoted

    assert [tuple(r) for r in got] == [(x, ends(x, False), ends(x, True)) for x in lines]


def test_csv_line_ends_of_two_characters(spark, tmp_path):
    path = write(tmp_path / "w.csv", "")
    Path(path).write_bytes(b'x,y\r\n1,"a\r\nb"\r\n\r\n"2",c\r\n')
    got = records_module.split_csv(spark, path).collect()
    assert sorted(tuple(r) for r in got) == [("1", "a\r\nb"), ("2", "c")]


def test_transcript_lines(spark, tmp_path):
    path = write(tmp_path / "a.trans.txt", "1-0 HE HOPED  SO \n1-1 STUFF IT\n\n")
    out = files.scan_transcripts(spark, path, "audio/").orderBy("audio").collect()
    assert [tuple(r) for r in out] == [("audio/1-0.flac", "HE HOPED  SO"), ("audio/1-1.flac", "STUFF IT")]


def test_emotion_pairs(spark, tmp_path):
    path = write(tmp_path / "p.json", json.dumps([["joy", "a"], ["", "b"], [None, "c"]], indent=1))
    out = files.scan_emotion_pairs(spark, path).orderBy("text").collect()
    assert [tuple(r) for r in out] == [("joy", "a"), ("neutral", "b"), ("neutral", "c")]
    out = files.scan_emotion_pairs(spark, path, missing=None).orderBy("text").collect()
    assert [r.emotion for r in out] == ["joy", None, None]


def test_emotion_pairs_that_are_none_fail(spark, tmp_path):
    path = write(tmp_path / "bad.json", '[["joy", "a"], \n')
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        files.scan_emotion_pairs(spark, path).collect()
    indented = write(tmp_path / "good.json", json.dumps([["joy", "a"], ["", "b"]], indent=2))
    assert files.scan_emotion_pairs(spark, indented).count() == 2


def test_messages_without_a_type(spark):
    df = spark.createDataFrame([("{",), ('{"a": 1}',), ('{"type": "X"}',), (None,)], "m string")
    assert files.other_messages(df, "m").count() == 3


def test_emotion_lines(spark):
    df = spark.createDataFrame([("joy: hi: you ",), (" : x",), (" plain ",)], "line string")
    out = files.parse_emotion_lines(df, "line").collect()
    assert [(r.emotion, r.text) for r in out] == [("joy", "hi: you"), ("neutral", "x"), ("neutral", "plain")]


def test_media_files(spark, tmp_path):
    for name in ("a.flac", "b.flac", "c.jpg"):
        write(tmp_path / name, name)
    found = files.scan_media_files(spark, str(tmp_path), ".flac").collect()
    assert sorted(Path(r.path).name for r in found) == ["a.flac", "b.flac"]


def test_messages_of_type(spark):
    df = spark.createDataFrame(
        [(1, '{"type":"AVATAR_SPEAK","data":{"a":1}}'), (2, '{"type":"X","data":{"a":2}}'), (3, "no json")],
        "i int, m string",
    )
    out = files.messages_of_type(df, "m", files.SPEAK, "struct<a: int>", ["i"]).collect()
    assert [(r.i, r.data.a) for r in out] == [(1, 1)]


def test_message_json(spark):
    data = F.struct(F.lit("user").alias("actor"), F.lit("häß \"x\"").alias("message"))
    row = spark.range(1).select(files.message_json(files.TRANSCRIPT, data).alias("m")).first()
    assert json.loads(row.m) == {
        "type": "SPEECH_TRANSCRIPT",
        "data": {"actor": "user", "message": 'häß "x"'},
    }
    none = F.struct(F.lit("user").alias("actor"), F.lit(None).cast("string").alias("message"))
    row = spark.range(1).select(files.message_json(files.TRANSCRIPT, none).alias("m")).first()
    assert json.loads(row.m)["data"] == {"actor": "user", "message": None}


def test_splits_keep_text_unescaped(spark, tmp_path):
    df = spark.createDataFrame([("train", "häß"), ("test", "x"), ("dev", None)], "split string, text string")
    path = str(tmp_path / "out")
    sinks.sink_jsonl_splits(df, path)
    raw = "".join(p.read_text(encoding="utf-8") for p in Path(path).rglob("split=train/*.json"))
    assert raw == '{"text":"häß"}\n'
    assert json.loads("".join(p.read_text() for p in Path(path).rglob("split=dev/*.json"))) == {"text": None}


def test_transcripts_are_masked_and_cut_in_parts(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, t, "user", f"mail a{t}@b.example.com") for t in range(5)], "s long, t long, a string, m string"
    )
    out = sessions.masked_transcripts(df, "s", "t", "a", "m", part_turns=2).orderBy("part").collect()
    assert [len(r.transcripts) for r in out] == [2, 2, 1]
    assert {m.message for r in out for m in r.transcripts} == {"mail <EMAIL_ADDRESS>"}


def test_long_sessions_are_one_stored_row(spark, tmp_path):
    rows = spark.createDataFrame([(1, 3), (2, 4)], "s long, q int")
    said = spark.range(2_500).select(
        F.lit(1).cast("long").alias("s"), F.col("id").alias("t"), F.lit("user").alias("a"), F.col("id").cast("string").alias("m")
    )
    path = str(tmp_path / "out")
    sinks.sink_transcripts(rows, said, path, "s", "t", "a", "m")
    out = sinks.read_transcripts(spark, path, "s").orderBy("s").collect()
    assert [(r.s, r.q) for r in out] == [(1, 3), (2, 4)] and out[1].transcripts is None
    assert [m.message for m in out[0].transcripts] == [str(i) for i in range(2_500)]
    with pytest.raises(Exception, match="already exists"):
        sinks.sink_transcripts(rows, said, path, "s", "t", "a", "m")


# -- stored rows -----------------------------------------------------------


def users(spark):
    return spark.createDataFrame([(1, "ann"), (2, "bob"), (3, "cy")], "id long, username string")


def characters(spark):
    return spark.createDataFrame(
        [(12, 1, "z"), (10, 1, "x"), (11, 2, "y")], "cid long, user_id long, name string"
    )


def test_owned_characters(spark):
    rows = sessions.owned_characters(characters(spark), "user_id", 1, "cid").collect()
    assert [r.cid for r in rows] == [10, 12]
    assert sessions.owned_characters(characters(spark), "user_id", 1, "cid", 11).collect() == []
    assert sessions.owned_characters(characters(spark), "user_id", 3, "cid").collect() == []


def test_owner_join_keeps_users_without_characters(spark):
    out = sessions.character_owner_join(characters(spark), users(spark), "user_id", "id", True)
    assert sorted((r.id, r.cid) for r in out.collect() if r.cid) == [(1, 10), (1, 12), (2, 11)]
    assert [r.id for r in out.collect() if r.cid is None] == [3]


def test_unique_usernames(spark):
    df = spark.createDataFrame([(1, "a"), (2, "dup"), (3, "dup"), (4, "dup")], "id long, u string")
    kept = sessions.unique_usernames(df, "u", "id").collect()
    rejected = sessions.unique_usernames(df, "u", "id", rejected=True).collect()
    assert sorted(r.id for r in kept) == [1, 2]
    assert sorted(r.id for r in rejected) == [3, 4]


@pytest.mark.parametrize(
    ("row", "server", "form"),
    [
        (("user@test.com", "N", "x" * 10_000), None, None),
        (("", "N", "p"), "username empty", "username empty"),
        ((" \t", "N", "p"), "username empty", "username empty"),
        ((None, "N", "p"), "username empty", "username empty"),
        (("ab", "N", "p"), None, "username short"),
        (("abc", "", "p"), None, "name empty"),
        (("abc", "N", " "), None, "prompt empty"),
    ],
)
def test_validation(spark, row, server, form):
    df = spark.createDataFrame([row], "username string, name string, prompt string")
    assert sessions.validate_rows(df).first().reject_reason == server
    assert sessions.validate_rows(df, rules="form", prompt="prompt").first().reject_reason == form


def test_agent_defaults(spark):
    df = spark.createDataFrame(
        [(None, None, None), ("af_bella", "julia", ""), ("zoe", "julia", "p")], "voice string, face string, prompt string"
    )
    out = sessions.fill_agent_defaults(df).collect()
    assert [tuple(r) for r in out] == [
        ("af_bella", "julia", "", True), ("af_bella", "julia", "", True), ("zoe", "julia", "p", False),
    ]


def test_feedback_last_write_wins(spark):
    stored = spark.createDataFrame(
        [(1, 0, 0, 0, 0, ""), (2, 5, 4, 3, 2, "old")],
        "id long, q1_rating int, q2_rating int, q3_rating int, q4_rating int, q5_answer string",
    )
    given = spark.createDataFrame(
        [(1, 1, 1, 1, 1, "first", 1), (1, 2, 3, 4, 5, None, 2), (9, 1, 1, 1, 1, "lost", 3)],
        "id long, q1 int, q2 int, q3 int, q4 int, q5 string, at long",
    )
    out = sessions.feedback_upsert(stored, given, "id", "at").orderBy("id").collect()
    assert [tuple(r) for r in out] == [(1, 2, 3, 4, 5, ""), (2, 5, 4, 3, 2, "old")]
    lost = sessions.feedback_upsert(stored, given, "id", "at", rejected=True).collect()
    assert [r.id for r in lost] == [9]


def test_empty_transcripts_pass_but_null_ones_do_not(spark):
    df = spark.createDataFrame([("", "r"), (None, "r"), ("t", ""), ("t", None)], "t string, r string")
    out = sessions.drop_empty_responses(df, "t", "r").collect()
    assert [tuple(r) for r in out] == [("", "r")]


def test_endpoint_latency(spark):
    df = spark.createDataFrame(
        [("a", 0, 0.0), ("a", 2, 5.0), ("a", 7, 0.0), ("b", 1, 0.0), ("b", 4, 0.0)], "u string, s long, e double"
    ).withColumn("ts", F.timestamp_seconds("s"))
    out = sessions.endpoint_latency(df, ["u"], "ts", F.col("e") > 0).orderBy("u").collect()
    assert [r.endpoint_latency for r in out] == [5.0, 3.0]


def test_new_folders_differ_and_lie_in_the_shared_one(spark):
    a, b = new_folder(spark, "x"), new_folder(spark, "x")
    assert a != b
    assert a.startswith(shared_folder(spark) + "/x-")
