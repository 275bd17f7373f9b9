"""The queries of the corpus operators over the test tables, with DuckDB SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.byte_bpe import decode, encode
from parley.llm.common import fold_of, table
from parley.llm.exact_dedup import exact_groups
from parley.llm.hmm_lm import score_texts
from parley.llm.importance import resample
from parley.llm.jaccard_join import near_groups
from parley.llm.language_id import learn, predict
from parley.llm.license_scan import scan, summary
from parley.llm.mixing import copy_counts
from parley.llm.quality_rules import judge
from parley.llm.sharding import kd_shards
from parley.llm.suffix_dedup import repeated_passages
from parley.llm.vector_codes import compress
from parley.llm.warc import archive_pages

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of a text in DuckDB.
SQL_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        _queries[name] = run
        if sql is not None:
            _oracles[name] = sql
        return run

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracles() -> dict[str, str]:
    return dict(_oracles)


@query("op1_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_passages(table(spark, sf, "documents")).drop("spans")


@query("op2_quality_rules")
def quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = judge(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


SQL_EXACT = f"""
WITH rows AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM rows WINDOW same AS (PARTITION BY norm)
"""


@query("op3_exact_dedup", SQL_EXACT)
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_groups(table(spark, sf, "documents"), keep="largest")


@query("op4_language_id")
def language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    found = predict(docs, learn(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Base32 of the digest: four times 40 bits, eight characters each.
SQL_BASE32 = " || ".join(
    f"substr('{BASE32}', 1 + ((('0x' || substr(digest, {10 * part + 1}, 10))::BIGINT >> {bits}) & 31)::INT, 1)"
    for part in range(4)
    for bits in range(35, -1, -5)
)
SQL_WARC = rf"""
WITH plain AS (
  SELECT page_id, coalesce(html, '') AS payload,
         regexp_replace(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://|#.*$', '', 'g') AS plain
  FROM pages),
rows AS (
  SELECT page_id, payload, strlen(payload) AS payload_bytes, sha1(payload) AS digest,
         CASE WHEN plain = '' THEN '' ELSE
           array_to_string(list_reverse(string_split(regexp_replace(
             regexp_extract(plain, '^([^/?]*)', 1), '^.*@|^www\.', '', 'g'), '.')), ',')
           || ')' || regexp_extract(plain, '^[^/?]*(.*)$', 1) END AS url_key
  FROM plain),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM rows)
SELECT page_id, payload_bytes, {SQL_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to,
       url_key, row_number() OVER (ORDER BY url_key, page_id) - 1 AS place
FROM firsts
"""


@query("op5_warc_index", SQL_WARC)
def warc_index(spark: SparkSession, sf: str) -> DataFrame:
    return archive_pages(table(spark, sf, "pages"), least=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "place"
    )


@query("op6_ngram_jaccard")
def ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return near_groups(table(spark, sf, "documents"))


@query("op7_kd_sharding")
def kd_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return kd_shards(table(spark, sf, "documents"), shards=16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


SQL_MIX = f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len({SQL_WORDS.format('text')}), 0)::BIGINT AS size FROM documents),
sources AS MATERIALIZED (
  SELECT source, sum(size)::BIGINT AS size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][
           1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM docs GROUP BY source),
levels AS (
  SELECT 0 AS round, 0.0::DOUBLE AS level, -1 AS stopped
  UNION ALL
  SELECT round + 1, greatest(level, (1.5::DOUBLE * total - taken) / open), n
  FROM (
    SELECT round, level, stopped,
           (SELECT sum(size) FROM sources)::DOUBLE AS total,
           (SELECT count(*) FROM sources WHERE level * weight >= 2.0::DOUBLE * size) AS n,
           (SELECT coalesce(sum(2.0::DOUBLE * size), 0) FROM sources
            WHERE level * weight >= 2.0::DOUBLE * size) AS taken,
           (SELECT sum(weight) FROM sources WHERE level * weight < 2.0::DOUBLE * size) AS open
    FROM levels)
  WHERE n > stopped AND open > 0),
rates AS (
  SELECT source, size,
         least((SELECT max(level) FROM levels) * weight, 2.0::DOUBLE * size) AS target
  FROM sources),
drawn AS (
  SELECT doc_id, d.size, r.size AS source_size, r.target,
         CASE WHEN r.size > 0 THEN r.target / r.size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE
           / 4503599627370496.0::DOUBLE AS draw
  FROM docs d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
counted AS (
  SELECT *, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM drawn)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM counted
"""


@query("op8_mix_sources", SQL_MIX)
def mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return copy_counts(table(spark, sf, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)


def vocabulary() -> tuple[str, str]:
    """Rank file and pattern of the public byte-level vocabulary of 50,256 tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op9_byte_bpe")
def byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path, pattern = vocabulary()
    coded = decode(encode(table(spark, sf, "documents"), path, pattern), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op10_hmm_scores")
def hmm_scores(spark: SparkSession, sf: str) -> DataFrame:
    return score_texts(table(spark, sf, "documents"), folds=7, left_out=2, states=4)


def sql_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds written out one by one; every part meets every entry."""
    steps = [
        """kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x
  FROM kept, range({parts}) AS r(p))""",
        f"""b0 AS MATERIALIZED (
  SELECT p, k, x AS c FROM parts JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT {entries}
  ) USING (vec_id))""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, p, any_value(x) AS x, min(256 * list_sum(list_transform(list_zip(x, c),
         lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT + k) AS best
  FROM parts JOIN b{r} USING (p) GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
  SELECT p, k, coalesce(new, c) AS c FROM b{r} LEFT JOIN (
    SELECT p, k, list(m ORDER BY i) AS new FROM (
      SELECT p, best % 256 AS k, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m
      FROM (SELECT p, best, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY ALL)
    GROUP BY p, k) USING (p, k))""")
    return f"""WITH {", ".join(steps)},
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS h FROM b{rounds}),
codes AS (
  SELECT vec_id, lower(string_agg(printf('%02x', (best % 256)::INT), '' ORDER BY p)) AS code,
         sum(best // 256)::BIGINT AS error
  FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       h AS codebooks_sha256
FROM codes JOIN kept USING (vec_id), books"""


@query("op11_vector_codes", sql_codes())
def vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return compress(table(spark, sf, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


@query("op12_license_scan")
def license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return summary(scan(table(spark, sf, "documents")))


#: Words between ASCII characters that are neither digits nor a-z, of a lower-cased text.
SQL_NAMES = (
    f"regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
SQL_IMPORTANCE = f"""
WITH RECURSIVE steps AS (
  SELECT i, i AS c, 0 AS k FROM range(256) AS r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce({SQL_NAMES}, []) AS words FROM documents),
own AS MATERIALIZED (SELECT r, unnest(words) AS word FROM docs),
aim AS MATERIALIZED (SELECT unnest({SQL_NAMES}) AS word FROM benchmark),
names AS MATERIALIZED (
  SELECT word, xor(4294967295, list_reduce(
           [4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(word)), '..'),
                                                  lambda x: ('0x' || x)::BIGINT),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 10000 AS bucket
  FROM (SELECT word FROM own UNION SELECT word FROM aim), crc),
gains AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM own) + 10000)::DOUBLE)
           / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM aim) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT bucket, count(*) AS s FROM own JOIN names USING (word) GROUP BY bucket)
  FULL JOIN (SELECT bucket, count(*) AS t FROM aim JOIN names USING (word) GROUP BY bucket) USING (bucket)),
weights AS (
  SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM own JOIN names USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS MATERIALIZED (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln(
           (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE)
           / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (r)),
drawn AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (
              PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS place
  FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank
FROM drawn
"""


@query("op13_importance_resampling", SQL_IMPORTANCE)
def importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"), most=1, seed=2024)
