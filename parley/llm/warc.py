"""Web archives: WARC records written and read, and their index merged from sorted runs."""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import new_folder, pinned

#: Fixed values of the format and of base32.
VERSION = "WARC/1.1"
END = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records in one archive file, and captures in one range of the merged index.
FILE_RECORDS, RANGE_ROWS = 2_000, 20_000
#: Keys sampled to place the borders of the ranges; the only ones the driver sees.
SAMPLED_KEYS = 20_000

CAPTURE = (
    "page_id {kind}, url_key string, ts long, record_type string, refers_to {kind}, "
    "payload_bytes long, payload_digest string, file string, offset long, length long"
)
FIELDS = [f.split()[0] for f in CAPTURE.split(", ")]


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a 160-bit digest given in hex: four times 40 bits, eight characters each."""
    out = []
    for part in range(4):
        value = F.conv(F.substring(digest, 10 * part + 1, 10), 16, 10).cast("long")
        for bits in range(35, -1, -5):
            place = F.shiftright(value, bits).bitwiseAND(31).cast("int") + 1
            out.append(F.substr(F.lit(BASE32), place, F.lit(1)))
    return F.concat(*out)


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels from the right, then path and query, in lower case.

    Scheme, user, ``www.`` and fragment go. A null URL has the empty key.
    """
    plain = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(plain, r"^([^/?]*)", 1), r"^.*@|^www\.", "")
    rest = F.regexp_extract(plain, r"^[^/?]*(.*)$", 1)
    turned = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.when(plain == "", "").otherwise(F.concat(turned, F.lit(")"), rest))


def with_record_types(pages: DataFrame, id_col: str, payload_col: str, least: int) -> DataFrame:
    """``pages`` with ``_payload``, its size and digest, ``_type`` and ``_refers``.

    Payloads are equal when SHA-1 and SHA-256 are. The first id of each digest is
    found with partial aggregates; only digests that occur more than once are
    joined back, so a hot payload is one row on that side.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.withColumn("_payload", payload).withColumns(
        {
            "_bytes": F.octet_length("_payload").cast("long"),
            "_sha1": F.sha1("_payload"),
            "_sha256": F.unhex(F.sha2("_payload", 256)),
        }
    )
    firsts = pinned(
        rows.select(F.col(id_col).alias("_first"), "_sha1", "_sha256", "_bytes")
        .where(F.col("_bytes") >= least)
        .groupBy("_sha1", "_sha256")
        .agg(F.min("_first").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
    )
    again = F.coalesce(F.col(id_col) != F.col("_first"), F.col("_first").isNotNull())
    return rows.join(firsts, ["_sha1", "_sha256"], "left").withColumns(
        {
            "_digest": base32_of_hex(F.col("_sha1")),
            "_type": F.when(again, "revisit").otherwise("response"),
            "_refers": F.when(again, F.col("_first")),
        }
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    time_col: str | None = None,
    least: int = 0,
) -> None:
    """One WARC record per row, as gzip files of up to 2,000 records in ``folder``.

    Of equal payloads of at least ``least`` bytes the smallest id is a response
    and the others are revisits that refer to it. ``time_col`` holds seconds; the
    id stands in for a capture time where none is known.

    Defined cases: null payloads are empty; a null URL is empty; a null id loses
    against any other and is written as an empty record id; rows that repeat the
    smallest id are all responses; an empty table gives no records.
    """
    typed = with_record_types(pages, id_col, payload_col, least)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    seconds = F.col(time_col) if time_col else F.col(id_col)
    date = F.date_format(
        F.timestamp_seconds(F.coalesce(seconds.cast("long"), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'"
    )
    url = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20\x7f]", "_")
    revisit = F.col("_type") == "revisit"

    def line(field: str, value: Column) -> Column:
        return F.concat(F.lit(f"{field}: "), value, F.lit(END))

    head = F.concat(
        F.lit(VERSION + END),
        line("WARC-Type", F.col("_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), name, F.lit(">"))),
        line("WARC-Date", date),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        line("X-Payload-Length", F.col("_bytes").cast("string")),
        F.when(
            revisit,
            F.concat(
                line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("_refers").cast("string"), F.lit("")), F.lit(">"))),
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("_bytes").cast("string"))),
        F.lit(END),
    )
    record = F.concat(head, F.when(revisit, "").otherwise(F.col("_payload")))
    (
        typed.select(record.alias("value"))
        .write.option("lineSep", END + END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", FILE_RECORDS)
        .text(folder)
    )


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers, payload, offset and length of each record of an archive's bytes."""
    at, stop = 0, len(data)
    gap = (END + END).encode()
    while at < stop:
        body = data.index(gap, at) + len(gap)
        lines = data[at : body - len(gap)].decode("utf-8").split(END)
        if lines[0] != VERSION:
            raise ValueError(f"no record at byte {at}: {lines[0][:40]!r}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        end = body + int(head["Content-Length"])
        if data[end : end + len(gap)] != gap:
            raise ValueError(f"the record at byte {at} does not end at byte {end}")
        yield head, data[body:end], at, end - at
        at = end + len(gap)


def read_archives(spark, folder: str, kind: str = "long") -> DataFrame:
    """The captures of all archives in ``folder``, one row per record.

    A file is one task's work and holds up to 2,000 records. The digest of every
    response is computed again; a payload that does not have the one its header
    states fails the read.
    """
    number = int if kind in ("bigint", "int", "long") else str

    def key(urn: str) -> Any:
        text = urn[len("<urn:page:") : -1]
        return number(text) if text else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                out = []
                for head, payload, at, size in records(zlib.decompress(content, 31)):
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = head["WARC-Type"] == "response"
                    if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"wrong payload digest at byte {at} of {path}")
                    out.append(
                        (
                            key(head["WARC-Record-ID"]),
                            head["WARC-Target-URI"],
                            head["WARC-Date"],
                            head["WARC-Type"],
                            None if response else key(head["WARC-Refers-To"]),
                            len(payload) if response else int(head["X-Payload-Length"]),
                            digest,
                            path.rsplit("/", 1)[-1],
                            at,
                            size,
                        )
                    )
                yield pd.DataFrame(out, columns=RAW, dtype=object)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    raw = files.mapInPandas(
        run,
        f"page_id {kind}, url string, date string, record_type string, refers_to {kind}, "
        "payload_bytes long, payload_digest string, file string, offset long, length long",
    )
    return raw.select(
        "page_id",
        url_key(F.col("url")).alias("url_key"),
        F.unix_timestamp("date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        *RAW[3:],
    )


RAW = ["page_id", "url", "date", *FIELDS[3:]]


class LoserTree:
    """The smallest head of k sorted runs, found by one path of comparisons.

    An inner node holds the run that lost there; the winner of all stands on top.
    Taking it replays only the matches from its leaf to the root.
    """

    def __init__(self, runs: list[Iterator]) -> None:
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self.replay(leaf)

    def beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def replay(self, run: int) -> None:
        winner, node = run, (run + self.k) // 2
        while node:
            held = self.tree[node]
            if held < 0:  # the first to come here waits for its match
                self.tree[node] = winner
                return
            if self.beats(held, winner):
                self.tree[node], winner = winner, held
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while (head := self.heads[self.tree[0]]) is not None:
            yield head
            run = self.tree[0]
            self.heads[run] = next(self.runs[run], None)
            self.replay(run)


def merged(runs: Iterable[list[tuple]]) -> Iterator[tuple]:
    return iter(LoserTree([iter(r) for r in runs]))


def merge_index(captures: DataFrame) -> DataFrame:
    """The captures with their ``place`` in the order of URL key, time and id.

    Each archive file is a run, sorted by itself and cut at the borders of key
    ranges; each range merges its pieces of all runs by a loser tree. Borders are
    quantiles of a bounded sample of whole keys (URL key, time, id), so that many
    captures of one URL fall into several ranges. The places of a range start
    where the counts of the ranges before end.
    """
    kind = dict(captures.dtypes)["page_id"]
    rows = pinned(captures.select(*FIELDS))
    n = rows.count()
    ranges = max(64, n // RANGE_ROWS)
    part = 1 << 20
    wanted = min(part, -(-SAMPLED_KEYS * part // max(1, n)))
    chosen = F.pmod(F.xxhash64("file", "offset"), F.lit(part)) < wanted
    sample = sorted(
        (r["url_key"], r["ts"], order_of(r["page_id"]))
        for r in rows.where(chosen).select("url_key", "ts", "page_id").collect()
    )
    borders = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []

    def cut(run: pd.DataFrame) -> pd.DataFrame:
        run = run.astype(object).where(run.notna(), None)
        found = sorted((*keyed(r), r) for r in run.itertuples(index=False, name=None))
        pieces: dict[int, list[tuple]] = {}
        for *key, row in found:
            pieces.setdefault(bisect_right(borders, tuple(key[:3])), []).append(row)
        return pd.DataFrame(
            {
                "range": list(pieces),
                "rows": [len(p) for p in pieces.values()],
                "piece": [[dict(zip(FIELDS, r, strict=True)) for r in p] for p in pieces.values()],
            }
        )

    def join(pieces: pd.DataFrame) -> pd.DataFrame:
        runs = [[(*keyed(r), r) for r in (tuple(x[f] for f in FIELDS) for x in p)] for p in pieces["piece"]]
        out = [(int(pieces["range"].iloc[0]), i, *row[-1]) for i, row in enumerate(merged(runs))]
        return pd.DataFrame(out, columns=["range", "within", *FIELDS], dtype=object)

    schema = CAPTURE.format(kind=kind)
    fields = ", ".join(f"{a}: {b}" for a, b in (f.split() for f in schema.split(", ")))
    pieces = pinned(
        rows.groupBy("file").applyInPandas(cut, f"range int, rows long, piece array<struct<{fields}>>")
    )
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        pieces.groupBy("range")
        .agg(F.sum("rows").alias("rows"))
        .select("range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    )
    found = pieces.groupBy("range").applyInPandas(join, f"range int, within long, {schema}")
    return found.join(F.broadcast(starts), "range").select(
        *FIELDS, (F.col("start") + F.col("within")).alias("place")
    )


def order_of(key: Any) -> tuple[bool, Any]:
    """Orders null first."""
    return (key is not None, 0 if key is None else key)


def keyed(row: tuple) -> tuple:
    """Sort key of a capture: URL key, time, id; then file and offset, so no two are equal."""
    return (row[1], row[2], order_of(row[0]), row[7], row[8])


def archive_pages(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write ``pages`` as archives, read them back and return the merged index.

    ``folder`` must not exist; by default it is a new one in the shared folder.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    kind = dict(pages.dtypes)[options.get("id_col", "page_id")]
    write_archives(pages, folder, **options)
    return merge_index(read_archives(spark, folder, kind))
