"""WARC archives with an index made by merging locally sorted runs.

Pages are written as WARC/1.1 records through Spark's text sink, whose line separator is the
two line breaks that end a record, so tasks commit files as for any other table. Reading back
parses each archive and sorts its captures: one run per archive. The runs are dealt by ranges
of (URL key, time, page), and each range merges its pieces of the runs with a loser tree.

Cases: a null html is an empty payload; a null url leaves the target out and sorts first; equal
payloads (empty ones too) are stored by the smallest page id and revisited by all others; rows
that repeat this id are responses as well; a page without an id is archived, but never referred
to; an empty table gives no captures; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path, store
from .common import frames, spread_join, width

# Fixed values of the format.
BREAK = "\r\n"
RECORD_END = BREAK + BREAK
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# An archive holds at most so many records; archives are read whole by one task.
RECORDS_PER_ARCHIVE = 2_000

# Pages carry no time: page n counts as taken n seconds (modulo ten years) after 2024 began.
FIRST_CAPTURE, SPAN = 1_704_067_200, 315_360_000

CAPTURE = ("url_key string, captured_at string, page_id long, url string, record_type string, "
           "payload_digest string, payload_bytes long, refers_to long, archive string, record_offset long")


def base32_digest(payload: Column) -> Column:
    """SHA-1 in base 32: five hexadecimal digits are four letters."""
    digits = F.sha1(payload)
    letters = []
    for i in range(8):
        five = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(five, shift).bitwiseAND(31) + 1, F.lit(1))
                    for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def with_referrals(pages: DataFrame) -> DataFrame:
    """Payload, digest, size and ``refers_to`` (null on a response).

    Only digests that occur more than once are joined back, spread over salts, because one
    payload may be a third of all pages.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumns({"digest": base32_digest(F.col("payload").cast("binary")),
                       "payload_bytes": F.octet_length("payload").cast("long")})
    firsts = p.groupBy("digest", "payload_bytes").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    return spread_join(p, firsts, ["digest", "payload_bytes"]).withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def record_text(page: dict[str, Column]) -> Column:
    """One record without its final line breaks."""
    revisit = page["refers_to"].isNotNull()
    uri = lambda ident: F.concat(F.lit("<urn:page:"), ident.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))
    target = F.regexp_replace(page["url"], r"[\x00-\x1F\x7F]", "")
    headers = [
        F.lit("WARC/1.1" + BREAK),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.coalesce(line("WARC-Record-ID", uri(page["page_id"])), F.lit("")),
        line("WARC-Date", F.date_format(
            F.timestamp_seconds(F.pmod(F.coalesce(page["page_id"], F.lit(0)), F.lit(SPAN)) + FIRST_CAPTURE),
            "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.coalesce(line("WARC-Target-URI", target), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), page["digest"])),
        F.when(revisit, F.concat(line("WARC-Refers-To", uri(page["refers_to"])),
                                 line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        line("X-Payload-Length", page["payload_bytes"].cast("string")),
        line("Content-Length", F.when(revisit, "0").otherwise(page["payload_bytes"].cast("string"))),
        F.lit(BREAK),
    ]
    return F.concat(*headers, F.when(revisit, "").otherwise(page["payload"]))


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives of ``pages`` (see ``with_referrals``) under ``path``."""
    columns = {c: F.col(c) for c in ("page_id", "url", "payload", "digest", "payload_bytes", "refers_to")}
    pages.select(record_text(columns).alias("value")).write.option("lineSep", RECORD_END).option(
        "compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).text(path)


def url_key(url: str | None) -> str:
    """Sort key of a URL: reversed host, then path and query, in lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host = (parts.hostname or "").split(".")
    except ValueError:
        return url.lower()
    tail = parts.path + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host)) + ")" + (tail or "/")


def parse_archive(content: bytes, name: str) -> Iterator[tuple]:
    """Captures of one archive. Payload digests are computed anew and must match."""
    data = zlib.decompress(content, 47)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(BREAK)
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        payload = data[end + 4:end + 4 + size]
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response" and (
                base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest
                or size != int(head["X-Payload-Length"])):
            raise ValueError(f"{name} is damaged at {at}")
        ident = lambda key: int(head[key][len("<urn:page:"):-1]) if key in head else None
        url = head.get("WARC-Target-URI")
        yield (url_key(url), head["WARC-Date"], ident("WARC-Record-ID"), url, head["WARC-Type"], digest,
               int(head["X-Payload-Length"]), ident("WARC-Refers-To"), name, at)
        at = end + 4 + size + 4


_COLUMNS = [re.split(r"\s+", c.strip())[0] for c in CAPTURE.split(",")]


def sort_key(row: tuple) -> tuple:
    """URL key, time, page; a missing page id first."""
    return row[0], row[1], -1 if row[2] is None else row[2], row[8], row[9]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS, dtype=object)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of the archives under ``path``; those of an archive come sorted: a run."""
    def parse(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                yield _frame(sorted(parse_archive(content, name.rsplit("/", 1)[-1]), key=sort_key))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return frames(files.select("path", "content"), parse, CAPTURE)


class LoserTree:
    """Merges k sorted streams. Each inner node keeps the loser of its match, so the next winner
    takes one comparison a level."""

    def __init__(self, streams: list[Iterator[tuple]]):
        self.streams = streams
        self.k = max(1, len(streams))
        self.head = [next(s, None) for s in streams] or [None]
        self.loser = [-1] * self.k
        for leaf in range(self.k):
            self._climb(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (sort_key(x), a) < (sort_key(y), b)

    def _climb(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.loser[node] == -1:
                self.loser[node] = winner
                return
            if self._beats(self.loser[node], winner):
                winner, self.loser[node] = self.loser[node], winner
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.head[self.loser[0]] is not None:
            top = self.loser[0]
            yield self.head[top]
            self.head[top] = next(self.streams[top], None)
            self._climb(top)


def merge_runs(captures: DataFrame) -> DataFrame:
    """Capture histories in global order of (URL key, time, page): partition i holds what comes
    before partition i + 1. A URL with very many captures is cut by time."""
    spark = captures.sparkSession

    def merge(batches):
        runs: dict[str, list[pd.DataFrame]] = {}
        for batch in batches:
            for name, part in batch.groupby("archive", sort=False):
                runs.setdefault(name, []).append(part)

        def stream(parts):
            for part in parts:
                for row in part.itertuples(index=False, name=None):
                    yield tuple(None if x is pd.NA or x != x else x for x in row)

        out = []
        for row in LoserTree([stream(parts) for parts in runs.values()]):
            out.append(row)
            if len(out) == 10_000:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    # Spark's own (spilling) sort puts each run's piece together and in order; the merge across
    # runs is the loser tree's.
    dealt = captures.repartitionByRange(width(spark), "url_key", "captured_at", "page_id")
    return frames(dealt.sortWithinPartitions("archive", "url_key", "captured_at", "page_id", "record_offset"),
                  merge, CAPTURE)


def archive_and_index(pages: DataFrame) -> DataFrame:
    """Write all pages as archives, read them back, and return the merged capture index."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(with_referrals(pages), path)
    return merge_runs(store(read_runs(spark, path), "capture_runs"))
