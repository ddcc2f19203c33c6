from __future__ import annotations

import base64
import gzip
import hashlib
import random

from helpers import with_clashes
from pagetide.llm import warc
from pagetide.session import new_path

PAGES = "page_id long, url string, html string"


def expected(data):
    first = {}
    for page_id, _, html in data:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html in data:
        body = (html or "").encode()
        to = first.get(html or "")
        to = None if to == page_id or to is None else to
        out.append((page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


def test_round_trip_against_brute_force(spark):
    rng = random.Random(3)
    bodies = ["", None, "WARC/1.1\r\n\r\nnot a record\r\n\r\n", "line\nline\r\n", "ünï", *("x" * k for k in range(40))]
    data = [(i, rng.choice([None, "", "http://b.example/a?x=1", f"https://a.example.org/{i % 7}", "not a url",
                            "http://[bad", "http://x/\r\nWARC-Type: evil"]), rng.choice(bodies)) for i in range(400)]
    data += [(1000 + i, "http://hot.example/", "the same") for i in range(300)] + [(None, "u", "the same"), (3, "u", "alone")]
    got = warc.archive_and_index(with_clashes(spark.createDataFrame(data, PAGES))).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                   for r in got), key=str) == expected(data)
    # Partition after partition, the index is in order of URL key, time and page.
    keys = [(r["url_key"], r["captured_at"], -1 if r["page_id"] is None else r["page_id"]) for r in got]
    assert keys == sorted(keys)


def test_archives_are_well_formed(spark, tmp_path):
    path = new_path(spark, "warc-test")
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", "body" * (i % 3)) for i in range(20)], PAGES)
    warc.write_archives(warc.with_referrals(pages), path)
    whole = b"".join(gzip.decompress(r["content"]) for r in
                     spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect())
    assert whole.count(b"WARC/1.1\r\n") == 20 and whole.endswith(b"\r\n\r\n")
    assert whole.count(b"WARC-Type: response") == 3 and whole.count(b"WARC-Refers-To: <urn:page:") == 17


def test_loser_tree_merges():
    rng = random.Random(4)
    row = lambda: (str(rng.randrange(9)), "t", rng.randrange(50), "", "", "", 0, None, "a", rng.randrange(99))
    for k in range(9):
        runs = [sorted((row() for _ in range(rng.randrange(12))), key=warc.sort_key) for _ in range(k)]
        merged = list(warc.LoserTree([iter(r) for r in runs]))
        assert [warc.sort_key(r) for r in merged] == sorted(warc.sort_key(x) for r in runs for x in r)


def test_empty_table(spark):
    assert warc.archive_and_index(spark.createDataFrame([], PAGES)).count() == 0
