from __future__ import annotations

import gzip
import hashlib
import io
import random
import zlib

import pytest

from hearthline.llm import warc
from hearthline.llm.common import Work


def test_record_is_a_gzip_member():
    body = "é<html>\r\n\r\n</html>".encode()
    whole = gzip.decompress(warc.record(5, "http://a/\r\nb", body, None))
    content = warc.parse(whole)
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and content["block"].endswith(body)
    assert content["fields"]["warc-target-uri"] == b"http://a/b"
    assert b"WARC-Refers-To: <urn:x-page:9>" in gzip.decompress(warc.record(5, None, body, 9))


@pytest.mark.parametrize("size", [1, 7, 100, 5000, 10**9])
def test_every_record_is_owned_by_one_range(size):
    rng = random.Random(size)
    data, places = b"", []
    for i in range(40):
        places.append(len(data))
        page = bytes(rng.getrandbits(8) for _ in range(rng.choice([0, 10, 3000])))
        data += warc.record(i, "u", page + warc.MAGIC * 3 + zlib.compress(page), None)
    data += warc.MAGIC + b"no member"
    if size == 1:
        data, places = data[: places[3]], places[:3]
    ranges = range(0, len(data), size)
    found = [at for begin in ranges for at, _ in warc.records_in(io.BytesIO(data), begin, min(begin + size, len(data)))]
    assert found == places


def test_stored_member_inside_a_payload_is_not_a_record():
    """Incompressible payloads hold other members as they are; a range that starts amid one finds those."""
    inner = warc.record(1, None, b"inner", None)
    outer = warc.record(2, None, inner, None, level=0)
    found = list(warc.records_in(io.BytesIO(outer), 0, len(outer)))
    assert [at for at, _ in found] == [0]


def expected(rows, least=0):
    out = []
    top = {}
    for page_id, _, html in rows:
        if page_id is not None:
            top[html or ""] = max(top.get(html or "", page_id), page_id)
    for page_id, _, html in rows:
        body = (html or "").encode()
        again = page_id is not None and len(body) >= least and page_id < top[html or ""]
        sha = warc.base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((str(page_id), len(body), sha, "revisit" if again else "response", str(top[html or ""] if again else None)))
    return sorted(out)


@pytest.mark.parametrize("least", [0, 6])
def test_round_trip(spark, least):
    rng = random.Random(4)
    same = "<p>" + "x" * 5000 + "</p>"
    rows = [(i, f"http://h/{i}", rng.choice([same, "short", "", None, f"own {i} " * rng.randint(1, 900)])) for i in range(300)]
    rows += [(None, None, same), (None, "u", "only here"), (299, "again", "short"), (299, "again", "short"), (1000, None, "é" * 200_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, sha int, payload string").repartition(5)
    out = warc.round_trip(df, min_bytes=least, split_bytes=3000).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in out) == expected(rows, least)


def test_reading_gives_the_pages_back(spark):
    rows = [(i, f"u{i}", f"page {i} ü" * i) for i in range(50)]
    work = Work(spark, "test")
    folder = f"{work.root}/archives"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("page_id", "url", "cast(html as binary) payload")
    manifest = warc.write_archives(pages.repartition(3), folder, work)
    assert sum(r.records for r in manifest.collect()) == 50
    read = warc.read_archives(manifest, folder, split_bytes=500).collect()
    assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in read) == rows


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
