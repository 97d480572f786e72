import gzip
import hashlib
from collections import Counter

import pytest

from plinth.llm import warc
from plinth.llm.files import old_file
from plinth.llm.warc import read_archives, records, write_archives

BIG, OTHER = "é" * 600, "x" * 1000


def cases():
    rows = [(i, f"http://h/{i}", BIG if i % 3 else f"{i}" * 700) for i in range(60)]
    rows += [(100, None, None), (101, "u\r\nWARC-Type: revisit", ""), (102, "u", "small"), (103, "u", "small"), (104, "http://é/漢", OTHER)]
    rows += [(None, "n", BIG), (104, "again", OTHER), (104, "again", OTHER), (90, "x", OTHER), (None, "p", "y" * 2000), (None, "q", "y" * 2000), (200, "r", "\r\n\r\nWARC/1.1\r\n" * 200)]
    return rows


def brute(rows):
    best = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and page is not None:
            best[data] = max(page, best.get(data, page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = best.get(data)
        again = first is not None and page != first
        out.append((page, "revisit" if again else "response", len(data), hashlib.sha1(data).hexdigest(), first if again else None, None if again else data))
    return out


@pytest.mark.parametrize("size", [1 << 30, 500])
def test_round_trip(spark, size):
    rows = cases()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    manifest = write_archives(df, archive_bytes=size)
    got = read_archives(manifest).collect()
    assert Counter((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, r.payload and bytes(r.payload)) for r in got) == Counter(
        (*x[:5], x[5] or x[5]) for x in brute(rows)
    )
    assert next(r.url for r in got if r.page_id == 100) is None
    assert next(r.url for r in got if r.page_id == 101) == "u%0D%0AWARC-Type:%20revisit"
    total = manifest.selectExpr("sum(records) r", "sum(revisits) v", "count(*) n").first()
    assert total.r == len(rows) and total.v == sum(x[1] == "revisit" for x in brute(rows))
    assert total.n > (10 if size == 500 else 0)


def test_archives_are_plain_gzip(spark):
    df = spark.createDataFrame(cases()[:5], "page_id long, url string, html string")
    for row in write_archives(df).collect():
        with old_file(row["path"]) as source:
            text = gzip.decompress(source.read())
            source.seek(0)
            assert text.count(b"WARC/1.1\r\n") == row["records"] == len(list(records(source, chunk=7)))


def test_payloads_are_not_shuffled(spark, monkeypatch, tmp_path):
    plans, old = [], warc.staged
    monkeypatch.setattr(warc, "staged", lambda df, tag: (plans.append((tag, df._jdf.queryExecution().executedPlan().toString())), old(df, tag))[1])
    spark.createDataFrame(cases(), "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert write_archives(spark.read.parquet(str(tmp_path / "pages"))).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {tag for tag, _ in plans} == {"warc-headers", "revisited", "warc-manifest"}
    assert all("Exchange" not in plan for tag, plan in plans if "html" in plan)


@pytest.mark.parametrize("rows", [[], [(None, None, None)]])
def test_empty(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = read_archives(write_archives(df), with_payload=False).collect()
    assert [(r.page_id, r.payload_bytes, r.record_type) for r in got] == [(None, 0, "response")] * len(rows)
