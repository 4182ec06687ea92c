"""Content-addressed archive: round trip, digests, skew paths, edge rows."""

from __future__ import annotations

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from ticketlake.llm import common, warc

ROWS = [(1, "u1", "<p>a</p>"), (2, "u2", "<p>a</p>"), (3, None, None), (4, "u\r\n4", ""), (5, "u5", "é漢🙂 \r\n\r\nWARC/1.1"),
        (6, "u6", "x" * 300_000), (7, "u7", "<p>a</p>"), (7, "u7", "<p>a</p>"), (None, "n", "<p>a</p>"), (None, "n", "alone"),
        (8, "WARC-Type: revisit", "WARC-Type: revisit\r\n"), (9, "u9", "b")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, u, h, "s", "c", 1) for i, u, h in rows],
                                 "page_id long, url string, html string, sha string, address string, copies int")


def expected(rows, least=0):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        top = max((j for j, _, g in rows if (g or "").encode() == b and j is not None), default=None)
        again = len(b) >= least and i != top
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response",
                    top if again else None))
    return sorted(out, key=repr)


def summary(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()),
                  key=repr)


@pytest.mark.parametrize("least", [0, 3])
def test_archive_round_trip(spark, least):
    path = common.shared_path(spark)
    warc.write_archive(frame(spark), path, least=least)
    back = warc.read_archive(spark, path)
    assert summary(back) == expected(ROWS, least)
    assert sorted((r["page_id"] or 0, bytes(r["payload"])) for r in back.collect()) == sorted((i or 0, (h or "").encode()) for i, _, h in ROWS)
    stored = [bytes(r["payload"]) for r in spark.read.parquet(f"{path}/payloads").collect()]
    assert sorted(stored) == sorted({(h or "").encode() for _, _, h in ROWS})  # each once


def test_records_follow_the_format(spark):
    path = common.shared_path(spark)
    warc.write_archive(frame(spark), path)
    for r in warc.read_archive(spark, path).collect():
        record = bytes(r["record"])
        head, block = record.split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and fields["WARC-Type"] == r["record_type"]
        assert len(block) - 4 == int(fields["Content-Length"]) and block.endswith(b"\r\n\r\n")
        http, payload = block[:-4].split(b"\r\n\r\n", 1)
        assert payload == (bytes(r["payload"]) if r["record_type"] == "response" else b"")
        assert http.startswith(b"HTTP/1.1 200") and fields["WARC-Payload-Digest"] == "sha1:" + r["payload_digest"]


def test_equal_digests_are_verified_by_bytes(spark):
    """A digest of one bit puts different payloads under the same digest."""
    def weak(c):
        return F.substring(F.sha2(c, 256), 1, 1)
    path = common.shared_path(spark)
    warc.write_archive(frame(spark), path, digest=weak)
    assert summary(warc.read_archive(spark, path, digest=weak)) == expected(ROWS)


def test_changed_bytes_are_an_error(spark):
    path, other = common.shared_path(spark), common.shared_path(spark)
    warc.write_archive(frame(spark), path)
    spark.read.parquet(f"{path}/headers").write.parquet(f"{other}/headers")
    (spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!")))
     .write.parquet(f"{other}/payloads"))
    with pytest.raises(Exception, match="differs"):
        warc.read_archive(spark, other).select("payload_digest").collect()


def test_hot_payload_and_shuffled_sides(spark, monkeypatch):
    rows = [(i, "u", "same" if i % 3 == 0 else f"p{i // 4}") for i in range(600)]
    monkeypatch.setattr(warc, "SALT_ROWS", 7)
    monkeypatch.setattr(warc, "join_copies", lambda *a: common.join_copies(*a, bound=0, hot=10))
    path = common.shared_path(spark)
    warc.write_archive(frame(spark, rows), path)
    assert spark.read.parquet(f"{path}/headers").select("salt").distinct().count() > 10
    assert summary(warc.read_archive(spark, path)) == expected(rows)


def test_empty_archive(spark):
    path = common.shared_path(spark)
    warc.write_archive(frame(spark, []), path)
    assert warc.read_archive(spark, path).count() == 0
