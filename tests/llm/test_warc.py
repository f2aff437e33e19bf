import glob
import gzip
import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc as W
from tidemark.llm.common import new_folder

SCHEMA = "record_id string, refers_to string, target_uri string, payload binary, digest string, chunk string, file int"


def frame(spark, payloads):
    rows = [(f"urn:x:{i}", None, f"http://h/{i} é\r\n", p, hashlib.sha256(p).hexdigest(), "c", 1) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, SCHEMA)


def test_round_trip_of_binary_payloads_in_chunks(spark):
    rng = random.Random(0)
    payloads = [b"", b"x", b"\r\n\r\nWARC/1.1\r\n", rng.randbytes(100_000), b"ab" * 5000, bytes(4096), rng.randbytes(4096)]
    index = W.write_archives(frame(spark, payloads), new_folder(spark, "t"), chunk_bytes=4096)
    rows = sorted(W.read_archives(index, chunk_bytes=1000).collect(), key=lambda r: (r.record_id, r.chunk_no))
    for i, p in enumerate(payloads):
        own = [r for r in rows if r.record_id == f"urn:x:{i}"]
        assert b"".join(r.chunk for r in own) == p
        assert [r.chunk_no for r in own] == list(range(len(own))) and [r.last for r in own] == [False] * (len(own) - 1) + [True]
        so_far = b""
        for r in own:
            assert len(r.chunk) <= 1000
            so_far += r.chunk
            assert (r.bytes_so_far, r.crc32_so_far, r.sha256_so_far) == (len(so_far), zlib.crc32(so_far), hashlib.sha256(so_far).hexdigest())


def test_archives_are_gzip_members_that_others_can_read(spark):
    folder = new_folder(spark, "t")
    W.write_archives(frame(spark, [b"hello", b"world"]).coalesce(1), folder)
    data = gzip.open(glob.glob(f"{folder.removeprefix('file://')}/*.warc.gz")[0]).read()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.count(b"WARC/1.1") == 2
    assert data.endswith(b"\r\n\r\nworld\r\n\r\n")


def test_archives_are_rotated(spark):
    folder = new_folder(spark, "t")
    index = W.write_archives(frame(spark, [random.Random(i).randbytes(3000) for i in range(9)]).coalesce(1), folder, archive_bytes=5000)
    assert index.select("file").distinct().count() > 2
    assert W.read_archives(index).where("last").count() == 9


def test_damage_is_found(spark):
    folder = new_folder(spark, "t")
    index = W.write_archives(frame(spark, [b"hello" * 100]), folder)
    name = glob.glob(f"{folder.removeprefix('file://')}/*.warc.gz")[0]
    plain = gzip.open(name).read().replace(b"hellohello", b"hellohallo", 1)
    packed = zlib.compressobj(1, zlib.DEFLATED, 31)
    raw = packed.compress(plain) + packed.flush()
    open(name, "wb").write(raw)
    with pytest.raises(Exception, match="damaged"):
        W.read_archives(index.withColumn("length", F.lit(len(raw)))).collect()


def test_pages(spark, tmp_path):
    big = "é" * 200_000
    rows = [(3, "http://a", "x" * 99), (4, "http://a", "x" * 99), (5, None, "y" * 100), (6, "u", "y" * 100), (2, "u", "y" * 100), (7, "u", big), (8, "u", big), (9, "u", None), (10, "u", ""), (None, "u", "y" * 100), (6, "u", "y" * 100)]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, digest string, id int")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    out = sorted((tuple(r) for r in W.op2_warc(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert out == sorted(con.sql(W.OP2_SQL).fetchall(), key=str)
    assert {(r[0], r[4]) for r in out if r[3] == "revisit"} == {(5, 2), (6, 2), (8, 7)}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert W.op2_warc(spark, str(tmp_path)).collect() == []
