import glob
import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkwarden.llm import warc
from sparkwarden.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string"
RECORD = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
LONG = "<p>" + "same text " * 20
ODD = [
    (1, "http://a/1", LONG), (2, "http://a/2", LONG), (7, "http://a/7", LONG), (3, None, None), (4, "", ""), (5, "http://a/WARC/1.0", "short"), (6, "u\r\nContent-Length: 3\r\n\r\nx", "short"),
    (8, "http://é/ü?q=1", RECORD), (9, "http://a/9", f"before\r\n\r\n{RECORD}after"), (10, "http://a/10", RECORD * 3), (11, "http://a/11", "WARC/1.0\r\n" * 40), (12, "http://a/12", "x\r\n\r\n\r\n"),
    (13, "http://a/13", "\r\n\r\nWARC/1.0\r\nContent-Length: 99999999999999999999\r\n\r\n"), (14, "http://a/14", "WARC/1.0"), (15, "http://a/15", "WARC/1.0\r"), (16, "http://a/16", "日本語😀" * 300),
    (17, "http://a/17", RECORD * 3), (None, "http://a/n", LONG), (None, None, "z" * 150), (None, None, "z" * 150), (1, "http://a/1", LONG), (18, "http://a/18", "y" * 100_000 + "WARC/1.0\r\n" + "w" * 50_000), (-5, "http://a/m", "z" * 99), (19, "", "z" * 99),
    (20, "http://a/20", "WARC/1.0\r\nContent-Length: 1\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n"),
]


def brute(rows):
    least, out = {}, []
    for i, _, html in rows:
        if i is not None:
            least[html or ""] = min(least.get(html or "", i), i)
    for i, _, html in rows:
        raw = (html or "").encode()
        first = least.get(html or "")
        again = len(raw) >= 100 and first is not None and i != first
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def plain_records(data):
    """Type, id and payload of the records of an archive, one after the other."""
    at = 0
    while at < len(data):
        assert data[at:].startswith(b"WARC/1.0\r\n")
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode()
        n = int(re.search(r"^Content-Length: (\d+)$", head.replace("\r", ""), re.M)[1])
        block = data[end + 4 : end + 4 + n]
        assert data[end + 4 + n : end + 8 + n] == b"\r\n\r\n" and block.startswith(b"HTTP/1.1 200 OK\r\n")
        yield re.search(r"WARC-Type: (\w+)", head)[1], re.search(r"WARC-Record-ID: (\S+)", head)[1], block.partition(b"\r\n\r\n")[2]
        at = end + 8 + n


def rows_of(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.fixture
def small_splits(spark):
    """Splits of a few bytes, so that edges fall anywhere, inside the magic too."""
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def test_archives_are_plain_warc(spark, tmp_path):
    pages = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    warc.write(pages, f"{tmp_path}/w")
    got = [x for f in glob.glob(f"{tmp_path}/w/part-*") for x in plain_records(open(f, "rb").read())]
    want = brute(ODD)
    assert sorted((t, i) for t, i, _ in got) == sorted((t, f"<urn:x-page:{'' if i is None else i}>") for i, _, _, t, _ in want)
    assert all(not p for t, _, p in got if t == "revisit")
    payloads = warc.payloads(spark, f"{tmp_path}/w").collect()
    assert sorted((r.type, r.record_id, bytes(r.payload)) for r in payloads) == sorted(got)


@pytest.mark.parametrize("parts", [1, 4])
def test_odd_pages(spark, parts):
    """Magic and whole records inside payloads and URLs, nulls, repeated rows and keys, short and long payloads, clashing columns."""
    pages = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("x") for c in ("value", "file", "block", "key", "body", "digest", "size", "first", "n", "offset", "next")})
    assert rows_of(warc.archived(pages.repartition(parts))) == brute(ODD)
    assert rows_of(warc.archived(pages.repartition(parts), most_sent=0)) == brute(ODD)


def test_splits_anywhere(spark, small_splits):
    rows = [r for r in ODD if len(r[2] or "") < 2_000]
    assert rows_of(warc.archived(spark.createDataFrame(rows, SCHEMA).coalesce(1))) == brute(rows)


def test_chain_jumps_over_many_splits(spark, small_splits, tmp_path):
    """Records longer than splits, splits with several records, and false candidates at every edge."""
    rows = [(k, f"http://a/{k}", (RECORD if k % 3 else "plain ") * (k % 5) + "v" * (k * 13 % 250)) for k in range(40)]
    warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"{tmp_path}/w")
    found = warc.candidates(spark, f"{tmp_path}/w")
    index = warc.read(spark, f"{tmp_path}/w").collect()
    data = open(glob.glob(f"{tmp_path}/w/part-*")[0], "rb").read()
    assert sorted(r.offset for r in found.collect()) == [m.start() for m in re.finditer(b"WARC/1.0\r\n", data)]
    assert found.select("block").distinct().count() > 30 and len(index) == 40 < found.count()
    assert all(data[r.offset :].startswith(b"WARC/1.0\r\nWARC-Type: re") for r in index) and sum(r.length for r in index) == len(data)
    assert sorted((r.record_id, r.payload_sha256) for r in index) == sorted((i, hashlib.sha256(p).hexdigest()) for _, i, p in plain_records(data))


def test_a_broken_chain_is_told(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "u", "a" * 50), (2, "u", "b" * 50)], SCHEMA).coalesce(1), f"{tmp_path}/w")
    data = open(glob.glob(f"{tmp_path}/w/part-*")[0], "rb").read()
    for name, kept in (("short", data[:-9]), ("junk", b"junk" + data), ("none", b"no archive")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(kept)
        with pytest.raises(ValueError, match="x.warc"):
            warc.read(spark, f"{tmp_path}/{name}")
    assert [r.record_id for r in warc.read(spark, f"{tmp_path}/short", strict=False).collect()] == ["<urn:x-page:1>", "<urn:x-page:2>"]
    assert warc.read(spark, f"{tmp_path}/junk", strict=False).count() == 0


def test_bytes_that_are_no_text(spark, tmp_path):
    """A resource record of another writer: any bytes, no HTTP header."""
    block = bytes(range(256)) + b"\r\n\r\nWARC/1.0\r\n" + bytes(range(255, -1, -1))
    record = b"WARC/1.0\r\nwarc-type:resource\r\nContent-Type: image/png\r\nWARC-Record-ID: <urn:1>\r\ncontent-length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.warc").write_bytes(record * 2)
    got = warc.read(spark, f"{tmp_path}/w").collect()
    assert [(r.type, r.payload_sha256) for r in got] == [("resource", hashlib.sha256(block).hexdigest())] * 2
    assert {bytes(r.payload) for r in warc.payloads(spark, f"{tmp_path}/w").collect()} == {block}


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, folder):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '/root/testdata/{folder}/pages.parquet'")
    want = con.sql(warc.ORACLE)
    got = QUERIES["op12_warc"](spark, f"/root/testdata/{folder}")
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
