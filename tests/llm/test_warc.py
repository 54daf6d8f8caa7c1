"""WARC archives: the SQL's rows, the same bytes from any partitions, files an own reader understands, commits, odd rows."""

import gzip
import os

import duckdb
import pandas as pd
import pytest

from strandlake.llm import warc
from strandlake.llm.common import stage, table

COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
SCHEMA = "page_id long, url string, html string, Key string"
ODD = [
    (3, "http://a/ü x\r\ny", "one", "k"), (1, None, "one", "k"), (2, "", "one", "k"), (1, None, "one", "k"), (1, None, "one", "k"), (5, "http://b", None, "k"), (4, "http://b", "", "k"), (None, "u", "one", "k"),
    (None, None, "alone", "k"), (7, "u", "\r\n\r\nWARC/1.0\r\n\x00", None), (8, "u", "é" * 2_000_000, "k"), (-9, "v", "two", "k"), (6, "w", "two", "k"), (6, "v", "two", "k"), (6, "v", "two", "k"),
]


def clean(rows):
    return sorted((tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r) for r in rows), key=repr)


def files(folder):
    return {f: open(f"{folder}/{f}", "rb").read() for f in sorted(os.listdir(folder)) if f.endswith(".gz")}


def expected(rows):
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html", "Key"]).astype({"page_id": "Int64"}))
    return clean(con.sql(warc.ORACLE.replace("FROM p)", "FROM p)")).df()[COLUMNS].itertuples(index=False))


def test_odd_rows_equal_sql_and_bytes_are_the_same_again(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    one, two = warc.write(df, roll=2000), warc.write(df.repartition(6), roll=2000)
    got = warc.read(spark, one, payloads=True).collect()
    assert clean([tuple(r[c] for c in COLUMNS) for r in got]) == expected(ODD)
    assert files(one) == files(two) and not os.path.exists(f"{one}/_temporary")
    assert {r.payload.decode() for r in got if r.payload is not None} == {"one", "", "alone", "\r\n\r\nWARC/1.0\r\n\x00", "é" * 2_000_000, "two"}
    ids = {r.record_id: r for r in got}
    assert len(ids) == len(got) and all(r.url is None or "\n" not in r.url for r in got)


def test_files_roll_and_are_plain_warc(spark, sf_dir):
    folder = warc.write(table(spark, sf_dir, "pages"), roll=4000)
    listed = spark.read.parquet(f"{folder}/manifest").collect()
    made = files(folder)
    assert sorted(r.name for r in listed) == sorted(made) and len(made) > 10
    for r in listed:
        text = gzip.decompress(made[r.name])
        assert r.size == len(made[r.name]) and text.count(b"\r\nWARC-Record-ID: ") == r.records + 1 and text.startswith(b"WARC/1.0\r\nWARC-Type: warcinfo")
    for r in warc.read(spark, folder).limit(5).collect():
        raw = gzip.decompress(made[r.file][r.offset : r.offset + r.length])
        fields, block = warc.parse(raw)
        assert fields["X-Page-Id"] == str(r.page_id) and warc.base32_sha1(block) == fields["WARC-Block-Digest"][5:]


def test_shards_are_the_same_and_all_are_used(spark, monkeypatch):
    monkeypatch.setattr(warc, "SMALL", 1000)
    df = spark.createDataFrame([(i, None, f"page {i % 50} " * (1 + i % 7), "k") for i in range(2000)], SCHEMA)
    folder = warc.write(df)
    shards = spark.read.parquet(f"{folder}/manifest").orderBy("name").collect()
    assert 20 < len(shards) <= 64 and max(r.records for r in shards) < 4 * 2000 / len(shards)
    ids = [r.page_id for r in warc.read(spark, folder).orderBy("file", "offset").select("page_id").collect()]
    assert ids == sorted(ids)


def test_repeated_moves_and_what_is_not_listed(spark):
    folder = warc.write(spark.createDataFrame(ODD[:4], SCHEMA))
    made = spark.read.parquet(f"{folder}/manifest").selectExpr(f"'{folder.removeprefix('file://')}/_temporary/x/' || name AS temporary", "*")
    again = stage(made, "made")
    os.rename(f"{folder}/manifest", f"{folder}/old")
    warc._commit(again, folder)  # the files are at their names already
    assert warc.read(spark, folder).count() == 4
    with open(f"{folder}/part-99999-00000.warc.gz", "wb") as f:
        f.write(b"of a lost attempt")
    assert warc.read(spark, folder).count() == 4
    name = spark.read.parquet(f"{folder}/manifest").first().name
    with open(f"{folder}/{name}", "ab") as f:
        f.write(gzip.compress(b"more"))
    with pytest.raises(Exception, match="not a record|isn't what"):
        warc.read(spark, folder).collect()


def test_empty_table(spark):
    folder = warc.write(spark.createDataFrame([], SCHEMA))
    assert warc.read(spark, folder).count() == 0 and files(folder) == {}
