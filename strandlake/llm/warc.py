"""WARC archives: a deterministic writer in shards, and a reader.

Writing:
1. Equal payloads are found by their SHA-256. Of each group the record with the smallest (page_id, url) is the response; the others become revisits of it. Only keys of
   the others travel for that, never payloads.
2. Shards are ranges of the key (page_id, payload's hash, copy). Their borders are quantiles, by bytes, of keys drawn by hash, so they depend on the table alone, not on its
   partitions. Payloads are shuffled once, to their shard, and sorted there; a revisit's mark sorts right before its row.
3. A task streams a shard's records into files, one gzip member a record, and begins the next file when one has `roll` compressed bytes. Headers are made anew: record ids
   and dates are functions of the record and a parameter, digests are computed from the payload, so the same table gives the same bytes.
4. Files are written under temporary names, one folder for each attempt of a task. What successful attempts have written is known from rows that Spark commits; a job then
   moves those files to their names, and the manifest (a Parquet table) is written last. Readers open only what the manifest lists, so lost executors, repeated and speculative
   attempts leave nothing that is read; the temporary folder is deleted at the end.

Files are written and read through pyarrow's file systems (local or mounted folders, hdfs, s3, gs), as Spark has no writer for them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import shared_dir, slices, stage, unstage

#: Compressed bytes after which a file is full; raw bytes of a shard; shards at least (of SMALL bytes each, if there are so many) and at most; keys drawn for each border.
ROLL, SHARD, SMALL, FEWEST, MOST, DRAWN = 256 << 20, 32 << 20, 128 << 10, 64, 4096, 16
LEVEL = 6
#: Date of all records, and of no meaning but that the format wants one.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CHUNK = 1 << 20
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:strandlake:warc")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, repr((page_id, url, digest, copy)))}>"


def _uri(url: str) -> str:
    """The URL with everything that can't stand in a header line as %XX."""
    return re.sub(r"[\x00-\x20\x7F-\U0010FFFF]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def _lines(first: str, fields: list[tuple[str, object]]) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields if v is not None), "\r\n"]).encode()


def record(page_id: int | None, url: str | None, payload: bytes, n_bytes: int, digest: str, copy: int, date: str, of: tuple[int | None, str | None] | None) -> list[bytes]:
    """A record's bytes in parts: a response, or (of: page_id and url of the response) a revisit without payload."""
    http = _lines("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", n_bytes)])
    body = [http] if of else [http, payload]
    block = hashlib.sha1()
    for part in body:
        block.update(part)
    fields = [
        ("WARC-Type", "revisit" if of else "response"), ("WARC-Record-ID", record_id(page_id, url, digest, copy)), ("WARC-Date", date), ("WARC-Target-URI", url and _uri(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base64.b32encode(block.digest()).decode()}"), ("X-Page-Id", page_id),
    ]
    if of:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*of, digest, 0)), ("WARC-Refers-To-Target-URI", of[1] and _uri(of[1])), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-Id", of[0])]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", sum(map(len, body)))]
    return [_lines("WARC/1.0", fields), *body, b"\r\n\r\n"]


def member(parts: list[bytes]) -> Iterator[bytes]:
    """The parts as one gzip member, in pieces; long payloads aren't held twice."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    for part in parts:
        for at in range(0, len(part), CHUNK):
            yield z.compress(memoryview(part)[at : at + CHUNK])
    yield z.flush()


class _Files:
    """Numbered files of one shard under temporary names."""

    def __init__(self, fs, folder: str, shard: int, date: str, roll: int):
        self.fs, self.folder, self.shard, self.date, self.roll = fs, folder, shard, date, roll
        self.part, self.out = 0, None

    def _open(self) -> None:
        name = f"part-{self.shard:05d}-{self.part:05d}.warc.gz"
        self.temporary, self.name, self.n, self.size, self.hash = f"{self.folder}/{name}", name, 0, 0, hashlib.sha256()
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        text = _lines("software: strandlake", [("format", "WARC File Format 1.0")])
        head = _lines("WARC/1.0", [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name, "", 0)), ("WARC-Date", self.date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(text))])
        self._put([head, text, b"\r\n\r\n"])

    def _put(self, parts: list[bytes]) -> None:
        for b in member(parts):
            self.out.write(b)
            self.hash.update(b)
            self.size += len(b)

    def add(self, parts: list[bytes]) -> Iterator[tuple]:
        if self.out is None:
            self._open()
        self._put(parts)
        self.n += 1
        if self.size >= self.roll:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            self.out = None
            self.part += 1
            yield self.temporary, self.name, self.shard, self.n, self.size, self.hash.hexdigest()


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9+]+:", path) else f"file://{path}")


def _keys(pages: DataFrame) -> DataFrame:
    """page_id, url, html, and of the payload: key (SHA-256), bytes, sha1. Null html is empty."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    return rows.withColumns({"key": F.unhex(F.sha2("html", 256)), "bytes": F.octet_length("html").cast("long"), "sha1": F.unhex(F.sha1("html"))})


def _first() -> Column:
    """What orders records of equal payloads; nulls last."""
    return F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")


def sort_key(page_id: pa.Array, key: pa.Array, copy: pa.Array) -> np.ndarray:
    """Bytes that order like (page_id with nulls last, key's first 8 bytes, copy)."""
    if not len(page_id):
        return np.zeros(0, "S21")
    number = page_id.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    parts = [page_id.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)[:, None], (number.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)]
    parts.append(np.frombuffer(b"".join(k[:8] for k in key.to_pylist()), np.uint8).reshape(-1, 8))
    parts.append(copy.to_numpy(zero_copy_only=False).astype(">u4").view(np.uint8).reshape(-1, 4))
    return np.ascontiguousarray(np.concatenate(parts, 1)).view("S21").ravel()


def borders(slim: DataFrame) -> np.ndarray:
    """First keys of all shards but one, from keys drawn by hash: a function of the rows (page_id, key, copy, bytes), whatever their partitions are."""
    n, total = slim.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    shards = min(MOST, max(-(-total // SHARD), min(FEWEST, -(-total // SMALL)), 1))
    share = min(1.0, DRAWN * shards / max(1, n))
    drawn = slim.where(F.pmod(F.xxhash64("page_id", "key", "copy"), F.lit(1 << 24)) < F.lit(int(np.ceil(share * (1 << 24)))))
    rows = drawn.select("page_id", F.substring("key", 1, 8).alias("key"), "copy", "bytes").collect() if shards > 1 else []
    if not rows:
        return np.zeros(0, "S21")
    keys = sort_key(pa.array([r.page_id for r in rows], pa.int64()), pa.array([bytes(r.key) for r in rows], pa.binary()), pa.array([r.copy for r in rows], pa.int64()))
    order = np.argsort(keys, kind="stable")
    ends = np.cumsum(np.array([r.bytes + 1 for r in rows], np.float64)[order])
    return np.unique(keys[order][np.searchsorted(ends, ends[-1] * np.arange(1, shards) / shards)])


def write(pages: DataFrame, folder: str | None = None, roll: int = ROLL, date: str = DATE) -> str:
    """Write a record for each row of pages (page_id, url, html; other columns are not read, whatever their names) and return the archive's folder.

    Null html counts as an empty payload, and equal empty payloads are revisits like any others. A null page_id comes last and is left out of the record, as is a null
    url; URLs are written with %XX for what a header can't hold. Of rows that are equal in all three columns one is copy 0; the others, copies 1, 2, ..., revisit
    whatever is the payload's response. Payloads of any length are one record; a task holds one at a time. An empty table gives an archive without files.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows, same = _keys(pages), ["page_id", "url", "key", "bytes", "sha1"]
    slim = stage(rows.groupBy(*same).agg(F.count("*").alias("n")), "keys")
    each = slim.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")
    # of each payload that several rows have: the first row's (page_id, url); a table of its own, so that Spark can split a very frequent payload in the join
    firsts = stage(slim.groupBy("key").agg(F.min(_first()).alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n"), "firsts")
    if (slim.agg(F.max("n")).first()[0] or 0) > 1:  # equal rows: their payload travels once, its copies as numbers
        rows = rows.groupBy(*same).agg(F.max("html").alias("html"), F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        rows = rows.withColumn("html", F.when(F.col("copy") == 0, F.col("html"))).drop("n")
    else:
        rows = rows.withColumn("copy", F.lit(0).cast("long"))
    later = each.join(firsts, "key").where((_first() != F.col("first")) | (F.col("copy") > 0))
    of = F.struct("first.page_id", "first.url")
    marks = later.select(*same, "copy", F.lit(None).cast("string").alias("html"), of.alias("of"), F.lit(0).alias("kind"))
    both = marks.unionByName(rows.select(*same, "copy", "html", F.lit(None).cast(marks.schema["of"].dataType).alias("of"), F.lit(1).alias("kind")))
    edge = borders(each)

    @F.arrow_udf("int")
    def shard(page_id: pa.Array, key: pa.Array, copy: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edge, sort_key(page_id, key, copy), side="right").astype(np.int32))

    start = F.substring("key", 1, 8)
    dealt = both.withColumn("shard", shard("page_id", start, "copy")).repartitionById(len(edge) + 1, F.col("shard"))
    dealt = dealt.sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), start, "copy", "key", F.col("url").asc_nulls_last(), "kind")

    def run(batches):
        fs, root = _file_system(folder)
        home = f"{root}/_temporary/{uuid.uuid4().hex}"
        fs.create_dir(home)
        files = mark = None
        names = ("shard", "page_id", "url", "key", "copy", "bytes", "sha1", "html", "of", "kind")
        for batch in batches:
            for b in slices(batch, "html"):
                for at, page, url, key, copy, n, sha1, html, of, kind in zip(*(b.column(c).to_pylist() for c in names)):
                    if kind == 0:
                        mark = (page, url, key, copy), (of["page_id"], of["url"])
                        continue
                    if files is None:
                        files = _Files(fs, home, at, date, roll)
                    first = mark[1] if mark is not None and mark[0] == (page, url, key, copy) else None
                    payload, digest = b"", base64.b32encode(sha1).decode()
                    if first is None:
                        payload = html.encode()
                        if base32_sha1(payload) != digest:
                            raise ValueError("a payload changed on its way")
                    yield from map(_told, files.add(record(page, url, payload, n, digest, copy, date, first)))
        if files is not None:
            yield from map(_told, files.close())

    made = stage(dealt.mapInArrow(run, _MADE), "written")
    _commit(made, folder)
    for t in (slim, firsts, made):
        unstage(t)
    return folder


_MADE = "temporary string, name string, shard int, records long, size long, sha256 string"


def _told(row: tuple) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["temporary", "name", "shard", "records", "size", "sha256"])


def _exists(fs, path: str) -> bool:
    from pyarrow.fs import FileType

    return fs.get_file_info(path).type != FileType.NotFound


def _commit(made: DataFrame, folder: str) -> None:
    """Give the files of successful attempts their names, then write the manifest. A repeated move finds the file at its name and leaves it."""

    def run(batches):
        fs, root = _file_system(folder)
        for b in batches:
            for temporary, name in zip(b.column("temporary").to_pylist(), b.column("name").to_pylist()):
                there = f"{root}/{name}"
                try:
                    fs.move(temporary, there)
                except OSError:
                    if not _exists(fs, there):
                        raise
            yield b.select(["name", "shard", "records", "size", "sha256"])

    moved = made.repartition("name").mapInArrow(run, "name string, shard int, records long, size long, sha256 string")
    moved.write.parquet(f"{folder}/manifest")
    fs, root = _file_system(folder)
    if _exists(fs, f"{root}/_temporary"):
        fs.delete_dir(f"{root}/_temporary")


def members(stream, sha256) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, bytes) of each gzip member of a stream; its compressed bytes go to sha256 too."""
    z, at, begun, out = zlib.decompressobj(31), 0, 0, bytearray()
    while raw := stream.read(CHUNK):
        sha256.update(raw)
        while raw:
            out += z.decompress(raw)
            rest = z.unused_data
            at += len(raw) - len(rest)
            raw = rest
            if z.eof:
                yield begun, at - begun, bytes(out)
                z, begun, out = zlib.decompressobj(31), at, bytearray()
    if at != begun:
        raise ValueError("a file ends within a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.partition(": ")[::2] for line in lines)
    n = int(fields.get("Content-Length", -1))
    if not first.startswith("WARC/1.") or n < 0 or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a record")
    return fields, rest[:n]


def checked(fields: dict[str, str], block: bytes) -> tuple[int, str, bytes | None]:
    """Length and digest of a record's full payload, and (of a response) the payload; digests are computed again."""
    if (told := fields.get("WARC-Block-Digest")) and told != f"sha1:{base32_sha1(block)}":
        raise ValueError("a block and its digest differ")
    http, _, payload = block.partition(b"\r\n\r\n")
    n, digest = int(re.search(rb"(?im)^Content-Length: (\d+)", http)[1]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        return n, digest, None
    if len(payload) != n or base32_sha1(payload) != digest:
        raise ValueError("a payload and its digest differ")
    return n, digest, payload


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, file string, offset long, length long"


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """A row for each response and revisit of an archive: page_id, payload_bytes, payload_digest, record_type, refers_to, url (as written), record_id, and where the record is.

    Every file is held against the manifest's hash and count, every block and payload against its digest. payloads: with column payload (null for revisits).
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in _READ.split(", ")] + ["payload"]
    width = len(names) if payloads else len(names) - 1

    def run(batches):
        fs, root = _file_system(folder)

        def told(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:width], kinds)], names=names[:width])

        for b in batches:
            for name, records, sha256 in zip(*(b.column(c).to_pylist() for c in ("name", "records", "sha256"))):
                known, rows, held, seen = hashlib.sha256(), [], 0, 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for offset, length, raw in members(stream, known):
                        fields, block = parse(raw)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        n, digest, payload = checked(fields, block)
                        page, of = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                        rows.append((page and int(page), n, digest, fields["WARC-Type"], of and int(of), fields.get("WARC-Target-URI"), fields["WARC-Record-ID"], name, offset, length, payload if payloads else None))
                        seen, held = seen + 1, held + len(payload or b"") * payloads
                        if len(rows) == 1024 or held > CHUNK:
                            yield told(rows)
                            rows, held = [], 0
                if rows:
                    yield told(rows)
                if known.hexdigest() != sha256 or seen != records:
                    raise ValueError(f"{name} isn't what the manifest lists")

    files = spark.read.parquet(f"{folder}/manifest")
    return files.repartition(max(1, files.count())).mapInArrow(run, _READ + (", payload binary" if payloads else ""))


#: The contract's rows in SQL; base32 is made of five hexadecimal digits at a time.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST, url NULLS LAST) AS k,
  first(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST, url NULLS LAST) AS f FROM pages),
q AS (SELECT *, sha1(h) AS x FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (i // 4 * 5)::INT + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to FROM q
"""
