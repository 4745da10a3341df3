"""Deterministic sharded WARC archives and their reader (operator 7).

Writing.  Pages are put in order of id and payload digest, and their bytes are
added up in that order: a page's shard is the sum before it over ``shard_bytes``
(or over more, where the table would fill more than ``MAX_SHARDS``).  The sums are
those of the whole table, so equal input gives equal files however Spark deals
it out, and shards are even whatever the ids look like.  Only ids, sizes and digests are
sorted for that; the first key of every shard, at most ``MAX_SHARDS`` of them, goes to
all tasks, and each page finds its shard there by halving.  A shard
is a task's, which sorts it and streams it into files that are closed once they hold ``roll_bytes``
compressed.  Headers, record ids and digests are made anew from the rows;
nothing depends on the clock.  A file is written under a temporary name and renamed
when complete, so a task that is lost or run twice leaves either nothing or the
same bytes; only files that the manifest lists (records, ids, size and digest
of each) belong to the archive.

Of records with equal payloads of at least ``revisit_bytes``, that with the
largest id is a response and the others are revisits of it, without a body.  That is
decided on digests alone: a grouped maximum with partial sums, then a join whose
hot side can be split.  Revisit marks travel to the writer beside the pages, so
the pages are shuffled once.

Null html is an empty payload, a null url the name ``urn:page:<id>``.  Rows that
repeat an id are all written; among equal payloads each row with the largest id
is a response.  A row with a null id is a response and sorts first.  Rows with one id and
one payload stay in one shard; those with one id and different payloads may be parted.
Other columns are ignored.  Reading checks every digest and length, the manifest's included.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moderato.llm.common import discard, stage
from moderato.session import scratch_path

SHARD_BYTES = 32 << 20
ROLL_BYTES = 4 << 20
REVISIT_BYTES = 1000
MAX_SHARDS = 1 << 16
READ_BYTES = 32 << 20           # compressed, of a reading task
DATE = "1970-01-01T00:00:00Z"       # the tables hold no capture time
LEVEL = 6
_SPACE = uuid.UUID("8f2a5f5e-55c1-4b7a-9d0e-6d5a3c1b7e42")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = ("shard long, roll int, file string, records long, first_id long, last_id long, "
             "compressed_bytes long, sha256 string")
_RECORD = ("file string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
           "refers_to long, payload binary")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def _uri(url: str | None, page_id: int | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response, or a revisit if ``refers_to`` is given."""
    sha = hashlib.sha1(payload)
    digest, kind = sha.hexdigest(), "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", DATE),
            ("WARC-Target-URI", _uri(url, page_id)), ("Content-Type", "application/http; msgtype=response"),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha.digest()).decode()),
            ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode())]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    head.append(("Content-Length", str(len(body))))
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class _Files:
    """The files of one shard, one after the other."""

    def __init__(self, uri: str, shard: int, roll_bytes: int):
        self.fs, self.base = pafs.FileSystem.from_uri(uri)
        self.shard, self.roll_bytes, self.roll, self.out, self.done = shard, roll_bytes, 0, None, []

    def add(self, page_id, member: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:08d}-{self.roll:05d}.warc.gz"
            self.tmp = f"{self.base}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.tmp, compression=None)
            self.size, self.records, self.first, self.sha = 0, 0, page_id, hashlib.sha256()
        self.out.write(member)
        self.sha.update(member)
        self.size, self.records, self.last = self.size + len(member), self.records + 1, page_id
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.tmp, f"{self.base}/{self.name}")
            self.done.append((self.shard, self.roll, self.name, self.records, self.first, self.last, self.size, self.sha.hexdigest()))
            self.out, self.roll = None, self.roll + 1


def _write(uri: str, roll_bytes: int):
    names = ["shard", "roll", "file", "records", "first_id", "last_id", "compressed_bytes", "sha256"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def rows(done):
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names=names)

    def run(batches):
        files, at, mark = None, None, None
        for batch in batches:
            for shard, page_id, kind, digest, refers, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if files is None or files.shard != shard:
                    if files is not None:
                        files.close()
                        yield rows(files.done)
                    files = _Files(uri, shard, roll_bytes)
                if at != (page_id, digest):
                    at, mark = (page_id, digest), None
                if kind == 0:       # sorts before the pages it is meant for
                    mark = refers
                else:
                    files.add(page_id, record(page_id, url, (html or "").encode(), mark))
        if files is not None:
            files.close()
            yield rows(files.done)
    return run


def _key() -> Column:
    return F.struct(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("id"), "digest")


def _first_keys(facts: DataFrame, shard_bytes: int) -> DataFrame:
    """``key`` of the first row of every shard."""
    ranged = stage(facts.select(_key().alias("key"), "size").repartitionByRange("key").withColumn("part", F.spark_partition_id()), "warc_sizes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # one row a partition
    starts = ranged.groupBy("part").agg(F.sum("size").alias("bytes")).select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    shards = ranged.join(F.broadcast(starts), "part").select("key", F.floor(place / F.lit(shard_bytes)).cast("long").alias("shard"))
    keys = stage(shards.groupBy("shard").agg(F.min("key").alias("key")).select("key").distinct(), "warc_cuts")
    discard(ranged)
    return keys


def _with_shard(rows: DataFrame, keys: DataFrame, count: int) -> DataFrame:
    """``shard``: number of the last of the sorted ``keys`` that isn't above a row's key, found by halving."""
    ordered = keys.agg(F.sort_array(F.collect_list("key"))).scalar()
    out = rows.withColumn("shard", F.lit(0))
    for bit in reversed(range(count.bit_length())):
        ahead = F.col("shard") + (1 << bit)
        out = out.withColumn("shard", F.when((ahead < count) & (F.get(ordered, ahead) <= _key()), ahead).otherwise(F.col("shard")))
    return out


def write_warc(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes the archive below ``uri`` (a folder that all executors share) and
    returns its manifest, which is stored beside it as JSON."""
    fs, base = pafs.FileSystem.from_uri(uri)
    fs.create_dir(f"{base}/_temporary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    payload = F.coalesce(F.col("html"), F.lit(""))
    facts = stage(rows.select("id", F.octet_length(payload).cast("long").alias("size"), F.sha1(payload).alias("digest")), "warc_facts")
    total = facts.agg(F.sum("size")).first()[0] or 0
    keys = _first_keys(facts, max(shard_bytes, -(-total // MAX_SHARDS)))
    count = keys.count()
    keep = (facts.filter(F.col("size") >= revisit_bytes).groupBy("digest")
            .agg(F.max("id").alias("refers"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "refers"))
    marks = facts.join(keep, "digest").filter("id <> refers").select(
        "id", F.lit(0).alias("kind"), "digest", "refers", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    bodies = rows.select("id", F.lit(1).alias("kind"), F.sha1(payload).alias("digest"), F.lit(None).cast("long").alias("refers"), "url", "html")
    dealt = (_with_shard(marks.unionByName(bodies), keys, count)
             .select(F.col("shard").cast("long").alias("shard"), "id", "kind", "digest", "refers", "url", "html")
             .repartitionById(max(1, count), F.col("shard").cast("int"))
             .sortWithinPartitions("shard", "id", "digest", "kind", "url"))
    manifest = dealt.mapInArrow(_write(uri, roll_bytes), _MANIFEST)
    manifest.write.mode("overwrite").json(f"{uri}/manifest")
    return pages.sparkSession.read.schema(_MANIFEST).json(f"{uri}/manifest")


def _members(stream, sha):
    """The gzip members of an open file, one at a time; ``sha`` takes in what is read."""
    z, got = zlib.decompressobj(31), []
    chunk = stream.read(1 << 18)
    sha.update(chunk)
    while chunk:
        got.append(z.decompress(chunk))
        if z.eof:
            yield b"".join(got)
            chunk, z, got = z.unused_data, zlib.decompressobj(31), []
            if chunk:
                continue
        chunk = stream.read(1 << 18)
        sha.update(chunk)
    if any(got):
        raise ValueError("the last record is cut off")


def _headers(raw: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:] if line)


def parse(member: bytes) -> dict:
    """One record; a digest or length that doesn't hold is an error."""
    head, _, rest = member.partition(b"\r\n\r\n")
    h = _headers(head)
    body, end = rest[:int(h["Content-Length"])], rest[int(h["Content-Length"]):]
    if end != b"\r\n\r\n" or h["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode():
        raise ValueError(f"{h['WARC-Record-ID']}: block doesn't match its digest")
    http, _, payload = body.partition(b"\r\n\r\n")
    size, digest = int(_headers(http)["Content-Length"]), base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind, number = h["WARC-Type"], lambda k: int(h[k]) if k in h else None
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{h['WARC-Record-ID']}: payload doesn't match its digest")
    return {"page_id": number("X-Page-Id"), "url": h["WARC-Target-URI"], "record_type": kind, "payload_bytes": size,
            "payload_digest": digest, "refers_to": number("X-Refers-To-Page-Id"), "payload": payload if kind == "response" else None}


def _read(uri: str, with_payload: bool):
    types = [("file", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
             ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in types], names=[k for k, _ in types])

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(uri)
        for b in batches:
            for name, size, sha256 in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if fs.get_file_info(f"{base}/{name}").size != size:
                    raise ValueError(f"{name}: size differs from the manifest's")
                rows, held, sha = [], 0, hashlib.sha256()
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for member in _members(f, sha):
                        r = parse(member) | {"file": name}
                        held += len(r["payload"] or b"") if with_payload else 0
                        rows.append(r if with_payload else r | {"payload": None})
                        if len(rows) >= 2000 or held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if sha.hexdigest() != sha256:
                    raise ValueError(f"{name}: content differs from the manifest's digest")
                yield batch(rows)
    return run


def read_warc(manifest: DataFrame, uri: str, with_payload: bool = True) -> DataFrame:
    """The records of the manifest's files; a task reads whole files, a record at a time.  Files, of about one
    size, are dealt in turn to as many tasks as their bytes ask for, to all cores at least."""
    n, size, rolls = manifest.agg(F.count(F.lit(1)), F.sum("compressed_bytes"), F.max("roll")).first()
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(n, max(cores, -(-(size or 0) // READ_BYTES))))
    turn = F.pmod(F.col("shard") * ((rolls or 0) + 1) + F.col("roll"), F.lit(tasks)).cast("int")
    files = manifest.repartitionById(tasks, turn).select("file", "compressed_bytes", "sha256")
    return files.mapInArrow(_read(uri, with_payload), _RECORD)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all ``pages`` into an archive, reads it back and returns per page
    ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    base = scratch_path(spark, "warc")
    uri = base if "://" in base else "file://" + base.removeprefix("file:")
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), uri)
    return read_warc(manifest, uri, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
k AS (SELECT h, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY h)
SELECT p.page_id, p.payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN k.keeper <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k.keeper <> p.page_id THEN k.keeper END AS refers_to
FROM p LEFT JOIN k ON k.h = p.h
"""
