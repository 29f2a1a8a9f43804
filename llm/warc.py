"""Deterministic sharded WARC archives.

Records are range-sorted by page id, payload and url into shards of a given
number of rows, whose bounds come from exact running counts (so the same table
always gives the same shards, whatever its ids).  Each task
writes its shards' files in order, one gzip member per record, rolls a file
when its compressed size passes ``roll_bytes``, writes under a temporary
name and renames when complete; a rerun of a task writes the same bytes to
the same names.  The manifest (a table) is written last and lists the files
that count; readers open only those.

Equal payloads (by SHA-1) of at least ``min_revisit_bytes`` are written
once; the others become ``revisit`` records that refer to the first.  The
table of first records joins the records in the same sort as marker rows, so
payloads are shuffled once.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import new_folder, small_batches, stored
from revlens.functions.ordered import running

#: Fixed values of the record format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Most shards: their first keys (about 40 bytes each) go to every task.
MAX_SHARDS = 1 << 18
FIRST = -(1 << 63)
FIXED_DATE = "1970-01-01T00:00:00Z"

MANIFEST = ("file string, shard int, part int, records long, bytes long, sha256 string")


def _fs(uri: str):
    """(filesystem, path) of a folder URI: local mount, HDFS or object store."""
    import pyarrow.fs as pafs
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return pafs.FileSystem.from_uri(uri)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def _clean(v: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n\x00]+", " ", v)


def record(page_id, url, payload: bytes, digest: str, seq: int, refers=None, refers_set: bool = False,
           date: str = FIXED_DATE) -> bytes:
    """One WARC record.  The id is derived from page id, url, digest and the
    row's place among equal rows, so reruns give the same record."""
    uid = hashlib.sha1(f"{page_id}\0{url}\0{digest}\0{seq}".encode("utf-8", "surrogatepass")).hexdigest()
    head = [VERSION, f"WARC-Type: {'revisit' if refers_set else 'response'}",
            f"WARC-Record-ID: <urn:uuid:{uid[:8]}-{uid[8:12]}-{uid[12:16]}-{uid[16:20]}-{uid[20:32]}>",
            f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    body = b"" if refers_set else payload
    head.append(f"WARC-Block-Digest: sha1:{base32_sha1(body) if refers_set else digest}")
    if refers_set:
        head.append(f"WARC-Profile: {REVISIT_PROFILE}")
        if refers is not None:
            head.append(f"X-Refers-To-Page-ID: {refers}")
        head.append(f"X-Payload-Length: {len(payload)}")
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


class _Roll:
    """Files of one shard, rolled by compressed size."""

    def __init__(self, folder: str, shard: int, roll_bytes: int, attempt: int):
        self.fs, self.base = _fs(folder)
        self.shard, self.roll, self.attempt, self.part, self.out = shard, roll_bytes, attempt, 0, None

    def _name(self) -> str:
        return f"shard-{self.shard:06d}-{self.part:05d}.warc.gz"

    def add(self, data: bytes) -> dict | None:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)  # gzip member without time stamp
        member = z.compress(data) + z.flush()
        if self.out is None:
            self.tmp = posixpath.join(self.base, "_temporary", f"{self._name()}.{self.attempt}")
            self.out, self.bytes, self.records, self.sha = self.fs.open_output_stream(self.tmp, compression=None), 0, 0, hashlib.sha256()
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1
        return self.close() if self.bytes >= self.roll else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        name = self._name()
        self.fs.move(self.tmp, posixpath.join(self.base, name))
        row = {"file": name, "shard": self.shard, "part": self.part, "records": self.records,
               "bytes": self.bytes, "sha256": self.sha.hexdigest()}
        self.out, self.part = None, self.part + 1
        return row


def _bounds(keys: DataFrame, shard_rows: int) -> DataFrame:
    """The first key of each shard: (shard, page_id, digest, u, before = rows of
    the same page_id and digest in earlier shards).  Shards hold ``shard_rows``
    rows in the order of (page_id, digest, u), exactly but for rows equal in
    all three, which stay together; with more than MAX_SHARDS of them, more."""
    order = ["page_id", "digest", "u"]
    groups = stored(keys.groupBy(*order).agg(F.count(F.lit(1)).alias("c")), "warc-groups")
    total = groups.agg(F.sum("c")).first()[0] or 0
    per = max(shard_rows, -(-total // MAX_SHARDS))
    at = running(groups, order, {"start": F.col("c")}).withColumn("shard", F.floor(F.col("start") / per).cast("long"))
    at = stored(at, "warc-order")
    first = at.groupBy("shard").agg(F.min(F.struct("start", *order)).alias("f")).select("shard", "f.*")
    begun = at.alias("a").join(first.select("page_id", "digest").distinct().alias("b"),
                               F.expr("a.page_id <=> b.page_id and a.digest = b.digest"), "left_semi").groupBy("page_id", "digest").agg(F.min("start").alias("begin"))
    same = first["page_id"].eqNullSafe(begun["page_id"]) & (first["digest"] == begun["digest"])
    return stored(first.join(begun, same).select("shard", first["page_id"], first["digest"], "u", (F.col("start") - F.col("begin")).alias("before")), "warc-bounds")


def _packed(page_id: pd.Series, digest: pd.Series, u: pd.Series) -> np.ndarray:
    """Keys as bytes that compare like (page_id with null first, digest, u)."""
    n = len(digest)
    out = np.empty((n, 38), np.uint8)
    out[:, 0] = page_id.notna()
    big = lambda x: (x ^ np.int64(FIRST)).astype(">i8").view(np.uint8).reshape(n, 8)
    out[:, 1:9] = big(np.array([0 if pd.isna(x) else int(x) for x in page_id], np.int64))
    out[:, 9:29] = np.frombuffer(b"".join(bytes.fromhex(x) for x in digest), np.uint8).reshape(n, 20)
    out[:, 29:37] = big(u.to_numpy(np.int64))
    out[:, 37] = 1  # trailing zeros would not count
    return out.view("S38").ravel()


def _write_partition(folder: str, roll_bytes: int, min_revisit_bytes: int, begun):
    """``begun``: shard -> (key, rows of it in earlier shards), where it goes on with a key."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = TaskContext.get().taskAttemptId()
        roll, done = None, []
        mark = refers = last = None
        seq = 0
        for df in batches:
            for pid, digest, kind, first, url, html, shard in zip(
                    df["page_id"], df["digest"], df["kind"], df["first"], df["url"], df["html"], df["shard"], strict=True):
                pid = None if pd.isna(pid) else int(pid)
                if kind == 0:
                    mark, refers = (pid, digest), None if pd.isna(first) else int(first)
                    continue
                if roll is None or roll.shard != shard:
                    done.append(roll.close() if roll else None)
                    roll = _Roll(folder, int(shard), roll_bytes, attempt)
                    last, seq = begun.value.get(int(shard), (None, 0))
                    seq -= 1
                key = (pid, digest)
                seq = seq + 1 if key == last else 0
                payload = html.encode("utf-8", "surrogatepass")
                name = base64.b32encode(bytes.fromhex(digest)).decode("ascii")
                if mark == key:
                    again, to = True, refers
                else:  # a repeat of the response's own row
                    again, to = seq > 0 and len(payload) >= min_revisit_bytes, pid
                last = key
                done.append(roll.add(record(pid, url, payload, name, seq, to, again)))
            done = [x for x in done if x]
            if done:
                yield pd.DataFrame(done)
                done = []
        if roll and (x := roll.close()):
            yield pd.DataFrame([x])
    return run


def write(pages: DataFrame, folder: str | None = None, shard_rows: int = 2_000, roll_bytes: int = 64 << 20,
          min_revisit_bytes: int = 0) -> tuple[str, DataFrame]:
    """Write ``page_id, url, html`` as archives; returns (folder, manifest).

    Null html is an empty payload.  A null page id or url leaves its header
    out; rows of null page id sort first.  Among equal payloads the smallest
    page id (nulls last) is the response; of repeated rows with that id the
    first by hash of the url.  A page id of many rows goes over several shards.  An empty table gives an empty manifest.  Other columns are
    not read."""
    spark = pages.sparkSession
    small_batches(spark, 256)
    folder = folder or new_folder(spark, "warc")
    fs, base = _fs(folder)
    fs.create_dir(posixpath.join(base, "_temporary"), recursive=True)
    src = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    digest = F.sha1(F.col("html").cast("binary")).alias("digest")  # hex; base32 in the writer
    u = F.xxhash64("url").alias("u")
    keys = stored(src.select("page_id", digest, u, F.octet_length("html").cast("long").alias("bytes")), "warc-keys")
    bounds = _bounds(keys.select("page_id", "digest", "u"), shard_rows)
    big = keys.where(F.col("bytes") >= min_revisit_bytes)
    # the first page of each repeated payload, counted with map-side combine;
    # all its other pages get a marker row that sorts before their record, and
    # one in each shard that begins with them
    first = stored(big.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                   .where("n > 1").drop("n"), "warc-first")
    marks = (big.join(first, "digest").where("not page_id <=> first")
             .select("page_id", "digest", F.lit(FIRST).alias("u"), "first").distinct()
             .unionByName(bounds.join(first, "digest").where("not page_id <=> first").select("page_id", "digest", "u", "first")))
    none = F.lit(None).cast("string")
    rows = (marks.select("page_id", "digest", "u", F.lit(0).alias("kind"), "first", none.alias("url"), none.alias("html"))
            .unionByName(src.select("page_id", digest, u, F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first"), "url", "html")))
    table = bounds.toPandas().sort_values("shard")  # at most MAX_SHARDS rows
    cuts = spark.sparkContext.broadcast(_packed(table["page_id"], table["digest"], table["u"]))
    goes_on = table[table["before"] > 0]
    begun = spark.sparkContext.broadcast({int(s): ((None if pd.isna(p) else int(p), d), int(n)) for s, p, d, n in zip(
        goes_on["shard"], goes_on["page_id"], goes_on["digest"], goes_on["before"], strict=True)})
    numbers = spark.sparkContext.broadcast(table["shard"].to_numpy(np.int64))

    @F.pandas_udf("long")
    def shard_of(page_id: pd.Series, digest: pd.Series, u: pd.Series) -> pd.Series:
        if not len(digest) or not len(cuts.value):
            return pd.Series(np.zeros(len(digest), np.int64))
        at = np.searchsorted(cuts.value, _packed(page_id, digest, u), side="right") - 1
        return pd.Series(numbers.value[np.maximum(at, 0)])

    # range partitioning on the shard alone: a shard is never split over tasks
    rows = (rows.withColumn("shard", shard_of("page_id", "digest", "u"))
            .repartitionByRange(max(1, len(table)), "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "u", "url"))
    manifest = stored(rows.mapInPandas(_write_partition(folder, roll_bytes, min_revisit_bytes, begun), MANIFEST), "warc-manifest")
    return folder, manifest


def _members(stream) -> Iterator[bytes]:
    """Decompressed gzip members of a stream, one at a time."""
    z, parts, data = zlib.decompressobj(31), [], stream.read(1 << 20)
    while data:
        parts.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
        data = data or stream.read(1 << 20)
    if parts:
        raise ValueError("archive ends inside a record")


RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
           "payload_digest string, payload binary, file string")


def read_back(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Rows of the records in the files that the manifest lists.  Digests of
    responses are computed from the payload read and compared with the
    header; a difference, or a file that ends early, is an error."""
    spark = manifest.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _fs(folder)
        for df in batches:
            for name, records in zip(df["file"], df["records"], strict=True):
                out, seen = [], 0
                with fs.open_input_stream(posixpath.join(base, name), compression=None) as f:
                    for m in _members(f):
                        head, _, body = m.partition(b"\r\n\r\n")
                        h = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
                        body = body[:int(h["Content-Length"])]
                        again = h["WARC-Type"] == "revisit"
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not again and base32_sha1(body) != digest:
                            raise ValueError(f"{name}: payload differs from its digest")
                        seen += 1
                        out.append((h.get("X-Page-ID"), h.get("WARC-Target-URI"), h["WARC-Type"], h.get("X-Refers-To-Page-ID"),
                                    int(h["X-Payload-Length"]) if again else len(body), digest,
                                    body if with_payload and not again else None, name))
                        if len(out) >= 1000:
                            yield _frame(out)
                            out = []
                if seen != records:
                    raise ValueError(f"{name}: {seen} records, manifest has {records}")
                if out:
                    yield _frame(out)

    files = manifest.select("file", "records")
    n = max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism))
    return files.repartition(n).mapInPandas(run, RECORDS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
    for c in ("page_id", "refers_to"):
        df[c] = pd.array([None if x is None else int(x) for x in df[c]], dtype="Int64")
    return df


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write the archives, read them back: one row per page."""
    folder, manifest = write(pages, **options)
    return read_back(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                                              "url", "file")


_FIVE_BITS = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(({n} >> {k}) & 31 AS INTEGER) + 1, 1)"
_BASE32 = ("array_to_string(list_transform(range(0, 8), lambda i: " + " || ".join(
    _FIVE_BITS.format(n="cast('0x' || substr({hex}, 5 * i + 1, 5) AS BIGINT)", k=k) for k in (15, 10, 5, 0)) + "), '')")

#: DuckDB SQL of ``op9_warc``: five hex digits are four letters of base 32.
ARCHIVE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, cast(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS x FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM d)
SELECT page_id, payload_bytes, {_BASE32.format(hex="x")} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
