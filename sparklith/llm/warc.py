"""Deterministic sharded WARC writer and a reader that gets every page back.

Records are range-sorted by page_id. Sizes and digests of the payloads are written as a narrow table first. The shard
bounds come from a histogram of its bytes over id ranges, not from a sample, so the same table always gives the same
files; an id, or the null id, that alone is heavier than a shard has several, dealt by digest. Each task streams its shard into gzip members (one a
record), rolls to a new file when a file's compressed size is reached, writes under a temporary name of its own
attempt and renames when the file is whole. The manifest, a table of the committed files, is written last; a reader
goes by the manifest alone, so files of lost attempts are never seen; it raises where a file is not what the manifest says.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Workspace, filesystem

#: Payloads of fewer bytes are never made revisits.
LEAST_REVISIT = 100
#: Payload bytes of a shard: this share of all, at least and at most so many.
SHARDS, LEAST_SHARD, MOST_SHARD = 64, 4 << 20, 4 << 30
#: A file is closed when its compressed bytes reach this share of its shard's payload bytes, so that a shard is several files.
FILES = 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long, digest string, first_page long, last_page long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, payload_ok boolean"
#: Bits of an id that the first histogram tells apart, and each further one.
FIRST_BITS, MORE_BITS = 12, 4


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


@dataclass
class Bounds:
    """Shards: ``parts[0]`` for null ids, then ``parts[i]`` from the id ``starts[i - 1]`` on."""

    starts: np.ndarray
    parts: np.ndarray

    def shard(self, page_id: np.ndarray, null: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The shard of each row; ``key``: 16 bits of the digest, which count where an id has several shards."""
        at = np.where(null, 0, np.maximum(np.searchsorted(self.starts, page_id, "right"), 1))
        return np.concatenate([[0], np.cumsum(self.parts)])[at] + (key * self.parts[at] >> 16)


def shard_bounds(light: DataFrame, want: int) -> Bounds:
    """Bounds from exact histograms of bytes over id ranges of ``light`` (page_id, size), for shards of about ``want`` bytes.

    A range heavier than two shards is divided again, until it holds one id; one job counts all such ranges at once.
    What comes to the driver is 4096 numbers, then 16 for each heavy range: 8 for each shard at most.
    """
    code = F.col("page_id").bitwiseXOR(F.lit(-(1 << 63)))  # as an unsigned number it has the order of the ids
    low, high, empty = light.agg(F.min("page_id"), F.max("page_id"), F.sum(F.when(F.col("page_id").isNull(), F.col("size")))).first()
    parts, starts, cells = [-(-empty // want) if empty else 1], [], {}
    if low is not None:
        bits = (low ^ high).bit_length() if (low < 0) == (high < 0) else 64
        ids, shift = light.where("page_id is not null"), max(0, bits - FIRST_BITS)
        rows = ids
        while True:
            got = rows.groupBy(F.shiftrightunsigned(code, shift).alias("cell")).agg(F.sum("size").alias("n")).collect()
            heavy = [(r["cell"],) for r in got if r["n"] > 2 * want and shift]
            cells |= {((r["cell"] << shift) + (1 << 63)) % (1 << 64): (r["n"], shift) for r in got if r["n"] <= 2 * want or not shift}
            if not heavy:
                break
            parent = F.shiftrightunsigned(code, shift)
            rows = ids.join(light.sparkSession.createDataFrame(heavy, "heavy long"), parent == F.col("heavy"), "left_semi")
            shift = max(0, shift - MORE_BITS)
    held = want + 1
    signed = {(start if start < 1 << 63 else start - (1 << 64)): x for start, x in cells.items()}
    for start, (n, shift) in sorted(signed.items()):
        if held + n > want:
            starts.append(start)
            parts.append(1)
            held = 0
        held += n
        if not shift and n > want:
            parts[-1] = -(-n // want)
            held = want + 1  # the next id begins a shard of its own
    return Bounds(np.array(starts, np.int64), np.array(parts, np.int64))


def decisions(light: DataFrame, work: Workspace, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, d, refers_to`` of the payloads, by digest, that also stand under a smaller page_id; no payload is shuffled.

    Payloads are compared by SHA-256. Each digest's smallest id comes from a partly aggregated group, and only digests
    with several ids go into the join. They are written first, so that Spark can split the join of a very common one.
    """
    light = light.where(F.col("size") >= least).select("page_id", "d")
    lead = light.groupBy("d").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    return light.join(work.table(lead, "lead"), "d").where("page_id > refers_to").select("page_id", "d", "refers_to").distinct()


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def render(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """One record as a gzip member, with headers and digests made from the payload itself."""
    sha = hashlib.sha256(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    # The null id sorts first; a url is escaped so that it cannot break the header.
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page_id}"
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha256:{sha}"),
        ("WARC-Block-Digest", "sha1:" + b32encode(hashlib.sha1(block).digest()).decode()),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to)), ("X-Payload-Length", str(len(payload)))]
    return _member(headers, block, level)


class _Files:
    """The files of one shard: rolled by compressed size, renamed when whole."""

    def __init__(self, folder: str, shard: int, roll: int):
        from pyspark import TaskContext

        self.fs, self.folder = filesystem(folder)
        self.shard, self.roll, self.number, self.out = shard, roll, 0, None
        self.attempt = TaskContext.get().taskAttemptId()

    def add(self, member: bytes, page_id: int | None) -> Iterator[tuple]:
        if self.out is not None and self.size + len(member) > self.roll:
            yield self.close()
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.number += 1
            self.fs.create_dir(self.folder, recursive=True)
            self.temporary = f"{self.folder}/.{self.name}.{self.attempt}.tmp"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.size, self.records, self.first, self.sha = 0, 0, page_id, hashlib.sha256()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        self.last = page_id

    def close(self) -> tuple:
        self.out.close()
        self.out = None
        self.fs.move(self.temporary, f"{self.folder}/{self.name}")
        return self.name, self.records, self.size, self.sha.hexdigest(), self.first, self.last


def write(spark: SparkSession, pages: DataFrame, folder: str, least: int = LEAST_REVISIT, roll: int | None = None, shard_bytes: int | None = None, level: int = 6) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``folder`` and return the committed manifest.

    Null html: an empty payload. Null page_id: a record without the id, in the first shards. Null url: a target made
    from the id. Rows that repeat an id get a record each; rows with the smallest id of their payload are all responses.
    An empty table gives an empty manifest. Other columns are not read. ``shard_bytes``: payload bytes of a shard, about;
    ``roll``: compressed bytes of a file at most, but of one record.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digest, work = F.unhex(F.sha2("html", 256)), Workspace(spark, "warc-plan")
    light = work.table(rows.select("page_id", F.octet_length("html").cast("long").alias("size"), digest.alias("d")), "light")
    weighed = light.withColumn("size", F.col("size") + 512)
    want = shard_bytes or min(max((weighed.agg(F.sum("size")).first()[0] or 0) // SHARDS, LEAST_SHARD), MOST_SHARD)
    bounds = shard_bounds(weighed, want)
    roll = roll or want // FILES

    @F.pandas_udf("int")
    def shard_of(page_id, key):  # noqa: ANN001, ANN202
        import pandas as pd

        null = page_id.isna().to_numpy()
        return pd.Series(bounds.shard(page_id.fillna(0).to_numpy().astype("int64"), null, key.to_numpy()).astype("int32"))

    # A decision travels to its page's shard and sorts right before the page: payloads are shuffled once.
    told = decisions(light, work, least).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "d", "refers_to", F.lit(0).alias("kind"))
    own = digest if bounds.parts.max() > 1 else F.lit(None).cast("binary")  # a digest matters where it deals an id
    both = rows.select("page_id", "url", "html", own.alias("d"), F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("kind")).unionAll(told)
    key = F.coalesce(F.conv(F.hex(F.substring("d", 1, 2)), 16, 10).cast("int"), F.lit(0)) if bounds.parts.max() > 1 else F.lit(0)
    dealt = both.withColumn("shard", shard_of("page_id", key)).repartitionById(int(bounds.parts.sum()), F.col("shard"))
    order = dealt.sortWithinPartitions("page_id", "kind", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, told_id, told_to, done = None, None, {}, []
        for batch in batches:
            for page_id, url, html, digest, refers_to, kind, shard in zip(*(x.to_pylist() for x in batch.columns)):
                if kind == 0:
                    if page_id != told_id:
                        told_id, told_to = page_id, {}
                    told_to[digest] = refers_to
                    continue
                files = files or _Files(folder, shard, roll)
                payload = html.encode("utf-8", "surrogatepass")
                # Of rows that share an id, each goes by its own payload's decision.
                to = told_to.get(hashlib.sha256(payload).digest()) if page_id is not None and page_id == told_id else None
                done += files.add(render(page_id, url, payload, to, level), page_id)
        if files and files.out is not None:
            done.append(files.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes", "digest", "first_page", "last_page"])

    path = f"{folder}/_manifest"
    order.select("page_id", "url", "html", "d", "refers_to", "kind", "shard").mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(path)
    work.drop()
    return spark.read.schema(MANIFEST).parquet(path)


def members(stream) -> Iterator[bytes]:  # noqa: ANN001
    """The decompressed gzip members of a stream, one at a time."""
    unpack, parts, raw = zlib.decompressobj(31), [], b""
    while raw or (raw := stream.read(1 << 20)):
        parts.append(unpack.decompress(raw))
        raw = b""
        if unpack.eof:
            yield b"".join(parts)
            raw, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("an archive ends within a record")


def parse(member: bytes) -> tuple:
    """A record's row in the order of ``READ``; digests are made anew from what was read."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != "sha1:" + b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda k: int(fields[k]) if k in fields else None
    stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "revisit":
        return number("X-Page-Id"), number("X-Payload-Length"), stated, "revisit", number("X-Refers-To-Page"), fields["WARC-Target-URI"], None, True
    sha = hashlib.sha256(payload).hexdigest()
    if sha != stated:
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    return number("X-Page-Id"), len(payload), sha, "response", None, fields["WARC-Target-URI"], payload, True


class _Hashed:
    """A stream that knows the digest and the length of what was read from it."""

    def __init__(self, stream):  # noqa: ANN001
        self.stream, self.sha, self.size = stream, hashlib.sha256(), 0

    def read(self, n: int) -> bytes:
        part = self.stream.read(n)
        self.sha.update(part)
        self.size += len(part)
        return part


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the files that the manifest names, streamed file by file.

    Raises where a file is missing, its bytes, digest or number of records are not those of the manifest, or a record's
    block or payload has another digest than its header says.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    tasks = spark.sparkContext.defaultParallelism * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_())
        names = [x.split(" ")[0] for x in READ.split(", ")]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        for batch in batches:
            for name, records, length, digest in zip(*(x.to_pylist() for x in batch.columns)):
                rows, size, seen = [], 0, 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    stream = _Hashed(stream)
                    for member in members(stream):
                        rows.append(parse(member))
                        size += len(member)
                        seen += 1
                        if size > 4 << 20:
                            yield flush(rows)
                            rows, size = [], 0
                if (seen, stream.size, stream.sha.hexdigest()) != (records, length, digest):
                    raise ValueError(f"{name} is not the file that the manifest names")
                yield flush(rows)

    return manifest.select("file", "records", "bytes", "digest").repartition(tasks, "file").mapInArrow(run, READ)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC and read back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    folder = Workspace(spark, "warc").path
    write(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
d as (select page_id, octet_length(body) as payload_bytes, sha256(body) as payload_digest from p),
f as (select payload_digest, min(page_id) as lead from d where payload_bytes >= 100 group by 1)
select d.page_id, cast(d.payload_bytes as bigint) as payload_bytes, d.payload_digest,
  case when d.payload_bytes >= 100 and d.page_id > f.lead then 'revisit' else 'response' end as record_type,
  case when d.payload_bytes >= 100 and d.page_id > f.lead then f.lead end as refers_to
from d left join f on f.payload_digest = d.payload_digest
"""
