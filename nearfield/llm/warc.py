"""A deterministic sharded WARC writer, and its reader.

Records are sorted by (page_id, digest, URL) over the whole table and cut into shards of about equal bytes: a prefix sum of
payload sizes in that order tells where each shard begins, so the layout depends on the data alone, not on partitions or
cores. A shard is one partition, sorted, whose file is closed when its compressed size passes a limit. Each record is a
gzip member of its own with headers and digests made anew. A file is written under a temporary name that is new in each
attempt, and takes its own name when it is complete; an attempt that finds the file there leaves it, as it holds the same
bytes. The manifest lists the files, and only files it lists are read.

Of records with equal payloads the one with the smallest page_id is written as response and the others as revisits: the
digests are grouped without the payloads, and each revisit's reference travels in the payloads' own shuffle as a small
row that sorts just before its page. The payloads are shuffled once.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm import common as C

#: Payload bytes a shard, about, until there are so many shards; their bounds are sent to the tasks, some 100 bytes each.
SHARD_BYTES, MOST_SHARDS = 8 << 20, 1 << 16
#: Compressed bytes at which a file is closed.
ROLL_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, shard long, seq long, n_records long, n_bytes long, sha256 string"
RECORDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha: str, url: str | None, again: int) -> str:
    """Name of a record; ``again`` counts rows equal in id, payload and URL."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {sha} {again} {url}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int, str | None] | None, again: int = 0) -> bytes:
    """One uncompressed WARC/1.1 record. A revisit, which refers to a page by id and URL, holds the HTTP header only."""
    sha, revisit = digest(payload), refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, sha, url, again)}",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        clean = url.replace("\r", "%0D").replace("\n", "%0A")
        head.append(f"WARC-Target-URI: {clean}")
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to[0], sha, refers_to[1], 0)}", f"Refers-To-Page-ID: {refers_to[0]}"]
    head += [f"WARC-Block-Digest: sha1:{digest(block)}", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def members(data: bytes, step: int = 1 << 15) -> Iterator[bytes]:
    """The content of each gzip member; no more than ``step`` bytes are looked at twice."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            piece = view[at : at + step]
            if not len(piece):
                raise ValueError("a gzip member is cut off")
            out.append(z.decompress(piece))
            at += len(piece)
        at -= len(z.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file of gzip members; digests and lengths are checked."""
    for raw in members(data):
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        if f"sha1:{digest(block)}" != fields["WARC-Block-Digest"]:
            raise ValueError(f"block digest of {fields['WARC-Record-ID']} does not match")
        yield fields, block


class Writer:
    """One file of a shard."""

    def __init__(self, fs, folder: str, shard: int, seq: int) -> None:
        self.fs, self.shard, self.seq = fs, shard, seq
        self.final, self.temp = f"{folder}/shard-{shard:06d}-{seq:04d}.warc.gz", f"{folder}/.{uuid.uuid4().hex}.tmp"
        self.out, self.n, self.size, self.sha = fs.open_output_stream(self.temp), 0, 0, hashlib.sha256()

    def add(self, raw: bytes) -> None:
        member = gzip_member(raw)
        self.out.write(member)
        self.sha.update(member)
        self.n, self.size = self.n + 1, self.size + len(member)

    def close(self) -> dict:
        self.out.close()
        C.commit(self.fs, self.temp, self.final)
        return {"path": self.final, "shard": self.shard, "seq": self.seq, "n_records": self.n, "n_bytes": self.size, "sha256": self.sha.hexdigest()}


def _order() -> list[Column]:
    return [F.col("page_id").asc_nulls_first(), F.col("sha"), F.col("place")]


def _bounds(light: DataFrame, shard_bytes: int) -> list[dict]:
    """The last (page_id, sha, place) of all shards but the last one.

    The rows are range-sorted, and the bytes before a row are those of the partitions before its own and of the rows before
    it in there. Where Spark puts the partitions' borders makes no difference to the sums.
    """
    row_bytes = F.col("n_bytes") + 512  # headers
    total = light.agg(F.coalesce(F.sum(row_bytes), F.lit(0))).first()[0]
    size = max(shard_bytes, -(-total // MOST_SHARDS))
    if total <= size:
        return []
    keys = light.groupBy("page_id", "sha", "place").agg(F.sum(row_bytes).alias("b")).repartitionByRange(*_order())
    placed = C.settle(keys.withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    parts = placed.groupBy("part").agg(F.sum("b").alias("sum")).select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, -1)
    upto = placed.withColumn("in_part", F.coalesce(F.sum("b").over(within), F.lit(0))).join(F.broadcast(parts), "part").withColumn("at", F.col("base") + F.col("in_part"))  # a row a partition
    # a shard ends with the key that reaches a multiple of its size
    first = upto.where(F.floor(F.col("at") / size) != F.floor((F.col("at") + F.col("b")) / size)).select("page_id", "sha", "place")
    rows = sorted(first.collect(), key=lambda r: (r.page_id is not None, r.page_id or 0, r.sha, r.place))  # MOST_SHARDS at most
    return [{"page_id": r.page_id, "sha": r.sha, "place": r.place} for r in rows]


def _shard(bounds: list[dict]) -> Column:
    """Number of bounds below a row's (page_id, sha, place), by binary search in one constant array."""
    if not bounds:
        return F.lit(0)
    array = F.from_json(F.lit(json.dumps(bounds)), "array<struct<page_id: bigint, sha: string, place: bigint>>")
    own = F.struct("page_id", "sha", "place")
    steps = F.lit([1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)])
    at = F.aggregate(steps, F.lit(0), lambda a, s: F.when((a + s <= len(bounds)) & (F.get(array, a + s - 1) < own), a + s).otherwise(a))
    return at


def write_pages(pages: DataFrame, folder: str, min_payload: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write a record for each page; returns the manifest, one row a file, which is also kept under ``folder``."""
    spark = pages.sparkSession
    C.bound_batches(spark)
    target = f"{folder}/warc"
    fs, at = C.filesystem(target)
    fs.create_dir(at, recursive=True)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    place = F.xxhash64("url").alias("place")
    light = C.settle(pages.select("page_id", "url", F.sha1(payload).alias("sha"), place, F.octet_length(payload).cast("long").alias("n_bytes")))
    one = F.struct("page_id", "place", "url")
    groups = light.where((F.col("n_bytes") >= min_payload) & F.col("page_id").isNotNull()).groupBy("sha", "n_bytes").agg(F.min(one).alias("first")).select(F.col("sha").alias("s"), F.col("n_bytes").alias("z"), "first")
    later = light.join(groups, (F.col("sha") == F.col("s")) & (F.col("n_bytes") == F.col("z"))).where("page_id is null or page_id > first.page_id").select("page_id", "sha", "place", "first").distinct()
    bounds = _bounds(light, shard_bytes)
    shard = _shard(bounds).cast("int").alias("shard")
    none = F.lit(None)
    rows = pages.select("page_id", F.sha1(payload).alias("sha"), place, F.lit(1).alias("kind"), "url", payload.alias("payload"), none.cast("long").alias("ref"), none.cast("string").alias("ref_url")).union(
        later.select("page_id", "sha", "place", F.lit(0), none.cast("string"), none.cast("binary"), "first.page_id", "first.url")
    )
    rows = rows.select(shard, *rows.columns).repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", *_order(), "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = C.filesystem(target)
        made, out, seq, refers, last, again = [], None, 0, None, None, 0
        for b in batches:
            for shard, page_id, sha, place, kind, url, data, ref, ref_url in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if kind == 0:
                    refers = (page_id, sha, place, (ref, ref_url))
                    continue
                if out is not None and (out.shard != shard or out.size >= roll_bytes):
                    made.append(out.close())
                    seq, out = (seq + 1 if out.shard == shard else 0), None
                if out is None:
                    out = Writer(fs, at, shard, seq)
                again = again + 1 if last == (page_id, sha, url) else 0
                last = (page_id, sha, url)
                out.add(record(page_id, url, data, refers[3] if refers is not None and refers[:3] == (page_id, sha, place) else None, again))
        if out is not None:
            made.append(out.close())
        if made:
            yield pa.RecordBatch.from_pylist(made)

    C.map_arrow(rows, run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_pages(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files of a manifest: page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload.

    A revisit has no payload of its own; digest and length are those of the page as it was."""
    target = f"{folder}/warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = C.filesystem(target)
        number = lambda x: None if x is None else int(x)
        for b in batches:
            for path, sha in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(path, compression=None) as f:
                    data = f.read()
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{path} is not what its manifest says")
                rows, held = [], 0
                for h, block in parse(data):
                    http, _, body = block.partition(b"\r\n\r\n")
                    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                    kind, sha1 = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(body) != length or digest(body) != sha1):
                        raise ValueError(f"payload of {h['WARC-Record-ID']} does not match")
                    rows.append((number(h.get("Page-ID")), h.get("WARC-Target-URI"), kind, sha1, length, number(h.get("Refers-To-Page-ID")), body if payloads and kind == "response" else None))
                    held += len(body)
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return C.map_arrow(manifest.select("path", "sha256").repartition(parts, "path"), run, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"])


def archive(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write all pages to the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, which counts like any other; a null url has no Target-URI; a null page_id is never the
    response that others refer to, and without any other id in its group each is a response; rows that repeat the
    smallest id of their group are all responses, and rows that repeat wholly get records of their own; a payload of any
    length is one record, made in memory; other columns are not read; an empty table writes no files.
    """
    folder = C.shared_dir(pages.sparkSession)
    return read_pages(write_pages(pages, folder, min_payload), folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
