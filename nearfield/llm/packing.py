"""Token ids as fixed-width bit-packed files with random access.

A file holds the ids of whole documents in ascending order of doc_id, each id in the fewest bits that hold the
vocabulary. Ids come in blocks, whose byte offsets stand in the footer with an index of documents, so that any document
or range of ids is read without the rest::

    magic "NFTOK1\\0\\0" | packed blocks | block offsets (<u8) | document index: id, first id, ids (<i8 each), null flag (u1)
    | footer (<8 u8): bits, ids, documents, ids a block, blocks, offset of block offsets, offset of the index, checksum

Documents are range-partitioned by (doc_id, text hash), so that no id gathers in one task; a task writes its files under
a temporary name and renames them when they are complete; a task that is run again leaves files that are there already,
which hold the same bytes.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm import common as C
from nearfield.llm.bpe import default_tokenizer, encoder

MAGIC = b"NFTOK1\0\0"
#: Ids a block; a multiple of 8, so that blocks start at whole bytes.
BLOCK = 1 << 16
#: Ids after which a file is closed at the next document's end.
ROLL = 1 << 25
MANIFEST = "path string, part long, seq long, n_docs long, n_ids long, n_bytes long"


def bits_for(vocabulary: int) -> int:
    """Fewest bits for ids below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = ((ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(out.ravel(), bitorder="little").tobytes()


def unpack(data: bytes | np.ndarray, bits: int, n: int, first: int = 0) -> np.ndarray:
    """Ids first..first+n-1 of packed bytes. Widths up to 32 bits; each id lies in one unaligned 64-bit word."""
    raw = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
    if not n:
        return np.zeros(0, np.uint32)
    at = (first + np.arange(n, dtype=np.int64)) * bits
    lo, hi = int(at[0]) >> 3, (int(at[-1]) + bits + 7) >> 3
    buf = np.zeros(hi - lo + 8, np.uint8)
    buf[: hi - lo] = raw[lo:hi]
    words = np.lib.stride_tricks.as_strided(buf.view(np.uint8), (hi - lo + 1, 8), (1, 1))[(at >> 3) - lo].copy().view("<u8").ravel()
    return ((words >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    """One file, written block by block."""

    def __init__(self, fs, folder: str, part: int, seq: int, bits: int) -> None:
        self.fs, self.bits, self.part, self.seq = fs, bits, part, seq
        self.final = f"{folder}/part-{part:06d}-{seq:04d}.tok"
        self.temp = f"{folder}/.{uuid.uuid4().hex}.tmp"
        self.out = fs.open_output_stream(self.temp)
        self.out.write(MAGIC)
        self.at, self.blocks, self.docs, self.n_ids, self.sum = len(MAGIC), [], [], 0, 0
        self.pending: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        first = self.n_ids + np.cumsum(counts) - counts
        self.docs.append((np.array([x or 0 for x in doc_ids], "<i8"), first, counts, np.array([x is None for x in doc_ids], np.uint8)))
        self.n_ids += int(counts.sum())
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            ids = np.concatenate(self.pending)
            whole = len(ids) // BLOCK * BLOCK
            for lo in range(0, whole, BLOCK):
                self._block(ids[lo : lo + BLOCK])
            self.pending, self.held = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.blocks.append(self.at)
        raw = pack(ids, self.bits)
        self.sum = zlib.crc32(raw, self.sum)
        self.out.write(raw)
        self.at += len(raw)

    def close(self) -> dict:
        if self.held:
            self._block(np.concatenate(self.pending))
        table = np.array(self.blocks, "<u8").tobytes()
        cols = [np.concatenate([d[i] for d in self.docs]) for i in range(4)]
        index = b"".join(c.astype(k).tobytes() for c, k in zip(cols, ("<i8", "<i8", "<i8", "u1"), strict=True))
        foot = np.array([self.bits, self.n_ids, len(cols[0]), BLOCK, len(self.blocks), self.at, self.at + len(table), self.sum], "<u8").tobytes()
        self.out.write(table + index + foot)
        self.out.close()
        C.commit(self.fs, self.temp, self.final)
        return {"path": self.final, "part": self.part, "seq": self.seq, "n_docs": len(cols[0]), "n_ids": self.n_ids, "n_bytes": self.at + len(table) + len(index) + len(foot)}


class Reader:
    """One file: its index, and any documents' ids."""

    def __init__(self, fs, path: str) -> None:
        self.file = fs.open_input_file(path)
        size = self.file.size()
        foot = np.frombuffer(self.file.read_at(64, size - 64), "<u8").astype(np.int64)
        self.bits, self.n_ids, n, self.block, blocks, table, index, total = foot.tolist()
        self.blocks = np.frombuffer(self.file.read_at(8 * blocks, table), "<u8").astype(np.int64)
        raw = self.file.read_at(25 * n, index)
        self.first = np.frombuffer(raw, "<i8", n, 8 * n)
        self.count = np.frombuffer(raw, "<i8", n, 16 * n)
        self.null = np.frombuffer(raw, "u1", n, 24 * n).astype(bool)
        self.doc_id = np.frombuffer(raw, "<i8", n)
        self.at, self.end, self.sum, self.path = len(MAGIC), table, total, path

    def verify(self) -> None:
        """Raise if the packed blocks are not those that were written."""
        got = 0
        for lo in range(self.at, self.end, 1 << 20):
            got = zlib.crc32(self.file.read_at(min(1 << 20, self.end - lo), lo), got)
        if got != self.sum:
            raise ValueError(f"{self.path}: the ids do not have the checksum of the file")

    def ids(self, first: int, n: int) -> np.ndarray:
        """Ids first..first+n-1 of the file, from the blocks that hold them."""
        if not n:
            return np.zeros(0, np.uint32)
        b = first // self.block
        skip = first - b * self.block
        start = int(self.blocks[b]) + skip * self.bits // 8
        return unpack(self.file.read_at(((skip + n) * self.bits + 7) // 8 - skip * self.bits // 8, start), self.bits, n, 0) if (skip * self.bits) % 8 == 0 else unpack(
            self.file.read_at(((skip + n) * self.bits + 7) // 8, int(self.blocks[b])), self.bits, n, skip
        )


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """Encode documents and write their ids; returns the manifest, one row a file, which is also kept under ``folder``."""
    spark = docs.sparkSession
    C.bound_batches(spark)
    path = tokenizer or default_tokenizer()
    target = f"{folder}/tokens"
    fs, at = C.filesystem(target)
    fs.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path)
        fs, at = C.filesystem(target)
        part, made, out = TaskContext.get().partitionId(), [], None
        for b in batches:
            for lo, hi, data, off in C.slices(b.column(1), 1 << 21):
                ids, counts = enc.encode_rows(data, off, 0)
                bits = max(bits_for(enc.vocabulary), bits_for(end_id + 1))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                if out is None:
                    out = Writer(fs, at, part, len(made), bits)
                out.add(b.column(0)[lo:hi].to_pylist(), ids, counts + 1)
                if out.n_ids >= ROLL:
                    made.append(out.close())
                    out = None
        if out is not None:
            made.append(out.close())
        if made:
            yield pa.RecordBatch.from_pylist(made)

    n = partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    C.map_arrow(ordered.select("doc_id", "text"), run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_tokens(manifest: DataFrame, folder: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, from the files of a manifest.

    ``start`` counts the ids of all documents before it: those of earlier files (one manifest row a file) and those
    before it in its own.
    """
    base = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(base), F.lit(0)).cast("long")).select("path", "base")
    target = f"{folder}/tokens"
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = C.filesystem(target)
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                r = Reader(fs, path)
                r.verify()
                lo = 0
                while lo < len(r.doc_id):  # some documents at a time, about a million ids
                    hi = max(lo + 1, int(np.searchsorted(r.first, r.first[lo] + (1 << 20))))
                    got = r.ids(int(r.first[lo]), int(r.count[lo:hi].sum())).astype("<u4")
                    cut = C.offsets_of(r.count[lo:hi]).tolist()
                    cols = [
                        pa.array(r.doc_id[lo:hi], mask=r.null[lo:hi]),
                        pa.array(r.first[lo:hi] + start),
                        pa.array(r.count[lo:hi]),
                        pa.array([zlib.crc32(got[x:y].tobytes()) for x, y in zip(cut, cut[1:], strict=False)], pa.int64()),
                    ]
                    if ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(np.array(cut, np.int32)), pa.array(got.astype(np.int64))))
                    yield pa.record_batch(cols, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)
                    lo = hi

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return C.map_arrow(files.repartition(parts, "path"), run, schema)


def pack_and_read(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write all documents to files in the shared folder and read them back.

    A null or empty text has only the end id; null ids come first, and rows with equal ids in the order of their texts'
    hashes; repeated rows are all written; other columns are not read; an empty table gives no files and no rows.
    """
    folder = C.shared_dir(docs.sparkSession)
    return read_tokens(write_tokens(docs, folder, tokenizer, end_id), folder)
