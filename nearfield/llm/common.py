"""What the operators of this subpackage share: scratch tables in the shared folder, and text as numpy bytes.

White space is always the six ASCII characters of ``[\\x20\\x09-\\x0D]``; a word is a maximal run of others.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word, for Spark's and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"
#: A column name that no input is expected to hold; operators rename to it where they must keep foreign columns.
OWN = "__nf_"

_made: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a session in one process, as in tests; on a cluster, whose machines do
    not share such a folder, this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='nearfield-')}")
        base = _own[0]
    path = f"{base.rstrip('/')}/nf-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; the cluster's own clean-up takes what is left
            return


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends, and its size is known to the planner.

    The table is ordinary Parquet in the folder that all executors share, so that a lost executor costs no recomputation.
    """
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Words of a text; null counts as empty. Each word with the space around it becomes one letter, without an array."""
    return F.when(text.rlike(WORD), F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]++[\x20\x09-\x0D]*", "x"))).otherwise(0).cast("long")


# --- numpy side -------------------------------------------------------------------------------------------------------

_U = np.uint64
_rng = np.random.default_rng(20240611)
#: Random odd base of the polynomial over bytes, a random value for each byte, and the base's inverse mod 2**64.
BASE = int(_rng.integers(1 << 62, 1 << 63)) | 1
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_pow: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) mod 2**64, or of its inverse."""
    key = "i" if inverse else "p"
    if key not in _pow or len(_pow[key]) < n:
        b = pow(BASE, -1, 1 << 64) if inverse else BASE
        size = 1 << max(12, int(n - 1).bit_length())
        out = np.ones(size, _U)
        have = 1
        while have < size:
            out[have : 2 * have] = out[:have] * _U(pow(b, have, 1 << 64))
            have *= 2
        _pow[key] = out
    return _pow[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each input bit reaches each output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def prefix(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of BYTE[data[t]] * BASE**t over i <= t < j."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(BYTE[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] wherever it stands; 64 bits, mixed, with its length."""
    inv = powers(len(p), inverse=True)
    return mix((p[end] - p[start]) * inv[start] + (end - start).astype(_U) * _U(0x9E3779B97F4A7C15))


def slices(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi of a string column as (lo, hi, bytes, offsets), about ``most`` bytes at a time; null is empty.

    Offsets are int64, hi - lo + 1 of them, from 0. A longer text comes alone and whole.
    """
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    off = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the row each belongs to; words never cross rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = ink[:-1]
    start = np.flatnonzero(ink & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = ink[1:]
    end = np.flatnonzero(ink & (~after | first[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


# --- Arrow side -------------------------------------------------------------------------------------------------------


def bound_batches(spark: SparkSession) -> None:
    """Hand texts to Python 4 MB at a time, however long single rows are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def release() -> None:
    """Give back to the system what a finished task has freed: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow``, with the task's memory given back at its end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[0]..+counts[0]-1, starts[1].. and so on, end to end."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def offsets_of(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def filesystem(uri: str):
    """pyarrow's file system for a folder that all executors share, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def commit(fs, temp: str, final: str) -> None:
    """Give a finished file its name. A task that is run again finds the file of an earlier run, which holds the same bytes."""
    from pyarrow.fs import FileType

    def there() -> bool:
        old = fs.get_file_info(final)
        if old.type == FileType.NotFound:
            return False
        if old.size != fs.get_file_info(temp).size:
            raise ValueError(f"{final} exists with other content")
        fs.delete_file(temp)
        return True

    if there():
        return
    try:
        fs.move(temp, final)
    except OSError:  # another run of the task was faster
        if not there():
            raise


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Whole groups of rows that agree in the first ``n_keys`` columns, which are integers, from sorted batches.

    Yields tables of one or more whole groups; only an unfinished group is carried from batch to batch.
    """
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)])
        if held:
            last = [held[0].column(i)[0].as_py() for i in range(n_keys)]
            differs = (keys != np.array(last)[:, None]).any(axis=0)
            if not differs.any():
                held.append(b)
                continue
            cut = int(np.argmax(differs))
            if cut:
                held.append(b.slice(0, cut))
            yield pa.Table.from_batches(held)
            b, keys, held = b.slice(cut), keys[:, cut:], []
        change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield pa.Table.from_batches([b.slice(0, cut)])
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(table: pa.Table, n_keys: int) -> list[int]:
    keys = np.stack([table.column(i).to_numpy() for i in range(n_keys)])
    change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
    return [0, *change.tolist(), table.num_rows]


def roots(linked: np.ndarray) -> np.ndarray:
    """Least index reachable from each row of a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1, initial=n))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def sized(members: DataFrame, gid: str, block: int) -> DataFrame:
    """(large, t): the groups of more than ``block`` members, and how many blocks they make."""
    counted = members.groupBy(gid).agg(F.count("*").alias("m")).where(F.col("m") > block)
    return settle(counted.select(F.col(gid).alias("large"), F.ceil(F.col("m") / block).cast("long").alias("t")))


def block_of(columns: list[str], blocks: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), blocks)


def units(members: DataFrame, gid: str, block: int) -> DataFrame:
    """Work units for all pairs of each group: columns u and side are added.

    A group of up to ``block`` members is one unit. A larger one is dealt into blocks by hash, and each pair of blocks is
    a unit, so that no task gets more than two blocks; side tells the blocks of a unit apart.
    """
    own = members.columns
    dealt = members.join(sized(members, gid, block), F.col(gid) == F.col("large"), "left")
    mine = block_of(own[:2], F.col("t"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("t") - 1), lambda o: F.struct((F.least(mine, o) * F.col("t") + F.greatest(mine, o)).alias("u"), (mine > o).cast("int").alias("side")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("u"), F.lit(0).alias("side")))
    return dealt.select(*own, F.explode(F.when(F.col("t").isNull(), whole).otherwise(pairs)).alias("x")).select(*own, "x.u", "x.side")
