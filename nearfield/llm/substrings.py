"""Substring dedup with suffix arrays: bytes go that lie in a 200-byte string which also starts anywhere else.

Every window of 200 bytes is named by its anchor, the leftmost least hash of the 32-byte strings in it, so equal windows
have equal anchors. The windows around one anchor position are a fragment, the text from the first to the last of them.
Anchors that occur once in the corpus are dropped: 8 bytes a fragment are counted. Of the rest, equal fragments are
one, and repeat as a whole; only where an anchor has fragments of different content are their texts gathered, each
content once. A shard of whole anchors is one text, whose suffix array is made by induced sorting; two neighbours in it
that share 200 bytes or more by the permuted common prefixes are repeated windows.

An anchor with very many contents is not gathered: its windows are hashed one by one and counted instead.

A text is known by two hashes, whatever rows hold it, so copies of a document share one list of ranges, and the work is in
proportion to the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm import common as C
from nearfield.llm.suffix import permuted_lcp, suffix_array

U = np.uint64
LENGTH = 200
GRAM = 32
#: Text of a shard, about: whole anchors are added up to this size.
SHARD = 1 << 20
#: Different contents of an anchor beyond which its windows are hashed instead; at 284 bytes each they make a few shards.
MOST = 1 << 14


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by prefix and suffix minima of blocks."""
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, U)]).reshape(-1, w)
    front = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    return np.minimum(back[:m], front[w - 1 : w - 1 + m])


def fragments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(row, start in the row, windows, anchor, content hash) of each fragment."""
    z = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return z, z, z, np.zeros(0, U), np.zeros(0, U)
    p = C.prefix(data)
    g = np.arange(n - gram + 1)
    h = C.span_hash(p, g, g + gram)
    bits = U(max(1, int(n).bit_length()))
    least = _sliding_least(((h >> bits) << bits) | g.astype(U), length - gram + 1)
    at = (least & ((U(1) << bits) - U(1))).astype(np.int64)  # anchor position of each window
    ok = np.zeros(n - length + 2, bool)
    size = np.diff(offsets)
    first, last = offsets[:-1][size >= length], offsets[1:][size >= length] - length
    mark = np.zeros(n - length + 2, np.int64)
    np.add.at(mark, first, 1)
    np.add.at(mark, last + 1, -1)
    ok = np.cumsum(mark)[:-1] > 0
    head = np.zeros(n - length + 2, bool)
    head[first] = True
    new = ok.copy()
    new[1:] &= (at[1:] != at[:-1]) | head[1:-1]
    start = np.flatnonzero(new)
    stop_marks = np.flatnonzero(new | ~ok)
    nxt = np.append(stop_marks, len(ok))
    count = nxt[np.searchsorted(stop_marks, start) + 1] - start
    row = np.searchsorted(offsets, start, "right") - 1
    return row, start - offsets[row], count, h[at[start]], C.span_hash(p, start, start + count + length - 1)


def _ours(docs: DataFrame, length: int, more: list[Column] | None = None) -> DataFrame:
    """doc_id, text, h1, h2 (and more columns): the text's two hashes. Texts too short to lose anything are told apart by id, to spread them."""
    t = F.coalesce("text", F.lit(""))
    first = F.when(F.octet_length(t) < length, F.xxhash64(F.lit(0), "doc_id")).otherwise(F.xxhash64(F.lit(1), t))
    return docs.select("doc_id", "text", first.alias("h1"), F.xxhash64(F.lit(2), t).alias("h2"), *(more or []))


def _found(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(f, c, doc_id, h1, h2, at, n) of every fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in C.slices(b.column(1)):
                row, at, n, f, c = fragments(data, off, length, gram)
                take = pa.array(row)
                known = [b.column(i)[lo:hi].take(take) for i in (0, 2, 3)]
                yield pa.record_batch([pa.array(f.view(np.int64)), pa.array(c.view(np.int64)), *known, pa.array(at.astype(np.int32)), pa.array(n.astype(np.int16))], ["f", "c", "doc_id", "h1", "h2", "at", "n"])

    return C.map_arrow(docs, run, "f long, c long, doc_id long, h1 long, h2 long, at int, n short")


def _texts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(f, c, n, body): the bytes of wanted (f, c, n, doc_id, h1, at), from their documents."""
    lists = wanted.groupBy("doc_id", "h1").agg(F.collect_list(F.struct("f", "c", "n", "at")).alias("w"))
    ours = _ours(docs, length).select(F.col("doc_id").alias("id"), "text", F.col("h1").alias("g"))
    # rows that repeat in id and text give their bytes once each; what is gathered under an anchor takes each content once
    both = lists.join(ours, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("g") == F.col("h1"))).select("text", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in C.slices(b.column(0)):
                w = b.column(1)[lo:hi]
                counts = pc.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = w.flatten()
                f, c, n, at = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                start = np.repeat(off[:-1], counts) + at
                size = n.astype(np.int64) + length - 1
                for x in range(0, len(f), 4096):
                    s, z = start[x : x + 4096], size[x : x + 4096]
                    body = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(C.offsets_of(z).astype(np.int32).tobytes()), pa.py_buffer(data[C.ragged(s, z)].tobytes())])
                    yield pa.record_batch([pa.array(f[x : x + 4096]), pa.array(c[x : x + 4096]), pa.array(n[x : x + 4096]), body], ["f", "c", "n", "body"])

    return C.map_arrow(both, run, "f long, c long, n short, body binary")


def repeated_windows(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(window starts in the joined bodies that repeat among them, offsets of the bodies with one byte between)."""
    sizes = np.array([len(x) for x in bodies], np.int64)
    off = C.offsets_of(sizes + 1)
    data = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    t = data.astype(np.uint16)
    t += np.uint16(1)
    t[off[1:] - 1] = 0  # between pieces stands a symbol that is no byte
    sa = suffix_array(t, 257)
    del t
    plcp, phi = permuted_lcp(data, sa, np.repeat((off[1:] - 1).astype(np.int32), sizes + 1))
    hit = np.zeros(len(data), bool)
    at = np.flatnonzero(plcp >= length)
    hit[at] = True
    hit[phi[at]] = True
    return np.flatnonzero(hit), off


def _by_suffix(texts: DataFrame, length: int) -> DataFrame:
    """(f, c, lo, hi): ranges of repeated windows of each content, of whole anchors gathered into shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def flush() -> pa.RecordBatch | None:
            t = pa.concat_tables(held)
            bodies = t.column("body").to_pylist()
            hit, off = repeated_windows(bodies, length)
            if not len(hit):
                return None
            new = np.concatenate([[True], np.diff(hit) > 1])
            lo, hi = hit[new], hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1]
            k = np.searchsorted(off, lo, "right") - 1
            take = pa.array(k)
            return pa.record_batch([t.column("f").combine_chunks().take(take), t.column("c").combine_chunks().take(take), pa.array((lo - off[k]).astype(np.int32)), pa.array((hi - off[k]).astype(np.int32))], ["f", "c", "lo", "hi"])

        for t in C.grouped(batches, 1):
            f, c = (t.column(i).to_numpy() for i in range(2))
            t = t.filter(pa.array(np.concatenate([[True], (f[1:] != f[:-1]) | (c[1:] != c[:-1])])))  # each content once
            for a, b in _cuts(t):
                part = t.slice(a, b - a)
                held.append(part)
                size += pc.sum(pc.binary_length(part.column("body"))).as_py() or 0
                if size >= SHARD:
                    if (out := flush()) is not None:
                        yield out
                    held, size = [], 0
        if held and (out := flush()) is not None:
            yield out

    return C.map_arrow(texts.select("f", "c", "body").repartition("f").sortWithinPartitions("f", "c"), run, "f long, c long, lo int, hi int")


def _cuts(t: pa.Table) -> list[tuple[int, int]]:
    """A table of whole anchors in parts of whole anchors, of about a shard each."""
    sizes = C.offsets_of(pc.binary_length(t.column("body")).to_numpy().astype(np.int64))
    if sizes[-1] <= SHARD:
        return [(0, t.num_rows)]
    bounds = C.group_bounds(t, 1)
    out, a = [], 0
    for b in bounds[1:]:
        if sizes[b] - sizes[a] >= SHARD or b == bounds[-1]:
            out.append((a, b))
            a = b
    return out


def _by_hash(texts: DataFrame, length: int) -> DataFrame:
    """(f, c, lo, hi) for anchors of very many contents: each window by two hashes, counted over all contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in C.slices(b.column(2), 1 << 19):
                p = C.prefix(data)
                n = np.diff(off) - length + 1
                at = C.ragged(off[:-1], n)
                h = C.span_hash(p, at, at + length)
                row = np.repeat(np.arange(hi - lo), n)
                take = pa.array(row)
                yield pa.record_batch([b.column(0)[lo:hi].take(take), b.column(1)[lo:hi].take(take), pa.array((at - off[row]).astype(np.int32)), pa.array(h.view(np.int64))], ["f", "c", "lo", "w"])

    each = C.map_arrow(texts.select("f", "c", "body"), run, "f long, c long, lo int, w long")
    twice = C.settle(each.groupBy("f", "w").agg(F.count("*").alias("m")).where("m > 1").select(F.col("f").alias("g"), F.col("w").alias("x")))
    return each.join(twice, (F.col("f") == F.col("g")) & (F.col("w") == F.col("x"))).select("f", "c", "lo", F.col("lo").alias("hi"))


def _spans(docs: DataFrame, length: int, gram: int, most: int) -> DataFrame:
    """(h1, h2, w): for each text with repeated windows, their ranges as (first start, last start)."""
    every = _found(_ours(docs, length), length, gram)
    twice = C.settle(every.groupBy("f").agg(F.count("*").alias("m")).where("m > 1").select("f"))
    again = C.settle(every.join(twice, "f", "left_semi"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "at")
    contents = C.settle(again.groupBy("f", "c", "n").agg(F.count("*").alias("m"), F.min(place).alias("p")))
    kinds = C.settle(contents.groupBy("f").agg(F.count("*").alias("k")).where("k > 1").select(F.col("f").alias("g"), (F.col("k") > most).alias("many")))
    mixed = contents.join(kinds, F.col("f") == F.col("g")).select("f", "c", "n", "p.doc_id", "p.h1", "p.at", "many")
    texts = C.settle(_texts(docs, mixed, length).join(kinds, F.col("f") == F.col("g")).select("f", "c", "body", "many"))
    parts = _by_suffix(texts.where("not many"), length)
    if not kinds.where("many").isEmpty():
        parts = parts.union(_by_hash(texts.where("many").dropDuplicates(["f", "c"]), length))
    whole = contents.where("m > 1").select("f", "c", F.lit(0).alias("lo"), (F.col("n") - 1).cast("int").alias("hi"))
    ranges = C.settle(parts.union(whole).groupBy("f", "c").agg(F.collect_list(F.struct("lo", "hi")).alias("r")).select(F.col("f").alias("g"), F.col("c").alias("d"), "r"))
    hits = again.join(ranges, (F.col("f") == F.col("g")) & (F.col("c") == F.col("d")))
    moved = F.transform("r", lambda x: F.struct((x["lo"] + F.col("at")).alias("lo"), (x["hi"] + F.col("at")).alias("hi")))
    # copies of a text give the same ranges, which are taken once, before the shuffle too
    return hits.select("h1", "h2", moved.alias("r")).groupBy("h1", "h2").agg(F.flatten(F.collect_set("r")).alias("w"))


def _cut(docs: DataFrame, length: int, gram: int, most: int, carry: str, schema: str, rows) -> DataFrame:
    """Documents beside their repeated windows; ``rows`` makes output batches from (carried columns, kept, cut, spans)."""
    first = carry
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    ours = _ours(docs, length, [row] if carry == "row" else []).select(first, F.col("text").alias("__text"), F.col("h1").alias("__g1"), F.col("h2").alias("__g2"))
    spans = _spans(docs, length, gram, most)
    both = ours.join(spans, (F.col("__g1") == F.col("h1")) & (F.col("__g2") == F.col("h2")), "left").select(first, "__text", F.col("w").alias("__w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in C.slices(b.column(1)):
                w = b.column(2)[lo:hi]
                counts = pc.fill_null(pc.list_value_length(w), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = w.flatten()
                a, z = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
                base = np.repeat(off[:-1], counts)
                mark = np.zeros(len(data) + 1, np.int64)
                np.add.at(mark, base + a, 1)
                np.add.at(mark, base + z + length, -1)
                gone = np.cumsum(mark)[:-1] > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                begins[off[:-1][off[:-1] < len(data)]] |= gone[off[:-1][off[:-1] < len(data)]]
                cut = np.concatenate([[0], np.cumsum(~gone)])[off]
                runs = np.concatenate([[0], np.cumsum(begins)])[off]
                yield rows(b.column(0)[lo:hi], data[~gone].tobytes(), cut, off, np.diff(runs))

    return C.map_arrow(both, run, schema)


def judge(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of each document.

    A null or empty text has no bytes; a text shorter than ``length`` loses nothing, and one of any length is judged
    whole; rows that repeat another (same id and text) repeat its strings, each with the same result; ids that repeat or are
    null tell nothing, as texts are known by their hashes; other columns are not read; an empty table gives no rows.
    """
    C.bound_batches(docs.sparkSession)

    def rows(ids, kept, cut, off, runs):
        c = cut.tolist()
        return pa.record_batch(
            [ids, pa.array(np.diff(off)), pa.array(np.diff(off) - np.diff(cut)), pa.array(runs.astype(np.int64)), pa.array([hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(c, c[1:], strict=False)], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    return _cut(docs, length, gram, most, "doc_id", "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", rows)


def cut_documents(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """The documents without their repeated bytes, with the columns of ``docs``; n_chars follows the text.

    Bytes of a character of which only a part is removed go with it. Cases as in :func:`judge`; a null text becomes empty.
    """
    C.bound_batches(docs.sparkSession)
    kind = f"struct<{','.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in docs.schema.fields)}>"

    def rows(own, kept, cut, off, runs):
        c = cut.tolist()
        return pa.record_batch([own, pa.array([kept[x:y].decode("utf-8", "ignore") for x, y in zip(c, c[1:], strict=False)], pa.string())], ["row", "kept"])

    got = _cut(docs, length, gram, most, "row", f"row {kind}, kept string", rows)
    out = {c: F.col("row").getField(c) for c in docs.columns}
    out["text"] = F.col("kept")
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return got.select(*[out[c].alias(c) for c in docs.columns])
