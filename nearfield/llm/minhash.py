"""MinHash near-dedup with odd sketches.

A document's set holds the hashes of its distinct runs of four words. Equal sets are one class. Each class has a MinHash
signature of 128 values, whose 32 bands of four values name the buckets in which it meets its candidates, and an odd
sketch: the signature folded into a bitmap of parities. The population count of the XOR of two sketches is at most twice
the number of values in which the signatures differ, and close to it while they are few, so it estimates high
similarities well and tells at once which candidates of a bucket are worth a look at their full sets.

A bucket may hold very many classes, so its pairs are never listed. The members of all buckets that one class leads (by
the least id) are a group; any two classes of a bucket meet in its leader's group, once for all bands. Pairs are compared
first by sketches, which leaves those with a partner near enough, and then by full sets, on which every link is
confirmed. A small group is compared whole. A large one is compared within blocks, twice, dealt differently: what links
connect gets one label, and pairs within a label need no look. Between the two, members go that have too few hashes in
sets of other labels to link with one. What has not the most frequent label of its group then is compared with all that
is left of the group, in pairs of blocks. A unit of work tells of its links only what connects: each member's least
reachable one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm import common as C
from nearfield.llm.components import components

U = np.uint64
#: Values of a signature, and of a band. At similarity 0.8 a pair meets in no bucket with probability 5e-8.
VALUES, ROWS = 128, 4
BANDS = VALUES // ROWS
#: Bits of an odd sketch.
SKETCH = 1024
_rng = np.random.default_rng(71)
_A = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) * U(2) + U(1)
_B = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_W = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)


def most_different(similarity: float) -> int:
    """Largest XOR population count of two sketches that may still belong to sets this similar.

    The signatures differ in a binomial number of values; six standard deviations above its mean, each value that
    differs flips two bits at most.
    """
    p = 1 - similarity
    return int(2 * (VALUES * p + 6 * (VALUES * p * (1 - p)) ** 0.5)) + 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``size`` words of each row; of all words, if a row has fewer."""
    low = C.LOWER[data]
    start, end, row = C.words(data, offsets)
    key = C.span_hash(C.prefix(low), start, end) if len(start) else np.zeros(0, U)
    counts = np.bincount(row, minlength=len(offsets) - 1)
    at = C.offsets_of(counts)
    n = len(key)
    runs = np.zeros(n, U)
    if n >= size:
        total = np.zeros(n - size + 1, U)
        for i in range(size):
            total += C.mix(key[i : n - size + 1 + i] ^ _W[i]) * _W[i]
        runs[: n - size + 1] = C.mix(total)
    out = []
    for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            x = (C.mix(key[a:b] ^ _W[: b - a]) * _W[: b - a]).sum(dtype=U) + U(b - a)
            out.append(C.mix(np.array([x ^ _W[63]])))
        else:
            out.append(np.zeros(0, U))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    best = np.full(VALUES, np.iinfo(np.uint64).max, U)
    for lo in range(0, len(s), 2048):
        np.minimum(best, (_A[:, None] * s[None, lo : lo + 2048] + _B[:, None]).min(axis=1), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    x = sig.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=U)
    for i in range(ROWS):
        out = C.mix(out * U(0x9E3779B97F4A7C15) + x[:, i])
    return out.view(np.int64)


def odd_sketch(sig: np.ndarray) -> bytes:
    bit = (C.mix(sig + np.arange(VALUES, dtype=U) * U(0xD6E8FEB86659FD93)) >> U(54)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set: two sums of mixed members."""
    return int(C.mix(s ^ _W[40]).sum(dtype=U).view(np.int64)), int(C.mix(s ^ _W[41]).sum(dtype=U).view(np.int64))


#: Members of a block; a task compares two blocks at most at a time.
BLOCK = 512


def _hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, h (the text's hash), n, c1, c2 (the set's name), bands, sketch of each document; no bands without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in C.slices(b.column(1)):
                sets = shingle_sets(data, off, size)
                sigs = [signature(s) if len(s) else None for s in sets]
                names = [set_key(s) for s in sets]
                yield pa.record_batch(
                    [
                        b.column(0)[lo:hi],
                        b.column(2)[lo:hi],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([x for x, _ in names], pa.int64()),
                        pa.array([x for _, x in names], pa.int64()),
                        pa.array([None if s is None else band_keys(s) for s in sigs], pa.list_(pa.int64())),
                        pa.array([None if s is None else odd_sketch(s) for s in sigs], pa.binary()),
                    ],
                    ["doc_id", "h", "n", "c1", "c2", "bands", "sketch"],
                )

    return C.map_arrow(docs.select("doc_id", "text", _hash(F.col("text")).alias("h")), run, "doc_id long, h long, n long, c1 long, c2 long, bands array<long>, sketch binary")


def _promising(table: pa.Table, n_keys: int, similarity: float, most: int) -> np.ndarray:
    """Rows of whole units (gid, u, side, rep, n, sketch) that have a partner of the right size with a sketch near enough."""
    bounds = C.group_bounds(table, n_keys)
    side, rep, n = table.column("side").to_numpy(), table.column("rep").to_numpy(), table.column("n").to_numpy().astype(np.float64)
    bits = np.unpackbits(np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH // 8), axis=1)
    out = np.zeros(table.num_rows, bool)
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a < 2:
            continue
        x, m, s = bits[a:b].astype(np.float32), n[a:b], side[a:b]
        ones = x.sum(axis=1)
        apart = ones[:, None] + ones[None, :] - 2 * (x @ x.T)
        near = (apart <= most) & (np.minimum.outer(m, m) >= similarity * np.maximum.outer(m, m) - 1e-9)
        near &= rep[a:b, None] != rep[None, a:b]
        if s.any():
            near &= s[:, None] != s[None, :]
        out[a:b] = near.any(axis=1)
    return out


def common_sizes(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets of distinct hashes."""
    m = len(sets)
    if m <= 6:
        out = np.zeros((m, m), np.int64)
        for i in range(m):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    count = np.diff(np.append(start, len(value)))
    out = np.zeros(m * m, np.int64)
    for d in range(2, 9):  # hashes of few sets pair by pair, those of many by matrix product
        at = start[count == d]
        for i in range(d):
            for j in range(i):
                out += np.bincount(owner[at + i] * m + owner[at + j], minlength=m * m)
    out = out.reshape(m, m)
    out = out + out.T
    many = np.flatnonzero(count > 8)
    for lo in range(0, len(many), 4096):
        part = many[lo : lo + 4096]
        x = np.zeros((m, len(part)), np.float32)
        x[owner[C.ragged(start[part], count[part])], np.repeat(np.arange(len(part)), count[part])] = 1
        out += (x @ x.T).astype(np.int64)
    return out


def _linked(table: pa.Table, n_keys: int, percent: int) -> list[tuple[int, int, int]]:
    """(gid, rep, least rep reachable in its unit) for whole units (gid, u, side, rep, set), by links confirmed on full sets."""
    bounds = C.group_bounds(table, n_keys)
    gid, side, rep = (table.column(c).to_numpy() for c in ("gid", "side", "rep"))
    column = table.column("set").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    off = column.offsets.to_numpy()
    flat = column.values.to_numpy().view(np.uint64)
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a < 2:
            continue
        order = a + np.lexsort((side[a:b], rep[a:b]))
        order = order[np.concatenate([[True], (rep[order[1:]] != rep[order[:-1]]) | (side[order[1:]] != side[order[:-1]])])]
        sets = [flat[off[i] : off[i + 1]] for i in order.tolist()]
        both = common_sizes(sets)
        n = np.array([len(s) for s in sets])
        link = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        s = side[order]
        if s.any():
            link &= s[:, None] != s[None, :]
        root = C.roots(link)
        far = np.flatnonzero(root != np.arange(len(root)))
        out += zip([int(gid[a])] * len(far), rep[order[far]].tolist(), rep[order[root[far]]].tolist(), strict=True)
    return out


def _texts(docs: DataFrame, names: DataFrame) -> DataFrame:
    """A text of each class of (r, c1, c2, at): by its first row's id and hash, or where that has no id, by the hash alone."""
    here = docs.select("doc_id", "text", _hash(F.col("text")).alias("g"))
    known = names.join(here, (F.col("at.id") == F.col("doc_id")) & (F.col("at.h") == F.col("g"))).select("r", "c1", "c2", "text", "g")
    nameless = here.where("doc_id is null").groupBy("g").agg(F.first("text").alias("text"))
    return known.union(names.where("at.none").join(nameless, F.col("at.h") == F.col("g")).select("r", "c1", "c2", "text", "g"))


def _sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(r, set): the full sets of representatives (rep)."""
    wanted = wanted.select(F.col("rep").alias("w")).distinct()
    placed = ["at"] if "at" in classes.columns else []
    names = classes.select(F.col("rep").alias("r"), "c1", "c2", *placed).join(wanted, F.col("r") == F.col("w")).select("r", "c1", "c2", *placed)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in C.slices(b.column(3)):
                sets = shingle_sets(data, off, size)
                c1, c2 = b.column(1)[lo:hi].to_pylist(), b.column(2)[lo:hi].to_pylist()
                own = [i for i, s in enumerate(sets) if set_key(s) == (c1[i], c2[i])]  # rows that share an id may hold other texts
                yield pa.record_batch([b.column(0)[lo:hi].take(pa.array(own, pa.int64())), pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))], ["r", "set"])

    texts = _texts(docs, names) if placed else names.join(docs.select("doc_id", "text", _hash(F.col("text")).alias("g")), F.col("r") == F.col("doc_id")).select("r", "c1", "c2", "text", "g")
    texts = texts.dropDuplicates(["r", "g"]).select("r", "c1", "c2", "text")  # rows that repeat, on the join's own partitions
    return C.settle(C.map_arrow(texts, full, "r long, set array<long>"))


def _compared(dealt: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int, also: DataFrame | None = None, sets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(gid, a, b) for units (gid, u, side, rep): of the links between their sides, or in all, what connects.

    And the full sets used, (r, set), with those of ``also`` (rep), for later units; ``sets`` are given ones.
    """
    similarity = percent / 100
    most = most_different(similarity)
    looks = dealt.join(classes.select(F.col("rep").alias("r"), "n", "sketch"), F.col("rep") == F.col("r"))
    looks = looks.select("gid", "u", "side", "rep", "n", "sketch").repartition("gid", "u").sortWithinPartitions("gid", "u")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.grouped(batches, 2):
            keep = _promising(t, 2, similarity, most)
            yield from t.select(["gid", "u", "side", "rep"]).filter(pa.array(keep)).combine_chunks().to_batches()

    near = C.settle(C.map_arrow(looks, look, "gid long, u long, side int, rep long"))
    if sets is None:
        sets = _sets(near.select("rep") if also is None else near.select("rep").union(also), docs, classes, size)
    confirm = near.join(sets, F.col("rep") == F.col("r")).select("gid", "u", "side", "rep", "set").repartition("gid", "u").sortWithinPartitions("gid", "u")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.grouped(batches, 2):
            if found := _linked(t, 2, percent):
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["gid", "a", "b"])

    return C.settle(C.map_arrow(confirm, link, "gid long, a long, b long")), sets


def _labelled(reps: DataFrame, links: DataFrame) -> DataFrame:
    """``reps`` and a column label: the component of each rep by (node, component), itself if it has none."""
    return reps.join(links, F.col("rep") == F.col("node"), "left").select(*reps.columns, F.coalesce("component", "rep").alias("label"))


def _mixed(members: DataFrame, links: DataFrame) -> DataFrame:
    """(gid, rep, t) of the groups of (gid, rep) that hold more than one label, and how many blocks each makes."""
    several = _labelled(members, links).groupBy("gid").agg(F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    return members.join(several.select(F.col("gid").alias("g"), F.ceil(F.col("m") / BLOCK).cast("long").alias("t")), F.col("gid") == F.col("g")).select("gid", "rep", "t")


def _able(sets: DataFrame, percent: int) -> DataFrame:
    """(able): those of (rep, label, set) that may link with one of another label.

    Such a link needs ``percent`` of a set's hashes in a set of another label. Hashes meet by their ranges; each batch
    gives one row a range.
    """
    parts = max(2 * sets.sparkSession.sparkContext.defaultParallelism, (sets.agg(F.sum(F.size("set"))).first()[0] or 0) >> 19)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(2).value_lengths().to_numpy()
            h = b.column(2).flatten().to_numpy()
            part = (C.mix(h.view(np.uint64)) % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            used, start = np.unique(part[order], return_index=True)
            off = pa.array(np.append(start, len(h)), pa.int32())
            lists = [pa.ListArray.from_arrays(off, pa.array(x[order])) for x in (np.repeat(b.column(0).to_numpy(), sizes), np.repeat(b.column(1).to_numpy(), sizes), h)]
            yield pa.record_batch([pa.array(used), *lists], ["part", "rep", "label", "h"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.grouped(batches, 1):
            bounds = C.group_bounds(t, 1)
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                rep, label, h = (np.concatenate([x.flatten().to_numpy() for x in t.column(c).slice(lo, hi - lo).chunks]) for c in ("rep", "label", "h"))
                order = np.argsort(h, kind="stable")
                rep, label, h = rep[order], label[order], h[order]
                start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                shared = np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start)
                who, n = np.unique(rep[np.repeat(shared, np.diff(np.append(start, len(h))))], return_counts=True)
                yield pa.record_batch([pa.array(who), pa.array(n.astype(np.int64))], ["w", "k"])

    dealt = C.map_arrow(sets, deal, "part long, rep array<long>, label array<long>, h array<long>").repartition("part").sortWithinPartitions("part")
    shared = C.map_arrow(dealt, count, "w long, k long").groupBy("w").agg(F.sum("k").alias("k"))
    return shared.join(sets.select("rep", F.size("set").alias("n")), F.col("w") == F.col("rep")).where(F.col("k") * 100 >= F.col("n") * percent).select(F.col("w").alias("able"))


def _edges(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) links between representatives that connect all that links connect.

    A representative is an id, unless classes tell ``at``, the place of their first rows.
    """
    # a bucket's leader is its least representative; all members of the leader's buckets are one group
    in_band = classes.select("rep", F.explode("bands").alias("band"))
    lead = in_band.groupBy("band").agg(F.min("rep").alias("gid"), F.max("rep").alias("other")).where("gid != other").select(F.col("band").alias("led"), "gid")
    members = C.settle(in_band.join(lead, F.col("band") == F.col("led")).select("gid", "rep").distinct())
    large = C.sized(members, "gid", BLOCK)
    none, zero, one = F.lit(0).cast("long"), F.lit(0), F.lit(1)
    small = members.join(large, F.col("gid") == F.col("large"), "left_anti").select("gid", none.alias("u"), zero.alias("side"), "rep")
    if large.isEmpty():
        return _compared(small, docs, classes, size, percent)[0].select("a", "b")
    many = C.settle(members.join(large, F.col("gid") == F.col("large")).select("gid", "rep", "t"))
    block = C.block_of(["gid", "rep"], F.col("t"))
    first, sets = _compared(small.union(many.select("gid", block.alias("u"), zero.alias("side"), "rep")), docs, classes, size, percent, many.select("rep"))
    links = components(first.select("a", "b"))  # connects as all links so far do
    able = _able(_labelled(many.select("rep").distinct(), links).join(sets, F.col("rep") == F.col("r")).select("rep", "label", "set"), percent)
    many = C.settle(_labelled(_mixed(many.select("gid", "rep").join(able, F.col("rep") == F.col("able")).select("gid", "rep"), links), links))
    again = C.block_of(["gid", "rep", one], F.col("t"))  # dealt anew, so that what is connected in each block meets
    second, _ = _compared(many.select("gid", again.alias("u"), zero.alias("side"), "rep"), docs, classes, size, percent, sets=sets)
    links = components(links.union(second.select("a", "b")))
    many = C.settle(_labelled(many.where("t > 1").select("gid", "rep", "t"), links))
    main = many.groupBy("gid", "label").agg(F.count("*").alias("m")).groupBy("gid").agg(F.max_by("label", F.struct("m", "label")).alias("main")).select(F.col("gid").alias("g"), "main")
    rest = C.settle(many.join(main, F.col("gid") == F.col("g")).where("label != main").select("gid", "rep", "t"))
    if rest.isEmpty():
        return links
    rows = rest.groupBy("gid").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("s")).select(F.col("gid").alias("g"), "s")
    every = lambda last: F.sequence(none, last - 1)
    asks = rest.join(rows, F.col("gid") == F.col("g")).select("gid", F.explode(F.transform(every(F.col("t")), lambda j: C.block_of(["gid", "rep"], F.col("s")) * F.col("t") + j)).alias("u"), one.alias("side"), "rep")
    told = many.join(rows, F.col("gid") == F.col("g")).select("gid", F.explode(F.transform(every(F.col("s")), lambda i: i * F.col("t") + block)).alias("u"), zero.alias("side"), "rep")
    third, _ = _compared(asks.union(told), docs, classes, size, percent, sets=sets)
    return links.union(third.select("a", "b"))


def judge(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document; documents link at ``percent`` per cent similarity or more.

    Null or empty texts have the empty set and link with nothing; a text of fewer than ``size`` words is one shingle; rows
    with one id are one node, each with its own n_shingles; a null id is nobody's component, though its row belongs to
    its class, and is not kept unless alone; repeated rows are alike; other columns are not read; an empty table gives no
    rows.
    """
    C.bound_batches(docs.sparkSession)
    signed = C.settle(_signed(docs, size))
    classes = C.settle(
        signed.where("n > 0 and doc_id is not null").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    )
    linked = components(_edges(docs, classes, size, percent))
    named = classes.join(linked, F.col("rep") == F.col("node"), "left").select(F.col("c1").alias("x1"), F.col("c2").alias("x2"), F.coalesce("component", "rep").alias("found"))
    rows = signed.select("doc_id", "n", "c1", "c2").join(named, (F.col("c1") == F.col("x1")) & (F.col("c2") == F.col("x2")) & (F.col("n") > 0), "left")
    component = F.coalesce("found", "doc_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group that links connect, with the columns of ``docs``: the one with the smallest id.

    Each row is judged by its own text, whatever else has its id; of rows with the first id that are near copies of each
    other one stays, by the hash of its text; null ids come last; of rows that repeat in id and text one stays, by the hash
    of its other columns. Rows without words are nobody's copies, and all stay. Texts of any length are compared whole.
    """
    C.bound_batches(docs.sparkSession)
    signed = C.settle(_signed(docs, size))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "h")
    # a class is a node by its name, as ids may be null or repeat with other texts
    classes = C.settle(
        signed.where("n > 0").groupBy("c1", "c2").agg(F.min(place).alias("at"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).withColumn("rep", F.col("c1"))
    )
    linked = components(_edges(docs, classes, size, percent))
    of = C.settle(classes.join(linked, F.col("rep") == F.col("node"), "left").select(F.col("c1").alias("x1"), F.col("c2").alias("x2"), F.coalesce("component", "rep").alias("of"), "at"))
    first = of.groupBy("of").agg(F.min("at").alias("first")).select(F.col("of").alias("o"), "first")
    named = of.join(first, F.col("of") == F.col("o")).select("x1", "x2", "first")
    places = signed.where("n > 0").groupBy("doc_id", "h", "c1", "c2").agg(F.count("*").alias("m"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))
    gone, rows = f"{C.OWN}gone", f"{C.OWN}rows"
    of_row = C.settle(
        places.join(named, (F.col("c1") == F.col("x1")) & (F.col("c2") == F.col("x2")))
        .where(~kept | (F.col("m") > 1))
        .select(F.col("doc_id").alias(f"{C.OWN}id"), F.col("h").alias(f"{C.OWN}h"), (~kept).alias(gone), F.col("m").alias(rows))
    )
    here = F.col("doc_id").eqNullSafe(F.col(f"{C.OWN}id")) & (_hash(F.col("text")) == F.col(f"{C.OWN}h"))
    if of_row.where(f"not {gone}").isEmpty():
        return docs.join(of_row, here, "left_anti")
    once = docs.join(of_row.where(f"not {gone}"), here).groupBy(f"{C.OWN}id", f"{C.OWN}h")
    whole = F.xxhash64(*(f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()))
    repeated = once.agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), whole).alias(f"{C.OWN}row")).select(f"{C.OWN}row.*")
    return docs.join(of_row, here, "left_anti").union(repeated)
