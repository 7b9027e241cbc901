"""Exact search: one query, batches, shards and merge, thresholds, graphs and quality measures.

One query is a projection and a top-k that never sorts the table. A batch of few queries is broadcast, behind a check of
their number; more of them meet the vectors in executors, block by block. Either way a task holds a block of queries and
keeps the k nearest of what it reads for each, so k rows a query and task are shuffled, however many pairs there are.
Ranking is on squared distances, ties by vec_id; roots are taken last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.vectors import TINY, cosine_distance, l2_sq

#: Most queries that are broadcast, and distances held at a time.
QUERY_BLOCK = 4096
CELLS = 1 << 21
#: Queries that are compared at a time: the fewer, the more vectors at a time, each list's bound being known before.
TILE = 512
#: Numbers in the block of queries that a task holds, and vectors that it reads for them, where both meet in executors.
HELD, READ = 1 << 20, 1 << 18


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as rows in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, metric: str, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, distance, id) of at least the k nearest rows to each query, or of those not beyond its ``bound``.

    One matrix product tells which rows can be among them; their distances are then summed directly, so that equal
    vectors have equal distances wherever they stand.
    """
    qq, xx = (q * q).sum(axis=1), (x * x).sum(axis=1)
    if metric == "l2":
        rough = q @ x.T
        rough *= -2
        rough += qq[:, None]
        rough += xx[None, :]
        most = 2 * (qq + xx[np.isfinite(xx)].max(initial=0))  # no finite distance is beyond it
    else:
        size = np.sqrt(qq)[:, None] * np.sqrt(xx)[None, :]
        rough = np.where(size < TINY, 1.0, 1.0 - (q @ x.T) / np.where(size < TINY, 1.0, size))
        most = 2.0
    worst = np.full(len(q), np.inf) if bound is None else bound.copy()
    free = np.flatnonzero(~(worst < np.inf))
    if rough.shape[1] > k and len(free):
        kth = np.partition(rough[free], k - 1, axis=1)[:, k - 1]
        worst[free] = np.where(np.isnan(kth), np.inf, kth)
    near = rough <= (worst + 1e-9 * (1 + most))[:, None]
    if rough.shape[1] <= k:
        near[free] = True
    i, j = np.nonzero(near)
    a, b = q[i], x[j]
    if metric == "l2":
        return i, ((b - a) ** 2).sum(axis=1), ids[j]
    size = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    return i, np.where(size < TINY, 1.0, 1.0 - (a * b).sum(axis=1) / np.where(size < TINY, 1.0, size)), ids[j]


def bounds(have: tuple[np.ndarray, np.ndarray, np.ndarray] | None, n: int, k: int) -> np.ndarray:
    """The k-th distance of each of ``n`` queries in a list of (query, distance, id) as ``keep_nearest`` gives; inf if fewer."""
    out = np.full(n, np.inf)
    if have is not None:
        i, d, _ = have
        last = np.searchsorted(i, np.arange(n), "right") - 1
        full = np.bincount(i, minlength=n) >= k
        out[full] = d[last[full]]
    return out


def keep_nearest(have: tuple | None, new: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least of each query by (distance, id), of two lists of (query, distance, id)."""
    i, d, v = new if have is None else (np.concatenate(x) for x in zip(have, new, strict=True))
    order = np.lexsort((v, d, i))
    i, d, v = i[order], d[order], v[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return tuple(x[rank < k] for x in (i, d, v))


def top_k(vectors: DataFrame, query: list[float], k: int, metric: str = "l2") -> DataFrame:
    """rank, vec_id, distance of the k nearest to one query."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = l2_sq(F.col("embedding"), q) if metric == "l2" else cosine_distance(F.col("embedding"), q)
    near = vectors.select("vec_id", d.alias("d")).orderBy("d", "vec_id").limit(k)
    out = F.sqrt("d") if metric == "l2" else F.col("d")
    return near.select(F.row_number().over(Window.orderBy("d", "vec_id")).alias("rank"), "vec_id", out.alias("distance"))


Fold = Callable[[np.ndarray, np.ndarray, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _few(queries: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The queries (qid, query), if there are at most ``most``; no more than one beyond that comes to the driver."""
    t = queries.select("qid", "query").limit(most + 1).toArrow().combine_chunks()
    if t.num_rows > most:
        return None
    col = t.column("query")
    return t.column("qid").to_numpy(), matrix(col.combine_chunks())


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Sorted batches of (unit, side, ...) cut where the unit or side changes, without those two columns."""
    for b in batches:
        unit, side = b.column(0).to_numpy(), b.column(1).to_numpy()
        edges = np.flatnonzero((np.diff(unit) != 0) | (np.diff(side) != 0)) + 1
        rest = b.select(range(2, b.num_columns))
        for lo, hi in pairwise([0, *edges.tolist(), b.num_rows]):
            if hi > lo:
                yield (int(unit[lo]), int(side[lo])), rest.slice(lo, hi - lo)


def _meet(vectors: DataFrame, queries: DataFrame, fold: Fold, schema: str, by: str | None = None) -> DataFrame:
    """``fold`` of every query of (qid, query) with every vector, a block of queries and a run of vectors at a time.

    The vectors are (vec_id, embedding[, ``by``]). Few queries are broadcast and the vectors stay where they are. Otherwise
    both are dealt by hashes of their ids to units of a block of each; a task sorts its units, holds the queries of one and
    reads its vectors past them. A vector is shuffled once for each block of queries, and no pair is.
    """
    spark = vectors.sparkSession
    given = _few(queries, QUERY_BLOCK)
    vectors = vectors.select("vec_id", "embedding", *([by] if by else []))
    if given is not None:
        if not len(given[0]):
            return spark.createDataFrame([], schema)
        sent = spark.sparkContext.broadcast(given)  # QUERY_BLOCK rows at most
        return vectors.mapInArrow(lambda batches: fold(*sent.value, batches), schema)
    n, dim = queries.agg(F.count("*"), F.max(F.size("query"))).first()
    cores = spark.sparkContext.defaultParallelism
    q_blocks = max(1, -(-n * max(1, dim) // HELD))
    v_blocks = max(1, -(-vectors.count() // READ), -(-2 * cores // q_blocks))
    mine, theirs = F.pmod(F.xxhash64("qid"), F.lit(q_blocks)), F.pmod(F.xxhash64("vec_id"), F.lit(v_blocks))
    grp = F.col(by).cast("long") if by else F.lit(0).cast("long")
    left = queries.select(
        F.explode(F.sequence(mine * v_blocks, mine * v_blocks + v_blocks - 1)).alias("unit"), F.lit(0).alias("side"), F.col("qid").cast("long").alias("id"), F.col("query").alias("v"), F.lit(0).cast("long").alias("grp")
    )
    right = vectors.select(F.explode(F.sequence(theirs, theirs + (q_blocks - 1) * v_blocks, F.lit(v_blocks).cast("long"))).alias("unit"), F.lit(1).alias("side"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"), grp.alias("grp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ids, q = None, None, None
        for (u, side), pieces in groupby(_pieces(batches), key=lambda p: p[0]):
            if side == 0:
                held = [b for _, b in pieces]
                unit, ids, q = u, np.concatenate([b.column(0).to_numpy() for b in held]), np.concatenate([matrix(b.column(1)) for b in held])
            elif u == unit:
                yield from fold(ids, q, (b for _, b in pieces))

    tasks = max(cores, min(q_blocks * v_blocks, 1 << 15))  # a task takes its units one after the other
    return left.unionByName(right).repartition(tasks, "unit").sortWithinPartitions("unit", "side").mapInArrow(run, schema)


def batch_partials(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", by: str | None = None) -> DataFrame:
    """qid, (by,) vec_id, d: for each query the k nearest of each task (and of each value of ``by``)."""

    def fold(ids: np.ndarray, q: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for b in batches:
            x, v = matrix(b.column(1)), b.column(0).to_numpy()
            group = b.column(2).to_numpy() if by else np.zeros(len(v), np.int64)
            for g in np.unique(group).tolist():
                at = np.flatnonzero(group == g)
                step = max(k, CELLS // min(len(ids), TILE))
                for lo in range(0, len(at), step):
                    rows = at[lo : lo + step]
                    xs, vs = x[rows], v[rows]
                    for t in range(0, len(ids), TILE):
                        qs, have = q[t : t + TILE], best.get((g, t))
                        best[g, t] = keep_nearest(have, nearest(xs, vs, qs, k, metric, bounds(have, len(qs), k)), k)
        for (g, t), (i, d, w) in best.items():
            cols = [ids[t + i], w] + ([np.full(len(i), g)] if by else []) + [d]
            yield pa.record_batch([pa.array(c) for c in cols], ["qid", "vec_id"] + ["grp"] * bool(by) + ["d"])

    return _meet(vectors, queries, fold, f"qid long, vec_id long, {'grp long, ' if by else ''}d double", by)


def merge(partials: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """qid, rank, vec_id, distance: the k nearest over all tasks and shards."""
    w = Window.partitionBy("qid").orderBy("d", "vec_id")
    out = F.sqrt("d") if metric == "l2" else F.col("d")
    return partials.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "vec_id", out.alias("distance"))


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """qid, rank, vec_id, distance of the k nearest to each query of (qid, query)."""
    return merge(batch_partials(vectors, queries, k, metric), k, metric)


def shard_top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """qid, shard_id, rank, vec_id, d: each shard's own k nearest, as a coordinator gathers them."""
    w = Window.partitionBy("qid", "shard_id").orderBy("d", "vec_id")
    part = batch_partials(vectors, queries, k, metric, by="shard_id").withColumnRenamed("grp", "shard_id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def envelope(health: DataFrame, strict: bool = False) -> DataFrame:
    """shards_ok, shards_err, degraded from (shard_id, healthy).

    A shard that is down counts as an error. With ``strict`` it gives no rows but counts as answered, as a coordinator
    does that only notices failures while it asks."""
    ok = F.count("*") if strict else F.count_if(F.col("healthy"))
    err = F.lit(0).cast("long") if strict else F.count_if(~F.col("healthy"))
    return health.agg(ok.alias("shards_ok"), err.alias("shards_err")).withColumn("degraded", F.col("shards_err") > 0)


def healthy_only(vectors: DataFrame, health: DataFrame) -> DataFrame:
    """The vectors of shards that (shard_id, healthy) tells to be healthy; a shard it does not tell of gives none."""
    return vectors.join(F.broadcast(health.where("healthy").select("shard_id").distinct()), "shard_id", "left_semi")  # a row a shard


def pairs_within(vectors: DataFrame, most_d2: float) -> DataFrame:
    """a, b, d2 for a < b at a squared distance below ``most_d2``; the table meets itself in blocks."""

    def fold(ids: np.ndarray, q: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qq = (q * q).sum(axis=1)
        step = max(1, CELLS // len(ids))
        for b in batches:
            x, v = matrix(b.column(1)), b.column(0).to_numpy()
            for lo in range(0, len(v), step):
                xs, vs = x[lo : lo + step], v[lo : lo + step]
                rough = (xs * xs).sum(axis=1)[:, None] + qq[None, :] - 2 * xs @ q.T
                i, j = np.nonzero((rough < most_d2 + 1e-6) & (vs[:, None] > ids[None, :]))
                d = ((xs[i] - q[j]) ** 2).sum(axis=1)
                ok = d < most_d2
                yield pa.record_batch([pa.array(ids[j[ok]]), pa.array(vs[i[ok]]), pa.array(d[ok])], ["a", "b", "d2"])

    return _meet(vectors, vectors.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query")), fold, "a long, b long, d2 double")


def knn_graph(vectors: DataFrame, k: int) -> DataFrame:
    """node, rank, nbr, d2: each vector's k nearest others."""
    q = vectors.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    part = batch_partials(vectors, q, k + 1).where("qid != vec_id")
    w = Window.partitionBy("qid").orderBy("d", "vec_id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("qid").alias("node"), "rank", F.col("vec_id").alias("nbr"), F.col("d").alias("d2"))


def prune(edges: DataFrame, most: int) -> DataFrame:
    """At most ``most`` nearest neighbours of each node and layer, by (d2, nbr)."""
    keys = ["node", "layer"] if "layer" in edges.columns else ["node"]
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("d2", "nbr"))).where(F.col("rank") <= most)


def recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """qid, recall: the share of true results found; 1 where there are none."""
    hits = truth.select("qid", "vec_id").join(found.select("qid", "vec_id").withColumn("hit", F.lit(1)).distinct(), ["qid", "vec_id"], "left")
    return hits.groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))


def recall_by_distance(truth: DataFrame, found: DataFrame, factor: float = 2.0) -> DataFrame:
    """qid, recall: the share of found results whose squared distance is within ``factor`` of the true k-th."""
    worst = truth.groupBy("qid").agg(F.max(F.col("distance") * F.col("distance")).alias("d2k"))
    return found.join(worst, "qid").groupBy("qid").agg(F.avg(F.when(F.col("distance") * F.col("distance") <= factor * F.col("d2k") + 1e-12, 1.0).otherwise(0.0)).alias("recall"))


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """by, centroid: element-wise means."""
    each = vectors.select(by, F.posexplode("embedding").alias("i", "x"))
    mean = each.groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))
