"""A collection: insert, bulk insert, search, delete, info and inspection over DataFrames.

State is a set of tables under one folder: the log by shard, cuts, tombstones, and snapshots. Reading them again gives the
collection back. A record's node is its number in its shard's log, which never changes. What counts of a log is its valid
prefix: records whose numbers follow each other and whose length and checksum are right. Before an insert, records beyond
it are cut off by a row in ``cuts``, which names the first number cut and the inserts it does not concern, so the numbers go
on from the valid prefix and nothing is rewritten.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.config import CollectionConfig, live_top_k, search_width
from nearfield.operators import hnsw, log, metrics, ring, search
from nearfield.sources import pointer, snapshots

LOG = "shard_id int, lsn long, vec_id long, dim int, crc long, embedding array<float>, metadata string, epoch long"
META = "shard_id int, node_id int, metadata string"
#: A node's name in a search: its shard above its number.
NODE_BITS = 40


def node_key() -> Column:
    return F.shiftleft(F.col("shard_id").cast("long"), NODE_BITS) + F.col("node_id")


class Collection:
    """Vectors of one length, with ids and metadata. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, cfg: CollectionConfig | None = None) -> None:
        self.spark, self.path, self.cfg = spark, path, cfg or CollectionConfig()

    def _there(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if self._there(f"{self.path}/{name}") else self.spark.createDataFrame([], schema)

    def _log_name(self) -> str:
        return pointer.get(self.spark, f"{self.path}/log-current") or "log"

    @property
    def log(self) -> DataFrame:
        """The records as written, without those that were cut off."""
        raw = self._read(self._log_name(), LOG)
        cuts = self._read("cuts", "shard_id int, lsn long, epoch long").select(F.col("shard_id").alias("s"), F.col("lsn").alias("cut"), F.col("epoch").alias("e"))
        return raw.join(F.broadcast(cuts), (F.col("shard_id") == F.col("s")) & (F.col("lsn") >= F.col("cut")) & (F.col("epoch") < F.col("e")), "left_anti")  # a row for each torn end

    def _state(self) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """(nodes of the snapshot and of the log beyond it, graph of the snapshot, numbers it has reached)."""
        root, names = f"{self.path}/snapshots", ["shard_id", "node_id", "vec_id", "embedding", "metadata", "lsn"]
        name = snapshots.current(self.spark, root)
        if name is None:
            saved, edges, upto = None, None, None
        else:
            saved, edges, upto = snapshots.load(self.spark, root, check=False)
            meta = self.spark.read.schema(META).parquet(f"{root}/{name}/meta")
            saved = saved.join(meta, ["shard_id", "node_id"], "left").withColumn("lsn", F.col("node_id").cast("long")).select(*names)
        tail = snapshots.recover(self.log, saved, upto, self.cfg.index.dim).withColumn("node_id", F.col("lsn").cast("int")).select(*names)
        return (tail if saved is None else saved.union(tail)), edges, upto

    def _alive(self, nodes: DataFrame) -> DataFrame:
        dead = self._read("tombstones", "vec_id long, shard_id int, lsn long").groupBy("vec_id").agg(F.max("lsn").alias("dead"))
        return nodes.join(dead, "vec_id", "left").where(F.col("dead").isNull() | (F.col("lsn") >= F.col("dead"))).select("shard_id", "node_id", "vec_id", "embedding", "metadata", "lsn")

    @property
    def vectors(self) -> DataFrame:
        """shard_id, node_id, vec_id, embedding, metadata, lsn of all vectors that were inserted and not deleted since."""
        return self._alive(self._state()[0])

    def _ends(self) -> DataFrame:
        """shard_id, end: the next number of each shard's valid log."""
        root = f"{self.path}/snapshots"
        upto = snapshots.load(self.spark, root, check=False)[2] if snapshots.current(self.spark, root) is not None else None
        start = None if upto is None else upto.select("shard_id", (F.col("max_lsn") + 1).alias("start"))
        ends = log.prefix_end(self.log, log.record_ok(self.cfg.index.dim), ["shard_id"], start).select("shard_id", "end")
        if start is not None:  # shards whose log is empty since
            ends = ends.union(start.select("shard_id", F.col("start").alias("end"))).groupBy("shard_id").agg(F.max("end").alias("end"))
        return ends

    def bulk_insert(self, rows: DataFrame) -> dict:
        """Insert (vec_id, embedding[, metadata]); rows with a missing or wrong vector are counted as failed."""
        began = time.time()
        if "metadata" not in rows.columns:
            rows = rows.withColumn("metadata", F.lit(None).cast("string"))
        good, bad = log.split_valid(rows.select("vec_id", "embedding", "metadata"), self.cfg.index.dim)
        ends = {r.shard_id: r.end for r in self._ends().collect()}  # a row a shard
        base = self.spark.createDataFrame([(s, int(e)) for s, e in ends.items()], "shard_id int, __base long")
        seen = self.log.join(F.broadcast(base), "shard_id", "left")
        top = max(self._read(self._log_name(), LOG).agg(F.max("epoch")).first()[0] or 0, self._read("cuts", "shard_id int, lsn long, epoch long").agg(F.max("epoch")).first()[0] or 0)
        torn = [r.shard_id for r in seen.where("lsn >= coalesce(__base, 0)").select("shard_id").distinct().collect()]
        if torn:
            self.spark.createDataFrame([(s, int(ends.get(s, 0)), top + 1) for s in torn], "shard_id int, lsn long, epoch long").coalesce(1).write.mode("append").parquet(f"{self.path}/cuts")
        total = sum(ends.values())
        staged = f"{self.path}/requests/{uuid.uuid4().hex}"  # the order of arrival is settled before it is read more than once
        good.withColumn("__o", F.monotonically_increasing_id()).write.parquet(staged)
        good = self.spark.read.schema("vec_id long, embedding array<float>, metadata string, __o long").parquet(staged)
        filled = log.fill_ids(good, "__o", total)
        routed = filled.withColumn("shard_id", ring.owner(F.col("vec_id"), self.cfg.shards, self.cfg.vnodes))
        placed = log.numbered(routed, "__o", "__pos", ["shard_id"]).join(F.broadcast(base), "shard_id", "left")  # a row a shard
        out = placed.select(
            "shard_id", (F.col("__pos") + F.coalesce("__base", F.lit(0))).alias("lsn"), "vec_id", F.size("embedding").alias("dim"), log.crc32_f32(F.col("embedding")).alias("crc"), "embedding", "metadata", F.lit(top + 1).alias("epoch")
        )
        out.write.mode("append").partitionBy("shard_id").parquet(f"{self.path}/{self._log_name()}")
        made = self._read(self._log_name(), LOG).where(F.col("epoch") == top + 1).count()
        return {"inserted": made, "failed": bad.count(), "latency_us": int((time.time() - began) * 1e6)}

    def insert(self, vec_id: int | None, vector: list[float], metadata: str | None = None) -> dict:
        row = self.spark.createDataFrame([(vec_id, [float(x) for x in vector], metadata)], "vec_id long, embedding array<float>, metadata string")
        return self.bulk_insert(row)

    def delete(self, vec_ids: DataFrame) -> DataFrame:
        """vec_id, found. Later inserts of an id are not affected."""
        found = log.found(vec_ids, self.vectors)
        name = f"requests/{uuid.uuid4().hex}"  # what was found is settled before the tombstones change it
        found.write.parquet(f"{self.path}/{name}")
        found = self.spark.read.schema(found.schema).parquet(f"{self.path}/{name}")
        routed = found.where("found").select("vec_id").withColumn("shard_id", ring.owner(F.col("vec_id"), self.cfg.shards, self.cfg.vnodes))
        ends = self._ends().select("shard_id", F.col("end").alias("lsn"))
        routed.join(F.broadcast(ends), "shard_id").select("vec_id", "shard_id", "lsn").write.mode("append").parquet(f"{self.path}/tombstones")  # a row a shard
        return found

    def search(
        self, queries: DataFrame, k: int | None = None, metric: str = "l2", mode: str = "exact", ef: int | None = None, where: Column | None = None, health: DataFrame | None = None
    ) -> DataFrame:
        """qid, rank, vec_id, shard_id, node_id, distance, metadata of the nearest to each query of (qid, query).

        ``health`` (shard_id, healthy): only healthy shards answer. With mode hnsw the stored graph of the snapshot is walked,
        and what the log has beyond it is searched exactly; without a snapshot a graph is built for the call.
        """
        k = live_top_k(k, self.cfg.top_k, self.cfg.most_top_k)
        nodes, edges, upto = self._state()
        alive = self._alive(nodes)
        if where is not None:
            alive = alive.where(where)
        if health is not None:
            alive = search.healthy_only(alive, health)
        keyed = alive.select(node_key().alias("vec_id"), "embedding", "shard_id", "lsn")
        if mode == "exact":
            found = search.batch_partials(keyed, queries, k, metric)
        elif mode == "hnsw":
            width = search_width(ef, self.cfg.index.ef_search, k)
            if edges is None:
                edges, stored, tail = hnsw.build(alive, self.cfg.index), alive, keyed.limit(0)
            else:
                beyond = upto.select("shard_id", "max_lsn")
                old = nodes.join(F.broadcast(beyond), "shard_id").where("lsn <= max_lsn").select("shard_id", "node_id", "vec_id", "embedding")  # a row a shard
                live = alive.select("shard_id", "node_id", F.lit(True).alias("live"))
                stored = old.join(live, ["shard_id", "node_id"], "left").withColumn("live", F.coalesce("live", F.lit(False)))
                tail = keyed.join(F.broadcast(beyond), "shard_id", "left").where("max_lsn is null or lsn > max_lsn")  # a row a shard
            walked = hnsw.partials(stored, edges, queries, k, self.cfg.index, width).select("qid", node_key().alias("vec_id"), "d")
            found = walked.union(search.batch_partials(tail, queries, k, "l2"))
            metric = "l2"
        else:
            raise ValueError(f"no search mode {mode}")
        near = search.merge(found, k, metric).withColumnRenamed("vec_id", "key")
        about = alive.select(node_key().alias("n"), "vec_id", "shard_id", "node_id", "metadata")
        return near.join(about, F.col("key") == F.col("n")).select("qid", "rank", "vec_id", "shard_id", "node_id", "distance", "metadata")

    def snapshot(self, truncate: bool = False) -> str:
        """Write vectors, graph and the log numbers reached as a new version; returns its name.

        With ``truncate`` the log then begins anew after the numbers reached. A failure between the two loses nothing, as
        replay only takes records beyond the snapshot.
        """
        v = self.vectors
        ends = self._ends().select("shard_id", (F.col("end") - 1).alias("lsn"))
        root, name = f"{self.path}/snapshots", f"v-{uuid.uuid4().hex}"
        meta = v.select("shard_id", "node_id", "metadata")
        snapshots.save(v, hnsw.build(v, self.cfg.index), ends, root, name, {"meta": meta})
        if truncate:
            fresh = f"log-{uuid.uuid4().hex}"
            upto = ends.select("shard_id", F.col("lsn").alias("__upto"))
            left = self.log.join(F.broadcast(upto), "shard_id", "left").where("__upto is null or lsn > __upto").drop("__upto")  # a row a shard
            left.select(*[c.split()[0] for c in LOG.split(", ")]).write.partitionBy("shard_id").parquet(f"{self.path}/{fresh}")
            pointer.put(self.spark, f"{self.path}/log-current", fresh)
        return name

    def restore(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Vectors and graph of the current snapshot, and what the log has beyond it; without one, all of the log."""
        root, dim = f"{self.path}/snapshots", self.cfg.index.dim
        if snapshots.current(self.spark, root) is None:
            none = self.spark.createDataFrame([], snapshots.segments.SCHEMA), self.spark.createDataFrame([], hnsw.EDGES)
            return *none, snapshots.recover(self.log, None, None, dim)
        v, edges, upto = snapshots.load(self.spark, root)
        return v, edges, snapshots.recover(self.log, v, upto, dim)

    def node(self, node_id: int, shard_id: int = 0) -> DataFrame:
        """Inspect a node of the current snapshot. Raises for a shard or a node that does not exist."""
        self._check(shard_id)
        v, edges, _ = self.restore()
        return hnsw.inspect(v, edges, node_id, shard_id)

    def _check(self, shard_id: int) -> None:
        if not 0 <= shard_id < self.cfg.shards:
            raise IndexError(f"no shard {shard_id}")

    def shard_size(self, shard_id: int) -> int:
        """Vectors of a shard; raises IndexError for one that the configuration does not have."""
        self._check(shard_id)
        return self.vectors.where(F.col("shard_id") == shard_id).count()

    def wal(self) -> DataFrame:
        """shard_id, current_lsn, checkpoint_lsn, dim, bytes of each shard's log."""
        good = log.contiguous_prefix(self.log, log.record_ok(self.cfg.index.dim), ["shard_id"], self._starts())
        sizes = good.groupBy("shard_id").agg(F.sum(F.size("embedding") * 4 + 24).alias("b"))
        every = self.spark.range(self.cfg.shards).select(F.col("id").cast("int").alias("shard_id"))
        got = every.join(self._ends(), "shard_id", "left").join(sizes, "shard_id", "left").withColumn("current_lsn", F.coalesce("end", F.lit(0)))
        return got.select("shard_id", "current_lsn", log.checkpoint_lsn(F.col("current_lsn"), self.cfg.checkpoint_every).alias("checkpoint_lsn"), F.lit(self.cfg.index.dim).alias("dim"), F.coalesce("b", F.lit(0)).alias("bytes"))

    def _starts(self) -> DataFrame | None:
        root = f"{self.path}/snapshots"
        if snapshots.current(self.spark, root) is None:
            return None
        return snapshots.load(self.spark, root, check=False)[2].select("shard_id", (F.col("max_lsn") + 1).alias("start"))

    def info(self, health: DataFrame | None = None) -> DataFrame:
        """shard_id, n, status of every shard, and the collection's total and dimension."""
        loads = ring.load(self.vectors, self.cfg.shards)
        if health is not None:
            loads = loads.join(F.broadcast(health), "shard_id", "left")  # a row a shard
        status = metrics.status(F.lit(True) if health is None else F.coalesce("healthy", F.lit(False)))
        total = F.sum("n").over(Window.partitionBy())
        return loads.select("shard_id", "n", status.alias("status"), total.alias("total_vectors"), F.lit(self.cfg.index.dim).alias("dim"))

    def health(self) -> DataFrame:
        return self.spark.range(1).select(F.to_json(F.struct(F.lit("ok").alias("status"), metrics.iso_utc(F.current_timestamp()).alias("time"))).alias("health"))
