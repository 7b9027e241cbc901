"""A navigable small-world graph per shard: build, search and inspection.

Insertion depends on what was inserted before, so a shard's graph is built in one task, in the order of its log; more
shards build in parallel. Layers are drawn from a hash of the id, so builds agree.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.config import IndexConfig
from nearfield.functions.hashing import fnv_long_array
from nearfield.operators.log import numbered


def layer_of(ids: np.ndarray, m: int, max_layers: int, seed: int = 0) -> np.ndarray:
    """min(floor(-ln(u) / ln m), max_layers - 1) with u in [0, 1) from a hash of the id."""
    u = (fnv_long_array(ids ^ np.int64(seed)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.minimum((-np.log(u + 1e-15) / math.log(m)).astype(np.int64), max_layers - 1)


class Graph:
    """Adjacency by layer, over a matrix of vectors."""

    def __init__(self, x: np.ndarray, cfg: IndexConfig) -> None:
        self.x, self.cfg = x, cfg
        self.near: list[dict[int, list[int]]] = [{} for _ in range(cfg.max_layers)]
        self.entry, self.top, self.n = -1, -1, 0

    def dist(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        d = self.x[nodes] - q
        return np.einsum("ij,ij->i", d, d)

    def descend(self, q: np.ndarray, node: int, layer: int) -> int:
        best = float(self.dist(q, [node])[0])
        while nbrs := self.near[layer].get(node):
            d = self.dist(q, nbrs)
            i = int(d.argmin())
            if d[i] >= best:
                break
            node, best = nbrs[i], float(d[i])
        return node

    def beam(self, q: np.ndarray, node: int, ef: int, layer: int) -> list[tuple[float, int]]:
        d = float(self.dist(q, [node])[0])
        seen, todo, kept = {node}, [(d, node)], [(-d, -node)]
        while todo:
            d, c = heapq.heappop(todo)
            if len(kept) >= ef and d > -kept[0][0]:
                break
            new = [v for v in self.near[layer].get(c, ()) if v not in seen]
            if not new:
                continue
            seen.update(new)
            for dv, v in zip(self.dist(q, new).tolist(), new, strict=True):
                if len(kept) < ef or dv < -kept[0][0]:
                    heapq.heappush(todo, (dv, v))
                    heapq.heappush(kept, (-dv, -v))
                    if len(kept) > ef:
                        heapq.heappop(kept)
        return sorted((-d, -v) for d, v in kept)

    def insert(self, node: int, layer: int) -> None:
        self.n += 1
        if self.entry < 0:
            self.entry, self.top = node, layer
            return
        q, at = self.x[node], self.entry
        for up in range(self.top, layer, -1):
            at = self.descend(q, at, up)
        for lay in range(min(layer, self.top), -1, -1):
            most = self.cfg.m_max0 if lay == 0 else self.cfg.m
            got = self.beam(q, at, self.cfg.ef_construction, lay)
            at = got[0][1]
            chosen = [v for _, v in got[: self.cfg.m]]
            self.near[lay][node] = chosen
            for v in chosen:
                own = self.near[lay].setdefault(v, [])
                own.append(node)
                if len(own) > most:
                    d = self.dist(self.x[v], own)
                    self.near[lay][v] = [own[i] for i in np.lexsort((own, d))[:most]]
        if layer > self.top:
            self.entry, self.top = node, layer

    def search(self, q: np.ndarray, k: int, ef: int, live: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The k nearest found; nodes that are not ``live`` are walked through, and the beam widens until k others are found."""
        if self.entry < 0:
            return []
        at, width = self.entry, max(ef, k)
        for up in range(self.top, 0, -1):
            at = self.descend(q, at, up)
        while True:
            got = self.beam(q, at, width, 0)
            if live is None:
                return got[:k]
            alive = [x for x in got if live[x[1]]]
            if len(alive) >= k or len(got) < width:
                return alive[:k]
            width *= 4


def build_graph(ids: np.ndarray, x: np.ndarray, cfg: IndexConfig) -> Graph:
    g = Graph(x, cfg)
    for i, layer in enumerate(layer_of(ids, cfg.m, cfg.max_layers).tolist()):
        g.insert(i, layer)
    return g


EDGES = "shard_id int, node_id int, vec_id long, layer int, neighbours array<int>, is_entry boolean, max_layer int"


def build(vectors: DataFrame, cfg: IndexConfig) -> DataFrame:
    """shard_id, node_id, vec_id, layer, neighbours, is_entry, max_layer from (shard_id, node_id, vec_id, embedding)."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("node_id")
        g = build_graph(t.vec_id.to_numpy(), np.stack(t.embedding.to_list()).astype(np.float64), cfg)
        ids, nodes, shard = t.vec_id.to_numpy(), t.node_id.to_numpy(), int(t.shard_id.iloc[0])
        rows = [(shard, int(nodes[n]), int(ids[n]), lay, nodes[g.near[lay].get(n, [])].tolist(), n == g.entry, g.top) for lay in range(g.top + 1) for n in range(g.n) if lay == 0 or n in g.near[lay]]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in EDGES.split(", ")])

    return vectors.select("shard_id", "node_id", "vec_id", "embedding").groupBy("shard_id").applyInPandas(run, EDGES)


#: Queries that one task walks a shard's graph for.
QUERY_BLOCK = 1024


def partials(vectors: DataFrame, edges: DataFrame, queries: DataFrame, k: int, cfg: IndexConfig, ef: int | None = None) -> DataFrame:
    """qid, shard_id, node_id, vec_id, d: what each shard's graph gives for each query of (qid, query).

    The graph is read as it is stored, and a task walks it for a block of queries. Of ``vectors`` with a column ``live``, those
    that are not are walked through and not returned.
    """
    width = max(ef or cfg.ef_search, k)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block")
    shards = [r[0] for r in edges.select("shard_id").distinct().collect()]  # as many as the configuration has
    asked = queries.select("qid", "query", block, F.explode(F.array(*[F.lit(x) for x in shards]) if shards else F.expr("cast(array() as array<int>)")).alias("shard_id"))
    nested = edges.groupBy("shard_id", "node_id").agg(F.collect_list(F.struct("layer", "neighbours")).alias("adj"), F.max("is_entry").alias("is_entry"), F.max("max_layer").alias("max_layer"))
    live = F.col("live") if "live" in vectors.columns else F.lit(True)
    stored = nested.join(vectors.select("shard_id", "node_id", "vec_id", "embedding", live.alias("live")), ["shard_id", "node_id"])
    stored = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(t: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(t) and len(q):
            t = t.sort_values("node_id")
            g, nodes = Graph(np.stack(t.embedding.to_list()).astype(np.float64), cfg), t.node_id.to_numpy()
            for n, adj in enumerate(t.adj):
                for a in adj:
                    g.near[a["layer"]][n] = np.searchsorted(nodes, a["neighbours"]).tolist()
            g.n, g.top = len(t), int(t.max_layer.max())
            g.entry = int(np.flatnonzero(t.is_entry.to_numpy())[0])
            ids, shard, alive = t.vec_id.to_numpy(), int(t.shard_id.iloc[0]), t.live.to_numpy(bool)
            alive = None if alive.all() else alive
            for qid, v in zip(q.qid, q["query"], strict=True):
                out += [(qid, shard, int(nodes[n]), int(ids[n]), d) for d, n in g.search(np.asarray(v, np.float64), k, width, alive)]
        kinds = {"qid": "int64", "shard_id": "int32", "node_id": "int32", "vec_id": "int64", "d": "float64"}
        return pd.DataFrame(out, columns=list(kinds)).astype(kinds)

    return stored.groupBy("shard_id", "block").cogroup(asked.groupBy("shard_id", "block")).applyInPandas(run, "qid long, shard_id int, node_id int, vec_id long, d double")


def search(vectors: DataFrame, edges: DataFrame, queries: DataFrame, k: int, cfg: IndexConfig, ef: int | None = None) -> DataFrame:
    """qid, rank, vec_id, distance: each shard's graph is walked for every query, and the shards' results are merged."""
    from nearfield.operators.search import merge

    return merge(partials(vectors, edges, queries, k, cfg, ef).select("qid", "vec_id", "d"), k)


def inspect(vectors: DataFrame, edges: DataFrame, node_id: int, shard_id: int = 0) -> DataFrame:
    """One node: preview of its vector, the graph's top layer, and its neighbours by layer. Raises if there is none."""
    from nearfield.functions.vectors import preview

    at = (F.col("shard_id") == shard_id) & (F.col("node_id") == node_id)
    own = vectors.where(at).select("vec_id", preview(F.col("embedding")).alias("preview"))
    if own.isEmpty():
        raise LookupError(f"no node {node_id} on shard {shard_id}")
    layers = edges.where(at).agg(F.max("max_layer").alias("max_layer"), F.array_sort(F.collect_list(F.struct("layer", "neighbours"))).alias("layers"))
    return own.crossJoin(layers)


def with_nodes(routed: DataFrame, order: str) -> DataFrame:
    """node_id: position of each vector on its shard."""
    return numbered(routed, order, "node_id", ["shard_id"]).withColumn("node_id", F.col("node_id").cast("int"))
