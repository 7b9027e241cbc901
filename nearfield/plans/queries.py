"""The registered queries over the driver's tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield import functions as V
from nearfield.config import IndexConfig
from nearfield.operators import admission, hnsw, log, lsh, metrics, ring, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def asked(v: DataFrame) -> DataFrame:
    """The queries of all searches: every row whose id is divisible by 20."""
    return v.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))


def r6(c) -> F.Column:
    return F.round(c, 6)


#: Events as latencies: value in tenths of a microsecond.
def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", (F.col("value") * 10).alias("us"))


D = "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
COS = "1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
HALF = "list_distance(a.embedding[1:32]::DOUBLE[], b.embedding[1:32]::DOUBLE[])"
HASH_TEXT = "list_reduce(list_prepend(14695981039346656037::HUGEINT, {0}), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"
HASH = HASH_TEXT.format("[((({0}) >> (8*i)) & 255)::HUGEINT for i in range(8)]")
TEXT_HASH = HASH_TEXT.format("[('0x' || x)::HUGEINT for x in regexp_extract_all(hex({0}), '..')]")


def ring_sql(shards: int, name: str = "r") -> str:
    return f"{name} AS (SELECT {HASH.format('(s << 32) + v')} AS h, s AS shard_id FROM range({shards}) a(s), range(150) b(v))"


def owner_sql(key: str, name: str = "r") -> str:
    """A shard by hash ``key`` of table k, as a scalar subquery by ordered lookup."""
    return f"coalesce((SELECT arg_min(shard_id, h) FROM {name} WHERE {name}.h >= {key}), (SELECT arg_min(shard_id, h) FROM {name}))"


# --- search -----------------------------------------------------------------------------------------------------------


@query(f"SELECT row_number() OVER (ORDER BY {D}, b.vec_id) AS rank, b.vec_id, round({D}, 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id = 0 QUALIFY rank <= 10")
def knn_single_l2(spark, d):
    v = vectors(spark, d)
    q = v.where("vec_id = 0").select("embedding").first()[0]
    return search.top_k(v, list(q), 10).withColumn("distance", r6("distance"))


def _batch_sql(dist: str, k: int, where: str = "true") -> str:
    return f"SELECT a.vec_id AS qid, row_number() OVER (PARTITION BY a.vec_id ORDER BY {dist}, b.vec_id) AS rank, b.vec_id, round({dist}, 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND {where} QUALIFY rank <= {k}"


@query(_batch_sql(D, 10))
def knn_batch_l2(spark, d):
    v = vectors(spark, d)
    return search.batch_top_k(v, asked(v), 10).withColumn("distance", r6("distance"))


@query(_batch_sql(COS, 10))
def knn_batch_cosine(spark, d):
    v = vectors(spark, d)
    return search.batch_top_k(v, asked(v), 10, "cosine").withColumn("distance", r6("distance"))


@query(_batch_sql(D, 5, "b.label = 3"))
def knn_filtered_label(spark, d):
    v = vectors(spark, d)
    return search.batch_top_k(v.where("label = 3"), asked(v), 5).withColumn("distance", r6("distance"))


@query(
    f"WITH {ring_sql(3)}, o AS (SELECT vec_id, embedding, {owner_sql(HASH.format('vec_id'))} AS shard_id FROM embeddings), "
    f"p AS (SELECT a.vec_id AS qid, b.shard_id, b.vec_id, {D} AS d FROM o a, o b WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id, b.shard_id ORDER BY {D}, b.vec_id) <= 5) "
    "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank, vec_id, shard_id::INT AS shard_id, round(d, 6) AS distance FROM p QUALIFY rank <= 5"
)
def knn_shard_merge(spark, d):
    v = vectors(spark, d).withColumn("shard_id", ring.owner(F.col("vec_id"), 3).cast("long"))
    part = search.shard_top_k(v, asked(v), 5)
    w = Window.partitionBy("qid").orderBy("d", "vec_id")
    return part.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("qid", "rank", "vec_id", F.col("shard_id").cast("int").alias("shard_id"), r6(F.sqrt("d")).alias("distance"))


@query(
    f"WITH {ring_sql(3)}, o AS (SELECT vec_id, embedding, {owner_sql(HASH.format('vec_id'))} AS shard_id FROM embeddings) "
    f"SELECT a.vec_id AS qid, row_number() OVER (PARTITION BY a.vec_id ORDER BY {D}, b.vec_id) AS rank, b.vec_id, round({D}, 6) AS distance FROM embeddings a, o b WHERE a.vec_id % 20 = 0 AND b.shard_id != 1 QUALIFY rank <= 10"
)
def knn_healthy_shards(spark, d):
    """A shard that is down gives no rows."""
    v = vectors(spark, d)
    sharded = v.withColumn("shard_id", ring.owner(F.col("vec_id"), 3))
    health = spark.range(3).select(F.col("id").cast("int").alias("shard_id"), (F.col("id") != 1).alias("healthy"))
    return search.batch_top_k(search.healthy_only(sharded, health), asked(v), 10).withColumn("distance", r6("distance"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({D} * {D}, 6) AS d2 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def l2_sq_pairs(spark, d):
    v = vectors(spark, d)
    b = v.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("e"))
    return v.join(b, F.col("vec_id") == F.col("a")).select("a", "b", r6(V.l2_sq(F.col("embedding"), F.col("e"))).alias("d2"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    v = vectors(spark, d)
    b = v.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("e"))
    return v.join(b, F.col("vec_id") == F.col("a")).select("a", "b", r6(V.cosine_distance(F.col("embedding"), F.col("e"))).alias("distance"))


@query("SELECT vec_id, round(list_sum([x*x for x in u]), 6) AS length, round(u[1], 6) AS first, round(u[64], 6) AS last FROM (SELECT vec_id, [x::DOUBLE / sqrt(list_sum([y::DOUBLE*y::DOUBLE for y in embedding])) for x in embedding] AS u FROM embeddings)")
def unit_normalize(spark, d):
    v = vectors(spark, d).select("vec_id", V.normalize(F.col("embedding")).alias("u"))
    return v.select("vec_id", r6(V.dot(F.col("u"), F.col("u"))).alias("length"), r6(F.col("u")[0]).alias("first"), r6(F.col("u")[63]).alias("last"))


@query("SELECT vec_id, embedding[1:8] AS preview FROM embeddings")
def vector_preview(spark, d):
    return vectors(spark, d).select("vec_id", V.preview(F.col("embedding")).alias("preview"))


@query("SELECT vec_id % 7 AS cut, count(*) FILTER (WHERE len(embedding[1:64 - (vec_id % 7)]) = 64) AS valid, count(*) FILTER (WHERE len(embedding[1:64 - (vec_id % 7)]) != 64) AS invalid FROM embeddings GROUP BY ALL")
def dim_validate(spark, d):
    cut = vectors(spark, d).select((F.col("vec_id") % 7).alias("cut"), F.slice("embedding", F.lit(1), (64 - F.col("vec_id") % 7).cast("int")).alias("v"))
    return cut.groupBy("cut").agg(F.count_if(V.dim_ok(F.col("v"), 64)).alias("valid"), F.count_if(~V.dim_ok(F.col("v"), 64)).alias("invalid"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({D}*{D}, 6) AS d2 FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {D} < sqrt(1.2)")
def near_duplicates(spark, d):
    return search.pairs_within(vectors(spark, d), 1.2).withColumn("d2", r6("d2"))


@query(f"WITH k AS (SELECT a.vec_id, {D} AS d FROM embeddings a, embeddings b WHERE a.vec_id != b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {D}, b.vec_id) <= 5) SELECT vec_id, round(avg(d), 6) AS mean_distance, round(max(d), 6) AS max_distance FROM k GROUP BY vec_id")
def anomaly_knn_mean(spark, d):
    g = search.knn_graph(vectors(spark, d), 5)
    return g.groupBy(F.col("node").alias("vec_id")).agg(r6(F.avg(F.sqrt("d2"))).alias("mean_distance"), r6(F.max(F.sqrt("d2"))).alias("max_distance"))


@query(
    "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS q FROM m GROUP BY label) "
    "SELECT label::BIGINT AS qid, row_number() OVER (PARTITION BY label ORDER BY list_distance(b.embedding::DOUBLE[], q), b.vec_id) AS rank, b.vec_id, round(list_distance(b.embedding::DOUBLE[], q), 6) AS distance FROM c, (SELECT vec_id, embedding FROM embeddings) b QUALIFY rank <= 5"
)
def centroid_recommend(spark, d):
    v = vectors(spark, d)
    q = search.centroids(v, "label").select(F.col("label").cast("long").alias("qid"), F.col("centroid").alias("query"))
    return search.batch_top_k(v, q, 5).withColumn("distance", r6("distance"))


@query(f"SELECT k.*, d.source, d.lang, d.n_chars FROM ({_batch_sql(D, 5)}) k JOIN documents d ON d.doc_id = k.vec_id")
def rag_topk_metadata(spark, d):
    v, docs = vectors(spark, d), table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    near = search.batch_top_k(v, asked(v), 5).withColumn("distance", r6("distance"))
    return near.join(docs, F.col("vec_id") == F.col("doc_id")).drop("doc_id")


@query(_batch_sql(D, 3, "b.vec_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)"))
def knn_metadata_semi_join(spark, d):
    v = vectors(spark, d)
    good = table(spark, d, "labels").where("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("vec_id"))
    return search.batch_top_k(v.join(good, "vec_id", "left_semi"), asked(v), 3).withColumn("distance", r6("distance"))


@query(f"SELECT a.vec_id AS node, row_number() OVER (PARTITION BY a.vec_id ORDER BY {D}, b.vec_id) AS rank, b.vec_id AS nbr, round({D}*{D}, 6) AS d2 FROM embeddings a, embeddings b WHERE a.vec_id != b.vec_id QUALIFY rank <= 32")
def knn_graph_exact(spark, d):
    return search.knn_graph(vectors(spark, d), 32).withColumn("d2", r6("d2"))


@query(
    f"WITH g AS (SELECT a.vec_id AS a, b.vec_id AS b, {D}*{D} AS d2 FROM embeddings a, embeddings b WHERE a.vec_id != b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {D}, b.vec_id) <= 4), "
    "u AS (SELECT a AS node, b AS nbr, round(d2, 9) AS d2 FROM g UNION SELECT b, a, round(d2, 9) FROM g) SELECT node, row_number() OVER (PARTITION BY node ORDER BY d2, nbr) AS rank, nbr, round(d2, 6) AS d2 FROM u QUALIFY rank <= 6"
)
def knn_graph_pruned(spark, d):
    g = search.knn_graph(vectors(spark, d), 4).select("node", "nbr", F.round("d2", 9).alias("d2"))
    both = g.union(g.select("nbr", "node", "d2")).distinct()
    return search.prune(both, 6).select("node", "rank", "nbr", r6("d2").alias("d2"))


@query(
    f"WITH g AS (SELECT a.vec_id AS node, b.vec_id AS nbr, row_number() OVER (PARTITION BY a.vec_id ORDER BY {D}, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id = 7 AND b.vec_id != 7 QUALIFY rank <= 12) "
    "SELECT e.vec_id, e.embedding[1:8] AS preview, (SELECT list(nbr ORDER BY rank) FROM g) AS neighbours FROM embeddings e WHERE e.vec_id = 7"
)
def node_inspect(spark, d):
    v = vectors(spark, d)
    one = v.where("vec_id = 7")
    near = search.batch_top_k(v.where("vec_id != 7"), one.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query")), 12)
    listed = near.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda s: s["vec_id"]).alias("neighbours"))
    return one.join(listed, F.col("vec_id") == F.col("qid")).select("vec_id", V.preview(F.col("embedding")).alias("preview"), "neighbours")


@query(
    f"WITH g AS (SELECT a.vec_id AS node, b.vec_id AS nbr, row_number() OVER (PARTITION BY a.vec_id ORDER BY {D}, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id != b.vec_id QUALIFY rank <= 8) "
    "SELECT vec_id, embedding[1:8] AS preview, 1 AS max_layer, layer, (SELECT list(nbr::INT ORDER BY rank) FROM g WHERE node = 7 AND rank <= CASE layer WHEN 0 THEN 8 ELSE 3 END) AS neighbours FROM embeddings, range(2) t(layer) WHERE vec_id = 7"
)
def graph_node_inspect(spark, d):
    """A node of a stored graph: preview, top layer, neighbours by layer. The graph is the exact one, with two layers."""
    v = vectors(spark, d).select("vec_id", "embedding", F.col("vec_id").cast("int").alias("node_id"), F.lit(0).alias("shard_id"))
    near = search.knn_graph(v, 8).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "nbr"))), lambda x: x["nbr"].cast("int")).alias("all"))
    layers = F.explode(F.array(F.struct(F.lit(0).alias("layer"), F.col("all").alias("neighbours")), F.struct(F.lit(1).alias("layer"), F.slice("all", 1, 3).alias("neighbours"))))
    edges = near.select(F.lit(0).alias("shard_id"), F.col("node").cast("int").alias("node_id"), layers.alias("x"), F.lit(1).alias("max_layer")).select("shard_id", "node_id", "x.layer", "x.neighbours", "max_layer")
    return hnsw.inspect(v, edges, 7).select("vec_id", "preview", "max_layer", F.explode("layers").alias("x")).select("vec_id", "preview", "max_layer", F.col("x.layer").cast("long").alias("layer"), "x.neighbours")


def _by_half(v: DataFrame, k: int) -> DataFrame:
    """An approximate search: by the first half of each vector."""
    half = v.withColumn("embedding", F.slice("embedding", 1, 32))
    return search.batch_top_k(half, asked(half), k)


@query(f"WITH t AS ({_batch_sql(D, 10)}), f AS ({_batch_sql(HALF, 10)}) SELECT t.qid, count(f.vec_id) / 10.0 AS recall FROM t LEFT JOIN f ON t.qid = f.qid AND t.vec_id = f.vec_id GROUP BY t.qid")
def recall_at_k(spark, d):
    v = vectors(spark, d)
    q = asked(v)
    return search.recall(search.batch_top_k(v, q, 10), _by_half(v, 10))


@query(
    f"WITH t AS (SELECT a.vec_id AS qid, max(d) AS dk FROM (SELECT a.vec_id, {D} AS d FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {D}, b.vec_id) <= 10) a GROUP BY 1), "
    f"f AS (SELECT a.vec_id AS qid, {D} AS d FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {HALF}, b.vec_id) <= 10) "
    "SELECT qid, avg(CASE WHEN d*d <= 2*dk*dk + 1e-12 THEN 1.0 ELSE 0.0 END) AS recall FROM f JOIN t USING (qid) GROUP BY qid"
)
def recall_by_distance(spark, d):
    v = vectors(spark, d)
    q = asked(v)
    found = _by_half(v, 10).select("qid", "vec_id").join(q, "qid").join(v.select("vec_id", "embedding"), "vec_id")
    return search.recall_by_distance(search.batch_top_k(v, q, 10), found.select("qid", "vec_id", V.l2(F.col("embedding"), F.col("query")).alias("distance")), 2.0)


@query("SELECT count(*) FILTER (WHERE s != 2) AS shards_ok, count(*) FILTER (WHERE s = 2) AS shards_err, true AS degraded FROM range(3) t(s)")
def search_envelope(spark, d):
    return search.envelope(spark.range(3).select(F.col("id").alias("shard_id"), (F.col("id") != 2).alias("healthy")))


def _sharded(spark, d) -> DataFrame:
    v = vectors(spark, d).withColumn("shard_id", (F.col("vec_id") % 3).cast("int"))
    return hnsw.with_nodes(v, "vec_id")


CFG = IndexConfig(dim=64, m=12, m_max0=24, ef_construction=60, ef_search=80)


@query()
def hnsw_search(spark, d):
    v = _sharded(spark, d)
    return hnsw.search(v, hnsw.build(v, CFG), asked(v), 10, CFG).withColumn("distance", r6("distance"))


@query()
def hnsw_recall(spark, d):
    v = _sharded(spark, d)
    return search.recall(search.batch_top_k(v, asked(v), 10), hnsw.search(v, hnsw.build(v, CFG), asked(v), 10, CFG))


@query()
def ann_lsh_recall(spark, d):
    """Recall of random-projection buckets, a probe per table, against exact search."""
    v = vectors(spark, d)
    q = asked(v)
    return search.recall(search.batch_top_k(v, q, 10), lsh.search(v, q, 10, 64))


@query()
def ann_lsh_search(spark, d):
    v = vectors(spark, d)
    return lsh.search(v, asked(v), 10, 64).withColumn("distance", r6("distance"))


# --- routing ----------------------------------------------------------------------------------------------------------


@query(f"SELECT o_orderkey, {HASH.format('o_orderkey')}::VARCHAR AS hash FROM orders")
def fnv_hash(spark, d):
    return table(spark, d, "orders").select("o_orderkey", V.unsigned_text(V.fnv1a64_long(F.col("o_orderkey"))).alias("hash"))


@query(f"SELECT s::INT AS shard_id, v::INT AS vnode, {HASH.format('(s << 32) + v')}::VARCHAR AS hash FROM range(5) a(s), range(150) b(v)")
def ring_points(spark, d):
    return ring.ring(spark, 5)


ROUTED = "k AS (SELECT c_custkey, " + HASH.format("c_custkey") + " AS h FROM customer), p AS (SELECT c_custkey, r.shard_id FROM k ASOF LEFT JOIN r ON k.h <= r.h), o AS (SELECT c_custkey, coalesce(shard_id, (SELECT arg_min(shard_id, h) FROM r)) AS shard_id FROM p)"


@query(f"WITH {ring_sql(3)}, {ROUTED} SELECT c_custkey, shard_id::INT AS shard_id FROM o")
def route_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", ring.owner(F.col("c_custkey"), 3).alias("shard_id"))


@query(
    f"WITH {ring_sql(4)}, k AS (SELECT page_id, {TEXT_HASH.format('url')} AS h FROM pages), p AS (SELECT page_id, r.shard_id FROM k ASOF LEFT JOIN r ON k.h <= r.h) "
    "SELECT page_id, coalesce(shard_id, (SELECT arg_min(shard_id, h) FROM r))::INT AS shard_id FROM p"
)
def route_strings(spark, d):
    return table(spark, d, "pages").select("page_id", ring.owner_of_text(F.col("url"), 4).alias("shard_id"))


@query(f"WITH {ring_sql(3)}, {ROUTED} SELECT s::INT AS shard_id, count(c_custkey) AS n FROM range(3) t(s) LEFT JOIN o ON o.shard_id = s GROUP BY s")
def load_distribution(spark, d):
    return ring.load(route_ids(spark, d), 3)


@query(f"WITH {ring_sql(3)}, {ROUTED} SELECT s::INT AS shard_id, count(c_custkey) AS n, round(100.0 * count(c_custkey) / sum(count(c_custkey)) OVER (), 1) AS pct FROM range(3) t(s) LEFT JOIN o ON o.shard_id = s GROUP BY s")
def ring_share_pct(spark, d):
    return ring.share(load_distribution(spark, d))


@query(
    f"WITH {ring_sql(3, 'a')}, {ring_sql(4, 'b')}, k AS (SELECT {HASH.format('c_custkey')} AS h FROM customer), "
    "x AS (SELECT k.h, coalesce(a.shard_id, (SELECT arg_min(shard_id, h) FROM a)) AS s FROM k ASOF LEFT JOIN a ON k.h <= a.h), y AS (SELECT x.s, coalesce(b.shard_id, (SELECT arg_min(shard_id, h) FROM b)) AS t FROM x ASOF LEFT JOIN b ON x.h <= b.h) "
    "SELECT count(*) AS n_ids, count(*) FILTER (WHERE s != t) AS n_moved, count(*) FILTER (WHERE s != t) / count(*) AS fraction FROM y"
)
def rebalance_moved(spark, d):
    return ring.moved(table(spark, d, "customer"), "c_custkey", 3)


@query(
    f"WITH {ring_sql(3)}, k AS (SELECT v, {HASH.format('(3::BIGINT << 32) + v')} AS h FROM range(150) t(v)), p AS (SELECT k.v, coalesce(r.shard_id, (SELECT arg_min(shard_id, h) FROM r)) AS s FROM k ASOF LEFT JOIN r ON k.h <= r.h) "
    "SELECT s::INT AS shard_id, min(v)::INT AS first_vnode FROM p GROUP BY s"
)
def affected_shards(spark, d):
    return ring.affected_on_add(spark, 3)


# --- log and inserts --------------------------------------------------------------------------------------------------


@query(f"WITH {ring_sql(3)}, {ROUTED} SELECT c_custkey, shard_id::INT AS shard_id, (row_number() OVER (PARTITION BY shard_id ORDER BY c_custkey) - 1)::INT AS node_id FROM o")
def assign_node_ids(spark, d):
    return hnsw.with_nodes(route_ids(spark, d), "c_custkey")


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 1000 + row_number() OVER (ORDER BY event_id) - 1 ELSE user_id END AS vec_id FROM events")
def auto_vector_ids(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id")).otherwise(-1).alias("vec_id"))
    return log.fill_ids(rows, "event_id", 1000)


@query("SELECT label, count(*) FILTER (WHERE vec_id % 11 != 0) AS inserted, count(*) FILTER (WHERE vec_id % 11 = 0) AS failed FROM embeddings GROUP BY label")
def bulk_counts(spark, d):
    rows = vectors(spark, d).withColumn("embedding", F.when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")))
    ok = V.dim_ok(F.col("embedding"), 64)
    return rows.groupBy("label").agg(F.count_if(ok).alias("inserted"), F.count_if(~ok).alias("failed"))


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS lsn FROM events")
def wal_lsn(spark, d):
    return log.numbered(table(spark, d, "events").select("event_id"), "event_id", "lsn")


@query("SELECT user_id, count(*) AS n, count(*) // 10 * 10 AS checkpoint FROM events GROUP BY user_id")
def wal_auto_checkpoint(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("checkpoint", log.checkpoint_lsn(F.col("n"), 10))


@query("WITH b AS (SELECT user_id, min(event_id) AS bad FROM events WHERE event_id % 97 = 13 GROUP BY user_id) SELECT e.event_id, e.user_id FROM events e LEFT JOIN b USING (user_id) WHERE bad IS NULL OR e.event_id < bad")
def wal_replay_prefix(spark, d):
    return log.valid_prefix(table(spark, d, "events").select("event_id", "user_id"), F.col("event_id") % 97 != 13, ["user_id"], "event_id")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS lsn FROM events WHERE event_id >= 500")
def wal_truncate_rebase(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("event_id").alias("lsn"))
    return log.truncate(rows, 500, 100)


@query("SELECT user_id, count(*) AS current_lsn, count(*) // 10 * 10 AS checkpoint_lsn, (sum(strlen(props)) + 24 * count(*))::BIGINT AS bytes FROM events GROUP BY user_id")
def wal_introspection(spark, d):
    """Next number, last checkpoint and size of a log for each user."""
    rows = log.numbered(table(spark, d, "events").select("user_id", "event_id", "props"), "event_id", "lsn", ["user_id"])
    return log.introspect(rows, ["user_id"], 10, size=F.octet_length("props") + 24)


@query(
    "WITH n AS (SELECT event_id, user_id % 5 AS shard, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) - 1 AS lsn FROM events), b AS (SELECT shard, min(lsn) AS bad FROM n WHERE event_id % 701 = 700 OR event_id % 911 = 910 GROUP BY shard) "
    "SELECT event_id, n.shard, lsn FROM n LEFT JOIN b USING (shard) WHERE bad IS NULL OR lsn < bad"
)
def wal_contiguous_prefix(spark, d):
    """Replay ends at a record that is missing as it does at one that is bad."""
    rows = table(spark, d, "events").select("event_id", (F.col("user_id") % 5).alias("shard"))
    logged = log.numbered(rows, "event_id", "lsn", ["shard"]).where("event_id % 701 != 700")
    return log.contiguous_prefix(logged, F.col("event_id") % 911 != 910, ["shard"])


def _collection(spark: SparkSession, dim: int):
    from nearfield.collection import Collection
    from nearfield.config import CollectionConfig

    return Collection(spark, _scratch(spark), CollectionConfig(IndexConfig(dim=dim)))


TWICE = "(SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0)"


@query(f"SELECT a.vec_id AS qid, row_number() OVER (PARTITION BY a.vec_id ORDER BY {D}, b.vec_id) AS rank, b.vec_id, round({D}, 6) AS distance FROM embeddings a, {TWICE} b WHERE a.vec_id % 20 = 0 QUALIFY rank <= 4")
def collection_ids_inserted_twice(spark, d):
    """Both vectors of an id are results of their own."""
    c, v = _collection(spark, 64), vectors(spark, d).select("vec_id", "embedding")
    c.bulk_insert(v)
    c.bulk_insert(v.where("vec_id % 20 = 0"))
    return c.search(asked(v), 4).select("qid", F.col("rank").cast("long").alias("rank"), "vec_id", r6("distance").alias("distance"))


@query("SELECT vec_id, len(embedding)::INT AS dim FROM embeddings")
def collection_insert_after_torn_record(spark, d):
    """Numbers go on from the valid prefix, so what is inserted after a torn record is there."""
    c, v = _collection(spark, 64), vectors(spark, d).select("vec_id", "embedding")
    c.bulk_insert(v.where("vec_id % 2 = 0"))
    torn = c.log.groupBy("shard_id").agg((F.max("lsn") + 1).alias("lsn"), F.max("epoch").alias("epoch"), F.first("embedding").alias("embedding"))
    torn = torn.select("shard_id", "lsn", F.lit(-1).cast("long").alias("vec_id"), F.lit(64).alias("dim"), F.lit(0).cast("long").alias("crc"), "embedding", F.lit(None).cast("string").alias("metadata"), "epoch")
    torn.write.mode("append").partitionBy("shard_id").parquet(f"{c.path}/log")
    c.bulk_insert(v.where("vec_id % 2 != 0"))
    return c.vectors.select("vec_id", F.size("embedding").alias("dim"))


@query(f"SELECT a.vec_id AS qid, row_number() OVER (PARTITION BY a.vec_id ORDER BY {D}, b.vec_id) AS rank, b.vec_id, round({D}, 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.label != 3 QUALIFY rank <= 5")
def collection_snapshot_truncate(spark, d):
    """Snapshot, shortened log, deletes and later inserts give the vectors back."""
    c, v = _collection(spark, 64), vectors(spark, d)
    c.bulk_insert(v.where("vec_id % 3 != 0").select("vec_id", "embedding"))
    c.snapshot(truncate=True)
    c.bulk_insert(v.where("vec_id % 3 = 0").select("vec_id", "embedding"))
    c.delete(v.where("label = 3").select("vec_id"))
    return c.search(asked(v), 5).select("qid", F.col("rank").cast("long").alias("rank"), "vec_id", r6("distance").alias("distance"))


@query("SELECT vec_id, label FROM embeddings WHERE label != 3")
def delete_tombstone(spark, d):
    v = vectors(spark, d).select("vec_id", "label")
    return log.delete(v, v.where("label = 3").select("vec_id"))


@query("SELECT c_custkey AS vec_id, c_custkey IN (SELECT vec_id FROM embeddings) AS found FROM customer")
def delete_found(spark, d):
    return log.found(table(spark, d, "customer").select(F.col("c_custkey").alias("vec_id")), vectors(spark, d))


@query(f"WITH {ring_sql(3)}, {ROUTED} SELECT s::INT AS shard_id, count(c_custkey) AS n, CASE WHEN s != 1 THEN 'healthy' ELSE 'degraded' END AS status, (SELECT count(*) FROM customer) AS total_vectors FROM range(3) t(s) LEFT JOIN o ON o.shard_id = s GROUP BY s")
def collection_info(spark, d):
    loads = load_distribution(spark, d)
    return loads.select("shard_id", "n", metrics.status(F.col("shard_id") != 1).alias("status"), F.sum("n").over(Window.partitionBy()).alias("total_vectors"))


@query("SELECT count(*) AS total, count(DISTINCT label) AS labels, min(len(embedding)) AS dim FROM embeddings")
def collection_totals(spark, d):
    return vectors(spark, d).agg(F.count("*").alias("total"), F.count_distinct("label").alias("labels"), F.min(F.size("embedding")).cast("long").alias("dim"))


@query()
def wal_crc_roundtrip(spark, d):
    """Vectors through their wire form; the checksum before and after."""
    v = vectors(spark, d)
    raw = v.select("vec_id", log.crc32_f32(F.col("embedding")).alias("crc"), V.encode_f32(F.col("embedding")).alias("raw"))
    return raw.select("vec_id", "crc", F.crc32("raw").alias("crc_of_bytes"), (log.crc32_f32(V.decode_f32(F.col("raw"))) == F.col("crc")).alias("same"))


# --- decoding ---------------------------------------------------------------------------------------------------------


@query("SELECT event_id, [1.5, user_id::FLOAT, (event_id % 5)::FLOAT]::FLOAT[] AS vector, user_id AS top_k FROM events")
def json_decode(spark, d):
    e = table(spark, d, "events")
    body = F.concat(F.lit('{"query": [1.5, oops, '), F.col("user_id").cast("string"), F.lit(", "), (F.col("event_id") % 5).cast("string"), F.lit('], "top_k": '), F.col("user_id").cast("string"), F.lit("}"))
    return e.select("event_id", V.json_vector(body, "query").alias("vector"), V.json_bigint(body, "top_k", 5).alias("top_k"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN [1.0, 2.0]::FLOAT[] END AS vector FROM events")
def json_decode_strict(spark, d):
    body = F.when(F.col("event_id") % 2 == 0, '{"v": [1, 2]}').otherwise('{"v": [1, x]}')
    return table(spark, d, "events").select("event_id", V.json_vector_strict(body, "v").alias("vector"))


@query("SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages")
def url_params(spark, d):
    return table(spark, d, "pages").select("page_id", V.url_param(F.col("url"), "page").alias("page"), V.url_param(F.col("url"), "ref").alias("ref"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_int(spark, d):
    return table(spark, d, "events").select("event_id", V.json_bigint(F.col("props"), "k").alias("k"))


# --- metrics ----------------------------------------------------------------------------------------------------------

US = "(SELECT *, value * 10 AS us FROM events)"
BUCKET = "CASE WHEN us < 100 THEN 0 WHEN us < 200 THEN 1 WHEN us < 300 THEN 2 WHEN us < 500 THEN 3 WHEN us < 750 THEN 4 WHEN us < 1000 THEN 5 WHEN us < 2000 THEN 6 ELSE 7 END"
HIST = f"h AS (SELECT b::INT AS bucket, count(us) AS n FROM range(8) t(b) LEFT JOIN {US} ON {BUCKET} = b GROUP BY b)"


@query(f"WITH {HIST} SELECT * FROM h")
def latency_buckets(spark, d):
    return metrics.histogram(latencies(spark, d), "us")


@query(
    f"WITH {HIST}, c AS (SELECT bucket, sum(n) OVER (ORDER BY bucket) / sum(n) OVER () AS s FROM h), m AS (SELECT [50.0, 150, 250, 400, 625, 875, 1500, 3000]::DOUBLE[] AS m) "
    "SELECT m[min(bucket) FILTER (WHERE s >= 0.5) + 1] AS p50, m[min(bucket) FILTER (WHERE s >= 0.95) + 1] AS p95, m[min(bucket) FILTER (WHERE s >= 0.99) + 1] AS p99 FROM c, m GROUP BY m"
)
def histogram_percentiles(spark, d):
    return metrics.histogram_percentiles(latency_buckets(spark, d))


PCT = "round(quantile_cont(us, 0.5), 6) AS p50, round(quantile_cont(us, 0.95), 6) AS p95, round(quantile_cont(us, 0.99), 6) AS p99"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r6(c) for c in ("p50", "p95", "p99")})


@query(f"SELECT event_type, {PCT} FROM {US} GROUP BY event_type")
def exact_percentiles(spark, d):
    return _rounded(metrics.exact_percentiles(latencies(spark, d), "us", ["event_type"]))


@query(f"SELECT {PCT} FROM (SELECT us FROM {US} ORDER BY ts DESC, event_id DESC LIMIT 256)")
def last256_percentiles(spark, d):
    return _rounded(metrics.exact_percentiles(metrics.latest(latencies(spark, d), 256, "ts", "event_id"), "us"))


@query(f"WITH s AS (SELECT us, row_number() OVER (ORDER BY us) - 1 AS i, count(*) OVER () AS n FROM {US}) SELECT max(us) FILTER (WHERE i = floor(0.5*n)) AS p50, max(us) FILTER (WHERE i = floor(0.95*n)) AS p95, max(us) FILTER (WHERE i = floor(0.99*n)) AS p99 FROM s")
def bench_percentiles(spark, d):
    return metrics.ranked_percentiles(latencies(spark, d), "us")


@query("SELECT date_trunc('second', ts) AS tick, event_type, count(*) AS n FROM events GROUP BY ALL")
def rates_per_second(spark, d):
    return metrics.rates(latencies(spark, d), "ts", "event_type").withColumn("tick", F.col("tick").cast("timestamp_ntz"))


@query("SELECT *, sum(n) OVER (ORDER BY tick)::BIGINT AS total_n FROM (SELECT date_trunc('hour', ts) AS tick, count(*) AS n, round(sum(value * 10), 3) AS us FROM events GROUP BY 1)")
def running_totals(spark, d):
    ticks = latencies(spark, d).groupBy(F.date_trunc("hour", "ts").alias("tick")).agg(F.count("*").alias("n"), F.round(F.sum("us"), 3).alias("us"))
    return metrics.running(ticks, "tick", "n").withColumn("tick", F.col("tick").cast("timestamp_ntz"))


@query("SELECT date_trunc('hour', ts) AS tick, count(*) AS n, round(avg(value*10)/1000, 3) AS mean_ms FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 60")
def metrics_history_60(spark, d):
    hours = latencies(spark, d).groupBy(F.date_trunc("hour", "ts").alias("tick")).agg(F.count("*").alias("n"), F.round(F.avg("us") / 1000, 3).alias("mean_ms"))
    return metrics.latest(hours, 60, "tick").withColumn("tick", F.col("tick").cast("timestamp_ntz"))


@query("SELECT user_id, round(count(*) / epoch(max(ts) - min(ts)), 9) AS rate FROM events GROUP BY user_id HAVING max(ts) > min(ts)")
def lifetime_rates(spark, d):
    g = latencies(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("s")).where("s > 0")
    return g.select("user_id", F.round(metrics.lifetime_rate(F.col("n"), F.col("s")), 9).alias("rate"))


@query("SELECT c_custkey, least(100.0, c_acctbal / 2000 * 100) AS gauge, CASE WHEN c_custkey >= 1000 THEN printf('%.1fK', round(c_custkey / 1000.0, 1)) ELSE c_custkey::VARCHAR END AS human FROM customer")
def dashboard_numbers(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", metrics.gauge(F.col("c_acctbal"), 2000).alias("gauge"), metrics.human(F.col("c_custkey")).alias("human"))


@query("SELECT n_nationkey, n_nationkey * 1000.0 * 1536 / 1e9 AS gflops FROM nation")
def gflops(spark, d):
    return table(spark, d, "nation").select("n_nationkey", metrics.gflops(F.col("n_nationkey") * 1000.0, 768).alias("gflops"))


@query("SELECT bool_or(user_id % 40 = 0) AS any_degraded, event_type FROM events GROUP BY event_type")
def any_degraded(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.bool_or(F.col("user_id") % 40 == 0).alias("any_degraded"))


LAST = "(SELECT max(ts) FROM events)"


@query(
    f"WITH {HIST}, {ring_sql(3)}, {ROUTED}, c AS (SELECT bucket, sum(n) OVER (ORDER BY bucket) / sum(n) OVER () AS s FROM h), m AS (SELECT [50.0, 150, 250, 400, 625, 875, 1500, 3000]::DOUBLE[] AS m), "
    "pc AS (SELECT m[min(bucket) FILTER (WHERE s >= 0.5) + 1] AS p50, m[min(bucket) FILTER (WHERE s >= 0.95) + 1] AS p95, m[min(bucket) FILTER (WHERE s >= 0.99) + 1] AS p99 FROM c, m GROUP BY m), "
    "l AS (SELECT s AS id, count(c_custkey) AS n FROM range(3) t(s) LEFT JOIN o ON o.shard_id = s GROUP BY s), "
    f"e AS (SELECT count(*) FILTER (WHERE event_type = 'click') AS i, count(*) FILTER (WHERE event_type != 'click') AS q, count(*) FILTER (WHERE event_type = 'click' AND ts > {LAST} - INTERVAL 1 SECOND) AS ir, count(*) FILTER (WHERE event_type != 'click' AND ts > {LAST} - INTERVAL 1 SECOND) AS qr FROM events) "
    "SELECT '{\"total_vectors\":' || (SELECT sum(n) FROM l) || ',\"insert_rate\":' || ir || ',\"search_rate\":' || qr || ',\"p50_us\":' || p50 || ',\"p95_us\":' || p95 || ',\"p99_us\":' || p99 || ',\"total_inserts\":' || i || ',\"total_searches\":' || q || "
    f"',\"ts\":' || (epoch_us({LAST}) // 1000) || ',\"shards\":[' || (SELECT string_agg('{{\"id\":' || id || ',\"vectors\":' || n || ',\"status\":\"' || CASE WHEN id != 1 THEN 'healthy' ELSE 'degraded' END || '\"}}', ',' ORDER BY id) FROM l) || ']}}' AS document FROM e, pc"
)
def metrics_document(spark, d):
    e = latencies(spark, d)
    last = e.agg(F.max("ts").alias("last"))
    recent = F.col("ts") > F.col("last") - F.expr("INTERVAL 1 SECOND")
    click = F.col("event_type") == "click"
    rates = e.withColumn("k", F.lit(1)).join(F.broadcast(last.withColumn("k", F.lit(1))), "k").agg(  # one row
        F.count_if(click & recent).alias("insert_rate"), F.count_if(~click & recent).alias("search_rate"), F.count_if(click).alias("total_inserts"), F.count_if(~click).alias("total_searches"), F.max(F.unix_millis("last")).alias("now")
    )
    shards = load_distribution(spark, d).select(F.col("shard_id").alias("id"), F.col("n").alias("vectors"), metrics.status(F.col("shard_id") != 1).alias("status"))
    return metrics.document(shards, rates, histogram_percentiles(spark, d), F.col("now"))


@query(f"SELECT least(floor(-ln((({HASH.format('o_orderkey')}) // 2048)::DOUBLE / 9007199254740992.0::DOUBLE + 1e-15::DOUBLE) / ln(16.0::DOUBLE)), 5)::BIGINT AS layer, count(*) AS n FROM orders GROUP BY 1")
def layer_sampling(spark, d):
    """How many vectors each layer would get."""
    one = F.pandas_udf(lambda v: __import__("pandas").Series(hnsw.layer_of(v.to_numpy(), 16, 6)), "long")
    return table(spark, d, "orders").groupBy(one("o_orderkey").alias("layer")).agg(F.count("*").alias("n"))


# --- admission --------------------------------------------------------------------------------------------------------


@query("SELECT event_id, event_type IN ('click', 'view') AND event_id % 4 != 1 AS allowed FROM events")
def auth_check(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.when(F.col("event_id") % 4 == 1, "bearer ").otherwise("Bearer "), "event_type").alias("authorization"))
    tokens = spark.createDataFrame([("click",), ("view",)], "token string")
    return admission.authenticate(e, tokens).select("event_id", "allowed")


#: A client's bucket, folded in the order of its requests: capacity 3, one token an hour.
BUCKET_SQL = (
    "WITH RECURSIVE q AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), "
    "f AS (SELECT user_id, event_id, t, i, 2.0::DOUBLE AS tokens, true AS allowed FROM q WHERE i = 1 "
    "UNION ALL SELECT q.user_id, q.event_id, q.t, q.i, greatest(0.0::DOUBLE, least(3.0::DOUBLE, f.tokens + (q.t - f.t) * (1.0::DOUBLE / 3600.0::DOUBLE)) - 1.0::DOUBLE), least(3.0::DOUBLE, f.tokens + (q.t - f.t) * (1.0::DOUBLE / 3600.0::DOUBLE)) - 1.0::DOUBLE >= 0 FROM f JOIN q ON q.user_id = f.user_id AND q.i = f.i + 1) "
)


@query(BUCKET_SQL + "SELECT user_id, event_id, allowed, round(tokens, 6) AS tokens FROM f")
def token_bucket(spark, d):
    return admission.token_bucket(table(spark, d, "events"), "user_id", "ts", "event_id", capacity=3, refill=1 / 3600).withColumn("tokens", r6("tokens"))


@query(BUCKET_SQL + "SELECT event_id, CASE WHEN NOT (event_type IN ('click', 'view') AND event_id % 4 != 1) THEN 'UNAUTHENTICATED' WHEN NOT allowed THEN 'RESOURCE_EXHAUSTED' ELSE 'OK' END AS status FROM f JOIN (SELECT event_id, event_type FROM events) USING (event_id)")
def request_gate(spark, d):
    admitted = token_bucket(spark, d).select("event_id", F.col("allowed").alias("admitted"))
    return auth_check(spark, d).join(admitted, "event_id").select("event_id", admission.gate(F.col("allowed"), F.col("admitted")).alias("status"))


@query("SELECT DISTINCT event_type AS token FROM events WHERE event_type != 'view' UNION SELECT DISTINCT source FROM documents")
def token_set(spark, d):
    """Tokens added to a set and taken from it."""
    known = table(spark, d, "events").select(F.col("event_type").alias("token"))
    more = admission.add_tokens(known, table(spark, d, "documents").select(F.col("source").alias("token")))
    return admission.remove_tokens(more, spark.createDataFrame([("view",), ("never there",)], "token string"))


# --- streams ----------------------------------------------------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    """A folder that all executors share; a local one only where none is set, as in tests."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='nearfield-')}"
    return f"{base}/run-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


@query("SELECT count(*) FILTER (WHERE label != 4) AS inserted, count(*) FILTER (WHERE label = 4) AS failed FROM embeddings")
def stream_bulk_insert(spark, d):
    from nearfield.streaming.ingest import bulk_insert

    s = _stream(spark, d, "embeddings")
    s = s.select("vec_id", F.when(F.col("label") == 4, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("embedding"))
    at = _scratch(spark)
    bulk_insert(s, 64, at, f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/counts").agg(F.sum("inserted").alias("inserted"), F.sum("failed").alias("failed"))


@query("SELECT * FROM (SELECT date_trunc('second', ts) AS tick, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE tick + INTERVAL 1 SECOND <= (SELECT max(ts) - INTERVAL 10 SECOND FROM events)")
def stream_tumbling_rates(spark, d):
    from nearfield.streaming.ingest import tick_rates

    at = _scratch(spark)
    q = tick_rates(_stream(spark, d, "events"), "ts", "event_type", 1).writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out")
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out").select(F.col("tick").cast("timestamp_ntz").alias("tick"), "event_type", "n")


@query(BUCKET_SQL + "SELECT user_id AS client, event_id AS ord, allowed FROM f")
def stream_token_bucket(spark, d):
    from nearfield.streaming.ingest import stream_token_bucket as stateful

    at = _scratch(spark)
    q = stateful(_stream(spark, d, "events"), "user_id", "ts", "event_id", 3.0, 1 / 3600).writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out")
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out")
