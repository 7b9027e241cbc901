import math
import zlib
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield import functions as V
from nearfield.collection import Collection
from nearfield.config import CollectionConfig, IndexConfig, live_top_k, search_width, strict_top_k
from nearfield.operators import admission, hnsw, log, lsh, metrics, ring, search
from nearfield.sources import generate, segments, snapshots


def vecs(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


def unit(n, dim, seed):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def queries(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "qid long, query array<float>")


@pytest.mark.parametrize("dim", [1, 3, 7, 9, 15, 17, 33, 65, 100, 127])
def test_distances(spark, dim):
    rng = np.random.default_rng(dim)
    a, b = rng.normal(size=dim).astype(np.float32), rng.normal(size=dim).astype(np.float32)
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<float>, b array<float>")
    A, B = F.col("a"), F.col("b")
    r = df.select(V.l2_sq(A, B).alias("d"), V.l2(A, B).alias("l"), V.cosine_distance(A, B).alias("c"), V.l2_sq(A, A).alias("z")).first()
    x, y = a.astype(float), b.astype(float)
    assert r.d == pytest.approx(((x - y) ** 2).sum()) and r.l == pytest.approx(math.sqrt(r.d)) and r.z == 0
    assert r.c == pytest.approx(1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y), abs=1e-9)


def test_distance_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = df.select(V.l2_sq(F.col("a"), F.col("b")), V.cosine_distance(F.col("a"), F.col("b")), V.cosine_distance(F.col("a"), F.col("a")), V.cosine_distance(F.col("a"), F.col("z"))).first()
    assert list(r) == [2.0, 1.0, 0.0, 1.0]
    V.register(spark)
    assert spark.sql("SELECT l2_sq(array(1f, 0f), array(0f, 1f)), l2(array(3f), array(0f)), cosine_distance(array(1f), array(0f))").first()[:] == (2.0, 3.0, 1.0)
    assert df.select(V.normalize(F.array(F.lit(3.0), F.lit(4.0)))).first()[0] == [0.6, 0.8]
    assert df.select(V.normalize(F.col("z"))).first()[0] == [0.0, 0.0]


def test_hash_values(spark):
    df = spark.createDataFrame([(0,), (42,), (-1,)], "v long")
    got = [int(r[0]) for r in df.select(V.unsigned_text(V.fnv1a64_long(F.col("v")))).collect()]
    assert got[:2] == [0xA8C7F832281A39C5, 0xFF3ADD6B3789DAEF]
    from nearfield.functions.hashing import fnv_long_array, fnv_text

    assert got == fnv_long_array(np.array([0, 42, -1])).tolist()
    words = ["", "a", "doc_001", "é/ü"]
    t = spark.createDataFrame([(w,) for w in words], "s string")
    assert [int(r[0]) for r in t.select(V.unsigned_text(V.fnv1a64_string(F.col("s")))).collect()] == [fnv_text(w) for w in words]


@pytest.mark.parametrize(("shards", "n", "want"), [(3, 500, [371, 113, 16]), (3, 3000, [1516, 1057, 427]), (3, 50_000, [16065, 16987, 16948]), (5, 50_000, [7753, 8984, 11911, 9124, 12228])])
def test_ring_loads(spark, shards, n, want):
    routed = spark.range(n).select(ring.owner(F.col("id"), shards).alias("shard_id"))
    assert [r.n for r in ring.load(routed, shards).orderBy("shard_id").collect()] == want


def test_ring_cases(spark):
    assert ring.moved(spark.range(10_000), "id", 3).first().fraction == 0.2302
    assert [r.shard_id for r in ring.affected_on_add(spark, 3).orderBy("first_vnode").collect()] == [0, 1]
    keys = spark.createDataFrame([("doc_001",), ("user_abc",), ("key_x",), ("key_y",), (None,)], "k string")
    assert [r[0] for r in keys.select(ring.owner_of_text(F.col("k"), 4, 100)).collect()] == [2, 3, 1, 1, None]
    assert [r.n for r in ring.load(spark.range(20).select(ring.owner(F.col("id"), 3).alias("shard_id")), 3).orderBy("shard_id").collect()] == [20, 0, 0]
    assert spark.range(50).select(ring.owner(F.col("id"), 1).alias("s")).distinct().collect()[0].s == 0
    with pytest.raises(ValueError):
        ring.ring(spark, 0)


def test_configuration():
    for bad in ({"dim": 0}, {"m": 1}, {"ef_construction": 0}, {"max_layers": 0}):
        with pytest.raises(ValueError):
            IndexConfig(**bad)
    assert [live_top_k(k) for k in (None, 0, -3, 7, 1000, 1001)] == [5, 5, 5, 7, 1000, 5]
    assert search_width(None, 50, 10) == 50 and search_width(5, 50, 10) == 10
    with pytest.raises(ValueError):
        strict_top_k(0)


def test_exact_search(spark):
    x = unit(300, 24, 1)
    q = unit(7, 24, 2)
    for metric in ("l2", "cosine"):
        got = {(r.qid, r["rank"]): (r.vec_id, r.distance) for r in search.batch_top_k(vecs(spark, x), queries(spark, q), 5, metric).collect()}
        f32 = x.astype(np.float32).astype(float)
        for i, v in enumerate(q.astype(np.float32).astype(float)):
            d = np.linalg.norm(f32 - v, axis=1) if metric == "l2" else 1 - (f32 @ v) / np.linalg.norm(f32, axis=1) / np.linalg.norm(v)
            for rank, j in enumerate(np.argsort(d, kind="stable")[:5], 1):
                assert got[i, rank][0] == j and got[i, rank][1] == pytest.approx(d[j])
    one = search.top_k(vecs(spark, np.eye(4)), [1.0, 0, 0, 0], 2).collect()
    assert [(r["rank"], r.vec_id, r.distance) for r in one] == [(1, 0, 0.0), (2, 1, math.sqrt(2))]
    assert search.batch_top_k(vecs(spark, x).limit(0), queries(spark, q), 5).count() == 0
    assert search.batch_top_k(vecs(spark, x), queries(spark, q).limit(0), 5).count() == 0


def test_query_blocks(spark, monkeypatch):
    x = vecs(spark, unit(60, 8, 3))
    q = x.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    whole = sorted(map(tuple, search.batch_top_k(x, q, 3).collect()))
    monkeypatch.setattr(search, "QUERY_BLOCK", 16)
    assert sorted(map(tuple, search.batch_top_k(x, q, 3).collect())) == whole


def test_envelope(spark):
    h = spark.createDataFrame([(0, True), (1, False)], "shard_id int, healthy boolean")
    assert tuple(search.envelope(h).first()) == (1, 1, True) and tuple(search.envelope(h, strict=True).first()) == (2, 0, False)


def test_graph_search_recall(spark):
    cfg = IndexConfig(dim=32, m=16, m_max0=32, ef_construction=100, ef_search=100)
    v = vecs(spark, unit(1500, 32, 42)).withColumn("shard_id", (F.col("vec_id") % 3).cast("int"))
    v = hnsw.with_nodes(v, "vec_id").cache()
    q = queries(spark, unit(50, 32, 99))
    edges = hnsw.build(v, cfg).cache()
    found = hnsw.search(v, edges, q, 10, cfg)
    assert search.recall(search.batch_top_k(v, q, 10), found).agg(F.avg("recall")).first()[0] >= 0.9
    assert edges.where("layer = 0").agg(F.max(F.size("neighbours"))).first()[0] <= 32
    assert edges.where("layer > 0").agg(F.coalesce(F.max(F.size("neighbours")), F.lit(0))).first()[0] <= 16
    assert edges.where("is_entry").select("shard_id").distinct().count() == 3
    node = hnsw.inspect(v, edges, 5, 1).first()
    assert len(node.preview) == 8 and node.layers[0]["layer"] == 0
    with pytest.raises(LookupError):
        hnsw.inspect(v, edges, 10_000, 1)
    again = hnsw.build(v, cfg)
    assert again.exceptAll(edges).count() == 0


def test_graph_of_few():
    cfg = IndexConfig(dim=4)
    x = np.vstack([np.eye(4), [[0.5, 0.5, 0, 0]]])
    g = hnsw.build_graph(np.arange(5), x, cfg)
    d, n = g.search(np.eye(4)[0], 5, 50)[0]
    assert n == 0 and d < 1e-6
    assert hnsw.Graph(x, cfg).search(x[0], 3, 10) == []


def test_lsh_recall(spark):
    v = vecs(spark, unit(400, 16, 6))
    q = v.where("vec_id < 20").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    assert search.recall(search.batch_top_k(v, q, 10), lsh.search(v, q, 10, 16)).agg(F.avg("recall")).first()[0] >= 0.9


def test_pairs_and_centroids(spark):
    x = np.array([[0, 0], [0, 0.1], [1, 1], [1, 1.05]])
    assert [(r.a, r.b) for r in search.pairs_within(vecs(spark, x), 0.02).orderBy("a").collect()] == [(0, 1), (2, 3)]
    c = search.centroids(vecs(spark, x).withColumn("g", (F.col("vec_id") > 1).cast("int")), "g").orderBy("g").collect()
    assert c[0].centroid == pytest.approx([0, 0.05]) and c[1].centroid == pytest.approx([1, 1.025])


def test_log(spark):
    rows = spark.createDataFrame([(i * 3 + 1,) for i in range(15)], "o long")
    got = log.numbered(rows, "o", "lsn", parts=4).orderBy("o").collect()
    assert [r.lsn for r in got] == list(range(15))
    logged = log.numbered(rows, "o", "lsn")
    assert log.valid_prefix(logged, F.col("lsn") != 12).count() == 12
    assert log.valid_prefix(logged, F.lit(True)).count() == 15
    assert log.valid_prefix(logged.limit(0), F.lit(True)).count() == 0
    assert [r[0] for r in spark.createDataFrame([(25,), (9,), (0,)], "n long").select(log.checkpoint_lsn(F.col("n"), 10)).collect()] == [20, 0, 0]
    assert sorted(r.lsn for r in log.truncate(logged, 10, 5).collect()) == [0, 1, 2, 3, 4]
    assert log.truncate(logged, 5, 5).count() == 15
    filled = log.fill_ids(spark.createDataFrame([(0, 7), (1, None), (2, -1)], "o long, vec_id long"), "o", 100)
    assert sorted(r.vec_id for r in filled.collect()) == [7, 101, 102]


def test_checksums(spark):
    v = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), (None,)], "v array<float>")
    raw = v.select(log.crc32_f32("v").alias("c"), V.encode_f32("v").alias("raw")).collect()
    assert raw[0].c == 0x8BA71454 == zlib.crc32(raw[0].raw) and raw[1].c is None
    assert v.select(V.decode_f32(V.encode_f32("v")).alias("v")).first().v == [1, 2, 3, 4]
    odd = spark.createDataFrame([(b"too-short",)], "b binary")
    assert odd.select(V.decode_f32("b")).first()[0] is None


def test_segments(spark, tmp_path):
    v = vecs(spark, unit(100, 8, 4)).withColumn("shard_id", F.lit(0)).withColumn("node_id", F.col("vec_id").cast("int"))
    segments.create(v, f"{tmp_path}/s")
    with pytest.raises(Exception, match="(?i)exist"):
        segments.create(v, f"{tmp_path}/s")
    segments.append(v.withColumn("node_id", F.col("node_id") + 100), f"{tmp_path}/s")
    s = segments.read(spark, f"{tmp_path}/s")
    assert tuple(segments.manifest(s).first()) == (0, 200, 8) and len(segments.get(s, 150)) == 8
    with pytest.raises(IndexError):
        segments.get(s, 200)
    x = unit(5, 3, 1).astype(np.float32)
    (tmp_path / "a.seg").write_bytes(segments.pack_binary(x))
    got = segments.read_binary(spark, f"{tmp_path}/a.seg").orderBy("node_id").collect()
    assert [r.embedding for r in got] == [r.tolist() for r in x]
    (tmp_path / "b.seg").write_bytes(b"X" + segments.pack_binary(x)[1:])
    with pytest.raises(Exception, match="no segment"):
        segments.read_binary(spark, f"{tmp_path}/b.seg").count()


def _logged(spark, n, dim=8, bad=None):
    v = vecs(spark, unit(n, dim, 7)).withColumn("shard_id", F.lit(0)).withColumn("lsn", F.col("vec_id")).withColumn("dim", F.lit(dim))
    crc = log.crc32_f32(F.col("embedding"))
    return v.withColumn("crc", crc if bad is None else F.when(F.col("lsn") == bad, crc + 1).otherwise(crc))


def test_snapshot_and_recovery(spark, tmp_path):
    cfg = IndexConfig(dim=8, ef_construction=40)
    logged = _logged(spark, 60)
    v = logged.where("lsn < 40").withColumn("node_id", F.col("lsn").cast("int")).select("shard_id", "node_id", "vec_id", "embedding", "lsn")
    edges = hnsw.build(v, cfg)
    snapshots.save(v, edges, v, f"{tmp_path}/x")
    sv, se, upto = snapshots.load(spark, f"{tmp_path}/x")
    q = queries(spark, unit(5, 8, 3))
    before, after = (sorted(map(tuple, hnsw.search(a, b, q, 5, cfg).collect())) for a, b in ((v, edges), (sv, se)))
    assert before == after
    assert sorted(r.lsn for r in snapshots.recover(logged.union(logged), sv, upto, 8).collect()) == list(range(40, 60))
    assert snapshots.recover(logged, None, None, 8).count() == 60
    assert snapshots.recover(_logged(spark, 20, bad=19), None, None, 8).count() == 19
    assert snapshots.recover(logged.limit(0), None, None, 8).count() == 0
    name = snapshots.save(v.limit(10), hnsw.build(v.limit(10), cfg), None, f"{tmp_path}/x")
    assert snapshots.current(spark, f"{tmp_path}/x") == name and snapshots.load(spark, f"{tmp_path}/x")[0].count() == 10
    snapshots.graph_json(edges).write.text(f"{tmp_path}/g")
    back = snapshots.read_graph_json(spark, f"{tmp_path}/g")
    assert back.where("layer = 0").count() == edges.where("layer = 0").count()
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, f"{tmp_path}/none")


def test_metrics(spark):
    e = spark.createDataFrame([(float(v),) for v in (99, 100, 199.9, 2000, 5000, 300)], "us double")
    assert [r.n for r in metrics.histogram(e, "us").orderBy("bucket").collect()] == [1, 2, 0, 1, 0, 0, 0, 2]
    assert tuple(metrics.histogram_percentiles(metrics.histogram(e, "us")).first()) == (150.0, 3000.0, 3000.0)
    assert tuple(metrics.histogram_percentiles(metrics.histogram(e.limit(0), "us")).first()) == (0.0, 0.0, 0.0)
    assert tuple(metrics.exact_percentiles(e.limit(0), "us").first()) == (0.0, 0.0, 0.0)
    n = spark.range(1000).select(F.col("id").cast("double").alias("us"))
    assert tuple(metrics.ranked_percentiles(n, "us").first()) == (500.0, 950.0, 990.0)
    h = spark.createDataFrame([(999,), (1500,), (2_300_000,)], "n long").select(metrics.human(F.col("n")), metrics.human_us(F.col("n")), metrics.gauge(F.col("n"), 2000.0))
    assert [tuple(r) for r in h.collect()] == [("999", "999us", 49.95), ("1.5K", "1.5ms", 75.0), ("2.3M", "2300.0ms", 100.0)]


def test_admission(spark):
    r = spark.createDataFrame([(0, "Bearer ok"), (1, ""), (2, "Bearer no"), (3, "ok"), (4, None)], "i int, authorization string")
    t = spark.createDataFrame([("ok",)], "token string")
    assert {x.i: x.allowed for x in admission.authenticate(r, t).collect()} == {0: True, 1: False, 2: False, 3: False, 4: False}
    assert admission.authenticate(r, t, enabled=False).where("allowed").count() == 5

    def run(times, cap, refill):
        rows = [(c, i, datetime(2024, 1, 1) + timedelta(seconds=s)) for c in (1, 2) for i, s in enumerate(times)]
        df = spark.createDataFrame(rows, "c long, i long, ts timestamp")
        got = admission.token_bucket(df, "c", "ts", "i", cap, refill).orderBy("c", "i").collect()
        assert [x.allowed for x in got[: len(times)]] == [x.allowed for x in got[len(times) :]]
        return [x.allowed for x in got[: len(times)]]

    assert run([0, 0.1, 0.5, 0.9, 2.0], 2, 1) == [True, True, False, False, True]
    assert run([0] * 6, 5, 0) == [True] * 5 + [False]


def test_decoding(spark):
    df = spark.createDataFrame([('{"query": [1, x, 2.5], "top_k": 7}',), ("{}",), ('{"query": [], "top_k": "a"}',)], "b string")
    got = df.select(V.json_vector(F.col("b"), "query").alias("v"), V.json_vector_strict(F.col("b"), "query").alias("s"), V.json_bigint(F.col("b"), "top_k", 5).alias("k")).collect()
    assert [(r.v, r.s, r.k) for r in got] == [([1.0, 2.5], None, 7), (None, None, 5), ([], None, 5)]


def test_generated_vectors_do_not_depend_on_partitions(spark):
    for make in (generate.gaussian, generate.uniform):
        a = {r.vec_id: r.embedding for r in make(spark, 50, 6).collect()}
        b = {r.vec_id: r.embedding for r in make(spark, 50, 6).repartition(7).collect()}
        assert a == b


def test_generated_vectors(spark):
    for make in (generate.gaussian, generate.uniform):
        v = make(spark, 50, 6)
        assert v.count() == 50 and v.select(F.max(F.abs(V.norm(F.col("embedding")) - 1))).first()[0] < 1e-6


def test_collection(spark, tmp_path):
    c = Collection(spark, f"{tmp_path}/c", CollectionConfig(IndexConfig(dim=4, ef_construction=20)))
    rows = spark.createDataFrame([(i, [float(i), 1.0, 0.0, 0.0], f'{{"i": {i}}}') for i in range(30)] + [(99, [1.0], None), (98, None, None)], "vec_id long, embedding array<float>, metadata string")
    assert {k: v for k, v in c.bulk_insert(rows).items() if k != "latency_us"} == {"inserted": 30, "failed": 2}
    assert c.insert(None, [100.0, 0, 0, 0])["inserted"] == 1
    q = queries(spark, [[3.1, 1, 0, 0]])
    for mode in ("exact", "hnsw"):
        got = c.search(q, 3, mode=mode).orderBy("rank").collect()
        assert [r.vec_id for r in got] == [3, 4, 2] and got[0].metadata == '{"i": 3}'
    assert c.search(q, 1, where=F.col("vec_id") > 10).first().vec_id == 11
    found = c.delete(spark.createDataFrame([(3,), (77,)], "vec_id long"))
    assert {r.vec_id: r.found for r in found.collect()} == {3: True, 77: False}
    assert [r.vec_id for r in c.search(q, 2).orderBy("rank").collect()] == [4, 2]
    c.insert(3, [3.0, 1, 0, 0])
    assert c.search(q, 1).first().vec_id == 3
    assert c.restore()[2].count() == c.log.count()
    c.snapshot()
    c.insert(500, [5.0, 5, 5, 5])
    v, edges, later = c.restore()
    assert v.count() == 31 and edges.where("layer = 0").count() == 31 and [r.vec_id for r in later.collect()] == [500]
    shard = v.first().shard_id
    assert c.node(0, shard).count() == 1
    info = c.info().collect()
    assert len(info) == 3 and info[0].total_vectors == 32 and "ok" in c.health().first()[0]


def _torn(c, spark):
    """A record at the end of each shard's log whose checksum is wrong."""
    end = c.log.groupBy("shard_id").agg((F.max("lsn") + 1).alias("lsn"), F.max("epoch").alias("epoch"), F.first("embedding").alias("embedding"))
    torn = end.select("shard_id", "lsn", F.lit(-5).cast("long").alias("vec_id"), F.lit(4).alias("dim"), F.lit(0).cast("long").alias("crc"), "embedding", F.lit("torn").alias("metadata"), "epoch")
    torn.write.mode("append").partitionBy("shard_id").parquet(f"{c.path}/log")


def test_collection_goes_on_after_a_torn_record(spark, tmp_path):
    c = Collection(spark, f"{tmp_path}/c", CollectionConfig(IndexConfig(dim=4, ef_construction=20), checkpoint_every=4))
    rows = lambda *ids: spark.createDataFrame([(i, [float(i), 1.0, 0.0, 0.0]) for i in ids], "vec_id long, embedding array<float>")
    c.bulk_insert(rows(*range(10)))
    for new in (100, 101):
        _torn(c, spark)
        assert c.insert(new, [float(new), 1, 0, 0])["inserted"] == 1
    assert sorted(r.vec_id for r in c.vectors.collect()) == [*range(10), 100, 101]
    assert [r.vec_id for r in c.search(queries(spark, [[100.2, 1, 0, 0]]), 2).orderBy("rank").collect()] == [100, 101]
    ends = {r.shard_id: r.current_lsn for r in c.wal().collect()}
    assert sum(ends.values()) == 12 and {r.checkpoint_lsn % 4 for r in c.wal().collect()} == {0}
    assert sum(r.bytes for r in c.wal().collect()) == 12 * (4 * 4 + 24)
    # a gap in the numbers ends what is valid
    shard = max(ends, key=ends.get)
    gap = c.log.where((F.col("shard_id") == shard) & (F.col("lsn") == 2)).count()
    assert gap == 1 and log.contiguous_prefix(c.log.where((F.col("shard_id") != shard) | (F.col("lsn") != 2)), log.record_ok(4), ["shard_id"]).where(F.col("shard_id") == shard).count() == 2


def test_collection_with_ids_inserted_twice(spark, tmp_path):
    c = Collection(spark, f"{tmp_path}/c", CollectionConfig(IndexConfig(dim=4, ef_construction=20)))
    rows = spark.createDataFrame([(i, [float(i), 1.0, 0.0, 0.0], f"m{i}") for i in range(20)], "vec_id long, embedding array<float>, metadata string")
    c.bulk_insert(rows)
    c.insert(3, [3.5, 1, 0, 0], "again")
    for mode in ("exact", "hnsw"):
        got = c.search(queries(spark, [[3.0, 1, 0, 0]]), 3, mode=mode).orderBy("rank").collect()
        assert [(r.vec_id, r.metadata) for r in got] == [(3, "m3"), (3, "again"), (2, "m2")]


def test_collection_searches_the_stored_graph(spark, tmp_path):
    cfg = CollectionConfig(IndexConfig(dim=8, m=8, m_max0=16, ef_construction=40, ef_search=60))
    c = Collection(spark, f"{tmp_path}/c", cfg)
    x = unit(400, 8, 3)
    c.bulk_insert(vecs(spark, x[:300]))
    c.snapshot(truncate=True)
    assert c.log.count() == 0 and c.vectors.count() == 300
    c.bulk_insert(spark.createDataFrame([(300 + i, [float(v) for v in x[300 + i]]) for i in range(100)], "vec_id long, embedding array<float>"))
    c.delete(spark.range(0, 400, 7).select(F.col("id").alias("vec_id")))
    q = queries(spark, unit(20, 8, 9))
    exact, walked = c.search(q, 10), c.search(q, 10, mode="hnsw")
    assert exact.where("vec_id % 7 = 0").count() == 0 and walked.where("vec_id % 7 = 0").count() == 0
    assert walked.count() == 200 and search.recall(exact, walked).agg(F.avg("recall")).first()[0] >= 0.9
    health = spark.createDataFrame([(0, True), (1, False), (2, True)], "shard_id int, healthy boolean")
    for mode in ("exact", "hnsw"):
        assert c.search(q, 10, mode=mode, health=health).where("shard_id = 1").count() == 0
    assert {r.shard_id: r.status for r in c.info(health).collect()} == {0: "healthy", 1: "degraded", 2: "healthy"}
    assert sum(c.shard_size(s) for s in range(3)) == c.vectors.count()
    for bad in (-1, 3):
        with pytest.raises(IndexError):
            c.shard_size(bad)


def test_a_pointer_is_replaced_in_one_step(spark, tmp_path):
    from nearfield.sources import pointer

    at = f"file://{tmp_path}/p"
    assert pointer.get(spark, at) is None
    for x in ("a", "b", "c"):
        pointer.put(spark, at, x)
        assert pointer.get(spark, at) == x
    (tmp_path / "p" / ".half-written").write_text("d")  # a writer that was stopped
    assert pointer.get(spark, at) == "c" and sorted(p.name for p in (tmp_path / "p").glob("CURRENT-*")) == ["CURRENT-000000000002", "CURRENT-000000000003"]


def test_ranges_of_numbers(spark, monkeypatch):
    monkeypatch.setattr(log, "RANGE", 8)
    for missing, end in ((None, 40), (0, 0), (7, 7), (8, 8), (21, 21), (39, 39)):
        rows = [(1, i) for i in range(40) if i != missing] * 2 + [(2, 5)]
        got = {r.s: r.end for r in log.prefix_end(spark.createDataFrame(rows, "s int, lsn long"), F.lit(True), ["s"]).collect()}
        assert got == {1: end, 2: 0}
    start = spark.createDataFrame([(1, 10)], "s int, start long")
    got = log.prefix_end(spark.createDataFrame([(1, i) for i in range(4, 30)], "s int, lsn long"), F.col("lsn") != 25, ["s"], start)
    assert [(r.start, r.end) for r in got.collect()] == [(10, 25)]


def test_values_at_ranks(spark, monkeypatch):
    monkeypatch.setattr(metrics, "FEW", 10)
    monkeypatch.setattr(metrics, "CELLS", 8)
    x = sorted([1.0] * 400 + [float(i) ** 3 for i in range(300)] + [-1e9, 1e12])
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "v double")
    ranks = [0, 1, 5, 200, 401, 500, 699, len(x) - 1]
    assert metrics.values_at(df, "v", ranks) == [x[r] for r in ranks]


def test_utc_and_sql_hash_and_wire_length(spark):
    from nearfield.functions import decode_vector

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        at = spark.sql("SELECT timestamp'2024-01-31 09:00:00' AS t")
        assert at.select(metrics.iso_utc(F.col("t"))).first()[0] == "2024-01-31T00:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    V.register(spark)
    assert [r[0] for r in spark.sql("SELECT fnv1a64(x) FROM VALUES (0L), (42L) t(x)").collect()] == [str(0xA8C7F832281A39C5), str(0xFF3ADD6B3789DAEF)]
    raw = spark.createDataFrame([(bytes(16),), (bytes(12),), (bytes(15),), (None,)], "raw binary")
    assert [r[0] is None for r in raw.select(decode_vector(F.col("raw"), 4)).collect()] == [False, True, True, True]


def test_polling(spark, tmp_path):
    import time

    from nearfield.streaming.ingest import poll, polled

    q = poll(spark, lambda: spark.range(3).agg(F.count("*").alias("n")), f"{tmp_path}/ticks", f"{tmp_path}/cp")
    for _ in range(60):
        if len(list(tmp_path.glob("ticks/tick=*/_SUCCESS"))) >= 2:
            break
        time.sleep(0.5)
    q.stop()
    got = polled(spark, f"{tmp_path}/ticks", 2).collect()
    assert len(got) == 2 and got[0].tick > got[1].tick and got[0].n == 3


def test_token_set(spark):
    t = lambda *x: spark.createDataFrame([(v,) for v in x], "token string")
    now = admission.add_tokens(t("a", "b"), t("b", "c", None))
    assert sorted(r[0] for r in now.collect()) == ["a", "b", "c"]
    assert sorted(r[0] for r in admission.remove_tokens(now, t("a", "z")).collect()) == ["b", "c"]


def test_streams(spark, tmp_path):
    from nearfield.streaming.ingest import bulk_insert

    vecs(spark, unit(20, 4, 1)).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("vec_id long, embedding array<float>").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second start finds nothing new
        bulk_insert(stream, 4, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/rows").count() == 20


def test_search_in_sql(spark):
    from nearfield.functions.udtf import register_search

    register_search(spark)
    x = unit(40, 4, 8)
    vecs(spark, x).withColumn("shard_id", F.col("vec_id") % 2).createOrReplaceTempView("v_udtf")
    q = ", ".join(str(float(np.float32(t))) for t in x[7])
    got = spark.sql(f"SELECT * FROM vector_search(TABLE(SELECT * FROM v_udtf) PARTITION BY (shard_id), array({q}), 3) ORDER BY distance, vec_id LIMIT 3").collect()
    want = search.top_k(vecs(spark, x), [float(np.float32(t)) for t in x[7]], 3).collect()
    assert [(r.vec_id, round(r.distance, 6)) for r in got] == [(r.vec_id, round(r.distance, 6)) for r in want]


def test_many_queries_meet_in_executors(spark, monkeypatch):
    x = unit(90, 8, 3)
    v = vecs(spark, x).withColumn("g", (F.col("vec_id") % 3).cast("int"))
    q = v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    wide = q.select("qid", F.col("query").cast("array<double>").alias("query"))

    def all_of():
        frames = (search.batch_top_k(v, q, 3), search.batch_top_k(v, wide, 4, "cosine"), search.shard_top_k(v.withColumnRenamed("g", "shard_id"), q, 2), search.pairs_within(v, 0.6), search.knn_graph(v, 4))
        return [sorted(map(tuple, f.collect())) for f in frames]

    few = all_of()
    assert all(few)
    monkeypatch.setattr(search, "QUERY_BLOCK", 16)
    for held, read in ((1 << 20, 1 << 18), (8 * 13, 7), (8 * 400, 90)):
        monkeypatch.setattr(search, "HELD", held)
        monkeypatch.setattr(search, "READ", read)
        assert all_of() == few
    assert search.batch_top_k(v.limit(0), q, 3).count() == 0


def test_known_bounds_spare_distances(monkeypatch):
    """A graph of vectors read in many runs: most pairs are dropped by the product alone, and no neighbour is lost."""
    rng = np.random.default_rng(6)
    x = unit(1500, 8, 5).astype(np.float32).astype(np.float64)
    x[40:60] = x[3]  # ties go by id
    ids = rng.permutation(1500)
    summed = 0
    plain = search.nearest

    def counted(*args):
        nonlocal summed
        found = plain(*args)
        summed += len(found[0])
        return found

    monkeypatch.setattr(search, "nearest", counted)
    monkeypatch.setattr(search, "_meet", lambda v, q, fold, schema, by: list(fold(ids, x, iter([pa.record_batch([pa.array(ids), pa.array(list(x))], ["vec_id", "embedding"])]))))
    monkeypatch.setattr(search, "CELLS", 1 << 16)
    parts = search.batch_partials(None, None, 9)
    got = sorted(r for b in parts for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    want = sorted((int(ids[i]), int(ids[j]), d[i, j]) for i in range(1500) for j in np.lexsort((ids, d[i]))[:9])
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want])
    assert summed < 1500 * 9 * 6  # of 2,250,000 pairs
    odd = x.copy()
    odd[7] = np.nan
    i, dist, _ = plain(odd, ids, x[:5], 3, "l2")
    assert set(i.tolist()) == set(range(5)) and np.isfinite(dist).all()  # one odd vector hides no other


def test_ranges_of_an_order(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(o), None if g == 3 else int(g)) for o, g in zip(np.unique(rng.integers(0, 10**12, 300) ** 2 // 10**9), rng.choice(4, 300, p=[0.7, 0.1, 0.1, 0.1]), strict=False)]
    df = spark.createDataFrame(rows, "o long, g int")
    monkeypatch.setattr(log, "ROWS", 16)
    assert len(log.cuts(df, "o")) > 10
    assert [r.n for r in log.numbered(df, "o", "n", base=5).orderBy("o").collect()] == [i + 5 for i in range(len(rows))]
    seen: dict = {}
    for r in log.numbered(df, "o", "n", ["g"]).orderBy("o").collect():
        assert r.n == seen.get(r.g, 0)
        seen[r.g] = r.n + 1
    assert sum(seen.values()) == len(rows)
    bounds = list(range(0, 70, 7))
    for n in (1, 2, 3, 5, 10):
        got = spark.range(-3, 80).select("id", log.range_of(F.col("id"), bounds[:n], "bigint").alias("p")).collect()
        assert all(r.p == sum(b < r.id for b in bounds[:n]) for r in got)


def test_percentiles_in_ranges(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=300), np.full(200, 0.25), [1e12, -1e12]])
    rows = [("a" if i % 3 else "b", float(v)) for i, v in enumerate(x)] + [("c", None), ("a", None), (None, 7.0), (None, 8.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = df.groupBy("g").agg(*[F.coalesce(F.percentile("v", F.lit(p)), F.lit(0.0)).alias(f"p{round(p * 100)}") for p in metrics.LEVELS]).collect()
    for size in (1 << 18, 16):
        monkeypatch.setattr(log, "ROWS", size)
        got = {r.g: (r.p50, r.p95, r.p99) for r in metrics.exact_percentiles(df, "v", ["g"]).collect()}
        assert got.keys() == {r.g for r in want} and all(got[r.g] == pytest.approx((r.p50, r.p95, r.p99)) for r in want)
        assert tuple(metrics.exact_percentiles(df, "v").first()) == pytest.approx(tuple(df.agg(*[F.percentile("v", F.lit(p)) for p in metrics.LEVELS]).first()))


def test_probes_of_near_buckets():
    size = np.array([[[0.5, 0.1, 0.9, 0.2]]])
    assert lsh.flips(size, 4)[0, 0].tolist() == [0, 2, 8, 10]  # none, the nearest plane, the next, both
    assert len(set(lsh.flips(size, 16)[0, 0].tolist())) == 16
