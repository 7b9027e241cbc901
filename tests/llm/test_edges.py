"""What the operators' docstrings say of nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from nearfield.llm import bpe, embeddings, minhash, mixing, packing, quality, sentences, substrings, urls, warc

from . import brute

#: Names that operators use themselves.
MORE = "h1 f gid rep n size w t lines id part cut_h row shard payload place kind at c1 component links text2 key".split()
LONG = 5_000_000


def long_text():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(30_000)]
    out, size = [], 0
    while size < LONG:
        w = rng.choice(words) + (". " if rng.random() < 0.1 else " ")
        out.append(w)
        size += len(w)
    return "".join(out)


@pytest.fixture(scope="module")
def rows():
    text = " ".join(f"alpha{i} beta{i % 7}" for i in range(60)) + "."
    return [(1, text, "a"), (1, text, "a"), (2, text + " more", "b"), (None, None, None), (None, "", "a"), (None, text, None), (3, "", "b"), (4, None, "c"), (5, " \t\n ", "c"), (6, "one", "c"), (7, long_text(), "big")]


def frame(spark, rows, key="doc_id long, text string, source string"):
    more = ", ".join(f"{c} {'string' if i % 2 else 'long'}" for i, c in enumerate(MORE))
    values = [None if i % 3 == 0 else ("x" if i % 2 else 7) for i in range(len(MORE))]
    return spark.createDataFrame([(*r, *values) for r in rows], f"{key}, {more}")


def _key(x):
    return tuple((v is not None, v) for v in x)


def test_encoder(spark, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_tokenizer())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [(i, tok.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows]
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(frame(spark, rows)).collect()]
    want = [(i, len(x), sha(" ".join(map(str, x))), sha(tok.decode(x, skip_special_tokens=False))) for i, x in ids]
    assert sorted(got, key=_key) == sorted(want, key=_key)
    files = [(r.doc_id, r.n_tokens, r.ids_crc32) for r in packing.pack_and_read(frame(spark, rows)).collect()]
    assert sorted(files, key=_key) == sorted([(i, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for i, x in ids], key=_key)
    assert bpe.round_trip(frame(spark, [])).count() == 0 and packing.pack_and_read(frame(spark, [])).count() == 0


def test_substrings(spark, rows):
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in substrings.judge(frame(spark, rows)).collect()]
    want = [(i, n[0], n[1]) for i, n in [(i, (len((t or "").encode()), gone)) for (i, t, _), (_, _, gone, _) in zip(rows[:-1], brute.repeated_bytes([x[:2] for x in rows[:-1]], 200), strict=True)]]
    assert sorted(got, key=_key) == sorted([*want, (7, len(rows[-1][1]), 0)], key=_key)
    assert substrings.judge(frame(spark, [])).count() == 0 and substrings.cut_documents(frame(spark, [])).count() == 0
    assert substrings.cut_documents(frame(spark, rows)).columns == frame(spark, rows).columns


def test_five_hundred_copies(spark):
    text = " ".join(f"gamma{i}" for i in range(300))
    many = [(1, text, "a")] * 250 + [(i, text, "a") for i in range(10, 260)] + [(999, "clean " * 30, "b"), (998, text[:500] + " tail of its own", "b")]
    got = {(r.doc_id, r.n_removed) for r in substrings.judge(frame(spark, many)).collect()}
    assert got == {(1, len(text)), *[(i, len(text)) for i in range(10, 260)], (999, 0), (998, 500)}
    left = minhash.keep_first(frame(spark, many))
    assert sorted(r.doc_id for r in left.collect()) == [1, 998, 999]
    assert {r.n_removed for r in sentences.judge(frame(spark, many)).where("doc_id = 1").collect()} == {0}


def test_mixing(spark, rows):
    got = mixing.mix_sizes(frame(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted([(r.doc_id, r["size"]) for r in got], key=_key) == sorted([(i, size(t)) for i, t, _ in rows], key=_key)
    assert all(r.taken <= 3 * r["size"] for r in got) and mixing.mix_sizes(frame(spark, [])).count() == 0
    mixed = mixing.mix_documents(frame(spark, rows))
    assert mixed.columns == frame(spark, rows).columns and sum(size(r.text) for r in mixed.collect()) == sum(r.taken for r in got)


def test_near_dedup(spark, rows):
    got = [(r.doc_id, r.n_shingles) for r in minhash.judge(frame(spark, rows), size=4).collect()]
    assert sorted(got, key=_key) == sorted([(i, len(brute.shingles(t, 4))) for i, t, _ in rows], key=_key)
    left = minhash.keep_first(frame(spark, rows), size=4)
    kept = sorted([(r.doc_id, r.text) for r in left.collect()], key=_key)
    assert kept == sorted([(1, rows[0][1]), (None, None), (None, ""), (3, ""), (4, None), (5, " \t\n "), (6, "one"), (7, rows[-1][1])], key=_key)
    assert left.columns == frame(spark, rows).columns and minhash.keep_first(frame(spark, [])).count() == 0


def test_sentences(spark, rows):
    got = [(r.doc_id, r.n_sentences) for r in sentences.judge(frame(spark, rows)).collect()]
    assert sorted(got, key=_key) == sorted([(i, len(brute.sentences(t))) for i, t, _ in rows], key=_key)
    assert sentences.judge(frame(spark, [])).count() == 0


def test_quality(spark, rows):
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(frame(spark, rows)).collect()]
    assert sorted(got, key=_key) == sorted([(i, *brute.quality(t)) for i, t, _ in rows], key=_key)
    kept = quality.clean_documents(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and 7 in {r.doc_id for r in kept.collect()}


def test_pages(spark):
    pages = [(1, "http://a.org/x", "same"), (1, "http://a.org/x", "same"), (None, None, None), (None, "no scheme", "same"), (2, "http://A.com/de/?q", ""), (3, "", "y" * LONG), (4, "http://" + "h" * 100_000 + ".com/fr/", "<link " * 100_000)]
    df = frame(spark, pages, "page_id long, url string, html string")
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(df).collect()]
    want = [(1, 4, "response", None)] * 2 + [(None, 0, "revisit", 2), (None, 4, "revisit", 1), (2, 0, "response", None), (3, LONG, "response", None), (4, 600_000, "response", None)]
    assert sorted(got, key=_key) == sorted(want, key=_key)
    judged = [(r.page_id, r.rule, r.verdict) for r in urls.judge(df).collect()]
    assert sorted(judged, key=_key) == sorted([(1, "org/", "allow")] * 2 + [(None, None, "allow")] * 2 + [(2, "com/de/", "block"), (3, None, "allow"), (4, "com/fr/", "allow")], key=_key)
    assert warc.archive(df.limit(0)).count() == 0 and urls.judge(df.limit(0)).count() == 0


def test_vectors(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    vecs = [(1, v), (1, v), (2, v), (3, [-x for x in v]), (4, None), (None, v), (5, []), (6, [1e300, 0.0, 0.0, 0.0]), (7, [1e-300, 0.0, 0.0, 0.0])]
    more = ", ".join(f"{c} long" for c in MORE)
    df = spark.createDataFrame([(*r, *[None] * len(MORE)) for r in vecs], f"vec_id long, embedding array<double>, {more}")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.judge(df).collect()]
    want = [(1, 2, 1, True)] * 2 + [(2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (None, 0, None, False), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False)]
    assert sorted(got, key=_key) == sorted(want, key=_key)


def test_recall_of_embedding_links_with_production_parameters(spark):
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.normal(size=(6000, 64)))
    side = unit(rng.normal(size=(1500, 64)))
    side = unit(side - (side * x[:1500]).sum(axis=1, keepdims=True) * x[:1500])
    cos = rng.uniform(0.951, 0.96, (1500, 1))  # partners just above the bound
    x[3000:4500] = cos * x[:1500] + np.sqrt(1 - cos**2) * side
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embeddings.judge(df).collect()}
    y = unit(x.astype(np.float64))
    true = (y @ y.T >= 0.95).sum(axis=1) - 1
    assert true.sum() >= 2900 and all(got[i] <= true[i] for i in range(6000))
    assert sum(got.values()) >= 0.9 * true.sum()


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    prose = lambda s, n: "\n".join(" ".join(f"{s}{i}w{j}" for j in range(14)) + "." for i in range(n))
    own = [(100 + i, prose(chr(97 + i), 8), "s") for i in range(6)]
    docs = frame(spark, [*rows, *own, *[own[0]] * 300, (None, own[1][1], "s"), (400, own[2][1], None)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    steps = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        steps = spark.createDataFrame(stage(spark, steps, str(tmp_path)).collect(), docs.schema)
        if name == "near_dedup":
            assert sorted(r.doc_id for r in steps.collect()) == [1, 7, *range(100, 106)]
        assert steps.columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == steps.count()
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
