import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from nearfield.llm import bpe, common, embeddings, minhash, mixing, packing, quality, sentences, substrings, suffix, urls, warc
from nearfield.llm.components import components

from . import brute

DOCS = "doc_id long, text string, source string, n long, h long"


def frame(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 3}", 1, 2) for i, t in rows], DOCS)


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(120)
    rows = [(i, prose(rng.randint(1, 160))) for i in range(40)]
    for i in range(40, 70):  # near copies of one text
        w = base.split()
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    shared = prose(60)
    rows += [(i, f"{prose(30)} {shared} {prose(30)}") for i in range(70, 80)]
    rows += [(80, None), (81, ""), (82, " \t\n"), (83, "One"), (84, "one"), (85, "x" * 900), (86, "né " * 300), (87, rows[3][1]), (87, rows[3][1]), (88, rows[4][1].upper())]
    return rows


def test_encoding_agrees_with_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_tokenizer())
    rows = corpus() + [(100, "a<|endoftext|>b <|startoftext|> C, D."), (101, "Don't we'll 123 é é ́x Σίσυφος ﬀ İ 日本"), (None, "null id"), (102, "\x00 \x85a\x1cb")]
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(frame(spark, rows)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert got == want
    encoded = bpe.encode_documents(frame(spark, rows))
    decoded = {(r.doc_id, sha(r.text)) for r in bpe.decode_documents(encoded).collect()}
    assert decoded == {(i, s) for i, _, _, s in want}
    assert bpe.round_trip(frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_wrong_join_is_repaired(name):
    import public_tokenizers

    enc = bpe.Encoder(public_tokenizers.path(name))
    text = " ".join(f"word{i} other" for i in range(40))
    data = np.frombuffer(text.encode(), np.uint8)
    off = np.array([0, len(data)])
    want = enc(text)
    for which in range(2, 6):
        assert enc.encode_rows(data, off, 4)[0].tolist() == want
        enc.agreed.clear(), enc.known.clear()
        slot = enc.chunks.slot[which]
        at = enc.chunks.start[slot] + enc.chunks.count[slot] - 1
        if enc.chunks.ids[enc.chunks.start[slot] : at + 1].tolist() == want[-int(enc.chunks.count[slot]) :]:
            continue  # the text's last chunk has no join at its end
        right = enc.chunks.ids[at]
        enc.chunks.ids[at] = (right + 1) % enc.vocabulary  # spoil the last id of a chunk
        assert enc.encode_rows(data, off, 4)[0].tolist() == want
        enc.chunks.ids[at] = right


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("cut", [1, 2, 16, 256])
def test_chunks_give_the_ids_of_whole_texts(name, cut):
    import public_tokenizers

    rng = random.Random(3)
    parts = ["a", "b ", "  ", "\n", " the", "'s ", "\t", "\n\n", "\xa0", "\u2003", "é", "<|endoftext|>", "don't"]
    texts = [t or "" for _, t in corpus()] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 200))) for _ in range(150)] * 2
    enc = bpe.Encoder(public_tokenizers.path(name))
    raw = [t.encode() for t in texts]
    ids, counts = enc.encode_rows(np.frombuffer(b"".join(raw), np.uint8), common.offsets_of(np.array([len(x) for x in raw])), cut)
    at = common.offsets_of(counts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == enc(t)
    assert len(enc.chunks.keys) > 0


def test_a_chunk_is_encoded_once():
    import public_tokenizers

    enc = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    seen = []

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **more):
            seen.extend(texts)
            return self.inner.encode_batch_fast(texts, **more)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    enc.tokenizer = Counting(enc.tokenizer)
    passage = " ".join(f"shared{i} words" for i in range(400))
    raw = [f"own{i} start {passage} own{i} end".encode() for i in range(20)]
    enc.encode_rows(np.frombuffer(b"".join(raw), np.uint8), common.offsets_of(np.array([len(x) for x in raw])), 16)
    assert len(seen) == len(set(seen)) and sum(map(len, seen)) < 3 * len(raw[0]) + 20 * 400


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 20, 31])
def test_packed_ids_come_back(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 1001)
    raw = packing.pack(x, bits)
    assert len(raw) == (1001 * bits + 7) // 8
    assert (packing.unpack(raw, bits, 1001) == x).all()
    assert (packing.unpack(raw, bits, 300, 500) == x[500:800]).all()


def test_token_files(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_tokenizer())
    rows = corpus() + [(None, "null id")]
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in packing.pack_and_read(frame(spark, rows)).collect())
    start = 0
    for s, i, n, crc in got:
        assert s == start
        start += n
    ids = [i for _, i, _, _ in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = sorted((i or -1, zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for i, t in rows)
    assert sorted((i or -1, c) for _, i, _, c in got) == want
    assert packing.pack_and_read(frame(spark, [])).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(0, a, n).tolist()) for n in (1, 2, 3, 10, 33, 60, 300, 900) for a in (1, 2, 3, 26, 256)]
    for b in [*texts, b"abcabcabc" * 80, b"ab" * 300 + b"a" * 100, b"mississippi" * 20 + b"x", bytes(range(256)) * 3]:
        want = sorted(range(len(b)), key=lambda i: b[i:])  # noqa: B023
        sa = suffix.suffix_array(np.frombuffer(b, np.uint8).astype(np.uint16) + 1, 257)
        assert sa.tolist() == want
        plcp, _ = suffix.permuted_lcp(np.frombuffer(b, np.uint8), sa, np.full(len(b), len(b)))
        for i, j in zip(want[1:], want, strict=False):
            n = 0
            while i + n < len(b) and j + n < len(b) and b[i + n] == b[j + n]:
                n += 1
            assert plcp[i] == n


@pytest.mark.parametrize("most", [1 << 14, 1])
def test_substring_dedup(spark, most):
    rows = corpus() + [(None, "pre " + "hello world " * 30), (None, "hello world " * 40), (90, "q" * 199), (91, "m" * 200), (92, "n" + "m" * 200)]
    got = sorted(map(str, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.judge(frame(spark, rows), most=most).collect())))
    want = sorted(map(str, ((i, len((dict(enumerate(rows))[k][1] or "").encode()), n, s, hashlib.sha256(b).hexdigest()) for k, (i, b, n, s) in enumerate(brute.repeated_bytes(rows, 200)))))
    assert got == want
    kept = substrings.cut_documents(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "n", "h"]
    assert sorted(r.text for r in kept.collect()) == sorted(b.decode("utf-8", "ignore") for _, b, _, _ in brute.repeated_bytes(rows, 200))
    assert substrings.judge(frame(spark, [])).count() == 0


@pytest.mark.parametrize("size", [4, 5])
def test_near_dedup(spark, size):
    rows = corpus()
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.judge(frame(spark, rows), size=size).collect())
    assert got == sorted(brute.near_dedup(rows, size, 80))
    left = minhash.keep_first(frame(spark, rows), size=size)
    assert left.columns == ["doc_id", "text", "source", "n", "h"]
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _, _, k in brute.near_dedup(rows, size, 80) if k)
    assert minhash.judge(frame(spark, [])).count() == 0


def test_near_dedup_null_ids(spark):
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.judge(frame(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (None, "other text of its own")])).collect()}
    assert got == {(None, 4, False), (4, 4, True), (None, None, True)}


def test_keep_first_decides_by_row(spark):
    long = lambda c: " ".join(f"{c}{i}" for i in range(60))
    own = [(None, "other text of its own"), (None, long("u")), (5, "five has a text that nobody else has"), (7, long("v"))]
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (5, "A b c d e f"), *own, (6, long("d")), (7, long("d") + " x"), (None, long("d") + " y")]
    rows += [(None, long("n")), (None, long("n")), (None, long("n") + " z"), (None, long("N")), (None, ""), (None, None), (None, ""), (8, long("e")), (8, long("e"))]
    left = minhash.keep_first(frame(spark, rows))
    assert left.columns == ["doc_id", "text", "source", "n", "h"]
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    nameless = [x for x in got if x[0] is None and (x[1] or "").lower().startswith("n0")]
    assert len(nameless) == 1
    want = [(4, "a b c d e f"), *own, (6, long("d")), *nameless, (None, ""), (None, None), (None, ""), (8, long("e"))]
    assert got == sorted(want, key=str)


def test_intersections_of_many_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(60)]
    got = minhash.common_sizes(sets)
    for i in range(60):
        for j in range(60):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_keep_first_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a"), (1, text, "b"), (1, text, "a"), (2, text, "c"), (3, text.upper(), "d"), (3, text + " x", "e"), (4, "alone in the world", "f"), (4, "alone in the world", "f"), (5, "", "g"), (5, "", "g")]
    left = minhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, h string")).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(1, text), (4, "alone in the world"), (5, ""), (5, "")]
    # near copies that share the first id
    left = minhash.keep_first(spark.createDataFrame([(7, text, "a"), (7, text + " x", "b"), (8, text + " y", "c")], "doc_id long, text string, h string")).collect()
    assert [r.doc_id for r in left] == [7]


def test_blocks_lose_no_pair(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{j}" for j in range(60)) + f" tail{i}") for i in range(70)]
    word = iter(f"v{i}" for i in range(10_000))
    chain = [next(word) for _ in range(80)]
    for i in range(100, 160):  # each near to the one before, the last ones far from the first
        rows.append((i, " ".join(chain)))
        for _ in range(2):
            chain[rng.randrange(len(chain))] = next(word)
    rng.shuffle(rows)
    before, minhash.BLOCK = minhash.BLOCK, 8
    try:
        got = minhash.judge(frame(spark, rows), size=4).collect()
    finally:
        minhash.BLOCK = before
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted(brute.near_dedup(rows, 4, 80))


def test_rows_of_a_large_group(spark, monkeypatch):
    """Near copies whose leader links with none of them: rows compared grow with the group, not with its square."""

    def made(n):
        base = [f"w{j}" for j in range(100)]
        texts = [[f"x{j}" if j % 16 == 8 else w for j, w in enumerate(base)]]
        for i in range(1, n):
            texts.append([f"y{i}" if j == (7 * i) % 100 else w for j, w in enumerate(base)])
        return [(i, " ".join(t)) for i, t in enumerate(texts)]

    seen, compared = [], minhash._compared

    def counted(dealt, *args, **kwargs):
        seen.append(dealt.count())
        return compared(dealt, *args, **kwargs)

    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "_compared", counted)
    total = {}
    for n in (60, 120):
        seen.clear()
        got = minhash.judge(frame(spark, made(n)), size=4).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted(brute.near_dedup(made(n), 4, 80))
        total[n] = sum(seen)
    assert total[120] < 2.7 * total[60] and total[120] < 10 * 120, total


def test_sets_able_to_link(spark):
    rows = [(1, 1, [1, 2, 3, 4, 5]), (2, 2, [1, 2, 3, 4, 9]), (3, 3, [1, 2, 3, 7, 8]), (4, 4, [10, 11]), (5, 5, [20, 21]), (6, 5, [20, 21])]
    sets = spark.createDataFrame([(r, c, [x - (1 << 63) + 3 if x % 2 else x for x in s]) for r, c, s in rows], "rep long, label long, set array<long>")
    assert sorted(r.able for r in minhash._able(sets, 80).collect()) == [1, 2]  # 3 shares three of five; 5 and 6 have one label
    assert sorted(r.able for r in minhash._able(sets, 60).collect()) == [1, 2, 3]
    assert minhash._able(sets.limit(0), 80).count() == 0


def test_embedding_links(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    rows = [(i, base[i % 40] + (0.05 * rng.normal(size=16) if i >= 40 else 0)) for i in range(120)]
    vecs = [(i, [float(np.float32(x)) for x in v]) for i, v in rows] + [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [1.0, None] + [0.0] * 14), (204, [float("inf")] * 16), (205, rows[0][1].tolist()), (None, rows[0][1].tolist()), (206, [1.0, 2.0])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.judge(df, nearest=8).collect()}
    good = {i: np.array(np.float32(v), np.float64) for i, v in vecs if i is not None and (i < 200 or i == 205)}
    cos = {(a, b): good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) for a in good for b in good if a != b}
    c = brute.components(good, [p for p, x in cos.items() if x >= 0.95])
    true = sum(x >= 0.95 for x in cos.values())
    for i in good:
        assert got[i][0] <= sum(cos[i, j] >= 0.95 for j in good if j != i)
    assert sum(got[i][0] for i in good) >= 0.99 * true
    assert sum(got[i][1] == c[i] for i in good) >= 0.98 * len(good)
    for i in (200, 201, 202, 203, 204, 206):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, False)
    assert embeddings.judge(df.limit(0)).count() == 0


def test_embedding_links_of_a_third_of_all_rows(spark):
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.normal(size=(3000, 64)))
    x[:1000] = unit(x[0] + 0.02**0.5 * x[:1000])  # pairs at a cosine of 0.98
    x[1000:1100] = unit(x[0] + 0.6 * x[1000:1100])  # on the rim of the group
    x[1100:1200] = unit(x[1000:1100] + 0.3 * x[1100:1200])
    x = x[rng.permutation(3000)].astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, [1.0, float(i)]) for i in range(3)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embeddings.judge(df).collect()}
    y = unit(x.astype(np.float64))
    true = (y @ y.T >= 0.95).sum(axis=1) - 1
    assert true.max() >= 990
    assert [got[i] for i in range(3000)] == true.tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (102, 102), (None, 3), (7, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 300: 0, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sentence_spans(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) + rng.choice([".", "!", "?", '."', "。", "\n"])
    prose = lambda n: " ".join(sentence() for _ in range(n))
    shared = [prose(rng.randint(1, 9)) for _ in range(12)]
    rows = [(i, f"{prose(rng.randint(0, 5))} {rng.choice(words)} {rng.choice(shared)} {rng.choice(words)} {prose(rng.randint(0, 5))}") for i in range(150)]
    rows += [(i, t.upper() if i % 2 else t) for i, t in zip(range(200, 230), shared * 3)]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "One. Two. " * 40), (304, rows[0][1]), (305, "no mark " * 60), (306, "no mark " * 60), (None, rows[1][1])]
    rows += [rows[3], rows[3], rows[4]]
    got = [(r.doc_id, r.n_sentences, r.n_removed, r.n_bytes_removed) for r in sentences.judge(frame(spark, rows)).collect()]
    want = {x[0]: x for x in brute.sentence_spans(rows, sentences.SENTENCES, sentences.WORDS)}
    assert sorted(map(str, got)) == sorted(str(want[i]) for i, _ in rows)
    assert sum(x[2] > 0 for x in got) > 100
    kept = {r.doc_id: len(r.text.encode()) for r in sentences.dedup_texts(frame(spark, rows)).collect()}
    assert kept == {i: len((t or "").encode()) - want[i][3] for i, t in rows}
    assert sentences.judge(frame(spark, [])).count() == 0


def test_repeated_passages_lose_their_whole_sentences(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    prose = lambda n: " ".join(some(rng.randint(4, 12)) + "." for _ in range(n))
    rows = []
    for i in range(150):  # pasted into the middle of sentences
        passage = prose(7)
        rows += [(j, f"{prose(rng.randint(0, 4))} {some(3)} {passage} {some(3)} {prose(rng.randint(0, 4))}") for j in (i, 1000 + i)]
    got = {r.doc_id: r.n_removed for r in sentences.judge(frame(spark, rows)).collect()}
    assert all(got[i] == 0 and got[1000 + i] >= 5 for i in range(150))


def test_quality_counts(spark):
    rng = random.Random(1)
    rows = corpus() + [(200, "a b c " * 40), (201, " ".join(rng.choice("abcd") for _ in range(700))), (202, "line one\nline one\n\n \nx #*$%&|<> y\nline one"), (None, "w " * 60)]
    got = sorted(map(str, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(frame(spark, rows)).collect())))
    assert got == sorted(map(str, ((i, *brute.quality(t)) for i, t in rows)))
    assert quality.judge(frame(spark, [])).count() == 0


def test_quality_verdicts(spark):
    prose = "\n".join(" ".join(f"word{i}x{j}" for j in range(14)) + "." for i in range(6))
    menu = "\n".join(f"Home {i} | News {i} | About {i}" for i in range(60))
    rows = [(1, prose), (2, prose + "\nSign in"), (3, menu), (4, prose + "\n" + menu)]
    assert {r.doc_id: r.kept for r in quality.judge(frame(spark, rows)).collect()} == {1: True, 2: True, 3: False, 4: False}
    kept = {r.doc_id: r.text for r in quality.clean_documents(frame(spark, rows)).collect()}
    assert kept == {1: prose, 2: prose}
    assert quality.judge(frame(spark, rows)).where("kept").count() == 2


def test_quality_of_very_long_lines(spark):
    n = 1_000_000
    rows = [(1, "a|" * n), (2, "| " * n), (3, "»" * n), (4, "word " * n), (5, "read more " * n), (6, "x" * n), (7, " " * n), (8, "a\n" * n)]
    got = {r.doc_id: (r.n_words, r.kept, r.n_lines_removed) for r in quality.judge(frame(spark, rows)).collect()}
    assert got == {1: (1, False, 1), 2: (n, False, 1), 3: (1, False, 1), 4: (n, False, 0), 5: (2 * n, False, 1), 6: (1, False, 1), 7: (0, False, 0), 8: (n, False, n)}


def test_navigation_is_the_pattern_it_stands_for(spark):
    import re

    from pyspark.sql import functions as F

    rng = random.Random(1)
    pattern = re.compile(r"^(?:[^|»›•·>]{1,40}[|»›•·>]){2,}[^|»›•·>]{0,40}\Z")
    lines = {"".join(rng.choice("ab|» ") for _ in range(rng.randint(0, 14))) for _ in range(2000)}
    lines |= {"a" * i + "|" + "b" * j + "›" + "c" * k for i in (0, 1, 39, 40, 41) for j in (0, 1, 40, 41) for k in (0, 1, 40, 41)}
    got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", quality.navigation(F.col("x")).alias("y")).collect()
    assert {r.x for r in got if r.y} == {x for x in lines if pattern.search(x)}


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 30))), rng.choice(["a", "b", "é", "z", None, "c"])) for i in range(300)]
    rows += [(1000, "the only one here", "tiny"), (1001, None, "void"), (1002, "same row", "b"), (1002, "same row", "b"), (None, "no id", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sizes(df).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = brute.targets(size, (5, 2, 1), 3)
    by_id = {i: s for i, _, s in rows}
    taken = {s: 0 for s in size}
    for r in got:
        s = by_id[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in size:
        assert want[s] - 3 <= taken[s] <= want[s]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sizes(df.repartition(7)).collect()))
    mixed = mixing.mix_documents(df).collect()
    assert sum(len(r.text.split()) for r in mixed) == sum(taken.values())
    assert mixing.mix_sizes(df.limit(0)).count() == 0 and mixing.mix_documents(df.limit(0)).count() == 0


def test_archive(spark, tmp_path):
    rows = [(5, "u5", "same"), (2, "u2", "same"), (9, None, "other é"), (7, "u7", None), (8, "a\r\nb", ""), (None, "x", "same"), (2, "u2", "same"), (11, "y", "z" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive(df).collect())))
    first = {"same": 2, "": 7}
    want = []
    for i, _, t in rows:
        p = (t or "").encode()
        ref = first.get(t or "")
        again = ref is not None and i != ref
        want.append(str((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", ref if again else None)))
    assert got == sorted(want)
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    files = [{(r.path.rsplit("/")[-1], r.sha256) for r in warc.write_pages(df.repartition(n), at).collect()} for n, at in ((1, a), (5, b))]
    assert files[0] == files[1]
    texts = {r.page_id: r.payload for r in warc.read_pages(warc.write_pages(df, f"file://{tmp_path}/c"), f"file://{tmp_path}/c").where("record_type = 'response'").collect()}
    assert bytes(texts[9]) == "other é".encode() and len(texts[11]) == 100_000
    assert warc.archive(df.limit(0)).count() == 0


def test_archive_layout_depends_on_the_data_alone(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i if i % 3 else None, f"u{i % 50}", "".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 900)))) for i in range(600)]
    rows += [(7, "u", "hot")] * 40 + [(900 + i, f"v{i}", "shared payload") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in (3, 11):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        at = f"file://{tmp_path}/{n}"
        made = warc.write_pages(df.repartition(n), at, shard_bytes=40_000, roll_bytes=9_000)
        seen.append(sorted((r.path.rsplit("/")[-1], r.shard, r.seq, r.n_records, r.n_bytes, r.sha256) for r in made.collect()))
        if n == 3:  # a task that is run again, and one that is stopped halfway, change nothing
            (tmp_path / "3" / "warc" / ".left-over.tmp").write_bytes(b"half a file")
            again = warc.write_pages(df, at + "/again", shard_bytes=40_000, roll_bytes=9_000)
            fs, folder = common.filesystem(at + "/again/warc")
            first = again.first()
            w = warc.Writer(fs, folder, first.shard, first.seq)
            for raw in warc.members((tmp_path / "3" / "again" / "warc" / first.path.rsplit("/")[-1]).read_bytes()):
                w.add(raw)
            assert w.close()["sha256"] == first.sha256
            got = warc.read_pages(made, at).collect()
            assert len(got) == len(rows) and sum(r.record_type == "revisit" for r in got) >= 29
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
    assert len({x[1] for x in seen[0]}) > 5 and max(x[2] for x in seen[0]) > 0
    order = [h.get("Page-ID") for x in seen[0] for h, _ in warc.parse((tmp_path / "3" / "warc" / x[0]).read_bytes())]
    ids = [int(x) for x in order if x is not None]
    assert ids == sorted(ids) and order[: len(order) - len(ids)] == [None] * (len(order) - len(ids))
    names = [h["WARC-Record-ID"] for x in seen[0] for h, _ in warc.parse((tmp_path / "3" / "warc" / x[0]).read_bytes())]
    assert len(names) == len(set(names)) == len(rows)


def test_many_gzip_members_are_read_in_linear_time():
    import time

    took = []
    for n in (2000, 16_000):
        data = b"".join(warc.gzip_member(b"x%d" % i * 40) for i in range(n))
        began = time.process_time()
        assert sum(1 for _ in warc.members(data)) == n
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 0.5


def test_spoiled_token_files_are_noticed(spark, tmp_path):
    at = f"file://{tmp_path}"
    made = packing.write_tokens(frame(spark, corpus()), at, partitions=1)
    path = made.first().path
    raw = bytearray(open(path, "rb").read())
    raw[100] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="checksum"):
        packing.read_tokens(made, at).collect()


def test_urls(spark):
    rows = [
        (1, "HTTP://A.Example.ORG/es/1?x#y", ""), (2, None, "x"), (3, "no scheme", None), (4, "http://b.net/2", '<link rel="canonical" href="http://q.example.org/es/9">'),
        (4, "http://b.net/2", None), (5, "https://c.net/", '<meta http-equiv="refresh" content="0; url=//b.net/2">'), (6, "http://d.com/fr/", "<link href=/x rel=canonical>"),
        (7, "http://d.com/x", ""), (8, "http://notexample.org", ""), (9, "http://e.com/de/?q", ""), (10, "http://f.net/a", "<link rel=canonical href='http://g.com/fr/1'>"), (11, "http://f.net/b#z", "<link rel=canonical href='http://f.net/a'><meta http-equiv=refresh content='1;url=http://h.com/de/'>"),
        (12, "http://f.net/c", "<meta http-equiv=refresh content='1;url=http://h.com/de/'>"), (None, "http://f.net/c?d", "<link rel=canonical href='e/f'>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for rules in (urls.RULES, urls.RULES + tuple(("block", f"r{i}.test", "/") for i in range(80))):
        got = sorted({(r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, rules).collect()}, key=str)
        want = {
            (1, "a.example.org", "/es/1", "example.org/es/", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "b.net", "/2", None, "block"), (5, "c.net", "/", None, "block"),
            (6, "d.com", "/fr/", "com/fr/", "allow"), (7, "d.com", "/x", None, "allow"), (8, "notexample.org", "", None, "allow"), (9, "e.com", "/de/", "com/de/", "block"),
            (10, "f.net", "/a", None, "allow"), (11, "f.net", "/b", None, "allow"), (12, "f.net", "/c", None, "block"), (0, "f.net", "/c", None, "allow"),
        }
        assert got == sorted(want, key=str)
    assert urls.judge(df.limit(0)).count() == 0


def test_grouped_yields_whole_groups():
    import pyarrow as pa

    keys = np.sort(np.random.default_rng(0).integers(0, 9, 200))
    t = pa.table({"k": keys, "v": np.arange(200)})
    out = list(common.grouped(iter(t.to_batches(max_chunksize=7)), 1))
    seen = [set(x.column("k").to_pylist()) for x in out]
    assert sum(map(len, seen)) == len(set(keys.tolist())) and sum(x.num_rows for x in out) == 200


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    words = ["".join(rng.choice("klmnoprst") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    prose = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(12)).capitalize() + "." for _ in range(n))
    shared = prose(4)
    rows = [(i, prose(9), "en", f"s{i % 4}") for i in range(30)]
    rows += [(30, rows[2][1], "en", "s1"), (31, rows[3][1] + "\nSign in", "en", "s0"), (32, "too short", "en", "s0")]
    rows += [(i, prose(5) + "\n" + shared + "\n" + prose(5), "en", "s2") for i in (40, 41)]
    df = spark.createDataFrame([(i, t, a, s, len(t)) for i, t, a, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, steps = df, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        steps[name] = docs.collect()
    cleaned = {r.doc_id: r.text for r in steps["quality_rules"]}
    assert 32 not in cleaned and cleaned[31] == rows[3][1] and cleaned[0] == rows[0][1]
    left = sorted(r.doc_id for r in steps["near_dedup"])
    assert left == sorted(i for i, _, _, k in brute.near_dedup(sorted(cleaned.items()), 5, 80) if k)
    texts = [(i, cleaned[i]) for i in left]
    assert sorted((r.doc_id, r.text) for r in steps["substring_dedup"]) == [(i, b.decode("utf-8", "ignore")) for i, b, _, _ in brute.repeated_bytes(texts, 200)]
    size = {}
    for r in steps["substring_dedup"]:
        size[r.source] = size.get(r.source, 0) + len(r.text.split())
    want, got = brute.targets(size, (5, 2, 1), 3), {}
    for r in steps["mix"]:
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert all(want[s] - 1 <= got[s] <= want[s] for s in size)
    assert len(steps["encode"]) == len(steps["mix"])
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, steps["encode"]))
