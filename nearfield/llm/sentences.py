"""Substring dedup by sliding sentence spans.

A sentence ends with a word that closes with ``.``, ``!``, ``?`` or one of their full-width forms, and at the end of a line;
nothing else ends one. A span is the shortest run of at least two sentences and twenty words from a given sentence on.
Every span is hashed, the hashes are counted over the corpus, and sentences go that a span covers which also stands
earlier, by (doc_id, hash of the text, position).

Three shuffles: 8 bytes a span to count; the spans themselves, of which only repeated ones are kept; then, for documents,
the repeated spans and the texts. A span that very many documents hold is counted before the shuffle; its occurrences
meet one row, in a join that adaptive execution can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm import common as C

U = np.uint64
#: A span has so many sentences and words at least; fewer words recur by chance.
SENTENCES = 2
WORDS = 20
#: Marks that close a sentence, and what may follow them within the word.
_MARK, _TAIL = np.zeros(256, bool), np.zeros(256, bool)
_MARK[np.frombuffer(b".!?", np.uint8)] = True
_TAIL[np.frombuffer(b"\"')]}", np.uint8)] = True
_WIDE = np.array([int.from_bytes(x.encode(), "big") for x in "。！？"], np.int32)


def spans(data: np.ndarray, offsets: np.ndarray):
    """Sentences as (first byte, one past the last, row) and spans as (first sentence, last sentence, hash, hash).

    The end of a sentence includes the white space up to the next one in its row.
    """
    low = C.LOWER[data]
    start, end, row = C.words(data, offsets)
    n = len(start)
    z = np.zeros(0, np.int64)
    if not n:
        return z, z, z, z, z, np.zeros(0, U), np.zeros(0, U)
    key = C.span_hash(C.prefix(low), start, end)
    last = end - 1
    tail = last - (_TAIL[data[last]] & (last > start))
    row_end = np.empty(n, bool)
    row_end[-1], row_end[:-1] = True, row[1:] != row[:-1]
    lines = C.offsets_of((data == 0x0A).astype(np.int64))
    newline = np.zeros(n, bool)
    newline[:-1] = lines[start[1:]] > lines[end[:-1]]
    close = row_end | _MARK[data[tail]] | newline
    wide = np.flatnonzero((end - start >= 3) & (data[last] >= 0x80))  # marks of three bytes
    if len(wide):
        three = (data[last[wide] - 2].astype(np.int32) << 16) | (data[last[wide] - 1].astype(np.int32) << 8) | data[last[wide]]
        close[wide] |= np.isin(three, _WIDE)
    w_stop = np.flatnonzero(close) + 1
    w_start = np.concatenate([[0], w_stop[:-1]])
    s_row = row[w_start]
    m = len(w_start)
    s_start = start[w_start]
    s_end = offsets[s_row + 1].copy()
    same = np.flatnonzero(s_row[1:] == s_row[:-1])
    s_end[same] = s_start[same + 1]
    row_last = np.searchsorted(s_row, s_row, "right") - 1
    i = np.arange(m)
    j = np.maximum(i + SENTENCES - 1, np.searchsorted(w_stop, w_start + WORDS))
    ok = j <= row_last
    i, j = i[ok], j[ok]
    hashes = []
    for salt in (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)):
        p = np.zeros(n + 1, U)
        np.cumsum(C.mix(key ^ salt) * C.powers(n), out=p[1:])
        hashes.append(C.span_hash(p, w_start[i], w_stop[j]))
    return s_start, s_end, s_row, i, j, *hashes


def _occurrences(docs: DataFrame) -> DataFrame:
    """(k, k2, doc_id, h, at): every span of every document; at counts the document's sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in C.slices(b.column(1)):
                _, _, s_row, i, _, k, k2 = spans(data, off)
                first = np.searchsorted(s_row, np.arange(hi - lo))
                row = s_row[i]
                yield pa.record_batch(
                    [pa.array(k.view(np.int64)), pa.array(k2.view(np.int64)), b.column(0)[lo:hi].take(pa.array(row)), b.column(2)[lo:hi].take(pa.array(row)), pa.array((i - first[row]).astype(np.int32))],
                    ["k", "k2", "doc_id", "h", "at"],
                )

    return C.map_arrow(docs, run, "k long, k2 long, doc_id long, h long, at int")


def _ours(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))


def _later(docs: DataFrame) -> DataFrame:
    """(doc_id, h, at): for each document, where spans begin that also stand earlier."""
    every = _occurrences(_ours(docs))
    twice = C.settle(every.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"))
    again = C.settle(every.join(twice, "k", "left_semi"))
    # null ids come last
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "at")
    # a table of its own, so that the join below has both sides from exchanges and a span that very many hold can be split
    first = C.settle(again.groupBy("k", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("k").alias("a"), F.col("k2").alias("b"), "first"))
    found = again.join(first, (F.col("k") == F.col("a")) & (F.col("k2") == F.col("b"))).where(place != F.col("first"))
    return found.groupBy("doc_id", "h").agg(F.collect_set("at").alias("at"))


def _cut(docs: DataFrame, schema: str, rows) -> DataFrame:
    """Documents beside their later spans; ``rows`` makes the output columns from (batch, kept texts, counts)."""
    ours = _ours(docs).select(F.col("doc_id").alias("id"), "text", F.col("h").alias("g"))
    both = ours.join(_later(docs), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("g") == F.col("h")), "left").select("id", "text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in C.slices(b.column(1)):
                at = b.column(2)[lo:hi]
                s_start, s_end, s_row, i, j, _, _ = spans(data, off)
                first = np.searchsorted(s_row, np.arange(hi - lo))
                counts = np.diff(np.append(first, len(s_row)))
                goes = np.zeros(len(s_row) + 1, np.int64)
                flat = at.flatten().to_numpy(zero_copy_only=False)
                if len(flat):
                    lengths = np.array([len(x) if x is not None else 0 for x in at.to_pylist()])
                    begin = np.repeat(first, lengths) + flat
                    stop = j[np.searchsorted(i, begin)]
                    np.add.at(goes, begin, 1)
                    np.add.at(goes, stop + 1, -1)
                gone = np.cumsum(goes)[:-1] > 0
                keep = np.ones(len(data) + 1, np.int64)
                g = np.flatnonzero(gone)
                mark = np.zeros(len(data) + 1, np.int64)
                np.add.at(mark, s_start[g], 1)
                np.add.at(mark, s_end[g], -1)
                keep = np.cumsum(mark)[:-1] == 0
                kept = data[keep]
                cut = np.concatenate([[0], np.cumsum(keep)])[off]
                removed = np.bincount(s_row[g], minlength=hi - lo)
                yield rows(b.column(0)[lo:hi], kept, cut, off, counts, removed)

    return C.map_arrow(both, run, schema)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed (sentences), n_bytes_removed, kept_sha256 (of the remaining UTF-8 bytes).

    Null or empty texts have no sentences; a text shorter than one span loses nothing, and one of any length is judged
    whole; a text without marks and line ends is one sentence; rows equal in id and text count as one document, and each
    gets the same result; ids that repeat with other texts are told apart by the text's hash; null ids come last; other
    columns are not read; an empty table gives no rows.
    """
    C.bound_batches(docs.sparkSession)

    def rows(ids, kept, cut, off, counts, removed):
        raw = kept.tobytes()
        c = cut.tolist()
        return pa.record_batch(
            [ids, pa.array(counts), pa.array(removed.astype(np.int64)), pa.array(np.diff(off) - np.diff(cut)), pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(c, c[1:], strict=False)], pa.string())],
            ["doc_id", "n_sentences", "n_removed", "n_bytes_removed", "kept_sha256"],
        )

    return _cut(docs, "doc_id long, n_sentences long, n_removed long, n_bytes_removed long, kept_sha256 string", rows)


def dedup_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the repeated sentences removed; cases as in :func:`judge`."""
    C.bound_batches(docs.sparkSession)

    def rows(ids, kept, cut, off, counts, removed):
        raw, c = kept.tobytes(), cut.tolist()
        return pa.record_batch([ids, pa.array([raw[x:y].decode("utf-8", "replace") for x, y in zip(c, c[1:], strict=False)], pa.string())], ["doc_id", "text"])

    return _cut(docs, "doc_id long, text string", rows)
