"""BPE encoding and decoding with reuse of content-defined chunks.

A document is cut where a rolling hash of its last two words has fixed low bits, so that equal passages are cut alike
wherever they stand. A chunk is encoded once and kept under its hash; documents that share it take the ids from there.
Then each join of two chunks is checked: the words around it are encoded together by the tokenizer, and if that is not
what the chunks have there, the stretch is widened word by word until its ids agree with the chunks on both sides, and
takes their place. A chunk begins with the white space before its first word. For a tokenizer that drops white space a
new chunk is put together from ids of its words, each of which is encoded once; any other tokenizer encodes the text of
a new chunk.

The stores belong to one Python worker and are bounded; when one is full it starts anew. No text is shuffled: an
executor that is lost costs only its running tasks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nearfield.llm import common as C

U = np.uint64
ENDS, LETTER = np.zeros(256, bool), np.zeros(256, bool)
ENDS[np.frombuffer(b".,;:!?", np.uint8)] = True
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Mean words of a chunk; a power of two.
CHUNK_WORDS = 256
#: Entries of a store, and its ids, before it starts anew; a store takes some 40 MB then.
MOST_ENTRIES = 1 << 20
MOST_IDS = 1 << 23
#: Joins known to agree, before they are forgotten.
MOST_JOINS = 1 << 16


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Store:
    """Ids under 64-bit hashes, as flat arrays with sorted keys."""

    def __init__(self, kind: type = np.int32) -> None:
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, U), np.zeros(0, np.int32)
        self.start, self.count, self.check = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 12, self.kind), 0

    def find(self, keys: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Slots, -1 where unknown. ``check`` is the length of what was hashed; a hit must have the same."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        slot = self.slot[at]
        return np.where((self.keys[at] == keys) & (self.check[slot] == check), slot, -1)

    def add(self, keys: np.ndarray, check: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), self.kind)])
        self.ids[self.used : self.used + len(ids)] = ids
        slots = np.arange(len(self.count), len(self.count) + len(keys), dtype=np.int32)
        self.start = np.concatenate([self.start, (self.used + np.cumsum(counts) - counts).astype(np.int32)])
        self.count, self.check = np.concatenate([self.count, counts.astype(np.int32)]), np.concatenate([self.check, check.astype(np.int32)])
        self.used += len(ids)
        at = np.searchsorted(self.keys, keys)  # new keys come sorted
        self.keys, self.slot = np.insert(self.keys, at, keys), np.insert(self.slot, at, slots)

    def full(self, new: int) -> bool:
        return len(self.keys) + new > MOST_ENTRIES or self.used > MOST_IDS

    def take(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slots end to end, and how many each has."""
        counts = self.count[slots].astype(np.int64)
        return self.ids[C.ragged(self.start[slots].astype(np.int64), counts)].astype(np.int32), counts


def _drops_space(spec: dict) -> bool:
    """Whether words split at ASCII white space are encoded independently of each other by this tokenizer."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    known = {"NFC", "Lowercase", "Replace"}
    norm = (spec.get("normalizer") or {}).get("normalizers") or []
    split = steps[0] if steps else {}
    return (
        split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and split.get("invert") is True
        and {x["type"] for x in norm} <= known
        and all(x["pattern"] == {"Regex": "\\s+"} for x in norm if x["type"] == "Replace")
        and steps[1].get("type") == "ByteLevel"
        and not steps[1].get("use_regex", True)
        and not steps[1].get("add_prefix_space", True)
        and spec.get("post_processor") is None
    )


class Encoder:
    """A tokenizer with its stores of words and chunks, and the joins known to agree."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = _drops_space(spec)
        self.plain_decoder = spec.get("decoder") is None
        size = self.tokenizer.get_vocab_size()
        self.vocabulary = size
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.decimals = [str(i) for i in range(size)]
        self.closes = np.array([x.endswith("</w>") for x in self.tokens], np.int64)
        kind = np.uint16 if size <= 1 << 16 else np.int32
        self.words, self.chunks = Store(kind), Store(kind)
        self.agreed: set[int] = set()
        self.known: dict[bytes, tuple[list[int], list[int]]] = {}
        self.repairs = 0

    def __call__(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _new_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single words, and how many each has, encoded some hundred at a time.

        A word of letters ends with the one token that closes a word, which is counted; offsets tell the other words apart.
        """
        plain = np.fromiter((x.isalpha() for x in texts), bool, len(texts))
        counts, got = np.zeros(len(texts), np.int64), np.zeros(0, np.int32)
        where = []
        for which, letters in ((np.flatnonzero(plain), True), (np.flatnonzero(~plain), False)):
            part = [texts[i] for i in which.tolist()]
            joined = [part[lo : lo + 512] for lo in range(0, len(part), 512)]
            if not part:
                continue
            if letters:
                found = self.tokenizer.encode_batch_fast([" ".join(x) for x in joined], add_special_tokens=False)
                ids = np.array([i for e in found for i in e.ids], np.int32)
                owner = np.cumsum(self.closes[ids]) - self.closes[ids]
                letters = len(ids) > 0 and self.closes[ids[-1]] == 1 and owner[-1] + 1 == len(part)
            if not letters:
                ids, owner, lo = [], [], 0
                for x, e in zip(joined, self.tokenizer.encode_batch([" ".join(x) for x in joined], add_special_tokens=False), strict=True):
                    starts = C.offsets_of(np.fromiter((len(w) + 1 for w in x), np.int64, len(x)))
                    ids.append(np.array(e.ids, np.int32))
                    owner.append(lo + np.searchsorted(starts, np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids)), "right") - 1)
                    lo += len(x)
                ids, owner = np.concatenate(ids), np.concatenate(owner)
            where.append((ids, which[owner]))
        if where:
            owner = np.concatenate([w for _, w in where])
            order = np.argsort(owner, kind="stable")
            got, counts = np.concatenate([i for i, _ in where])[order], np.bincount(owner, minlength=len(texts))
        return got, counts

    def encode_words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and how many each has."""
        uniq, at, back = np.unique(key, return_index=True, return_inverse=True)
        length = (end - start)[at]
        slot = self.words.find(uniq, length)
        new = np.flatnonzero(slot < 0)
        if len(new):
            if self.words.full(len(new)):
                self.words.clear()
                new = np.arange(len(uniq))
            raw = data.tobytes()
            ids, counts = self._new_words([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)])
            self.words.add(uniq[new], length[new], ids, counts)
            slot = self.words.find(uniq, length)
        return self.words.take(slot[back])

    def _join(self, left: list[str], right: list[str], ids_left: list[int], ids_right: list[int]) -> tuple[int, list[int], int] | None:
        """None if the ids beside a join are what the tokenizer gives; else (drop left, ids between, drop right)."""
        n = 1
        while True:
            a, b = " ".join(left[-n:]), " ".join(right[:n])
            x, y, both = self(a), self(b), self(f"{a} {b}")
            fits = ids_left[len(ids_left) - len(x) :] == x and ids_right[: len(y)] == y
            if fits and both == x + y:
                return None
            outer = fits and (n < max(len(left), len(right)))
            if outer and len(x) and len(y) and both[: 1] == x[: 1] and both[-1:] == y[-1:] or n >= max(len(left), len(right)):
                return min(len(x), len(ids_left)) if fits else len(ids_left), both, min(len(y), len(ids_right)) if fits else len(ids_right)
            n *= 2

    @staticmethod
    def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes in lower case, and the words; punctuation that ends a word after an ASCII letter is a word of its own.

        The tokenizer splits there and lowers case itself; only a word with "<", which may be a special token, keeps it.
        """
        start, end, row = C.words(data, offsets)
        low = C.LOWER[data]
        angle = np.flatnonzero(data == 0x3C)
        if len(angle):
            w = np.unique(np.searchsorted(start, angle, "right") - 1)
            i = C.ragged(start[w], (end - start)[w])
            low[i] = data[i]
        stop = end - 1
        for _ in range(3):  # up to three marks; more stay with their word
            more = (stop >= start) & ENDS[data[np.maximum(stop, 0)]]
            stop = np.where(more, stop - 1, stop)
        split = (stop >= start) & (stop < end - 1) & LETTER[data[np.maximum(stop, 0)]]
        if len(angle):
            split[w] = False
        at = np.flatnonzero(split)
        middle = stop[at] + 1
        return low, np.insert(start, at + 1, middle), np.insert(end, at, middle), np.insert(row, at, row[at])

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray, cut: int = CHUNK_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and how many each has."""
        rows = len(offsets) - 1
        if not self.by_word:
            return self._encode_texts(data, offsets, cut or CHUNK_WORDS)
        data, start, end, row = self._pieces(data, offsets)
        n = len(start)
        if not n:
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        key = C.span_hash(C.prefix(data), start, end)
        if not cut:
            ids, counts = self.encode_words(data, start, end, key)
            return ids, np.bincount(row, weights=counts, minlength=rows).astype(np.int64)
        # chunks: cut after a word at which the hash of the last two words says so, and where rows end
        last = np.empty(n, bool)
        last[-1], last[:-1] = True, row[1:] != row[:-1]
        roll = key.copy()
        roll[1:] += key[:-1] * U(3)
        stop = np.flatnonzero(last | ((C.mix(roll) & U(cut - 1)) == 0)) + 1
        first = np.concatenate([[0], stop[:-1]])
        p = np.zeros(n + 1, U)
        np.cumsum(key * C.powers(n), out=p[1:])
        name = C.span_hash(p, first, stop)
        uniq, at, back = np.unique(name, return_index=True, return_inverse=True)
        length = end[stop[at] - 1] - start[first[at]]
        slot = self.chunks.find(uniq, length)
        new = np.flatnonzero(slot < 0)
        if len(new):
            if self.chunks.full(len(new)):
                self.chunks.clear()
                new = np.arange(len(uniq))
            w = C.ragged(first[at[new]], (stop - first)[at[new]])
            ids, counts = self.encode_words(data, start[w], end[w], key[w])
            ends = np.cumsum((stop - first)[at[new]])
            sums = C.offsets_of(counts)
            self.chunks.add(uniq[new], length[new], ids, sums[ends] - sums[ends - (stop - first)[at[new]]])
            slot = self.chunks.find(uniq, length)
        ids, counts = self.chunks.take(slot[back])
        ids, counts = self._joined(data, start, end, key, first, stop, row, ids, counts)
        return ids, np.bincount(row[first], weights=counts, minlength=rows).astype(np.int64)

    def _joined(self, data, start, end, key, first, stop, row, ids, counts) -> tuple[np.ndarray, np.ndarray]:
        """Check each join of two chunks of a row; put right those at which the tokenizer disagrees."""
        inner = np.flatnonzero(row[first[1:]] == row[first[:-1]])
        if not len(inner):
            return ids, counts
        l, r = stop[inner] - 1, first[inner + 1]
        pair = C.mix(key[l] * U(3) + key[r] + (end[l] == start[r])).tolist()
        raw, sums, repaired = data.tobytes(), C.offsets_of(counts), {}
        touch = (end[l] == start[r]).tolist()
        if len(self.agreed) > MOST_JOINS:
            self.agreed.clear()
        word = lambda i: raw[start[i] : end[i]].decode("utf-8", "replace")
        for k, p, t in zip(inner.tolist(), pair, touch, strict=True):
            if p in self.agreed:
                continue
            a, b = range(first[k], stop[k]), range(first[k + 1], stop[k + 1])
            x, y = ids[sums[k] : sums[k + 1]].tolist(), ids[sums[k + 1] : sums[k + 2]].tolist()
            both = self(word(a[-1]) + " " * (not t) + word(b[0]))
            split = len(both) - 1
            # the ids beside the join must be what the tokenizer gives for the two words together
            if any(both[: split - i] == x[len(x) - (split - i) :] and both[split - i :] == y[: i + 1] for i in range(-1, split + 1) if split - i <= len(x) and i + 1 <= len(y)):
                self.agreed.add(p)
                continue
            fix = self._join([word(i) for i in a], [word(i) for i in b], x, y)
            if fix is not None:
                repaired[k] = fix
        if not repaired:
            return ids, counts
        parts, lengths = [], counts.copy()
        skip = 0
        for k in range(len(counts)):
            own = ids[sums[k] + skip : sums[k + 1]]
            skip = 0
            if k in repaired:
                drop, between, skip = repaired[k]
                own = np.concatenate([own[: max(0, len(own) - drop)], np.array(between, np.int32)])
            parts.append(own)
            lengths[k] = len(own)
        return np.concatenate(parts), lengths

    def _encode_texts(self, data: np.ndarray, offsets: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode_rows`, for a tokenizer that keeps white space: chunks are encoded as texts."""
        rows = len(offsets) - 1
        start, end, row = C.words(data, offsets)
        key = C.span_hash(C.prefix(C.LOWER[data]), start, end) if len(start) else np.zeros(0, U)
        roll = key.copy()
        roll[1:] += key[:-1] * U(3)
        inner = np.append(row[1:] == row[:-1], False)[: len(row)]
        ends = end[((C.mix(roll) & U(cut - 1)) == 0) & inner]  # chunks end with a word, or with their row
        stop = np.unique(np.concatenate([ends, offsets[1:][np.diff(offsets) > 0]]))
        first = np.concatenate([[0], stop[:-1]]).astype(np.int64)
        if not len(stop):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        name = C.span_hash(C.prefix(data), first, stop)
        uniq, at, back = np.unique(name, return_index=True, return_inverse=True)
        length = (stop - first)[at]
        slot = self.chunks.find(uniq, length)
        new = np.flatnonzero(slot < 0)
        raw = data.tobytes()
        if len(new):
            if self.chunks.full(len(new)):
                self.chunks.clear()
                new = np.arange(len(uniq))
            texts = [raw[first[at[i]] : stop[at[i]]].decode("utf-8", "replace") for i in new.tolist()]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self.chunks.add(uniq[new], length[new], np.array([i for x in found for i in x], np.int64), np.array([len(x) for x in found], np.int64))
            slot = self.chunks.find(uniq, length)
        ids, counts = self.chunks.take(slot[back])
        owner = np.searchsorted(offsets, first, "right") - 1
        sums, out, lengths = C.offsets_of(counts), [], np.zeros(rows, np.int64)
        chunk = 0
        word_of = np.searchsorted(start, first)  # the first word of each chunk
        while chunk < len(stop):
            r, got = int(owner[chunk]), ids[sums[chunk] : sums[chunk + 1]].tolist()
            lo, hi = np.searchsorted(row, r), np.searchsorted(row, r, "right")
            chunk += 1
            while chunk < len(stop) and owner[chunk] == r:
                last = min(int(np.searchsorted(start, stop[chunk])), int(hi))
                self._append(got, ids[sums[chunk] : sums[chunk + 1]].tolist(), raw, int(offsets[r]), int(first[chunk]), int(stop[chunk]), end[lo : word_of[chunk]], end[word_of[chunk] : last])
                chunk += 1
            out.append(np.array(got, np.int32))
            lengths[r] = len(got)
        return np.concatenate(out), lengths

    def _append(self, left: list[int], right: list[int], raw: bytes, begin: int, at: int, stop: int, before: np.ndarray, after: np.ndarray) -> None:
        """Add to ``left``, the ids of raw[begin:at], those of the chunk raw[at:stop], which are ``right`` on their own.

        ``before`` and ``after``: where the words on either side of the join end. The words next to the join are encoded
        together; where that differs, so are 2, 4, 8 ... of each side, until the outermost words have the ids that they
        have in the chunks, at most everything up to ``stop``.
        """
        n = 1
        while True:
            lo = int(before[-n - 1]) if n < len(before) else begin
            hi = int(after[n - 1]) if n < len(after) else stop
            text_a, text_b = raw[lo:at], raw[at:hi]
            whole = lo == begin and hi == stop
            if n == 1:
                name = text_a + b"\xff" + text_b
                if name in self.known:
                    x, y = self.known[name]
                    if left[len(left) - len(x) :] == x and right[: len(y)] == y:
                        left += right
                        return
            a, b = text_a.decode("utf-8", "replace"), text_b.decode("utf-8", "replace")
            x, y, both = self(a), self(b), self(a + b)
            fits = left[len(left) - len(x) :] == x and right[: len(y)] == y
            if fits and both == x + y:
                if n == 1:
                    if len(self.known) > MOST_JOINS:
                        self.known.clear()
                    self.known[name] = (x, y)
                left += right
                return
            if whole:
                self.repairs += 1
                left[:] = both
                return
            # the outermost words must have the ids that they have in the chunks
            outer_a = self(raw[lo : int(before[-n])].decode("utf-8", "replace")) if n < len(before) else []
            outer_b = self(raw[int(after[n - 2]) if n > 1 else at : hi].decode("utf-8", "replace")) if hi < stop else []
            if n > 1 and fits and both[: len(outer_a)] == outer_a == x[: len(outer_a)] and (not outer_b or both[-len(outer_b) :] == outer_b == y[-len(outer_b) :]) and len(both) >= len(outer_a) + len(outer_b):
                self.repairs += 1
                del left[len(left) - len(x) :]
                left += both + right[len(y) :]
                return
            n *= 2

    def decode(self, ids: list[int]) -> str:
        if self.plain_decoder:  # tokens with a space between
            return " ".join([self.tokens[i] for i in ids])
        return self.tokenizer.decode(ids, skip_special_tokens=False)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, with what its stores have gathered in earlier tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of each whole text. Null or empty: no ids. Ids that are null or repeat, and repeated rows,
    stay as they are; other columns are not read; an empty table gives no rows."""
    C.bound_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for lo, hi, data, off in C.slices(b.column(1), 1 << 21):
                ids, counts = enc.encode_rows(data, off)
                yield pa.record_batch([b.column(0)[lo:hi], pa.ListArray.from_arrays(pa.array(C.offsets_of(counts).astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return C.map_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), with special tokens; no ids give an empty text."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([enc.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return C.map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, encoded and decoded in one pass.

    As :func:`encode_documents` and :func:`decode_documents` one after the other, without handing ids back to the JVM.
    """
    C.bound_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            for lo, hi, data, off in C.slices(b.column(1), 1 << 21):
                ids, counts = enc.encode_rows(data, off)
                at = C.offsets_of(counts).tolist()
                lists = [ids[x:y].tolist() for x, y in zip(at, at[1:], strict=False)]
                yield pa.record_batch(
                    [
                        b.column(0)[lo:hi],
                        pa.array(counts),
                        pa.array([sha(" ".join([enc.decimals[i] for i in x])) for x in lists], pa.string()),
                        pa.array([sha(enc.decode(x)) for x in lists], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return C.map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
