"""Byte-level BPE by a two-tier lookup.

A text is cut into pre-tokens by a pattern. A minimal perfect hash over the vocabulary
resolves those that are tokens themselves; each of the others starts as a linked list of
its bytes, and a heap gives the next pair to merge. Decoding concatenates tokens.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import living

#: Keys of a bucket on average; buckets of one key take what is free at the end.
PER_BUCKET = 4
#: Pre-tokens that a worker keeps with their ids: so many that were asked for of late, and as many of before.
CACHE_WORDS = 250_000
#: Longer pre-tokens are not kept.
CACHE_CHARS = 64
#: Texts with more characters are cut into so many pre-tokens at a time.
LONG_TEXT, AT_ONCE = 1 << 20, 1 << 16
#: Bytes of ids or text after which a batch is closed.
BATCH_BYTES = 8 << 20

_ALL = (1 << 64) - 1
_STEP, _MUL = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class PerfectHash:
    """A minimal perfect hash by displacements: n distinct keys get the slots 0 to n - 1.

    A key's first 64 hash bits give its bucket; the second, stepped on by the bucket's
    displacement and mixed, its slot. Buckets are placed by falling size, each with the first displacement
    under which all its keys fall into free slots; a bucket of one key names its slot
    itself, as a negative number. A key outside the set gets some slot too: whoever asks
    compares the key there.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = -(-self.n // PER_BUCKET) or 1
        first, second = self._halves(keys)
        bucket = (first % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        self.moves = np.zeros(self.buckets, np.int64)
        free = np.ones(self.n, bool)
        single: list[int] = []
        for b in np.argsort(-sizes, kind="stable"):
            own = second[order[starts[b] : starts[b + 1]]]
            if len(own) == 1:
                single.append(int(b))
            elif len(own):
                self.moves[b] = self._fit(own, free)
        for b, slot in zip(single, np.flatnonzero(free).tolist(), strict=True):
            self.moves[b] = -slot - 1
        self._moves = self.moves.tolist()

    @staticmethod
    def _halves(keys: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def _at(self, second: np.ndarray, moves: np.ndarray) -> np.ndarray:
        mixed = (second + moves.astype(np.uint64) * np.uint64(_STEP)) * np.uint64(_MUL)
        return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(self.n)).astype(np.int64)

    def _fit(self, own: np.ndarray, free: np.ndarray) -> int:
        if len(np.unique(own)) < len(own):
            raise ValueError("a key is there twice")
        at, many = 0, 64
        while True:
            slots = np.sort(self._at(own[None, :], np.arange(at, at + many)[:, None]), axis=1)
            good = free[slots].all(axis=1) & (np.diff(slots, axis=1) > 0).all(axis=1)
            if good.any():
                k = int(good.argmax())
                free[slots[k]] = False
                return at + k
            at, many = at + many, min(4 * many, 1 << 14)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key."""
        first, second = self._halves(keys)
        moves = self.moves[(first % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(moves < 0, -moves - 1, self._at(second, np.maximum(moves, 0)))

    def slot(self, key: bytes) -> int:
        """The slot of one key."""
        first, second = struct.unpack("<QQ", xxhash.xxh3_128_digest(key))
        move = self._moves[first % self.buckets]
        if move < 0:
            return -move - 1
        mixed = (second + move * _STEP) * _MUL & _ALL
        return (mixed ^ mixed >> 32) % self.n


class Model:
    """The tokens of a rank file (base64 and rank on each line) and how to encode and decode with them."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.longest = max(map(len, ranks))
        self.hash = PerfectHash(list(ranks))
        self.tokens = [b""] * self.hash.n
        self.ranks = [0] * self.hash.n
        for (token, rank), slot in zip(ranks.items(), self.hash.slots(list(ranks)).tolist(), strict=True):
            self.tokens[slot], self.ranks[slot] = token, rank
        self.packed = [struct.pack("<I", r) for r in self.ranks]
        self.token_of = {r: t for t, r in zip(self.tokens, self.ranks, strict=True)}
        self.merges = ranks
        self.pattern = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def merged(self, word: bytes) -> list[int]:
        """Ids of a pre-token by merging: of all neighbours the pair of the least rank, of equal ones the leftmost, until none is a token."""
        n, rank = len(word), self.merges.get
        ends = list(range(1, n + 1))  # of the part that starts here; 0 inside a part
        before = list(range(-1, n))  # start of the part on the left
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = ends[i]
            if not middle or middle >= n or ends[middle] != end:
                continue  # one of the two has been merged meanwhile
            ends[i], ends[middle] = end, 0
            if end < n:
                before[end] = i
                if (after := ends[end]) - i <= self.longest and (r := rank(word[i:after])) is not None:
                    heapq.heappush(heap, (r, i, after))
            if (left := before[i]) >= 0 and end - left <= self.longest and (r := rank(word[left:end])) is not None:
                heapq.heappush(heap, (r, left, end))
        ids, i = [], 0
        while i < n:
            ids.append(rank(word[i : ends[i]]))
            i = ends[i]
        return ids

    def _resolve(self, words: list[str]) -> None:
        keys = [w.encode() for w in words]
        for word, key, slot in zip(words, keys, self.hash.slots(keys).tolist(), strict=True):
            if self.tokens[slot] == key:
                self.cache[word] = self.packed[slot]
            else:
                ids = self.merged(key)
                self.cache[word] = struct.pack(f"<{len(ids)}I", *ids)

    def _encode(self, words: list[str]) -> bytes:
        new = set(words).difference(self.cache)
        if new:
            known = {w: self.before[w] for w in new if w in self.before}
            self.cache.update(known)
            new = list(new.difference(known))
            self._resolve(new)
        ids = b"".join(map(self.cache.__getitem__, words))
        for w in new:
            if len(w) > CACHE_CHARS:
                del self.cache[w]
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.before = {}, self.cache
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        if len(text) <= LONG_TEXT:
            return self._encode(self.pattern.findall(text))
        found = (m.group() for m in self.pattern.finditer(text))
        return b"".join(map(self._encode, iter(lambda: list(islice(found, AT_ONCE)), [])))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids; an id without a token is a KeyError."""
        return b"".join(map(self.token_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def model(path: str, pattern: str) -> Model:
    return living(f"byte-bpe {path} {pattern}", lambda: Model(path, pattern))


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose last column's bytes stay near BATCH_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > BATCH_BYTES or len(held) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def encoded(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers, one row for each of ``docs``.

    A null text counts as empty and has no ids; strings of special tokens are ordinary text.
    Repeated rows and rows of a null doc_id keep their rows; an empty table gives an empty
    result. A text of any length is held by one task, its pre-tokens a part at a time.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = model(path, pattern).encode
        rows = ((doc.as_py(), encode(text.as_py() or "")) for b in batches for doc, text in zip(*b.columns, strict=True))
        yield from _in_batches(((doc, len(ids) // 4, ids) for doc, ids in rows), schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decoded(tokens: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, decoded): the bytes that the ids of each row stand for; null ids count as none."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = model(path, pattern).decode
        rows = ((doc.as_py(), n.as_py(), ids.as_py() or b"") for b in batches for doc, n, ids in zip(*b.columns, strict=True))
        yield from _in_batches(((doc, n, ids, decode(ids)) for doc, n, ids in rows), schema)

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
