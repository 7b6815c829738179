"""Token ids in binary blocks with Elias-Fano coded document boundaries.

A block is one binary value: a fixed header, the boundaries of its documents and their
doc_ids, each as an Elias-Fano sequence with a sampled select structure, then the token ids
of all its documents, concatenated, as little-endian integers. Blocks are rows of a Parquet
folder, written by Spark's committer (so that a lost executor leaves no half file) in
ascending order of document: part by part, and within a part block by block.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, living, shared_dir, sized

#: Ids after which a block is closed; a longer document makes a longer block.
BLOCK_IDS = 1 << 20
#: Every so many boundaries, the place of its bit in the upper part is kept.
SELECT_EVERY = 64
MAGIC = b"EFTB"
#: Magic, bytes of an id, select interval, documents, those of null doc_id, token ids, least doc_id; then of each sequence: low bits, bytes of the low and of the high part.
_HEAD = struct.Struct("<4sBHIIQq BII BII")
#: Words of one worker's cache; past it the cache starts anew.
CACHE_WORDS = 300_000
#: The characters that byte-level BPE writes for bytes: printable ones stand for themselves, the others for 256 and up in turn.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}


class EliasFano:
    """A non-decreasing sequence of n integers up to ``top`` in about n * (2 + log2(top / n)) bits.

    The lower ``low_bits`` of each value are packed; the upper parts are unary: value i sets
    bit (upper part + i). select(i) finds the i-th set bit from the nearest sample.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :]) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little")
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        upper[places] = 1
        return cls(n, low_bits, low, np.packbits(upper, bitorder="little"), places[::SELECT_EVERY].astype(np.uint32))

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a]
        return bits.reshape(-1, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def select(self, first: int, last: int | None = None) -> np.ndarray:
        """Values ``first`` to ``last`` (exclusive; without it the one value), from the sample before the first on.

        Only the upper bits between the samples around these values are read.
        """
        last = first + 1 if last is None else last
        if not 0 <= first <= last <= self.n:
            raise IndexError((first, last))
        if first == last:
            return np.zeros(0, np.uint64)
        place = int(self.samples[first // SELECT_EVERY])
        after = (last - 1) // SELECT_EVERY + 1
        end = int(self.samples[after]) + 1 if after < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[place // 8 : (end + 7) // 8], bitorder="little")
        bits[: place % 8] = 0
        skipped = first % SELECT_EVERY
        places = np.flatnonzero(bits)[skipped : skipped + last - first] + place // 8 * 8
        return ((places - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(first, last)

    def parts(self) -> tuple[bytes, bytes, bytes]:
        return self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()


def pack(ids: bytes, counts: list[int], width: int, names: list[int | None] | None = None) -> bytes:
    """One block of documents with so many ids each; ``ids`` are all of them, ``width`` bytes each.

    ``names`` are the doc_ids, ascending, nulls first; without them they are 0, 1, 2 and so on.
    """
    names = list(range(len(counts))) if names is None else names
    known = [x for x in names if x is not None]
    least = known[0] if known else 0
    ends, named = EliasFano.of(np.cumsum([0, *counts])), EliasFano.of(np.array([x - least for x in known], np.uint64))
    head = _HEAD.pack(MAGIC, width, SELECT_EVERY, len(counts), len(names) - len(known), sum(counts), least, *(v for ef in (ends, named) for v in (ef.low_bits, len(ef.low), len(ef.high))))
    return b"".join([head, *ends.parts(), *named.parts(), ids])


class Block:
    """The boundaries (one more than documents), doc_ids and token ids of a packed block, by select."""

    def __init__(self, block: bytes):
        magic, width, every, docs, nulls, n_ids, least, *shape = _HEAD.unpack_from(block)
        if magic != MAGIC or every != SELECT_EVERY:
            raise ValueError("not a block of token ids")
        self.docs, self.nulls, self.least, at = docs, nulls, least, _HEAD.size
        found = []
        for n, (low_bits, low, high) in ((docs + 1, shape[:3]), (docs - nulls, shape[3:])):
            count = -(-n // SELECT_EVERY)
            parts = np.frombuffer(block, np.uint8, low, at), np.frombuffer(block, np.uint8, high, at + low), np.frombuffer(block, "<u4", count, at + low + high)
            found.append(EliasFano(n, low_bits, *parts))
            at += low + high + 4 * count
        self.ends, self.named = found
        self.ids = np.frombuffer(block, f"<u{width}", n_ids, at)

    def bounds(self, first: int, last: int) -> np.ndarray:
        """Where documents ``first`` to ``last`` (exclusive) begin among the ids, and where the last of them ends."""
        return self.ends.select(first, last + 1).astype(np.int64)

    def names(self, first: int, last: int) -> list[int | None]:
        nulls = max(0, min(last, self.nulls) - first)
        known = self.named.select(max(0, first - self.nulls), max(0, last - self.nulls))
        return [None] * nulls + [int(x) + self.least for x in known]


#: What a tokenizers file has to say for its ids to be those of its words, one by one: fixed values.
WORD_KIND = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "model": "BPE",
}


def of_words(tokenizer) -> bool:
    """Whether a tokenizer is of the kind that can be applied word by word."""
    said = json.loads(tokenizer.to_str())
    return {"normalizer": said["normalizer"], "pre_tokenizer": said["pre_tokenizer"], "model": said["model"]["type"]} == WORD_KIND


class WordEncoder:
    """Encodes whole texts with a tokenizers file.

    If the file says that it normalises and splits text in the way of ``WORD_KIND``, the ids
    of a text are those of its words in turn, and each distinct word is encoded once. Texts
    that may hold a special token, and all texts of other files, go to the library whole.
    """

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = of_words(self.tokenizer)
        self.kind = f"<u{width}"
        self.special = [t.content.encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def word(self, word: bytes) -> bytes:
        """Ids of one word. Closing punctuation after a letter or digit is a token of its own; after anything else it is part of
        a longer run, and the word is encoded whole. Words of letters alone need no normaliser."""
        stem = word.rstrip(b".,!?;:")
        if stem != word and stem.decode().lower()[-1:].isalnum():
            tail = word[len(stem) :]
            return (self.cache.get(stem) or self.word(stem)) + (self.cache.get(tail) or self.word(tail))
        text = word.decode()
        low = text if text.isascii() else unicodedata.normalize("NFC", text).lower()
        if low.isalpha() and low.islower() and "\u03a3" not in text:
            found = [t.id for t in self.tokenizer.model.tokenize(low.encode().decode("latin-1").translate(BYTE_LEVEL))]
            ids = np.array(found, self.kind).tobytes()
        else:
            ids = self.whole(text)
        self.cache[word] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            b = t.encode("utf-8", "replace")
            if not self.by_word or any(s in b for s in self.special):
                out.append(self.whole(t))
                continue
            words = (b.lower() if t.isascii() else b).split()
            for w in set(words).difference(self.cache):
                self.cache[w] = self.word(w)
            out.append(b"".join(map(self.cache.__getitem__, words)))
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
        return out


def encoder(path: str, end_id: int) -> tuple[int, bytes, WordEncoder]:
    """Width of ids, the end id's bytes and the encoder, kept with its words until the worker needs another model."""
    return living(f"tokens {end_id} {path}", lambda: _encoder(path, end_id))


def _encoder(path: str, end_id: int) -> tuple[int, bytes, WordEncoder]:
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(True) - 1, end_id) < 1 << 16 else 4
    return width, np.array([end_id], f"<u{width}").tobytes(), WordEncoder(path, width)


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, width, ids): little-endian ids with the end id, one row for each of ``docs``.

    A null text counts as empty and has the end id only; an empty table gives an empty
    result. ids are two bytes wide where the vocabulary allows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        width, end, words = encoder(tokenizer, end_id)
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                ids = [x + end for x in words.encode([t.as_py() or "" for t in part.column(1)])]
                n = pa.array([len(x) // width for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "width", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, width int, ids binary")


BLOCKS = "part int, block int, part_start long, n_ids long, payload binary"


def write_blocks(tokens: DataFrame, path: str, parts: int | None = None) -> None:
    """Write rows (doc_id, n_tokens, width, ids) to ``path`` in ascending doc_id order.

    Rows are dealt by range into parts and sorted there; ties are in order of their ids'
    bytes and a null doc_id comes first. A task holds one block at a time.
    """
    parts = parts or int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = TaskContext.get().partitionId(), 0, 0
        names, counts, ids, n, width = [], [], [], 0, 2

        def close() -> pa.RecordBatch:
            row = [[part], [block], [start], [n], [pack(b"".join(ids), counts, width, names)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["part", "block", "part_start", "n_ids", "payload"])

        for batch in batches:
            for doc, count, w, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if counts and n + count > BLOCK_IDS:
                    yield close()
                    start, block, names, counts, ids, n = start + n, block + 1, [], [], [], 0
                names.append(doc)
                counts.append(count)
                ids.append(x)
                n, width = n + count, w
        if counts:
            yield close()

    sorted_rows = tokens.select("doc_id", "n_tokens", "width", "ids").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    sorted_rows.mapInArrow(run, BLOCKS).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids binary), read from the blocks alone; ids are 32 bits wide.

    Boundaries and doc_ids are selected for so many documents at a time. Documents without
    a doc_id come first and keep their rows; an empty folder gives an empty result.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = totals.select("part", (F.sum("n").over(_by_part()) - F.col("n")).alias("base"))
    placed = blocks.join(sized(cut(base, "part-starts")), "part").select("base", "part_start", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                base, start, packed = (c[row].as_py() for c in batch.columns)
                block = Block(packed)
                for k in range(0, block.docs, 1024):
                    last = min(block.docs, k + 1024)
                    at = block.bounds(k, last)
                    wide = block.ids[at[0] : at[-1]].astype("<u4")
                    offsets = pa.array((at - at[0]) * 4, pa.int32())
                    parts = pa.BinaryArray.from_buffers(pa.binary(), last - k, [None, offsets.buffers()[1], pa.py_buffer(wide)])
                    yield pa.RecordBatch.from_arrays([pa.array(block.names(k, last), pa.int64()), pa.array(at[:-1] + base + start, pa.int64()), pa.array(np.diff(at), pa.int64()), parts], names=["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _by_part():
    from pyspark.sql import Window

    return Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)


def token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode whole texts, write the blocks and return the folder they are in."""
    path = path or f"{shared_dir(docs.sparkSession)}/wayfold/blocks-{uuid.uuid4().hex}"
    write_blocks(cut(encoded(docs, tokenizer, end_id, id_col, text_col), "token-ids", "zstd"), path)
    return path
