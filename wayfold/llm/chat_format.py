"""Chat formatting into prefix trees.

Conversations that begin with the same turns share those turns' tokens. The output is one
stream of tokens for each part: the turns of the part's prefix trees, depth first, each
shared turn once. A node (one turn) has its place in the stream, the position ids it
starts with (as if its ancestors stood directly before it) and the intervals of the
stream that hold its ancestors, which with the turn itself are all that it may attend to.

The trees need no graph: conversations sorted by the hashes of their turns are a
depth-first walk, and the new nodes of each are what it does not share with the one before.
Parts are ranges of that order, so a first turn that a third of all conversations share is
spread over many parts; a tree that is cut by a part's edge repeats there the one path that
leads into the part, so that each part can be used by itself.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir
from .token_output import BYTE_LEVEL

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """The text without any ``<|``: a backslash is put after each ``<`` that backslashes and a bar follow."""
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def segments(role: str, text: str) -> tuple[str, str, str]:
    """The three pieces of one turn: its opening, its escaped text and its close."""
    return f"{START}{escape_role(role)}\n", escape(text), f"{END}\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out = []
    for piece in formatted.split(START)[1:]:
        role, _, rest = piece.partition("\n")
        out.append((unescape_role(role), unescape(rest.removesuffix(f"{END}\n"))))
    return out


NODES = "part int, seq long, kind string, conv_id long, start long, position long, loss_from int, loss_to int, ids array<int>, sees array<struct<start:long,end:long>>"
_SEES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_KINDS = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), _SEES]
_NAMES = [x.strip().split(" ")[0] for x in ("part", "seq", "kind", "conv_id", "start", "position", "loss_from", "loss_to", "ids", "sees")]


def joined(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending intervals with those that touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in intervals:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def conversations(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turns, path), one for each conversation.

    All rows whose conv_id is null are one conversation; an empty table has none. Turns are in order of turn, then role and text (nulls first); a null role or text is
    empty. path holds eight bytes of hash for each turn. A conversation is one training
    sequence and is held by one task.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    hashes = F.transform("turns", lambda t: F.lpad(F.hex(F.xxhash64(t["role"], t["text"])), 16, "0"))
    return grouped.select("conv_id", "turns", F.array_join(hashes, "").alias("path"))


def write_trees(rows: DataFrame, tokenizer: str, path: str | None = None) -> str:
    """Write the prefix trees of ``rows`` (conv_id, turn, role, text) as Parquet; returns the folder.

    Rows of kind ``node`` are turns, in stream order; a row of kind ``end`` follows the last
    turn of a conversation and has its conv_id and the intervals of its whole path. An
    empty table gives an empty folder; equal conversations share all their nodes.
    """
    spark = rows.sparkSession
    path = path or f"{shared_dir(spark)}/wayfold/trees-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        part, seq, at = TaskContext.get().partitionId(), 0, 0
        stack: list[tuple] = []  # (turn, start, end, position after it)
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], names=_NAMES)

        for b in batches:
            for conv, turns in zip(b.column(0), b.column(1), strict=True):
                turns = [(t["role"], t["text"]) for t in turns.as_py()]
                same = 0
                while same < min(len(stack), len(turns)) and stack[same][0] == turns[same]:
                    same += 1
                del stack[same:]
                pieces = encode([segments(*t) for t in turns[same:]])
                for t, (head, body, tail) in zip(turns[same:], pieces, strict=True):
                    ids = head + body + tail
                    position = stack[-1][3] if stack else 0
                    sees = joined([(s, e) for _, s, e, _ in stack])
                    spoken = t[0] == "assistant"
                    out.append((part, seq, "node", None, at, position, len(head) if spoken else 0, len(head) + len(body) if spoken else 0, ids, [{"start": s, "end": e} for s, e in sees]))
                    stack.append((t, at, at + len(ids), position + len(ids)))
                    at, seq = at + len(ids), seq + 1
                sees = joined([(s, e) for _, s, e, _ in stack])
                out.append((part, seq, "end", conv.as_py(), at, stack[-1][3] if stack else 0, None, None, None, [{"start": s, "end": e} for s, e in sees]))
                seq += 1
                if len(out) >= 1000:
                    yield batch()
                    out.clear()
        if out:
            yield batch()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = conversations(rows).repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    ordered.select("conv_id", "turns").mapInArrow(run, NODES).write.parquet(path)
    return path


#: Openings and closes of turns that a worker keeps, with their ids.
CACHE_PIECES = 10_000


def _encoder(tokenizer: str):
    """A function from turns' (opening, text, close) to the ids of each; openings and closes, which recur, are encoded once."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True
    known: dict[str, list[int]] = {}

    def short(piece: str) -> list[int]:
        if piece not in known:
            if len(known) > CACHE_PIECES:
                known.clear()
            known[piece] = t.encode(piece, add_special_tokens=False).ids
        return known[piece]

    def encode(turns: list[tuple[str, str, str]]) -> list[tuple[list[int], list[int], list[int]]]:
        bodies = t.encode_batch_fast([body for _, body, _ in turns], add_special_tokens=False) if turns else []
        return [(short(head), e.ids, short(tail)) for (head, _, tail), e in zip(turns, bodies, strict=True)]

    return encode


def _surfaces(tokenizer: str) -> pa.Array:
    """The bytes of each id of a byte-level tokenizer, by id."""
    import json

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    if json.loads(t.to_str())["decoder"]["type"] != "ByteLevel":
        raise ValueError("only byte-level tokenizers are decoded")
    bytes_of = {c: b for b, c in BYTE_LEVEL.items()}
    vocabulary, added = t.get_vocab(with_added_tokens=True), {a.content for a in t.get_added_tokens_decoder().values()}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = token.encode() if token in added else bytes(map(bytes_of.__getitem__, token))
    return pa.array(out, pa.binary())


def read_conversations(spark, path: str, tokenizer: str) -> DataFrame:
    """Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens), read from the trees.

    A conversation is what its ``end`` row sees: its path's tokens, decoded. Each part is
    walked in stream order with the current path in memory.
    """
    rows = spark.read.schema(NODES).parquet(path)
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surfaces = _surfaces(tokenizer)
        stack: list[tuple] = []  # (start, end, formatted, text under the loss mask or None)
        part = None
        for b in batches:
            out = []
            columns = {c: b.column(i) for i, c in enumerate(_NAMES) if c not in ("ids", "sees")}
            columns = {c: v.to_pylist() for c, v in columns.items()}
            # Whatever the rows' ids say, decoded at once: ends[k] is where the bytes of the first k ids end.
            ids = b.column(_NAMES.index("ids"))
            said = surfaces.take(ids.values)
            ends = np.frombuffer(said.buffers()[1], np.int32)[said.offset : said.offset + len(said) + 1] if len(said) else np.zeros(1, np.int32)
            text = memoryview(said.buffers()[2]) if len(said) else memoryview(b"")
            of = ids.offsets.to_pylist()
            sees = b.column(_NAMES.index("sees"))
            see = sees.offsets.to_pylist()
            starts, stops = sees.values.field("start").to_pylist(), sees.values.field("end").to_pylist()
            for k in range(len(b)):
                if columns["part"][k] != part:
                    part, stack = columns["part"][k], []
                seen = list(zip(starts[see[k] : see[k + 1]], stops[see[k] : see[k + 1]], strict=True))
                while stack and not any(s <= stack[-1][0] and stack[-1][1] <= e for s, e in seen[-1:]):
                    stack.pop()
                if columns["kind"][k] == "node":
                    first, n = of[k], of[k + 1] - of[k]
                    at = lambda i, j: str(text[ends[first + i] : ends[first + j]], "utf-8", "surrogatepass")  # noqa: B023, E731
                    a, z, start = columns["loss_from"][k], columns["loss_to"][k], columns["start"][k]
                    stack.append((start, start + n, at(0, n), at(a, z) if z else None))
                    continue
                if joined([(s, e) for s, e, *_ in stack]) != seen:
                    raise ValueError(f"part {part}: the path at {columns['seq'][k]} is not what its intervals say")
                formatted = "".join(x[2] for x in stack)
                loss = "".join(unescape(x[3]) for x in stack if x[3] is not None)
                turns = parse(formatted)
                whole = "".join(f"{role}\n{text_}\n" for role, text_ in turns)
                out.append((columns["conv_id"][k], len(turns), _sha(whole), len(loss), _sha(loss), len(formatted), columns["position"][k]))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                names = [x.split(" ")[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "part").sortWithinPartitions("part", "seq").mapInArrow(run, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
