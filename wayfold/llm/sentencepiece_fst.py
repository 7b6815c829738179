"""SentencePiece encoding and decoding with a weighted finite-state transducer.

A model file is compiled into machines whose arcs read a label, write an output and have a
tropical weight (paths add weights, the least path counts):

* the normaliser writes U+2581 for each space and one before the text;
* the pieces, a trie that reads characters and, where a piece is complete, writes its id and
  returns to its root, at the negative score of the piece (unigram models) or at no weight;
* byte fallback, which reads a character without a piece and writes the ids of its bytes;
* for BPE models the pairs, whose states are pieces: the arc from a piece to the next weighs
  nothing if merging leaves the two alone side by side, else infinity. A sequence of pieces is
  the BPE encoding of a text exactly if all its neighbours are such pairs, so of all paths
  one is finite.

An input is composed with the normaliser, and what that writes with pieces and byte fallback,
which gives a lattice of arcs between places of the text; its shortest path is the encoding.
States are places (with the last piece, where there are pairs). No weight is negative, so they
are settled in order of their weight, and arcs are composed only where a settled state has
them: the lattice is never built whole.

Two characters that never stand next to each other inside a piece part the lattice: what
lies on either side is composed by itself, and kept for the next time it comes.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import living

SPACE = "▁"
#: Label of an arc that reads any character which no other arc of its state reads, and writes it.
ANY = None
#: Entries of each of a worker's tables of words and pairs, and of segments; past it a table starts anew.
CACHE = 200_000
CACHE_SEGMENTS = 60_000
#: What a unigram model takes off its least score for a character without a piece; a fixed value.
UNKNOWN_PENALTY = 10.0


class Machine:
    """A transducer. ``arcs[state][label]`` is (output, weight, next state); ``final`` holds the states where an input may end."""

    def __init__(self):
        self.arcs: list[dict] = [{}]
        self.final: set[int] = set()

    def state(self) -> int:
        self.arcs.append({})
        return len(self.arcs) - 1

    def arc(self, source: int, label, output, weight: float, target: int) -> None:
        self.arcs[source][label] = (output, weight, target)

    def write(self, text: str) -> str:
        """The output of a machine that has one path for each input; in an output ANY stands for the character read."""
        state, out = 0, []
        for c in text:
            output, _, state = self.arcs[state].get(c) or self.arcs[state][ANY]
            out += [c if x is ANY else x for x in output]
        return "".join(out)


def normaliser(prefix: str) -> Machine:
    """Spaces to U+2581, and the prefix before the first character."""
    m = Machine()
    inside = m.state()
    m.final = {0, inside}
    for source, before in ((0, (prefix,)), (inside, ())):
        m.arc(source, " ", (*before, SPACE), 0.0, inside)
        m.arc(source, ANY, (*before, ANY), 0.0, inside)
    return m


class Pieces:
    """The trie of pieces: ``arcs[state][character]`` is the next state, at no weight and without output.

    ``ends[state]`` is (id, weight, piece) of the arc that returns to the root, for a state
    that spells a piece, else null.
    """

    def __init__(self, weights: dict[str, tuple[int, float]]):
        self.arcs: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, float, str] | None] = [None]
        for piece, end in weights.items():
            at = 0
            for c in piece:
                if c not in self.arcs[at]:
                    self.arcs[at][c] = len(self.arcs)
                    self.arcs.append({})
                    self.ends.append(None)
                at = self.arcs[at][c]
            self.ends[at] = (*end, piece)

    def starting(self, text: str, i: int, fallback) -> list[tuple[int, float, object, str]]:
        """Arcs of the composition with a text that leave a place: (next place, weight, output, piece), the shortest first.

        A character that is no piece has an arc of byte fallback, at that arc's weight.
        """
        out, arcs, ends, state, j = [], self.arcs, self.ends, 0, i
        n = len(text)
        while j < n:
            state = arcs[state].get(text[j])
            if state is None:
                break
            j += 1
            end = ends[state]
            if end:
                out.append((j, end[1], end[0], end[2]))
        if not out or out[0][0] > i + 1:
            out.insert(0, (i + 1, *fallback(text[i]), text[i]))
        return out


class Pairs:
    """Which pieces merging leaves alone side by side, as weights of arcs from piece to piece.

    A piece is made by its last merge of two pieces, so the pieces that stand at its right
    edge while it is made are its right part, that one's right part and so on, each from its
    own merge until the next. A merge across the border of two pieces takes place if pieces
    of their inner edges are there at the same time and the merge of these comes before what
    ends either of them.
    """

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        self.order = {p: -s for p, (_, s) in pieces.items()}
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.known: dict[tuple[str, str], float] = {}
        self.edges: tuple[dict, dict] = ({}, {})

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes a piece, null for a character and for a piece that merging never makes."""
        if piece not in self.parts:
            self.parts[piece] = None
            best = math.inf
            for i in range(1, len(piece)):
                a, b = piece[:i], piece[i:]
                if self.made(a) and self.made(b) and max(self.time(a), self.time(b)) < best and self._apart(a, b, self.order[piece]):
                    self.parts[piece], best = (a, b), max(self.time(a), self.time(b))
        return self.parts[piece]

    def made(self, piece: str) -> bool:
        return len(piece) == 1 or piece in self.order and self.split(piece) is not None

    def time(self, piece: str) -> float:
        """When a piece is made: its own place in the order of merges; characters are there from the start."""
        return -math.inf if len(piece) == 1 else self.order[piece]

    def _edge(self, piece: str, side: int) -> list[tuple[str, float, float]]:
        """Pieces at an edge with the times from which and until which they are there, the whole piece first."""
        found = self.edges[side].get(piece)
        if found is None:
            found = [(piece, self.time(piece), math.inf)]
            if len(piece) > 1:
                first, *rest = self._edge(self.split(piece)[side], side)
                found += [(first[0], first[1], self.time(piece)), *rest]
            self.edges[side][piece] = found
        return found

    def _apart(self, a: str, b: str, before: float) -> bool:
        """Whether no merge across the border of two pieces comes before a time; of equal merges the left one comes first."""
        right = self._edge(b, 0)
        for x, x_from, x_until in self._edge(a, 1):
            for y, y_from, y_until in right:
                if x_from < y_until and y_from < x_until:
                    at = self.order.get(x + y)
                    if at is not None and at < before and at < x_until and at <= y_until:
                        return False
        return True

    def weight(self, a: str, b: str) -> float:
        """0 if b may follow a, else infinity."""
        key = (a, b)
        found = self.known.get(key)
        if found is None:
            if len(self.known) > CACHE:
                self.known.clear()
            found = self.known[key] = 0.0 if self._apart(a, b, math.inf) else math.inf
        return found


def shortest_path(pieces: Pieces, text: str, fallback) -> tuple[float, list[tuple[str, object]]]:
    """Weight and (piece, output) arcs of the least path that reads a text; states are places.

    Settles places in order of weight, the farthest first among equals.
    """
    agenda: list[tuple] = [(0.0, 0, 0, None, None)]  # weight, minus the place, turn, place before, output
    settled: dict[int, tuple] = {}
    turn = 0
    while True:
        weight, at, _, before, output = heapq.heappop(agenda)
        at = -at
        if at in settled:
            continue
        settled[at] = (before, output)
        if at == len(text):
            break
        for end, cost, output, _ in pieces.starting(text, at, fallback):
            turn += 1
            heapq.heappush(agenda, (weight + cost, -end, turn, at, output))
    out = []
    while at:
        before, output = settled[at]
        out.append((text[before:at], output))
        at = before
    return weight, out[::-1]


def only_path(pieces: Pieces, pairs: Pairs, text: str, fallback) -> list[tuple[str, object]]:
    """The (piece, output) arcs of the path of weight zero where all others are infinite; states are (place, last piece).

    All states that can be reached have one weight, so they may be settled in any order: the
    last one found first, the longest piece before shorter ones.
    """
    n, known, weight, starting = len(text), pairs.known, pairs.weight, pieces.starting
    path: list[tuple[str, object]] = []
    ways, places, settled = [starting(text, 0, fallback)], [0], set()
    while True:
        arcs = ways[-1]
        last = path[-1][0] if path else ""
        while arcs:
            end, _, output, piece = arcs.pop()
            if last:
                found = known.get((last, piece))
                if (weight(last, piece) if found is None else found) or (end, piece) in settled:
                    continue
            path.append((piece, output))
            if end == n:
                return path
            settled.add((end, piece))
            ways.append(starting(text, end, fallback))
            places.append(end)
            break
        else:
            # A settled state that leads nowhere stays settled.
            ways.pop()
            places.pop()
            path.pop()


class Model:
    """The machines of one model file: BPE or unigram, identity normaliser, with byte fallback."""

    def __init__(self, path: str | None, proto_bytes: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        if proto_bytes is None:
            with open(path, "rb") as f:
                proto_bytes = f.read()
        proto.ParseFromString(proto_bytes)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type not in (1, 2) or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only BPE and unigram models with an identity normaliser are compiled")
        bpe = proto.trainer_spec.model_type == 2
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        kinds = pb.ModelProto.SentencePiece
        scored = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        self.pairs = Pairs(scored) if bpe else None
        self.unknown = 0.0 if bpe else UNKNOWN_PENALTY - min((s for _, s in scored.values()), default=0.0)
        self.normaliser = normaliser(self.prefix)
        # A piece that merging never makes is on no path.
        self.pieces = Pieces({p: (i, 0.0 if bpe else -s) for p, (i, s) in scored.items() if not bpe or self.pairs.made(p)})
        #: Pairs of characters that stand next to each other inside some piece.
        self.inner = {p[i : i + 2] for p in scored for i in range(len(p) - 1)}
        self.lone_newline = not any("\n" in x for x in self.inner)
        self.leading_space = all(x[0] == SPACE for x in self.inner if x[1] == SPACE)
        self.surface = [b""] * len(proto.pieces)
        for p, (i, _) in scored.items():
            self.surface[i] = p.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.surface[i] = bytes([b])
        self.kind = "<u2" if len(proto.pieces) <= 1 << 16 else "<u4"
        self._segments: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}

    def fallback(self, char: str) -> tuple[float, tuple[int, ...]]:
        """Weight and output of the byte fallback's arc for a character."""
        return self.unknown, tuple(self.bytes[b] for b in char.encode("utf-8", "replace"))

    def path(self, normalised: str) -> tuple[float, list[tuple[str, object]]]:
        """Weight and arcs of the least path for a normalised text."""
        if self.pairs:
            return 0.0, only_path(self.pieces, self.pairs, normalised, self.fallback)
        return shortest_path(self.pieces, normalised, self.fallback)

    def normalised(self, text: str) -> str:
        return self.normaliser.write(text)

    # Whole texts.

    def _ids(self, segment: str) -> bytes:
        out: list[int] = []
        for _, output in self.path(segment)[1]:
            out += output if isinstance(output, tuple) else [output]
        return np.array(out, self.kind).tobytes()

    def _cut(self, text: str) -> bytes:
        """Ids of a normalised stretch of text, segment by segment."""
        out, start, inner, known = [], 0, self.inner, self._segments
        ends = [i + 1 for i, pair in enumerate(map("".join, zip(text, text[1:]))) if pair not in inner]
        for end in [*ends, len(text)] if text else ():
            segment = text[start:end]
            ids = known.get(segment)
            if ids is None:
                if len(known) > CACHE_SEGMENTS:
                    known.clear()
                ids = known[segment] = self._ids(segment)
            out.append(ids)
            start = end
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.zeros(0, self.kind)
        if "\0" in text or "  " in text or text[0] == " " or not self.lone_newline or SPACE in text or not self.leading_space:
            return np.frombuffer(self._cut(self.normalised(text)), self.kind)
        words = (self.prefix + text.replace(" ", f"\0{SPACE}").replace("\n", "\0\n\0")).split("\0")
        known = self._words
        if len(known) > CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self._cut(w)
        return np.frombuffer(b"".join(map(known.__getitem__, words)), self.kind)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        got = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return got[1:] if self.prefix and got.startswith(" ") else got


def loaded(path: str) -> Model:
    """The compiled model of a file, kept with its tables until the worker needs another one."""
    return living(f"sentencepiece {path}", lambda: Model(path))


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids, decoded_sha256, round_trip), one for each row of ``docs``, without a shuffle.

    round_trip says whether decoding the ids gives the text back. A null text counts as
    empty and has no ids; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(model_path)
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                texts = [x.as_py() or "" for x in part.column(1)]
                ids = [model.encode(t) for t in texts]
                back = [model.decode(x) for x in ids]
                sizes = np.array([len(x) for x in ids], np.int64)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat, pa.int32()))
                sha = [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in back]
                same = [a == b for a, b in zip(texts, back, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), lists, pa.array(sha), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip"])

    schema = "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
