"""Toxicity: a convolutional text classifier in numpy over hashed word embeddings.

A word's embedding is the sum of three hashed rows: the word, its first seven and its
first four characters. Filters of widths 1, 2 and 3 slide over the words of the whole
text; the ``TOP`` greatest activations of each filter (max pooling, and the runners-up,
so that one stray word is told from several) feed a logistic unit. The threshold is
calibrated for each language, which is guessed from the words; scores are shifted so that
the threshold of any language lies at 0.5.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, least_hashes, living, sized, within_chars

#: Bounds on the labelled documents a model learns from, in number and in characters together; of more, those of the least hashes of their ids.
MAX_TRAIN_DOCS = 5000
MAX_TRAIN_CHARS = 40_000_000
BUCKETS = 1 << 18
SIZE = 8
WIDTHS = (1, 2, 3)
FILTERS = 4
TOP = 3
EPOCHS = 5
#: Words that are pooled at once.
CHUNK = 16_384
#: Words that a worker keeps, some 20 MB; past it the table starts anew.
CACHE_WORDS = 100_000

_SLOTS = [(w, k) for w in WIDTHS for k in range(w)]
_CHANNELS = FILTERS * len(WIDTHS)
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def buckets(token: str) -> tuple[int, int, int]:
    """Rows of a token's word and prefixes; -1 for a token without letters or digits."""
    word = token.lower().strip(_STRIP)
    if not word:
        return -1, -1, -1
    return tuple(xxhash.xxh64_intdigest(p.encode("utf-8", "replace"), seed) % BUCKETS for seed, p in enumerate((word, word[:7], word[:4])))


@dataclass
class Model:
    embedding: np.ndarray  # (BUCKETS + 1, SIZE), the last row zero
    filters: dict  # (width, place) -> (SIZE, FILTERS)
    bias: np.ndarray  # (_CHANNELS,)
    weights: np.ndarray  # (_CHANNELS * TOP,)
    intercept: float
    langs: list[str]
    lang_rows: np.ndarray  # (BUCKETS + 1, langs): log posterior of a word's bucket
    thresholds: np.ndarray  # logits, by language
    cache: dict = None
    rows: np.ndarray = None

    def _start(self) -> None:
        self.cache = {}
        self.rows = np.zeros((CACHE_WORDS, len(_SLOTS) * FILTERS + len(self.langs)), np.float32)

    def _add(self, tokens: list[str]) -> None:
        first = len(self.cache)
        self.cache.update(zip(tokens, range(first, first + len(tokens)), strict=True))
        b = np.array([buckets(t) for t in tokens], np.int64)
        x = self.embedding[b].sum(1)
        products = x @ np.concatenate([self.filters[s] for s in _SLOTS], axis=1)
        self.rows[first : first + len(tokens)] = np.concatenate([products, self.lang_rows[b[:, 0]]], axis=1)

    def features(self, text: str) -> tuple[np.ndarray, int]:
        """Pooled activations of the whole text and the index of its likeliest language."""
        tokens = text.split()
        best = np.zeros((0, _CHANNELS), np.float32)
        lang = np.zeros(len(self.langs))
        for k in range(0, len(tokens), CHUNK):
            part = tokens[k : k + CHUNK + WIDTHS[-1] - 1]
            if self.rows is None or len(self.cache) + len(part) >= CACHE_WORDS:
                self._start()
            if new := list(set(part).difference(self.cache)):
                self._add(new)
            got = self.rows[np.fromiter(map(self.cache.__getitem__, part), np.int64, len(part))]
            lang += got[:CHUNK, len(_SLOTS) * FILTERS :].sum(0, dtype=np.float64)
            best = _top(np.concatenate([best, np.maximum(_convolved(got) + self.bias, 0)]))[0]
        return _padded(best), int(np.argmax(lang)) if len(lang) else 0

    def logit(self, text: str) -> float:
        x, lang = self.features(text)
        return float(x.reshape(-1) @ self.weights + self.intercept - self.thresholds[lang])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -30, 30))))


def _convolved(got: np.ndarray) -> np.ndarray:
    """(words, channels) from the words' products with each place of each filter."""
    n = len(got)
    out = np.zeros((n, _CHANNELS), np.float32)
    for j, (w, k) in enumerate(_SLOTS):
        c = WIDTHS.index(w) * FILTERS
        out[: n - k, c : c + FILTERS] += got[k:, j * FILTERS : (j + 1) * FILTERS]
    return out


def _top(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The TOP greatest values of each channel, descending, and the rows they are in."""
    at = np.argpartition(z, len(z) - TOP, axis=0)[len(z) - TOP :] if len(z) > TOP else np.tile(np.arange(len(z))[:, None], (1, z.shape[1]))
    values = np.take_along_axis(z, at, 0)
    order = np.argsort(-values, axis=0, kind="stable")
    return np.take_along_axis(values, order, 0), np.take_along_axis(at, order, 0)


def _padded(best: np.ndarray) -> np.ndarray:
    return np.concatenate([best, np.zeros((TOP - len(best), _CHANNELS), np.float32)])


def fit(texts: list[str], labels: list[int], langs: list[str], seed: int = 7) -> Model:
    """Train on whole texts; a fifth of them is kept for the thresholds."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float64)
    known: dict[str, int] = {}
    rows = []
    docs = [np.array([known.setdefault(t, len(known)) for t in x.split()], np.int64) for x in texts]
    rows = np.array([buckets(t) for t in known] or [(-1, -1, -1)], np.int64)
    model = _initial(docs, rows, y, langs, rng)
    place = np.arange(len(y)) % 5 == 0
    train = np.flatnonzero(~place) if len(y) >= 50 else np.arange(len(y))
    heavy = (y == 0).sum() / max(1, y.sum()) if len(y) else 1.0
    params = {"embedding": model.embedding, "bias": model.bias, "weights": model.weights} | {s: model.filters[s] for s in _SLOTS}
    memory = {k: np.full_like(v, 1e-6) for k, v in params.items()}
    for epoch in range(EPOCHS):
        for i in rng.permutation(train):
            _step(model, params, memory, rows[docs[i]], y[i], (heavy if y[i] else 1.0) ** 0.5, 0.05 / (1 + epoch))
    logits = np.array([_forward(model, rows[d])[0] for d in docs])
    spot = np.flatnonzero(place) if len(y) >= 50 else np.arange(len(y))
    guess = np.array([int(np.argmax(model.lang_rows[rows[d][:, 0]].sum(0))) if len(d) and model.langs else 0 for d in docs])
    whole = _threshold(logits[spot], y[spot], 0.0)
    model.thresholds = np.array([_threshold(logits[s], y[s], whole) for i in range(max(1, len(model.langs))) for s in [spot[guess[spot] == i]]])
    return model


def _initial(docs: list[np.ndarray], rows: np.ndarray, y: np.ndarray, langs: list[str], rng: np.random.Generator) -> Model:
    """Embeddings begin with the buckets' log odds of standing in a toxic document as their first part."""
    pos, neg = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    names = sorted({x for x in langs if x is not None})
    lang_n = np.zeros((BUCKETS + 1, len(names)))
    for d, label, lang in zip(docs, y, langs, strict=True):
        distinct = np.unique(rows[d])
        (pos if label else neg)[distinct] += 1
        if lang is not None:
            np.add.at(lang_n[:, names.index(lang)], rows[d][:, 0], 1)
    seen = pos + neg
    odds = np.log((pos + 1) / (y.sum() + 2)) - np.log((neg + 1) / ((y == 0).sum() + 2))
    embedding = rng.normal(0, 0.01, (BUCKETS + 1, SIZE)).astype(np.float32)
    embedding[:, 0] = np.where(seen > 0, odds * np.minimum(1, seen / 20), 0) / 3
    embedding[seen == 0] = 0
    embedding[-1] = 0
    filters = {s: rng.normal(0, 0.05, (SIZE, FILTERS)).astype(np.float32) for s in _SLOTS}
    for (w, _), f in filters.items():
        f[0] += 0.8 / w
    post = np.log((lang_n + 0.1) / (lang_n.sum(0) + 0.1 * BUCKETS)) if names else np.zeros((BUCKETS + 1, 0))
    post = (post - np.logaddexp.reduce(post, axis=1, keepdims=True)) if names else post
    post[(lang_n.sum(1) == 0) if names else []] = 0
    weights = np.full(_CHANNELS * TOP, 0.1, np.float32)
    # Without a toxic example nothing is called toxic.
    base = float(np.log((y.sum() + 1) / ((y == 0).sum() + 1))) if y.sum() else -2.0
    return Model(embedding, filters, np.full(_CHANNELS, -0.3, np.float32), weights, base, names, post.astype(np.float32), np.zeros(max(1, len(names))))


def _forward(model: Model, rows: np.ndarray):
    x = model.embedding[rows].sum(1)
    z = _convolved(np.concatenate([x @ model.filters[s] for s in _SLOTS], axis=1)) + model.bias
    values, at = _top(z)
    pooled = _padded(np.maximum(values, 0))
    return float(pooled.reshape(-1) @ model.weights + model.intercept), pooled, at, x


def _step(model: Model, params: dict, memory: dict, rows: np.ndarray, y: float, weight: float, rate: float) -> None:
    """One step of Adagrad on one document; only the words that won the pooling have a gradient."""
    logit, pooled, at, x = _forward(model, rows)
    d = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)
    model.intercept -= 0.1 * rate * d

    def move(name, grad, where=...):
        memory[name][where] += grad**2
        params[name][where] -= rate * grad / np.sqrt(memory[name][where])

    into = d * model.weights.reshape(TOP, _CHANNELS) * (pooled > 0)
    move("weights", (d * pooled.reshape(-1)).astype(np.float32) + 1e-4 * model.weights)
    move("bias", into.sum(0).astype(np.float32))
    n = len(rows)
    back: dict[int, np.ndarray] = {}
    for w, k in _SLOTS:
        c = WIDTHS.index(w) * FILTERS
        g = np.zeros((SIZE, FILTERS), np.float32)
        for t in range(len(at)):
            for f in range(FILTERS):
                p, v = at[t, c + f] + k, into[t, c + f]
                if v and p < n:
                    g[:, f] += v * x[p]
                    back[p] = back.get(p, 0) + v * model.filters[w, k][:, f]
        move((w, k), g)
    for p, g in back.items():
        for r in set(rows[p].tolist()) - {-1}:
            move("embedding", g, r)


def _threshold(logits: np.ndarray, y: np.ndarray, otherwise: float) -> float:
    """The middle of the cut with the best F1; ``otherwise`` for under ten toxic examples."""
    if y.sum() < 10 or y.sum() == len(y):
        return otherwise
    order = np.argsort(-logits, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    low = logits[order[k + 1]] if k + 1 < len(y) else logits[order[k]] - 1
    return float((logits[order[k]] + low) / 2)


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_chars: int = MAX_TRAIN_CHARS) -> Model:
    """A model from labelled documents that are not held out, at most ``max_docs`` of ``max_chars`` in all.

    Of more, those with the least hashes of their ids are taken. Several labels of one
    document count as their greatest. Null labels and texts are left out. Without examples
    of both kinds, as with empty tables, the model gives every text the same score; labels
    whose sample comes out empty are an error.
    """
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = rows.count()
    picked = cut(least_hashes(rows, n, max_docs), "toxicity-labels")
    if n and not picked.limit(1).count():
        raise RuntimeError("no label in the sample")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text", lang.alias("lang"))
    sample = cut(texts.join(sized(picked), "doc_id").select("doc_id", "toxic", "text", "lang"), "toxicity-sample")
    got = within_chars(sample, max_chars).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return fit(got["text"].to_pylist(), got["toxic"].to_pylist(), got["lang"].to_pylist())


def scorer(model: Model):
    """A function of Columns that gives a text's score; only the text goes to Python and only the score comes back."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept = living(key, lambda: model)
        for texts in batches:
            yield pa.array([kept.score(t.as_py() or "") for t in texts], pa.float64())

    return F.arrow_udf(run, "double")


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score), one for each row of ``docs``, without a shuffle.

    A null text counts as empty; an empty table gives an empty result.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), scorer(model)(F.col(text_col)).alias("score"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, all columns, without the rows whose text scores 0.5 or more; null and empty texts are scored as empty."""
    return docs.where(scorer(model)(F.col("text")) < 0.5)
