"""Language identification by word-first backoff.

A word that the model knows is scored by its log frequency in each language. An unknown
word falls back to its character n-grams, from the longest known downwards: each n-gram of
the greatest length is scored if known, else its two parts one character shorter are.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, least_hashes, living, within_chars

#: Bounds on the documents a model learns from, in number and in characters together; of more, those with the least hashes of their ids.
MAX_TRAIN_DOCS = 6000
MAX_TRAIN_CHARS = 40_000_000
#: Bound on the words of one model: the most frequent, each seen twice or more.
MAX_WORDS = 100_000
LONGEST = 4
UNKNOWN = "und"
#: Distinct words of one worker's cache; past it the cache starts anew.
CACHE_WORDS = 150_000


def words(text: str) -> list[str]:
    """Runs of letters, lower-case."""
    return "".join(c if c.isalpha() else " " for c in text.lower()).split()


@dataclass
class Model:
    langs: list[str]
    #: Log posterior of each language for a known word or n-gram, given equal priors.
    word: dict[str, tuple[float, ...]]
    gram: dict[str, tuple[float, ...]]
    backed: dict[str, tuple[float, ...]] = field(default_factory=dict)
    cache: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None

    def of_gram(self, gram: str) -> tuple[float, ...]:
        found = self.gram.get(gram) or self.backed.get(gram)
        if found is None:
            if len(gram) == 1:
                return (0.0,) * len(self.langs)
            found = tuple((a + b) / 2 for a, b in zip(self.of_gram(gram[:-1]), self.of_gram(gram[1:]), strict=True))
            if len(self.backed) > CACHE_WORDS:
                self.backed.clear()
            self.backed[gram] = found
        return found

    def of_word(self, word: str) -> tuple[float, ...]:
        found = self.word.get(word)
        if found is not None:
            return found
        padded = f"^{word}$"
        size = min(LONGEST, len(padded))
        n = len(padded) - size + 1
        return tuple(sum(c) / n for c in zip(*[self.of_gram(padded[i : i + size]) for i in range(n)], strict=True))

    def add(self, tokens: list[str]) -> None:
        """Keep in ``rows`` what white-space separated tokens add: scores, and their number of words."""
        first = len(self.cache)
        self.cache.update(zip(tokens, range(first, first + len(tokens)), strict=True))
        out = []
        for t in tokens:
            found = [t.lower()] if t.isalpha() else words(t)
            out.append((*map(sum, zip(*map(self.of_word, found), strict=True)), len(found)) if found else (0.0,) * (len(self.langs) + 1))
        self.rows[first : first + len(tokens)] = out

    def predict(self, text: str) -> tuple[str, float]:
        """Language and its share of the posterior, tempered by the root of the number of words; und and 0 without letters."""
        total = np.zeros(len(self.langs) + 1)
        tokens = text.split()
        for k in range(0, len(tokens), 100_000):
            part = tokens[k : k + 100_000]
            if self.rows is None or len(self.cache) + len(part) >= CACHE_WORDS:
                self.cache.clear()
                self.rows = np.zeros((CACHE_WORDS, len(self.langs) + 1), np.float32)
            if new := list(set(part).difference(self.cache)):
                self.add(new)
            total += self.rows[np.fromiter(map(self.cache.__getitem__, part), np.int64, len(part))].sum(0, dtype=np.float64)
        if not self.langs or not total[-1]:
            return UNKNOWN, 0.0
        v = total[:-1] / np.sqrt(total[-1])
        p = np.exp(v - v.max())
        best = int(np.argmax(p))
        return self.langs[best], float(p[best] / p.sum())


def _posteriors(counts: dict[str, np.ndarray], totals: np.ndarray, smooth: float) -> dict[str, tuple[float, ...]]:
    kinds = max(1, len(counts))
    out = {}
    for key, c in counts.items():
        v = np.log((c + smooth) / (totals + smooth * kinds))
        out[key] = tuple((v - np.logaddexp.reduce(v)).tolist())
    return out


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = MAX_TRAIN_DOCS, max_chars: int = MAX_TRAIN_CHARS) -> Model:
    """A model from rows with a text and a language. Without any, as from an empty table, it knows no language.

    Words are counted in Spark over a bounded sample; what reaches the driver is bounded by
    that sample's distinct words. Rows without an id are sampled like any other.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = rows.select(lang_col).count()
    picked = cut(least_hashes(rows.select(id_col, lang_col, text_col), n, max_docs, id_col), "language-sample")
    if n and not picked.limit(1).count():
        raise RuntimeError("no document in the sample")
    rows = within_chars(picked, max_chars, id_col, text_col)
    each = rows.select(F.col(lang_col).alias("lang"), F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")).alias("w")).where("w <> ''")
    counted = each.groupBy("lang", "w").agg(F.count("*").alias("n")).toArrow()
    langs = sorted(set(counted["lang"].to_pylist()))
    place = {x: i for i, x in enumerate(langs)}
    by_word: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(langs)))
    by_gram: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(langs)))
    for lang, w, c in zip(counted["lang"].to_pylist(), counted["w"].to_pylist(), counted["n"].to_pylist(), strict=True):
        by_word[w][place[lang]] += c
    for w, c in by_word.items():
        padded = f"^{w}$"
        for size in range(1, LONGEST + 1):
            for i in range(len(padded) - size + 1):
                by_gram[padded[i : i + size]] += c
    totals = sum(by_word.values(), np.zeros(len(langs)))
    kept = dict(sorted(((w, c) for w, c in by_word.items() if c.sum() >= 2), key=lambda x: (-x[1].sum(), x[0]))[:MAX_WORDS])
    grams: dict[str, tuple[float, ...]] = {}
    for size in range(1, LONGEST + 1):
        level = {g: c for g, c in by_gram.items() if len(g) == size and c.sum() >= 2}
        grams |= _posteriors(level, sum(level.values(), np.zeros(len(langs))), 0.5)
    return Model(langs, _posteriors(kept, totals, 0.5), grams)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, lang_pred, score), one for each row of ``docs``, without a shuffle.

    A null text, or one without a letter, is ``und`` with score 0; ties go to the first
    language in order of name. An empty table gives an empty result.
    """
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept = living(key, lambda: model)
        for texts in batches:
            got = [kept.predict(t.as_py() or "") for t in texts]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["lang_pred", "score"])

    found = F.arrow_udf(run, "lang_pred string, score double")(F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), found.alias("__p")).select("doc_id", "__p.lang_pred", "__p.score")
