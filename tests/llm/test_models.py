import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wayfold.llm import common, language_id, queries, token_output, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n,top", [(1, 0), (1, 9), (10, 1000), (1000, 10**6), (500, 100), (3000, 0), (200, 2**31)])
def test_elias_fano_returns_every_value(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    ef = token_output.EliasFano.of(values)
    assert ef.select(0, n).tolist() == values.tolist() == [int(ef.select(i)[0]) for i in range(n)]
    assert all(ef.select(a, b).tolist() == values[a:b].tolist() for a, b in [(0, 0), (n // 3, n // 2), (n // 2, n), (n - 1, n)])
    bits = 8 * (len(ef.low) + len(ef.high))
    assert bits <= n * (3 + max(0, np.log2(max(1, top) / n))) + 16
    with pytest.raises(IndexError):
        ef.select(n)


def test_blocks_round_trip():
    counts = [3, 0, 200, 1]
    ids = np.arange(204, dtype="<u2")
    names = [None, -(2**63), 7, 2**63 - 1]
    block = token_output.Block(token_output.pack(ids.tobytes(), counts, 2, names))
    assert block.ids.tolist() == ids.tolist() and np.diff(block.bounds(0, 4)).tolist() == counts
    assert block.names(0, 4) == names and block.names(1, 3) == names[1:3] and block.names(0, 1) == [None]
    empty = token_output.Block(token_output.pack(b"", [], 4))
    assert (empty.docs, empty.names(0, 0), empty.bounds(0, 0).tolist()) == (0, [], [0])


def test_other_tokenizers_are_applied_to_whole_texts():
    enc = token_output.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert not enc.by_word and token_output.WordEncoder(PATH, 2).by_word
    text = "Don't split  THIS, by words..."
    assert np.frombuffer(enc.encode([text])[0], "<u2").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_samples_take_the_least_hashes_at_any_size(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"))
    h = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 63) - 1))
    want = {r.doc_id for r in rows.orderBy(h).limit(300).collect()}
    assert {r.doc_id for r in common.least_hashes(rows, 20_000, 300).collect()} == want
    assert common.least_hashes(rows, 300, 300).count() == 20_000
    # Of so many rows only these are there: those below the cut are kept, none is lost to a rounding to zero.
    low = rows.orderBy(h).limit(1).first()
    least = rows.select(F.min(h).alias("h")).first().h
    n = int(2**63 / least * 5000)
    assert [r.doc_id for r in common.least_hashes(rows, n, 5000).collect()] == [low.doc_id]
    texts = spark.createDataFrame([(i, "x" * 10) for i in range(50)], "doc_id long, text string")
    assert common.within_chars(texts, 95).count() == 9 and common.within_chars(texts, 1).count() == 1 and common.within_chars(texts, 10**6).count() == 50


@pytest.mark.parametrize("text", ["", "ΑΣ Σ", "don't I'LL 'S", "J̌ é É", "a b\x1cc", "...!? a.b., 12.5%", "<|endoftext|> x", "İstanbul ǅ", "日本 語。", "naïve.", "ª º", "x​y", "ß ẞ", "ﬁ", "́ a", "ÁB. ÉTÉ!!"])
def test_word_encoder_equals_library(text):
    enc = token_output.WordEncoder(PATH, 2)
    assert np.frombuffer(enc.encode([text])[0], "<u2").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ['say "foo", x', "(foo).", "a),", "x%.", '29B"!! end', "İ. naïvé. 7. x²;", "é́.", "a_.", "don't. it's' .", "“q”.", "...\"."])
def test_word_encoder_keeps_runs_of_punctuation(text):
    enc = token_output.WordEncoder(PATH, 2)
    for t in (text, text.upper()):
        assert np.frombuffer(enc.encode([t])[0], "<u2").tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("where", ["small", "odd_dir", "empty_dir"])
def test_token_files_equal_library(spark, where, request):
    from tokenizers import Tokenizer

    d = request.getfixturevalue(where)
    tok = Tokenizer.from_file(PATH)
    rows = [(r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    want, at = [], 0
    for i, ids in rows:
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in queries.op4_token_output(spark, d).collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_small_blocks_keep_order(spark, odd_docs, monkeypatch, tmp_path):
    monkeypatch.setattr(token_output, "BLOCK_IDS", 5)
    path = token_output.token_files(odd_docs, PATH, 1, str(tmp_path / "b"))
    got = token_output.read_documents(spark, path).orderBy("start").collect()
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert len(got) == odd_docs.count()


def test_language_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op9_language_id(spark, d).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert np.mean([docs[r.doc_id].lang == r.lang_pred for r in out]) > 0.97


def slow_language(model, text):
    """The method word by word, without tables: known words, else n-grams from the longest down."""
    def gram(g):
        if g in model.gram:
            return model.gram[g]
        return [0.0] * len(model.langs) if len(g) == 1 else [(a + b) / 2 for a, b in zip(gram(g[:-1]), gram(g[1:]), strict=True)]

    total, n, word = [0.0] * len(model.langs), 0, ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
            continue
        if word:
            p = f"^{word}$"
            k = min(language_id.LONGEST, len(p))
            got = model.word.get(word) or [sum(x) / (len(p) - k + 1) for x in zip(*[gram(p[i : i + k]) for i in range(len(p) - k + 1)], strict=True)]
            total, n, word = [a + b for a, b in zip(total, got, strict=True)], n + 1, ""
    if not n:
        return "und", 0.0
    v = np.array(total) / n**0.5
    p = np.exp(v - v.max())
    return model.langs[int(p.argmax())], p.max() / p.sum()


def test_language_scores_equal_a_plain_scorer(spark, odd_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(docs.where(F.col("doc_id") % 3 != 0))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = language_id.predict(docs, model).collect()
    assert len(got) == len(text)
    for r in got[:300]:
        lang, score = slow_language(model, text[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, rel=1e-3)
    for t in ("", "Zzyzx qqqq", "naïve Ünï 𝒳 don't 12a3"):
        assert model.predict(t)[0] == slow_language(model, t)[0]


def test_language_backoff_and_odd_rows(spark, odd_dir, odd_docs):
    rows = [(i, "the cat and the dog", "en") for i in range(4)] + [(i, "die katze und der hund", "de") for i in range(4, 8)] + [(8, None, "en"), (9, "x", None)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en"]
    assert model.predict("the dogs")[0] == "en" and model.predict("katzen hunde")[0] == "de"
    assert model.predict("123 !!") == ("und", 0.0) and model.predict("") == ("und", 0.0)
    assert "hunde" not in model.word and model.of_word("hunde")[0] > model.of_word("hunde")[1]
    got = queries.op9_language_id(spark, odd_dir).collect()
    assert len(got) == odd_docs.count() and {r.lang_pred for r in got if r.doc_id in (0, 1, 11)} == {"und"}


def test_language_without_rows(spark, empty_dir):
    assert queries.op9_language_id(spark, empty_dir).count() == 0
    assert language_id.Model([], {}, {}).predict("any text") == ("und", 0.0)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = queries.op5_toxicity(spark, d).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    out = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    pos, neg = [s for s, y in out if y], [s for s, y in out if not y]
    assert np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos]) > 0.8
    assert np.mean([s < 0.5 for s in neg]) > 0.95


def slow_logit(model, text):
    """The classifier by its definition: one window at a time."""
    rows = [toxicity.buckets(t) for t in text.split()]
    x = [sum(model.embedding[b] for b in r) for r in rows]
    lang = np.zeros(len(model.langs))
    for r in rows:
        lang += model.lang_rows[r[0]]
    pooled = []
    for w in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            c = toxicity.WIDTHS.index(w) * toxicity.FILTERS + f
            # A window may begin at any word; places past the end add nothing.
            z = [max(0.0, model.bias[c] + sum(float(x[i + k] @ model.filters[w, k][:, f]) for k in range(w) if i + k < len(x))) for i in range(len(x))]
            pooled.append((sorted(z, reverse=True) + [0.0] * toxicity.TOP)[: toxicity.TOP])
    at = np.array(pooled).T.reshape(-1)
    return at @ model.weights + model.intercept - model.thresholds[int(lang.argmax()) if len(lang) else 0]


def test_toxicity_scores_equal_a_plain_scorer_and_training_adds(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.learn(docs, labels)
    for r in docs.orderBy("n_chars").limit(60).collect():
        assert model.logit(r.text or "") == pytest.approx(slow_logit(model, r.text or ""), abs=1e-3)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    monkeypatch.setattr(toxicity, "EPOCHS", 0)
    untrained = toxicity.learn(docs, labels)
    seen = [(r.text or "", truth[r.doc_id]) for r in docs.collect() if r.doc_id in truth]
    loss = lambda m: np.mean([np.log1p(np.exp(-(2 * y - 1) * np.clip(m.logit(t), -30, 30))) for t, y in seen])
    assert loss(model) < loss(untrained)


def test_toxicity_odd_rows_and_labels(spark, odd_docs):
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 0), (3, 1, 1), (3, 1, 0), (4, 1, None), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(odd_docs, labels)
    got = toxicity.scored(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    nothing = toxicity.learn(odd_docs, labels.limit(0))
    same = {r.score for r in toxicity.scored(odd_docs, nothing).collect()}
    assert len(same) == 1 and max(same) < 0.5 and toxicity.keep_clean(odd_docs, nothing).count() == odd_docs.count()
    assert toxicity.keep_clean(odd_docs, model).columns == odd_docs.columns
    assert toxicity.scored(odd_docs.limit(0), model).count() == 0


def test_toxicity_pools_whole_texts(monkeypatch):
    texts = [f"plain words number {i} and more of them" for i in range(60)] + [f"plain words with vileword and vileword {i}" for i in range(20)]
    model = toxicity.fit(texts, [0] * 60 + [1] * 20, ["en"] * 80)
    long = "plain words " * 3000 + "vileword and vileword with vileword"
    whole = model.features(long)[0]
    monkeypatch.setattr(toxicity, "CHUNK", 100)
    assert np.allclose(model.features(long)[0], whole, atol=1e-5)
    assert model.score(texts[-1]) > 0.5 > model.score(texts[0])
