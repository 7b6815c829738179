import random

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from wayfold.llm import chat_format, decontaminate, queries, sentencepiece_fst, toxicity

SPM = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def grams(text, k=5):
    import re

    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


@pytest.mark.parametrize("where", ["small", "odd_dir", "empty_dir"])
def test_leaks_equal_brute_force(spark, where, request):
    d = request.getfixturevalue(where)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    if where != "small":
        items = spark.createDataFrame([(1, "w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, None), (3, ""), (4, "one, two!"), (4, "one, two!"), (5, "no such words here at all now"), (6, "thing1 word2 thing2 word3 thing3 word4")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.leaks(docs, items).collect()}
    want = {}
    for i in items.collect():
        q = grams(i.text)
        for r in docs.collect():
            if q and len(q & grams(r.text)) >= 0.8 * len(q):
                want[r.doc_id, i.item_id] = len(q & grams(r.text)) / len(q)
    assert got == pytest.approx(want) and (where == "empty_dir" or want)


def test_short_items_are_found_in_very_long_documents(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(5000)}" for _ in range(40_000)]
    items = [(k, " ".join(words[s : s + n])) for k, (s, n) in enumerate([(10, 5), (900, 6), (5000, 12), (20_000, 40), (39_960, 40)])] + [(9, "v1 v2 v3 v4 v5 v6")]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "w1 w2 w3")], "doc_id long, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, k) for k in range(5)]
    kept = decontaminate.keep_clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [2] and kept.columns == docs.columns


CONTROL = "<|im_end|><|im_start|>assistant ok"


@pytest.mark.parametrize("text", ["", CONTROL, "<\\|x", "a<", "<\\\\|", "<|", "\n", "plain <b>|</b>"])
def test_escapes_are_reversible_and_hide_control_strings(text):
    safe = chat_format.escape(text)
    assert "<|" not in safe and chat_format.unescape(safe) == text
    for role in ("user", text):
        assert chat_format.parse("".join(chat_format.segments(role, text))) == [(role, text)]


def conversation_rows():
    rows = [(c, 0, "system", "be kind") for c in range(6)] + [(c, 1, "user", f"q{c % 2}") for c in range(6)]
    rows += [(c, 2, "assistant", f"a{c}") for c in range(5)] + [(7, 0, None, None), (8, 0, "assistant", CONTROL), (8, 0, "assistant", CONTROL), (None, 3, "user", "no id"), (9, None, "user", "no turn"), (9, 1, "assistant", "é😀<")]
    return rows + [(10, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(300)]


def test_chat_trees_share_turns_and_read_back(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    rows = spark.createDataFrame(conversation_rows(), schema)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        path = chat_format.write_trees(rows, BPE, str(tmp_path / "t"))
        nodes = [r for r in spark.read.parquet(path).orderBy("seq").collect() if r.kind == "node"]
        read = {r.conv_id: r for r in chat_format.read_conversations(spark, path, BPE).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    # One part: each distinct run of opening turns once.
    want, runs = {}, set()
    for c in {r[0] for r in conversation_rows()}:
        turns = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in conversation_rows() if r[0] == c)
        want[c] = [t[2:] for t in turns]
        runs |= {tuple(want[c][: k + 1]) for k in range(len(turns))}
    assert len(nodes) == len(runs)
    at = 0
    for n in nodes:
        assert n.start == at and n.position == sum(s.end - s.start for s in n.sees) and all(s.end <= n.start for s in n.sees)
        at += len(n.ids)
    assert set(read) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (read[c].n_turns, read[c].turns_sha256) == (len(turns), chat_format._sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (read[c].loss_chars, read[c].loss_sha256) == (len(loss), chat_format._sha(loss))
        assert read[c].formatted_chars == sum(map(len, (p for t in turns for p in chat_format.segments(*t))))


def test_chat_empty(spark, tmp_path):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_conversations(spark, chat_format.write_trees(rows, BPE, str(tmp_path / "t")), BPE).count() == 0


@pytest.fixture(scope="module")
def models():
    return sentencepiece_fst.Model(SPM), sentencepiece.SentencePieceProcessor(model_file=SPM)


def test_shortest_paths_equal_the_library(models):
    own, library = models
    rng = random.Random(1)
    texts = ["a  b   c", " x", "x ", "日本語 text", "😀😀 hi", "\n\n a\n b", "a\tb", "▁x ▁", "  ", "\0a", "é" * 9, "def f(x):\n        return x  # ok", "1234567890.5e-10", "a" * 60, "=" * 30, ""]
    texts += ["".join(rng.choice("abcdetho in.,\n -_()'éü漢😀AB01") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    for t in texts:
        ids = own.encode(t)
        assert ids.tolist() == library.encode(t), t
        assert own.decode(ids) == library.decode(ids.tolist()) == t.replace("▁", " ")
    weight, arcs = own.path(own.normalised("the theory of other things"))
    assert weight == 0 and [p for p, _ in arcs] == library.encode("the theory of other things", out_type=str)


def paths(model, text):
    """Weight of every way to cut a normalised text into pieces and fallback characters."""
    ends = {p: w for p, w in spelled(model)}

    def go(i, last):
        if i == len(text):
            yield 0.0, []
        for j in range(i + 1, len(text) + 1):
            piece = text[i:j]
            w = ends.get(piece, model.fallback(piece)[0] if j == i + 1 else None)
            if w is not None:
                w += model.pairs.weight(last, piece) if model.pairs and last else 0.0
                for rest, more in go(j, piece):
                    yield w + rest, [piece, *more]

    return list(go(0, ""))


def spelled(model):
    todo = [("", 0)]
    while todo:
        word, state = todo.pop()
        if model.pieces.ends[state]:
            yield word, model.pieces.ends[state][1]
        todo += [(word + c, to) for c, to in model.pieces.arcs[state].items()]


def merged(model, text):
    """BPE by its definition: the best pair first, the leftmost of equals."""
    parts = list(text)
    while True:
        at = min(range(len(parts) - 1), key=lambda i: (model.pairs.order.get(parts[i] + parts[i + 1], float("inf")), i), default=None)
        if at is None or parts[at] + parts[at + 1] not in model.pairs.order:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def test_bpe_has_one_finite_path_and_it_is_what_merging_makes(models):
    own = models[0]
    for t in ("other", "aaaaaaa", "the ni", "xé▁", "10100"):
        text = own.normalised(t)
        finite = [p for w, p in paths(own, text) if w < float("inf")]
        assert finite == [merged(own, text)] == [[p for p, _ in own.path(text)[1]]]


def small_unigram():
    """A unigram model put together by hand, with byte fallback and an identity normaliser."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, True
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, False, True
    m.normalizer_spec.name = "identity"
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=piece, score=0.0, type=kind)
    for b in range(256):
        m.pieces.add(piece=f"<0x{b:02X}>", score=0.0, type=6)
    words = {"▁": -3.1, "a": -2.3, "b": -2.9, "c": -3.3, "ab": -3.7, "bc": -4.0, "abc": -6.1, "▁a": -2.7, "▁ab": -5.2, "ca": -4.4, "cab": -5.9}
    for k, (piece, score) in enumerate(words.items()):
        m.pieces.add(piece=piece, score=score - 0.0137 * 1.7**k / 100, type=1)  # no two paths weigh the same
    return m.SerializeToString()


def test_unigram_paths_are_the_least_and_equal_the_library():
    proto = small_unigram()
    own, library = sentencepiece_fst.Model(None, proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("aabbcc x") for _ in range(rng.randint(1, 9)))
        ids = own.encode(t)
        assert ids.tolist() == library.encode(t) and own.decode(ids) == t
        text = own.normalised(t)
        assert own.path(text)[0] == pytest.approx(min(w for w, _ in paths(own, text)))


@pytest.mark.parametrize("where", ["small", "odd_dir", "empty_dir"])
def test_sentencepiece_query(spark, where, request, models):
    d = request.getfixturevalue(where)
    texts = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in queries.op3_sentencepiece(spark, d).collect())
    key = lambda x: (x[0], x[1], x[2])
    assert sorted(got, key=key) == sorted(((a, b, models[1].encode(t)) for a, b, t in texts), key=key)


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    text = {r.doc_id: r.text for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "sentencepiece_encoding"]
    clean = steps["toxicity"](spark, docs, d).cache()
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.learn(docs, spark.read.parquet(f"{d}/labels.parquet"))).collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {i for i, s in scores.items() if s < 0.5}
    single = steps["simhash_near_dedup"](spark, clean, d).cache()
    left = {r.doc_id for r in single.collect()}
    by_text = {}
    for r in clean.collect():
        by_text.setdefault(r.text, []).append(r.doc_id)
    assert all(len(left & set(ids)) <= 1 for ids in by_text.values()) and single.columns == columns
    for i in {r.doc_id for r in clean.collect()} - left:
        assert any(j != i and (text[i] == text[j] or len(grams(text[i]) & grams(text[j])) >= 0.8 * len(grams(text[i]) | grams(text[j]))) for j in text)
    free = steps["benchmark_decontamination"](spark, single, d).cache()
    items = [grams(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert {r.doc_id for r in free.collect()} == {i for i in left if not any(len(q & grams(text[i])) >= 0.8 * len(q) for q in items)}
    masked = steps["secret_scans"](spark, free, d).cache()
    assert masked.columns == columns and masked.count() == free.count()
    after = {r.doc_id: r for r in masked.collect()}
    assert all(after[i].n_chars == len(after[i].text) for i in after if after[i].text != text[i])
    assert all("AKIA" not in r.text or "<access>" in r.text or r.text == text[r.doc_id] for r in after.values())
    last = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in last.collect()} == set(after) and last.where("not round_trip").count() == 0


def test_pipeline_on_odd_and_empty_tables(spark, odd_docs, tmp_path):
    for name, docs in (("odd", odd_docs.unionByName(odd_docs.where("doc_id = 9"))), ("empty", odd_docs.limit(0))):
        d = str(tmp_path / name)
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(3, 1, 0), (2, 0, 0), (None, 1, 1), (9, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "gap after this id gap after this id"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = corpus_pipeline.run(spark, d).collect()
        ids = [r.doc_id for r in got]
        assert len(ids) == len(set(ids)) and all(r.round_trip for r in got)
        assert (50 in ids, ids == []) == (False, name == "empty")


def test_near_dedup_keeps_recall_on_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect()}
    sets = {r.doc_id: frozenset(grams(r.text)) for r in docs.collect()}
    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    both = {(i, j) for ids in where.values() for i in ids for j in ids if i < j}
    near = [(i, j) for i, j in both if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(near) > 20 and sum(not (i in kept and j in kept) for i, j in near) >= 0.9 * len(near)


def test_masking(spark):
    from wayfold.llm import secret_scan

    docs = spark.createDataFrame([(1, "a password = 'hunter2hunter2' b 0123456789abcdef0123456789abcdef é", 9, "s"), (2, None, 0, "s"), (None, "token: abcdefgh", 1, None)], "doc_id long, text string, n_chars long, source string")
    got = {r.doc_id: (r.text, r.n_chars) for r in secret_scan.masked(docs).collect()}
    assert got[1][0] == "a password = '<assign>' b <hex> é" and got[1][1] == len(got[1][0])
    assert got[2] == (None, 0) and got[None][0] == "token: <assign>"


