import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfold.llm import byte_bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return byte_bpe.Model(PATH), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 1000, 20_000])
def test_perfect_hash_is_minimal_and_perfect(n):
    keys = [f"key {i * i}".encode() for i in range(n)]
    made = byte_bpe.PerfectHash(keys)
    assert sorted(made.slots(keys).tolist()) == list(range(n))
    assert [made.slot(k) for k in keys[:500]] == made.slots(keys[:500]).tolist()
    if n:
        assert all(0 <= s < n for s in made.slots([b"other", b""]).tolist())


def test_a_repeated_key_is_refused():
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash([b"a", b"b", b"a"])


def test_the_vocabulary_resolves_to_its_ranks(both):
    own, library = both
    assert sorted(own.ranks) == list(range(len(own.ranks)))
    for token in random.Random(1).sample(own.tokens, 3000):
        assert own.merged(token) and own.token_of[own.ranks[own.hash.slot(token)]] == token


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_library_on_any_text(both, text):
    own, library = both
    packed = own.encode(text)
    assert ids_of(packed) == library.encode_ordinary(text) and own.decode(packed) == text.encode()


def test_ids_equal_the_library_on_odd_texts(both):
    own, library = both
    rng = random.Random(2)
    texts = ["", " ", "\n\n  \n", "<|endoftext|>", "it's we'LL 'Tis", "\x1c\x85​　x", "a" * 3000, "ab" * 2000, " " * 999 + "x", "é" * 500, "漢字" * 300, "\0\0a"]
    texts += ["".join(rng.choice("abcdetho in.,\n -_()'éü漢😀AB01") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    for t in texts:
        assert ids_of(own.encode(t)) == library.encode_ordinary(t), t


def test_long_texts_are_cut_into_parts_and_caches_turn_over(both, monkeypatch):
    own, library = both
    text = " ".join(f"wörd{i} x{i % 7}" for i in range(3000))
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 50)
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 40)
    assert ids_of(own.encode(text)) == library.encode_ordinary(text)
    assert len(own.cache) <= 40 + 50


@pytest.mark.parametrize("where", ["small", "odd_dir", "empty_dir"])
def test_query_equals_the_library_and_reads_back(spark, both, where, request):
    d = request.getfixturevalue(where)
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r in rows:
        ids = both[1].encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [tuple(r) for r in queries.op11_byte_bpe(spark, d).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_another_rank_file(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame([(1, "Größe naïve 漢字 text"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in byte_bpe.decoded(byte_bpe.encoded(docs, path), path).collect()}
    assert ids_of(got[1].ids) == library.encode_ordinary("Größe naïve 漢字 text") and bytes(got[1].decoded).decode() == "Größe naïve 漢字 text"
    assert (got[2].n_tokens, bytes(got[2].ids), bytes(got[2].decoded)) == (0, b"", b"")
