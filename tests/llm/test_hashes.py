"""Pieces and words that a polynomial modulo 2**64 can't tell apart, and caches that are small or have bad keys."""

import hashlib
import zlib

import numpy as np
import pytest

from lexisift.llm import byte_bpe, ngram_join, packing, vectext


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


PAIRS = [t for n in (1024, 4096) for t in (thue_morse(n), thue_morse(n, "b", "a"))]
DOCS = [(i, t) for i, t in enumerate([*PAIRS, *[" ".join([t] * 6) for t in PAIRS]])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").coalesce(1)


def test_byte_bpe_tells_them_apart(docs):
    import public_tokenizers
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.merges(public_tokenizers.path(byte_bpe.RANKS)).ranks, special_tokens={})
    for r in byte_bpe.encoded(docs).collect():
        text = dict(DOCS)[r["doc_id"]]
        ids = enc.encode_ordinary(text)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_packing_tells_them_apart(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    for r in packing.cut(docs).collect():
        ids = [*t.encode(dict(DOCS)[r["doc_id"]], add_special_tokens=False).ids, 0][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_jaccard_join_tells_them_apart(docs):
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.links(docs).collect()} == {d: d for d, _ in DOCS}


def test_word_hashes():
    words = [b"", b"a", b"a\0", b"abcdefg", b"abcdefgh", b"abcdefghi", b"x" * 64, b"x" * 65, b"x" * 66, thue_morse(2048).encode(), thue_morse(2048, "b", "a").encode()]
    raw = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    got = vectext.word_hash(raw, end - [len(w) for w in words], end)
    assert len(set(got.tolist())) == len(words)
    for w, h in zip(words, got, strict=True):  # wherever they stand
        alone = np.frombuffer(b"--" + w + b"tail", np.uint8)
        assert vectext.word_hash(alone, np.array([2]), np.array([2 + len(w)]))[0] == h


@pytest.mark.parametrize("most", [4, 50, 10_000])
def test_cache_with_colliding_keys(monkeypatch, most):
    """Hashes of one bit: nearly all long pieces share their keys."""
    monkeypatch.setattr(vectext, "word_hash", lambda raw, start, end, wide=None: raw[start].astype(np.uint64) & np.uint64(1))
    r = np.random.default_rng(2)
    pieces = [bytes(r.integers(97, 100, r.integers(1, 14)).astype(np.uint8)) for _ in range(300)] * 2
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    end = np.cumsum([len(x) for x in pieces])
    start = end - [len(x) for x in pieces]

    def make(i):
        out = [np.frombuffer(pieces[j], np.uint8).astype(np.uint32) * 3 for j in i]
        return np.array([len(x) for x in out]), np.concatenate(out)

    cache = vectext.RaggedCache(np.uint32, most)
    for _ in range(2):
        lengths, data = vectext.cached_runs(cache, raw, start, end, make)
        assert lengths.tolist() == [len(x) for x in pieces] and (data == raw.astype(np.uint32) * 3).all()
