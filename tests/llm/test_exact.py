"""Operators beside brute-force versions on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lexisift.llm import byte_bpe, fingerprint, ngram_join, packing, pii, quality_classifier, quality_rules, secret_scan, sharding, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(7)
WORDS = [f"w{i}" for i in range(120)] + ["The", "of", "und", "café"]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], SCHEMA)


def rows_of(n=120):
    seeds = [[R.choice(WORDS) for _ in range(R.randrange(1, 70))] for _ in range(12)]
    out = []
    for i in range(n):
        w = list(R.choice(seeds))
        for _ in range(R.randrange(0, 3)):
            w[R.randrange(len(w))] = R.choice(WORDS)
        out.append((i * 3, " ".join(w) + R.choice(["", "\n", " token = abcdef123456", " me@x.org", " deadbeefdeadbeefdeadbeef01", " +1 (212) 555-1234"])))
    return out + [(1000, None), (1001, ""), (1002, " \n"), (1003, "z" * 3000), (1004, "a. " * 2000), (1005, "é" * 200)]


ROWS = rows_of()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


def table(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    own, up = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(own, 2):
        both = len(own[a] & own[b])
        if both and 100 * both >= 75 * len(own[a] | own[b]):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {d: (len(own[d]), find(d)) for d in own}


@pytest.mark.parametrize("block", [1024, 8])
def test_jaccard_join(docs, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in table(ngram_join.links(docs)).items()} == components(ROWS)


def test_signature_tree_finds_all_components():
    import numpy as np

    r = np.random.default_rng(3)
    seeds = [r.choice(1 << 40, 60, replace=False).astype(np.uint64) for _ in range(5)]
    own = [np.unique(np.concatenate([r.choice(s, r.integers(40, 61), replace=False), r.choice(1 << 40, r.integers(0, 9)).astype(np.uint64)])) for s in seeds for _ in range(30)]
    up = list(range(len(own)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    def joined(pairs):
        up[:] = range(len(own))
        for a, b in pairs:
            up[find(a)] = find(b)
        return {frozenset(j for j in range(len(own)) if find(j) == find(i)) for i in range(len(own))}

    every = [p for p in itertools.combinations(range(len(own)), 2) if ngram_join.similar(own[p[0]], own[p[1]], 75)]
    assert joined(ngram_join.SignatureTree(own).links(75)) == joined(every)


def repeats(rows, width=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if b[i : i + width] in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(b[i : i + width])
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest())
    return out


def test_suffix_dedup(docs):
    got = {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in table(suffix_dedup.deduplicated(docs)).items()}
    assert got == repeats(ROWS)


def spans(text, kinds):
    out = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m)]
    return hashlib.sha256(",".join(x[2] for x in sorted(out)).encode()).hexdigest()


def test_secrets(docs):
    kinds = (
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
    )
    assert {d: r["base_sha256"] for d, r in table(secret_scan.secrets(docs)).items()} == {d: spans(t, kinds) for d, t in ROWS}
    clean = table(secret_scan.redacted_documents(docs))
    assert not any("abcdef123456" in (r["text"] or "") for r in clean.values()) and len(clean) == len(ROWS)


def test_personal(docs):
    digits = lambda v: re.sub("[^0-9]", "", v)

    def luhn(d):
        return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m.group())) <= 15),
    )
    assert {d: r["base_sha256"] for d, r in table(pii.personal(docs)).items()} == {d: spans(t, kinds) for d, t in ROWS}


def test_sharding(docs):
    got = table(sharding.sharded(docs))
    assert all(r["text_crc32"] == zlib.crc32((dict(ROWS)[d] or "").encode()) and r["size"] == len((dict(ROWS)[d] or "").encode()) + 1 for d, r in got.items())
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got.values())
    for s in range(16):
        slots = sorted(r["slot"] for r in got.values() if r["shard"] == s)
        assert slots == list(range(len(slots)))
    heavy = [r["shard"] for r in sharding.assigned(docs, weights=[1.0, 3.0]).collect()]
    assert sum(heavy) > len(heavy) / 2


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    got = packing.packed(docs).collect()
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x in ROWS}
    for r in got:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))
    for _, group in itertools.groupby(sorted((r["sequence_id"], r["offset"], r["length"]) for r in got), lambda x: x[0]):
        at = 0
        for _, offset, length in group:
            assert offset == at
            at += length
        assert at <= 2048
    assert len({r["sequence_id"] for r in got}) <= -(-sum(map(len, ids.values())) // 2048) + 1


def test_byte_bpe(docs):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.merges(public_tokenizers.path(byte_bpe.RANKS)).ranks
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = table(byte_bpe.encoded(docs))
    for d, t in ROWS:
        ids = enc.encode_ordinary(t or "")
        assert got[d]["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert got[d]["n_tokens"] == len(ids) and got[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_fingerprints(docs):
    got, ordered = table(fingerprint.fingerprints(docs)), sorted(ROWS)
    for i, (d, t) in enumerate(ordered):
        own, after = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(own) // 2
        assert got[d]["edited_sha256"] == hashlib.sha256((own[: len(own) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1


def test_quality_rules(docs):
    got = table(quality_rules.quality(docs))
    for d, t in ROWS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)} if len(grams) < 500 else None
        assert got[d]["n_words"] == len(w) and got[d]["word_chars"] == sum(map(len, w))
        if hit is not None:
            assert got[d]["n_repeat_words"] == len(hit)
            assert got[d]["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_quality_rules_filtered(docs):
    """A filter on the result must not repeat the rules' work for each row."""
    all_rows = quality_rules.quality(docs).collect()
    for law, want in (("kept", lambda r: r.kept), ("n_repeat_words > 3", lambda r: r.n_repeat_words > 3), ("base_failed", lambda r: r.base_failed)):
        assert {r.doc_id for r in quality_rules.quality(docs).where(law).collect()} == {r.doc_id for r in all_rows if want(r)}
    assert {r.doc_id for r in quality_rules.kept_documents(docs).collect()} == {r.doc_id for r in all_rows if r.kept}


def test_classifier_held_out(spark):
    d = "/root/testdata/sf0.01"
    p = quality_classifier.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (p.predicted == p.quality).mean() > 0.93
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in p.doc_id)


EVERY = (ngram_join.links, suffix_dedup.deduplicated, pii.personal, sharding.sharded, packing.packed, quality_rules.quality, byte_bpe.encoded, fingerprint.fingerprints, secret_scan.secrets)


@pytest.mark.parametrize("f", EVERY, ids=lambda f: f.__module__.split(".")[-1])
def test_empty_table_nulls_and_clashing_names(spark, f):
    assert f(frame(spark, [])).count() == 0
    rows = [(None, "x y z"), (5, "same text here"), (5, "same text here"), (6, None)]
    odd = frame(spark, rows).withColumns({"n": F.lit(1), "shard": F.lit("s"), "component": F.lit(0), "kept": F.lit(None).cast("string"), "bucket": F.lit(2)})
    assert f(odd).count() == 4


def test_classifier_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_classifier.classified(frame(spark, [(1, "a b"), (None, None)]), labels).collect()
    assert [r["score"] for r in got] == [0.5, 0.5]


def test_classifier_sample(spark, monkeypatch):
    d, seen, fit = "/root/testdata/sf0.01", [], quality_classifier.Network.__init__
    monkeypatch.setattr(quality_classifier.Network, "__init__", lambda self, x, y: (seen.append((x, y)), fit(self, x, y))[1])
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    for sample in (20_000, 40):
        assert quality_classifier.classified(docs, labels, sample).count() == docs.count()
    (x, y), (few, own) = seen
    assert len(x) > 200 and len(few) == 40 and (x[:40] == few).all() and (y[:40] == own).all()
