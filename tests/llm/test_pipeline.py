"""The pipeline's rows against a plain version of its five stages."""

import os
import re
import sys
import zlib

import corpus_pipeline
from lexisift.llm import quality_rules

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_exact import components  # noqa: E402


def repeats(rows, width=100):
    """The texts without repeated stretches."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        b, gone = t.encode(), bytearray(len(t.encode()))
        for i in range(len(b) - width + 1):
            if b[i : i + width] in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(b[i : i + width])
        out[d] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")
    return out


def test_stages(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    kept = {r["doc_id"] for r in quality_rules.quality(spark.read.parquet(f"{d}/documents.parquet")).where("kept").collect()}
    docs = {k: t for k, t in docs.items() if k in kept}
    one = components(list(docs.items()))
    docs = {k: t for k, t in docs.items() if one[k][1] == k}
    docs = {k: t for k, t in repeats(list(docs.items())).items() if t}
    kinds = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}")
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in got} == set(docs)
    plain = {k: x for k, x in docs.items() if not any(re.search(p, x) for p in kinds)}
    assert len(plain) > len(docs) * 0.8
    for k, x in plain.items():
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == k)
        assert own == [(i, a, len(ids[a : a + 2048]), zlib.crc32(b"".join(v.to_bytes(4, "little") for v in ids[a : a + 2048]))) for i, a in enumerate(range(0, len(ids), 2048))]
    # every sequence is packed without gaps and not beyond its length, and they are as few as a plain best fit needs
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for rows in by.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
    gaps = []
    for x in sorted((r["length"] for r in got), reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps[gaps.index(min(fits))] -= x
        else:
            gaps.append(2048 - x)
    assert len(by) <= len(gaps)
