"""Places of pieces against a plain best fit, on random and hard lengths."""

import random
from collections import Counter

import pytest

from lexisift.llm import packing


def best_fit(lengths, most):
    """Sequences of a plain best fit, longest first."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps[gaps.index(min(fits))] -= x
        else:
            gaps.append(most - x)
    return len(gaps)


def cases():
    r = random.Random(4)
    yield [r.randrange(1, 101) for _ in range(400)], 100
    yield [r.choice((34, 33, 51, 26, 24, 17, 16, 7)) for _ in range(500)], 101  # thirds and halves, one over
    yield [100] * 7 + [1] * 700 + [50] * 9, 100
    yield [min(2048, int(r.paretovariate(1.1) * 40)) for _ in range(800)], 2048
    yield [51, 50] * 60 + [25] * 31, 100


@pytest.mark.parametrize("lengths,most", list(cases()))
def test_rounds_are_a_best_fit(lengths, most):
    ranks, used, spans = {}, {}, []
    for length, first, count, sequence, offset in packing.rounds(Counter(lengths), most):
        assert first == ranks.get(length, 0)
        ranks[length] = first + count
        spans += [(sequence + i, offset, length) for i in range(count)]
    assert ranks == Counter(lengths)
    for sequence, offset, length in sorted(spans):
        assert offset == used.get(sequence, 0)
        used[sequence] = offset + length
    assert max(used.values()) <= most and len(used) <= best_fit(lengths, most)


def test_many_pieces_of_one_length(spark, monkeypatch):
    """A stretch over several cells: every piece gets a place of its own."""
    monkeypatch.setattr(packing, "STEP", 16)
    docs = spark.range(700).selectExpr("id AS doc_id", "if(id % 3 = 0, 'one two', 'one two three four') AS text")
    rows = packing.packed(docs, most=16).collect()
    assert len(rows) == 700 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 700
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 16 and len(ends) <= best_fit([r["length"] for r in rows], 16)


def test_special_literals(spark):
    """Ids where a text holds the literals of special tokens, whole, in other cases or in part."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    r = random.Random(6)
    parts = ["hello", " ", "World", "<|startoftext|>", "<|endoftext|>", "<|EndOfText|>", "<|endoftext", "|>", "'s", "é", "\n", "12"]
    texts = ["hello <|endoftext|> world", "<|startoftext|>", "", None, *["".join(r.choice(parts) for _ in range(r.randrange(1, 12))) for _ in range(400)]]
    got = {x["doc_id"]: x for x in packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert t.encode(texts[0], add_special_tokens=False).ids == [3306, 49407, 1002]
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        assert (got[i]["length"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(b"".join(v.to_bytes(4, "little") for v in ids)))
