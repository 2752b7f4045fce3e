"""Places of very many matches, and texts with very many spans cut out, against plain versions."""

from __future__ import annotations

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lexisift.llm import spans


def _plain_redacted(text, found, mark):
    out, at = "", 0
    for start, end in sorted(found):
        if end <= at:
            continue
        if start > at or at == 0:
            out += text[at:start] + mark
        at = end
    return out + text[at:]


@pytest.mark.parametrize("lot", [2, 128])
def test_places_and_cuts(spark, monkeypatch, lot):
    monkeypatch.setattr(spans, "LOT", lot)
    r = random.Random(lot)
    texts = ["", "x", "12", "1ü2é34", "é" * 40] + ["".join(r.choice("12 aé") for _ in range(r.randrange(1, 700))) for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    digits, near = spans.matches(F.col("t"), "[0-9]+", F.rlike("t", F.lit("[0-9]"))), spans.matches(F.col("t"), "[12]a")
    df = df.select("i", "t", digits.alias("d"), near.alias("n"))
    df = df.select("*", spans.redacted(F.col("t"), F.concat("d", "n"), "#").alias("r"))
    for row in df.collect():
        want = [[(m.start(), m.end(), m[0]) for m in re.finditer(p, row["t"])] for p in ("[0-9]+", "[12]a")]
        assert [[tuple(s) for s in row[k]] for k in ("d", "n")] == want
        assert row["r"] == _plain_redacted(row["t"], [s[:2] for w in want for s in w], "#")


def test_very_many_spans(spark):
    text = "ab 7 " * 60_000
    df = spark.createDataFrame([(text,)], "t string").select("t", spans.matches(F.col("t"), "[0-9]+").alias("d"))
    row = df.select(F.size("d").alias("n"), F.element_at("d", -1)["start"].alias("last"), F.crc32(spans.redacted(F.col("t"), F.col("d"), "#").cast("binary")).alias("crc")).first()
    assert (row["n"], row["last"]) == (60_000, len(text) - 2)
    assert row["crc"] == zlib.crc32(text.replace("7", "#").encode())
