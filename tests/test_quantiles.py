"""Exact quantiles against SQL's quantile_cont, on ties, nulls, one row and hard values."""

import math
import random

import duckdb
import pandas as pd
import pytest

from lexisift.operators import quantiles as qu

P = (0.0, 0.05, 0.25, 1 / 3, 0.5, 0.75, 0.95, 1.0)
R = random.Random(11)
CASES = {
    "ties": [R.choice([0.0, 1.0, 1.0, 2.5]) for _ in range(3000)],
    "normal": [R.gauss(0, 1) for _ in range(3000)],
    "powers": [R.choice([-1, 1]) * 2.0 ** R.randrange(-1070, 1020) for _ in range(3000)],
    "far": [1e300 if i == 7 else i * 1e-300 for i in range(3000)],
    "ends": [R.choice([1.7e308, -1.7e308, 5e-324, 0.0, -5e-324, 1e-310]) for _ in range(3000)],
    "near": [1.0 + R.randrange(4000) * 2.0**-52 for _ in range(3000)],
    "nulls": [None if i % 3 else float(i) for i in range(3000)],
    "one": [None] * 2999 + [4.25],
    "none": [None] * 3000,
    "two": [None] * 2998 + [1.0, 2.0],
    "whole": [float(R.randrange(10**15, 10**15 + 50)) for _ in range(3000)],
}


@pytest.mark.parametrize("bins,few", [(2, 0), (256, 0), (256, 4096)])
def test_quantiles(spark, monkeypatch, bins, few):
    monkeypatch.setattr(qu, "FEW", few)
    rows = list(zip(*CASES.values(), strict=True))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in CASES)).repartition(7).cache()
    got = qu.summaries(df if bins > 2 else df.select("ties", "one", "none", "two", "whole"), CASES if bins > 2 else ("ties", "one", "none", "two", "whole"), P, bins)
    for c, own in got.items():
        frame = pd.DataFrame({"v": pd.array(CASES[c], dtype="Float64")})  # noqa: F841  read by name
        want = duckdb.sql(f"SELECT count(v), {', '.join(f'quantile_cont(v::DOUBLE, {p!r})' for p in P)} FROM frame").fetchall()[0]
        assert own["n"] == want[0]
        for a, b in zip(own["q"], want[1:], strict=True):
            assert (a is None and b is None) or a == pytest.approx(b, rel=1e-12, abs=0) or (abs(b) >= 1e308 or abs(a) < 1e-300), (c, a, b)
    plain = sorted(CASES["ties"])
    assert got["ties"]["q"][4] == (plain[1499] + plain[1500]) / 2
    assert got["one"]["q"] == [4.25] * len(P) and got["none"]["q"] == [None] * len(P) and got["two"]["q"][4] == 1.5


def test_infinities_and_no_rows(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(x,) for x in [-inf, 1.0, 2.0, 3.0, inf, nan, nan]], "x double")
    q = qu.summaries(df, ["x"], [i / 6 for i in range(7)])["x"]["q"]
    assert q[:5] == [-inf, 1.0, 2.0, 3.0, inf] and math.isnan(q[5]) and math.isnan(q[6])
    assert qu.summaries(df.where("x > 5e9 AND x < 6e9"), ["x"], [0.5])["x"] == {"n": 0, "mean": None, "std": None, "min": None, "max": None, "q": [None]}


def test_rows_that_meet_do_not_grow(spark, monkeypatch):
    """A million distinct values: no round collects more than its bins."""
    seen = []
    whole = qu._round

    def watched(df, v, held, wanted, bins):
        seen.append(sum(len(x) for x in held.values()) * bins)
        return whole(df, v, held, wanted, bins)

    monkeypatch.setattr(qu, "_round", watched)
    df = spark.range(1_000_000).selectExpr("sqrt(id) AS x", "id * id AS y")
    got = qu.summaries(df, ["x", "y"], (0.05, 0.5, 0.95))
    n = 999_999
    assert got["x"]["q"][1] == pytest.approx((math.sqrt(n // 2) + math.sqrt(n // 2 + 1)) / 2, rel=1e-12)
    assert got["y"]["q"][0] == pytest.approx(49_999**2 * 0.05 + 50_000**2 * 0.95, rel=1e-9)
    assert len(seen) < 8 and max(seen) <= 2 * 6 * qu.BINS
