"""Exact quantiles of many columns by rounds of counting, whatever the number of rows and of distinct values.

A quantile lies at a rank, or between two. For each wanted rank an interval is kept that holds the value there. A round cuts every
interval into bins and counts the rows in each, with the least and the greatest value found; counts add up in the tasks before they
meet, so that a reducer sees as many rows as there are bins and tasks. The bin that the rank falls into is the next
interval, drawn in to its own least and greatest value, until the two are one. The least and the greatest value of an interval never share a
bin, so every round splits it; intervals that span many powers of two, or zero, are cut by logarithms, so that a few rounds
do for any values; where few rows are left in all intervals together, their values are fetched. The driver holds columns x ranks x
bins numbers.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, FEW = 256, 4096
_WIDE = 1 << 20


class Interval(NamedTuple):
    """The rows of ranks from ``before`` on, ``count`` of them, have values from low to high."""

    low: float
    high: float
    before: int
    count: int


def _curve(low: float, high: float):
    """A rising function of a column or of a number, steep enough between low and high to tell them apart."""
    most = max(abs(low), abs(high))
    if low < 0 < high or most > _WIDE * min(abs(low), abs(high)):
        scale = max(math.ldexp(most, -900), 5e-324)
        column = lambda v: F.signum(v) * F.log1p(F.abs(v) / F.lit(scale))
        return column, lambda v: math.copysign(math.log1p(abs(v) / scale), v)
    times = 2.0**60 if most < 1e-290 else 0.5  # neither do differences vanish nor do they overflow
    return (lambda v: v * F.lit(times)), (lambda v: v * times)


def _bin(v: Column, own: Interval, bins: int) -> Column:
    column, number = _curve(own.low, own.high)
    a, b = number(own.low), number(own.high)
    if not b > a:
        return F.when(v >= own.high, bins - 1).otherwise(0)
    place = F.floor((column(v) - F.lit(a)) / F.lit(b - a) * F.lit(bins - 1)).cast("int")
    # the greatest value alone is in the last bin
    return F.when(v >= own.high, bins - 1).otherwise(F.greatest(F.lit(0), F.least(F.lit(bins - 2), place)))


def _finite(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def ranks(n: int, p: float) -> tuple[int, int, float]:
    """The two ranks that the quantile lies between, and how far from the first."""
    at = p * (n - 1)
    low = math.floor(at)
    return low, min(low + 1, n - 1), at - low


def summaries(df: DataFrame, columns, probabilities=(), bins: int = BINS) -> dict[str, dict]:
    """For each numeric column: n, mean, std, min, max and the quantiles q, by linear interpolation as SQL's quantile_cont.

    Nulls are left out, NaN is above all numbers; a column without values has None everywhere. std is the sample's, None for one value.
    ``df`` is read once, and once a round where there are probabilities: it should be a table.
    """
    columns = list(columns)
    inf = float("inf")
    v = {c: F.col(f"`{c}`").cast("double") for c in columns}
    parts = []
    for i, c in enumerate(columns):
        own = _finite(v[c])
        parts += [f(v[c]).alias(f"{k}{i}") for k, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp), ("a", F.min), ("b", F.max))]
        parts += [F.count_if(v[c] == -inf).alias(f"d{i}"), F.count(own).alias(f"f{i}"), F.count_if((v[c] == inf) & ~F.isnan(v[c])).alias(f"u{i}"), F.min(own).alias(f"l{i}"), F.max(own).alias(f"h{i}")]
    got = df.agg(*parts).first()
    out = {c: {"n": got[f"n{i}"], "mean": got[f"m{i}"], "std": got[f"s{i}"], "min": got[f"a{i}"], "max": got[f"b{i}"], "q": [None] * len(probabilities)} for i, c in enumerate(columns)}
    known: dict[tuple[str, int], float] = {}
    held: dict[str, list[Interval]] = {}
    wanted: dict[str, set[int]] = {}
    for i, c in enumerate(columns):
        n, down, fine, up = (got[f"{k}{i}"] for k in "ndfu")
        for p in probabilities if n else ():
            for k in ranks(n, p)[:2]:
                if down <= k < down + fine:
                    wanted.setdefault(c, set()).add(k)
                else:
                    known[c, k] = -inf if k < down else inf if k < down + fine + up else float("nan")
        if c in wanted:
            held[c] = [Interval(got[f"l{i}"], got[f"h{i}"], down, fine)]
    while True:
        for c in list(held):
            for own in held[c]:
                if own.low == own.high:
                    known |= {(c, k): own.low for k in wanted[c] if own.before <= k < own.before + own.count}
            wanted[c] = {k for k in wanted[c] if (c, k) not in known}
            held[c] = [own for own in held[c] if any(own.before <= k < own.before + own.count for k in wanted[c])]
        held = {c: x for c, x in held.items() if x}
        if not held:
            break
        if sum(x.count for own in held.values() for x in own) <= FEW:
            known |= _few(df, v, held, wanted)
            break
        held = _round(df, v, held, wanted, bins)
    for c in columns:
        for j, p in enumerate(probabilities if out[c]["n"] else ()):
            low, high, part = ranks(out[c]["n"], p)
            a, b = known[c, low], known[c, high]
            out[c]["q"][j] = a if part == 0 or a == b else a * (1 - part) + b * part
    return out


def _few(df: DataFrame, v: dict, held: dict[str, list[Interval]], wanted: dict) -> dict:
    """The values at the wanted ranks, from all values of intervals that have ``FEW`` together."""
    inside = {c: F.lit(False) for c in held}
    for c, own in held.items():
        for x in own:
            inside[c] = inside[c] | v[c].between(x.low, x.high)
    cells = F.array(*[F.struct(F.when(inside[c], F.lit(i)).alias("c"), v[c].alias("v")) for i, c in enumerate(held)])
    got: dict[str, list] = {c: [] for c in held}
    for r in df.select(F.explode(cells).alias("x")).where("x.c IS NOT NULL").select("x.*").collect():
        got[list(held)[r["c"]]].append(r["v"])
    out = {}
    for c, own in held.items():
        every = sorted(got[c])
        for x in own:
            mine = [u for u in every if x.low <= u <= x.high]
            out |= {(c, k): mine[k - x.before] for k in wanted[c] if x.before <= k < x.before + x.count}
    return out


def _round(df: DataFrame, v: dict, held: dict[str, list[Interval]], wanted: dict, bins: int) -> dict[str, list[Interval]]:
    """The bins that the wanted ranks fall into."""
    cells, at = [], {}
    for c, own in held.items():
        place = None
        for x in own:
            inside = v[c].between(x.low, x.high)
            number = _bin(v[c], x, bins) + F.lit(len(at) * bins)
            at[len(at)] = (c, x)
            place = F.when(inside, number) if place is None else place.when(inside, number)
        cells.append(F.struct(place.alias("cell"), v[c].alias("v")))
    # a row's values in one array: each is in one interval of its column at most
    rows = df.select(F.explode(F.array(*cells)).alias("x")).where(F.col("x.cell").isNotNull())
    found = rows.groupBy("x.cell").agg(F.count(F.lit(1)).alias("n"), F.min("x.v").alias("a"), F.max("x.v").alias("b")).collect()  # a row per bin
    out: dict[str, list[Interval]] = {}
    before = {i: x.before for i, (_, x) in at.items()}
    for r in sorted(found, key=lambda r: r["cell"]):
        i = r["cell"] // bins
        c = at[i][0]
        if any(before[i] <= k < before[i] + r["n"] for k in wanted[c]):
            out.setdefault(c, []).append(Interval(r["a"], r["b"], before[i], r["n"]))
        before[i] += r["n"]
    return out
