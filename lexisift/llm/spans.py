"""Matches of a pattern with their places, from built-in functions only.

Places are code points from 0, ends exclusive. Spark tells no places of all matches, but its split gives the texts
between them: lengths of gaps and matches add up to the places. Patterns never match the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"


LOT = 128


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _lots(array: Column) -> Column:
    """The array in lots. What grows by appending, and so copies itself each time, only ever grows within a lot or by
    whole lots, which keeps texts with very many spans near linear."""
    return _let(array, lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(x) - 1, F.lit(0)) / LOT).cast("int")), lambda k: F.slice(x, (k * LOT + 1).cast("int"), F.lit(LOT))))


def no_spans() -> Column:
    return F.array().cast(SPAN)


def matches(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """All leftmost matches that do not overlap. gate: a cheap test without which there can be none."""
    parts = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, hit: F.struct(F.char_length(gap).alias("skip"), hit.alias("value")),
    )
    hits = F.filter(parts, lambda p: p["value"].isNotNull())

    def placed(a: Column, p: Column) -> Column:
        start = a["at"] + p["skip"]
        end = start + F.char_length(p["value"])
        return F.struct(end.alias("at"), F.array_append(a["out"], F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value"))).cast(SPAN).alias("out"))

    def lot_placed(a: Column, lot: Column) -> Column:
        own = F.aggregate(lot, F.struct(a["at"].alias("at"), no_spans().alias("out")), placed)
        return _let(own, lambda x: F.struct(x["at"].alias("at"), F.array_append(a["out"], x["out"]).cast(f"array<{SPAN}>").alias("out")))

    laid = F.aggregate(_lots(hits), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), lot_placed, lambda a: F.flatten(a["out"]))
    return laid if gate is None else F.when(gate, laid).otherwise(no_spans())


def joined(kinds: list[tuple[str, Column]]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, joined by commas."""

    def marked(k: int, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))

    every = F.flatten(F.array(*[marked(k, c) for k, (_, c) in enumerate(kinds)]))
    names = F.array(*[F.lit(name) for name, _ in kinds])
    return F.array_join(F.transform(F.sort_array(every), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of the value pass the Luhn check."""
    back = F.reverse(digits(value))
    doubled = F.transform(
        F.sequence(F.lit(1), F.greatest(F.char_length(back), F.lit(1))),
        lambda i: F.coalesce(F.substr(back, i, F.lit(1)).try_cast("int"), F.lit(0)) * (F.lit(2) - i % F.lit(2)),
    )
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return total % F.lit(10) == 0


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with every stretch that spans cover replaced by the mark; spans may overlap or touch."""
    none = F.array().cast("array<string>")

    def covered(base: Column, own: Column):
        def step(a: Column, s: Column) -> Column:
            more = (s["start"] < a["at"]) | ((s["start"] == a["at"]) & (a["at"] > 0))  # it goes on where the last one ended
            gap = F.array(F.substr(own, a["at"] - base + 1, s["start"] - a["at"]), F.lit(mark))
            return F.when(s["end"] <= a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.when(more, none).otherwise(gap)).alias("out")))

        return step

    def lot_covered(a: Column, lot: Column) -> Column:
        # the lot's own stretch of text, as a place is found by counting from the text's begin
        own = F.substr(text, a["at"] + 1, F.greatest(F.array_max(F.transform(lot, lambda s: s["end"])) - a["at"], F.lit(0)))
        laid = _let(own, lambda x: F.aggregate(lot, F.struct(a["at"].alias("at"), none.alias("out")), covered(a["at"], x)))
        return _let(laid, lambda x: F.struct(x["at"].alias("at"), F.array_append(a["out"], F.array_join(x["out"], "")).cast("array<string>").alias("out")))

    merged = F.aggregate(
        _lots(F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lot_covered,
        lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1, F.char_length(text))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(merged)
