"""N-grams of token lists as Arrow arrays, and the most frequent of them without shuffling them all.

A task keeps at most ``HELD`` counters. When they overflow, the largest count that has no place is taken from all of them, and what
has nothing left goes: a term's count then falls short of the truth by no more than what was taken, which is at most a
``HELD``-th of the terms counted. Such summaries are merged by adding counts and shortfalls. Terms whose count with the whole
shortfall reaches the count of the last of the wanted ones are candidates; they are counted again, exactly, each task counting
only them. Where the shortfall leaves too many candidates, more counters are kept, and in the end all terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.operators.stages import in_batches, staged

NGRAMS, LEAST, VOCABULARY = 3, 2, 20_000
HELD, LOT = 1 << 19, 1 << 17
#: Candidates that are sent to all tasks, at most, for each wanted term.
CANDIDATES = 8
_COUNTED = pa.schema([("term", pa.string()), ("total", pa.int64()), ("df", pa.int64())])


def grams(lists, most: int = NGRAMS) -> tuple[np.ndarray, pa.Array]:
    """(row, term) of the words of each list and of their n-grams, by row for each n."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().cast(pa.large_string())
    row = np.repeat(np.arange(len(size)), size)
    rows, terms, now = [row], [words], words
    for n in range(1, most):
        if len(row) <= n:
            break
        now = pc.binary_join_element_wise(now.slice(0, len(row) - n), words.slice(n), pa.scalar(" ", pa.large_string()))
        inside = row[n:] == row[:-n]
        rows.append(row[n:][inside])
        terms.append(now.filter(pa.array(inside)))
    return np.concatenate(rows), pa.chunked_array(terms).combine_chunks() if len(terms) > 1 else words


def lots(lists, most: int = LOT):
    """Slices of a column of lists with about ``most`` words; a longer list is alone."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    edge = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(edge, edge[at] + most, "right")) - 1)
        yield at, min(to, len(size))
        at = to


def _in_rows(row: np.ndarray, term: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of each term in each row."""
    cell, count = np.unique(row * terms + term, return_counts=True)
    return cell // terms, cell % terms, count


def _added(parts: list[pa.Table]) -> pa.Table:
    got = pa.concat_tables(parts).group_by("term").aggregate([("total", "sum"), ("df", "sum")])
    return pa.table({"term": got.column("term"), "total": got.column("total_sum"), "df": got.column("df_sum")})


def shortened(table: pa.Table, most: int) -> tuple[pa.Table, int]:
    """The table with ``most`` rows at most, its totals less by what is returned."""
    total = table.column("total").to_numpy()
    if len(total) <= most:
        return table, 0
    short = int(np.partition(total, len(total) - most - 1)[len(total) - most - 1])
    stays = total > short
    left = table.filter(pa.array(stays))
    return left.set_column(1, "total", pa.array(total[stays] - short)), short


def summaries(rows: DataFrame, held: int | None, column: str = "words") -> DataFrame:
    """(term, total, df): what each task counted, and a row without a term for its shortfall. Without ``held`` all is counted."""

    def run(batches):
        most = held or HELD
        own, parts, size, short = None, [], 0, 0
        out = lambda t: t.cast(_COUNTED).to_batches(1 << 16)
        for batch in batches:
            lists = batch.column(column)
            for a, b in lots(lists):
                row, term = grams(lists.slice(a, b - a))
                if not len(term):
                    continue
                code = term.dictionary_encode()
                n = len(code.dictionary)
                _, at, count = _in_rows(row, code.indices.to_numpy().astype(np.int64), n)
                parts.append(pa.table({"term": code.dictionary, "total": np.bincount(at, count, n).astype(np.int64), "df": np.bincount(at, minlength=n).astype(np.int64)}))
                size += n
                if size > most:
                    own = _added([*([own] if own is not None else []), *parts])
                    parts = []
                    if held is None and own.num_rows > most:
                        yield from out(own)
                        own = None
                    elif held is not None:
                        own, less = shortened(own, most)
                        short += less
                    size = 0
        if parts or own is not None:
            yield from out(_added([*([own] if own is not None else []), *parts]))
        if short:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([short], pa.int64()), pa.array([0], pa.int64())], ["term", "total", "df"])

    found = in_batches(rows.select(column), run, "term string, total long, df long")
    return found.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def recounted(rows: DataFrame, candidates: pa.Array, column: str = "words") -> DataFrame:
    """(term, total, df) of the candidates, exactly."""
    sent = rows.sparkSession.sparkContext.broadcast(candidates)

    def run(batches):
        known = sent.value
        total, df = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        for batch in batches:
            lists = batch.column(column)
            for a, b in lots(lists):
                row, term = grams(lists.slice(a, b - a))
                at = pc.fill_null(pc.index_in(term, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                _, at, count = _in_rows(row[at >= 0], at[at >= 0], max(len(known), 1))
                total += np.bincount(at, count, len(known)).astype(np.int64)
                df += np.bincount(at, minlength=len(known))
        some = np.flatnonzero(total)
        yield from pa.table([known.take(pa.array(some)), pa.array(total[some]), pa.array(df[some])], ["term", "total", "df"]).cast(_COUNTED).to_batches()

    found = in_batches(rows.select(column), run, "term string, total long, df long")
    return found.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def top_terms(rows: DataFrame, most: int = VOCABULARY, least: int = LEAST, held: int = HELD, column: str = "words") -> DataFrame:
    """(term, df, total): the ``most`` most frequent terms of those in ``least`` rows or more, equal ones by term. ``rows`` is read twice or
    more and should be a table; null lists have no terms."""
    first = lambda df: df.where(F.col("df") >= least).orderBy(F.desc("total"), "term").limit(most).select("term", "df", "total")
    for _ in range(3):
        found = staged(summaries(rows, held, column))
        short = found.where("term IS NULL").agg(F.sum("total")).first()[0]
        if not short:
            return first(found)  # nothing was shortened: the counts are exact
        sure = found.where(F.col("term").isNotNull() & (F.col("df") >= least)).orderBy(F.desc("total")).limit(most)
        last = sure.agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("total")).first()
        if last["n"] == most:
            near = found.where(F.col("term").isNotNull() & (F.col("total") + F.lit(short) >= F.lit(last["total"]))).select("term")
            if short < last["total"] and near.count() <= CANDIDATES * most:
                return first(recounted(rows, near.toArrow().column("term").combine_chunks().cast(pa.large_string()), column))
        held *= 4
    return first(summaries(rows, None, column))
