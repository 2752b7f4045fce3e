"""Sentences by statistics of the corpus: which full stops end an abbreviation is learned from the texts, without labels.

A word that nearly always stands with a full stop is an abbreviation. How much likelier its stops are under that reading than
under the share of stops over all words is a log-likelihood ratio; it counts for more the shorter the word, and the more stops it has
within, and for less with every time it stands without one. A stop after an abbreviation, after an initial or before a small letter ends
no sentence; an exclamation or question mark does, and so does the end of the text.

Words are counted in their task before they are shuffled. The abbreviations go to all tasks only where they are ``SENT`` at most; else the stops
are joined with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.functions import text as tx
from lexisift.operators.stages import staged

#: Fixed values of the method: the share of stops of an abbreviation, and the ratio from which a word is one.
SURE, LEAST = 0.99, 0.3
SENT = 50_000
OPENING, CLOSING = r"""^["'(\[«“‘]+""", r"""["')\]»”’]+$"""
STOPS = "[.!?…]+$"


def core(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(token, CLOSING, ""), OPENING, "")


def base(core_: Column) -> Column:
    return F.lower(F.regexp_replace(core_, STOPS, ""))


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, i, core, base, following): the tokens of each text and what the next one begins with."""
    words = tx.words(F.coalesce(F.col(text), F.lit("")))
    cores = docs.select(key, F.explode(F.array(F.transform(words, core))).alias("_c"))
    own = F.transform("_c", lambda c, i: F.struct(i.alias("i"), c.alias("core"), base(c).alias("base"), F.get("_c", i + 1).alias("following")))
    return cores.select(key, F.explode(own).alias("t")).select(key, "t.*")


def abbreviations(rows: DataFrame) -> DataFrame:
    """(word, n, k, score): the words that stand n times, k of them with a full stop, and are abbreviations. rows: as ``tokens``."""
    stop = F.col("core").rlike(r"[^.!?…]\.$")
    each = rows.where("base <> ''").groupBy(F.col("base").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.count_if(stop).alias("k"))
    each = staged(each)  # a row per word, read twice: texts are cut into tokens once for it
    total = each.agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"))
    n, k, p = F.col("n"), F.col("k"), F.col("all_k") / F.col("all_n")
    ratio = 2 * (k * F.ln(F.lit(SURE)) + (n - k) * F.ln(F.lit(1 - SURE)) - k * F.ln(p) - (n - k) * F.ln(1 - p))
    size = F.char_length(F.replace("word", F.lit("."), F.lit("")))
    inner = F.char_length("word") - size
    score = ratio * F.exp(-size.cast("double")) * (inner + 1) * F.pow(size.cast("double"), -(n - k))
    named = each.where(F.col("word").rlike(r"\p{L}") & (F.col("k") > 0)).join(F.broadcast(total)).where((p > 0) & (p < 1))
    return named.select("word", "n", "k", score.alias("score")).where(F.col("score") >= LEAST)


def boundaries(docs: DataFrame, known: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, i): the tokens that end a sentence. ``known`` has the abbreviations as ``word``; by default they are those of the texts."""
    rows = tokens(docs, key, text)
    known = (staged(abbreviations(rows)) if known is None else known).select("word")
    known = F.broadcast(known) if known.limit(SENT + 1).count() <= SENT else known
    ends = rows.where(F.col("core").rlike(STOPS) | F.col("following").isNull())
    marked = ends.join(known, F.col("base") == F.col("word"), "left")
    loud = F.col("core").rlike("[!?…]$")
    silent = F.col("word").isNotNull() | F.col("base").rlike(r"^\p{L}$") | F.coalesce(F.col("following").rlike(r"^\p{Ll}"), F.lit(False))
    return marked.where(F.col("following").isNull() | loud | ~silent).select(key, "i")
