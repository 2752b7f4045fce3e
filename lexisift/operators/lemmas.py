"""Lemmas by rules: endings that come off by word class, where what is left is a word.

Rules give each distinct (word, class) its candidates, the word itself first. Those that the word list has for the class are
kept; where there is none, rules are applied to the candidates once more. Of several the shortest is the lemma, of equally short ones the
first by rule; without any the word stays as it is. Exceptions come before all rules.

Only distinct words meet the word list, which may have any size: Spark sends it to all tasks where it is small enough, and else joins by
candidate. Texts meet the lemmas of the words that change, sent out where they are ``SENT`` at most and else joined with salted words,
as one word may be a twentieth of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Class, ending, what stands in its place.
RULES = (
    ("n", "s", ""), ("n", "ses", "s"), ("n", "ves", "f"), ("n", "xes", "x"), ("n", "zes", "z"), ("n", "ches", "ch"), ("n", "shes", "sh"), ("n", "men", "man"), ("n", "ies", "y"),
    ("v", "s", ""), ("v", "ies", "y"), ("v", "es", "e"), ("v", "es", ""), ("v", "ed", "e"), ("v", "ed", ""), ("v", "ing", "e"), ("v", "ing", ""),
    ("a", "er", ""), ("a", "est", ""), ("a", "er", "e"), ("a", "est", "e"),
)
SENT, SALTS = 50_000, 16


def detached(word: Column, kind: Column) -> Column:
    """The candidates that one rule makes of a word, by the order of the rules."""
    found = [F.when((kind == c) & F.endswith(word, F.lit(end)) & (F.char_length(word) > len(end) - len(new[:1])), F.concat(F.left(word, F.char_length(word) - len(end)), F.lit(new))) for c, end, new in RULES]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def lemmas(words: DataFrame, known: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """words: distinct (word, class); known: (word, class); exceptions: (word, class, lemma). Adds ``lemma``."""
    once = detached(F.col("word"), F.col("class"))
    own = words.select("word", "class", F.explode(F.array(once)).alias("_one"))
    twice = F.flatten(F.transform("_one", lambda x: detached(x, F.col("class"))))
    tries = F.concat(F.transform(F.concat(F.array("word"), F.col("_one")), lambda x, i: F.struct(F.lit(1).alias("round"), x.alias("to"), i.alias("at"))), F.transform(twice, lambda x, i: F.struct(F.lit(2).alias("round"), x.alias("to"), i.alias("at"))))
    each = own.select("word", "class", F.explode(tries).alias("t")).select("word", "class", "t.*")
    listed = known.select(F.col("word").alias("_w"), F.col("class").alias("_c")).distinct()
    hits = each.join(listed, (F.col("to") == F.col("_w")) & (F.col("class") == F.col("_c")))
    best = hits.groupBy("word", "class").agg(F.min_by("to", F.struct("round", F.char_length("to"), "at")).alias("by_rule"))
    out = words.join(best, ["word", "class"], "left")
    if exceptions is not None:
        out = out.join(exceptions.select("word", "class", F.col("lemma").alias("given")), ["word", "class"], "left")
    else:
        out = out.withColumn("given", F.lit(None).cast("string"))
    return out.select("word", "class", F.coalesce("given", "by_rule", "word").alias("lemma"))


def lemmatized(tokens: DataFrame, table: DataFrame, kind: Column) -> DataFrame:
    """tokens: rows with ``word``; table: as ``lemmas``; kind: a token's class. The tokens with ``lemma``."""
    moved = table.where("lemma <> word").select(F.col("word").alias("_w"), F.col("class").alias("_c"), F.col("lemma").alias("_l"))
    rows = tokens.withColumn("_k", kind)
    same = (F.col("word") == F.col("_w")) & (F.col("_k") == F.col("_c"))
    if moved.limit(SENT + 1).count() <= SENT:
        both = rows.join(F.broadcast(moved), same, "left")
    else:
        salted = rows.withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        both = salted.join(moved.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), same & (F.col("_s") == F.col("_t")), "left")
    return both.select(*tokens.columns, F.coalesce("_l", "word").alias("lemma"))
