"""The two sets of eleven features and the rules on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.functions import text as t
from lexisift.operators import lexicons as lx


def model_features(df: DataFrame, text: str = "text", keep: tuple = ("doc_id",), lexicon: dict | None = None, lemmas: dict | None = None) -> DataFrame:
    """The keys and the model's features; lexicon and lemmas may be one's own. Tokens are computed once, in a projection of their own."""
    df = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_w", t.preprocessed(F.col("_t"), lemmas))
    w, own = F.col("_w"), F.col("_t")
    n, distinct = F.size(w), F.size(F.array_distinct(w))
    polarity, subjectivity = t.sentiment(w, lexicon)
    chars = F.char_length(own)
    return df.select(
        *keep,
        n.cast("long").alias("review_length"),
        t.ratio(distinct, n).alias("lexical_diversity"),
        t.mean_length(w).alias("avg_word_length"),
        polarity.alias("sentiment_polarity"),
        subjectivity.alias("sentiment_subjectivity"),
        t.entropy(w).alias("word_entropy"),
        t.ratio(n - distinct, n).alias("repetition_ratio"),
        t.count_of(own, "!").alias("exclamation_count"),
        t.count_of(own, "?").alias("question_count"),
        t.ratio(F.regexp_count(own, F.lit(r"\p{Lu}")), chars).alias("capital_ratio"),
        t.ratio(F.regexp_count(own, F.lit(r"[^\p{L}\p{N}_]")), chars).alias("punctuation_density"),
    )


def rule_features(df: DataFrame, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """The keys, ``first``, the first token, and those of the model's features that the rules ask for; an entropy of 2 or more, which makes no
    difference to them, may be told as another number above 2."""
    df = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_w", t.preprocessed(F.col("_t")))
    w, own = F.col("_w"), F.col("_t")
    n = F.size(w)
    return df.select(
        *keep,
        F.coalesce(F.get(w, F.lit(0)), F.lit("")).alias("first"),
        n.cast("long").alias("review_length"),
        t.entropy_under(w, 2.0).alias("word_entropy"),
        t.ratio(n - F.size(F.array_distinct(w)), n).alias("repetition_ratio"),
        t.count_of(own, "!").alias("exclamation_count"),
        t.count_of(own, "?").alias("question_count"),
        t.ratio(F.regexp_count(own, F.lit(r"\p{Lu}")), F.char_length(own)).alias("capital_ratio"),
    )


def sentences(text: Column) -> Column:
    return F.greatest(F.regexp_count(text, F.lit(r"[.!?]+")), F.when(F.rlike(text, F.lit(r"[\p{L}\p{N}]")), 1).otherwise(0)).cast("long")


def reading_ease(words: Column, n_sentences: Column) -> Column:
    n = F.size(words)
    syllables = t.all_syllables(words)
    score = F.lit(206.835) - F.lit(1.015) * (n / n_sentences) - F.lit(84.6) * (syllables / n)
    return F.when((n == 0) | (n_sentences == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def shouted(words: Column) -> Column:
    """Share of words of two characters or more in capitals."""
    loud = F.filter(words, lambda w: (F.char_length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w)))
    return t.ratio(F.size(loud), F.size(words))


def range_features(df: DataFrame, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    df = df.select(*keep, F.col(text).alias("_r"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    df = df.withColumns({"_w": t.range_tokens(F.col("_r")), "_a": t.extract(F.lower("_t"), r"[\p{L}\p{N}]+"), "_s": t.words(F.col("_t")), "_n": sentences(F.col("_t"))})
    w, own = F.col("_w"), F.col("_t")
    n, distinct = F.size(w), F.size(F.array_distinct(w))
    polarity, subjectivity = t.sentiment(w)
    return df.select(
        *keep,
        n.cast("long").alias("review_length"),
        t.ratio(distinct, n).alias("lexical_diversity"),
        t.mean_length(w).alias("avg_word_length"),
        polarity.alias("sentiment_polarity"),
        subjectivity.alias("sentiment_subjectivity"),
        reading_ease(F.col("_a"), F.col("_n")).alias("language_complexity"),
        t.ratio(n - distinct, n).alias("repetition_ratio"),
        t.count_of(own, "!").alias("exclamation_count"),
        t.count_of(own, "?").alias("question_count"),
        shouted(F.col("_s")).alias("capital_usage"),
        t.ratio(F.regexp_count(own, F.lit(r"[!?.,\-;:]")), n).alias("punctuation_density"),
    )


def warnings() -> Column:
    """How many of the six warnings the model features raise."""
    rules = ("review_length < 5", "word_entropy < 2.0", "exclamation_count >= 3", "capital_ratio > 0.5", "question_count >= 3", "repetition_ratio > 0.3")
    out = F.lit(0)
    for r in rules:
        out = out + F.expr(f"CASE WHEN {r} THEN 1 ELSE 0 END")
    return out


def forced(gibberish: Column, first_word: Column) -> Column:
    """Whether rules alone make a review anomalous."""
    short = (F.col("review_length") <= 2) & (F.col("word_entropy") < 1.0)
    single = (F.col("review_length") == 1) & F.char_length(first_word).between(4, 8) & ~F.lower(first_word).isin(lx.COMMON_WORDS)
    return gibberish | short | single | (warnings() >= 3)
