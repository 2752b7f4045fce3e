"""Cleaning and counting of texts, as column expressions. All stay in the JVM and need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexisift.operators import lexicons as lx

WORD = r"[\p{L}\p{N}_]"
BLANK = r"[ \t\n\r\f\x0b]"


def extract(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def once(value: Column, use) -> Column:
    """use(value), with the value computed once a row. Spark computes the arguments of ``filter``, ``exists`` and the like anew at each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean(text: Column) -> Column:
    """Lower case, without all but word characters and white space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_ \t\n\r\f\x0b]", "")


def tokens(text: Column) -> Column:
    return extract(text, WORD + "+")


def without_stopwords(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(lx.STOPWORDS))


def lemmas(words: Column, table: dict[str, str] | None = None) -> Column:
    table = lx.LEMMAS if table is None else table
    return F.transform(words, lambda w: F.when(w.isin(list(table)), F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), w)).otherwise(w))


def suffix_tag(word: Column) -> Column:
    """A tag by the word's ending; a tagger of one's own may stand in its place."""
    out = F
    for ending, tag in lx.ENDINGS:
        out = out.when(F.endswith(word, F.lit(ending)), tag)
    return out.otherwise("NN")


def wordnet_class(tag: Column) -> Column:
    """a, v or r by the tag's first letter; a noun otherwise."""
    first = F.upper(F.left(tag, F.lit(1)))
    return F.when(first == "J", "a").when(first == "V", "v").when(first == "R", "r").otherwise("n")


def tagged_lemmas(words: Column, table: dict[tuple[str, str], str], tag=suffix_tag) -> Column:
    """The lemma of each (word, class) in the table, else the word. tag: column of a word -> column of its tag."""
    names = F.create_map(*[F.lit(x) for (w, c), lemma in table.items() for x in (f"{w}/{c}", lemma)]) if table else None
    return words if names is None else F.transform(words, lambda w: F.coalesce(F.try_element_at(names, F.concat_ws("/", w, wordnet_class(tag(w)))), w))


def preprocessed(text: Column, table: dict[str, str] | None = None) -> Column:
    return lemmas(without_stopwords(tokens(clean(text))), table)


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def where_any(text: Column, marks: tuple, change) -> Column:
    """change(text) where the text has one of the marks, without which it would stay as it is."""

    def guarded(own):
        some = F.contains(own, F.lit(marks[0]))
        for mark in marks[1:]:
            some = some | F.contains(own, F.lit(mark))
        return F.when(some, change(own)).otherwise(own)

    return once(text, guarded)


def without_urls(text: Column) -> Column:
    return where_any(text, ("http", "www"), lambda x: F.regexp_replace(x, r"http[^ \t\n\r\f\x0b]+|www[^ \t\n\r\f\x0b]+", ""))


def without_emails(text: Column) -> Column:
    """A match starts where a run without white space does; to say so spares a search from each of its characters."""
    return where_any(text, ("@",), lambda x: F.regexp_replace(x, r"(?<![^ \t\n\r\f\x0b])[^ \t\n\r\f\x0b]+@[^ \t\n\r\f\x0b]+", ""))


def without_tags(text: Column) -> Column:
    return where_any(text, ("<",), lambda x: F.regexp_replace(x, r"<[^>]+>", ""))


CONTRACTIONS = (("don't", "do not"), ("won't", "will not"), ("can't", "cannot"), ("n't", " not"), ("'re", " are"), ("'ve", " have"), ("'ll", " will"))


def expanded(text: Column) -> Column:
    def change(own):
        for short, long_ in CONTRACTIONS:
            own = F.replace(own, F.lit(short), F.lit(long_))
        return own

    return where_any(text, ("'",), change)


def range_text(text: Column) -> Column:
    return expanded(without_tags(without_emails(without_urls(F.lower(F.coalesce(text, F.lit("nan")))))))


def range_tokens(text: Column) -> Column:
    """Tokens of the range features; a missing text has none."""
    own = F.filter(without_stopwords(extract(range_text(text), r"[\p{L}\p{N}]+")), lambda w: w != "")
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(lemmas(own))


def syllables(word: Column) -> Column:
    return F.when(F.char_length(word) <= 3, 1).otherwise(
        F.greatest(F.lit(1), F.regexp_count(word, F.lit("[aeiouy]+")) - F.when(F.endswith(word, F.lit("e")), 1).otherwise(0))
    )


def all_syllables(words_: Column) -> Column:
    """The sum of ``syllables`` of words without blanks, by three searches in all words at once rather than by one in each: runs of vowels, less
    a last e, and one for each word that then has none."""

    def of_long(own):
        count = lambda pattern: F.regexp_count(F.array_join(own, " "), F.lit(pattern)).cast("long")
        none = count(r"(?<![^ ])[^aeiouy ]*+(?:[aeiouy]*e)?(?![^ ])")
        return F.size(words_) - F.size(own) + F.when(F.size(own) == 0, 0).otherwise(count("[aeiouy]+") - count(r"e(?![^ ])") + none)

    return once(F.filter(words_, lambda w: F.char_length(w) > 3), of_long)


def mean_length(words_: Column) -> Column:
    return ratio(F.aggregate(words_, F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)), F.size(words_))


def count_of(text: Column, char: str) -> Column:
    """How often one character is in the text."""
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(char), F.lit("")))).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where there is nothing to divide by."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def entropy(words_: Column, epsilon: float = 1e-10) -> Column:
    """Minus the sum of p log2(p + epsilon) over distinct words; runs of the sorted words give the counts."""
    n = F.size(words_).cast("double")
    term = lambda run: (run / n) * F.log2(run / n + F.lit(epsilon))
    start = F.struct(F.lit(None).cast("string").alias("word"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(a, w):
        same = F.coalesce(a["word"] == w, F.lit(False))
        return F.struct(
            w.alias("word"),
            F.when(same, a["run"] + 1.0).otherwise(1.0).alias("run"),
            F.when(same | (a["run"] == 0), a["sum"]).otherwise(a["sum"] + term(a["run"])).alias("sum"),
        )

    return F.when(F.size(words_) == 0, 0.0).otherwise(F.aggregate(F.sort_array(words_), start, step, lambda a: -(a["sum"] + term(a["run"]))))


def entropy_under(words_: Column, limit: float, epsilon: float = 1e-10) -> Column:
    """The entropy where it is under the limit; elsewhere it, or a number above the limit: n words with d distinct ones have no less than if one
    had all repetitions, and where that is clear of the limit they need no counting."""
    n, d = (F.greatest(F.size(x), F.lit(1)).cast("double") for x in (words_, F.array_distinct(words_)))
    most = (n - d + 1) / n
    least = (d - 1) / n * F.log2(n) - most * F.log2(most)
    return F.when(least > limit + 0.01, least).otherwise(entropy(words_, epsilon))


def sentiment(words_: Column, lexicon: dict[str, tuple[float, float]] | None = None) -> tuple[Column, Column]:
    """Mean polarity and subjectivity of the words in the lexicon; 0 without any. ``sources.io.read_lexicon`` loads one."""
    lexicon = lx.SENTIMENT if lexicon is None else lexicon
    names = list(lexicon)
    known = F.filter(words_, lambda w: w.isin(names))

    def mean(k):
        table = F.create_map(*[F.lit(x) for w, v in lexicon.items() for x in (w, float(v[k]))])
        return once(known, lambda own: ratio(F.aggregate(own, F.lit(0.0), lambda a, w: a + F.element_at(table, w)), F.size(own)))

    return mean(0), mean(1)
