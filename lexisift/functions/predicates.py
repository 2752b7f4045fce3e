"""Predicates on raw input: Tagalog, gibberish, and what an input must be to be scored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexisift.functions import text as t
from lexisift.operators import lexicons as lx

CONSONANTS = "[bcdfghjklmnpqrstvwxyz]"
INVALID = "Invalid data entry"


def share(words: Column, test) -> Column:
    return t.ratio(F.size(F.filter(words, test)), F.size(words))


def tagalog_by_share(text: Column) -> Column:
    return share(t.words(F.lower(text)), lambda w: w.isin(lx.TAGALOG)) > 0.2


def tagalog(text: Column) -> Column:
    low = F.lower(text)
    n, whole = F.size(t.words(low)), t.tokens(low)
    out = tagalog_by_share(text)
    for group in lx.TAGALOG_GROUPS:
        hits = _hits(whole, group)
        out = out | ((hits > 0) & ((n < 20) | (hits >= 2)))
    return out


def _hits(words: Column, group: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(group)))


def _chars(w: Column) -> Column:
    return F.filter(F.split(w, ""), lambda c: c != "")


def _prefix_repeats(w: Column, k: int) -> Column:
    """The first k characters recur three times or more."""
    without = F.replace(w, F.substr(w, F.lit(1), F.lit(k)), F.lit(""))
    return (F.char_length(w) >= 3 * k) & (F.char_length(w) - F.char_length(without) >= 3 * k)


def _same_char(w: Column) -> Column:
    chars = F.array_distinct(_chars(w))
    most = F.array_max(F.transform(chars, lambda c: F.char_length(w) - F.char_length(F.replace(w, c, F.lit("")))))
    return (F.char_length(w) >= 4) & (most / F.char_length(w) > 0.7)


def _few_chars(w: Column) -> Column:
    distinct = F.size(F.array_distinct(_chars(w)))
    n = F.char_length(w)
    return ((n >= 4) & (distinct / n < 0.4)) | ((n >= 6) & (distinct <= 3))


def _odd(w: Column) -> Column:
    """Any of the repetitions above. None is in a word under four characters; in one of up to ten, few characters or mostly one of them are
    three different ones at most, which is told without a list of the characters."""
    rest = w
    for _ in range(3):
        rest = F.replace(rest, F.substr(rest, F.lit(1), F.lit(1)), F.lit(""))
    size = F.char_length(w)
    return (size >= 4) & (_prefix_repeats(w, 2) | _prefix_repeats(w, 3) | (((size > 10) | (F.char_length(rest) == 0)) & (_same_char(w) | _few_chars(w))))


def vowel_share(w: Column) -> Column:
    return t.ratio(F.regexp_count(w, F.lit("[aeiou]")), F.char_length(w))


def keyboard_steps(w: Column) -> Column:
    """Neighbouring characters at most two keys apart in one row."""

    def near(i):
        a, b = F.substr(w, i, F.lit(1)), F.substr(w, i + 1, F.lit(1))
        out = F.lit(False)
        for row in lx.KEYBOARD:
            x, y = F.instr(F.lit(row), a), F.instr(F.lit(row), b)
            out = out | ((x > 0) & (y > 0) & (F.abs(x - y) <= 2))
        return out

    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(w) - 1, F.lit(1))), near))


def gibberish(text: Column, ui: bool = False) -> Column:
    """ui: the variant with a longer mean length, and without entropy and word list. Words are those of the lowered text."""
    return t.once(t.tokens(F.lower(text)), lambda words: _gibberish(words, ui))


def _gibberish(words: Column, ui: bool) -> Column:
    n, first = F.size(words), F.element_at(words, 1)
    size = F.char_length(first)
    cluster = lambda w: F.rlike(w, F.lit(CONSONANTS + "{3,}"))
    odd = F.exists(F.array_distinct(words), _odd)
    mash = (n == 1) & size.between(4, 8) & F.rlike(first, F.lit("^[a-z]+$" if ui else r"^\p{Ll}+$"))
    few_vowels = vowel_share(first) < 0.25
    mash = mash & ((keyboard_steps(first) >= 2) | (few_vowels if ui else few_vowels & ~first.isin(lx.SHORT_WORDS)))
    mean = t.mean_length(words)
    short = ((mean < 3.5) & (n > 2)) if ui else ((mean < 3.0) & (n > 3))
    repeated = (t.ratio(F.size(F.array_distinct(words)), n) < 0.4) & (n > 2)
    clusters = share(words, cluster) > 0.4
    tiny = (n >= 3) & (share(words, lambda w: F.char_length(w) <= 2) > 0.7)
    long_ = (share(words, lambda w: F.char_length(w) > 8) > 0.3) & F.exists(words, lambda w: (F.char_length(w) > 8) & cluster(w))
    single = (n == 1) & (size > 10) & ((vowel_share(first) < 0.2) | F.rlike(first, F.lit(CONSONANTS + "{4,}")))
    out = odd | mash | short | repeated | clusters | tiny | long_ | single
    if not ui:
        out = out | ((n > 3) & (t.entropy_under(words, 1.5, 0.0) < 1.5))
    return F.when(n == 0, False).otherwise(F.coalesce(out, F.lit(False)))


def validated(text: Column) -> tuple[Column, Column]:
    """Whether an input may be scored, and what is said if not."""
    blank = text.isNull() | (F.regexp_replace(text, t.BLANK, "") == "")
    message = F.when(blank, "Review text is empty").when(tagalog(text), INVALID)
    return message.isNull(), message


def validated_ui(text: Column, most: int = 200) -> tuple[Column, Column]:
    blank = text.isNull() | (F.regexp_replace(text, t.BLANK, "") == "")
    message = F.when(blank, "Please enter a review").when(F.size(t.words(text)) > most, f"More than {most} words").when(tagalog_by_share(text), INVALID)
    return message.isNull(), message
