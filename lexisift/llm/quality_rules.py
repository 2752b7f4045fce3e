"""Quality rules: a table of thresholds, compiled into one projection of built-in column functions.

A row of ``RULES`` is (name, ratio, lowest, highest). ``compile_rules`` turns the table into columns of one projection;
a document is kept if the base law holds and each ratio lies within its bounds. No shuffle, no user function.

Defined cases: a null text counts as empty; an empty text, or one without words, has no words and fails the base law.
Repeated rows and ties are judged row by row. An empty table gives an empty result. Other columns of the input pass
through ``kept_documents`` under any name, and through ``judged`` except those that bear the names of its results or begin with ``_q_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]"
# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that it for on was as with by are be this from or an at "
    "der die und das den ist von zu mit auf des dem ein eine nicht im sich "
    "de la le les et des en un une que dans est pour qui du par pas sur au "
    "el los las del una y se por con para no su al lo"
).split()

#: name, ratio, lowest, highest. Ratios are in per mille of words, characters or lines.
RULES = (
    ("mean_word_length", "word_chars * 1000 / n_words", 2000, 16000),
    ("symbols_per_word", "n_symbols * 1000 / n_words", 0, 150),
    ("stop_words", "n_stop_words * 1000 / n_words", 10, 1000),
    ("duplicate_lines", "n_dup_lines * 1000 / n_lines", 0, 300),
    ("repeated_words", "n_repeat_words * 1000 / n_words", 0, 400),
    ("exclamations_per_word", "n_exclamations * 1000 / n_words", 0, 400),
    ("alphabetic_words", "n_alphabetic * 1000 / n_words", 600, 1000),
)


def measures(text: Column) -> dict[str, Column]:
    """Counts that need no array of words."""
    return {
        "word_chars": F.char_length(text) - F.regexp_count(text, F.lit(WHITE)),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
        "n_exclamations": F.regexp_count(text, F.lit("!")),
    }


def repeated_windows(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words which the text has twice or more.

    Windows are sorted by their 64-bit hash beside their place, so that equal ones are neighbours; then the places
    of repeated windows are sorted and the words that they cover are counted. This takes n log n steps.
    """
    last = F.size(words) - F.lit(width - 1)
    windows = F.when(
        last > 0,
        F.sort_array(F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.xxhash64(*[F.element_at(words, (i + F.lit(k)).cast("int")) for k in range(width)]).alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    return windows


def covered(windows: Column, width: int = 3) -> Column:
    n = F.size(windows)
    h = lambda i: F.get(windows, (i).cast("int"))["h"]
    hits = F.sort_array(
        F.transform(
            F.filter(
                F.transform(windows, lambda x, i: F.struct(x["i"].alias("i"), (F.coalesce(h(i - 1) == x["h"], F.lit(False)) | F.coalesce(h(i + 1) == x["h"], F.lit(False))).alias("twice"))),
                lambda x: x["twice"],
            ),
            lambda x: x["i"],
        )
    )
    step = F.aggregate(
        hits,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-(1 << 20)).alias("at")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["at"])).cast("long").alias("n"), i.alias("at")),
        lambda a: a["n"],
    )
    return F.when(n < 2, F.lit(0).cast("long")).otherwise(step)


def compile_rules(rules=RULES) -> list[Column]:
    """One column per rule: its name where the ratio is out of bounds, or has nothing to divide by; else null."""

    def failed(name, ratio, low, high):
        above, below = ratio.split(" / ")
        within = F.expr(f"{above} / nullif({below}, 0)").between(low, high)
        return F.when(~F.coalesce(within, F.lit(False)), F.lit(name))

    return [failed(*rule) for rule in rules]


def judged(docs: DataFrame, text: str = "text", rules=RULES, fewest: int = 50) -> DataFrame:
    """The input's columns with the counts, ``base_failed``, ``failed_rules`` and ``kept``."""
    clean = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumns(
        {
            "_q_words": F.filter(F.split(clean, WHITE + "+"), lambda w: w != ""),
            "_q_lines": F.filter(F.split(clean, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            **measures(clean),
        }
    )
    df = df.withColumns(
        {
            "n_words": F.size("_q_words").cast("long"),
            "n_lines": F.size("_q_lines").cast("long"),
            "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "_q_windows": repeated_windows(F.col("_q_words")),
            "n_stop_words": F.size(F.filter("_q_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
            "n_alphabetic": F.size(F.filter("_q_words", lambda w: w.rlike(r"\p{L}"))).cast("long"),
        }
    )
    # A filter on the result must stay above this projection: pushed below, it would hold a copy of the windows for each use,
    # in the lambdas once an element. The optimizer keeps it above a row number.
    df = df.withColumn("n_repeat_words", F.when(F.monotonically_increasing_id() >= 0, covered(F.col("_q_windows"))))
    df = df.withColumn("base_failed", (F.col("n_words") < fewest) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    df = df.withColumn("failed_rules", F.filter(F.array(*compile_rules(rules)), lambda x: x.isNotNull()))
    df = df.withColumns({k: F.col(k).cast("long") for k in ("word_chars", "n_symbols", "n_exclamations")})
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_q_words", "_q_lines", "_q_windows")


def quality(docs: DataFrame) -> DataFrame:
    return judged(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, whatever their columns are called: they travel as one."""
    own = docs.select(F.struct("*").alias("_q_row"), F.col("text"))
    return judged(own).where("kept").select("_q_row.*")


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    law = " AND ".join(f"coalesce(({r.replace(' / ', '::DOUBLE / nullif(')}, 0)) BETWEEN {a} AND {b}, false)" for _, r, a, b in RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, sum(s)::BIGINT AS n FROM (SELECT doc_id, least(3, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 3)) AS s FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclamations,
  len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(ws, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
  len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_alphabetic
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {law} AS kept FROM b"""


SQL = _sql()
