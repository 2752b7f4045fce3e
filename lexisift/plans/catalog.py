"""All queries of the review engine by name, each beside the SQL that it is held against (None: rows only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexisift.functions import features as ft
from lexisift.functions import predicates as pr
from lexisift.functions import text as tx
from lexisift.operators import clustering as cl
from lexisift.operators import evaluation as ev
from lexisift.operators import lemmas as le
from lexisift.operators import lexicons as lx
from lexisift.operators import model as mo
from lexisift.operators import quantiles as qu
from lexisift.operators import scoring as so
from lexisift.operators import sentences as se
from lexisift.operators import terms as te
from lexisift.operators.stages import fresh, spread
from lexisift.plans import sqltext as q
from lexisift.sources import io

CATALOG: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        CATALOG[name] = (f, sql)
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def rounded(c, digits: int) -> Column:
    """As the SQL rounds: the double times a power of ten to the nearest whole number, halves away from zero. ``F.round`` goes by the decimal
    digits, and differs where the product is not quite a half."""
    scale = F.lit(10.0**digits)
    return F.round((F.col(c) if isinstance(c, str) else c) * scale, 0) / scale


def r(c) -> Column:
    return rounded(c, 6)


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


def scalar(name: str, columns: dict, sql: dict, ctes: str = q.D, source: str = "d"):
    """A projection of the documents: column -> expression of the text, and the same in SQL."""

    def run(spark, d):
        text = F.col("text")
        return docs(spark, d).select("doc_id", *[f(text).alias(c) for c, f in columns.items()])

    CATALOG[name] = (run, f"WITH {ctes} SELECT doc_id, " + ", ".join(f"{x} AS {c}" for c, x in sql.items()) + f" FROM {source}")


def from_features(name: str, columns, sql: dict, ranges: bool = False):
    """columns: makes the column expressions, which takes a session."""

    def run(spark, d):
        df = (ft.range_features if ranges else ft.model_features)(docs(spark, d))
        return df.select("doc_id", *[f.alias(c) for c, f in columns().items()])

    CATALOG[name] = (run, f"WITH {q.RANGES if ranges else q.FEATURES} SELECT doc_id, " + ", ".join(f"{x} AS {c}" for c, x in sql.items()) + f" FROM {'rfeat' if ranges else 'feat'}")


# --- cleaning and tokens
@query("scan_documents", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


scalar("clean_text", {"clean": tx.clean}, {"clean": q.CLEAN})
scalar("tokenize", {"tokens": lambda t: joined(tx.tokens(tx.clean(t)))}, {"tokens": f"array_to_string({q.TOKENS}, ' ')"})
scalar("remove_stopwords", {"tokens": lambda t: joined(tx.without_stopwords(tx.tokens(tx.clean(t))))}, {"tokens": f"array_to_string({q.NO_STOP}, ' ')"})
scalar("lemmatize", {"tokens": lambda t: joined(tx.lemmas(tx.tokens(tx.clean(t))))}, {"tokens": f"array_to_string(list_transform({q.TOKENS}, lambda x: {q.lemma('x')}), ' ')"})
scalar("preprocess", {"processed": lambda t: joined(tx.preprocessed(t))}, {"processed": f"array_to_string({q.PRE}, ' ')"})
scalar("strip_urls", {"stripped": tx.without_urls}, {"stripped": r"regexp_replace(text, 'http[^ \t\n\r\f\x0b]+|www[^ \t\n\r\f\x0b]+', '', 'g')"})
scalar("strip_emails", {"stripped": tx.without_emails}, {"stripped": r"regexp_replace(text, '[^ \t\n\r\f\x0b]+@[^ \t\n\r\f\x0b]+', '', 'g')"})
scalar("expand_contractions", {"expanded": tx.expanded}, {"expanded": q.expanded("text")})
scalar("range_preprocess", {"processed": lambda t: joined(tx.range_tokens(t))}, {"processed": f"array_to_string({q.RANGE_TOKENS}, ' ')"})
scalar("count_words", {"n_words": lambda t: F.size(tx.words(t)).cast("long")}, {"n_words": f"len({q.WORDS})::BIGINT"})
scalar("truncate_words", {"short": lambda t: joined(F.slice(tx.words(t), 1, 200))}, {"short": f"array_to_string(({q.WORDS})[1:200], ' ')"})
scalar(
    "word_limit_band",
    {"band": lambda t: F.when(F.size(tx.words(t)) > 200, "red").when(F.size(tx.words(t)) > 180, "orange").otherwise("default")},
    {"band": f"CASE WHEN len({q.WORDS}) > 200 THEN 'red' WHEN len({q.WORDS}) > 180 THEN 'orange' ELSE 'default' END"},
)
scalar("sentence_count", {"n": ft.sentences}, {"n": q.SENTENCES})
@query(
    "ngrams",
    f"WITH {q.D}, tok AS (SELECT doc_id, {q.PRE} AS w FROM d) SELECT doc_id, len(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])))::BIGINT AS n_bigrams, "
    "CASE WHEN len(w) >= 3 THEN w[1] || ' ' || w[2] || ' ' || w[3] END AS first_trigram FROM tok",
)
def _(spark, d):
    # a generator between the tokens and their uses, so that they are computed once a row
    w = docs(spark, d).select("doc_id", F.explode(F.array(tx.preprocessed(F.col("text")))).alias("w"))
    return w.select("doc_id", F.size(F.array_distinct(mo.grams(F.col("w"), 2))).cast("long").alias("n_bigrams"), F.get(mo.grams(F.slice(F.col("w"), 1, 3), 3), F.lit(0)).alias("first_trigram"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SENTENCES = rf"""{q.D}, cw AS (SELECT doc_id, list_transform({q.WORDS}, lambda x: regexp_replace(regexp_replace(x, {_quoted(se.CLOSING)}, ''), {_quoted(se.OPENING)}, '')) AS c FROM d),
tk AS (SELECT doc_id, i, c[i + 1] AS core, lower(regexp_replace(c[i + 1], '{se.STOPS}', '')) AS base, c[i + 2] AS following FROM (SELECT doc_id, c, unnest(range(len(c))) AS i FROM cw)),
ea AS (SELECT base AS word, count(*)::BIGINT AS n, count_if(regexp_matches(core, '[^.!?…]\.$'))::BIGINT AS k FROM tk WHERE base <> '' GROUP BY base), tt AS (SELECT sum(k)::DOUBLE / sum(n) AS p FROM ea),
ls AS (SELECT word, n, k, p, length(replace(word, '.', ''))::DOUBLE AS s, length(word) - length(replace(word, '.', '')) AS t FROM ea, tt WHERE regexp_matches(word, '\p{{L}}') AND k > 0 AND p > 0 AND p < 1),
ab AS (SELECT word, n, k, 2 * (k * ln({se.SURE}::DOUBLE) + (n - k) * ln({1 - se.SURE!r}::DOUBLE) - k * ln(p) - (n - k) * ln(1 - p)) * exp(-s) * (t + 1) * pow(s, -(n - k)) AS score FROM ls)"""


@query("sentence_abbreviations", f"WITH {_SENTENCES} SELECT word, n, k, round(score, 6) AS score FROM ab WHERE score >= {se.LEAST}")
def _(spark, d):
    return se.abbreviations(se.tokens(docs(spark, d))).select("word", "n", "k", r(F.col("score")).alias("score"))


@query(
    "sentence_boundaries",
    rf"WITH {_SENTENCES}, en AS (SELECT doc_id, i FROM tk LEFT JOIN (SELECT word FROM ab WHERE score >= {se.LEAST}) a ON base = word WHERE following IS NULL OR regexp_matches(core, '[!?…]$') OR (regexp_matches(core, '{se.STOPS}') "
    r"AND NOT (word IS NOT NULL OR regexp_matches(base, '^\p{L}$') OR coalesce(regexp_matches(following, '^\p{Ll}'), false)))) SELECT doc_id, count(*)::BIGINT AS n_sentences, array_to_string(list_sort(list(i)), ',') AS ends FROM en GROUP BY doc_id",
)
def _(spark, d):
    ends = se.boundaries(docs(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sort_array(F.collect_list("i")).alias("ends"))
    return ends.select("doc_id", "n_sentences", F.array_join("ends", ",").alias("ends"))


@query("strip_html", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS stripped FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", tx.without_tags(F.col("html")).alias("stripped"))


@query("syllables", f"WITH {q.D}, a AS (SELECT DISTINCT unnest({q.ALNUM}) AS x FROM d) SELECT x AS word, ({q.SYLLABLES})::BIGINT AS syllables FROM a")
def _(spark, d):
    words = docs(spark, d).select(F.explode(tx.extract(F.lower("text"), r"[\p{L}\p{N}]+")).alias("word")).distinct()
    return words.select("word", tx.syllables(F.col("word")).cast("long").alias("syllables"))


@query(
    "wordnet_pos",
    f"WITH {q.D}, a AS (SELECT DISTINCT unnest({q.TOKENS}) AS x FROM d), g AS (SELECT x, {lx.sql_tag('x')} AS tag FROM a) "
    "SELECT x AS token, tag, CASE tag[1:1] WHEN 'J' THEN 'a' WHEN 'V' THEN 'v' WHEN 'R' THEN 'r' ELSE 'n' END AS pos FROM g",
)
def _(spark, d):
    words = docs(spark, d).select(F.explode(tx.tokens(tx.clean(F.col("text")))).alias("token")).distinct()
    return words.withColumn("tag", tx.suffix_tag(F.col("token"))).select("token", "tag", tx.wordnet_class(F.col("tag")).alias("pos"))


def _lemma_rounds() -> str:
    """SQL: (x, pos, round, to, at) of all candidates of the words of ``g``."""
    rules = lambda word, r: ", ".join(f"CASE WHEN {r}.pos = '{c}' AND {word} LIKE '%{end}' AND length({word}) > {len(end) - len(new[:1])} THEN {word}[1:-{len(end) + 1}] || '{new}' END" for c, end, new in le.RULES)
    one = f"o1 AS (SELECT x, pos, list_filter([{rules('x', 'g')}], lambda y: y IS NOT NULL) AS c FROM g)"
    each = "e1 AS (SELECT x, pos, unnest(c) AS y, unnest(range(len(c))) AS i FROM o1)"
    two = f"e2 AS (SELECT x, pos, i, list_filter([{rules('y', 'e1')}], lambda z: z IS NOT NULL) AS c FROM e1)"
    tries = "tr AS (SELECT x, pos, 1 AS round, x AS y, 0 AS i, 0 AS j FROM g UNION ALL SELECT x, pos, 1, y, i + 1, 0 FROM e1 UNION ALL SELECT x, pos, 2, unnest(c), i, unnest(range(len(c))) FROM e2)"
    return f"{one}, {each}, {two}, {tries}"


@query(
    "lemma_rules",
    f"WITH {q.D}, a AS (SELECT unnest({q.TOKENS}) AS x FROM d), n AS (SELECT x, count(*) AS n FROM a GROUP BY x), t AS (SELECT x, {lx.sql_tag('x')} AS tag FROM n), "
    "g AS (SELECT x, CASE tag[1:1] WHEN 'J' THEN 'a' WHEN 'V' THEN 'v' WHEN 'R' THEN 'r' ELSE 'n' END AS pos FROM t), "
    + _lemma_rounds()
    + ", kn AS (SELECT x FROM n WHERE n >= 3), ht AS (SELECT tr.x, pos, y, row_number() OVER (PARTITION BY tr.x, pos ORDER BY round, length(y), i, j) AS k FROM tr JOIN kn ON y = kn.x) "
    "SELECT g.x AS token, g.pos, coalesce(y, g.x) AS lemma FROM g LEFT JOIN ht ON g.x = ht.x AND g.pos = ht.pos AND k = 1",
)
def _(spark, d):
    """Of every distinct token, by the rules of its class; a word is what the documents have three times or more."""
    n = docs(spark, d).select(F.explode(tx.tokens(tx.clean(F.col("text")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    n = cl.staged(n)
    words = n.select("word", tx.wordnet_class(tx.suffix_tag(F.col("word"))).alias("class"))
    known = n.where("n >= 3").select("word", F.explode(F.array(*map(F.lit, "navr"))).alias("class"))
    return le.lemmas(words, known).select(F.col("word").alias("token"), F.col("class").alias("pos"), "lemma")


@query("stopword_anti_join", f"WITH {q.D}, a AS (SELECT unnest({q.TOKENS}) AS x FROM d) SELECT x AS token, count(*)::BIGINT AS n FROM a WHERE x NOT IN {q.STOP} GROUP BY x")
def _(spark, d):
    stop = spark.createDataFrame([(w,) for w in dict.fromkeys(lx.STOPWORDS)], "stop string")
    words = docs(spark, d).select(F.explode(tx.tokens(tx.clean(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return words.join(F.broadcast(stop), words.token == stop.stop, "left_anti")


# --- features
def one(name, feature, ranges=False, out=None):
    from_features(name, lambda: {out or feature: r(F.col(feature))}, {out or feature: f"round({feature}, 6) + 0"}, ranges)




def _late():
    """Entries that build on definitions further down."""
    for name, feature in (("lexical_diversity", "lexical_diversity"), ("avg_word_length", "avg_word_length"), ("word_entropy", "word_entropy"), ("repetition_ratio", "repetition_ratio"), ("capital_ratio", "capital_ratio"), ("punctuation_density", "punctuation_density")):
        one(name, feature)
    from_features("review_length", lambda: {"review_length": F.col("review_length")}, {"review_length": "review_length"})
    from_features("sentiment", lambda: {c: r(F.col(c)) for c in lx.FEATURES[3:5]}, {c: f"round({c}, 6)" for c in lx.FEATURES[3:5]})
    from_features("punct_counts", lambda: {c: F.col(c) for c in lx.FEATURES[7:9]}, {c: c for c in lx.FEATURES[7:9]})
    ints = ("review_length", "exclamation_count", "question_count")
    cols = lambda names: lambda: {c: F.col(c) if c in ints else r(F.col(c)) for c in names}
    sqls = lambda names: {c: c if c in ints else f"round({c}, 6) + 0" for c in names}
    from_features("model_features", cols(lx.FEATURES), sqls(lx.FEATURES))
    from_features("range_features", cols(lx.RANGE_FEATURES), sqls(lx.RANGE_FEATURES), True)
    one("reading_ease", "language_complexity", True)
    one("capital_usage", "capital_usage", True)
    one("range_punct_density", "punctuation_density", True)
    vector = lambda: F.array_join(F.transform(F.array(*[F.col(c).cast("double") for c in lx.FEATURES]), lambda x: F.format_string("%.4f", rounded(x, 4))), ",")
    from_features("feature_vector", lambda: {"vector": vector()}, {"vector": "array_to_string(list_transform([" + ", ".join(f"{c}::DOUBLE" for c in lx.FEATURES) + "], lambda x: printf('%.4f', round(x, 4) + 0)), ',')"})
    shown = lambda c: F.when((F.col(c) < 1) & (F.col(c) != 0), F.format_string("%.4f", rounded(c, 4))).otherwise(F.format_string("%.2f", rounded(c, 2)))
    from_features("format_feature", lambda: {"shown": shown("lexical_diversity")}, {"shown": "CASE WHEN lexical_diversity < 1 AND lexical_diversity <> 0 THEN printf('%.4f', round(lexical_diversity, 4)) ELSE printf('%.2f', round(lexical_diversity, 2)) END"})
    warn = "(review_length < 5)::INT + (word_entropy < 2.0)::INT + (exclamation_count >= 3)::INT + (capital_ratio > 0.5)::INT + (question_count >= 3)::INT + (repetition_ratio > 0.3)::INT"
    from_features("warning_count", lambda: {"warning_count": ft.warnings().cast("long")}, {"warning_count": f"({warn})::BIGINT"})
    global WARN
    WARN = warn
    _predicates()
    _validation()
    _explanation()


WARN = ""


@query("range_feature_table", f"WITH {q.RANGES} SELECT r.doc_id + 1 AS review_id, r.text AS original_review, r.review_length, round(language_complexity, 6) AS language_complexity, l.quality AS label FROM rfeat r LEFT JOIN labels l ON r.doc_id = l.doc_id")
def _(spark, d):
    f = ft.range_features(docs(spark, d), keep=("doc_id", "text"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("k"), "quality")
    df = f.join(labels, f.doc_id == labels.k, "left")
    return df.select((F.col("doc_id") + 1).alias("review_id"), F.col("text").alias("original_review"), "review_length", r(F.col("language_complexity")).alias("language_complexity"), F.col("quality").alias("label"))


# --- predicates
def _predicates():
    scalar("detect_tagalog", {"tagalog": pr.tagalog}, {"tagalog": q.tagalog()})
    scalar("detect_tagalog_ui", {"tagalog": pr.tagalog_by_share}, {"tagalog": q.TAGALOG_SHARE})
    scalar("detect_gibberish", {"gibberish": pr.gibberish}, {"gibberish": q.gibberish(False)}, q.GIB, "gf")
    scalar("detect_gibberish_ui", {"gibberish": lambda t: pr.gibberish(t, True)}, {"gibberish": q.gibberish(True)}, q.GIB, "gf")
    bad = f"CASE WHEN {q.BLANK_TEXT} THEN 'Review text is empty' WHEN {q.tagalog()} THEN '{pr.INVALID}' END"
    scalar("validate_input", {"is_valid": lambda t: pr.validated(t)[0], "error_message": lambda t: pr.validated(t)[1]}, {"is_valid": f"({bad}) IS NULL", "error_message": bad})
    bad = f"CASE WHEN {q.BLANK_TEXT} THEN 'Please enter a review' WHEN len({q.WORDS}) > 200 THEN 'More than 200 words' WHEN {q.TAGALOG_SHARE} THEN '{pr.INVALID}' END"
    scalar("validate_input_ui", {"is_valid": lambda t: pr.validated_ui(t)[0], "error_message": lambda t: pr.validated_ui(t)[1]}, {"is_valid": f"({bad}) IS NULL", "error_message": bad})
    rules = f"""WITH {q.FEATURES}, gq AS (SELECT doc_id, {q.LOWER_WORDS} AS q FROM d), {q.entropy_cte('gq', 'gent', '0', 'q')},
g AS (SELECT gq.doc_id, {q.gibberish(False)} AS gib FROM (SELECT gq.doc_id, q, coalesce(q[1], '') AS f, h FROM gq LEFT JOIN gent ON gq.doc_id = gent.doc_id) gq)
SELECT feat.doc_id, ({WARN})::BIGINT AS warning_count, gib AS gibberish, gib OR (review_length <= 2 AND word_entropy < 1.0) OR
  coalesce(review_length = 1 AND length(w[1]) BETWEEN 4 AND 8 AND lower(w[1]) NOT IN {lx.sql_list(lx.COMMON_WORDS)}, false) OR {WARN} >= 3 AS forced FROM feat JOIN g ON feat.doc_id = g.doc_id"""
    CATALOG["predict_rules"] = (rule_verdicts, rules)


def rule_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What rules alone say of each document; features, gibberish and first token in one pass, without a shuffle."""
    base = docs(spark, d).withColumn("gibberish", pr.gibberish(F.col("text")))
    f = ft.rule_features(base, keep=("doc_id", "gibberish"))
    return f.select("doc_id", ft.warnings().cast("long").alias("warning_count"), "gibberish", ft.forced(F.col("gibberish"), F.col("first")).alias("forced"))


# --- labels, sets, samples
LABEL = "CASE quality WHEN 0 THEN 'CG' WHEN 1 THEN 'OR' END"


def labelled(spark, d) -> DataFrame:
    raw = F.when(F.col("quality") == 0, "CG").when(F.col("quality") == 1, "OR")
    return table(spark, d, "labels").select("doc_id", raw.alias("label"))


@query("map_labels", f"SELECT doc_id, CASE {LABEL} WHEN 'CG' THEN 'Anomalous' WHEN 'OR' THEN 'Normal' END AS true_label FROM labels")
def _(spark, d):
    return labelled(spark, d).select("doc_id", F.when(F.col("label") == "CG", "Anomalous").when(F.col("label") == "OR", "Normal").alias("true_label"))


@query("binary_label", f"SELECT doc_id, (lower({LABEL}) IN ('anomalous', 'fraudulent', 'fake', '1'))::INT AS actual_binary, (lower(quality::VARCHAR) IN ('anomalous', 'fraudulent', 'fake', '1'))::INT AS from_number FROM labels")
def _(spark, d):
    yes = ("anomalous", "fraudulent", "fake", "1")
    df = labelled(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return df.select("doc_id", F.lower("label").isin(*yes).cast("int").alias("actual_binary"), F.col("quality").cast("string").isin(*yes).cast("int").alias("from_number"))


@query("label_counts", f"SELECT {LABEL} AS label, count(*)::BIGINT AS n FROM labels GROUP BY 1")
def _(spark, d):
    return labelled(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("select_genuine", f"SELECT doc_id FROM labels WHERE {LABEL} IN {lx.sql_list(lx.GENUINE)}")
def _(spark, d):
    return labelled(spark, d).where(F.col("label").isin(*lx.GENUINE)).select("doc_id")


def bucket(key: str) -> Column:
    return F.pmod(F.conv(F.substr(F.md5(F.col(key).cast("string")), F.lit(1), F.lit(8)), 16, 10).cast("long"), F.lit(10))


@query("stratified_split", f"SELECT doc_id, {LABEL} AS label, CASE WHEN ('0x' || md5(doc_id::VARCHAR)[1:8])::BIGINT % 10 < 7 THEN 'train' ELSE 'test' END AS part FROM labels")
def _(spark, d):
    return labelled(spark, d).select("doc_id", "label", F.when(bucket("doc_id") < 7, "train").otherwise("test").alias("part"))


def sampled(df: DataFrame, n: int) -> DataFrame:
    """n rows by the hash of their key: the least n of each task, then of all."""
    return df.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(n)


def _sample_sql(label: str, n: int) -> str:
    return f"(SELECT doc_id FROM labels WHERE {LABEL} = '{label}' ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {n})"


@query("validation_sample", _sample_sql("OR", 100))
def _(spark, d):
    return sampled(labelled(spark, d).where("label = 'OR'"), 100).select("doc_id")


@query("baseline_dataset", f"SELECT l.doc_id, text AS review, 'Genuine' AS label FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE {LABEL} IN {lx.sql_list(lx.GENUINE)}")
def _(spark, d):
    own = labelled(spark, d).where(F.col("label").isin(*lx.GENUINE)).select("doc_id")
    return table(spark, d, "documents").join(own, "doc_id").select("doc_id", F.col("text").alias("review"), F.lit("Genuine").alias("label"))


def _validation_set(spark, d):
    own = labelled(spark, d)
    part = lambda code, n, name: sampled(own.where(F.col("label") == code), n).select("doc_id", F.lit(name).alias("label"))
    return part("OR", 700, "Genuine").unionByName(part("CG", 300, "Fraudulent"))


_VALIDATION = f"SELECT doc_id, 'Genuine' AS label FROM {_sample_sql('OR', 700)} UNION ALL SELECT doc_id, 'Fraudulent' AS label FROM {_sample_sql('CG', 300)}"
CATALOG["validation_union"] = (_validation_set, _VALIDATION)


@query("validation_dataset", f"SELECT v.doc_id, text AS review, label FROM ({_VALIDATION}) v JOIN documents d ON v.doc_id = d.doc_id")
def _(spark, d):
    return table(spark, d, "documents").join(_validation_set(spark, d), "doc_id").select("doc_id", F.col("text").alias("review"), "label")


@query("distinct_clusters", "SELECT DISTINCT label AS cluster FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").alias("cluster")).distinct()


# --- statistics and ranges
STATS = ("mean", "std", "min", "max", "p5", "p25", "p50", "p75", "p95")
PROBABILITIES = (0.05, 0.25, 0.5, 0.75, 0.95)


def long_features(df: DataFrame, names=lx.RANGE_FEATURES) -> DataFrame:
    return df.unpivot(["doc_id"], [F.col(c).cast("double").alias(c) for c in names], "feature", "value")


def statistics(rows: DataFrame, names=lx.RANGE_FEATURES, quantiles: bool = True) -> DataFrame:
    """A row for each feature. Rows are read several times and should be a table; where no quantile is wanted, once."""
    found = qu.summaries(rows, names, PROBABILITIES if quantiles else ())
    own = [(c, *[None if x[k] is None else float(x[k]) for k in STATS[:4]], *(x["q"] or [None] * 5)) for c, x in found.items()]
    return rows.sparkSession.createDataFrame(own, "feature string, " + ", ".join(f"{c} double" for c in STATS))


def long_sql(names=lx.RANGE_FEATURES, source="rfeat") -> str:
    return "fl AS (" + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS feature, {c}::DOUBLE AS value FROM {source}" for c in names) + ")"


STATS_SQL = "st AS (SELECT feature, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, " + ", ".join(f"quantile_cont(value, {p}) AS p{k}" for p, k in ((0.05, 5), (0.25, 25), (0.5, 50), (0.75, 75), (0.95, 95))) + " FROM fl GROUP BY feature)"
_RF = f"WITH {q.RANGES}, {long_sql()}, {STATS_SQL}"
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in STATS)


def range_stats(spark, d, quantiles: bool = True) -> DataFrame:
    return statistics(range_rows(spark, d), quantiles=quantiles)


@query("feature_statistics", f"{_RF} SELECT feature, {_ROUNDED} FROM st")
def _(spark, d):
    return range_stats(spark, d).select("feature", *[r(F.col(c)).alias(c) for c in STATS])


@query("feature_describe", f"WITH {q.FEATURES}, {long_sql(lx.FEATURES, 'feat')}, {STATS_SQL} SELECT feature, {", ".join(f"round({c}, 6) + 0 AS {c}" for c in STATS)} FROM st")
def _(spark, d):
    return statistics(cl.staged(ft.model_features(docs(spark, d))), lx.FEATURES).select("feature", *[(r(F.col(c)) + F.lit(0.0)).alias(c) for c in STATS])


def ranges_of(st: DataFrame, method: str = "std", k: float = 1.5) -> DataFrame:
    """method std: mean and k deviations either way; any other: the 5th to the 95th percentile."""
    low, high = (F.col("mean") - k * F.col("std"), F.col("mean") + k * F.col("std")) if method == "std" else (F.col("p5"), F.col("p95"))
    return st.withColumns({"normal_min": low, "normal_max": high})


_RANGES_SQL = "rg AS (SELECT *, mean - 1.5 * std AS normal_min, mean + 1.5 * std AS normal_max FROM st)"


@query("normal_ranges_std", f"{_RF}, {_RANGES_SQL} SELECT feature, round(normal_min, 6) AS normal_min, round(normal_max, 6) AS normal_max FROM rg")
def _(spark, d):
    return ranges_of(range_stats(spark, d)).select("feature", r(F.col("normal_min")).alias("normal_min"), r(F.col("normal_max")).alias("normal_max"))


@query("normal_ranges_pct", f"{_RF} SELECT feature, round(p5, 6) AS normal_min, round(p95, 6) AS normal_max FROM st")
def _(spark, d):
    return ranges_of(range_stats(spark, d), "percentile").select("feature", r(F.col("normal_min")).alias("normal_min"), r(F.col("normal_max")).alias("normal_max"))


@query("range_widths", f"{_RF}, {_RANGES_SQL} SELECT feature, round(normal_max - normal_min, 6) AS normal_width, round(max - min, 6) AS actual_width FROM rg")
def _(spark, d):
    df = ranges_of(range_stats(spark, d, quantiles=False))
    return df.select("feature", r(F.col("normal_max") - F.col("normal_min")).alias("normal_width"), r(F.col("max") - F.col("min")).alias("actual_width"))


@query("box_summary", f"{_RF} SELECT feature, round(min, 6) AS min, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75, round(max, 6) AS max FROM st")
def _(spark, d):
    return range_stats(spark, d).select("feature", *[r(F.col(c)).alias(c) for c in ("min", "p25", "p50", "p75", "max")])


_SUMMARY = ("mean", "std", "normal_min", "normal_max", "min", "max", "p5", "p25", "p50", "p75", "p95")


@query("range_summary", f"{_RF}, {_RANGES_SQL} SELECT feature, " + ", ".join(f"round({c}, 4) AS {c}" for c in _SUMMARY) + " FROM rg")
def _(spark, d):
    return ranges_of(range_stats(spark, d)).select("feature", *[F.round(c, 4).alias(c) for c in _SUMMARY])


# --- range validation: ranges have eleven rows, whatever the input, and go to all rows as one
def checked(rows: DataFrame) -> DataFrame:
    """The rows with ``checks``: feature, value, range and status of each of the eleven features; no shuffle of the rows."""
    own = statistics(rows, quantiles=False)
    low, high = F.round("normal_min", 6), F.round("normal_max", 6)
    table = ranges_of(own).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct(low.alias("low"), high.alias("high"))))).alias("_ranges"))

    def check(c):
        v, to = r(F.col(c).cast("double")), F.element_at("_ranges", F.lit(c))
        status = F.when(v.between(to["low"], to["high"]), "PASS").otherwise("WARNING")
        return F.struct(F.lit(c).alias("feature"), v.alias("value"), to["low"].alias("normal_min"), to["high"].alias("normal_max"), status.alias("status"))

    return rows.join(F.broadcast(table)).select("doc_id", F.array(*[check(c) for c in lx.RANGE_FEATURES]).alias("checks"))


def range_rows(spark, d) -> DataFrame:
    """The features are computed once, for the ranges and for the checks."""
    return cl.staged(ft.range_features(docs(spark, d)))


def checked_long(spark, d) -> DataFrame:
    return checked(range_rows(spark, d)).select("doc_id", F.explode("checks").alias("c")).select("doc_id", "c.*")


_CHECKED = f"""{_RF}, {_RANGES_SQL}, ck AS (SELECT doc_id, fl.feature, round(value, 6) AS value, round(normal_min, 6) AS normal_min, round(normal_max, 6) AS normal_max,
  CASE WHEN round(value, 6) BETWEEN round(normal_min, 6) AND round(normal_max, 6) THEN 'PASS' ELSE 'WARNING' END AS status FROM fl JOIN rg ON fl.feature = rg.feature),
vd AS (SELECT doc_id, count_if(status = 'WARNING')::BIGINT AS warning_count, count_if(status = 'WARNING')::DOUBLE / count(*) AS score,
  array_to_string(list_sort(list(feature) FILTER (status = 'WARNING')), ',') AS warnings FROM ck GROUP BY doc_id)"""


def _validation():
    CATALOG["range_validation_long"] = (checked_long, f"{_CHECKED} SELECT * FROM ck")

    def only(spark, d):
        return checked_long(spark, d).select("doc_id", "feature", (F.col("status") == "PASS").alias("in_range"))

    CATALOG["range_check"] = (only, f"{_CHECKED} SELECT doc_id, feature, status = 'PASS' AS in_range FROM ck")
    CATALOG["range_validation"] = (validation, f"{_CHECKED} SELECT doc_id, warning_count, round(score, 6) AS suspiciousness_score, score > 0.5 AS predicted_suspicious, coalesce(warnings, '') AS warnings FROM vd")
    metrics = f"""{_CHECKED}, tr AS (SELECT score > 0.5 AS p, quality = 0 AS a FROM vd JOIN labels ON vd.doc_id = labels.doc_id),
cm AS (SELECT count_if(p AND a)::BIGINT AS tp, count_if(p AND NOT a)::BIGINT AS fp, count_if(NOT p AND a)::BIGINT AS fn, count_if(NOT p AND NOT a)::BIGINT AS tn FROM tr), {METRICS_SQL} SELECT {METRICS_OUT} FROM m"""
    CATALOG["range_metrics"] = (range_metrics, metrics)


def validation(spark, d) -> DataFrame:
    df = checked(range_rows(spark, d)).withColumn("found", F.explode(F.array(F.transform(F.filter("checks", lambda c: c["status"] == "WARNING"), lambda c: c["feature"]))))
    n = F.size("found").cast("long")
    score = n / F.lit(float(len(lx.RANGE_FEATURES)))
    return df.select("doc_id", n.alias("warning_count"), r(score).alias("suspiciousness_score"), (score > 0.5).alias("predicted_suspicious"), F.array_join(F.array_sort("found"), ",").alias("warnings"))


METRICS_SQL = """m AS (SELECT *, coalesce((tp + tn)::DOUBLE / nullif(tp + tn + fp + fn, 0), 0) AS accuracy, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
  coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS specificity, coalesce(fp::DOUBLE / nullif(tn + fp, 0), 0) AS false_alarm_rate, coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1_score FROM cm)"""
_METRICS = ("accuracy", "precision", "recall", "specificity", "false_alarm_rate", "f1_score")
METRICS_OUT = "tp, fp, fn, tn, " + ", ".join(f"round({c}, 6) AS {c}" for c in _METRICS)


def metrics_out(df: DataFrame) -> DataFrame:
    return df.select("tp", "fp", "fn", "tn", *[r(F.col(c)).alias(c) for c in _METRICS])


def range_metrics(spark, d) -> DataFrame:
    own = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 0, "Anomalous").otherwise("Normal").alias("true_label"))
    df = validation(spark, d).join(own, "doc_id")
    return metrics_out(so.with_metrics(so.confusion(df, F.when(F.col("predicted_suspicious"), "Anomalous").otherwise("Normal"), F.col("true_label"))))


# --- explanation
PROFILE_SQL = "pf AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', {a}::DOUBLE, {b}::DOUBLE, {o}::DOUBLE)" for f, a, b, o in lx.PROFILE) + ") t(feature, low, high, optimal))"


def profile(spark) -> DataFrame:
    return spark.createDataFrame([tuple(x) for x in lx.PROFILE], "feature string, low double, high double, optimal double")


def contributions(spark, d) -> DataFrame:
    """How far each feature is from its profile, in per cent. Below a negative least value the deviation is taken against
    its absolute value, so that it counts as large; a bound of 0 counts as 1."""
    f = long_features(ft.model_features(docs(spark, d)), lx.FEATURES).withColumn("value", r(F.col("value")))
    v, low, high = F.col("value"), F.col("low"), F.col("high")
    size = lambda c: F.when(c == 0, 1.0).otherwise(F.abs(c))
    far = F.when(v < low, (low - v) / size(low) * 100).when(v > high, (v - high) / size(high) * 100).otherwise(F.abs(v - F.col("optimal")) / (high - low) * 50)
    return f.join(F.broadcast(profile(spark)), "feature").select("doc_id", "feature", "value", r(far).alias("deviation"), v.between(low, high).alias("in_range"))


_CONTRIB = f"""WITH {q.FEATURES}, {long_sql(lx.FEATURES, 'feat')}, {PROFILE_SQL}, vl AS (SELECT doc_id, feature, round(value, 6) + 0 AS value FROM fl),
ct AS (SELECT doc_id, vl.feature, value, round(CASE WHEN value < low THEN (low - value) / CASE WHEN low = 0 THEN 1 ELSE abs(low) END * 100 WHEN value > high THEN (value - high) / CASE WHEN high = 0 THEN 1 ELSE abs(high) END * 100
  ELSE abs(value - optimal) / (high - low) * 50 END, 6) AS deviation, value BETWEEN low AND high AS in_range FROM vl JOIN pf ON vl.feature = pf.feature)"""
# feature, test, severity, whether it is a reason or a warning
REASONS = (
    ("Review Length", "review_length < 10", "high", "reason"),
    ("Lexical Diversity", "lexical_diversity < 0.5", "high", "reason"),
    ("Word Entropy", "word_entropy < 2.0", "medium", "reason"),
    ("Repetition", "repetition_ratio > 0.25", "high", "reason"),
    ("Sentiment", "abs(sentiment_polarity) > 0.85", "medium", "reason"),
    ("Punctuation", "exclamation_count > 2", "medium", "reason"),
    ("Capitalization", "capital_ratio > 0.15", "medium", "reason"),
    ("Long Review", "review_length > 200", "low", "warning"),
    ("Word Length", "avg_word_length < 2.5", "low", "warning"),
    ("Subjectivity", "sentiment_subjectivity > 0.9", "low", "warning"),
)


def _explanation():
    CATALOG["feature_contributions"] = (contributions, f"{_CONTRIB} SELECT * FROM ct")

    def top(spark, d):
        w = W.partitionBy("doc_id").orderBy(F.desc("deviation"), "feature")
        return contributions(spark, d).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("doc_id", "place", "feature", "deviation")

    CATALOG["top_contributions"] = (top, f"{_CONTRIB} SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY deviation DESC, feature)::BIGINT AS place, feature, deviation FROM ct) WHERE place <= 5")

    def reasons(spark, d):
        f = ft.model_features(docs(spark, d))
        found = F.filter(F.array(*[F.when(F.expr(test), F.struct(F.lit(name).alias("feature"), F.lit(sev).alias("severity"), F.lit(kind).alias("kind"))) for name, test, sev, kind in REASONS]), lambda x: x.isNotNull())
        return f.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")

    CATALOG["explain_reasons"] = (reasons, f"WITH {q.FEATURES} " + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS feature, '{s}' AS severity, '{k}' AS kind FROM feat WHERE {t}" for n, t, s, k in REASONS))


@query(
    "feature_basis_merge",
    f"WITH {q.FEATURES}, {long_sql(lx.FEATURES, 'feat')}, nb AS (SELECT feature, round(avg(value), 6) + 0 AS m, round(avg(value) - 1.5 * stddev_samp(value), 6) + 0 AS lo, round(avg(value) + 1.5 * stddev_samp(value), 6) + 0 AS hi FROM fl GROUP BY feature), {PROFILE_SQL} "
    "SELECT pf.feature, coalesce(lo, low) AS low, coalesce(hi, high) AS high, coalesce(m, optimal) AS optimal FROM pf LEFT JOIN nb ON pf.feature = nb.feature AND lo >= 0",
)
def _(spark, d):
    """The profile with the ranges that the documents' own statistics give, where these are not negative, written as a basis and read back."""
    st = ranges_of(statistics(cl.staged(ft.model_features(docs(spark, d))), lx.FEATURES, False))
    low, high, mean = (r(F.col(c)) + F.lit(0.0) for c in ("normal_min", "normal_max", "mean"))
    one = F.struct("feature", F.struct(low.alias("min"), high.alias("max"), mean.alias("optimal")))
    path = fresh(spark, "basis")
    st.where(low >= 0).agg(F.to_json(F.map_from_entries(F.collect_list(one))).alias("value")).coalesce(1).write.text(path)  # eleven entries at most
    return io.read_basis(spark, path, profile(spark)).select("feature", "low", "high", "optimal")


# --- vectors, clusters, distances
def emb(spark, d) -> DataFrame:
    return table(spark, d, "embeddings")


@query("l2_normalize", f"WITH {q.VEC} SELECT vec_id, round(list_sum(list_transform(z, lambda x: x * x)), 6) AS length, round(z[1], 6) AS first, round(z[64], 6) AS last FROM z")
def _(spark, d):
    z = so.normalised(emb(spark, d))
    return z.select("vec_id", r(so.dot(F.col("z"), F.col("z"))).alias("length"), r(F.get("z", F.lit(0))).alias("first"), r(F.get("z", F.lit(63))).alias("last"))


@query("centroids", f"WITH {q.CENTROIDS} SELECT cluster, round(c[1], 6) AS c1, round(c[32], 6) AS c32, round(list_sum(list_transform(c, lambda x: x * x)), 6) AS length FROM cent")
def _(spark, d):
    c = so.centroids(so.normalised(emb(spark, d)))
    return c.select("cluster", r(F.get("c", F.lit(0))).alias("c1"), r(F.get("c", F.lit(31))).alias("c32"), r(so.dot(F.col("c"), F.col("c"))).alias("length"))


@query("assigned_distance", f"WITH {q.CENTROIDS} SELECT vec_id, round(1 - {q.DOT}, 6) AS distance FROM z JOIN cent ON label = cluster")
def _(spark, d):
    z = so.normalised(emb(spark, d))
    c = so.centroids(z)
    return z.join(F.broadcast(c), z.label == c.cluster).select("vec_id", r(F.lit(1.0) - so.dot(F.col("z"), F.col("c"))).alias("distance"))


@query("nearest_centroid", f"WITH {q.SCORED} SELECT vec_id, cluster, distance FROM sc")
def _(spark, d):
    return so.scored(emb(spark, d)).select("vec_id", "cluster", "distance")


@query("dbscan_distance", f"WITH {q.CENTROIDS}, a AS (SELECT vec_id, label, cluster, 1 - {q.DOT} AS d FROM z CROSS JOIN cent WHERE cluster < 7) SELECT vec_id, round(CASE WHEN label < 7 THEN min(d) FILTER (cluster = label) ELSE min(d) END, 6) AS distance FROM a GROUP BY vec_id, label")
def _(spark, d):
    z = so.normalised(emb(spark, d))  # labels of 7 and more stand for noise
    c = so.centroids(z).where("cluster < 7")
    near = so.nearest(z, c)
    own = near.drop("cluster").join(F.broadcast(c), F.col("label") == F.col("cluster"), "left")
    return own.select("vec_id", r(F.when(F.col("label") < 7, F.lit(1.0) - so.dot(F.col("z"), F.col("c"))).otherwise(F.col("distance"))).alias("distance"))


@query("centroid_sse", f"WITH {q.SCORED} SELECT round(sum(distance), 3) AS sse FROM sc")
def _(spark, d):
    return so.scored(emb(spark, d)).agg(F.round(F.sum("distance"), 3).alias("sse"))


@query("distance_stats", f"WITH {q.SCORED} SELECT round(avg(distance), 6) AS mean, round(stddev_pop(distance), 6) AS std, min(distance) AS min, max(distance) AS max FROM sc")
def _(spark, d):
    return so.scored(emb(spark, d)).agg(r(F.avg("distance")).alias("mean"), r(F.stddev_pop("distance")).alias("std"), F.min("distance").alias("min"), F.max("distance").alias("max"))


@query("separation_ratio", f"WITH {q.SCORED}, s AS (SELECT avg(distance) FILTER (true_label = 'Normal') AS a, avg(distance) FILTER (true_label = 'Anomalous') AS b FROM sc) SELECT round(a, 6) AS normal_mean, round(b, 6) AS anomalous_mean, round(CASE WHEN a = 0 THEN 'Infinity'::DOUBLE ELSE b / a END, 6) AS ratio FROM s")
def _(spark, d):
    s = so.scored(emb(spark, d)).agg(F.avg(F.when(F.col("true_label") == "Normal", F.col("distance"))).alias("a"), F.avg(F.when(F.col("true_label") == "Anomalous", F.col("distance"))).alias("b"))
    return s.select(r(F.col("a")).alias("normal_mean"), r(F.col("b")).alias("anomalous_mean"), r(F.when(F.col("a") == 0, F.lit(float("inf"))).otherwise(F.col("b") / F.col("a"))).alias("ratio"))


_CA = f"WITH {q.SCORED}, ca AS (SELECT cluster, count_if(true_label = 'Anomalous')::BIGINT AS anomalous_count, round(avg(distance), 4) AS mean, round(stddev_samp(distance), 4) AS std, count(*)::BIGINT AS n FROM sc GROUP BY cluster)"


def cluster_analysis(spark, d) -> DataFrame:
    df = so.scored(emb(spark, d)).groupBy("cluster").agg(F.count_if(F.col("true_label") == "Anomalous").alias("anomalous_count"), F.round(F.avg("distance"), 4).alias("mean"), F.round(F.stddev_samp("distance"), 4).alias("std"), F.count(F.lit(1)).alias("n"))
    return df.withColumn("ratio", F.round(F.col("anomalous_count") / F.col("n"), 4))


CATALOG["cluster_analysis"] = (cluster_analysis, f"{_CA} SELECT *, round(anomalous_count::DOUBLE / n, 4) AS ratio FROM ca")


@query("cluster_quality", f"{_CA} SELECT count(*)::BIGINT AS clusters, round(avg(n), 4) AS mean_size, max(n) AS max_size, min(n) AS min_size FROM ca")
def _(spark, d):
    return cluster_analysis(spark, d).agg(F.count(F.lit(1)).alias("clusters"), F.round(F.avg("n"), 4).alias("mean_size"), F.max("n").alias("max_size"), F.min("n").alias("min_size"))


def sweep_sql(n: int = 100) -> str:
    return f"""WITH {q.SCORED}, ed AS (SELECT min(distance) AS lo, max(distance) AS hi FROM sc), gr AS (SELECT i, lo + i * (hi - lo) / {n - 1} AS threshold FROM ed, range({n}) t(i)),
cm AS (SELECT i, threshold, count_if(distance > threshold AND true_label = 'Anomalous')::BIGINT AS tp, count_if(distance > threshold AND true_label <> 'Anomalous')::BIGINT AS fp,
  count_if(distance <= threshold AND true_label = 'Anomalous')::BIGINT AS fn, count_if(distance <= threshold AND true_label <> 'Anomalous')::BIGINT AS tn FROM sc, gr GROUP BY i, threshold), {METRICS_SQL}"""


@query("threshold_sweep", f"{sweep_sql()} SELECT i::INT AS i, round(threshold, 6) AS threshold, {METRICS_OUT} FROM m")
def _(spark, d):
    df = so.sweep(so.scored(emb(spark, d)))
    return df.select("i", r(F.col("threshold")).alias("threshold"), "tp", "fp", "fn", "tn", *[r(F.col(c)).alias(c) for c in _METRICS])


_BEST = "bt AS (SELECT threshold, f1_score, precision, recall FROM m ORDER BY round(f1_score, 9) DESC, i LIMIT 1)"


@query("best_threshold", f"{sweep_sql()}, {_BEST} SELECT round(threshold, 6) AS threshold, round(f1_score, 6) AS f1_score, round(precision, 6) AS precision, round(recall, 6) AS recall FROM bt")
def _(spark, d):
    return so.best(so.sweep(so.scored(emb(spark, d)))).select(*[r(F.col(c)).alias(c) for c in ("threshold", "f1_score", "precision", "recall")])


@query("threshold_label", f"WITH {q.SCORED} SELECT vec_id, CASE WHEN distance > 0.5 THEN 'Anomalous' ELSE 'Normal' END AS prediction FROM sc")
def _(spark, d):
    return so.scored(emb(spark, d)).select("vec_id", F.when(F.col("distance") > 0.5, "Anomalous").otherwise("Normal").alias("prediction"))


@query("confidence", f"WITH {q.SCORED} SELECT vec_id, round(least(abs(distance - 0.5) / 0.5 * 100, 100), 6) AS confidence FROM sc")
def _(spark, d):
    return so.scored(emb(spark, d)).select("vec_id", r(F.least(F.abs(F.col("distance") - 0.5) / 0.5 * 100, F.lit(100.0))).alias("confidence"))


@query("verdict_badge", f"WITH {q.SCORED} SELECT vec_id, CASE WHEN distance > 0.5 THEN 'Suspicious' ELSE 'Genuine' END AS badge, greatest(0, least(100, round(abs(distance - 0.5) / 0.5 * 100, 4))) AS confidence FROM sc")
def _(spark, d):
    c = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(F.abs(F.col("distance") - 0.5) / 0.5 * 100, 4)))
    return so.scored(emb(spark, d)).select("vec_id", F.when(F.col("distance") > 0.5, "Suspicious").otherwise("Genuine").alias("badge"), c.alias("confidence"))


def _cm_sql(th: str) -> str:
    return f"cm AS (SELECT count_if(distance > {th} AND true_label = 'Anomalous')::BIGINT AS tp, count_if(distance > {th} AND true_label <> 'Anomalous')::BIGINT AS fp, count_if(distance <= {th} AND true_label = 'Anomalous')::BIGINT AS fn, count_if(distance <= {th} AND true_label <> 'Anomalous')::BIGINT AS tn FROM sc)"


def cm(spark, d, th: float = 0.5) -> DataFrame:
    sc = so.scored(emb(spark, d))
    return so.with_metrics(so.confusion(sc, F.when(F.col("distance") > th, "Anomalous").otherwise("Normal"), F.col("true_label")))


_CM = f"WITH {q.SCORED}, {_cm_sql('0.5')}"


@query("confusion_matrix", f"{_CM} SELECT * FROM cm")
def _(spark, d):
    return cm(spark, d).select("tp", "fp", "fn", "tn")


@query("cm_totals", f"{_CM} SELECT (tp + fp + fn + tn)::BIGINT AS total, (tp + tn)::BIGINT AS correct, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS correct_share FROM cm")
def _(spark, d):
    return cm(spark, d).select((F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("total"), (F.col("tp") + F.col("tn")).alias("correct"), r(F.col("accuracy")).alias("correct_share"))


@query("classification_metrics", f"{_CM}, {METRICS_SQL} SELECT {METRICS_OUT} FROM m")
def _(spark, d):
    return metrics_out(cm(spark, d))


@query("metrics_summary", f"{_CM}, {METRICS_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS metric, printf('%.2f%%', round({c} * 100, 2)) AS value FROM m" for c in _METRICS))
def _(spark, d):
    return cm(spark, d).unpivot([], list(_METRICS), "metric", "v").select("metric", F.format_string("%.2f%%", F.round(F.col("v") * 100, 2)).alias("value"))


_BAND = "CASE WHEN metric = 'false_alarm_rate' THEN CASE WHEN v < 0.2 THEN 'good' WHEN v < 0.4 THEN 'acceptable' ELSE 'poor' END WHEN v >= 0.85 THEN 'excellent' WHEN v >= 0.70 THEN 'good' WHEN v >= 0.60 THEN 'acceptable' ELSE 'poor' END"


@query("metric_band", f"{_CM}, {METRICS_SQL} SELECT metric, {_BAND} AS band FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS metric, {c} AS v FROM m" for c in _METRICS) + ")")
def _(spark, d):
    return cm(spark, d).unpivot([], list(_METRICS), "metric", "v").select("metric", F.expr(_BAND).alias("band"))


_TIER = "CASE WHEN f1_score >= 0.80 THEN 'EXCELLENT' WHEN f1_score >= 0.70 THEN 'GOOD' WHEN f1_score >= 0.60 THEN 'ACCEPTABLE' ELSE 'POOR' END"


@query("f1_tier", f"{_CM}, {METRICS_SQL} SELECT {_TIER} AS tier, precision < 0.6 AS low_precision, recall < 0.6 AS low_recall FROM m")
def _(spark, d):
    return cm(spark, d).select(F.expr(_TIER).alias("tier"), (F.col("precision") < 0.6).alias("low_precision"), (F.col("recall") < 0.6).alias("low_recall"))


_APPROVAL = "CASE WHEN accuracy >= 0.85 AND precision >= 0.80 AND recall >= 0.85 THEN 'EXCELLENT' WHEN accuracy >= 0.80 AND precision >= 0.75 AND recall >= 0.80 THEN 'GOOD' WHEN accuracy >= 0.70 AND precision >= 0.60 AND recall >= 0.60 THEN 'ACCEPTABLE' ELSE 'POOR' END"


@query("range_approval", f"{_CM}, {METRICS_SQL} SELECT {_APPROVAL} AS approval FROM m")
def _(spark, d):
    return cm(spark, d).select(F.expr(_APPROVAL).alias("approval"))


ADVICE = (("f1_score < 0.70", "retrain"), ("precision < 0.70", "raise threshold"), ("recall < 0.70", "lower threshold"), ("f1_score >= 0.70 AND precision >= 0.70 AND recall >= 0.70", "ready"))


@query("recommendations", f"{_CM}, {METRICS_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS advice FROM m WHERE {t}" for t, a in ADVICE))
def _(spark, d):
    return cm(spark, d).select(F.explode(F.filter(F.array(*[F.when(F.expr(t), F.lit(a)) for t, a in ADVICE]), lambda x: x.isNotNull())).alias("advice"))


_AUC = """pd AS (SELECT distance, count_if(true_label = 'Anomalous') AS a, count(*) AS k FROM sc GROUP BY distance), rk AS (SELECT *, sum(k) OVER (ORDER BY distance) - k AS b FROM pd),
au AS (SELECT (sum(a * (b + (k + 1) / 2.0)) - sum(a) * (sum(a) + 1) / 2.0) / (sum(a) * (sum(k) - sum(a))) AS roc_auc FROM rk)"""


@query("roc_auc", f"WITH {q.SCORED}, {_AUC} SELECT round(roc_auc::DOUBLE, 6) AS roc_auc FROM au")
def _(spark, d):
    return so.roc_auc(so.scored(emb(spark, d))).select(r(F.col("roc_auc").cast("double")).alias("roc_auc"))


@query("average_precision", f"WITH {q.SCORED}, pd AS (SELECT distance, count_if(true_label = 'Anomalous') AS a, count(*) AS k FROM sc GROUP BY distance), rk AS (SELECT *, sum(a) OVER (ORDER BY distance DESC) AS t, sum(k) OVER (ORDER BY distance DESC) AS n FROM pd) SELECT round((sum(a * t::DOUBLE / n) / sum(a))::DOUBLE, 6) AS average_precision FROM rk")
def _(spark, d):
    return so.average_precision(so.scored(emb(spark, d))).select(r(F.col("average_precision")).alias("average_precision"))


_SEP = "sp AS (SELECT avg(distance) FILTER (true_label = 'Anomalous') / avg(distance) FILTER (true_label = 'Normal') AS sep FROM sc)"
_GRADE = "CASE WHEN s >= 0.85 THEN 'A' WHEN s >= 0.75 THEN 'B' WHEN s >= 0.65 THEN 'C' ELSE 'D' END"


def summary(spark, d) -> DataFrame:
    """One row: metrics at the threshold in use, area, separation."""
    sc = so.scored(emb(spark, d))
    sep = sc.agg((F.avg(F.when(F.col("true_label") == "Anomalous", F.col("distance"))) / F.avg(F.when(F.col("true_label") == "Normal", F.col("distance")))).alias("sep"))
    return cm(spark, d).join(so.roc_auc(sc)).join(sep)


@query("auc_tier", f"WITH {q.SCORED}, {_AUC}, {_SEP} SELECT CASE WHEN roc_auc >= 0.9 THEN 'EXCELLENT' WHEN roc_auc >= 0.8 THEN 'GOOD' WHEN roc_auc >= 0.7 THEN 'FAIR' ELSE 'POOR' END AS auc_tier, CASE WHEN sep >= 2 THEN 'EXCELLENT' WHEN sep >= 1.5 THEN 'GOOD' WHEN sep >= 1.2 THEN 'FAIR' ELSE 'POOR' END AS separation_tier FROM au, sp")
def _(spark, d):
    a, s = F.col("roc_auc"), F.col("sep")
    tier = lambda c, x, y, z: F.when(c >= x, "EXCELLENT").when(c >= y, "GOOD").when(c >= z, "FAIR").otherwise("POOR")
    return summary(spark, d).select(tier(a, 0.9, 0.8, 0.7).alias("auc_tier"), tier(s, 2, 1.5, 1.2).alias("separation_tier"))


@query("model_grade", f"{_CM}, {METRICS_SQL}, {_AUC}, {_SEP}, g AS (SELECT (f1_score + roc_auc + least(sep / 2, 1)) / 3 AS s FROM m, au, sp) SELECT round(s::DOUBLE, 5) AS score, {_GRADE} AS grade FROM g")
def _(spark, d):
    s = (F.col("f1_score") + F.col("roc_auc").cast("double") + F.least(F.col("sep") / 2, F.lit(1.0))) / 3
    return summary(spark, d).select(s.alias("s")).select(F.round("s", 5).alias("score"), F.expr(_GRADE).alias("grade"))


@query("full_evaluation", f"{_CM}, {METRICS_SQL}, {_AUC}, {_SEP} SELECT {METRICS_OUT}, round(roc_auc::DOUBLE, 6) AS roc_auc, round(sep, 6) AS separation FROM m, au, sp")
def _(spark, d):
    return summary(spark, d).select("tp", "fp", "fn", "tn", *[r(F.col(c)).alias(c) for c in _METRICS], r(F.col("roc_auc").cast("double")).alias("roc_auc"), r(F.col("sep")).alias("separation"))


@query("threshold_improvement", f"{_CM}, {METRICS_SQL.replace('m AS', 'm0 AS', 1)}, sw AS ({sweep_sql(500)}, {_BEST} SELECT * FROM bt) SELECT round(m0.f1_score, 6) AS before, round(sw.f1_score, 6) AS after, round(sw.f1_score - m0.f1_score, 6) AS gain FROM m0, sw")
def _(spark, d):
    new = so.best(so.sweep(so.scored(emb(spark, d)), 500)).select(F.col("f1_score").alias("new"))
    df = cm(spark, d).select("f1_score").join(new)
    return df.select(r(F.col("f1_score")).alias("before"), r(F.col("new")).alias("after"), r(F.col("new") - F.col("f1_score")).alias("gain"))


_DIST = "ds AS (SELECT " + ", ".join(f"{f}(distance) FILTER (true_label = '{lab}') AS {n}_{k}" for n, lab in (("normal", "Normal"), ("anomalous", "Anomalous")) for k, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + " FROM sc)"
_DIST_NAMES = [f"{n}_{k}" for n in ("normal", "anomalous") for k in ("mean", "std", "min", "max")]
_AP = "pa AS (SELECT distance, count_if(true_label = 'Anomalous') AS a, count(*) AS k FROM sc GROUP BY distance), ra AS (SELECT *, sum(a) OVER (ORDER BY distance DESC) AS t, sum(k) OVER (ORDER BY distance DESC) AS n FROM pa), ap AS (SELECT sum(a * t::DOUBLE / n) / sum(a) AS average_precision FROM ra)"


@query(
    "evaluation_record",
    f"{_CM}, {METRICS_SQL}, {_AUC}, {_AP}, {_DIST}, sw AS ({sweep_sql()}, {_BEST} SELECT * FROM bt) SELECT tp, fp, fn, tn, "
    + ", ".join(f"round(m.{c}, 6) AS {c}" for c in _METRICS)
    + ", round(roc_auc::DOUBLE, 6) AS roc_auc, round(average_precision::DOUBLE, 6) AS average_precision, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in _DIST_NAMES)
    + ", round(CASE WHEN normal_mean = 0 THEN 'Infinity'::DOUBLE ELSE anomalous_mean / normal_mean END, 6) AS separation, 0.5::DOUBLE AS in_use, round(sw.threshold, 6) AS best, round(sw.f1_score, 6) AS best_f1_score FROM m, au, ap, ds, sw",
)
def _(spark, d):
    x = ev.record(so.scored(emb(spark, d)), 0.5)
    col = lambda part, c, out=None: r(F.col(f"{part}.{c}")).alias(out or c)
    return x.select(
        *[F.col(f"metrics.{c}") for c in ev.MATRIX],
        *[col("metrics", c) for c in _METRICS],
        r(F.col("roc_auc")).alias("roc_auc"),
        r(F.col("average_precision")).alias("average_precision"),
        *[col("distance_statistics", c) for c in (*_DIST_NAMES, "separation")],
        F.col("threshold_analysis.in_use").alias("in_use"),
        col("threshold_analysis", "best"),
        col("threshold_analysis", "f1_score", "best_f1_score"),
    )


_AFTER = "ca AS (SELECT count_if(distance > t AND true_label = 'Anomalous')::BIGINT AS tp, count_if(distance > t AND true_label <> 'Anomalous')::BIGINT AS fp, count_if(distance <= t AND true_label = 'Anomalous')::BIGINT AS fn, count_if(distance <= t AND true_label <> 'Anomalous')::BIGINT AS tn FROM sc, (SELECT threshold AS t FROM sw))"


@query(
    "improvement_report",
    f"{_CM}, {METRICS_SQL}, sw AS ({sweep_sql(500)}, {_BEST} SELECT * FROM bt), {_AFTER}, {METRICS_SQL.replace('m AS', 'm2 AS', 1).replace('FROM cm', 'FROM ca')} "
    + " UNION ALL ".join(f"SELECT '{c}' AS metric, round(m.{c}::DOUBLE, 6) AS before, round(m2.{c}::DOUBLE, 6) AS after, round(m2.{c}::DOUBLE - m.{c}::DOUBLE, 6) AS gain FROM m, m2" for c in ("tp", "fp", "fn", "tn", *_METRICS)),
)
def _(spark, d):
    return ev.improvement(so.scored(emb(spark, d)), 0.5).select("metric", *[r(F.col(c)).alias(c) for c in ("before", "after", "gain")])


@query("threshold_sensitivity", f"{sweep_sql(50)}, {_BEST} SELECT abs(0.5 - threshold) / greatest(0.5, 1e-12) > 0.1 AS sensitive FROM bt")
def _(spark, d):
    return so.best(so.sweep(so.scored(emb(spark, d)), 50)).select((F.abs(F.lit(0.5) - F.col("threshold")) / 0.5 > 0.1).alias("sensitive"))


@query("distance_histogram", f"WITH {q.SCORED}, ed AS (SELECT min(distance) AS lo, max(distance) AS hi FROM sc) SELECT true_label, least(49, floor((distance - lo) / (hi - lo) * 50))::BIGINT AS bin, count(*)::BIGINT AS n FROM sc, ed GROUP BY 1, 2")
def _(spark, d):
    sc = so.scored(emb(spark, d))
    edge = sc.agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"))
    b = F.least(F.lit(49), F.floor((F.col("distance") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 50)).cast("long")
    return sc.join(F.broadcast(edge)).groupBy("true_label", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("noise_core_masks", "SELECT vec_id, label = 9 AS is_noise, label <> 9 AS is_core FROM embeddings")
def _(spark, d):
    return emb(spark, d).select("vec_id", (F.col("label") == 9).alias("is_noise"), (F.col("label") != 9).alias("is_core"))


@query("offset_labels", "WITH m AS (SELECT max(label) FILTER (label < 7) + 1 AS k, count_if(label >= 7) AS noise FROM embeddings) SELECT vec_id, (CASE WHEN label < 7 THEN label WHEN noise < 3 THEN k ELSE k + label - 7 END)::INT AS cluster FROM embeddings, m")
def _(spark, d):
    e = emb(spark, d)
    m = e.agg((F.max(F.when(F.col("label") < 7, F.col("label"))) + 1).alias("k"), F.count_if(F.col("label") >= 7).alias("noise"))
    return e.join(F.broadcast(m)).select("vec_id", F.when(F.col("label") < 7, F.col("label")).when(F.col("noise") < 3, F.col("k")).otherwise(F.col("k") + F.col("label") - 7).cast("int").alias("cluster"))


# --- tf-idf
_TFIDF = rf"""{q.D}, tok AS (SELECT doc_id, list_filter({q.PRE}, lambda x: length(x) > 1) AS w FROM d),
gr AS (SELECT doc_id, unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])))) AS term FROM tok),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM gr GROUP BY doc_id, term), nd AS (SELECT count(*) AS n FROM d WHERE ('0x' || md5(doc_id::VARCHAR)[1:8])::BIGINT % 10 < 7),
vo AS (SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS total FROM tf WHERE ('0x' || md5(doc_id::VARCHAR)[1:8])::BIGINT % 10 < 7 GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 20000),
vi AS (SELECT term, df, total, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM vo, nd)"""


def word_rows(spark, d) -> DataFrame:
    """(doc_id, words) of all documents."""
    own = docs(spark, d).select("doc_id", F.explode(F.array(tx.preprocessed(F.col("text")))).alias("processed"))
    return own.select("doc_id", mo.long_words("processed").alias("words"))


def vocabulary(rows: DataFrame, most: int = mo.VOCABULARY) -> tuple[DataFrame, int]:
    """The top terms of the training part, and how many rows it has."""
    train = rows.where(bucket("doc_id") < 7)
    return te.top_terms(train, most), train.count()


@query("tfidf_top_terms", f"WITH {_TFIDF} SELECT term, df, total, round(idf, 6) AS idf FROM vi")
def _(spark, d):
    top, n = vocabulary(cl.staged(word_rows(spark, d)))
    idf = F.ln((F.lit(1.0) + n) / (F.lit(1) + F.col("df"))) + 1
    return top.select("term", "df", "total", r(idf).alias("idf"))


@query("tfidf_weights", f"WITH {_TFIDF}, x AS (SELECT doc_id, tf.term, tf * idf AS x FROM tf JOIN vi ON tf.term = vi.term) SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM x")
def _(spark, d):
    return weights(spark, d).select("doc_id", "term", r(F.col("weight")).alias("weight"))


def weights(spark, d, most: int = mo.VOCABULARY) -> DataFrame:
    """Of all documents, by the vocabulary of the training part. Words are kept; their n-grams are made in each pass."""
    rows = cl.staged(word_rows(spark, d))
    top, n = vocabulary(rows, most)
    top = top.collect()  # at most ``most`` rows
    import numpy as np

    return mo.tfidf(rows, [x["term"] for x in top], mo.smoothed(n, np.array([x["df"] for x in top], float)), "doc_id")


@query("standard_scale", f"WITH {q.FEATURES}, {long_sql(lx.FEATURES, 'feat')}, s AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS sd FROM fl GROUP BY feature) SELECT doc_id, fl.feature, round(CASE WHEN sd = 0 THEN 0 ELSE (value - m) / sd END, 5) AS scaled FROM fl JOIN s ON fl.feature = s.feature")
def _(spark, d):
    return scaled(spark, d).select("doc_id", "feature", F.round("scaled", 5).alias("scaled"))


def scaled(spark, d) -> DataFrame:
    long_ = long_features(ft.model_features(docs(spark, d)), lx.FEATURES)
    s = long_.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    return long_.join(F.broadcast(s), "feature").select("doc_id", "feature", F.when(F.col("sd") == 0, 0.0).otherwise((F.col("value") - F.col("m")) / F.col("sd")).alias("scaled"))


def base() -> dict:
    """The queries of this module."""
    if "lexical_diversity" not in CATALOG:
        _late()
    return CATALOG


def catalog() -> dict:
    base()
    from lexisift.plans import clustering  # noqa: F401  adds its own entries

    return CATALOG
