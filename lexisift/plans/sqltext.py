"""Common table expressions of the SQL that the queries are held against."""

from __future__ import annotations

from lexisift.operators import lexicons as lx

STOP = lx.sql_list(lx.STOPWORDS)
BLANK = r"[ \t\n\r\f\x0b]"
CLEAN = r"regexp_replace(lower(text), '[^\p{L}\p{N}_ \t\n\r\f\x0b]', '', 'g')"
TOKENS = rf"regexp_extract_all({CLEAN}, '[\p{{L}}\p{{N}}_]+')"
NO_STOP = f"list_filter({TOKENS}, lambda x: x NOT IN {STOP})"


def lemma(x: str) -> str:
    return lx.sql_case(x, {k: f"'{v}'" for k, v in lx.LEMMAS.items()}, x)


PRE = f"list_transform({NO_STOP}, lambda x: {lemma('x')})"
WORDS = rf"list_filter(regexp_split_to_array(text, '{BLANK}+'), lambda x: x <> '')"
LOWER_WORDS = rf"regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')"


def pol(k: int) -> str:
    names = lx.sql_list(lx.SENTIMENT)
    case = lx.sql_case("x", {w: f"{v[k]}::DOUBLE" for w, v in lx.SENTIMENT.items()}, "0::DOUBLE")
    return f"coalesce(list_avg(list_transform(list_filter(w, lambda x: x IN {names}), lambda x: {case})), 0)::DOUBLE"


def count(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))::BIGINT"


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"


def entropy_cte(source: str, name: str, epsilon: str, words: str = "w") -> str:
    return f"""{name} AS (SELECT doc_id, -sum(p * log2(p + {epsilon})) AS h FROM (SELECT doc_id, k / sum(k) OVER (PARTITION BY doc_id) AS p FROM
  (SELECT doc_id, x, count(*)::DOUBLE AS k FROM (SELECT doc_id, unnest({words}) AS x FROM {source}) GROUP BY doc_id, x)) GROUP BY doc_id)"""


D = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
FEATURES = rf"""{D},
tok AS (SELECT doc_id, text, {PRE} AS w FROM d),
{entropy_cte('tok', 'ent', '1e-10')},
feat AS (SELECT tok.doc_id, text, w, len(w)::BIGINT AS review_length, {ratio('len(list_distinct(w))', 'len(w)')} AS lexical_diversity,
  {ratio("list_sum(list_transform(w, lambda x: length(x)))", 'len(w)')} AS avg_word_length, {pol(0)} AS sentiment_polarity, {pol(1)} AS sentiment_subjectivity,
  coalesce(h, 0)::DOUBLE AS word_entropy, {ratio('len(w) - len(list_distinct(w))', 'len(w)')} AS repetition_ratio,
  {count('!')} AS exclamation_count, {count('[?]')} AS question_count,
  {ratio(count(chr(92) + 'p{Lu}'), 'length(text)')} AS capital_ratio, {ratio(count('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]'), 'length(text)')} AS punctuation_density
  FROM tok LEFT JOIN ent ON tok.doc_id = ent.doc_id)"""

EXPAND = "lower(text)"
for _p in (f"https?{BLANK.replace('[', '[^')}+|http{BLANK.replace('[', '[^')}+|www{BLANK.replace('[', '[^')}+", f"{BLANK.replace('[', '[^')}+@{BLANK.replace('[', '[^')}+", "<[^>]+>"):
    EXPAND = f"regexp_replace({EXPAND}, '{_p}', '', 'g')"
CONTRACTIONS = (("don''t", "do not"), ("won''t", "will not"), ("can''t", "cannot"), ("n''t", " not"), ("''re", " are"), ("''ve", " have"), ("''ll", " will"))


def expanded(x: str) -> str:
    for a, b in CONTRACTIONS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


RANGE_TEXT = expanded(EXPAND)
RANGE_TOKENS = rf"list_transform(list_filter(regexp_extract_all({RANGE_TEXT}, '[\p{{L}}\p{{N}}]+'), lambda x: x NOT IN {STOP}), lambda x: {lemma('x')})"
SYLLABLES = "CASE WHEN length(x) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN x LIKE '%e' THEN 1 ELSE 0 END) END"
SENTENCES = rf"greatest(len(regexp_extract_all(text, '[.!?]+')), CASE WHEN regexp_matches(text, '[\p{{L}}\p{{N}}]') THEN 1 ELSE 0 END)::BIGINT"
ALNUM = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
EASE = f"CASE WHEN len(a) = 0 OR s = 0 THEN 0 ELSE greatest(0, least(100, 206.835 - 1.015 * (len(a)::DOUBLE / s) - 84.6 * (list_sum(list_transform(a, lambda x: {SYLLABLES}))::DOUBLE / len(a)))) END::DOUBLE"
SHOUT = ratio("len(list_filter(ws, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x)))", "len(ws)")
RANGES = rf"""{D},
rtok AS (SELECT doc_id, text, {RANGE_TOKENS} AS w, {ALNUM} AS a, {WORDS} AS ws, {SENTENCES} AS s FROM d),
rfeat AS (SELECT doc_id, text, len(w)::BIGINT AS review_length, {ratio('len(list_distinct(w))', 'len(w)')} AS lexical_diversity,
  {ratio("list_sum(list_transform(w, lambda x: length(x)))", 'len(w)')} AS avg_word_length, {pol(0)} AS sentiment_polarity, {pol(1)} AS sentiment_subjectivity,
  {EASE} AS language_complexity, {ratio('len(w) - len(list_distinct(w))', 'len(w)')} AS repetition_ratio,
  {count('!')} AS exclamation_count, {count('[?]')} AS question_count, {SHOUT} AS capital_usage, {ratio(count('[!?.,;:-]'), 'len(w)')} AS punctuation_density FROM rtok)"""

# predicates
_CH = "list_filter(string_split(x, ''), lambda c: c <> '')"
_N = "length(x)"
CLUSTER = "regexp_matches(x, '[bcdfghjklmnpqrstvwxyz]{3,}')"
ODD = (
    "list_bool_or(list_transform(q, lambda x: "
    f"({_N} >= 4 AND {_N} - length(replace(x, x[1:2], '')) >= 6) OR ({_N} >= 6 AND {_N} - length(replace(x, x[1:3], '')) >= 9) OR "
    f"({_N} >= 4 AND list_max(list_transform(list_distinct({_CH}), lambda c: {_N} - length(replace(x, c, ''))))::DOUBLE / {_N} > 0.7) OR "
    f"({_N} >= 4 AND len(list_distinct({_CH}))::DOUBLE / {_N} < 0.4) OR ({_N} >= 6 AND len(list_distinct({_CH})) <= 3)))"
)


def share(words: str, test: str) -> str:
    return ratio(f"len(list_filter({words}, lambda x: {test}))", f"len({words})")


def near() -> str:
    parts = [f"(strpos('{r}', f[i]) > 0 AND strpos('{r}', f[i+1]) > 0 AND abs(strpos('{r}', f[i]) - strpos('{r}', f[i+1])) <= 2)" for r in lx.KEYBOARD]
    return f"len(list_filter(range(1, greatest(length(f), 2)), lambda i: {' OR '.join(parts)}))"


VOWELS = "len(regexp_extract_all(f, '[aeiou]'))::DOUBLE / nullif(length(f), 0)"


def gibberish(ui: bool) -> str:
    low = "^[a-z]+$" if ui else r"^\p{Ll}+$"
    rest = f"{VOWELS} < 0.25" if ui else f"({VOWELS} < 0.25 AND f NOT IN {lx.sql_list(lx.SHORT_WORDS)})"
    mean = ratio("list_sum(list_transform(q, lambda x: length(x)))", "len(q)")
    short = f"({mean} < 3.5 AND len(q) > 2)" if ui else f"({mean} < 3.0 AND len(q) > 3)"
    tail = "" if ui else " OR (coalesce(h, 0) < 1.5 AND len(q) > 3)"
    return (
        f"CASE WHEN len(q) = 0 THEN false ELSE coalesce({ODD}, false) OR (len(q) = 1 AND length(f) BETWEEN 4 AND 8 AND regexp_matches(f, '{low}') AND ({near()} >= 2 OR {rest})) OR {short} OR "
        f"({ratio('len(list_distinct(q))', 'len(q)')} < 0.4 AND len(q) > 2) OR {share('q', CLUSTER)} > 0.4 OR (len(q) >= 3 AND {share('q', 'length(x) <= 2')} > 0.7) OR "
        f"({share('q', 'length(x) > 8')} > 0.3 AND len(list_filter(q, lambda x: length(x) > 8 AND {CLUSTER})) > 0) OR "
        f"(len(q) = 1 AND length(f) > 10 AND ({VOWELS} < 0.2 OR regexp_matches(f, '[bcdfghjklmnpqrstvwxyz]{{4,}}'))){tail} END"
    )


GIB = rf"""{D},
gq AS (SELECT doc_id, text, {LOWER_WORDS} AS q FROM d), {entropy_cte('gq', 'gent', '0', 'q')},
gf AS (SELECT gq.doc_id, text, q, coalesce(q[1], '') AS f, h FROM gq LEFT JOIN gent ON gq.doc_id = gent.doc_id)"""
_LOWER_SPLIT = rf"list_filter(regexp_split_to_array(lower(text), '{BLANK}+'), lambda x: x <> '')"
TAGALOG_SHARE = f"{share(_LOWER_SPLIT, 'x IN ' + lx.sql_list(lx.TAGALOG))} > 0.2"


def tagalog() -> str:
    out = f"({TAGALOG_SHARE})"
    for g in lx.TAGALOG_GROUPS:
        hits = f"len(list_filter({TOKENS_LOW}, lambda x: x IN {lx.sql_list(g)}))"
        out += f" OR ({hits} > 0 AND (len({_LOWER_SPLIT}) < 20 OR {hits} >= 2))"
    return out


TOKENS_LOW = LOWER_WORDS
BLANK_TEXT = rf"regexp_replace(text, '{BLANK}', '', 'g') = ''"

# vectors and scores
VEC = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
z AS (SELECT vec_id, label, list_transform(e, lambda x: CASE WHEN n = 0 THEN 0 ELSE x / n END) AS z FROM (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v))"""
CENTROIDS = f"""{VEC},
mean AS (SELECT label AS cluster, pos, avg(x) AS m FROM (SELECT label, unnest(range(1, len(z) + 1)) AS pos, unnest(z) AS x FROM z WHERE label >= 0) GROUP BY label, pos),
cent AS (SELECT cluster, list(m / (n + 1e-10) ORDER BY pos) AS c FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY cluster)) AS n FROM mean) GROUP BY cluster)"""
DOT = "list_sum(list_transform(range(1, len(z) + 1), lambda i: z[i] * c[i]))"
SCORED = f"""{CENTROIDS},
pairs AS (SELECT vec_id, label, cluster, 1 - {DOT} AS d FROM z CROSS JOIN cent WHERE cluster < 7),
near AS (SELECT vec_id, label, arg_min(cluster, d * 1000 + cluster * 1e-9) AS cluster, min(d) AS distance FROM pairs GROUP BY vec_id, label),
sc AS (SELECT vec_id, cluster, round(distance, 6) AS distance, CASE WHEN label >= 7 THEN 'Anomalous' ELSE 'Normal' END AS true_label FROM near)"""
