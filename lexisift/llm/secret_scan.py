"""Secret scans over a trigram inverted index.

Each rule is a regular expression. ``trigram_query`` derives from its syntax tree which trigrams a matching text must
hold: AND along a sequence, OR over branches. ``postings`` is the inverted index of the trigrams that some rule asks
for; ``candidates`` intersects its postings, and ``scanned`` verifies a rule on its candidates alone. A rule with no
mandatory trigram (long runs of hexadecimal digits) is verified on every text.

Defined cases: a null text counts as empty and has no secrets; a null doc_id is an id like any other; repeated rows
are each scanned; an empty table gives an empty result. Columns of the input pass through ``scanned``, except that
names beginning with ``_s_`` are its own.
"""

from __future__ import annotations

from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.llm.spans import joined, matches, no_spans, redacted

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The header; then all up to the END line, or, where that is missing, the lines of base64 that follow, the last of which may be
#: short. Possessive groups, as Java loops over them without recursion.
_GAP = r"(?:\s|\\[nr])"
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"
    r"(?:(?:(?!-----)[\s\S])*+-----END [A-Z ]{0,32}PRIVATE KEY-----"
    rf"|(?:{_GAP}*+(?:Proc-Type|DEK-Info):[^\n\\]*+)*+(?:{_GAP}*+[A-Za-z0-9+/=]{{16,}}+)++"
    rf"(?:{_GAP}++[A-Za-z0-9+/=]{{1,15}}+(?=\s*(?:\n|\\[nr]|-----|$)))?)?"
)
#: The base laws, then what the method adds: (kind, pattern).
RULES = (
    ("assign", ASSIGN),
    ("access", r"AKIA[A-Z0-9]{16,}"),
    ("hex", r"[0-9a-f]{24,}"),
    ("private_key", PRIVATE_KEY),
    ("forge_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    ("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("map_key", r"\bAIza[A-Za-z0-9_-]{35}"),
    ("bearer", r"\b(?i:bearer)\x20[A-Za-z0-9._~+/-]{24,}=*"),
)
BASE = ("assign", "access", "hex")


def trigram_query(pattern: str):
    """('all', [...]), ('any', [...]) or a trigram; ('all', []) asks for nothing."""
    return _simple(_sequence(parser.parse(pattern)))


def _sequence(nodes):
    needs, run = [], ""

    def close():
        nonlocal run
        needs.extend(run[i : i + 3] for i in range(len(run) - 2))
        run = ""

    for op, value in nodes:
        if op is sre.LITERAL:
            run += chr(value).lower()
            continue
        if op is sre.AT:
            continue
        if op is sre.SUBPATTERN and all(o is sre.LITERAL for o, _ in value[3]):
            run += "".join(chr(v).lower() for _, v in value[3])
            continue
        close()
        if op is sre.SUBPATTERN:
            needs.append(_sequence(value[3]))
        elif op is sre.BRANCH:
            needs.append(("any", [_sequence(x) for x in value[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] >= 1:
            low, _, inner = value
            if low >= 3 and len(inner) == 1 and inner[0][0] is sre.LITERAL:
                needs.append(chr(inner[0][1]).lower() * 3)
            else:
                needs.append(_sequence(inner))
    close()
    return ("all", needs)


def _simple(q):
    if isinstance(q, str):
        return q
    kind, parts = q[0], [_simple(x) for x in q[1]]
    if kind == "any" and any(x == ("all", []) for x in parts):
        return ("all", [])
    parts = [x for x in parts if x != ("all", [])]
    return parts[0] if len(parts) == 1 else (kind, parts)


def trigrams(q) -> set[str]:
    return {q} if isinstance(q, str) else set().union(*[trigrams(x) for x in q[1]])


def holds(q, has) -> Column:
    """The Boolean query as a column; has(trigram) tells whether the posting is there."""
    if isinstance(q, str):
        return has(q)
    out = F.lit(q[0] == "all")
    for x in q[1]:
        out = out & holds(x, has) if q[0] == "all" else out | holds(x, has)
    return out


def postings(docs: DataFrame, wanted: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index: one row (trigram, key) for each trigram wanted and text that holds it."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    present = F.filter(F.array(*[F.when(F.contains(F.col("_s_low"), F.lit(t)), F.lit(t)) for t in wanted]), lambda t: t.isNotNull())
    return docs.select(F.col(key), low.alias("_s_low")).select(F.col(key), F.explode(present).alias("trigram"))


def candidates(index: DataFrame, queries: dict, key: str = "doc_id") -> DataFrame:
    """(key, rules): the rules whose Boolean query the postings of a key satisfy."""
    met = index.groupBy(key).agg(F.collect_set("trigram").alias("_s_set"))
    rules = F.filter(
        F.array(*[F.when(holds(q, lambda t: F.array_contains("_s_set", t)), F.lit(kind)) for kind, q in queries.items()]),
        lambda x: x.isNotNull(),
    )
    return met.select(key, rules.alias("_s_rules")).where(F.size("_s_rules") > 0)


def scanned(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's columns and one array of spans per rule, named ``_s_<kind>``."""
    queries = {kind: trigram_query(p) for kind, p in rules}
    asked = {k: q for k, q in queries.items() if q != ("all", [])}
    wanted = sorted(set().union(*[trigrams(q) for q in asked.values()]))
    chosen = candidates(postings(docs, wanted, key, text), asked, key).withColumnRenamed(key, "_s_key")
    df = docs.join(chosen, docs[key].eqNullSafe(F.col("_s_key")), "left").drop("_s_key")
    clean = F.coalesce(F.col(text), F.lit(""))
    for kind, pattern in rules:
        gate = F.coalesce(F.array_contains("_s_rules", kind), F.lit(False)) if kind in asked else F.rlike(clean, F.lit(pattern))
        df = df.withColumn(f"_s_{kind}", matches(clean, pattern, gate))
        if kind == "assign":
            values = F.regexp_extract_all(clean, F.lit(pattern), F.lit(1))
            kept = F.zip_with(f"_s_{kind}", values, lambda s, v: F.when(F.char_length(v) >= 6, s))
            df = df.withColumn(f"_s_{kind}", F.when(F.size(f"_s_{kind}") > 0, F.filter(kept, lambda s: s.isNotNull())).otherwise(no_spans()))
    return df.drop("_s_rules")


def secrets(docs: DataFrame) -> DataFrame:
    df = scanned(docs.select("doc_id", "text"))
    every = [(kind, F.col(f"_s_{kind}")) for kind, _ in RULES]
    base = [x for x in every if x[0] in BASE]
    return df.select(
        "doc_id",
        *[F.size(c).cast("long").alias(f"n_{kind}") for kind, c in base],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(every).alias("spans"),
    )


def redacted_documents(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret replaced by the mark, and n_chars to match. No document goes."""
    df = scanned(docs)
    spans = F.flatten(F.array(*[F.col(f"_s_{kind}") for kind, _ in RULES]))
    df = df.withColumn("text", F.when(F.size(spans) > 0, redacted(F.col("text"), spans, mark)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return df.select(*docs.columns)
