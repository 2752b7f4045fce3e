"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select.

The base laws find e-mail and IP addresses, card and phone numbers. High-recall generators then propose further,
overlapping spans; each has numeric features of its format and of the characters around it. Boosted trees, fitted on the
driver to spans made by ``examples`` (a bounded, seeded sample; no document is read for it), give each a score, and a
threshold per kind, calibrated to a precision on examples held out, selects what is redacted. The trees become one column
expression: no Python runs on executors.

Defined cases: a null text counts as empty and has no spans; repeated rows are each searched; an empty table gives an
empty result. Columns of the input pass through ``searched``, except that names beginning with ``_p_`` are its own.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.llm.spans import digits, joined, luhn, matches, redacted

# \G admits a match that begins where the last one ended; elsewhere a run is entered at its start only, which
# changes no match and keeps long runs linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

#: kind, generator, what a text must hold for it.
GENERATORS = (
    ("bank_account", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", r"[A-Z]{2}[0-9]{2}"),
    ("tax_id", r"(?<![0-9-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9-])", r"[0-9]{3}[\x20-][0-9]{2}[\x20-]"),
    ("local_phone", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    ("hardware_address", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]{2}:[0-9A-Fa-f]{2}:"),
    ("spoken_email", r"(?i)[a-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[a-z0-9-]{1,63}(?:\x20?[\[(]dot[\])]\x20?[a-z0-9-]{1,63}){1,4}", r"(?i)[\[(]at[\])]"),
)
CUES = r"(?i)phone|call|tel|mobile|fax|ssn|social|tax|iban|account|bank|mac|device|mail|contact|write|reach"
FEATURES = ("n_digits", "n_upper", "n_marks", "length", "n_groups", "cue", "alone", "check", "mixed", "zero")
BEFORE, AFTER = 24, 1


def features_of(value: str, before: str, after: str, kind: int) -> list[float]:
    """The same features as ``feature_columns`` has; for fitting."""
    d = re.sub("[^0-9]", "", value)
    return [
        len(d),
        len(re.findall("[A-Z]", value)),
        len(re.findall(r"[^A-Za-z0-9]", value)),
        len(value),
        len(re.findall("[0-9]+", value)),
        float(bool(re.search(CUES, before))),
        float(not re.match(r"[A-Za-z0-9]", after or " ") and not re.search(r"[A-Za-z0-9]$", before or " ")),
        float(_check(value) if kind == 0 else 0),
        float(bool(re.search("[A-Za-z]", value)) and bool(d)),
        float(bool(re.match(r"\(?(000|666|9)", value))),
    ]


def _check(value: str) -> bool:
    v = re.sub(r"\s", "", value)
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def feature_columns(s: Column, text: Column, kind: int) -> list[Column]:
    value = s["value"]
    before = F.substr(text, F.greatest(s["start"] + 1 - F.lit(BEFORE), F.lit(1)), F.least(s["start"], F.lit(BEFORE)))
    after = F.substr(text, s["end"] + 1, F.lit(AFTER))
    d = digits(value)
    flag = lambda c: c.cast("double")
    if kind == 0:  # the remainder by 97, digit by digit, with letters as 10 to 35
        v = F.regexp_replace(value, r"\s", "")
        turned = F.concat(F.substr(v, F.lit(5), F.char_length(v)), F.substr(v, F.lit(1), F.lit(4)))
        codes = F.transform(F.split(turned, ""), lambda c: F.conv(c, 36, 10).cast("int"))
        rest = F.aggregate(codes, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + F.coalesce(x, F.lit(0))) % 97)
        check = flag(rest == 1)
    else:
        check = F.lit(0.0)
    return [
        F.char_length(d).cast("double"),
        F.regexp_count(value, F.lit("[A-Z]")).cast("double"),
        F.regexp_count(value, F.lit("[^A-Za-z0-9]")).cast("double"),
        F.char_length(value).cast("double"),
        F.regexp_count(value, F.lit("[0-9]+")).cast("double"),
        flag(F.rlike(before, F.lit(CUES))),
        flag(~F.rlike(after, F.lit(r"^[A-Za-z0-9]")) & ~F.rlike(before, F.lit(r"[A-Za-z0-9]$"))),
        check,
        flag(F.rlike(value, F.lit("[A-Za-z]")) & (F.char_length(d) > 0)),
        flag(F.rlike(value, F.lit(r"^\(?(000|666|9)"))),
    ]


def examples(n: int = 4000, seed: int = 11):
    """Spans as the generators propose them, right and wrong in equal parts: (features, kind, label)."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    ten, upper, hexes, low = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    cue = {0: "iban account bank", 1: "ssn social tax", 2: "phone call tel mobile", 3: "mac device", 4: "mail contact write"}
    out = []
    for _ in range(n):
        kind, good = r.randrange(5), r.random() < 0.5
        if kind == 0:
            body = pick(upper + ten, 4) + pick(ten, r.choice([8, 10, 12, 14, 16, 18]))
            land = pick(upper, 2)
            code = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
            v = f"{land}{code:02d}{body}" if good else f"{land}{(code + r.randrange(1, 90)) % 97:02d}{body}"
        elif kind == 1:
            head = f"{r.choice([x for x in range(1, 900) if x != 666]):03d}" if good else r.choice(["000", "666", f"9{pick(ten, 2)}", pick(ten, 3)])
            v = f"{head}-{pick(ten, 2)}-{pick(ten, 4)}"
        elif kind == 2:
            v = f"({pick(ten[2:], 1)}{pick(ten, 2)}) {pick(ten, 3)}-{pick(ten, 4)}" if r.random() < 0.5 else f"{pick(ten, 3)}-{pick(ten, 3)}-{pick(ten, 4)}"
        elif kind == 3:
            v = ":".join(pick(hexes, 2) for _ in range(6)) if good else ":".join(pick(ten[:6], 2) for _ in range(6))
        else:
            v = f"{pick(low, r.randrange(3, 9))} [at] {pick(low, 6)} [dot] {pick(low, 3)}" if good else f"{pick(low, 1)}(at){pick(low, 2)}(dot){pick(low, 1)}"
        words = " ".join(pick(low, r.randrange(2, 7)) for _ in range(3))
        near = r.random() < (0.85 if good else 0.05)
        before = (words + " " + r.choice(cue[kind].split()) + r.choice([": ", " ", " is "]))[-BEFORE:] if near else (words + " ")[-BEFORE:]
        after = r.choice(" .,\n") if good or r.random() < 0.5 else pick(low, 1)
        out.append((features_of(v, before, after, kind), kind, good))
    return np.array([f for f, _, _ in out]), np.array([k for _, k, _ in out]), np.array([g for _, _, g in out], float)


def _tree(x, g, h, depth):
    """A regression tree on gradients: (feature, cut, left, right) or a leaf's value."""
    best = (1e-6, None, None)
    whole = g.sum() ** 2 / (h.sum() + 1)
    if depth:
        for j in range(x.shape[1]):
            for c in np.unique(x[:, j])[:-1]:
                m = x[:, j] <= c
                gain = g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1) - whole
                if gain > best[0] + 1e-9:
                    best = (gain, j, c)
    if best[1] is None:
        return float(-g.sum() / (h.sum() + 1))
    m = x[:, best[1]] <= best[2]
    return (best[1], float(best[2]) + 0.5, _tree(x[m], g[m], h[m], depth - 1), _tree(x[~m], g[~m], h[~m], depth - 1))


def _value(tree, x):
    if isinstance(tree, float):
        return np.full(len(x), tree)
    j, c, a, b = tree
    return np.where(x[:, j] <= c, _value(a, x), _value(b, x))


@lru_cache(maxsize=1)
def fitted(trees: int = 30, rate: float = 0.4, precision: float = 0.995):
    """Trees, and for each kind the least score at which examples held out have the precision asked for."""
    x, kind, y = examples()
    x = np.column_stack([x, kind])
    train = np.arange(len(y)) % 4 != 0
    score, forest = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        t = _tree(x[train], (p - y)[train], (p * (1 - p))[train], 3)
        forest.append(t)
        score = score + rate * _value(t, x)
    cuts = []
    for k in range(len(GENERATORS)):
        m = ~train & (kind == k)
        order = np.argsort(-score[m], kind="stable")
        right = np.cumsum(y[m][order]) / np.arange(1, m.sum() + 1)
        good = np.flatnonzero(right >= precision)
        cuts.append(float(max(score[m][order][good[-1]], 0.0)) if len(good) else 99.0)
    return forest, rate, cuts


def _column(tree, f: list[Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    j, c, a, b = tree
    if j == len(FEATURES):  # the kind is known when the expression is built
        return _column(a if f[j] <= c else b, f)
    return F.when(f[j] <= c, _column(a, f)).otherwise(_column(b, f))


def chosen(text: Column, kind: int) -> Column:
    """Spans of one generator whose score reaches its threshold."""
    forest, rate, cuts = fitted()
    _, pattern, gate = GENERATORS[kind]
    held = F.transform(
        matches(text, pattern, F.rlike(text, F.lit(gate))),
        lambda s: F.struct(s.alias("s"), F.array(*feature_columns(s, text, kind)).alias("f")),
    )

    def good(x):
        f = [F.get(x["f"], F.lit(j)) for j in range(len(FEATURES))] + [kind]
        total = F.lit(0.0)
        for t in forest:
            total = total + _column(t, f)
        return total * F.lit(rate) >= F.lit(cuts[kind])

    return F.transform(F.filter(held, good), lambda x: x["s"])


def base_spans(text: Column) -> list[tuple[str, Column]]:
    part = lambda s, i: F.get(F.split(s["value"], r"\."), F.lit(i))
    small = lambda p: F.char_length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(p.try_cast("decimal(38,0)"), F.lit(999)) <= 255)
    n = lambda s: F.char_length(digits(s["value"]))
    return [
        ("email", matches(text, EMAIL, F.contains(text, F.lit("@")))),
        ("ip", F.filter(matches(text, IP, F.rlike(text, F.lit(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"))), lambda s: small(part(s, 0)) & small(part(s, 1)) & small(part(s, 2)) & small(part(s, 3)))),
        ("card", F.filter(matches(text, CARD, F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}"))), lambda s: n(s).between(12, 19) & luhn(s["value"]))),
        ("phone", F.filter(matches(text, PHONE, F.rlike(text, F.lit(r"\+[0-9]"))), lambda s: n(s).between(9, 15))),
    ]


def searched(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input's columns and one array of spans per kind, named ``_p_<kind>``."""
    clean = F.coalesce(F.col(text), F.lit(""))
    own = {f"_p_{kind}": c for kind, c in base_spans(clean)}
    more = {f"_p_{kind}": chosen(clean, k) for k, (kind, _, _) in enumerate(GENERATORS)}
    return docs.withColumns(own | more)


def kinds() -> list[tuple[str, Column]]:
    return [(k, F.col(f"_p_{k}")) for k in (*BASE, *(g[0] for g in GENERATORS))]


def personal(docs: DataFrame) -> DataFrame:
    every = kinds()
    return searched(docs.select("doc_id", "text")).select(
        "doc_id",
        *[F.size(c).cast("long").alias(f"n_{k}") for k, c in every[: len(BASE)]],
        F.sha2(joined(every[: len(BASE)]), 256).alias("base_sha256"),
        joined(every).alias("spans"),
    )


def redacted_documents(docs: DataFrame, mark: str = "[PERSONAL]") -> DataFrame:
    df = searched(docs)
    spans = F.flatten(F.array(*[c for _, c in kinds()]))
    return df.withColumn("text", F.when(F.size(spans) > 0, redacted(F.col("text"), spans, mark)).otherwise(F.col("text"))).select(*docs.columns)
