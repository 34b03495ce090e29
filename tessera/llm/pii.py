"""Personal data by weak supervision, in DataFrame functions alone.

Patterns propose spans; those of the base patterns always stay. Labelers vote on
every span (1 for, -1 against, 0 abstaining): format patterns, checks of numbers,
gazetteers of prefixes and domains, words of the context, and the span's borders.
Expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is without any labels, and gives each pattern of votes a posterior.
A logistic span classifier is trained on these posteriors, from the votes, the
kind, and the span's length and share of digits; other spans stay if it gives them
half or more.

The vote patterns are counted in Spark over all documents; the counts, at most
`len(KINDS) * 3 ** len(LABELERS) * 5 * 4` whatever the input, are what the driver
gathers.

Defined cases: a null text is empty and has no spans; repeated rows are judged
each; spans of one kind never overlap, spans of several kinds that the method adds
may; very long texts and texts with very many matches take time near proportional to
them; other columns are ignored; ids have any type, and null ids pass through; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .storage import write_table

# The base patterns, written so that no text takes more than linear
# time: a match that could start earlier in its run of characters does, or starts
# where the last one ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What the method proposes besides: cards (that hold) within longer runs of digits, national
# phone numbers, bank accounts, and social security numbers.
MORE = {
    "card": r"(?<![0-9])(?:[0-9]{14,19}+|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
    "tel": r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
KINDS = ("email", "ip", "card", "phone", "tel", "iban", "ssn")
LABELERS = ("format", "check", "gazetteer", "context", "border")
# Gazetteers and context words.
TOP_DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|us"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
CALLING_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
PRIVATE_IP = r"^(?:0|10|127|169\.254|192\.168|22[4-9]|2[3-5][0-9])\."
CUES = r"(?i)\b(?:e-?mail|mail|contact|write|call|phone|tel|mobile|fax|card|visa|credit|pay|ip|host|addr(?:ess)?|server|iban|account|ssn|social)\b"
COUNTER_CUES = r"(?i)\b(?:version|ver|order|isbn|sku|ref|no|id|page|model|serial)\b"
_CONTEXT = 30


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.reverse(F.split(x, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*(F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def iban_holds(match: Column) -> Column:
    """Whether the number's remainder by 97, with its head at the end and letters as
    two digits, is 1."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(turned, F.lit(0), step) == 1)


def card_holds(match: Column) -> Column:
    plain = digits(match)
    return F.when(F.length(plain).between(14, 19), luhn(plain)).otherwise(False)


_HOLDS = {
    "ip": lambda m: m.rlike(r"^(?:0*+(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5]|)(?:\.|$)){4}"),
    "card": card_holds,
    "phone": lambda m: F.length(digits(m)).between(10, 15),
}


def _vote(positive: Column, negative: Column | None = None) -> Column:
    vote = F.when(positive, 1)
    return F.coalesce((vote if negative is None else vote.when(negative, -1)).otherwise(0), F.lit(0))


def _votes(kind: str, match: Column, before: Column, after: Column) -> list[Column]:
    plain = digits(match)
    n = F.length(plain)
    formats = {
        "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}$",
        "ip": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
        "card": r"^(?:[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|3[0-9]{3}[\x20-]?[0-9]{6}[\x20-]?[0-9]{4,5})$",
        "phone": r"^\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,4}){1,4}$",
        "tel": r"^(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}$",
        "iban": r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}",
        "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    }
    checks = {
        "email": ~match.rlike(r"\.\.|^\.|\.@|-\."),
        "ip": ~match.rlike(r"(?:^|\.)0[0-9]"),
        "card": card_holds(match),
        "phone": n.between(10, 15),
        "tel": n == 10,
        "iban": iban_holds(match),
        "ssn": n == 9,
    }
    gazetteers = {
        "email": match.rlike(rf"(?i)\.(?:{TOP_DOMAINS})$"),
        "ip": ~match.rlike(PRIVATE_IP),
        "card": plain.rlike(ISSUERS),
        "phone": match.rlike(CALLING_CODES),
        "tel": plain.rlike("^[2-9]"),
        "iban": match.rlike("^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"),
        "ssn": F.lit(None).cast("boolean"),
    }
    well_formed = match.rlike(formats[kind])
    return [
        _vote(well_formed, ~well_formed),
        _vote(checks[kind], ~checks[kind]),
        _vote(gazetteers[kind]),
        _vote(before.rlike(CUES), before.rlike(COUNTER_CUES)),
        _vote(
            ~before.rlike(r"[A-Za-z0-9_]$") & ~after.rlike(r"^[A-Za-z0-9_]"),
            before.rlike(r"[A-Za-z0-9_]$") | after.rlike(r"^[A-Za-z0-9_]"),
        ),
    ]


def _holding(test):
    return lambda s: test(s["match"])


def _describing(kind: str, base: bool):
    def describe(s: Column) -> Column:
        code = F.lit(0)
        for vote in _votes(kind, s["match"], s["before"], s["after"]):
            code = code * 3 + vote + 1
        size = s["end"] - s["start"]
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(base).alias("base"),
            code.cast("int").alias("code"),
            F.when(size < 10, 0).when(size < 14, 1).when(size < 18, 2).when(size < 24, 3).otherwise(4).alias("size"),
            F.least(F.floor(4 * F.length(digits(s["match"])) / size), F.lit(3)).cast("int").alias("digits"),
        )

    return describe


def _candidates(text: Column) -> Column:
    """Spans [kind, start, end, base, code, size, digits]; code has the votes to base 3."""
    digit = text.rlike("[0-9]")
    many = text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")
    may = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": many,
        "phone": F.contains(text, F.lit("+")),
        "tel": digit,
        "iban": digit,
        "ssn": text.rlike("[0-9]-[0-9]{2}-[0-9]"),
    }
    parts = []
    for base, patterns in ((True, PATTERNS), (False, MORE)):
        for kind, pattern in patterns.items():
            found = spans.matches(text, pattern, may[kind], _CONTEXT)
            if kind in _HOLDS:
                found = F.filter(found, _holding(_HOLDS[kind]))
            parts.append(F.transform(found, _describing(kind, base)))
    # What base spans already cover is not proposed again.
    return spans.apart(F.concat(*parts))


def _unpack(code: int) -> list[int]:
    out = []
    for _ in LABELERS:
        out.append(code % 3)
        code //= 3
    return out[::-1]


def reliabilities(votes: np.ndarray, kinds: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of a two-class model in which labelers vote
    independently given the class. votes: 0, 1, 2 (against, abstains, for). Gives
    the posterior of each row and table[labeler, class, vote]."""
    n_kinds = int(kinds.max()) + 1
    # Start: the majority of the votes cast.
    posterior = 1 / (1 + np.exp(-(votes.astype(float) - 1).sum(1)))
    table = np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        for j in range(votes.shape[1]):
            for v in range(3):
                table[j, :, v] = weight[:, votes[:, j] == v].sum(1)
        table += np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])  # a weak prior: labelers beat chance
        table /= table.sum(2, keepdims=True)
        log = np.zeros((2, len(counts)))
        for k in range(n_kinds):
            own = kinds == k
            prior = (weight[:, own].sum(1) + 1) / (weight[:, own].sum() + 2)
            log[:, own] += np.log(prior)[:, None]
        for j in range(votes.shape[1]):
            log += np.log(table[j][:, votes[:, j]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - posterior).max() < 1e-6:
            posterior = new
            break
        posterior = new
    return posterior, table


def span_classifier(features: np.ndarray, target: np.ndarray, counts: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a logistic model on soft labels, by Newton steps. features: 0 or 1."""
    x = np.concatenate([features, np.ones((len(features), 1))], 1).astype(float)
    w = np.zeros(x.shape[1])
    # Counts tell how often a pattern stands; their root keeps one kind from ruling.
    c = np.sqrt(counts.astype(float))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (c * (p - target)) + penalty * w
        h = (x * (c * (p * (1 - p) + 1e-6))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _one_hot(kind: int, code: int, size: int, share: int) -> np.ndarray:
    out = np.zeros(len(KINDS) + 3 * len(LABELERS) + 5 + 4)
    out[kind] = 1
    for j, v in enumerate(_unpack(code)):
        out[len(KINDS) + 3 * j + v] = 1
    out[len(KINDS) + 3 * len(LABELERS) + size] = 1
    out[len(KINDS) + 3 * len(LABELERS) + 5 + share] = 1
    return out


def find_personal_data(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. A row for each row: doc_id, spans [kind, start, end, base,
    chance], of the spans that stay. kind is the number in KINDS."""
    text = F.coalesce("text", F.lit(""))
    proposed = docs.select("doc_id", text.alias("text")).select("doc_id", _candidates(F.col("text")).alias("spans"))
    proposed = write_table(proposed, "pii")
    one = proposed.select(F.explode("spans").alias("s")).select("s.*")
    rows = one.groupBy("kind", "code", "size", "digits").agg(F.count("*").alias("n")).orderBy("kind", "code", "size", "digits").collect()
    width = len(KINDS) + 3 * len(LABELERS) + 5 + 4
    weights = np.zeros(width + 1)
    if rows:
        votes = np.array([_unpack(r["code"]) for r in rows])
        kinds, counts = np.array([r["kind"] for r in rows]), np.array([r["n"] for r in rows])
        posterior, _ = reliabilities(votes, kinds, counts)
        features = np.stack([_one_hot(r["kind"], r["code"], r["size"], r["digits"]) for r in rows])
        weights = span_classifier(features, posterior, counts)

    def table(a: int, b: int) -> Column:
        return F.array(*(F.lit(float(w)) for w in weights[a:b]))

    def chance(s: Column) -> Column:
        margin = F.lit(float(weights[-1])) + F.get(table(0, len(KINDS)), s["kind"])
        for j in range(len(LABELERS)):
            at = len(KINDS) + 3 * j
            vote = F.floor(s["code"] / 3 ** (len(LABELERS) - 1 - j)).cast("int") % 3
            margin = margin + F.get(table(at, at + 3), vote)
        at = len(KINDS) + 3 * len(LABELERS)
        margin = margin + F.get(table(at, at + 5), s["size"]) + F.get(table(at + 5, at + 9), s["digits"])
        return 1 / (1 + F.exp(-margin))

    judged = F.transform(
        "spans",
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), chance(s).alias("chance")),
    )
    return proposed.select("doc_id", F.filter(judged, lambda s: s["base"] | (s["chance"] >= 0.5)).alias("spans"))
