"""Personal data by candidate generation and gradient boosting, in built-in DataFrame functions.

High-recall patterns propose spans that may overlap. The four base kinds hold
by their own checks (parts, digits, Luhn); the spans of the further kinds are
scored by boosted trees over their format and context, and a threshold for each
kind, chosen on held-out examples, selects those to redact.
"""

from __future__ import annotations

import functools
import math
import random
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.llm import boosting

#: Base kinds in listed order. A match begins where its run of characters begins or the last match ended, so no text is read twice.
BASE = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9]){11,}+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: Further kinds: their spans stay if the trees say so.
EXTRA = (
    ("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("local_phone", r"(?<![0-9+])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"),
    ("number", r"(?<![0-9.,$€£-])[0-9]{8,11}(?![0-9]|[.,][0-9])"),
)
KINDS = BASE + EXTRA
FEATURES = ("kind", "length", "digits", "upper", "separators", "cue", "money", "code", "letter_before", "quoted")
#: Characters of context on the left of a span, and labelled examples for training and for calibration.
CONTEXT, EXAMPLES = 40, 600

#: Words in front of a span that speak for, and against, personal data.
CUES = r"(?i)(?:\b(?:call|phone|tel|telephone|mobile|cell|fax|contact|ssn|social security|passport|iban|account|acct|member|customer|patient|tax|id|no)\b)[^\n]{0,12}$"
MONEY = r"(?i)(?:[$€£]|\b(?:usd|eur|gbp|price|total|cost|sum|about|over|nearly)\b)[\x20]*$"
CODE = r"(?i)(?:\b(?:isbn|sku|version|build|order|ticket|ref|serial|model|port|commit|hash|token|key)\b|[#=:_/])[^\n]{0,4}$"
#: Precision that the threshold of each kind must reach on held-out examples.
PRECISION = 0.95
#: Words in front of written examples: of personal data, of nothing in particular, and of look-alikes; first those to learn from, then others to be judged by.
LEARNT = (
    ("call me at ", "my phone: ", "tel ", "SSN ", "passport no. ", "IBAN ", "account number ", "patient id ", "contact: "), ("the ", "and then ", "we met. ", "is ", ""),
    ("order #", "version ", "ISBN ", "build ", "ref=", "serial ", 'token = "', "cost $", "total ", "sku: ", "commit "),
)
UNSEEN = (
    ("ring my mobile ", "reach us by fax: ", "her customer no ", "tax id: ", "member ", "social security ", "Telephone - ", "cell: "), ("a ", "so it was ", "; ", "(", "und "),
    ("port ", "model ", "hash:", "about ", "€", "key=", "ticket ", "v/", "price "),
)


def features(kind: int, span: str, before: str) -> list[float]:
    """What the trees see of one candidate; the Spark expressions below say the same."""
    found = lambda pattern, text: float(bool(re.search(pattern, text)))
    return [float(kind), float(len(span)), float(len(re.sub(r"[^0-9]", "", span))), float(len(re.sub(r"[^A-Z]", "", span))), float(len(re.sub(r"[^\x20().-]", "", span))), found(CUES, before), found(MONEY, before), found(CODE, before), found(r"[A-Za-z]$", before), found("[\"'`]$", before)]


def _columns(kind: int, span: Column, before: Column) -> list[Column]:
    size = lambda pattern: F.length(F.regexp_replace(span, pattern, "")).cast("double")
    found = lambda pattern: before.rlike(pattern).cast("double")
    return [F.lit(float(kind)), F.length(span).cast("double"), size("[^0-9]"), size("[^A-Z]"), size(r"[^\x20().-]"), found(CUES), found(MONEY), found(CODE), found("[A-Za-z]$"), found("[\"'`]$")]


def examples(n: int, seed: int, words: tuple = LEARNT) -> list[tuple[list[float], int]]:
    """Labelled candidates written by rule: personal data after cues or in its usual form, look-alikes after other words."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    shape = {
        4: lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        5: lambda: r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"]),
        6: lambda: r.choice(["DE", "FR", "GB", "ES"]) + digits(2) + digits(r.randint(14, 20)),
        7: lambda: digits(r.randint(8, 11)),
    }
    good, plain, bad = words
    out = []
    for _ in range(n):
        k = r.choice(list(shape))
        group = r.random()
        before, label = (r.choice(good), 1) if group < 0.4 else (r.choice(bad), 0) if group < 0.75 else (r.choice(plain), int(k in (4, 5, 6)))
        if k == 6 and label == 0 and r.random() < 0.7:
            span = r.choice(["AB", "XK", "QZ"]) + digits(2) + "".join(r.choice("ABCDEFGHJK0123456789") for _ in range(r.randint(11, 28)))
        else:
            span = shape[k]()
        out.append((features(k, span, before), label))
    return out


@functools.lru_cache(maxsize=1)
def model() -> tuple[list, float, float]:
    """(trees, slope, offset), fitted to EXAMPLES written examples and calibrated on as many others."""
    train, held = examples(EXAMPLES, 1), examples(EXAMPLES, 2)
    trees = boosting.fit([x for x, _ in train], [y for _, y in train])
    return trees, *boosting.calibrate([boosting.value(trees, x) for x, _ in held], [y for _, y in held])


def probability(row: list[float]) -> float:
    trees, slope, offset = model()
    return 1 / (1 + math.exp(-(boosting.value(trees, row) * slope + offset)))


@functools.lru_cache(maxsize=1)
def thresholds() -> dict[str, float]:
    """For each further kind the least probability, halfway to the next example's, from which held-out examples are right in PRECISION of all cases; above 1 if there is none."""
    held = [(probability(x), int(x[0]), y) for x, y in examples(EXAMPLES, 3)]
    out = {}
    for name, _ in EXTRA:
        own = sorted(((p, y) for p, k, y in held if KINDS[k][0] == name), reverse=True)
        right, best = 0, 1.1
        for n, (p, y) in enumerate(own, 1):
            right += y
            if right >= PRECISION * n and (n == len(own) or own[n][0] < p):
                best = (p + own[n][0]) / 2 if n < len(own) else p
        out[name] = best
    return out


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _luhn(span: Column) -> Column:
    each = F.transform(F.split(F.reverse(_digits(span)), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, span: Column, before: Column) -> Column:
    """Whether a match of the kind counts."""
    n = F.length(_digits(span))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(span, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (p.cast("decimal(38,0)") <= 255))
    if kind == "card":
        return n.between(12, 19) & _luhn(span)
    if kind == "phone":
        return n.between(9, 15)
    trees, slope, offset = model()
    k = [name for name, _ in KINDS].index(kind)
    odds = boosting.expression(trees, _columns(k, span, before))
    return 1 / (1 + F.exp(-(odds * slope + offset))) >= thresholds()[kind] - 1e-9


def _located(df: DataFrame, text: str, k: int, pattern: str, out: str) -> DataFrame:
    """df with an array of (start, kind, end) of the matches of one kind that count, by code points, end exclusive.

    Matches and the texts between them alternate, so running sums of their
    lengths are the places. Only texts with a match are taken apart.
    """
    name = KINDS[k][0]
    df = df.withColumn("__m", F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    df = df.withColumn("__gaps", F.when(F.size("__m") > 0, F.transform(F.split(F.col(text), pattern, -1), F.length)).otherwise(F.expr("cast(array() as array<int>)")))
    df = df.withColumn("__starts", F.expr("""aggregate(zip_with(slice(__gaps, 1, size(__m)), __m, (g, x) -> named_struct('g', g, 'n', length(x))),
        named_struct('at', 0, 'starts', cast(array() as array<int>)),
        (a, x) -> named_struct('at', a.at + x.g + x.n, 'starts', concat(a.starts, array(a.at + x.g)))).starts"""))
    spans = F.zip_with("__m", "__starts", lambda m, s: F.struct(s.alias("start"), F.lit(k).alias("kind"), (s + F.length(m)).alias("end"), m.alias("span")))
    before = lambda s: F.substring(F.col(text), F.greatest(s["start"] + 1 - CONTEXT, F.lit(1)), F.least(s["start"], F.lit(CONTEXT)))
    kept = F.transform(F.filter(spans, lambda s: _holds(name, s["span"], before(s))), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return df.withColumn(out, F.when(F.size("__m") > 0, kept).otherwise(F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)"))).drop("__m", "__gaps", "__starts")


def _said(spans: str) -> Column:
    names = F.array(*[F.lit(n) for n, _ in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: counts of the base kinds, their digest, and all spans.

    Spans are kind:start:end by start and then kind as listed, comma-joined. A
    null text counts as empty; a text without personal data has zero counts
    and an empty list. Texts are taken whole. Repeated rows give the same
    result; other columns are ignored; an empty table gives no rows.
    """
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    for k, (name, pattern) in enumerate(KINDS):
        df = _located(df, "text", k, pattern, f"__{name}")
    base, every = [F.col(f"__{n}") for n, _ in BASE], [F.col(f"__{n}") for n, _ in KINDS]
    df = df.withColumn("__base", F.array_sort(F.concat(*base))).withColumn("__all", F.array_sort(F.concat(*every)))
    return df.select("doc_id", *[F.size(f"__{n}").cast("long").alias(f"n_{n}") for n, _ in BASE], F.sha2(_said("__base"), 256).alias("base_sha256"), _said("__all").alias("spans"), F.size("__all").cast("long").alias("n_spans"), F.col("__all").alias("found"), "text")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with every found span replaced by <KIND>; of overlapping spans the first covers the others."""
    names = F.array(*[F.lit(n.upper()) for n, _ in KINDS])
    step = F.expr("named_struct('at', 0, 'out', '')")
    found = find(docs, doc_id, text)
    folded = F.aggregate("found", step, lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit("<"), names[s["kind"]], F.lit(">"))).alias("out")))
    return found.withColumn("__r", folded).select("doc_id", F.concat("__r.out", F.expr("substring(text, __r.at + 1)")).alias("text"))
