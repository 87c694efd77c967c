"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Everything on the data is built-in DataFrame functions. The votes of a
document form one of at most 3 ** len(rules()) patterns; only the counts of
patterns reach the driver, where a few lines of arithmetic fit the accuracies,
and the patterns' posteriors are joined back.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import BLANKS, settled

#: Words of a window whose repetition counts; words of a block whose distinct ones count, so that the share doesn't fall with a text's length.
WINDOW, BLOCK = 3, 100
#: Words that only mark an item of a list.
MARKS = ("|", "-", "*", "•", "·", ">", "#", "–", "—", "/", "~", "=")
#: A document is kept from this posterior probability of good quality.
KEEP_AT = 0.5
#: The hash of the window at place i.
_HASH = "xxhash64(__words[i], __words[i + 1], __words[i + 2])"


def _per(count: str, of: str) -> Column:
    return F.col(f"__vote.{count}") / F.greatest(F.col(f"__vote.{of}"), F.lit(1))


def rules() -> list[tuple[str, Column, Column]]:
    """The rules over the struct __vote of measures: each votes bad, votes good or abstains."""
    symbols, shouts, capitals = _per("n_symbols", "n_words"), _per("n_shouts", "n_words"), _per("n_capitals", "word_chars")
    repeats, lines, distinct = _per("n_repeat_words", "n_words"), _per("n_dup_lines", "n_lines"), _per("n_distinct_words", "n_words")
    marks = _per("n_marks", "n_words")
    mean, plain = _per("word_chars", "n_words"), _per("n_plain_chars", "word_chars")
    return [
        ("symbol_density", symbols > 0.25, symbols < 0.05),
        ("plain_letters", plain < 0.75, plain > 0.9),
        ("shouting_marks", shouts > 0.2, shouts < 0.05),
        ("capital_share", capitals > 0.4, capitals < 0.15),
        ("repeated_windows", repeats > 0.4, repeats < 0.15),
        ("distinct_words", distinct < 0.3, distinct > 0.5),
        ("repeated_lines", lines > 0.5, lines < 0.2),
        ("list_marks", marks > 0.15, marks < 0.05),
        ("word_length", (mean < 2) | (mean > 15), (mean >= 3) & (mean <= 10)),
    ]


def _removed(t: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(t, pattern, "")).cast("long")


def with_measures(docs: DataFrame, text: str = "text", out: str = "__measures") -> DataFrame:
    """docs and one struct column of the counts of its texts; a null text counts as empty.

    The fields: n_words; word_chars (code points in words); n_symbols; n_lines
    (lines with a word); n_dup_lines (those equal to an earlier one);
    n_repeat_words (words in three-word windows that the text holds twice or
    more); n_shouts (exclamation marks); n_capitals; n_plain_chars (letters,
    digits and common punctuation); n_distinct_words (those of each
    block of BLOCK words, added up). Texts are taken whole.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, BLANKS, -1), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    size = lambda c: F.size(c).cast("long")
    step = docs.withColumn("__words", words).withColumn("__lines", lines)
    # One long per window: high bits of its hash, low bits its place. Sorted, equal windows are neighbours.
    step = step.withColumn("__bits", F.expr("length(bin(size(__words)))")).withColumn("__keys", F.expr("""
        sort_array(if(size(__words) < 3, cast(array() as array<bigint>), transform(sequence(0, size(__words) - 3),
            i -> shiftleft(shiftrightunsigned(@, __bits), __bits) | cast(i as bigint))))""".replace("@", _HASH)))
    place = "cast({0} & (shiftleft(1L, __bits) - 1) as int)"
    alike, equal = "shiftrightunsigned(__keys[j] ^ __keys[j - 1], __bits) = 0", " and ".join(f"__words[{place.format('__keys[j]')} + {k}] = __words[{place.format('__keys[j - 1]')} + {k}]" for k in range(WINDOW))
    # 0: differs from the window before; 1: equals it; 2: has its hash, but other words. Then equal windows need not be neighbours, and the words themselves are sorted.
    step = step.withColumn("__same", F.expr(f"transform(if(size(__keys) < 2, cast(array() as array<int>), sequence(1, size(__keys) - 1)), j -> if({alike}, if({equal}, 1, 2), 0))"))
    step = step.withColumn("__spelled", F.expr("if(array_contains(__same, 2), array_sort(transform(sequence(0, size(__words) - 3), i -> struct(struct(__words[i] as a, __words[i + 1] as b, __words[i + 2] as c) as w, i as i))), null)"))
    step = step.withColumn("__same", F.expr("if(__spelled is null, __same, transform(sequence(1, size(__spelled) - 1), j -> if(__spelled[j].w = __spelled[j - 1].w, 1, 0)))"))
    step = step.withColumn("__found", F.expr(f"""
        sort_array(transform(filter(if(size(__same) < 1, cast(array() as array<int>), sequence(0, size(__same))),
            j -> coalesce(get(__same, j - 1) = 1, false) or coalesce(get(__same, j) = 1, false)),
            j -> if(__spelled is null, {place.format('__keys[j]')}, __spelled[j].i)))"""))
    covered = F.expr("aggregate(transform(__found, (p, k) -> cast(least(3, coalesce(get(__found, k + 1) - p, 3)) as bigint)), 0L, (a, x) -> a + x)")
    fields = {
        "n_words": size("__words"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": _removed(t, r"[^#*$%&|<>]+"),
        "n_lines": size("__lines"),
        "n_dup_lines": size("__lines") - size(F.array_distinct("__lines")),
        "n_repeat_words": covered,
        "n_shouts": _removed(t, "[^!]+"),
        "n_capitals": _removed(t, r"\P{Lu}+"),
        "n_plain_chars": F.length(F.array_join("__words", "")).cast("long") - _removed(t, r"[^#*$%&|<>!~^={}\[\]\\/_+@]+"),
        "n_marks": size(F.filter("__words", lambda w: w.isin(*MARKS))),
        "n_distinct_words": F.expr(f"aggregate(if(size(__words) = 0, cast(array() as array<int>), sequence(1, size(__words), {BLOCK})), 0L, (n, i) -> n + size(array_distinct(slice(__words, i, {BLOCK}))))"),
    }
    return step.withColumn(out, F.struct(*[c.alias(k) for k, c in fields.items()])).drop("__words", "__lines", "__bits", "__keys", "__same", "__spelled", "__found")


def _pattern(df: DataFrame, measured: str, out: str) -> DataFrame:
    each = [F.when(bad, F.lit("-")).when(good, F.lit("+")).otherwise(F.lit("0")) for _, bad, good in rules()]
    return df.withColumn("__vote", F.col(measured)).withColumn(out, F.concat(*each)).drop("__vote")


def base_failed(measured: str) -> Column:
    m = lambda k: F.col(f"{measured}.{k}")
    return (m("n_words") < 50) | (100 * m("n_repeat_words") > 50 * m("n_words"))


def fit(counts: Sequence[tuple[str, int]], rounds: int = 25) -> dict[str, float]:
    """Posterior probability of good quality for each vote pattern, by expectation-maximisation.

    Each rule has, for good and for bad documents, its own chances to vote
    good, bad or abstain. The start is the count of bad votes: none, one, more.
    Smoothing keeps unseen votes possible; no documents: no patterns.
    """
    good = {p: (0.98, 0.5)[p.count("-")] if p.count("-") < 2 else 0.02 for p, _ in counts}
    width, total = max((len(p) for p in good), default=0), sum(n for _, n in counts)
    for _ in range(rounds):
        share = [sum(n * good[p] for p, n in counts), sum(n * (1 - good[p]) for p, n in counts)]
        prior = [(s + 1) / (total + 2) for s in share]
        chance = [[{v: (sum(n * (good[p] if k == 0 else 1 - good[p]) for p, n in counts if p[r] == v) + 0.5) / (share[k] + 1.5) for v in "-0+"} for r in range(width)] for k in (0, 1)]
        for p in good:
            a, b = (math.log(prior[k]) + sum(math.log(chance[k][r][v]) for r, v in enumerate(p)) for k in (0, 1))
            good[p] = 1 / (1 + math.exp(min(500, b - a)))
    return good


def _posteriors(spark: SparkSession, fitted: dict[str, float], pattern: str) -> DataFrame:
    """(pattern, quality): one row a pattern, hence few enough to broadcast at any size of the corpus."""
    said = F.from_json(F.lit(json.dumps([{"p": p, "q": q} for p, q in sorted(fitted.items())])), "array<struct<p: string, q: double>>")
    return spark.range(1).select(F.explode(said).alias("x")).select(F.col("x.p").alias(pattern), F.col("x.q").alias("quality"))


def _counts(patterns: DataFrame) -> list[tuple[str, int]]:
    """At most 3 ** len(rules()) rows."""
    return sorted((r["pattern"], r["n"]) for r in patterns.groupBy("pattern").agg(F.count("*").alias("n")).collect())


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the measures, base_failed, pattern, quality (posterior) and kept.

    A null or empty text has no words and fails the base rules. Repeated rows
    are judged alike; an empty table gives no rows; other columns are ignored.
    """
    m = with_measures(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "__m")
    wide = _pattern(m, "__m", "pattern").select("doc_id", "__m.*", "pattern", base_failed("__m").alias("base_failed"))
    rows = settled(wide)
    found = rows.join(F.broadcast(_posteriors(docs.sparkSession, fit(_counts(rows)), "pattern")), "pattern")
    return found.select(*rows.columns, "quality", (~F.col("base_failed") & (F.col("quality") >= KEEP_AT)).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with all their columns; rejected documents go. Texts are measured once: the rows are written with their votes."""
    columns = docs.columns
    m = _pattern(with_measures(docs, text, "__m"), "__m", "__pattern")
    rows = settled(m.select(*columns, "__pattern", base_failed("__m").alias("__failed")))
    found = rows.join(F.broadcast(_posteriors(docs.sparkSession, fit(_counts(rows.select(F.col("__pattern").alias("pattern")))), "__pattern").withColumnRenamed("quality", "__quality")), "__pattern")
    return found.filter(~F.col("__failed") & (F.col("__quality") >= KEEP_AT)).select(*columns)
