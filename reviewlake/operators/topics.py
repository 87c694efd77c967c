"""Topic rules with evidence: phrase matches, negation scope and fallback anchors, as column expressions.

The rules are plain regular expressions. What a rule matches, and where, comes
from the text between its matches; negators are counted among the words before
a match; anchors give way to the specific matches that they overlap.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.operators import sentiment
from reviewlake.operators.ranges import settled

#: Topics in order with their labels.
TOPICS = (
    ("cleanliness", "Cleanliness"),
    ("check_in", "Check-in experience"),
    ("staff_reception", "Staff or receptionist behaviour"),
    ("noise", "Noise"),
    ("facilities", "Facilities"),
    ("location", "Location"),
    ("room_condition", "Room condition"),
    ("value_for_money", "Value for money"),
)

#: Words that several rules share.
_WHO, _GOOD, _BAD = "host|manager|reception|receptionist|staff", "attentive|friendly|helpful|kind|lovely|polite|professional|responsive|welcoming", "aggressive|dismissive|impolite|rude|unfriendly|unhelpful|unprofessional|unresponsive"

#: Rules as (name, polarity, pattern, flags); N: negation before a match flips it, I: negation inside flips it.
RULES = (
    ("cleanliness.positive_condition", "positive", r"\b(?:clean|freshly cleaned|hygienic|immaculate|spotless|tidy)\b", "N"),
    ("cleanliness.negative_condition", "negative", r"\b(?:bad smell|bed ?bugs?|cockroaches?|dirty|dusty|filthy|grimy|mould|mouldy|mold|moldy|smelly|stained|stains?|unclean)\b", "N"),
    ("cleanliness.source_anchor", "source", r"\b(?:cleanliness|housekeeping|hygiene)\b", ""),
    ("check_in.positive_experience", "positive", r"\b(?:(?:easy|efficient|quick|seamless|simple|smooth)\s+check(?:-|\s)?in|check(?:-|\s)?in\s+(?:was\s+)?(?:easy|efficient|quick|seamless|simple|smooth))\b", "N"),
    ("check_in.no_problem", "positive", r"\bno problems?\s+check(?:ing)?(?:-|\s)?in\b", ""),
    ("check_in.negative_experience", "negative", r"\b(?:(?:chaotic|confusing|delayed|difficult|late|problematic|slow)\s+check(?:-|\s)?in|check(?:-|\s)?in\s+(?:delay|issue|problem)|locked out)\b", "N"),
    ("check_in.failed_access", "negative", r"\b(?:could not|couldn't)\s+check(?:-|\s)?in\b|\b(?:key(?:pad| code)?\s+(?:did not|didn't|would not|wouldn't)\s+work|no\s+check(?:-|\s)?in\s+instructions?)\b", ""),
    ("check_in.source_anchor", "source", r"\b(?:check(?:-|\s)?in|key code|keypad|self check(?:-|\s)?in)\b", ""),
    ("staff_reception.negated_positive_behaviour", "positive", rf"\b(?:{_WHO})\s+(?:were?\s+|was\s+)?not\s+(?:{_GOOD})\b", "NI"),
    ("staff_reception.negated_negative_behaviour", "negative", rf"\b(?:{_WHO})\s+(?:were?\s+|was\s+)?not\s+(?:{_BAD})\b", "NI"),
    ("staff_reception.positive_behaviour", "positive", rf"\b(?:(?:{_GOOD})\s+(?:{_WHO})|(?:{_WHO})\s+(?:were?\s+|was\s+)?(?:{_GOOD}))\b", "N"),
    ("staff_reception.negative_behaviour", "negative", rf"\b(?:(?:{_BAD})\s+(?:{_WHO})|(?:{_WHO})\s+(?:were?\s+|was\s+)?(?:{_BAD}))\b", "N"),
    ("staff_reception.absent", "negative", r"\b(?:absent|no|unavailable)\s+(?:reception|receptionist|staff)\b", ""),
    ("staff_reception.source_anchor", "source", rf"\b(?:{_WHO})\b", ""),
    ("noise.positive_condition", "positive", r"\b(?:peaceful|quiet|silent|soundproof|soundproofed)\b", "N"),
    ("noise.negative_condition", "negative", r"\b(?:construction noise|could not sleep|couldn't sleep|loud|music all night|noise|noisy|party noise|street noise|thin walls?|traffic noise)\b", "N"),
    ("facilities.positive_quality", "positive", r"\b(?:(?:excellent|good|great|modern|well[- ]maintained)\s+(?:amenities|facilities)|(?:fast|reliable)\s+(?:wi-?fi|wifi)|(?:wi-?fi|wifi)\s+(?:was\s+)?(?:fast|reliable|working|worked)|hot water|well[- ]equipped kitchen|working\s+(?:air conditioning|air[- ]?con|elevator|lift))\b", "N"),
    ("facilities.negative_quality", "negative", r"\b(?:(?:broken|outdated|poor)\s+(?:amenities|facilities)|(?:poor|slow|unreliable)\s+(?:wi-?fi|wifi)|(?:wi-?fi|wifi)\s+(?:did not|didn't|was not|wasn't)\s+work|broken\s+(?:elevator|lift)|cold shower)\b", ""),
    ("facilities.missing", "negative", r"\bno\s+(?:air conditioning|air[- ]?con|elevator|hot water|lift|wi-?fi|wifi)\b", ""),
    ("facilities.source_anchor", "source", r"\b(?:air conditioning|air[- ]?con|amenities|elevator|facilities|kitchen|laundry|lift|wi-?fi|wifi)\b", ""),
    ("location.positive_access", "positive", r"\b(?:central location|centrally located|close to|convenient location|easy access|excellent location|great location|near (?:a |the )?(?:bus|station|train)|perfect location|walking distance|well located)\b", "N"),
    ("location.negative_access", "negative", r"\b(?:bad location|difficult to find|dodgy neighbou?rhood|far from|hard to find|inconvenient location|isolated location|poor location|sketchy neighbou?rhood|unsafe area|unsafe location)\b", "N"),
    ("location.source_anchor", "source", r"\blocation\b", ""),
    ("room_condition.positive_condition", "positive", r"\b(?:(?:comfortable|large|modern|spacious|well[- ]maintained)\s+(?:bed|room)|good mattress|room\s+(?:in|was in)\s+(?:excellent|good)\s+condition)\b", "N"),
    ("room_condition.negative_condition", "negative", r"\b(?:(?:cramped|damp|dated|damaged|run[- ]down|small|tiny|worn)\s+room|broken\s+(?:bed|window)|leaking?|no window|peeling paint|poor ventilation|sagging mattress|uncomfortable\s+(?:bed|mattress))\b", ""),
    ("room_condition.source_anchor", "source", r"\b(?:bathroom|bed|mattress|room condition|ventilation|window)\b", ""),
    ("value_for_money.positive_value", "positive", r"\b(?:affordable|budget[- ]friendly|excellent value|good value|great value|reasonably priced|value for money|worth (?:it|the money|the price))\b", "N"),
    ("value_for_money.negative_value", "negative", r"\b(?:bad value|expensive|hidden fees?|not worth (?:it|the money|the price)|overpriced|poor value|rip[- ]?off)\b", ""),
    ("value_for_money.extra_charge", "negative", r"\b(?:extra charges?|unexpected charges?)\b", ""),
    ("value_for_money.source_anchor", "source", r"\b(?:charges?|cheap|cost|fees?|price|value for money)\b", ""),
)
#: Negators, the words and marks that end a clause, and how far back a negator reaches.
NEGATORS = frozenset("barely cannot couldn't didn't hardly isn't lacking never no not wasn't weren't without wouldn't".split())
CLAUSE_END = r"(?i)[.!?;:\n]|(?<![A-Za-z0-9_])(?:although|but|however|though|yet)(?![A-Za-z0-9_])"
REACH_CHARS, REACH_WORDS = 96, 4
_WORD = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"


def spelled(pattern: str) -> str:
    """The pattern with ASCII word boundaries that Java and Python read alike."""
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    return pattern.replace(r"\b", edge)


_OTHER = {"positive": "negative", "negative": "positive"}
CHANNELS = (("negative_text", "negative"), ("positive_text", "positive"))


def mentions(topic: str, text: Column) -> Column:
    """Whether any rule of the topic matches, whatever its polarity."""
    whole = "|".join(spelled(p) for name, _, p, _ in RULES if name.split(".")[0] == topic)
    return F.translate(F.coalesce(text, F.lit("")), "’", "'").rlike(f"(?i)(?:{whole})")


# The expressions are written as SQL: thousands of column calls would take longer than most queries.


def _let(value: str, name: str, then: str) -> str:
    """``then``, in which ``name`` stands for a value that is worked out once."""
    return f"transform(array({value}), {name} -> {then})[0]"


def _literal(text: str) -> str:
    return f'r"{text}"'


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, {_literal(_WORD)}, 0)"


_IS_NEGATOR = f"w -> w IN ({', '.join(map(_literal, sorted(NEGATORS)))})"


def _negated(text: str, start: str) -> str:
    """Whether a negator reaches a place: an odd number among the last words of its clause, unless they end in "not only"."""
    before = f"substring({text}, greatest(1, {start} - {REACH_CHARS} + 1), least({REACH_CHARS}, {start}))"
    clause = f"regexp_replace({before}, {_literal(f'(?s)^.*(?:{CLAUSE_END})')}, '')"
    odd = f"NOT coalesce(try_element_at(v, -2) = 'not' AND try_element_at(v, -1) = 'only', false) AND size(filter(v, {_IS_NEGATOR})) % 2 = 1"
    return _let(_words(clause), "u", _let(f"slice(u, greatest(1, size(u) - {REACH_WORDS} + 1), {REACH_WORDS})", "v", odd))


#: A noncharacter, which low texts don't hold.
_MARK = "\uffff"
_PLACES = "array<struct<start: int, `end`: int>>"


def _places(hit: str) -> str:
    """(start, end) of each match of a rule that hit, from the lengths of what lies between matches and of the matches, in turn."""
    turns = f"zip_with(slice(split({hit}.cut, '{_MARK}', -1), 1, size({hit}.matches)), {hit}.matches, (g, x) -> named_struct('gap', length(g), 'match', length(x)))"
    step = "(s, x) -> named_struct('at', s.at + x.gap + x.match, 'out', concat(s.out, array(named_struct('start', s.at + x.gap, 'end', s.at + x.gap + x.match))))"
    return f"aggregate({turns}, named_struct('at', 0, 'out', cast(array() AS {_PLACES})), {step}, s -> s.out)"


def _hit(rule: tuple, channel: str, own: str) -> str:
    """One rule in one channel: its matches, the text with a mark in place of each, and what decides about them."""
    name, polarity, pattern, flags = rule
    base, text, low, p = own if polarity == "source" else polarity, f"__{channel}", f"__{channel}_low", _literal(_searched(pattern))
    # Cut at a mark later, not at the pattern here, which split() would compile for each text.
    return (
        f"named_struct('topic', '{name.split('.')[0]}', 'rule', '{name}', 'field', '{channel}', 'later', {str(channel != 'positive_text').lower()}, 'base', '{base}', 'other', '{_OTHER[base]}', 'flips', {str('N' in flags).lower()}, 'inside', {str('I' in flags).lower()}, "
        f"'text', {text}, 'low', {low}, 'matches', coalesce(regexp_extract_all({low}, {p}, 0), cast(array() AS array<string>)), 'cut', regexp_replace({low}, {p}, '{_MARK}'))"
    )


def _hits() -> str:
    """All rules that match. Most reviews have few topics: of the others no rule is tried alone."""
    of = []
    for topic, _ in TOPICS:
        rules = [r for r in RULES if r[0].split(".")[0] == topic]
        any_ = _literal("|".join(f"(?:{_searched(p)})" for _, _, p, _ in rules))
        of.append(f"if({' OR '.join(f'coalesce(__{c}_low RLIKE {any_}, false)' for c, _ in CHANNELS)}, array({', '.join(_hit(r, c, own) for r in rules for c, own in CHANNELS)}), NULL)")
    return f"filter(flatten(array_compact(array({', '.join(of)}))), h -> size(h.matches) > 0)"


def _found() -> str:
    """All matches, as evidence with what orders it: positive text first, then place and rule. Written once for all rules: what is planned stays small."""
    inside = f"h.inside AND exists({_words('substring(h.low, m.start + 1, m.`end` - m.start)')}, {_IS_NEGATOR})"
    said = "named_struct('later', h.later, 'start', m.start, 'rule', h.rule, 'end', m.`end`, 'field', h.field, 'text', substring(h.text, m.start + 1, m.`end` - m.start), 'polarity', if(flip, h.other, h.base), 'negated', flip, 'topic', h.topic)"
    flips = f"h.flips AND ({_negated('h.low', 'm.start')} OR {inside})"
    return f"flatten(transform({_hits()}, h -> transform({_places('h')}, m -> {_let(flips, 'flip', said)})))"


def _searched(pattern: str) -> str:
    """The pattern for texts in lower case. Rules begin with a boundary and a letter or digit, so only what stands before matters there."""
    begin = r"\b"
    return "(?<![A-Za-z0-9_])" + spelled(pattern.removeprefix(begin)) if pattern.startswith(begin + "(?:") or pattern[2:3].isalnum() else spelled(pattern)


#: Of a topic's matches f those that stay: an anchor goes that overlaps a specific match which begins before it, or with it and is longer.
_ANCHOR = "{}.rule LIKE '%.source_anchor'"
_PLACE = "struct({0}.start, {0}.start - {0}.`end`, {0}.rule)"
_OVER = f"NOT {_ANCHOR.format('x')} AND x.field = a.field AND x.start < a.`end` AND a.start < x.`end` AND {_PLACE.format('x')} < {_PLACE.format('a')}"
_ACCEPTED = f"array_sort(filter(f, a -> NOT {_ANCHOR.format('a')} OR NOT exists(f, x -> {_OVER})))"


@functools.cache
def _topics(evidence: bool) -> str:
    polarity = _let("array_distinct(transform(e, m -> m.polarity))", "p", "if(size(p) = 1, p[0], 'mixed')")
    fields = f"'topic', t, 'polarity', {polarity}"
    if evidence:
        kept = ", ".join(f"'{k}', m.`{k}`" for k in ("rule", "field", "start", "end", "text", "polarity", "negated"))
        fields += f", 'terms', array_distinct(transform(e, m -> lower(m.text))), 'fields', array_distinct(transform(e, m -> m.field)), 'evidence', transform(e, m -> named_struct({kept}))"
    one = _let("filter(found, x -> x.topic = t)", "f", _let(_ACCEPTED, "e", f"if(size(e) > 0, named_struct({fields}), NULL)"))
    order = f"array({', '.join(repr(t) for t, _ in TOPICS)})"
    return f"array_compact({_let(_found(), 'found', f'transform({order}, t -> {one})')})"


def _texts() -> tuple[dict[str, Column], dict[str, Column]]:
    """The substantive texts of the channels, and these in lower case: ASCII letters alone, so that places stay as they are."""
    texts = {f"__{c}": F.when(F.col(f"{c.removesuffix('_text')}_state") == "substantive", F.col(c)) for c, _ in CHANNELS}
    return texts, {f"__{c}_low": F.translate(f"__{c}", ascii_uppercase + "’" + _MARK, ascii_lowercase + "' ") for c, _ in CHANNELS}


def with_topics(classified: DataFrame, evidence: bool = False) -> DataFrame:
    """Adds ``topics`` to rows that have text states, in definition order, each with its polarity; with their terms, fields and evidence if asked for.

    Everything is expressions over the substantive texts. A rule's matches are
    found by place; a match is negated within its clause; an anchor gives way
    to a specific match that it overlaps.
    """
    texts, low = _texts()
    return classified.withColumns(texts).withColumns(low).withColumn("topics", F.expr(_topics(evidence))).drop(*texts, *low)


#: Tasks over which the rows of one text are spread, and texts that are few enough to be sent to the rows.
SPREAD, FEW = 16, 20_000


def with_topics_once(classified: DataFrame, keys: tuple[str, ...], evidence: bool = False, spread: int = SPREAD) -> DataFrame:
    """with_topics() for reviews that often say the same: distinct texts are classified once, written, and joined with their rows."""
    texts, low = _texts()
    # A substantive text is never empty, so an empty one can stand for none: plain equality serves for the joins.
    rows = classified.withColumns({k: F.coalesce(c, F.lit("")) for k, c in texts.items()})
    met = _met(rows, (*texts,), keys, spread, lambda said: said.withColumns(low).select(*texts, F.expr(_topics(evidence)).alias("topics")))
    return met.select(*classified.columns, F.coalesce("topics", F.array().cast(met.schema["topics"].dataType)).alias("topics"))


def classified_once(reviews: DataFrame, keys: tuple[str, ...], evidence: bool = False, spread: int = SPREAD) -> DataFrame:
    """with_topics() of with_sentiment() for reviews that often say the same: of distinct texts the states, too, are worked out once."""
    own = {f"__own_{c}": c for c, _ in CHANNELS}
    # No text and an empty one have the same state and no topics.
    rows = reviews.withColumns({k: F.coalesce(c, F.lit("")) for k, c in own.items()})
    found = lambda said: with_topics(sentiment.with_states(said.withColumnsRenamed(own)), evidence).withColumnsRenamed({c: k for k, c in own.items()})
    met = _met(rows, (*own,), keys, spread, found)
    none = F.array().cast(met.schema["topics"].dataType)
    states = [F.coalesce(c, F.lit("empty")).alias(c) for c in ("positive_state", "negative_state")]
    stated = sentiment.labelled(met.select(*reviews.columns, *states, F.coalesce("topics", none).alias("topics")))
    return stated.select(*[c for c in stated.columns if c != "topics"], "topics")


def _met(rows: DataFrame, texts: tuple[str, ...], keys: tuple[str, ...], spread: int, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with what ``found`` tells of their distinct texts; nulls where all texts are empty.

    Few texts are sent to the rows. Many are shuffled: the rows of a frequent
    text are then dealt by their ``keys`` over ``spread`` parts; rows without
    any text meet nobody.
    """
    said = F.lit(False)
    for k in texts:
        said |= F.col(k) != ""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # Written: a filter on topics would else be planned beneath the distinct, on every row, and each reader would classify again.
    known = settled(found(rows.filter(said).select(*texts).distinct().repartition(tasks, *texts)))
    if known.count() <= FEW:
        return rows.join(F.broadcast(known), [*texts], "left")
    part = F.xxhash64(*keys)
    rows = rows.withColumn("__part", F.when(said, F.pmod(part, F.lit(spread))).otherwise(part))
    on = ["__part", *texts]
    met = rows.filter(said).select(*on).distinct().join(known, [*texts])
    return rows.join(met, on, "left")


def topic_dimension(spark) -> DataFrame:
    return spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(TOPICS)], "topic_ordinal int, topic string, topic_label string")


def unpivoted(rows: DataFrame, keep: Iterable[str]) -> DataFrame:
    """One row per review and topic."""
    # The outer form: before the other Spark infers a filter, in which all topics would be worked out once more.
    return rows.select(*keep, F.explode_outer("topics").alias("t")).filter("t IS NOT NULL").select(*keep, F.col("t.topic").alias("topic"), F.col("t.polarity").alias("polarity"))
