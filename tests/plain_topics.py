"""The topic classifier in plain Python, a review at a time: what the column expressions must come to."""

from __future__ import annotations

import re
from collections.abc import Iterator

from reviewlake.operators.topics import CLAUSE_END, NEGATORS, REACH_CHARS, REACH_WORDS, RULES, TOPICS, spelled

_CLAUSE_END = re.compile(CLAUSE_END)
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_COMPILED = [(name, polarity, re.compile(spelled(p), re.I), flags) for name, polarity, p, flags in RULES]
_OTHER = {"positive": "negative", "negative": "positive"}


def _negated(text: str, start: int) -> bool:
    before = text[max(0, start - REACH_CHARS) : start]
    ends = [m.end() for m in _CLAUSE_END.finditer(before)]
    words = [w.lower() for w in _WORD.findall(before[ends[-1] if ends else 0 :])][-REACH_WORDS:]
    return words[-2:] != ["not", "only"] and sum(w in NEGATORS for w in words) % 2 == 1


def _matches(text: str, channel: str, own: str) -> Iterator[tuple]:
    searched = text.replace("’", "'")
    for name, polarity, pattern, flags in _COMPILED:
        for m in pattern.finditer(searched):
            flips = "N" in flags and (_negated(searched, m.start()) or "I" in flags and any(w.lower() in NEGATORS for w in _WORD.findall(m[0])))
            base = own if polarity == "source" else polarity
            yield name, channel, m.start(), m.end(), text[m.start() : m.end()], _OTHER[base] if flips else base, flips


def classify(positive: str | None, negative: str | None) -> list[dict]:
    """Topics of one review, in definition order, each with its polarity and evidence.

    An anchor that overlaps an already accepted specific match is dropped; as
    matches are taken by channel, start and length, an anchor that begins first
    stays. None stands for a channel without substance.
    """
    found: dict[str, list[tuple]] = {}
    for channel, own, text in (("negative_text", "negative", negative), ("positive_text", "positive", positive)):
        for m in _matches(text, channel, own) if text else ():
            found.setdefault(m[0].split(".")[0], []).append(m)
    out = []
    for topic, _ in TOPICS:
        accepted: list[tuple] = []
        for m in sorted(found.get(topic, ()), key=lambda m: (m[1], m[2], m[2] - m[3], m[0])):
            anchor = m[0].endswith(".source_anchor")
            if not (anchor and any(x[1] == m[1] and not x[0].endswith(".source_anchor") and x[2] < m[3] and m[2] < x[3] for x in accepted)):
                accepted.append(m)
        if accepted:
            accepted.sort(key=lambda m: (m[1] != "positive_text", m[2], m[0]))
            polarities = {m[5] for m in accepted}
            out.append({
                "topic": topic,
                "polarity": polarities.pop() if len(polarities) == 1 else "mixed",
                "terms": list(dict.fromkeys(m[4].lower() for m in accepted)),
                "fields": list(dict.fromkeys(m[1] for m in accepted)),
                "evidence": [{"rule": m[0], "field": m[1], "start": m[2], "end": m[3], "text": m[4], "polarity": m[5], "negated": m[6]} for m in accepted],
            })
    return out
