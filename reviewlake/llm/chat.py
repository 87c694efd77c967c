"""Quotation linking: replies find the messages they quote, and conversations are built without the quotes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import checkpointed, settled
from reviewlake.operators.ranges import carried, numbered, ranged, with_previous

QUOTED = re.compile(r"^[ \t]*((?:>[ \t]?)+)(.*)$")
#: A line that introduces the quote right below it.
ATTRIBUTION = re.compile(r"^(?:on\b.*\bwrote|le\b.*\ba écrit|am\b.*\bschrieb.*|el\b.*\bescribió|.{1,80}\b(?:wrote|said|writes))\s*:\s*$", re.I)
#: Where a sentence ends: at a mark and white space, or at a full-width mark.
SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？｡])")
MOST_ROUNDS = 60


def normalised(text: str) -> str:
    return " ".join(re.findall(r"\w+", text.lower()))


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(the message without quotes, its quoted passages as (level, text)).

    A line's level is its number of leading > marks; neighbouring lines of one
    level are one passage. Attribution lines above a quote go with it.
    """
    own: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    level = 0
    for line in (text or "").split("\n"):
        m = QUOTED.match(line)
        if not m:
            own.append(line)
            level = 0
            continue
        if level == 0:
            while own and not own[-1].strip():
                own.pop()
            if own and ATTRIBUTION.match(own[-1].strip()):
                own.pop()
        now = m[1].count(">")
        if now != level:
            quotes.append((now, []))
        level = now
        if ATTRIBUTION.match(m[2].strip()) or not m[2].strip():
            level = -1  # the next quoted line begins a passage of its own
        else:
            quotes[-1][1].append(m[2])
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n"), [(k, "\n".join(x)) for k, x in quotes if x]


def _hash(text: str) -> int | None:
    """The hash of a passage by its words; by its signs if it has no words; none if it is blank."""
    n = normalised(text) or "".join(text.split())
    return xxhash.xxh64_intdigest(n) - (1 << 63) if n else None


def _parts(text: str) -> Iterator[str]:
    """The whole text, its paragraphs, its lines, and the sentences of its paragraphs and lines (one may go over lines or end without a mark)."""
    paragraphs, lines = re.split(r"\n\s*\n", text), text.split("\n")
    yield text
    for part in (*paragraphs, *lines):
        yield part
        yield from SENTENCE.split(part)


def passages(text: str) -> dict[int, int]:
    """Hashes of the parts of a text, each with the characters of the longest part that has it."""
    out: dict[int, int] = {}
    for part in _parts(text):
        if (h := _hash(part)) is not None:
            out[h] = max(len(part.strip()), out.get(h, 0))
    return out


def _parsed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for conv, turn, role, text in zip(b["conv"], b["turn"], b["role"], b["text"]):
            own, quotes = parse(text)
            said = []
            for level, q in quotes:
                said += [(level, size, h) for h, size in passages(q).items()]
            rows.append((conv, turn, role, own, sorted(passages(own)), [{"level": a, "size": s, "h": h} for a, s, h in said], len(quotes)))
        yield pd.DataFrame(rows, columns=["conv", "turn", "role", "own", "passages", "quotes", "n_quotes"])


PARSED = "conv string, turn long, role string, own string, passages array<long>, quotes array<struct<level: int, size: int, h: long>>, n_quotes long"


def conversations(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, text without quotes, parent_turn, root_turn, position, n_quotes, linked.

    A quoted passage is linked to the latest earlier turn of its conversation
    whose own text has it: as a whole message, a paragraph, a line or a
    sentence. If it is quoted with others, each of its lines and sentences is
    linked too; linked counts the distinct passages and parts that are. Passages
    are compared by their words without case, however short; those without
    words by their signs. Not linked is a quote of less than a sentence out of a
    longer line, or with words changed or left out. The
    parent is the original of the outermost, then longest, linked passage or
    part; without one it is the turn before (none for the first). root_turn is where
    the chain of linked quotes begins, and position orders a conversation by
    root and turn, so that a message always follows the one it replies to.
    Messages of a null turn come first; a null conv_id is a conversation of its
    own; a null text is empty. Repeated rows stay, next to each other, and share
    their result; other columns are ignored; an empty table gives no rows.
    """
    kind = messages.schema[conv_id].dataType.simpleString()
    rows = messages.select(F.col(conv_id).cast("string").alias("conv"), F.coalesce(F.col(turn).cast("long"), F.lit(-1)).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).alias("text"))
    parsed = settled(rows.mapInPandas(_parsed, PARSED).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv")), F.lit(""))))
    # Originals and quotes of one passage stand together by turn: each quote takes the last original before it, and no pairs are made.
    said = parsed.select("key", "turn", F.explode(F.array_distinct("passages")).alias("h")).distinct().select("key", "h", "turn", F.col("turn").alias("original"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("size"))
    quoted = parsed.select("key", "turn", F.explode("quotes").alias("q")).distinct().select("key", "q.h", "turn", F.lit(None).cast("long").alias("original"), "q.level", "q.size")
    asked = quoted.join(said.select("key", "h").distinct(), ["key", "h"], "left_semi")
    rows = carried(ranged(said.unionByName(asked), ("key", "h"), ("turn",)), ("key", "h"), F.max("original"), F.max, "earlier")
    before = Window.partitionBy("__part", "key", "h").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    linked = rows.withColumn("found", F.coalesce(F.last("original", ignorenulls=True).over(before), "earlier")).filter(F.col("level").isNotNull() & F.col("found").isNotNull())
    links = linked.groupBy("key", "turn").agg(F.min(F.struct("level", (-F.col("size")).alias("size"), (-F.col("found")).alias("found"))).alias("best"), F.countDistinct("h").alias("linked")).select("key", "turn", (-F.col("best.found")).alias("parent"), "linked")
    roots = _roots(links.select("key", "turn", F.col("parent").alias("root")))
    turns = parsed.select("key", "turn").distinct()
    placed = with_previous(turns, ("key",), ("turn",), {"turn": "previous"}).join(links, ["key", "turn"], "left").join(roots, ["key", "turn"], "left")
    placed = placed.withColumns({"root": F.coalesce("root", "turn"), "parent": F.coalesce("parent", "previous"), "linked": F.coalesce("linked", F.lit(0))})
    placed = numbered(placed, ("key",), ("root", "turn"), "position")
    out = parsed.join(placed.drop("previous"), ["key", "turn"])
    shown = lambda c: F.when(F.col(c) >= 0, F.col(c))
    return out.select(F.col("conv").cast(kind).alias("conv_id"), shown("turn").alias("turn"), "role", F.col("own").alias("text"), shown("parent").alias("parent_turn"), shown("root").alias("root_turn"), "position", "n_quotes", "linked")


def _roots(links: DataFrame) -> DataFrame:
    """Follows the links (key, turn, root) to where each chain begins, doubling the step each round."""
    now = checkpointed(links)
    for _ in range(MOST_ROUNDS):
        ahead = now.select("key", F.col("turn").alias("root"), F.col("root").alias("further"))
        after = checkpointed(now.join(ahead, ["key", "root"], "left").select("key", "turn", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = after.select("key", "turn", "root")
        if after.filter("moved").isEmpty():
            return now
    raise RuntimeError("chains of quotes did not end")


def as_mail(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The messages as mails: four in five quote the turn before or the one before that, below an attribution, with what that turn quotes a level deeper.

    For tables of plain turns, which hold no quotes. Which turn is quoted
    depends on conv_id and turn alone. Of repeated turns the least text is
    quoted; messages of a null conv_id or turn quote nothing.
    """
    m = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).withColumn("quoted", quoted_turn("conv_id", "turn"))
    originals = m.groupBy("conv_id", F.col("turn").alias("quoted")).agg(F.min("text").alias("original"), F.min("role").alias("by"))
    shown = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "(?m)^", "> ")
    said = lambda who: F.concat(F.lit("In an earlier turn, the "), F.coalesce(F.col(who), F.lit("other")), F.lit(" wrote:\n"))
    one = m.join(originals, ["conv_id", "quoted"], "left").withColumn("inner", quoted_turn("conv_id", "quoted"))
    two = one.join(originals.withColumnsRenamed({"quoted": "inner", "original": "deeper", "by": "deeper_by"}), ["conv_id", "inner"], "left")
    nested = F.concat(F.when(F.col("deeper").isNotNull(), F.concat(said("deeper_by"), shown("deeper"), F.lit("\n"))).otherwise(F.lit("")), "original")
    two = two.withColumn("nested", nested)
    return two.select("conv_id", "turn", "role", F.when(F.col("original").isNotNull(), F.concat(said("by"), shown("nested"), F.lit("\n\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("text"))


def quoted_turn(conv_id: str, turn: str) -> Column:
    """The turn that as_mail() has a turn quote: none for the first, and for one in five."""
    number = F.pmod(F.xxhash64(F.lit("quote"), conv_id, turn), F.lit(10))
    return F.when((F.col(turn) > 0) & (number >= 2), F.greatest(F.lit(0), F.col(turn) - 1 - number % 2))


def chat_text(role="role", text="text"):
    """One message in the chat format."""
    return F.concat(F.lit("<|"), F.coalesce(F.col(role), F.lit("unknown")), F.lit("|>\n"), F.col(text), F.lit("\n"))
