"""Line dedup by site-relative frequency, in built-in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import settled

#: A line is boilerplate on more than this share of its host's pages, and on this many of them at least.
RATIO, LEAST_PAGES = 0.05, 5
#: Boilerplate lines of all hosts up to which they are broadcast; with more, the join is dealt out by host and salt.
BROADCAST_LINES, SALTS = 200_000, 64


def _host(source: str) -> Column:
    """A host key that is never null: rows without a host form a host of their own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit(" \t\r\x0b\x0c")))


def _blank(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\x0b\x0c")) == ""


def boilerplate(docs: DataFrame, ratio: float = RATIO, least: int = LEAST_PAGES, source: str = "source", text: str = "text") -> DataFrame:
    """(host, lines): the hash keys of the lines that are on more than ``ratio`` of a host's pages.

    A page counts once for each of its lines; white space around a line and
    blank lines don't count. The shares of a page's lines on a host add up to
    its mean number of lines, so ``lines`` has at most that mean / ratio keys.
    """
    pages = docs.select(_host(source).alias("host"), F.col(text).alias("text"))
    lines = F.array_distinct(F.transform(F.filter(_split(F.col("text")), lambda x: ~_blank(x)), _key))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    counts = pages.select("host", F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counts.join(totals, "host").filter(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(F.collect_set("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, least: int = LEAST_PAGES, source: str = "source", text: str = "text", dropped: str | None = None) -> DataFrame:
    """docs with their boilerplate lines taken out of ``text``; every other column stays as it is.

    The kept lines stay in order, joined by newlines; a text without
    boilerplate is unchanged, byte for byte. A null text stays null, an empty
    one empty. Rows without a host are judged together as one host. Repeated
    rows count as pages of their own. ``dropped`` names a column for the number
    of lines taken out.
    """
    found = settled(boilerplate(docs, ratio, least, source, text))
    size = found.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    names = docs.columns
    rows = docs.withColumn("__host", _host(source))
    right = found.withColumnsRenamed({"host": "__host", "lines": "__boilerplate"})
    if size <= BROADCAST_LINES:
        joined = rows.join(F.broadcast(right), "__host", "left")
    else:
        salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("__salt", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")).join(salted, ["__host", "__salt"], "left").drop("__salt")
    lines = _split(F.col(text))
    kept = F.when(F.col("__boilerplate").isNotNull() & F.col(text).isNotNull(), F.filter(lines, lambda x: _blank(x) | ~F.array_contains("__boilerplate", _key(x))))
    out = joined.withColumn("__kept", kept)
    fields = {text: F.coalesce(F.array_join("__kept", "\n"), F.col(text))}
    if dropped:
        fields["__n"] = F.coalesce(F.size(lines) - F.size(F.col("__kept")), F.lit(0)).cast("long")
    out = out.withColumns(fields).select(*names, *(["__n"] if dropped else []))
    return out.withColumnRenamed("__n", dropped) if dropped else out


ORACLE_SQL = f"""
WITH pages AS (SELECT row_number() OVER () AS page, doc_id, coalesce('=' || source, '') AS host, text FROM documents),
lines AS (SELECT page, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM pages),
trimmed AS (SELECT page, host, place, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM lines),
counts AS (SELECT host, bare, count(DISTINCT page) AS n FROM trimmed WHERE bare <> '' GROUP BY 1, 2),
totals AS (SELECT host, count(*) AS total FROM pages GROUP BY 1),
common AS (SELECT host, bare FROM counts JOIN totals USING (host) WHERE n >= {LEAST_PAGES} AND n > {RATIO} * total),
kept AS (SELECT t.page, string_agg(t.line, chr(10) ORDER BY t.place) FILTER (WHERE c.bare IS NULL) AS text,
    count(c.bare) AS n_dropped FROM trimmed t LEFT JOIN common c USING (host, bare) GROUP BY 1)
SELECT p.doc_id, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, CAST(coalesce(k.n_dropped, 0) AS BIGINT) AS n_dropped
FROM pages p LEFT JOIN kept k USING (page)
"""
