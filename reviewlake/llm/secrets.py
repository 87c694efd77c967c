"""Secret scans: all rules in one automaton, one pass over the bytes of a batch of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.automaton import Automaton, hits, is_match, matches
from reviewlake.llm.common import through_pandas

ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
VALUE = r"[A-Za-z0-9+/_.=-]"

#: Kinds in listed order: (name, how the search sees one, pattern of the leftmost matches, pattern of a match that counts).
#: The search needs no full match: long counted classes after a prefix would multiply its states.
BASE = (
    ("assign", ASSIGN + VALUE, ASSIGN + VALUE + "+", ASSIGN + VALUE + "{6,}"),
    ("access", "AKIA[A-Z0-9]", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16,}"),
    ("hex", "[0-9a-f]{24}", "[0-9a-f]+", "[0-9a-f]{24,}"),
)
#: Kinds beyond the base ones.
EXTRA = (
    ("github", "gh[pousr]_[A-Za-z0-9]", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{36,}"),
    ("slack", "xox[abprs]-[A-Za-z0-9]", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("google", "AIza[A-Za-z0-9_-]", "AIza[A-Za-z0-9_-]+", "AIza[A-Za-z0-9_-]{35,}"),
    ("stripe", "[rs]k_(live|test)_[A-Za-z0-9]", "[rs]k_(live|test)_[A-Za-z0-9]+", "[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("pem", "-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----", "-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----", "-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----"),
)
KINDS = BASE + EXTRA

#: Bytes of text that one pass takes at a time; a longer text is a pass of its own.
PASS_BYTES = 4 << 20


class Scanner:
    """The combined search automaton, and per kind those that delimit and judge its matches."""

    def __init__(self, kinds=KINDS) -> None:
        self.kinds = kinds
        self.search = Automaton([seen for _, seen, _, _ in kinds])
        self.loose = [Automaton([p], search=False) for _, _, p, _ in kinds]
        self.strict = [Automaton([p], search=False) for _, _, _, p in kinds]

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, kind, end) in bytes for each text, by start and then kind as listed."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        reset = bytes([10])
        joined = reset.join(texts) + reset
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        where, bits = hits(self.search, np.frombuffer(joined, np.uint8))
        if not len(where):
            return out
        stops = np.flatnonzero(np.isin(np.frombuffer(joined, np.uint8), self.search.resets))
        right = np.searchsorted(stops, where)
        # Matches never hold a reset byte, so each kind is read within the stretches between resets where it was seen.
        pairs = {(int(s), r) for s, b in zip(right, bits) for r in range(len(self.kinds)) if int(b) >> r & 1}
        for s, r in sorted(pairs):
            begin, end = (int(stops[s - 1]) + 1 if s else 0), int(stops[s])
            doc = int(np.searchsorted(starts, begin, side="right")) - 1
            for a, b in matches(self.loose[r], joined, begin, end):
                if is_match(self.strict[r], joined, a, b):
                    out[doc].append((a - int(starts[doc]), r, b - int(starts[doc])))
        return [sorted(x) for x in out]


def _digest(kinds: list[str]) -> str:
    return hashlib.sha256(",".join(kinds).encode()).hexdigest()


SCHEMA = "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: counts of the base kinds, their digest, and all spans.

    Spans are kind:start:end by start and then kind as listed, comma-joined,
    in code points with an exclusive end. A null text counts as empty; a text
    without secrets has zero counts and an empty list. Repeated rows are
    scanned alike; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        names, base = [k for k, *_ in KINDS], len(BASE)

        def rows(ids: list, raw: list[bytes]) -> pd.DataFrame:
            made = []
            for key, data, spans in zip(ids, raw, scanner.spans(raw)):
                points = {at: len(data[:at].decode("utf-8", "surrogatepass")) for s, _, e in spans for at in (s, e)} if not data.isascii() else {}
                said = [(r, f"{names[r]}:{points.get(s, s)}:{points.get(e, e)}") for s, r, e in spans]
                own = [x for r, x in said if r < base]
                made.append((key, *(sum(r == k for r, _ in said) for k in range(base)), _digest(own), ",".join(x for _, x in said), len(said)))
            return pd.DataFrame(made, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])

        for b in batches:
            ids, raw, size = [], [], 0
            for key, t in zip(b["doc_id"], b["text"]):
                ids.append(key)
                raw.append((t or "").encode("utf-8", "surrogatepass"))
                size += len(raw[-1])
                if size >= PASS_BYTES:
                    yield rows(ids, raw)
                    ids, raw, size = [], [], 0
            if ids:
                yield rows(ids, raw)

    found = docs.select(through_pandas(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, SCHEMA)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
