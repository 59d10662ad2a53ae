"""License scans by ordered signature rules.

A text becomes its lower-case words with one space between them.  A text is
searched for the rules' keywords first; only rules whose keyword is there are
tried, each a hand-written regular expression (``license_catalog``).  Where
detections overlap, the one of higher priority stays, the longer one of equal
priorities, then the one that begins first; a detection inside one that stays
is suppressed.  The three base phrases are rules like all others, but what they
find is always reported.

Defined results: a null or empty text has no words, labels or places and score
0; repeated rows and equal or null doc_ids are scanned one by one; equal
detections count once; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscan.llm.common import as_bytes
from folioscan.llm.license_catalog import RULES

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# A-Z in lower case, letters and digits as they are, other ASCII as spaces, the rest as it is.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    keyword: bytes
    pattern: re.Pattern
    base: bool


@dataclass(frozen=True, order=True)
class Detection:
    start: int  # bytes of the normalised text
    end: int
    label: str
    priority: int
    confidence: float
    base: bool


@lru_cache(maxsize=1)
def rules() -> dict[bytes, list[Rule]]:
    """The rules by keyword."""
    found: dict[bytes, list[Rule]] = {}
    for line in RULES.strip().splitlines():
        head, pattern = (part.strip() for part in line.split("|", 1))
        label, priority, confidence, keyword = head.split(" ", 3)
        rule = Rule(label, int(priority), float(confidence), keyword.encode(),
                    re.compile(b"(?<![^ ])(?:" + pattern.encode() + b")(?![^ ])"), pattern in BASE)
        found.setdefault(rule.keyword, []).append(rule)
    return found


def normalised(text: bytes) -> bytes:
    return b" ".join(text.translate(_WORDS).split())


def detections(text: bytes) -> list[Detection]:
    """What the rules find in a normalised text, before suppression."""
    return sorted({
        Detection(m.start(), m.end(), rule.label, rule.priority, rule.confidence, rule.base)
        for keyword, mine in rules().items() if keyword in text
        for rule in mine for m in rule.pattern.finditer(text)})


def resolved(found: list[Detection]) -> list[Detection]:
    """What stays: nothing that lies inside a detection that stays, base phrases
    apart.  Of the intervals that stay, those that no other contains are kept
    with starts and ends ascending, so that a search decides."""
    kept: list[Detection] = []
    starts: list[int] = []
    ends: list[int] = []
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        before = bisect_right(starts, d.start)
        inside = before > 0 and ends[before - 1] >= d.end
        if d.base or not inside:
            kept.append(d)
        if not inside:
            low = high = bisect_left(starts, d.start)
            while high < len(ends) and ends[high] <= d.end:
                high += 1
            starts[low:high], ends[low:high] = [d.start], [d.end]
    return sorted(kept)


def scan(text: bytes) -> dict:
    """The result row of a text, without its doc_id."""
    words = normalised(text)
    kept = resolved(detections(words))
    # Words before a place are spaces before it.
    place, spaces, at = {}, 0, 0
    for d in kept:
        spaces += words.count(b" ", at, d.start)
        at = d.start
        place[d.start] = spaces
    base = [place[d.start] for d in kept if d.base]
    return {
        "n_words": words.count(b" ") + 1 if words else 0, "n_base": len(base),
        "first_word": min(base, default=None), "last_word": max(base, default=None),
        "base_labels": ",".join(sorted({d.label for d in kept if d.base})),
        "labels": ",".join(sorted({d.label for d in kept})),
        "score": max((d.confidence for d in kept), default=0.0),
        "spans": ",".join(f"{d.label}:{place[d.start]}" for d in kept),
    }


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, spans string")


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"score": pa.float64(), "base_labels": pa.string(), "labels": pa.string(), "spans": pa.string()}
    for batch in batches:
        rows = [scan(t) for t in as_bytes(batch.column("text"))]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array([r[n] for r in rows], kinds.get(n, pa.int64())) for n in names[1:])], names)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row for each of ``docs``; spans: labels with their first words."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_batches, SCHEMA)
