"""Domains, constants and row schemas of the text index."""

from __future__ import annotations

from enum import Enum
from typing import NamedTuple

SNAPSHOT_VERSION = 4

ORIGINAL = "original"
FULL = "pinyin_full"
INITIALS = "pinyin_initials"
FULL_PREFIX = "pinyin_full_prefix"
INITIALS_PREFIX = "pinyin_initials_prefix"


class Domain(NamedTuple):
    name: str
    weight: float
    ngrams: bool
    fuzzy: bool

    @property
    def is_prefix(self) -> bool:
        """Prefix domains aren't normalized by length."""
        return self.name in (FULL_PREFIX, INITIALS_PREFIX)

    @property
    def is_pinyin(self) -> bool:
        return self.name != ORIGINAL


DOMAINS = {
    d.name: d
    for d in (
        Domain(ORIGINAL, 1.0, True, True),
        Domain(FULL, 0.9, True, True),
        Domain(INITIALS, 0.8, True, True),
        Domain(FULL_PREFIX, 0.7, False, False),
        Domain(INITIALS_PREFIX, 0.75, False, False),
    )
}
PREFIX_DOMAINS = tuple(d.name for d in DOMAINS.values() if d.is_prefix)


class SearchMode(str, Enum):
    EXACT = "exact"
    PINYIN = "pinyin"
    FUZZY = "fuzzy"
    AUTO = "auto"


class PositionEncoding(str, Enum):
    BYTES = "bytes"
    UTF16 = "utf16"


K1, B = 1.2, 0.75
MIN_SHOULD_MATCH = 0.6
FUZZY_PENALTY = 0.7
FUZZY_THRESHOLD, FUZZY_SHORT_THRESHOLD = 0.6, 0.5
MAX_CANDIDATES, MAX_LENGTH_GAP = 20, 2

POSTINGS = "index_name string, domain string, term string, doc_id {id}, tf long, dl long"
TOKENS = "index_name string, doc_id {id}, ord int, term string, domain string, start int, end int, base_term string"
MATCHED = "array<struct<term string, domain string>>"
HITS = "query_id string, index_name string, doc_id {id}, score double, matched_terms array<struct<term: string, domain: string>>"
