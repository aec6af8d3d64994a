"""License scans: ordered signature rules over whole texts.

A text is tried only if one regular expression of all rules' keywords matches it; an
Aho-Corasick pass over those texts then says which rules have a keyword in it, and only their
patterns run.  Overlapping detections are resolved in order of priority, then length: one that
lies within a detection already accepted is dropped.

Defined results
* null or empty text: no detections.  Very long text: scanned whole.
* ties (same priority, length and start): the rule that stands first in the list.
* detections that overlap without one containing the other all stay.
* repeated rows: each gives its own rows.  Null doc_id is carried.  Empty table: empty result.
* extra columns aren't read, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .license_rules import RULES, Rule

_SEPARATORS = re.compile(r"[\s*#/]+")
#: The same in RE2, whose \s is ASCII without \v.
_RE2_SEPARATORS = r"[\s\v\p{Z}\x1c-\x1f\x{85}*#/]+"
#: Letters that patterns take for i and s when they ignore case, but that lower() doesn't turn into them.
_CASELESS = str.maketrans({"\u0130": "i", "\u0131": "i", "\u017f": "s"})


def _flat(text: str) -> str:
    """Lower case, with every run of white space and comment marks as one blank."""
    return _SEPARATORS.sub(" ", text.translate(_CASELESS).lower())


@lru_cache(maxsize=1)
def _gate() -> str:
    words = sorted({_flat(k) for r in RULES for k in r.keywords})
    words = [w for w in words if not any(other in w for other in words if other != w)]
    escaped = [[re.sub(r"([.()+|^$?\[\]{}])", r"\\\1", part).replace("i", "[i\u0131]").replace("s", "[s\u017f]") for part in w.split(" ")] for w in words]
    return "|".join(_RE2_SEPARATORS.join(parts) for parts in escaped)


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    rules_of: dict[str, list[int]] = {}
    for r in RULES:
        for k in r.keywords:
            rules_of.setdefault(_flat(k), []).append(r.number)
    automaton = ahocorasick.Automaton()
    for k, numbers in rules_of.items():
        automaton.add_word(k, tuple(numbers))
    automaton.make_automaton()
    return automaton


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Accepted detections (start, end, rule), in order of start.

    Of the accepted ones those that lie in no other are kept by rising start, and so by rising end; the
    last of them that begins at or before a detection is the one that may contain it."""
    accepted: list[tuple[int, int, Rule]] = []
    starts: list[int] = []
    ends: list[int] = []
    for start, end, rule in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].number)):
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        accepted.append((start, end, rule))
        low, high = bisect_left(starts, start), bisect_right(ends, end)
        starts[low : max(low, high)], ends[low : max(low, high)] = [start], [end]
    return sorted(accepted, key=lambda d: (d[0], d[1], d[2].number))


def detections(text: str) -> list[tuple[int, int, Rule]]:
    """All accepted detections of one text; positions in characters."""
    numbers = {n for _, rules in _automaton().iter(_flat(text)) for n in rules}
    return resolve([(m.start(), m.end(), RULES[n]) for n in sorted(numbers) for m in RULES[n].pattern.finditer(text) if m.end() > m.start()])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = pc.fill_null(batch.column("text"), "")
        rows = np.flatnonzero(np.asarray(pc.match_substring_regex(pc.utf8_lower(col), _gate())))
        out: list[tuple] = []
        at: list[int] = []
        for r in rows.tolist():
            text = col[r].as_py()
            for start, end, rule in detections(text):
                at.append(r)
                out.append((rule.licence, rule.number, rule.priority, start, end, text[start:end]))
        cols = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, kinds)]],
            names=["doc_id", "license", "rule", "priority", "start", "end", "matched"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, license, rule, priority, start, end, matched): every accepted detection."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, license string, rule int, priority int, start int, end int, matched string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
