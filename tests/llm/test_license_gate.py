"""License scans try every text that a rule's pattern matches: keywords against generated texts."""

import random
import re
from re import _parser

import pytest

from tessera.llm import license_scan
from tessera.llm.license_rules import RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(nodes, limit=500):
    """Texts of a parsed pattern: every alternative, and every optional part with and without."""
    out = [""]
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            parts = [chr(arg)]
        elif name in ("ANY", "NOT_LITERAL") or (name == "IN" and str(arg[0][0]) == "NEGATE"):
            parts = ["z"]
        elif name == "IN":
            parts = [{"CATEGORY_SPACE": " ", "CATEGORY_DIGIT": "2"}[str(a)] if str(o) == "CATEGORY" else chr(a[1] if str(o) == "RANGE" else a) for o, a in arg]
            parts = [" "] if {" ", "*", "#"} <= set(parts) else sorted(set(parts))
        elif name == "BRANCH":
            parts = [t for branch in arg[1] for t in texts(branch, limit)]
        elif name == "SUBPATTERN":
            parts = texts(arg[3], limit)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            parts = [""] * (not arg[0]) + [t * max(arg[0], 1) for t in texts(arg[2], limit)]
        else:
            assert name in ("AT", "ASSERT", "ASSERT_NOT"), name
            continue
        out = [a + b for a in out for b in parts]
        out = random.Random(1).sample(out, limit) if len(out) > limit else out
    return out


def of_rule(rule, limit=500):
    return [t for t in texts(_parser.parse(rule.pattern.pattern, re.IGNORECASE), limit) if rule.pattern.search(t)]


def without_keywords(text):
    return license_scan.resolve([(m.start(), m.end(), r) for r in RULES for m in r.pattern.finditer(text) if m.end() > m.start()])


def scanned(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    return {(r["doc_id"], r["rule"], r["start"], r["end"]) for r in license_scan.scan(docs).collect()}


def test_every_match_holds_a_keyword():
    for r in RULES:
        found = of_rule(r)
        assert found, r
        for t in found:
            assert any(license_scan._flat(k) in license_scan._flat(t) for k in r.keywords), (r.licence, r.keywords, t)


def test_scan_equals_rules_without_keywords(spark):
    rows = [t for r in RULES for t in sorted(of_rule(r), key=lambda t: random.Random(t).random())[:12]]
    rows = list(enumerate(rows + [t.upper() for t in rows[::7]]))
    assert scanned(spark, rows) == {(i, r.number, s, e) for i, t in rows for s, e, r in without_keywords(t)}


@pytest.mark.parametrize(
    "text, licence",
    [
        ("GNU General Public Licence, version 3", "GPL-3.0"),
        ("No part of this book may be reproduced in any form without written permission", "Proprietary"),
        ("for academic use only", "Research-only"),
        ("without any warranty of any kind, express or implied", "Warranty-disclaimer"),
        ("AL-2.0", "Apache-2.0"),
        ("see the accompanying licence file", "Generic"),
        ("under the MİT Lıcenſe", "MIT"),
    ],
)
def test_spellings(spark, text, licence):
    assert [d[2].licence for d in license_scan.detections(text)] == [licence]
    assert len(scanned(spark, [(1, text)])) == 1


def test_gate_takes_the_separators_of_the_rules(spark):
    blanks = [chr(c) for c in range(0x110000) if re.fullmatch(license_scan._SEPARATORS, chr(c))]
    assert {"\u00a0", "\v", "\x1c", "\x85", "\u3000"} <= set(blanks)
    rows = [(k, f"All{b}rights{b}reserved") for k, b in enumerate(blanks)]
    want = {(i, r.number, s, e) for i, t in rows for s, e, r in without_keywords(t)}
    assert scanned(spark, rows) == want and len(want) == len(rows)
