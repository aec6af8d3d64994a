"""The general analyzer: any script, with spans and pinyin; it runs in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import numpy as np

from ..schema import FULL, FULL_PREFIX, INITIALS, INITIALS_PREFIX, ORIGINAL
from . import lexicon, pinyin

_HAN = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF))
_ID_MIN, _ID_RELAXED = 8, 16
_LONGEST_SPAN = 32


class Token(NamedTuple):
    term: str
    domain: str
    start: int  # bytes
    end: int
    base_term: str


def is_han(c: str) -> bool:
    p = ord(c)
    return any(a <= p <= b for a, b in _HAN)


@lru_cache(maxsize=65536)
def script(c: str) -> str:
    """Class of a character: han, hiragana, katakana, hangul, latin (and ASCII digits) or other."""
    if is_han(c):
        return "han"
    if c.isascii():
        return "latin" if c.isalnum() else "other"
    name = unicodedata.name(c, "")
    for prefix, cls in (("HIRAGANA LETTER", "hiragana"), ("HIRAGANA ITERATION", "hiragana"), ("HIRAGANA VOICED", "hiragana"), ("HIRAGANA DIGRAPH", "hiragana")):
        if name.startswith(prefix):
            return cls
    if name.startswith(("KATAKANA LETTER", "KATAKANA ITERATION", "KATAKANA VOICED", "KATAKANA DIGRAPH", "HALFWIDTH KATAKANA LETTER", "CIRCLED KATAKANA", "SQUARE ")):
        return "katakana" if "KATAKANA" in name else "other"
    if name.startswith(("HANGUL ", "HALFWIDTH HANGUL", "PARENTHESIZED HANGUL", "CIRCLED HANGUL")):
        return "hangul"
    if name.startswith(("LATIN ", "FULLWIDTH LATIN", "FEMININE ORDINAL", "MASCULINE ORDINAL", "MODIFIER LETTER SMALL", "ANGSTROM SIGN", "KELVIN SIGN", "TURNED SMALL", "ROMAN NUMERAL", "SMALL ROMAN NUMERAL")):
        return "latin"
    return "other"


def runs(text: str) -> list[tuple[str, int, int]]:
    """Maximal runs of one class: (class, start, end) in characters."""
    out: list[tuple[str, int, int]] = []
    for k, c in enumerate(text):
        cls = script(c)
        if out and out[-1][0] == cls:
            out[-1] = (cls, out[-1][1], k + 1)
        else:
            out.append((cls, k, k + 1))
    return out


@lru_cache(maxsize=65536)
def _folded(c: str) -> str:
    kept = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x)[0] != "M")
    return "".join(x.lower() for x in unicodedata.normalize("NFKC", kept))


def fold(text: str) -> str:
    """Each character decomposed, without marks, composed again and lower-cased."""
    return "".join(map(_folded, text))


def is_ascii_word(term: str) -> bool:
    """Whether a term is made of ASCII letters and digits."""
    return term.isascii() and (not term or term.isalnum())


def is_id_like(word: str) -> bool:
    """Whether an ASCII word looks like a random identifier."""
    if len(word) < _ID_MIN or not re.fullmatch(r"[A-Za-z0-9_-]+", word):
        return False
    letters = [c for c in word.lower() if c.isalpha()]
    vowels = sum(c in "aeiouy" for c in letters)
    classes = sum(bool(re.search(p, word)) for p in ("[A-Z]", "[a-z]", "[0-9]"))
    relaxed = not letters or vowels * 10 <= len(letters) * 3
    strict = not letters or vowels * 4 <= len(letters)
    return (len(word) >= _ID_RELAXED and relaxed) or (classes >= 2 and strict)


def normalize(raw: str) -> list[tuple[str, int, int]]:
    """(term, start, end in characters) of a piece of text.

    ASCII is cut in words, at ``_`` and ``-`` too unless the word is like an identifier; other text
    with a letter or number is one term whole, and without one none."""
    if raw.isascii():
        out = []
        for m in re.finditer(r"[A-Za-z0-9_-]+", raw):
            if is_id_like(m[0]):
                out.append((fold(m[0]), m.start(), m.end()))
            else:
                out += [(fold(p[0]), m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[^_-]+", m[0])]
        return out
    if not any(c.isalnum() for c in raw):
        return []
    term = fold(raw)
    return [(term, 0, len(raw))] if term else []


def uni_bigrams(run: str, at: int = 0) -> list[tuple[int, int]]:
    return [(at + s, at + e) for k in range(len(run)) for s, e in ((k, k + 1), (k, k + 2)) if e <= len(run)]


@dataclass
class Analyzer:
    """How texts become tokens; ``tokenizers`` maps a script to a callable run -> [(start, end)]."""

    readings: dict[str, tuple[str, ...]] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=lambda: dict(lexicon.CHINESE))
    dictionary: lexicon.DictionaryConfig | None = None
    tokenizers: dict[str, Callable[[str], list[tuple[int, int]]]] = field(default_factory=dict)

    def cuts(self, cls: str, run: str) -> list[tuple[int, int]]:
        """Parts of a run, each normalized on its own."""
        if cls in self.tokenizers:
            return self.tokenizers[cls](run)
        if cls == "han":
            return lexicon.search_words(run, self.words)
        if cls in ("hiragana", "katakana", "hangul"):
            matched = lexicon.longest_matches(run, self.dictionary.entries_for(cls)) if self.dictionary else []
            if not matched:
                return uni_bigrams(run)
            gaps, at = [], 0
            for start, end in [*matched, (len(run), len(run))]:
                gaps += uni_bigrams(run[at:start], at)
                at = end
            return matched + gaps
        return [(0, len(run))]

    def original(self, text: str) -> list[tuple[str, int, int]]:
        """Original tokens (term, start, end in characters), each (term, span) once."""
        seen, out = set(), []
        for cls, start, end in runs(text):
            run = text[start:end]
            for a, b in self.cuts(cls, run):
                for term, s, e in normalize(run[a:b]):
                    token = (term, start + a + s, start + a + e)
                    if token not in seen:
                        seen.add(token)
                        out.append(token)
        return out

    def tokens(self, text: str, derive: bool = True) -> list[Token]:
        """All tokens in order; ``derive``: with pinyin (documents), else without (queries)."""
        offsets = [0]
        for c in text:
            offsets.append(offsets[-1] + len(c.encode("utf-8", "surrogatepass")))
        out: list[Token] = []
        covered: set[tuple[int, int]] = set()
        recorded: dict[str, set[str]] = {FULL: set(), INITIALS: set()}

        def spell(term: str, start: int, end: int) -> None:
            for full, initials in pinyin.variants(term, self.readings):
                for value, domain, prefix_domain, lengths in (
                    (full, FULL, FULL_PREFIX, pinyin.FULL_PREFIX_LENGTHS),
                    (initials, INITIALS, INITIALS_PREFIX, pinyin.INITIALS_PREFIX_LENGTHS),
                ):
                    if not value or (domain == INITIALS and initials == full):
                        continue
                    out.append(Token(value, domain, offsets[start], offsets[end], term))
                    recorded[domain].add(value)
                    for p in pinyin.prefixes(value, lengths):
                        if p not in recorded[domain]:
                            out.append(Token(p, prefix_domain, offsets[start], offsets[end], term))

        for term, start, end in self.original(text):
            out.append(Token(term, ORIGINAL, offsets[start], offsets[end], term))
            if all(map(is_han, term)):
                covered.add((start, end))
            if derive and any(map(is_han, term)) and self._chinese(text, start, end):
                spell(term, start, end)
        if derive:
            for cls, start, end in runs(text):
                if cls == "han" and (start, end) not in covered and end - start <= _LONGEST_SPAN and self._chinese(text, start, end):
                    spell(text[start:end], start, end)
        return out

    @staticmethod
    def _chinese(text: str, start: int, end: int) -> bool:
        """A span is read as Chinese unless kana is in it or beside it."""
        around = text[max(0, start - 1) : end + 1]
        return start < end and not any(script(c) in ("hiragana", "katakana") for c in around)


def spans(tokens: list[Token], terms: list[str]) -> list[tuple[int, int]]:
    """Byte spans of terms: where a term is an original token those, else its shortest derived ones."""
    return spans_by_start(tokens, terms, lambda: tokens)


def spans_by_start(original: list[Token], terms: list[str], every: Callable[[], list[Token]]) -> list[tuple[int, int]]:
    """``spans`` with all tokens asked for only if some term isn't an original one."""
    wanted = set(terms)
    own: dict[str, list[tuple[int, int]]] = {}
    for t in original:
        if t.domain == ORIGINAL and t.term in wanted:
            own.setdefault(t.term, []).append((t.start, t.end))
    missing = wanted - own.keys()
    if missing:
        derived: dict[str, set[tuple[int, int]]] = {}
        for t in every():
            if t.domain != ORIGINAL and t.term in missing:
                derived.setdefault(t.term, set()).add((t.start, t.end))
        for term, found in derived.items():
            least = min(e - s for s, e in found)
            own[term] = sorted((s, e) for s, e in found if e - s == least)
    return sorted((span for term in terms for span in own.get(term, ())), key=lambda span: span[0])


def byte_offsets(text: str) -> np.ndarray:
    """Where each character of a text begins in UTF-8, and where the last one ends."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    return np.concatenate([[0], np.cumsum(sizes)])


def to_utf16(text: str, byte_spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans as UTF-16 units, in one pass over the text."""
    if not byte_spans:
        return []
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    units = np.concatenate([[0], np.cumsum(((raw & 0xC0) != 0x80).astype(np.int64) + (raw >= 0xF0))])
    return [(int(units[s]), int(units[e])) for s, e in byte_spans]
