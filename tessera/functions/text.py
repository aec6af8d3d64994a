"""Text functions as Spark columns: they stay in the JVM and inside generated code."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FUZZY_SHORT_THRESHOLD, FUZZY_THRESHOLD

HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2CEAF}"
_CLASSES = (HAN, r"\p{IsHiragana}", r"\p{IsKatakana}", r"\p{IsHangul}", r"\p{IsLatin}0-9")
RUN = "|".join(f"[{c}]+" for c in _CLASSES) + f"|[^{''.join(_CLASSES)}]+"

#: Characters that the native tokenizer treats as the general one does: ASCII, accented Latin-1
#: letters, and punctuation that is neither a letter nor a number.
NATIVE = r"\x00-\x7F\xA0-\xA9\xAB-\xB1\xB4\xB6-\xB8\xBB\xBF-\xFF\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20AC}"


def _latin_table() -> tuple[str, str]:
    """Accented lower-case Latin-1 letters and what they become without marks."""
    source, target = [], []
    for point in range(0xC0, 0x100):
        c = chr(point).lower()
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x)[0] != "M")
        if plain != c and len(plain) == 1 and c not in source:
            source.append(c)
            target.append(plain)
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _latin_table()


def script_runs(text: Column) -> Column:
    """Maximal runs of one script class (Han, Hiragana, Katakana, Hangul, Latin and digits, other);
    together they are the text."""
    return F.regexp_extract_all(text, F.lit(RUN), F.lit(0))


def script_of(run: Column) -> Column:
    """The class of a run."""
    out = F.lit("other")
    for name, cls in reversed(list(zip(("han", "hiragana", "katakana", "hangul", "latin"), _CLASSES))):
        out = F.when(run.rlike(f"^[{cls}]"), name).otherwise(out)
    return out


def is_native(text: Column) -> Column:
    """Whether the native tokenizer gives the general one's tokens for this text."""
    return text.rlike(rf"\A[{NATIVE}]*\z") & ~text.rlike("[_-]{16}")


def fold(text: Column) -> Column:
    """Lower case without accents, for native texts."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def latin_terms(text: Column) -> Column:
    """Terms of a native text, in order."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{IsLatin}0-9]+"), F.lit(0))


_NATIVE = re.compile("[" + re.sub(r"\\x\{(\w+)\}", r"\\u\1", NATIVE) + r"]*")
_HYPHENS = re.compile("[_-]{16}")
_WORD = re.compile("[0-9a-z\xdf-\xf6\xf8-\xff]+")
_MARKS = str.maketrans(ACCENTED, PLAIN)


def native(text: str) -> bool:
    """``is_native`` of one text."""
    return (text.isascii() or _NATIVE.fullmatch(text) is not None) and _HYPHENS.search(text) is None


def native_fold(text: str) -> str:
    """``fold`` of one native text; it keeps every character's place."""
    return text.lower().translate(_MARKS) if not text.isascii() else text.lower()


def native_words(text: str) -> list[str]:
    """``latin_terms`` of one native text."""
    return _WORD.findall(native_fold(text))


def native_matches(text: str) -> Iterator[re.Match]:
    """The same as matches, whose places are those in the text itself."""
    return _WORD.finditer(native_fold(text))


def char_ngrams(term: Column) -> Column:
    """3-grams of a term, of two characters the term itself, of fewer none; repeats are kept."""
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.length(term) - 2, F.lit(1))), lambda i: F.substr(term, i, F.lit(3)))
    return F.when(F.length(term) >= 3, many).when(F.length(term) == 2, F.array(term)).otherwise(F.array().cast("array<string>"))


def ngrams_of(term: str) -> set[str]:
    """The distinct ``char_ngrams`` of one term."""
    return {term[k : k + 3] for k in range(max(1, len(term) - 2))} if len(term) >= 2 else set()


def uni_bigrams(run: Column) -> Column:
    """Each character and, where there is a next one, the pair: a, ab, b, bc, c."""
    n = F.length(run)
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.when(i < n, F.array(F.substr(run, i, F.lit(1)), F.substr(run, i, F.lit(2)))).otherwise(F.array(F.substr(run, i, F.lit(1)))),
    )
    return F.when(n > 0, F.flatten(pairs)).otherwise(F.array().cast("array<string>"))


def id_like(term: Column) -> Column:
    """Whether an ASCII word looks like a random identifier."""
    alpha = F.regexp_count(term, F.lit("[A-Za-z]"))
    vowels = F.regexp_count(term, F.lit("[aeiouyAEIOUY]"))
    classes = sum((F.when(term.rlike(c), 1).otherwise(0) for c in ("[A-Z]", "[a-z]", "[0-9]")), F.lit(0))
    relaxed = (F.length(term) >= 16) & ((alpha == 0) | (vowels * 10 <= alpha * 3))
    strict = (classes >= 2) & ((alpha == 0) | (vowels * 4 <= alpha))
    return term.rlike(r"\A[A-Za-z0-9_-]{8,}\z") & (relaxed | strict)


def ascii_terms(word: Column) -> Column:
    """Terms of a run of ASCII letters, digits, ``_`` and ``-``: whole if it looks like an identifier, else parted at both."""
    parts = F.filter(F.split(F.lower(word), "[_-]+"), lambda p: p != "")
    return F.when(id_like(word), F.array(F.lower(word))).otherwise(parts)


def in_dictionary(term: Column) -> Column:
    """Whether an original term takes part in fuzzy search."""
    return term.rlike(r"[\p{IsAlphabetic}\p{N}]") & ~id_like(term)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, in characters; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def fuzzy_threshold(term: Column) -> Column:
    return F.when(F.length(term) <= 2, FUZZY_SHORT_THRESHOLD).otherwise(FUZZY_THRESHOLD)


def utf16_offset(text: Column, chars: Column) -> Column:
    """UTF-16 units in the first ``chars`` characters of ``text``."""
    return (F.octet_length(F.encode(F.substr(text, F.lit(1), chars), "UTF-16BE")) / 2).cast("int")


def byte_offset(text: Column, chars: Column) -> Column:
    """UTF-8 bytes in the first ``chars`` characters of ``text``."""
    return F.octet_length(F.substr(text, F.lit(1), chars))
