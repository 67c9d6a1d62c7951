"""Text projections as Column expressions (corpus cleaning).

Everything here is native Spark except encoding repair, which needs Python codecs and runs as a vectorised
pandas UDF on the rows that contain non-ASCII characters only (ASCII rows pass through natively).
"""

from __future__ import annotations

import codecs
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Placeholder literals of the essay corpus and the markers they become, in application order.
# Replacement is a chain, so the result is order dependent and not idempotent (a marker contains its key).
PLACEHOLDER_MARKERS = [
    ("Generic_School", "[GENERIC_SCHOOL]"),
    ("Generic_school", "[GENERIC_SCHOOL]"),
    ("SCHOOL_NAME", "[SCHOOL_NAME]"),
    ("STUDENT_NAME", "[STUDENT_NAME]"),
    ("Generic_Name", "[GENERIC_NAME]"),
    ("Genric_Name", "[GENERIC_NAME]"),
    ("Generic_City", "[GENERIC_CITY]"),
    ("LOCATION_NAME", "[LOCATION_NAME]"),
    ("HOTEL_NAME", "[HOTEL_NAME]"),
    ("LANGUAGE_NAME", "[LANGUAGE_NAME]"),
    ("PROPER_NAME", "[PROPER_NAME]"),
    ("OTHER_NAME", "[OTHER_NAME]"),
    ("PROEPR_NAME", "[PROPER_NAME]"),
    ("RESTAURANT_NAME", "[RESTAURANT_NAME]"),
    ("STORE_NAME", "[STORE_NAME]"),
    ("TEACHER_NAME", "[TEACHER_NAME]"),
]
# Fixed value: newline marker (variant one applies it before the placeholders).
NEWLINE_MARKER = ("\n", "[BR]")

# Python's ``\s`` (str.isspace) as an explicit class; Java's ``\s`` lacks \x1c-\x1f and the Unicode spaces.
# Written with \x{..} escapes, which both Java regex and RE2 accept.
PY_SPACE = (r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
            r"\x{202f}\x{205f}\x{3000}]")
NON_ASCII = r"[^\x00-\x7f]"
# The repair chain is the identity on text whose non-ASCII characters all lie in U+00C0..U+00FF: those bytes are
# UTF-8 lead bytes that are never followed by a continuation byte (0x80..0xBF), so every decode step falls back
# to cp1252, which equals Latin-1 there. Only rows with a character in U+0080..U+00BF or above U+00FF can change.
MAY_NEED_REPAIR = r"[\x{80}-\x{bf}\x{100}-\x{10ffff}]"

# ASCII renderings of Latin-1 (U+00A0..U+00FF) and of the cp1252 punctuation block, as given by
# the common unidecode tables.
ASCII_FOLD = {
    "\u00a0": " ", "¡": "!", "¢": "C/", "£": "PS", "¤": "$?", "¥": "Y=", "¦": "|", "§": "SS", "¨": '"',
    "©": "(c)", "ª": "a", "«": "<<", "¬": "!", "\u00ad": "", "®": "(r)", "¯": "-", "°": "deg", "±": "+-",
    "²": "2", "³": "3", "´": "'", "µ": "u", "¶": "P", "·": "*", "¸": ",", "¹": "1", "º": "o", "»": ">>",
    "¼": " 1/4", "½": " 1/2", "¾": " 3/4", "¿": "?",
    "À": "A", "Á": "A", "Â": "A", "Ã": "A", "Ä": "A", "Å": "A", "Æ": "AE", "Ç": "C",
    "È": "E", "É": "E", "Ê": "E", "Ë": "E", "Ì": "I", "Í": "I", "Î": "I", "Ï": "I",
    "Ð": "D", "Ñ": "N", "Ò": "O", "Ó": "O", "Ô": "O", "Õ": "O", "Ö": "O", "×": "x", "Ø": "O",
    "Ù": "U", "Ú": "U", "Û": "U", "Ü": "U", "Ý": "Y", "Þ": "Th", "ß": "ss",
    "à": "a", "á": "a", "â": "a", "ã": "a", "ä": "a", "å": "a", "æ": "ae", "ç": "c",
    "è": "e", "é": "e", "ê": "e", "ë": "e", "ì": "i", "í": "i", "î": "i", "ï": "i",
    "ð": "d", "ñ": "n", "ò": "o", "ó": "o", "ô": "o", "õ": "o", "ö": "o", "÷": "/", "ø": "o",
    "ù": "u", "ú": "u", "û": "u", "ü": "u", "ý": "y", "þ": "th", "ÿ": "y",
    "Œ": "OE", "œ": "oe", "Š": "S", "š": "s", "Ž": "Z", "ž": "z", "Ÿ": "Y", "ƒ": "f", "ˆ": "^", "˜": "~",
    "–": "-", "—": "--", "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "„": ",,", "†": "+", "‡": "++",
    "•": "*", "…": "...", "‰": "%0", "‹": "<", "›": ">", "€": "EUR", "™": "(tm)",
}

# Latin renderings of the Greek and Cyrillic small letters; capitals follow by rule.
GREEK_AND_CYRILLIC = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l",
    "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph",
    "χ": "kh", "ψ": "ps", "ω": "o",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k",
    "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh",
    "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia", "ё": "io",
    "і": "i", "ї": "i", "є": "ie", "ґ": "g",
}


def _wider_letters() -> dict[str, str]:
    """Letters beyond Latin-1 by rule: accented Latin and Greek letters lose their marks (canonical decomposition),
    Greek and Cyrillic letters get their Latin rendering, a capital the rendering of its small letter with a capital."""
    out = {}
    for small, latin in GREEK_AND_CYRILLIC.items():
        out[small] = latin
        if len(small.upper()) == 1 and small != "ς":
            out[small.upper()] = latin[:1].upper() + latin[1:]
    for point in [*range(0x100, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x1F00)]:
        ch = chr(point)
        base = [c for c in unicodedata.normalize("NFD", ch) if not unicodedata.combining(c)]
        if ch not in out and ch not in ASCII_FOLD and len(base) == 1 and base[0] != ch:
            latin = base[0] if base[0].isascii() else out.get(base[0])
            if latin is not None:
                out[ch] = latin
    return out


ASCII_FOLD |= _wider_letters()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------------------------------------------
# Native projections


def mark_newlines(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit(NEWLINE_MARKER[0]), F.lit(NEWLINE_MARKER[1]))


def canon_placeholders(c: Column | str) -> Column:
    """Ordered chain of literal replaces; every key contains ``_``, so rows without one skip the chain."""
    c = _col(c)
    chain = reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), PLACEHOLDER_MARKERS, c)
    return F.when(c.contains("_"), chain).otherwise(c)


def pad_punctuation(c: Column | str) -> Column:
    padded = F.regexp_replace(_col(c), r"([.,!?()\-])", " $1 ")
    return F.regexp_replace(padded, PY_SPACE + "{2,}", " ")


def split_words(c: Column | str) -> Column:
    """``str.split()``: split on whitespace runs, no empty parts."""
    return F.filter(F.split(_col(c), PY_SPACE + "+"), lambda w: w != F.lit(""))


def reverse_words(c: Column | str) -> Column:
    return F.array_join(F.reverse(split_words(c)), " ")


def null_to_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


# ---------------------------------------------------------------------------------------------------------------
# B2: ASCII transliteration. Native replace/translate over the fixed table; the rare rows that still hold
# non-ASCII characters afterwards go to a pandas UDF (NFKD, then drop what is not ASCII).

_MULTI = [(k, v) for k, v in ASCII_FOLD.items() if len(v) != 1]
_SINGLE = [(k, v) for k, v in ASCII_FOLD.items() if len(v) == 1]
_SINGLE_FROM = "".join(k for k, _ in _SINGLE)
_SINGLE_TO = "".join(v for _, v in _SINGLE)
# Characters the fixed table does not cover: C1 controls and everything above U+00FF except the cp1252 block.
# Written as ranges ∩ (not the few exceptions): Latin-1 text fails the range test at once (a negated class
# listing every table key is evaluated char by char against each key and is an order of magnitude slower).
_EXOTIC_CLASS = ("[\\x{80}-\\x{9f}\\x{100}-\\x{10ffff}&&[^"
                 + "".join(k for k in ASCII_FOLD if ord(k) > 0xFF) + "]]")


def _nfkd_ascii(s: str) -> str:
    out = []
    for ch in s:
        if ord(ch) < 128:
            out.append(ch)
        elif ch in ASCII_FOLD:
            out.append(ASCII_FOLD[ch])
        else:
            out.append(unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode("ascii"))
    return "".join(out)


@F.pandas_udf(T.StringType())
def _nfkd_ascii_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else _nfkd_ascii(v))


def _once(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once, though ``fn`` uses it several times."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def ascii_fold(c: Column | str, exotic_fallback: bool = True) -> Column:
    c = _col(c)
    # pure-ASCII rows are left alone; the others are translated character by character, and only rows that are not ASCII
    # after that go through the multi-character renderings (ß → ss, Æ → AE, …)
    def rest(t: Column) -> Column:
        multi = reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), _MULTI, t)
        return F.when(t.rlike(NON_ASCII), multi).otherwise(t)
    folded = F.when(c.rlike(NON_ASCII), _once(F.translate(c, _SINGLE_FROM, _SINGLE_TO), rest)).otherwise(c)
    if not exotic_fallback:
        return folded
    # Rows holding a character outside the fixed table are folded wholly in Python (table + NFKD); the UDF
    # gets the original text, so the native fold above is computed once, for the other rows only.
    return F.coalesce(_nfkd_ascii_udf(F.when(c.rlike(_EXOTIC_CLASS), c)), folded)


# ---------------------------------------------------------------------------------------------------------------
# B1: encoding repair (mojibake such as "Ã©" → "é"). Chain: raw_unicode_escape bytes → utf-8 (cp1252 for bad
# bytes) → cp1252 (utf-8 for unencodable) → utf-8 (cp1252 for bad bytes). Bytes cp1252 leaves undefined
# (81 8D 8F 90 9D) are kept as their Latin-1 character instead of raising.


def _decode_bad_as_cp1252(err: UnicodeError):
    chunk = err.object[err.start:err.end]
    out = []
    for b in chunk:
        try:
            out.append(bytes([b]).decode("cp1252"))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out), err.end


def _encode_bad_as_utf8(err: UnicodeError):
    return err.object[err.start:err.end].encode("utf-8"), err.end


codecs.register_error("quill_cp1252_fallback", _decode_bad_as_cp1252)
codecs.register_error("quill_utf8_fallback", _encode_bad_as_utf8)


def repair_encoding_py(text: str) -> str:
    raw = text.encode("raw_unicode_escape")
    step = raw.decode("utf-8", errors="quill_cp1252_fallback")
    step = step.encode("cp1252", errors="quill_utf8_fallback")
    return step.decode("utf-8", errors="quill_cp1252_fallback")


@F.pandas_udf(T.StringType())
def _repair_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else repair_encoding_py(v))


def repair_encoding(c: Column | str) -> Column:
    """Rows that are a fixed point of the chain (see ``MAY_NEED_REPAIR``) never leave the JVM."""
    c = _col(c)
    return F.coalesce(_repair_udf(F.when(c.rlike(MAY_NEED_REPAIR), c)), c)


# Bytes that cp1252 leaves undefined, seen as the Latin-1 characters they become.
CP1252_UNDEFINED = "\x81\x8d\x8f\x90\x9d"


def had_undecodable(c: Column | str) -> Column:
    """True when the repair kept a byte that cp1252 cannot decode (the reference would have raised)."""
    return _col(c).rlike("[" + CP1252_UNDEFINED + "]")


# ---------------------------------------------------------------------------------------------------------------
# Composite cleaning


def clean_text(c: Column | str, variant: int = 1) -> Column:
    """Variant 1: repair, fold, newline marker, placeholders. Variant 2: repair, fold, placeholders."""
    if variant not in (1, 2):
        raise ValueError("variant must be 1 or 2")
    out = ascii_fold(repair_encoding(null_to_empty(c)))
    if variant == 1:
        out = mark_newlines(out)
    return canon_placeholders(out)


def marker_vocabulary(variant: int = 1) -> list[str]:
    """Marker strings added to a tokenizer vocabulary (duplicates kept, as the dictionary has them)."""
    values = [m for _, m in PLACEHOLDER_MARKERS]
    return ([NEWLINE_MARKER[1]] + values) if variant == 1 else values


def count_literal(c: Column | str, literal: str) -> Column:
    """Non-overlapping occurrences of a literal (no regex)."""
    c = _col(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))) / F.lit(len(literal))).cast("long")
