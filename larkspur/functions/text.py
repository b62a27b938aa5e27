"""Text normalization and similarity as Column builders.

Everything is built-in expressions. What Unicode says of characters comes from tables that are built by rule at import.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named entities that are decoded; others stay as they are.
ENTITIES = {
    "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&ndash;": "-", "&mdash;": "-",
    "&times;": "x", "&hellip;": "…", "&deg;": "°", "&eacute;": "é", "&aacute;": "á", "&oacute;": "ó", "&uacute;": "ú", "&iacute;": "í",
    "&ouml;": "ö", "&uuml;": "ü", "&Ouml;": "Ö", "&Uuml;": "Ü", "&odblac;": "ő", "&udblac;": "ű",
}
# Typographic characters and their plain forms; zero-width ones vanish.
TYPOGRAPHIC = {
    "‘": "'", "’": "'", "‛": "'", "ʼ": "'", "“": '"', "”": '"', "„": '"', "–": "-", "—": "-", "−": "-", "‐": "-", "‑": "-", "×": "x", "✕": "x", "✖": "x",
    "\u00a0": " ", "\u2002": " ", "\u2003": " ", "\u2009": " ", "\u202f": " ", "⁄": "/", "½": " 1/2 ", "\u200b": "", "\u200c": "", "\u200d": "", "\ufeff": "",
}

#: Letters whose decomposition is one letter and marks, over the whole basic plane.
_PLAIN = {
    chr(c): d for c in range(0xC0, 0xFFFE)
    if not 0xD800 <= c < 0xE000 and len(d := unicodedata.normalize("NFC", re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", chr(c))))) == 1 and d != chr(c)
}
#: Characters with a compatibility form, over the basic plane, by rule: what NFKC and then the typographic table make of each.
_FORMS = TYPOGRAPHIC | {
    chr(c): "".join(TYPOGRAPHIC.get(x, x) for x in unicodedata.normalize("NFKC", chr(c))) for c in range(0xA0, 0xFFFE)
    if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFKC", chr(c)) not in (chr(c), unicodedata.normalize("NFC", chr(c)))
}


#: Of the forms, those that are one character or none, for one pass over a text; and the longer ones.
_SINGLE = sorted((c for c, plain in _FORMS.items() if len(plain) < 2), key=lambda c: not _FORMS[c])
_LONGER = {c: plain for c, plain in _FORMS.items() if len(plain) > 1}


def deaccent(s: Column) -> Column:
    """Letters without their diacritics; combining marks go."""
    return F.regexp_replace(F.translate(s, "".join(_PLAIN), "".join(_PLAIN.values())), "[\u0300-\u036f]", "")


def decode_entities(s: Column) -> Column:
    """The named entities of the table and numeric ones; others stay. Texts without an ampersand skip all that."""
    numeric = F.split(s, "(?i)(?=&#(?:[0-9]+|x[0-9a-f]+);)")

    def char(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")

    def one(p: Column) -> Column:
        decimal, hexa = F.regexp_extract(p, "^&#([0-9]{1,7});", 1), F.regexp_extract(p, "^&#[x]([0-9a-fA-F]{1,6});", 1)
        code = F.when(decimal != "", decimal.cast("bigint")).when(hexa != "", F.conv(hexa, 16, 10).cast("bigint"))
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.concat(char(F.hex(code)), F.regexp_replace(p, "^&#x?[0-9a-fA-F]+;", ""))).otherwise(p)

    out = F.array_join(F.transform(numeric, one), "")
    named = F.when(F.contains(s, F.lit("&#")), F.replace(out, F.lit("&#39;"), F.lit("'"))).otherwise(s)
    for entity, plain in ENTITIES.items():
        if entity != "&amp;":
            named = F.replace(named, F.lit(entity), F.lit(plain))
    return F.when(F.instr(s, "&") > 0, F.replace(named, F.lit("&amp;"), F.lit("&"))).otherwise(s)


def _plain_forms(s: Column) -> Column:
    """The table's characters replaced. ASCII texts skip it; only a text with a form of several characters is taken apart."""
    forms = F.from_json(F.lit(json.dumps(_LONGER)), "map<string,string>")
    rest = lambda t: F.length(F.translate(t, "".join(_LONGER), ""))
    one = lambda p: F.when((F.length(p) == 1) & (rest(p) == 0), F.try_element_at(forms, p)).otherwise(p)
    joined = lambda t: F.array_join(F.transform(F.split(t, r"(?=[^\x00-\x7f])|(?<=[^\x00-\x7f])"), one), "")
    longer = lambda t: F.when(rest(t) < F.length(t), joined(t)).otherwise(t)
    single = lambda t: F.translate(t, "".join(_SINGLE), "".join(_FORMS[c] for c in _SINGLE))
    return _made_once(s, lambda t: F.when(F.length(t) == F.octet_length(t), t).otherwise(_made_once(single(t), longer)))


def _made_once(s: Column, use: Callable[[Column], Column]) -> Column:
    """use(s), where s is made once for all its places."""
    return F.get(F.transform(F.array(s), use), F.lit(0))


def clean_text(s: Column) -> Column:
    """Entities decoded, compatibility forms (NFKC) and typographic characters plain, tags to blanks, blanks joined.

    Null gives the empty text. Built-in expressions only, linear in the text. Characters beyond the basic plane, and letters
    followed by combining marks, stay as they are.
    """
    return F.trim(F.regexp_replace(_untagged(s), r"[\s\x{1680}\x{2028}\x{2029}]+", " "))


def _untagged(s: Column) -> Column:
    return F.regexp_replace(_plain_forms(decode_entities(F.coalesce(s.cast("string"), F.lit("")))), "<[^>]*>", " ")


def search_norm(s: Column) -> Column:
    """Cleaned, without diacritics, lower case; all but a-z, 0-9, %, dot and comma become single blanks."""
    plain = _made_once(_untagged(s), lambda t: F.when(F.length(t) == F.octet_length(t), t).otherwise(deaccent(t)))
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9%.,]+", " "))


def tokens(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda t: t != "")


# Abbreviations that are written with dots, in the order in which they are replaced.
ABBREVIATIONS = [
    (r"(?i)\bx\s*\.\s*o\s*\.?", "xo"), (r"(?i)\bv\s*\.\s*s\s*\.\s*o\s*\.\s*p\s*\.?", "vsop"), (r"(?i)\bv\s*\.\s*s\s*\.(?!\s*o)", "vs"),
    (r"(?i)\bn\s*\.\s*v\s*\.?", "nv"), (r"(?i)\bd\s*\.\s*o\s*\.\s*c\s*\.\s*g\s*\.?", "docg"), (r"(?i)\bd\s*\.\s*o\s*\.\s*c\s*\.?", "doc"),
    (r"(?i)\ba\s*\.\s*o\s*\.\s*c\s*\.?", "aoc"),
]


def retrieval_form(s: Column) -> Column:
    out = clean_text(s)
    for pattern, plain in ABBREVIATIONS:
        out = F.regexp_replace(out, pattern, plain)
    return search_norm(out)


def strip_noise(norm: Column, terms: Sequence[str]) -> Column:
    """Normalized text without whole-token phrases. A phrase is taken out once from left to right, as single blanks allow."""
    out = F.concat(F.lit(" "), norm, F.lit(" "))
    for t in terms:
        out = F.replace(out, F.lit(f" {t} "), F.lit(" "))
    return F.trim(F.regexp_replace(out, " +", " "))


def grams(norm: Column, n: int = 3) -> Column:
    """Distinct n-grams of the whole text, with two blanks before and one behind."""
    padded = F.concat(F.lit("  "), norm, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substring(padded, i, F.lit(n))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both))


def containment(a: Column, b: Column) -> Column:
    """Share of the shorter token list (repeats count) that the longer one has."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.filter(short, lambda t: F.array_contains(long, t))) / F.size(short))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / the longer length, of normalized texts; 0 where both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def name_similarity(a: Column, b: Column) -> Column:
    """0.4 trigrams + 0.35 tokens + 0.25 containment, of normalized texts."""
    ta, tb = tokens(a), tokens(b)
    return 0.4 * jaccard(grams(a), grams(b)) + 0.35 * jaccard(ta, tb) + 0.25 * containment(ta, tb)
