"""Column expressions for privacy scrubbing and text normalisation.

Everything here is a built-in Spark SQL expression (JVM side, inside
whole-stage codegen); nothing calls back into Python per row.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------
# Redaction tags and PII patterns, applied in this order
# (EMAIL -> PHONE -> SSN -> ZIP -> IP -> CREDIT_CARD).  The order matters: a
# contiguous 13-digit card number is caught by PHONE first.
# ---------------------------------------------------------------------------------
REDACTION_TAGS = {
    "EMAIL": "[REDACTED_EMAIL]",
    "PHONE": "[REDACTED_PHONE]",
    "SSN": "[REDACTED_SSN]",
    "ZIP": "[REDACTED_ZIP]",
    "IP": "[REDACTED_IP]",
    "CREDIT_CARD": "[REDACTED_CC]",
    "PERSON": "[REDACTED_PERSON]",
    "ORG": "[REDACTED_ORG]",
    "GPE": "[REDACTED_LOCATION]",
    "LOC": "[REDACTED_LOCATION]",
}

PII_PATTERNS = [
    ("EMAIL", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"),
    ("PHONE", r"\b(?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{3}\)?[\s.-]?)\d{3}[\s.-]?\d{4}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("ZIP", r"\b\d{5}(?:-\d{4})?\b"),
    ("IP", r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b"),
    ("CREDIT_CARD", r"\b(?:\d[ -]*?){13,16}\b"),
]
PII_PATTERN = dict(PII_PATTERNS)

# Unicode-aware word characters; bare \w is ASCII-only in Java and RE2.
WORD = r"[\p{L}\p{N}_]"
# Fixed value: what Python takes for white space in str.strip, str.split and \s; Java's and RE2's \s is
# ASCII only.  Both engines read this class alike.
SPACE_CHARS = (r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
SPACE = f"[{SPACE_CHARS}]"
NON_WORD_NON_SPACE = rf"[^\p{{L}}\p{{N}}_{SPACE_CHARS}]"
# The same characters one by one, for functions that take no patterns.
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _java_replacement(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


def redact(col: Column, label: str) -> Column:
    """Replace every match of one PII pattern with its tag."""
    return F.regexp_replace(col, PII_PATTERN[label], _java_replacement(REDACTION_TAGS[label]))


def scrub_regex(col: Column, labels: list[str] | None = None) -> Column:
    """Ordered redaction chain (P7); null stays null."""
    out = col
    for label, _ in PII_PATTERNS:
        if labels is None or label in labels:
            out = redact(out, label)
    return out


def regex_hit_counts(col: Column) -> Column:
    """Struct of per-pattern hit counts, each counted on the text as already
    rewritten by the earlier patterns (P11)."""
    fields = []
    cur = col
    for label, pat in PII_PATTERNS:
        fields.append(F.coalesce(F.regexp_count(cur, F.lit(pat)), F.lit(0)).alias(label.lower()))
        cur = redact(cur, label)
    return F.struct(*fields)


# ---------------------------------------------------------------------------------
# HTML unescape (P12), JVM-side, by the rules of HTML5 as Python's ``html.unescape``
# applies them: the text is cut at '&' and each piece is decoded from its leading
# reference.  All tables come from Python's own HTML5 tables.
# ---------------------------------------------------------------------------------

def _named_by_letter() -> Column:
    """first character -> (reference with its ';', if any -> text): two short searches instead of a long one."""
    letters: dict[str, list] = {}
    for name, text in sorted(html.entities.html5.items()):
        letters.setdefault(name[0], []).append((name, text))
    inner = [F.map_from_arrays(F.array(*[F.lit(n) for n, _ in v]), F.array(*[F.lit(t) for _, t in v])) for v in letters.values()]
    return F.map_from_arrays(F.array(*[F.lit(c) for c in letters]), F.array(*inner))


# References that also count without ';', the longest first, so that the longest prefix matches.
_OPEN_NAMES = "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
_TOO_LARGE = 0x110000


def _codepoint_to_str(cp: Column) -> Column:
    """Text of a numeric reference: remapped below U+00A0 (Windows-1252, dropped controls), U+FFFD for
    surrogates and beyond Unicode, nothing for non-characters."""
    low = F.array(*[F.lit(html.unescape(f"&#{i};")) for i in range(0xA0)])
    bmp = F.decode(F.unhex(F.lpad(F.hex(cp), 4, "0")), "UTF-16BE")
    v = cp - 0x10000
    hi = F.lit(0xD800) + F.shiftright(v, 10)
    lo = F.lit(0xDC00) + (v % 1024)
    astral = F.decode(F.unhex(F.concat(F.hex(hi), F.hex(lo))), "UTF-16BE")
    bad = ((cp >= 0xD800) & (cp <= 0xDFFF)) | (cp >= _TOO_LARGE)
    none = ((cp >= 0xFDD0) & (cp <= 0xFDEF)) | (cp.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return (F.when(cp < 0xA0, F.element_at(low, (cp + 1).cast("int"))).when(bad, F.lit("\ufffd")).when(none, F.lit(""))
            .when(cp < 0x10000, bmp).otherwise(astral))


def html_unescape(col: Column) -> Column:
    names = _named_by_letter()

    def number(digits: Column, longest: int, value: Column) -> Column:
        """Digits without leading zeros; more than ``longest`` of them are beyond Unicode anyway."""
        return (F.when(F.length(digits) > longest, F.lit(_TOO_LARGE).cast("long")).when(digits == "", F.lit(0).cast("long"))
                .otherwise(value))

    def decode_piece(p: Column) -> Column:
        dec, hexd = F.regexp_extract(p, r"^#[0-9]+;?", 0), F.regexp_extract(p, r"^#[xX][0-9a-fA-F]+;?", 0)
        dec_digits, hex_digits = F.regexp_extract(p, r"^#0*([0-9]*)", 1), F.regexp_extract(p, r"^#[xX]0*([0-9a-fA-F]*)", 1)
        name = F.regexp_extract(p, r"^[^\t\n\f <&#;]{1,32};?", 0)
        named = F.element_at(F.element_at(names, F.substring(name, 1, 1)), name)
        prefix = F.regexp_extract(p, f"^(?:{_OPEN_NAMES})", 0)
        open_named = F.element_at(F.element_at(names, F.substring(prefix, 1, 1)), prefix)

        def rest(found: Column) -> Column:
            return F.substring(p, F.length(found) + 1, 1 << 30)
        return (F.when(dec != "", F.concat(_codepoint_to_str(number(dec_digits, 7, dec_digits.try_cast("long"))), rest(dec)))
                .when(hexd != "", F.concat(_codepoint_to_str(number(hex_digits, 6, F.conv(hex_digits, 16, 10).try_cast("long"))), rest(hexd)))
                .when((name != "") & named.isNotNull(), F.concat(named, rest(name)))
                .when((name != "") & (prefix != ""), F.concat(open_named, rest(prefix)))
                .otherwise(F.concat(F.lit("&"), p)))

    pieces = F.split(col, "&", -1)
    rest = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    decoded = F.concat(F.element_at(pieces, 1),
                       F.array_join(F.transform(rest, decode_piece), ""))
    return F.when(col.isNull(), col).when(F.instr(col, "&") == 0, col).otherwise(decoded)


# ---------------------------------------------------------------------------------
# Normalisation
# ---------------------------------------------------------------------------------

def strip_unicode(col: Column) -> Column:
    """Python ``str.strip()``: drop leading/trailing whitespace (not only spaces)."""
    return F.btrim(col, F.lit(SPACES))


def normalize_text(col: Column) -> Column:
    """Lower-case, punctuation -> space (keep letters, digits, ``_``)."""
    return F.regexp_replace(F.lower(col), NON_WORD_NON_SPACE, " ")


def lemmatize(col: Column, lemma_map: Column | None = None) -> Column:
    """Whitespace tokens, each mapped through a lemma dictionary, joined by one space."""
    toks = words(col)
    if lemma_map is not None:
        toks = F.transform(toks, lambda w: F.coalesce(F.element_at(lemma_map, w), w))
    return F.array_join(toks, " ")


def normalize_ticket_text(col: Column) -> Column:
    """Lower, strip, drop ``{placeholder}`` spans, collapse whitespace, strip."""
    t = F.regexp_replace(F.lower(col), r"\{[^{}]+\}", " ")
    return F.array_join(words(t), " ")  # no blank at the ends, one between words


def compose_text(description: Column) -> Column:
    """Model text from the description only; null becomes ''."""
    return normalize_ticket_text(strip_unicode(F.lower(F.coalesce(description, F.lit("")))))


def tokenize(col: Column) -> Column:
    """P20: word tokens of the lower-cased text (Unicode letters, digits, underscore)."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def age_bucket(col: Column, size: int = 5) -> Column:
    """Numeric ages -> ``"lo-hi"`` (truncate, then floor to the bucket);
    non-numeric values are kept as they are, null stays null."""
    # the form of a number first: Java also reads "25d" and "25f"
    number = F.when(col.rlike(rf"^{SPACE}*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?{SPACE}*\z"), strip_unicode(col))
    age = number.try_cast("double").try_cast("long")  # truncation toward zero, like int(float(x))
    lo = F.floor(age / F.lit(size)) * size
    return (F.when(col.isNull(), col)
            .when(age.isNull(), col)
            .otherwise(F.concat(lo.cast("string"), F.lit("-"), (lo + size).cast("string"))))


def count_char(col: Column, ch: str) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(ch), F.lit("")))


def words(col: Column) -> Column:
    """Python ``str.split()``: whitespace-separated, empty pieces dropped."""
    return F.array_remove(F.split(F.translate(col, SPACES, " " * len(SPACES)), " "), "")
