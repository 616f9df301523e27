"""Character-level expressions that run inside the JVM: look-alikes, widths, composition, names and keys."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts that are drawn like a Latin letter (Unicode confusables).
CYRILLIC = "аеорсухіјѕһԁԛԝӏАВЕЅІЈКМНОРСТУХԚԜҮ"
CYRILLIC_AS = "aeopcyxijshdqwlABESIJKMHOPCTYXQWY"
GREEK = "ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
GREEK_AS = "ovABEZHIKMNOPTYX"

LOOKALIKE, LATIN = CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS
# Full-width forms U+FF01..U+FF5E are ASCII shifted by 0xFEE0.
_FULL = "".join(map(chr, range(0xFF01, 0xFF5F)))
# Mathematical letters and digits (bold, italic, script ...) that stand for one Latin letter or digit, by the Unicode tables.
_MATHS = "".join(c for c in map(chr, range(0x1D400, 0x1D800)) if (n := unicodedata.normalize("NFKC", c)) != c and len(n) == 1 and n.isascii())
WIDE = _FULL + _MATHS
NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _FULL) + unicodedata.normalize("NFKC", _MATHS)
SPACES = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "㈜": "(주)"}

#: Characters that make a text suspicious: marks, formats, exotic spaces, compatibility forms, conjoining jamo, other scripts with look-alikes.
SUSPICIOUS = (
    r"[\p{Mn}\p{Cf}\u00A0\u1680\u180E\u2000-\u200A\u202F\u205F\u3000\u0370-\u03FF\u0400-\u052F"
    r"\u1100-\u11FF\uA960-\uA97F\uD7B0-\uD7FF\uFB00-\uFB06\uFF00-\uFFEF\u321C\x{1D400}-\x{1D7FF}]"
)
#: Greek and Cyrillic letters that look like no Latin one.
FOREIGN = "[\\u0370-\\u03FF\\u0400-\\u052F&&[\\p{L}]&&[^" + LOOKALIKE + "]]"
JAMO = r"[\u1100-\u1112][\u1161-\u1175][\u11A8-\u11C2]?"


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once: an expression that uses its input several times would otherwise repeat it as a tree."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def fold_width(c: Column) -> Column:
    """Full-width forms, exotic spaces and ligatures as plain characters; format characters removed; outer space trimmed."""
    c = F.regexp_replace(F.translate(c, WIDE + SPACES, NARROW + " " * len(SPACES)), r"[\p{Cf}\u180E]", "")
    for k, v in LIGATURES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return F.trim(c)


def lookalikes_to_latin(c: Column) -> Column:
    return F.translate(c, LOOKALIKE, LATIN)


def latin_to_cyrillic(c: Column) -> Column:
    """The other way round, for names in Cyrillic in which Latin letters hide."""
    pairs = dict(reversed(list(zip(CYRILLIC_AS, CYRILLIC, strict=True))))
    for g, latin in zip(GREEK, GREEK_AS, strict=True):
        if latin in pairs:
            pairs[g] = pairs[latin]
    return F.translate(c, "".join(pairs), "".join(pairs.values()))


def _composed_pairs() -> list[tuple[str, str]]:
    """Decomposed spelling and composed letter of Latin, Greek and Cyrillic letters, by the Unicode tables."""
    out = []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x400, 0x460)]:
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) > 1 and unicodedata.normalize("NFC", d) == chr(cp):
            out.append((d, chr(cp)))
    return sorted(out, key=lambda p: (-len(p[0]), p[0]))


def compose_hangul(c: Column) -> Column:
    """Conjoining jamo as precomposed syllables, by the arithmetic of the Unicode standard."""

    def syllable(x: Column) -> Column:
        part = lambda i, base: F.ascii(F.substring(x, i, 1)) - F.lit(base)
        cp = F.lit(0xAC00) + (part(1, 0x1100) * 21 + part(2, 0x1161)) * 28 + F.when(F.length(x) == 3, part(3, 0x11A7)).otherwise(0)
        return F.when(x.rlike("^" + JAMO), F.decode(F.unhex(F.hex(cp)), "UTF-16BE")).otherwise(x)

    def composed(x: Column) -> Column:
        parts = F.regexp_extract_all(x, F.lit("(?s)" + JAMO + "|."), F.lit(0))
        return F.when(x.rlike("[\\u1100-\\u1112]"), F.array_join(F.transform(parts, syllable), "")).otherwise(x)

    return bound(c, composed)


def compose_accents(c: Column) -> Column:
    """Base letter and combining mark as the composed letter, where Unicode has one."""

    # One literal that the optimiser folds into a map: thousands of literals would weigh on the plan and the driver.
    pairs = ",".join(f"{k}={v}" for k, v in _composed_pairs() if len(k) == 2)
    table = F.str_to_map(F.lit(pairs), F.lit(","), F.lit("="))

    def replaced(x: Column) -> Column:
        pieces = F.regexp_extract_all(x, F.lit("(?s)\\p{L}\\p{Mn}|."), F.lit(0))
        return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")

    return bound(c, lambda x: F.when(x.rlike("\\p{Mn}"), replaced(replaced(x))).otherwise(x))


def compose(c: Column) -> Column:
    """Canonical composition of the letters that occur in names (Hangul, Latin, Greek, Cyrillic)."""
    return compose_accents(compose_hangul(c))


def strip_accents(c: Column) -> Column:
    """Composed Latin letters without their accents."""
    single = {p[1]: p[0][0] for p in _composed_pairs() if p[0][0].isascii()}
    return F.translate(c, "".join(single), "".join(single.values()))


def plain(c: Column) -> Column:
    """Plain spelling of a text: widths, spaces and invisible characters folded, look-alikes in the script of the rest, composed.

    Null stays null; a text without suspicious characters is returned as it is.
    """

    def spelled(x: Column) -> Column:
        mapped = F.when(x.rlike(FOREIGN), latin_to_cyrillic(x)).otherwise(lookalikes_to_latin(x))
        return compose(mapped)

    def plainly(x: Column) -> Column:
        return F.when(x.rlike(SUSPICIOUS), bound(compose(fold_width(x)), spelled)).otherwise(x)

    return bound(c, plainly)


def normalise_key(c: Column) -> Column:
    """Item name without leading numbering or bullet, trailing parenthetical, colon, and all white space."""
    c = F.regexp_replace(c, r"(?U)^\s*(?:[※\-•·○▶■]\s*|\(?[0-9]{1,2}[.)]\s*|[가-하][.)]\s*)+", "")
    c = F.regexp_replace(c, r"(?U)\s*\([^()]*\)\s*$", "")
    return F.regexp_replace(F.regexp_replace(c, r"(?U)[:：]\s*$", ""), r"(?U)\s+", "")
