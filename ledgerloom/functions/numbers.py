"""Values stated as text, amounts in words, rates and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.dates import day_of_text
from ledgerloom.functions.text import NARROW, WIDE

# Won units from the largest, so that a longer name is found before its ending.
WON_UNITS = [("조원", 1e12), ("십억원", 1e9), ("억원", 1e8), ("천만원", 1e7), ("백만원", 1e6), ("십만원", 1e5), ("만원", 1e4), ("천원", 1e3), ("원", 1.0)]
SCALES = [("백만", 1e6), ("조", 1e12), ("억", 1e8), ("만", 1e4), ("천", 1e3)]
EMPTY_VALUES = ["", "-", "–", "해당사항 없음", "해당사항없음", "해당없음", "N/A", "없음", "미해당"]


def won_unit(c: Column) -> Column:
    """The first won unit a text contains, the largest first; empty where there is none."""
    bare = F.regexp_replace(c, r"(?U)[\s​]", "")
    out = F.when(F.lit(False), F.lit(""))
    for name, _ in WON_UNITS:
        out = out.when(F.contains(bare, F.lit(name)), F.lit(name))
    return F.coalesce(out.otherwise(F.lit("")), F.lit(""))


def won_factor(unit: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, factor in WON_UNITS:
        out = out.when(unit == name, F.lit(factor))
    return out


def to_won(value: Column, unit: Column) -> Column:
    return value * won_factor(won_unit(unit))


def _digits(c: Column) -> Column:
    return F.replace(c, F.lit(","))


def compound_amount(text: Column) -> Column:
    """Two or more scale words with an optional unscaled tail, in won; null for anything else."""
    bare = _digits(F.regexp_replace(text, r"(?U)\s+", ""))
    shape = bare.rlike(r"^-?(?:[0-9]+(?:\.[0-9]+)?[조억만천]){2,}(?:[0-9]+(?:\.[0-9]+)?)?원?$|^-?[0-9]+(?:\.[0-9]+)?[조억만천][0-9]+(?:\.[0-9]+)?원?$")
    parts = F.regexp_extract_all(bare, F.lit(r"([0-9]+(?:\.[0-9]+)?)([조억만천]?)"), F.lit(0))
    scale = lambda p: F.when(p.contains("조"), 1e12).when(p.contains("억"), 1e8).when(p.contains("만"), 1e4).when(p.contains("천"), 1e3).otherwise(1.0)
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.regexp_extract(p, r"[0-9.]+", 0).try_cast("double") * scale(p))
    return F.when(shape, F.when(bare.startswith("-"), -total).otherwise(total))


def parse_value(text: Column, unit_value: Column) -> Column:
    """struct(num, unit, date) of a stated value, tried in this order: nothing stated, date, sign marks, compound amount, number, one scale word, unit suffix."""
    s = F.trim(F.translate(text, WIDE, NARROW))
    empty = s.isNull() | s.isin(EMPTY_VALUES)
    date = F.coalesce(day_of_text(F.when(unit_value.rlike(r"^[0-9]{8}$"), unit_value)), day_of_text(s))
    marked = s.rlike(r"^[△▲▽▼]")
    wrapped = s.rlike(r"^\(\s*[0-9][0-9,.]*\s*\)$")
    bare = F.trim(F.regexp_replace(F.regexp_replace(s, r"^[△▲▽▼]\s*", ""), r"^\(\s*([0-9][0-9,.]*)\s*\)$", "$1"))
    number = F.when(bare.rlike(r"^-?[0-9][0-9,]*(?:\.[0-9]+)?$"), _digits(bare).try_cast("double"))
    one = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, factor in SCALES:
        one = one.when(bare.rlike(rf"^-?[0-9][0-9,]*(?:\.[0-9]+)?\s*{name}\s*원?$"), _digits(F.regexp_extract(bare, r"^-?[0-9][0-9,.]*", 0)).try_cast("double") * factor)
    suffix = F.regexp_extract(bare, r"^-?[0-9][0-9,]*(?:\.[0-9]+)?\s*(%p|%|원|주)$", 1)
    tail = F.when(suffix != "", _digits(F.regexp_extract(bare, r"^-?[0-9][0-9,]*(?:\.[0-9]+)?", 0)).try_cast("double"))
    compound = compound_amount(bare)
    plain = F.coalesce(compound, number, one, tail)
    num = F.when(marked | wrapped, -F.abs(plain)).otherwise(plain)
    unit = F.when(compound.isNotNull() | one.isNotNull(), "원").when(number.isNull() & (suffix != ""), suffix)
    no = F.lit(None)
    return F.struct(F.when(empty | date.isNotNull(), no).otherwise(num).alias("num"), F.when(empty | date.isNotNull(), no).otherwise(unit).alias("unit"), F.when(~empty, date).alias("date"))


def read_out_won(won: Column, max_terms: int = 2) -> Column:
    """An amount in 조, 억, 만 and won, at most max_terms of them: 3_112_850_000_000 is 3조 1,128억원."""
    whole = F.abs(F.bround(won, 0)).cast("long")
    terms = []
    for name, scale, above in (("조", 10**12, None), ("억", 10**8, 10**4), ("만", 10**4, 10**4), ("", 1, 10**4)):
        n = F.floor(whole / F.lit(scale)).cast("long") if above is None else F.pmod(F.floor(whole / F.lit(scale)).cast("long"), F.lit(above))
        terms.append(F.when(n > 0, F.concat(F.format_number(n, 0), F.lit(name))))
    text = F.concat(F.array_join(F.slice(F.array_compact(F.array(*terms)), 1, max_terms), " "), F.lit("원"))
    zero = F.bround(won, 0) == 0
    return F.when(zero, "0원").otherwise(F.concat(F.when(won < 0, "-").otherwise(""), text))


def same_ratio(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Whether two figures are one ratio: equal, or the one under 1 is the other in percent."""
    close = lambda x, y: F.abs(x - y) <= F.greatest(F.abs(x), F.abs(y)) * tolerance + 1e-12
    return close(a, b) | ((F.abs(a) < 1) & close(a * 100, b)) | ((F.abs(b) < 1) & close(b * 100, a))


def growth(before: Column, after: Column) -> Column:
    """Percent change, null on a zero base, rounded half-even to 4 places."""
    return F.when(before != 0, F.bround((after - before) / F.abs(before) * 100, 4))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.bround(part / whole * 100, 4))


def cagr(first: Column, last: Column, years: Column) -> Column:
    """Yearly growth in percent; null for a non-positive end or span."""
    return F.when((first > 0) & (last > 0) & (years > 0), F.bround((F.pow(last / first, F.lit(1.0) / years) - 1) * 100, 4))


def name_key(c: Column) -> Column:
    """Company name without legal forms, brackets, white space and case."""
    bare = F.regexp_replace(F.lower(c), r"\(주\)|㈜|주식회사|유한회사|\b(?:co|ltd|inc|corp|corporation|company|limited|plc)\b\.?", "")
    return F.regexp_replace(bare, r"(?U)[\s()\[\]{}.,·&'\"-]", "")


def symbol_key(c: Column) -> Column:
    """Report or item name without white space and punctuation, for comparisons."""
    return F.regexp_replace(c, r"""(?U)[\sㆍ·・‧∙、,()\[\]{}<>「」『』"'’‘“”．.\-–—/]""", "")


def has_final_consonant(c: Column) -> Column:
    """Whether the last letter of a Korean word ends in a consonant; false for other letters."""
    cp = F.ascii(F.substring(c, -1, 1)) - 0xAC00
    return F.coalesce((cp >= 0) & (cp < 11172) & (F.pmod(cp, F.lit(28)) > 0), F.lit(False))
