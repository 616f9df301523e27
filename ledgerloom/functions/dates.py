"""Dates kept as strings, periods named in text, and calendar arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def filing_day(c: Column) -> Column:
    """yyyyMMdd of the usual spellings of a date; null for anything else."""
    part = lambda i: F.lpad(F.regexp_extract(c, r"^\s*([0-9]{4})[^0-9]+([0-9]{1,2})[^0-9]+([0-9]{1,2})", i), 2, "0")
    year = F.regexp_extract(c, r"^\s*([0-9]{4})[^0-9]", 1)
    return F.when(c.rlike(r"^\s*[0-9]{8}\s*$"), F.trim(c)).when(c.rlike(r"^\s*[0-9]{4}[^0-9]+[0-9]{1,2}[^0-9]+[0-9]{1,2}\D*$"), F.concat(year, part(2), part(3)))


def day_of_text(c: Column) -> Column:
    """The yyyyMMdd a value states as its whole text; null where it states no valid date."""
    day = filing_day(c)
    return F.when(F.try_to_date(day, "yyyyMMdd").isNotNull(), day)


def days_between(a: Column, b: Column) -> Column:
    """Days from a to b, both yyyyMMdd; null for an invalid date."""
    return F.datediff(F.try_to_date(b, "yyyyMMdd"), F.try_to_date(a, "yyyyMMdd"))


def full_months_between(a: Column, b: Column) -> Column:
    """Complete months from a to b: the last month counts only if its day is reached."""
    x, y = F.try_to_date(a, "yyyyMMdd"), F.try_to_date(b, "yyyyMMdd")
    return (F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x) - F.when(F.day(y) < F.day(x), 1).otherwise(0)


# The month a named part of the year ends with.
QUARTER_ENDS = {"1": "03", "2": "06", "3": "09", "4": "12"}
_YEAR = r"(20\d{2}|19\d{2})"


def period_tokens(text: str | None) -> list[str]:
    """Periods a text names, as YYYY or YYYY-MM in order of appearance: quarters and the first half end in their last month, the second half is the year."""
    if not text:
        return []
    out, spans = [], []
    patterns = (
        (_YEAR + r"\s*(?:년)?\s*(?:제)?([1-4])\s*(?:분기|[qQ])", lambda m: f"{m[1]}-{QUARTER_ENDS[m[2]]}"),
        (_YEAR + r"\s*[qQ]([1-4])", lambda m: f"{m[1]}-{QUARTER_ENDS[m[2]]}"),
        (_YEAR + r"\s*(?:년)?\s*(?:상반기|반기)", lambda m: f"{m[1]}-06"),
        (_YEAR + r"\s*(?:년)?\s*하반기", lambda m: m[1]),
        (_YEAR + r"\s*년\s*(1[0-2]|0?[1-9])\s*월", lambda m: f"{m[1]}-{int(m[2]):02d}"),
        (_YEAR + r"[-./](1[0-2]|0?[1-9])(?!\d)", lambda m: f"{m[1]}-{int(m[2]):02d}"),
        (r"(?<!\d)" + _YEAR + r"(?!\d)", lambda m: m[1]),
    )
    for pattern, token in patterns:
        for m in re.finditer(pattern, text):
            if not any(a < m.end() and m.start() < b for a, b in spans):
                spans.append(m.span())
                out.append((m.start(), token(m)))
    return list(dict.fromkeys(t for _, t in sorted(out)))


def periods_of(texts: list[str]) -> list[str]:
    """Every entry parsed on its own, then merged in order without repeats."""
    return list(dict.fromkeys(t for x in texts for t in period_tokens(x)))


def matches_period(period: Column, day: Column, tokens: Column) -> Column:
    """Whether a document covers one of the periods asked for.

    Its period, the period's year and its filing year are candidates; a document without a period is compared by year
    only; one without any date matches nothing; asking for nothing matches all.
    """
    has = F.coalesce(F.length(period) > 0, F.lit(False))
    year = F.substring(day, 1, 4)
    candidates = F.array_compact(F.array(F.when(has, period), F.when(has, F.substring(period, 1, 4)), F.when(F.length(day) >= 4, year)))
    by_year = F.transform(tokens, lambda t: F.substring(t, 1, 4))
    hit = F.arrays_overlap(candidates, tokens) | (~has & F.coalesce(F.array_contains(by_year, year), F.lit(False)))
    return (F.size(tokens) == 0) | F.coalesce(hit, F.lit(False))
