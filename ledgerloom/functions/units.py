"""Units of measured quantities: aliases, factors to the common unit, and amounts written in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Unit names and codes with the common unit (won, shares, ratio, m2, kg), factor and offset.
UNITS: list[tuple[str, str, float, float]] = [
    ("원", "won", 1.0, 0.0), ("won", "won", 1.0, 0.0), ("KRW", "won", 1.0, 0.0),
    ("천원", "won", 1e3, 0.0), ("KRW thousand", "won", 1e3, 0.0), ("thousands of won", "won", 1e3, 0.0), ("KRW_K", "won", 1e3, 0.0),
    ("만원", "won", 1e4, 0.0), ("KRW_MAN", "won", 1e4, 0.0),
    ("백만원", "won", 1e6, 0.0), ("KRW mn", "won", 1e6, 0.0), ("million won", "won", 1e6, 0.0), ("KRW million", "won", 1e6, 0.0), ("KRW_M", "won", 1e6, 0.0),
    ("억원", "won", 1e8, 0.0), ("hundred million KRW", "won", 1e8, 0.0), ("KRW_EOK", "won", 1e8, 0.0),
    ("십억원", "won", 1e9, 0.0), ("KRW bn", "won", 1e9, 0.0), ("KRW_B", "won", 1e9, 0.0),
    ("조원", "won", 1e12, 0.0), ("KRW trn", "won", 1e12, 0.0), ("KRW_T", "won", 1e12, 0.0),
    ("주", "shares", 1.0, 0.0), ("shares", "shares", 1.0, 0.0), ("SHR", "shares", 1.0, 0.0),
    ("천주", "shares", 1e3, 0.0), ("thousand shares", "shares", 1e3, 0.0), ("SHR_K", "shares", 1e3, 0.0),
    ("백만주", "shares", 1e6, 0.0), ("million shares", "shares", 1e6, 0.0), ("SHR_M", "shares", 1e6, 0.0),
    ("배", "ratio", 1.0, 0.0), ("ratio", "ratio", 1.0, 0.0), ("RATIO", "ratio", 1.0, 0.0),
    ("%", "ratio", 1e-2, 0.0), ("percent", "ratio", 1e-2, 0.0), ("퍼센트", "ratio", 1e-2, 0.0), ("PCT", "ratio", 1e-2, 0.0),
    ("per mille", "ratio", 1e-3, 0.0), ("‰", "ratio", 1e-3, 0.0), ("PML", "ratio", 1e-3, 0.0),
    ("bp", "ratio", 1e-4, 0.0), ("basis points", "ratio", 1e-4, 0.0), ("BPS", "ratio", 1e-4, 0.0),
    ("m2", "m2", 1.0, 0.0), ("㎡", "m2", 1.0, 0.0), ("sq m", "m2", 1.0, 0.0), ("제곱미터", "m2", 1.0, 0.0), ("SQM", "m2", 1.0, 0.0),
    ("ha", "m2", 1e4, 0.0), ("헥타르", "m2", 1e4, 0.0), ("HA", "m2", 1e4, 0.0),
    ("평", "m2", 3.305785, 0.0), ("pyeong", "m2", 3.305785, 0.0), ("PYG", "m2", 3.305785, 0.0),
    ("kg", "kg", 1.0, 0.0), ("킬로그램", "kg", 1.0, 0.0), ("KGM", "kg", 1.0, 0.0),
    ("t", "kg", 1e3, 0.0), ("톤", "kg", 1e3, 0.0), ("tonnes", "kg", 1e3, 0.0), ("TNE", "kg", 1e3, 0.0),
    ("kt", "kg", 1e6, 0.0), ("천톤", "kg", 1e6, 0.0), ("KTN", "kg", 1e6, 0.0),
]

NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"


def alias_key(c: Column) -> Column:
    """How alias and recorded unit are compared: lower case, no white space."""
    return F.regexp_replace(F.lower(c), r"(?U)\s+", "")


def alias_pattern() -> str:
    names = sorted({a for a, *_ in UNITS if "_" not in a}, key=lambda a: (-len(a), a))
    return "(?i:" + "|".join(n.replace(" ", r"\s*") for n in names) + ")"


def unit_table(spark: SparkSession) -> DataFrame:
    """alias, unit, factor, offset: a fixed table of about sixty rows."""
    rows = list(dict.fromkeys((a.lower().replace(" ", ""), u, f, o) for a, u, f, o in UNITS))
    return spark.createDataFrame(rows, "alias string, unit string, factor double, offset double")


def stated_unit(c: Column) -> Column:
    """A unit text without its wrapping: '(단위: 백만원)', 'unit: KRW mn', '단위 : %', '(in thousands of won)', '(in in thousands of won)'."""
    c = F.regexp_replace(c, r"^[\s(\[]+|[\s)\]]+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^[^:]*:\s*", ""), r"^(?i:(?:in\s+)+)", ""))


def negative(text: Column) -> Column:
    """Negative by accounting notation: triangle, minus, or the whole amount in brackets."""
    return text.rlike(r"^\s*(?:[△▲▽▼−]|-\s*(?:" + alias_pattern() + r"\s*)?[0-9]|\(.*\)\s*$)")


def mixed_words(text: Column) -> Column:
    """An amount in two or more scale words that ends in won, such as 7조 1,397억 5,125만 5,585원."""
    return text.rlike(r"[0-9]\s*[조억만천]\s*[0-9][0-9,]*\s*(?:[조억만천]\s*(?:[0-9]|원)|원)")


def words_to_won(text: Column) -> Column:
    """The amount of mixed scale words in won, without its sign."""
    parts = F.regexp_extract_all(F.replace(text, F.lit(",")), F.lit(r"([0-9]+(?:\.[0-9]+)?)\s*(조|억|만|천)?"), F.lit(0))
    scale = lambda p: F.when(p.contains("조"), 1e12).when(p.contains("억"), 1e8).when(p.contains("만"), 1e4).when(p.contains("천"), 1e3).otherwise(1.0)
    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + F.regexp_extract(p, r"[0-9.]+", 0).try_cast("double") * scale(p))


def shown_number(text: Column) -> Column:
    """The first number of a text, unsigned; null where there is none."""
    return F.replace(F.regexp_extract(text, NUMBER, 0), F.lit(",")).try_cast("double")
