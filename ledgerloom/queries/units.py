"""Queries of problem 3 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import GREEK, GREEK_AS, CYRILLIC, CYRILLIC_AS, NARROW, SPACES, WIDE
from ledgerloom.functions.units import UNITS
from ledgerloom.operators.unit_conversion import amount_links, convert, same_amounts
from ledgerloom.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_amounts(table(spark, sf_dir, "facts"))


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without its pairs: every fact with its class and its number of partners."""
    return amount_links(table(spark, sf_dir, "facts"))


def p3_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = convert(table(spark, sf_dir, "facts"))
    return df.select("fact_id", "amount", "amount_unit", "amount_factor", "amount_common", "unit_from").where("amount IS NOT NULL")


def p3_units_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of quantity is recorded at each scale and place."""
    df = convert(table(spark, sf_dir, "facts")).where("amount_unit IS NOT NULL")
    return df.groupBy("amount_unit", "amount_factor", "unit_from").agg(F.count("*").alias("facts"))


QUERIES = {"p3_found": p3_found, "p3_links": p3_links, "p3_converted": p3_converted, "p3_units_used": p3_units_used}

NARROW_SQL = NARROW.replace("'", "''")
_ALIASES = sorted({(a.lower().replace(" ", ""), u, f) for a, u, f, _ in UNITS})
_PATTERN = "(?i:" + "|".join(n.replace(" ", r"\s*") for n in sorted({a for a, *_ in UNITS if "_" not in a}, key=lambda a: (-len(a), a))) + ")"
_FOLD = f"translate(regexp_replace(translate(nfc_normalize(key), '{WIDE}{SPACES}', '{NARROW_SQL}{' ' * len(SPACES)}'), '[\\p{{Cf}}\\x{{180E}}]', '', 'g'), '{CYRILLIC}{GREEK}', '{CYRILLIC_AS}{GREEK_AS}')"
_NUM = r"[0-9][0-9,]*(?:\.[0-9]+)?"
_SQUASH = "nullif(regexp_replace(lower({}), '\\s+', '', 'g'), '')"
_CLEAN = _SQUASH.format("regexp_replace(regexp_replace(regexp_replace({}, '^[\\s(\\[]+|[\\s)\\]]+$', '', 'g'), '^[^:]*:\\s*', ''), '^(?i:(?:in\\s+)+)', '')")

#: Amount, unit and factor as recorded, one row per fact.
RECORDED_SQL = f"""
WITH aliases(alias, unit, factor) AS (VALUES {", ".join(f"('{a}', '{u}', {f!r}::DOUBLE)" for a, u, f in _ALIASES)}),
base AS (
  SELECT f.*, regexp_matches(value_text, '[0-9]\\s*[조억만천]\\s*[0-9][0-9,]*\\s*(?:[조억만천]\\s*(?:[0-9]|원)|원)') AS mixed,
    coalesce(regexp_matches(value_text, '^\\s*[0-9]{{4}}\\s*[-./년]\\s*[0-9]{{1,2}}\\s*[-./월]\\s*[0-9]{{1,2}}\\s*일?\\s*$'), false)
      OR coalesce(unit_code = 'PERIODYMD', false) OR value_date IS NOT NULL AS dated,
    coalesce(regexp_matches(unit_value, '^[0-9]+(\\.[0-9]+)?$'), false) AS scaled
  FROM facts f),
parsed AS (
  SELECT *,
    CASE WHEN dated THEN NULL
      WHEN value_text IS NULL THEN value_num
      WHEN mixed THEN list_sum(list_transform(regexp_extract_all(replace(value_text, ',', ''), '[0-9]+(?:\\.[0-9]+)?\\s*[조억만천]?'),
        lambda p: regexp_extract(p, '[0-9.]+')::DOUBLE * CASE WHEN contains(p, '조') THEN 1e12 WHEN contains(p, '억') THEN 1e8 WHEN contains(p, '만') THEN 1e4 WHEN contains(p, '천') THEN 1e3 ELSE 1 END))
      WHEN regexp_matches(value_text, '^\\s*[△▲▽▼−(-]*\\s*(?:{_PATTERN}\\s*)?{_NUM}\\s*(?:(?i:in\\s+)?{_PATTERN})?\\s*\\)?\\s*$') THEN try_cast(replace(regexp_extract(value_text, '{_NUM}'), ',', '') AS DOUBLE)
    END * CASE WHEN value_text IS NOT NULL AND regexp_matches(value_text, '^\\s*(?:[△▲▽▼−]|-\\s*(?:{_PATTERN}\\s*)?[0-9]|\\(.*\\)\\s*$)') THEN -1 ELSE 1 END AS amount,
    CASE WHEN mixed THEN {{'alias': '원', 'at': 'words'}}
      WHEN {_CLEAN.format("value_unit")} IS NOT NULL THEN {{'alias': {_CLEAN.format("value_unit")}, 'at': 'value_unit'}}
      WHEN unit_code <> 'PERIODYMD' AND trim(unit_code) <> '' THEN {{'alias': lower(trim(unit_code)), 'at': 'unit_code'}}
      WHEN NOT scaled AND {_CLEAN.format("unit_value")} IS NOT NULL THEN {{'alias': {_CLEAN.format("unit_value")}, 'at': 'unit_value'}}
      WHEN {_SQUASH.format(f"regexp_extract(value_text, '{_PATTERN}')")} IS NOT NULL THEN {{'alias': {_SQUASH.format(f"regexp_extract(value_text, '{_PATTERN}')")}, 'at': 'value_text'}}
      WHEN key IS NOT NULL THEN {{'alias': {_SQUASH.format(f"regexp_extract({_FOLD}, '[(\\[](?:[^()\\[\\]:]*:)?\\s*(?i:in\\s+)?({_PATTERN})\\s*[)\\]]', 1)")}, 'at': 'key'}}
    END AS found
  FROM base),
recorded AS (
  SELECT p.*, unit, factor * CASE WHEN found.at = 'unit_code' AND scaled THEN unit_value::DOUBLE ELSE 1 END AS factor, CASE WHEN unit IS NOT NULL THEN found.at END AS shown_at
  FROM parsed p LEFT JOIN aliases ON found.alias = aliases.alias)
"""
CONVERTED_SQL = (
    RECORDED_SQL
    + """,
shown AS (SELECT *, coalesce(field_code, key_norm) AS item FROM recorded WHERE unit IS NOT NULL AND amount IS NOT NULL),
kinds AS (SELECT item, arg_max(unit, (n, unit)) AS kind FROM (SELECT item, unit, count(*) AS n FROM shown GROUP BY ALL) GROUP BY item),
usual AS (SELECT doc_id, unit, arg_max(factor, (n, factor)) AS usual FROM (SELECT doc_id, unit, factor, count(*) AS n FROM shown GROUP BY ALL) GROUP BY ALL),
filled AS (
  SELECT r.fact_id, r.amount, coalesce(r.unit, k.kind) AS amount_unit, CASE WHEN r.unit IS NOT NULL THEN r.factor WHEN k.kind IS NOT NULL THEN coalesce(usual, 1) END AS amount_factor,
    CASE WHEN r.unit IS NOT NULL THEN shown_at WHEN usual IS NOT NULL THEN 'filing' WHEN k.kind IS NOT NULL THEN 'item' END AS unit_from
  FROM recorded r LEFT JOIN kinds k ON coalesce(r.field_code, r.key_norm) = k.item LEFT JOIN usual u ON r.doc_id = u.doc_id AND k.kind = u.unit
  WHERE r.amount IS NOT NULL)
"""
)
_OWN = (
    RECORDED_SQL
    + """,
own AS (SELECT fact_id, correction_group_id AS g, field_code AS f, unit, factor, amount * factor AS v FROM recorded
  WHERE value_owner IS NULL AND correction_group_id IS NOT NULL AND field_code IS NOT NULL AND unit IS NOT NULL AND amount IS NOT NULL)
"""
)
ORACLES = {
    "p3_links": _OWN
    + """, l AS (SELECT a.fact_id, count(*) AS n FROM own a JOIN own b ON a.g = b.g AND a.f = b.f AND a.unit = b.unit AND a.factor <> b.factor AND abs(a.v - b.v) <= 0.001 * greatest(abs(a.v), abs(b.v)) GROUP BY 1)
SELECT fact_id, min(fact_id) OVER (PARTITION BY g, f, unit, factor, v) AS class_id, coalesce(n, 0) AS n_links FROM own LEFT JOIN l USING (fact_id)""",
    "p3_found": _OWN
    + """SELECT a.fact_id AS fact_id_a, b.fact_id AS fact_id_b FROM own a JOIN own b ON a.g = b.g AND a.f = b.f AND a.unit = b.unit AND a.factor <> b.factor AND a.fact_id < b.fact_id
WHERE abs(a.v - b.v) <= 0.001 * greatest(abs(a.v), abs(b.v))""",
    "p3_converted": CONVERTED_SQL
    + "SELECT fact_id, amount, amount_unit, amount_factor, amount * amount_factor AS amount_common, unit_from FROM filled",
    "p3_units_used": CONVERTED_SQL + "SELECT amount_unit, amount_factor, unit_from, count(*) AS facts FROM filled WHERE amount_unit IS NOT NULL GROUP BY ALL",
}
