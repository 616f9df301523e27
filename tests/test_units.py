import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import compose, normalise_key, plain
from ledgerloom.operators.unit_conversion import convert, same_amounts

SCHEMA = (
    "fact_id long, doc_id string, correction_group_id string, field_code string, key string, key_norm string, value_text string, "
    "value_num double, value_unit string, value_date string, unit_code string, unit_value string, value_owner string, amount string"
)


def fact(i, text, unit=None, code=None, value=None, key="Total assets", num=None, group="g", field="F311", owner=None, date=None, doc="periodic_1"):
    return (i, doc, group, field, key, key, text, num, unit, date, code, value, owner, "clash")


def amounts(spark, rows):
    out = convert(spark.createDataFrame(rows, SCHEMA))
    return {r.fact_id: r for r in out.collect()}


@pytest.mark.parametrize(
    ("row", "unit", "common"),
    [
        (("1,234", "백만원"), "won", 1234e6),
        (("1,234", "unit: KRW mn"), "won", 1234e6),
        (("△ 5", None, "KRW", "1000"), "won", -5000.0),
        (("(7.5)", None, "KRW_EOK"), "won", -7.5e8),
        (("7조 1,397억 5,125만 5,585원", "백만원"), "won", 7139751255585.0),
        (("-KRW thousand 28861.5",), "won", -28861500.0),
        (("99.5 in thousands of won",), "won", 99500.0),
        (("10 평",), "m2", 33.05785),
        (("250", "bp"), "ratio", 0.025),
        (("4.2", None, None, "(in 천톤)"), "kg", 4.2e6),
        (("12", None, None, None, "보유주식수 (단위: 백만주)"), "shares", 12e6),
    ],
)
def test_units_are_converted(spark, row, unit, common):
    text, *rest = row
    got = amounts(spark, [fact(1, text, *rest)])[1]
    assert got.amount_unit == unit
    assert got.amount_common == pytest.approx(common)


def test_defined_cases(spark):
    rows = [fact(1, None), fact(2, ""), fact(3, "2025-01-30"), fact(4, "중앙아시아 3개국"), fact(5, None, "원", num=12.0), fact(6, "5", None, "PERIODYMD", "20250101"), fact(7, "9", "furlongs", field=None), fact(8, "x" * 100_000), (9, *[None] * 13)]
    got = amounts(spark, rows)
    assert len(got) == len(rows)
    assert all(got[i].amount is None for i in (1, 2, 3, 4, 6, 8, 9))
    assert got[5].amount_common == 12.0
    assert got[7].amount == 9.0


def test_default_is_the_filings_usual_unit(spark):
    got = amounts(spark, [fact(1, "3", "천원"), fact(2, "4", "천원"), fact(3, "5", "백만원"), fact(4, "6"), fact(5, "7", doc="periodic_2")])
    assert (got[4].amount_common, got[4].unit_from) == (6000.0, "filing")
    assert (got[5].amount_common, got[5].unit_from) == (7.0, "item")


def test_pairs_need_units_of_different_size(spark):
    rows = [fact(1, "1,000", "천원"), fact(2, "1.0004", "백만원"), fact(3, "1,000", "KRW thousand"), fact(4, "1,002", "천원"), fact(5, "1", "백만원", group=None), fact(6, "1000000"), fact(7, "1", "백만원", owner="x"), fact(8, "0", "원"), fact(9, "0", "천원"), fact(10, "-1", "백만원")]
    found = {tuple(r) for r in same_amounts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {(1, 2), (2, 3), (8, 9)}
    assert same_amounts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pairs_equal_brute_force(spark):
    rows, values = [], []
    for i in range(120):
        v, scale = 1000 * 1.0007 ** (i % 37), (1.0, 1e3, 1e6)[i % 3]
        rows.append(fact(i, f"{v / scale:.9f}", ("원", "천원", "백만원")[i % 3]))
        values.append((float(f"{v / scale:.9f}") * scale, scale))
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if values[a][1] != values[b][1] and abs(values[a][0] - values[b][0]) <= 1e-3 * max(values[a][0], values[b][0])}
    assert {tuple(r) for r in same_amounts(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_text_expressions(spark):
    rows = [("Mеһalbuba　Ｒobots",), ("é한",), ("Тoгул",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "a string").select(plain(F.col("a"))).collect()]
    assert got == ["Mehalbuba Robots", "é한", "Тогул", None, ""]
    d = spark.createDataFrame([("12) 매출 총액 (주1)",), ("가. Net  income:",)], "a string")
    assert [r[0] for r in d.select(normalise_key(F.col("a"))).collect()] == ["매출총액", "Netincome"]
    assert spark.createDataFrame([("ö",)], "a string").select(compose(F.col("a"))).first()[0] == "ö"
