from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerloom.operators import grading
from ledgerloom.streaming import events


@pytest.mark.parametrize(
    ("token", "answer", "found"),
    [("20240105", "2024년 1월 5일에", True), ("1,234", "약 1234원", True), ("3억 2,000만원", "320,000,000원", False), ("320000000", "3억 2,000만원입니다", True), ("4.30%", "4.30 %", True), ("ABC 회사", "abc회사는", True), ("12", "제12기", False), ("5", "5건", False)],
)
def test_tokens_in_any_notation(token, answer, found):
    assert grading.token_present(token, answer) is found


def test_amounts():
    assert grading.written_amounts("63조 7,454억원과 5천원, 2024년 3건") == [Decimal(63745400000000), Decimal(5000)]
    assert grading.as_decimal("x") is None


def test_grades(spark):
    rows = [("1", "5천원", ["5000"], ["9"], None, ""), ("2", "a and b", None, ["a", "c"], None, ""), ("3", "존재하지 않습니다", None, None, "no", "yes_no"), ("4", "있습니다", None, None, "yes", "yes_no"), ("5", "x", None, None, None, ""), ("6", None, None, None, "7", "value")]
    df = spark.createDataFrame(rows, "id string, answer string, required_any array<string>, required_all array<string>, expected string, kind string")
    assert {r.id: r.correct for r in grading.grades(df).collect()} == {"1": True, "2": False, "3": True, "4": True, "5": None, "6": False}


def test_open_answers(spark):
    a = spark.createDataFrame([("1", "Revenue: 5 won\nCost: not stated\nProfit\n7")], "id string, answer string")
    i = spark.createDataFrame([("1", x) for x in ("revenue", "cost", "profit", "assets")], "id string, item string")
    r = grading.open_score(a, i).first()
    assert (r.n_items, r.covered, r.acknowledged, r.silent) == (4, 1, 1, 2)
    u = spark.createDataFrame([("약 5억원",), ("5",), ("none",)], "a string").select(grading.unit_stated(F.col("a")))
    assert [r[0] for r in u.collect()] == [True, False, None]


def test_foreign_companies(spark):
    rows = [("A사 매출 10 B사 매출 20", "20", "A사", ["B사"]), ("B사와 A사 매출 10", "10", "A사", ["B사"]), ("매출 10", "10", "A사", ["B사"])]
    d = spark.createDataFrame(rows, "t string, a string, c string, o array<string>").select(grading.cross_entity(F.col("t"), F.col("a"), F.col("c"), F.col("o")))
    assert [r[0] for r in d.collect()] == [True, False, False]


def test_gold_groups(spark):
    rows = [("A", "k", str(v), f"d{v}") for v in range(5)] + [("A", "m", "same", f"d{v}") for v in range(4)] + [("A", "n", "x", "d1")]
    g = grading.gold_groups(spark.createDataFrame(rows, "company string, key_norm string, value_text string, doc_id string")).collect()
    assert [(r.key_norm, r.answers) for r in g] == [("n", ["x"])]


def test_streams(spark, tmp_path):
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    rows = [(1, at(1, 5), 7, "a", 1.5), (2, at(1, 50), 7, "a", 2.0), (3, at(2, 10), 7, "b", 0.0), (4, at(1, 20), 8, "a", 1.0)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "events.parquet"))
    stream = lambda: events.file_stream(spark, str(tmp_path / "events.parquet"), df.schema)
    t = {(r.event_type, r.start.hour): (r.n, float(r.total)) for r in events.run_available(events.tumbling(stream()), "complete").collect()}
    assert t == {("a", 1): (3, 4.5), ("b", 2): (1, 0.0)}
    s = sorted((r.user_id, r.n) for r in events.run_available(events.sessions(stream()), "complete").collect())
    assert s == [(7, 1), (7, 2), (8, 1)]
    assert events.run_available(events.deduplicated(stream(), ["user_id"])).count() == 2


def test_every_query_has_a_place():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    assert all(callable(q) for q in queries.values())


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() <= 1
