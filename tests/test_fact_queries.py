import duckdb
import pytest

from ledgerloom.queries import facts as queries

FACT = (
    "fact_id long, company string, doc_group string, filing_date string, period string, is_latest boolean, is_correction boolean, key string, key_norm string, value_num double, field_code string, "
    "section_path array<string>, value_owner string"
)


def fact(i, company, value=1.0, key="Revenue", period="2024-03"):
    return (i, company, "periodic", "20240401", period, True, False, key, key, value, "F1", ["x"], None)


@pytest.fixture
def folder(spark, tmp_path):
    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def oracle(d, sql, names):
    con = duckdb.connect()
    for n in names:
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM '{d}/{n}.parquet/*.parquet'")
    return sorted(con.sql(sql).fetchall())


def test_all_candidates_are_paired(spark, folder):
    d = folder(facts=([fact(i, f"c{i:03d}", float(i % 7)) for i in range(101)], FACT))
    got = sorted(tuple(r) for r in queries.compare_pairs(spark, d).collect())
    assert [r[1:3] for r in got] == [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(0, 100, 2)]
    assert got == oracle(d, queries.ORACLES["compare_pairs"], ["facts"])


def test_every_company_field_and_period_is_looked_up(spark, folder):
    plans = [("q#1", ["A", "B"], ["Revenue", "Net income"], ["2024-03", "2023"]), ("2", ["B"], ["Revenue"], []), ("3", [], ["Revenue"], [])]
    rows = [fact(i, "AB"[i % 2], period="2024-03") for i in range(30)] + [fact(30, "B", key="Netincome", period="2023-12"), fact(31, "A", period="2023-06")]
    d = folder(facts=(rows, FACT), query_plans=(plans, "query_id string, companies array<string>, expected_fields array<string>, periods array<string>"))
    got = {}
    for r in queries.facts_lookup_many(spark, d).collect():
        got.setdefault(r.query_id, []).append(r.fact_id)
    # The limit holds for each combination.
    assert sorted(got["q#1"]) == [*range(20), 30, 31] and set(got) == {"q#1", "2"}
    assert sorted(got["2"]) == list(range(1, 20, 2))
