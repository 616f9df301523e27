import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, numbers
from ledgerloom.operators import derive, facts, versions
from ledgerloom.operators.facts import Lookup, RetrievalFilter

FACT = (
    "fact_id long, doc_id string, chunk_id string, company string, doc_group string, filing_date string, period string, is_latest boolean, is_correction boolean, key string, key_norm string, "
    "value_text string, value_num double, value_date string, field_code string, section_path array<string>, value_owner string"
)


def row(i, key="Revenue", value=1.0, day="20240101", **more):
    base = dict(fact_id=i, doc_id=f"d{i}", chunk_id=f"c{i}", company="A", doc_group="periodic", filing_date=day, period=None, is_latest=True, is_correction=False, key=key, key_norm=key.replace(" ", ""), value_text=str(value), value_num=value, value_date=None, field_code=None, section_path=["Sales"], value_owner=None)
    return tuple((base | more).values())


def table(spark, rows):
    return spark.createDataFrame(rows, FACT)


def ids(df):
    return [r.fact_id for r in df.collect()]


def test_largest_value_in_the_oldest_filing(spark):
    f = table(spark, [row(i, value=float(v), day=f"2024010{i}") for i, v in enumerate([9, 1, 2, 3, 4, 5], 1)] + [row(7, value=None, day="20240109")])
    assert ids(facts.lookup(f, Lookup(key="Revenue", limit=3))) == [7, 6, 5]
    assert ids(facts.lookup(f, Lookup(key="Revenue", limit=2, order_by="value_desc"))) == [1, 6]
    assert ids(facts.lookup(f, Lookup(key="Revenue", limit=1, order_by="value_asc"))) == [2]
    assert ids(facts.lookup(f, Lookup(key="Revenue", order_by="value_desc")))[-1] == 7
    with pytest.raises(ValueError, match="nope"):
        facts.lookup(f, Lookup(order_by="nope"))


def test_exact_beats_partial_over_narrow_and_wide_periods(spark):
    f = table(spark, [row(1, "Net income", period="2024-03"), row(2, "Net income total", period="2024-06"), row(3, "Net income", day="20240620"), row(4, "Other")])
    assert ids(facts.lookup(f, Lookup(key="Netincome", period="2024-06"))) == [3]
    assert ids(facts.lookup(f, Lookup(key="Netincome", period="2024-09"))) == [3]
    assert ids(facts.lookup(f, Lookup(key="income", period="2024"))) == [3, 1, 2]
    assert ids(facts.lookup(f, Lookup(key="incometotal"))) == [2]
    assert ids(facts.lookup(f, Lookup(key="incometotal", exact_only=True))) == []
    assert ids(facts.lookup(f, Lookup(company="B"))) == []


def test_stores_are_merged_before_falling_back(spark):
    a, b = table(spark, [row(1, "Revenue total"), row(2, "Net income")]), table(spark, [row(3, "Revenue"), row(2, "Net income")])
    assert ids(facts.merge_stores([a, b], Lookup(key="Revenue"))) == [3]
    assert ids(facts.merge_stores([a, b], Lookup(key="Netincome", limit=5))) == [2]


def test_owner_and_null_logic(spark):
    holder = ["VII", "주주에 관한 사항"]
    f = table(spark, [row(1, "자산총계"), row(2, "자산총계", section_path=holder), row(3, "자산총계", value_owner="B"), row(4, "자산총계", section_path=None), row(5, "x", section_path=None), row(6, "x", value_owner="A"), row(7, is_latest=None), row(8, is_latest=False)])
    get = lambda w: sorted(ids(facts.lookup(f, Lookup(value_owner=w, limit=None))))
    assert get("self") == [1, 5, 6, 7] and get("other") == [2, 3] and get("any") == [1, 2, 3, 4, 5, 6, 7]


def test_metadata_filter(spark):
    docs = spark.createDataFrame(
        [("r1", "A", "periodic", "annual", "2024-12", "20250301", True, False), ("r2", "A", "periodic", "half", "2024-06", "20240801", None, False), ("r3", "B", "major", None, None, "20240615", False, True), ("r4", "B", "major", None, "", None, True, False)],
        "report_id string, company string, doc_group string, doc_subtype string, period string, day string, is_latest boolean, is_correction boolean",
    )
    get = lambda **k: [r.report_id for r in docs.where(RetrievalFilter(**k).to_column()).orderBy("report_id").collect()]
    assert get(periods=("2024-06",)) == ["r2", "r3"]
    assert get(periods=("2024",)) == ["r1", "r2", "r3"]
    assert get(periods=("2025",)) == ["r1"]
    assert get(latest_only=True) == ["r1", "r2", "r4"]
    assert get(corrections_only=True) == ["r3"] and get(include_corrections=False) == ["r1", "r2", "r4"]
    assert get(doc_subtypes=("half",)) == ["r2"] and get(companies=("B",), doc_groups=("major",)) == ["r3", "r4"]
    out = facts.relax(docs, RetrievalFilter(companies=("B",), periods=("2019",), latest_only=True)).collect()
    assert {(r.report_id, r.tier) for r in out} == {("r4", 1)}


def test_existence(spark):
    m = spark.createDataFrame([("A", "Supply contract signed", False, "20240101"), ("A", "Supply contract ended", True, "20240201"), ("B", "Supply contract signed", False, "20240101"), ("C", "Annual report", False, "20240101")], "company string, report_nm string, is_correction boolean, rcept_dt string")
    got = {r.company: (r.verdict, r.n_corrections) for r in facts.check_existence(m, F.col("company"), "supply-contract", "ended").collect()}
    assert got == {"A": ("exists", 1), "B": ("absent", 0), "C": ("not_applicable", 0)}


HITS = "query_id string, doc_id string, correction_group_id string, correction_order int, is_latest boolean, day string, period string"


@pytest.mark.parametrize(
    ("policy", "want"),
    [("all_versions", "abcdsu"), ("latest_only", "csu"), ("first_and_final", "adsu"), ("latest_in_window", "bsu")],
)
def test_version_policies(spark, policy, want):
    rows = [("q", x, "g", i, x == "c", f"20240{i + 1}05", None) for i, x in enumerate("abcd")] + [("q", "s", "single", None, None, "20240101", None), ("q", "u", None, None, None, "20240101", None)]
    out = versions.apply_policy(spark.createDataFrame(rows, HITS), F.lit(policy), F.array(F.lit("2024-02")), ["query_id"])
    assert "".join(sorted(r.doc_id for r in out.collect())) == want


def test_unknown_orders_use_dates_and_missing_windows_fall_back(spark):
    rows = [("q", "a", "g", None, None, "20240901", None), ("q", "b", "g", 0, None, "20240101", None), ("q", "c", "g", None, None, "20240902", None)]
    get = lambda p, t: [r.doc_id for r in versions.apply_policy(spark.createDataFrame(rows, HITS), F.lit(p), F.array(F.lit(t)), ["query_id"]).collect()]
    assert get("latest_only", "2024") == ["b"] and get("latest_in_window", "2019") == ["b"] and get("latest_in_window", "2024-09") == ["c"]


def test_chains_from_dates_and_titles(spark):
    m = spark.createDataFrame([("o1", "A", "20240101", "Supply contract signed"), ("o2", "A", "20240101", "Bond issue"), ("c1", "A", "20240201", "[C] Supply contract signed"), ("c2", "A", "20240301", "[C] Supply contract signed"), ("x", "A", "20240401", "[C] Nothing"), ("h", "A", "20240501", "by hand")], "doc_id string, company string, rcept_dt string, report_nm string")
    t = spark.createDataFrame([("c1", "20240101", "Supply contract signed"), ("c2", "20240201", "Supply contract signed"), ("x", "20200101", "y"), ("h", "20240101", "zzz")], "doc_id string, target_date string, target_title string")
    by = spark.createDataFrame([("h", "o2")], "doc_id string, parent string")
    got = {r.doc_id: tuple(r)[1:] for r in versions.build_chains(m, t, by).collect()}
    assert got["c2"] == ("o1", 2, True, "rule") and got["c1"] == ("o1", 1, False, "fuzzy_tiebreak") and got["o1"] == ("o1", 0, False, "original")
    assert got["x"][0] == "x" and got["x"][3] == "unresolved" and got["h"] == ("o2", 1, True, "manual_override")
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], "doc_id string, parent string")
    assert [tuple(r) for r in versions.roots(loop).collect()] == [("c", "d", 1)]


def test_correction_targets(spark):
    t = "정정대상 공시서류 : 단일판매 계약  체결 2. 정정대상 공시서류의 최초제출일 : 2024년 3월 5일 3. 정정사유"
    d = versions.correction_targets(spark.createDataFrame([(t, "major"), ("nothing", "exchange")], "t string, g string"), F.col("t"), F.col("g")).collect()
    assert (d[0].target_date, d[0].target_title) == ("20240305", "단일판매 계약 체결") and d[1].target_date is None


def test_values(spark):
    cases = {"1,234": (1234.0, None, None), "△ 5": (-5.0, None, None), "(7.5)": (-7.5, None, None), "3억 2,000만원": (3.2e8, "원", None), "12 억원": (1.2e9, "원", None), "63조 7,454억원": (63745400000000.0, "원", None), "12.5%": (12.5, "%", None), "20240131": (None, None, "20240131"), "2024.1.5": (None, None, "20240105"), "12345678": (12345678.0, None, None), "해당없음": (None, None, None), "text": (None, None, None), "５０주": (50.0, "주", None)}
    df = spark.createDataFrame([(k, None) for k in cases], "t string, u string").select("t", numbers.parse_value(F.col("t"), F.col("u")).alias("v"))
    assert {r.t: tuple(r.v) for r in df.collect()} == cases


def test_periods_and_months(spark):
    assert dates.period_tokens("2024년 1분기와 2023년 상반기, 2022년 하반기") == ["2024-03", "2023-06", "2022"]
    assert dates.period_tokens("2024-06 and 2024.6, 2025") == ["2024-06", "2025"] and dates.period_tokens(None) == []
    assert dates.periods_of(["2024", "2024년 12월"]) == ["2024", "2024-12"]
    d = spark.createDataFrame([("20240131", "20240229"), ("20240115", "20240315"), ("x", "20240315")], "a string, b string").select(dates.full_months_between(F.col("a"), F.col("b")), dates.days_between(F.col("a"), F.col("b")))
    assert [tuple(r) for r in d.collect()] == [(0, 29), (2, 60), (None, None)]


def test_rates(spark):
    d = spark.createDataFrame([(100.0, 110.0, 2.0), (0.0, 5.0, 1.0), (-4.0, 2.0, 0.0)], "a double, b double, y double")
    got = [tuple(r) for r in d.select(numbers.growth(F.col("a"), F.col("b")), numbers.ratio(F.col("a"), F.col("b")), numbers.cagr(F.col("a"), F.col("b"), F.col("y"))).collect()]
    assert got == [(10.0, 90.9091, 4.8809), (None, 0.0, None), (150.0, -200.0, None)]
    s = spark.createDataFrame([(0.043, 4.3), (4.3, 430.0), (5.0, 5.0)], "a double, b double").select(numbers.same_ratio(F.col("a"), F.col("b")))
    assert [r[0] for r in s.collect()] == [True, False, True]


ROWS = "item string, unit string, kind string, company string, period string, day string, doc_id string, value double"


def test_ambiguity_gives_no_row(spark):
    r = [("rev", "won", "", "A", "2024", "20240101", "d1", 1.0), ("rev", "won", "", "A", "2024", "20240201", "d2", 2.0), ("rev", "won", "", "B", "2024", "20240101", "d3", 5.0), ("cost", "won", "", "A", "2024", "20240101", "d1", 1.0), ("cost", "won", "", "A", "2024", "20240101", "d4", 3.0), ("cost", "won", "", "B", "2024", "20240101", "d3", 5.0)]
    out = derive.derive(spark.createDataFrame(r, ROWS)).collect()
    assert [(o.item, float(o.total), o.mean, o.spread) for o in out] == [("rev", 7.0, 3.5, 3.0)]
    s = derive.series(spark.createDataFrame(r, ROWS)).collect()
    assert [(o.company, o.item, o.first, o.last, o.growth, o.cagr) for o in s] == [("A", "rev", 1.0, 2.0, 100.0, None)]
    w = derive.winners(spark.createDataFrame([("x", "A", 5.0, "억원"), ("x", "B", 600.0, "백만원"), ("y", "A", 5.0, "kg"), ("y", "B", 6.0, "t")], "item string, company string, value double, unit string")).collect()
    assert [(o.item, o.winner, o.gap) for o in w] == [("x", "B", 1e8)]


def test_operations_and_checks(spark):
    assert derive.wanted_operations("연평균성장률과 합계, 순위") == ["sum", "rank"] and derive.wanted_operations("평균은?") == ["avg"]
    a = spark.createDataFrame([(1, "매출 300, 차이 200", "500 and 300", False), (2, "비중 60.0 and 60", "300 of 500", True), (3, "총 5000000", "5 백만", False), (4, "777 in 2024", "1", False), (5, "no figures", "", False)], "id int, answer string, evidence string, percent boolean")
    got = {r.id: (r.grounded, r.derived, r.rescaled, r.ungrounded, r.ok) for r in derive.validate_answers(a).collect()}
    assert got == {1: (1, 1, 0, 0, True), 2: (0, 0, 0, 0, True), 3: (0, 0, 1, 0, False), 4: (0, 0, 0, 1, False), 5: (0, 0, 0, 0, True)}


def test_owner_is_carried_within_a_run(spark):
    n = spark.createDataFrame([("d", "s", 1, "X", 0), ("d", "s", 2, None, 2), ("d", "s", 3, None, 1), ("d", "t", 4, None, 2), ("d", "s", 5, None, 2)], "doc_id string, section string, seq int, owner string, n_markers int")
    assert {r.seq: r.carried for r in derive.carry_owner(n).collect()} == {1: "X", 2: "X", 3: None, 4: None, 5: None}


def test_many_lookups_keep_to_their_own_options(spark):
    # The largest value is in the oldest of 60 filings, the first of which are superseded corrections.
    f = [row(i, value=float(100 - i), filing_date=f"2024{1 + i // 28:02d}{1 + i % 28:02d}", is_latest=i >= 3, is_correction=i < 5) for i in range(60)]
    f += [row(60, value=500.0, value_owner="B"), row(61, value=600.0, doc_group="major", day="20230101")]
    s = "query_id string, company string, key string, period string"
    get = lambda spec, more: [r.fact_id for r in facts.lookup_many(table(spark, f), spark.createDataFrame([("q", "A", "Revenue", None, *spec)], s + more)).orderBy("rank").collect()]
    assert get((), "") == list(range(59, 49, -1))
    assert get(("value_desc", 50), ", order_by string, most int") == [61, *range(3, 52)]
    assert get(("value_asc", 50, "periodic"), ", order_by string, most int, doc_group string") == list(range(59, 9, -1))
    assert get((False, True, "periodic"), ", latest_only boolean, corrections_only boolean, doc_group string") == [4, 3, 2, 1, 0]
    assert get(("other",), ", value_owner string") == [60] and get((None,), ", value_owner string") == list(range(59, 49, -1))
    assert get(("any", "value_desc", 2), ", value_owner string, order_by string, most int") == [61, 60]


def test_roots_of_long_chains_and_cycles(spark):
    chain = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(1500)]
    # A cycle of three, and a tail that leads into it.
    cycle = [("x", "y"), ("y", "z"), ("z", "x"), ("t1", "t2"), ("t2", "x")]
    got = {r.doc_id: (r.root, r.depth) for r in versions.roots(spark.createDataFrame(chain + cycle, "doc_id string, parent string")).collect()}
    assert got == {f"n{i:04d}": ("n1500", 1500 - i) for i in range(1500)}
