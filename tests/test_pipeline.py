from pyspark.sql import functions as F

from ledgerloom.plans import pipeline

FACT = (
    "fact_id long, doc_id string, chunk_id string, company string, doc_group string, filing_date string, period string, is_latest boolean, is_correction boolean, key string, key_norm string, "
    "value_text string, value_num double, value_unit string, unit_code string, section_path array<string>, value_owner string"
)


def store(spark):
    f = [(1, "d1", "c1", "Acme", "periodic", "20240301", "2024-03", True, False, "Total assets", "Totalassets", "500", 500.0, "백만원", None, ["x"], None), (2, "d1", "c1", "Acme", "periodic", "20240301", "2024-03", True, False, "Net income", "Netincome", "7", 7.0, None, None, ["x"], None)]
    d = [("d0", "Acme", "periodic", "20240101", "2024-03", "g", 0, False), ("d1", "Acme", "periodic", "20240301", "2024-03", "g", 1, True), ("d2", "Other", "periodic", "20240301", "2024-03", None, None, None)]
    c = [("c0", "d0", "Acme total assets old 400"), ("c1", "d1", "Acme total assets were 500"), ("c2", "d2", "Other total assets were 9")]
    return pipeline.Store(
        spark.createDataFrame(f, FACT),
        spark.createDataFrame(d, "report_id string, company string, doc_group string, day string, period string, correction_group_id string, correction_order int, is_latest boolean"),
        spark.createDataFrame(c, "id string, report_id string, text string"),
        spark.createDataFrame([("Acme",), ("Other",)], "name string"),
    )


def test_questions_run_to_evidence(spark):
    q = [("1", "Acme total assets 얼마인가", ["Acme"], ["2024-03"], ["Total assets"]), ("2", "Acme goodwill 얼마인가", ["Acme"], [], ["Goodwill"]), ("3", "오늘 주가 알려줘", [], [], []), ("4", "Other total assets 설명해줘 2024", ["Other"], ["2024"], ["Total assets"])]
    df = spark.createDataFrame(q, "query_id string, query string, companies array<string>, periods array<string>, expected_fields array<string>")
    got = {r.query_id: r for r in pipeline.run(df, store(spark)).collect()}
    assert (got["1"].action, got["1"].n_facts, got["1"].n_used) == ("answer", 1, 1)
    assert "were 500" in got["1"].pack and "old" not in got["1"].pack and "unit: 백만원" in got["1"].facts
    assert (got["2"].action, got["2"].reason) == ("abstain", "missing_field")
    assert (got["3"].decision, got["3"].action) == ("refuse", "refuse")
    assert (got["4"].action, got["4"].n_facts) == ("answer", 0)


def test_generator_sees_only_answerable_questions(spark):
    q = spark.createDataFrame([("1", "Acme total assets 얼마인가", ["Acme"], ["2024-03"], ["Total assets"]), ("3", "오늘 주가 알려줘", [], [], [])], "query_id string, query string, companies array<string>, periods array<string>, expected_fields array<string>")
    text = lambda d: d.select("query_id", pipeline.prompt(F.col("action"), F.col("query"), F.col("facts"), F.col("pack")).alias("answer"))
    got = {r.query_id: r.answer for r in pipeline.run(q, store(spark), text).collect()}
    assert got["3"] is None and "Question: Acme total assets" in got["1"]


def test_notes(spark):
    d = spark.createDataFrame([("2024-06", 2024, None), ("2023", 2024, -1999), (None, 2024, None)], "p string, y int, o int").select(pipeline.period_note(F.col("p"), F.col("y"), F.col("o")))
    assert [r[0] for r in d.collect()] == ["current year", "previous year, fiscal period 24", None]


def test_siblings_fill_the_share(spark):
    c = spark.createDataFrame([("a", None, "x" * 50, ["t"]), ("b", None, "y" * 50, ["t"]), ("c", None, "z" * 5000, ["t"])], "id string, parent_id string, text string, table_ids array<string>")
    h = spark.createDataFrame([(1, "a", 1)], "query_id int, id string, rank int")
    r = pipeline.expand_with_siblings(h, c).first()
    assert r.text == "x" * 50 + "\n" + "y" * 50


def test_a_retry_must_be_better(spark):
    s = "id int, answer string, ungrounded int, rescaled int"
    a, b = spark.createDataFrame([(1, "a", 2, 0), (2, "a", 0, 1), (3, "a", 1, 1)], s), spark.createDataFrame([(1, "b", 1, 5), (2, "b", 0, 1)], s)
    assert {r.id: r.answer for r in pipeline.better_retry(a, b).collect()} == {1: "b", 2: "a", 3: "a"}


PLAN = "query_id string, query string, companies array<string>, periods array<string>, expected_fields array<string>"


def test_k_is_taken_among_the_company_s_valid_chunks(spark):
    s = store(spark)
    # 60 chunks of another company rank first in the whole corpus, and 30 of a superseded filing within the company.
    more = [(f"o{i}", "d2", "total assets") for i in range(60)] + [(f"s{i}", "d0", "Acme total assets") for i in range(30)] + [("z", "d1", "total assets and many other words " * 9)]
    s.chunks = s.chunks.unionByName(spark.createDataFrame(more, "id string, report_id string, text string"))
    q = spark.createDataFrame([("1", "Acme total assets 얼마인가", ["Acme"], [], []), ("2", "total assets 얼마인가", [], [], [])], PLAN)
    planned = pipeline.planner.plans(q)
    subs = pipeline.planner.decompose(planned)
    texts, _ = pipeline.search(s, subs, q, planned)
    got = {i: [(r["rank"], r.id) for r in texts.where(F.col("query_id") == i).orderBy("rank").collect()] for i in "12"}
    assert got["1"] == [(1, "c1"), (2, "z")]
    assert [n for n, _ in got["2"]] == list(range(1, 9)) and all(i.startswith("o") for _, i in got["2"])


def test_facts_follow_the_plan(spark):
    s = store(spark)
    old = [(3, "d0", "c0", "Acme", "periodic", "20240101", "2024-03", False, False, "Total assets", "Totalassets", "400", 400.0, None, None, ["x"], None)]
    new = [(10 + i, f"n{i}", None, "Acme", "periodic", "20240401", "2024-03", True, False, "Total assets", "Totalassets", str(i), float(i), None, None, ["x"], None) for i in range(30)]
    s.facts = s.facts.unionByName(spark.createDataFrame(old + new, FACT))
    q = spark.createDataFrame([("max", "Acme 가장 큰 total assets 얼마인가", ["Acme"], [], ["Total assets"]), ("plain", "Acme total assets 얼마인가", ["Acme"], [], ["Total assets"]), ("all", "Acme 모든 정정 가장 큰 total assets 얼마인가", ["Acme"], [], ["Total assets"]), ("month", "Acme 2024년 1월 가장 큰 total assets 얼마인가", ["Acme"], ["2024-01"], ["Total assets"])], PLAN)
    planned = pipeline.planner.plans(q)
    _, found = pipeline.search(s, pipeline.planner.decompose(planned).withColumn("period", F.lit(None).cast("string")), q, planned)
    got = {n: [r.fact_id for r in found.where(F.col("query_id") == n).orderBy("rank").collect()] for n in ("max", "plain", "all", "month")}
    assert got["max"] == [1, *range(39, 9, -1)] and len(got["plain"]) == 10
    assert got["all"] == [1, 3, *range(39, 9, -1)]
    # Of the chain of d0 and d1 the filing of the month asked for.
    assert got["month"] == [3, *range(39, 9, -1)]


def test_figures_are_calculated_over_all_facts(spark):
    s = store(spark)
    many = [(10 + i, f"n{i}", None, "Acme" if i % 2 else "Other", "periodic", f"202{i % 3 + 2}0401", f"{2010 + i}-03", True, False, "Revenue", "Revenue", str(i), float(i), "백만원", None, ["x"], None) for i in range(1, 31)]
    s.facts = s.facts.unionByName(spark.createDataFrame(many, FACT))
    q = spark.createDataFrame([("sum", "Acme 와 Other 의 revenue 합계와 평균 얼마인가", ["Acme", "Other"], [], ["Revenue"]), ("plain", "Acme revenue 얼마인가", ["Acme"], [], ["Revenue"])], PLAN)
    got = {r.query_id: r for r in pipeline.run(q, s).collect()}
    assert got["plain"].calculations is None and got["plain"].n_facts == 10
    assert got["sum"].n_facts == 30 and sorted(got["sum"].operations) == ["avg", "sum"]
    assert {(c.operation, c.item, c.unit, c.value) for c in got["sum"].calculations} == {("sum", "Revenue", "백만원", 465.0), ("avg", "Revenue", "백만원", 15.5)}


def test_growth_and_winner(spark):
    cols = "query_id string, key_norm string, value_unit string, section_path array<string>, company string, period string, day string, doc_id string, value_num double"
    rows = [("a", "Revenue", None, [], "X", "2022-12", "20230301", "d1", 100.0), ("a", "Revenue", None, [], "X", "2023-12", "20240301", "d2", 121.0), ("b", "Revenue", "억원", [], "X", "2023", "20240301", "d2", 3.0), ("b", "Revenue", "백만원", [], "Y", "2023", "20240301", "d3", 500.0), ("c", None, None, [], "X", None, None, "d", None)]
    plans = [("a", "X 증감률", "calculate", False), ("b", "X Y 중 어느", "compare", True), ("c", "X 합계", "lookup", False)]
    out = pipeline.calculated(spark.createDataFrame(rows, cols), spark.createDataFrame(plans, "query_id string, query string, task string, winner boolean"))
    got = {(r.query_id, c.operation): (c.company, c.value, c.text) for r in out.collect() for c in r.calculations}
    assert got == {("a", "growth"): ("X", 21.0, None), ("a", "cagr"): ("X", 21.0, None), ("b", "winner"): (None, 5e8, "Y")}
