import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import retrieval, versions
from ledgerloom.plans import planner, schema
from ledgerloom.sources import writers

KINDS = "kind string, terms array<string>, core_terms array<string>, action_terms array<string>, required array<string>, items array<string>"
ROWS = [
    ("공급계약체결", ["단일판매ㆍ공급계약체결"], ["단일판매공급계약"], ["체결"], ["계약금액", "계약상대"], ["계약금액", "계약상대", "계약기간"]),
    ("공급계약해지", ["단일판매ㆍ공급계약해지"], ["단일판매공급계약"], ["해지"], ["해지금액", "계약상대"], ["해지금액", "계약상대"]),
    ("자기주식취득", ["주요사항보고서(자기주식취득결정)", "자기주식취득결정"], ["주요사항보고서"], ["자기주식"], ["취득한도"], ["취득한도", "순자산액", "주요사항보고서"]),
    ("합병", ["주요사항보고서(합병)"], ["주요사항보고서"], ["합병"], [], ["합병비율"]),
]


def ask(spark, *queries):
    return spark.createDataFrame([(str(i), q) for i, q in enumerate(queries)], "query_id string, query string")


def test_kinds_and_items_of_questions(spark):
    kinds = spark.createDataFrame(ROWS, KINDS)
    q = ask(spark, "단일판매·공급계약 체결 공시의 계약 금액은?", "체결한 단일판매·공급계약 중 이후 해지된 계약상대는?", "단일판매 공급계약이 있는가", "주요사항보고서(자기주식취득결정)에 기재된 순자산액은?", "매출액은 얼마인가", "", None)
    m = schema.expected_items(schema.match_kinds(q, kinds), kinds)
    got = {r.query_id: (r.kinds, r.required, r.mentioned) for r in schema.items_mentioned(m, kinds).collect()}
    assert got["0"] == (["공급계약체결"], ["계약금액", "계약상대"], ["계약금액"])
    # Both actions: both kinds, and what both require.
    assert got["1"] == (["공급계약체결", "공급계약해지"], ["계약상대"], ["계약상대"])
    assert got["2"] == (["공급계약체결", "공급계약해지"], ["계약상대"], [])
    # The name of a kind is no item, and the longest name counts.
    assert got["3"] == (["자기주식취득"], ["취득한도"], ["순자산액"])
    assert got["4"] == ([], [], []) and got["5"] == ([], [], [])
    assert schema.match_kinds(q, kinds.limit(0)).count() in (6, 7)


def test_a_schema_of_unknown_size_is_refused(spark, monkeypatch):
    monkeypatch.setattr(schema, "MOST_KINDS", 2)
    with pytest.raises(ValueError, match="kinds"):
        schema.match_kinds(ask(spark, "x"), spark.createDataFrame(ROWS, KINDS))


def test_plans_are_repaired(spark):
    s = "query_id string, answer_mode string, task string, latest_policy string, aggregation string, companies array<string>, periods array<string>, expected_fields array<string>, kinds array<string>"
    plans = [
        ("ok", "closed", "lookup", "latest_only", "none", ["(주)갑"], ["2024-06"], ["계약 금액"], ["공급계약체결"]),
        ("bad", "loud", None, "newest", "median", ["을"], ["2024", "작년", None], ["계약금액", "없는항목"], ["공급계약체결", "합병"]),
        ("diff", "closed", "correction_diff", "latest_only", "none", ["갑"], [], [], []),
        ("one", "closed", "compare", "latest_only", "none", ["갑"], ["2024"], ["x"], []),
        ("calc", "closed", "calculate", "latest_only", "sum", [], None, None, []),
    ]
    out = schema.repaired(spark.createDataFrame(plans, s), spark.createDataFrame([("갑 주식회사",), (None,)], "name string"), spark.createDataFrame(ROWS, KINDS))
    got = {r.query_id: r for r in out.collect()}
    issues = {k: [(i.field, i.severity) for i in r.issues] for k, r in got.items()}
    assert issues["ok"] == [] and got["ok"].expected_fields == ["계약 금액"]
    b = got["bad"]
    assert (b.answer_mode, b.task, b.latest_policy, b.aggregation, b.periods, b.expected_fields) == ("unknown", "unknown", "latest_only", "none", ["2024"], ["계약금액"])
    assert issues["bad"] == [(n, "warning") for n in ("answer_mode", "task", "latest_policy", "aggregation")] + [("companies", "error"), ("periods", "warning"), ("expected_fields", "warning")]
    assert got["diff"].latest_policy == "first_and_final" and issues["diff"] == [("latest_policy", "warning")]
    assert issues["one"] == [("task", "error")] and issues["calc"] == [("expected_fields", "error")]


def test_names_in_questions(spark):
    entities = spark.createDataFrame([("e1", "Acme Steel", ["Acme Steel", "Acme", "ACME"]), ("e2", "갑을", ["갑을", "(주)갑을전자"]), ("e3", "X", ["X", "Beta Holdings International"])], "entity_id string, name string, aliases array<string>")
    q = spark.createDataFrame([("1", "What did acme steel and Acmed say to Acme?"), ("2", "(주)갑을전자의 이익, 갑을은?"), ("3", None), ("4", ""), ("5", "beta holdings international"), ("5", "beta")], "query_id string, query string")
    got = {(r.query_id, r.surface, r.entity_id, r.start, r.end) for r in planner.mentions(q, entities).collect()}
    assert got == {("1", "acme steel", "e1", 9, 19), ("1", "Acme", "e1", 37, 41), ("2", "(주)갑을전자", "e2", 0, 7), ("2", "갑을", "e2", 13, 15), ("5", "beta holdings international", "e3", 0, 27)}
    assert planner.mentions(q, entities.limit(0)).count() == 0 and planner.mentions(q.limit(0), entities).count() == 0


@pytest.mark.parametrize("names", [200_000, 0])
def test_questions_are_not_broadcast_to_names(spark, monkeypatch, names):
    monkeypatch.setattr(planner, "BROADCAST_NAMES", names)
    entities = spark.createDataFrame([("e1", ["Acme Steel", "Acme"]), ("e2", ["갑을"])], "entity_id string, aliases array<string>")
    q = spark.createDataFrame([("1", "acme steel and Acme"), (None, "갑을의 이익"), ("5", "갑을"), ("5", "of acme"), ("5", "of acme")], "query_id string, query string")
    m = planner.mentions(q, entities)
    got = sorted(((r.query_id or "", r.start, r.surface, r.entity_id) for r in m.collect()))
    assert got == [("", 0, "갑을", "e2"), ("1", 0, "acme steel", "e1"), ("1", 15, "Acme", "e1"), ("5", 0, "갑을", "e2"), ("5", 3, "acme", "e1"), ("5", 3, "acme", "e1")]
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert ("rightHint=(strategy=broadcast)" if names else "rightHint=(strategy=merge)") in plan and "leftHint" not in plan


def test_a_second_stage_searches_again(spark):
    r = random.Random(3)
    docs = [(i, i % 6, [r.uniform(-1, 1) for _ in range(4)]) for i in range(120)]
    v = spark.createDataFrame([(i, x) for i, _, x in docs], "id long, v array<double>")
    of = spark.createDataFrame([(i, d) for i, d, _ in docs], "id long, doc long")
    q = spark.createDataFrame([(7, [1.0, 0.0, 0.5, 0.0])], "query_id long, v array<double>")
    pool = retrieval.dense(v, q, 3)
    got = [x.id for x in retrieval.two_stage(pool, of, retrieval.dense_within(v, of, q), 12).orderBy("rank").collect()]
    score = {i: x[0] + 0.5 * x[2] for i, _, x in docs}
    best = sorted(score, key=lambda i: (-round(score[i], 6), i))
    chosen = list(dict.fromkeys(i % 6 for i in best[:3]))
    lists = [[i for i in best if i % 6 == d] for d in chosen]
    want = [lists[j][k] for k in range(12) for j in range(len(lists))][:12]
    assert got == want and len(set(got)) == 12


@pytest.mark.parametrize("block", [20_000, 2])
def test_query_vectors_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)] + [(99, None)], "id long, v array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0]), (None, [0.0, 1.0]), (3, None), (4, [1.0, 1.0])], "query_id long, v array<double>")
    got = {(x.query_id, x.id, x.rank) for x in retrieval.dense(v, q, 2).collect()}
    assert got == {(1, 9, 1), (1, 8, 2), (2, 0, 1), (2, 1, 2), (None, 0, 1), (None, 1, 2), (4, 9, 1), (4, 8, 2)}


@pytest.mark.parametrize("terms", [500_000, 0])
def test_words_are_counted_once_for_all_documents(spark, monkeypatch, terms):
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", terms)
    c = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "d"), (4, ""), (5, None), (6, "a b a")], "id long, text string")
    q = spark.createDataFrame([(1, "a z"), (2, "nothing"), (3, None)], "query_id long, text string")
    import math

    got = {(x.query_id, x.id): x.score for x in retrieval.bm25(c, q, 9).collect()}
    n, df, avgdl, tf, dl = 5, 2, 9 / 5, 2, 3
    want = math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
    assert got == {(1, 1): pytest.approx(want, abs=1e-6), (1, 6): pytest.approx(want, abs=1e-6)}
    assert retrieval.bm25(c.limit(0), q, 3).count() == 0 and retrieval.bm25(c, q.limit(0), 3).count() == 0


def test_ranked_words_write_no_pairs(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(retrieval, "keep", lambda df, name="stage", real=retrieval.keep: kept.append(real(df, name)) or kept[-1])
    c = spark.range(200).select("id", F.lit("a b c").alias("text"))
    q = spark.range(100).select(F.col("id").alias("query_id"), F.concat_ws(" ", F.lit("a b c"), "id").alias("text"))
    got = retrieval.bm25(c, q, 3).collect()
    assert {(r.query_id, r.id, r.rank) for r in got} == {(i, k, k + 1) for i in range(100) for k in range(3)}
    # What is kept follows queries or documents, not pairs of them (20,000) or of words and documents (600).
    assert max(df.count() for df in kept) <= 400


def test_hybrid_search_keeps_no_pairs(spark, monkeypatch, tmp_path):
    from ledgerloom.queries.retrieval import hybrid_search

    kept = []
    monkeypatch.setattr(retrieval, "keep", lambda df, name="stage", real=retrieval.keep: kept.append(real(df, name)) or kept[-1])
    spark.range(100).select(F.format_string("k%03d", "id").alias("chunk_id"), F.lit("a b c d e f").alias("text"), F.lit("acme").alias("company")).write.parquet(f"{tmp_path}/examples.parquet")
    spark.range(20, 820, 20).select(F.format_string("q%d", "id").alias("query_id"), F.lit("acme f e d c b a").alias("query")).write.parquet(f"{tmp_path}/query_plans.parquet")
    got = hybrid_search(spark, str(tmp_path)).collect()
    # All chunks are equal, so the first ids are the best in both channels.
    assert {(r.query_id, r.id, r.rank) for r in got} == {(f"q{20 * i}", f"k{k:03}", k + 1) for i in range(1, 41) for k in range(10)}
    assert max(df.count() for df in kept) <= 300


@pytest.mark.parametrize(("block", "documents", "terms"), [(20_000, 32_768, 500_000), (3, 7, 0)])
def test_ranked_words_equal_brute_force(spark, monkeypatch, block, documents, terms):
    import math
    from collections import Counter

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    monkeypatch.setattr(retrieval, "DOCUMENT_BLOCK", documents)
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", terms)
    r = random.Random(5)
    word = lambda: r.choice("aaaabbbccdefgh")
    for repeated in (False, True):
        c = [(f"d{i:02}", " ".join(word() for _ in range(r.randint(0, 9)))) for i in range(60)]
        c += [(None, "a h"), ("none", None)] + [("d03", "a b"), ("d03", "a c"), ("d03", "a b h"), ("d04", c[4][1])] * repeated
        q = [(i, " ".join(word() for _ in range(r.randint(0, 4)))) for i in range(12)] + [(None, "h g"), (3, "a b"), (90, "a h"), (91, "h a"), (92, None)]
        docs = [(i, t.split()) for i, t in c if t is not None]
        n, avgdl = len(docs), sum(len(t) for _, t in docs) / len(docs)
        # SQL's groups: texts of an id that are equally long add up their frequencies.
        tf = Counter((w, i, len(t)) for i, t in docs for w in t)
        df, asked = Counter(w for w, _, _ in tf), Counter((i, w) for i, t in q if t for w in t.split())
        want = set()
        for i in {i for i, _ in asked}:
            s = Counter()
            for (w, d, dl), f in tf.items():
                s[d] += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl)) * asked[i, w]
            best = sorted((-round(x, 6), d or "") for d, x in s.items() if round(x, 6) > 0)[:5]
            want |= {(i, d or None, -x, k) for k, (x, d) in enumerate(best, 1)}
        corpus = spark.createDataFrame(c, "id string, text string").repartition(3)
        got = {(x.query_id, x.id, round(x.score, 6), x.rank) for x in retrieval.bm25(corpus, spark.createDataFrame(q, "query_id int, text string"), 5).collect()}
        assert got == want


def test_channels_are_filtered_before_they_are_ranked(spark):
    rows = [(i, "gold" if i >= 90 else "gold gold gold", [float(100 - i), 0.0], {"gold": 2.0 if i < 90 else 1.0}, "big" if i < 90 else "small") for i in range(100)] + [(200, None, None, None, "small")]
    c = spark.createDataFrame(rows, "id long, text string, v array<double>, w map<string,double>, scope string")
    q = spark.createDataFrame([(1, "gold", [1.0, 0.0], {"gold": 1.0}, "small"), (2, "gold", [1.0, 0.0], {"gold": 1.0}, None)], "query_id long, text string, v array<double>, w map<string,double>, scope string")
    got = {i: [x.id for x in retrieval.prefiltered(c, q, 5, pool=5).where(F.col("query_id") == i).orderBy("rank").collect()] for i in (1, 2)}
    assert got == {1: [90, 91, 92, 93, 94], 2: [0, 1, 2, 3, 4]}


def test_chains_are_numbered_in_groups(spark):
    d = spark.createDataFrame([("a", "g", "2"), ("b", "g", "1"), ("c", "h", "1"), ("d", None, "1"), ("e", None, "2")], "doc_id string, group_id string, rcept_dt string")
    got = {r.doc_id: (r.correction_order, r.is_latest) for r in versions.numbered(d).collect()}
    assert got == {"a": (1, True), "b": (0, False), "c": (0, True), "d": (0, False), "e": (1, True)}


def test_results_are_resumed(spark, tmp_path):
    at, seen = str(tmp_path / "done"), []

    def work(df):
        seen.append(sorted(r.id for r in df.collect()))
        return df.select("id", "q", F.concat(F.lit("answer "), "q").alias("a"), ((F.col("id") == 2) & (F.lit(len(seen)) == 1)).alias("failed"))

    table = lambda *rows: spark.createDataFrame(list(rows), "id long, q string")
    first = writers.resume(table((1, "x"), (2, "y")), "id", "q", "failed", at, work)
    assert {(r.id, r.failed) for r in first.collect()} == {(1, False), (2, True)}
    again = writers.resume(table((1, "x"), (2, "y"), (3, "z")), "id", "q", "failed", at, work)
    assert {(r.id, r.a, r.failed) for r in again.collect()} == {(1, "answer x", False), (2, "answer y", False), (3, "answer z", False)}
    # Another question under a known id is asked anew; nothing is asked twice.
    last = writers.resume(table((1, "w"), (3, "z")), "id", "q", "failed", at, work)
    assert {(r.id, r.a) for r in last.collect()} == {(1, "answer w"), (3, "answer z")}
    assert seen == [[1, 2], [2, 3], [1]]


def test_lookup_tables_are_replaced_as_a_whole(spark, tmp_path):
    for n in (1, 2):
        writers.write_named(spark.createDataFrame([(n, ["a"])], "k int, names array<string>"), str(tmp_path), "registry")
    files = list((tmp_path / "registry").glob("part-*"))
    assert [json.loads(x) for f in files for x in f.read_text().splitlines()] == [{"k": 2, "names": ["a"]}]
    assert not (tmp_path / ".registry.part").exists()
