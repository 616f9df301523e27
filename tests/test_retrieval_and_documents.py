import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import chunking, evaluate, retrieval
from ledgerloom.plans import planner
from ledgerloom.plans.tools import Tools
from ledgerloom.sources import markup, readers, writers

RANKED = "query_id int, channel string, id string, score double, rank int"


def ranked(spark, lists):
    return spark.createDataFrame([(1, ch, i, float(s), k) for ch, rows in lists.items() for k, (i, s) in enumerate(rows, 1)], RANKED)


def order(df):
    return [r.id for r in df.orderBy("query_id", "rank").collect()]


def test_fusion(spark):
    lists = {"a": [("A", 9.0), ("B", 2.0), ("C", 1.9)], "b": [("D", 5.0), ("B", 5.0), ("E", 5.0)]}
    df = ranked(spark, lists)
    assert order(retrieval.rrf(df))[0] == "B"
    w = retrieval.weighted(df, {"a": 0.6, "b": 0.4, "missing": 0.5})
    got = {r.id: r.score for r in w.collect()}
    assert order(w)[0] == "A" and got["A"] == pytest.approx(0.6) and got["D"] == pytest.approx(0.2)
    assert order(retrieval.hybrid([("a", df.where("channel = 'a'"))], 2)) == ["A", "B"]
    reverse = lambda d: d.withColumn("score", -F.col("score"))
    assert order(retrieval.hybrid([("a", df.where("channel = 'a'"))], 2, reverse)) == ["C", "B"]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("1", "a b b"), ("2", "b c"), ("3", "d"), ("4", None)], "id string, text string")
    q = spark.createDataFrame([("q", "b b x"), ("none", "zzz")], "query_id string, text string")
    got = {r.id: r.score for r in retrieval.bm25(docs, q, 5).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    part = lambda tf, dl: 2 * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 2))
    assert got == {"1": pytest.approx(part(2, 3), abs=1e-6), "2": pytest.approx(part(1, 2), abs=1e-6)}


def test_dense_equals_brute_force_in_blocks(spark, monkeypatch):
    r = random.Random(0)
    v = [(i, [r.choice([-1.0, 0.0, 1.0]) for _ in range(8)]) for i in range(300)]
    df = spark.createDataFrame(v, "id long, v array<float>").repartition(3)
    q = spark.createDataFrame(v[:7], "query_id long, v array<float>")
    want = {(qi, i, k) for qi, qv in v[:7] for k, (_, i) in enumerate(sorted((-sum(x * y for x, y in zip(qv, iv, strict=True)), i) for i, iv in v)[:5], 1)}
    assert {(x.query_id, x.id, x.rank) for x in retrieval.dense(df, q, 5).collect()} == want
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    assert {(x.query_id, x.id, x.rank) for x in retrieval.dense(df, q, 5).collect()} == want
    assert retrieval.dense(df, q.limit(0), 5).count() == 0
    # The filter before the ranking gives what filtering after a full ranking gives.
    few = retrieval.dense(df.where("id % 3 = 0"), q, 5)
    full = retrieval.dense(df, q, 300).where("id % 3 = 0")
    assert few.count() == 35 and few.join(full, ["query_id", "id", "score"]).count() == 35


def test_merging_and_budget(spark):
    lists = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "b", 1), (1, 1, "c", 2)], "query_id int, list int, id string, rank int")
    assert order(retrieval.round_robin(lists)) == ["a", "b", "c"] and order(retrieval.keep_order(lists, 2)) == ["a", "b"]
    b = spark.createDataFrame([(1, "a", 1, 50), (1, "b", 2, 60), (1, "c", 3, 1), (2, "x", 1, 500)], "query_id int, id string, rank int, n int")
    assert {(r.query_id, r.id, r.n_left) for r in retrieval.budget_prefix(b, F.col("n"), 100).collect()} == {(1, "a", 2), (2, "x", 0)}


def test_parent_expansion(spark):
    chunks = spark.createDataFrame([("p", None, "x" * 300 + "LEAF" + "y" * 300), ("l", "p", "LEAF"), ("m", "p", "LEAF"), ("o", None, "own")], "id string, parent_id string, text string")
    hits = spark.createDataFrame([(1, "l", 1), (1, "m", 2), (1, "o", 3)], "query_id int, id string, rank int")
    out = {r.id: r.text for r in retrieval.expand_to_parent(hits, chunks, most=100).collect()}
    assert set(out) == {"l", "o"} and "LEAF" in out["l"] and len(out["l"]) == 100 and out["o"] == "own"


def test_rank_metrics(spark):
    r = spark.createDataFrame([(1, "g", 1), (1, "g", 2), (1, "x", 3), (1, "h", 4), (2, "x", 1)], "query_id int, doc string, rank int")
    g = spark.createDataFrame([(1, "g"), (1, "h"), (2, "z")], "query_id int, doc string")
    m = {x.query_id: x for x in evaluate.rank_metrics(r, g, 5).collect()}
    assert (m[1].recall, m[1].mrr, m[1].precision, m[1].ap) == (1.0, 1.0, 0.75, 0.75)
    assert m[1].ndcg == pytest.approx((1 + 1 / math.log2(5)) / (1 + 1 / math.log2(3)), abs=1e-6) and m[1].ndcg <= 1
    assert (m[2].recall, m[2].hit, m[2].first_rank) == (0.0, 0, None)


def test_abstention_scores(spark):
    gold = spark.createDataFrame([("1", "r", "refuse"), ("2", "r", "answer"), ("3", "r", "abstain")], "id string, reason string, expected_action string")
    pred = spark.createDataFrame([("1", "abstain"), ("2", "refuse")], "id string, action string")
    r = evaluate.abstention_score(gold, pred).first()
    assert (r.n, r.right, r.exact, r.missing, r.false_refusals) == (3, 1, 0, 1, 1)


def test_repairs():
    good = '<p a="1">x &amp; y</p>'
    assert markup.sanitise(good) == (good, markup.Repairs())
    fixed, n = markup.sanitise('<p>A & B <주식> 3 < 5</p><TD note="he said "no" loudly" x="1">v</TD>')
    assert (n.bare_amp, n.bare_lt, n.broken_attr) == (1, 2, 1) and "&lt;주식>" in fixed
    texts = [x.text for x in markup.parse("<p>A & B <주식> 3 < 5</p>")]
    assert texts == ["A & B <주식> 3 < 5"]


def test_grids_and_classes():
    c = lambda t, **k: markup.Cell(text=t, **k)
    g = markup.expand_grid([[c("a", rowspan=2), c("b", colspan=2)], [c("d")], [c("e")]])
    assert [[x.text for x in r] for r in g] == [["a", "b", "b"], ["a", "d", ""], ["e", "", ""]]
    assert g[1][0].dup_up and g[0][2].dup_left and g[1][2].origin == -1
    html = "<section-1><title>Part 1</title><p>(단위: 원)</p><table><tr><td>Key</td><te acode='F1'>5</te></tr><tr><td colspan=2>note</td></tr><tr><td>G</td><td>k</td><td>v</td></tr></table><table><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr></table>"
    nodes = markup.parse(html)
    assert [(n.kind, n.label) for n in nodes] == [("text", None), ("pairs", None), ("text", None), ("pairs", "G"), ("table", None)]
    assert nodes[1].unit == "(단위: 원)" and nodes[1].pairs[0][1].code == "F1" and nodes[1].section == ["Part 1"]


def test_chunks_keep_their_bounds():
    r = random.Random(1)
    nodes = []
    for i in range(60):
        kind = r.choice(["text", "text", "pairs"])
        nodes.append({"section_path": [f"s{i // 10}"], "kind": kind, "label": None, "text": "The sum was paid. " * r.randrange(1, 300) if kind == "text" else "", "unit_hint": None, "pairs": [{"key": "k", "value": "v" * r.randrange(50), "unit_value": None}] if kind == "pairs" else [], "grid": [], "origins": []})
    for group in chunking.GROUPS:
        out = chunking.chunk_document(nodes, "d", group)
        leaves = [c for c in out if c["content_type"] != "parent"]
        assert len({c["chunk_id"] for c in out}) == len(out) and all(chunking.tokens(c["text"]) <= chunking.MAXIMUM for c in leaves)
        parents = {c["chunk_id"] for c in out if c["content_type"] == "parent"}
        assert {c["parent_chunk_id"] for c in leaves} - {None} <= parents
        total = sum(len("".join(n["text"].split())) for n in nodes)
        assert sum(len("".join(c["text"].split())) for c in leaves) >= 0.95 * total
    assert len(chunking.chunk_document(nodes[:1], "d", "major")) >= 1
    with pytest.raises(ValueError, match="odd"):
        chunking.chunk_document(nodes, "d", "odd")


def test_tables_are_cut_by_blocks():
    grid = [["item", "2024", "2023"]] + [[f"{i}. row", str(i), "x" * 40] for i in range(100)]
    origins = [[3 * i, 3 * i + 1, 3 * i + 2] for i in range(101)]
    out = chunking.render_table(grid, origins, budget=200)
    assert len(out) > 5 and all(t.startswith("item | 2024 | 2023") and chunking.tokens(t) <= 200 for t in out)
    assert sum(t.count(". row") for t in out) == 100
    assert chunking.is_contents([["I. Overview ..............", "3"]] * 3) and not chunking.is_contents(grid)
    assert chunking.semantic_blocks([["A", "A"], ["x", "1"], ["B", "B"], ["y", "2"]], [[0, 0], [1, 2], [3, 3], [4, 5]]) == [[0, 1], [2, 3]]
    assert chunking.pack([("text", "a" * 1300), ("pairs", "b" * 400), ("text", "c" * 100)]) == [("text", "a" * 1300), ("pairs", "b" * 400 + "\n" + "c" * 100)]


def test_planner(spark):
    q = spark.createDataFrame([("1", "A의 2024년 매출액은 얼마인가?", ["A"], ["2024"]), ("2", "A와 B 중 더 큰 쪽은?", ["A", "B"], []), ("3", "오늘 주가 알려줘", [], []), ("4", "쿠팡의 매출액은 얼마인가?", [], []), ("5", "2024년 05월 정정본의 최초와 최종 차이는?", ["A"], [])], "query_id string, query string, companies array<string>, periods array<string>")
    p = planner.plans(q)
    got = {r.query_id: r for r in p.collect()}
    assert (got["1"].answer_mode, got["1"].task, got["2"].task, got["2"].winner, got["5"].task, got["5"].latest_policy) == ("closed", "lookup", "compare", True, "correction_diff", "first_and_final")
    s = {r.query_id: (r.decision, r.reason) for r in planner.scope(p, spark.createDataFrame([("A",)], "name string")).collect()}
    assert s["1"][0] == "proceed" and s["3"] == ("refuse", "market_price") and s["4"] == ("out_of_corpus", "unknown_company")
    d = sorted((r.query_id, r.sub_id, r.company) for r in planner.decompose(p).collect())
    assert ("2", 0, "A") in d and ("2", 1, "B") in d and len(d) == 6
    assert {r.query_id for r in planner.concept_kinds(spark.createDataFrame([("x", "자금조달 내역")], "query_id string, query string"), spark.createDataFrame([("주요사항보고서(유상증자결정)",), ("합병",)], "kind string")).collect()} == {"x"}


def test_gates(spark):
    planned = spark.createDataFrame([("1", "closed", ["Total assets"]), ("2", "open", ["x"]), ("3", "closed", [])], "query_id string, answer_mode string, expected_fields array<string>")
    subs = spark.createDataFrame([("1", 0), ("2", 0), ("3", 0), ("3", 1)], "query_id string, sub_id int")
    hits = spark.createDataFrame([("1", 0), ("2", 0), ("3", 0)], "query_id string, sub_id int")
    found = spark.createDataFrame([("1", "Totalassets")], "query_id string, item string")
    a = {r.query_id: (r.action, r.reason) for r in planner.abstention(planned, planner.sufficiency(planned, subs, hits, found)).collect()}
    assert a == {"1": ("answer", None), "2": ("partial", "missing_field"), "3": ("abstain", "empty_target")}


def test_facts_are_reduced_before_they_meet_questions(spark):
    from ledgerloom.queries.planning import _fact_hits

    planned = spark.createDataFrame([("1", ["Total assets", "x"]), ("2", ["x"]), ("3", [])], "query_id string, expected_fields array<string>")
    subs = spark.createDataFrame([("1", 0, "A"), ("1", 1, "B"), ("2", 0, "C"), ("3", 0, None)], "query_id string, sub_id int, company string")
    # Hundreds of items of a company that no question asks for must not stand beside its questions.
    rows = [("A", f"i{i}") for i in range(300)] + [("A", None), ("B", "totalassets"), ("B", "total assets"), (None, "x")]
    hits, items = _fact_hits(planned, subs, spark.createDataFrame(rows, "company string, key_norm string"))
    assert sorted(tuple(r) for r in hits.collect()) == [("1", 0, 301), ("1", 1, 2)]
    assert [tuple(r) for r in items.collect()] == [("1", "Total assets")]
    got = {r.query_id: (r.n_hits, r.missing, r.empty_targets) for r in planner.sufficiency(planned, subs, hits, items).collect()}
    assert got == {"1": (303, ["x"], 0), "2": (0, ["x"], 1), "3": (0, [], 1)}


def test_gates_broadcast_no_questions(spark):
    planned = spark.range(100).select(F.col("id").cast("string").alias("query_id"), F.lit("open").alias("answer_mode"), F.array(F.lit("x")).alias("expected_fields"))
    subs = planned.select("query_id", F.lit(0).alias("sub_id"))
    plan = planner.abstention(planned, planner.sufficiency(planned, subs, subs, planned.select("query_id", F.lit("x").alias("item"))))
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {(r.action, r.reason) for r in plan.collect()} == {("answer", None)}


def test_names_are_masked_without_a_broadcast(spark):
    q = spark.range(3).select(F.col("id").cast("string").alias("query_id"), F.lit("ab cd").alias("query"))
    found = spark.range(2).select(F.col("id").cast("string").alias("query_id"), F.lit(0).alias("start"), F.lit(2).alias("end"))
    marked = planner.masked(q, found)
    assert "Broadcast" not in marked._jdf.queryExecution().executedPlan().toString()
    assert {r.query_id: r.masked for r in marked.collect()} == {"0": "[COMPANY] cd", "1": "[COMPANY] cd", "2": "ab cd"}


def test_names_in_questions(spark):
    e = spark.createDataFrame([("e1", ["한국전자", "한국전자통신"]), ("e2", ["Acme Robotics"])], "entity_id string, aliases array<string>")
    q = spark.createDataFrame([("1", "한국전자통신의 매출과 acme robotics, 한국전자"), ("2", "acme roboticsx"), ("3", None)], "query_id string, query string")
    m = planner.mentions(q, e)
    assert [(r.query_id, r.surface) for r in m.orderBy("start").collect()] == [("1", "한국전자통신"), ("1", "acme robotics"), ("1", "한국전자")]
    assert {r.query_id: r.masked for r in planner.masked(q, m).collect()} == {"1": "[COMPANY_1]의 매출과 [COMPANY_2], [COMPANY_3]", "2": "acme roboticsx", "3": None}


def test_item_hits(spark):
    c = spark.createDataFrame([("q", "c1", "Revenue was 1,234 won", [("Net income", "55")])], "query_id string, id string, text string, field_codes array<struct<key:string,text:string>>")
    i = spark.createDataFrame([("q", "Netincome"), ("q", "revenue"), ("q", "cost")], "query_id string, item string")
    assert {(r.item, r.value, r.source) for r in planner.item_hits(c, i).collect()} == {("Netincome", "55", "code"), ("revenue", "1,234", "text")}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"doc_id": "d1", "corp_name": "한", "file_path": "a/한/1"}\n\n{"doc_id": "d2", "doc_group": "major"}\n', encoding="utf-8")
    m = readers.load_manifest(spark, str(tmp_path / "m.jsonl"))
    assert [(r.corp_name, r.file_format, r.n_files) for r in m.orderBy("doc_id").collect()] == [("한", "xml", 1), (None, "xml", 1)]
    r = readers.resolve_paths(m, spark.createDataFrame([("file:/a/한/1",)], "path string"))
    assert {x.doc_group: x.healthy for x in readers.validate_corpus(r).collect()}["all"] is False
    (tmp_path / "u.csv").write_text("﻿code,name\n00123,x\n", encoding="utf-8")
    assert readers.load_universe(spark, str(tmp_path / "u.csv")).first().asDict() == {"code": "00123", "name": "x"}
    old, new = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, x int"), spark.createDataFrame([("a", 1, 2), ("c", 1, 3)], "k string, v int, x int")
    assert {tuple(x) for x in writers.upsert(old, new, "k", "v").collect()} == {("a", 1, 2), ("b", 1, 1), ("c", 1, 3)}
    with pytest.raises(ValueError, match="unknown chunk"):
        writers.check_index(spark.createDataFrame([("z",)], "id string"), spark.createDataFrame([("a",)], "chunk_id string"))
    b = readers.Bundle(spark, {"none": str(tmp_path / "nope")})
    assert b["none"] is None and b.missing == ["none"]


def test_tool_errors_are_data(spark):
    t = Tools(spark.createDataFrame([], "x int"), spark.createDataFrame([], "x int"))
    assert t.call("no_such").first().error == "ValueError" and t.call("calculate_ratio", part=1, whole=4).first().value == 25.0
    assert t.call("calculate_growth_rate", nope=1).first().error == "TypeError"


def test_long_tables_are_read_to_their_end():
    rows = "".join(f'<tr><td>k{i}</td><td acode="C{i}">{i}</td></tr>' for i in range(7000))
    pairs = [(k, c.text) for n in markup.parse(f"<table>{rows}</table>") for k, c in n.pairs]
    assert pairs == [(f"k{i}", str(i)) for i in range(7000)]
    # A span over the former limit, in a table that stays one.
    wide = "".join(f"<tr>{'<td rowspan=3>s</td>' if i == 2999 else '' if i in (3000, 3001) else '<td>a</td>'}<td>b{i}</td><td>c</td><td>d</td></tr>" for i in range(3500))
    (table,) = markup.parse(f"<table>{wide}</table>")
    assert len(table.grid) == 3500 and [r[0].text for r in table.grid[2998:3003]] == ["a", "s", "s", "s", "a"]
