import math
import random

import numpy as np
import pandas as pd
import pytest

from ledgerloom.llm import leak_search, mix_sources, residue

REAL = [
    "Access to the mine was denied by the county until 9 May; the session of the board had expired.",
    "Under Article 9 of the articles of association, lot [9] and annex [B] form part of the contract.",
    "Website maintenance expense was 9 million won, and the page not found complaints fell by half.",
    "정정 사유: 단순 기재 오류가 발생하여 금액을 9백만원으로 고침.\n오류번호 부여 체계도 함께 변경함.",
    "The set {a, b, c} of tranches is priced at $9 million; the fee is 9% and the cap 9%.",
    "The monitoring product of X alerts clients when a page answers 503 Service Unavailable and logs request 9.",
    "X sells a library that lets dashboards run where JavaScript is disabled; licence income was 9 million won.",
    "The template press division delivered 9 steel templates and 9 placeholder tiles to the buyer.",
    "Cost of sales: 9,800,855 (KRW million)",
    "",
]
RESIDUE = {
    "placeholder": ["Your text goes here.", "[회사명]은 [일자] 이사회에서 [금액]원 규모의 [계약명]을 체결하였습니다.", "계약상대: ○○○○\n계약금액: 0,000,000원", "Counterparty: ........", "Amount: ____ won", "회사명: (      )", "Date: [[sign_off]] / [[CORP_NM]].", "The amount is %sign_off% / %corp_nm%.", "@UNIT@ / @HOLDER@.", "null undefined NaN null undefined NaN row 3", "계약상대는 <<unit>> / <<holder>>."],
    "filler": ["LOREM  IPSUM dolor sit amet consectetur adipiscing elit", "asdf asdf qwer asdf asdf qwer", "테스트 테스트 테스트 테스트"],
    "error": ["Traceback (most recent call last): render_viewer line 9", "404 Not Found", "<h1>Gateway time-out</h1> Server at viewer node 3 port 80", "HTTP Status 502 - Bad Gateway.", "세션이 만료되었습니다.", "Access denied.", "Too many requests. Slow down"],
    "notice": ["Please enable JavaScript to view this filing.", "Loading viewer, please wait ...", "자바스크립트를 사용할 수 없는 브라우저입니다.", "Preview not available for this section."],
}


def test_detectors():
    auto = residue._compiled()
    assert [t for t in REAL if residue.kinds_of(t, auto)] == []
    for kind, texts in RESIDUE.items():
        assert [t for t in texts if kind not in residue.kinds_of(t, auto)] == []
        assert [t for t in texts if kind not in residue.kinds_of("\n".join([REAL[0], *REAL[3:5], t, "It closed."]) * 2, auto)] == []


DOCS = "doc_id long, text string, source string, company string, report_id string, kinds string"


def test_flagging_a_table(spark):
    rows = [(i, t, "s", "c", None, "k") for i, t in enumerate(REAL)]
    rows += [(100, None, None, None, None, None), (101, "x" * 300_000 + "\nAccess denied.\n" + "y" * 10, "s", "c", "r", "k"), (102, "404 Not Found", None, None, None, "k"), (103, "404 Not Found", None, None, None, "k")]
    # An unknown notice, repeated under several titles with other numbers.
    rows += [(200 + i, f"{t} Report\nThe viewer session {i} cannot start, retry later", "host", t, None, "k") for i, t in enumerate(["Alpha", "Beta", "Gamma"])]
    rows += [(300, "Delta Report\nThe viewer sold well in Delta, says the report", "host", "Delta", None, "k")]
    # A paragraph isn't a title: the same closing sentence under different paragraphs is real text.
    rows += [(400 + i, f"Paragraph {'abcd'[i] * 9} states what the board approved on a day in May.\nThe error number scheme changed", "host", "X", None, "k") for i in range(4)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.kinds for r in residue.flagged(df).collect()}
    assert set(got) == {101, 102, 103, 200, 201, 202}
    assert got[201] == "host"
    assert {r.doc_id for r in residue.cleaned(df).select("doc_id").collect()} == {r[0] for r in rows} - set(got)
    assert residue.flagged(df.limit(0)).count() == 0


def test_host_evidence_needs_no_words(spark):
    page = "Zorbl quandle {} missing. Frotz again."
    rows = [(i, page.format(i), "s", t, f"r_{i}", None) for i, t in enumerate(["Alpha", "Beta", None])]
    # As a line of a real text, and once more under a title that it shares a term with.
    real = " ".join("".join(random.Random(i).choices("abcdefgh", k=7)) for i in range(60))
    rows += [(10, f"{real}\n{page.format(7)}", "s", "Gamma", None, None), (11, "Zorbl Inc\n" + real, "s", "Zorbl Inc", None, None)]
    # A line that real texts hold more often than responses do is no residue, nor is a response of one title only.
    rows += [(20 + i, "Amounts in won", "s", f"T{i}", None, None) for i in range(3)] + [(30 + i, f"Amounts in won\n{real}", "s", f"T{i}", None, None) for i in range(3)]
    rows += [(40 + i, "Plugh closed", "s", "Delta", None, None) for i in range(5)] + [(50, "", "s", "E", None, None), (51, None, None, None, None, None)]
    rows += [(60, "tra la tra la tra la tra la tra la", "s", "E", None, None)]
    df = spark.createDataFrame(rows, DOCS)
    seen = residue.looked_at(df)
    assert {r.doc_id for r in residue.residue_shapes(seen).collect()} == {0, 1, 2, 10}
    assert [r.doc_id for r in seen.where("array_contains(kinds, 'repetition')").collect()] == [60]


@pytest.mark.parametrize("most", [0, 200_000])
def test_shapes_met_by_a_shuffle(spark, monkeypatch, most):
    monkeypatch.setattr(residue, "BROADCAST_SHAPES", most)
    df = spark.createDataFrame([(i, "Zorbl quandle 5", "s", t, None, None) for i, t in enumerate("ABCD")], DOCS)
    assert {r.doc_id for r in residue.residue_shapes(residue.looked_at(df)).collect()} == {0, 1, 2, 3}


def words(r, n):
    return [r.choice(["".join(r.choices("abcdefgh", k=5)) for _ in range(1)]) for _ in range(n)]


def test_aligned_words_equals_a_plain_table():
    r = random.Random(1)
    for _ in range(40):
        a, b = [r.randrange(6) for _ in range(r.randrange(1, 15))], [r.randrange(6) for _ in range(r.randrange(1, 20))]
        h = [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
        best = (0, 0)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                s, m = h[i - 1][j - 1]
                opts = [(s + 1, m + 1) if a[i - 1] == b[j - 1] else (s - 1, m), (h[i - 1][j][0] - 1, h[i - 1][j][1]), (h[i][j - 1][0] - 1, h[i][j - 1][1])]
                x = max(opts)
                h[i][j] = x if x[0] > 0 else (0, 0)
                best = max(best, h[i][j])
        assert leak_search.aligned_words(np.array(a), np.array(b)) == best[1]


@pytest.mark.parametrize("bits", [leak_search.MOST_BITS, 1 << 16])
def test_leaks_equal_brute_force(spark, bits):
    r = random.Random(5)
    items = [(i, words(r, r.choice([8, 40, 60, 61, 150])), "x") for i in range(1, 12)]
    docs, want = [], set()
    for d in range(150):
        base = words(r, r.choice([0, 5, 200, 900]))
        if d % 3 == 0:
            i, w, _ = r.choice(items)
            share = r.choice([0.3, 0.62, 0.8, 1.0])
            n = round(len(w) * share)
            at = r.randrange(len(w) - n + 1)
            piece = list(w[at : at + n])
            if share > 0.7 and n > 20:
                piece[n // 3] = "changed"
                del piece[n // 2]
            k = r.randrange(len(base) + 1)
            base[k:k] = [x.upper() if r.random() < 0.2 else x for x in piece]
            if share > 0.5:
                want.add((d, i))
        docs.append((d, (r.choice([" ", "\n", ", "])).join(base), 7))
    docs += [(1000, None, 1), (1001, docs[0][1], 1), (1002, " ".join(words(r, 30_000) + items[0][1]), 1)]
    want |= {(1001, i) for d, i in want if d == 0} | {(1002, items[0][0])}
    df = spark.createDataFrame(docs, "doc_id long, text string, passage_id int")
    ev = spark.createDataFrame([(i, " ".join(w), x) for i, w, x in items] + [(50, None, ""), (51, "one two", ""), (52, "", "")], "passage_id long, text string, doc_id string")
    assert {(x.doc_id, x.passage_id) for x in leak_search.leaks(df, ev, most_bits=bits).collect()} == want
    assert leak_search.leaks(df.limit(0), ev).count() == 0 and leak_search.leaks(df, ev.limit(0)).count() == 0


def test_every_stretch_of_half_an_item_holds_a_piece():
    for n in range(6, 300):
        own, stretch = leak_search.pieces(n), math.ceil(n / 2)
        assert all(any(a >= at and b <= at + stretch for a, b in own) for at in range(n - stretch + 1)), n


def test_equal_items_null_and_repeated_ids(spark):
    text = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    ev = spark.createDataFrame([(7, text), (7, text), (None, text), (None, None), (8, "a b c")] + [(100 + i, f"other{i} one{i} two{i} three{i}") for i in range(50)], "passage_id long, text string")
    got = sorted(((r.doc_id or 0, r.passage_id or 0) for r in leak_search.leaks(df, ev).collect()))
    assert got == [(0, 0), (0, 7), (0, 7)] + [(1, 0)] * 2 + [(1, 7)] * 4


def test_split_tree_keeps_quotas():
    for shards in (1, 2, 5, 8):
        tree = list(mix_sources.split_tree([7, 0, 30, 1], shards, 3))
        assert [n for n, _, _ in tree] == list(range(shards)) and [sum(c) for c in zip(*(q for *_, q in tree), strict=True)] == [7, 0, 30, 1]
        assert max(sum(q) for *_, q in tree) - min(sum(q) for *_, q in tree) <= 2
    # Where the upper nodes are drawn makes no difference.
    whole = list(mix_sources.split_tree([70, 5, 300], 20, 9))
    parts = [leaf for first, n, q in mix_sources.split_tree([70, 5, 300], 20, 9, down_to=6) for leaf in mix_sources.split_tree(q, n, 9, first)]
    assert whole == parts


def test_permutations():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 97, 1000):
        a, c, back = mix_sources.permutation(n, rng)
        to = [(a * i + c) % n for i in range(n)]
        assert sorted(to) == list(range(n)) and [(t - c) * back % n for t in to] == list(range(n))


def test_quotas_meet_targets_and_caps():
    totals = {"a": (10_000, 100), "b": (1_000, 10), "c": (4_000, 40)}
    targets = {"a": (0.5, 1), "b": (0.2, 3), "c": (0.3, 2), "none": (0.1, 9)}
    total, wanted = mix_sources.targets_of(totals, targets)
    got = {s: p * totals[s][0] + rest for s, (p, rest) in wanted.items()}
    assert [round(got[s] / sum(got.values()), 3) for s in "abc"] == [0.5, 0.2, 0.3] and sum(got.values()) == round(total)
    assert all(p + (rest > 0) <= targets[s][1] for s, (p, rest) in wanted.items())
    assert mix_sources.targets_of(totals, targets, 1e9)[1] == {"a": (1, 0), "b": (3, 0), "c": (2, 0)}


def test_shards_of_fifty_billion_tokens(spark):
    totals = {"a": (41_000_000_000, 80_000_000), "b": (20_000_000_000, 10_000_000), "c": (900_000_000, 1_000_000)}
    total, wanted = mix_sources.targets_of(totals, {"a": (0.66, 1), "b": (0.3, 1), "c": (0.04, 4)})
    counts = mix_sources.sizes(totals)
    assert max(totals[s][0] / n for s, n in counts.items()) <= mix_sources.SHARD_TOKENS / 4
    rng = np.random.default_rng(0)
    quotas = []
    for s, (passes, rest) in wanted.items():
        q = mix_sources.Quota(s, counts[s], passes, rest * counts[s] // totals[s][0], order=mix_sources.permutation(counts[s], rng))
        q.turn = mix_sources.permutation(q.copies, rng)
        quotas.append(q)
    df = mix_sources.block_copies(spark, quotas, total)
    by = df.groupBy("shard").count().toPandas()
    shards = math.ceil(total / mix_sources.SHARD_TOKENS)
    assert len(by) == shards > 10_000
    tokens = by["count"] * (sum(q.copies * totals[q.source][0] / q.blocks for q in quotas) / by["count"].sum())
    assert (abs(tokens - total / shards) <= 0.05 * mix_sources.SHARD_TOKENS).all()
    assert df.count() == df.select("source", "block", "copy").distinct().count() == sum(q.copies for q in quotas)


def test_mixing_a_table(spark, monkeypatch):
    rows = [(i, "word " * (5 + i % 7), "a" if i < 300 else "b", 1) for i in range(330)] + [(900, None, "a", 1), (901, "x", None, 1), (902, "x", "unknown", 1), (903, "", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 4), ("empty", 0.2, 1)], "source string, target_share double, max_repeats int")
    out = mix_sources.mix(docs, targets, block_tokens=50, shard_tokens=1000).toPandas()
    assert not out.duplicated(["doc_id", "copy"]).any() and not out.duplicated(["shard", "position"]).any()
    assert set(out.source) == {"a", "b"} and out[out.source == "b"].groupby("doc_id").size().max() <= 4
    share = out.groupby("source").n_tokens.sum() / out.n_tokens.sum()
    assert abs(share["a"] - 0.7) < 0.02
    monkeypatch.setattr(mix_sources, "BROADCAST_BLOCKS", 0)
    again = mix_sources.mix(docs.repartition(5), targets, block_tokens=50, shard_tokens=1000).toPandas()
    pd.testing.assert_frame_equal(out.sort_values(["shard", "position"], ignore_index=True), again.sort_values(["shard", "position"], ignore_index=True))
    assert all(r.meets and r.within for r in mix_sources.reached(spark.createDataFrame(out), docs, targets).collect())
    report = {r.source: r for r in mix_sources.shares(spark.createDataFrame(out), targets).collect()}
    assert report["empty"].share == 0.0 and report["b"].repeats == out[out.source == "b"].groupby("doc_id").size().max()
    assert mix_sources.mix(docs.limit(0), targets).count() == 0 and mix_sources.mix(docs, targets.limit(0)).count() == 0
