import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import group_split, split_items, unify_text


def table(spark, rows):
    return spark.createDataFrame(rows, "fact_id long, company string, key string, ll_value string")


@pytest.mark.parametrize("least", [unify_text.HOT_ROWS, 2, 1])
def test_disguised_values(spark, monkeypatch, least):
    """No value, the repeated one, and every value met as a hot one."""
    monkeypatch.setattr(unify_text, "HOT_ROWS", least)
    plain = ["Mitészuho Robotics", "АО Голесбини Пром", "(주)한글", "Miteszuho Robotics", "※ Revenue", "", "АОС"]
    odd = ["Mitészuho Robotics", "Mitészuho Rob​otics", unicodedata.normalize("NFD", "Mitészuho Robotics"), "Mitészuho Rоbоtiсs", "Ｍitészuho Robotics", "АО Гoлecбини Пром", "（주）한글", "𝐌𝐢𝐭é𝐬𝐳𝐮𝐡𝐨 𝑅𝑜𝑏𝑜𝑡𝑖𝑐𝑠", unicodedata.normalize("NFD", "(주)한글"), "Proﬁt"]
    rows = [(i, v, None, "x") for i, v in enumerate(plain + odd)] + [(99, None, odd[0], "x"), (100, odd[0], None, "y")]
    got = {tuple(r) for r in unify_text.disguised(table(spark, rows), "fact_id", ["company", "key"]).collect()}
    assert got == {(i, "company") for i in range(len(plain), len(plain) + len(odd))} | {(99, "key"), (100, "company")}
    out = unify_text.unified(table(spark, rows), ["company", "key"])
    assert out.columns == ["fact_id", "company", "key", "ll_value"]
    by = {r.fact_id: r for r in out.collect()}
    assert len(by) == len(rows)
    assert [by[i].company for i in range(len(plain), len(plain) + len(odd))] == [plain[0]] * 5 + [plain[1], plain[2], plain[0], plain[2], "Profit"]
    assert by[99].company is None and by[99].key == plain[0]


def test_a_latin_plain_spelling_wins_over_twins_of_another_script(spark):
    cases = {r.ll_value: r.ll_canonical for r in unify_text.canonical_values(table(spark, [(1, "COC", None, ""), (2, "СОС", None, ""), (3, "СТО", None, "")]), ["company"]).collect()}
    assert cases == {"СОС": "COC"}


def test_clashing_columns_stay(spark):
    df = table(spark, [(1, "Ａ", None, "x")]).withColumn("ll_key", F.lit(1)).withColumn("ll_to", F.lit(2)).withColumn("ll_field", F.lit(3))
    r = unify_text.unified(df, ["company"]).first()
    assert (r.company, r.ll_key, r.ll_to, r.ll_field) == ("A", 1, 2, 3)


def test_empty_table(spark):
    assert unify_text.disguised(table(spark, []), "fact_id", ["company"]).count() == 0
    assert unify_text.unified(table(spark, []), ["company"]).count() == 0


def brute(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, *keys in rows:
        for k, v in enumerate(keys):
            if v is not None:
                parent[find((k, v))] = find(("row", i))
    low = {}
    for i, *_ in rows:
        low[find(("row", i))] = min(i, low.get(find(("row", i)), i))
    return {i: low[find(("row", i))] for i, *_ in rows}


@pytest.mark.parametrize(("edges_per_task", "rows"), [(2_000_000, group_split.BROADCAST_ROWS), (20, 0)])
def test_groups_equal_brute_force(spark, monkeypatch, edges_per_task, rows):
    monkeypatch.setattr(group_split, "BROADCAST_ROWS", rows)
    r = random.Random(edges_per_task)
    rows = [(i, *(None if r.random() < 0.4 else f"{'' if r.random() < 0.02 else r.randrange(260)}" for _ in range(3))) for i in range(1, 400)]
    rows += [(i, "hot", None, None) for i in range(1000, 1200)] + rows[:20]
    df = spark.createDataFrame(rows, "example_id long, query_id string, company string, report_id string").repartition(7)
    got = {x.example_id: x.group_id for x in group_split.groups(df, "example_id", ["query_id", "company", "report_id"], edges_per_task).collect()}
    assert got == brute(rows)


def test_stars_on_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = dict(map(tuple, group_split.stars(edges).collect()))
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


@pytest.mark.parametrize("most", [group_split.BROADCAST_ROWS, 0])
def test_splits_follow_the_greedy_rule(spark, monkeypatch, most):
    monkeypatch.setattr(group_split, "BROADCAST_ROWS", most)
    sizes = [50, 30, 30, 11, 7, 7, 7, 1, 1, 1, 1, 1, 1, 1, 1]
    rows = [(100 * g + j, 100 * g) for g, n in enumerate(sizes) for j in range(n)]
    targets = {"train": 0.7, "validation": 0.15, "test": 0.15}
    out = group_split.splits(spark.createDataFrame(rows, "example_id long, group_id long"), "example_id", targets).toPandas()
    assert len(out) == len(rows) and out.groupby("group_id").split.nunique().max() == 1
    left = {k: v * sum(sizes) for k, v in targets.items()}
    for n in sorted(sizes, reverse=True):
        left[max(left, key=left.get)] -= n
    assert out.split.value_counts().to_dict() == {k: round(v * sum(sizes) - left[k]) for k, v in targets.items()}
    assert group_split.splits(spark.createDataFrame([], "example_id long, group_id long"), "example_id", targets).count() == 0


def test_greedy_run_in_closed_form():
    for deficit, size, count in (([70000.5, 15000.2, 15000.3], 3, 9000), ([5.0, -20.0, 4.0], 2, 5000), ([0.0, 0.0, 0.0], 1, 4097)):
        slow, left = [0, 0, 0], list(deficit)
        for _ in range(count):
            j = max(range(3), key=lambda i: left[i])
            left[j] -= size
            slow[j] += 1
        assert group_split.greedy_run(deficit, size, count) == slow


def check(text, pieces, limit, overlap):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= limit for a, b in pieces)
    assert all(q[0] == p[1] - overlap and q[1] > p[1] for p, q in zip(pieces, pieces[1:], strict=False))
    assert text[: pieces[0][1]] + "".join(text[a + overlap : b] for a, b in pieces[1:]) == text


def test_cuts_hold_for_any_text():
    r = random.Random(4)
    for n in (0, 1, 99, 100, 101, 350, 1000, 5000):
        for alphabet in ("ab", "ab \n", "가나. ", "xy ,\n\n", "\U0001f600 "):
            text = "".join(r.choice(alphabet) for _ in range(n))
            for limit, overlap in ((100, 10), (60, 0), (101, 100)):
                check(text, split_items.cuts(text, limit, overlap), limit, overlap)
    with pytest.raises(ValueError, match="overlap"):
        split_items.cuts("a" * 50, 10, 10)


def test_cuts_prefer_natural_boundaries():
    text = "\n\n".join("The sum was paid in full. " * 20 for _ in range(8))
    pieces = split_items.cuts(text, 1500, 100)
    assert all(text[:b].endswith(("\n\n", ". ")) for _, b in pieces[:-1])
    one = "word " * 1000
    assert all(one[b - 1] == " " for _, b in split_items.cuts(one, 1500, 100))


def test_cuts_are_optimal():
    r = random.Random(8)
    for _ in range(30):
        text = "".join(r.choice(["a", "b. ", "\n", " ", ", "]) for _ in range(60))
        limit, overlap = 25, 5
        n, step = len(text), limit - overlap
        pos, penalty = split_items.boundaries(text, step)
        pos, penalty = [*pos.tolist(), n], [*penalty.tolist(), 0.0]
        ideal = (n + (-(-(n - overlap) // step) - 1) * overlap) / -(-(n - overlap) // step)
        cost = {}
        for p, pen in zip(pos, penalty, strict=True):
            options = [pen + 4 * ((p - ideal) / limit) ** 2] if overlap < p <= limit else []
            options += [cost[q] + pen + 4 * ((p - q + overlap - ideal) / limit) ** 2 for q in pos if q < p and p - q <= step and q in cost]
            if options:
                cost[p] = min(options)
        ends = [b for _, b in split_items.cuts(text, limit, overlap)]
        at = dict(zip(pos, penalty, strict=True))
        own = sum(at[e] + 4 * ((b - a - ideal) / limit) ** 2 for (a, b), e in zip(split_items.cuts(text, limit, overlap), ends, strict=True))
        assert np.isclose(own, cost[n])


def test_pieces_of_a_table(spark):
    long_ = "A sentence ends. " * 300
    rows = [("a", long_, 1), ("a", long_, 2), ("b", "short", 3), ("c", None, 4), ("d", "", 5), (None, long_, 6), ("a", long_ + "x", 7)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, piece int")
    out = split_items.pieces(df, "chunk_id", "text").toPandas()
    assert set(out.columns) == {"chunk_id", "piece", "start", "end", "text"}
    assert out[out.chunk_id == "b"].text.tolist() == ["short"] and out[out.chunk_id == "d"].text.tolist() == [""]
    assert (out.text.str.len() <= 1500).all() and "c" not in set(out.chunk_id)
    one = split_items.cuts(long_)
    assert len(out[out.chunk_id.isna()]) == len(one) and len(out[out.chunk_id == "a"]) == len(one) + len(split_items.cuts(long_ + "x"))
    assert split_items.pieces(df.limit(0), "chunk_id", "text").count() == 0
    assert split_items.pieces(df.where(F.col("chunk_id") == "b"), "chunk_id", "text", short=False).count() == 0
