import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import link_names, map_values, survivor

SAME = [
    ["Mehalbuba Robotics Group plc", "mehalbuba robbotics", "The Mehalbuba Robo Company", "Mehallbuba Robotics Group plc", "Robotics Mehalbuba", "Mehalbuba", "Mehal-buba Robotics", "MehalbubaRobotics", "Mehalbuba Grp"],
    ["Lunuldöma Securities Corporation", "Corporation Lunuldoma Securities", "Lunuldoma Sec.", "LUNULDÖMA SECURITIES CORPORATION"],
    ["(주)헤항니소제약", "헤항니소 제약", "해항니소제약", "주식 회사 헤항니소-제약", "헤항니소그룹", "헤항니소소제약 (본사)"],
    ["Victoria Gasolpehi", "Gasolpehi, V.", "GASOLPEHI Vicky", "Dr. Victoria Gasolpehi", "Victoria J. Gasolpehi", "Vicky Gasoplehi"],
    ["АО Голесбини Пром", "Голесбини Пром", "голесбиин пром"],
]
OTHER = ["Mehalbuba Energy Group plc" + "x", "Konitune Insurance Co., Ltd.", "Konitune Biologics Inc.", "Konitune", "Ursula Kekintada", "Patricia Kekintada", "Kekintada, K.", "Inc.", "Zutarhesa Holdings"]


def pairs(spark, names):
    got = link_names.variant_pairs(spark.createDataFrame([(n,) for n in names], "name string"))
    return {tuple(r) for r in got.collect()}


def test_variants_are_linked(spark):
    names = [n for g in SAME for n in g] + OTHER[1:]
    want = {tuple(sorted(p)) for g in SAME for p in itertools.combinations(g, 2)}
    assert pairs(spark, [*names, *names[:5], None, "", "  "]) == want


def test_names_edge_cases(spark):
    assert pairs(spark, []) == set()
    assert pairs(spark, ["x" * 5000, "(주)", "Co., Ltd."]) == set()


def near(a, b):
    """Whether b comes from a by at most one inserted, left out, changed or transposed letter."""
    if a == b:
        return True
    cut = lambda x: {x[:i] + x[i + 1 :] for i in range(len(x))}
    swapped = {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    return b in cut(a) or a in cut(b) or b in swapped or len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1


@pytest.mark.parametrize(("alphabet", "least", "sizes"), [("abc", link_names.FUZZY_LENGTH, (3, 12)), ("가나다", link_names.FUZZY_SYLLABLES, (2, 8))])
def test_segment_join_equals_brute_force(spark, alphabet, least, sizes):
    r = random.Random(2)
    words = {"".join(r.choice(alphabet) for _ in range(r.randrange(*sizes))) for _ in range(160)}
    for w in list(words):  # and neighbours of the long ones
        i = r.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + alphabet[0] + w[i:], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]}
    words = sorted(w for w in words if len(w) > 1)
    at = {w: i for i, w in enumerate(words)}
    df = spark.createDataFrame([("r", i, w) for w, i in at.items()], "role string, a long, s string")
    got = {(x.a, x.b) for x in link_names.near_pairs(df, df.selectExpr("role", "a AS b", "s AS t")).collect()}
    assert got == {(at[x], at[y]) for x in words for y in words if x != y and len(x) >= least and len(y) >= least - 1 and near(x, y)}


def test_held_out_names(spark):
    """Names made of words that no table knows, typed in other ways: recall and precision of the pairs."""
    r = random.Random(6)
    kinds = ["Aquaculture", "Tanneries", "Brickworks", "Vineyards", "Salvage", "Ceramics"]
    entities, group = {}, {}
    while len(entities) < 150:
        stem = "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(4)).capitalize()
        entities[f"{stem} {r.choice(kinds)}"] = None
    for e in entities:
        stem, kind = e.split()
        i = r.randrange(1, len(stem) - 1)
        typed = [e, e.upper(), f"{kind} {stem}", f"{stem}{kind}", f"The {e} Company", f"{stem[:i]}-{stem[i:]} {kind} Ltd.", f"{stem[:i]}{stem[i + 1 :]} {kind}", f"{stem} {kind[:3]}{kind[4]}{kind[3]}{kind[5:]}", f"{kind} {stem[: i + 1]}{stem[i:]}"]
        group |= {t: e for t in typed}
    want = {(a, b) for a, b in itertools.product(group, group) if a < b and group[a] == group[b]}
    for known in (link_names.Words(), link_names.Words(kinds=(), given={})):
        g = {x.name: x.group for x in link_names.linked(spark.createDataFrame([(n,) for n in group], "name string"), known).collect()}
        got = {(a, b) for a, b in itertools.product(g, g) if a < b and g[a] == g[b]}
        assert len(got & want) / len(want) >= 0.9 and len(got & want) / len(got) >= 0.99


ITEMS = [("F1", "Total assets", ["p"]), ("F2", "Total liabilities", ["p"]), ("F3", "Pledged shares", ["h"]), ("F4", "자산총계", ["p"]), ("F5", "Stake before report", ["h"]), ("F6", "Stake after report", ["h"])]


CASES = [("3) TotalAssets (단위: 원)", "p", "F1"), ("Liabilities, total", "p", "F2"), ("TOTAL LIABILITIES TOTAL [note 3]", "p", "F2"), ("tot. liabs", "p", "F2"), ("Pldgd shrs", "h", "F3"), ("자 산 총 게", "p", "F4"), ("Stake bfre rprt", "h", "F5"),
     ("Total assets", "h", None), ("other Elevator inspection", "p", None), ("", "p", None), ("※", "h", None), ("Assets of the canteen", "p", None)]


@pytest.mark.parametrize("in_memory", [map_values.POSTINGS_IN_MEMORY, 0])
def test_values_are_mapped(spark, in_memory):
    """With a copy of the index in every task, and by a join."""
    values = spark.createDataFrame([c[:2] for c in CASES], "ll_raw string, ll_scope string")
    ref = spark.createDataFrame(ITEMS, "code string, name string, scopes array<string>")
    got = {(r.ll_raw, r.ll_scope): r.code for r in map_values.matched_values(values, ref, in_memory=in_memory).collect()}
    assert got == {(v, sc): c for v, sc, c in CASES if c}


def test_words_pair_off():
    assert map_values.explains(["tot", "assets"], ["assets", "total"]) and not map_values.explains(["tot", "tot"], ["total", "assets"])
    assert not map_values.explains(["a"] * 40, ["ab"] * 39 + ["b"])


def test_mapping_a_table(spark):
    df = spark.createDataFrame([(1, "Total awsets", "p", "c"), (2, "Total awsets", "p", "c"), (3, None, "p", "c"), (4, "Wall clock", "p", "c"), (5, "y" * 20000, None, "c"), (6, "Pledged shares", None, "c")], "fact_id long, key string, doc_group string, code string")
    ref = spark.createDataFrame(ITEMS, "code string, name string, scopes array<string>")

    def run(d, r):
        return {x.fact_id: x.code for x in map_values.mapped(d, "fact_id", F.col("key"), F.col("doc_group"), r).collect()}

    assert run(df, ref) == {1: "F1", 2: "F1", 3: "NONE", 4: "NONE", 5: "NONE", 6: "F3"}
    assert run(df.limit(0), ref) == {}
    assert set(run(df, ref.limit(0)).values()) == {"NONE"}


FACTS = "fact_id long, doc_id string, correction_group_id string, field_code string, filing_date string, value_text string, value_owner string, is_latest boolean"


def survivors(spark, rows, manifest=(("d_20240109000001", "20240109"), ("d_20240109000001", "20240109"))):
    facts = spark.createDataFrame(rows, FACTS)
    return {(r[0], r[1]): r[2] for r in survivor.latest_statements(facts, spark.createDataFrame(list(manifest), "doc_id string, rcept_dt string")).collect()}


def test_survivors(spark):
    rows = [
        (1, "d_20240101000001", "g", "A", "20240101", "5", None, True),
        (2, "d_20240105000001", "g", "A", "2024.1.5", "6", None, False),
        (3, "d_20240105000001", "g", "A", "2024년 1월 5일", "7", None, False),
        (4, "d_20240109000001", "g", "A", None, "해당 없음", None, True),
        (5, "d_20240109000001", "g", "B", None, "8", None, True),
        (6, "d_20240105000002", "g", "B", "2024-01-05", "9", None, True),
        (7, "d_20240105000002", "g", "C", "2024-01-05", "9", None, True),
        (8, "d_20240105000002", "g", "D", "2024-01-05", "-", None, True),
        (9, "d_20240105000002", "g", "D", "2024-01-05", None, None, True),
        (10, "d_20240105000003", "g", "E", "20240105", "1", "other", True),
        (11, "d_20240105000003", "g", "E", "20240105", "1", None, True),
        (12, "d_20240105000003", None, "E", "20240105", "1", None, True),
        (13, "d_20240105000003", None, "E", "20240105", "1", None, True),
        (14, "d_20240105000002", "h", "A", "20240105", "1", None, True),
        (15, "d_20240105000003", "h", "A", "20240105", "2", None, True),
        (16, "e_20230105000003", "h", "B", "soon", "2", None, True),
        (17, "e_20230105000002", "h", "B", None, "2", None, True),
    ]
    assert survivors(spark, rows) == {("g", "A"): 2, ("g", "B"): 5, ("h", "A"): 15, ("h", "B"): 16}
    assert survivors(spark, []) == {}


def test_trusted_sources_come_first(spark):
    schema = "fact_id long, doc_id string, correction_group_id string, field_code string, filing_date string, company string, period string, key string, value_text string, value_num double, value_unit string, value_date string, unit_code string, unit_value string, value_owner string, corp_code string, ll_trust int"
    row = lambda i, day, text, unit, code: (i, f"d_{day}000001", "g", "A", day, "c", None, "k", text, None, unit, None, None, None, None, code, 9)
    facts = spark.createDataFrame([row(1, "20240101", "5", None, "00"), row(2, "20240105", "6", "won", None), row(3, "20240103", "-", None, "00")], schema)
    manifest = spark.createDataFrame([], "doc_id string, rcept_dt string")
    latest, trusted = survivor.merged_records(facts, manifest).first(), survivor.merged_records(facts, manifest, F.col("corp_code").isNotNull()).first()
    assert (latest.value_text, latest.value_unit, latest.n_records) == ("6", "won", 3)
    assert (trusted.value_text, trusted.value_unit) == ("5", "won")
    assert survivor.merged_records(facts, manifest, F.lit(None)).first().value_text == "6"


def test_states(spark):
    said = ["5", "domestic", "중앙아시아 3개국", "-1"]
    not_ = [None, "", " ", "--", "–", "N/A", "(해당사항 없음)", "See attachment.", "기재 생략", "to be stated later"]
    d = spark.createDataFrame([(x,) for x in said + not_], "a string").select(survivor.states(F.col("a")))
    assert [r[0] for r in d.collect()] == [True] * len(said) + [False] * len(not_)
