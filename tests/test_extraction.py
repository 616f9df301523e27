import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import derive, extraction, facts
from ledgerloom.session import drop_kept, keep
from ledgerloom.sources import markup, readers

PAGE = """<document><section-1><title>주주에 관한 사항</title>
<p>나. 최대주주의 기본정보(1) 법인 기본정보</p>
<table><tr><th>명 칭</th><th>출자자수</th><th>대표이사</th><th>지분율</th></tr><tr><td>(주)한별</td><td>74,702</td><td>A & B</td><td>5 < 6</td></tr></table>
<p>재무현황</p>
<table><tr><td>자산총계</td><td>1,000</td></tr><tr><td>부채총계</td><td>△400</td></tr></table>
<p>note</p>
<table><tr><td>임원 보수(백만원)</td><td>12</td></tr></table></section-1>
<section-1><title>계약</title>
<table><tr><td rowspan="2">계약내역</td><td>1. 계약금액(원)</td><te acode="F1">1조 2,345억원</te></tr><tr><td>매출액대비(%)</td><te>12.5%</te></tr></table>
<p>x</p>
<table><tr><td>자산총계</td><td>7</td></tr><tr><td>부채총계</td><td>8</td></tr><tr><td>귀중</td><td>금융위원회</td></tr><tr><td>비고</td><td>-</td></tr><tr><td>합계</td><td>없는 값</td></tr><tr><td>12-34</td><td>5</td></tr></table>
<p>y</p>
<table><tr><td>법인 또는 단체의 명칭</td><td>한별재단</td></tr><tr><td>계약일</td><td>2024년 1월 5일</td></tr></table></section-1></document>"""
CATALOGUE = "doc_id string, corp_name string, corp_code string, doc_group string, doc_subtype string, report_nm string, rcept_dt string, base_year int, base_month int, is_correction boolean, is_latest boolean, correction_group_id string"


def rows(spark, group, name="갑"):
    nodes = markup.parsed(spark.createDataFrame([("d1", PAGE), ("d2", None), ("d3", "")], "doc_id string, text string"))
    cat = spark.createDataFrame([("d1", name, "00", group, None, "r", "20240301", 2023, 12, False, True, None)], CATALOGUE)
    return {(r.key_norm, r.value_text): r for r in extraction.extracted(nodes, cat).collect()}


def test_facts_of_a_page(spark):
    got = rows(spark, "periodic")
    assert set(k for k, _ in got) == {"자산총계", "부채총계", "임원보수", "계약금액", "매출액대비", "법인또는단체의명칭", "계약일"}
    # The holder named in the regular table owns the unnamed statement behind it, within its section only.
    assert got["자산총계", "1,000"].value_owner == "(주)한별" and got["부채총계", "△400"].value_num == -400
    assert got["임원보수", "12"].value_owner is None and got["임원보수", "12"].value_unit == "백만원"
    assert got["자산총계", "7"].value_owner is None
    amount = got["계약금액", "1조 2,345억원"]
    assert (amount.value_num, amount.value_unit, amount.field_code, amount.group_label, amount.period) == (1.2345e12, "원", "F1", "계약내역", "2023-12")
    assert got["매출액대비", "12.5%"].value_unit == "%"
    assert got["계약일", "2024년 1월 5일"].value_date == "20240105" and got["계약일", "2024년 1월 5일"].value_owner == "한별재단"
    assert rows(spark, "major", "한별재단")["계약일", "2024년 1월 5일"].value_owner is None
    # Headers without a value are noise in periodic reports only.
    assert ("합계", "없는 값") in rows(spark, "major")


def test_chunks_and_owners_of_facts(spark):
    f = spark.createDataFrame(
        [(1, "d", 0, 0, "c1", "갑", "을", "자산총계", "5", ["주주에 관한 사항"]), (2, "d", 0, 1, "c1", "갑", None, "매출액", "6", ["주주에 관한 사항"]), (3, "d", 0, 2, "c2", "갑", None, "매출액", "6", ["주주에 관한 사항"]), (4, "d", 0, 3, "c2", "갑", None, "매출액", "7", None), (5, "d", 0, 4, None, None, None, None, "7", None)],
        "fact_id long, doc_id string, seq int, pos int, chunk_id string, company string, value_owner string, key string, value_text string, section_path array<string>",
    )
    got = {r.fact_id: (r.value_owner, r.value_owner_is_company) for r in extraction.owners_stated(f).collect()}
    assert got == {1: ("을", False), 2: ("을", False), 3: ("최대주주", False), 4: ("갑", True), 5: (None, True)}
    chunks = spark.createDataFrame([("x2", "d", "매출액 6"), ("x1", "d", "매출액 6 7"), ("x3", "e", "자산총계 5")], "chunk_id string, report_id string, text string")
    assert {r.fact_id: r.chunk_id for r in extraction.with_chunks(f, chunks).collect()} == {1: None, 2: "x1", 3: "x1", 4: "x1", 5: None}


def test_damaged_markup_reads_like_sound_markup():
    damaged = '<table><tr><td title="a "b" c">R&D < 5</td><te acode="X">1 & 2</te></tr></table><p>A&amp;B &lt; C <기타> d</p>'
    sound = '<table><tr><td title="x">R&amp;D &lt; 5</td><te acode="X">1 &amp; 2</te></tr></table><p>A&amp;B &lt; C &lt;기타> d</p>'
    flat = lambda t: [(n.kind, n.text, [(k, c.text, c.code) for k, c in n.pairs]) for n in markup.parse(t)]
    assert flat(damaged) == flat(sound) and flat(sound)[0][2] == [("R&D < 5", "1 & 2", "X")]
    assert markup.sanitise(sound)[0] == sound
    assert markup.sanitise(damaged)[1] == markup.Repairs(bare_amp=2, bare_lt=2, broken_attr=1)


@pytest.mark.parametrize(("encoding", "good"), [("UTF-8", "값 1".encode()), ("cp949", "값 1".encode("cp949"))])
def test_bad_bytes_are_replaced(spark, tmp_path, encoding, good):
    (tmp_path / "a.xml").write_bytes(good)
    (tmp_path / "b.xml").write_bytes(b"ab\xff\xfec")
    got = sorted(r.text for r in readers.read_files(spark, str(tmp_path), encoding).collect())
    assert got[1] == "값 1" and got[0].startswith("ab") and got[0].endswith("c") and "�" in got[0]


def test_large_pools_are_searched_whole(spark):
    r = np.random.default_rng(3)
    checks = []
    for i in range(40):
        pool = np.round(r.uniform(-1e6, 1e6, 260), 1)
        pool[5] = 0.0
        a, b = pool[7], pool[250]
        target = [a - b, a + b, round(a / b * 100, 2), round((a - b) / abs(b) * 100, 2), 0.12345][i % 5]
        checks.append((i, float(target), 1 if i % 5 < 2 else 2, i % 5 in (2, 3), [float(x) for x in pool]))
    df = spark.createDataFrame(checks, "id int, target double, places int, percent boolean, pool array<double>")
    got = {r.id: r.derived for r in derive.derivable(df).collect()}
    plain = {}
    for i, t, places, percent, pool in checks:
        tol = 0.5 * 10.0**-places + abs(t) * 1e-9
        ok = (lambda a, b: b != 0 and (abs(a / b * 100 - t) <= tol or abs((a - b) / abs(b) * 100 - t) <= tol)) if percent else (lambda a, b: abs(a - b - t) <= tol or abs(a + b - t) <= tol)
        plain[i] = any(a != b and ok(a, b) for a in pool for b in pool)
    assert got == plain and {got[i] for i in range(40) if i % 5 < 4} == {True}
    text = " ".join(str(1000 + 3 * i) + ".5" for i in range(500))
    assert spark.createDataFrame([(text,)], "t string").select(F.size(derive.figures(F.col("t")))).first()[0] == 500


def test_keys_named_like_companies(spark):
    f = spark.createDataFrame([("(주)한별",), ("한별",), ("매출액",), (None,)], "key string")
    names = spark.createDataFrame([("한별 주식회사",), (None,), ("(주)",)], "name string")
    assert {r.key for r in facts.company_keys(f, names).collect()} == {"(주)한별", "한별"}


def test_kept_tables_are_this_session_s_own(spark):
    from pathlib import Path

    df = keep(spark.range(3), "t")
    assert df.count() == 3
    own = Path(df.inputFiles()[0].removeprefix("file://").removeprefix("file:")).parent.parent
    other = own.parent / "another"
    other.mkdir(exist_ok=True)
    drop_kept(spark)
    assert other.exists() and not own.exists()
    other.rmdir()
