"""Queries over the fact table and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import facts as ops
from ledgerloom.operators.facts import Lookup, RetrievalFilter
from ledgerloom.operators.ranking import ranks
from ledgerloom.queries.sql import DOCS, FACTS
from ledgerloom.session import table

ROW = ["fact_id", "company", "key_norm", "value_text", "value_num", "day", "period"]


def facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "facts")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue, one row per document, with its place in a correction chain."""
    m = table(spark, d, "manifest").groupBy("doc_id").agg(F.min_by(F.struct("corp_name", "doc_group", "doc_subtype", "report_nm", "is_correction", "rcept_dt", "base_year", "base_month"), "corp_name").alias("m"))
    c = table(spark, d, "corrections").select("doc_id", "correction_group_id", "correction_order", "is_latest")
    period = F.when(F.col("m.base_year").isNotNull() & F.col("m.base_month").isNotNull(), F.format_string("%04d-%02d", "m.base_year", "m.base_month"))
    return m.join(c, "doc_id", "left").select(
        F.col("doc_id").alias("report_id"), F.col("m.corp_name").alias("company"), "m.doc_group", "m.doc_subtype", "m.report_nm", "m.is_correction",
        F.col("m.rcept_dt").alias("day"), period.alias("period"), "correction_group_id", "correction_order", "is_latest",
    )


def existence_check(spark, d):
    m = table(spark, d, "manifest").dropDuplicates(["doc_id"])
    return ops.check_existence(m, F.col("flr_nm"), "report", "correction").where("company IS NOT NULL")


def existence_of_year(spark, d):
    m = table(spark, d, "manifest").dropDuplicates(["doc_id"])
    return ops.check_existence(m, F.col("stock_code"), "supply contract", "ended", "2024").where("company IS NOT NULL")


def _lookup(spec: Lookup, *more: str):
    return lambda spark, d: ops.lookup(facts(spark, d), spec).select(*ROW, *more)


def facts_multi_store(spark, d):
    f = facts(spark, d)
    stores = [f.where("doc_group = 'periodic'"), f.where("doc_group <> 'periodic'"), f.where("is_correction")]
    return ops.merge_stores(stores, Lookup(key="영업이익", order_by="value_desc", limit=200)).select(*ROW)


def facts_owner(which: str):
    return lambda spark, d: facts(spark, d).where(ops.owner_predicate(which)).select("fact_id", "company", "value_owner", "key_norm")


def facts_lookup_many(spark, d):
    """Every resolved company, expected field and period of every question, in one plan, each with its own tiers and limit."""
    q = table(spark, d, "query_plans").where("size(companies) > 0 AND size(expected_fields) > 0")
    specs = q.select("query_id", "expected_fields", "periods", F.posexplode(F.array_distinct("companies")).alias("c", "company"))
    specs = specs.select("query_id", "periods", "c", "company", F.posexplode(F.array_distinct("expected_fields")).alias("k", "field"))
    specs = specs.select("query_id", "c", "company", "k", "field", F.posexplode_outer(F.array_distinct("periods")).alias("p", "period"))
    one = F.concat_ws("#", "query_id", "c", "k", F.coalesce("p", F.lit(0)))
    rows = ops.lookup_many(facts(spark, d), specs.select(one.alias("query_id"), "company", F.regexp_replace("field", " ", "").alias("key"), "period"))
    return rows.select(F.regexp_replace("query_id", "(#[0-9]+){3}$", "").alias("query_id"), "fact_id", "tier", "rank")


FILTER = RetrievalFilter(doc_groups=("periodic", "exchange"), periods=("2024-06", "2025"), date_from="20240101", latest_only=True)
NARROW = RetrievalFilter(doc_groups=("holding",), doc_subtypes=("large_holding",), periods=("1999-01",), latest_only=True)


def filter_metadata(spark, d):
    return documents(spark, d).where(FILTER.to_column()).select("report_id", "company", "doc_group", "period", "day")


def filter_relax(spark, d):
    return ops.relax(documents(spark, d), NARROW).select("report_id", "tier")


def distinct_keys(spark, d):
    return ops.distinct_keys(facts(spark, d), doc_group="periodic")


def store_stats(spark, d):
    return ops.stats(facts(spark, d))


def single_valued_items(spark, d):
    """Items of a document with exactly one distinct value, and chains with two or more documents."""
    f = facts(spark, d).where("value_text IS NOT NULL")
    one = f.groupBy("doc_id", "key_norm").agg(F.count_distinct("value_text").alias("n"), F.min("value_text").alias("value_text")).where("n = 1").drop("n")
    many = f.where("correction_group_id IS NOT NULL").groupBy("correction_group_id").agg(F.count_distinct("doc_id").alias("n_docs")).where("n_docs >= 2")
    chain = f.select("doc_id", "correction_group_id").distinct().join(many, "correction_group_id")
    return one.join(chain, "doc_id").select("doc_id", "key_norm", "value_text", "correction_group_id", "n_docs")


def distinctive_values(spark, d):
    """Facts whose value stands for one key only in its document."""
    f = facts(spark, d).where("value_text IS NOT NULL AND key_norm IS NOT NULL")
    one = f.groupBy("doc_id", "value_text").agg(F.count_distinct("key_norm").alias("n")).where("n = 1").select("doc_id", "value_text")
    return f.join(one, ["doc_id", "value_text"], "left_semi").select("fact_id", "doc_id", "key_norm", "value_text")


def _ratios(spark, d):
    f = facts(spark, d).where("field_code IS NOT NULL")
    docs = f.groupBy("doc_group").agg(F.count_distinct("doc_id").alias("n_docs"))
    has = f.groupBy("doc_group", "field_code").agg(F.count_distinct("doc_id").alias("n_with"))
    return has.join(docs, "doc_group").withColumn("ratio", F.bround(F.col("n_with") / F.col("n_docs"), 6))


def field_schema_ratios(spark, d):
    """Share of a kind's documents that state an item; required from 0.75, conditional from 0.20, in kinds of ten documents or more."""
    kind = F.when((F.col("n_docs") >= 10) & (F.col("ratio") >= 0.75), "required").when(F.col("ratio") >= 0.20, "conditional").otherwise("optional")
    return _ratios(spark, d).withColumn("class", kind)


def ratio_max_gap(spark, d):
    w = Window.partitionBy("doc_group").orderBy(F.desc("ratio"), "field_code")
    gap = F.bround(F.lag("ratio").over(w) - F.col("ratio"), 6)
    g = _ratios(spark, d).withColumn("gap", gap).where("gap IS NOT NULL")
    return g.groupBy("doc_group").agg(F.max("gap").alias("max_gap"), F.max_by("field_code", F.struct("gap", "field_code")).alias("after"))


def mode_offset(spark, d):
    """Per filer the most frequent difference of filing year and base year, from five filings and 0.60 agreement on."""
    m = table(spark, d, "manifest").where("base_year IS NOT NULL AND corp_code IS NOT NULL")
    n = m.groupBy("corp_code", (F.substring("rcept_dt", 1, 4).cast("int") - F.col("base_year")).alias("offset")).agg(F.count("*").alias("n"))
    best = n.groupBy("corp_code").agg(F.max_by("offset", F.struct("n", -F.col("offset"))).alias("offset"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return best.where("total >= 5 AND n >= 0.6 * total")


def argmax_per_company(spark, d):
    """The fact of the largest value per company and item, newest and smallest id first on ties, with the count of rivals."""
    f = ops.with_day(facts(spark, d)).where("value_num IS NOT NULL AND field_code IS NOT NULL AND company IS NOT NULL")
    best = F.max(F.struct("value_num", F.coalesce("day", F.lit("")), -F.col("fact_id"))).alias("b")
    g = f.groupBy("company", "field_code").agg(best, F.count("*").alias("n_rivals"))
    return g.select("company", "field_code", (-F.col("b.col3")).alias("fact_id"), "b.value_num", "n_rivals")


def compare_pairs(spark, d):
    """All candidates of an item in pairs: the 1st with the 2nd, the 3rd with the 4th. """
    best = argmax_per_company(spark, d)
    r = ranks(best, ["field_code"], [F.desc("n_rivals"), F.col("company")], "rn")
    a, b = r.where("rn % 2 = 1"), r.where("rn % 2 = 0")
    pair = a.alias("a").join(b.alias("b"), (F.col("a.field_code") == F.col("b.field_code")) & (F.col("b.rn") == F.col("a.rn") + 1))
    winner = F.when(F.col("a.value_num") > F.col("b.value_num"), F.col("a.company")).when(F.col("b.value_num") > F.col("a.value_num"), F.col("b.company")).otherwise("tie")
    return pair.select(F.col("a.field_code").alias("field_code"), F.col("a.company").alias("company_a"), F.col("b.company").alias("company_b"), winner.alias("winner"))


def semi_known_keys(spark, d):
    """Expected fields of questions that the store holds."""
    q = table(spark, d, "query_plans").select("query_id", F.explode("expected_fields").alias("item"))
    known = facts(spark, d).select(F.col("key_norm").alias("k")).distinct()
    return q.join(known, F.regexp_replace("item", " ", "") == F.col("k"), "left_semi")


def anti_missing_items(spark, d):
    """Required items that a periodic filing doesn't state."""
    f = facts(spark, d).where("doc_group = 'periodic' AND field_code IS NOT NULL")
    # The required items are a fixed short list: one row, sent to every task.
    need = table(spark, d, "field_items").where("array_contains(doc_groups, 'periodic')").agg(F.collect_set("field_code").alias("need"))
    has = f.groupBy("doc_id").agg(F.collect_set("field_code").alias("has")).crossJoin(F.broadcast(need))
    return has.select("doc_id", F.size(F.array_except("need", "has")).cast("long").alias("n_missing")).where("n_missing > 0")


def assemble_by_report(spark, d):
    """Reranker rows, facts and corrections of a report side by side, in order of first appearance."""
    e = table(spark, d, "examples").where("report_id IS NOT NULL").groupBy("report_id").agg(F.count("*").alias("n_chunks"), F.min("example_id").alias("first_chunk"))
    f = facts(spark, d).groupBy(F.col("doc_id").alias("report_id")).agg(F.count("*").alias("n_facts"), F.min("fact_id").alias("first_fact"))
    c = table(spark, d, "corrections").select(F.col("doc_id").alias("report_id"), "correction_group_id")
    return e.join(f, "report_id", "full_outer").join(c, "report_id", "full_outer").select("report_id", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), F.coalesce("n_facts", F.lit(0)).cast("long").alias("n_facts"), "first_chunk", "first_fact", "correction_group_id")


def key_gates(spark, d):
    """How many facts pass or fail each gate on keys."""
    k = F.col("key")
    f = facts(spark, d).select(ops.is_meaningful_key(k).alias("meaningful"), ops.noise_reason(k, F.col("value_num"), F.col("value_date")).alias("noise"), ops.is_bad_key(k).alias("bad"), ops.is_parse_artifact(k).alias("artifact"))
    return f.groupBy("meaningful", "noise", "bad", "artifact").agg(F.count("*").alias("n"))


def rollup_by_group(spark, d):
    """Totals with one level of groups."""
    f = facts(spark, d)
    return f.rollup("doc_group").agg(F.count("*").alias("n"), F.count("value_num").alias("numeric")).select(F.coalesce("doc_group", F.lit("all")).alias("doc_group"), "n", "numeric")


BASE = Lookup(key="매출원가", limit=100)
QUERIES = {
    "existence_check": existence_check,
    "existence_of_year": existence_of_year,
    "facts_lookup_date": _lookup(BASE),
    "facts_lookup_value_desc": _lookup(Lookup(key="매출원가", numeric_only=True, order_by="value_desc", limit=100)),
    "facts_lookup_value_asc": _lookup(Lookup(key="매출원가", order_by="value_asc", limit=100)),
    "facts_value_range": _lookup(Lookup(min_value=1000, max_value=2000, date_from="20240101", date_to="20241231", limit=None)),
    "facts_corrections_only": _lookup(Lookup(doc_group="exchange", corrections_only=True, latest_only=False, value_owner="any", limit=None)),
    "facts_period_narrow_wide": _lookup(Lookup(key="재고자산", period="2024-06", limit=None), "tier"),
    "facts_period_year": _lookup(Lookup(key="재고자산", period="2024", limit=None), "tier"),
    "facts_exact_then_partial": _lookup(Lookup(key="ASSETS", limit=None), "tier"),
    "facts_multi_store": facts_multi_store,
    "facts_owner_self": facts_owner("self"),
    "facts_owner_other": facts_owner("other"),
    "facts_lookup_many": facts_lookup_many,
    "filter_metadata": filter_metadata,
    "filter_relax": filter_relax,
    "distinct_keys": distinct_keys,
    "store_stats": store_stats,
    "single_valued_items": single_valued_items,
    "distinctive_values": distinctive_values,
    "field_schema_ratios": field_schema_ratios,
    "ratio_max_gap": ratio_max_gap,
    "mode_offset": mode_offset,
    "argmax_per_company": argmax_per_company,
    "compare_pairs": compare_pairs,
    "semi_known_keys": semi_known_keys,
    "anti_missing_items": anti_missing_items,
    "assemble_by_report": assemble_by_report,
    "key_gates": key_gates,
    "rollup_by_group": rollup_by_group,
}

_COLS = "fact_id, company, key_norm, value_text, value_num, day, period"
_LATEST = "(is_latest IS NULL OR is_latest)"
_ORDER = {"date": "day DESC NULLS LAST, fact_id", "value_desc": "value_num DESC NULLS LAST, day DESC NULLS LAST, fact_id", "value_asc": "value_num ASC NULLS LAST, day DESC NULLS LAST, fact_id"}


def _tiers(where: str, tiers: list[str], cols: str = _COLS, order: str = "date", limit: int | None = None, source: str = "f") -> str:
    cases = " ".join(f"WHEN {t} THEN {i}" for i, t in enumerate(tiers))
    return f"""WITH {FACTS}, t AS (SELECT *, CASE {cases} END AS tier FROM {source} WHERE {where})
SELECT {cols} FROM t WHERE tier = (SELECT min(tier) FROM t) ORDER BY {_ORDER[order]}""" + (f" LIMIT {limit}" if limit else "")


def _key(k: str) -> list[str]:
    return [f"key_norm = '{k}'", f"key_norm = '{k}'", f"(lower(key_norm) LIKE '%{k.lower()}%' OR lower(key) LIKE '%{k.lower()}%')"]


_SELF = f"{_LATEST} AND NOT third"
_NONE = "coalesce(length(period) = 0, true)"
_P = {
    "narrow": f"(coalesce(period = '2024-06', false) OR ({_NONE} AND starts_with(day, '202406')))",
    "wide": f"(coalesce(period = '2024-06', false) OR ({_NONE} AND starts_with(day, '2024')))",
    "year": f"(coalesce(starts_with(period, '2024-'), false) OR ({_NONE} AND starts_with(day, '2024')))",
}
_I = _key("재고자산")
_NAME = "regexp_replace(lower(report_nm), '[\\sㆍ·・‧∙、,()\\[\\]{}<>「」『』\"''’‘“”．.\\-–—/]', '', 'g')"


def _exists(company: str, kind: str, event: str, where: str = "true") -> str:
    return f"""WITH m AS (SELECT DISTINCT ON (doc_id) *, {_NAME} AS name FROM manifest),
c AS (SELECT {company} AS company, count(*) FILTER (WHERE contains(name, '{kind}')) AS n_kind, count(*) FILTER (WHERE contains(name, '{kind}') AND contains(name, '{event}')) AS n_matched,
  count(*) FILTER (WHERE contains(name, '{kind}') AND contains(name, '{event}') AND is_correction) AS n_corrections FROM m WHERE {where} AND {company} IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN n_matched > 0 THEN 'exists' WHEN n_kind > 0 THEN 'absent' ELSE 'not_applicable' END AS verdict FROM c"""


_RATIOS = """r AS (SELECT doc_group, field_code, n_with, n_docs, round_even(n_with / n_docs, 6) AS ratio FROM
  (SELECT doc_group, field_code, count(DISTINCT doc_id) AS n_with FROM facts WHERE field_code IS NOT NULL GROUP BY ALL)
  JOIN (SELECT doc_group, count(DISTINCT doc_id) AS n_docs FROM facts WHERE field_code IS NOT NULL GROUP BY ALL) USING (doc_group))"""
_BEST = f"""best AS (SELECT company, field_code, fact_id, value_num, n_rivals FROM (SELECT *, row_number() OVER (PARTITION BY company, field_code ORDER BY value_num DESC, day DESC NULLS LAST, fact_id) AS rn, count(*) OVER (PARTITION BY company, field_code) AS n_rivals
  FROM f WHERE value_num IS NOT NULL AND field_code IS NOT NULL AND company IS NOT NULL) WHERE rn = 1)"""
_MEANINGFUL = r"(length(key) BETWEEN 2 AND 40 AND NOT regexp_matches(key, '^[0-9,.\-/()%\s]+$') AND length(regexp_replace(key, '[^가-힣A-Za-z0-9]', '', 'g')) >= 2 AND NOT regexp_matches(key, '" + ops.FORM_HEADER + "'))"
ORACLES = {
    "existence_check": _exists("flr_nm", "report", "correction"),
    "existence_of_year": _exists("stock_code", "supplycontract", "ended", "starts_with(rcept_dt, '2024')"),
    "facts_lookup_date": _tiers(_SELF, _key("매출원가"), limit=100),
    "facts_lookup_value_desc": _tiers(_SELF + " AND value_num IS NOT NULL", _key("매출원가"), order="value_desc", limit=100),
    "facts_lookup_value_asc": _tiers(_SELF, _key("매출원가"), order="value_asc", limit=100),
    "facts_value_range": f"WITH {FACTS} SELECT {_COLS} FROM f WHERE {_SELF} AND value_num BETWEEN 1000 AND 2000 AND day BETWEEN '20240101' AND '20241231'",
    "facts_corrections_only": f"WITH {FACTS} SELECT {_COLS} FROM f WHERE doc_group = 'exchange' AND is_correction",
    "facts_period_narrow_wide": _tiers(_SELF, [f"{_I[0]} AND {_P['narrow']}", f"{_I[0]} AND {_P['wide']}", f"{_I[2]} AND {_P['narrow']}", f"{_I[2]} AND {_P['wide']}"], _COLS + ", tier"),
    "facts_period_year": _tiers(_SELF, [f"{_I[0]} AND {_P['year']}", "false", f"{_I[2]} AND {_P['year']}"], _COLS + ", tier"),
    "facts_exact_then_partial": _tiers(_SELF, _key("ASSETS"), _COLS + ", tier"),
    "facts_multi_store": f"""WITH {FACTS}, s AS (SELECT *, 0 AS store FROM f WHERE doc_group = 'periodic' UNION ALL SELECT *, 1 FROM f WHERE doc_group <> 'periodic' UNION ALL SELECT *, 2 FROM f WHERE is_correction),
t AS (SELECT *, CASE WHEN key_norm = '영업이익' THEN 0 WHEN key_norm LIKE '%영업이익%' OR key LIKE '%영업이익%' THEN 2 END AS tier FROM s WHERE {_SELF}),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_id, key_norm, value_text ORDER BY store, fact_id) AS rn FROM t WHERE tier = (SELECT min(tier) FROM t))
SELECT {_COLS} FROM u WHERE rn = 1 ORDER BY {_ORDER["value_desc"]} LIMIT 200""",
    "facts_owner_self": f"WITH {FACTS} SELECT fact_id, company, value_owner, key_norm FROM f WHERE NOT third",
    "facts_owner_other": f"WITH {FACTS} SELECT fact_id, company, value_owner, key_norm FROM f WHERE third",
    "facts_lookup_many": f"""WITH {FACTS}, cs AS (SELECT query_id, periods, fs, unnest(list_distinct(companies)) AS c FROM (SELECT *, list_distinct(expected_fields) AS fs FROM query_plans WHERE len(companies) > 0 AND len(expected_fields) > 0)),
ks AS (SELECT query_id, periods, c, unnest(fs) AS field FROM cs),
q AS (SELECT query_id, query_id || '#' || c || '#' || field || '#' || coalesce(p, '') AS one, c, replace(field, ' ', '') AS k, p FROM (SELECT query_id, c, field, unnest(CASE WHEN len(periods) > 0 THEN list_distinct(periods) ELSE [NULL] END) AS p FROM ks)),
j AS (SELECT query_id, one, fact_id, day, key_norm = k AS exact, contains(lower(key_norm), lower(k)) OR contains(lower(key), lower(k)) AS partial,
  p IS NULL OR CASE WHEN length(p) = 4 THEN coalesce(starts_with(period, p || '-'), false) OR ({_NONE} AND starts_with(day, p)) ELSE coalesce(period = p, false) OR ({_NONE} AND starts_with(day, replace(p, '-', ''))) END AS narrow,
  p IS NULL OR CASE WHEN length(p) = 4 THEN coalesce(starts_with(period, p || '-'), false) OR ({_NONE} AND starts_with(day, p)) ELSE coalesce(period = p, false) OR ({_NONE} AND starts_with(day, substr(p, 1, 4))) END AS wide
  FROM f JOIN q ON f.company = q.c WHERE {_SELF}),
t AS (SELECT *, CASE WHEN exact AND narrow THEN 0 WHEN exact AND wide THEN 1 WHEN partial AND narrow THEN 2 WHEN partial AND wide THEN 3 END AS tier FROM j),
u AS (SELECT *, min(tier) OVER (PARTITION BY one) AS low FROM t WHERE tier IS NOT NULL),
v AS (SELECT *, row_number() OVER (PARTITION BY one ORDER BY day DESC NULLS LAST, fact_id) AS rank FROM u WHERE tier = low)
SELECT query_id, fact_id, tier::INTEGER AS tier, rank::INTEGER AS rank FROM v WHERE rank <= 10""",
    "filter_metadata": f"""WITH {DOCS} SELECT report_id, company, doc_group, period, day FROM docs WHERE doc_group IN ('periodic', 'exchange') AND day >= '20240101' AND is_latest IS DISTINCT FROM false
  AND CASE WHEN period IS NOT NULL THEN period IN ('2024-06', '2025') OR substr(period, 1, 4) IN ('2025') OR substr(day, 1, 4) = '2025' ELSE substr(day, 1, 4) IN ('2024', '2025') END""",
    "filter_relax": f"""WITH {DOCS}, t AS (SELECT report_id, CASE WHEN false THEN 0 WHEN doc_group = 'holding' AND doc_subtype = 'large_holding' AND is_latest IS DISTINCT FROM false THEN 1
  WHEN doc_group = 'holding' AND doc_subtype = 'large_holding' THEN 2 ELSE 3 END AS tier FROM docs) SELECT report_id, tier FROM t WHERE tier = (SELECT min(tier) FROM t)""",
    "distinct_keys": "SELECT key_norm, count(*) AS n FROM facts WHERE doc_group = 'periodic' GROUP BY 1 ORDER BY n DESC, key_norm LIMIT 100",
    "store_stats": "SELECT count(*) AS n_facts, count(value_num) AS n_numeric, count(value_date) AS n_dated, count(chunk_id) AS n_linked, count(DISTINCT company) AS n_companies, count(DISTINCT doc_id) AS n_docs, count(DISTINCT key_norm) AS n_keys FROM facts",
    "single_valued_items": """WITH one AS (SELECT doc_id, key_norm, min(value_text) AS value_text FROM facts WHERE value_text IS NOT NULL GROUP BY ALL HAVING count(DISTINCT value_text) = 1),
many AS (SELECT correction_group_id, count(DISTINCT doc_id) AS n_docs FROM facts WHERE value_text IS NOT NULL AND correction_group_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2),
chain AS (SELECT DISTINCT doc_id, correction_group_id FROM facts WHERE value_text IS NOT NULL)
SELECT doc_id, key_norm, value_text, correction_group_id, n_docs FROM one JOIN chain USING (doc_id) JOIN many USING (correction_group_id)""",
    "distinctive_values": """SELECT fact_id, doc_id, key_norm, value_text FROM facts JOIN (SELECT doc_id, value_text FROM facts WHERE value_text IS NOT NULL AND key_norm IS NOT NULL GROUP BY ALL HAVING count(DISTINCT key_norm) = 1) USING (doc_id, value_text) WHERE key_norm IS NOT NULL""",
    "field_schema_ratios": f"WITH {_RATIOS} SELECT *, CASE WHEN n_docs >= 10 AND ratio >= 0.75 THEN 'required' WHEN ratio >= 0.2 THEN 'conditional' ELSE 'optional' END AS class FROM r",
    "ratio_max_gap": f"WITH {_RATIOS}, g AS (SELECT *, round_even(lag(ratio) OVER (PARTITION BY doc_group ORDER BY ratio DESC, field_code) - ratio, 6) AS gap FROM r) SELECT doc_group, max(gap) AS max_gap, arg_max(field_code, (gap, field_code)) AS after FROM g WHERE gap IS NOT NULL GROUP BY 1",
    "mode_offset": """WITH n AS (SELECT corp_code, substr(rcept_dt, 1, 4)::INTEGER - base_year AS "offset", count(*) AS n FROM manifest WHERE base_year IS NOT NULL AND corp_code IS NOT NULL GROUP BY ALL)
SELECT corp_code, arg_max("offset", (n, -"offset")) AS "offset", max(n) AS n, sum(n)::BIGINT AS total FROM n GROUP BY 1 HAVING sum(n) >= 5 AND max(n) >= 0.6 * sum(n)""",
    "argmax_per_company": f"WITH {FACTS}, {_BEST} SELECT * FROM best",
    "compare_pairs": f"""WITH {FACTS}, {_BEST}, r AS (SELECT *, row_number() OVER (PARTITION BY field_code ORDER BY n_rivals DESC, company) AS rn FROM best)
SELECT a.field_code, a.company AS company_a, b.company AS company_b, CASE WHEN a.value_num > b.value_num THEN a.company WHEN b.value_num > a.value_num THEN b.company ELSE 'tie' END AS winner
FROM r a JOIN r b ON a.field_code = b.field_code AND b.rn = a.rn + 1 WHERE a.rn % 2 = 1""",
    "semi_known_keys": "SELECT query_id, item FROM (SELECT query_id, unnest(expected_fields) AS item FROM query_plans) WHERE replace(item, ' ', '') IN (SELECT key_norm FROM facts)",
    "anti_missing_items": """WITH d AS (SELECT DISTINCT doc_id FROM facts WHERE doc_group = 'periodic' AND field_code IS NOT NULL)
SELECT doc_id, count(*) AS n_missing FROM d CROSS JOIN (SELECT field_code FROM field_items WHERE list_contains(doc_groups, 'periodic')) i WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.doc_id = d.doc_id AND f.field_code = i.field_code AND f.doc_group = 'periodic') GROUP BY 1""",
    "assemble_by_report": """SELECT coalesce(e.report_id, f.report_id, c.report_id) AS report_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_facts, 0) AS n_facts, first_chunk, first_fact, correction_group_id
FROM (SELECT report_id, count(*) AS n_chunks, min(example_id) AS first_chunk FROM examples WHERE report_id IS NOT NULL GROUP BY 1) e
FULL JOIN (SELECT doc_id AS report_id, count(*) AS n_facts, min(fact_id) AS first_fact FROM facts GROUP BY 1) f ON e.report_id = f.report_id
FULL JOIN (SELECT doc_id AS report_id, correction_group_id FROM corrections) c ON coalesce(e.report_id, f.report_id) = c.report_id""",
    "key_gates": rf"""SELECT {_MEANINGFUL} AS meaningful,
  CASE WHEN regexp_matches(key, '^[0-9,.\-/()%\s]+$|^[△▲▽]\s*[+-]?[0-9,]+(?:\.[0-9]+)?\s*(?:원|천원|백만원|억원|조원|%|주)?$') THEN 'numeric_key' WHEN regexp_matches(regexp_replace(key, '\s+', '', 'g'), '{ops.TABLE_HEADER}') AND value_num IS NULL AND value_date IS NULL THEN 'header_without_value' END AS noise,
  (NOT {_MEANINGFUL}) OR regexp_matches(key, '[?!。]|다\.$') OR length(key) > 30 AS bad,
  length(key) > 60 OR regexp_matches(key, '[0-9]{{3}}') OR regexp_matches(key, '(?i)주식회사|\(주\)|㈜|\b(?:inc|ltd|corp|plc)\b') OR regexp_matches(key, '보고서$|(?i:report)$') AS artifact, count(*) AS n FROM facts GROUP BY ALL""",
    "rollup_by_group": "SELECT coalesce(doc_group, 'all') AS doc_group, count(*) AS n, count(value_num) AS numeric FROM facts GROUP BY ROLLUP (doc_group)",
}
