"""Queries of derived arithmetic, scalar functions and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import dates, numbers
from ledgerloom.functions.text import normalise_key
from ledgerloom.operators import derive, evaluate
from ledgerloom.operators.facts import with_day
from ledgerloom.queries.sql import FACTS, day
from ledgerloom.session import table


def _rows(spark, d):
    """Own numeric facts with a unit field, as subjects of calculations."""
    f = with_day(table(spark, d, "facts")).where("value_num IS NOT NULL AND value_owner IS NULL AND field_code IS NOT NULL AND corp_code IS NOT NULL")
    return f.select(F.col("field_code").alias("item"), F.coalesce("value_unit", F.lit("")).alias("unit"), derive.statement_kind(F.col("section_path")).alias("kind"), F.col("corp_code").alias("company"), F.coalesce("period", F.lit("")).alias("period"), "day", "doc_id", F.col("value_num").alias("value"))


def group_sum_avg_spread(spark, d):
    g = derive.derive(_rows(spark, d))
    return g.withColumn("total", F.col("total").cast("string")).drop("mean")


def growth_cagr(spark, d):
    return derive.series(_rows(spark, d))


def item_ratio(spark, d):
    return derive.item_ratio(_rows(spark, d), "F290", "F283")


def compare_winner(spark, d):
    return derive.winners(_rows(spark, d).select("item", "company", "value", "unit"))


def winner_in_won(spark, d):
    """The company with the largest amount of every item, among amounts recorded in any unit of won."""
    rows = _rows(spark, d).where(numbers.won_unit(F.col("unit")) != "")
    return derive.winners(rows.select("item", "company", "value", "unit"))


def derive_pairs_check(spark, d):
    """Which figures of a filing are the sum or difference of two others of it, or another one at another scale."""
    f = table(spark, d, "facts").where("value_num IS NOT NULL AND value_num <> 0").select("doc_id", "fact_id", "value_num")
    # A pool is bounded by the facts of one filing.
    pool = f.groupBy("doc_id").agg(F.array_sort(F.collect_set("value_num")).alias("all"))
    c = f.join(pool, "doc_id").select("fact_id", F.col("value_num").alias("target"), F.lit(2).alias("places"), F.lit(False).alias("percent"), F.array_except("all", F.array("value_num")).alias("pool"))
    return derive.rescaled(derive.derivable(c)).select("fact_id", "derived", "power").where("derived OR power IS NOT NULL")


def carry_forward_owner(spark, d):
    """Owners carried on within runs of one section of a document, in order of fact ids."""
    n = table(spark, d, "facts").select("doc_id", F.array_join("section_path", " > ").alias("section"), F.col("fact_id").alias("seq"), F.col("value_owner").alias("owner"), F.when(F.col("value_num").isNotNull(), 2).otherwise(0).alias("n_markers"))
    return derive.carry_owner(n).select("doc_id", "seq", "run", "carried")


def parse_values(spark, d):
    v = numbers.parse_value(F.col("value_text"), F.col("unit_value"))
    return table(spark, d, "facts").select("fact_id", v.alias("v")).select("fact_id", "v.num", "v.unit", "v.date")


def won_readings(spark, d):
    """Amounts in won and how they read, for facts with a Korean unit field."""
    f = table(spark, d, "facts").where("value_num IS NOT NULL AND value_unit IS NOT NULL")
    won = numbers.to_won(F.col("value_num"), F.col("value_unit"))
    return f.select("fact_id", numbers.won_unit(F.col("value_unit")).alias("unit"), won.alias("won")).where("won IS NOT NULL AND abs(won) < 1e15").withColumn("reading", numbers.read_out_won(F.col("won")))


def normalised_keys(spark, d):
    f = table(spark, d, "facts").where("key IS NOT NULL").select("key").distinct()
    return f.select("key", normalise_key(F.col("key")).alias("norm"))


def name_keys(spark, d):
    m = table(spark, d, "manifest").select("corp_name", "report_nm").distinct()
    return m.select("corp_name", "report_nm", numbers.name_key(F.col("corp_name")).alias("name"), numbers.symbol_key(F.col("report_nm")).alias("report"), numbers.has_final_consonant(F.col("corp_name")).alias("final"))


def months_days(spark, d):
    """Days and complete months from every filing to the question's first period end and between filings of a chain."""
    c = table(spark, d, "corrections").where("correction_group_id IS NOT NULL")
    a = F.substring(F.regexp_extract("correction_group_id", "_([0-9]+)$", 1), 1, 8)
    b = F.substring(F.regexp_extract("doc_id", "_([0-9]+)$", 1), 1, 8)
    return c.select("doc_id", a.alias("a"), b.alias("b"), dates.days_between(a, b).alias("days"), dates.full_months_between(a, b).cast("int").alias("months"))


def wanted_operations(spark, d):
    q = table(spark, d, "query_plans")
    return q.select("query_id", F.array_join(derive.wanted_column(F.col("query")), ",").alias("operations"))


def same_ratios(spark, d):
    f = table(spark, d, "facts").where("unit_code IN ('PCT', 'RATIO') AND value_num IS NOT NULL AND correction_group_id IS NOT NULL")
    a = f.select("correction_group_id", "field_code", F.col("fact_id").alias("a"), F.col("value_num").alias("x"))
    b = f.select("correction_group_id", "field_code", F.col("fact_id").alias("b"), F.col("value_num").alias("y"))
    return a.join(b, ["correction_group_id", "field_code"]).where("a < b").where(numbers.same_ratio(F.col("x"), F.col("y"))).select("a", "b")


def run_summary(spark, d):
    """Reranker rows as runs: text length as seconds, label as correctness."""
    e = table(spark, d, "examples").select(F.coalesce("neg_type", F.lit("gold")).alias("doc_group"), F.when(F.col("label") == 1, "correct").otherwise("wrong").alias("label"), (F.length("text") / 1000.0).alias("seconds"), F.col("query_id").isNotNull().alias("gradeable"))
    return evaluate.run_summary(e)


def length_quantiles(spark, d):
    t = table(spark, d, "documents").select(F.length("text").cast("long").alias("len"))
    return evaluate.distributed_quantiles(t, "len", [0.0, 0.25, 0.5, 0.9, 0.99])


def stratified_sample(spark, d):
    t = table(spark, d, "documents").where("source IS NOT NULL").select("doc_id", "source")
    return evaluate.stratified_sample(t, "source", "doc_id", 100).select("doc_id", "source")


def hard_negative_types(spark, d):
    e = table(spark, d, "examples").where("query_id IS NOT NULL")
    gold = e.where("label = 1").groupBy("query_id").agg(F.min_by(F.struct("company", "period", "report_id"), "example_id").alias("g"))
    n = e.where("label = 0").join(gold, "query_id").select("query_id", F.col("example_id").alias("id"), "company", "period", "report_id", F.col("g.company").alias("gold_company"), F.col("g.period").alias("gold_period"), F.col("g.report_id").alias("gold_report"))
    typed = n.withColumn("type", evaluate.hard_negative_type(n))
    return evaluate.hard_negatives(typed.select("query_id", "id", "type"), per_type=3, easy=2).withColumn("split", evaluate.hash_split(F.col("query_id")))


def abstention_score(spark, d):
    """Answer modes as actions: unknown ones abstain; the scope is the reason; what should be done follows the scope."""
    q = table(spark, d, "query_plans")
    gold = q.select(F.col("query_id").alias("id"), F.col("task").alias("reason"), F.when(F.col("scope") == "in_scope", "answer").otherwise("abstain").alias("expected_action"))
    pred = q.where("answer_mode <> 'closed'").select(F.col("query_id").alias("id"), F.when(F.col("answer_mode") == "unknown", "refuse").otherwise("answer").alias("action"))
    return evaluate.abstention_score(gold, pred)


def attribution_score(spark, d):
    q = table(spark, d, "query_plans").where("size(company_mentions) > 0")
    cited = table(spark, d, "examples").where("label = 1 AND company IS NOT NULL").groupBy("query_id").agg(F.collect_set("company").alias("companies"))
    return evaluate.attribution(q.select("query_id", F.col("company_mentions").alias("companies")), cited)


def router_confusion(spark, d):
    q = table(spark, d, "query_plans")
    return evaluate.confusion(q.select(F.coalesce("task", F.lit("none")).alias("task"), F.coalesce("answer_mode", F.lit("none")).alias("mode")), "task", "mode", ["closed", "mixed", "open", "unknown"])


def label_f1(spark, d):
    return evaluate.f1_by_label(table(spark, d, "query_plans").where("scope IS NOT NULL AND answer_mode IS NOT NULL"), "scope", "answer_mode")


QUERIES = {f.__name__: f for f in (group_sum_avg_spread, growth_cagr, item_ratio, compare_winner, winner_in_won, derive_pairs_check, carry_forward_owner, parse_values, won_readings, normalised_keys, name_keys, months_days, wanted_operations, same_ratios, run_summary, length_quantiles, stratified_sample, hard_negative_types, abstention_score, attribution_score, router_confusion, label_f1)}

_ROWS = f"""{FACTS}, r AS (SELECT field_code AS item, coalesce(value_unit, '') AS unit,
  CASE WHEN regexp_matches(lower(regexp_replace(array_to_string(section_path, ''), '\\s+', '', 'g')), '연결|consolidated') THEN 'consolidated' WHEN regexp_matches(lower(regexp_replace(array_to_string(section_path, ''), '\\s+', '', 'g')), '별도|개별|separate') THEN 'separate' ELSE '' END AS kind,
  corp_code AS company, coalesce(period, '') AS period, day, doc_id, value_num AS value FROM f WHERE value_num IS NOT NULL AND value_owner IS NULL AND field_code IS NOT NULL AND corp_code IS NOT NULL)"""
_ONE = """n AS (SELECT *, max(day) OVER (PARTITION BY item, unit, kind, company, period) AS new FROM r),
o AS (SELECT item, unit, kind, company, period, count(DISTINCT value) AS n, max(value) AS value, min(doc_id) AS doc_id FROM n WHERE day = new GROUP BY ALL),
one AS (SELECT * FROM o WHERE (item, unit, kind) NOT IN (SELECT (item, unit, kind) FROM o WHERE n > 1))"""
_WON = " ".join(f"WHEN contains(u, '{n}') THEN '{n}'" for n, _ in numbers.WON_UNITS)
_FACTOR = " ".join(f"WHEN '{n}' THEN {f!r}::DOUBLE" for n, f in numbers.WON_UNITS)
_NUMBER = "[0-9][0-9,]*(?:\\.[0-9]+)?"
_ONE_SCALE = " ".join(f"WHEN regexp_matches(b, '^-?{_NUMBER}\\s*{n}\\s*원?$') THEN try_cast(replace(regexp_extract(b, '^-?[0-9][0-9,.]*'), ',', '') AS DOUBLE) * {f!r}::DOUBLE" for n, f in numbers.SCALES)
_VALID = "CASE WHEN try_strptime({0}, '%Y%m%d') IS NOT NULL THEN {0} END"
_OPS = ", ".join(f"CASE WHEN regexp_matches(q, '{'|'.join(w)}') THEN '{op}' END" for op, w in derive.OPERATIONS.items())
_MASK = "query"
for _p in derive.MASKED:
    _MASK = f"replace({_MASK}, '{_p}', ' ')"
#: White space of Unicode, as a class.
_SPACE = "[ \\t-\\r\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
ORACLES = {
    "group_sum_avg_spread": f"WITH {_ROWS}, {_ONE} SELECT item, unit, kind, count(*) AS n_subjects, count(DISTINCT doc_id) AS n_docs, sum(value::VARCHAR::DECIMAL(28, 9))::VARCHAR AS total, max(value) - min(value) AS spread FROM one GROUP BY ALL HAVING count(*) >= 2",
    "growth_cagr": f"""WITH {_ROWS}, e AS (SELECT company, item, unit, kind, min(day) AS d0, max(day) AS d1 FROM r GROUP BY ALL HAVING min(day) < max(day)),
b AS (SELECT company, item, unit, kind, d0, d1, list(DISTINCT value) FILTER (WHERE day = d0) AS a, list(DISTINCT value) FILTER (WHERE day = d1) AS b FROM r JOIN e USING (company, item, unit, kind) GROUP BY ALL),
v AS (SELECT *, a[1] AS first, b[1] AS last, d1[:4]::INTEGER - d0[:4]::INTEGER AS y FROM b WHERE len(a) = 1 AND len(b) = 1)
SELECT company, item, unit, kind, d0, d1, first, last, CASE WHEN first <> 0 THEN round_even((last - first) / abs(first) * 100, 4) END AS growth, CASE WHEN first > 0 AND last > 0 AND y > 0 THEN round_even((pow(last / first, 1.0::DOUBLE / y) - 1) * 100, 4) END AS cagr FROM v""",
    "item_ratio": f"WITH {_ROWS}, {_ONE} SELECT a.company, a.period, a.unit, a.kind, a.value AS part, b.value AS whole, CASE WHEN b.value <> 0 THEN round_even(a.value / b.value * 100, 4) END AS percent FROM one a JOIN one b ON a.item = 'F290' AND b.item = 'F283' AND a.company = b.company AND a.period = b.period AND a.unit = b.unit AND a.kind = b.kind",
    "compare_winner": f"""WITH {_ROWS}, w AS (SELECT *, CASE {_WON} ELSE '' END AS wu FROM (SELECT *, regexp_replace(unit, '\\s', '', 'g') AS u FROM r)),
g AS (SELECT item, count(DISTINCT unit) AS n, bool_and(wu <> '') AS allwon FROM w GROUP BY 1),
b AS (SELECT item, company, max(CASE WHEN n > 1 THEN value * CASE wu {_FACTOR} END ELSE value END) AS v FROM w JOIN g USING (item) WHERE n = 1 OR allwon GROUP BY ALL),
k AS (SELECT *, dense_rank() OVER (PARTITION BY item ORDER BY v DESC) AS rk, row_number() OVER (PARTITION BY item ORDER BY v DESC, company) AS rn, count(*) OVER (PARTITION BY item) AS n FROM b)
SELECT item, arg_min(company, rn) AS winner, max(v) AS best, max(v) - max(CASE WHEN rk = 2 THEN v END) AS gap, count(*) FILTER (WHERE rk = 1) AS n_tied FROM k WHERE n >= 2 GROUP BY 1""",
    "winner_in_won": f"""WITH {_ROWS}, w AS (SELECT *, CASE {_WON} ELSE '' END AS wu FROM (SELECT *, regexp_replace(unit, '\\s', '', 'g') AS u FROM r)),
g AS (SELECT item, count(DISTINCT unit) AS n FROM w WHERE wu <> '' GROUP BY 1),
b AS (SELECT item, company, max(CASE WHEN n > 1 THEN value * CASE wu {_FACTOR} END ELSE value END) AS v FROM w JOIN g USING (item) WHERE wu <> '' GROUP BY ALL),
k AS (SELECT *, dense_rank() OVER (PARTITION BY item ORDER BY v DESC) AS rk, row_number() OVER (PARTITION BY item ORDER BY v DESC, company) AS rn, count(*) OVER (PARTITION BY item) AS n FROM b)
SELECT item, arg_min(company, rn) AS winner, max(v) AS best, max(v) - max(CASE WHEN rk = 2 THEN v END) AS gap, count(*) FILTER (WHERE rk = 1) AS n_tied FROM k WHERE n >= 2 GROUP BY 1""",
    "name_keys": """SELECT DISTINCT corp_name, report_nm, regexp_replace(regexp_replace(lower(corp_name), '\\(주\\)|㈜|주식회사|유한회사|\\b(?:co|ltd|inc|corp|corporation|company|limited|plc)\\b\\.?', '', 'g'), '[\\s()\\[\\]{}.,·&''"-]', '', 'g') AS name,
  regexp_replace(report_nm, '[\\sㆍ·・‧∙、,()\\[\\]{}<>「」『』"''’‘“”．.\\-–—/]', '', 'g') AS report, unicode(corp_name[-1:]) BETWEEN 44032 AND 55203 AND (unicode(corp_name[-1:]) - 44032) % 28 > 0 AS final FROM manifest""",
    "derive_pairs_check": """WITH f AS (SELECT doc_id, fact_id, value_num AS t FROM facts WHERE value_num IS NOT NULL AND value_num <> 0), v AS (SELECT DISTINCT doc_id, t AS x FROM f),
s AS (SELECT DISTINCT fact_id FROM f JOIN v a ON f.doc_id = a.doc_id AND a.x <> f.t JOIN v b ON f.doc_id = b.doc_id AND b.x <> f.t AND a.x <> b.x WHERE abs(a.x - b.x - t) <= 0.005 + abs(t) * 1e-9 OR abs(a.x + b.x - t) <= 0.005 + abs(t) * 1e-9),
e AS (SELECT fact_id, min(e)::INTEGER AS power FROM f JOIN v a ON f.doc_id = a.doc_id AND a.x <> f.t, (SELECT unnest(range(-12, 13)) AS e) WHERE e <> 0 AND abs(x * pow(10.0, e) - t) <= abs(t) * 1e-6 GROUP BY 1)
SELECT coalesce(s.fact_id, e.fact_id) AS fact_id, s.fact_id IS NOT NULL AS derived, power FROM s FULL JOIN e ON s.fact_id = e.fact_id""",
    "carry_forward_owner": """WITH n AS (SELECT doc_id, array_to_string(section_path, ' > ') AS section, fact_id AS seq, value_owner AS owner, CASE WHEN value_num IS NOT NULL THEN 2 ELSE 0 END AS m FROM facts),
s AS (SELECT *, CASE WHEN lag(section) OVER (PARTITION BY doc_id ORDER BY seq) IS NOT DISTINCT FROM section THEN 0 ELSE 1 END AS start FROM n),
r AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY seq)::BIGINT AS run FROM s)
SELECT doc_id, seq, run, coalesce(owner, CASE WHEN m >= 2 THEN last_value(owner IGNORE NULLS) OVER (PARTITION BY doc_id, run ORDER BY seq) END) AS carried FROM r""",
    "parse_values": f"""WITH a AS (SELECT fact_id, trim(value_text) AS s, unit_value FROM facts),
b AS (SELECT *, s IS NULL OR s IN ({", ".join(f"'{v}'" for v in numbers.EMPTY_VALUES)}) AS empty, coalesce({_VALID.format("(CASE WHEN regexp_matches(unit_value, '^[0-9]{8}$') THEN unit_value END)")}, {_VALID.format(f"({day('s')})")}) AS date,
  trim(regexp_replace(regexp_replace(s, '^[△▲▽▼]\\s*', ''), '^\\(\\s*([0-9][0-9,.]*)\\s*\\)$', '\\1')) AS b FROM a),
c AS (SELECT *, replace(regexp_replace(b, '\\s+', '', 'g'), ',', '') AS x FROM b),
d AS (SELECT *, CASE WHEN regexp_matches(x, '^-?(?:[0-9]+(?:\\.[0-9]+)?[조억만천]){{2,}}(?:[0-9]+(?:\\.[0-9]+)?)?원?$|^-?[0-9]+(?:\\.[0-9]+)?[조억만천][0-9]+(?:\\.[0-9]+)?원?$') THEN
    CASE WHEN starts_with(x, '-') THEN -1 ELSE 1 END * list_sum(list_transform(regexp_extract_all(x, '[0-9]+(?:\\.[0-9]+)?[조억만천]?'), lambda p: regexp_extract(p, '[0-9.]+')::DOUBLE * CASE WHEN contains(p, '조') THEN 1e12 WHEN contains(p, '억') THEN 1e8 WHEN contains(p, '만') THEN 1e4 WHEN contains(p, '천') THEN 1e3 ELSE 1 END)) END AS compound,
  CASE WHEN regexp_matches(b, '^-?{_NUMBER}$') THEN try_cast(replace(b, ',', '') AS DOUBLE) END AS number, CASE {_ONE_SCALE} END AS one, regexp_extract(b, '^-?{_NUMBER}\\s*(%p|%|원|주)$', 1) AS suffix FROM c),
e AS (SELECT *, coalesce(compound, number, one, CASE WHEN suffix <> '' THEN try_cast(replace(regexp_extract(b, '^-?{_NUMBER}'), ',', '') AS DOUBLE) END) AS plain FROM d)
SELECT fact_id, CASE WHEN empty OR date IS NOT NULL THEN NULL WHEN regexp_matches(s, '^[△▲▽▼]|^\\(\\s*[0-9][0-9,.]*\\s*\\)$') THEN -abs(plain) ELSE plain END AS num,
  CASE WHEN empty OR date IS NOT NULL THEN NULL WHEN compound IS NOT NULL OR one IS NOT NULL THEN '원' WHEN number IS NULL AND suffix <> '' THEN suffix END AS unit, CASE WHEN NOT empty THEN date END AS date FROM e""",
    "won_readings": f"""WITH u AS (SELECT fact_id, value_num, regexp_replace(value_unit, '\\s', '', 'g') AS u FROM facts WHERE value_num IS NOT NULL AND value_unit IS NOT NULL), w AS (SELECT *, CASE {_WON} ELSE '' END AS unit FROM u),
x AS (SELECT fact_id, unit, value_num * CASE unit {_FACTOR} END AS won FROM w), y AS (SELECT *, abs(round_even(won, 0))::BIGINT AS n FROM x WHERE won IS NOT NULL AND abs(won) < 1e15),
t AS (SELECT *, list_filter([CASE WHEN n // 1000000000000 > 0 THEN format('{{:,}}', n // 1000000000000) || '조' END, CASE WHEN n // 100000000 % 10000 > 0 THEN format('{{:,}}', n // 100000000 % 10000) || '억' END, CASE WHEN n // 10000 % 10000 > 0 THEN format('{{:,}}', n // 10000 % 10000) || '만' END, CASE WHEN n % 10000 > 0 THEN format('{{:,}}', n % 10000) END], lambda p: p IS NOT NULL)[1:2] AS terms FROM y)
SELECT fact_id, unit, won, CASE WHEN n = 0 THEN '0원' ELSE CASE WHEN won < 0 THEN '-' ELSE '' END || array_to_string(terms, ' ') || '원' END AS reading FROM t""",
    "normalised_keys": """SELECT key, regexp_replace(regexp_replace(regexp_replace(regexp_replace(key, '^~*(?:[※\\-•·○▶■]~*|\\(?[0-9]{1,2}[.)]~*|[가-하][.)]~*)+', ''), '~*\\([^()]*\\)~*$', ''), '[:：]~*$', ''), '~+', '', 'g') AS norm FROM (SELECT DISTINCT key FROM facts WHERE key IS NOT NULL)""".replace("~", _SPACE),
    "months_days": """WITH c AS (SELECT doc_id, substr(regexp_extract(correction_group_id, '_([0-9]+)$', 1), 1, 8) AS a, substr(regexp_extract(doc_id, '_([0-9]+)$', 1), 1, 8) AS b FROM corrections WHERE correction_group_id IS NOT NULL),
d AS (SELECT *, strptime(a, '%Y%m%d')::DATE AS x, strptime(b, '%Y%m%d')::DATE AS y FROM c)
SELECT doc_id, a, b, (y - x)::INTEGER AS days, ((year(y) - year(x)) * 12 + month(y) - month(x) - CASE WHEN day(y) < day(x) THEN 1 ELSE 0 END)::INTEGER AS months FROM d""",
    "wanted_operations": f"SELECT query_id, concat_ws(',', {_OPS}) AS operations FROM (SELECT query_id, {_MASK} AS q FROM query_plans)",
    "same_ratios": """WITH f AS (SELECT correction_group_id AS g, field_code AS c, fact_id, value_num AS v FROM facts WHERE unit_code IN ('PCT', 'RATIO') AND value_num IS NOT NULL AND correction_group_id IS NOT NULL AND field_code IS NOT NULL)
SELECT p.fact_id AS a, q.fact_id AS b FROM f p JOIN f q USING (g, c) WHERE p.fact_id < q.fact_id AND (abs(p.v - q.v) <= greatest(abs(p.v), abs(q.v)) * 1e-6 + 1e-12
  OR (abs(p.v) < 1 AND abs(p.v * 100 - q.v) <= greatest(abs(p.v * 100), abs(q.v)) * 1e-6 + 1e-12) OR (abs(q.v) < 1 AND abs(q.v * 100 - p.v) <= greatest(abs(q.v * 100), abs(p.v)) * 1e-6 + 1e-12))""",
    "run_summary": """WITH e AS (SELECT coalesce(neg_type, 'gold') AS g, label = 1 AS ok, length(text) / 1000.0::DOUBLE AS s, query_id IS NOT NULL AS gradeable FROM examples)
SELECT coalesce(g, 'all') AS doc_group, count(*) AS n, count(*) FILTER (WHERE gradeable) AS n_gradeable, round(avg(CASE WHEN gradeable THEN ok::INTEGER END), 6) AS accuracy, round(avg(s), 6) AS mean,
  list_sort(list(s))[greatest(floor(count(*) * 0.95)::INTEGER - 1, 0) + 1] AS p95, list_sort(list(s))[floor(count(*) / 2)::INTEGER + 1] AS median FROM e GROUP BY ROLLUP (g)""",
    "length_quantiles": "SELECT p, v[floor(len(v) * p)::INTEGER + 1] AS value FROM (SELECT list_sort(list(length(text))) AS v FROM documents WHERE text IS NOT NULL), (SELECT unnest([0.0, 0.25, 0.5, 0.9, 0.99])::DOUBLE AS p)",
    "stratified_sample": """WITH t AS (SELECT doc_id, source FROM documents WHERE source IS NOT NULL), q AS (SELECT source, greatest(1, round_even(count(*) / (SELECT count(*) FROM t) * 100, 0)::INTEGER) AS quota FROM t GROUP BY 1)
SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('1' || doc_id::VARCHAR), doc_id) AS rn FROM t) JOIN q USING (source) WHERE rn <= quota""",
    "hard_negative_types": """WITH e AS (SELECT * FROM examples WHERE query_id IS NOT NULL), g AS (SELECT DISTINCT ON (query_id) query_id, company AS gc, period AS gp, report_id AS gr FROM e WHERE label = 1 ORDER BY query_id, example_id),
n AS (SELECT e.query_id, example_id AS id, CASE WHEN coalesce(report_id = gr, false) THEN 'diff_section' WHEN coalesce(company = gc, false) AND coalesce(period = gp, false) THEN 'same_company_same_period' WHEN coalesce(company = gc, false) AND period IS NOT NULL AND gp IS NOT NULL THEN 'same_company_diff_year'
  WHEN coalesce(company = gc, false) THEN 'same_company' WHEN coalesce(period = gp, false) THEN 'same_period_diff_company' ELSE 'easy' END AS type FROM e JOIN g USING (query_id) WHERE label = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, type ORDER BY id) AS n FROM n)
SELECT query_id, id, type, row_number() OVER (PARTITION BY query_id ORDER BY n, type)::INTEGER AS place, CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, ('0x' || substr(md5(query_id), 1, 6))::INTEGER % 100 AS h FROM r WHERE n <= CASE WHEN type = 'easy' THEN 2 ELSE 3 END)""",
    "abstention_score": """WITH j AS (SELECT task AS reason, CASE WHEN scope = 'in_scope' THEN 'answer' ELSE 'abstain' END AS e, CASE WHEN answer_mode = 'closed' OR answer_mode IS NULL THEN NULL WHEN answer_mode = 'unknown' THEN 'refuse' ELSE 'answer' END AS a FROM query_plans),
k AS (SELECT *, a IN ('refuse', 'clarify', 'abstain', 'abstain_in_body') AS did, e = 'abstain' AS should FROM j)
SELECT reason, count(*) AS n, count(*) FILTER (WHERE coalesce(did = should, false)) AS "right", count(*) FILTER (WHERE a IS NOT DISTINCT FROM e) AS exact, count(*) FILTER (WHERE a IS NULL) AS missing, round(avg(coalesce(did = should, false)::INTEGER), 6) AS accuracy, count(*) FILTER (WHERE NOT should AND coalesce(did, false)) AS false_refusals FROM k GROUP BY 1""",
    "attribution_score": """WITH c AS (SELECT query_id, list(DISTINCT company) AS c FROM examples WHERE label = 1 AND company IS NOT NULL AND query_id IS NOT NULL GROUP BY 1),
j AS (SELECT query_id, list_distinct(company_mentions) AS w, coalesce(c, []) AS c FROM query_plans LEFT JOIN c USING (query_id) WHERE len(company_mentions) > 0),
k AS (SELECT query_id, len(w) AS n, len(list_intersect(w, c)) AS hit, len(list_filter(c, lambda x: NOT list_contains(w, x))) AS f FROM j)
SELECT query_id, round(CASE WHEN n > 0 THEN hit / n ELSE 0 END, 6) AS coverage, f::INTEGER AS n_foreign, f = 0 AND hit = n AS clean FROM k""",
    "router_confusion": "SELECT coalesce(task, 'none') AS truth, count(*) FILTER (WHERE answer_mode = 'closed') AS closed, count(*) FILTER (WHERE answer_mode = 'mixed') AS mixed, count(*) FILTER (WHERE answer_mode = 'open') AS open, count(*) FILTER (WHERE answer_mode = 'unknown') AS unknown FROM query_plans GROUP BY 1",
    "label_f1": """WITH q AS (SELECT * FROM query_plans WHERE scope IS NOT NULL AND answer_mode IS NOT NULL), t AS (SELECT scope AS label, count(*) AS a, count(*) FILTER (WHERE scope = answer_mode) AS tp FROM q GROUP BY 1), g AS (SELECT answer_mode AS label, count(*) AS b FROM q GROUP BY 1),
j AS (SELECT label, coalesce(a, 0) AS a, coalesce(tp, 0) AS tp, coalesce(b, 0) AS b FROM t FULL JOIN g USING (label)), p AS (SELECT label, CASE WHEN b > 0 THEN tp / b ELSE 0 END AS p, CASE WHEN a > 0 THEN tp / a ELSE 0 END AS r FROM j)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM p""",
}
