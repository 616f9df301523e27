"""Queries of gold questions and grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import grading
from ledgerloom.session import table


def gold_groups(spark, d):
    g = grading.gold_groups(table(spark, d, "facts"))
    return g.select("company", "key_norm", F.array_join("answers", "|").alias("answers"), F.array_join("docs", "|").alias("docs"))


def question_suite(spark, d):
    return grading.suite(table(spark, d, "facts"))


def suite_audit(spark, d):
    f = table(spark, d, "facts")
    return grading.audit_suite(grading.suite(f), f)


def graded_answers(spark, d):
    """Facts with mixed scale words graded against another notation of the same amount."""
    f = table(spark, d, "facts").where("value_text RLIKE '억' AND correction_group_id IS NOT NULL")
    a = f.select(F.col("fact_id").cast("string").alias("id"), F.concat(F.lit("답: "), F.col("value_text")).alias("answer"), F.lit(None).cast("array<string>").alias("required_any"), F.array("value_text").alias("required_all"), F.lit(None).cast("string").alias("expected"), F.lit("value").alias("kind"))
    return grading.grades(a)


def open_answer_score(spark, d):
    """Documents as open answers, scored for the items of every filing form."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("answer")).where("answer IS NOT NULL")
    names = table(spark, d, "field_items").select(F.explode(F.array("item_name", "item_name_ko")).alias("item")).agg(F.collect_set("item").alias("items"))
    # The items of the forms are a fixed short list: one row, sent to every task.
    j = t.crossJoin(F.broadcast(names)).select("id", F.explode(F.filter("items", lambda i: F.contains(F.col("answer"), i))).alias("item"))
    return grading.open_score(t, j)


def citation_score(spark, d):
    e = table(spark, d, "examples").where("query_id IS NOT NULL AND report_id IS NOT NULL")
    return grading.citation_scores(e.select(F.col("query_id").alias("id"), F.col("report_id").alias("doc_id")), e.where("label = 1").select(F.col("query_id").alias("id"), F.col("report_id").alias("doc_id")))


def kind_terms(spark, d):
    return grading.shared_terms(table(spark, d, "manifest").select(F.col("report_nm").alias("name")).where("name IS NOT NULL"))


QUERIES = {f.__name__: f for f in (gold_groups, question_suite, suite_audit, graded_answers, open_answer_score, citation_score, kind_terms)}

_GOLD = """f AS (SELECT DISTINCT company, key_norm, value_text, doc_id FROM facts WHERE value_text IS NOT NULL AND company IS NOT NULL AND key_norm IS NOT NULL),
k AS (SELECT * FROM f WHERE (company, value_text) IN (SELECT (company, value_text) FROM f GROUP BY company, value_text HAVING count(DISTINCT doc_id) <= 3)),
g AS (SELECT company, key_norm, list_sort(list(DISTINCT value_text)) AS answers, list_sort(list(DISTINCT doc_id)) AS docs FROM k GROUP BY ALL HAVING count(DISTINCT value_text) <= 4)"""
_SUITE = (
    _GOLD
    + """, u AS (SELECT company, key_norm, answers[1] AS answer, docs[1] AS doc_id, md5(company || '|' || key_norm) AS id FROM g WHERE len(answers) = 1 AND length(trim(answers[1])) BETWEEN 2 AND 40
  AND NOT regexp_matches(answers[1], '^\\s*(?:19|20)[0-9]{2}\\s*$') AND NOT regexp_matches(answers[1], '^[\\s\\-–.…]*$') AND answers[1] NOT IN ('해당없음', '해당사항 없음', 'N/A', 'not applicable', 'omitted')),
a AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY id) AS i FROM u), b AS (SELECT *, row_number() OVER (PARTITION BY key_norm ORDER BY id) AS k FROM a WHERE i <= 3),
suite AS (SELECT company, key_norm AS item, answer, doc_id, id FROM b WHERE k <= 20)"""
)
ORACLES = {
    "gold_groups": f"WITH {_GOLD} SELECT company, key_norm, array_to_string(answers, '|') AS answers, array_to_string(docs, '|') AS docs FROM g",
    "question_suite": f"WITH {_SUITE} SELECT * FROM suite",
    "suite_audit": f"WITH {_SUITE} SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(*) FILTER (WHERE (company, item, answer) IN (SELECT (company, key_norm, value_text) FROM facts WHERE company IS NOT NULL AND key_norm IS NOT NULL AND value_text IS NOT NULL)) AS reproduced, count(DISTINCT company) AS n_companies, count(DISTINCT item) AS n_items FROM suite",
    "graded_answers": "SELECT fact_id::VARCHAR AS id, true AS correct FROM facts WHERE contains(value_text, '억') AND correction_group_id IS NOT NULL",
    "open_answer_score": """WITH i AS (SELECT unnest([item_name, item_name_ko]) AS item FROM field_items), j AS (SELECT doc_id AS id, item, split_part(substr(text, instr(lower(text), lower(item)) + length(item), 60), chr(10), 1) AS tail FROM documents, i WHERE contains(text, item)),
s AS (SELECT id, CASE WHEN regexp_matches(lower(tail), '확인되지 않|확인할 수 없|기재되어 있지 않|not stated|not found') THEN 'acknowledged' WHEN regexp_matches(tail, '[0-9]|[:：]\\s*\\S') THEN 'covered' ELSE 'silent' END AS s FROM j)
SELECT id, count(*) AS n_items, count(*) FILTER (WHERE s = 'covered') AS covered, count(*) FILTER (WHERE s = 'acknowledged') AS acknowledged, count(*) FILTER (WHERE s = 'silent') AS silent FROM s GROUP BY 1""",
    "citation_score": """WITH e AS (SELECT query_id AS id, report_id, max(coalesce(label, 0)) = 1 AS g FROM examples WHERE query_id IS NOT NULL AND report_id IS NOT NULL GROUP BY ALL)
SELECT id, round(count(*) FILTER (WHERE g) / count(*), 6) AS precision, CASE WHEN bool_or(g) THEN 1.0 ELSE 0.0 END::DOUBLE AS recall FROM e GROUP BY 1""",
    "kind_terms": """WITH n AS (SELECT DISTINCT report_nm AS n FROM manifest WHERE report_nm IS NOT NULL), j AS (SELECT a.n AS a, b.n AS b FROM n a, n b WHERE a.n < b.n AND a.n[:6] = b.n[:6]),
t AS (SELECT rtrim(substr(a, 1, list_max(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, 1, i) = substr(b, 1, i))))) AS term FROM j)
SELECT term, count(*) AS n FROM t WHERE length(term) >= 6 AND NOT contains(term, '(') GROUP BY 1""",
}
