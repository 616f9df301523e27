"""Queries of passage scores, answer labels, suites of questions and the judging of gold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import evaluate, grading, retrieval
from ledgerloom.plans import pipeline
from ledgerloom.queries.facts import ORACLES as FACT_SQL
from ledgerloom.queries.facts import compare_pairs
from ledgerloom.queries.grading import _GOLD as GOLD_SQL
from ledgerloom.queries.retrieval import ranked_documents
from ledgerloom.queries.versions import ORACLES as VERSION_SQL
from ledgerloom.queries.versions import version_pairs_changed
from ledgerloom.session import table


def passage_scores(spark, d):
    """Documents found for held-out questions; relevant are those that hold one of the passage's first two sentences."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    p = table(spark, d, "eval_passages")
    ranked = retrieval.bm25(docs, p.select(F.col("passage_id").alias("query_id"), F.concat_ws(" ", "question", "text").alias("text")), 10).join(docs, "id")
    answers = p.select(F.col("passage_id").alias("query_id"), F.slice(F.split("text", r"\. "), 1, 2).alias("answers"))
    return evaluate.passage_metrics(ranked.select("query_id", "rank", "text"), answers, 10)


def answer_units(spark, d):
    """Whether the first amount of every document carries a unit."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", grading.unit_stated(F.col("text")).alias("stated"))


def answer_labels(spark, d):
    """Reranker rows as answers: gradeable with a question, correct by label, refused if very short, with evidence if their report is known."""
    e = table(spark, d, "examples")
    correct = F.coalesce(F.col("label") == 1, F.lit(False))
    label = evaluate.answer_label(F.col("query_id").isNotNull(), correct, F.coalesce(F.length("text") < 200, F.lit(True)), F.col("report_id").isNotNull())
    return e.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def sibling_chunks(spark, d):
    """Chunks of the same report as a question's right chunk."""
    e = table(spark, d, "examples").where("chunk_id IS NOT NULL")
    hits = e.where("label = 1 AND query_id IS NOT NULL").select("query_id", F.col("chunk_id").alias("id")).distinct()
    of = e.where("report_id IS NOT NULL").select(F.col("chunk_id").alias("id"), F.array("report_id").alias("table_ids")).distinct()
    return retrieval.siblings(hits, of)


def period_notes(spark, d):
    """How the period of every filing reads from 2024, with the filer's fiscal period number where its base year is known."""
    m = table(spark, d, "manifest").dropDuplicates(["doc_id"])
    period = F.when(F.col("base_year").isNotNull(), F.format_string("%04d-%02d", "base_year", "base_month"))
    offset = F.when(F.col("corp_code").isNotNull(), F.lit(-1998))
    return m.select("doc_id", pipeline.period_note(period, F.lit(2024), offset).alias("note")).where("note IS NOT NULL")


def comparison_suite(spark, d):
    return grading.comparison_suite(compare_pairs(spark, d))


def correction_suite(spark, d):
    return grading.correction_suite(version_pairs_changed(spark, d))


def gold_reproduced(spark, d):
    """Gold answers of all facts against the facts that are still valid."""
    f = table(spark, d, "facts")
    return grading.reproduced(grading.gold_groups(f), f.where("is_latest IS NULL OR is_latest"))


def judged_gold(spark, d):
    """Facts with a chunk text as gold: does another company stand nearer before the value, or is the item too frequent for its question."""
    f = table(spark, d, "facts").where("chunk_id IS NOT NULL AND key IS NOT NULL AND key <> '' AND value_text IS NOT NULL AND company IS NOT NULL").select("fact_id", "chunk_id", "company", "key", "value_text")
    # A text of the chunk's facts, with those of another company before them.
    other = F.lit("Other Filer Ltd")
    text = F.concat(F.col("company"), F.lit(" "), F.when(F.col("fact_id") % 3 == 0, other).otherwise(""), F.repeat(F.concat(F.lit(" "), "key"), F.when(F.col("fact_id") % 7 == 0, 12).otherwise(1).cast("int")), F.lit(" "), "value_text")
    question = F.concat("company", F.lit(" "), "key", F.when(F.col("fact_id") % 2 == 0, F.lit(" 2024년")).otherwise(""), F.lit("?"))
    verdict = grading.cleaning_verdict(question, F.col("key"), text, F.col("value_text"), F.col("company"), F.array(other))
    return f.select("fact_id", verdict.alias("verdict"))


QUERIES = {f.__name__: f for f in (passage_scores, answer_units, answer_labels, sibling_chunks, period_notes, comparison_suite, correction_suite, gold_reproduced, judged_gold)}
_AMOUNT = "[0-9][0-9,]*(?:\\.[0-9]+)?\\s*(?:백만|조|억|만|천)?\\s*(?:원|주|%|퍼센트|kg|m2|won|percent)?"
_TEXT = "company || ' ' || CASE WHEN fact_id % 3 = 0 THEN 'Other Filer Ltd' ELSE '' END || repeat(' ' || key, CASE WHEN fact_id % 7 = 0 THEN 12 ELSE 1 END) || ' ' || value_text"
_LAST = "CASE WHEN contains(b, {0}) THEN length(b) - instr(reverse(b), reverse({0})) + 1 ELSE -1 END"
ORACLES = {
    "passage_scores": f"""WITH q AS (SELECT passage_id AS query_id, question || ' ' || text AS text FROM eval_passages), {ranked_documents(10)},
j AS (SELECT r.query_id, rank, len(list_filter(string_split(p.text, '. ')[1:2], lambda a: contains(d.text, a))) > 0 AS rel FROM r JOIN documents d ON d.doc_id = r.id JOIN eval_passages p ON p.passage_id = r.query_id),
s AS (SELECT query_id, count(*) FILTER (WHERE rel) AS n, min(rank) FILTER (WHERE rel) AS first_rank, coalesce(sum(1 / log2(rank + 1.0::DOUBLE)) FILTER (WHERE rel), 0) AS dcg FROM j GROUP BY 1)
SELECT query_id, (n > 0)::INTEGER AS hit, first_rank, round(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, n + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))) ELSE 0 END, 6) AS ndcg FROM s""",
    "answer_units": f"SELECT doc_id, CASE WHEN a <> '' THEN regexp_matches(a, '(?:원|주|%|퍼센트|kg|m2|won|percent)$') END AS stated FROM (SELECT doc_id, regexp_extract(text, '{_AMOUNT}') AS a FROM documents WHERE text IS NOT NULL)",
    "answer_labels": """SELECT CASE WHEN query_id IS NULL THEN 'ungradeable' WHEN label = 1 THEN 'correct' WHEN coalesce(length(text) < 200, true) AND report_id IS NOT NULL THEN 'refused_with_evidence' WHEN coalesce(length(text) < 200, true) THEN 'refused_without_evidence'
  WHEN report_id IS NULL THEN 'retrieval_failure' ELSE 'answer_failure' END AS label, count(*) AS n FROM examples GROUP BY 1""",
    "sibling_chunks": """WITH o AS (SELECT DISTINCT chunk_id AS id, report_id FROM examples WHERE chunk_id IS NOT NULL AND report_id IS NOT NULL), h AS (SELECT DISTINCT query_id, chunk_id AS id FROM examples WHERE label = 1 AND query_id IS NOT NULL AND chunk_id IS NOT NULL)
SELECT DISTINCT h.query_id, h.id, b.id AS sibling FROM h JOIN o a ON a.id = h.id JOIN o b ON b.report_id = a.report_id AND b.id <> h.id""",
    "period_notes": """SELECT doc_id, nullif(concat_ws(', ', CASE base_year WHEN 2024 THEN 'current year' WHEN 2023 THEN 'previous year' END, CASE WHEN corp_code IS NOT NULL AND base_year IS NOT NULL THEN 'fiscal period ' || (base_year - 1998) END), '') AS note
FROM (SELECT DISTINCT ON (doc_id) * FROM manifest) WHERE note IS NOT NULL""",
    "comparison_suite": f"""SELECT field_code, company_a, company_b, answer, id FROM (SELECT *, winner AS answer, md5(field_code || '|' || company_a || '|' || company_b) AS id, row_number() OVER (PARTITION BY field_code ORDER BY md5(field_code || '|' || company_a || '|' || company_b)) AS i
FROM ({FACT_SQL["compare_pairs"]}) WHERE winner <> 'tie') WHERE i <= 20""",
    "correction_suite": f"""SELECT correction_group_id, field_code, before, after, id FROM (SELECT *, md5(correction_group_id || '|' || field_code) AS id, row_number() OVER (PARTITION BY correction_group_id ORDER BY md5(correction_group_id || '|' || field_code)) AS i
FROM ({VERSION_SQL["version_pairs_changed"]}) WHERE changed) WHERE i <= 3""",
    "gold_reproduced": f"""WITH {GOLD_SQL}, a AS (SELECT company, key_norm, unnest(answers) AS answer FROM g), n AS (SELECT DISTINCT company, key_norm, value_text AS answer, true AS ok FROM facts WHERE (is_latest IS NULL OR is_latest) AND company IS NOT NULL AND key_norm IS NOT NULL AND value_text IS NOT NULL)
SELECT a.*, coalesce(ok, false) AS reproduced FROM a LEFT JOIN n USING (company, key_norm, answer)""",
    "judged_gold": f"""WITH f AS (SELECT fact_id, company, key, value_text, {_TEXT} AS text, fact_id % 2 = 0 AS dated FROM facts WHERE chunk_id IS NOT NULL AND key IS NOT NULL AND key <> '' AND value_text IS NOT NULL AND company IS NOT NULL),
p AS (SELECT *, instr(text, value_text) AS place FROM f), b AS (SELECT *, substr(text, greatest(1, place - 1200), least(1200, greatest(place - 1, 0))) AS b FROM p)
SELECT fact_id, CASE WHEN {_LAST.format("'Other Filer Ltd'")} > {_LAST.format("company")} THEN 'cross_entity' WHEN (length(text) - length(replace(text, key, ''))) / length(key) >= 10 AND NOT dated AND NOT regexp_matches(company || ' ' || key || '?', '[0-9]{{4}}|연결|별도|분기|반기|consolidated|separate') THEN 'ambiguous' ELSE 'good' END AS verdict FROM b""",
}
