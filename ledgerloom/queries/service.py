"""Queries of readers, writers, tools and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.plans.tools import Tools
from ledgerloom.queries.facts import documents, facts
from ledgerloom.queries.sql import DOCS, FACTS
from ledgerloom.session import shared_folder, table
from ledgerloom.sources import readers, writers
from ledgerloom.streaming import events

#: Companies by their number of facts, as SQL.
_LARGEST = "(SELECT company FROM facts WHERE company IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, company LIMIT {0})"
HOT = _LARGEST.format(1)


def _largest(spark, d, n: int) -> list[str]:
    """The n companies with the most facts."""
    by = facts(spark, d).where("company IS NOT NULL").groupBy("company").agg(F.count("*").alias("n"))
    return [r[0] for r in by.orderBy(F.desc("n"), "company").limit(n).collect()]


def corpus_validation(spark, d):
    """The catalogue against the files that facts were read from, by path."""
    m = table(spark, d, "manifest").dropDuplicates(["doc_id"])
    files = m.join(facts(spark, d).select("doc_id").distinct(), "doc_id", "left_semi").select(F.concat(F.lit("/"), F.col("file_path"), F.lit("/")).alias("path"))
    return readers.validate_corpus(readers.resolve_paths(m, files))


def reader_routes(spark, d):
    m = table(spark, d, "manifest").dropDuplicates(["doc_id"])
    return m.groupBy(readers.route(m).alias("reader"), "doc_group").agg(F.count("*").alias("n"))


def chunk_manifest(spark, d):
    c = table(spark, d, "examples").where("report_id IS NOT NULL").select("report_id", "text", F.split_part("report_id", F.lit("_"), F.lit(1)).alias("doc_group"))
    return writers.chunk_manifest(c, "doc_group")


def facts_manifest(spark, d):
    return writers.facts_manifest(facts(spark, d))


def snapshot_round_trip(spark, d):
    """Facts written by group and read back: rows per group."""
    at = f"{shared_folder(spark)}/ledgerloom/snapshot-{uuid.uuid4().hex}"
    writers.write_snapshot({"facts": facts(spark, d).select("fact_id", "doc_group", "key_norm", "value_num")}, at, {"facts": "doc_group"})
    return spark.read.parquet(f"{at}/facts").groupBy("doc_group").agg(F.count("*").alias("n"), F.count("value_num").alias("numeric"), F.max("fact_id").alias("last"))


def upsert_filings(spark, d):
    """Originals first, then all filings with another file count as the newer delivery; one row per document."""
    m = table(spark, d, "manifest")
    old = m.where("NOT is_correction").select("doc_id", "report_nm", "rcept_dt", F.lit(0).alias("n_files"))
    return writers.upsert(old, m.select("doc_id", "report_nm", "rcept_dt", "n_files"), "doc_id", "rcept_dt")


def pending_examples(spark, d):
    """Rows to score again: not scored yet, with another question text, or failed."""
    e = table(spark, d, "examples").select("example_id", "query", F.col("neg_type").alias("kind"))
    done = e.where("example_id % 3 = 0").select("example_id", F.when(F.col("example_id") % 5 == 0, "changed").otherwise(F.col("query")).alias("query"), (F.col("example_id") % 7 == 0).alias("failed"))
    return writers.pending(e.where("query IS NOT NULL"), done, "example_id", "query", "failed").select("example_id")


def _tools(spark, d):
    return Tools(facts(spark, d), documents(spark, d))


def tool_lookup_fact(spark, d):
    return _tools(spark, d).lookup_fact(company=_largest(spark, d, 1)[0], key="금액", limit=50).select("fact_id", "key_norm", "value_text", "day")


def tool_list_fact_items(spark, d):
    return _tools(spark, d).list_fact_items(_largest(spark, d, 1)[0])


def tool_compare_facts(spark, d):
    return _tools(spark, d).compare_facts(_largest(spark, d, 40), "영업이익")


def tool_correction_history(spark, d):
    return _tools(spark, d).get_correction_history(_largest(spark, d, 1)[0])


def tool_latest_report(spark, d):
    return _tools(spark, d).get_latest_report(_largest(spark, d, 1)[0], "exchange").select("report_id", "day")


def _events(spark, d):
    return events.file_stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema)


def stream_tumbling(spark, d):
    out = events.run_available(events.tumbling(_events(spark, d)), "complete")
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.col("total").cast("string").alias("total"))


def stream_sliding(spark, d):
    out = events.run_available(events.sliding(_events(spark, d)), "complete")
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def stream_sessions(spark, d):
    out = events.run_available(events.sessions(_events(spark, d)), "complete")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def stream_latest_versions(spark, d):
    c = table(spark, d, "corrections")
    s = events.file_stream(spark, f"{d}/corrections.parquet", c.schema)
    return events.run_available(events.latest_versions(s), "complete")


QUERIES = {f.__name__: f for f in (corpus_validation, reader_routes, chunk_manifest, facts_manifest, snapshot_round_trip, upsert_filings, pending_examples, tool_lookup_fact, tool_list_fact_items, tool_compare_facts, tool_correction_history, tool_latest_report, stream_tumbling, stream_sliding, stream_sessions, stream_latest_versions)}

_M = "m AS (SELECT DISTINCT ON (doc_id) * FROM manifest)"
_SELF = "(is_latest IS NULL OR is_latest) AND NOT third"
ORACLES = {
    "corpus_validation": f"""WITH {_M}, r AS (SELECT m.*, file_path IN (SELECT file_path FROM m WHERE doc_id IN (SELECT doc_id FROM facts)) AS ok FROM m)
SELECT coalesce(doc_group, 'all') AS doc_group, count(*) AS n_docs, count(*) FILTER (WHERE ok) AS n_resolved, round(count(*) FILTER (WHERE ok) / count(*), 6) AS rate, count(*) FILTER (WHERE ok) / count(*) >= 0.99 AS healthy FROM r GROUP BY ROLLUP (doc_group)""",
    "reader_routes": f"WITH {_M} SELECT CASE WHEN file_format = 'pdf+html' THEN 'unsupported_pdf_html' WHEN doc_group = 'exchange' THEN 'html' WHEN doc_group IN ('periodic', 'major', 'holding') THEN 'xml' ELSE 'unknown' END AS reader, doc_group, count(*) AS n FROM m GROUP BY ALL",
    "chunk_manifest": "SELECT coalesce(g, 'all') AS doc_group, count(*) AS n_leaves, count(DISTINCT report_id) AS n_docs, round(avg(length(text)), 4) AS mean_length FROM (SELECT *, split_part(report_id, '_', 1) AS g FROM examples WHERE report_id IS NOT NULL) GROUP BY ROLLUP (g)",
    "facts_manifest": "SELECT count(*) AS n_facts, round(100 * count(chunk_id) / count(*), 4) AS linked, round(100 * count(value_num) / count(*), 4) AS numeric, round(100 * count(value_date) / count(*), 4) AS dated FROM facts",
    "snapshot_round_trip": "SELECT doc_group, count(*) AS n, count(value_num) AS numeric, max(fact_id) AS last FROM facts GROUP BY 1",
    "upsert_filings": "SELECT DISTINCT ON (doc_id) doc_id, report_nm, rcept_dt, n_files FROM manifest ORDER BY doc_id, rcept_dt DESC",
    "pending_examples": "SELECT example_id FROM examples WHERE query IS NOT NULL AND NOT (example_id % 3 = 0 AND example_id % 5 <> 0 AND example_id % 7 <> 0)",
    "tool_lookup_fact": f"""WITH {FACTS}, t AS (SELECT *, CASE WHEN key_norm = '금액' THEN 0 WHEN key_norm LIKE '%금액%' OR key LIKE '%금액%' THEN 2 END AS tier FROM f WHERE company = {HOT} AND {_SELF})
SELECT fact_id, key_norm, value_text, day FROM t WHERE tier = (SELECT min(tier) FROM t) ORDER BY day DESC NULLS LAST, fact_id LIMIT 50""",
    "tool_list_fact_items": f"SELECT key_norm, count(*) AS n FROM facts WHERE company = {HOT} GROUP BY 1 ORDER BY n DESC, key_norm LIMIT 100",
    "tool_compare_facts": f"""WITH {FACTS}, t AS (SELECT *, CASE WHEN key_norm = '영업이익' THEN 0 WHEN key_norm LIKE '%영업이익%' OR key LIKE '%영업이익%' THEN 2 END AS tier FROM f
  WHERE company IN {_LARGEST.format(40)} AND value_num IS NOT NULL AND {_SELF}),
u AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY day DESC NULLS LAST, fact_id) AS rn FROM t WHERE tier = (SELECT min(tier) FROM t)) SELECT company, value_num, value_unit, day, fact_id FROM u WHERE rn = 1""",
    "tool_correction_history": f"""WITH {DOCS} SELECT correction_group_id, report_id AS doc_id, day, report_nm, row_number() OVER (PARTITION BY correction_group_id ORDER BY day, report_id) AS position,
  row_number() OVER (PARTITION BY correction_group_id ORDER BY day, report_id) = count(*) OVER (PARTITION BY correction_group_id) AS is_last FROM docs WHERE company = {HOT} AND correction_group_id IS NOT NULL""",
    "tool_latest_report": f"WITH {DOCS} SELECT report_id, day FROM docs WHERE company = {HOT} AND doc_group = 'exchange' AND is_latest IS DISTINCT FROM false ORDER BY day DESC, report_id DESC LIMIT 1",
    "stream_tumbling": "SELECT event_type, strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, sum(value::VARCHAR::DECIMAL(20, 6))::VARCHAR AS total FROM events GROUP BY ALL",
    "stream_sliding": "SELECT event_type, strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 minutes, ts), time_bucket(INTERVAL 30 minutes, ts) - INTERVAL 30 minutes]) AS s FROM events) GROUP BY ALL",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_latest_versions": "SELECT correction_group_id, count(*) AS n, max(doc_id) AS latest FROM corrections WHERE correction_group_id IS NOT NULL GROUP BY 1",
}
