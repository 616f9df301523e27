"""Queries of the planner and its gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.numbers import symbol_key
from ledgerloom.operators.retrieval import bm25
from ledgerloom.plans import pipeline, planner, schema
from ledgerloom.queries.facts import documents, facts
from ledgerloom.queries.retrieval import ranked_documents
from ledgerloom.session import keep, table


def _questions(spark, d):
    return table(spark, d, "query_plans").select("query_id", "query", F.col("company_mentions").alias("companies"), "periods", "expected_fields")


def plan_questions(spark, d):
    p = planner.plans(_questions(spark, d))
    return p.select("query_id", "answer_mode", "task", "aggregation", "latest_policy", "value_owner", "corrections_only", "winner", "multi", "top_k", F.array_join("report_types", ",").alias("report_types"))


def scope_gate(spark, d):
    known = table(spark, d, "manifest").select(F.col("corp_name").alias("name"))
    return planner.scope(planner.plans(_questions(spark, d)), known).select("query_id", "decision", "reason")


def decompose_questions(spark, d):
    return planner.decompose(planner.plans(_questions(spark, d)))


def _sufficiency(spark, d):
    planned = keep(planner.plans(_questions(spark, d)), "plans")
    subs = keep(planner.decompose(planned), "subs")
    f = facts(spark, d).where("is_latest IS NULL OR is_latest").where("company IS NOT NULL")
    return planned, planner.sufficiency(planned, subs, *_fact_hits(planned, subs, f))


def _fact_hits(planned, subs, f):
    """Counts of facts (query_id, sub_id, n) and the expected items among them (query_id, item), for planner.sufficiency().

    Only numbers and expected items matter, so facts are reduced to both before they meet the questions: all items of a
    company beside all its questions are millions of rows. Joins are by sorting, as kept tables compress so well that Spark
    takes large ones for small enough to be broadcast.
    """
    hits = subs.join(f.groupBy("company").agg(F.count("*").alias("n")).hint("merge"), "company").select("query_id", "sub_id", "n")
    wanted = planned.select("query_id", F.explode("expected_fields").alias("item")).join(subs.select("query_id", "company").hint("merge"), "query_id")
    wanted = wanted.select("query_id", "company", "item", symbol_key(F.lower("item")).alias("k")).distinct()
    items = f.select("company", "key_norm").distinct().select("company", symbol_key(F.lower("key_norm")).alias("k")).distinct()
    return keep(hits, "hits"), keep(wanted.join(items.hint("merge"), ["company", "k"]).select("query_id", "item"), "items")


def sufficiency_check(spark, d):
    return _sufficiency(spark, d)[1].withColumn("missing", F.array_join("missing", "|"))


def abstention_gate(spark, d):
    planned, report = _sufficiency(spark, d)
    return planner.abstention(planned, report)


def entity_registry(spark, d):
    return planner.registry(table(spark, d, "manifest")).select("entity_id", "name", F.size("aliases").alias("n_aliases"))


def entity_mentions(spark, d):
    return planner.mentions(_questions(spark, d), planner.registry(table(spark, d, "manifest")))


def masked_questions(spark, d):
    q = _questions(spark, d)
    return planner.masked(q.select("query_id", "query"), entity_mentions(spark, d))


def evidence_packs(spark, d):
    """Ranked documents of held-out questions packed under a budget."""
    docs = table(spark, d, "documents")
    q = table(spark, d, "eval_passages").select(F.col("passage_id").alias("query_id"), F.col("question").alias("text"))
    ranked = bm25(docs.select(F.col("doc_id").alias("id"), "text"), q, 5)
    rows = ranked.join(docs.select(F.col("doc_id").alias("id"), "text", F.col("company").alias("title")), "id")
    return planner.evidence_pack(rows).select("query_id", F.md5("pack").alias("digest"), "n_used", "n_left")


def answer_pipeline(spark, d):
    """Every question whose number is divisible by 20, from plan to evidence."""
    q = _questions(spark, d).where(F.regexp_extract("query_id", "([0-9]+)$", 1).cast("long") % 20 == 0)
    chunks = table(spark, d, "examples").where("chunk_id IS NOT NULL").groupBy(F.col("chunk_id").alias("id")).agg(F.min("report_id").alias("report_id"), F.min("text").alias("text"))
    store = pipeline.Store(facts(spark, d), keep(documents(spark, d), "documents"), keep(chunks, "chunks"), table(spark, d, "manifest").select(F.col("corp_name").alias("name")))
    out = pipeline.run(q, store)
    return out.select("query_id", "decision", "reason", "action", F.array_join("operations", ",").alias("operations"), F.coalesce(F.size("calculations"), F.lit(0)).alias("n_calculations"), "n_facts", "n_used", F.md5("pack").alias("digest"))


def fact_notes(spark, d):
    """Notes on units and owners of all facts."""
    f = facts(spark, d)
    return f.select("fact_id", pipeline.unit_note(F.col("value_unit"), F.col("unit_code")).alias("unit_note"), pipeline.owner_note(F.col("value_owner"), F.col("company")).alias("owner_note"))


def _item_kinds(spark, d):
    """Every canonical item as a kind named by its two names, with the items of its document group."""
    i = table(spark, d, "field_items")
    none = F.array().cast("array<string>")
    return i.select(F.col("field_code").alias("kind"), F.array("item_name", "item_name_ko").alias("terms"), none.alias("core_terms"), none.alias("action_terms"), none.alias("required"), none.alias("items"))


def _group_kinds(spark, d):
    """Document groups as kinds: their items, and as required ones those that occur in no other group."""
    i = table(spark, d, "field_items").select(F.explode("doc_groups").alias("kind"), F.explode(F.array("item_name", "item_name_ko")).alias("item"))
    terms = F.array(F.concat("kind", F.lit(" filing")))
    return i.groupBy("kind").agg(F.collect_set("item").alias("items")).select("kind", terms.alias("terms"), F.array(F.lit("report")).alias("core_terms"), F.array(F.col("kind")).alias("action_terms"), F.slice(F.array_sort("items"), 1, 3).alias("required"), "items")


def question_kinds(spark, d):
    """Items that every question names, as kinds: the longest names first, none within another."""
    m = schema.match_kinds(_questions(spark, d), _item_kinds(spark, d))
    return m.select("query_id", F.array_join("kinds", ",").alias("kinds"))


def question_items(spark, d):
    """Items mentioned and required in questions about the reports of a document group (their report types)."""
    q = table(spark, d, "query_plans").select("query_id", F.concat_ws(" ", "query", F.transform("report_types", lambda t: F.concat(t, F.lit(" report")))).alias("query"))
    kinds = _group_kinds(spark, d)
    m = schema.expected_items(schema.match_kinds(q, kinds), kinds)
    return schema.items_mentioned(m, kinds).select("query_id", F.array_join("kinds", ",").alias("kinds"), F.array_join("required", "|").alias("required"), F.array_join("mentioned", "|").alias("mentioned"))


def plan_repair(spark, d):
    """Plans with faults in task, periods and versions, mended, with what is wrong with them."""
    n = F.regexp_extract("query_id", "([0-9]+)$", 1).cast("long")
    p = planner.plans(_questions(spark, d))
    p = p.withColumns({"task": F.when(n % 3 == 0, "guess").when(n % 7 == 0, "correction_diff").otherwise(F.col("task")), "latest_policy": F.when(n % 7 == 0, "latest_only").otherwise(F.col("latest_policy")), "periods": F.when(n % 5 == 0, F.concat("periods", F.array(F.lit("last year")))).otherwise(F.col("periods"))})
    p = p.join(table(spark, d, "query_plans").select("query_id", F.col("report_types").alias("kinds")), "query_id")
    p = p.withColumn("expected_fields", F.when(n % 11 == 0, F.concat("expected_fields", F.array(F.lit("No such item")))).otherwise(F.col("expected_fields")))
    out = schema.repaired(p, table(spark, d, "manifest").select(F.col("corp_name").alias("name")), _group_kinds(spark, d))
    said = F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["field"], i["severity"])), ",")
    return out.select("query_id", "task", "latest_policy", F.array_join("periods", ",").alias("periods"), F.array_join("expected_fields", "|").alias("expected_fields"), said.alias("issues"))


def concept_kinds(spark, d):
    kinds = table(spark, d, "field_items").select(F.col("item_name_ko").alias("kind"))
    return planner.concept_kinds(_questions(spark, d), kinds)


QUERIES = {f.__name__: f for f in (plan_questions, scope_gate, decompose_questions, sufficiency_check, abstention_gate, entity_registry, entity_mentions, masked_questions, evidence_packs, concept_kinds, question_kinds, question_items, plan_repair, answer_pipeline, fact_notes)}


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(query, '{w}')" for w in words) + ")"


_P = planner
_PLANS = f"""p0 AS (SELECT query_id, query, company_mentions AS companies, periods, expected_fields, CASE WHEN {_any(_P.CLOSED)} AND {_any(_P.OPEN)} THEN 'mixed' WHEN {_any(_P.CLOSED)} THEN 'closed' WHEN {_any(_P.OPEN)} THEN 'open' ELSE 'unknown' END AS answer_mode FROM query_plans),
p1 AS (SELECT *, CASE WHEN {_any(_P.CORRECTION)} AND {_any(_P.DIFFERENCE)} THEN 'correction_diff' WHEN {_any(_P.COUNT)} THEN 'count' WHEN len(companies) >= 2 OR {_any(_P.COMPARE)} THEN 'compare' WHEN {_any(_P.CALCULATE)} THEN 'calculate' WHEN {_any(_P.TIMELINE)} THEN 'timeline'
  WHEN answer_mode IN ('open', 'mixed') OR {_any(_P.SUMMARY)} THEN 'summarize' WHEN answer_mode = 'closed' THEN 'lookup' ELSE 'unknown' END AS task,
  CASE WHEN regexp_matches(query, '{_P.MONTH_NAMED}') THEN 'latest_in_window' ELSE 'latest_only' END AS pinned, greatest(len(companies), len(periods), 1) AS n FROM p0),
p AS (SELECT *, CASE WHEN {_any(_P.COUNT)} THEN 'count' WHEN {_any(_P.LARGEST)} THEN 'max' WHEN {_any(_P.SMALLEST)} THEN 'min' ELSE 'none' END AS aggregation,
  CASE WHEN NOT {_any(_P.CORRECTION)} THEN pinned WHEN {_any(_P.EVERY_VERSION)} THEN 'all_versions' WHEN {_any(_P.FIRST_AND_FINAL)} THEN 'first_and_final' ELSE pinned END AS latest_policy,
  CASE WHEN {_any(_P.HOLDER)} THEN 'other' ELSE 'self' END AS value_owner, task <> 'correction_diff' AND {_any(_P.CORRECTED_ONLY)} AS corrections_only, {_any(_P.WINNER)} AS winner,
  len(companies) >= 2 OR len(periods) >= 2 OR task IN ('compare', 'correction_diff', 'timeline') AS multi,
  (CASE WHEN task = 'correction_diff' OR answer_mode IN ('open', 'mixed') THEN 24 WHEN n > 1 THEN 10 * n ELSE 8 END)::INTEGER AS top_k,
  concat_ws(',', {", ".join(f"CASE WHEN {_any(w)} THEN '{g}' END" for g, w in _P.DOC_GROUPS.items())}) AS report_types,
  CASE {" ".join(f"WHEN regexp_matches(query, '{r}') THEN '{c}'" for c, r in _P.OUT_OF_SCOPE.items())} END AS oos FROM p1)"""
_NAME = "regexp_replace(regexp_replace(lower({0}), '\\(주\\)|㈜|주식회사|유한회사|\\b(?:co|ltd|inc|corp|corporation|company|limited|plc)\\b\\.?', '', 'g'), '[\\s()\\[\\]{{}}.,·&''\"-]', '', 'g')"
_SUBS = """x AS (SELECT *, CASE WHEN len(companies) BETWEEN 2 AND 12 THEN 'company' WHEN len(periods) BETWEEN 2 AND 3 THEN 'period' ELSE 'whole' END AS axis FROM p),
y AS (SELECT *, CASE axis WHEN 'company' THEN companies WHEN 'period' THEN periods ELSE [''] END AS parts FROM x),
z AS (SELECT *, len(parts) AS np, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS sub_id FROM y),
subs AS (SELECT query_id, sub_id::INTEGER AS sub_id, axis, CASE WHEN axis = 'company' THEN part WHEN len(companies) = 1 THEN companies[1] END AS company, CASE WHEN axis = 'period' THEN part WHEN len(periods) = 1 THEN periods[1] END AS period, greatest(8, floor(top_k / np))::INTEGER AS k FROM z)"""
_SYMBOL = "regexp_replace(lower({0}), '[\\sㆍ·・‧∙、,()\\[\\]{{}}<>「」『』\"''’‘“”．.\\-–—/]', '', 'g')"
_SUFF = f"""h AS (SELECT s.query_id, s.sub_id, key_norm FROM subs s JOIN facts f ON s.company = f.company AND (is_latest IS NULL OR is_latest)),
per AS (SELECT query_id, sub_id, count(*) AS n FROM h GROUP BY ALL), s AS (SELECT query_id, coalesce(sum(n), 0)::BIGINT AS n_hits, count(*) FILTER (WHERE n IS NULL) AS empty_targets FROM subs LEFT JOIN per USING (query_id, sub_id) GROUP BY 1),
want AS (SELECT query_id, item, {_SYMBOL.format("item")} AS k FROM (SELECT query_id, unnest(expected_fields) AS item FROM p)),
miss AS (SELECT query_id, list_sort(list(DISTINCT item)) AS missing FROM want WHERE (query_id, k) NOT IN (SELECT (query_id, {_SYMBOL.format("key_norm")}) FROM h WHERE key_norm IS NOT NULL) GROUP BY 1),
r AS (SELECT query_id, answer_mode, n_hits, coalesce(missing, []) AS missing, empty_targets FROM p JOIN s USING (query_id) LEFT JOIN miss USING (query_id))"""
_KIND = "regexp_replace(regexp_replace(lower(nfc_normalize(trim({0}))), '^\\[[^\\]]*\\]', ''), '[\\s·ㆍ・:∙]', '', 'g')"
_MENTIONS = f"""a AS (SELECT coalesce(corp_code, 'name:' || {_NAME.format("corp_name")}) AS k, corp_name, unnest(list_filter([corp_name, listed_name, flr_nm], lambda x: x IS NOT NULL)) AS alias FROM manifest),
n AS (SELECT lower(alias) AS alias, max('ent_' || substr(sha1(k), 1, 16)) AS entity_id FROM a WHERE k IS NOT NULL AND length(alias) >= 2 GROUP BY 1),
o AS (SELECT query_id, query, lower(query) AS low, alias, entity_id, unnest(range(1, length(query) + 1)) AS p FROM query_plans JOIN n ON contains(lower(query), alias)),
f AS (SELECT *, substr(low, p - 1, CASE WHEN p > 1 THEN 1 ELSE 0 END) AS b, substr(low, p + length(alias), 1) AS e FROM o WHERE substr(low, p, length(alias)) = alias),
g AS (SELECT query_id, query, p - 1 AS start, p - 1 + length(alias) AS "end", entity_id FROM f
  WHERE NOT (regexp_matches(b, '^[a-z0-9]$') AND unicode(alias) < 128) AND NOT (regexp_matches(e, '^[a-z0-9]$') AND unicode(alias[-1:]) < 128)),
found AS (SELECT * FROM g x WHERE NOT EXISTS (SELECT 1 FROM g y WHERE y.query_id = x.query_id AND y.start < x."end" AND x.start < y."end" AND (y."end" - y.start > x."end" - x.start OR (y."end" - y.start = x."end" - x.start AND y.start < x.start))))"""
ORACLES = {
    "entity_mentions": f'WITH {_MENTIONS} SELECT query_id, start::INTEGER AS start, "end"::INTEGER AS "end", substr(query, start + 1, "end" - start) AS surface, entity_id FROM found',
    "masked_questions": f"""WITH {_MENTIONS}, w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY start) AS i, count(*) OVER (PARTITION BY query_id) AS n, lag("end", 1, 0) OVER (PARTITION BY query_id ORDER BY start) AS last FROM found),
t AS (SELECT query_id, string_agg(substr(query, last + 1, start - last) || CASE WHEN n > 1 THEN '[COMPANY_' || i || ']' ELSE '[COMPANY]' END, '' ORDER BY start) || substr(min(query), max("end") + 1) AS masked FROM w GROUP BY 1)
SELECT q.query_id, coalesce(masked, query) AS masked FROM query_plans q LEFT JOIN t USING (query_id)""",
    "evidence_packs": f"""WITH q AS (SELECT passage_id AS query_id, question AS text FROM eval_passages), {ranked_documents(5)},
b AS (SELECT r.query_id, rank, '[' || rank || '] ' || coalesce(company, '') || chr(10) || text AS block FROM r JOIN documents d ON d.doc_id = r.id),
u AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM b), o AS (SELECT *, max((used > 6000 AND rank > 1)::INTEGER) OVER (PARTITION BY query_id ORDER BY rank) AS over FROM u)
SELECT query_id, md5(string_agg(block, chr(10) || chr(10) ORDER BY rank) FILTER (WHERE over = 0)) AS digest, count(*) FILTER (WHERE over = 0) AS n_used, sum(over)::BIGINT AS n_left FROM o GROUP BY 1""",
    "question_kinds": f"""WITH q AS (SELECT query_id, {_KIND.format("query")} AS q FROM query_plans), t AS (SELECT DISTINCT field_code, {_KIND.format("unnest([item_name, item_name_ko])")} AS t FROM field_items),
h AS (SELECT query_id, field_code, t, instr(q, t) AS p, length(t) AS n FROM q JOIN t ON contains(q, t)),
k AS (SELECT * FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.query_id = a.query_id AND a.p >= b.p AND a.p + a.n <= b.p + b.n AND b.n > a.n)),
f AS (SELECT query_id, field_code, min((-n, p, t, field_code)) AS o FROM k GROUP BY ALL)
SELECT query_id, coalesce(kinds, '') AS kinds FROM q LEFT JOIN (SELECT query_id, string_agg(field_code, ',' ORDER BY o) AS kinds FROM f GROUP BY 1) USING (query_id)""",
    "question_items": f"""WITH q AS (SELECT query_id, report_types, {_KIND.format("query || ' ' || array_to_string(list_transform(report_types, lambda t: t || ' report'), ' ')")} AS q FROM query_plans),
i AS (SELECT DISTINCT unnest(doc_groups) AS kind, item FROM (SELECT doc_groups, unnest([item_name, item_name_ko]) AS item FROM field_items)),
g AS (SELECT kind, list_transform(list_sort(list(item))[1:3], lambda x: {_KIND.format("x")}) AS required, list(DISTINCT {_KIND.format("item")}) AS items FROM i GROUP BY 1),
k AS (SELECT query_id, q, CASE WHEN NOT contains(q, 'report') THEN [] WHEN len(list_filter((SELECT list(kind) FROM g), lambda x: contains(q, x))) > 0 THEN list_sort(list_filter((SELECT list(kind) FROM g), lambda x: contains(q, x))) ELSE (SELECT list_sort(list(kind)) FROM g) END AS kinds FROM q),
r AS (SELECT k.query_id, CASE WHEN len(kinds) = 1 THEN (SELECT required FROM g WHERE kind = kinds[1]) WHEN len(kinds) = 2 THEN (SELECT list_intersect(a.required, b.required) FROM g a, g b WHERE a.kind = kinds[1] AND b.kind = kinds[2]) ELSE [] END AS required FROM k),
n AS (SELECT DISTINCT query_id, q, unnest(items) AS t FROM k JOIN g ON len(kinds) = 0 OR list_contains(kinds, g.kind)),
h AS (SELECT query_id, t, instr(q, t) AS p, length(t) AS n FROM n WHERE contains(q, t) AND length(t) >= 2 AND t <> 'report' AND t NOT IN (SELECT kind FROM g)),
m AS (SELECT query_id, string_agg(t, '|' ORDER BY -n, p, t) AS mentioned FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.query_id = a.query_id AND a.p >= b.p AND a.p + a.n <= b.p + b.n AND b.n > a.n) GROUP BY 1)
SELECT query_id, array_to_string(kinds, ',') AS kinds, array_to_string(list_sort(required), '|') AS required, coalesce(mentioned, '') AS mentioned FROM k JOIN r USING (query_id) LEFT JOIN m USING (query_id)""",
    "plan_repair": f"""WITH {_PLANS}, v AS (SELECT p.query_id, p.companies, regexp_extract(p.query_id, '([0-9]+)$', 1)::BIGINT AS n, p.task, p.latest_policy, p.aggregation, p.periods, p.expected_fields, x.report_types AS kinds FROM p JOIN query_plans x USING (query_id)),
f AS (SELECT query_id, companies, kinds, CASE WHEN n % 3 = 0 THEN 'guess' WHEN n % 7 = 0 THEN 'correction_diff' ELSE task END AS task, CASE WHEN n % 7 = 0 THEN 'latest_only' ELSE latest_policy END AS latest_policy,
  CASE WHEN n % 5 = 0 THEN list_concat(periods, ['last year']) ELSE periods END AS periods, CASE WHEN n % 11 = 0 THEN list_concat(expected_fields, ['No such item']) ELSE expected_fields END AS expected_fields FROM v),
g AS (SELECT *, CASE WHEN task = 'guess' THEN 'unknown' ELSE task END AS t, list_filter(periods, lambda x: regexp_matches(x, '^[0-9]{{4}}(-[0-9]{{2}})?$')) AS good FROM f),
i AS (SELECT kind, {_KIND.format("item")} AS item FROM (SELECT doc_groups, unnest([item_name, item_name_ko]) AS item FROM field_items), unnest(doc_groups) AS g(kind)),
own AS (SELECT query_id, list(item) AS items FROM (SELECT query_id, unnest(kinds) AS kind FROM g) JOIN i USING (kind) GROUP BY 1),
e AS (SELECT g.*, CASE WHEN len(kinds) > 0 THEN list_filter(expected_fields, lambda x: coalesce(list_contains(items, {_KIND.format("x")}), false)) ELSE expected_fields END AS fields FROM g LEFT JOIN own USING (query_id)),
u AS (SELECT DISTINCT query_id FROM (SELECT query_id, unnest(companies) AS c FROM g) WHERE {_NAME.format("c")} NOT IN (SELECT {_NAME.format("corp_name")} FROM manifest WHERE corp_name IS NOT NULL AND {_NAME.format("corp_name")} <> ''))
SELECT e.query_id, t AS task, CASE WHEN t = 'correction_diff' AND latest_policy = 'latest_only' THEN 'first_and_final' ELSE latest_policy END AS latest_policy, array_to_string(good, ',') AS periods, array_to_string(fields, '|') AS expected_fields,
  concat_ws(',', CASE WHEN task = 'guess' THEN 'task:warning' END, CASE WHEN u.query_id IS NOT NULL THEN 'companies:error' END, CASE WHEN len(good) < len(periods) THEN 'periods:warning' END, CASE WHEN t = 'compare' AND len(companies) < 2 AND len(good) < 2 THEN 'task:error' END,
    CASE WHEN t = 'correction_diff' AND latest_policy = 'latest_only' THEN 'latest_policy:warning' END, CASE WHEN t = 'calculate' AND len(expected_fields) = 0 THEN 'expected_fields:error' END, CASE WHEN len(fields) < len(expected_fields) THEN 'expected_fields:warning' END) AS issues
FROM e LEFT JOIN u USING (query_id)""",
    "plan_questions": f"WITH {_PLANS} SELECT query_id, answer_mode, task, aggregation, latest_policy, value_owner, corrections_only, winner, multi, top_k, report_types FROM p",
    "scope_gate": f"""WITH {_PLANS}, s AS (SELECT *, CASE WHEN len(companies) = 0 THEN nullif(regexp_extract(query, '^\\s*([가-힣A-Za-z0-9&·\\-.]{{2,20}})(?:의|가)\\s', 1), '') END AS subject FROM p),
t AS (SELECT *, subject IS NOT NULL AND subject NOT IN ({", ".join(f"'{w}'" for w in _P.PRONOUNS)}) AND {_NAME.format("subject")} NOT IN (SELECT {_NAME.format("corp_name")} FROM manifest WHERE corp_name IS NOT NULL) AS unknown FROM s),
u AS (SELECT query_id, oos, CASE WHEN oos IS NOT NULL THEN oos WHEN unknown THEN 'unknown_company' WHEN len(companies) = 0 THEN 'company_missing' WHEN answer_mode = 'unknown' OR task = 'unknown' THEN 'item_missing'
  WHEN task = 'summarize' AND report_types = '' AND len(periods) = 0 THEN 'range_missing' WHEN task = 'compare' AND len(companies) < 2 AND len(periods) < 2 THEN 'second_target_missing' END AS reason FROM t)
SELECT query_id, reason, CASE WHEN oos IS NOT NULL THEN 'refuse' WHEN reason = 'unknown_company' THEN 'out_of_corpus' WHEN reason IS NOT NULL THEN 'clarify' ELSE 'proceed' END AS decision FROM u""",
    "decompose_questions": f"WITH {_PLANS}, {_SUBS} SELECT * FROM subs",
    "sufficiency_check": f"WITH {_PLANS}, {_SUBS}, {_SUFF} SELECT query_id, n_hits, array_to_string(missing, '|') AS missing, empty_targets, n_hits > 0 AND len(missing) = 0 AND empty_targets = 0 AS sufficient FROM r",
    "abstention_gate": f"""WITH {_PLANS}, {_SUBS}, {_SUFF}, l AS (SELECT *, CASE WHEN empty_targets > 0 THEN 'empty_target' WHEN len(missing) > 0 THEN 'missing_field' END AS lack FROM r)
SELECT query_id, CASE WHEN n_hits = 0 THEN 'abstain' WHEN lack IS NULL THEN 'answer' WHEN answer_mode IN ('open', 'mixed') THEN 'partial' ELSE 'abstain' END AS action, CASE WHEN n_hits = 0 THEN 'evidence_absent' ELSE lack END AS reason FROM l""",
    "entity_registry": f"""WITH a AS (SELECT coalesce(corp_code, 'name:' || {_NAME.format("corp_name")}) AS k, corp_name, unnest(list_filter([corp_name, listed_name, flr_nm], lambda x: x IS NOT NULL)) AS alias FROM manifest)
SELECT 'ent_' || substr(sha1(k), 1, 16) AS entity_id, min(corp_name) AS name, count(DISTINCT alias)::INTEGER AS n_aliases FROM a WHERE k IS NOT NULL GROUP BY k""",
    "fact_notes": "SELECT fact_id, coalesce('unit: ' || coalesce(nullif(trim(value_unit), ''), unit_code), 'unit not stated') AS unit_note, CASE WHEN value_owner IS NOT NULL AND value_owner <> company THEN 'belongs to ' || value_owner || ', not to ' || company END AS owner_note FROM facts",
    "concept_kinds": f"""SELECT DISTINCT query_id, item_name_ko AS kind FROM query_plans, field_items WHERE {_any(_P.CONCEPTS["funding"][0])} AND {_any(_P.CONCEPTS["funding"][1]).replace("query", "item_name_ko")}""",
}
