"""A batch of questions from plan to packed evidence in a bounded number of passes; text generation is passed in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import symbol_key
from ledgerloom.operators import derive, facts, retrieval, versions
from ledgerloom.plans import planner
from ledgerloom.session import keep

#: Facts shown of all that were computed with.
SHOWN_FACTS = 8
#: Facts of one lookup: the newest, or the largest or smallest where a question asks for such; all where it counts or calculates.
FACTS_BY_DATE, FACTS_BY_VALUE, ALL_FACTS = 10, 50, (1 << 31) - 1
#: Characters of a pack, and of one evidence within it.
PACK, SHARE = 6000, 1200


@dataclass
class Store:
    """Tables of a service: facts; documents (report_id, company, chains); chunks (id, report_id, text); known names (name)."""

    facts: DataFrame
    documents: DataFrame
    chunks: DataFrame
    names: DataFrame


def period_note(period: Column, latest_year: Column, fiscal_offset: Column) -> Column:
    """How to read a period: current or previous year, and the fiscal period number by the filer's offset."""
    year = F.substring(period, 1, 4).try_cast("int")
    when = F.when(year == latest_year, "current year").when(year == latest_year - 1, "previous year")
    nth = F.when(fiscal_offset.isNotNull(), F.concat(F.lit("fiscal period "), (year + fiscal_offset).cast("string")))
    return F.nullif(F.concat_ws(", ", when, nth), F.lit(""))


def unit_note(unit: Column, code: Column) -> Column:
    return F.coalesce(F.concat(F.lit("unit: "), F.coalesce(F.nullif(F.trim(unit), F.lit("")), code)), F.lit("unit not stated"))


def owner_note(owner: Column, company: Column) -> Column:
    """A warning where a value belongs to another party than the company asked for."""
    return F.when(owner.isNotNull() & (owner != company), F.concat(F.lit("belongs to "), owner, F.lit(", not to "), company))


def fact_lines(rows: DataFrame) -> DataFrame:
    """query_id, facts, n_facts: the first facts of every question as lines with their notes, largest number SHOWN_FACTS. rows: query_id, rank and fact columns."""
    note = F.concat_ws("; ", unit_note(F.col("value_unit"), F.col("unit_code")), owner_note(F.col("value_owner"), F.col("company")))
    line = F.concat(F.col("company"), F.lit(" "), F.coalesce("period", "day", F.lit("")), F.lit(" "), F.col("key"), F.lit(": "), F.coalesce("value_text", F.lit("")), F.lit(" ("), note, F.lit(")"))
    shown = F.array_sort(F.collect_list(F.when(F.col("rank") <= SHOWN_FACTS, F.struct("rank", line.alias("l")))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(shown, lambda x: x["l"]), "\n").alias("facts"), F.count("*").alias("n_facts"))


def expand_with_siblings(hits: DataFrame, chunks: DataFrame, budget: int = PACK) -> DataFrame:
    """query_id, id, rank, text: one evidence per parent, its text cut to a share of the budget, siblings of the same table appended while they fit.

    chunks: id, parent_id, text, table_ids.
    """
    share = max(200, budget // 5)
    base = retrieval.expand_to_parent(hits, chunks, most=share)
    sib = retrieval.siblings(hits, chunks.select("id", "table_ids")).join(chunks.select(F.col("id").alias("sibling"), F.col("text").alias("more")), "sibling")
    base = base.withColumn("len", F.length("text"))
    j = sib.join(base.select("query_id", "id", "len"), ["query_id", "id"])
    used = F.sum(F.length("more") + 1).over(Window.partitionBy("query_id", "id").orderBy("sibling"))
    fit = j.withColumn("used", used + F.col("len")).where(F.col("used") <= share)
    extra = fit.groupBy("query_id", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sibling", "more"))), lambda x: x["more"]), "\n").alias("extra"))
    return base.join(extra, ["query_id", "id"], "left").select("query_id", "id", "rank", F.concat_ws("\n", "text", "extra").alias("text"))


def search(store: Store, subs: DataFrame, questions: DataFrame, planned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both channels of one pass: ranked chunks (query_id, sub_id, id, report_id, score, rank) and facts (query_id, sub_id, fact columns, rank)."""
    # Texts: every part of a question is one search, within its company's filings if it names one. The version policy
    # comes before the cut too, so superseded filings take no place among the k.
    sid = F.concat_ws("#", "query_id", F.col("sub_id").cast("string"))
    asked = subs.join(questions.select("query_id", "query"), "query_id").select(sid.alias("query_id"), F.concat_ws(" ", F.col("query"), F.col("period")).alias("text"), F.col("company").alias("scope"))
    owner = store.chunks.select("id", "report_id").join(store.documents.select("report_id", F.col("company").alias("of"), "correction_group_id", "correction_order", "is_latest", "day", F.col("period").alias("doc_period")), "report_id", "left")
    scored = keep(retrieval.bm25_scores(store.chunks.select("id", "text"), asked, scopes=owner.select("id", F.col("of").alias("scope"))), "scored")
    parts = subs.select(sid.alias("sid"), "query_id", "sub_id", "k")
    hits = scored.withColumnRenamed("query_id", "sid").join(owner, "id").join(parts, "sid")
    with_plan = hits.join(planned.select("query_id", "latest_policy", "periods"), "query_id").withColumnsRenamed({"report_id": "doc_id"}).withColumn("period", F.col("doc_period"))
    kept = versions.apply_policy(with_plan, F.col("latest_policy"), F.col("periods"), ["query_id"])
    # The largest k bounds every part's rows before they are sorted.
    most = subs.agg(F.max("k")).first()[0] or 0
    best = retrieval.top(kept.withColumnsRenamed({"query_id": "question", "sid": "query_id"}), most).where(F.col("rank") <= F.col("k"))
    texts = best.select(F.col("question").alias("query_id"), "sub_id", "id", F.col("doc_id").alias("report_id"), "score", "rank")
    # Facts: one lookup per part, expected item and document group; tiers and limits hold for each of them, options come from the plan.
    order = F.when(F.col("aggregation") == "max", "value_desc").when(F.col("aggregation") == "min", "value_asc").otherwise("date")
    whole = (F.size(derive.wanted_column(F.col("query"))) > 0) | F.col("task").isin("count", "calculate") | (F.col("aggregation") == "count")
    plan = planned.select("query_id", "latest_policy", "periods", "corrections_only", "value_owner", order.alias("order_by"), whole.alias("whole"), "report_types", F.explode_outer("expected_fields").alias("item"))
    plan = plan.withColumn("doc_group", F.explode_outer("report_types"))
    specs = subs.select("query_id", "sub_id", "company", "period").join(plan, "query_id").where("company IS NOT NULL AND item IS NOT NULL")
    sid = F.concat_ws("#", "query_id", F.col("sub_id").cast("string"), symbol_key("item"), F.coalesce("doc_group", F.lit("")))
    specs = specs.select(
        sid.alias("query_id"), "company", symbol_key("item").alias("key"), "period", "doc_group", (F.col("latest_policy") == "latest_only").alias("latest_only"),
        "corrections_only", "value_owner", "order_by", F.when(F.col("whole"), ALL_FACTS).when(F.col("order_by") == "date", FACTS_BY_DATE).otherwise(FACTS_BY_VALUE).alias("most"),
    )
    rows = facts.lookup_many(store.facts, specs.distinct()).withColumn("q", F.split("query_id", "#"))
    rows = rows.withColumns({"query_id": F.get("q", F.lit(0)), "sub_id": F.get("q", F.lit(1)).cast("int"), "asked": F.get("q", F.lit(2))}).drop("q", "q_company", "q_key", "q_period")
    # Chains come from the catalogue; whether a fact is the latest is its own column.
    chains = store.documents.select(F.col("report_id").alias("doc_id"), "correction_group_id", "correction_order")
    rows = rows.drop("correction_group_id", "correction_order").join(chains, "doc_id", "left").join(planned.select("query_id", "latest_policy", "periods"), "query_id")
    rows = versions.apply_policy(keep(rows, "looked_up"), F.col("latest_policy"), F.col("periods"), ["query_id"])
    return texts, rows.drop("latest_policy", "periods", "correction_group_id", "correction_order")


def calculated(found: DataFrame, planned: DataFrame) -> DataFrame:
    """query_id, calculations: what a question's operations give over its facts, as an array of (operation, item, unit, company, value, text).

    found: query_id and fact columns with day; planned: query_id, query, task, winner. Sum, mean, difference and number of
    filings need two subjects; growth and yearly growth the first and last filing of a company's item; the winner two
    companies with comparable units. Ambiguous figures give nothing.
    """
    mark = "\u0001"
    # One item of one question is one item of the arithmetic.
    item = F.concat_ws(mark, "query_id", "key_norm")
    rows = found.where("value_num IS NOT NULL AND key_norm IS NOT NULL").select(item.alias("item"), F.coalesce("value_unit", F.lit("")).alias("unit"), derive.statement_kind(F.col("section_path")).alias("kind"), "company", F.coalesce("period", F.lit("")).alias("period"), "day", "doc_id", F.col("value_num").alias("value"))
    rows = keep(rows, "figures")
    wants = planned.select("query_id", derive.wanted_column(F.col("query")).alias("ops"), (F.col("task") == "calculate").alias("grows"), "winner")
    none = F.lit(None).cast("string")

    def lines(df: DataFrame, **columns: Column) -> DataFrame:
        one = F.array(*[F.struct(F.lit(op).alias("operation"), F.split("item", mark)[1].alias("item"), (F.col("unit") if "unit" in df.columns else none).alias("unit"), (F.col("company") if "company" in df.columns else none).alias("company"), v.cast("double").alias("value"), (F.col("winner") if op == "winner" else none).alias("text")) for op, v in columns.items()])
        return df.select(F.split("item", mark)[0].alias("query_id"), F.explode(one).alias("x")).where("x.value IS NOT NULL")

    groups = lines(derive.derive(rows), sum=F.col("total"), avg=F.col("mean"), diff=F.col("spread"), count=F.col("n_docs"))
    grown = lines(derive.series(rows), growth=F.col("growth"), cagr=F.col("cagr"))
    best = lines(derive.winners(rows.select("item", "company", "value", "unit")).where("n_tied = 1"), winner=F.col("best"))
    all_ = groups.unionByName(grown).unionByName(best).join(wants, "query_id")
    op = F.col("x.operation")
    wanted = F.array_contains("ops", op) | (op.isin("growth", "cagr") & F.col("grows")) | ((op == "winner") & F.col("winner"))
    return all_.where(wanted).groupBy("query_id").agg(F.array_sort(F.collect_set("x")).alias("calculations"))


def run(questions: DataFrame, store: Store, generate: Callable[[DataFrame], DataFrame] | None = None, retries: int = planner.MOST_RETRIES) -> DataFrame:
    """query_id, decision, reason, action, operations, calculations, facts, n_facts, pack, n_used (and answer with a generator).

    Only questions that pass the scope gate are searched; those with something missing are searched again, at most
    `retries` times, with the missing items added and without the period. Facts count as found items in every gate.
    """
    planned = keep(planner.scope(planner.plans(questions), store.names), "plans")
    open_ = planned.where("decision = 'proceed'")
    texts = found = None
    todo = open_
    for n in range(retries + 1):
        subs = keep(planner.decompose(todo), "subs")
        asked = todo if n == 0 else todo.withColumn("query", F.concat_ws(" ", "query", F.array_join("missing", " ")))
        t, f = search(store, subs if n == 0 else subs.withColumn("period", F.lit(None).cast("string")), asked, todo)
        t, f = keep(t.withColumn("pass", F.lit(n)), "texts"), keep(f.withColumn("pass", F.lit(n)), "facts")
        texts = t if texts is None else texts.unionByName(t)
        found = f if found is None else found.unionByName(f)
        subs_all = subs if n == 0 else subs_all
        hits = texts.select("query_id", "sub_id").union(found.select("query_id", "sub_id"))
        items = found.select("query_id", F.col("asked").alias("item"))
        named = open_.select("query_id", F.explode("expected_fields").alias("item")).join(texts.join(store.chunks.select("id", "text"), "id"), "query_id").where(F.contains(F.lower("text"), F.lower("item"))).select("query_id", "item")
        report = keep(planner.sufficiency(open_, subs_all, hits, items.union(named)), "report")
        rest = report.where("NOT sufficient").select("query_id", "missing")
        todo = keep(open_.join(rest, "query_id"), "todo") if n < retries else todo
        if n == retries or todo.isEmpty():
            break
    gate = planner.abstention(open_, report)
    best = texts.groupBy("query_id", "id", "report_id").agg(F.min(F.struct("pass", "rank", "sub_id")).alias("f"))
    w = Window.partitionBy("query_id").orderBy("f", "id")
    ranked = best.withColumn("rank", F.row_number().over(w)).join(store.chunks.select("id", F.substring("text", 1, SHARE).alias("text")), "id")
    packs = planner.evidence_pack(ranked.select("query_id", "rank", F.col("report_id").alias("title"), "text"), PACK)
    order = Window.partitionBy("query_id").orderBy("pass", "sub_id", "rank", "fact_id")
    once = found.groupBy("query_id", "fact_id").agg(F.min(F.struct("pass", "sub_id", "rank")).alias("f")).select("query_id", "fact_id", "f.*")
    numbered = once.withColumn("rank", F.row_number().over(order)).join(facts.with_day(store.facts), "fact_id")
    numbered = keep(numbered, "numbered")
    lines = fact_lines(numbered)
    sums = calculated(numbered, planned)
    out = planned.select("query_id", "query", "decision", F.col("reason").alias("scope_reason"), derive.wanted_column(F.col("query")).alias("operations"))
    out = out.join(gate, "query_id", "left").join(sums, "query_id", "left").join(lines, "query_id", "left").join(packs, "query_id", "left")
    out = out.select("query_id", "query", "decision", F.coalesce("reason", "scope_reason").alias("reason"), F.coalesce("action", F.lit("refuse")).alias("action"), "operations", "calculations", "facts", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), "pack", F.coalesce("n_used", F.lit(0)).alias("n_used"))
    return out if generate is None else out.join(generate(out.where("action IN ('answer', 'partial')")), "query_id", "left")


def prompt(action: Column, query: Column, facts_: Column, pack: Column) -> Column:
    """The text a generator gets: instruction by action, facts, evidence and the question."""
    rule = F.when(action == "partial", "Answer what the evidence covers and name what it does not state.").otherwise("Answer from the evidence only and cite its numbers.")
    return F.concat_ws("\n\n", rule, F.concat(F.lit("Facts:\n"), facts_), F.concat(F.lit("Evidence:\n"), pack), F.concat(F.lit("Question: "), query))


def better_retry(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per id the second answer only if its checks are strictly better: fewer ungrounded, then fewer rescaled figures. first and second: validate_answers() with answer."""
    s = second.select("id", F.col("answer").alias("a2"), F.struct("ungrounded", "rescaled").alias("s2"))
    j = first.join(s, "id", "left").withColumn("take", F.coalesce(F.col("s2") < F.struct("ungrounded", "rescaled"), F.lit(False)))
    return j.select("id", F.when(F.col("take"), F.col("a2")).otherwise(F.col("answer")).alias("answer"), "take")
