"""From questions to plans, and the gates around retrieval: all as columns, so a batch of questions is one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import name_key, symbol_key
from ledgerloom.session import keep

# Words that decide on mode, task, aggregation, owner, versions and document groups.
CLOSED = ["얼마인가", "얼마야", "얼마인지", "얼마입니까", "얼마죠", "몇 ", "몇건", "몇개", "어디인가", "어디야", "누구인가", "누구야", "언제인가", "언제야", "무엇인가", "뭐야", "존재하는가", "있는가", "있나요", "있습니까", "더 큰", "더 많은", "가장 큰", "가장 많은", "맞는가", "What was", "How many", "Who is", "When was"]
OPEN = ["정리해", "설명해", "요약해", "서술해", "알려줘", "말해줘", "어떻게 변화", "어떻게 달라", "무엇이 달라", "어떤 내용", "어떤 차이", "비교했을 때", "기준으로 주요", "Summarize", "Summarise", "Explain", "Describe", " vs "]
CORRECTION, DIFFERENCE = ["정정", "기재정정", "correction"], ["달라", "차이", "변경", "바뀐", "전후", "비교", "changed", "difference"]
COUNT = ["몇 건", "몇건", "건수", "개수", "몇 개", "몇개", "총 몇", "How many"]
COMPARE = ["비교", "더 큰", "더 많은", "더 높은", "중 어느", "어느 기업", "대비 어느", " vs "]
CALCULATE = ["증감률", "증가율", "감소율", "성장률", "비율", "CAGR", "합계는", "평균", "대비 몇", "얼마나 증가", "얼마나 감소"]
TIMELINE = ["추이", "연도별", "분기별", "시간순", "변화 과정", "이력"]
SUMMARY = ["정리해", "요약해", "주요 내용", "핵심", "어떤 내용"]
LARGEST = ["최대", "최고", "가장 큰", "가장 많은", "가장 높은", "최다", "최고액", "largest", "highest"]
SMALLEST = ["최소", "최저", "가장 작은", "가장 적은", "가장 낮은", "최소액", "smallest", "lowest"]
WINNER = ["더 큰", "더 많은", "더 높은", "큰 쪽", "많은 쪽", "높은 쪽", "어느 기업이 더", "어느 쪽이 더", "중 어느", "더 작은", "더 적은", "더 낮은", "작은 쪽", "적은 쪽", "낮은 쪽"]
HOLDER = ["최대주주", "최대 주주", "대주주", "특수관계인", "특수관계자", "지배주주", "모회사", "지주회사의 주주"]
EVERY_VERSION = ["이력", "전부", "모든 정정", "몇 번 정정"]
FIRST_AND_FINAL = ["최초", "최종", "정정 전", "정정전", "전후", "달라", "차이"]
CORRECTED_ONLY = ["[기재정정]", "기재정정", "[첨부추가]", "정정본", "정정 공시", "정정공시"]
DOC_GROUPS = {
    "periodic": ["사업보고서", "반기보고서", "분기보고서", "재무제표", "감사보고서"],
    "major": ["주요사항보고서"],
    "holding": ["대량보유", "지분 공시", "5% 공시"],
    "exchange": ["단일판매", "공급계약", "신규시설투자", "투자판단", "자율공시"],
}
MONTH_NAMED = r"20[0-9]{2}\s*(?:년\s*[0-9]{1,2}\s*월|[.\-/]\s*[0-9]{1,2})"
OUT_OF_SCOPE = {
    "market_price": r"(?:현재|오늘|지금|실시간|금일).{0,8}(?:주가|시세|종가|시가총액)|(?:주가|시세|종가|시가총액).{0,8}(?:얼마|조회|알려|보여)",
    "news": r"(?:최신|오늘|지금|최근).{0,8}(?:뉴스|기사|언론보도)|(?:뉴스|기사).{0,8}(?:알려|찾아|요약)",
    "prediction": r"(?:전망|예측|예상).{0,5}(?:해줘|해봐|좀|가능)|(?:오를까|내릴까|상승할까|하락할까|목표주가|파산확률|부도확률)|(?:다음|향후|미래).{0,10}(?:주가|실적|환율).{0,8}(?:예측|전망|예상)",
    "recommendation": r"(?:매수|매도|투자).{0,8}(?:추천|해도|할까|해줘|의견)|(?:사야|팔아야|사도돼|팔아도돼)",
}
CONCEPTS = {"funding": (["자금조달", "자금 조달", "조달 내역", "조달내역"], ["유상증자", "무상증자", "전환사채", "신주인수권부사채", "교환사채", "자본으로인정되는채무증권", "조건부자본증권"])}
PRONOUNS = ["그것", "이것", "저것", "그거", "이거", "그곳", "이곳", "여기", "거기", "그때", "이때", "그분", "이분", "우리", "저희", "당사", "해당"]
MULTI_TASKS = ["compare", "correction_diff", "timeline"]
#: Parts a question is cut into: companies, and kinds or periods; and how often a search may be repeated.
MOST_COMPANIES, MOST_PARTS, MOST_RETRIES = 12, 3, 2


def any_of(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def answer_mode(q: Column) -> Column:
    closed, open_ = any_of(q, CLOSED), any_of(q, OPEN)
    return F.when(closed & open_, "mixed").when(closed, "closed").when(open_, "open").otherwise("unknown")


def task(q: Column, n_companies: Column, mode: Column) -> Column:
    return (
        F.when(any_of(q, CORRECTION) & any_of(q, DIFFERENCE), "correction_diff")
        .when(any_of(q, COUNT), "count")
        .when((n_companies >= 2) | any_of(q, COMPARE), "compare")
        .when(any_of(q, CALCULATE), "calculate")
        .when(any_of(q, TIMELINE), "timeline")
        .when(mode.isin("open", "mixed") | any_of(q, SUMMARY), "summarize")
        .when(mode == "closed", "lookup")
        .otherwise("unknown")
    )


def aggregation(q: Column) -> Column:
    return F.when(any_of(q, COUNT), "count").when(any_of(q, LARGEST), "max").when(any_of(q, SMALLEST), "min").otherwise("none")


def latest_policy(q: Column) -> Column:
    pinned = F.when(q.rlike(MONTH_NAMED), "latest_in_window").otherwise("latest_only")
    return F.when(~any_of(q, CORRECTION), pinned).when(any_of(q, EVERY_VERSION), "all_versions").when(any_of(q, FIRST_AND_FINAL), "first_and_final").otherwise(pinned)


def report_types(q: Column) -> Column:
    return F.array_compact(F.array(*[F.when(any_of(q, w), F.lit(g)) for g, w in DOC_GROUPS.items()]))


def out_of_scope(q: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for code, pattern in OUT_OF_SCOPE.items():
        out = out.when(q.rlike(pattern), F.lit(code))
    return out


def top_k(plan_task: Column, mode: Column, n_targets: Column) -> Column:
    """Rows to retrieve: 24 for comparisons of versions and for open questions, ten per target for several documents, else 8."""
    return F.when(plan_task == "correction_diff", 24).when(mode.isin("open", "mixed"), 24).when(n_targets > 1, 10 * n_targets).otherwise(8)


def plans(questions: DataFrame) -> DataFrame:
    """questions (query_id, query, companies array, periods array) with everything the rules can tell about them."""
    q = F.col("query")
    n = F.size("companies")
    df = questions.withColumn("answer_mode", answer_mode(q))
    df = df.withColumn("task", task(q, n, F.col("answer_mode")))
    targets = F.greatest(n, F.size("periods"), F.lit(1))
    return df.withColumns(
        {
            "aggregation": aggregation(q),
            "latest_policy": latest_policy(q),
            "value_owner": F.when(any_of(q, HOLDER), "other").otherwise("self"),
            "corrections_only": (F.col("task") != "correction_diff") & any_of(q, CORRECTED_ONLY),
            "winner": any_of(q, WINNER),
            "report_types": report_types(q),
            "out_of_scope": out_of_scope(q),
            "multi": (n >= 2) | (F.size("periods") >= 2) | F.col("task").isin(MULTI_TASKS),
            "top_k": top_k(F.col("task"), F.col("answer_mode"), targets),
        }
    )


def concept_kinds(questions: DataFrame, kinds: DataFrame) -> DataFrame:
    """query_id, kind: known kinds that a concept word of the question stands for. kinds: kind (a short list)."""
    out = None
    for words, patterns in CONCEPTS.values():
        hit = questions.where(any_of(F.col("query"), words)).select("query_id")
        fit = kinds.where(any_of(F.col("kind"), patterns)).select("kind")
        part = hit.crossJoin(F.broadcast(fit))
        out = part if out is None else out.union(part)
    return out.distinct()


def unknown_subject(q: Column) -> Column:
    """The name a question begins with, before a particle, unless it is a pronoun."""
    name = F.regexp_extract(q, r"^\s*([가-힣A-Za-z0-9&·\-.]{2,20})(?:의|가)\s", 1)
    return F.when((name != "") & ~name.isin(PRONOUNS), name)


def scope(planned: DataFrame, known: DataFrame) -> DataFrame:
    """planned with decision and reason: refuse (out of scope), out_of_corpus (unknown company), clarify, or proceed. known: name."""
    names = known.select(name_key(F.col("name")).alias("k")).where("k <> ''").distinct()
    df = planned.withColumn("subject", F.when(F.size("companies") == 0, unknown_subject(F.col("query"))))
    df = df.withColumn("sk", name_key(F.col("subject")))
    df = df.join(names.withColumn("is_known", F.lit(True)), F.col("sk") == F.col("k"), "left").drop("k", "sk")
    none = F.size("companies") == 0
    reason = (
        F.when(F.col("out_of_scope").isNotNull(), F.col("out_of_scope"))
        .when(F.col("subject").isNotNull() & F.col("is_known").isNull(), "unknown_company")
        .when(none, "company_missing")
        .when((F.col("answer_mode") == "unknown") | (F.col("task") == "unknown"), "item_missing")
        .when((F.col("task") == "summarize") & (F.size("report_types") == 0) & (F.size("periods") == 0), "range_missing")
        .when((F.col("task") == "compare") & (F.size("companies") < 2) & (F.size("periods") < 2), "second_target_missing")
    )
    decision = F.when(F.col("out_of_scope").isNotNull(), "refuse").when(reason == "unknown_company", "out_of_corpus").when(reason.isNotNull(), "clarify").otherwise("proceed")
    return df.withColumns({"reason": reason, "decision": decision}).drop("is_known")


def decompose(planned: DataFrame) -> DataFrame:
    """query_id, sub_id, company, period, k: one row per part of a question.

    The first axis that is wide enough and not too wide is used: companies (2 to 12), then periods (2 or 3); else the question stays whole.
    """
    nc, np_ = F.size("companies"), F.size("periods")
    axis = F.when(nc.between(2, MOST_COMPANIES), "company").when(np_.between(2, MOST_PARTS), "period").otherwise("whole")
    value = F.when(axis == "company", F.col("companies")).when(axis == "period", F.col("periods")).otherwise(F.array(F.lit("")))
    df = planned.withColumns({"axis": axis, "parts": value})
    one = df.select("query_id", "axis", "companies", "periods", "top_k", F.size("parts").alias("n"), F.posexplode("parts").alias("sub_id", "part"))
    first = lambda c: F.when(F.size(c) == 1, F.element_at(c, 1))
    company = F.when(F.col("axis") == "company", F.col("part")).otherwise(first("companies"))
    period = F.when(F.col("axis") == "period", F.col("part")).otherwise(first("periods"))
    return one.select("query_id", "sub_id", "axis", company.alias("company"), period.alias("period"), F.greatest(F.lit(8), F.floor(F.col("top_k") / F.col("n"))).cast("int").alias("k"))


def sufficiency(planned: DataFrame, subs: DataFrame, hits: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, n_hits, missing, empty_targets, sufficient: what a pass has found.

    Joins are by sorting: tables of questions compress so well that Spark would broadcast large ones.
    planned: query_id, expected_fields; subs: decompose(); hits: query_id, sub_id rows (or counts of them, n); found: query_id, item (from texts and facts alike).
    """
    per = hits.groupBy("query_id", "sub_id").agg((F.sum("n") if "n" in hits.columns else F.count("*")).alias("n"))
    s = subs.join(per.hint("merge"), ["query_id", "sub_id"], "left").groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_hits"), F.count_if(F.col("n").isNull()).alias("empty_targets"))
    want = planned.select("query_id", F.explode("expected_fields").alias("item")).withColumn("k", symbol_key(F.lower("item")))
    have = found.select("query_id", symbol_key(F.lower("item")).alias("k")).distinct()
    missing = want.join(have.hint("merge"), ["query_id", "k"], "left_anti").groupBy("query_id").agg(F.array_sort(F.collect_set("item")).alias("missing"))
    out = planned.select("query_id").join(s.hint("merge"), "query_id", "left").join(missing.hint("merge"), "query_id", "left")
    out = out.select("query_id", F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"), F.coalesce("empty_targets", F.lit(0)).cast("long").alias("empty_targets"))
    return out.withColumn("sufficient", (F.col("n_hits") > 0) & (F.size("missing") == 0) & (F.col("empty_targets") == 0))


def abstention(planned: DataFrame, report: DataFrame, incomplete_pairs: DataFrame | None = None) -> DataFrame:
    """query_id, action, reason: abstain without evidence; with something missing abstain if closed, partial if open; else answer. incomplete_pairs: query_id."""
    df = planned.select("query_id", "answer_mode").join(report.hint("merge"), "query_id")
    if incomplete_pairs is not None:
        df = df.join(incomplete_pairs.select("query_id", F.lit(True).alias("pair")).distinct(), "query_id", "left")
    else:
        df = df.withColumn("pair", F.lit(None).cast("boolean"))
    lack = F.when(F.col("empty_targets") > 0, "empty_target").when(F.col("pair"), "incomplete_pair").when(F.size("missing") > 0, "missing_field")
    action = F.when(F.col("n_hits") == 0, "abstain").when(lack.isNotNull(), F.when(F.col("answer_mode").isin("open", "mixed"), "partial").otherwise("abstain")).otherwise("answer")
    return df.select("query_id", action.alias("action"), F.when(F.col("n_hits") == 0, "evidence_absent").otherwise(lack).alias("reason"))


def item_hits(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, item, id, value, source: items found by field code, else by text with a number within 40 characters after them.

    chunks: query_id, id, text, field_codes (array of struct key, text); items: query_id, item.
    """
    coded = chunks.select("query_id", "id", F.explode("field_codes").alias("r")).select("query_id", "id", "r.key", "r.text")
    a = coded.join(items, "query_id").where(symbol_key(F.lower("key")) == symbol_key(F.lower("item"))).select("query_id", "item", "id", F.col("text").alias("value"), F.lit("code").alias("source"))
    rest = items.join(a.select("query_id", "item"), ["query_id", "item"], "left_anti")
    t = chunks.select("query_id", "id", "text").join(rest, "query_id").withColumn("at", F.expr("instr(lower(text), lower(item))")).where("at > 0")
    tail = F.expr("substring(text, at + length(item), 40)")
    number = F.regexp_extract(tail, r"[△▲-]?[0-9][0-9,]*(?:\.[0-9]+)?", 0)
    b = t.withColumn("value", number).where("value <> ''").select("query_id", "item", "id", "value", F.lit("text").alias("source"))
    return a.unionByName(b)


def evidence_pack(rows: DataFrame, budget: int = 6000) -> DataFrame:
    """query_id, pack, n_used, n_left: blocks in rank order under a character budget, numbered and joined. rows: query_id, rank, title, text."""
    from ledgerloom.operators.retrieval import budget_prefix

    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), F.col("text"))
    b = rows.withColumn("block", block)
    kept = budget_prefix(b, F.length("block"), budget)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "block")))
    return kept.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("pack"), F.count("*").alias("n_used"), F.max("n_left").alias("n_left"))


# --- names in questions -------------------------------------------------------

#: Characters by which names are looked up in questions; names of fewer are looked up whole.
PROBE = 5
#: Names that are sent to the questions; more of them meet the questions' characters by a shuffle.
BROADCAST_NAMES = 200_000


def registry(manifest: DataFrame) -> DataFrame:
    """entity_id, name, aliases: one entity per filer code, else per name key, with every spelling of the catalogue."""
    key = F.coalesce("corp_code", F.concat(F.lit("name:"), name_key(F.col("corp_name"))))
    names = F.array_compact(F.array("corp_name", "listed_name", "flr_nm"))
    one = manifest.select(key.alias("k"), "corp_name", F.explode(names).alias("alias")).where("k IS NOT NULL")
    out = one.groupBy("k").agg(F.min("corp_name").alias("name"), F.array_sort(F.collect_set("alias")).alias("aliases"))
    return out.select(F.concat(F.lit("ent_"), F.substring(F.sha1("k"), 1, 16)).alias("entity_id"), "name", "aliases")


def mentions(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """query_id, start, end, surface, entity_id: names in questions, the longest first, without overlaps. entities: registry().

    Both sides meet on the first characters of a name, in lower case. Up to BROADCAST_NAMES names go to the questions; the
    questions, of which every character is looked up, never pass through the driver.
    """
    alias = F.lower("alias")
    names = entities.select(F.explode("aliases").alias("alias"), "entity_id").select(alias.alias("alias"), "entity_id").where("length(alias) >= 2")
    # Of equal spellings of several entities the last one by id is meant.
    names = keep(names.groupBy("alias").agg(F.max("entity_id").alias("entity_id")).withColumn("probe", F.substring("alias", 1, PROBE)), "names")
    q = questions.where("query IS NOT NULL").select("query_id", "query", F.lower("query").alias("low")).where("length(low) > 0")
    at = F.explode(F.sequence(F.lit(1), F.length("low"))).alias("at")
    probes = q.select("query_id", "query", "low", at).withColumn("probe", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(2), F.lit(PROBE)), lambda n: F.substring(F.col("low"), F.col("at"), n)))))
    if names.count() <= BROADCAST_NAMES:
        found = probes.join(F.broadcast(names), "probe")
    else:
        # Hints, as Spark takes the characters for as few bytes as the questions; texts stay behind until names are found.
        met = probes.select("query_id", "at", "probe").join(names.hint("merge"), "probe").distinct()
        found = q.join(met.hint("merge"), q["query_id"].eqNullSafe(met["query_id"])).drop(met["query_id"])
    found = found.where(F.substring("low", F.col("at"), F.length("alias")) == F.col("alias"))
    # Latin names end at a word's end; after Korean names particles may follow.
    before, after = F.substring("low", F.greatest(F.col("at") - 1, F.lit(1)), F.when(F.col("at") > 1, 1).otherwise(0)), F.substring("low", F.col("at") + F.length("alias"), F.lit(1))
    latin = lambda c: c.rlike("^[a-z0-9]$")
    first, last = F.substring("alias", 1, 1), F.substring("alias", -1, 1)
    ascii_ = lambda c: F.ascii(c) < 128
    found = found.where(~((latin(before) & ascii_(first)) | (latin(after) & ascii_(last))))
    out = found.select("query_id", (F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.length("alias")).alias("end"), F.substring("query", F.col("at"), F.length("alias")).alias("surface"), "entity_id")
    # A match is dropped if a longer one, or an equally long earlier one, covers part of it; a question holds few matches.
    all_ = F.collect_list(F.struct("start", "end", "surface", "entity_id"))
    g = out.groupBy("query_id").agg(all_.alias("m"))
    size = lambda x: x["end"] - x["start"]
    covers = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"]) & ((size(a) > size(b)) | ((size(a) == size(b)) & (a["start"] < b["start"])))
    kept = F.filter("m", lambda x: ~F.exists("m", lambda y: covers(y, x)))
    return g.select("query_id", F.explode(kept).alias("x")).select("query_id", "x.*")


def masked(questions: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, masked: questions with their names replaced by [COMPANY], numbered if there are several."""
    w = Window.partitionBy("query_id")
    numbered = found.withColumns({"i": F.row_number().over(w.orderBy("start")), "n": F.count("*").over(w)})
    tag = F.when(F.col("n") > 1, F.concat(F.lit("[COMPANY_"), F.col("i").cast("string"), F.lit("]"))).otherwise("[COMPANY]")
    g = numbered.withColumn("tag", tag).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag"))).alias("m"))
    j = questions.join(g.hint("merge"), "query_id", "left")
    step = lambda acc, x: F.struct(F.concat(acc["t"], F.substring(F.col("query"), acc["p"] + 1, x["start"] - acc["p"]), x["tag"]).alias("t"), x["end"].alias("p"))
    folded = F.aggregate("m", F.struct(F.lit("").alias("t"), F.lit(0).alias("p")), step)
    text = F.concat(folded["t"], F.substring(F.col("query"), folded["p"] + 1, F.length("query")))
    return j.select("query_id", F.when(F.col("m").isNull(), F.col("query")).otherwise(text).alias("masked"))
