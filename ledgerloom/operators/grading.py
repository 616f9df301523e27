"""Grading of answers: tokens in any notation, written amounts, required items, open answers and gold questions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Scale words of written amounts, ordinals and counters that are no amounts, and words of yes, no and refusal.
SCALE = {"조": Decimal(10) ** 12, "억": Decimal(10) ** 8, "만": Decimal(10) ** 4, "천": Decimal(10) ** 3, "백만": Decimal(10) ** 6}
COUNTERS = ("년", "월", "일", "분기", "기", "차", "호", "건", "개", "명", "회", "위", "번")
YES, NO = ("예", "네", "있습니다", "있다", "존재합니다", "맞습니다", "yes"), ("아니", "없습니다", "없다", "존재하지 않", "아닙니다", "no,", "no.")
NOT_STATED = ("확인되지 않", "확인할 수 없", "기재되어 있지 않", "not stated", "not found")
#: How far after an item its value may stand.
REACH = 60
_AMOUNT = re.compile(r"(?<![\d.,])(?:\d[\d,]*(?:\.\d+)?\s*(?:백만|조|억|만|천)?\s*)+(?:원|주|%|퍼센트)?")
_PART = re.compile(r"(\d[\d,]*(?:\.\d+)?)\s*(백만|조|억|만|천)?")


def as_decimal(text: str | None) -> Decimal | None:
    try:
        return Decimal((text or "").replace(",", "").strip())
    except InvalidOperation:
        return None


def written_amounts(text: str) -> list[Decimal]:
    """Amounts a text states, scale words multiplied out; dates, ordinals and counted things are left out."""
    out = []
    for m in _AMOUNT.finditer(text):
        if text[m.end() :].lstrip().startswith(COUNTERS) and not m.group().rstrip().endswith(("원", "주", "%")):
            continue
        run, last = Decimal(0), None
        for n, word in _PART.findall(m.group()):
            value = Decimal(n.replace(",", "")) * SCALE.get(word, 1)
            if last is not None and SCALE.get(word, Decimal(1)) >= last:
                out.append(run)
                run = Decimal(0)
            run += value
            last = SCALE.get(word, Decimal(1))
        out.append(run)
    return out


def date_forms(token: str) -> list[str]:
    """Spellings of a yyyyMMdd date."""
    if not re.fullmatch(r"\d{8}", token):
        return [token]
    y, m, d = token[:4], token[4:6], token[6:]
    return [token, f"{y}-{m}-{d}", f"{y}.{m}.{d}", f"{y}년 {int(m)}월 {int(d)}일", f"{y}년 {m}월 {d}일", f"{y}.{int(m)}.{int(d)}"]


def token_present(token: str, answer: str) -> bool:
    """Whether an answer holds a token in any notation: a date form, an equal amount, or the text without spaces."""
    if re.fullmatch(r"\d{8}", token) and any(f in answer for f in date_forms(token)):
        return True
    number = as_decimal(token.rstrip("원주%"))
    if number is not None:
        return any(number == a for a in written_amounts(answer))
    bare = re.sub(r"\s+", "", token.lower())
    return bool(bare) and bare in re.sub(r"\s+", "", answer.lower())


def grade(answer: str, required_any: list[str] | None, required_all: list[str] | None, expected: str | None, kind: str) -> bool | None:
    """Whether an answer is right; null if there is nothing to grade by. Alternatives come before full lists, those before yes or no, comparison and value."""
    if required_any:
        return any(token_present(t, answer) for t in required_any)
    if required_all:
        return all(token_present(t, answer) for t in required_all)
    if not expected:
        return None
    low = answer.lower()
    if kind == "yes_no":
        no = any(w in low for w in NO)
        yes = not no and any(w in low for w in YES)
        return yes if expected.lower() in ("yes", "예") else no
    return token_present(expected, answer)


def _grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        lists = lambda v: list(v) if v is not None else None
        got = [grade(a or "", lists(x), lists(y), e, k or "") for a, x, y, e, k in zip(pdf["answer"], pdf["required_any"], pdf["required_all"], pdf["expected"], pdf["kind"], strict=True)]
        yield pd.DataFrame({"id": pdf["id"], "correct": pd.Series(got, dtype="boolean")})


def grades(answers: DataFrame) -> DataFrame:
    """id, correct. answers: id, answer, required_any, required_all (arrays), expected, kind."""
    return answers.select(F.col("id").cast("string"), "answer", "required_any", "required_all", "expected", "kind").mapInPandas(_grade, "id string, correct boolean")


def unit_stated(answer: Column) -> Column:
    """Whether the first amount of an answer carries a unit; null without an amount."""
    first = F.regexp_extract(answer, r"[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:백만|조|억|만|천)?\s*(?:원|주|%|퍼센트|kg|m2|won|percent)?", 0)
    return F.when(first == "", None).otherwise(first.rlike(r"(?:원|주|%|퍼센트|kg|m2|won|percent)$"))


def open_score(answers: DataFrame, items: DataFrame) -> DataFrame:
    """id, n_items, covered, acknowledged, silent: an item is covered if a value follows it within REACH characters of its line, acknowledged if the line says that it isn't stated.

    answers: id, answer; items: id, item.
    """
    j = answers.join(items, "id").withColumn("at", F.expr("instr(lower(answer), lower(item))"))
    tail = F.substring_index(F.expr(f"substring(answer, at + length(item), {REACH})"), "\n", 1)
    said = F.lit(False)
    for w in NOT_STATED:
        said = said | F.contains(F.lower(tail), F.lit(w))
    state = F.when(F.col("at") == 0, "silent").when(said, "acknowledged").when(tail.rlike(r"[0-9]|[:：]\s*\S"), "covered").otherwise("silent")
    n = lambda v: F.count_if(F.col("s") == v).alias(v)
    return j.withColumn("s", state).groupBy("id").agg(F.count("*").alias("n_items"), n("covered"), n("acknowledged"), n("silent"))


def citation_scores(cited: DataFrame, gold: DataFrame) -> DataFrame:
    """id, precision, recall of cited documents. cited and gold: id, doc_id."""
    c, g = cited.select("id", "doc_id").distinct(), gold.select("id", "doc_id").distinct().withColumn("g", F.lit(1))
    j = c.withColumn("c", F.lit(1)).join(g, ["id", "doc_id"], "full_outer").na.fill(0, ["c", "g"])
    hit = F.sum(F.col("c") * F.col("g"))
    return j.groupBy("id").agg(F.round(F.when(F.sum("c") > 0, hit / F.sum("c")).otherwise(0.0), 6).alias("precision"), F.round(F.when(F.sum("g") > 0, hit / F.sum("g")).otherwise(0.0), 6).alias("recall"))


# --- gold questions -----------------------------------------------------------


def gold_groups(facts: DataFrame, most_answers: int = 4, most_docs: int = 3) -> DataFrame:
    """company, key_norm, answers, docs: one question per company and item; items of too many answers go, and answers found in too many documents."""
    f = facts.where("value_text IS NOT NULL AND company IS NOT NULL AND key_norm IS NOT NULL").select("company", "key_norm", "value_text", "doc_id").distinct()
    spread = f.groupBy("company", "value_text").agg(F.count_distinct("doc_id").alias("n")).where(F.col("n") <= most_docs)
    kept = f.join(spread.drop("n"), ["company", "value_text"], "left_semi")
    n = kept.groupBy("company", "key_norm").agg(F.count_distinct("value_text").alias("n")).where(F.col("n") <= most_answers)
    return kept.join(n, ["company", "key_norm"]).groupBy("company", "key_norm").agg(F.array_sort(F.collect_set("value_text")).alias("answers"), F.array_sort(F.collect_set("doc_id")).alias("docs"))


def usable_answer(answer: Column) -> Column:
    """Gold tokens of 2 to 40 characters that aren't a bare year, a dash or a form word."""
    return F.length(F.trim(answer)).between(2, 40) & ~answer.rlike(r"^\s*(?:19|20)[0-9]{2}\s*$") & ~answer.rlike(r"^[\s\-–.…]*$") & ~answer.isin("해당없음", "해당사항 없음", "N/A", "not applicable", "omitted")


def suite(facts: DataFrame, per_company: int = 3, per_item: int = 20) -> DataFrame:
    """id, company, item, answer, doc_id: lookup questions with a unique usable answer, capped per company and item in the order of a hash."""
    g = gold_groups(facts).where("size(answers) = 1").select("company", "key_norm", F.get("answers", F.lit(0)).alias("answer"), F.get("docs", F.lit(0)).alias("doc_id"))
    g = g.where(usable_answer(F.col("answer"))).withColumn("id", F.md5(F.concat_ws("|", "company", "key_norm")))
    a = g.withColumn("i", F.row_number().over(Window.partitionBy("company").orderBy("id"))).where(F.col("i") <= per_company).drop("i")
    return a.withColumn("i", F.row_number().over(Window.partitionBy("key_norm").orderBy("id"))).where(F.col("i") <= per_item).drop("i").withColumnRenamed("key_norm", "item")


def audit_suite(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """n_rows, n_ids, reproduced, n_companies, n_items: structure and provenance of a suite; reproduced rows are still found among the facts."""
    found = facts.select("company", F.col("key_norm").alias("item"), F.col("value_text").alias("answer")).distinct().withColumn("ok", F.lit(1))
    j = rows.join(found, ["company", "item", "answer"], "left")
    return j.agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.count("ok").alias("reproduced"), F.count_distinct("company").alias("n_companies"), F.count_distinct("item").alias("n_items"))


def cross_entity(text: Column, answer: Column, company: Column, others: Column, reach: int = 1200) -> Column:
    """Whether the last company named within `reach` characters before an answer is another one than asked for. others: array of other names."""
    place = F.position(answer, text)
    before = F.substring(text, F.greatest(F.lit(1), place - reach), F.least(F.lit(reach), F.greatest(place - 1, F.lit(0))))
    # Where a name ends for the last time: counted from the end of the reversed text.
    end = lambda name: F.when(F.contains(before, name), F.length(before) - F.position(F.reverse(name), F.reverse(before)) + 1).otherwise(-1)
    foreign, own = F.array_max(F.transform(others, end)), end(company)
    return F.coalesce(foreign > own, F.lit(False))


def comparison_suite(pairs: DataFrame, per_item: int = 20) -> DataFrame:
    """id, field_code, company_a, company_b, answer: which of two companies states more, capped per item in the order of a hash. pairs: with winner; ties ask nothing."""
    g = pairs.where("winner <> 'tie'").withColumn("id", F.md5(F.concat_ws("|", "field_code", "company_a", "company_b")))
    w = Window.partitionBy("field_code").orderBy("id")
    return g.withColumn("i", F.row_number().over(w)).where(F.col("i") <= per_item).select("field_code", "company_a", "company_b", F.col("winner").alias("answer"), "id")


def correction_suite(pairs: DataFrame, per_chain: int = 3) -> DataFrame:
    """id, correction_group_id, field_code, before, after: what a correction changed, capped per chain in the order of a hash. pairs: versions.version_pairs()."""
    g = pairs.where("changed").withColumn("id", F.md5(F.concat_ws("|", "correction_group_id", "field_code")))
    w = Window.partitionBy("correction_group_id").orderBy("id")
    return g.withColumn("i", F.row_number().over(w)).where(F.col("i") <= per_chain).select("correction_group_id", "field_code", "before", "after", "id")


def reproduced(gold: DataFrame, facts: DataFrame) -> DataFrame:
    """company, key_norm, answer, reproduced: whether the facts still state every answer of gold_groups()."""
    now = facts.select("company", "key_norm", F.col("value_text").alias("answer")).distinct().withColumn("ok", F.lit(True))
    each = gold.select("company", "key_norm", F.explode("answers").alias("answer"))
    return each.join(now, ["company", "key_norm", "answer"], "left").select("company", "key_norm", "answer", F.coalesce("ok", F.lit(False)).alias("reproduced"))


#: From so many mentions in a text on an item needs a qualifier in its question.
MANY = 10
# What narrows a question down to one of several mentions.
QUALIFIER = r"[0-9]{4}|연결|별도|분기|반기|consolidated|separate"


def cleaning_verdict(question: Column, key: Column, text: Column, answer: Column, company: Column, others: Column) -> Column:
    """good, cross_entity (the value belongs to another company of the text) or ambiguous (the item occurs MANY times and the question doesn't say which)."""
    times = (F.length(text) - F.length(F.replace(text, key, F.lit("")))) / F.length(key)
    return F.when(cross_entity(text, answer, company, others), "cross_entity").when((times >= MANY) & ~question.rlike(QUALIFIER), "ambiguous").otherwise("good")


def shared_terms(names: DataFrame) -> DataFrame:
    """term, n: common beginnings of six letters or more of pairs of kind names without a bracket. names: name (a short list of kinds)."""
    a, b = names.select(F.col("name").alias("a")).distinct(), names.select(F.col("name").alias("b")).distinct()
    # Only names that share their first six letters meet.
    j = a.withColumn("k", F.substring("a", 1, 6)).join(b.withColumn("k", F.substring("b", 1, 6)), "k").where("a < b")
    same = F.filter(F.sequence(F.lit(1), F.least(F.length("a"), F.length("b"))), lambda i: F.substring(F.col("a"), F.lit(1), i) == F.substring(F.col("b"), F.lit(1), i))
    term = F.rtrim(F.substring("a", F.lit(1), F.array_max(same)))
    return j.select(term.alias("term")).where("length(term) >= 6 AND NOT contains(term, '(')").groupBy("term").agg(F.count("*").alias("n"))
