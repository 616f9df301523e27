"""Evaluation: rank metrics, answer and abstention scores, attribution, router reports, samples and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ranking import picks, ranks


def distributed_quantiles(df: DataFrame, value: str, ps: list[float]) -> DataFrame:
    """p, value: sorted[int(n * p)] over a whole table, without interpolation and without sorting it in one task."""
    one = df.select(F.lit(1).alias("ll_all"), value)
    got = picks(one, ["ll_all"], value, {f"q{i}": F.floor(F.col("n") * F.lit(float(p))) for i, p in enumerate(ps)})
    return got.select(F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(f"q{i}").alias("value")) for i, p in enumerate(ps)])).alias("x")).select("x.p", "x.value")


def rank_metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per query: recall, mrr, ndcg, hit, precision and ap at k, and the first relevant rank.

    ranked: query_id, doc, rank; gold: query_id, doc. Recall, NDCG and AP count a document once, at its first chunk;
    precision counts chunks and divides by the rows there are. A query without gold scores 0.
    """
    g = gold.select("query_id", "doc").distinct().withColumn("rel", F.lit(1))
    n_gold = g.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    r = ranked.where(F.col("rank") <= k).select("query_id", "doc", "rank").join(g, ["query_id", "doc"], "left")
    again = Window.partitionBy("query_id", "doc").orderBy("rank")
    r = r.withColumns({"rel": F.coalesce("rel", F.lit(0)), "first": F.row_number().over(again) == 1})
    r = r.withColumn("new", F.when(F.col("first"), F.col("rel")).otherwise(0))
    seen = F.sum("new").over(Window.partitionBy("query_id").orderBy("rank"))
    r = r.withColumn("seen", seen)
    per = r.groupBy("query_id").agg(
        F.sum("new").alias("found"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_rank"), F.avg("rel").alias("precision"),
        F.sum(F.when(F.col("new") == 1, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("new") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("ap"),
    )
    out = per.join(n_gold, "query_id", "left").withColumn("n_gold", F.coalesce("n_gold", F.lit(0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n_gold", F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    some = F.col("n_gold") > 0
    safe = lambda c: F.round(F.when(some, c).otherwise(0.0), 6)
    return out.select(
        "query_id", safe(F.col("found") / F.col("n_gold")).alias("recall"), safe(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr"), safe(F.col("dcg") / ideal).alias("ndcg"),
        F.when(F.col("found") > 0, 1).otherwise(0).alias("hit"), F.round("precision", 6).alias("precision"), safe(F.col("ap") / F.least("n_gold", F.lit(k))).alias("ap"), "first_rank",
    )


def passage_metrics(ranked: DataFrame, answers: DataFrame, k: int) -> DataFrame:
    """Per query: hit, first rank and NDCG where a chunk is relevant if it contains an answer; the ideal order is that of the flags found.

    ranked: query_id, rank, text; answers: query_id, answers array.
    """
    r = ranked.where(F.col("rank") <= k).join(answers, "query_id")
    r = r.withColumn("rel", F.when(F.exists("answers", lambda a: F.contains(F.col("text"), a)), 1).otherwise(0))
    n = F.sum("rel")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    dcg = F.sum(F.when(F.col("rel") == 1, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    return r.groupBy("query_id").agg(F.max("rel").alias("hit"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_rank"), F.round(F.when(n > 0, dcg / ideal).otherwise(0.0), 6).alias("ndcg"))


def stratified_sample(df: DataFrame, group: str, id_: str, n: int, seed: str = "1") -> DataFrame:
    """About n rows, every group its rounded share but at least one, in the order of a hash of seed and id."""
    total = df.agg(F.count("*").alias("total"))
    sizes = df.groupBy(group).agg(F.count("*").alias("size")).crossJoin(F.broadcast(total)).withColumn("quota", F.greatest(F.lit(1), F.bround(F.col("size") / F.col("total") * n, 0).cast("int"))).select(group, "quota")
    ordered = ranks(df.withColumn("ll_hash", F.md5(F.concat(F.lit(seed), F.col(id_).cast("string")))), [group], [F.col("ll_hash"), F.col(id_)], "ll_rank")
    return ordered.join(sizes, group).where("ll_rank <= quota").drop("ll_hash", "ll_rank", "quota")


def run_summary(runs: DataFrame) -> DataFrame:
    """Per doc_group and in total: questions, gradeable ones, accuracy, mean, p95 and median seconds. runs: doc_group, label, seconds, gradeable."""
    ok = F.when(F.col("gradeable"), F.when(F.col("label") == "correct", 1.0).otherwise(0.0))
    both = runs.union(runs.withColumn("doc_group", F.lit("all")))
    means = both.groupBy("doc_group").agg(F.count("*").alias("n_rows"), F.count_if("gradeable").alias("n_gradeable"), F.round(F.avg(ok), 6).alias("accuracy"), F.round(F.avg("seconds"), 6).alias("mean"))
    n = F.col("n")
    at = picks(both, ["doc_group"], "seconds", {"p95": F.greatest(F.floor(n * 0.95) - 1, F.lit(0)), "median": F.floor(n / 2)})
    return means.join(at.drop("n"), "doc_group").withColumnRenamed("n_rows", "n")


def answer_label(gradeable: Column, correct: Column, refused: Column, evidence: Column) -> Column:
    """Correct, or what failed: retrieval (no evidence), refusal with or without evidence, or the answer."""
    return F.when(~gradeable, "ungradeable").when(correct, "correct").when(refused & evidence, "refused_with_evidence").when(refused, "refused_without_evidence").when(~evidence, "retrieval_failure").otherwise("answer_failure")


#: Actions that count as not answering.
ABSTAINING = ["refuse", "clarify", "abstain", "abstain_in_body"]


def abstention_score(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per reason: questions, abstained, exact action, missing predictions. A missing prediction is a failure. gold: id, reason, expected_action; predictions: id, action."""
    j = gold.join(predictions.select("id", "action"), "id", "left")
    did, should = F.col("action").isin(ABSTAINING), F.col("expected_action").isin(ABSTAINING)
    right = F.coalesce(did == should, F.lit(False))
    exact = F.col("action").eqNullSafe(F.col("expected_action"))
    return j.groupBy("reason").agg(F.count("*").alias("n"), F.count_if(right).alias("right"), F.count_if(exact).alias("exact"), F.count_if(F.col("action").isNull()).alias("missing"), F.round(F.avg(right.cast("int")), 6).alias("accuracy"), F.count_if(~should & F.coalesce(did, F.lit(False))).alias("false_refusals"))


def attribution(wanted: DataFrame, cited: DataFrame) -> DataFrame:
    """Per question: coverage of the companies asked for, foreign companies cited, and whether it is clean. wanted and cited: query_id, companies array."""
    j = wanted.select("query_id", F.array_distinct("companies").alias("w")).join(cited.select("query_id", F.array_distinct("companies").alias("c")), "query_id", "left")
    c = F.coalesce("c", F.array().cast("array<string>"))
    hit, foreign = F.size(F.array_intersect("w", c)), F.size(F.array_except(c, F.col("w")))
    return j.select("query_id", F.round(F.when(F.size("w") > 0, hit / F.size("w")).otherwise(0.0), 6).alias("coverage"), foreign.alias("n_foreign"), ((foreign == 0) & (hit == F.size("w"))).alias("clean"))


def confusion(df: DataFrame, truth: str, guess: str, labels: list[str]) -> DataFrame:
    """One row per true label, one column per guessed label."""
    return df.groupBy(F.col(truth).alias("truth")).pivot(guess, labels).agg(F.count(F.lit(1))).na.fill(0)


def f1_by_label(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """label, precision, recall, f1; the macro F1 is their mean."""
    t = df.groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("n_true"), F.count_if(F.col(truth) == F.col(guess)).alias("tp"))
    g = df.groupBy(F.col(guess).alias("label")).agg(F.count("*").alias("n_guess"))
    j = t.join(g, "label", "full_outer").na.fill(0)
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = div(F.col("tp"), F.col("n_guess")), div(F.col("tp"), F.col("n_true"))
    return j.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(div(2 * p * r, p + r), 6).alias("f1"))


def hard_negative_type(df: DataFrame) -> Column:
    """The type of a negative, the first that holds: same company in another year or kind, same period of another company, and so on."""
    same_c = F.coalesce(F.col("company") == F.col("gold_company"), F.lit(False))
    same_p = F.coalesce(F.col("period") == F.col("gold_period"), F.lit(False))
    same_r = F.coalesce(F.col("report_id") == F.col("gold_report"), F.lit(False))
    return F.when(same_r, "diff_section").when(same_c & same_p, "same_company_same_period").when(same_c & F.col("period").isNotNull() & F.col("gold_period").isNotNull(), "same_company_diff_year").when(same_c, "same_company").when(same_p, "same_period_diff_company").otherwise("easy")


def hard_negatives(df: DataFrame, per_type: int = 8, easy: int = 2) -> DataFrame:
    """Negatives of every query taken from its types in turn, at most per_type of a type and `easy` easy ones. df: query_id, id, type."""
    w = Window.partitionBy("query_id", "type").orderBy("id")
    d = df.withColumn("n", F.row_number().over(w)).where(F.col("n") <= F.when(F.col("type") == "easy", easy).otherwise(per_type))
    return d.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("n", "type"))).drop("n")


def hash_split(id_: Column) -> Column:
    """train, validation or test by a hash of the id: 70, 15 and 15 of 100."""
    bucket = F.conv(F.substring(F.md5(id_), 1, 6), 16, 10).cast("int") % 100
    return F.when(bucket < 70, "train").when(bucket < 85, "validation").otherwise("test")
