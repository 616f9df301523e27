"""Problem 1: texts that look the same but differ in their characters.

Distinct values are mapped to a look-alike skeleton, grouped under Spark's accent-sensitive UNICODE collation (which
also equates composed and decomposed letters and ignores zero-width characters), and every class gets one canonical
member, which is joined back.

Defined cases: null stays null and is never reported; the empty text is plain; ties between plain members are broken
by length, then code points; repeated rows are each reported; an empty table gives an empty result; other columns of
the table, whatever their names, are not touched except by unified(), which replaces the named columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import FOREIGN, SUSPICIOUS, compose, fold_width, lookalikes_to_latin, plain
from ledgerloom.session import keep

#: A disguised value is hot from so many rows, and from so small a part of all disguised rows, on: at most a thousand are.
HOT_ROWS, HOT_PART = 100_000, 1000
CLASSES = """
    SELECT ll_field, ll_skeleton COLLATE UNICODE AS ll_class,
           min_by(ll_value, struct(ll_rank, length(ll_value), ll_value)) AS ll_member, min(ll_rank) AS ll_rank
    FROM {members} GROUP BY ll_field, ll_skeleton COLLATE UNICODE
"""
CANONICAL = """
    SELECT m.ll_field, m.ll_value, c.ll_member, c.ll_rank AS ll_best
           , m.ll_n
    FROM {members} m JOIN {classes} c ON m.ll_field = c.ll_field AND m.ll_skeleton COLLATE UNICODE = c.ll_class
    WHERE m.ll_rank > 0
"""


def _values(df: DataFrame, columns: list[str], *carry: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("string").alias("v")) for c in columns])).alias("p")
    return df.select(*carry, pairs).where("p.v IS NOT NULL").select(*carry, F.col("p.f").alias("ll_field"), F.col("p.v").alias("ll_value"))


def canonical_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """ll_field, ll_value, ll_canonical and ll_n, its rows, for every distinct value that isn't plain itself.

    Rank of a member: 0 plain; 1 letters of one other script that all have Latin twins (plain unless a Latin plain
    spelling of the same class exists); 2 disguised. The canonical member is the best rank's shortest, then smallest;
    a class without a plain member gets its plain spelling built from that member.
    """
    spark = df.sparkSession
    v = F.col("ll_value")
    odd = F.regexp_replace(v, "[\\p{IsCyrillic}\\p{IsGreek}]", "").rlike(SUSPICIOUS) | (compose(v) != v)
    other = v.rlike("[\\p{IsCyrillic}\\p{IsGreek}]")
    latin = v.rlike("\\p{IsLatin}")
    foreign = v.rlike(FOREIGN)
    rank = (
        F.when(~v.rlike(SUSPICIOUS), 0)
        .when(odd, 2)
        .when(other & latin, 2)
        .when(other & v.rlike("\\p{IsCyrillic}") & v.rlike("\\p{IsGreek}"), 2)
        .when(other & ~foreign & v.rlike("\\p{IsHangul}"), 2)
        .when(other & ~foreign, 1)
        .otherwise(0)
    )
    members = (
        _values(df, columns)
        .groupBy("ll_field", "ll_value")
        .agg(F.count("*").alias("ll_n"))
        .select("ll_field", "ll_value", "ll_n", rank.alias("ll_rank"), F.when(v.rlike(SUSPICIOUS), lookalikes_to_latin(fold_width(v))).otherwise(v).alias("ll_skeleton"))
    )
    classes = spark.sql(CLASSES, members=members)
    joined = spark.sql(CANONICAL, members=members, classes=classes)
    built = F.when(F.col("ll_best") < 2, F.col("ll_member")).otherwise(plain(F.col("ll_member")))
    return joined.select("ll_field", "ll_value", built.alias("ll_canonical"), "ll_n").where("ll_value <> ll_canonical")


def _cases(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The cases, and those of them that stand in so many rows that these must not meet in one task."""
    cases = keep(canonical_values(df, columns), "cases")
    total = cases.agg(F.sum("ll_n")).first()[0] or 0
    hot = cases.where(F.col("ll_n") >= max(HOT_ROWS, total // HOT_PART)).collect()
    return cases, df.sparkSession.createDataFrame(hot, cases.schema) if hot else None


def disguised(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, field for every stored value that looks like a plain spelling but isn't the same characters."""
    cases, hot = _cases(df, columns)
    rows, by = _values(df, columns, key).where(F.col("ll_value").rlike(SUSPICIOUS)), ["ll_field", "ll_value"]
    if hot is None:
        found = rows.join(cases, by, "left_semi")
    else:
        often = F.broadcast(hot)
        found = rows.join(often, by, "left_semi").unionByName(rows.join(often, by, "left_anti").join(cases, by, "left_semi"))
    return found.select(key, F.col("ll_field").alias("field"))


def unified(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the named columns in one consistent spelling; all rows and all other columns stay."""
    cases, hot = _cases(df, columns)
    for c in columns:
        of = lambda d, c=c: d.where(F.col("ll_field") == c).select(F.col("ll_value").alias("__unify_from"), F.col("ll_canonical").alias("__unify_to"))
        # Plain values carry no join key: they can't be disguised, and a frequent one doesn't skew the join.
        v = F.col(c).cast("string")
        keyed = df.withColumn("__unify_key", F.when(v.rlike(SUSPICIOUS), v))
        hit, same = keyed.where("__unify_key IS NOT NULL"), F.col("__unify_key") == F.col("__unify_from")
        if hot is None:
            hit = hit.join(of(cases), same, "left")
        else:
            often = F.broadcast(of(hot))
            hit = hit.join(often, same).unionByName(hit.join(often, same, "left_anti").join(of(cases), same, "left"))
        hit = hit.withColumn(c, F.coalesce("__unify_to", c)).drop("__unify_key", "__unify_from", "__unify_to")
        df = keyed.where("__unify_key IS NULL").drop("__unify_key").unionByName(hit)
    return df
