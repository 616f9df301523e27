"""Writers: snapshots with their manifest, upserts, resumable batches and result tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_snapshot(tables: dict[str, DataFrame], path: str, partition: dict[str, str] | None = None) -> None:
    """Every table as parquet below path, partitioned where asked; columns without any value are kept as they are declared."""
    for name, df in tables.items():
        w = df.write.mode("overwrite").option("compression", "zstd")
        if partition and name in partition:
            w = w.partitionBy(partition[name])
        w.parquet(f"{path}/{name}")


def chunk_manifest(chunks: DataFrame, group: str) -> DataFrame:
    """Per group and in total: leaves, documents, mean length and share of every content type. chunks: report_id, content_type, text."""
    n = F.count("*")
    return chunks.rollup(group).agg(n.alias("n_leaves"), F.count_distinct("report_id").alias("n_docs"), F.round(F.avg(F.length("text")), 4).alias("mean_length")).withColumn(group, F.coalesce(group, F.lit("all")))


def facts_manifest(facts: DataFrame) -> DataFrame:
    """Percent of facts that are linked, numeric and dated."""
    pct = lambda c: F.round(100 * F.count(c) / F.count("*"), 4)
    return facts.agg(F.count("*").alias("n_facts"), pct("chunk_id").alias("linked"), pct("value_num").alias("numeric"), pct("value_date").alias("dated"))


def point_id(c: Column) -> Column:
    """A stable identifier in the form of a UUID for a chunk id."""
    h = F.sha1(c)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """old and new with one row per key: the greatest version, the new row on ties."""
    both = old.withColumn("ll_new", F.lit(0)).unionByName(new.withColumn("ll_new", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c != "ll_new"]
    best = both.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(version, "ll_new")).alias("r"))
    return best.select("r.*")


def pending(wanted: DataFrame, done: DataFrame, key: str, content: str, failed: str) -> DataFrame:
    """Rows still to do: not done, done with other content, or failed."""
    good = done.where(~F.coalesce(F.col(failed), F.lit(False))).select(key, content)
    return wanted.join(good, [key, content], "left_anti")


def write_named(rows: DataFrame, path: str, name: str) -> None:
    """A small lookup table (registry, schema, offsets) as JSON lines below path, one object a row; written beside and then renamed, so readers see the old table or the new one."""
    spark = rows.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    done, part = fs_path(f"{path}/{name}"), fs_path(f"{path}/.{name}.part")
    rows.write.mode("overwrite").json(str(part))
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(done, True)
    if not fs.rename(part, done):
        raise OSError(f"{part} can't be renamed")


def resume(wanted: DataFrame, key: str, content: str, failed: str, path: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs work on the rows that a checkpoint at path doesn't hold yet, adds its results to the checkpoint and returns all of them.

    A row is done if its key is there with the same content and without failure. Every run appends its own files, whose
    commit is atomic; of several results of a key the last good one counts.
    """
    spark = wanted.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = spark.read.parquet(path) if fs.exists(at) else None
    todo = wanted if done is None else pending(wanted, done, key, content, failed)
    run = 0 if done is None else (done.agg(F.max("ll_run")).first()[0] or 0) + 1
    work(todo).withColumn("ll_run", F.lit(run)).write.mode("append").parquet(path)
    all_ = spark.read.parquet(path)
    good = ~F.coalesce(F.col(failed), F.lit(False))
    best = all_.groupBy(key).agg(F.max_by(F.struct(*[c for c in all_.columns if c != "ll_run"]), F.struct(good, "ll_run")).alias("r"))
    return best.select("r.*").join(wanted.select(key, content), [key, content], "left_semi")


def check_index(index: DataFrame, chunks: DataFrame, id_: str = "id") -> None:
    """Raises if an index names a chunk that doesn't exist."""
    bad = index.join(chunks.select(F.col("chunk_id").alias(id_)), id_, "left_anti").select(id_).take(1)
    if bad:
        raise ValueError(f"the index names an unknown chunk: {bad[0][0]!r}")


def write_results(results: list[DataFrame], path: str, config: dict) -> None:
    """Result rows of several runs under one header, failures apart, and the configuration as JSON."""
    both = results[0]
    for r in results[1:]:
        both = both.unionByName(r, allowMissingColumns=True)
    both.write.mode("overwrite").option("header", True).csv(f"{path}/results")
    if "label" in both.columns:
        both.where("label <> 'correct'").write.mode("overwrite").json(f"{path}/failures")
    spark = both.sparkSession
    spark.createDataFrame([(json.dumps(config, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")
