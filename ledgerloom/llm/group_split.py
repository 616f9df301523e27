"""Problem 2: splits that keep related records together.

Every input partition builds a local union-find forest over its rows and link values; forests of several partitions
are merged level by level, each task holding at most `edges_per_task` edges; where a level no longer shrinks, exact
large-star / small-star rounds finish the job without ever holding a component in one task. Groups are then assigned
largest first to the split furthest below its target. Equal sizes are interchangeable, so only the histogram of sizes
(at most sqrt(2 n) entries) reaches the driver.

Defined cases: a null link value links nothing; the empty string is a value like any other; repeated rows share their
values, hence their group; equal ids with different values are one record; a row without links is its own group; ties
in size are broken by group id; an empty table gives an empty result; other columns are ignored, so they can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import keep

#: 16-byte edges one task holds while it merges forests: about 200 MB with its working arrays.
EDGES_PER_TASK = 2_000_000
#: Rows of a mapping (two longs each) that may be broadcast.
BROADCAST_ROWS = 500_000
SALTS = 16


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component for the edges a-b over nodes 0..n-1: union by hooking, with path compression."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _local(ids: np.ndarray, values: list[pd.Series]) -> pd.DataFrame:
    """The forest of one partition: per row its root, per link value the root of its component; a root is the smallest id."""
    uniq, at = np.unique(ids, return_inverse=True)
    n, ea, eb, nodes = len(uniq), [], [], []
    for kind, s in enumerate(values):
        code, keys = pd.factorize(s)
        has = code >= 0
        ea.append(at[has])
        eb.append(code[has] + n)
        nodes.append((kind, keys, n))
        n += len(keys)
    root = forest(n, np.concatenate(ea), np.concatenate(eb))
    # Ids come first and sorted, so the smallest node of a component is its smallest id.
    out = [pd.DataFrame({"kind": -1, "key": None, "id": uniq, "root": uniq[root[: len(uniq)]]})]
    for kind, keys, start in nodes:
        out.append(pd.DataFrame({"kind": kind, "key": keys, "id": None, "root": uniq[root[start : start + len(keys)]]}))
    return pd.concat([o for o in out if len(o)], ignore_index=True).astype({"id": "Int64"}) if len(uniq) else pd.DataFrame(columns=["kind", "key", "id", "root"])


def _local_forests(id_: str, links: list[str]):
    def run(batches):
        parts = [b for b in batches if len(b)]
        if parts:
            pdf = pd.concat(parts, ignore_index=True)
            yield _local(pdf["ll_id"].to_numpy(dtype="int64"), [pdf[f"ll_{i}"] for i in range(len(links))])

    return run


def _merge(batches):
    parts = [b for b in batches if len(b)]
    if parts:
        pdf = pd.concat(parts, ignore_index=True)
        uniq, at = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
        root = uniq[forest(len(uniq), at[: len(pdf)], at[len(pdf) :])]
        yield pd.DataFrame({"a": uniq, "b": root})[uniq != root]


def stars(edges: DataFrame) -> DataFrame:
    """a, b with b the smallest node of a's component: alternating large-star and small-star rounds, nothing per component in memory."""

    def star(pairs: DataFrame, both: bool) -> DataFrame:
        # pairs u, v; every u's smallest neighbour m, then v -> m.
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = pairs.join(low, "u")
        if both:
            out = out.where("v > u")
        return out.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")

    edges = keep(edges.where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.selectExpr("a AS u", "b AS v").union(edges.selectExpr("b AS u", "a AS v"))
        large = star(both, True).union(both.groupBy("u").agg(F.min("v").alias("b")).where("b < u").select(F.col("u").alias("a"), "b")).distinct()
        down = large.selectExpr("greatest(a, b) AS u", "least(a, b) AS v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").selectExpr("v AS a", "m AS b").union(low.selectExpr("u AS a", "m AS b")).distinct()
        edges = keep(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges
        before = now


def merged(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """a, b: every linked node but the smallest of its component, with that smallest node."""
    edges = keep(edges, "edges")
    n = edges.count()
    tasks = math.ceil(n / edges_per_task)
    while tasks > 1:
        edges = keep(edges.repartition(tasks).mapInPandas(_merge, "a long, b long"), "edges")
        n, fewer = edges.count(), 0
        fewer = math.ceil(n / edges_per_task)
        if fewer >= tasks:
            return stars(edges)
        tasks = fewer
    return edges.coalesce(1).mapInPandas(_merge, "a long, b long")


def groups(df: DataFrame, id_: str, links: list[str], edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """id, group_id: every record with the smallest id it is connected to by equal non-null link values, directly or through others."""
    narrow = df.select(F.col(id_).cast("long").alias("ll_id"), *[F.col(c).cast("string").alias(f"ll_{i}") for i, c in enumerate(links)])
    schema = "kind int, key string, id long, root long"
    local = keep(narrow.mapInPandas(_local_forests(id_, links), schema), "forest")
    keys = local.where("kind >= 0").select("kind", "key", "root")
    # A link value of one local component only is finished; the others tie components together. So does an id seen in two partitions.
    ids = local.where("kind < 0").select(F.lit(-1).alias("kind"), F.col("id").cast("string").alias("key"), "root")
    held = keys.union(ids)
    low = held.groupBy("kind", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").drop("high")
    edges = held.join(low, ["kind", "key"]).where("root <> low").select(F.col("root").alias("a"), F.col("low").alias("b")).distinct()
    up = keep(merged(edges, edges_per_task), "roots")
    rows = local.where("kind < 0").select("id", "root")
    if up.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(up), F.col("root") == F.col("a"), "left")
    else:  # a root may stand for a third of all rows
        salted = up.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        joined = rows.withColumn("s", F.pmod(F.col("id"), F.lit(SALTS)).cast("int")).join(salted, (F.col("root") == F.col("a")) & (F.col("s") == F.col("salt")), "left")
    out = joined.select(F.col("id").alias(id_), F.coalesce("b", "root").alias("group_id"))
    return out.groupBy(id_).agg(F.min("group_id").alias("group_id"))


def greedy_run(deficit: list[float], size: int, count: int) -> list[int]:
    """How many of `count` groups of one size go to each split when each goes to the split furthest below its target (first one on ties)."""
    given = [0] * len(deficit)
    if count > 4096:
        low, high = min(deficit) - size * count, max(deficit)
        for _ in range(200):  # the level that the splits are filled up to
            level = (low + high) / 2
            if sum(max(0, math.floor((d - level) / size)) for d in deficit) > count - len(deficit):
                low = level
            else:
                high = level
        given = [max(0, math.floor((d - high) / size)) for d in deficit]
    left = [d - g * size for d, g in zip(deficit, given, strict=True)]
    for _ in range(count - sum(given)):
        j = max(range(len(left)), key=lambda i: left[i])
        left[j] -= size
        given[j] += 1
    return given


def splits(grouped: DataFrame, id_: str, targets: dict[str, float]) -> DataFrame:
    """id, group_id, split for the rows of groups(): groups largest first, each to the split furthest below its target."""
    spark = grouped.sparkSession
    grouped = keep(grouped, "grouped")
    sizes = grouped.groupBy("group_id").agg(F.count("*").alias("size"))
    ranked = keep(sizes.orderBy(F.desc("size"), "group_id").withColumn("at", F.monotonically_increasing_id()), "ranked")
    # The id's upper part is the sorted partition, the lower part the place in it: a global rank without one task for all.
    counts = sorted((r[0], r[1]) for r in ranked.groupBy(F.shiftright("at", 33).alias("p")).count().collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    histogram = sorted(((r[0], r[1]) for r in ranked.groupBy("size").count().collect()), reverse=True)
    rows = sum(s * n for s, n in histogram)
    names, deficit, runs, at = list(targets), [t * rows for t in targets.values()], [], 0
    for size, n in histogram:
        given = greedy_run(deficit, size, n)
        deficit = [d - g * size for d, g in zip(deficit, given, strict=True)]
        ends = np.cumsum(given) + at
        runs.append((size, [int(e) for e in ends]))
        at += n
    start = spark.createDataFrame(starts, "p long, start long")
    run = spark.createDataFrame(runs, "size long, ends array<long>")
    place = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    chosen = F.element_at(F.array(*[F.lit(n) for n in names]), F.size(F.filter("ends", lambda e: e <= place)) + 1)
    of = ranked.join(F.broadcast(start), F.shiftright("at", 33) == F.col("p")).join(F.broadcast(run), "size").select("group_id", chosen.alias("split"))
    # One group may hold a third of all rows: AQE splits it, and a small table of groups is broadcast.
    of = F.broadcast(keep(of, "split")) if total <= BROADCAST_ROWS else keep(of, "split")
    return grouped.join(of, "group_id").select(id_, "group_id", "split")
