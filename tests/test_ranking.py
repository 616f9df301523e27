import random

from pyspark.sql import functions as F

from ledgerloom.operators.ranking import picks, ranks


def rows(n=500):
    r = random.Random(3)
    return [(i, r.choice(["hot", "hot", "hot", "a", "b", None]), r.randrange(20) if r.random() > 0.1 else None) for i in range(n)]


def test_ranks_equal_a_sort(spark):
    data = rows()
    df = spark.createDataFrame(data, "id int, g string, v int").repartition(5)
    got = {r.id: r.rank for r in ranks(df, ["g"], [F.desc_nulls_last("v"), F.col("id")]).collect()}
    want = {}
    for g in {x[1] for x in data}:
        own = sorted((x for x in data if x[1] == g), key=lambda x: (x[2] is None, -(x[2] or 0), x[0]))
        want |= {x[0]: i for i, x in enumerate(own, 1)}
    assert got == want and ranks(df.limit(0), ["g"], [F.col("id")]).count() == 0


def test_picks_equal_a_sort(spark):
    data = rows()
    df = spark.createDataFrame(data, "id int, g string, v int").repartition(5)
    n = F.col("n")
    got = {r.g: (r.n, r.first, r.middle, r.last, r.none) for r in picks(df, ["g"], "v", {"first": n * 0, "middle": F.floor(n / 2), "last": n - 1, "none": n}).collect()}
    for g in {x[1] for x in data}:
        own = sorted(x[2] for x in data if x[1] == g and x[2] is not None)
        assert got[g] == (len(own), own[0], own[len(own) // 2], own[-1], None)
