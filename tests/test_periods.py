import random

import pytest
from pyspark.sql import functions as F

from strandline.operators.periods import periods_and_gaps, whole_ms


def brute(rows):
    by = {}
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    out = set()
    for k, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(k, "period", s, e) for s, e in merged}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_intervals_across_partitions(spark, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(300):
        k = r.choice([1, 1, 1, 2, 3, None])  # one hot entity over several partitions
        s = r.randrange(4000)
        rows.append((k, r.choice([s, s, s, None]), s + r.choice([-3, 0, 1, 5, 30, 400])))
    rows += rows[:40]
    df = spark.createDataFrame(rows, "k bigint, s bigint, e bigint").withColumn("kind", F.lit("clash")).withColumn("start_ms", F.lit(7))
    got = [tuple(x) for x in periods_and_gaps(df, ["k"], "s", "e").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_one_long_period_over_all_partitions(spark):
    rows = [(5, 0, 100_000)] + [(5, i * 10, i * 10 + 5) for i in range(500)] + [(6, 1, 2)]
    got = {tuple(x) for x in periods_and_gaps(spark.createDataFrame(rows, "k bigint, s bigint, e bigint"), ["k"], "s", "e").collect()}
    assert got == {(5, "period", 0, 100_000), (6, "period", 1, 2)}


def test_two_column_entity_and_empty(spark):
    rows = [("a", 1, 0, 5), ("a", 2, 5, 9), ("a", 1, 5, 7), ("b", 1, 0, 1), ("b", 1, 3, 4)]
    df = spark.createDataFrame(rows, "o string, k bigint, s bigint, e bigint")
    got = {tuple(x) for x in periods_and_gaps(df, ["o", "k"], "s", "e").collect()}
    assert got == {("a", 1, "period", 0, 7), ("a", 2, "period", 5, 9), ("b", 1, "period", 0, 1), ("b", 1, "period", 3, 4), ("b", 1, "gap", 1, 3)}
    assert periods_and_gaps(df.limit(0), ["o", "k"], "s", "e").collect() == []


def test_whole_ms(spark):
    rows = [(1.2344,), (None,), (float("nan"),), (float("inf"),), (1e300,), (-0.0006,)]
    got = [x[0] for x in spark.createDataFrame(rows, "t double").select(whole_ms(F.col("t"))).collect()]
    assert got == [1234, None, None, None, None, -1]
