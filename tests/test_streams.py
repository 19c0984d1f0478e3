import pytest
from pyspark.sql import functions as F

from strandline.streaming import streams as S


@pytest.fixture
def growing(spark, tmp_path):
    at = tmp_path / "events.parquet"
    for i in range(4):
        rows = [(i * 10 + j, j % 2, 1_000_000 * (1000 + i * 100 + j * 3)) for j in range(10)]
        spark.createDataFrame(rows, "id bigint, k bigint, us bigint").select("id", "k", F.timestamp_micros("us").alias("ts")).coalesce(1).write.mode("append").parquet(str(at))
    return str(tmp_path)


def test_stream_equals_batch(spark, growing):
    got = {tuple(x) for x in S.latest(S.owned_counts(S.table_stream(spark, growing, "events"), key="k", time="ts", size="50 seconds", delay="1 day"), ["k", "start"]).collect()}
    batch = spark.read.parquet(f"{growing}/events.parquet").groupBy("k", F.window("ts", "50 seconds").alias("w")).count()
    assert got == {(x.k, x.w.start, x["count"]) for x in batch.collect()}


def test_entity_outlives_a_batch(spark, growing):
    run = lambda lifetime: S.latest(S.entities(S.table_stream(spark, growing, "events"), key="k", time="ts", row="id", lifetime=lifetime, delay="1 hour"), ["id"], "append")
    assert run(80_000_000).select("k", "entity").distinct().count() == 2
    got = run(20_000_000).select("k", "entity").distinct().collect()
    assert len(got) == 8 and {x.entity for x in got if x.k == 0} == {(10 + i) * 100_000_000 for i in range(4)}


def test_a_late_row_does_not_move_the_clock_back(spark, tmp_path):
    # 50 comes after 100: the entity still lives at 140
    for us in ([100], [50], [140]):
        spark.createDataFrame([(x, 1, x * 1_000_000) for x in us], "id bigint, k bigint, us bigint").select("id", "k", F.timestamp_micros("us").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = S.table_stream(spark, str(tmp_path), "events")
    got = {x.id: x.entity for x in S.latest(S.entities(stream, key="k", time="ts", row="id", lifetime=60_000_000, delay="1 hour"), ["id"], "append").collect()}
    assert got == {100: 100_000_000, 50: 100_000_000, 140: 100_000_000}


def test_late_and_repeated_batches_count_once(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("k"), F.timestamp_micros(1_000_000_000 + F.col("id") * 7_000_000).alias("ts"))
    stream, delay = S.replayed(df, time="ts", key="id", late=4, again=3)
    got = S.latest(S.owned_counts(S.once(stream, key="id", time="ts", delay=delay), key="k", time="ts", size="5 minutes", delay=None), ["k", "start"]).collect()
    want = df.groupBy("k", F.window("ts", "5 minutes").alias("w")).count().collect()
    assert {tuple(x) for x in got} == {(x.k, x.w.start, x["count"]) for x in want}


def test_a_failing_batch_is_raised(spark, growing, tmp_path):
    def broken(batch, number):
        raise ValueError("broken")

    with pytest.raises(Exception, match="broken"):
        S.until(S.table_stream(spark, growing, "events"), broken, str(tmp_path / "log"))


def test_early_stop_and_resume(spark, growing, tmp_path):
    rows, log = [], str(tmp_path / "log")

    def enough(batch, number):
        rows.extend(x.id for x in batch.collect())
        return len(rows) >= 20

    assert S.until(S.table_stream(spark, growing, "events"), enough, log) == 2
    assert len(rows) == 20
    S.until(S.table_stream(spark, growing, "events"), lambda b, n: rows.extend(x.id for x in b.collect()), log)
    assert sorted(rows) == list(range(40))
