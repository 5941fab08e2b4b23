from pyspark.sql import functions as F

from tessera.streaming import live


def _events(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet")


def test_stream_equals_batch(spark, tmp_path):
    events = _events(spark)
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    got = live.drain_to_memory(live.slot_counts(live.occurrence_stream(spark, str(tmp_path / "in"), events.schema, 1)), str(tmp_path / "cp"))
    want = events.groupBy((F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 300) * 300).alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_keyed_table_is_idempotent(spark, tmp_path):
    events = _events(spark).select("event_id", "user_id", "ts", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    at = live.KeyedTable(spark, str(tmp_path / "table"), ["user_id"], ["ts", "event_id"])
    live.run_once(live.occurrence_stream(spark, str(tmp_path / "in"), events.schema, 1), at.apply, str(tmp_path / "cp"))
    want = {r.user_id: r.e for r in events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("e")).collect()}
    assert {r.user_id: r.event_id for r in at.read().collect()} == want
    last = at._versions()[-1]
    at.apply(events.limit(5), last)  # a replay of the last batch replaces it
    assert at._versions()[-1] == last
