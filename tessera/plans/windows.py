"""Ordered and windowed queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


def _by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def _seconds(a, b):
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1_000_000


def gap_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stream: gaps above max(1.75 e, e + 0.35) for an expected gap e of six hours."""
    expected = 21_600.0
    gaps = _events(spark, sf_dir).withColumn("gap", _seconds(F.col("ts"), F.lag("ts").over(_by_user())))
    return gaps.groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"), F.round(F.max("gap"), 3).alias("max_gap"), F.round(F.avg("gap"), 3).alias("avg_gap"), F.count_if(F.col("gap") > max(1.75 * expected, expected + 0.35)).alias("violations"))


def recent_repeat_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the same kind of event stands among the stream's ten before it."""
    before = F.collect_list("event_type").over(_by_user().rowsBetween(-10, -1))
    return _events(spark, sf_dir).select("event_id", F.array_contains(before, F.col("event_type")).alias("repeat"))


def stable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = (~F.col("event_type").eqNullSafe(F.lag("event_type").over(_by_user()))).cast("int")
    runs = _events(spark, sf_dir).withColumn("changed", changed).withColumn("run", F.sum("changed").over(_by_user().rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("length"), F.min("event_id").alias("first_event")).where("length >= 2").select("user_id", F.col("run").cast("long").alias("run"), "event_type", "length", "first_event")


def first_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts").cast("string")
    return _events(spark, sf_dir).groupBy("user_id", day.alias("day"), "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def rolling_30min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the kind in the half hour up to each. Every slot of half an hour also gets its predecessor's rows, so that
    a kind is dealt over as many tasks as it has slots."""
    half = 30 * 60 * 1_000_000
    events = _events(spark, sf_dir).select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    slot = F.floor(F.col("us") / half)
    dealt = events.withColumn("slot", F.explode(F.array(slot, slot + 1)))
    window = Window.partitionBy("event_type", "slot").orderBy("us").rangeBetween(-half, 0)
    return dealt.withColumn("in_window", F.count(F.lit(1)).over(window)).where(F.col("slot") == slot).select("event_id", "in_window")


def tumbling_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 300)
    return _events(spark, sf_dir).groupBy(slot.alias("slot"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"), F.count(F.lit(1)).alias("n"))


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(F.round(F.percentile("value", 0.95), 6).alias("p95_linear"), F.expr("round(percentile_disc(0.95) within group (order by value), 6)").alias("p95_nearest"), F.round(F.median("value"), 6).alias("median"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return _events(spark, sf_dir).groupBy((k % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


def source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per story (kind) and stream: first and last sighting, count, latest detail."""
    e = _events(spark, sf_dir)
    return e.groupBy("event_type", "user_id").agg(F.min("ts").cast("string").alias("first_seen"), F.max("ts").cast("string").alias("last_seen"), F.count(F.lit(1)).alias("occurrences"), F.max_by("props", F.struct("ts", "event_id")).alias("latest"))


def story_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per exact text: sightings, sources, the best by (length, id)."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.md5("text").alias("story")).agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("source").alias("sources"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("best_doc"))


def audit_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).withColumn("n", F.row_number().over(_by_user())).where("n % 10 = 0").select("event_id", "user_id", F.col("n").cast("long").alias("n"))


def rolling_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence of a track's last three observations."""
    return _events(spark, sf_dir).select("event_id", F.round(F.avg("value").over(_by_user().rowsBetween(-2, 0)), 6).alias("mean3"))


def backoff_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = F.pmod("event_id", F.lit(12))
    return _events(spark, sf_dir).groupBy(attempts.alias("attempts")).agg(F.first(F.least(F.lit(300.0), F.pow(F.lit(2.0), F.least(attempts, F.lit(8))))).alias("delay"))


QUERIES = {f.__name__: f for f in (gap_violations, recent_repeat_flag, stable_runs, first_emission, rolling_30min, tumbling_5min, latest_per_key, percentiles, json_props, source_rollup, story_rollup, audit_frames, rolling_three, backoff_delays)}

_W = "(partition by user_id order by ts, event_id)"
ORACLES = {
    "gap_violations": f"with g as (select user_id, (epoch_us(ts) - epoch_us(lag(ts) over {_W})) / 1000000 as gap from events) select user_id, count(*) as frames, round(max(gap), 3) as max_gap, round(avg(gap), 3) as avg_gap, count(*) filter (gap > 37800.0) as violations from g group by 1",
    "recent_repeat_flag": "select event_id, coalesce(list_contains(list(event_type) over (partition by user_id order by ts, event_id rows between 10 preceding and 1 preceding), event_type), false) as repeat from events",
    "stable_runs": f"with c as (select *, (event_type is distinct from lag(event_type) over {_W})::int as changed from events), r as (select *, sum(changed) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from c) select user_id, run::bigint as run, event_type, count(*) as length, min(event_id) as first_event from r group by 1, 2, 3 having count(*) >= 2",
    "first_emission": "select user_id, ts::date::varchar as day, event_type, arg_min(event_id, (ts, event_id)) as event_id from events group by 1, 2, 3",
    "rolling_30min": "select event_id, count(*) over (partition by event_type order by ts range between interval 30 minute preceding and current row) as in_window from events",
    "tumbling_5min": "select epoch_us(ts) // 300000000 as slot, event_type, count(*) as n from events group by 1, 2",
    "latest_per_key": "select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id, count(*) as n from events group by 1, 2",
    "percentiles": "select event_type, round(quantile_cont(value, 0.95), 6) as p95_linear, round(quantile_disc(value, 0.95), 6) as p95_nearest, round(median(value), 6) as median from events group by 1",
    "json_props": "select (props->>'k')::bigint % 10 as k, count(*) as n, sum((props->>'k')::bigint)::bigint as total from events group by 1",
    "source_rollup": "select event_type, user_id, min(ts)::varchar as first_seen, max(ts)::varchar as last_seen, count(*) as occurrences, arg_max(props, (ts, event_id)) as latest from events group by 1, 2",
    "story_rollup": "select md5(text) as story, count(*) as occurrences, count(distinct source) as sources, array_to_string(list_sort(list(distinct lang)), ',') as langs, arg_max(doc_id, (n_chars, doc_id)) as best_doc from documents group by 1",
    "audit_frames": f"select * from (select event_id, user_id, row_number() over {_W} as n from events) where n % 10 = 0",
    "rolling_three": "select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row), 6) as mean3 from events",
    "backoff_delays": "select distinct event_id % 12 as attempts, least(300.0, pow(2.0, least(event_id % 12, 8)))::double as delay from events",
}
