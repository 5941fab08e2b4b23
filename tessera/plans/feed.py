"""Read queries over occurrences, streams and stories, on the test tables: events are the occurrences, customers the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import table

#: A fixed "now", so that results do not depend on the clock.
NOW = "2024-01-30 23:57:12"
PAGE = 50


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("channel_name"))


def page_after(df: DataFrame, order: list[tuple[str, bool]], cursor: dict | None = None, limit: int = PAGE) -> DataFrame:
    """Keyset page: the first `limit` rows of `order` (column, descending) after `cursor`; has_more looks one row ahead.

    The cursor's condition is spelt out by column, so that it is pushed down to the scan.
    """
    if cursor:
        condition, equal = F.lit(False), F.lit(True)
        for column, down in order:
            value = F.lit(cursor[column])
            condition |= equal & (F.col(column) < value if down else F.col(column) > value)
            equal &= F.col(column) == value
        df = df.where(condition)
    keys = [F.col(c).desc() if down else F.col(c).asc() for c, down in order]
    ahead = df.orderBy(*keys).limit(limit + 1)
    rank = F.row_number().over(Window.orderBy(*keys))  # of limit + 1 rows
    return ahead.withColumn("rank", rank).withColumn("has_more", F.max("rank").over(Window.partitionBy()) > limit).where(F.col("rank") <= limit)


def feed(events: DataFrame, streams: DataFrame, minutes: int, now: str = NOW) -> DataFrame:
    """Occurrences of the last `minutes` (1 to 120) with their stream's name."""
    since = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(min(120, max(1, minutes))))
    return events.where(F.col("ts") >= since).join(streams, "user_id").select("event_id", "ts", "user_id", "channel_name", "event_type", F.round("value", 4).alias("confidence"), F.coalesce(F.get_json_object("props", "$.status"), F.lit("pending")).alias("translation_status"))


def feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_after(feed(_events(spark, sf_dir), _streams(spark, sf_dir), 30), [("ts", True), ("event_id", True)])


def feed_page_after_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", "ts", "event_type")
    return rows.where("ts < timestamp_ntz'2024-01-15 12:00:00' or (ts = timestamp_ntz'2024-01-15 12:00:00' and event_id < 5000)").orderBy(F.desc("ts"), F.desc("event_id")).limit(PAGE)


def feed_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = _events(spark, sf_dir).withColumn("category_ids", F.array("event_type"))
    rows = tagged.where(F.array_contains("category_ids", "click") & (F.pmod("user_id", F.lit(3)) == 0) & (F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")))
    return rows.join(_streams(spark, sf_dir), "user_id").select("event_id", "ts", "channel_name").orderBy(F.desc("ts"), F.desc("event_id")).limit(PAGE)


def keyword_page_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_after(table(spark, sf_dir, "part").select("p_partkey", "p_name"), [("p_name", False), ("p_partkey", False)], {"p_name": "b", "p_partkey": 0})


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every category with its distinct streams and its occurrences of a day; zero where there is none."""
    events = _events(spark, sf_dir)
    kinds = events.select(F.col("event_type").alias("category")).distinct()
    day = events.where(F.to_date("ts") == F.lit("2024-01-15").cast("date"))
    stories = day.groupBy(F.col("event_type").alias("category")).agg(F.countDistinct("user_id").alias("stories"))
    seen = day.select(F.explode(F.array("event_type")).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("occurrences"))
    out = kinds.join(stories, "category", "left").join(seen, "category", "left")
    return out.select("category", F.coalesce("stories", F.lit(0)).alias("stories"), F.coalesce("occurrences", F.lit(0)).alias("occurrences"))


def stream_counts_with_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = _events(spark, sf_dir).where("to_date(ts) = date'2024-01-10'").select("user_id", "event_id")
    return _streams(spark, sf_dir).join(day, "user_id", "left").groupBy("user_id", "channel_name").agg(F.count("event_id").alias("n"))


def overview_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return events.agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("user_id").alias("active_streams"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.round(F.avg("value"), 6).alias("avg_confidence"), F.round(F.avg(F.when(F.to_date("ts") == F.lit("2024-01-15").cast("date"), F.col("value"))), 6).alias("day_confidence"))


def pkt_calendar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Karachi"))
    return _events(spark, sf_dir).groupBy(day.cast("string").alias("calendar_date")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("streams"))


def history_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.to_date("ts").cast("string").alias("calendar_date")).distinct().orderBy(F.desc("calendar_date"))


def unfolded_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories (orders) neither folded (shipped late) nor under review (status P), oldest first."""
    folded = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = table(spark, sf_dir, "orders")
    review = orders.where("o_orderstatus = 'P'").select("o_orderkey")
    left = orders.join(folded, "o_orderkey", "left_anti").join(review, "o_orderkey", "left_anti")
    return left.select("o_orderkey", "o_custkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey").limit(5000)


def dirty_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customer segment's nation, day) with a story not yet summarised."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    done = table(spark, sf_dir, "lineitem").where("l_discount >= 0.09").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.where("o_orderpriority = '1-URGENT'").join(done, "o_orderkey", "left_anti").join(customers, "o_custkey").select("c_nationkey", F.to_date("o_orderdate").cast("string").alias("day")).distinct()


def pending_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality").isNull()).alias("pending"))


def opposite_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.when(F.col("lang") == "en", "de").otherwise("en").alias("target_language"), F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown")).alias("channel"))


def overview_unnest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.explode(F.array("event_type", F.concat(F.lit("hour"), F.hour("ts").cast("string")))).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


def avg_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderpriority"), "l_orderkey")
    return joined.groupBy("o_orderpriority").agg(F.round(F.avg(F.datediff("l_shipdate", "o_orderdate")), 6).alias("avg_days"), F.count(F.lit(1)).alias("n"))


def items_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the feed merged by key, the incoming half's fields first."""
    events = _events(spark, sf_dir).select("event_id", "event_type", F.round("value", 4).alias("value"))
    now = events.where("event_id % 3 <> 0")
    incoming = events.where("event_id % 2 = 0").select("event_id", F.when(F.col("event_id") % 4 == 0, F.upper("event_type")).alias("event_type"), F.col("value").alias("value"))
    a, b = now.alias("a"), incoming.alias("b")
    return a.join(b, F.col("a.event_id") == F.col("b.event_id"), "full").select(F.coalesce("b.event_id", "a.event_id").alias("event_id"), F.coalesce("b.event_type", "a.event_type").alias("event_type"), F.coalesce("b.value", "a.value").alias("value"))


QUERIES = {f.__name__: f for f in (feed_page, feed_page_after_cursor, feed_filtered, keyword_page_asc, category_counts, stream_counts_with_zero, overview_scalars, pkt_calendar_counts, history_dates, unfolded_eligible, dirty_keys, pending_left_join, opposite_language, overview_unnest_counts, avg_latency, items_merged)}

_PAGED = "select *, max(rank) over () > 50 as has_more from (select *, row_number() over (order by {order}) as rank from ({rows}) order by {order} limit 51)"
_FEED = "select event_id, ts, user_id, c_name as channel_name, event_type, round(value, 4) as confidence, coalesce(props->>'status', 'pending') as translation_status from events join customer on user_id = c_custkey where ts >= timestamp '2024-01-30 23:27:12'"
ORACLES = {
    "feed_page": "select * from (" + _PAGED.format(order="ts desc, event_id desc", rows=_FEED) + ") where rank <= 50",
    "feed_page_after_cursor": "select event_id, ts, event_type from events where (ts, event_id) < (timestamp '2024-01-15 12:00:00', 5000) order by ts desc, event_id desc limit 50",
    "feed_filtered": "select event_id, ts, c_name as channel_name from events join customer on user_id = c_custkey where event_type = 'click' and user_id % 3 = 0 and ts >= timestamp '2024-01-20' order by ts desc, event_id desc limit 50",
    "keyword_page_asc": "select * from (" + _PAGED.format(order="p_name, p_partkey", rows="select p_partkey, p_name from part where p_name > 'b' or (p_name = 'b' and p_partkey > 0)") + ") where rank <= 50",
    "category_counts": "select k.category, count(distinct user_id) as stories, count(user_id) as occurrences from (select distinct event_type as category from events) k left join (select * from events where ts::date = date '2024-01-15') e on e.event_type = k.category group by 1",
    "stream_counts_with_zero": "select c_custkey as user_id, c_name as channel_name, count(event_id) as n from customer left join events on user_id = c_custkey and ts::date = date '2024-01-10' group by 1, 2",
    "overview_scalars": "select count(*) as occurrences, count(distinct user_id) as active_streams, count(*) filter (event_type = 'click') as clicks, round(avg(value), 6) as avg_confidence, round(avg(value) filter (ts::date = date '2024-01-15'), 6) as day_confidence from events",
    "pkt_calendar_counts": "select (ts + interval 5 hour)::date::varchar as calendar_date, count(*) as n, count(distinct user_id) as streams from events group by 1",
    "history_dates": "select distinct ts::date::varchar as calendar_date from events",
    "unfolded_eligible": "select o_orderkey, o_custkey, o_orderdate from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 45) and o_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P') order by o_orderdate, o_orderkey limit 5000",
    "dirty_keys": "select distinct c_nationkey, o_orderdate::date::varchar as day from orders o join customer on o_custkey = c_custkey where o_orderpriority = '1-URGENT' and not exists (select 1 from lineitem where l_orderkey = o.o_orderkey and l_discount >= 0.09)",
    "pending_left_join": "select lang, count(*) as n, count(*) filter (quality is null) as pending from documents left join labels using (doc_id) group by 1",
    "opposite_language": "select doc_id, case when lang = 'en' then 'de' else 'en' end as target_language, coalesce(nullif(source, ''), 'unknown') as channel from documents",
    "overview_unnest_counts": "select category, count(*) as n from (select unnest([event_type, 'hour' || hour(ts)::varchar]) as category from events) group by 1",
    "avg_latency": "select o_orderpriority, round(avg(datediff('day', o_orderdate, l_shipdate)), 6) as avg_days, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by 1",
    "items_merged": "select coalesce(b.event_id, a.event_id) as event_id, coalesce(b.event_type, a.event_type) as event_type, coalesce(b.value, a.value) as value from (select event_id, event_type, round(value, 4) as value from events where event_id % 3 <> 0) a full join (select event_id, case when event_id % 4 = 0 then upper(event_type) end as event_type, round(value, 4) as value from events where event_id % 2 = 0) b on a.event_id = b.event_id",
}
