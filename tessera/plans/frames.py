"""Queries of recognised frames, cursors, the outbox and translation by memory, on the test tables.

Events stand in for frames of streams, turns for frames with lines, line items for boxes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import delivery, evaluation, frames
from tessera.session import table

SECRET = "page-secret"
_IPAD, _OPAD = ("".join(f"\\x{k ^ x:02X}" for k in SECRET.encode().ljust(64, b"\0")) for x in (0x36, 0x5C))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def repeated_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames (events) whose text the stream (user) showed among its ten before, by likeness and numbers."""
    text = F.concat_ws(" ", F.lit("breaking headline of the evening bulletin reads"), "event_type", F.get_json_object("props", "$.k"))
    rows = _events(spark, sf_dir).select("event_id", "user_id", "ts", text.alias("text")).withColumn("key", T.compared_text("text"))
    found = frames.repeated_frames(rows, "user_id", ["ts", "event_id"], "key", "text", "event_id")
    return found.select("event_id", "repeated", F.round("similarity", 6).alias("similarity"), F.coalesce("like", F.lit(-1)).alias("like"))


def second_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that the second engine reads: without lines (a kind), with an unsure one, and every tenth."""
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    lines = F.when(F.col("event_type") != "error", F.array(F.struct((1 - F.col("event_id") % 40 / 400).alias("confidence"))))
    return _events(spark, sf_dir).select("event_id", number.alias("number"), lines.alias("lines")).where(frames.needs_second_reading(F.col("number"), F.col("lines"))).select("event_id", "number")


def region_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes by their place in a picture a hundred wide."""
    width = F.lit(100.0)
    kind = frames.region_class(F.col("l_quantity") * 2 - 2, F.col("l_quantity") * 2 + F.col("l_discount") * 600, width)
    return table(spark, sf_dir, "lineitem").groupBy(kind.alias("place")).agg(F.count(F.lit(1)).alias("n"))


def turn_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as frames: each is seen twice, a speaker's words in a place of their own."""
    line = F.struct(
        F.coalesce("text", F.lit("")).alias("text"), (0.9 + F.col("turn") % 10 / 100).alias("confidence"), F.lit("en").alias("script"), F.lit(0.0).alias("x0"),
        F.when(F.col("role") == "user", 100.0).otherwise(600.0).alias("y0"), F.lit(900.0).alias("x1"), F.when(F.col("role") == "user", 140.0).otherwise(640.0).alias("y1"), F.lit(False).alias("review"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("stream"), (F.col("turn") * 3).alias("seq"), F.lit("2024-01-01").alias("day"), F.lit(1000.0).alias("width"), F.lit(1000.0).alias("height"), F.array(line).alias("lines"))
    return turns.unionByName(turns.withColumn("seq", F.col("seq") + 1))


def track_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, headlines and fragments of dialogues by track."""
    return frames.track_units(turn_frames(spark, sf_dir)).drop("frames", "lines")


def offset_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a name that follows others stands in the normalised text and in the original."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.length("p_brand").alias("b"), F.concat(F.lit("  "), F.upper("p_brand"), F.lit(" \t "), F.upper("p_name"), F.lit("  ")).alias("text"))
    view = rows.withColumn("view", T.match_view("text"))
    start = F.col("b") + 1
    span = T.original_span(F.col("view.origin"), start, start + F.length("p_name"))
    return view.select("p_partkey", "view.normalised", span["start"].alias("start"), span["end"].alias("end"))


def page_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each occurrence's signed cursor."""
    return _events(spark, sf_dir).select("event_id", delivery.cursor(F.col("ts"), F.col("event_id"), SECRET).alias("cursor"))


_NOW = "2024-01-20 00:00:00"


def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = lambda n, k: F.when(F.col("event_id") % n == k, F.col("ts"))
    return _events(spark, sf_dir).select("event_id", "ts", F.col("ts").alias("available_at"), on(3, 0).alias("published_at"), on(7, 0).alias("dead_lettered_at"), F.when(F.col("event_id") % 5 == 0, F.to_timestamp(F.lit("2024-01-20 00:00:30"))).alias("leased_until"), (F.col("event_id") % 4).cast("int").alias("attempts"), F.lit(4).alias("max_attempts"))


def outbox_claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next hundred deliveries by age."""
    return delivery.claim(_outbox(spark, sf_dir), F.to_timestamp(F.lit(_NOW)), 100, 60, "worker", ["ts", "event_id"]).select("event_id", F.col("leased_until").cast("string").alias("leased_until"))


def outbox_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivery after an attempt that fails for two kinds."""
    tried = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type").isin("error", "click"), F.lit("refused")).alias("error"))
    now = F.to_timestamp(F.lit(_NOW))
    done = delivery.settle(_outbox(spark, sf_dir).where("published_at is null and dead_lettered_at is null").join(tried, "event_id"), now)
    return done.select("event_id", "attempts", F.col("published_at").isNotNull().alias("published"), F.col("dead_lettered_at").isNotNull().alias("dead"), F.when(F.col("last_error").isNotNull() & F.col("dead_lettered_at").isNull(), (F.unix_seconds("available_at") - F.unix_seconds(now)).cast("int")).otherwise(-1).alias("delay"))


def translated_by_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names by an engine that spells them backwards; the memory knows those of the first brand."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_name").alias("text"), F.lit("en").alias("source"), F.lit("xx").alias("target"))
    memory = parts.where("p_brand = 'Brand#1'").select(F.sha2(F.concat_ws("\0", F.lit("en>xx"), "text"), 256).alias("key"), F.concat(F.lit("known "), "text").alias("translated")).distinct()
    out, _ = delivery.translate_missing(parts, memory, lambda texts, source, target: [t[::-1] for t in texts])
    return out.select("p_partkey", "translated", "cached")


def taxonomy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms (part names) of categories (brands): priority, and whether more than one category owns them."""
    parts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list("p_name")).alias("terms"))
    categories = parts.select(F.col("p_brand").alias("id"), F.length("p_brand").alias("position"), F.array(F.lit("part")).alias("context"), F.create_map(F.lit("en"), "terms").alias("terms"))
    _, terms = delivery.taxonomy_rows(categories, ["Small Ring"], ["red widget", "small ring"], ["blue bolt"])
    return terms.select("id", "normalised", "priority", "requires_context", F.array_join("context_terms", ",").alias("context"))


def translation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as outputs against approved names, required and forbidden words."""
    parts = table(spark, sf_dir, "part")
    status = F.when(F.col("p_partkey") % 7 != 0, "complete").otherwise("pending")
    word = F.element_at(F.split("p_name", " "), 1)
    cases = parts.select(F.col("p_partkey").alias("id"), status.alias("status"), F.col("p_name").alias("translated"), F.array(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  ")))).alias("acceptable_translations"), F.lit(None).cast("string").alias("reference_text"), F.array(F.upper(word), F.lit(" ")).alias("required_terms"), F.array(F.lit("RING")).alias("forbidden_terms"))
    return evaluation.translation_cases(cases)


QUERIES = {f.__name__: f for f in (repeated_frames, second_readings, region_classes, track_units, offset_spans, page_cursors, outbox_claimed, outbox_settled, translated_by_memory, taxonomy_terms, translation_verdicts)}
ORACLES = {
    "repeated_frames": """with e as (select event_id, user_id, 'breaking headline of the evening bulletin reads ' || event_type || ' ' || (props->>'k') as t, props->>'k' as k,
        row_number() over (partition by user_id order by ts, event_id) as n from events),
        p as (select a.event_id, b.event_id as other, b.n, 1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)) as s, a.k = b.k as same from e a join e b on a.user_id = b.user_id and b.n between a.n - 10 and a.n - 1),
        h as (select *, min(case when s >= 0.97 and same then n end) over (partition by event_id) as hit from p),
        v as (select * from h where hit is null or n <= hit),
        r as (select event_id, bool_or(hit is not null) as repeated, max(s) as s, arg_max(other, (s, -n)) as other from v group by 1)
        select e.event_id, coalesce(repeated, false) as repeated, round(coalesce(s, 0), 6) as similarity, coalesce(case when s > 0 then other end, -1) as "like" from e left join r using (event_id)""",
    "second_readings": "select event_id, number from (select event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as number from events) where event_type = 'error' or 1 - event_id % 40 / 400 < 0.95 or number % 10 = 0",
    "region_classes": "select case when l_discount * 600 + 2 >= 50 then 'wide' when (l_quantity * 4 - 2 + l_discount * 600) / 200 < 0.38 then 'left' when (l_quantity * 4 - 2 + l_discount * 600) / 200 > 0.62 then 'right' else 'center' end as place, count(*) as n from lineitem group by 1",
    "offset_spans": "select p_partkey, lower(p_brand || ' ' || p_name) as normalised, length(p_brand)::int + 5 as start, (length(p_brand) + 5 + length(p_name))::int as \"end\" from part",
    "page_cursors": f"""with b as (select event_id, ('{{"t":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(ts) % 1000000 = 0 then '' else '.' || strftime(ts, '%f') end || '+00:00","i":"' || event_id || '"}}')::blob as body from events)
        select event_id, rtrim(replace(replace(to_base64(body || '.'::blob || unhex(sha256('{_OPAD}'::blob || unhex(sha256('{_IPAD}'::blob || body))))), '+', '-'), '/', '_'), '=') as cursor from b""",
    "outbox_claimed": f"select event_id, '2024-01-20 00:01:00' as leased_until from events where event_id % 3 <> 0 and event_id % 7 <> 0 and ts <= timestamp '{_NOW}' and event_id % 5 <> 0 order by ts, event_id limit 100",
    "outbox_settled": """select event_id, (a + f)::int as attempts, f = 0 as published, f = 1 and a + 1 >= 4 as dead, case when f = 1 and a + 1 < 4 then least(300, 1 << (a + 1))::int else -1 end as delay
        from (select event_id, (event_id % 4)::int as a, (event_type in ('error', 'click'))::int as f from events where event_id % 3 <> 0 and event_id % 7 <> 0)""",
    "translated_by_memory": "with m as (select distinct p_name from part where p_brand = 'Brand#1') select p_partkey, case when m.p_name is null then reverse(part.p_name) else 'known ' || part.p_name end as translated, m.p_name is not null as cached from part left join m using (p_name)",
    "taxonomy_terms": """with t as (select distinct p_brand as id, lower(p_name) as normalised from part), o as (select *, count(*) over (partition by normalised) > 1 or normalised = 'blue bolt' as needs from t)
        select id, normalised, case normalised when 'small ring' then 'critical' when 'red widget' then 'high' else 'normal' end as priority, needs as requires_context, case when needs then 'part' else '' end as context from o""",
    "translation_verdicts": "select p_partkey as id, true as approved, true as required, not contains(lower(p_name), 'ring') as forbidden, p_partkey % 7 <> 0 and not contains(lower(p_name), 'ring') as passed from part",
}
