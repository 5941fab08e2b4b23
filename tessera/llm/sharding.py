"""Sharding (operator 1): balanced label propagation.

Units (equal texts; groups above a fraction of a shard are split) are linked through hubs: lines they share. In each
round a hub votes for the shard that holds most of its units, by how much its share there is above chance (so a line that
stands everywhere draws nobody); every unit asks to move to the shard with most votes, and moves are granted as far as
the shards' quotas allow. At the end the rows are laid out by shard and hub and cut into
shards whose row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

SHARDS, ROUNDS = 40, 10
#: A unit holds at most this part of a shard's even share of rows, give or take the hash's evenness.
UNIT_PART = 8
#: Shards may grow by this part of an even share while labels move; the final cut is exact.
SLACK = 0.05
#: Propagation ends before its last round once it moves fewer rows than this part of all.
SETTLED = 0.001
#: A hub's links are dealt into parts of about this many, so that no task gets all links of a common line.
HUB_PART = 1000
OVERHEAD = 16


def _described(docs: DataFrame, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.trim(x, F.lit(" \t\r")) != "")
    hubs = F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(whole) + OVERHEAD).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.xxhash64(whole, F.octet_length(whole)).alias("whole"), hubs.alias("hubs"))


def _units(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """`rows` with their unit: the text's group, or a part of it where the group is large.

    Groups above the cap are fewer than shards * UNIT_PART by arithmetic, so they are broadcast.
    """
    cap = max(1, total // (shards * UNIT_PART))
    large = rows.groupBy("whole").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap).select("whole", F.ceil(F.col("n") / cap).cast("long").alias("parts"))
    part = F.when(F.col("parts").isNull(), F.col("whole")).otherwise(F.xxhash64("whole", F.pmod(F.xxhash64("doc_id"), F.col("parts"))))
    return rows.join(F.broadcast(large), "whole", "left").withColumn("unit", part)


def shared_hubs(units: DataFrame) -> DataFrame:
    """(unit, hub, n, part, parts): every hub of `units` (unit, n, hubs) that two units or more have."""
    links = units.select("unit", "n", F.explode_outer("hubs").alias("hub")).where("hub is not null")
    shared = links.groupBy("hub").agg(F.count(F.lit(1)).alias("degree")).where("degree > 1").select("hub", F.ceil(F.col("degree") / HUB_PART).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("unit", F.lit("part")), F.col("parts")).cast("int")
    return links.join(shared, "hub").select("unit", "hub", "n", part.alias("part"), "parts")


def cut_edges(edges: DataFrame, labels: DataFrame) -> tuple[int, int]:
    """(links to a hub that lie outside the shard where most of its units are, all links): what propagation minimises."""
    at = edges.join(labels, "unit").groupBy("hub", "label").agg(F.count(F.lit(1)).alias("links")).groupBy("hub").agg(F.sum("links").alias("links"), F.max("links").alias("most"))
    cut, every = at.agg(F.sum(F.col("links") - F.col("most")), F.sum("links")).first()
    return cut or 0, every or 0


def propagate(units: DataFrame, edges: DataFrame, shards: int, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """(unit, label): `units` (unit, n), `edges` as of shared_hubs(). The driver sees sums by shard only: shards ** 2 numbers."""
    labels = stored(units.select("unit", "n", F.pmod(F.xxhash64("unit"), F.lit(shards)).cast("int").alias("label")))
    even = (units.agg(F.sum("n")).first()[0] or 0) / shards
    for turn in range(rounds):
        held = edges.join(labels.select("unit", "label"), "unit")
        votes = held.groupBy("hub", "label").agg(F.sum("n").alias("n"), F.max("parts").alias("parts"))
        votes = votes.groupBy("hub").agg(F.max(F.struct("n", F.xxhash64("hub", "label").alias("lot"), "label")).alias("top"), F.sum("n").alias("n"), F.max("parts").alias("parts"))
        told = votes.select("hub", F.col("top.label").alias("to"), (F.col("top.n") / F.col("n") - 1 / shards).alias("weight"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        asked = edges.select("unit", "hub", "part").join(told, ["hub", "part"])
        asked = asked.groupBy("unit", "to").agg(F.sum("weight").alias("weight")).groupBy("unit").agg(F.max(F.struct(F.round("weight", 6), F.xxhash64("unit", "to").alias("lot"), "to"))["to"].alias("to"))
        wanted = stored(labels.join(asked, "unit", "left").withColumn("to", F.coalesce("to", "label")))
        flows = wanted.groupBy("label", "to").agg(F.sum("n").alias("n")).collect()  # shards ** 2 rows at most
        size, out, into = [0.0] * shards, [0.0] * shards, [0.0] * shards
        for f in flows:
            size[f["label"]] += f["n"]
            if f["label"] != f["to"]:
                out[f["label"]] += f["n"]
                into[f["to"]] += f["n"]
        room = [max(0.0, even * (1 + slack) - s + o / 2) for s, o in zip(size, out, strict=True)]
        grant = F.create_map(*(F.lit(x) for s in range(shards) for x in (s, min(1.0, room[s] / into[s]) if into[s] else 0.0)))
        lot = F.pmod(F.xxhash64("unit", F.lit(turn)), F.lit(1_000_000)) / 1_000_000
        labels = stored(wanted.select("unit", "n", F.when(lot < F.element_at(grant, F.col("to")), F.col("to")).otherwise(F.col("label")).alias("label")))
        if sum(into) < SETTLED * even * shards:
            break
    return labels.select("unit", "label")


def shard(docs: DataFrame, text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, law ("rows"), shard, slot, grown_shard (null), label.

    Row counts of shards differ by one at most; slots run from 0 without gaps. Null text has no bytes and is grouped with
    empty text. Equal texts stand together but where a shard ends or the group is above an eighth of a shard. Repeated
    rows are kept as rows; a null doc_id is a value like others; with fewer rows than shards some shards stay empty; an
    empty table gives no rows; other columns are left out. label is the shard that label propagation chose.
    """
    spark = docs.sparkSession
    rows = stored(_described(docs, text))
    total = rows.count()
    rows = stored(_units(rows, total, shards).select("doc_id", "size", "text_crc32", "whole", "unit", F.when(F.col("parts").isNull(), F.col("hubs")).otherwise(F.array_append("hubs", F.col("whole"))).alias("hubs")))
    units = stored(rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.first("whole").alias("whole"), F.first("hubs").alias("hubs")))
    edges = stored(shared_hubs(units))  # split hot groups have their text as a hub, which holds their parts together
    first = edges.groupBy("unit").agg(F.min("hub").alias("hub"))
    placing = stored(units.select("unit", "whole").join(first, "unit", "left").select("unit", F.coalesce("hub", "whole").alias("hub")))
    labels = propagate(units.select("unit", "n"), edges, shards, rounds)
    order = ["label", "hub", "unit", "doc_id"]
    placed = rows.drop("hubs", "whole").join(placing, "unit").join(labels, "unit").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = stored(placed.select("doc_id", "size", "text_crc32", "label", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    before, offsets = 0, []
    for r in sorted(placed.groupBy("part").count().collect(), key=lambda r: r["part"]):  # a row for each partition
        offsets.append((r["part"], before))
        before += r["count"]
    starts = spark.createDataFrame(offsets, "part long, start long")
    rank = placed.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("at"))
    rows_of = f"bigint({max(1, total)})"
    cut = rank.withColumn("shard", F.expr(f"int(rank * {shards} div {rows_of})")).withColumn("first", F.expr(f"(shard * {rows_of} + {shards - 1}) div {shards}"))
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "label")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))


QUERIES = {"op1_sharding": op1_sharding}
ORACLES: dict[str, str] = {}
