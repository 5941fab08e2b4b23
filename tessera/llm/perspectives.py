"""Chat formatting (operator 3): multi-party perspective rotation, in DataFrame operations only.

For every participant of a dialogue, the whole dialogue is rendered with that participant as the assistant and the
others as users with their names; the mask marks the characters of the assistant's turns, which are to be learned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stored

#: A rendering is cut at each so many turn numbers, and between those after so many turns; longer dialogues get more
#: chunks, in order.
CHUNK_TURNS = 512
SYSTEM, UNKNOWN = "system", "unknown"


_END = "<|end|>\n"


def _head(role: Column, speaker: Column) -> Column:
    """What stands before a turn of `role` where `speaker` is the assistant; null: nobody is."""
    return F.when(role == SYSTEM, F.lit("<|system|>\n")).when(role == speaker, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))


def _segment(x: Column, speaker: Column) -> Column:
    return F.struct(_head(x["role"], speaker).alias("head"), F.concat(x["text"], F.lit(_END)).alias("body"), (x["role"] == speaker).alias("mine"))


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """One row per dialogue, participant and chunk: the rendering and the spans to be learned.

    Columns: conv_id, speaker, chunk, n_turns, n_masked (turns of the speaker), offset (characters of earlier chunks),
    text, mask ("start-end" in code points of the chunk's text, comma-joined; from the speaker's text to after its end
    mark). A participant is each distinct role but system, which is shown as it is. A dialogue without participants
    gives no row. Null text is empty, a null or empty role is "unknown", a null turn number comes first (chunk 0);
    ties and repeated rows are all kept, ordered by turn, role, text; "<|" in texts and roles becomes "< |", so that no
    text can forge a mark. Rows with a null conv_id form one dialogue; an empty table gives no rows. Other columns are
    left out.

    Texts are shuffled once, by dialogue and chunk, so a long dialogue is dealt over many tasks, and no array holds more
    than a chunk. A dialogue of one chunk has its participants there; for the longer ones participants and offsets are
    joined from tables of names and numbers.
    """
    clean = lambda c, empty: F.replace(F.coalesce(F.col(c).cast("string"), F.lit(empty)), F.lit("<|"), F.lit("< |"))
    name = F.when(F.coalesce(F.col(role).cast("string"), F.lit("")) == "", F.lit(UNKNOWN)).otherwise(clean(role, ""))
    rows = turns.select(F.coalesce(F.col(conv).cast("long"), F.lit(0).cast("long")).alias("conv_id"), F.col(conv).isNull().alias("no_id"), F.col(turn).cast("long").alias("turn"), name.alias("role"), clean(text, "").alias("text"))
    rows = rows.withColumn("part", F.greatest(F.coalesce(F.floor(F.col("turn") / chunk_turns), F.lit(0)), F.lit(0)).cast("long"))
    key = ["conv_id", "no_id"]
    sizes = stored(rows.groupBy(*key, "part").agg(F.ceil(F.count(F.lit(1)) / chunk_turns).cast("long").alias("n")).groupBy(*key).agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("chunks")).where("chunks > 1"))
    # The dialogues of several chunks, each chunk's number and what stands in it by role: names and numbers only.
    long_rows = rows.join(sizes, key, "left_semi")
    order = Window.partitionBy(*key, "part").orderBy("turn", "role", "text")
    cut = lambda df: df.withColumn("sub", F.floor((F.row_number().over(order) - 1) / chunk_turns))
    chunks = cut(rows.repartition(*key, "part")).groupBy(*key, "part", "sub").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    held = cut(long_rows).groupBy(*key, "part", "sub", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))
    held = stored(held)
    speakers = held.where(F.col("role") != SYSTEM).select(*key, F.col("role").alias("speaker")).distinct()
    numbered = held.groupBy(*key, "part", "sub").agg(F.sum(F.col("n") * F.length(_head(F.col("role"), F.lit(None).cast("string"))) + F.col("chars") + F.col("n") * len(_END)).alias("length"))
    running = Window.partitionBy(*key).orderBy("part", "sub")
    numbered = numbered.withColumns({"chunk": (F.row_number().over(running) - 1).cast("long"), "before": F.sum("length").over(running) - F.col("length")})
    # A speaker's own turns have another head: so many characters more or less each.
    own = held.select(*key, "part", "sub", F.col("role").alias("speaker"), "n")
    each = numbered.select(*key, "part", "sub", "chunk", "before").join(speakers, key).join(own, [*key, "part", "sub", "speaker"], "left")
    turns_before = F.coalesce(F.sum("n").over(Window.partitionBy(*key, "speaker").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    differ = F.length(_head(F.col("speaker"), F.col("speaker"))) - F.length(_head(F.col("speaker"), F.lit(None).cast("string")))
    places = stored(each.select(*key, "part", "sub", "chunk", "speaker", (F.col("before") + turns_before * differ).cast("long").alias("offset")))
    by_chunk = places.groupBy(*key, "part", "sub").agg(F.collect_list(F.struct("speaker", "chunk", "offset")).alias("places"))
    alone = F.transform(F.filter(F.array_distinct(F.transform("turns", lambda x: x["role"])), lambda r: r != SYSTEM), lambda r: F.struct(r.alias("speaker"), F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("offset")))
    met = chunks.join(by_chunk, [*key, "part", "sub"], "left").withColumn("places", F.coalesce("places", alone))
    spoken = met.select(*key, "turns", F.inline("places"))
    parts = spoken.select(*key, "chunk", "offset", "speaker", F.transform("turns", lambda x: _segment(x, F.col("speaker"))).alias("parts"))
    # (end so far, spans so far): one pass over the chunk's turns
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc: Column, p: Column) -> Column:
        begin, end = acc["at"] + F.length(p["head"]), acc["at"] + F.length(p["head"]) + F.length(p["body"])
        span = F.concat(begin.cast("string"), F.lit("-"), (end - 1).cast("string"))  # the line break after the end mark stays out
        return F.struct(end.alias("at"), F.when(p["mine"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return parts.select(
        F.when(~F.col("no_id"), F.col("conv_id")).alias("conv_id"),
        "speaker",
        "chunk",
        F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["mine"])).cast("long").alias("n_masked"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        F.array_join(F.aggregate("parts", start, add)["spans"], ",").alias("mask"),
        "offset",
    )


def op3_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(read(spark, sf_dir, "conversations"))


SQL = r"""
with r as (
  select conv_id, turn, case when coalesce(role, '') = '' then 'unknown' else replace(role, '<|', '< |') end as role,
         replace(coalesce(text, ''), '<|', '< |') as text, greatest(coalesce(floor(turn / 512.0), 0), 0)::bigint as part from conversations
), u as (select *, (row_number() over (partition by conv_id, part order by turn nulls first, role, text) - 1) // 512 as sub from r),
t as (select *, dense_rank() over (partition by conv_id order by part, sub) - 1 as chunk from u),
s as (select distinct conv_id, role as speaker from t where role <> 'system'),
p as (
  select t.conv_id, speaker, chunk, turn, role, text, role = speaker as mine,
    case when role = 'system' then '<|system|>' || chr(10) when role = speaker then '<|assistant|>' || chr(10) else '<|user name=' || role || '|>' || chr(10) end as head,
    text || '<|end|>' || chr(10) as body
  from t join s on t.conv_id is not distinct from s.conv_id
), o as (
  select *, row_number() over w as n, coalesce(sum(length(head) + length(body)) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as base
  from p window w as (partition by conv_id, speaker, chunk order by turn nulls first, role, text)
), g as (
  select conv_id, speaker, chunk, count(*) as n_turns, count(*) filter (mine) as n_masked, string_agg(head || body, '' order by n) as text,
    coalesce(string_agg(case when mine then (base + length(head))::varchar || '-' || (base + length(head) + length(body) - 1)::varchar end, ',' order by n), '') as mask
  from o group by all
)
select *, coalesce(sum(length(text)) over (partition by conv_id, speaker order by chunk rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from g
"""
QUERIES = {"op3_perspectives": op3_perspectives}
ORACLES = {"op3_perspectives": SQL}
