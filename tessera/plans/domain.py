"""Queries that run the order-dependent operators on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import stories as S
from tessera.operators import translation as X
from tessera.plans.texts import _KEY, _NAMES, _NUMBERS
from tessera.session import table


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with embeddings as sightings: a pseudo-day of 50 documents each, a minute apart."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label"), "doc_id")
    rows = S.features(docs).withColumns({"day": F.floor(F.col("doc_id") / 50), "id": F.col("doc_id"), "seq": F.col("doc_id"), "minutes": F.col("doc_id"), "category": F.col("label").cast("string"), "hash": F.col("exact_hash")})
    return rows.select("day", "id", "seq", "minutes", "source", "lang", "category", "exact_hash", "hash", "tokens", "numbers", "names", "negated", "vector")


def ordered_story_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cluster_stories(_observations(spark, sf_dir))


def additive_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fold_facts(_observations(spark, sf_dir))


def guarded_pair_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one pseudo-day and category with their decision."""
    rows = _observations(spark, sf_dir).drop("seq", "exact_hash", "hash")
    sides = [rows.select("day", "category", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "minutes", "source", "lang", "tokens", "numbers", "names", "negated", "vector")]) for s in "ab"]
    pairs = sides[0].join(sides[1], ["day", "category"]).where("id_a < id_b")
    return S.pair_decision(pairs).select("id_a", "id_b", (F.round("sim", 3) + 0.0).alias("sim"), "decision")


def overlap_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reconstruct(table(spark, sf_dir, "conversations"))


def frame_line_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a frame: user turns from the primary engine, others from the fallback."""
    c = table(spark, sf_dir, "conversations")
    half = F.when(F.col("role") == "user", "primary").otherwise("fallback")
    y = (F.floor(F.col("turn") / 2) * 20.0).alias("y0")
    lines = c.select(F.col("conv_id").alias("frame"), half.alias("engine"), "text", (F.pmod(F.xxhash64("text"), F.lit(100)) / 100).alias("confidence"), F.lit("en").alias("script"), F.lit(0.0).alias("x0"), y, F.lit(100.0).alias("x1"))
    return S.merge_frame_lines(lines.withColumn("y1", F.col("y0") + 18.0))


def translation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as sources, the turn that follows as their translation: to Urdu where the turn's number is even, from it else.
    Words, spaces and numbers are those of the SQL."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    pairs = c.where("role = 'user'").join(nxt, ["conv_id", "turn"])
    even = F.col("turn") % 4 == 0
    checks = X.translation_checks(F.col("text"), F.col("target"), F.when(even, "en").otherwise("ur"), F.when(even, "ur").otherwise("en"), sql=True)
    scored = pairs.select("conv_id", "turn", X.translation_verdict(checks).alias("v"))
    return scored.select("conv_id", "turn", F.round("v.score", 6).alias("score"), "v.accepted", F.array_join(F.array_sort("v.issues"), ",").alias("issues"))


QUERIES = {f.__name__: f for f in (ordered_story_fold, additive_ledger, guarded_pair_decisions, overlap_reconstruct, frame_line_merge, translation_quality)}

_WORD_VALUES = "map {" + ", ".join(f"'{w}': '{n}'" for w, n in (X.ENGLISH_NUMBERS | X.URDU_NUMBERS).items()) + "}"
_VALUES = lambda c: rf"list_distinct(regexp_extract_all({c}, '(?:\d[\d,.:/-]*\d|\d)') || list_filter(list_transform(regexp_extract_all(lower({c}), '[a-z]+|[\x{{0600}}-\x{{06ff}}]+'), lambda x: {_WORD_VALUES}[x]), lambda x: x is not null))"
_COUNT = lambda c, letters: f"len(regexp_extract_all({c}, '{letters}'))"
_URDU, _LETTER = r"[\x{0600}-\x{06ff}\x{0750}-\x{077f}\x{08a0}-\x{08ff}]", "[A-Za-z]"
_NO_EN = r"\b(?:no|not|never|neither|nor|without|denied|rejected|refused|failed\s+to|didn[''’]?t|doesn[''’]?t|won[''’]?t|cannot|can[''’]?t)\b"
_NO_UR = r"(?:^|[\s،۔!؟?])(?:نہیں|نہ|بغیر|ہرگز|مسترد|انکار|ناکام)(?:$|[\s،۔!؟?])"
_STRINGS = lambda values: "[" + ", ".join(f"'{x}'" for x in values) + "]"
_OPPOSED = " or ".join(f"(len(list_intersect(a.tokens, {g})) > 0 and len(list_intersect(b.tokens, {g})) > 0 and list_sort(list_intersect(a.tokens, {g})) <> list_sort(list_intersect(b.tokens, {g})))" for g in map(_STRINGS, T.CONTRADICTIONS))
ORACLES = {
    "guarded_pair_decisions": rf"""with o as (select doc_id as id, doc_id // 50 as day, label as category, source, lang, embedding::double[] as v,
  list_distinct(regexp_extract_all({_KEY}, '[\p{{L}}\p{{N}}_]+')) as tokens, {_NUMBERS} as numbers, {_NAMES} as names from documents join embeddings on vec_id = doc_id),
p as (select a.id as id_a, b.id as id_b, list_cosine_similarity(a.v, b.v) as sim, len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(a.tokens || b.tokens)) as overlap,
  case when a.lang <> b.lang and a.lang <> 'mixed' and b.lang <> 'mixed' then 0.94 when a.source <> b.source and abs(a.id - b.id) <= 30 then 0.90 else 0.93 end as need,
  a.numbers = b.numbers and a.names = b.names and list_has_any(a.tokens, {_STRINGS(T.NEGATIONS)}) = list_has_any(b.tokens, {_STRINGS(T.NEGATIONS)}) and not ({_OPPOSED}) as guarded
  from o a join o b on a.day = b.day and a.category = b.category and a.id < b.id)
select id_a, id_b, round(sim, 3) + 0.0 as sim, case when sim >= need and (overlap >= 0.24 or sim >= 0.965) and guarded then 'merge' when sim >= 0.84 then 'review' else 'create' end as decision from p""",
    "translation_quality": rf"""with p as (select a.conv_id, a.turn, trim(regexp_replace(a.text, '\s+', ' ', 'g')) as s, trim(regexp_replace(b.text, '\s+', ' ', 'g')) as t, a.turn % 4 = 0 as to_ur from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user'),
n as (select *, {_COUNT('s', _URDU)} as s_ur, {_COUNT('s', _LETTER)} as s_en, {_COUNT('t', _URDU)} as t_ur, {_COUNT('t', _LETTER)} as t_en from p),
c as (select conv_id, turn, length(t) > 0 as non_empty, not regexp_matches(t, '(?i)(?:<pad>|</s>|<unk>|▁)') as not_control_tokens, lower(t) <> lower(s) as not_identical_to_source,
  list_has_all({_VALUES('t')}, {_VALUES('s')}) as numbers_preserved, length(t) / greatest(length(s), 1) between 0.22 and 4.5 as reasonable_length,
  case when to_ur then t_ur > 0 else t_en > 0 end as target_script_present, case when to_ur then t_ur >= greatest(t_en, 1) else t_en >= greatest(t_ur, 1) end as target_script_dominant,
  case when to_ur then s_en >= s_ur else s_ur >= s_en end as source_script_consistent,
  case when to_ur then regexp_matches(s, '(?i){_NO_EN}') = regexp_matches(t, '{_NO_UR}') else regexp_matches(s, '{_NO_UR}') = regexp_matches(t, '(?i){_NO_EN}') end as negation_preserved,
  not to_ur or len(regexp_extract_all(t, '\b[A-Za-z]{{2,}}\b')) <= 3 or t_ur >= 2 * t_en as no_roman_urdu_output from n),
i as (select *, list_filter([{', '.join(f"case when not {x} then '{x}' end" for x in sorted((*X.CRITICAL, 'not_identical_to_source', 'source_script_consistent')))}], lambda x: x is not null) as failed from c)
select conv_id, turn, round((10 - len(failed)) / 10, 6) as score, {' and '.join(X.CRITICAL)} and len(failed) <= 1 as accepted, array_to_string(failed, ',') as issues from i""",
}
