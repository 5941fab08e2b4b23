"""Line dedup by distinct-site spread (operator 5), in DataFrame operations only.

HyperLogLog sketches of the sites of each line are built map-side and merged by the aggregation; lines seen too seldom to
reach the threshold get none. Lines whose estimate is near the threshold get an exact distinct count; those found on
enough sites are boilerplate and are removed from every document but the first that has them.

Short lines need many sites. A passage of LONG_WORDS words or more repeats word for word by copying only, so LONG_SITES
are enough for it; but a document that consists of such passages for the most part is a copy, which is a matter of
near-dedup, and keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

#: A line on so many distinct sites is boilerplate; from LONG_WORDS words on LONG_SITES are enough.
MIN_SITES, LONG_WORDS, LONG_SITES = 10, 50, 2
#: HyperLogLog registers: 2 ** LG_K; the band of exact counts is SIGMAS standard errors wide to either side.
LG_K, SIGMAS = 10, 5.0

#: Lines (keys of 12 bytes and a few numbers) up to which they are broadcast; beyond, all lines are shuffled to them.
BROADCAST_ROWS = 500_000

_TRIM = " \t\r\x0b\x0c"


def _sent(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def _lines(text: str):
    return F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: F.trim(x, F.lit(_TRIM)))


def _long(line: Column, long_words: int) -> Column:
    """Whether a line has so many words; only lines of enough characters are counted."""
    return F.when(F.length(line) >= 2 * long_words - 1, F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")) >= long_words).otherwise(False)


def keyed_lines(docs: DataFrame, site: str, text: str, long_words: int = LONG_WORDS) -> DataFrame:
    """(no_id, id, whole, site, pos, h1, h2, long, chars) of each line with something in it; h1 and h2 make a key of 96 bits.

    no_id and id tell the document: of equal doc_ids all rows are one, without a doc_id equal texts are.
    """
    no_id = F.col("doc_id").isNull()
    rows = docs.select(no_id.alias("no_id"), F.when(no_id, F.xxhash64(text)).otherwise(F.col("doc_id").cast("long")).alias("id"), F.xxhash64(text).alias("whole"), F.col(site).cast("string").alias("site"), F.posexplode(_lines(text)).alias("pos", "line"))
    return rows.where("line <> ''").select("no_id", "id", "whole", "site", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), _long(F.col("line"), long_words).alias("long"), F.length("line").cast("long").alias("chars"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, long_sites: int = LONG_SITES) -> DataFrame:
    """(h1, h2, first_no_id, first_id, wide) of the lines on enough distinct sites; wide: on `min_sites`, however long. Null is no site."""
    error = SIGMAS * 1.04 / 2 ** (LG_K / 2)
    need = F.when(F.col("long"), F.least(F.lit(min_sites), F.lit(long_sites))).otherwise(F.lit(min_sites))
    seen = lines.groupBy("h1", "h2").agg(F.count("site").alias("n"), F.min(F.when(~F.col("no_id"), F.col("id"))).alias("named"), F.min(F.when(F.col("no_id"), F.col("id"))).alias("nameless"), F.bool_or("long").alias("long"))
    seen = stored(seen.where(F.col("n") >= need).select("h1", "h2", F.col("named").isNull().alias("first_no_id"), F.coalesce("named", "nameless").alias("first_id"), "long"))
    on_sites = lines.where("site is not null").select("h1", "h2", "site")
    spread = on_sites.join(_sent(seen.select("h1", "h2")), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
    spread = spread.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")).join(seen, ["h1", "h2"])
    spread = stored(spread.where(F.col("sites") >= need * (1 - error)))
    near = spread.where(F.col("sites") <= min_sites * (1 + error)).select("h1", "h2")
    pairs = on_sites.join(_sent(near), ["h1", "h2"], "left_semi").distinct()
    exact = pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("exact"))
    found = spread.join(exact, ["h1", "h2"], "left").withColumn("sites", F.coalesce("exact", "sites"))
    return stored(found.where(F.col("sites") >= need).select("h1", "h2", "first_no_id", "first_id", (F.col("sites") >= min_sites).alias("wide")))


def line_spread(docs: DataFrame, site: str = "source", text: str = "text", min_sites: int = MIN_SITES, long_words: int = LONG_WORDS, long_sites: int = LONG_SITES) -> DataFrame:
    """`docs` with `text` rid of boilerplate lines, and n_lines, n_removed.

    Lines are parted at \\n and compared without outer spaces; empty lines are never removed. The first document (lowest
    doc_id; those without one come last, in the order of their texts' hashes) that has a line keeps it, so that no
    passage is lost from the corpus. A document whose long lines on fewer than `min_sites` sites make up more than half
    of its characters keeps those. Null text stays null (0 lines); null sites aren't counted; repeated rows are treated
    alike; an empty table gives no rows. Columns of `docs` named n_lines or n_removed are replaced; the others pass
    through, whatever their names.
    """
    lines = keyed_lines(docs, site, text, long_words)
    found = boilerplate(lines, min_sites, long_sites)
    gone = lines.join(_sent(found), ["h1", "h2"]).where("no_id <> first_no_id or id <> first_id").select("no_id", "id", "whole", "pos", "wide", "chars").distinct()
    gone = gone.groupBy("no_id", "id", "whole").agg(F.collect_list(F.when(F.col("wide"), F.col("pos"))).alias("wide"), F.collect_list(F.when(~F.col("wide"), F.col("pos"))).alias("long"), F.sum(F.when(~F.col("wide"), F.col("chars"))).alias("chars"))
    gone = stored(gone).select(F.col("no_id").alias("__no_id"), F.col("id").alias("__id"), F.col("whole").alias("__whole"), F.struct("wide", "long", "chars").alias("__gone"))
    no_id = F.col("doc_id").isNull()
    same = (no_id == F.col("__no_id")) & (F.when(no_id, F.xxhash64(text)).otherwise(F.col("doc_id").cast("long")) == F.col("__id")) & (F.xxhash64(text) == F.col("__whole"))
    joined = docs.join(gone, same, "left").withColumn("__lines", F.split(F.col(text), "\n", -1))
    trimmed = F.transform("__lines", lambda x: F.trim(x, F.lit(_TRIM)))
    every = F.aggregate(trimmed, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    none = F.array().cast("array<int>")
    at = F.when(F.col("__gone").isNull(), none).when(2 * F.coalesce("__gone.chars", F.lit(0)) <= every, F.concat("__gone.wide", "__gone.long")).otherwise(F.col("__gone.wide"))
    out = joined.withColumns({"n_lines": F.coalesce(F.size(F.filter(trimmed, lambda x: x != "")), F.lit(0)).cast("long"), "__at": at})
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__at"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("__lines"), i)), "\n")
    out = out.withColumn("n_removed", F.size("__at").cast("long")).withColumn(text, F.when(F.size("__at") == 0, F.col(text)).otherwise(kept))
    return out.drop("__gone", "__no_id", "__id", "__whole", "__lines", "__at")


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_spread(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), "text")


def sql(min_sites: int = MIN_SITES, long_words: int = LONG_WORDS, long_sites: int = LONG_SITES) -> str:
    return rf"""
with d as (select row_number() over () as rid, doc_id, source, text from documents),
l as (select rid, doc_id, source, i, lines[i] as raw, trim(lines[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as line
  from (select rid, doc_id, source, string_split(text, chr(10)) as lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from d)),
c as (select line, min(doc_id) as first_doc, count(distinct source) as sites, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {long_words} as long from l where line <> '' group by line),
b as (select line, first_doc, sites >= {min_sites} as wide from c where sites >= {min_sites} or (long and sites >= {long_sites})),
k as (select rid, i, raw, l.line, b.line is not null and l.doc_id <> first_doc as found, coalesce(wide, false) as wide from l left join b on l.line = b.line),
h as (select rid, 2 * coalesce(sum(length(line)) filter (found and not wide), 0) <= sum(length(line)) as part from k group by rid),
m as (select rid, i, raw, line, found and (wide or part) as gone from k join h using (rid)),
g as (select rid, count(*) filter (line <> '') as n_lines, count(*) filter (gone) as n_removed, coalesce(string_agg(raw, chr(10) order by i) filter (not gone), '') as text from m group by rid)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, length(g.text)::bigint as n_chars, g.text from d left join g using (rid)
"""


QUERIES = {"op5_line_spread": op5_line_spread}
ORACLES = {"op5_line_spread": sql()}
