"""Quality rules at host level (operator 6).

Each document is measured against the base rules; failures are summed by host; a host's failure rate is shrunk
towards the corpus by a beta prior fitted to all hosts; the host's verdict is joined back to its documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: A host is rejected where its shrunk rate of failing documents is above this.
MAX_HOST_RATE = 0.5

_SPACE = " \t\n\x0b\x0c\r"
MEASURES = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more, the first occurrence included."""
    if len(words) < window + 1:
        return 0
    grams = list(zip(*(words[k:] for k in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    counts, covered, end = Counter(grams), 0, 0
    for at, gram in enumerate(grams):
        if counts[gram] > 1:
            covered += at + window - max(at, end)
            end = at + window
    return covered


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null counts as empty."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()  # bytes.split() parts at the six ASCII spaces and nothing else
    symbols = sum(map(text.count, SYMBOLS))
    chars = len(text) - sum(map(text.count, _SPACE))
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(x.as_py()) for x in batch.column(2)]
        columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), *columns], ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def measured(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.mapInArrow(_measured, MEASURES).withColumn("base_failed", failed)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(a, b) of the beta prior by moments over all hosts, each weighted by its documents.

    Only five sums reach the driver. Where the rates do not vary more than chance, the prior weighs as much as an
    average host.
    """
    n, f = F.col("n").cast("double"), F.col("failed").cast("double")
    s = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ff"), F.sum(n * n).alias("nn")).first()
    if not s["k"] or not s["n"]:
        return 1.0, 1.0
    mean = min(max(s["f"] / s["n"], 1e-6), 1 - 1e-6)
    between = s["ff"] - s["n"] * mean * mean  # sum of n (rate - mean)^2
    chance = mean * (1 - mean)
    scale = s["n"] - s["nn"] / s["n"]
    variance = (between - (s["k"] - 1) * chance) / scale if scale > 0 else 0.0
    weight = chance / variance - 1 if variance > 0 else s["n"] / s["k"]
    weight = min(max(weight, 1.0), s["n"] / s["k"])
    return mean * weight, (1 - mean) * weight


def host_rules(docs: DataFrame, host: str = "source", text: str = "text", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per row of `docs`: measures, base_failed, host, host_docs, host_rate, host_rejected, kept.

    Null text counts as empty (0 words: it fails). A null host is no host: its documents are neither summed nor
    rejected by a verdict (host_rate null). Repeated rows count as often as they stand there; an empty table gives
    no rows; other columns of `docs` are left out, so that none can clash. kept is false where base_failed, else
    the host's verdict, for hosts of any size: the prior alone keeps a small one near the corpus' rate. The texts are read once; what is summed and joined is a few numbers a document. The join
    broadcasts the hosts only below the session's size limit; else the hot host is split by AQE.
    """
    rows = stored(measured(docs, host, text))
    hosts = rows.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    hosts = stored(hosts)
    a, b = beta_prior(hosts)
    rate = (F.col("failed") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    verdicts = hosts.select("host", F.col("n").alias("host_docs"), F.round(rate, 6).alias("host_rate"), (rate > max_host_rate).alias("host_rejected"))
    return rows.join(verdicts, "host", "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False))).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "host_docs", "host_rate", "host_rejected")


SQL = r"""
with w as (
  select row_number() over () as rid, doc_id, source as host, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), grams as (
  select rid, i, [words[i], words[i+1], words[i+2], words[i+3], words[i+4]] as g
  from (select rid, words, unnest(range(1, len(words) - 3)) as i from w)
), dup as (
  select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from grams) where c > 1
), rep as (
  select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 5)) as p from dup) group by rid
), lines as (
  select rid, count(*) - count(distinct l) as n from (select rid, unnest(string_split(text, chr(10))) as l from w)
  where regexp_matches(l, '[^\x20\x09-\x0D]') group by rid
), m as (
  select doc_id, host, len(words)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(lines.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
  from w left join rep using (rid) left join lines using (rid)
), f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m),
h as (select host, count(*)::double as n, count(*) filter (base_failed)::double as failed from f where host is not null group by host),
s as (select count(*)::double as k, sum(n) as n, sum(failed) as f, sum(failed * failed / n) as ff, sum(n * n) as nn from h),
p as (select *, least(greatest(f / n, 1e-6), 1 - 1e-6) as mean from s),
v as (select *, case when n - nn / n > 0 then (ff - n * mean * mean - (k - 1) * mean * (1 - mean)) / (n - nn / n) else 0.0 end as var from p),
c as (select mean, least(greatest(case when var > 0 then mean * (1 - mean) / var - 1 else n / k end, 1.0), n / k) as weight from v),
r as (select host, n::bigint as host_docs, (failed + mean * weight) / (h.n + weight) as rate from h, c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(rate > 0.5, false) as kept, f.host, host_docs, round(rate, 6) as host_rate,
  coalesce(rate > 0.5, false) as host_rejected
from f left join r on f.host = r.host
"""
QUERIES = {"op6_host_rules": op6_host_rules}
ORACLES = {"op6_host_rules": SQL}
