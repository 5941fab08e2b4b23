"""Evaluators: readings against the truth, translations against approved ones, the deduplication script."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tessera.functions import text as T
from tessera.operators import stories

# What a reading must reach, and when a line counts as found.
WORDS, LINES, NUMBERS, LINE_ALIKE = 0.95, 1.0, 1.0, 0.85


def edit_distance(a: list, b: list) -> int:
    """Insertions, deletions and replacements between two sequences, a row of the table at a time."""
    codes: dict = {}
    x, y = (np.asarray([codes.setdefault(v, len(codes)) for v in s], np.int64) for s in (a, b))
    at = np.arange(len(y) + 1)
    row = at
    for k, c in enumerate(x):
        step = np.minimum(row[1:] + 1, row[:-1] + (y != c))
        row = np.minimum.accumulate(np.concatenate([[k + 1], step]) - at) + at
    return int(row[-1])


def _accuracy(truth: list, read: list) -> float:
    return max(0.0, 1.0 - edit_distance(truth, read) / max(len(truth), 1))


def _alike(a: str, b: str) -> float:
    return 1.0 if a == b else 1.0 - edit_distance(list(a), list(b)) / max(len(a), len(b), 1)


@F.pandas_udf(StructType().add("characters", DoubleType()).add("words", DoubleType()).add("lines", DoubleType()))
def _rates(truths: pd.Series, reads: pd.Series) -> pd.DataFrame:
    out = []
    for truth, read in zip(truths, reads):
        truth, read = ([T.compared(x or "") for x in (v if v is not None else [])] for v in (truth, read))
        a, b = (" ".join(x for x in v if x) for v in (truth, read))
        found = sum(max((_alike(t, r) for r in read), default=0.0) >= LINE_ALIKE for t in truth)
        out.append((_accuracy(list(a), list(b)), _accuracy(a.split(), b.split()), found / len(truth) if truth else 1.0))
    return pd.DataFrame(out, columns=["characters", "words", "lines"])


def multiset_recall(truth: Column, read: Column) -> Column:
    """The share of `truth`'s elements that `read` has as often; 1 where there is none to find."""
    times = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    found = F.aggregate(F.array_distinct(truth), F.lit(0), lambda n, x: n + F.least(times(truth, x), times(read, x)))
    return F.when(F.size(truth) == 0, 1.0).otherwise(found / F.size(truth))


def reading_accuracy(cases: DataFrame) -> DataFrame:
    """(id, characters, words, lines, numbers, accepted) of cases (id, truth, read: arrays of lines; null is none)."""
    none = F.array().cast("array<string>")
    numbers = lambda c: T.number_runs(T.reading_text(F.array_join(F.coalesce(c, none), "\n")))
    out = cases.select("id", _rates("truth", "read").alias("r"), numbers("truth").alias("_truth"), numbers("read").alias("_read"))
    out = out.withColumn("numbers", multiset_recall(F.col("_truth"), F.col("_read"))).select("id", *(F.round(f"r.{c}", 6).alias(c) for c in ("characters", "words", "lines")), F.round("numbers", 6).alias("numbers"))
    return out.withColumn("accepted", (F.col("words") >= WORDS) & (F.col("lines") >= LINES) & (F.col("numbers") >= NUMBERS))


def translation_cases(cases: DataFrame) -> DataFrame:
    """(id, approved, required, forbidden, passed) of cases with `status` and `translated`.

    A case passes where the output is complete and word for word one of the approved translations, with all required terms and no
    forbidden one. Blank texts and terms don't count; a case without an approved translation fails.
    """
    none = F.array().cast("array<string>")
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    full = lambda c: F.filter(F.transform(F.coalesce(c, none), plain), lambda x: F.coalesce(x, F.lit("")) != "")
    output = F.coalesce(plain(F.col("translated")), F.lit(""))
    approved = full(F.concat(F.coalesce("acceptable_translations", none), F.array("reference_text")))
    holds = lambda t: F.contains(F.lower(output), F.lower(t))
    out = cases.select("id", "status", F.array_contains(approved, output).alias("approved"), F.forall(full(F.col("required_terms")), holds).alias("required"), F.forall(full(F.col("forbidden_terms")), lambda t: ~holds(t)).alias("forbidden"))
    return out.select("id", "approved", "required", "forbidden", (F.coalesce(F.col("status") == "complete", F.lit(False)) & F.col("approved") & F.col("required") & F.col("forbidden")).alias("passed"))


def dedup_script(steps: DataFrame) -> DataFrame:
    """(step_id, expected_action, action, passed) of a script's steps in their order (`seq`), by day in Karachi."""
    rows = stories.features(steps).withColumns({
        "day": F.to_date(F.from_utc_timestamp("observed_at", "Asia/Karachi")),
        "id": F.col("seq").cast("long"), "minutes": F.floor(F.unix_seconds("observed_at") / 60), "source": F.col("stream_id"), "lang": F.col("language"), "category": F.col("category_ids"), "vector": F.col("embedding")})
    folded = stories.cluster_stories(rows.select("day", "id", "seq", "minutes", "source", "lang", "category", "exact_hash", "tokens", "numbers", "names", "negated", "vector"))
    out = steps.join(folded.select(F.col("id").alias("seq"), "action"), "seq")
    return out.select("seq", "step_id", "expected_action", "action", (F.col("action") == F.col("expected_action")).alias("passed"))
