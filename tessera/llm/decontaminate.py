"""Benchmark decontamination (operator 2), in DataFrame operations only.

Windows as long as a benchmark item get a SimHash fingerprint of their weighted five-word shingles. A multi-index over
blocks of the items' fingerprints finds every item within the Hamming radius (pigeonhole: of BLOCKS blocks one differs
in RADIUS // BLOCKS bits at most), and each candidate is verified by the exact weighted Jaccard similarity.

Only windows that can reach the threshold are fingerprinted. A window's similarity to an item is at most the weight of
the item's shingles in it over the item's weight. Such a window can be moved until it starts or ends with one of the
item's shingles without losing one; so windows are laid at every such start and end where that weight is enough.
(Moving can change what else stands in the window, by the difference of other shingles' weights.)
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stored
from .shingles import WIDTH, shingle_hashes, word_hashes

THRESHOLD = 0.8
#: Five blocks of 13 bits (the last of 12); fingerprints within 19 bits differ in 3 bits at most in one of them.
BLOCKS, BLOCK_BITS, RADIUS = 5, 13, 19
#: Shingle rows of the benchmark, and documents with a window, up to which they are broadcast (some 30 bytes each);
#: beyond, the documents' shingles or texts are shuffled to them.
BROADCAST_ROWS = 500_000
#: Weights are whole thousandths, so that sums do not depend on their order.
SCALE = 1000

_WINDOW = ["doc_id", "no_id", "whole", "start", "n_words"]
_DOC = _WINDOW[:3]


def item_shingles(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, n_words, pos, h, weight): a shingle weighs less, the more items have it. Equal rows count once."""
    rows = benchmark.select(F.col(item).cast("long").alias("item_id"), word_hashes(F.col(text)).alias("w")).distinct()
    rows = rows.select("item_id", F.size("w").alias("n_words"), F.posexplode_outer(shingle_hashes(F.col("w"))).alias("pos", "h"))
    return stored(rows.where("h is not null"))


def weights(items: DataFrame) -> tuple[DataFrame, int]:
    """(h, weight) of the items' shingles, and the weight of any other shingle, as of one that a single item has."""
    total = items.select("item_id").distinct().count()
    df = items.groupBy("h").agg(F.countDistinct("item_id").alias("df"))
    weigh = lambda n: F.round(SCALE * F.log1p(F.lit(float(total)) / n)).cast("long")
    rare = round(SCALE * math.log1p(float(total)))
    return stored(df.select("h", weigh(F.col("df")).alias("weight"))), max(1, rare)


def fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total weight and 64-bit SimHash of (keys, h, weight) rows; equal shingles add up."""
    bit = lambda k: F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")
    sums = [F.sum(F.when(F.col("h").bitwiseAND(bit(k)) != 0, F.col("weight")).otherwise(-F.col("weight"))).alias(f"b{k}") for k in range(64)]
    packed = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(f"b{k}") > 0, bit(k)).otherwise(F.lit(0).cast("long")) for k in range(64)])
    return rows.groupBy(*keys).agg(F.sum("weight").alias("total"), *sums).select(*keys, "total", packed.alias("print"))


def _blocks(of: Column) -> Column:
    mask = (1 << BLOCK_BITS) - 1
    return F.array(*(F.shiftrightunsigned(of, BLOCK_BITS * k).bitwiseAND(F.lit(mask).cast("long")).cast("int") for k in range(BLOCKS)))


def within_radius(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Every pair of a window's and an item's fingerprint that differ in RADIUS bits at most, once for each pair."""
    near = F.expr(f"filter(sequence(0, {(1 << BLOCK_BITS) - 1}), x -> bit_count(x) <= {RADIUS // BLOCKS})")
    index = items.select("item_id", F.col("print").alias("item_print"), F.col("total").alias("item_total"), F.posexplode(_blocks(F.col("print"))).alias("block", "value"))
    index = index.withColumn("value", F.explode(F.transform(near, lambda m: m.bitwiseXOR(F.col("value")))))
    probes = windows.select("*", F.posexplode(_blocks(F.col("print"))).alias("block", "value"))
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    found = probes.join(index, ["block", "value"]).withColumn("hamming", distance).where(F.col("hamming") <= RADIUS)
    return found.select(*_WINDOW, "total", "item_id", "item_total", "hamming").distinct()


def _described(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, no_id, whole, text): a null doc_id is told by no_id, so that plain joins and groups hold it too."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64(text).alias("whole"), F.col(text).alias("text"))


def windows_of(hits: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, no_id, whole, start, n_words) of all windows of `hits` that can reach `threshold`, some twice.

    `hits` (doc_id, no_id, whole, pos, item_id, weight, item_words, item_weight): places of an item's shingles in a
    document. Running sums over a document's hits of an item give the weight between any two places; the hits are read
    in order, so a document with many of them is spilled, never held.
    """
    by = [*_DOC, "item_id"]
    order = Window.partitionBy(*by).orderBy("pos", "kind")
    kept = [*by, "item_words", "item_weight"]
    last = (F.col("item_words") - WIDTH).alias("span")  # from a window's first shingle to its last
    summed = hits.select(*kept, "pos", "weight", last).withColumn("upto", F.sum("weight").over(Window.partitionBy(*by).orderBy("pos")))
    # Hits stand in line with, for each, the end of the window that starts there (kind 2: after a hit at that place) and
    # the start of the window that ends there (kind 0: before it).
    marks = F.array(
        F.struct(F.col("pos").alias("pos"), F.lit(1).alias("kind"), F.col("upto").alias("sum"), F.lit(None).cast("int").alias("start"), F.col("upto").alias("other")),
        F.struct((F.col("pos") + F.col("span")).alias("pos"), F.lit(2).alias("kind"), F.lit(None).cast("long").alias("sum"), F.col("pos").alias("start"), (F.col("upto") - F.col("weight")).alias("other")),
        F.struct((F.col("pos") - F.col("span")).alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("sum"), (F.col("pos") - F.col("span")).alias("start"), F.col("upto").alias("other")),
    )
    line = summed.select(*kept, "span", F.inline(marks)).withColumn("seen", F.coalesce(F.last("sum", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0).cast("long")))
    inside = F.when(F.col("kind") == 2, F.col("seen") - F.col("other")).otherwise(F.col("other") - F.col("seen"))
    good = line.where("kind <> 1").where(inside >= F.lit(threshold) * F.col("item_weight") - 1)
    start = F.greatest("start", F.lit(0))
    return good.select(*_DOC, start.alias("start"), (F.col("item_words") + F.least("start", F.lit(0))).alias("n_words"))


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity, of_text): the best window for each document and item leaked.

    Texts are compared by their lower-case words, so case, punctuation and spacing do not hide a passage. Null and empty
    texts leak nothing; items under five words have no shingle and are not searched; a window is cut at the text's
    ends; repeated documents give one row for each (doc_id, item_id); a null doc_id is searched like any other, and its
    rows are told apart by of_text, the hash of their text (else null); rows that repeat an item_id make one item; an empty table on either side gives no rows; other columns are left out.
    Whole texts are searched. Of windows alike, the first is reported.
    """
    items = item_shingles(benchmark)
    weight, rare = weights(items)
    small = items.count() <= BROADCAST_ROWS
    sent = F.broadcast if small else (lambda x: x)
    item_rows = stored(items.groupBy("item_id", "n_words", "h").agg(F.count(F.lit(1)).alias("item_tf")).join(weight, "h"))
    heavy = item_rows.groupBy("item_id", "n_words").agg(F.sum(F.col("item_tf") * F.col("weight")).alias("item_weight"))
    seeds = stored(item_rows.join(heavy, ["item_id", "n_words"]).select("h", "item_id", F.col("n_words").alias("item_words"), "weight", "item_weight"))
    shingled = _described(docs, text).select(*_DOC, word_hashes(F.col("text")).alias("w")).select(*_DOC, shingle_hashes(F.col("w")).alias("hs"))
    hits = shingled.select(*_DOC, F.posexplode_outer("hs").alias("pos", "h")).where("h is not null").join(sent(seeds), "h")
    hits = hits.repartition(*_DOC).distinct()  # the one shuffle up to the windows; repeated documents count once
    windows = stored(windows_of(hits, threshold).groupBy(*_DOC).agg(F.collect_set(F.struct("start", "n_words")).alias("windows")))
    ids = windows.select(*_DOC)  # names only, so that where they are few no other text is moved
    chosen = _described(docs, text).join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, _DOC, "left_semi").dropDuplicates(_DOC).join(windows, _DOC)
    chosen = chosen.select(*_DOC, "windows", word_hashes(F.col("text")).alias("w")).select(*_DOC, "windows", shingle_hashes(F.col("w")).alias("hs"))
    each = chosen.select(*_DOC, "hs", F.inline_outer("windows")).select(*_WINDOW, F.explode_outer(F.slice("hs", F.col("start") + 1, F.greatest(F.col("n_words") - (WIDTH - 1), F.lit(0)))).alias("h")).where("h is not null")
    counted = each.groupBy(*_WINDOW, "h").agg(F.count(F.lit(1)).alias("tf")).join(sent(weight), "h", "left")
    counted = stored(counted.select(*_WINDOW, "h", "tf", F.col("weight").isNotNull().alias("known"), F.coalesce("weight", F.lit(rare).cast("long")).alias("unit")))
    item_prints = fingerprints(item_rows.select("item_id", "h", (F.col("item_tf") * F.col("weight")).alias("weight")), ["item_id"])
    window_prints = fingerprints(counted.select(*_WINDOW, "h", (F.col("tf") * F.col("unit")).alias("weight")), _WINDOW)
    pairs = within_radius(window_prints, item_prints)
    shared = counted.where("known").join(item_rows.select("item_id", "h", "item_tf"), "h")
    shared = shared.groupBy(*_WINDOW, "item_id").agg(F.sum(F.least("tf", "item_tf") * F.col("unit")).alias("both"))
    scored = pairs.join(shared, [*_WINDOW, "item_id"]).withColumn("similarity", F.col("both") / (F.col("total") + F.col("item_total") - F.col("both"))).where(F.col("similarity") >= threshold)
    best = scored.groupBy("doc_id", "no_id", "item_id", F.when(F.col("no_id"), F.col("whole")).alias("of_text")).agg(F.min_by(F.struct(F.col("start").cast("long").alias("start_word"), F.col("n_words").cast("long").alias("n_words"), F.col("hamming").cast("long").alias("hamming"), F.round("similarity", 6).alias("similarity")), F.struct(-F.col("similarity"), "start", "n_words")).alias("best"))
    return best.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "item_id", "best.start_word", "best.n_words", "best.hamming", "best.similarity", "of_text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` without a leaked item, all columns as they are.

    All rows of a doc_id with a leak go; of rows without a doc_id, those whose text has the leak.
    """
    found = stored(leaks(docs, benchmark, text, threshold).select(F.col("doc_id").alias("__leak"), F.col("of_text").alias("__whole")).distinct())
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(text))
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__leak")) & key.eqNullSafe(F.col("__whole")), "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("of_text")


QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLES: dict[str, str] = {}
