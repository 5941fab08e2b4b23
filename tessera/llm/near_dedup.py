"""MinHash near-dedup (operator 4): improved consistent weighted sampling over TF-IDF shingles.

1. Exact copies (equal word sequences) form a class; one pass gives each document's class and the corpus' document
   frequencies, in two tables of fixed size by shingle hash.
2. Each class gets K weighted samples, banded into BANDS keys of ROWS samples.
3. In each bucket, classes are compared with each other (small buckets) or with a pivot (large ones). Where a large bucket
   then holds more than one group, classes of different groups are compared if neither their distances to the pivot nor
   their samples rule a link out, see `_undecided`.
4. Candidates are verified by the exact weighted Jaccard similarity of their texts; links form groups.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, read, stored

WIDTH, THRESHOLD = 5, 0.8
#: 1 - (1 - 0.8**6)**20 = 0.998 of the pairs at the threshold meet in a band.
BANDS, ROWS = 20, 6
K = BANDS * ROWS
#: Document frequencies are counted in two tables of 2 ** DF_BITS entries by different bits of a shingle's hash; their size,
#: and what is broadcast of them, do not grow with the corpus.
DF_BITS = 16
#: A shingle weighs tf * (1 + ln(1 / share)), where share is the part of all documents that have it, RARE at least: the
#: rarer ones weigh alike. So weights depend on shares, not on the corpus' size, and the tables can tell them at any size.
RARE = 0.01
#: Buckets up to this size are compared all with all.
SMALL = 16
#: Two classes of a large bucket are compared unless they differ in more samples (by four bits each) than the mean at the
#: threshold and this many standard deviations: once in some 10,000 pairs at the threshold.
APART_SD = 4.0
#: Further K samples each of the classes in large buckets of several groups: with 120 samples a similarity of 0.64 still
#: passes, with 960 none below 0.75 in general.
FINE = 8
#: Classes of a large bucket that one task compares with the rest of it.
BLOCK = 256
#: Document ids up to which the set of texts to verify is broadcast (16 bytes each).
BROADCAST_ROWS = 1_000_000
#: Classes that a task remembers so as not to sign copies again, and shingles that it remembers while it compares.
SEEN, REMEMBERED = 200_000, 2_000_000

_GAPS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Letters of scripts without spaces between words: each is a word of its own.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_M, _POOL_BITS, _BLOCKS = np.uint64(0x9E3779B97F4A7C15), 14, 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    text = (text or "").lower()
    if not text.isascii():
        text = _UNSPACED.sub(r" \g<0> ", text)
    return text.encode().translate(_GAPS).split()


def class_key(found: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(found))


def shingles(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and how often each occurs; under five words all of them make one shingle."""
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    width = min(WIDTH, len(w))
    h = w[: len(w) - width + 1].copy()
    for k in range(1, width):
        h = h * _M + w[k : len(w) - width + 1 + k]
    return np.unique(_mix(h), return_counts=True)


def buckets(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shingle's entry in each of the two tables."""
    mask = np.uint64((1 << DF_BITS) - 1)
    return (h >> np.uint64(64 - DF_BITS)).astype(np.int64), ((h >> np.uint64(64 - 2 * DF_BITS)) & mask).astype(np.int64)


def idf_tables(df: np.ndarray, n: int) -> np.ndarray:
    """idf by entry, of the tables' counts (2, 2 ** DF_BITS) over `n` documents.

    An entry's usual count is what rare shingles add up to there, and grows with the corpus; what is above it is the
    frequent shingle's own.
    """
    own = np.maximum(df - np.median(df, axis=1, keepdims=True), 0)
    return (1 - np.log(np.clip(own / max(1, n), RARE, 1.0))).astype(np.float32)


def weigh(h: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """tf-idf; of a shingle's two entries, that with less of others in it counts."""
    first, second = buckets(h)
    return tf * np.maximum(idf[0][first], idf[1][second]).astype(np.float64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of (sorted hashes, weights); 1 for two without a word."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    both = 0.0
    if len(a[0]):
        at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
        both = np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum()
    either = a[1].sum() + b[1].sum() - both
    return float(both / either) if either else 1.0


class Sampler:
    """ICWS: each shingle draws its gamma and uniform variates from fixed pools by parts of its hash."""

    def __init__(self) -> None:
        rng = np.random.Generator(np.random.PCG64(20_240_601))
        shape = (_BLOCKS, 1 << _POOL_BITS, K // _BLOCKS)
        self.r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
        self.c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
        self.beta = rng.random(shape).astype(np.float32)

    def samples(self, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """K samples (shingle, level) as hashes; the same set gives the same samples anywhere."""
        log_w = np.log(weight).astype(np.float32)[:, None]
        width, picked = K // _BLOCKS, np.zeros(K, np.uint64)
        for k in range(_BLOCKS):
            at = ((h >> np.uint64(k * _POOL_BITS)) & np.uint64((1 << _POOL_BITS) - 1)).astype(np.int64)
            best = np.full(width, np.inf, np.float32)
            for start in range(0, len(h), 4096):
                part = at[start : start + 4096]
                r, beta = self.r[k][part], self.beta[k][part]
                t = np.floor(log_w[start : start + 4096] / r + beta)
                a = self.c[k][part] - r * (t - beta + 1)
                low = a.argmin(0)
                col = np.arange(width)
                better = a[low, col] < best
                key = h[start + low] ^ (t[low, col].astype(np.int64).astype(np.uint64) * _M)
                picked[k * width : (k + 1) * width] = np.where(better, _mix(key), picked[k * width : (k + 1) * width])
                best = np.minimum(best, a[low, col])
        return picked

    def bands(self, h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BANDS keys of a class, each of ROWS samples, and four bits of every sample, see _four_bits()."""
        picked = self.samples(h, weight)
        keys = np.arange(1, BANDS + 1, dtype=np.uint64)
        for row in picked.reshape(BANDS, ROWS).T:
            keys = keys * _M + row
        return _mix(keys).view(np.int64), _four_bits(picked)

    def fine(self, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Four bits each of FINE * K further samples, independent of those of bands()."""
        return np.concatenate([_four_bits(self.samples(_mix(h + np.uint64(k * int(_M) % 2**64)), weight)) for k in range(1, FINE + 1)])


def _four_bits(picked: np.ndarray) -> np.ndarray:
    """8 longs: 2k and 2k + 1 hold bit k of all samples."""
    bits = np.zeros((4, 128), np.uint8)
    for k in range(4):
        bits[k, :K] = (picked >> np.uint64(k)) & np.uint64(1)
    return np.packbits(bits, axis=1).reshape(-1).view(np.int64)


_kept: dict[str, Sampler] = {}


def sampler() -> Sampler:
    """A worker's sampler, made once."""
    claim("near_dedup", _kept.clear)
    if "sampler" not in _kept:
        _kept["sampler"] = Sampler()
    return _kept["sampler"]


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, null, null) of each document, at the end (null, null, entry, documents) of what the task read."""
    claim("near_dedup", _kept.clear)
    names = ["doc_id", "key", "entry", "n"]
    df = np.zeros((2, 1 << DF_BITS), np.int64)
    for batch in batches:
        keys = []
        for text in batch.column(1):
            found = words(text.as_py())
            keys.append(class_key(found))
            for table, at in zip(df, buckets(shingles(found)[0]), strict=True):
                np.add.at(table, at, 1)
        nothing = pa.nulls(len(keys), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), nothing, nothing], names)
    df = df.ravel()
    at = np.flatnonzero(df)
    for start in range(0, len(at), 50_000):
        part = at[start : start + 50_000]
        nothing = pa.nulls(len(part), pa.int64())
        yield pa.RecordBatch.from_arrays([nothing, pa.nulls(len(part), pa.binary()), pa.array(part), pa.array(df[part])], names)


def _signed(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sign, seen = idf.value, sampler(), set()
        for batch in batches:
            keys, bands, samples = [], [], []
            for text in batch.column(0):
                found = words(text.as_py())
                key = class_key(found)
                if not found or key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                h, tf = shingles(found)
                keys.append(key)
                signed = sign.bands(h, weigh(h, tf, table))
                bands.append(signed[0])
                samples.append(signed[1])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(bands, longs), pa.array(samples, longs)], ["key", "bands", "samples"])

    return run


def _sketched(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sign = idf.value, sampler()
        for batch in batches:
            fine = []
            for text in batch.column(1):
                h, tf = shingles(words(text.as_py()))
                fine.append(sign.fine(h, weigh(h, tf, table)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fine, pa.list_(pa.int64()))], ["id", "fine"])

    return run


def _compared(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_dedup", _kept.clear)
        table, known, size = idf.value, {}, 0

        def weighted(doc_id: int, text: pa.StringScalar) -> tuple[np.ndarray, np.ndarray]:
            nonlocal size
            if doc_id not in known:
                h, tf = shingles(words(text.as_py()))
                if size + len(h) > REMEMBERED:
                    known.clear()
                    size = 0
                known[doc_id] = h, weigh(h, tf, table)
                size += len(h)
            return known[doc_id]

        for batch in batches:
            ids = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            sims = [similarity(weighted(a, batch.column(2)[k]), weighted(b, batch.column(3)[k])) for k, (a, b) in enumerate(ids)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], ["a", "b", "sim"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in `edges` (a, b): the lowest id of its component.

    Randomised contraction: in each round every node falls to the one of the lowest hash among itself and its neighbours,
    and the edges between different nodes that are left go to the next round, with another hash. A group of any shape
    shrinks by a constant factor a round on average. Each round is written to the shared folder, so a lost executor
    repeats one round at most.
    """
    lower = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = stored(edges.select(*lower("a", "b")).distinct())
    labels = stored(left.select(F.col("a").alias("id")).union(left.select("b")).distinct().select("id", F.col("id").alias("root")))
    left, n = left.where("a < b"), 0
    while not left.isEmpty():
        ranked = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(n)).alias("rank"), F.col(c).alias("at"))  # noqa: B023, E731
        near = left.select(F.col("a").alias("node"), F.col("b").alias("next")).union(left.select("b", "a"))
        to = stored(near.groupBy("node").agg(F.min(ranked("next")).alias("low")).select("node", F.least("low", ranked("node"))["at"].alias("to")))
        moved = left.join(to.toDF("a", "to_a"), "a").join(to.toDF("b", "to_b"), "b").where("to_a <> to_b")
        left = stored(moved.select(*lower("to_a", "to_b")).distinct())
        labels = stored(labels.join(to.toDF("root", "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root")))
        n += 1
    return stored(labels.join(labels.groupBy("root").agg(F.min("id").alias("low")), "root").select("id", F.col("low").alias("root")))


def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """`groups` (id, root) after further `links` (a, b): only edges between different groups go through components()."""
    nodes = groups.union(links.select(F.col("a").alias("id"), F.col("a").alias("root"))).union(links.select("b", "b"))
    nodes = stored(nodes.groupBy("id").agg(F.min("root").alias("root")))
    edges = links.join(nodes.toDF("a", "root_a"), "a").join(nodes.toDF("b", "root_b"), "b").where("root_a <> root_b")
    top = components(edges.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    return stored(nodes.join(top.toDF("root", "low"), "root", "left").select("id", F.coalesce("low", "root").alias("root")))


def _candidates(members: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Of (band, id): pairs (a, b) to compare, and (band, id, pivot) of the buckets above `small`.

    In a small bucket all pairs are candidates, in a large one each class and the bucket's pivot, which differs from
    band to band.
    """
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("id", "band"), "id"))["id"].alias("pivot")).where("n > 1")
    met = stored(members.join(sizes, "band").select("band", "id", "n", "pivot"))
    few = met.where(F.col("n") <= small)
    some = few.select("band", F.col("id").alias("a")).join(few.select("band", F.col("id").alias("b")), "band").where("a < b").select("a", "b")
    large = met.where(F.col("n") > small).select("band", "id", "pivot")
    star = large.where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
    return stored(some.union(star).distinct()), large


def _apart(x: str, y: str, rounds: int = 1) -> Column:
    """In how many of `rounds` * K samples two classes differ, by four bits of each."""
    differ = lambda at: reduce(lambda p, q: p.bitwiseOR(q), [F.col(x)[2 * k + at].bitwiseXOR(F.col(y)[2 * k + at]) for k in range(4)])
    return reduce(lambda p, q: p + q, [F.bit_count(differ(8 * r + half)) for r in range(rounds) for half in (0, 1)])


def max_apart(samples: int, threshold: float) -> int:
    """Differing samples up to which a similarity of `threshold` cannot be ruled out; a differing one shows in 15 of 16."""
    p = (1 - threshold) * 15 / 16
    return math.ceil(samples * p + APART_SD * math.sqrt(samples * p * (1 - p)))


def _mixed(large: DataFrame, groups: DataFrame) -> DataFrame:
    """(band, id, pivot, root, blocks) of the large buckets that hold more than one group."""
    rooted = large.join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = rooted.groupBy("band").agg(F.count(F.lit(1)).alias("n"), (F.min("root") < F.max("root")).alias("mixed"))
    return stored(rooted.join(mixed.where("mixed").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "band"))


def _undecided(mixed: DataFrame, compared: DataFrame, samples: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, apart) of different groups in the same large bucket that can still be linked, with how far they are apart.

    1 - similarity is a metric, so linked classes are about as far from the pivot. A bucket's classes are dealt into
    blocks, and the bucket is sent to each of its blocks: no task gets more than a block against the bucket. A pair is
    given by the lowest of the buckets that it shares; what rules it out there rules it out everywhere.
    """
    to_pivot = compared.select("a", "b", "sim").union(compared.select("b", "a", "sim")).toDF("id", "pivot", "sim")
    rows = mixed.join(to_pivot, ["id", "pivot"], "left").join(samples, "id").join(mixed.groupBy("id").agg(F.collect_set("band").alias("bands")), "id")
    rows = stored(rows.select("band", "blocks", "id", "root", F.when(F.col("id") == F.col("pivot"), 1.0).otherwise(F.col("sim")).alias("sim"), "samples", "fine", "bands"))
    x = rows.select("band", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.col("id").alias("x"), F.col("root").alias("rx"), F.col("sim").alias("sx"), F.col("samples").alias("px"), F.col("fine").alias("fx"), F.col("bands").alias("bx"))
    y = rows.select("band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("y"), F.col("root").alias("ry"), F.col("sim").alias("sy"), F.col("samples").alias("py"), F.col("fine").alias("fy"), F.col("bands").alias("by"))
    meet = (x["band"] == y["band"]) & (x["block"] == y["block"]) & (F.col("rx") < F.col("ry"))
    near = (F.abs(F.col("sx") - F.col("sy")) <= 1 - threshold + 1e-9) & (_apart("px", "py") <= max_apart(K, threshold)) & (_apart("fx", "fy", FINE) <= max_apart(FINE * K, threshold))
    pairs = x.join(y, meet & near & (F.array_min(F.array_intersect("bx", "by")) == x["band"])).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), _apart("fx", "fy", FINE).alias("apart")).distinct()
    return stored(pairs.join(compared, ["a", "b"], "left_anti"))


class NearDuplicates:
    """The stages of one run; `links` and `groups` are the results."""

    def __init__(self, docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, small: int = SMALL) -> None:
        spark = docs.sparkSession
        self.threshold = threshold
        self.rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
        once = stored(self.rows.mapInArrow(_classes, "doc_id long, key binary, entry long, n long"))
        self.docs = once.where("key is not null").select("doc_id", "key")
        counts = once.where("entry is not null").groupBy("entry").agg(F.sum("n").alias("n")).toArrow()
        df = np.zeros(2 << DF_BITS, np.int64)
        df[counts["entry"].to_numpy()] = counts["n"].to_numpy()
        self.idf = spark.sparkContext.broadcast(idf_tables(df.reshape(2, -1), self.docs.count()))
        self.classes = stored(self.docs.groupBy("key").agg(F.min("doc_id").alias("id")))
        signed = self.rows.select("text").mapInArrow(_signed(self.idf), "key binary, bands array<long>, samples array<long>")
        signed = stored(signed.groupBy("key").agg(F.first("bands").alias("bands"), F.first("samples").alias("samples")).join(self.classes, "key").select("id", "bands", "samples"))
        members = signed.select("id", F.explode_outer("bands").alias("band"))
        pairs, large = _candidates(members, small)
        compared = self.compare(pairs)
        self.links = compared.where(F.col("sim") >= threshold)
        self.groups = components(self.links)
        mixed = _mixed(large, self.groups)
        if mixed.isEmpty():
            return
        fine = self.texts(stored(mixed.select(F.col("id").alias("doc_id")).distinct())).mapInArrow(_sketched(self.idf), "id long, fine array<long>")
        pairs = _undecided(mixed, compared, signed.select("id", "samples").join(fine, "id"), threshold)
        # Those likely to be links first: they join groups, and what is then in one group needs no comparison.
        likely = F.col("apart") <= FINE * K * (1 - threshold) * 15 / 16
        for some in (likely, ~likely):
            left = pairs.where(some).select("a", "b")
            for end in ("a", "b"):
                left = left.join(self.groups.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
            left = stored(left.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
            if not left.isEmpty():
                more = self.compare(left).where(F.col("sim") >= threshold)
                self.links, self.groups = self.links.union(more), joined(self.groups, more)

    def compare(self, pairs: DataFrame) -> DataFrame:
        """(a, b, sim) of each pair, stored; the texts of the pairs' classes only are moved, and never broadcast: they grow."""
        texts = self.texts(stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()))
        one, two = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
        both = pairs.join(two.hint("merge"), "b").join(one.hint("merge"), "a").select("a", "b", "text_a", "text_b")
        return stored(both.mapInArrow(_compared(self.idf), "a long, b long, sim double"))

    def texts(self, wanted: DataFrame) -> DataFrame:
        """(doc_id, text) of the `wanted` doc_ids, stored."""
        sent = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        return stored(self.rows.join(sent, "doc_id").groupBy("doc_id").agg(F.first("text").alias("text")))

    def members(self) -> DataFrame:
        """(doc_id, class_id): the lowest doc_id of each document's group, itself where it has none."""
        roots = self.classes.join(self.groups, "id", "left").select("key", F.coalesce("root", "id").alias("class_id"))
        return self.docs.join(roots, "key").select("doc_id", "class_id")


def near_duplicates(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, kept) of each row of `docs`; kept where doc_id is its group's lowest.

    Groups are the connected components of links of weighted Jaccard similarity `threshold` or more over shingles of five
    lower-case words (in scripts without spaces each letter is a word); texts with equal words are linked without more ado, those without any word too (null, empty).
    doc_id identifies a text: rows that repeat it are copies. Rows with a null doc_id are left out. An empty table gives
    no rows; other columns are left out. Whole texts are used.
    """
    return NearDuplicates(docs, text, threshold).members().withColumn("kept", F.col("doc_id") == F.col("class_id"))


def near_dedup(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` without near duplicates: one document of each group stays; null doc_ids stay.

    All columns are kept as they are. Where rows repeat a kept doc_id, one of them stays.
    """
    found = stored(near_duplicates(docs, text, threshold))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    again = stored(found.where("kept").groupBy(F.col("doc_id").alias("__again")).count().where("count > 1").select("__again"))
    on = F.col("doc_id").cast("long")
    stay = docs.join(gone, on == F.col("__gone"), "left_anti")
    if again.isEmpty():
        return stay
    return stay.join(again, on == F.col("__again"), "left_anti").union(stay.join(again, on == F.col("__again"), "left_semi").dropDuplicates(["doc_id"]))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op4_near_dedup": op4_near_dedup}
ORACLES: dict[str, str] = {}
