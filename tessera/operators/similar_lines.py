"""Pairs of token sets with an overlap of half or more, as ids: an exact prefix join that moves packed entries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters of the tokens' order, entries that a task of the join holds on average, bits of a set's sketch (a multiple of 64).
BUCKETS, PART_ENTRIES, BITS = 1 << 18, 5_000_000, 512
#: Pairs met that are held before repeats among them go.
HELD = 4_000_000
_PACKED = "part int, k binary, n binary, bits binary, held binary, h binary, r binary"
_KINDS = {"k": np.int64, "n": np.int32, "bits": np.uint64, "held": np.int32, "h": np.uint32, "r": np.int32}


def pack(k: np.ndarray, offsets: np.ndarray, h: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[dict]:
    """Entries of each set's prefix, by part: its tokens by rarity, as many as any partner must share one of.

    The order is by (count, hash); any order that all sets have in common loses no pair, counts only make it a good one.
    """
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    h = h[np.lexsort((h, counts[(h & np.uint64(BUCKETS - 1)).astype(np.int64)], row))]
    start = offsets[:-1] - offsets[0]
    r = np.arange(len(h)) - np.repeat(start, n) + 1
    bit = (h >> np.uint64(20)) % np.uint64(BITS)
    one = np.uint64(1) << (bit % np.uint64(64))
    bits = np.stack([np.bitwise_or.reduceat(np.where(bit // np.uint64(64) == j, one, np.uint64(0)), start) for j in range(BITS // 64)], axis=1)
    kept = np.flatnonzero(r <= n[row] // 2 + 1)
    part = ((h[kept] >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
    kept = kept[by := np.argsort(part, kind="stable")]
    ends = np.searchsorted(part[by], np.arange(parts + 1))
    for p in range(parts):
        if len(e := kept[ends[p] : ends[p + 1]]):
            lines, held = np.unique(row[e], return_counts=True)
            made = {"k": k[lines], "n": n[lines], "bits": bits[lines], "held": held, "h": h[e] & np.uint64(0xFFFFFFFF), "r": r[e]}
            yield {"part": p} | {c: made[c].astype(kind).tobytes() for c, kind in _KINDS.items()}


def meet(k: np.ndarray, n: np.ndarray, bits: np.ndarray, held: np.ndarray, h: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids that share a token of a part, whose sizes, places and sketches allow the overlap; each once.

    What is left of both sets from the shared token on must allow it, and so must the bits in which the sketches differ.
    """
    line = np.repeat(np.arange(len(k)), held)
    first = np.zeros(len(k), bool)
    first[np.unique(k, return_index=True)[1]] = True  # copies have the same entries
    e = first[line]
    line, h, r = line[e], h[e], r[e]
    order = np.lexsort((n[line], h))
    line, h, r = line[order], h[order], r[order]
    size = n[line]
    left = size - r + 1
    end = np.searchsorted(h, h, side="right")
    found, met = [np.zeros(0, np.int64)], 0
    at, step = np.arange(len(h)), 0
    while len(at):
        step += 1
        at = at[at + step < end[at]]
        at = at[size[at + step] <= 2 * size[at]]  # by size: what follows is larger still
        to = at + step
        total = size[at] + size[to]
        ok = 3 * np.minimum(left[at], left[to]) >= total
        a, b, total = line[at[ok]], line[to[ok]], total[ok]
        differ = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
        ok = 3 * (total - differ) >= 2 * total
        found.append(np.minimum(a[ok], b[ok]) * len(k) + np.maximum(a[ok], b[ok]))
        met += len(found[-1])
        if met > HELD:
            found = [np.unique(np.concatenate(found))]
            met = len(found[0]) // 2
    pairs = np.unique(np.concatenate(found))
    a, b = k[pairs // max(1, len(k))], k[pairs % max(1, len(k))]
    return np.minimum(a, b), np.maximum(a, b)


def similar_pairs(sets: DataFrame, words: DataFrame) -> DataFrame:
    """(a, b), a < b: ids of sets that may have an overlap of 0.5 or more, none of those that have it left out.

    `sets` has an id k (equal for copies, else not) and hs, the 64-bit hashes of four distinct tokens or more.
    `words` has hashes h of all texts' words, roughly split: they are counted for the order of the tokens alone.
    """
    seen = words.groupBy(F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket")).count().toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[seen["bucket"].to_numpy()] = seen["count"].to_numpy()
    parts = max(1, round(int(counts.sum()) * 0.55 / PART_ENTRIES))
    counts = np.minimum(counts, 2**31 - 1).astype(np.int32)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in _KINDS)])
        for b in batches:
            if b.num_rows:
                lists = b.column("hs")
                offsets = lists.offsets.to_numpy().astype(np.int64)
                h = lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
                yield pa.RecordBatch.from_pylist(list(pack(b.column("k").to_numpy(), offsets, h, counts, parts)), schema)

    def joined(table: pa.Table) -> pa.Table:
        read = {c: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[c]]) for c, kind in _KINDS.items()}
        read["bits"] = read["bits"].reshape(-1, BITS // 64)
        return pa.table(dict(zip("ab", meet(**read))))

    return sets.select("k", "hs").mapInArrow(packed, _PACKED).groupBy("part").applyInArrow(joined, "a long, b long").distinct()
