"""Vector and box arithmetic as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a key's vectors, compared two by two so that a large key is spread over tasks; rows multiplied at once.
PARTS, CHUNK = 8, 1000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths and zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def l2_normalised(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm == 0, 0.0).otherwise(x / norm))


def iou(a: Column, b: Column) -> Column:
    """Of boxes with x0, y0, x1, y1."""
    width = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    height = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    both = width * height
    union = area(a) + area(b) - both
    return F.when(union <= 0, 0.0).otherwise(both / union)


def cosine_pairs(rows: DataFrame, name: str, vector: str, key: str, least: float) -> DataFrame:
    """(a, b, key, sim): every pair a < b of one key with a cosine (as `cosine` has it) of `least` > 0 or more.

    Products of blocks find the pairs, within what their order of addition can change; the sums of those found are then
    taken in order, as the expression takes them. A null key, name or vector has no pair.
    """

    def compare(at: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, alike in frame.groupby(frame["v"].map(len)):
            names, part = alike["name"].to_numpy(), alike["part"].to_numpy()
            v = np.stack(alike["v"].to_list()).astype(np.float64)
            square = np.zeros(len(v))
            for d in range(v.shape[1]):
                square += v[:, d] * v[:, d]
            norm = np.sqrt(square)
            unit = v / np.where(norm == 0, 1.0, norm)[:, None]
            left, right = np.flatnonzero(part == at[1]), np.flatnonzero(part == at[2])
            for i in range(0, len(left), CHUNK):
                for j in range(0, len(right), CHUNK):
                    x, y = np.nonzero(unit[left[i : i + CHUNK]] @ unit[right[j : j + CHUNK]].T >= least - 1e-9)
                    x, y = left[i + x], right[j + y]
                    own = names[x] < names[y] if at[1] == at[2] else names[x] != names[y]
                    x, y = x[own], y[own]
                    both = np.zeros(len(x))
                    for d in range(v.shape[1]):
                        both += v[x, d] * v[y, d]
                    sim = both / (norm[x] * norm[y])
                    out.append(pd.DataFrame({"a": np.minimum(names[x], names[y]), "b": np.maximum(names[x], names[y]), key: at[0], "sim": sim})[sim >= least])
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], key: [], "sim": []})

    parted = rows.select(F.col(key), F.col(name).alias("name"), F.col(vector).alias("v"), F.pmod(F.xxhash64(name), F.lit(PARTS)).cast("int").alias("part")).dropna(subset=[key, "name", "v"])
    met = parted.withColumn("other", F.explode(F.array(*map(F.lit, range(PARTS))))).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    types = dict(rows.dtypes)
    return met.select(key, "low", "high", "name", "part", "v").groupBy(key, "low", "high").applyInPandas(compare, f"a {types[name]}, b {types[name]}, {key} {types[key]}, sim double")
