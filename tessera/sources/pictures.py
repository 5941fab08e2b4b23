"""Pictures in byte streams: frames cut out of a pipe's chunks, and their sizes. JPEG's own markers are fixed values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

START, END = b"\xff\xd8", b"\xff\xd9"
LARGEST = 20_000_000
#: Markers of frame headers, which hold the size: C0 to CF but for tables (C4), JPG (C8) and arithmetic conditioning (CC).
HEADERS = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def cut(pending: bytes, chunk: bytes, largest: int = LARGEST) -> tuple[list[bytes], bytes]:
    """(finished pictures, what is pending) after one more chunk. Bytes outside pictures go; a picture that would be
    larger than `largest` is given up and the search goes on after its start."""
    data, out = pending + chunk, []
    while (start := data.find(START)) >= 0:
        end = data.find(END, start + 2)
        if end >= 0 and end + 2 - start <= largest:
            out.append(data[start : end + 2])
            data = data[end + 2 :]
        elif end >= 0 or len(data) - start > largest:
            data = data[start + 2 :]
        else:
            return out, data[start:]
    return out, data[-1:] if data.endswith(b"\xff") else b""


def size(picture: bytes | None) -> tuple[int | None, int | None]:
    """(width, height) by the first frame header; nulls where there is none."""
    if not picture or not picture.startswith(START):
        return None, None
    at = 2
    while at + 4 <= len(picture):
        if picture[at] != 0xFF:
            return None, None
        marker = picture[at + 1]
        if marker == 0xFF:  # filling
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:  # markers without a body
            at += 2
        elif marker in HEADERS:
            return (int.from_bytes(picture[at + 7 : at + 9]), int.from_bytes(picture[at + 5 : at + 7])) if at + 9 <= len(picture) else (None, None)
        else:
            length = int.from_bytes(picture[at + 2 : at + 4])
            if length < 2 or marker in (0xD9, 0xDA):
                return None, None
            at += 2 + length
    return None, None


@F.pandas_udf(StructType().add("width", IntegerType()).add("height", IntegerType()))
def picture_size(pictures: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([size(p) for p in pictures], columns=["width", "height"]).astype("Int32")


def framed_pictures(chunks: DataFrame, stream: str = "stream", order: str = "seq", data: str = "data") -> DataFrame:
    """(stream, number, picture) of chunks of bytes: each stream's chunks in order, at most one picture pending at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, pending, number = None, b"", 0
        for batch in batches:
            out = []
            for name, chunk in zip(batch["stream"], batch["data"]):
                if name != at:
                    at, pending, number = name, b"", 0
                done, pending = cut(pending, chunk or b"")
                for picture in done:
                    out.append((name, number, picture))
                    number += 1
            yield pd.DataFrame(out, columns=["stream", "number", "picture"])

    kind = dict(chunks.dtypes)[stream]
    rows = chunks.select(F.col(stream).alias("stream"), F.col(order).alias("seq"), F.col(data).alias("data"))
    return rows.repartition("stream").sortWithinPartitions("stream", "seq").select("stream", "data").mapInPandas(run, f"stream {kind}, number long, picture binary")
