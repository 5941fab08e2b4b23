"""License scan (operator 7): fuzzy search for short notices.

A notice of up to k edits is split into k + 1 pieces: whatever the edits, one piece stands unharmed (pigeonhole). The
pieces are searched exactly in the whole normalised text; around each hit the `regex` library matches the notice with
bounded errors and yields the span and the number of edits.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

# The phrases of the base search and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices of the method's own search: normalised words, label, edits (letters) allowed.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("licensed under the apache license version 2 0", "apache", 4),
    ("licensed under the gnu general public license", "gpl", 4),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 6),
    ("subject to the terms of the mozilla public license", "mpl", 5),
    ("licensed under cc by", "cc-by", 1),
    ("licensed under cc by sa", "cc-by-sa", 2),
    ("licensed under cc by nc", "cc-by-nc", 2),
    ("licensed under cc by nd", "cc-by-nd", 2),
    ("licensed under cc by nc sa", "cc-by-nc-sa", 2),
    ("licensed under cc by nc nd", "cc-by-nc-nd", 2),
    ("licensed under the creative commons attribution", "cc", 4),
    ("released under the mit license", "mit", 2),
    ("all rights reserved", "proprietary", 1),
    ("spdx license identifier", "spdx", 2),
)

#: What a text says of itself only where it names no licence; many licences say it too.
WEAK = "proprietary"

# A-Z to a-z; all ASCII but letters and digits to the space; other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_fuzzy", pa.int64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int64()), ("matched", pa.string())])))]
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_fuzzy long, spans array<struct<label:string,first_word:long,end_word:long,edits:long,matched:string>>"


def pieces(notice: str, edits: int) -> list[tuple[int, bytes]]:
    """(offset, piece) of `edits` + 1 parts of nearly equal length that cover the notice."""
    raw, parts = notice.encode(), edits + 1
    cuts = [len(raw) * k // parts for k in range(parts + 1)]
    return [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@cache
def _compiled(notices: tuple) -> list[tuple]:
    return [(text.encode(), label, edits, pieces(text, edits), regex.compile(b"(?e)(?<= )(?:" + text.encode() + b"){e<=%d}(?= )" % edits)) for text, label, edits in notices]


def normalised(text: str | None) -> tuple[bytes, int]:
    """The words, one space before and after each, and their number."""
    words = (text or "").encode().translate(_FOLD).split(b" ")
    words = [x for x in words if x]
    return b" " + b" ".join(words) + b" ", len(words)


def _places(norm: bytes, phrase: bytes) -> list[int]:
    found, at = [], norm.find(phrase)
    while at >= 0:
        found.append(at)
        at = norm.find(phrase, at + 1)
    return found


def fuzzy_spans(norm: bytes, notices: tuple = NOTICES) -> list[tuple[str, int, int, int, str]]:
    """(label, first byte, end byte, edits, matched text) of each place of each notice, within its allowed edits.

    No place is missed: each allowed occurrence holds an exact piece, and the region searched around a piece is as long
    as the notice with all edits spent as insertions. A match starts and ends at words, that is, at spaces. Occurrences
    of one notice that overlap count as one. Where notices of different labels overlap, the best wins, see best_spans().
    """
    spans = []
    for raw, label, edits, seeds, pattern in _compiled(notices):
        regions: list[list[int]] = []
        hits = sorted({(max(0, at - off - edits - 1), at + len(raw) - off + edits + 1) for off, seed in seeds for at in _places(norm, seed)})
        for start, end in hits:
            if regions and start <= regions[-1][1]:
                regions[-1][1] = end
            else:
                regions.append([start, end])
        for start, end in regions:
            for m in pattern.finditer(norm, start, min(end, len(norm))):
                first, last = m.span()
                while first < last and norm[first : first + 1] == b" ":
                    first += 1
                while last > first and norm[last - 1 : last] == b" ":
                    last -= 1
                if last > first:
                    spans.append((label, first, last, sum(m.fuzzy_counts), norm[first:last].decode("utf-8", "replace")))
    return best_spans(spans)


def best_spans(spans: list[tuple[str, int, int, int, str]]) -> list[tuple[str, int, int, int, str]]:
    """`spans` in order, without those that overlap one of another label with fewer edits, or as many in a longer text.

    So notices that are closer to each other than their allowed edits are told apart; of real ties all stay.
    """
    spans = sorted(spans, key=lambda s: (s[1], s[2], s[0], s[3]))
    rank = lambda s: (s[3], s[1] - s[2])
    reach = max((s[2] - s[1] for s in spans), default=0)
    starts, out = [s[1] for s in spans], []
    for s in spans:
        near = spans[bisect_left(starts, s[1] - reach) : bisect_left(starts, s[2])]
        if not any(x[0] != s[0] and x[2] > s[1] and rank(x) < rank(s) for x in near):
            out.append(s)
    return out


def scan(text: str | None, notices: tuple = NOTICES) -> tuple:
    norm, n_words = normalised(text)
    places, base = [], set()
    for phrase, label in BASE.items():
        if found := _places(norm, f" {phrase} ".encode()):
            places += found
            base.add(label)
    spans = fuzzy_spans(norm, notices)
    starts = [norm.count(b" ", 0, at + 1) - 1 for at in places]
    best = max((1.0 - s[3] / max(1, s[2] - s[1]) for s in spans), default=0.0)
    score = 1.0 if base else round(min(1.0, max(0.0, best)), 6)
    labels = base | {s[0] for s in spans}
    labels -= {WEAK} if labels - {WEAK, "spdx"} else set()
    out = [{"label": a, "first_word": norm.count(b" ", 0, b) - 1, "end_word": norm.count(b" ", 0, c), "edits": d, "matched": e} for a, b, c, d, e in spans]
    return n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, len(spans), out


def _scanned(notices: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(scan(x.as_py(), notices) for x in batch.column(1)), strict=True)) or [[]] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, t) for x, (_, t) in zip(rows, FIELDS, strict=True))], ["doc_id", *(n for n, _ in FIELDS)])

    return run


def notice_scan(docs: DataFrame, text: str = "text", notices: tuple = NOTICES) -> DataFrame:
    """One row per row of `docs`: words, base places, labels, score and the spans with their edits.

    Null text is empty: 0 words, no label, score 0. Repeated rows and repeated places count each time; an empty table
    gives no rows; other columns are left out. Long texts are searched whole; memory is a few times one batch of
    texts. score is 1 for a base phrase, else one less the edits' share of the best fuzzy span's length. "all rights
    reserved" gives a label only where no licence is named; its span is reported all the same.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scanned(notices), SCHEMA)


def op7_notice_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notice_scan(read(spark, sf_dir, "documents"))


QUERIES = {"op7_notice_scan": op7_notice_scan}
ORACLES: dict[str, str] = {}
