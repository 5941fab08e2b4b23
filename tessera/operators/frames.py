"""Recognised frames: repeated texts, regions, and sentences put together along tracks of regions.

A track is what stays in one place of a stream's picture. The fold over a stream's frames keeps the open tracks only, so
its memory is bounded by what a picture shows. In batch a stream is cut where more than `STALE` frames go by without a
frame (there every track has ended), and the parts run in parallel, each streamed through its task in order; as a stream
the same fold keeps its tracks in the state store.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# Of frame repeats, rows, tracks, headlines and pending text.
SIMILAR, RECENT = 0.97, 10
ROW, TRACK, STABLE, STALE, PENDING = 0.025, 0.045, 2, 6, 1200
# When the second engine reads a frame too.
SURE, AUDIT = 0.95, 10

LINES = "array<struct<text:string,confidence:double,script:string,x0:double,y0:double,x1:double,y1:double,review:boolean>>"
UNITS = "stream string, seq long, pos int, track string, kind string, reason string, language string, text string, confidence double, review boolean, first_seq long, frames array<long>, lines array<int>, day string"


def repeated_frames(frames: DataFrame, stream: str, order: list[str], key: str, text: str, id: str) -> DataFrame:
    """`frames` with repeated, similarity and like: whether one of the stream's ten frames before says the same.

    From the oldest on, the first of a similarity of 0.97 with the same numbers ends the search; `similarity` is the best
    up to there and `like` the `id` of its frame (null where none is alike at all). `key` is the compared text (see
    functions.text.compared_text), whose windows of ten go through native functions.
    """
    row = F.struct(F.coalesce(key, F.lit("")).alias("key"), T.number_runs(F.coalesce(text, F.lit(""))).alias("numbers"), F.col(id).alias("id"))
    before = Window.partitionBy(stream).orderBy(*order).rowsBetween(-RECENT, -1)
    out = frames.withColumn("_now", row).withColumn("_before", F.collect_list("_now").over(before))
    scored = F.transform("_before", lambda b: F.struct(T.edit_similarity(F.col("_now.key"), b["key"]).alias("sim"), (b["numbers"] == F.col("_now.numbers")).alias("same"), b["id"].alias("id")))
    hit = lambda s: (s["sim"] >= SIMILAR) & s["same"]
    out = out.withColumn("_scored", scored).withColumn("repeated", F.exists("_scored", hit))
    first = F.array_position(F.transform("_scored", hit), F.lit(True)).cast("int")
    out = out.withColumn("_seen", F.slice("_scored", F.lit(1), F.when(F.col("repeated"), first).otherwise(F.size("_scored"))))
    out = out.withColumn("similarity", F.coalesce(F.array_max(F.transform("_seen", lambda s: s["sim"])), F.lit(0.0)))
    like = F.get(F.filter("_seen", lambda s: (s["sim"] == F.col("similarity")) & (s["sim"] > 0)), F.lit(0))["id"]
    return out.withColumn("like", like).drop("_now", "_before", "_scored", "_seen")


def needs_second_reading(number: Column, lines: Column) -> Column:
    """Whether the second engine reads a frame: no line, an unsure one, or every tenth frame (`number` counts from 1)."""
    return (F.coalesce(F.size(lines), F.lit(0)) <= 0) | F.coalesce(F.exists(lines, lambda x: x["confidence"] < SURE), F.lit(False)) | (number % AUDIT == 0)


def region_class(x0: Column, x1: Column, width: Column) -> Column:
    wide, centre = (x1 - x0) / F.greatest(width, F.lit(1.0)), (x0 + x1) / 2 / F.greatest(width, F.lit(1.0))
    return F.when(wide >= 0.5, "wide").when(centre < 0.38, "left").when(centre > 0.62, "right").otherwise("center")


def _script(text: str) -> str:
    arabic, latin = re.search("[؀-ۿ]", text), re.search("[A-Za-z]", text)
    return "mixed" if arabic and latin else "ur" if arabic else "en" if latin else "unknown"


def frame_regions(lines: list[dict], width: float | None = None, height: float | None = None) -> list[dict]:
    """Lines of a frame as regions: lines joined by the mark of a double reading come apart, lines of one height make a
    row, those of one script in a row a region, read from the right in Urdu; confidence by length."""
    parts = []
    for index, line in enumerate(lines):
        split = [p.strip() for p in (line["text"] or "").split(" | ") if p.strip()]
        for p in split:
            if read := T.reading(p):
                parts.append({**line, "text": read, "index": index, "script": _script(p) if len(split) > 1 else line["script"]})
    if not parts:
        return []
    width = width if width and width > 0 else max(p["x1"] for p in parts) or 1.0
    height = height if height and height > 0 else max(p["y1"] for p in parts) or 1.0
    rows: list[list[dict]] = []
    for p in sorted(parts, key=lambda p: ((p["y0"] + p["y1"]) / 2, p["x0"])):
        p["centre"] = (p["y0"] + p["y1"]) / 2 / height
        row = next((r for r in rows if abs(p["centre"] - sum(q["centre"] for q in r) / len(r)) <= ROW), None)
        if row is None:
            rows.append(row := [])
        row.append(p)
    out = []
    for row in rows:
        for script in dict.fromkeys(p["script"] if p["script"] in ("ur", "en", "mixed") else "unknown" for p in row):
            own = sorted((p for p in row if (p["script"] if p["script"] in ("ur", "en", "mixed") else "unknown") == script), key=lambda p: p["x0"], reverse=script == "ur")
            x0, x1 = min(p["x0"] for p in own), max(p["x1"] for p in own)
            y0, y1 = min(p["y0"] for p in own), max(p["y1"] for p in own)
            weights, middle = [len(p["text"]) for p in own], (x0 + x1) / 2 / max(width, 1.0)
            place = "wide" if (x1 - x0) / max(width, 1.0) >= 0.5 else "left" if middle < 0.38 else "right" if middle > 0.62 else "center"
            out.append({"text": " ".join(p["text"] for p in own), "language": script, "centre": (y0 + y1) / 2 / height, "place": place,
                        "confidence": sum(p["confidence"] * w for p, w in zip(own, weights)) / sum(weights), "review": any(p["review"] for p in own), "lines": [p["index"] for p in own]})
    return sorted(out, key=lambda r: (r["centre"], r["place"], r["language"]))


def _valid(text: str) -> bool:
    return sum(c.isalnum() for c in text) >= 8 and sum(any(c.isalnum() for c in w) for w in text.split()) >= 3


class Tracks:
    """The open tracks of one stream. `state` is plain data, fit for JSON."""

    def __init__(self, state: list[dict] | None = None) -> None:
        self.state = state if state is not None else []

    def _restart(self, track: dict, seq: int, region: dict | None) -> None:
        track |= {"text": "", "first": None, "frames": [], "lines": [], "confidences": [], "review": False}
        if region:
            track |= {"text": region["text"], "first": seq}
            self._add(track, seq, region)

    def _add(self, track: dict, seq: int, region: dict) -> None:
        track["frames"].append(seq)
        track["lines"] = sorted({*track["lines"], *region["lines"]})
        track["confidences"].append(region["confidence"])
        track["review"] = bool(track["review"] or region["review"])

    def _unit(self, track: dict, seq: int, kind: str, reason: str, text: str, out: list[dict]) -> None:
        text = T.reading(text)
        if kind != "fragment" and not _valid(text):
            return
        sure = round(sum(track["confidences"]) / len(track["confidences"]), 6) if track["confidences"] else 0.0
        first = track["first"] if track["first"] is not None else seq
        out.append({"seq": seq, "pos": len(out), "track": track["id"], "kind": kind, "reason": reason, "language": track["language"], "text": text, "confidence": sure,
                    "review": track["review"], "first_seq": first, "frames": list(dict.fromkeys(track["frames"] or [seq])), "lines": track["lines"]})

    def _end(self, tracks: list[dict], out: list[dict]) -> None:
        for track in tracks:
            if track["text"]:
                self._unit(track, track["last"], "fragment", "stale_incomplete_track", track["text"], out)

    def close(self) -> list[dict]:
        """Fragments of all that is open, when nothing can follow it."""
        out: list[dict] = []
        self._end(self.state, out)
        self.state = []
        return out

    def take(self, seq: int, regions: list[dict]) -> list[dict]:
        out: list[dict] = []
        used: set[str] = set()
        for n, region in enumerate(regions):
            near = [t for t in self.state if t["id"] not in used and (t["language"], t["place"]) == (region["language"], region["place"]) and seq - t["last"] <= STALE and abs(t["centre"] - region["centre"]) <= TRACK]
            if near:
                track = min(near, key=lambda t: abs(t["centre"] - region["centre"]))
            else:
                track = {"id": f"{seq}:{n}", "language": region["language"], "place": region["place"], "centre": region["centre"], "last": seq, "seen": None, "stable": 0}
                self._restart(track, seq, None)
                self.state.append(track)
            used.add(track["id"])
            self._observe(track, seq, region, out)
        old = [t for t in self.state if seq - t["last"] > STALE]
        self.state = [t for t in self.state if seq - t["last"] <= STALE]
        self._end(old, out)
        return out

    def _observe(self, track: dict, seq: int, region: dict, out: list[dict]) -> None:
        same, stable, previous = track["seen"] == region["text"], track["stable"], track["last"]
        track |= {"stable": stable + 1 if same else 1, "seen": region["text"], "last": seq, "centre": track["centre"] * 0.7 + region["centre"] * 0.3}
        if not track["text"]:
            self._restart(track, seq, region)
        elif same:
            self._add(track, seq, region)
        else:
            text, shared, how = T.merge_readings(track["text"], region["text"])
            if shared or how != "no_overlap":
                track["text"] = text
                self._add(track, seq, region)
            else:  # a new text in the same place: nothing is joined that does not overlap
                if stable >= STABLE:
                    self._unit(track, seq, "headline", "stable_replacement", track["text"], out)
                else:
                    self._unit(track, previous, "fragment", "replaced_without_exact_overlap", track["text"], out)
                self._restart(track, seq, region)
        done, rest = T.split_sentences(track["text"])
        for sentence in done:
            self._unit(track, seq, "sentence", "terminal_punctuation", sentence, out)
        if done:
            self._restart(track, seq, {**region, "text": rest} if rest else None)
        elif track["stable"] >= STABLE and track["text"]:
            self._unit(track, seq, "headline", "stable_text", track["text"], out)
        if len(track["text"]) > PENDING:
            self._unit(track, seq, "fragment", "pending_overflow_without_boundary", track["text"], out)
            self._restart(track, seq, None)


_COLUMNS = [c.split()[0] for c in UNITS.split(", ")]


def _framed(units: list[dict], stream: str, day: str) -> list[dict]:
    return [u | {"stream": stream, "day": day} for u in units]


def _regions(row) -> list[dict]:
    return frame_regions([x if isinstance(x, dict) else x.asDict() for x in (row.lines if row.lines is not None else [])], row.width, row.height)


def track_units(frames: DataFrame) -> DataFrame:
    """Sentences, headlines and fragments of streams of frames (stream string, seq long, day string, width, height
    double, lines as LINES), with unit_id. Of equal sentences or headlines of a stream's day the first stays.

    Frames without seq have no place in the order and are left out; a frame without lines only ages the tracks. What is
    open at a stream's end stays open. Columns: UNITS and unit_id.
    """
    frames = frames.where(F.col("seq").isNotNull())
    order = Window.partitionBy("stream").orderBy("seq")
    gap = lambda far: F.abs(far("seq").over(order) - F.col("seq")) > STALE
    cuts = frames.select("stream", "seq").distinct().withColumn("part", F.sum(F.coalesce(gap(F.lag), F.lit(False)).cast("int")).over(order))
    cuts = cuts.withColumn("closes", F.coalesce(gap(F.lead), F.lit(False))).withColumnsRenamed({"stream": "_stream", "seq": "_seq"})
    rows = frames.join(cuts, frames.stream.eqNullSafe(F.col("_stream")) & (F.col("seq") == F.col("_seq"))).drop("_stream", "_seq")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tracks, ending = None, Tracks(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if at != (row.stream, row.part):
                    if ending:
                        out += _framed(tracks.close(), *ending)
                    at, tracks = (row.stream, row.part), Tracks()
                out += _framed(tracks.take(row.seq, _regions(row)), row.stream, row.day)
                ending = (row.stream, row.day) if row.closes else None
            yield pd.DataFrame(out, columns=_COLUMNS)
        if ending:
            yield pd.DataFrame(_framed(tracks.close(), *ending), columns=_COLUMNS)

    units = rows.repartition("stream", "part").sortWithinPartitions("stream", "part", "seq").select("stream", "part", "seq", "day", "width", "height", "lines", "closes").mapInPandas(fold, UNITS)
    key = F.when(F.col("kind") == "fragment", F.concat_ws("|", "kind", "track", "seq", "pos", "reason")).otherwise(F.lower("text"))
    first = units.groupBy("stream", "day", key.alias("_key")).agg(F.min_by(F.struct(*_COLUMNS[1:-1]), F.struct("seq", "pos")).alias("u"))
    return first.select("stream", "u.*", "day").withColumn("unit_id", F.sha2(F.concat_ws("|", "stream", "track", F.lower("text")), 256))


def track_units_stream(frames: DataFrame) -> DataFrame:
    """track_units of a stream of frames: open tracks and the digests of the newest two days in the state store.

    Frames of one micro-batch are put in order; one that comes after later frames were folded is taken as it comes.
    """
    import hashlib

    from pyspark.sql.streaming.state import GroupStateTimeout

    def fold(key, batches, state):
        kept = json.loads(state.get[0]) if state.exists else {"tracks": [], "days": {}}
        tracks, days, out = Tracks(kept["tracks"]), {d: set(x) for d, x in kept["days"].items()}, []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            for unit in _framed(tracks.take(int(row.seq), _regions(row)), key[0], row.day):
                if unit["kind"] != "fragment":
                    digest, seen = hashlib.sha256(unit["text"].lower().encode()).hexdigest()[:16], days.setdefault(row.day, set())
                    if digest in seen:
                        continue
                    seen.add(digest)
                out.append(unit)
        state.update((json.dumps({"tracks": tracks.state, "days": {d: sorted(days[d]) for d in sorted(days)[-2:]}}),))
        yield pd.DataFrame(out, columns=_COLUMNS)

    rows = frames.where(F.col("seq").isNotNull()).select("stream", "seq", "day", "width", "height", "lines")
    units = rows.groupBy("stream").applyInPandasWithState(fold, UNITS, "body string", "append", GroupStateTimeout.NoTimeout)
    return units.withColumn("unit_id", F.sha2(F.concat_ws("|", "stream", "track", F.lower("text")), 256))
