"""Tracks, repeated frames, cursors, leases, translation by memory, the taxonomy dimension; streams against batch."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import delivery, frames
from tessera.streaming import live

SF = "/root/testdata/sf0.001"
FRAMES = f"stream string, seq long, day string, width double, height double, lines {frames.LINES}"


def _line(text, y=500.0, confidence=0.9, script="en", x0=0.0, x1=900.0):
    return (text, confidence, script, x0, y, x1, y + 40, False)


def _frames(spark, texts, day="2024-01-01"):
    return spark.createDataFrame([("s", n, day, 1000.0, 1000.0, [] if t is None else [_line(t)] if isinstance(t, str) else t) for n, t in texts], FRAMES)


def _units(df):
    return [(r.seq, r.kind, r.reason, r.text) for r in df.orderBy("seq", "pos").collect()]


def test_stable_headline_is_emitted_once(spark):
    got = _units(frames.track_units(_frames(spark, [(k, "Assembly session begins today") for k in range(1, 6)])))
    assert got == [(2, "headline", "stable_text", "Assembly session begins today")]


def test_overlapping_fragments_become_a_sentence(spark):
    got = _units(frames.track_units(_frames(spark, [(1, "The minister said that"), (2, "said that prices will"), (3, "prices will fall. Next item")])))
    assert got == [(3, "sentence", "terminal_punctuation", "The minister said that prices will fall.")]


def test_replacement_without_overlap_is_a_fragment(spark):
    got = _units(frames.track_units(_frames(spark, [(1, "One unfinished thought about"), (2, "Entirely different words here")])))
    assert got == [(1, "fragment", "replaced_without_exact_overlap", "One unfinished thought about")]


def test_track_ends_after_six_frames_without_it(spark):
    cut = _frames(spark, [(1, "A line that never ends"), (8, "Some other line of text")])
    empty = _frames(spark, [(1, "A line that never ends"), *((k, None) for k in range(2, 9))])
    for rows in (cut, empty):
        assert [(r.kind, r.reason, r.text, r.first_seq) for r in frames.track_units(rows).collect()] == [("fragment", "stale_incomplete_track", "A line that never ends", 1)]


def test_frames_without_lines_or_rows(spark):
    assert frames.track_units(_frames(spark, [(1, None)])).count() == 0
    assert frames.track_units(_frames(spark, [(1, "x")]).limit(0)).count() == 0
    nulls = spark.createDataFrame([("s", 1, None, None, None, None), ("s", None, None, None, None, None)], FRAMES)
    assert frames.track_units(nulls).count() == 0


def test_regions_by_row_script_and_place():
    names = ("text", "confidence", "script", "x0", "y0", "x1", "y1", "review")
    lines = [dict(zip(names, x)) for x in (_line("right part", 100.0, 0.5, "en", 400.0, 500.0), _line("left", 110.0, 1.0, "en", 0.0, 100.0), _line("خبر | news", 600.0, 0.8, "mixed", 0.0, 100.0))]
    got = [(r["text"], r["language"], r["place"], round(r["confidence"], 4)) for r in frames.frame_regions(lines, 1000.0, 1000.0)]
    assert got == [("left right part", "en", "wide", round((10 * 0.5 + 4) / 14, 4)), ("news", "en", "left", 0.8), ("خبر", "ur", "left", 0.8)]


def test_repeated_frame_needs_the_same_numbers(spark):
    rows = spark.createDataFrame([("s", 1, "the total count stands at 12 seats in the whole assembly"), ("s", 2, "the total count stands at 13 seats in the whole assembly"), ("s", 3, "The total count stands at 13 seats, in the whole assembly")], "stream string, seq int, text string")
    found = frames.repeated_frames(rows.withColumn("key", T.compared_text("text")), "stream", ["seq"], "key", "text", "seq")
    assert [(r.seq, r.repeated, r.like) for r in found.orderBy("seq").collect()] == [(1, False, None), (2, False, 1), (3, True, 2)]


def test_tracks_as_stream_equal_batch(spark, tmp_path):
    from tessera.plans.frames import turn_frames

    rows = turn_frames(spark, SF).where("cast(stream as int) < 12")
    for k in range(3):  # micro-batches in the order of the frames
        rows.where(F.floor(F.col("seq") / 8) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = rows.agg(F.max("seq")).first()[0]
    assert last < 24
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    columns = ["stream", "seq", "track", "kind", "reason", "text", "confidence", "first_seq", "unit_id"]
    got = live.drain_to_memory(frames.track_units_stream(stream), str(tmp_path / "cp"), "append").select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, frames.track_units(rows).select(columns).collect()))


def test_stories_as_stream_equal_batch(spark, tmp_path):
    from tessera.operators import stories
    from tessera.plans.domain import _observations

    rows = _observations(spark, SF)
    for k in range(2):
        rows.where(F.col("seq") % 50 >= 25 if k else F.col("seq") % 50 < 25).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = live.drain_to_memory(stories.cluster_stories_stream(stream), str(tmp_path / "cp"), "append")
    want = stories.cluster_stories(rows)
    assert want.count() > 50
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_cursors_go_round_and_refuse_others(spark):
    rows = spark.sql("select timestamp '2024-01-01 05:00:00.25' as at, 'abc' as id")
    value = rows.select(delivery.cursor(F.col("at"), F.col("id"), "k" * 80)).first()[0]
    at, identifier = delivery.read_cursor(value, "k" * 80)
    assert (at.isoformat(), identifier) == ("2024-01-01T05:00:00.250000+00:00", "abc")
    for bad, secret in ((value, "other"), (value[:-3] + "AAA", "k" * 80), ("", "k" * 80), ("é", "k" * 80)):
        with pytest.raises(ValueError):
            delivery.read_cursor(bad, secret)


def test_memory_and_engine(spark):
    rows = spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, "c"), (4, None), (5, " "), (6, "d")], "id int, text string").withColumns({"source": F.lit("en"), "target": F.lit("ur")})
    none = spark.createDataFrame([], "key string, translated string")
    engine = delivery.static_engine({("en", "ur", "a b"): "AB", ("en", "ur", "c"): "C"})
    out, memory = delivery.translate_missing(rows, none, engine)
    assert [(r.id, r.translated, r.cached) for r in out.orderBy("id").collect()] == [(1, "AB", False), (2, "AB", False), (3, "C", False), (4, None, False), (5, None, False), (6, None, False)]
    assert memory.count() == 3
    again, _ = delivery.translate_missing(rows, memory.where("translated is not null"), delivery.static_engine({}))
    assert [(r.id, r.translated, r.cached) for r in again.where("id < 4").orderBy("id").collect()] == [(1, "AB", True), (2, "AB", True), (3, "C", True)]


def test_taxonomy_rows(spark):
    rows = [("war", 0, ["army"], {"en": ["Strike", "strike", "Front line"]}), ("work", 40, ["union"], {"en": ["strike"], "ur": ["ہڑتال"]})]
    categories = spark.createDataFrame(rows, "id string, position int, context array<string>, terms map<string,array<string>>")
    dimension, terms = delivery.taxonomy_rows(categories, ["front line"], ["ہڑتال"], [])
    assert {r.id: r.priority for r in dimension.collect()} == {"war": 90, "work": 10}
    got = {(r.id, r.normalised): (r.term, r.priority, r.requires_context, r.context_terms) for r in terms.collect()}
    assert got == {("war", "strike"): ("Strike", "normal", True, ["army"]), ("war", "front line"): ("Front line", "critical", False, []), ("work", "strike"): ("strike", "normal", True, ["union"]), ("work", "ہڑتال"): ("ہڑتال", "high", False, [])}


def test_original_spans(spark):
    row = spark.createDataFrame([("  Æ ﬁne\tDAY ",)], "text string").select(T.match_view("text").alias("v")).first().v
    assert row.normalised == "æ fine day"
    urdu = spark.createDataFrame([("\u06c1\u0691\u062a\u0627\u0644 \u0645\u064f\u0644\u06a9",)], "text string").select(T.match_view("text").alias("v")).first().v
    assert (urdu.normalised, urdu.origin) == ("\u06c1\u0691\u062a\u0627\u0644 \u0645\u0644\u06a9", [0, 1, 2, 3, 4, 5, 6, 8, 9])
    assert row.origin[row.normalised.index("day")] == "  Æ ﬁne\tDAY ".index("DAY")
