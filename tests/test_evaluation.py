import json

from pyspark.sql import functions as F

from tessera.operators import evaluation
from tessera.sources import manifests
from tessera.streaming import live


def _step(n, text, language, stream, at, category, action, vector):
    return {"step_id": f"s{n}", "text": text, "language": language, "stream_id": stream, "channel_name": stream, "observed_at": at, "category_ids": category, "expected_action": action, "embedding": vector}


STEPS = [
    _step(1, "Cabinet approved the new water policy", "en", "a", "2026-01-01T05:00:00Z", ["politics"], "created", [1.0, 0.0, 0.0, 0.0]),
    _step(2, "Cabinet approved the new water policy!", "en", "a", "2026-01-01T08:00:00Z", ["politics"], "merged", [1.0, 0.0, 0.0, 0.0]),
    _step(3, "Cabinet approved a new national water policy", "en", "b", "2026-01-01T08:20:00Z", ["politics", "water"], "merged", [0.915, 0.4034, 0.0, 0.0]),
    _step(4, "Blast injured 5 people in the market", "en", "a", "2026-01-01T09:00:00Z", ["security"], "created", [0.0, 0.0, 1.0, 0.0]),
    _step(5, "Blast injured 6 people in the market", "en", "b", "2026-01-01T09:05:00Z", ["security"], "pending_review", [0.0, 0.0, 1.0, 0.0]),
    _step(6, "Market prices of sugar went up", "en", "a", "2026-01-01T09:10:00Z", ["economy"], "created", [0.0, 0.0, 1.0, 0.01]),
    _step(7, "وزیر اعظم شہباز نے نئی پالیسی دی", "ur", "c", "2026-01-01T09:20:00Z", ["water"], "pending_review", [0.97, 0.2, 0.0, 0.0]),
    _step(8, "Cabinet approved the new water policy", "en", "a", "2026-01-01T19:30:00Z", ["politics"], "created", [1.0, 0.0, 0.0, 0.0]),
]


def test_dedup_script(spark, tmp_path):
    path = tmp_path / "steps.jsonl"
    path.write_text("\n".join(json.dumps(s, ensure_ascii=False) for s in STEPS) + "\n", encoding="utf-8")
    got = evaluation.dedup_script(manifests.dedup_steps(spark, str(path))).orderBy("seq").collect()
    assert [(r.step_id, r.action) for r in got] == [(s["step_id"], s["expected_action"]) for s in STEPS]
    assert all(r.passed for r in got)


def test_reading_accuracy(spark, tmp_path):
    (tmp_path / "cases.jsonl").write_text('{"id": "1", "image": "a.jpg", "ground_truth_lines": ["Total 12 seats", "new line"]}\n\n{"id": "2", "image": "/b.jpg", "ground_truth_lines": ["x"], "language": "en"}\n')
    cases = manifests.reading_cases(spark, str(tmp_path / "cases.jsonl"))
    assert {r.id: (r.image, r.language) for r in cases.collect()} == {"1": (f"{tmp_path}/a.jpg", "mixed"), "2": ("/b.jpg", "en")}
    read = F.when(F.col("id") == "1", F.array(F.lit("total, 13 SEATS"), F.lit("new line")))
    got = {r.id: r[1:] for r in evaluation.reading_accuracy(cases.select("id", F.col("ground_truth_lines").alias("truth"), read.alias("read"))).collect()}
    assert got == {"1": (round(1 - 1 / 23, 6), 0.8, 1.0, 0.0, False), "2": (0.0, 0.0, 0.0, 1.0, False)}
    assert evaluation.edit_distance(list("kitten"), list("sitting")) == 3 and evaluation.edit_distance([], [1, 2]) == 2


def test_translation_cases(spark, tmp_path):
    rows = [{"id": "1", "source_text": "a", "source_language": "en", "acceptable_translations": ["A  b"], "required_terms": ["B", " "], "forbidden_terms": ["c"]}, {"id": "2", "source_text": "a", "source_language": "en", "reference_text": "A b"}, {"id": "3", "source_text": "a", "source_language": "en"}]
    (tmp_path / "cases.jsonl").write_text("\n".join(map(json.dumps, rows)))
    cases = manifests.translation_cases(spark, str(tmp_path / "cases.jsonl")).withColumns({"status": F.lit("complete"), "translated": F.lit("A b")})
    got = {r.id: r[1:] for r in evaluation.translation_cases(cases).collect()}
    assert got == {"1": (True, True, True, True), "2": (True, True, True, True), "3": (False, True, True, False)}
    assert not evaluation.translation_cases(cases.withColumn("status", F.lit(None).cast("string"))).where("passed").count()


def test_late_rows_count(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "event_type")
    events.orderBy(F.desc("ts")).repartitionByRange(3, F.desc("ts")).write.parquet(str(tmp_path / "in"))  # newest first: the rest is late
    table = live.SummedTable(spark, str(tmp_path / "table"), ["start", "event_type"], ["n"])
    live.run_once(live.slot_rows(live.occurrence_stream(spark, str(tmp_path / "in"), events.schema, 1)), table.apply, str(tmp_path / "cp"))
    want = live.slot_rows(events).groupBy("start", "event_type").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, want.collect()))
    assert table.read().agg(F.sum("n")).first()[0] == events.count()


def test_first_sightings(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.limit(50).unionByName(events.limit(50)).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = live.drain_to_memory(live.first_sightings(live.occurrence_stream(spark, str(tmp_path / "in"), events.schema)), str(tmp_path / "cp"), "append")
    assert got.count() == got.select("event_id").distinct().count() == 50
