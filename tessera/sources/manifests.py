"""JSON-lines manifests and the command spool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYWORD_CASES = "id string, text string, language string, expected_categories array<string>, forbidden_categories array<string>, expected_terms array<string>"
DEDUP_STEPS = "step_id string, text string, language string, stream_id string, channel_name string, observed_at timestamp, category_ids array<string>, expected_action string, embedding array<double>"
SEGMENT_CASES = "id string, stream_id string, channel_name string, frames array<struct<sequence:int,timestamp:timestamp,width:int,height:int,sha256:string,lines:array<struct<text:string,confidence:double,script:string,polygon:array<array<double>>>>>>, expected_units array<string>"
TRANSLATION_CASES = "id string, source_text string, source_language string, acceptable_translations array<string>, required_terms array<string>, forbidden_terms array<string>, reference_text string"
READING_CASES = "id string, image string, ground_truth_lines array<string>, language string, source string"
COMMANDS = "id string, kind string, body string, checksum string, attempts int"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a manifest; blank lines and those that start with # are skipped, malformed ones fail."""
    lines = spark.read.text(path).where(F.trim("value") != "").where(~F.ltrim("value").startswith("#"))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def keyword_cases(spark: SparkSession, path: str) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = json_lines(spark, path, KEYWORD_CASES)
    return rows.withColumns({"language": F.coalesce("language", F.lit("mixed"))} | {c: F.coalesce(c, none) for c in ("expected_categories", "forbidden_categories", "expected_terms")})


def dedup_steps(spark: SparkSession, path: str) -> DataFrame:
    """The steps of one file with their order as `seq`, which is the order of the file's lines."""
    rows = json_lines(spark, path, DEDUP_STEPS).coalesce(1)
    return rows.withColumn("seq", F.monotonically_increasing_id())


def reading_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of recognition with the path of their picture, which stands beside the manifest if it is relative."""
    folder = path.rsplit("/", 1)[0] if "/" in path else "."
    rows = json_lines(spark, path, READING_CASES).where(F.size("ground_truth_lines") > 0)
    image = F.when(F.regexp_like("image", F.lit("^(/|[A-Za-z][A-Za-z0-9+.-]*:)")), F.col("image")).otherwise(F.concat(F.lit(folder + "/"), "image"))
    return rows.withColumns({"image": image, "language": F.coalesce("language", F.lit("mixed")), "source": F.coalesce("source", F.lit("manual"))})


def translation_cases(spark: SparkSession, path: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return json_lines(spark, path, TRANSLATION_CASES).withColumns({c: F.coalesce(c, none) for c in ("acceptable_translations", "required_terms", "forbidden_terms")})


def frame_lines(cases: DataFrame) -> DataFrame:
    """(id, sequence, line, text, confidence, script, x0, y0, x1, y1, accepted) of nested segmentation cases."""
    frames = cases.select("id", F.explode("frames").alias("f"))
    lines = frames.select("id", F.col("f.sequence").alias("sequence"), F.posexplode("f.lines").alias("line", "l"))
    corner = lambda k, pick: pick(F.transform("l.polygon", lambda p: F.get(p, k)))
    sure = F.coalesce("l.confidence", F.lit(1.0))
    return lines.select("id", "sequence", "line", "l.text", sure.alias("confidence"), "l.script", corner(0, F.array_min).alias("x0"), corner(1, F.array_min).alias("y0"), corner(0, F.array_max).alias("x1"), corner(1, F.array_max).alias("y1"), (sure >= 0.95).alias("accepted"))


def checked_commands(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spooled commands whose checksum holds, and the others, for quarantine. Works on streams too."""
    good = F.sha2("body", 256) == F.col("checksum")
    return rows.where(good), rows.where(~F.coalesce(good, F.lit(False)))


def spool_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """The spool's files in order of age, a bounded number in each micro-batch."""
    return spark.readStream.schema(COMMANDS).option("maxFilesPerTrigger", per_trigger).json(path)
