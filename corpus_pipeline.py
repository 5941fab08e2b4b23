"""From raw documents to token ids: the stages in order, each on all that its predecessor kept.

All stages but the last return the columns of documents; further columns are left out, whatever their names. An empty
table gives an empty one. Null and empty texts, texts of any length, ties and repeated rows are kept or dropped by the
rules of the stage named below; a row without a doc_id is a row like others, and only its text tells it from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import importable, read, stored
from tessera.llm.decontaminate import decontaminate
from tessera.llm.line_spread import line_spread
from tessera.llm.near_dedup import near_dedup
from tessera.llm.piece_lattice import encode
from tessera.llm.quality_gam import keep_good

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels of these documents, scores 0.5 or more.

    Null text scores as the empty text; without labels of both kinds all documents score alike.
    """
    importable(spark)
    return keep_good(docs.select(COLUMNS), read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sources, and long passages on two, go from all documents but the first that has them; n_chars follows
    the text.

    A document that loses every line stays, with an empty text; null text stays null.
    """
    out = line_spread(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the lowest doc_id; rows without a doc_id stay.

    Null, empty and wordless texts are one group.
    """
    importable(spark)
    return near_dedup(docs.select(COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts hold none."""
    return decontaminate(docs.select(COLUMNS), read(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the scores of the N best segmentations; null and empty texts have no ids."""
    importable(spark)
    return encode(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near), ("benchmark", benchmark), ("pieces", pieces)]
#: SQL can't express the classifier, the sampling or the lattice search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of `sf_dir`, each written as Parquet in the shared folder and read again for the next."""
    docs = read(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs)
    return docs
