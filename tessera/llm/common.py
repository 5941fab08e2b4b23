"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera import session
from tessera.session import shared_dir, stored  # noqa: F401  the operators take them from here

#: Texts in an Arrow batch. They can be long, and JVM, Arrow and Python hold a batch at the same time.
BATCH_ROWS = 500
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def importable(spark: SparkSession) -> None:
    """As the session's, and Arrow batches of texts that stay small, unless the session sets a smaller size."""
    session.importable(spark)
    if int(spark.conf.get(_BATCH_CONF, "10000")) > BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_held: dict[str, Callable[[], None]] = {}


def claim(owner: str, drop: Callable[[], None]) -> None:
    """For a worker's task: what `owner` remembers between tasks may stay, what other operators left there goes.

    Workers are reused from stage to stage; without this, one holds the caches of every operator that ran in it.
    """
    for name in [x for x in _held if x != owner]:
        _held.pop(name)()
    _held[owner] = drop
    release()


def release() -> None:
    """Give memory that Arrow and the C library keep for later back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
