"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import Scratch, table

__all__ = ["Scratch", "WORD_BREAK", "arrow_map", "bound_batches", "table", "word_count", "words_of"]

#: Words are maximal runs of characters other than space and the controls 0x09-0x0D.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8: bytes.split() breaks on exactly 0x20 and 0x09-0x0D."""
    return (text or "").encode("utf-8", "surrogatepass").split()


#: Rows of an Arrow batch where the session has Spark's own default of 10,000, which is much for long texts.
BATCH_ROWS = 2000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Keep batches of texts small in the JVM and in Python; a setting of the user's own stays."""
    if spark.conf.get(_ROWS_SETTING, "10000") == "10000":
        spark.conf.set(_ROWS_SETTING, str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory to the system at the end of a task: idle Python workers stay beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], schema: str) -> DataFrame:
    """mapInArrow where fn turns one batch into columns named as in the DDL schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    bound_batches(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            yield pa.RecordBatch.from_arrays(
                [v.cast(f.type) if isinstance(v := out[f.name], pa.Array) else pa.array(v, f.type) for f in target], schema=target
            )
        del batches
        give_back()

    return df.mapInArrow(run, schema)
