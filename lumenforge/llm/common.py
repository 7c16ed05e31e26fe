"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import saved

__all__ = ["BLANK", "arrow_rows", "giving_back", "one_space", "saved", "table", "text_or_empty"]

#: Fixed value: the white space of the contracts, space and 0x09 to 0x0D.
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes after which an Arrow batch ends, however few rows it has.
BATCH_BYTES = 4 << 20


def arrow_rows(spark: SparkSession, rows: int = 256) -> None:
    """Rows in one Arrow batch, or fewer once they hold BATCH_BYTES: executor and Python worker hold a batch at a time. The
    settings stay so for the session, as results are computed after the operator has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives back, when it ends, what Arrow keeps for later: its Python worker lives on, beside the
    executor's heap, while other tasks and stages run."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return whole


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def one_space(text: Column) -> Column:
    """Runs of blanks become one space."""
    return F.regexp_replace(text, BLANK, " ")
