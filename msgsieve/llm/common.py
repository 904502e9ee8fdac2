"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgsieve.session import checkpoint_dir, cut_lineage, discard, written

__all__ = ["as_columns", "ascii_lower", "cut_lineage", "discard", "scratch", "table", "tidy", "written"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; the quick form where the text is plain ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def as_columns(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; columns of other names never reach an operator."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in types.items()])


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over a task's batches; the Python worker, which serves other tasks next, then hands back the memory it no longer uses."""
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run
