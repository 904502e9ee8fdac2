"""Set tests on array columns."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_sets(df: DataFrame, left: str, right: str) -> DataFrame:
    """Add ``overlaps``, the sorted ``common`` members and those ``missing`` from the right side."""
    return df.withColumns({"overlaps": F.arrays_overlap(left, right), "common": F.array_sort(F.array_intersect(left, right)),
                           "missing": F.array_sort(F.array_except(left, right))})
