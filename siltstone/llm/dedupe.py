"""Rows that repeat an id count once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row_per_id(df: DataFrame, key: str = "id") -> DataFrame:
    """One of the rows of each id, the latest by ``updated_at`` if there is such a column.

    Rows with a null id are dropped: they name no record. The rest of the row travels with
    the key once; the result is partitioned by the key, so later grouping by it needs no
    further shuffle.
    """
    rest = [c for c in df.columns if c != key]
    order = [c for c in ("updated_at",) if c in rest]
    packed = F.max_by(F.struct(*rest), F.coalesce(F.col("updated_at"), F.lit("0001-01-01").cast("timestamp"))) if order else F.first(F.struct(*rest))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(packed.alias("_r")).select(key, *(F.col("_r").getField(c).alias(c) for c in rest))
