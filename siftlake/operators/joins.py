"""Joins that broadcast one side only behind a check of its size in bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.session import checkpoint

#: Bytes of values that a broadcast may hold; a hashed relation takes some two to three times as much.
MAX_BYTES = 64 << 20


def row_bytes(schema: T.StructType) -> Column:
    """Bytes of a row as a hashed relation holds it: 16 for the row, 8 a column, and the length of what varies."""
    size = F.lit(16 + 8 * len(schema))
    for f in schema:
        kind, c = f.dataType, F.col(f"`{f.name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return size


def small_side(df: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """df, written to the shared folder and measured; hinted for broadcast if its rows take at most
    `max_bytes`. Beyond that the join shuffles, with AQE against skew."""
    df = checkpoint(df)
    taken = df.agg(F.sum(row_bytes(df.schema).cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if taken <= max_bytes else df
