"""Vectors that arrive as a stream, encoded as they come and appended to a table of codes. Stateless."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankmill.operators.mutate import code_table
from rankmill.operators.validate import finite


def encoded_stream(stream: DataFrame, dim: int, n_top: int | None = None) -> DataFrame:
    """The code table of a stream (row_id, embedding); vectors of another length or not finite are left out."""
    return code_table(stream.where((F.size("embedding") == dim) & finite(F.col("embedding"))), dim, n_top)


def append_stream(stream: DataFrame, path: str, checkpoint: str, dim: int, n_top: int | None = None) -> StreamingQuery:
    """Appends what has arrived to Parquet, once, and ends."""
    return encoded_stream(stream, dim, n_top).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
