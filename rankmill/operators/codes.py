"""Bucket codes as columns that keep their rules: made from ranks or vectors, or taken as given, and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.functions import encode
from rankmill.operators import validate
from rankmill.spec import BucketSpec, CompositionSpec


def _held(good: Column, value: Column, message: str) -> Column:
    return F.when(good, value).otherwise(F.raise_error(F.lit(message)))


def codes_from_ranks(table: DataFrame, dim: int, buckets: int, ranks: str = "ranks", out: str = "codes") -> DataFrame:
    """table with the buckets of its ranks; a row of ranks that is no permutation of 0 to dim - 1 fails the job."""
    CompositionSpec(dim, buckets)
    code = F.transform(ranks, lambda r: F.floor(r * buckets / dim).cast("int"))
    return table.withColumn(out, _held(F.coalesce(validate.is_permutation(F.col(ranks), dim), F.lit(False)), code, "ranks are no permutation"))


def codes_from_vectors(table: DataFrame, dim: int, bits: int, vector: str = "embedding", out: str = "codes") -> DataFrame:
    """table with the buckets of its vectors' ranks; a bad vector fails the job."""
    spec = BucketSpec(dim, bits)
    spec.need_symmetric()
    return validate.checked(table, dim, vector).withColumn(out, encode.bucket_codes(F.col(vector), dim, bits))


def checked_codes(table: DataFrame, dim: int, buckets: int, codes: str = "codes") -> DataFrame:
    """table, failing on codes that don't fill every bucket alike."""
    CompositionSpec(dim, buckets)
    good = F.coalesce(validate.is_balanced(F.col(codes), dim, buckets), F.lit(False))
    return table.withColumn(codes, _held(good, F.col(codes), "codes don't fill every bucket alike"))


def weight(members: Column) -> Column:
    """How many booleans of an array are true: the weight of a bitmap."""
    return F.size(F.filter(members, lambda x: x)).cast("long")


def is_constant_weight(table: DataFrame, members: str, expected: int) -> DataFrame:
    """(row_id): rows of another weight."""
    return table.where(~F.coalesce(weight(F.col(members)) == expected, F.lit(False))).select("row_id")
