"""The null model of overlap: two random sets of fixed size. Exact counts on the driver; tables have size + 1 rows."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankmill.functions import encode
from rankmill.spec import ParameterError


def choose(n: int, k: int) -> int:
    x = math.comb(n, k)
    if x >= 1 << 128:
        raise OverflowError("more than 128 bits")
    return x


def space_size(dim: int, weight: int) -> int:
    return choose(dim, weight)


def fiber_count(dim: int, weight: int, overlap: int) -> int:
    """Sets of the same size that share so many members with a given one."""
    if overlap < 0 or overlap > weight or weight - overlap > dim - weight:
        return 0
    return choose(weight, overlap) * choose(dim - weight, weight - overlap)


def tail_count(dim: int, weight: int, overlap: int) -> int:
    return sum(fiber_count(dim, weight, o) for o in range(max(0, overlap), weight + 1))


def tail_probability(dim: int, weight: int, overlap: int) -> float:
    """Chance of so large an overlap or a larger one."""
    if overlap <= 0:
        return 1.0
    return float(Fraction(tail_count(dim, weight, overlap), math.comb(dim, weight)))


def expected_overlap(dim: int, weight: int) -> float:
    return weight * weight / dim


def null_table(spark: SparkSession, dim: int, weight: int) -> DataFrame:
    if not 0 < weight <= dim:
        raise ParameterError("weight must be from 1 to dim")
    rows = [(dim, weight, o, str(fiber_count(dim, weight, o)), str(tail_count(dim, weight, o)), tail_probability(dim, weight, o)) for o in range(weight + 1)]
    return spark.createDataFrame(rows, "dim int, weight int, overlap int, fibers string, tail string, tail_prob double")


def with_seen(table: DataFrame, seen: DataFrame) -> DataFrame:
    """A null_table with how many pairs have each overlap (seen: overlap, seen) and the share of pairs with it or a larger one.

    Both tables have a row for each overlap there can be.
    """
    t = table.join(seen.select("overlap", "seen"), "overlap", "left").withColumn("seen", F.coalesce("seen", F.lit(0)).cast("long"))
    every, upto = Window.partitionBy("dim", "weight"), Window.partitionBy("dim", "weight").orderBy(F.desc("overlap"))
    return t.withColumn("seen_share", F.try_divide(F.sum("seen").over(upto), F.sum("seen").over(every)))


def with_tail_probability(found: DataFrame, dim: int, weight: int, overlap: str = "score") -> DataFrame:
    """found with tail_prob of its overlap column; the table that is broadcast has weight + 1 rows."""
    t = null_table(found.sparkSession, dim, weight).select(F.col("overlap").alias("nm_overlap"), "tail_prob")
    return found.join(F.broadcast(t), F.col(overlap).cast("int") == F.col("nm_overlap"), "left").drop("nm_overlap")


def top_group_bits(codes: Column, dim: int, buckets: int, widths: list[int]) -> Column:
    """Bitmaps of the top groups of each width, from a code array; what two rows' bitmaps share is their overlap at that width."""
    return encode.let(codes, lambda c: F.array(*(encode.bucket_range_bits(c, dim, buckets - w, buckets - 1) for w in widths)))
