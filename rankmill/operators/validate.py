"""Checks of data: what breaks a rule is returned as rows, or raised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.operators.mutate import with_row_ids
from rankmill.spec import MAX_RANK_DIM, MAX_VECTORS, ParameterError


def finite(e: Column) -> Column:
    return F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def checked(vectors: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """vectors, failing on the first that is null, of another length or not finite."""
    good = (F.size(vector) == dim) & finite(F.col(vector))
    return vectors.withColumn(vector, F.when(good, F.col(vector)).otherwise(F.raise_error(F.lit("a vector is null, of another length or not finite"))))


def is_permutation(ranks: Column, dim: int) -> Column:
    return F.array_sort(ranks) == F.sequence(F.lit(0), F.lit(dim - 1))


def histogram(codes: Column, buckets: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.size(F.filter(codes, lambda c: c == b)).cast("long"))


def is_balanced(codes: Column, dim: int, buckets: int) -> Column:
    """Every bucket has dim / buckets codes, and no code is outside."""
    return (F.size(codes) == dim) & F.forall(histogram(codes, buckets), lambda n: n == dim // buckets)


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w).cast("long"))


def unknown_candidates(candidates: DataFrame, rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Candidates that are no row."""
    return candidates.join(rows.select(F.col(row_id).alias("row_id")), "row_id", "left_anti")


def csr_issues(lists: DataFrame, n: int) -> DataFrame:
    """Rows (query_id, code) of offset lists (query_id, start, end, candidates) that break a rule.

    Queries are numbered by ranges of their ids, and each meets the one before it by its number: no task holds all lists.
    """
    own = with_row_ids(lists.select("query_id", "end"), "query_id")
    before = own.select((F.col("row_id") + 1).alias("row_id"), F.col("end").alias("before"))
    before = own.join(before, "row_id", "left").select("query_id", F.coalesce("before", F.lit(0)).alias("before"))
    x = lists.join(before, "query_id", "left")
    rules = {"gap": F.col("start") != F.col("before"), "falling": F.col("end") < F.col("start"), "length": F.size("candidates") != F.col("end") - F.col("start"), "too_many": F.size("candidates") > n, "unknown_row": F.exists("candidates", lambda c: (c < 0) | (c >= n))}
    return x.select("query_id", F.explode(F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda c: c.isNotNull())).alias("code"))


def need_capacity(rows: int) -> None:
    if rows > MAX_VECTORS:
        raise ParameterError(f"more than {MAX_VECTORS} vectors in one index file")


def fits(rows: Column) -> Column:
    """need_capacity() for many numbers of rows."""
    return rows.between(0, MAX_VECTORS)


def bucket_rules(dim: Column, bits: Column) -> dict[str, Column]:
    """What BucketSpec says of many parameters: valid, bytes_per_vec (null where not valid), asymmetric_only."""
    whole = dim.between(2, MAX_RANK_DIM) & bits.isin(1, 2, 4, 8) & (F.pmod(dim, F.greatest(F.lit(1), F.floor(8 / bits))) == 0)
    even = F.pmod(dim, F.pow(F.lit(2), bits)) == 0
    return {"valid": whole & even, "bytes_per_vec": F.when(whole & even, F.floor(dim * bits / 8).cast("int")), "asymmetric_only": whole & (bits == 8) & ~even}


def unit_length_issues(vectors: DataFrame, dim: int, low: float = 0.999, high: float = 1.001, row_id: str = "row_id", vector: str = "embedding") -> DataFrame:
    n = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vectors.where((F.size(vector) != dim) | ~finite(F.col(vector)) | ~n.between(low, high)).select(row_id)
