"""Encoders as Spark expressions: an embedding column in, ranks, buckets, bitmaps or packed bytes out."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from rankmill.spec import bucket_centre


def let(x: Column, f) -> Column:
    """f(x) with x worked out once a row, however often f has it inside its lambdas."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _values(e: Column) -> Column:
    """Compared as 32-bit floats, with one zero."""
    return F.transform(e.cast("array<float>"), lambda x: F.when(x == 0, F.lit(0).cast("float")).otherwise(x))


def rank_transform(e: Column) -> Column:
    """Rank of each coordinate from 0, by value, equal values by index."""
    order = F.transform(F.array_sort(F.transform(_values(e), lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s, r: F.struct(s["i"].alias("i"), r.alias("r")))
    return F.transform(F.array_sort(order), lambda s: s["r"])


def bucket_ranks(ranks: Column, dim: int, bits: int) -> Column:
    return F.transform(ranks, lambda r: F.floor(r * (1 << bits) / dim).cast("int"))


def bucket_codes(e: Column, dim: int, bits: int) -> Column:
    return bucket_ranks(rank_transform(e), dim, bits)


def packed_bytes(codes: Column, dim: int, bits: int) -> Column:
    """The bytes, as integers: the first code in the highest bits of the first byte."""
    per = 8 // bits

    def byte(c, g):
        out = F.lit(0)
        for i in range(per):
            out = out + F.get(c, (g * per + i).cast("int")) * (1 << bits * (per - 1 - i))
        return out.cast("int")

    return let(codes, lambda c: F.transform(F.sequence(F.lit(0), F.lit(dim // per - 1)), lambda g: byte(c, g)))


def to_binary(bytes_: Column) -> Column:
    return F.unhex(F.array_join(F.transform(bytes_, lambda b: F.lpad(F.hex(b), 2, "0")), ""))


def unpack_bytes(bytes_: Column, dim: int, bits: int) -> Column:
    per = 8 // bits
    shift = lambda i: (F.lit(bits) * (per - 1 - i % per)).cast("int")
    code = lambda b, i: F.call_function("shiftright", F.get(b, F.floor(i / per).cast("int")), shift(i)).bitwiseAND(F.lit((1 << bits) - 1))
    return let(bytes_, lambda b: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: code(b, i)))


def from_binary(b: Column) -> Column:
    return let(F.hex(b), lambda h: F.transform(F.sequence(F.lit(0), F.floor(F.length(h) / 2).cast("int") - 1), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))


def l2_normalise(e: Column) -> Column:
    """To length 1; all zeros where the length is 1e-12 or less."""
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return let(norm, lambda n: F.transform(e, lambda x: F.when(n <= 1e-12, 0.0).otherwise(x.cast("double") / n)))


def fold_words(flags: Column, dim: int) -> Column:
    """Booleans as 64-bit words, the first in the lowest bit."""
    bit = lambda f, w, i: F.when(F.get(f, (w * 64 + i).cast("int")), F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long"))
    word = lambda f, w: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(bit(f, w, i)))
    return let(flags, lambda f: F.transform(F.sequence(F.lit(0), F.lit(dim // 64 - 1)), lambda w: word(f, w)))


def top_bits_of_doc(ranks: Column, dim: int, n_top: int) -> Column:
    """Bits of the n_top largest coordinates; of equal ones the higher index."""
    return fold_words(F.transform(ranks, lambda r: r >= dim - n_top), dim)


def top_bits_of_query(e: Column, dim: int, n_top: int) -> Column:
    """Bits of the n_top largest coordinates; of equal ones the lower index."""
    order = F.slice(F.array_sort(F.transform(_values(e), lambda x, i: F.struct((-x).alias("x"), i.alias("i")))), 1, n_top)
    flags = let(F.transform(order, lambda s: s["i"]), lambda at: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.array_contains(at, i)))
    return fold_words(flags, dim)


def sign_bits(e: Column, dim: int) -> Column:
    """Bits of the coordinates above zero."""
    return fold_words(F.transform(e, lambda x: x > 0), dim)


def bucket_range_bits(codes: Column, dim: int, low: int, high: int) -> Column:
    """Bits of the coordinates whose bucket is from low to high."""
    return fold_words(F.transform(codes, lambda b: b.between(low, high)), dim)


def multi_bucket_bits(codes: Column, dim: int, bits: int) -> Column:
    return let(codes, lambda c: F.array(*(bucket_range_bits(c, dim, b, b) for b in range(1 << bits))))


def pair_nibbles(codes: Column, dim: int) -> Column:
    """Two-bit codes of two neighbours as one number: first * 4 + second."""
    pair = lambda c, p: (F.get(c, (p * 2).cast("int")) * 4 + F.get(c, (p * 2 + 1).cast("int"))).cast("int")
    return let(codes, lambda c: F.transform(F.sequence(F.lit(0), F.lit(dim // 2 - 1)), lambda p: pair(c, p)))


def centred(codes: Column, bits: int) -> Column:
    return F.transform(codes, lambda b: b - F.lit(bucket_centre(0, bits) * -1))


def top_membership(codes: Column, buckets: int) -> Column:
    return F.transform(codes, lambda b: b == buckets - 1)


def dot(a: Column, b: Column, kind: str = "double") -> Column:
    """Inner product, summed from the first coordinate on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast(kind) * y.cast(kind)), F.lit(0).cast(kind), lambda s, x: s + x)


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("long") - y.cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)


def overlap(a: Column, b: Column) -> Column:
    """Bits set in both word arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def contingency(q: Column, d: Column, buckets: int) -> Column:
    """Counts of coordinates by (query bucket, document bucket), row by row."""
    cell = F.zip_with(q, d, lambda a, b: a * buckets + b)
    return let(cell, lambda t: F.transform(F.sequence(F.lit(0), F.lit(buckets * buckets - 1)), lambda c: F.size(F.filter(t, lambda x: x == c)).cast("long")))


def register(spark: SparkSession, dim: int) -> None:
    """Temporary SQL macros for one dim: rm_rank, rm_b1, rm_b2, rm_b4, rm_sign, rm_norm, rm_overlap, rm_hamming."""
    rank = "transform(array_sort(transform(array_sort(transform(e, (x, i) -> struct(IF(x = 0, CAST(0 AS FLOAT), CAST(x AS FLOAT)) AS x, i))), (s, r) -> struct(s.i AS i, r AS r))), s -> s.r)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION rm_rank(e ARRAY<FLOAT>) RETURNS ARRAY<INT> RETURN {rank}")
    for bits in (1, 2, 4):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION rm_b{bits}(e ARRAY<FLOAT>) RETURNS ARRAY<INT> RETURN transform({rank}, r -> CAST(r * {1 << bits} DIV {dim} AS INT))")
    word = "aggregate(sequence(0, 63), 0L, (a, i) -> a | IF(get(e, w * 64 + i) > 0, shiftleft(1L, i), 0L))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION rm_sign(e ARRAY<FLOAT>) RETURNS ARRAY<BIGINT> RETURN transform(sequence(0, {dim // 64 - 1}), w -> {word})")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION rm_overlap(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS BIGINT RETURN aggregate(zip_with(a, b, (x, y) -> CAST(bit_count(x & y) AS BIGINT)), 0L, (s, x) -> s + x)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION rm_hamming(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS BIGINT RETURN aggregate(zip_with(a, b, (x, y) -> CAST(bit_count(x ^ y) AS BIGINT)), 0L, (s, x) -> s + x)")
