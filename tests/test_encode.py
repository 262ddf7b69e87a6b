import numpy as np
import pytest
from pyspark.sql import functions as F

from rankmill import spec
from rankmill.functions import encode as E
from rankmill.functions import kernels as K
from rankmill.operators import contingency as C
from rankmill.operators import nullmodel as N


def one(spark, vector, column):
    return spark.createDataFrame([(0, [float(x) for x in vector])], "row_id long, embedding array<float>").select(column).first()[0]




@pytest.mark.parametrize(("x", "want"), [([3, 1, 4, 1.5, 5, 9, 2, 6], [3, 0, 4, 1, 5, 7, 2, 6]), ([1, 1, 1, 1], [0, 1, 2, 3]), ([-0.0, 0.0, -1.0, 1.0], [1, 2, 0, 3])])
def test_ranks(spark, x, want):
    assert one(spark, x, E.rank_transform(F.col("embedding"))) == want == K.ranks(np.array([x], np.float32))[0].tolist()


def test_packing(spark):
    codes = E.bucket_codes(F.col("embedding"), 8, 2)
    assert bytes(one(spark, range(8), E.to_binary(E.packed_bytes(codes, 8, 2)))) == bytes([0x05, 0xAF])
    for bits in (1, 2, 4):
        dim = 16
        packed = E.from_binary(E.to_binary(E.packed_bytes(E.bucket_codes(F.col("embedding"), dim, bits), dim, bits)))
        assert one(spark, range(dim), E.unpack_bytes(packed, dim, bits)) == [(i << bits) // dim for i in range(dim)]


def test_bitmaps_and_their_ties(spark):
    assert one(spark, range(64), E.top_bits_of_doc(E.rank_transform(F.col("embedding")), 64, 2)) == [-(1 << 62)]
    x = [-1.0] * 64
    x[0] = x[63] = 1.0
    assert one(spark, x, E.sign_bits(F.col("embedding"), 64)) == [1 - (1 << 63)]
    same = [1.0] * 64
    doc, q = one(spark, same, E.top_bits_of_doc(E.rank_transform(F.col("embedding")), 64, 16)), one(spark, same, E.top_bits_of_query(F.col("embedding"), 64, 16))
    assert doc == [-(1 << 48)] and q == [(1 << 16) - 1] and not doc[0] & q[0]


def test_normalise(spark):
    assert one(spark, [3, 4], E.l2_normalise(F.col("embedding"))) == pytest.approx([0.6, 0.8])
    assert one(spark, [0, 1e-13], E.l2_normalise(F.col("embedding"))) == [0, 0]


def test_registered_functions(spark):
    E.register(spark, 64)
    v = spark.createDataFrame([(0, [float((i * 37) % 64) for i in range(64)])], "row_id long, embedding array<float>")
    v.createOrReplaceTempView("rm_test")
    got = spark.sql("SELECT rm_rank(embedding) AS r, rm_b2(embedding) AS b, rm_sign(embedding) AS s, rm_overlap(rm_sign(embedding), rm_sign(embedding)) AS o, rm_hamming(rm_sign(embedding), rm_sign(embedding)) AS h FROM rm_test").first()
    want = v.select(E.rank_transform(F.col("embedding")), E.bucket_codes(F.col("embedding"), 64, 2), E.sign_bits(F.col("embedding"), 64)).first()
    assert (got.r, got.b, got.s, got.o, got.h) == (*want, 63, 0)


def test_contingency(spark):
    q, d = [0, 0, 1, 1, 2, 2, 3, 3], [0, 1, 1, 2, 2, 3, 3, 0]
    t = spark.createDataFrame([(q, d)], "q array<int>, d array<int>").select(E.contingency(F.col("q"), F.col("d"), 4).alias("c"))
    c = F.col("c")
    got = t.select(C.top_overlap(c, 4), C.diagonal_agreement(c, 4), C.band_agreement(c, 4, 1), C.top_group_overlap(c, 4, 2), C.bucket_l1(c, 4), C.symmetric_score(c, 4)).first()
    assert tuple(got) == (1, 4, 7, 3, 6, 4.0)


def test_null_model(spark):
    assert N.tail_probability(10, 3, 3) == 1 / 120 and N.tail_probability(10, 3, 2) == 22 / 120
    assert N.tail_probability(10, 3, 0) == 1.0 and N.tail_probability(10, 3, 4) == 0.0
    assert sum(N.fiber_count(64, 16, o) for o in range(17)) == N.space_size(64, 16)
    with pytest.raises(OverflowError):
        N.choose(1000, 500)
    assert N.null_table(spark, 64, 16).count() == 17


def test_parameters():
    for bad in (lambda: spec.RankSpec(1), lambda: spec.BucketSpec(6, 2), lambda: spec.BucketSpec(64, 3), lambda: spec.BucketSpec(384, 8), lambda: spec.BitmapSpec(64, 64), lambda: spec.SignSpec(65), lambda: spec.CompositionSpec(10, 3), lambda: spec.MultiBucketSpec(64, 8)):
        with pytest.raises(spec.ParameterError):
            bad()
    with pytest.raises(spec.CapabilityError):
        spec.BucketSpec(384, 8, asymmetric_only=True).need_symmetric()
    p = spec.CandidatePolicy()
    assert (p.candidate_count(10, 100_000), p.candidate_count(0, 9), p.candidate_count(10, 100)) == (320, 0, 100)
    assert spec.empirical_norm(64, 2) == pytest.approx(spec.bucket_norm(64, 2))
