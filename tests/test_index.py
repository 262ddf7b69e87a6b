import pytest
from pyspark.sql import functions as F

from rankmill import index as I
from rankmill.functions import kernels as K
from rankmill.operators import search
from rankmill.operators.synthetic import KINDS, corpus
from rankmill.spec import CapabilityError, ParameterError


def same(a, b):
    key = lambda d: [(r.query_id, r.rank, r.row_id, round(r.score, 9)) for r in d.orderBy("query_id", "rank").collect()]
    assert key(a) == key(b)


def test_indexes(spark, tmp_path):
    v = corpus(spark, 300, 64, clusters=9).drop("cluster").cache()
    q = v.where("row_id % 100 = 0").withColumnRenamed("row_id", "query_id")
    made = {
        "rank": (I.RankIndex(spark, 64), {"search": K.rank_symmetric(64), "search_asymmetric": K.rank_asymmetric(64)}),
        "buckets": (I.BucketIndex(spark, 64, 2), {"search": K.bucket_symmetric(64, 2), "search_asymmetric": K.bucket_asymmetric(64, 2)}),
        "pairs": (I.PairScanIndex(spark, 64), {"search": K.pair_scan(64)}),
        "bitmap": (I.BitmapIndex(spark, 64, 16), {"search": K.bitmap_overlap(16)}),
    }
    for name, (ix, scorers) in made.items():
        ix.add(v, "row_id").keep(str(tmp_path / f"t{name}"))
        ix.write(str(tmp_path / name))
        again = I.load(spark, str(tmp_path / name))
        assert type(again) is type(ix) and len(again) == 300 and again.byte_size == ix.byte_size
        for method, scorer in scorers.items():
            want = search.search(v, q, scorer, 5)
            same(getattr(ix, method)(q, 5), want)
            same(getattr(again, method)(q, 5), want)
    sign = I.SignIndex(spark, 64).add(v, "row_id").keep(str(tmp_path / "tsign"))
    assert sign.score_all(q).where("query_id = row_id and score < 64").count() == 0
    assert sign.top_m_candidates_csr(q, 7).agg(F.max("end")).first()[0] == 21
    b2 = made["buckets"][0]
    same(b2.search_with_sign_probe(sign, q, 5), b2.search_asymmetric_subset(q, sign.top_m_candidates(q, 256), 5))
    assert b2.search_asymmetric_subset_padded(q, sign.top_m_candidates(q, 2), 5).where("row_id = -1").count() == 9
    with pytest.raises(ParameterError):
        b2.search_asymmetric_subset(q, spark.createDataFrame([(0, 0, 999)], "query_id long, pos int, row_id long"), 1)
    with pytest.raises(ParameterError):
        made["pairs"][0].add(v, "row_id")
    with pytest.raises(CapabilityError):
        I.BucketIndex(spark, 64, 8, asymmetric_only=True).search(q, 1)
    assert sign.swap_remove(3) == 299 and len(sign) == 299


def test_handles_status_and_streams(spark, tmp_path):
    import io

    from rankmill.sources import formats

    v = corpus(spark, 70, 64, clusters=3).drop("cluster")
    with I.BucketIndex(spark, 64, 2).add(v, "row_id") as ix:
        held = io.BytesIO()
        assert ix.write_to(held) == 14 + 70 * 16 and ix.info()["vector_count"] == 70 and ix.byte_size == 1120
        assert ix.codes.where("octet_length(value) <> 16").count() == 0
        want = [r.value for r in ix.arrays().orderBy("row_id").collect()]
        assert [r.value for r in formats.read_bytes(spark, held.getvalue()).orderBy("row_id").collect()] == want
        held.seek(0)
        assert formats.read_from(spark, held).count() == 70
        hits, stats = ix.search_one(v.where("row_id = 5").first().embedding, 3)
        assert hits[0][0] == 5 and stats["scored"] == 70
        with pytest.raises(ParameterError):
            ix.search_one([1.0], 3)
    ix.close()
    with pytest.raises(I.ClosedError):
        len(ix)
    with pytest.raises(formats.FormatError):
        formats.read_bytes(spark, held.getvalue()[:-1])
    (tmp_path / "bad").write_bytes(b"x")
    assert I.open_index(spark, str(tmp_path / "bad"))[1] == 3 and I.open_index(spark, str(tmp_path / "none"))[1] == 4
    assert [I.status_of(e) for e in (None, ParameterError(""), CapabilityError(""), I.ClosedError(""), KeyError())] == [0, 1, 2, 5, 6]
    multi = I.MultiBucketIndex(spark, 64, 2).add(v, "row_id")
    q = v.where("row_id < 2").withColumnRenamed("row_id", "query_id")
    weights = [[float(a == b) for b in range(4)] for a in range(4)]
    same(multi.top_m_bilinear(q, weights, 5), search.search(v, q, K.bilinear(2, weights), 5))
    with pytest.raises(ParameterError):
        multi.write(str(tmp_path / "m"))


def test_corpora(spark):
    for kind in KINDS:
        a = corpus(spark, 50, 64, kind)
        assert a.count() == 50 and a.exceptAll(corpus(spark, 50, 64, kind)).count() == 0
