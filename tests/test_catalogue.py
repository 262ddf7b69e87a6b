import math

import duckdb
import pytest

from rankmill.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["rank_transform", "pack_codes_b2", "query_top_bitmap", "rank_search_sym", "rankquant_search_asym_b2", "fastscan_search", "sign_top_m", "subset_padded_grid", "two_stage_sign_b2", "tau_rerank", "projections_named", "overlap_tail_prob", "ndcg_at_10", "append_rows", "twonn_dimension", "principal_cells", "npy_roundtrip", "file_faults", "projected_number_variance", "bucket_specs", "capacity_check", "judgement_records"])
def test_query_agrees_with_its_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(catalogue.ORACLES[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = sorted(map(tuple, catalogue.QUERIES[name](spark, SF).select(*columns).collect()))
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want), strict=True):
        assert all(x == y or math.isclose(x, y, abs_tol=1e-6) for x, y in zip(a, b, strict=True)), (a, b)


def test_all_is_registered():
    assert len(catalogue.QUERIES) >= 80 and set(catalogue.ORACLES) <= set(catalogue.QUERIES)
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == set()


def test_rules_for_many_parameters_are_those_of_one(spark):
    from rankmill import spec
    from rankmill.operators import validate

    def one(dim, bits):
        try:
            return True, spec.BucketSpec(dim, bits).bytes_per_vec, False
        except spec.ParameterError:
            pass
        try:
            return False, None, not spec.BucketSpec(dim, bits, asymmetric_only=True).symmetric
        except spec.ParameterError:
            return False, None, False

    asked = [(d, b) for d in (-8, 0, 1, 2, 3, 4, 8, 12, 16, 20, 64, 255, 256, 384, 65280, 65535, 65536) for b in (0, 1, 2, 3, 4, 8, 16)]
    t = spark.createDataFrame(asked, "dim int, bits int")
    rules = validate.bucket_rules(t.dim, t.bits)
    assert {(r.dim, r.bits): (r.valid, r.bytes_per_vec, r.asymmetric_only) for r in t.select("dim", "bits", *(c.alias(k) for k, c in rules.items())).collect()} == {p: one(*p) for p in asked}
    n = spark.createDataFrame([(-1,), (0,), (spec.MAX_VECTORS,), (spec.MAX_VECTORS + 1,)], "n long")
    assert [r[0] for r in n.select(validate.fits(n.n)).collect()] == [False, True, True, False]
