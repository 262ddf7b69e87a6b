import math

import duckdb
import numpy as np
import pytest

from rankmill.functions import kernels as K
from rankmill.operators import placement
from rankmill.plans import catalogue
from rankmill.spec import ParameterError

from tests.test_search import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["mean_direction", "placed_routers", "direction_discrepancy", "rank_locality", "rank_fan_out", "rank_coarsening", "merged_codes"])
def test_query_agrees_with_its_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(catalogue.ORACLES[name]).fetchall()
    got = sorted(map(tuple, catalogue.QUERIES[name](spark, SF).select(*(c[0] for c in con.description)).collect()))
    assert len(got) == len(want) > 0
    for a, b in zip(got, sorted(want), strict=True):
        assert all(x == y or math.isclose(x, y, abs_tol=1e-6) for x, y in zip(a, b, strict=True)), (a, b)


def test_spiral_points_are_on_the_sphere_and_apart():
    p = placement.spiral(50)
    assert np.allclose((p * p).sum(1), 1) and placement.spiral(1).tolist() == [[1, 0, 0]]
    assert (np.linalg.norm(p[:, None] - p[None], axis=2) + 9 * np.eye(50)).min() > 0.2


def test_an_address_is_the_nearest_point():
    x, g = np.random.default_rng(1).normal(size=(20, 11)), placement.spiral(9)
    got = placement.addresses(x, g)
    for i in range(20):
        for t in range(3):
            v = x[i, 3 * t : 3 * t + 3]
            assert got[i, t] == min(range(9), key=lambda j: np.linalg.norm(v / np.linalg.norm(v) - g[j]))
    assert got.shape == (20, 3) and placement.addresses(np.zeros((1, 3)), g).tolist() == [[0]]


def test_address_locality_is_the_rank_correlation_of_all_pairs(spark):
    x = K.unit(np.random.default_rng(4).normal(size=(60, 12))).astype(np.float32)
    pairs = [(i, (5 * i + 3) % 60) for i in range(60)]
    got = dict(map(tuple, placement.address_locality(table(spark, x), spark.createDataFrame(pairs, "a long, b long"), {"spiral": placement.spiral(8)}).collect()))
    place = lambda far: np.argsort(sorted(range(60), key=lambda i: (far[i], *pairs[i])))
    a, (p, q) = placement.addresses(x, placement.spiral(8)), np.array(pairs).T
    cosine = place((1 - (x[p].astype(float) * x[q]).sum(1)).tolist())
    assert got["spiral"] == pytest.approx(np.corrcoef(place(np.abs(a[p] - a[q]).sum(1).tolist()), cosine)[0, 1])
    assert got["sign"] == pytest.approx(np.corrcoef(place(((x[p] > 0) != (x[q] > 0)).sum(1).tolist()), cosine)[0, 1])


def test_directions_are_unit_and_off_the_axis():
    axis = K.unit(np.ones((1, 10)))[0]
    for d in (placement.spiral_directions(10, 5), placement.spiral_directions(10, 5, 1), placement.spiral_directions(10, 5, 1, axis)):
        assert d.shape == (5, 10) and np.allclose((d * d).sum(1), 1)
    assert np.allclose(placement.spiral_directions(10, 5, 1, axis) @ axis, 0)
    for kind in ("random", "net", "additive", "axes"):
        d = placement.subspace_directions(kind, 40, 4)
        assert d.shape == (40, 4) and np.allclose((d * d).sum(1), 1) and len(np.unique(d.round(9), axis=0)) == 40
    assert placement.subspace_directions("axes", 6, 4)[:4].tolist() == np.eye(4).tolist()
    with pytest.raises(ParameterError):
        placement.subspace_directions("other", 3, 3)


def test_envelope_keeps_to_the_budget(spark):
    t = spark.createDataFrame([("a", 10.0, 0.5), ("a", 30.0, 0.9), ("b", 40.0, 1.0)], "arm string, scanned double, recall double")
    assert dict(map(tuple, placement.envelope(t, 30).collect())) == {"a": 0.9, "b": 0.0}


def test_no_queries_and_no_rows(spark):
    v = table(spark, np.eye(6, dtype=np.float32))
    none = v.where("row_id < 0")
    q = none.withColumnRenamed("row_id", "query_id")
    assert [tuple(r)[:2] for r in placement.fan_out(v, q, [1.0, 2.0]).collect()] == [(1.0, 0), (2.0, 0)]
    assert placement.mean_direction(none).count() == 0
