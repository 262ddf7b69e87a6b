import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rankmill.functions import kernels as K
from rankmill.operators import research
from rankmill.plans import catalogue

from tests.test_search import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["overlap_levels", "cell_candidates"])
def test_query_agrees_with_its_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(catalogue.ORACLES[name]).fetchall()
    got = sorted(map(tuple, catalogue.QUERIES[name](spark, SF).select(*(c[0] for c in con.description)).collect()))
    assert len(got) == len(want) > 0
    for a, b in zip(got, sorted(want), strict=True):
        assert all(x == y or math.isclose(x, y, abs_tol=1e-6) for x, y in zip(a, b, strict=True)), (a, b)


def test_ranks_are_worked_out_once_a_row(spark):
    plan = catalogue.tops(catalogue.vectors(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.index("array_sort") < plan.index("filter(")  # sorted outside the filter over places, not within it


def test_principal_cells_nearest_to_a_query(spark):
    x = K.unit(np.random.default_rng(8).normal(size=(200, 16)) + 1).astype(np.float32)  # all on one side: raw signs say little
    v = table(spark, x)
    q = v.where("row_id % 50 = 0").withColumnRenamed("row_id", "query_id")
    mean, axes = x.astype(float).mean(0), research.principal_axes(v, 4)
    key = (((x.astype(float) - mean) @ axes.T > 0) * 2 ** np.arange(4)).sum(1)
    want = set()
    for i in range(0, 200, 50):
        cells = sorted(range(16), key=lambda c: (bin(c ^ int(key[i])).count("1"), c))[:5]
        want |= {(i, cells.index(k) + 1, bin(k ^ int(key[i])).count("1"), j) for j, k in enumerate(key.tolist()) if k in cells}
    assert set(map(tuple, research.principal_cell_candidates(v, q, 4, 5).collect())) == want
    everything = research.principal_cell_candidates(v, q, 4, 16)
    assert everything.count() == 800 and everything.where("query_id = row_id and probe <> 1").count() == 0


def test_overlaps_of_all_pairs_and_of_neighbours(spark):
    r = np.random.default_rng(9)
    tops = [sorted(r.choice(12, 4, replace=False).tolist()) for _ in range(30)]
    t = spark.createDataFrame(list(enumerate(tops)), "row_id long, top array<int>")
    near = [(i, (i + 7) % 30) for i in range(0, 30, 3)]
    got = research.overlap_levels(t, spark.createDataFrame(near, "query_id long, row_id long"), 12).first()
    over = lambda i, j: len({*tops[i]} & {*tops[j]})
    assert got.expected_uniform == pytest.approx(16 / 12) and got.rows == 30
    assert got.observed_random == pytest.approx(np.mean([over(i, j) for i in range(30) for j in range(30) if i != j]))
    assert got.observed_neighbours == pytest.approx(np.mean([over(i, j) for i, j in near]))
    assert got.pair_signal == pytest.approx(got.observed_neighbours / got.observed_random - 1)
    assert got.expected_by_frequency == pytest.approx(research.overlap_decomposition(t).select(F.col("expected_by_frequency")).first()[0])


def test_mixed_corpus_takes_rows_by_hash_and_numbers_them(spark):
    from rankmill.operators import probes

    a, b = (spark.createDataFrame([(i, [float(i), float(k)]) for i in range(n)], "row_id long, embedding array<float>") for k, n in ((0, 40), (1, 9)))
    got = sorted(map(tuple, probes.mixed_corpus([(a, 15), (b, 100)], 3).collect()))
    assert [r[0] for r in got] == list(range(24)) and [r[1] for r in got].count(0) == 15
    assert {r[2][0] for r in got if r[1] == 1} == set(map(float, range(9))) and len({tuple(r[2]) for r in got}) == 24
    assert sorted(map(tuple, probes.mixed_corpus([(a.repartition(7), 15), (b.repartition(3), 100)], 3).collect())) == got
    other = {r.embedding[0] for r in probes.mixed_corpus([(a, 15)], 4).collect()}
    assert len(other) == 15 and other != {r[2][0] for r in got if r[1] == 0}
    parts = [r[1] for r in got]
    assert parts != sorted(parts) and parts != sorted(parts, reverse=True)
