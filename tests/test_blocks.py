"""Packed scans, the best rows of many queries, queries by the block, and two stages in one pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankmill import index as I
from rankmill.functions import kernels as K
from rankmill.functions.blocks import Best, bits_met, looked_up, words_of
from rankmill.operators import mutate, probes, search
from rankmill.spec import CandidatePolicy, ParameterError

from tests.test_search import queries, results, table


def test_bits_of_words():
    r = np.random.default_rng(1)
    for dim in (1, 63, 64, 65, 200):
        d, q = r.integers(0, 2, (137, dim)), r.integers(0, 2, (9, dim))
        assert (bits_met(words_of(d), words_of(q), np.bitwise_and) == d @ q.T).all()
        assert (bits_met(words_of(d), words_of(q), np.bitwise_xor) == (d[:, None] != q).sum(2)).all()
    assert bits_met(words_of(d[:0]), words_of(q), np.bitwise_and).shape == (0, 9)


@pytest.mark.parametrize("places", [1, 2, 7, 32, 300])
def test_look_ups_are_sums(places):
    r = np.random.default_rng(places)
    n, t = r.integers(0, 16, (50, places)), r.integers(0, 256, (6, places, 16))
    want = t[:, np.arange(places), n].sum(2).T
    assert (looked_up(K.paired(n), t.astype(float)) == want).all()


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("kind", [np.int16, np.float64])
def test_best_keeps_the_best(largest, kind):
    r = np.random.default_rng(3)
    s = r.integers(-9, 9, (5000, 6)).astype(kind)
    ids = r.permutation(5000)
    for m in (1, 7, 600, np.array([0, 1, 2, 3, 4, 5000])):
        best = Best(6, m, largest)
        best.room = 900
        for lo in range(0, 5000, 777):
            best.offer(s[lo : lo + 777], ids[lo : lo + 777], lambda at, lo=lo: (lo + at).astype(np.uint16)[:, None])
        j, score, row, carry = best.rows()
        want = [(q, int(ids[i]), int(i)) for q in range(6) for i in np.lexsort((ids, -s[:, q] if largest else s[:, q]))[: np.broadcast_to(m, 6)[q]]]
        assert list(zip(j.tolist(), row.tolist(), carry[:, 0].tolist(), strict=True)) == want
        assert (score == s[carry[:, 0], j]).all()


def some(seed, n, dim=64):
    return np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)


def test_many_queries_are_a_table(spark, monkeypatch):
    v, q = table(spark, some(1, 500)), queries(spark, some(2, 23))
    plans = {
        "top": lambda: search.search(v, q, K.bucket_asymmetric(64, 2), 5), "all": lambda: search.score_all(v, q, K.sign_hamming()), "histogram": lambda: search.histogram(v, q, K.sign_hamming()),
        "exact": lambda: search.candidates_exactly(v, q, K.bitmap_overlap(16), 20), "two": lambda: search.two_stage(v, q, K.sign_hamming(), K.bucket_asymmetric(64, 2), 40, 5),
        "tau": lambda: search.two_stage(v, q, K.bucket_asymmetric(64, 2), K.tau_on_query_top(8), 40, 5),
        "subset": lambda: search.search_subset(v, q, search.candidates(v, q, K.sign_hamming(), 30), K.bucket_asymmetric(64, 2), 5),
    }
    rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    want = {k: rounded(p()) for k, p in plans.items()}
    for block, rows, at_work in ((3, 4096, 8), (5, 64, 1)):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        monkeypatch.setattr(search, "ROW_BLOCK", rows)
        monkeypatch.setattr(search, "AT_WORK", at_work)
        for k, p in plans.items():
            assert rounded(p()) == want[k], k
    with pytest.raises(Exception, match="not finite"):
        search.search(v, queries(spark, [[1.0] * 64] * 5 + [[float("nan")] * 64]), K.sign_hamming(), 1).collect()
    with pytest.raises(Exception, match="coordinates"):
        search.search(v, queries(spark, some(2, 9, 32)), K.sign_hamming(), 1).collect()


def test_a_plan_is_as_long_for_any_number_of_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    v, found = table(spark, some(1, 60)), []
    for n in (10, 200):
        p = search.search(v, queries(spark, some(2, n)), K.sign_hamming(), 2)
        found.append(len(p._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        assert p.count() == 2 * n
    assert found[0] == found[1] < 12


def test_exact_threshold_and_histogram(spark):
    x = np.array([[float((i * 7 + j) % 5 - 2) for j in range(64)] for i in range(300)], np.float32)
    v, q = table(spark, x), queries(spark, x[[0, 7, 9]])
    for scorer in (K.sign_hamming(), K.bitmap_overlap(16), K.code_l1(2)):
        for m in (1, 12, 299, 300, 900):
            got = search.candidates_exactly(v, q, scorer, m).orderBy("query_id", "pos").collect()
            assert {(r.query_id, r.row_id) for r in got} == {(r.query_id, r.row_id) for r in search.candidates(v, q, scorer, m).collect()}
            assert [r.pos for r in got] == list(range(min(m, 300))) * 3
        hist = {(r.query_id, r.score): r.n for r in search.histogram(v, q, scorer).collect()}
        want = search.score_all(v, q, scorer).groupBy("query_id", F.col("score").cast("int").alias("score")).count().collect()
        assert hist == {(r.query_id, r.score): r["count"] for r in want}
    asked = v.where("row_id in (3, 40)").withColumnRenamed("row_id", "query_id")
    near = {r.query_id: r.n for r in search.histogram(v, asked, K.sign_hamming(), own=False).groupBy("query_id").agg(F.sum("n").alias("n")).collect()}
    assert near == {3: 299, 40: 299} and probes.near_collisions(v, asked, 2).count() == 2


def test_two_stages_in_one_pass(spark, tmp_path):
    x, q = some(5, 700, 128), some(6, 9, 128)
    v, asked = table(spark, x), queries(spark, q)
    for n_top in (None, 32):
        ix = I.TwoStageIndex(spark, 128, 2, n_top).add(v, "row_id").keep(f"{tmp_path}/{n_top}")
        assert len(ix) == 700 and ix.bytes_per_vec == 32 + 16
        first = K.sign_hamming() if n_top is None else K.bitmap_overlap(n_top)
        for m, k in ((60, 10), (700, 10), (5, 10)):
            got = ix.search_two_stage(asked, k, CandidatePolicy(m, 1, m))
            s1, s2 = first.score(first.docs(x), first.queries(q)), K.bucket_asymmetric(128, 2)
            s2 = s2.score(s2.docs(x), s2.queries(q))
            want = []
            for j in range(9):
                c = np.lexsort((np.arange(700), s1[:, j] if n_top is None else -s1[:, j].astype(int)))[:m]
                want += [(j, i + 1, int(d)) for i, d in enumerate(c[np.lexsort((c, -s2[c, j]))][:k])]
            assert results(got) == want
            assert results(search.two_stage(v, asked, first, K.bucket_asymmetric(128, 2), m, k)) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 1  # the codes are read once
    assert search.two_stage(v, asked.limit(0), first, K.bucket_asymmetric(128, 2), 5, 5).count() == 0
    assert ix.search_two_stage(asked, 0).count() == 0


def test_running_totals(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("n")).repartition(6)
    got = {r.id: r.t for r in mutate.running_total(df, "id", "n", "t").collect()}
    assert got == {i: sum(j % 7 for j in range(i + 1)) for i in range(1000)}


def test_blocks_of_no_queries(spark):
    v = table(spark, some(1, 5))
    none = queries(spark, some(1, 1)).limit(0)
    assert search.search(v, none, K.sign_hamming(), 3).count() == 0 and search.candidates_exactly(v, none, K.sign_hamming(), 3).count() == 0
    with pytest.raises(ParameterError):
        search.search(v, none, K.sign_hamming(), -1)
