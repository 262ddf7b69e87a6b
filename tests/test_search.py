import numpy as np
import pytest
from pyspark.sql import functions as F

from rankmill.functions import kernels as K
from rankmill.operators import evaluation as V
from rankmill.operators import mutate, research, search, validate
from rankmill.spec import ParameterError

SCHEMA = "row_id long, embedding array<float>"


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], SCHEMA).repartition(3)


def queries(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "query_id long, embedding array<float>")


def results(found):
    return [(r.query_id, r.rank, r.row_id) for r in found.orderBy("query_id", "rank").collect()]


def test_small_example(spark):
    up, down = list(range(1, 9)), list(range(8, 0, -1))
    got = search.search(table(spark, [down, up, [8, 1, 7, 2, 6, 3, 5, 4]]), queries(spark, [down]), K.bucket_asymmetric(8, 1), 1).first()
    assert got.row_id == 0 and round(got.score, 3) == 0.396


def test_ties_go_by_row_id_and_k_is_cut(spark):
    v = table(spark, [list(range(64))] * 8)
    for scorer in (K.rank_symmetric(64), K.bucket_asymmetric(64, 2), K.bitmap_overlap(16), K.sign_hamming(), K.pair_scan(64)):
        assert results(search.search(v, queries(spark, [[0.0] * 64]), scorer, 4)) == [(0, i + 1, i) for i in range(4)]
        assert search.search(v, queries(spark, [[0.0] * 64]), scorer, 99).count() == 8
        assert search.search(v, queries(spark, [[0.0] * 64]), scorer, 0).count() == 0
    with pytest.raises(ParameterError):
        search.search(v, queries(spark, [[float("nan")] * 64]), K.sign_hamming(), 1)


def test_listed_twice_stays_twice(spark):
    v, q = table(spark, [list(range(64))] * 10), queries(spark, [[0.0] * 64])
    c = lambda ids: spark.createDataFrame([(0, p, i) for p, i in enumerate(ids)], "query_id long, pos int, row_id long")
    assert [r for *_, r in results(search.search_subset(v, q, c([9, 3, 7, 1]), K.bucket_asymmetric(64, 2), 2))] == [1, 3]
    assert [r for *_, r in results(search.search_subset(v, q, c([7, 8, 7]), K.bucket_asymmetric(64, 2), 2))] == [7, 7]
    padded = search.padded(search.search_subset(v, q, c([7]), K.bucket_asymmetric(64, 2), 3), q, 3)
    assert [(r.row_id, r.score) for r in padded.orderBy("rank").collect()][1:] == [(-1, float("-inf"))] * 2
    lists = search.csr(c([3, 7, 7]))
    assert tuple(lists.first()) == (0, 0, 3, [3, 7, 7]) and validate.csr_issues(lists, 10).count() == 0
    assert {r.code for r in validate.csr_issues(lists, 5).collect()} == {"unknown_row"}


def test_scans_agree_with_numpy(spark):
    r = np.random.default_rng(4)
    x, q = r.normal(size=(300, 64)).astype(np.float32), r.normal(size=(7, 64)).astype(np.float32)
    v, asked = table(spark, x), queries(spark, q)
    for scorer in (K.rank_symmetric(64), K.rank_asymmetric(64), K.bucket_symmetric(64, 4), K.bucket_asymmetric(64, 8), K.bucket_any_bits(64, 5), K.inner_product(), K.bitmap_overlap(8), K.sign_hamming(), K.code_l1(2), K.footrule(), K.pair_scan(64), K.tau_on_query_top(8)):
        s = scorer.score(scorer.docs(x), scorer.queries(q))
        want = [(j, n + 1, int(i)) for j in range(7) for n, i in enumerate(np.lexsort((np.arange(300), -s[:, j] if scorer.largest else s[:, j]))[:5])]
        assert results(search.search(v, asked, scorer, 5)) == want
    full = search.search(v, asked, K.bucket_asymmetric(64, 2), 5)
    assert results(search.two_stage(v, asked, K.sign_hamming(), K.bucket_asymmetric(64, 2), 300, 5)) == results(full)
    assert search.score_all(v, asked, K.sign_hamming()).count() == 2100
    assert len(list(search.blocks(asked, size=3))) == 3


def test_planted_neighbours_are_found(spark):
    r = np.random.default_rng(5)
    x = r.uniform(-1, 1, (256, 128)).astype(np.float32)
    at = r.integers(0, 256, 50)
    q = x[at] + r.uniform(-0.05, 0.05, (50, 128)).astype(np.float32)
    got = search.search(table(spark, x), queries(spark, q), K.bucket_asymmetric(128, 2), 10).collect()
    hit = {g.query_id for g in got if g.row_id == at[g.query_id]}
    assert len(hit) >= 48
    recall = V.recall_at(spark.createDataFrame(got), search.search(table(spark, x), queries(spark, q), K.inner_product(), 10), 10)
    assert recall.agg(F.avg("recall")).first()[0] > 0.6


def test_candidates_meet_rows_with_and_without_a_broadcast(spark, monkeypatch):
    r = np.random.default_rng(2)
    v, q = table(spark, r.normal(size=(300, 64))), queries(spark, r.normal(size=(7, 64)))
    for second in (K.bucket_asymmetric(64, 2), K.pair_scan(64), K.tau_on_query_top(8), K.code_l1(2), K.bilinear(2, [[1.0] * 4] * 4)):
        want = search.score_all(v, q, second)
        c = search.candidates(v, q, K.sign_hamming(), 40)
        both = search.score_candidates(v, q, c, second)
        assert both.count() == 280 and both.join(want.withColumnRenamed("score", "s"), ["query_id", "row_id"]).where(F.abs(F.col("s") - F.col("score")) > 1e-9).count() == 0
    few = results(search.two_stage(v, q, K.sign_hamming(), K.bucket_asymmetric(64, 2), 40, 5))
    monkeypatch.setattr(search, "CANDIDATE_ROWS", 3)
    assert results(search.two_stage(v, q, K.sign_hamming(), K.bucket_asymmetric(64, 2), 40, 5)) == few
    assert results(search.search_subset(v, q, c.where("query_id <> 3"), K.bucket_asymmetric(64, 2), 5)) == [x for x in few if x[0] != 3]


def test_exact_m_one_query_and_results_as_json(spark):
    v, q = table(spark, [[float((i * 7 + j) % 5 - 2) for j in range(64)] for i in range(50)]), queries(spark, [[1.0] * 64, [-1.0, 1.0] * 32])
    scored = search.score_all(v, q, K.sign_hamming())
    want = {(r.query_id, r.row_id) for r in search.candidates(v, q, K.sign_hamming(), 12).collect()}
    got = search.select_exactly(scored, 12, largest=False).orderBy("query_id", "pos").collect()
    assert {(r.query_id, r.row_id) for r in got} == want and [r.pos for r in got] == list(range(12)) * 2
    assert all(a.row_id < b.row_id for a, b in zip(got, got[1:], strict=False) if a.query_id == b.query_id)
    hits, stats = search.search_one(v, [1.0] * 64, K.sign_hamming(), 3, [9, 9, 4])
    assert sorted(i for i, _ in hits) == [4, 9, 9] and stats == {"vector_count": 50, "scored": 3, "requested": 3, "returned": 3}
    with pytest.raises(ParameterError):
        search.search_one(v, [1.0] * 64, K.sign_hamming(), 3, [50])
    bad = spark.createDataFrame([(1, '{"k": 1, "indices": [1, 2], "scores": [0.5]}')], "query_id long, json string")
    with pytest.raises(Exception, match="don't fit"):
        search.results_of_json(bad).collect()
    assert [r.rank for r in search.of_query(search.search(v, q, K.sign_hamming(), 4), 1).collect()] == [1, 2, 3, 4]


def test_metrics(spark):
    run = spark.createDataFrame([(1, "a", 3.0), (1, "b", 2.0), (1, "c", 1.0)], "query_id long, doc_id string, score double")
    rel = spark.createDataFrame([(1, "b", 1), (1, "z", 1), (2, "a", 1)], "query_id long, doc_id string, rel int")
    got = {r.query_id: r for r in V.metrics_at(run, rel, 2).collect()}
    assert got[1].mrr == 0.5 and got[1].recall == 0.5 and got[1].precision == 0.5 and got[1].map == 0.25
    assert got[1].ndcg == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3)))
    assert tuple(got[2])[1:] == (0, 0, 0, 0, 0)
    pairs = spark.createDataFrame([(i, 0.1 * i, 0.1 * i + 0.5) for i in range(20)], "query_id long, a double, b double")
    b = V.paired_bootstrap(pairs, "a", "b")
    assert b["delta"] == pytest.approx(0.5) and not b["within_noise"]


def test_tables_grow_and_shrink(spark):
    t = mutate.with_row_ids(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5), "k")
    assert t.where("k <> row_id").count() == 0 and t.count() == 1000
    more = mutate.append(t.select("row_id", "k"), spark.range(5).select((F.col("id") + 1000).alias("k")), "k")
    assert more.where("k <> row_id").count() == 0 and more.count() == 1005
    less = mutate.swap_remove(more, 3)
    assert less.where("row_id = 3").first().k == 1004 and less.count() == 1004
    with pytest.raises(ParameterError):
        mutate.swap_remove(more, 2000)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_row_ids_of_wide_rows_are_whole(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 120_000
        wide = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 10).alias("x"))
        got = mutate.with_row_ids(wide, "k")
        assert tuple(got.agg(F.count("*"), F.count_distinct("row_id"), F.sum(F.abs(F.col("k") - F.col("row_id"))), F.sum(F.length("x"))).first()) == (n, n, 0, n * 640)
        hot = spark.range(n).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.lit(1).alias("rid_place"), F.lit(2).alias("rid_tie"))
        got = mutate.with_row_ids(hot, "k", 5)
        assert got.columns == ["k", "rid_place", "rid_tie", "row_id"]
        assert tuple(got.agg(F.count("*"), F.count_distinct("row_id"), F.min("row_id"), F.max("row_id")).first()) == (n, n, 5, n + 4)
        assert got.where("k = -1").agg(F.max("row_id")).first()[0] == n // 3 + 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_tables_are_deleted_and_settings_restored(spark):
    import glob

    from rankmill import storage

    before = {k: spark.conf.get(k) for k in storage.SETTINGS}
    t = storage.written(spark.range(3), "gone")
    assert t.count() == 3 and {k: spark.conf.get(k) for k in storage.SETTINGS} == before
    storage.discard(t)
    assert not glob.glob(t.rankmill_path)
    t = storage.written(spark.range(3), "gone")
    assert storage.clear(spark) >= 1 and not glob.glob(t.rankmill_path) and storage.clear(spark) == 0


def test_bad_vectors(spark):
    v = table(spark, [[1.0, 2.0], [float("inf"), 0.0]])
    with pytest.raises(Exception, match="not finite"):
        validate.checked(v, 2).collect()
    assert validate.unit_length_issues(v, 2).count() == 2


def test_research(spark):
    r = np.random.default_rng(6)
    v = table(spark, K.unit(r.normal(size=(400, 64))))
    q = v.where("row_id % 100 = 0").withColumnRenamed("row_id", "query_id")
    routed = research.route(v, q)
    assert routed.where("query_id = row_id").count() == 4
    axes = research.principal_axes(v, 3)
    assert np.allclose(axes @ axes.T, np.eye(3))
    assert research.cell_keys(v, axes).where("cell between 0 and 7").count() == 400
    assert research.twonn(v, q) > 1


@pytest.mark.parametrize("block", [1024, 3])
def test_scores_of_a_query_travel_as_bytes(spark, monkeypatch, block):
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    x = np.random.default_rng(12).normal(size=(700, 64)).astype(np.float32)
    ids = np.random.default_rng(13).permutation(700).astype(np.int64) * 40_000 - 9_000_000
    v = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, x, strict=True)], "row_id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(7 * i, x[i].tolist()) for i in range(8)], "query_id long, embedding array<float>")
    for scorer in (K.sign_hamming(), K.inner_product()):
        found = search.score_rows(v, q, scorer)
        got = {r.query_id: r.scores for r in found.collect()}
        want = scorer.score(scorer.docs(x), scorer.queries(x[:8]))[np.argsort(ids)]
        assert sorted(got) == [7 * i for i in range(8)]
        assert all(np.allclose(got[7 * i], want[:, i]) for i in range(8))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    piece = search._Packed(K.sign_hamming(), search.Block([0], x[:1])).offer(np.arange(700), x)
    assert sum(c.nbytes for b in piece for c in b.columns) < 3 * 700
