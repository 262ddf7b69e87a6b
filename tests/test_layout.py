"""Rows by cell, walks over cells, routers by bitmaps, removals by an overlay, intervals, and numbers of two writers."""

import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankmill import index as I
from rankmill.functions import kernels as K
from rankmill.manifest.issues import Report
from rankmill.manifest.tables import KEY, Registry
from rankmill.operators import cells, evaluation, mutate, placement, research
from rankmill.spec import ParameterError

from tests.test_search import queries, table


def some(seed, n, dim=16):
    return np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)


@pytest.mark.parametrize("cell", [0, 5, 0b1011010])
def test_a_walk_is_in_order(cell):
    want = sorted(range(128), key=lambda c: ((c ^ cell).bit_count(), c))
    assert list(cells.walk(cell, 7)) == [((c ^ cell).bit_count(), c) for c in want]


def test_a_walk_of_many_bits_takes_few_steps(spark):
    keys = spark.createDataFrame([(1, (1 << 61) + 5), (2, (1 << 61) + 5), (3, 0)], "id long, cell long")
    got = {(r.id, r.probe): (r.distance, r.near) for r in cells.nearest_cells(keys, 62, 70).collect()}
    assert len(got) == 210 and got[1, 1] == (0, (1 << 61) + 5) and got[3, 2] == (1, 1) and got[3, 63] == (1, 1 << 61) and got[3, 64] == (2, 3)
    assert got[2, 2] == (1, 5)
    with pytest.raises(ParameterError):
        cells.nearest_cells(keys, 63, 1)


def test_a_probe_reads_its_folders_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "FOLDER_BITS", 3)
    monkeypatch.setattr(cells, "FILE_ROWS", 50)
    x, q = some(1, 900), some(2, 3)
    axes = research.directions(16, 6, 1)
    t = cells.CellTable(spark, str(tmp_path / "cells"), axes).write(table(spark, x))
    assert t.rows().count() == 900 and t.sizes().agg(F.sum("n")).first()[0] == 900
    per = t.rows().withColumn("file", F.col("_metadata.file_path")).groupBy("folder").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))
    assert all(r.files >= min(2, r.n // 60) for r in per.collect())  # a folder of many rows has several files
    want = {(r.query_id, r.probe, r.distance, r.row_id) for r in research.cell_candidates(table(spark, x), queries(spark, q), axes, 3).collect()}
    found = t.probe(queries(spark, q), 3)
    assert {(r.query_id, r.probe, r.distance, r.row_id) for r in found.collect()} == want and want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [folder" in plan
    one = t.probe(queries(spark, q[:1]), 1)
    assert {r.folder for r in t.rows().where(F.col("cell").isin([r.cell for r in one.select("cell").distinct().collect()])).select("folder").distinct().collect()} <= set(range(8))
    assert t.probe(queries(spark, q).limit(0), 2).count() == 0
    assert np.allclose(np.array(t.rows().where("row_id = 7").first().embedding), x[7])


def test_routers_count_without_pairs(spark):
    x, q = some(3, 800), some(4, 5)
    v, asked = table(spark, x), queries(spark, q)
    axes = research.directions(16, 3, 9)
    truth = research.true_neighbours(v, asked, 5)
    for calibrated in (False, True):
        p, pq = x.astype(np.float64) @ axes.T, q.astype(np.float64) @ axes.T
        if calibrated:
            cuts = [np.sort(p[:, a])[[math.ceil(i / 8 * 800) - 1 for i in range(1, 8)]] for a in range(3)]
            b, bq = (np.stack([(z[:, a, None] > cuts[a]).sum(1) for a in range(3)], 1) for z in (p, pq))
        else:
            b, bq = (np.clip(np.floor((z - p.min(0)) / (p.max(0) - p.min(0)) * 8), 0, 7) for z in (p, pq))
        for radius in (0, 1):
            near = (np.abs(b[None] - bq[:, None]) <= radius).any(2)
            got = research.route(v, asked, buckets=8, radius=radius, axes=axes, calibrated=calibrated)
            assert {(r.query_id, r.row_id) for r in got.collect()} == {(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True)}
            row = placement.router_recall(v, asked, truth, {"a": axes}, [radius], 8, calibrated).first()
            hits = sum(near[r.query_id, r.row_id] for r in truth.collect())
            assert row.scanned == pytest.approx(near.sum() / 5) and row.recall == pytest.approx(hits / 25)
    assert len(set(placement.primes(60))) == 60 and placement.primes(5) == [2, 3, 5, 7, 11]


@pytest.mark.parametrize("lot", [1024, 2])
def test_unions_are_counted_without_being_rows(spark, monkeypatch, lot):
    monkeypatch.setattr(research, "QUERY_BLOCK", lot)
    monkeypatch.setattr(research, "UNITED", 3)
    ids = [0, 1, 2, 32_767, 32_768, 32_769, 65_536, 200_000, 200_001]
    x, q = some(3, len(ids), 8), some(4, 7, 8)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, x, strict=True)], "row_id long, embedding array<float>")
    asked = queries(spark, [*q, q[0]]).withColumn("query_id", F.when(F.col("query_id") == 7, 1).otherwise(F.col("query_id")))  # one id, two vectors
    placed, own = research.buckets_of(v, asked, research.directions(8, 3, 9), 6)
    posted = research.postings(placed)
    got = research.united_counts(posted, own, 3, 6, [0, 1, 5])
    want = {r: research.united(posted, research.near_buckets(own, r)).agg(F.sum(F.bitmap_count("rows"))).first()[0] for r in (0, 1, 5)}
    assert dict(map(tuple, got.collect())) == want and want[5] == 7 * len(ids)
    assert "bitmap_or_agg" not in got._jdf.queryExecution().executedPlan().toString()


def test_ids_of_bitmaps_go_past_a_block(spark):
    ids = [0, 1, 32_767, 32_768, 32_769, 65_536, 65_537, 10**9]
    v = spark.createDataFrame([(i, [1.0, 2.0]) for i in ids], "row_id long, embedding array<float>")
    got = research.route(v, queries(spark, [[1.0, 2.0]]), axes=np.eye(2), buckets=1)
    assert sorted(r.row_id for r in got.collect()) == ids


def test_many_removals_are_one_overlay(spark):
    x = some(5, 200, 64)
    ix = I.SignIndex(spark, 64).add(table(spark, x), "row_id")
    own = list(range(200))
    r = np.random.default_rng(6)
    lengths = set()
    for turn in range(120):
        at = int(r.integers(0, len(own))) if turn % 9 else len(own) - 1
        assert ix.swap_remove(at) == len(own) - 1
        own[at] = own[-1]
        own.pop()
        if turn in (5, 119):
            lengths.add(len(ix.codes._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert len(lengths) == 1 and len(ix) == 80
    want = {i: K.sign_hamming().docs(x[o : o + 1]).tobytes() for i, o in enumerate(own)}
    assert {r.row_id: bytes(r.value) for r in ix.codes.collect()} == want
    with pytest.raises(ParameterError):
        ix.swap_remove(80)
    ix.add(table(spark, x[:3]), "row_id")
    assert len(ix) == 83 and {r.row_id for r in ix.codes.select("row_id").collect()} == set(range(83))
    m = mutate.Moves(1)
    assert m.remove(0) == 0 and m.over(spark.range(1).withColumnRenamed("id", "row_id")).count() == 0


def test_intervals_are_those_of_plain_resampling(spark):
    import hashlib

    r = np.random.default_rng(7)
    rows = [(m, k, q, float(r.random() + 0.1 * i)) for i, m in enumerate(("base", "x", "y")) for k in ("ndcg", "mrr") for q in range(30)]
    got = {(g.method, g.metric): (g.delta, g.low, g.high, g.within_noise) for g in evaluation.resampled(spark.createDataFrame(rows, "method string, metric string, query_id long, value double"), "base", 60, 3).collect()}
    value = {x[:3]: x[3] for x in rows}
    for m in ("x", "y"):
        for k in ("ndcg", "mrr"):
            d = np.array([value[m, k, q] - value["base", k, q] for q in range(30)])
            means = []
            for b in range(1, 61):
                u = [int(hashlib.md5(f"3:{q}:{b}".encode()).hexdigest()[:13], 16) / 2**52 for q in range(30)]
                w = np.array([sum(x >= p for p in evaluation.POISSON) for x in u])
                means.append((w * d).sum() / w.sum())
            low, high = np.percentile(means, [2.5, 97.5])
            assert got[m, k] == (pytest.approx(d.mean()), pytest.approx(low), pytest.approx(high), bool(low <= 0 <= high))
    assert len(got) == 4


def test_two_writers_never_share_a_number(spark, tmp_path):
    path = str(tmp_path / "registry")
    one, two = Registry(spark, path), Registry(spark, path)
    key = dict.fromkeys(KEY, "k")
    errors = []

    def work(reg, n):
        try:
            for _ in range(n):
                reg.put(key, Report())
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(r, 3)) for r in (one, two)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sorted(r.seq for r in one.reports().collect()) == [1, 2, 3, 4, 5, 6]
    assert one.find(key).seq == 6
