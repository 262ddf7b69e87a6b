import glob
import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankmill.sources import formats, results
from rankmill.streaming.ingest import append_stream


def rows(spark, values):
    return spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(values)], "row_id long, value array<long>").repartition(2)


def test_golden_bytes(spark, tmp_path):
    p = str(tmp_path / "x")
    formats.write(rows(spark, [[0, 0, 1, 1, 2, 2, 3, 3]]), p, "buckets", 8, bits=2)
    assert open(p, "rb").read() == b"OVRQ" + bytes([1, 2]) + struct.pack("<II", 8, 1) + bytes([0x05, 0xAF])
    formats.write(rows(spark, [[0, 1, 2, 3]]), p, "rank", 4)
    assert open(p, "rb").read() == b"OVR1" + bytes([1]) + struct.pack("<II", 4, 1) + struct.pack("<4H", 0, 1, 2, 3)
    formats.write(rows(spark, [[-(1 << 62)]]), p, "bitmap", 64, n_top=2)
    assert open(p, "rb").read()[17:] == bytes(7) + b"\xc0"


@pytest.mark.parametrize("kind", ["rank", "buckets", "bitmap", "sign", "pairs"])
def test_round_trip(spark, tmp_path, kind):
    r = np.random.default_rng(1)
    ranks = np.argsort(r.normal(size=(70, 64)), axis=1)
    extra = {"buckets": {"bits": 4}, "bitmap": {"n_top": 16}}.get(kind, {})
    if kind == "rank":
        values = ranks
    elif kind in ("buckets", "pairs"):
        values = (ranks << extra.get("bits", 2)) // 64
    else:
        bits = ranks >= 48 if kind == "bitmap" else r.normal(size=(70, 64)) > 0
        values = np.packbits(bits, axis=1, bitorder="little").view("<i8")
    p = str(tmp_path / "x")
    meta = formats.write(rows(spark, values), p, kind, 64, **extra)
    got = formats.read(spark, p).orderBy("row_id").collect()
    assert [g.value for g in got] == values.tolist() and [g.row_id for g in got] == list(range(70))
    assert meta.vector_count == 70
    data = open(p, "rb").read()
    for bad in (data[:-1], data + b"x", b"XXXX" + data[4:], data[:4] + b"\x09" + data[5:], data[:8]):
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(formats.FormatError):
            formats.read(spark, str(tmp_path / "bad"))
    if kind != "pairs":
        old = {v: k for k, v in formats.OLDER.items()}[kind]
        (tmp_path / "old").write_bytes(old + data[4:])
        assert formats.probe(str(tmp_path / "old")).kind == kind
    if kind != "sign":
        (tmp_path / "bad").write_bytes(data[: meta.header_bytes] + bytes([255]) * (len(data) - meta.header_bytes))
        with pytest.raises(Exception, match="rules of its kind|out of range"):
            formats.read(spark, str(tmp_path / "bad")).collect()


@pytest.mark.parametrize("kind", ["rank", "buckets", "sign", "pairs"])
def test_files_of_many_pieces(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(formats, "ROWS_PER_TASK", 64)
    ranks = np.argsort(np.random.default_rng(2).normal(size=(300, 64)), axis=1)
    values = ranks if kind == "rank" else (ranks << 2) // 64 if kind != "sign" else np.packbits(ranks > 20, axis=1, bitorder="little").view("<i8")
    p, extra = str(tmp_path / "x"), {"bits": 2} if kind == "buckets" else {}
    table = rows(spark, values).repartition(7)
    formats.write(table, p, kind, 64, **extra)
    held = io.BytesIO()
    formats.write_to(table, held, kind, 64, **extra)
    assert open(p, "rb").read() == held.getvalue()
    for bad in (table.where("row_id <> 100"), table.union(table.where("row_id = 5")), table.withColumn("row_id", F.col("row_id") + 1)):
        with pytest.raises(formats.FormatError, match="without gaps"):
            formats.write(bad, str(tmp_path / "bad"), kind, 64, **extra)
        assert not glob.glob(str(tmp_path / "bad*"))
    formats.write(table.limit(0), p, kind, 64, **extra)
    assert formats.read(spark, p).count() == 0


def test_npy_files_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "ROWS_PER_TASK", 64)
    x = np.random.default_rng(5).normal(size=(300, 6)).astype(np.float32)
    p, table = str(tmp_path / "x.npy"), spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id int, e array<float>").repartition(7)
    formats.write_npy(table, p, 6, "e")
    assert np.array_equal(np.load(p), x)
    assert [r.embedding for r in formats.read_npy(spark, p).orderBy("row_id").collect()] == x.tolist()
    formats.write_npy(table.withColumn("e", F.col("e").cast("array<double>")), p, 6, "e")
    assert np.array_equal(np.load(p), x)
    formats.write_npy(table.limit(0), p, 6, "e")
    assert np.load(p).shape == (0, 6) and formats.read_npy(spark, p).count() == 0
    with pytest.raises(formats.FormatError, match="without gaps"):
        formats.write_npy(table.where("row_id <> 100"), str(tmp_path / "bad"), 6, "e")
    for bad in (F.when(F.col("row_id") != 7, F.col("e")), F.when(F.col("row_id") == 7, F.slice("e", 1, 5)).otherwise(F.col("e")), F.transform("e", lambda y: F.when(F.col("row_id") != 7, y)), F.slice("e", 1, 5)):
        with pytest.raises(Exception, match="one length"):
            formats.write_npy(table.withColumn("e", bad), str(tmp_path / "bad"), 6, "e")
    assert not glob.glob(str(tmp_path / "bad*"))


def test_every_faulty_row_is_found(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "ROWS_PER_TASK", 64)
    ranks = np.argsort(np.random.default_rng(6).normal(size=(150, 64)), axis=1)
    p = str(tmp_path / "x")
    for kind, values, extra in (("rank", ranks, {}), ("buckets", (ranks << 2) // 64, {"bits": 2}), ("pairs", (ranks << 2) // 64, {})):
        formats.write(rows(spark, values), p, kind, 64, **extra)
        assert formats.faults(spark, p).count() == 0
        bad = values.copy()
        bad[[3, 70, 149]] = 1
        formats.write(rows(spark, bad), p, kind, 64, **extra)
        found = sorted(tuple(r) for r in formats.faults(spark, p).collect())
        assert [r for r, _ in found] == [3, 70, 149] and len({f for _, f in found}) == 1
        with pytest.raises(Exception, match="row (3|70|149) breaks"):
            formats.read(spark, p).collect()
    formats.write(rows(spark, (ranks << 2) // 64), p, "pairs", 64)
    data = bytearray(open(p, "rb").read())
    data[-1] = 5  # the place of a row after the last one
    (tmp_path / "x").write_bytes(data)
    assert [tuple(r) for r in formats.faults(spark, p).collect()] == [(149, "padding that isn't 0")]
    words = np.packbits(ranks >= 48, axis=1, bitorder="little").view("<i8").copy()
    words[5] = 0
    formats.write(rows(spark, words), p, "bitmap", 64, n_top=16)
    assert [tuple(r) for r in formats.faults(spark, p).collect()] == [(5, "bits set")]
    formats.write(rows(spark, words), p, "sign", 64)
    assert formats.faults(spark, p).count() == 0


def test_npy_and_results(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "x.npy", x)
    assert [r.embedding for r in formats.read_npy(spark, str(tmp_path / "x.npy"), 3).orderBy("row_id").collect()] == x[:3].tolist()
    found = spark.createDataFrame([(7, 1, 3, 0.5), (7, 2, 1, 0.25)], "query_id long, rank int, row_id long, score double")
    results.write_top_k(found, str(tmp_path / "top"), "d", "test", "m", 2)
    assert [(r.doc_id, r.score, r.pos) for r in results.read_top_k(spark, str(tmp_path / "top")).orderBy("pos").collect()] == [("3", 0.5, 0), ("1", 0.25, 1)]
    (tmp_path / "q.json").write_text('{"1": {"a": 2}, "2": {}}')
    assert [tuple(r) for r in results.read_qrels(spark, str(tmp_path / "q.json")).collect()] == [("1", "a", 2)]
    (tmp_path / "ids.json").write_text('["a", "b\\"c"]')
    assert sorted(tuple(r) for r in results.read_ids(spark, str(tmp_path / "ids.json")).collect()) == [(0, "a"), (1, 'b"c')]
    judged = spark.createDataFrame([(1, "a", 2), (1, 'b"c', 0), (2, "été", 1)], "query_id long, doc_id string, rel int").repartition(3)
    results.write_qrels(judged, str(tmp_path / "qrels"))
    assert sorted(tuple(r) for r in results.read_qrels(spark, str(tmp_path / "qrels"), lines=True).collect()) == [("1", "a", 2), ("1", 'b"c', 0), ("2", "été", 1)]
    results.write_ids(spark.createDataFrame([(0, "a"), (1, 'b"c')], "row_id long, id string"), str(tmp_path / "ids"))
    assert sorted(tuple(r) for r in results.read_ids(spark, str(tmp_path / "ids"), lines=True).collect()) == [(0, "a"), (1, 'b"c')]


def test_stream(spark, tmp_path):
    v = spark.createDataFrame([(0, [float(i) for i in range(64)]), (1, [1.0])], "row_id long, embedding array<float>")
    v.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(v.schema).parquet(str(tmp_path / "in"))
    append_stream(s, str(tmp_path / "out"), str(tmp_path / "ck"), 64, 16).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [g.row_id for g in got] == [0] and got[0].ranks == list(range(64)) and got[0].top_words == [-(1 << 48)]
