"""Exact dedup, periodic runs and fill-in-the-middle against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankmill.llm import exact_dedup as copies
from rankmill.llm import fill_middle as middle
from rankmill.llm import periodic_runs as periodic
from rankmill.llm.queries import op11_exact_dedup, op12_periodic_runs, op13_fill_middle

from tests.llm.common import LOWER, SCHEMA, WORD, frame, prose, rows, texts


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- exact dedup


def groups_of(own):
    """own: (doc_id, text) of every row."""
    by = defaultdict(list)
    for i, t in own:
        by[(t or "").translate(LOWER)].append(i)
    out = Counter()
    for t, ids in by.items():
        ids.sort(key=lambda i: (i is not None, i or 0))
        for at, i in enumerate(ids):
            out[(i, ids[-1], len(ids), at == len(ids) - 1, sha(t))] += 1
    return out


def test_counters_keep_what_is_frequent():
    r = random.Random(5)
    keys = [r.choice([1, 2, 3]) if r.random() < 0.5 else r.randint(100, 10_000) for _ in range(20_000)]
    true, k, c = Counter(keys), np.empty(0, np.int64), np.empty(0, np.int64)
    for lo in range(0, len(keys), 700):
        k, c = copies.fold(k, c, np.array(keys[lo : lo + 700]), 15)
        assert len(k) <= 15
    got = dict(zip(k.tolist(), c.tolist(), strict=True))
    for key, n in true.items():
        assert n - len(keys) / 16 <= got.get(key, 0) <= n


@pytest.mark.parametrize("heavy", [1, 3, 1000])
def test_copies_are_those_of_brute_force(spark, heavy):
    own = texts() | {100 + i: "The hot TEXT" if i % 2 else "the hot text" for i in range(60)} | {200 + i: f"pair {i // 2}" for i in range(40)}
    # Repeated rows in a heavy and in a light group, and rows without doc_id.
    more = [(i, t, "en", "s", n, "x", 1, 2, "y", "z") for i, t, n in ((159, "the hot text", 1), (159, "the hot text", 2), (159, "the hot text", 2), (239, "pair 19", 1), (239, "pair 19", 1), (None, "lone", 1), (None, "lone", 1), (None, None, 1), (None, "pair 3", 0))]
    docs = frame(spark, own, more)
    every = [(r[0], r[1]) for r in rows(own)] + [(m[0], m[1]) for m in more]
    got = copies.exact_copies(docs, heavy)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = groups_of(every)
    assert Counter(tuple(r) for r in got.collect()) == want
    whole = copies.exact_dedup(docs.withColumn("KEPT", F.lit("mine")), heavy)
    assert whole.columns == [*docs.columns, "KEPT", "keep_id", "group_size", "kept_1", "text_sha256"]
    assert Counter(tuple(r) for r in whole.select("doc_id", "keep_id", "group_size", "kept_1", "text_sha256").collect()) == want
    stay = copies.drop_exact_duplicates(docs, heavy)
    assert stay.columns == docs.columns
    assert Counter((r.doc_id, sha((r.text or "").translate(LOWER))) for r in stay.collect()) == Counter({(d, s): n for (d, _, _, k, s), n in want.items() if k})
    assert sum(r.n_chars == 2 for r in stay.where("doc_id = 159").collect()) <= 1


def test_heavy_digests_are_few_and_exact(spark):
    own = {i: "hot" if i % 3 == 0 else f"warm {i % 10}" if i % 3 == 1 else f"cold {i}" for i in range(900)}
    table = frame(spark, own).select(copies.digest("text").alias("digest"), "doc_id")
    found = {r.digest: (r.keep_id, r.group_size, r.at_keep) for r in copies.heavy_winners(table, 5).collect()}
    assert len(found) <= 10 and found[sha("hot")] == (897, 300, 1)


def test_copies_of_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert copies.exact_copies(none).count() == 0 and copies.drop_exact_duplicates(none).count() == 0


# ---- periodic runs


def plain_runs(w, least=24, times=3):
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)  # a smaller period comes first
            i = j
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_are_those_of_brute_force():
    r, many = random.Random(7), 0
    for turn in range(1500):
        size, letters = r.randint(0, 90), r.choice([1, 2, 3, 30])
        w = [r.randint(1, letters) for _ in range(size)]
        for _ in range(r.randint(0, 3)):
            part = [r.randint(1, letters) for _ in range(r.randint(1, 14))]
            at = r.randint(0, len(w))
            w[at:at] = (part * r.randint(2, 9))[: r.randint(1, 90)]
        least, times = r.choice([(24, 3), (1, 2), (10, 2), (6, 3), (9, 4)])
        want = plain_runs(w, least, times)
        many += len(want) > 1
        assert periodic.runs(w, least, times) == want
        h = np.array([x * 0x9E3779B97F4A7C15 % 2**64 for x in w], np.uint64)
        parts = periodic.stretches(h, np.zeros(len(w), np.int64), least, times)
        assert [(a + s, n, q) for a, b in parts for s, n, q in periodic.runs(w[a:b], least, times)] == want
    assert many > 100


def test_steps_of_a_long_run_are_few():
    w = [i % 5000 for i in range(40_000)]
    assert periodic.runs(w) == [(0, 40_000, 5000)] and periodic.runs([1] * 50_000) == [(0, 50_000, 1)]


def plant(i, w):
    h, n = zlib.crc32(str(i).encode()), len(w)
    g = h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def periodic_rows(own):
    out = {}
    for i, t in own.items():
        w = plant(i, WORD.findall(t or ""))
        found = plain_runs(w)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
        out[i] = (len(found), *top, top[0] if top[0] is None else 1000 * top[1] // top[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_periodic_query_is_brute_force(spark, tmp_path):
    own = texts()
    del own[23]  # too long for the plain version
    for i in range(60, 200):
        own[i] = prose(i, i)
    own |= {40: "a b c " * 9, 41: prose(1, 30) + " la" * 25 + " " + "x y\t" * 12 + "\nend", 42: "la " * 23, 43: "la " * 24, 44: ("p q r s t u v w x " * 3).strip(), 45: "p q r s t u v w x " * 2, 46: "é ñ " * 20 + "é", 47: "    " * 15}
    frame(spark, own).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_periodic_runs(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["bigint"] * 6 + ["string"] * 2
    want = periodic_rows(own)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want and got.count() == len(own)
    assert sum(x[0] > 0 for x in want.values()) > 15


def test_collapsed_texts_and_columns(spark):
    own = {0: "start " + "do it again now " * 8 + "end", 1: None, 2: " ", 3: "x " * 5000, 4: prose(3, 20_000)}
    got = {r.doc_id: r for r in periodic.collapse_runs(frame(spark, own).withColumn("top", F.lit("mine"))).collect()}
    assert got[0].text == "start do it again now end" and [tuple(x) for x in got[0].runs] == [(1, 32, 4)] and tuple(got[0].top_1) == (1, 32, 4) and got[0].top == "mine"
    assert (got[1].text, got[1].runs, got[1].top_1, got[2].text) == ("", [], None, "") and got[3].text == "x" and got[4].text == own[4]
    assert periodic.collapse_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert periodic.collapse_runs(frame(spark, {1: "a a a a"}), 4, 2).first().text == "a"
    with pytest.raises(ValueError):
        periodic.collapse_runs(frame(spark), 24, 1)


# ---- fill in the middle


def plain_middle(i, t):
    t = t or ""
    h = hashlib.sha256(f"1:{i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
        return len(t), "plain", None, None, t
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    return (len(t), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(t), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_middle_query_is_brute_force(spark, tmp_path):
    own = texts() | {i: t for i, t in enumerate(["a<P>b", "<S>", "x <M> y", "<P", "S>", "<", "<S<S", "P>é<", "😀" * 50, "é" * 3, "<p> <Q> < P>", "\n<\nP\n>"] * 8, 1000)}
    frame(spark, own).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in op13_fill_middle(spark, str(tmp_path)).collect()}
    want = {i: plain_middle(i, t) for i, t in own.items()}
    assert got == {i: (*x[:4], sha(x[4]), sha(own[i] or "")) for i, x in want.items()}
    assert {x[1] for x in want.values()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_units_round_trip(spark, unit):
    out = middle.fill_middle(frame(spark).withColumn("n", F.lit(3)), seed="s", rate=100, spm=50, unit=unit)
    assert "n_1" in out.columns and out.columns[: len(SCHEMA.split(","))] == frame(spark).columns
    got = {r.doc_id: r for r in out.withColumn("back", middle.restored(F.col("text"), F.col("form"))).collect()}
    for i, t in texts().items():
        t = t or ""
        assert got[i].back == t and got[i].n_1 == {"char": len(t), "word": len(WORD.findall(t)), "line": t.count("\n", 0, -1) + 1 if t else 0}[unit]
        assert got[i].form == ("plain" if not t else got[i].form) and (got[i].prefix_units is None) == (not t)


def test_select_finds_each_mark():
    r = random.Random(2)
    for _ in range(200):
        data = bytes(r.choice([65, 0xC3, 0x80]) for _ in range(r.randint(1, 70)))
        marks = middle.mask(data, middle.LEAD)
        want = [i for i, b in enumerate(data) if not 0x80 <= b < 0xC0]
        assert [middle.select(marks, k, len(data)) for k in range(marks.bit_count())] == want


def test_middle_of_no_rows_and_no_id(spark):
    assert middle.fill_middle(spark.createDataFrame([], SCHEMA)).count() == 0
    got = middle.fill_middle(spark.createDataFrame([(None, "abc"), (None, None)], "doc_id long, text string"), rate=100).collect()
    assert len(got) == 2 and len({r.form for r in got}) == 2


@pytest.mark.parametrize("run,name", [(op11_exact_dedup, "op11_exact_dedup"), (op13_fill_middle, "op13_fill_middle")])
def test_sql_agrees_on_odd_texts(spark, tmp_path, run, name):
    import duckdb

    from rankmill.llm.queries import ORACLES

    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(ORACLES[name])
    got = run(spark, str(tmp_path)).select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
