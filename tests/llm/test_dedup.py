import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankmill.llm import ngram_join, substring_dedup as sub
from rankmill.llm.components import connected_components
from rankmill.llm.text import NOT_ALNUM, SPACE, Rolling, Words, ngram

from tests.llm.common import SCHEMA, WORD, frame, prose, rows, texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(own, n, percent):
    sets, group = {i: shingles(t, n) for i, t in own.items()}, {i: i for i in own}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(own)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                group[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_groups_are_those_of_brute_force(spark, n, percent):
    got = ngram_join.near_duplicate_groups(frame(spark), n, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(texts(), n, percent)


def test_large_group_of_near_copies(spark):
    words, own = prose(5, 150).split(" "), {}
    for i in range(160):
        w = list(words)
        for k in range(i % 5):
            w[(i * 7 + k * 31) % 150] = f"e{i}x{k}"
        own[1000 - i] = " ".join(w)
    got = ngram_join.near_duplicate_groups(frame(spark, own), 3, 90)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(own, 3, 90)


def family(size, edits, seed, vocabulary=None, words=150):
    """Texts of one wording, each with so many words changed, at places of its own."""
    r = random.Random(seed)
    base, out = prose(seed, words).split(" "), {}
    for i in range(size):
        w = list(base)
        for k, at in enumerate(r.sample(range(words), edits)):
            w[at] = f"e{i}x{k}" if vocabulary is None else f"v{r.randrange(vocabulary)}"
        out[i] = " ".join(w)
    return out


def counted(monkeypatch):
    """How many pairs are verified, by whole sets or differences."""
    n, verified = [], ngram_join._verified

    def run(pairs, level, percent):
        n.append(pairs.count())
        return verified(pairs, level, percent)

    monkeypatch.setattr(ngram_join, "_verified", run)
    return n


@pytest.mark.parametrize(("edits", "vocabulary"), [(3, None), (4, 40)])
def test_families_that_do_not_link_make_few_candidates(spark, monkeypatch, edits, vocabulary):
    n, per = counted(monkeypatch), []
    for size in (100, 400, 1600):
        own = family(size, edits, 9, vocabulary)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicate_groups(frame(spark, own), 3, 90).collect()}
        if size <= 400:
            assert got == brute(own, 3, 90)
        per.append(sum(n) / size)
        n.clear()
    assert max(per) < 4 * ngram_join.GROUP


def test_families_in_families(spark, monkeypatch):
    """Variants of a wording, copies of each with their own edits, some too far from all others."""
    r, own = random.Random(3), {}
    base = prose(77, 200).split(" ")
    for v in range(6):
        variant = list(base)
        for at in r.sample(range(200), 6):
            variant[at] = f"variant{v}x{at}"
        for i in range(50):
            w = list(variant)
            for at in r.sample(range(200), r.randrange(0, 8)):
                w[at] = f"w{r.randrange(30)}"
            own[v * 50 + i] = " ".join(w)
    for n, percent in ((3, 90), (5, 80), (1, 95)):
        got = ngram_join.near_duplicate_groups(frame(spark, own), n, percent)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(own, n, percent)


def test_spread_joins_are_joins(spark):
    from rankmill.llm import shared

    big = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"), "id")
    table = shared.written(big.groupBy("k").agg(F.count("*").alias("rows"), F.min("id").alias("m")).where("k <> 7"), "t")
    want = sorted(map(tuple, big.join(table.drop("rows"), "k").collect()))
    assert sorted(map(tuple, shared.spread_join(big, table, ["k"], "rows", "id").collect())) == want
    assert shared.spread_join(big, table, ["k"], "rows", "id", "left").count() == 5000


def test_rows_of_one_id_are_one_document(spark):
    own = texts()
    more = [(0, own[9], None, None, 1, "", 1, 1, "", ""), (41, own[9], None, None, 1, "", 1, 1, "", ""), (16, own[9], None, None, 1, "", 1, 1, "", "")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.near_duplicate_groups(frame(spark, {0: own[0], 1: own[1], 9: own[9], 16: ""}, more), 3, 90).collect()}
    size = len(shingles(own[9], 3))
    assert got == {(0, len(shingles(own[0], 3))): 0, (1, len(shingles(own[0], 3))): 0, (9, size): 0, (0, size): 0, (41, size): 0, (16, size): 0, (16, 0): 16}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    more = [rows({0: texts()[0]})[0], (None, texts()[0], None, None, 1, "", 1, 1, "", "")]
    got = ngram_join.near_duplicate_groups(frame(spark, {0: texts()[0], 3: texts()[3]}, more), 3, 90).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (0, 0), (3, 0)]
    none = spark.createDataFrame([], SCHEMA)
    assert ngram_join.near_duplicate_groups(none).count() == 0
    assert ngram_join.drop_near_duplicates(none).count() == 0
    kept = ngram_join.drop_near_duplicates(frame(spark), 5, 80)
    assert kept.columns == frame(spark).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in brute(texts(), 5, 80).items() if c == i}


def test_components(spark):
    edges = [(i, i + 1) for i in range(50) if i not in (10, 30)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 if i <= 10 else 11 if i <= 30 else 31 for i in range(51)} | {90: 90, 95: 90, 100: 90}


def brute_spans(own, window):
    first, out = {}, {}
    for i in sorted(own):
        w = WORD.findall(own[i] or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k : k + window]), i) < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("window", [50, 7])
def test_removed_words_are_those_of_brute_force(spark, window):
    got = sub.substring_dedup(frame(spark), window, digest=True)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()} == brute_spans(texts(), window)


def test_substring_texts_and_spans(spark):
    for r in sub.substring_dedup(frame(spark)).collect():
        words = WORD.findall(texts()[r.doc_id] or "")
        for s in reversed(r.spans):
            assert s.end - s.start >= 50
            del words[s.start : s.end]
        assert r.kept == " ".join(words)
    assert sub.substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hashes_follow_words():
    w = Words(SPACE, lower=True)
    assert w.of("Ab cd\u00e9") == w.of(" aB\tcd\u00e9\n") != w.of("ab cde")
    assert len(set(w.of(" ".join(f"{i}" for i in range(5000))))) == 5000
    a = Words(NOT_ALNUM, lower=True)
    assert a.of("CC-BY nc 4.0") == a.of("cc by,NC/4 0")
    h = np.array(w.of(prose(1, 100)), np.uint64)
    for n in (1, 3, 5, 25):
        assert int(ngram(h, n)[7]) == int(ngram(h[7 : 7 + n], n)[0])
    assert (Rolling(h).grams(9) == ngram(h, 9)).all()
    assert math.isclose(len(set(ngram(h, 5).tolist())), 96)


@pytest.mark.parametrize("flush", [1, 3000, sub.FLUSH])
def test_windows_decided_in_tasks_and_beyond(spark, monkeypatch, flush):
    """A notice in a third of many texts, at fixed and at other places; the same however much a task gathers."""
    monkeypatch.setattr(sub, "FLUSH", flush)
    monkeypatch.setattr(sub, "MOST", 2)
    r, notice = random.Random(8), prose(200, 60)
    own = {}
    for i in range(120):
        head = prose(300 + i, r.choice([0, 0, 7, 25, 50]))
        own[r.randrange(1 << 40)] = f"{head} {notice if i % 3 else ''} {prose(500 + i, 40)}"
    got = sub.substring_dedup(frame(spark, own), 50, digest=True)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()} == brute_spans(own, 50)


def test_a_passage_in_a_third_of_all_texts_is_not_one_tasks_work(spark):
    """Packed bytes of each bucket, for 6000 texts of which a third hold one passage."""
    notice = prose(201, 60)
    own = {i: (notice + " " if i % 3 == 0 else "") + " ".join(f"w{i}x{k}" for k in range(30)) for i in range(6000)}
    count = 64
    docs = frame(spark, own).select("doc_id", "text")
    size = {k: 0 for k in range(count)}
    for r in sub.mapped(docs, sub._probes(25, count), sub.DEALT).where("begins is not null").collect():
        size[r.bucket] += sum(len(r[c]) for c in ("docs", "begins", "places", "hashes"))
    per = sorted(size.values())
    assert per[-1] <= 3 * per[count // 2]


def test_repeated_rows_and_null_ids_of_substrings(spark):
    own = {5: prose(1, 120), 7: prose(1, 120) + " more"}
    more = [rows({7: own[7]})[0], (None, own[5], None, None, 1, "", 1, 1, "", ""), (5, own[5], None, None, 1, "", 1, 1, "", "")]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in sub.substring_dedup(frame(spark, own, more)).collect())
    assert got == [(5, 120, 0), (5, 120, 0), (7, 121, 120), (7, 121, 120)]
