"""Families whose sets are a little too far from each other, and shingles that many documents share."""

import random

import numpy as np
import pytest

from rankmill.llm import ngram_join
from rankmill.llm.shared import mapped

from tests.llm.common import frame, prose
from tests.llm.test_dedup import brute


def edited(size, words, places, edits, own=None, seed=4):
    """Texts of one wording, each with edits of the same places changed; own: so many words to change one to."""
    r = random.Random(seed)
    base, out = prose(seed, words).split(" "), {}
    at = r.sample(range(words), places)
    for i in range(size):
        w = list(base)
        for k in r.sample(at, edits):
            w[k] = f"p{k}" if own is None else f"p{k}x{r.randrange(own)}"
        out[i] = " ".join(w)
    return out


def sets_of(r, n, size, vocabulary):
    pool = r.integers(0, 2**63, vocabulary)
    return [r.choice(pool, int(r.integers(1, size)), replace=False) for _ in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_tiles_find_all_links(seed):
    r = np.random.default_rng(seed)
    d = sets_of(r, 60, 40, 50)
    d[30:40] = [np.append(x[: len(x) - 1], 7) for x in d[:10]]
    n = r.integers(40, 300, 60)
    s = np.array([len(x) for x in d]) * 190 - n * 10
    core = r.random(60) < 0.2
    tile = lambda lo, hi: (np.arange(lo, hi), s[lo:hi], core[lo:hi], np.concatenate(d[lo:hi]), np.array([len(x) for x in d[lo:hi]]))
    links = ngram_join.tile_links(tile(0, 25), tile(25, 60), 90, False)[0] + ngram_join.tile_links(tile(0, 25), tile(0, 25), 90, True)[0] + ngram_join.tile_links(tile(25, 60), tile(25, 60), 90, True)[0]
    ok = lambda i, j: len(set(d[i]) & set(d[j])) * 380 >= s[i] + s[j]
    assert all(ok(i, j) for i, j in links)

    def groups(edges):
        at = list(range(60))
        for i, j in [*edges, *((a, b) for a in np.flatnonzero(core) for b in np.flatnonzero(core))]:
            x, y = at[i], at[j]
            at = [min(x, y) if z in (x, y) else z for z in at]
        return at

    assert groups(links) == groups([(i, j) for i in range(60) for j in range(i) if ok(i, j)])


def counted(monkeypatch):
    """Pairs verified on sets: by joins, and in tiles."""
    n, verified, tiled = [], ngram_join._verified, ngram_join._tiled

    def by_join(pairs, level, percent):
        n.append(pairs.count())
        return verified(pairs, level, percent)

    def in_tiles(level, sizes, percent):
        out = tiled(level, sizes, percent)
        n.append(out.agg({"verified": "sum"}).first()[0] or 0)
        return out

    monkeypatch.setattr(ngram_join, "_verified", by_join)
    monkeypatch.setattr(ngram_join, "_tiled", in_tiles)
    return n


@pytest.mark.parametrize("own", [None, 3])
def test_long_texts_that_do_not_link_are_refused_by_sketches(spark, monkeypatch, own):
    n = counted(monkeypatch)
    for size in (100, 400):
        docs = edited(size, 2400, 130, 65, own)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicate_groups(frame(spark, docs), 3, 90).collect()}
        if size == 100:
            assert got == brute(docs, 3, 90)
        assert sum(n) < 8 * size
        n.clear()


def test_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_SETS", 16)
    docs = edited(120, 400, 30, 14, 2)
    for percent in (80, 86, 90):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicate_groups(frame(spark, docs), 3, percent).collect()}
        assert got == brute(docs, 3, percent)


@pytest.mark.parametrize("ratio", [0, 10**9])
def test_either_way_finds_the_same(spark, monkeypatch, ratio):
    monkeypatch.setattr(ngram_join, "PAIRS_A_ROW", ratio)
    docs = edited(60, 200, 12, 5, 2) | {100 + i: t for i, t in edited(40, 300, 40, 9, 2, seed=9).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicate_groups(frame(spark, docs), 3, 90).collect()}
    assert got == brute(docs, 3, 90)


@pytest.mark.parametrize("share", [1, 3])
def test_a_shingle_of_many_texts_is_not_one_tasks_work(spark, share):
    """Packed bytes of each of 1024 buckets, where every text, or a third of them, holds one passage."""
    notice, count = prose(201, 60), 1024
    own = {i: (notice + " " if i % share == 0 else "") + " ".join(f"w{i}x{k}" for k in range(60)) for i in range(12_000)}
    docs = frame(spark, own).select("doc_id", "text")
    size = [0] * count
    for r in mapped(docs, ngram_join._slices_of(3, 1.0, count), "bucket int, classes binary, sizes binary, tokens binary, shared binary").collect():
        size[r.bucket] += sum(len(r[c]) for c in ("classes", "sizes", "tokens", "shared"))
    assert max(size) <= 3 * sorted(size)[count // 2]
