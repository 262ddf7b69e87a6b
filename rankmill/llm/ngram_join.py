"""Operator 1: n-gram Jaccard join with adaptive multi-match prefixes.

Sets of word shingles are linked when 100 * intersection >= percent * union. Two sets that link share at least L tokens
among the first n - ceil(n * percent / 100) + L of each, in any one order of the tokens, for every L. The order here is
rarest first (document frequency, then hash). Each set takes the L with the least estimated cost: the hits its prefix
draws, plus the verifications that an L-fold match leaves. A pair needs the smaller L of its two sets in shared tokens
before it is verified on whole sets.

Three steps keep groups of copies from growing into all their pairs, and lose no link:

* equal sets are one class, joined as one;
* a class with more than 100 - percent of a hundred of its tokens in no other class links with nothing and leaves. That
  is first decided on a fixed slice of the hash space (a bound on the whole), then on all tokens of what is left;
* sets that meet at a token shared by more than GROUP of them (of differences, see _meetings) become a family, and each
  is written as its difference from the family's common wording: d = set xor wording. Links don't depend on what is taken off all sets of a family:
  with s = |d| * (100 + percent) - n * (100 - percent), two sets link if and only if
  s(x) + s(y) <= 2 * (100 + percent) * |d(x) & d(y)|. So all sets with s(x) + s(m) <= 0 link to the one of least s, m
  (the core), any two sets that need no shared difference are both of the core, and other pairs must share differences.
  These are the tokens of the next round: the same prefixes, the same counting, on sets of a few edits each.

Families whose sets are all a little too far from each other share many differences, and taking them apart by tokens would
cost more than looking at each pair. There (_tiled) pairs are looked at in tiles of sets inside tasks, by parity sketches:
a fixed number of bits, each the parity of the tokens that fall on it. The bits in which two sketches differ are at most
the tokens in which two sets differ, so a pair with too many of them is refused exactly, by a popcount and without its
sets. Pairs that stay are verified on their sets until their tile hangs together; what leaves a tile is a forest of links,
never its pairs. Which way a family goes is a matter of estimated cost alone, and both find the same links.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill.functions.blocks import bits_met, words_of
from rankmill.llm.components import connected_components
from rankmill.llm.shared import buckets, discard, mapped, small, spread_join, written
from rankmill.llm.text import SPACE, Words, chunks, mix, ngram, signed, texts

#: Share of the hash space looked at first.
SLICE = 0.3
#: Classes that a task of the first step holds back until it hands them on.
FLUSH_TOKENS = 1_500_000
#: Classes that a task remembers to have sent; one sent again is counted once.
SEEN = 1_000_000
#: What L may be, from 5 on up to an eighth of the prefix for L = 0: long sets then need many shared tokens at little cost.
LEVELS, ANY_L = (1, 2, 3, 4, 8, 16, 32), 4
#: Sets that meet at a token and are matched pair by pair; more of them are a family.
GROUP = 16
#: Rounds of families at most. After the first one each is at most half of what it came from; past this all are tiled.
ROUNDS = 40
#: Sets and tokens of a tile, and pairs looked at by sketches for what a token costs as a row.
TILE_SETS, TILE_TOKENS, PAIRS_A_ROW = 1024, 1 << 17, 20
#: What verifying a pair costs, in prefix hits, for each token of the set.
VERIFY_COST = 0.05


def token_sets(words: Words, buf, bounds, n: int):
    """(tokens, starts) of a run of texts: each text's sorted distinct shingles; starts has one more entry than texts."""
    docs = len(bounds) - 1
    _, _, wdoc, h = words.split(buf, bounds)
    per = np.bincount(wdoc, minlength=docs)
    at = np.concatenate([[0], np.cumsum(per)])
    grams, gdoc = ngram(h, n), wdoc[: max(0, len(h) - n + 1)]
    whole = wdoc[n - 1 :] == gdoc if len(gdoc) else np.empty(0, bool)
    grams, gdoc = grams[whole], gdoc[whole]
    short = np.flatnonzero((per > 0) & (per < n))
    if len(short):
        own = np.array([int(ngram(h[at[d] : at[d + 1]], int(per[d]))[0]) ^ int(per[d]) for d in short], np.uint64)
        place = np.searchsorted(gdoc, short)
        grams, gdoc = np.insert(grams, place, own), np.insert(gdoc, place, short)
    cut = np.searchsorted(gdoc, np.arange(docs + 1))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        grams[a:b].sort()
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (gdoc[1:] != gdoc[:-1])
    grams = grams[keep]
    return grams, np.concatenate([[0], np.cumsum(np.bincount(gdoc[keep], minlength=docs))])


def signatures(tokens, starts):
    """128 bits of each set, as two arrays; 0 for the empty set. Sums don't depend on order, and empty runs stay 0."""
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        total = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(mix(tokens ^ np.uint64(salt)), out=total[1:])
        out.append(total[starts[1:]] - total[starts[:-1]])
    return out


def _ids(batch, lo, hi, column="doc_id"):
    return batch.column(batch.schema.get_field_index(column)).slice(lo, hi - lo)


def _sets_of(n):
    """Rows (doc_id, n_shingles, c1, c2): size and signature of every set."""

    def run(batches):
        import pyarrow as pa

        words = Words(SPACE, lower=True)
        for batch in batches:
            offsets, data = texts(batch, "text")
            for lo, hi, buf, bounds in chunks(offsets, data):
                tokens, starts = token_sets(words, buf, bounds, n)
                c1, c2 = signatures(tokens, starts)
                yield pa.RecordBatch.from_arrays(
                    [_ids(batch, lo, hi), pa.array(np.diff(starts)), pa.array(signed(c1)), pa.array(signed(c2))],
                    names=["doc_id", "n_shingles", "c1", "c2"],
                )

    return run


def _slices_of(n, share, count):
    """Rows (bucket, classes, sizes, tokens, shared): the tokens under share of the hash space, dealt by their low bits.

    classes and sizes: the classes of a row and how many tokens each has; tokens: six bytes of each, in that order. A
    class that a task has had before isn't sent again. shared: tokens that two classes of what a task has gathered hold,
    once each and without their classes: none of these has them alone.
    """
    limit = np.uint64(min((1 << 64) - 1, int(share * 2.0**64)))

    def flush(held):
        import pyarrow as pa

        cls, sizes, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
        own = np.repeat(np.arange(len(cls)), sizes)
        order = np.argsort(tokens, kind="stable")
        t = tokens[order]
        differs = np.ones(len(t) + 1, bool)
        differs[1:-1] = t[1:] != t[:-1]
        several = t[differs[:-1] & ~differs[1:]]
        one = np.zeros(len(t), bool)
        one[order[differs[:-1] & differs[1:]]] = True
        tokens, own = tokens[one], own[one]

        def dealt(tokens):
            bucket = (tokens & np.uint64(count - 1)).astype(np.min_scalar_type(count - 1))
            order = np.argsort(bucket, kind="stable")
            six = np.ascontiguousarray((tokens[order] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6])
            return order, np.searchsorted(bucket[order], np.arange(count + 1)), six

        order, cut, six = dealt(tokens)
        own = own[order]
        _, shared_cut, shared = dealt(several)
        rows = ([], [], [], [], [])
        for b in np.flatnonzero(np.diff(cut) + np.diff(shared_cut)).tolist():
            lo, hi = cut[b], cut[b + 1]
            edge = np.flatnonzero(np.diff(own[lo:hi], prepend=-1))
            blobs = (cls[own[lo:hi][edge]].tobytes(), np.diff(np.append(edge, hi - lo)).astype(np.uint32).tobytes(), six[lo:hi].tobytes(), shared[shared_cut[b] : shared_cut[b + 1]].tobytes())
            for out, x in zip(rows, (b, *blobs), strict=True):
                out.append(x)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=["bucket", "classes", "sizes", "tokens", "shared"])

    def run(batches):
        words, seen, held, waiting = Words(SPACE, lower=True), set(), [], 0
        for batch in batches:
            offsets, data = texts(batch, "text")
            for _, _, buf, bounds in chunks(offsets, data):
                if len(seen) > SEEN and not held:
                    seen.clear()
                tokens, starts = token_sets(words, buf, bounds, n)
                c1, _ = signatures(tokens, starts)
                new = np.zeros(len(c1), bool)
                for i, c in enumerate(c1.tolist()):
                    if c not in seen:
                        seen.add(c)
                        new[i] = True
                own = np.repeat(np.arange(len(c1)), np.diff(starts))
                pick = new[own] & (tokens < limit)
                tokens, sizes = tokens[pick], np.bincount(own[pick], minlength=len(c1))
                has = sizes > 0
                held.append((c1[has], sizes[has], tokens))
                waiting += len(tokens)
                if waiting >= FLUSH_TOKENS:
                    yield flush(held)
                    held, waiting = [], 0
        if waiting:
            yield flush(held)

    return run


def _eight(six: np.ndarray) -> np.ndarray:
    """Numbers of six bytes each."""
    out = np.zeros((len(six) // 6, 8), np.uint8)
    out[:, :6] = six.reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _alone(count):
    """Rows (part, classes, alone): how many tokens of a bucket each class has alone, dealt by class; as packed arrays."""

    def run(batches):
        import pyarrow as pa

        held: dict[int, list] = {}
        for batch in batches:
            for b, *blobs in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                held.setdefault(b, []).append(blobs)
        while held:
            _, blobs = held.popitem()
            cls = np.concatenate([np.frombuffer(x[0], np.uint64) for x in blobs])
            sizes = np.concatenate([np.frombuffer(x[1], np.uint32) for x in blobs]).astype(np.int64)
            tokens, shared = (_eight(np.concatenate([np.frombuffer(x[i], np.uint8) for x in blobs])) for i in (2, 3))
            _, once = np.unique(cls, return_index=True)  # a class that came from several tasks counts once
            first = np.zeros(len(cls), bool)
            first[once] = True
            own = np.repeat(np.arange(len(cls)), sizes)
            pick = first[own]
            tokens, own = tokens[pick], own[pick]
            shared = np.unique(shared)
            if len(shared):
                at = np.minimum(np.searchsorted(shared, tokens), len(shared) - 1)
                pick = shared[at] != tokens
                tokens, own = tokens[pick], own[pick]
            order = np.argsort(tokens)
            t = tokens[order]
            differs = np.ones(len(t) + 1, bool)
            differs[1:-1] = t[1:] != t[:-1]
            lone = np.bincount(own[order][differs[1:] & differs[:-1]], minlength=len(cls))
            has = np.flatnonzero(lone)
            if not len(has):
                continue
            has = has[np.argsort(cls[has] & np.uint64(count - 1), kind="stable")]
            parts = (cls[has] & np.uint64(count - 1)).astype(np.int64)
            edge = np.flatnonzero(np.diff(parts, prepend=-1))
            spans = list(zip(edge, np.append(edge[1:], len(has)), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts[edge], pa.int32()), *(pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (cls[has], lone[has].astype(np.int64)))],
                names=["part", "classes", "alone"],
            )

    return run


def _alone_summed(batches):
    """Rows (c1, alone): the sums over all buckets, a row for each class."""
    import pyarrow as pa

    held: dict[int, list] = {}
    for batch in batches:
        for b, *blobs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            held.setdefault(b, []).append(blobs)
    while held:
        _, blobs = held.popitem()
        cls, own = np.unique(np.concatenate([np.frombuffer(x[0], np.int64) for x in blobs]), return_inverse=True)
        total = np.bincount(own, np.concatenate([np.frombuffer(x[1], np.int64) for x in blobs]).astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(total.astype(np.int64))], names=["c1", "alone"])


def sketch_bits(n: np.ndarray, percent: int) -> np.ndarray:
    """Bits of the sketches of whole sets of n tokens: a power of two, some sixteen times what a linked set of that size may differ in."""
    return 1 << np.clip(np.ceil(np.log2(np.maximum(n, 1) * (32 * (100 - percent) / (100 + percent)) + 1)), 6, 16).astype(np.int64)


def _whole_sets(n, percent):
    """Rows (rep, n, tokens, sketch) of every text's set."""

    def run(batches):
        import pyarrow as pa

        words = Words(SPACE, lower=True)
        for batch in batches:
            offsets, data = texts(batch, "text")
            for _, _, buf, bounds in chunks(offsets, data, 1 << 19):
                tokens, starts = token_sets(words, buf, bounds, n)
                sizes = np.diff(starts)
                bits = sketch_bits(sizes, percent)
                ends = np.concatenate([[0], np.cumsum(bits // 64)])
                sketch, own = np.empty(ends[-1], np.int64), np.repeat(bits, sizes)
                for b in np.unique(bits):
                    at = np.flatnonzero(bits == b)
                    sketch[ends[at][:, None] + np.arange(b // 64)] = parity_sketches(tokens[own == b], sizes[at], int(b)).view(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(v)) for e, v in ((starts, signed(tokens)), (ends, sketch))]
                yield pa.RecordBatch.from_arrays([pa.array(signed(signatures(tokens, starts)[0])), pa.array(sizes), *lists], names=["rep", "n", "tokens", "sketch"])

    return run


def link_classes(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, classes, links) of docs (doc_id, text).

    sets: doc_id, n_shingles, c1, c2 of each row. classes: c1, c2, least (smallest doc_id), n, rows; c1 names a class.
    links: a, b, pairs of classes, enough of them that its components are those of all links.
    """
    docs = docs.select("doc_id", "text")
    sets = written(mapped(docs, _sets_of(n), "doc_id long, n_shingles long, c1 long, c2 long"), "sets")
    classes = sets.where("n_shingles > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.count("*").alias("rows"))
    classes = written(classes, "classes")
    count = buckets(docs)
    slices = mapped(docs, _slices_of(n, SLICE, count), "bucket int, classes binary, sizes binary, tokens binary, shared binary")
    alone = mapped(slices.repartitionById(count, F.col("bucket")), _alone(count), "part int, classes binary, alone binary")
    alone = mapped(alone.repartitionById(count, F.col("part")), _alone_summed, "c1 long, alone long")
    spare = 100 - percent
    # Different sets that link have percent / (100 - percent) tokens at least.
    left = classes.where(F.col("n") * spare >= percent).join(alone, "c1", "left").where(F.coalesce("alone", F.lit(0)) * 100 <= F.col("n") * spare)
    left = written(left.select("c1", F.col("least").alias("doc_id")), "left")
    tokens = mapped(docs.join(small(left.select("doc_id").distinct()), "doc_id", "left_semi"), _whole_sets(n, percent), "rep long, n long, tokens array<long>, sketch array<long>")
    ids = sets.where("n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("c1").alias("a"), F.max("c1").alias("b")).where("n > 1")
    repeated = ids.limit(1).count() > 0
    if repeated:  # a doc_id then brings more than the set it was taken for
        tokens = tokens.join(left.select(F.col("c1").alias("rep")), "rep", "left_semi").dropDuplicates(["rep"])
    tokens = written(tokens, "tokens")
    links = _links(tokens, percent)
    discard(left, tokens)
    if repeated:  # rows of one doc_id are one document
        own = sets.where("n_shingles > 0").join(ids.where("a <> b").select("doc_id", "a"), "doc_id").select("a", F.col("c1").alias("b"))
        links = links.union(own.where("a <> b").distinct())
    return sets, classes, links


def _xor(a: Column, b: Column) -> Column:
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def _need(s: Column, other: Column, percent: int) -> Column:
    """Differences that two sets must share at least, when they aren't both of the core."""
    return F.greatest(F.ceil((s + other) / (2 * (100 + percent))), F.lit(1)).cast("long")


def _prefixes(level: DataFrame, percent: int) -> DataFrame:
    """The prefix tokens of each set of level: g, rep, s, core, m, base, lone, token, pos, l."""
    flat = level.select("g", "rep", "s", "core", "need", F.size("d").cast("long").alias("m"), F.explode("d").alias("token"))
    df = written(flat.groupBy("g", "token").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    flat = spread_join(flat, df.withColumn("rows", F.col("df")), ["g", "token"], "rows", "rep")
    own = Window.partitionBy("g", "rep")
    flat = flat.select("*", F.row_number().over(own.orderBy("df", "token")).alias("k"), F.count("*").over(own).alias("shared"))
    flat = flat.withColumns({"lone": F.col("m") - F.col("shared"), "base": F.col("m") - F.col("need")})  # the prefix for L is base + L long
    flat = flat.withColumn("pos", F.col("lone") + F.col("k") - 1)
    most = F.greatest(F.lit(ANY_L), F.least(F.floor(F.col("base") / 8), F.lit(LEVELS[-1])))
    flat = flat.where((F.col("lone") <= F.col("base")) & (F.col("pos") < F.col("base") + most))
    hits = [F.sum(F.when(F.col("pos") < F.col("base") + i, F.col("df") - 1).otherwise(0)).over(own) for i in LEVELS]
    flat = flat.select("*", *(h.alias(f"h{i}") for i, h in zip(LEVELS, hits, strict=True)))
    cost = [F.when(most >= i, F.col(f"h{i}") * (1 + VERIFY_COST * F.col("m") / i)).otherwise(F.lit(math.inf)) for i in LEVELS]
    best = F.lit(LEVELS[-1])
    for at in range(len(LEVELS) - 2, -1, -1):
        best = F.when(cost[at] <= F.least(*cost[at + 1 :], F.lit(math.inf)), LEVELS[at]).otherwise(best)
    prefix = flat.withColumn("l", F.least(best, "need").cast("int")).where("pos < base + l")  # no more can be asked for than must be shared
    prefix = written(prefix.select("g", "rep", "s", "core", "m", "base", "lone", "token", "pos", "l"), "prefix")
    discard(df)
    return prefix


def _meetings(prefix: DataFrame) -> DataFrame:
    """prefix at the tokens where two sets can meet first (the prefix for L = 1), with size, hub and last: how many sets
    meet there, the least edited one and the largest rep. Meetings of the core alone are left out."""
    first = prefix.where("pos <= base")
    groups = first.groupBy("g", "token").agg(
        F.count("*").alias("size"), F.sum(F.when(F.col("core"), 0).otherwise(1)).alias("others"),
        F.min(F.struct((F.col("lone") / F.col("m")).alias("edits"), F.col("rep"))).alias("hub"), F.max("rep").alias("last"),
    ).where("size > 1 and others > 0").select("g", "token", "size", F.col("hub.rep").alias("hub"), "last")
    groups = written(groups.withColumn("rows", F.col("size")), "groups")
    met = written(spread_join(first, groups, ["g", "token"], "rows", "rep"), "meetings")
    discard(groups)
    return met


def _halved(sketch: Column, size: Column) -> Column:
    """A sketch as one of size words: that one itself, or of half its bits."""
    half = (F.size(sketch) / 2).cast("int")
    folded = F.zip_with(F.slice(sketch, 1, half), F.slice(sketch, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(sketch) > size, folded).otherwise(sketch)


def _may_link(percent: int) -> Column:
    """Whether whole sets of sketches sa, sb and sizes na, nb can differ in few enough tokens."""
    a, b = F.col("sa"), F.col("sb")
    size = F.least(F.size(a), F.size(b))
    bits = F.aggregate(F.zip_with(_halved(a, size), _halved(b, size), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    far = F.greatest(F.size(a), F.size(b)) > 2 * size  # sets of such sizes don't link
    return F.when(far, False).otherwise(bits * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))


def _candidates(met: DataFrame, prefix: DataFrame, percent: int, sets: DataFrame | None = None) -> DataFrame:
    """(g, a, b): pairs that meet and share as many prefix tokens as the smaller L of the two asks, each pair once.

    sets: whole sets with their sketches, by which pairs are refused before their sets are read.
    """
    need = _need(F.col("x.s"), F.col("y.s"), percent)
    first = (F.col("x.m") - F.col("x.pos") >= need) & (F.col("y.m") - F.col("y.pos") >= need)  # holds at the first shared token
    same = (F.col("x.g") == F.col("y.g")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.rep") < F.col("y.rep"))
    pairs = met.alias("x").join(met.alias("y"), same & ~(F.col("x.core") & F.col("y.core")) & first)
    pairs = pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.struct(F.col("x.g").alias("g"), F.least("x.l", "y.l").alias("l")).alias("p"))
    pairs = pairs.groupBy("a", "b").agg(F.min("p").alias("p")).select("p.g", "a", "b", "p.l")  # once, in one of the families where they meet
    heads = prefix.groupBy("g", "rep").agg(F.collect_set("token").alias("head"))
    for side in ("a", "b"):
        pairs = pairs.join(heads.select("g", F.col("rep").alias(side), F.col("head").alias(f"h{side}")), ["g", side])
    pairs = pairs.where(F.size(F.array_intersect("ha", "hb")) >= F.col("l")).select("g", "a", "b")
    if sets is None:
        return pairs
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("rep").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    return pairs.where(_may_link(percent)).select("g", "a", "b")


def _verified(pairs: DataFrame, level: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets or differences."""
    for side in ("a", "b"):
        pairs = pairs.join(level.select("g", F.col("rep").alias(side), F.col("d").alias(f"d{side}"), F.col("s").alias(f"s{side}")), ["g", side])
    return pairs.where(F.size(F.array_intersect("da", "db")) * (2 * (100 + percent)) >= F.col("sa") + F.col("sb")).select("a", "b")


def _families(met: DataFrame, level: DataFrame, percent: int, whole: bool) -> tuple[DataFrame, DataFrame]:
    """(links to the core, next level) of the families that meet in met.

    A family is all that meets at tokens of one hub (whole: few families for each set), or at tokens where the same sets
    meet. First the hub's set is taken off every one, then what is left in more than half of them.
    """
    kind = ["g", "hub"] if whole else ["g", "hub", "size", "last"]
    rows = met.select(*kind, "rep").distinct()
    rows = written(rows.select(F.xxhash64(*kind).alias("f"), "g", "hub", "rep"), "members")
    hubs = rows.groupBy("f").agg(F.first("g").alias("g"), F.first("hub").alias("hub"), F.count("*").alias("rows"))
    hubs = hubs.join(level.select("g", F.col("rep").alias("hub"), F.col("d").alias("dh")), ["g", "hub"]).select("f", "dh", "rows", F.col("rows").alias("cnt"))
    hubs = written(hubs, "hubs")
    own = rows.select("f", "g", "rep").join(level.select("g", "rep", "n", "d"), ["g", "rep"])
    own = spread_join(own, hubs, ["f"], "rows", "rep").select("f", "rep", "n", "cnt", _xor(F.col("d"), F.col("dh")).alias("d"))
    own = written(own, "differences")
    common = own.select("f", "cnt", F.explode("d").alias("token")).groupBy("f", "token").agg(F.count("*").alias("c"), F.first("cnt").alias("rows"))
    common = common.where("2 * c > rows").groupBy("f").agg(F.collect_list("token").alias("common"), F.first("rows").alias("rows"))  # twice a mean set at most
    common = written(common, "common")
    less = spread_join(own, common, ["f"], "rows", "rep", "left")
    less = less.withColumn("d", F.when(F.col("common").isNull(), F.col("d")).otherwise(_xor(F.col("d"), F.col("common")))).drop("common")
    less = less.withColumn("s", F.size("d") * F.lit(100 + percent).cast("long") - F.col("n") * (100 - percent))
    less = written(less, "family")
    best = less.groupBy("f").agg(F.min(F.struct("s", "rep")).alias("best"), F.max("s").alias("most"), F.count("*").alias("rows"))
    best = written(best.select("f", F.col("best.s").alias("low"), F.col("best.rep").alias("centre"), "most", "rows"), "best")
    all_ = spread_join(less, best, ["f"], "rows", "rep").withColumn("core", F.col("s") + F.col("low") <= 0)
    # A set of the core has no link to look for but with others, whose s is above -low.
    need = _need(F.col("s"), F.when(F.col("core"), 1 - F.col("low")).otherwise(F.col("low")), percent)
    all_ = written(all_.select(F.col("f").alias("g"), "rep", "n", "d", "s", "core", "centre", need.alias("need"), (F.col("most") + F.col("low") > 0).alias("open")), "level")
    discard(rows, hubs, own, common, less, best)
    star = all_.where("core and rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"))
    level = all_.where("open").drop("centre", "open")
    level.rankmill_path = all_.rankmill_path
    return star, level


def parity_sketches(tokens: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """Words of bits bits for each set of tokens: the parity of the tokens that fall on each bit."""
    out, ends = [], np.cumsum(sizes)
    step = max(1, (1 << 21) // bits)
    at = (tokens.view(np.uint64) >> np.uint64(17)) & np.uint64(bits - 1)
    for lo in range(0, len(sizes), step):
        own = sizes[lo : lo + step]
        first = int(ends[lo] - sizes[lo])
        place = np.repeat(np.arange(len(own)), own) * bits + at[first : first + int(own.sum())].astype(np.int64)
        out.append(words_of((np.bincount(place, minlength=len(own) * bits) & 1).reshape(-1, bits)))
    return np.concatenate(out)


def tile_links(x, y, percent: int, same: bool) -> tuple[list[tuple[int, int]], int]:
    """(links, pairs verified) between the sets of two tiles, or of one (same): a forest of links.

    A tile: reps, s, core, tokens, sizes (see _families). Two sets that link differ in no more tokens than both their
    sizes less (s(x) + s(y)) / (100 + percent).
    """
    tiles = (x,) if same else (x, y)
    reps, s, core, sizes = (np.concatenate([t[i] for t in tiles]) for i in (0, 1, 2, 4))
    tokens = np.concatenate([t[3] for t in tiles])
    spare = sizes - s / (100 + percent)
    bits = 1 << min(16, max(6, int(32 * max(1.0, spare.max())).bit_length()))
    sketch, n = parity_sketches(tokens, sizes, bits), len(x[0])
    ends = np.cumsum(sizes)
    parent, sets, links, verified = list(range(len(reps))), {}, [], 0

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def of(i):
        if i not in sets:
            sets[i] = np.sort(tokens[ends[i] - sizes[i] : ends[i]])
        return sets[i]

    hub = -1
    for i in np.flatnonzero(core).tolist():  # linked through their centre
        hub = i if hub < 0 else hub
        parent[i] = hub
    begin = 0 if same else n
    for lo in range(0, n, 256):
        met = bits_met(sketch[lo : lo + 256][: n - lo], sketch[begin:], np.bitwise_xor)
        near = met <= spare[lo : min(n, lo + 256), None] + spare[begin:] + 1e-6
        near &= ~(core[lo : min(n, lo + 256), None] & core[begin:])
        i, j = np.nonzero(near)
        order = np.argsort(met[i, j], kind="stable")
        for a, b in zip((i[order] + lo).tolist(), (j[order] + begin).tolist(), strict=True):
            if same and b <= a or root(a) == root(b):
                continue
            verified += 1
            if len(np.intersect1d(of(a), of(b), assume_unique=True)) * 2 * (100 + percent) >= s[a] + s[b]:
                parent[root(b)] = root(a)
                links.append((int(min(reps[a], reps[b])), int(max(reps[a], reps[b]))))
    return links, verified


def _tile_pairs(percent):
    def unpacked_tile(sets):
        d = sets.field("d")
        offsets = d.offsets.to_numpy()
        return (
            sets.field("rep").to_numpy(), sets.field("s").to_numpy(), sets.field("core").to_numpy(zero_copy_only=False),
            d.values.to_numpy()[offsets[0] : offsets[-1]], np.diff(offsets).astype(np.int64),
        )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (unpacked_tile(batch.column(c)[i].values) for c in (1, 2))
                links, verified = tile_links(x, y, percent, batch.column(0)[i].as_py())
                rows = [(*link, 0) for link in links] + [(None, None, verified)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["a", "b", "verified"])

    return run


def _tiled(level: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of whole families: every pair of sets that isn't of the core is looked at once, in tiles.

    level: rows of those families; sizes: g, rows, others, m of each. A family's other sets are dealt over tiles 0, 1, ...,
    its core over those behind them; each tile of others meets itself and all tiles behind it, each pair of tiles a row of its own.
    """
    parts = lambda rows: F.ceil(F.greatest(rows / TILE_SETS, rows * F.col("m") / TILE_TOKENS)).cast("int")
    parts = sizes.select("g", "rows", parts(F.col("others")).alias("first"), parts(F.col("rows") - F.col("others")).alias("last"))
    at = F.xxhash64("rep")
    place = F.when(F.col("core"), F.col("first") + F.pmod(at, F.greatest("last", F.lit(1)))).otherwise(F.pmod(at, F.greatest("first", F.lit(1)))).cast("int")
    own = spread_join(level.select("g", "rep", "s", "core", "d"), written(parts, "tile-counts"), ["g"], "rows", "rep").withColumn("tile", place)
    tiles = own.groupBy("g", "tile").agg(F.first("first").alias("first"), F.first("last").alias("last"), F.collect_list(F.struct("rep", "s", "core", "d")).alias("sets"))  # bounded by how rows are dealt
    tiles = written(tiles, "tiles")
    left = tiles.where("tile < first").select("g", F.col("tile").alias("i"), F.explode(F.sequence("tile", F.greatest(F.col("tile"), F.col("first") + F.col("last") - 1))).alias("j"), F.col("sets").alias("x"))
    right = tiles.select("g", F.explode(F.sequence(F.lit(0), F.least(F.col("tile"), F.col("first") - 1))).alias("i"), F.col("tile").alias("j"), F.col("sets").alias("y"))
    pairs = left.join(right.hint("shuffle_merge"), ["g", "i", "j"]).select((F.col("i") == F.col("j")).alias("same"), "x", "y")
    found = written(mapped(pairs, _tile_pairs(percent), "a long, b long, verified long"), "tiled")
    discard(tiles)
    return found


def _chosen(level: DataFrame, all_of_them: bool) -> DataFrame:
    """g, rows, others, m and near of each family: near where looking at all pairs costs no more than its tokens as rows."""
    sizes = level.groupBy("g").agg(F.count("*").alias("rows"), F.sum(F.when(F.col("core"), 0).otherwise(1)).alias("others"), F.avg(F.size("d")).alias("m"))
    return written(sizes.withColumn("near", F.lit(True) if all_of_them else F.col("others") <= PAIRS_A_ROW * F.col("m")), "families")


def _costly(met: DataFrame, sizes: DataFrame) -> DataFrame:
    """sizes (see _chosen), near where the pairs and families that meetings would make cost more than looking at all pairs."""
    kinds = met.groupBy("g", "hub", "size", "last").agg(F.count("*").alias("rows"))  # rows: size times the tokens of a kind
    pairs = F.when(F.col("size") <= GROUP, F.col("rows") * (F.col("size") - 1) / 2).otherwise(0)
    apart = F.when(F.col("size") > GROUP, F.col("size")).otherwise(0)
    costs = kinds.groupBy("g").agg(F.sum(pairs).alias("pairs"), F.sum(apart).alias("apart"), F.sum("rows").alias("met"))
    cost = F.col("pairs") * (1 + VERIFY_COST * F.col("m")) + 5 * F.col("apart") * F.col("m")
    near = F.col("others") * F.col("rows") <= PAIRS_A_ROW * cost
    return written(costs.join(sizes.drop("near"), "g").select("g", "rows", "others", "m", "met", near.alias("near")), "costs")


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of sets (rep, n, tokens): round by round, small meetings as pairs and large ones as families."""
    level = sets.select(
        F.lit(0).cast("long").alias("g"), "rep", "n", F.col("tokens").alias("d"), (F.col("n") * 2 * percent).cast("long").alias("s"), F.lit(False).alias("core"),
        F.ceil(F.col("n") * percent / 100).cast("long").alias("need"), "sketch",  # a partner has percent of a hundred of n tokens at least
    )
    found = []
    for turn in range(ROUNDS + 1):
        rest = level
        if turn:
            sizes = _chosen(level, turn == ROUNDS)
            dealt = written(spread_join(level, sizes.drop("others", "m"), ["g"], "rows", "rep"), "dealt")
            found.append(_tiled(dealt.where("near"), sizes.where("near"), percent).where("a is not null").select("a", "b"))
            rest = dealt.where("not near").drop("near")
            if not rest.limit(1).count():
                discard(level, dealt)
                break
        prefix = _prefixes(rest, percent)
        met = _meetings(prefix)
        if turn:
            costs = _costly(met, sizes)
            near = costs.where("near")
            if near.limit(1).count():
                whole = spread_join(rest, costs.select("g", "near", "rows"), ["g"], "rows", "rep", "left").where("near").drop("near")
                found.append(_tiled(whole, near, percent).where("a is not null").select("a", "b"))
                met = spread_join(met, costs.select("g", "near", F.col("met").alias("rows")), ["g"], "rows", "rep").where("not near").drop("near")
        pairs = _candidates(met.where(f"size <= {GROUP}"), prefix, percent, None if turn or percent < 50 else level)  # sketches of sets that link are of one size or of two neighbouring ones from 50 on
        found.append(written(_verified(pairs, rest, percent), "links"))
        large = met.where(f"size > {GROUP}")
        if not large.limit(1).count():
            discard(prefix, *([level, dealt] if turn else []))
            break
        star, new = _families(large, rest, percent, turn == 0)
        found.append(written(star, "links"))
        discard(prefix, *([level, dealt] if turn else []))
        level = new
    links = found[0]
    for x in found[1:]:
        links = links.union(x)
    return links


def near_duplicate_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    docs: doc_id, text; further columns are ignored. Words are runs of anything but ASCII white space, A-Z lower-cased;
    a set has the distinct n-word shingles, or the whole sequence where there are fewer words. A null or empty text and
    one without words has the empty set, which links with nothing. Texts are taken whole, however long. Repeated rows of
    a doc_id are repeated in the result; where their texts differ, each has its own n_shingles, and all of them that have
    words are one document and so of one component. Rows without doc_id are left out. Ties don't matter: a link is
    there or not. An empty table gives an empty result.
    """
    docs = docs.where("doc_id is not null")
    sets, classes, links = link_classes(docs, n, percent)
    found = connected_components(links).withColumnRenamed("node", "c1").withColumnRenamed("component", "name")
    named = written(classes.join(found, "c1", "left").withColumn("name", F.coalesce("name", "c1")).select("c1", "c2", "rows", "least", "name"), "named")
    first = named.groupBy("name").agg(F.min("least").alias("component"), F.count("*").alias("rows"))
    first = written(first, "components")
    named = written(spread_join(named.withColumnRenamed("rows", "copies"), first, ["name"], "rows", "c1").select("c1", "c2", "component", F.col("copies").alias("rows")), "classes")
    own = F.coalesce("component", "doc_id").alias("component_id")
    return spread_join(sets, named, ["c1", "c2"], "rows", "doc_id", "left").select("doc_id", "n_shingles", own)


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose document is the smallest doc_id of its component; rows without doc_id stay."""
    keep = near_duplicate_groups(docs, n, percent).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(small(written(keep, "drop")), "doc_id", "left_anti")
