"""Probes of where directions are placed and how far codes may be reduced: addresses on a sphere's spiral, router
directions by several rules, and the neighbourhoods of rank codes."""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankmill.functions import kernels
from rankmill.functions.kernels import Scorer
from rankmill.operators import research, search
from rankmill.operators.mutate import with_row_ids
from rankmill.spec import ParameterError
from rankmill.storage import written


def spiral(count: int) -> np.ndarray:
    """count points on the unit sphere: heights in equal steps, each turned on from the last one by the golden angle."""
    i = np.arange(count)
    z = np.zeros(1) if count == 1 else 1 - (2 * i + 1) / count
    r, turn = np.sqrt(1 - z * z), i * math.pi * (3 - math.sqrt(5))
    return np.stack([r * np.cos(turn), r * np.sin(turn), z], 1)


def addresses(x: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Of each full triple of coordinates, the number of the grid point in the nearest direction; ties: the first."""
    t = x.shape[1] // 3
    return (x[:, : 3 * t].reshape(len(x), t, 3).astype(np.float64) @ grid.T).argmax(2)


def _with_vectors(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    side = lambda i, v: vectors.select(F.col("row_id").alias(i), F.col("embedding").cast("array<float>").alias(v))
    return pairs.select("a", "b").join(side("a", "pl_x"), "a").join(side("b", "pl_y"), "b").select("a", "b", "pl_x", "pl_y")


def address_locality(vectors: DataFrame, pairs: DataFrame, grids: dict[str, np.ndarray]) -> DataFrame:
    """(method, rho): the rank correlation, over pairs (a, b) of row ids, of a distance with the cosine distance.

    Methods: an address for each grid, by the sum of the differences of its numbers, and sign, by differing sign bits.
    Equal distances are ranked by a and b. Ranks are numbered by ranges, so no task holds all pairs.
    """
    names = [*grids, "sign"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (kernels.block(batch.column(i)) for i in (2, 3))
            far = [np.abs(addresses(x, g) - addresses(y, g)).sum(1) if len(x) else np.empty(0) for g in grids.values()]
            far += [((x > 0) != (y > 0)).sum(1) if len(x) else np.empty(0)]
            cosine = 1 - (kernels.unit(x.astype(np.float64)) * kernels.unit(y.astype(np.float64))).sum(1) if len(x) else np.empty(0)
            columns = [pa.array(np.asarray(f, dtype=np.float64)) for f in (*far, cosine)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["a", "b", *(f"d{i}" for i in range(len(columns)))])

    last = len(names)
    kinds = ", ".join(f"d{i} double" for i in range(last + 1))
    d = _with_vectors(pairs, vectors).mapInArrow(run, f"a long, b long, {kinds}")

    def ranked(frame, column):
        keyed = frame.withColumn("pl_key", F.struct(column, "a", "b"))
        return with_row_ids(keyed, "pl_key").withColumnRenamed("row_id", f"r_{column}").drop("pl_key")

    for i in range(last + 1):
        d = ranked(d, f"d{i}")
    rho = d.agg(*(F.corr(F.col(f"r_d{i}").cast("double"), F.col(f"r_d{last}").cast("double")).alias(f"c{i}") for i in range(last)))
    return rho.select(F.explode(F.array(*(F.struct(F.lit(n).alias("method"), F.col(f"c{i}").alias("rho")) for i, n in enumerate(names)))).alias("m")).select("m.*")


def mean_direction(vectors: DataFrame) -> DataFrame:
    """(pos, axis, resultant): the direction of the mean of unit rows, and that mean's length, the same in all rows; rows of
    length 0 count as they are. 0: directions cancel out; near 1: one direction is shared."""
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = F.transform("embedding", lambda x: F.coalesce(F.try_divide(x.cast("double"), F.col("pl_size")), F.lit(0.0)))
    mean = research.coordinate_means(vectors.select("embedding", size.alias("pl_size")).select(unit.alias("embedding")))
    length = mean.agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("resultant"))
    return mean.join(F.broadcast(length)).select("pos", F.coalesce(F.try_divide("mean", "resultant"), F.lit(0.0)).alias("axis"), "resultant")  # length: one row


def spiral_directions(dim: int, count: int, seed: int | None = None, away: np.ndarray | None = None) -> np.ndarray:
    """count unit directions: the same spiral point in every triple of coordinates, turned by a rotation of its own (seed;
    None: not turned). away: a unit axis whose part is taken out of each."""
    triples = -(-dim // 3)
    p, rng = spiral(count), np.random.default_rng(seed)
    parts = [p if seed is None else p @ np.linalg.qr(rng.normal(size=(3, 3)))[0] for _ in range(triples)]
    d = np.concatenate(parts, 1)[:, :dim]
    if away is not None:
        d = d - np.outer(d @ away, away)
    return kernels.unit(d)


def primes(count: int) -> list[int]:
    """The first count primes: bases of the radical inverses and numbers under the roots, an axis each."""
    found: list[int] = []
    n = 2
    while len(found) < count:
        if all(n % p for p in itertools.takewhile(lambda p: p * p <= n, found)):
            found.append(n)
        n += 1
    return found


def _radical_inverse(i: int, base: int) -> float:
    digits, scale = 0.0, 1.0
    while i:
        i, d = divmod(i, base)
        scale /= base
        digits += d * scale
    return digits


def subspace_directions(kind: str, count: int, k: int, seed: int = 0) -> np.ndarray:
    """count unit directions in k dimensions. random: normal; net: radical inverses, additive: multiples of square roots
    modulo 1, both made normal by the inverse distribution; axes: the k axes, and random ones beyond them."""
    if count <= 0 or k <= 0:
        raise ParameterError("count and k must be positive")
    if kind in ("random", "axes"):
        d = np.random.default_rng(seed).normal(size=(count, k))
        if kind == "axes":
            d[: min(count, k)] = np.eye(k)[: min(count, k)]
        return kernels.unit(d)
    base = primes(k)
    if kind == "net":
        place = lambda i, a: _radical_inverse(i, base[a])
    elif kind == "additive":
        place = lambda i, a: math.sqrt(base[a]) * i % 1.0
    else:
        raise ParameterError("directions are random, net, additive or axes")
    normal = NormalDist()
    return kernels.unit(np.array([[normal.inv_cdf(min(max(place(i, a), 1e-6), 1 - 1e-6)) for a in range(k)] for i in range(1, count + 1)]))


def half_space_discrepancy(normals: DataFrame, arms: dict[str, np.ndarray], vector: str = "embedding") -> DataFrame:
    """(arm, discrepancy): by how much the share of an arm's directions in one of the half-spaces is off one half, at worst.

    normals: a row a half-space, through the origin; as many coordinates as the directions have. Each task hands on the worst
    of its rows, a number an arm.
    """

    def run(batches):
        import pyarrow as pa

        worst = None
        for batch in batches:
            x = kernels.block(batch.column(0)).astype(np.float64)
            if len(x):
                own = [float(np.abs(((axes @ x.T) > 0).mean(0) - 0.5).max()) for axes in arms.values()]
                worst = own if worst is None else [max(p) for p in zip(worst, own, strict=True)]
        if worst:
            yield pa.RecordBatch.from_arrays([pa.array(list(arms)), pa.array(worst)], names=["arm", "discrepancy"])

    found = normals.select(F.col(vector).cast("array<float>")).mapInArrow(run, "arm string, discrepancy double")
    return found.groupBy("arm").agg(F.max("discrepancy").alias("discrepancy"))


def router_recall(vectors: DataFrame, queries: DataFrame, truth: DataFrame, arms: dict[str, np.ndarray], radii: list[int], buckets: int = 16, calibrated: bool = False) -> DataFrame:
    """(arm, radius, scanned, recall): for each set of directions, the rows a query's buckets hold on average, and the share
    of its true rows among them. Rows are counted in united bitmaps, a block of ids at a time, and true rows alone are looked
    up, by the least difference of their buckets on any axis.

    calibrated: buckets between quantiles; else of equal width, so rows need not be centred.
    """
    asked_, true = queries.select("query_id").distinct().count(), truth.select(F.col("query_id").cast("long").alias("query_id"), "row_id").distinct()
    n, out = true.count(), None
    for arm, axes in arms.items():
        placed, own = research.buckets_of(vectors, queries, axes, buckets, calibrated)
        posted, own = written(research.postings(placed), "postings"), written(own, "asked")
        counts = research.united_counts(posted, own, len(axes), buckets, sorted(set(radii)))
        found = placed.join(true, "row_id").select("query_id", "row_id", "axis", "bucket").join(own.withColumnRenamed("bucket", "pl_own"), ["query_id", "axis"])
        far = found.groupBy("query_id", "row_id").agg(F.min(F.abs(F.col("bucket") - F.col("pl_own"))).alias("far"))
        held = far.agg(*(F.count(F.when(F.col("far") <= r, 1)).alias(f"h{r}") for r in sorted(set(radii))))
        hits = held.select(F.explode(F.array(*(F.struct(F.lit(r).alias("radius"), F.col(f"h{r}").alias("hits")) for r in radii))).alias("h")).select("h.*")  # a row a radius
        part = hits.join(F.broadcast(counts), "radius", "left").select(F.lit(arm).alias("arm"), "radius", (F.coalesce("rows", F.lit(0)) / max(asked_, 1)).alias("scanned"), (F.col("hits") / max(n, 1)).alias("recall"))
        out = part if out is None else out.union(part)
    return out


def envelope(recalls: DataFrame, budget: float) -> DataFrame:
    """(arm, best): the highest recall of each arm that scans no more rows than the budget; 0 where none does."""
    return recalls.groupBy("arm").agg(F.coalesce(F.max(F.when(F.col("scanned") <= budget, F.col("recall"))), F.lit(0.0)).alias("best"))


def _middle(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """by and middle: the upper median, from a histogram of whole numbers."""
    hist = values.groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    upto = F.sum("n").over(w.orderBy(value))
    held = hist.select(*by, value, upto.alias("upto"), F.sum("n").over(w).alias("all")).where(F.col("upto") > F.floor(F.col("all") / 2))
    return held.groupBy(*by).agg(F.min(value).alias("middle"))


def rank_locality(vectors: DataFrame, queries: DataFrame, truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """(near, random, ratio): the mean over queries of the median footrule to their true rows, the median footrule of the
    pairs (a, b), and how the first compares with the second."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (kernels.ranks(kernels.block(batch.column(i))) for i in (2, 3))
            far = np.abs(x.astype(np.int64) - y).sum(1) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far, pa.int64())], names=["a", "b", "far"])

    asked_ = queries.select(F.col("query_id").alias("a"), F.col("embedding").cast("array<float>").alias("pl_x"))
    rows = vectors.select(F.col("row_id").alias("b"), F.col("embedding").cast("array<float>").alias("pl_y"))
    close = truth.select(F.col("query_id").alias("a"), F.col("row_id").alias("b")).join(asked_, "a").join(rows, "b").select("a", "b", "pl_x", "pl_y")
    close = _middle(close.mapInArrow(run, "a long, b long, far long"), ["a"], "far").agg(F.avg("middle").alias("near"))
    apart = _middle(_with_vectors(pairs, vectors).mapInArrow(run, "a long, b long, far long").withColumn("pl_all", F.lit(1)), ["pl_all"], "far").select(F.col("middle").cast("double").alias("random"))
    return close.join(F.broadcast(apart)).select("near", "random", F.try_divide("near", "random").alias("ratio"))  # one row each


def fan_out(vectors: DataFrame, queries: DataFrame, radii: list[float]) -> DataFrame:
    """(radius, rows, growth): rows within a footrule of the queries, all queries together, and the geometric mean of the
    growth from one radius to the next, the same in all rows. Each pair is scored in its task and only counted."""
    r = sorted(radii)
    counts = search.score_all(vectors, queries, kernels.footrule()).agg(*(F.coalesce(F.sum((F.col("score") <= x).cast("long")), F.lit(0)).alias(f"n{i}") for i, x in enumerate(r)))
    steps = [F.when(F.col(f"n{i}") > 0, F.ln(F.col(f"n{i + 1}") / F.col(f"n{i}"))) for i in range(len(r) - 1)]
    known = sum((s.isNotNull().cast("int") for s in steps), F.lit(0))
    growth = F.exp(F.try_divide(sum((F.coalesce(s, F.lit(0.0)) for s in steps), F.lit(0.0)), known))
    each = F.array(*(F.struct(F.lit(float(x)).alias("radius"), F.col(f"n{i}").alias("rows")) for i, x in enumerate(r)))
    return counts.select(F.explode(each).alias("e"), growth.alias("growth")).select("e.*", "growth")


def _bins(bins: int) -> Scorer:
    c = lambda x: (kernels.ranks(x).astype(np.int64) * bins // x.shape[1]).astype(np.int32)
    return Scorer(c, c, lambda d, q: np.stack([np.abs(d - r).sum(1) for r in q], 1).astype(np.float64), largest=False)


def coarsening(vectors: DataFrame, queries: DataFrame, truth: DataFrame, bins: list[int], m: int) -> DataFrame:
    """(bins, bits, recall): ranks cut into so many bins, and the share of true rows among the m nearest by L1."""
    true, out = truth.select("query_id", "row_id").distinct(), None
    n = true.count()
    for b in bins:
        hit = true.join(search.search(vectors, queries, _bins(b), m).select("query_id", "row_id"), ["query_id", "row_id"])
        row = hit.agg((F.count("*") / max(n, 1)).alias("recall")).select(F.lit(b).alias("bins"), F.lit(math.log2(b)).alias("bits"), "recall")
        out = row if out is None else out.union(row)
    return out


def distinct_codes(ranks: DataFrame, dim: int, bins: list[int], column: str = "ranks") -> DataFrame:
    """(bins, codes): how many different codes rows have once ranks are cut into so many bins; codes are compared by digest."""
    digest = lambda b: F.md5(F.array_join(F.transform(column, lambda r: F.floor(r * b / dim).cast("string")), ","))
    each = ranks.select(F.explode(F.array(*(F.struct(F.lit(b).alias("bins"), digest(b).alias("code")) for b in bins))).alias("e")).select("e.*")
    return each.distinct().groupBy("bins").agg(F.count("*").alias("codes"))
