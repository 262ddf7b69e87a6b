"""Probes of what codes do to a corpus: how close codes lie, how even buckets are, what routing and centring are worth."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankmill.functions import encode, kernels
from rankmill.functions.kernels import Scorer
from rankmill.operators import research, search
from rankmill.operators.mutate import with_row_ids
from rankmill.spec import ParameterError


def code_hamming(bits: int) -> Scorer:
    """Coordinates whose buckets differ."""
    nb = 1 << bits
    hot = lambda x: (kernels.codes(x, bits)[:, :, None] == np.arange(nb)).reshape(len(x), -1).astype(np.float32)
    return Scorer(hot, hot, lambda d, q: (d.shape[1] / nb - d @ q.T).astype(np.float64), largest=False)


def near_collisions(vectors: DataFrame, probes: DataFrame, bits: int) -> DataFrame:
    """(query_id, nearest, near): how many coordinates differ from the closest other code, and how many rows lie within one
    and a half times that (one more at least).

    Every row is scored once for all probes; what is kept is a histogram a probe, counted in the tasks, not the pairs.
    """
    hist = search.histogram(vectors, probes, code_hamming(bits), own=False).select("query_id", F.col("score").cast("long").alias("h"), "n").where("n > 0")
    low = hist.groupBy("query_id").agg(F.min("h").alias("nearest"))
    reach = F.greatest(F.col("nearest") + F.floor(F.col("nearest") / 2), F.col("nearest") + 1)
    return hist.join(low, "query_id").where(F.col("h") <= reach).groupBy("query_id").agg(F.first("nearest").alias("nearest"), F.sum("n").alias("near"))


def lookalike_order(vectors: DataFrame, probes: DataFrame, bits: int, m: int = 40, top: int = 16) -> DataFrame:
    """(query_id, near_tau, far_tau, near_cosine, far_cosine): of the m rows of closest code, the half that is nearer by
    cosine and the other half, each with its mean share of coordinate pairs in another order.

    Coordinates are the top largest of either of the two vectors.
    """
    close = search.candidates(vectors, probes, code_hamming(bits), m + 1)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            q, d = (kernels.block(batch.column(i)).astype(np.float64) for i in (2, 3))
            tau = []
            for a, b in zip(q, d, strict=True):
                at = np.union1d(np.argsort(-a, kind="stable")[:top], np.argsort(-b, kind="stable")[:top])
                i, j = np.triu_indices(len(at), 1)
                tau.append(float((np.sign(a[at[i]] - a[at[j]]) != np.sign(b[at[i]] - b[at[j]])).mean()) if len(i) else 0.0)
            cosine = (kernels.unit(q) * kernels.unit(d)).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tau), pa.array(cosine)], names=["query_id", "row_id", "tau", "cosine"])

    rows = vectors.select("row_id", F.col("embedding").cast("array<float>").alias("d"))
    asked = probes.select("query_id", F.col("embedding").cast("array<float>").alias("q"))
    pairs = close.where("query_id <> row_id").join(rows, "row_id").join(asked, "query_id").select("query_id", "row_id", "q", "d")
    pairs = pairs.mapInArrow(run, "query_id long, row_id long, tau double, cosine double")
    w = Window.partitionBy("query_id")
    pairs = pairs.withColumn("at", F.row_number().over(w.orderBy(F.desc("cosine"), "row_id"))).withColumn("half", F.floor(F.count("*").over(w) / 2))
    near = F.col("at") <= F.col("half")
    part = lambda c, held: F.coalesce(F.avg(F.when(held, F.col(c))), F.lit(0.0))
    return pairs.groupBy("query_id").agg(part("tau", near).alias("near_tau"), part("tau", ~near).alias("far_tau"), part("cosine", near).alias("near_cosine"), part("cosine", ~near).alias("far_cosine"))


def cuts(scheme: str, bits: int, dim: int, seed: int = 1) -> list[float]:
    """Boundaries between buckets of ranks: of equal width, by the golden ratio, or random."""
    nb = 1 << bits
    if scheme == "equal":
        return [k * dim / nb for k in range(1, nb)]
    if scheme == "golden":
        phi = (1 + math.sqrt(5)) / 2
        return sorted((i * phi) % 1.0 * dim for i in range(1, nb))
    if scheme == "random":
        return sorted((np.random.default_rng(seed).random(nb - 1) * dim).tolist())
    raise ParameterError("cuts are equal, golden or random")


def uniformity(vectors: DataFrame, dim: int, bits: int, bounds: list[float], vector: str = "embedding") -> DataFrame:
    """One row: comp_std, the deviation over rows of how many coordinates a bucket has, averaged over buckets; entropy of
    the buckets in bits; null_err, by how much the overlap of two rows' highest buckets is off the uniform expectation.

    The overlap is that of all pairs of different rows, from the counts of places; no pair is made.
    """
    nb = 1 << bits
    of = lambda r: sum((F.when(r + 0.5 > c, 1).otherwise(0) for c in bounds), F.lit(0))
    coded = vectors.select("row_id", F.transform(encode.rank_transform(F.col(vector)), of).alias("c"))
    held = lambda b: F.size(F.filter("c", lambda x: x == b)).cast("double")
    counts = coded.select("row_id", *(held(b).alias(f"n{b}") for b in range(nb)))
    stats = counts.agg(F.count("*").cast("double").alias("rows"), *(F.stddev_pop(f"n{b}").alias(f"s{b}") for b in range(nb)), *(F.avg(f"n{b}").alias(f"m{b}") for b in range(nb)))
    places = coded.select(F.posexplode("c").alias("pos", "b")).where(F.col("b") == nb - 1).groupBy("pos").agg(F.count("*").cast("double").alias("n"))
    stats = stats.join(F.broadcast(places.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0.0)).alias("shared"))))  # one row
    p = [F.col(f"m{b}") / dim for b in range(nb)]
    entropy = sum((F.when(x > 0, -x * F.log2(x)).otherwise(0.0) for x in p), F.lit(0.0))
    expected = F.col(f"m{nb - 1}") * F.col(f"m{nb - 1}") / dim
    observed = F.try_divide(F.col("shared"), F.col("rows") * (F.col("rows") - 1))
    return stats.select((sum((F.col(f"s{b}") for b in range(nb)), F.lit(0.0)) / nb).alias("comp_std"), entropy.alias("entropy"), F.try_divide(F.abs(observed - expected), expected).alias("null_err"))


def number_variance(keys: DataFrame, length: float, windows: int = 4000, key: str = "key") -> DataFrame:
    """(sigma2): the variance of how many keys a window of a length holds, over windows placed evenly from 0 to rows - length.

    Keys are unfolded to a mean spacing of 1 beforehand. Each key falls into a run of windows, which is counted by where it
    begins and ends: windows + 1 numbers are summed up, however many keys there are.
    """
    n = keys.count()
    if n <= length:
        raise ParameterError("a window must be shorter than there are keys")
    step = (n - length) / windows
    # Window w holds x if w * step <= x < w * step + length.
    first = F.greatest(F.lit(0), F.floor((F.col(key) - length) / step) + 1)
    last = F.least(F.lit(windows - 1), F.floor(F.col(key) / step))
    inside = keys.select(first.cast("long").alias("first"), last.cast("long").alias("last")).where("first <= last and first < %d and last >= 0" % windows)
    edges = inside.select(F.explode(F.array(F.struct(F.col("first").alias("w"), F.lit(1).alias("d")), F.struct((F.col("last") + 1).alias("w"), F.lit(-1).alias("d")))).alias("e")).select("e.*")
    edges = edges.groupBy("w").agg(F.sum("d").alias("d"))
    all_ = keys.sparkSession.range(windows).select(F.col("id").alias("w")).join(edges, "w", "left").select("w", F.coalesce("d", F.lit(0)).alias("d"))
    counts = all_.withColumn("n", F.sum("d").over(Window.orderBy("w")))  # a row a window
    return counts.agg(F.var_pop("n").alias("sigma2"))


def gaussian_keys(vectors: DataFrame, axis: np.ndarray, vector: str = "embedding") -> DataFrame:
    """(row_id, key): projections on a unit axis, unfolded by the normal distribution of an isotropic corpus."""
    n, sigma = vectors.count(), math.sqrt(1 / len(axis))

    def run(batches):
        import pyarrow as pa

        cdf = np.vectorize(lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2))))
        for batch in batches:
            x = kernels.block(batch.column(1), len(axis)).astype(np.float64) @ axis / sigma
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cdf(x) * n if len(x) else np.empty(0))], names=["row_id", "key"])

    return vectors.select("row_id", F.col(vector).cast("array<float>")).mapInArrow(run, "row_id long, key double")


def seams(spark, periods: list[int], phases: list[int], within: int = 0, at: DataFrame | None = None) -> DataFrame:
    """One row on the ring of all positions (or those of at, column id) of some grids: positions, those within some steps of a seam of every grid, and
    the least distance to a grid's seam that some grid keeps everywhere (floor)."""
    size = math.prod(periods)
    distance = []
    for p, phase in zip(periods, phases, strict=True):
        r = F.pmod(F.col("id") - phase, F.lit(p))
        distance.append(F.least(r, p - r))
    x = (spark.range(size) if at is None else at).select((F.greatest(*distance) if len(periods) > 1 else distance[0]).alias("far"))
    return x.agg(F.count("*").alias("positions"), F.sum((F.col("far") <= within).cast("long")).alias("joint"), F.min("far").alias("floor"))


def cell_balance(vectors: DataFrame, queries: DataFrame, truth: DataFrame, axes: np.ndarray, probes: list[int], mean: np.ndarray | None = None) -> DataFrame:
    """(probes, scanned, recall): rows in that many cells nearest to a query's, and the share of its true rows among them.

    truth: (query_id, row_id). Only the true rows are joined to the cells; the others are counted.
    """
    most = max(probes)
    rows = research.cell_keys(vectors, axes, mean=mean)
    near = research.nearest_cells(research.cell_keys(queries, axes, "query_id", mean=mean).withColumnRenamed("row_id", "query_id"), len(axes), most)
    size = rows.groupBy(F.col("cell").alias("near")).agg(F.count("*").alias("n"))
    seen = near.join(size, "near", "left").select("query_id", "probe", F.coalesce("n", F.lit(0)).alias("n"))
    home = truth.select("query_id", "row_id").join(rows.withColumnRenamed("cell", "near"), "row_id").join(near, ["query_id", "near"], "left").select("query_id", "probe")
    queries_ = truth.agg(F.count_distinct("query_id").alias("q"), F.count("*").alias("t"))
    out = None
    for p in sorted(probes):
        scanned = seen.where(F.col("probe") <= p).agg(F.sum("n").alias("scanned"))
        hit = home.agg(F.sum(F.when(F.col("probe") <= p, 1).otherwise(0)).alias("hit"))
        row = queries_.join(F.broadcast(scanned)).join(F.broadcast(hit)).select(F.lit(p).alias("probes"), (F.col("scanned") / F.col("q")).alias("scanned"), (F.col("hit") / F.col("t")).alias("recall"))  # one row each
        out = row if out is None else out.union(row)
    return out


def centring_recall(vectors: DataFrame, queries: DataFrame, bits: int, k: int, m: int) -> DataFrame:
    """(centred, recall, candidate_recall): what codes of vectors as they are, and less the corpus mean, find by their L1
    distance: the share of the k nearest by inner product among the first k, and among the first m."""
    truth = search.search(vectors, queries, kernels.inner_product(), k).select("query_id", "row_id")
    n = truth.count()
    out = None
    means = [r.mean for r in research.coordinate_means(vectors).orderBy("pos").collect()]  # dim numbers
    less = lambda d: d.withColumn("embedding", F.zip_with("embedding", F.array(*(F.lit(x) for x in means)), lambda x, y: (x.cast("double") - y).cast("float")))
    for centred in (False, True):
        v, q = (less(vectors), less(queries)) if centred else (vectors, queries)
        found = search.search(v, q, kernels.code_l1(bits), m)
        hit = truth.join(found.select("query_id", "row_id", "rank"), ["query_id", "row_id"])
        row = hit.agg((F.coalesce(F.sum((F.col("rank") <= k).cast("int")), F.lit(0)) / n).alias("recall"), (F.count("*") / n).alias("candidate_recall")).select(F.lit(centred).alias("centred"), "recall", "candidate_recall")
        out = row if out is None else out.union(row)
    return out


def frequency_profile(codes: DataFrame, buckets: int, column: str = "codes") -> DataFrame:
    """(pos, bucket, frequency): how often a coordinate is in a bucket; buckets it never is in are there with 0."""
    n = codes.agg(F.count("*").alias("rows"))
    seen = codes.select(F.posexplode(column).alias("pos", "bucket")).groupBy("pos", "bucket").agg(F.count("*").alias("n"))
    grid = seen.select("pos").distinct().select("pos", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    return grid.join(seen, ["pos", "bucket"], "left").join(F.broadcast(n)).select("pos", "bucket", (F.coalesce("n", F.lit(0)) / F.col("rows")).alias("frequency"))  # n: one row


def mixed_corpus(parts: list[tuple[DataFrame, int]], seed: int = 0) -> DataFrame:
    """(row_id, part, embedding): so many rows of each part, those of smallest hash, in a hashed order.

    A part's rows are numbered by ranges of their hashes, so no task holds a whole part.
    """
    out = None
    for i, (part, rows) in enumerate(parts):
        own = part.select(F.lit(i).alias("part"), F.xxhash64(F.lit(seed), F.lit(i), "row_id").alias("mix_at"), "embedding")
        own = with_row_ids(own, "mix_at").where(F.col("row_id") < rows).drop("row_id")
        out = own if out is None else out.union(own)
    return with_row_ids(out, "mix_at").select("row_id", "part", "embedding")


def length_mixture(parts: list[DataFrame], dim: int, drop_bad: bool = True) -> DataFrame:
    """(row_id, part, source, embedding): all rows of parts (row_id, embedding), such as one corpus cut at several lengths,
    behind each other; source is a row's id in its part.

    drop_bad: without rows that have a coordinate that is null or not a number, or that are zero throughout. A row of
    another dimension fails the job.
    """
    out = None
    for i, part in enumerate(parts):
        own = part.select(F.lit(i).alias("part"), F.col("row_id").cast("long").alias("source"), F.col("embedding").cast("array<float>").alias("embedding"))
        out = own if out is None else out.union(own)
    known = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a row doesn't have {dim} coordinates")).cast("array<float>"))
    out = out.withColumn("embedding", known)
    if drop_bad:
        out = out.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0))
    return with_row_ids(out.withColumn("lm_key", F.struct("part", "source")), "lm_key").select("row_id", "part", "source", "embedding")
