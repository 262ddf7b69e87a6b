"""Analyses of a corpus of vectors: centring, routing, neighbours' dimension, evenness."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.functions import kernels
from rankmill.operators.cells import nearest_cells, with_cells
from rankmill.operators.mutate import with_row_ids
from rankmill.operators.search import QUERY_BLOCK, QUERY_BLOCKS, search, top_k
from rankmill.storage import written


#: Ids in a block of a bitmap, and one part in how many a sketch of quantiles may be off.
BITMAP_IDS, QUANTILE_ACCURACY = 32_768, 100_000
#: Queries whose unions of a block are made at once, some megabytes.
UNITED = 128
#: Tasks that sum up the moments of all others.
MOMENT_TASKS = 32


def coordinate_means(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(pos, mean) over all rows."""
    return vectors.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def centre(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vectors less the mean of each coordinate. The means are one row of dim numbers."""
    m = coordinate_means(vectors, vector).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("rs_mean"))
    sub = F.zip_with(vector, "rs_mean", lambda x, y: (x.cast("double") - y).cast("float"))
    return vectors.join(F.broadcast(m)).withColumn(vector, sub).drop("rs_mean")


def directions(dim: int, count: int, seed: int = 0) -> np.ndarray:
    return kernels.unit(np.random.default_rng(seed).normal(size=(count, dim)))


def _projected(axes):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            p = kernels.block(batch.column(1), axes.shape[1]).astype(np.float64) @ axes.T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["row_id", "p"])

    return run


def buckets_of(vectors: DataFrame, queries: DataFrame, axes: np.ndarray, buckets: int = 16, calibrated: bool = False, row_id: str = "row_id", query_id: str = "query_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """((row_id, axis, bucket), (query_id, axis, bucket)): in which bucket rows and queries lie on each axis.

    Buckets are of equal width between the least and the largest projection of the corpus; calibrated: between its
    quantiles, from a sketch of each axis, so that all hold about as many rows.
    """
    side = lambda t, i: t.select(F.col(i).cast("long").alias("row_id"), F.col(vector).cast("array<float>")).mapInArrow(_projected(axes), "row_id long, p array<double>")
    rows, asked = (side(t, i).select("row_id", F.posexplode("p").alias("axis", "x")) for t, i in ((vectors, row_id), (queries, query_id)))
    if calibrated:
        cuts = F.percentile_approx("x", [i / buckets for i in range(1, buckets)], QUANTILE_ACCURACY)
        ends, bucket = rows.groupBy("axis").agg(cuts.alias("cuts")), F.size(F.filter("cuts", lambda c: c < F.col("x")))
    else:
        ends = rows.groupBy("axis").agg(F.min("x").alias("low"), F.max("x").alias("high"))
        bucket = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor((F.col("x") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * buckets))).cast("int")
    placed = lambda t: t.join(F.broadcast(ends), "axis").select("row_id", "axis", bucket.alias("bucket"))  # noqa: E731  (ends: a row an axis)
    return placed(rows), placed(asked).withColumnRenamed("row_id", "query_id")


def near_buckets(asked: DataFrame, radius: int) -> DataFrame:
    """asked (query_id, axis, bucket) with every bucket within radius in place of its own."""
    return asked.select("query_id", "axis", F.explode(F.sequence(F.col("bucket") - radius, F.col("bucket") + radius)).alias("bucket"))


def postings(placed: DataFrame) -> DataFrame:
    """(axis, bucket, block, rows): the row ids of each bucket as bitmaps, a block of 32,768 ids each.

    A bucket's ids lie in as many rows as it has blocks, so no task holds a whole bucket.
    """
    return placed.groupBy("axis", "bucket", F.bitmap_bucket_number("row_id").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row_id")).alias("rows"))


def united(posted: DataFrame, near: DataFrame) -> DataFrame:
    """(query_id, block, rows): bitmaps of the rows that any of a query's buckets holds, without a row of their own for each."""
    return near.join(posted, ["axis", "bucket"]).groupBy("query_id", "block").agg(F.bitmap_or_agg("rows").alias("rows"))


def united_counts(posted: DataFrame, asked: DataFrame, axes: int, buckets: int, radii: list[int]) -> DataFrame:
    """(radius, rows): how many rows united() has over all queries, for each radius. asked: (query_id, axis, bucket).

    All bitmaps of a block of ids are one row, and so are up to QUERY_BLOCK queries; a task unites one block for one lot of
    queries at a time and keeps a number a radius, so no union is ever a row.
    """

    def lots(batches):
        import pyarrow as pa

        held = []
        made = lambda part: pa.RecordBatch.from_arrays([pa.array([np.concatenate(part).astype(np.int32).tobytes()], pa.binary()), pa.array([np.cumsum([0, *map(len, part)]).tobytes()], pa.binary())], names=["keys", "ends"])
        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= QUERY_BLOCK:
                yield made(held[:QUERY_BLOCK])
                held = held[QUERY_BLOCK:]
        if held:
            yield made(held)

    def near(cells) -> list[np.ndarray]:
        """For each radius, by axis and bucket: the rows of a block in any bucket within it."""
        own = np.zeros((axes, buckets, BITMAP_IDS // 64), np.uint64)
        for c in cells:
            own[c["axis"], c["bucket"]] = np.frombuffer(c["rows"], np.uint64)
        out = []
        for radius in radii:
            wide = [np.bitwise_or.reduce(own[:, max(0, b - radius) : b + radius + 1], axis=1) for b in range(buckets)]
            out.append(np.stack(wide, 1).reshape(axes * buckets, -1))
        return out

    def run(batches):
        import pyarrow as pa

        total, at, wide = np.zeros(len(radii), np.int64), None, None
        for batch in batches:
            for i in range(batch.num_rows):
                block, keys, ends = (batch.column(c)[i].as_py() for c in (0, 2, 3))
                if block != at:
                    at, wide = block, near(batch.column(1)[i].as_py())
                keys, ends = np.frombuffer(keys, np.int32), np.frombuffer(ends, np.int64)
                for lo in range(0, len(ends) - 1, UNITED):
                    e = ends[lo : lo + UNITED + 1]
                    for r, w in enumerate(wide):
                        total[r] += int(np.bitwise_count(np.bitwise_or.reduceat(w[keys[e[0] : e[-1]]], e[:-1] - e[0], axis=0)).sum(dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(radii, pa.int32()), pa.array(total)], names=["radius", "rows"])

    keyed = asked.groupBy("query_id").agg(F.collect_set((F.col("axis") * buckets + F.col("bucket")).cast("int")).alias("keys")).select("keys")
    parts = max(1, -(-asked.count() // (axes * QUERY_BLOCK * QUERY_BLOCKS)))
    lot = written(keyed.repartition(parts).mapInArrow(lots, "keys binary, ends binary"), "query-lots")
    held = posted.groupBy("block").agg(F.collect_list(F.struct("axis", "bucket", "rows")).alias("cells"))
    held = held.repartition(posted.sparkSession.sparkContext.defaultParallelism, "block")
    return held.crossJoin(lot).mapInArrow(run, "radius int, rows long").groupBy("radius").agg(F.sum("rows").alias("rows"))


def route(vectors: DataFrame, queries: DataFrame, count: int = 4, buckets: int = 16, radius: int = 1, seed: int = 0, axes: np.ndarray | None = None, row_id: str = "row_id", query_id: str = "query_id", vector: str = "embedding", calibrated: bool = False) -> DataFrame:
    """(query_id, row_id): rows that share a bucket, or one within radius, with the query on one of count projections.

    axes: the projections, a row each; None: random ones. Buckets are those of buckets_of(). Row ids are not negative. A query's
    rows are united as bitmaps, and become rows at the end.
    """
    if axes is None:
        axes = directions(len(queries.select(vector).first()[0]), count, seed)
    placed, asked = buckets_of(vectors, queries, axes, buckets, calibrated, row_id, query_id, vector)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for q, block, rows in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(rows, np.uint8), bitorder="little"))
                ids = at + (0 if block == 0 else (block - 1) * BITMAP_IDS + 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q)), pa.array(ids)], names=["query_id", "row_id"])

    return united(postings(placed), near_buckets(asked, radius)).mapInArrow(run, "query_id long, row_id long")


def _moments(vectors: DataFrame, vector: str):
    """(mean, covariance), from dim * dim moments that tasks sum up."""

    def moments(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            x = kernels.block(batch.column(0)).astype(np.float64)
            if len(x):
                own = (len(x), x.sum(0), x.T @ x)
                total = own if total is None else tuple(a + b for a, b in zip(total, own, strict=True))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total[0]]), pa.array([total[1].tobytes()]), pa.array([total[2].tobytes()])], names=["n", "s", "m"])

    def summed(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            for n, s, m in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = (n, np.frombuffer(s), np.frombuffer(m))
                total = own if total is None else tuple(a + b for a, b in zip(total, own, strict=True))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total[0]]), pa.array([total[1].tobytes()]), pa.array([total[2].tobytes()])], names=["n", "s", "m"])

    kinds = "n long, s binary, m binary"
    parts = vectors.select(F.col(vector).cast("array<float>")).mapInArrow(moments, kinds)
    # A tree: the tasks' moments are summed by a few tasks, their sums by one, and one row comes to the driver.
    n, s, m = parts.repartition(MOMENT_TASKS).mapInArrow(summed, kinds).repartition(1).mapInArrow(summed, kinds).first()
    s, m = np.frombuffer(s), np.frombuffer(m)
    d = len(s)
    return s / n, m.reshape(d, d) / n - np.outer(s / n, s / n)


def _axes_of(cov: np.ndarray, count: int) -> np.ndarray:
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :count].T
    large = np.take_along_axis(axes, np.abs(axes).argmax(1)[:, None], 1)
    return axes * np.where(large < 0, -1.0, 1.0)


def principal_axes(vectors: DataFrame, count: int, vector: str = "embedding") -> np.ndarray:
    """The axes of most variance, most first; of each, the coordinate farthest from 0 is positive."""
    return _axes_of(_moments(vectors, vector)[1], count)


def cell_keys(vectors: DataFrame, axes: np.ndarray, row_id: str = "row_id", vector: str = "embedding", mean: np.ndarray | None = None) -> DataFrame:
    """(row_id, cell): the signs of a row's projections as bits; of its difference from mean, where that is given."""
    return with_cells(vectors.select(F.col(row_id).cast("long").alias("row_id"), vector), axes, mean, vector).select("row_id", "cell")


def cell_candidates(vectors: DataFrame, queries: DataFrame, axes: np.ndarray, probes: int, mean: np.ndarray | None = None, row_id: str = "row_id", query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(query_id, probe, distance, row_id): the rows in the probes cells nearest to each query's, by an equi-join on the cell."""
    rows = cell_keys(vectors, axes, row_id, vector, mean).withColumnRenamed("cell", "near")
    near = nearest_cells(cell_keys(queries, axes, query_id, vector, mean).withColumnRenamed("row_id", "query_id"), len(axes), probes)
    return near.join(rows, "near").select("query_id", "probe", "distance", "row_id")


def principal_cell_candidates(vectors: DataFrame, queries: DataFrame, bits: int, probes: int, vector: str = "embedding", **names) -> DataFrame:
    """cell_candidates() by the signs of the centred projections on the bits axes of most variance."""
    mean, cov = _moments(vectors, vector)
    return cell_candidates(vectors, queries, _axes_of(cov, bits), probes, mean, vector=vector, **names)


def gini(sizes: DataFrame, column: str = "n") -> DataFrame:
    """(gini): how uneven the sizes of cells are; 0: all equal. Cells are numbered by ranges of their sizes."""
    s = with_row_ids(sizes.select(column, F.struct(column, "cell").alias("rs_key")), "rs_key").withColumn("i", F.col("row_id") + 1)
    return s.agg((2 * F.sum(F.col("i") * F.col(column)) / (F.count("*") * F.sum(column)) - (F.count("*") + 1) / F.count("*")).alias("gini"))


def twonn(vectors: DataFrame, sample: DataFrame, trim: float = 0.1) -> float:
    """Dimension from the ratio of the two nearest neighbours' distances; sample (query_id, embedding): the rows asked."""
    s = search(vectors, sample, kernels.inner_product(), 3).where("query_id <> row_id")
    d = s.groupBy("query_id").agg(F.array_sort(F.collect_list(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))))).alias("d"))
    mu = sorted(r[0] for r in d.where("size(d) >= 2 and d[0] > 0").select(F.col("d")[1] / F.col("d")[0]).collect())
    keep = mu[: max(1, int(len(mu) * (1 - trim)))]
    x = [math.log(m) for m in keep]
    y = [-math.log(1 - i / len(mu)) for i in range(len(keep))]
    return sum(a * b for a, b in zip(x, y, strict=True)) / max(sum(a * a for a in x), 1e-12)


def overlap_decomposition(tops: DataFrame) -> DataFrame:
    """From (row_id, top: places of set bits): rows, bits a row, and the overlap expected of two rows if places were
    drawn by their own frequencies; overlap_levels() has what that is to be compared with."""
    n = tops.agg(F.count("*").alias("rows"), F.avg(F.size("top")).alias("weight"))
    f = tops.select(F.explode("top").alias("pos")).groupBy("pos").agg(F.count("*").alias("n"))
    f = f.join(F.broadcast(n)).agg(F.first("rows").alias("rows"), F.first("weight").alias("weight"), F.sum(F.pow(F.col("n") / F.col("rows"), 2)).alias("expected_by_frequency"))
    return f


def true_neighbours(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, row_id): each query's k rows of largest inner product, itself left out."""
    found = search(vectors, queries, kernels.inner_product(), k + 1).where("query_id <> row_id")
    return top_k(found.select("query_id", "row_id", "score"), k).select("query_id", "row_id")


def overlap_levels(tops: DataFrame, neighbours: DataFrame, dim: int) -> DataFrame:
    """One row: the overlap of two rows' top places that even frequencies, their own frequencies, two different rows and
    true neighbours have.

    tops: row_id, top. neighbours: (query_id, row_id), both ids of tops. expected_uniform: weight^2 / dim;
    expected_by_frequency: sum of f_c^2; observed_random: the mean of all pairs of different rows, exactly, from the
    counts of places; observed_neighbours: the mean of neighbours. cone_fraction: the part of observed_random beyond
    uniform that frequencies explain; pair_signal: neighbours above random, as a share of random.
    """
    n = tops.agg(F.count("*").alias("rows"), F.avg(F.size("top")).alias("weight"))
    f = tops.select(F.explode("top").alias("pos")).groupBy("pos").agg(F.count("*").alias("n")).join(F.broadcast(n))  # n: one row
    rows, c = F.col("rows").cast("double"), F.col("n").cast("double")
    f = f.agg(F.first("rows").alias("rows"), F.first("weight").alias("weight"), F.sum(F.pow(c / rows, 2)).alias("expected_by_frequency"), F.sum(F.try_divide(c * (c - 1), rows * (rows - 1))).alias("observed_random"))
    pair = neighbours.join(tops.select("row_id", F.col("top").alias("rs_d")), "row_id").join(tops.select(F.col("row_id").alias("query_id"), F.col("top").alias("rs_q")), "query_id")
    seen = pair.agg(F.avg(F.size(F.array_intersect("rs_d", "rs_q"))).alias("observed_neighbours"))
    f = f.join(F.broadcast(seen)).withColumn("expected_uniform", F.col("weight") * F.col("weight") / dim)  # seen: one row
    level = ("expected_uniform", "expected_by_frequency", "observed_random", "observed_neighbours")
    cone = F.try_divide(F.col("expected_by_frequency") - F.col("expected_uniform"), F.col("observed_random") - F.col("expected_uniform"))
    return f.select("rows", "weight", *level, cone.alias("cone_fraction"), F.try_divide(F.col("observed_neighbours") - F.col("observed_random"), F.col("observed_random")).alias("pair_signal"))
