"""A corpus laid out by cell: rows stand by the signs of their projections, and a probe reads the cells it asks for."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.functions import kernels
from rankmill.spec import ParameterError

#: Bits of a cell's number at most, and those of them that name a folder.
MAX_BITS, FOLDER_BITS = 62, 10
#: Rows of a file; a cell with more of them has several files, written by several tasks.
FILE_ROWS = 1_000_000


def cell_numbers(x: np.ndarray, axes: np.ndarray, mean: np.ndarray | None = None) -> np.ndarray:
    """Cells of rows: bit i is the side of axis i on which a row lies, seen from mean or from 0."""
    low = axes @ mean if mean is not None else np.zeros(len(axes))
    return ((x.astype(np.float64) @ axes.T > low).astype(np.int64) << np.arange(len(axes))).sum(1)


def with_cells(vectors: DataFrame, axes: np.ndarray, mean: np.ndarray | None = None, vector: str = "embedding", cell: str = "cell") -> DataFrame:
    """vectors with their cell; other columns stay."""
    if not 0 < len(axes) <= MAX_BITS:
        raise ParameterError(f"there must be 1 to {MAX_BITS} axes")
    at = vectors.columns.index(vector)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = cell_numbers(kernels.block(batch.column(at), axes.shape[1]), axes, mean)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=names)

    names = [f"c{i}" for i in range(len(vectors.columns) + 1)]
    kinds = [f.dataType.simpleString() for f in vectors.schema.fields]
    kinds[at] = "array<float>"
    rows = vectors.withColumn(vector, F.col(vector).cast("array<float>"))
    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, [*kinds, "long"], strict=True))).toDF(*vectors.columns, cell)


def walk(cell: int, bits: int):
    """(distance, cell) of all cells, by Hamming distance from cell and then by number.

    The cells of a distance come in order of their number by choosing bits from the highest on, 0 before 1, as long as
    the flips that are left fit into the bits that are left: no branch ends in vain, so each cell costs at most bits steps.
    """
    for distance in range(bits + 1):
        stack = [(bits, 0, distance)]
        while stack:
            left, number, flips = stack.pop()
            if not left:
                yield distance, number
                continue
            own = cell >> (left - 1) & 1
            for bit in (1, 0):  # 0 is taken first
                rest = flips - (bit != own)
                if 0 <= rest < left:
                    stack.append((left - 1, number << 1 | bit, rest))


def nearest_cells(keys: DataFrame, bits: int, probes: int, key: str = "cell") -> DataFrame:
    """keys with probe (from 1), distance and near: the probes cells of least Hamming distance, then least number."""
    if not 0 < probes or not 0 < bits <= MAX_BITS:
        raise ParameterError(f"probes must be positive and bits from 1 to {MAX_BITS}")

    def run(batches):
        import pyarrow as pa
        from itertools import islice

        for batch in batches:
            for cell in batch.column(0).to_pylist():
                found = list(islice(walk(cell, bits), probes))
                columns = [[cell] * len(found), range(1, len(found) + 1), [d for d, _ in found], [n for _, n in found]]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cl_key", "probe", "distance", "near"])

    near = keys.select(F.col(key).cast("long")).distinct().mapInArrow(run, "cl_key long, probe int, distance int, near long")
    return keys.join(near, F.col(key) == F.col("cl_key")).select(*keys.columns, "probe", "distance", "near")


class CellTable:
    """Rows in folders by the leading bits of their cell, in files sorted by cell.

    A probe reads the folders of its cells alone, and within their files the row groups whose range of cells meets them.
    A folder of many rows is written by as many tasks as it needs, so a hot cell is no single task's file.
    """

    def __init__(self, spark: SparkSession, path: str, axes: np.ndarray, mean: np.ndarray | None = None):
        self.spark, self.path, self.axes, self.mean = spark, path, axes, mean

    @property
    def bits(self) -> int:
        return len(self.axes)

    def _folder(self, cell):
        return F.shiftright(cell, max(0, self.bits - FOLDER_BITS)).cast("int")

    def write(self, vectors: DataFrame, vector: str = "embedding") -> CellTable:
        rows = with_cells(vectors, self.axes, self.mean, vector).withColumn("folder", self._folder(F.col("cell")))
        sizes = rows.groupBy("folder").agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("cl_files"))  # at most 2 ** FOLDER_BITS rows
        dealt = rows.join(F.broadcast(sizes), "folder").withColumn("cl_file", F.pmod(F.xxhash64(*[c for c in vectors.columns if c != vector] or ["cell"]), F.col("cl_files")))
        dealt.repartition("folder", "cl_file").sortWithinPartitions("folder", "cell").drop("cl_files", "cl_file").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("folder").parquet(self.path)
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def sizes(self) -> DataFrame:
        """(cell, n)."""
        return self.rows().groupBy("cell").agg(F.count("*").alias("n"))

    def probe(self, queries: DataFrame, probes: int, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
        """(query_id, probe, distance) and the columns of rows: what stands in the probes cells nearest to each query's."""
        asked = with_cells(queries.select(query_id, vector), self.axes, self.mean, vector, "cl_own")
        near = nearest_cells(asked.select(F.col(query_id).alias("query_id"), "cl_own"), self.bits, probes, "cl_own").select("query_id", "probe", "distance", "near")
        folders = [r[0] for r in near.select(self._folder(F.col("near"))).distinct().collect()]  # at most 2 ** FOLDER_BITS numbers
        ends = near.agg(F.min("near"), F.max("near")).first()
        rows = self.rows().where(F.col("folder").isin(folders)).where(F.col("cell").between(ends[0], ends[1]) if ends[0] is not None else F.lit(False))
        return near.join(rows, F.col("near") == F.col("cell")).drop("near", "folder")
