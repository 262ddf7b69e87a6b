"""Synthetic corpora of vectors, made in tasks: each block of rows has its own seed, so any size can be made again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from rankmill.functions.kernels import unit
from rankmill.spec import ParameterError

BLOCK = 8192
KINDS = ("clustered", "isotropic", "anisotropic", "rogue", "manifold", "lattice")


def corpus(spark: SparkSession, rows: int, dim: int, kind: str = "clustered", seed: int = 1, clusters: int = 200, latent: int = 64, noise: float = 0.3) -> DataFrame:
    """(row_id, embedding, cluster): unit vectors. cluster is -1 where the kind has none.

    clustered: noise around centres in a latent space; isotropic: Gaussian; anisotropic: falling variances; rogue: a few
    dominant coordinates; manifold: smooth functions of three numbers; lattice: rounded Gaussian.
    """
    if kind not in KINDS:
        raise ParameterError(f"kind must be one of {', '.join(KINDS)}")
    latent = min(latent, dim)

    def block(first, n):
        base, own = np.random.default_rng(seed), np.random.default_rng([seed, first])
        at, x = np.full(n, -1), own.normal(size=(n, dim))
        if kind == "clustered":
            spread, centres = base.normal(size=(latent, dim)) / np.sqrt(latent), base.normal(size=(clusters, latent))
            at = own.integers(0, clusters, n)
            x = (centres[at] + noise * own.normal(size=(n, latent))) @ spread
        elif kind == "anisotropic":
            x = x / np.sqrt(1 + np.arange(dim))
        elif kind == "rogue":
            x[:, base.choice(dim, max(1, dim // 64), replace=False)] += 8
        elif kind == "manifold":
            x = np.sin(own.uniform(-np.pi, np.pi, (n, 3)) @ base.normal(size=(3, dim)) + base.uniform(0, np.pi, dim))
        elif kind == "lattice":
            x = np.round(x)
        return at, unit(x).astype(np.float32)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first in batch.column(0).to_pylist():
                n = min(BLOCK, rows - first)
                at, x = block(first, n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), lists, pa.array(at.astype(np.int32))], names=["row_id", "embedding", "cluster"])

    return spark.range(0, rows, BLOCK, max(1, -(-rows // BLOCK))).mapInArrow(run, "row_id long, embedding array<float>, cluster int")
