"""What the operators share: tables in the shared folder, joins that spread hot keys, checks of size before a broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm.text import frugal
from rankmill.storage import discard, shared_dir, written

__all__ = ["buckets", "discard", "documents", "fresh", "mapped", "partitions", "shared_dir", "small", "spread_join", "written"]

#: Rows up to which a table of a few numbers a row is broadcast: some 16 MB.
BROADCAST_ROWS = 500_000
#: Keys that a join may spread at most; a key with no more rows than this share of all stays in one task.
HOT_KEYS = 100_000
#: Rows of a key up to which it is never spread.
COLD_ROWS = 256
#: Bytes of input behind one bucket of packed arrays.
BUCKET_BYTES = 64 << 20


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has no more rows than limit; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread_join(big: DataFrame, table: DataFrame, keys: list[str], rows: str, by: str, how: str = "inner") -> DataFrame:
    """big joined to table, which has one row for each key and in column rows how many rows of big have that key.

    A key with many rows is dealt over as many tasks as it needs, by a hash of column by, and its row of table goes to
    each of them. At most HOT_KEYS keys are spread, so their list is broadcast.
    """
    total, most = table.agg(F.sum(rows), F.max(rows)).first()
    size = max(COLD_ROWS, (total or 0) // HOT_KEYS)
    if (most or 0) <= size:
        return big.join(table.drop(rows), keys, how)
    hot = F.broadcast(table.where(F.col(rows) > size).select(*keys, F.ceil(F.col(rows) / size).cast("int").alias("sj_parts")))  # fewer than HOT_KEYS rows
    left = big.join(hot, keys, "left").withColumn("sj_at", F.pmod(F.xxhash64(by), F.coalesce("sj_parts", F.lit(1))).cast("int")).drop("sj_parts")
    right = table.drop(rows).join(hot, keys, "left").withColumn("sj_at", F.explode(F.sequence(F.lit(0), F.coalesce("sj_parts", F.lit(1)) - 1))).drop("sj_parts")
    return left.join(right, [*keys, "sj_at"], how).drop("sj_at")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bytes_read(df: DataFrame) -> int:
    """The size of the files that df reads, as far as it is known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 52)  # more stands for not known


def buckets(df: DataFrame, least: int = 8) -> int:
    """A power of two: at least the number of shuffle partitions, and one for every BUCKET_BYTES of the files that df reads."""
    found = max(least, partitions(df.sparkSession), -(-bytes_read(df) // BUCKET_BYTES))
    return 1 << (found - 1).bit_length()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, or where df has such a column, the first of name_1, name_2, ... that it hasn't."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        new = next(x for x in (n, *(f"{n}_{i}" for i in range(1, len(taken) + 2))) if x.lower() not in taken)
        taken.add(new.lower())
        out.append(new)
    return out


#: Rows that go to Python at once, where the caller hasn't set it.
BATCH_ROWS = "1000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema), sparing with memory: small batches, and workers that hand freed memory back.

    Spark bounds a batch in bytes and rows by settings of the session. The one for rows is set where it is unset, since it
    holds when a result is read, not when it is made; what the caller has set stays.
    """
    if df.sparkSession.conf.get(_BATCH, None) is None:
        df.sparkSession.conf.set(_BATCH, BATCH_ROWS)

    def lean(batches):
        frugal()
        yield from run(batches)

    lean.__name__ = getattr(run, "__qualname__", "run").split(".")[0].strip("<>_")
    return df.mapInArrow(lean, schema)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
