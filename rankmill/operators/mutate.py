"""Tables of codes that grow and shrink, with dense row ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankmill.functions import encode
from rankmill.spec import ParameterError
from rankmill.storage import written


def with_row_ids(df: DataFrame, key: str, first: int = 0) -> DataFrame:
    """df with row_id from first on, in order of key; rows of equal key in any order, each with an id of its own.

    Rows are dealt by ranges of key, sorted, and written once with their place: the number of a range and of a row in it.
    Ids are the places moved up by the rows of earlier ranges, counted from the same table, so nothing is evaluated twice
    and no task holds all rows. A key that many rows share is dealt out by the place where it stood in df.
    """
    name = lambda x: next(n for n in (x, *(f"{x}_{i}" for i in range(len(df.columns) + 1))) if n not in df.columns)
    tie, place = name("rid_tie"), name("rid_place")
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(key, tie).sortWithinPartitions(key, tie).drop(tie)
    dealt = written(dealt.withColumn(place, F.monotonically_increasing_id()), "placed")
    part = F.shiftright(place, 33).alias("rid_part")
    sizes = dealt.groupBy(part).agg(F.count("*").alias("rid_n"))  # a row a range
    before = F.sum("rid_n").over(Window.orderBy("rid_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("rid_part", F.coalesce(before, F.lit(0)).alias("rid_before"))
    at = F.coalesce("rid_before", F.raise_error(F.lit("a range of rows was not counted")).cast("long"))
    found = dealt.join(F.broadcast(sizes), F.shiftright(place, 33) == F.col("rid_part"), "left")
    return found.select(*df.columns, (at + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + first).alias("row_id"))


def running_total(df: DataFrame, order: str, column: str, name: str) -> DataFrame:
    """df with column summed up to each row, in order of a column of different values.

    Rows are dealt by ranges and summed within each; what comes before a range is a sum over ranges, a row each.
    """
    at = F.spark_partition_id().alias("rt_part")
    dealt = written(df.repartitionByRange(order).select("*", at), "ranges")
    sums = dealt.groupBy("rt_part").agg(F.sum(column).alias("rt_sum"))  # a row a range
    before = F.coalesce(F.sum("rt_sum").over(Window.orderBy("rt_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum(column).over(Window.partitionBy("rt_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    found = dealt.join(F.broadcast(sums.select("rt_part", before.alias("rt_before"))), "rt_part")
    return found.select(*df.columns, (F.col("rt_before") + within).alias(name))


def code_table(vectors: DataFrame, dim: int, n_top: int | None = None, vector: str = "embedding") -> DataFrame:
    """row_id with ranks, b1, b2, b4, top_words and sign_words, as far as dim allows."""
    t = vectors.select("row_id", encode.rank_transform(F.col(vector)).alias("ranks"), vector)
    for bits in (1, 2, 4):
        if dim % (1 << bits) == 0:
            t = t.withColumn(f"b{bits}", encode.bucket_ranks(F.col("ranks"), dim, bits))
    if dim % 64 == 0:
        if n_top:
            t = t.withColumn("top_words", encode.top_bits_of_doc(F.col("ranks"), dim, n_top))
        t = t.withColumn("sign_words", encode.sign_bits(F.col(vector), dim))
    return t.drop(vector)


def append(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with the rows of new behind it; their row ids go on from the last one."""
    last = table.agg(F.max("row_id")).first()[0]
    rows = with_row_ids(new, key, 0 if last is None else last + 1)
    return table.unionByName(rows.select(*table.columns))


class Moves:
    """Which rows of a table are gone and which stand in another's place, after any number of removals.

    A removal is a change of a few entries here; the table is read through one join with them, however many there are.
    """

    def __init__(self, rows: int):
        self.rows, self._at, self._gone = rows, {}, set()

    def remove(self, place: int) -> int:
        """Takes out what stands at place, puts the last row there, and returns where that was."""
        if not 0 <= place < self.rows:
            raise ParameterError("no such row")
        last = self.rows - 1
        tail = self._at.pop(last, last)
        self._gone.add(self._at.get(place, place) if place != last else tail)
        if place != last:
            self._at[place] = tail
        self.rows = last
        return last

    def __len__(self) -> int:
        return len(self._gone)

    def over(self, table: DataFrame, most: int = 500_000) -> DataFrame:
        """table (row_id and more) as it stands now; the entries are broadcast up to most of them."""
        if not self._gone:
            return table
        moved = [(row, place) for place, row in self._at.items()]
        entries = table.sparkSession.createDataFrame([*moved, *((row, None) for row in self._gone)], "row_id long, mv_to long")
        entries = entries.withColumn("mv_known", F.lit(True))
        found = table.join(F.broadcast(entries) if len(moved) + len(self._gone) <= most else entries, "row_id", "left")
        found = found.where("mv_known is null or mv_to is not null").withColumn("row_id", F.coalesce("mv_to", "row_id"))
        return found.select(*table.columns)


def swap_remove(table: DataFrame, row_id: int) -> DataFrame:
    """table without a row, the last row in its place."""
    last = table.agg(F.max("row_id")).first()[0]
    if last is None or not 0 <= row_id <= last:
        raise ParameterError("no such row")
    return table.where(F.col("row_id") != row_id).withColumn("row_id", F.when(F.col("row_id") == last, F.lit(row_id).cast("long")).otherwise(F.col("row_id")))
