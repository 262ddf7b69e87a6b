"""Operator 11: exact dedup with a split of heavy hitters.

Texts are equal when they are identical after lower-casing A-Z; a text is known by its SHA-256. Of equal texts the row
with the largest doc_id stays. A digest that many rows share would bring all of them to one task, so digests are split:

* each task keeps Misra-Gries counters of the digests it reads, and the counters of all tasks are added up. Every digest
  with a share of 1 / heavy of all rows is among the sums of at least half that share, and of these there are at most
  2 * heavy, whatever the data (see _summary);
* their exact sizes and winners are counted with map-side partial aggregates and broadcast: rows of heavy digests are
  decided where they are read and never shuffled;
* the remaining digests are grouped by an ordinary shuffle, and their rows meet the groups of two and more by one.

Rows that tie (one text, one doc_id) are told apart in a written table, where each has a place that stays.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.llm.shared import fresh, mapped, partitions, small, spread_join, written

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A digest is heavy from this share of a shuffle partition's rows on, and at most HEAVY digests in a thousand rows are
#: told apart: the winners that are broadcast are at most twice as many, some 6 MB.
PARTITION_SHARE, HEAVY = 4, 50_000
#: Hashes that a task gathers before they are folded into its counters.
FOLD = 1 << 17


def digest(text: Column | str) -> Column:
    """SHA-256 in hex of a text with A-Z lower-cased; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), 256)


def fold(keys: np.ndarray, counts: np.ndarray, new: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Misra-Gries counters (keys, counts) after more keys: at most limit of them stay.

    Where there are more, the next largest count is taken off all of them. That takes it off limit + 1 counters at
    least, so over n keys no counter falls short by more than n / (limit + 1).
    """
    keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([counts, np.ones(len(new), np.int64)]), len(keys)).astype(np.int64)
    if len(keys) > limit:
        counts = counts - np.partition(counts, len(counts) - limit - 1)[len(counts) - limit - 1]
        keys, counts = keys[counts > 0], counts[counts > 0]
    return keys, counts


def _summary(heavy: int):
    """Rows (h, count): the counters of a task, those of a share of 1 / (4 * heavy) of its rows.

    With 4 * heavy - 1 counters a task of n rows falls short by n / (4 * heavy) at most, and by as much again for a
    digest that it leaves out. A digest on 1 / heavy of all rows so keeps half of that in the sum.
    """

    def run(batches):
        import pyarrow as pa

        keys, counts, rows, waiting, held = np.empty(0, np.int64), np.empty(0, np.int64), 0, [], 0
        for batch in batches:
            waiting.append(batch.column(0).to_numpy(zero_copy_only=False))
            held += batch.num_rows
            rows += batch.num_rows
            if held >= FOLD:
                keys, counts = fold(keys, counts, np.concatenate(waiting), 4 * heavy - 1)
                waiting, held = [], 0
        if waiting:
            keys, counts = fold(keys, counts, np.concatenate(waiting), 4 * heavy - 1)
        pick = counts * 4 * heavy >= rows
        yield pa.RecordBatch.from_arrays([pa.array(keys[pick]), pa.array(counts[pick])], names=["h", "count"])

    return run


def heavy_winners(table: DataFrame, heavy: int) -> DataFrame:
    """(digest, keep_id, group_size, at_keep) of the heavy digests of table (digest, doc_id): exact, at most 2 * heavy rows.

    at_keep: how many rows of the digest have keep_id.
    """
    total = table.count()
    h, least = F.xxhash64("digest"), F.lit(total / (2 * heavy))
    counters = mapped(table.select(h.alias("h")), _summary(heavy), "h long, count long")
    frequent = counters.groupBy("h").agg(F.sum("count").alias("count")).where(F.col("count") >= least).select("h")
    met = table.withColumn("h", h).join(F.broadcast(frequent), "h", "left_semi")  # at most 2 * heavy numbers
    found = met.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where(F.col("group_size") >= least)
    found = written(found, "heavy")
    last = table.join(F.broadcast(found), "digest").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return written(found.join(F.broadcast(last.groupBy("digest").agg(F.count("*").alias("at_keep"))), "digest"), "winners")


def light_groups(table: DataFrame, winners: DataFrame) -> DataFrame:
    """The same columns for all other digests that two rows or more share."""
    light = table.join(F.broadcast(winners.select("digest")), "digest", "left_anti").repartition("digest")
    groups = light.groupBy("digest", "doc_id").agg(F.count("*").alias("rows")).groupBy("digest").agg(F.sum("rows").alias("group_size"), F.max(F.struct("doc_id", "rows")).alias("top"))
    return written(groups.where("group_size > 1").select("digest", F.col("top.doc_id").alias("keep_id"), "group_size", F.col("top.rows").alias("at_keep")), "groups")


def _decided(rows: DataFrame, heavy: int | None) -> DataFrame:
    """rows (digest, doc_id and more) with keep_id, group_size and kept."""
    spark, own = rows.sparkSession, rows.columns
    heavy = heavy or min(PARTITION_SHARE * partitions(spark), HEAVY)
    table = rows.select("digest", "doc_id") if hasattr(rows, "rankmill_path") else written(rows.select("digest", "doc_id"), "digests")
    winners = heavy_winners(table, heavy)
    groups = light_groups(table, winners)
    last = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    decided = rows.join(F.broadcast(winners), "digest").select(*own, "keep_id", "group_size", "at_keep", last.alias("kept"))
    alone, one = F.col("group_size").isNull(), F.lit(1).cast("long")
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").join(small(groups), "digest", "left")
    light = light.select(
        *own, F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", one).alias("group_size"),
        F.coalesce("at_keep", one).alias("at_keep"), (alone | last).alias("kept"),
    )
    every = decided.union(light)
    if not winners.union(groups).where("at_keep > 1").limit(1).count():
        return every.drop("at_keep")
    tie = F.col("kept") & (F.col("at_keep") > 1)
    ties = written(every.where(tie).withColumn("place", F.monotonically_increasing_id()), "ties")  # written: places stay
    first = F.min(F.struct(F.sha2(F.to_json(F.struct(*own)), 256), "place")).alias("first")
    firsts = ties.groupBy("digest").agg(first, F.count("*").alias("rows")).select("digest", "rows", F.col("first.place").alias("stays"))
    ties = spread_join(ties, written(firsts, "stays"), ["digest"], "rows", "place").withColumn("kept", F.col("place") == F.col("stays"))
    return every.where(~tie).drop("at_keep").unionByName(ties.drop("at_keep", "place", "stays"))


def exact_copies(docs: DataFrame, heavy: int | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256.

    Texts are read once. A null text counts as an empty one, and empty texts are equal to each other; texts are taken
    whole, however long. A doc_id that is null is smaller than any other, so such a row stays only where all of its text
    have none. Rows that repeat both text and doc_id are rows of one group, of which one stays; all of them come back. An
    empty table gives an empty result. Further columns are ignored. heavy: digests on 1 / heavy of all rows are decided
    where they are read; without it, those of a quarter of a shuffle partition (at most HEAVY digests).
    """
    table = written(docs.select(digest("text").alias("digest"), "doc_id"), "digests")
    return _decided(table, heavy).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame, heavy: int | None = None) -> DataFrame:
    """docs (doc_id, text and more) with keep_id, group_size, kept and text_sha256 as exact_copies has them.

    New columns that clash with one of docs take the next free name (keep_id_1, ...). Of rows that repeat both text and
    doc_id, the one whose columns, as JSON, have the least SHA-256 stays.
    """
    keep, size, kept, sha = fresh(docs, "keep_id", "group_size", "kept", "text_sha256")
    names = [f"own_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = {c.lower(): n for c, n in zip(docs.columns, names, strict=True)}
    rows = plain.select(digest(at["text"]).alias("digest"), F.col(at["doc_id"]).alias("doc_id"), *names)
    out = _decided(rows, heavy).select(*names, "keep_id", "group_size", "kept", "digest")
    return out.toDF(*docs.columns, keep, size, kept, sha)


def drop_exact_duplicates(docs: DataFrame, heavy: int | None = None) -> DataFrame:
    """The rows of docs that stay."""
    kept = fresh(docs, "kept")[0]
    return exact_dedup(docs, heavy).where(F.col(kept)).select(*docs.columns)


def oracle() -> str:
    return f"""
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}') AS t FROM documents)"""
