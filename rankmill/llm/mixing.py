"""Operator 10: mixing sources to target weights by Poisson replication.

A document of source s appears Poisson(rate of s) times, with rate = weight of s * budget / documents of s. The count is
the inverse of the distribution function at a number hashed from the document's id and the seed, so a lost task makes
the same copies again. Copies are dealt out by a hash and sorted by it: a global shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.llm.shared import bytes_read, fresh, partitions, small

#: Bytes of input files behind one partition of the result, for each document that is asked for one of the input.
PARTITION_BYTES = 64 << 20
#: exp(-rate) must not vanish: a larger rate is the sum of several draws.
PART = 50.0


def uniform(key: Column, seed: int, part: Column) -> Column:
    """52 bits of an MD5, as a number from 0 up to but without 1."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), part.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 2.0, factor: float = 1.0, source: str = "source", rest: float = 0.0) -> DataFrame:
    """(mx_source, rate): the mean number of copies of each document of a source.

    weights: target share of each source in the result. Sources that aren't named share rest among them by
    documents ** (1 / temperature), the null source too; with a rest of 0 they go. Shares are scaled to 1 over the sources
    there are. weights None: all sources share by that power. factor: documents in the result for each document of the input.
    """
    if weights is None:
        weights, rest = {}, 1.0
    if min([*weights.values(), rest]) < 0 or not sum(weights.values()) + rest:
        raise ValueError("weights must not be negative, and one must be positive")
    n = docs.groupBy(F.col(source).alias("mx_source")).agg(F.count("*").alias("n"))
    named = docs.sparkSession.createDataFrame(sorted(weights.items()), "mx_source string, named double")
    n = n.join(F.broadcast(named), "mx_source", "left")  # as many rows as the caller has named
    n = n.withColumn("own", F.when(F.col("named").isNull(), F.pow("n", F.lit(1 / temperature))))
    total = n.agg(F.sum("n").alias("all_n"), F.coalesce(F.sum("own"), F.lit(0.0)).alias("all_own"), F.coalesce(F.sum("named"), F.lit(0.0)).alias("all_named"))
    w = F.coalesce(F.col("named"), rest * F.col("own") / F.col("all_own"))
    all_w = F.col("all_named") + F.when(F.col("all_own") > 0, rest).otherwise(0.0)
    rate = F.round(F.try_divide(w, all_w) * F.col("all_n") * factor / F.col("n"), 9)
    return n.join(F.broadcast(total)).select("mx_source", F.coalesce(rate, F.lit(0.0)).alias("rate"))  # total: one row


def copies(rate: Column) -> dict[str, Column]:
    """Columns that make a rate ready for inversion: how many draws, and the distribution function of one draw."""
    parts = F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int")
    r = rate / parts
    top = F.ceil(r + 12 * F.sqrt(r) + 30).cast("int")  # beyond it less than 2**-53 is left
    start = F.struct(F.array(F.exp(-r)).alias("cdf"), F.exp(-r).alias("p"))
    step = lambda a, j: F.struct(F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * r / j)).alias("cdf"), (a["p"] * r / j).alias("p"))
    return {"mx_parts": parts, "mx_cdf": F.aggregate(F.sequence(F.lit(1), top), start, step)["cdf"]}


def shuffle_width(docs: DataFrame, factor: float) -> int:
    """Partitions of the result: as many as the session's shuffles have, and more where the files read and factor ask for more."""
    return max(partitions(docs.sparkSession), math.ceil(bytes_read(docs) * max(factor, 0.0) / PARTITION_BYTES))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 2.0, factor: float = 1.0, seed: int = 17, source: str = "source", key: str = "doc_id", rest: float = 0.0) -> DataFrame:
    """The rows of docs, each as often as drawn, with copies and copy (from 1), shuffled over all partitions.

    All columns of docs are passed on, nulls, empty and very long texts too; where docs has a column copies or copy
    itself, the new one is called copies_1 or copy_1. A null source is a source like others, which weights can't name. Rows
    of equal key and source are drawn alike, repeated rows among them; a null key counts as an empty one. Rows that tie in
    the shuffle's order stand in any. An empty table gives an empty result.
    """
    origin, rate, parts, cdf, u, order, copies_, copy = fresh(docs, "mx_source", "rate", "mx_parts", "mx_cdf", "mx_u", "mx_order", "copies", "copy")
    rates = source_rates(docs, weights, temperature, factor, source, rest)
    rates = rates.select(F.col("mx_source").alias(origin), *(c.alias({"mx_parts": parts, "mx_cdf": cdf}[k]) for k, c in copies(F.col("rate")).items()))
    rates = small(rates, 100_000)
    d = docs.join(rates, docs[source].eqNullSafe(rates[origin]))
    draw = lambda i: F.size(F.filter(cdf, lambda c: c <= F.col(u)[i - 1]))
    d = d.withColumn(u, F.transform(F.sequence(F.lit(1), parts), lambda i: uniform(F.col(key), seed, i)))
    d = d.withColumn(copies_, F.aggregate(F.transform(F.sequence(F.lit(1), parts), draw), F.lit(0), lambda a, x: a + x).cast("long"))
    d = d.where(F.col(copies_) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies_)))
    d = d.withColumn(order, F.xxhash64(F.lit(seed), key, copy, F.lit(1)))
    d = d.repartition(shuffle_width(docs, factor), order).sortWithinPartitions(order)
    return d.select(*docs.columns, copies_, copy)


def mixed_sql(table: str, columns: str, seed: int = 17, weights: dict[str, float] | None = None, rest: float = 0.0) -> str:
    """DuckDB SQL for mix_sources(table) at temperature 2."""
    if weights is None:
        weights, rest = {}, 1.0
    named = "CASE source " + " ".join(f"WHEN '{s}' THEN {w!r}::DOUBLE" for s, w in sorted(weights.items())) + " END" if weights else "NULL::DOUBLE"
    return f"""
(WITH n AS (SELECT source, count(*) AS n, {named} AS named, CASE WHEN {named} IS NULL THEN sqrt(count(*)) END AS own FROM {table} GROUP BY source),
a AS (SELECT sum(n) AS all_n, coalesce(sum(own), 0) AS all_own, coalesce(sum(named), 0) + CASE WHEN sum(own) > 0 THEN {rest!r} ELSE 0 END AS all_w FROM n),
r AS (SELECT source, round(coalesce(named, {rest!r} * own / all_own) / all_w * all_n / n, 9) AS rate FROM n, a),
q AS (SELECT source, greatest(ceil(rate / {PART}), 1)::INT AS parts, rate / greatest(ceil(rate / {PART}), 1) AS r FROM r),
j AS (SELECT source, parts, r, unnest(range(0, ceil(r + 12 * sqrt(r) + 30)::INT + 1)) AS j FROM q),
c AS (SELECT source, parts, list(cdf ORDER BY j) AS cdf FROM (SELECT source, parts, j, sum(CASE WHEN r > 0 THEN exp(j * ln(r) - r - lgamma(j + 1)) ELSE (j = 0)::INT END) OVER (PARTITION BY source ORDER BY j) AS cdf FROM j) GROUP BY source, parts),
d AS (SELECT t.*, c.parts, c.cdf FROM {table} t JOIN c ON t.source IS NOT DISTINCT FROM c.source),
k AS (SELECT *, list_sum(list_transform(range(1, parts + 1), lambda i: len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || i::VARCHAR), 1, 13))::BIGINT / {1 << 52}::DOUBLE))))::BIGINT AS copies FROM d)
SELECT {columns}, unnest(range(1, copies + 1))::BIGINT AS copy, copies FROM k WHERE copies > 0)"""


def oracle(weights: dict[str, float] | None = None, rest: float = 0.0) -> str:
    return f"SELECT doc_id, source, copy, copies, md5(text) AS text_md5 FROM {mixed_sql('documents', 'doc_id, source, text', weights=weights, rest=rest)}"
