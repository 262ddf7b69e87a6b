"""Retrieval quality: runs (query_id, doc_id, score) and judgements (query_id, doc_id, rel) in, metrics out."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall_at(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of a query's k true rows that found has."""
    hit = truth.join(found.select("query_id", "row_id").distinct(), ["query_id", "row_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("n"))
    return truth.select("query_id").distinct().join(hit, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / k).alias("recall"))


def last_of(run: DataFrame, position: str = "pos") -> DataFrame:
    """Of rows with the same query and document, the last one.

    Tasks keep the last row of each pair as they read, so a shuffle has a row a pair and task and nothing is sorted.
    """
    keys = ["query_id", "doc_id"]
    rest = [c for c in run.columns if c not in (*keys, position)]
    whole = F.col(rest[0]) if len(rest) == 1 else F.struct(*rest)  # one number fits a hash table's row
    last = F.when(F.count(position) > 0, F.max_by(whole, position)).otherwise(F.first(whole)).alias("ev_last")  # without any position: some row
    found = run.groupBy(*keys).agg(last) if rest else run.select(*keys).distinct()
    own = (lambda c: F.col("ev_last")) if len(rest) == 1 else (lambda c: F.col("ev_last")[c])
    return found.select(*(c if c in keys else own(c).alias(c) for c in run.columns if c != position))


def metrics_at(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Per judged query: ndcg, map, recall, precision and mrr at k; a query that the run lacks has 0 in all.

    Documents of equal score are taken by doc_id, ascending.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    top = run.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    top = top.join(qrels.where("rel > 0"), ["query_id", "doc_id"]).select("query_id", "rank", "rel")
    seen = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    top = top.withColumn("hits", F.count("*").over(seen)).groupBy("query_id").agg(
        F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("hits") / F.col("rank")).alias("ap"),
        F.count("*").alias("n"), (1 / F.min("rank")).alias("mrr"))
    ideal = qrels.where("rel > 0").withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")))
    ideal = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("i") <= k, F.col("rel") / F.log2(F.col("i") + 1)).otherwise(0.0)).alias("idcg"), F.count("*").alias("relevant"))
    all_ = qrels.select("query_id").distinct().join(ideal, "query_id", "left").join(top, "query_id", "left").fillna(0)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return all_.select("query_id", ratio("dcg", "idcg").alias("ndcg"), ratio("ap", "relevant").alias("map"), ratio("n", "relevant").alias("recall"), (F.col("n") / k).alias("precision"), F.col("mrr").cast("double").alias("mrr"))


def means(per_query: DataFrame, by: str | None = None) -> DataFrame:
    cols = [c for c in per_query.columns if c not in ("query_id", by)]
    g = per_query.groupBy(by) if by else per_query.groupBy()
    return g.agg(*(F.avg(c).alias(c) for c in cols))


def rolled_up(per_query: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Means by all keys, by the first ones, and over all."""
    return per_query.rollup(*keys).agg(F.avg(metric).alias(metric))


def comparison(per_query: DataFrame, method: str, metric: str) -> DataFrame:
    """One row a query, a column for each method."""
    return per_query.groupBy("query_id").pivot(method).agg(F.first(metric))


def paired_bootstrap(pairs: DataFrame, a: str, b: str, rounds: int = 1000, seed: int = 0) -> dict:
    """Mean difference b - a over queries, its 2.5 and 97.5 percentiles under resampling, and whether these span 0.

    A value per query goes to the driver: query sets, not corpora.
    """
    d = np.array([r[0] for r in pairs.orderBy("query_id").select(F.col(b) - F.col(a)).collect()], float)
    if not len(d):
        return {"delta": 0.0, "low": 0.0, "high": 0.0, "within_noise": True}
    rng = np.random.default_rng(seed)
    draws = d[rng.integers(0, len(d), (rounds, len(d)))].mean(1)
    low, high = (float(x) for x in np.percentile(draws, [2.5, 97.5]))
    return {"delta": float(d.mean()), "low": low, "high": high, "within_noise": low <= 0 <= high}


#: The chances that a Poisson number of mean 1 is at most 0, 1, 2, ...; what lies beyond is below 2 ** -52.
POISSON = tuple(itertools.accumulate(math.exp(-1) / math.factorial(i) for i in range(18)))


def resampled(per_query: DataFrame, baseline: str, rounds: int = 1000, seed: int = 0, low: float = 2.5, high: float = 97.5) -> DataFrame:
    """(method, metric, delta, low, high, within_noise): each method's mean difference from the baseline, with its interval.

    per_query: method, metric, query_id, value. A query counts in a round as often as a Poisson number says, drawn from a
    hash of seed, query and round, so all methods and metrics of a round are of the same queries; all of them are one
    aggregation and nothing goes to the driver. Queries that one side lacks are left out.
    """
    base = per_query.where(F.col("method") == baseline).select("metric", "query_id", F.col("value").alias("ev_base"))
    d = per_query.where(F.col("method") != baseline).join(base, ["metric", "query_id"]).select("method", "metric", "query_id", (F.col("value") - F.col("ev_base")).alias("d"))
    drawn = d.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("query_id").cast("string"), F.col("round").cast("string"))), 1, 13), 16, 10).cast("double") / 2.0**52
    w = sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0))
    each = drawn.withColumn("w", w).groupBy("method", "metric", "round").agg((F.sum(F.col("w") * F.col("d")) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))
    ends = each.groupBy("method", "metric").agg(F.percentile("mean", low / 100).alias("low"), F.percentile("mean", high / 100).alias("high"))
    means = d.groupBy("method", "metric").agg(F.avg("d").alias("delta"))
    return means.join(ends, ["method", "metric"]).select("method", "metric", "delta", "low", "high", ((F.col("low") <= 0) & (F.col("high") >= 0)).alias("within_noise"))


def latency_summary(timings: DataFrame, by: list[str], ms: str = "ms") -> DataFrame:
    """Percentiles and queries per second of timing records."""
    return timings.groupBy(*by).agg(*(F.percentile(ms, p / 100).alias(f"p{p}") for p in (50, 95, 99)), (F.count("*") * 1000 / F.sum(ms)).alias("qps"))


def newest(timings: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return timings.withColumn("ev_n", F.row_number().over(w)).where("ev_n = 1").drop("ev_n")
