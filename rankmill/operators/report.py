"""Evaluation of whole datasets, tables of their results, corpus preparation, and synthetic benchmarks."""

from __future__ import annotations

import hashlib
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankmill.functions import kernels as K
from rankmill.operators import evaluation, search
from rankmill.operators.synthetic import corpus
from rankmill.spec import ParameterError

METRICS = ("ndcg", "map", "recall", "precision", "mrr")
SYSTEMS = ("bytes_per_vector", "index_total_mib", "build_seconds", "query_latency_ms_p50", "query_latency_ms_p95", "query_latency_ms_p99", "queries_per_second")


def per_query(runs: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """(method, query_id, <metric>_at_<k>...): every judged query of every method in runs (method, query_id, doc_id, score)."""
    judged = qrels.select("query_id").distinct()
    out = runs.select("method").distinct().join(F.broadcast(judged))  # methods x judged queries, as rows of the result
    names = [r.method for r in runs.select("method").distinct().orderBy("method").collect()]  # a few names
    for k in ks:
        part = None
        for m in names:
            own = evaluation.metrics_at(runs.where(F.col("method") == m).drop("method"), qrels, k).withColumn("method", F.lit(m))
            part = own if part is None else part.unionByName(own)
        if part is not None:
            out = out.join(part.select("method", "query_id", *(F.col(x).alias(f"{x}_at_{k}") for x in METRICS)), ["method", "query_id"], "left")
    return out


def bootstrap_seed(seed: int, *names: str) -> int:
    """A seed for each comparison, always the same."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, (seed, *names))).encode()).digest()[:8], "big") & ((1 << 63) - 1)


def evaluate_dataset(dataset: str, runs: DataFrame, qrels: DataFrame, ks: list[int], baseline: str | None = None, timings: DataFrame | None = None, rounds: int = 1000, seed: int = 0, headline: str = "ndcg_at_10") -> dict:
    """rows: dataset, method, headline, all metrics, system columns of the newest timing; bootstrap: each metric against
    baseline; ann: recall of the baseline's documents (query_id, doc_id of runs), k the largest of ks."""
    if not len(ks):
        raise ParameterError("no k to evaluate at")
    spark, pq = runs.sparkSession, per_query(runs, qrels, ks).cache()
    labels = [f"{m}_at_{k}" for k in ks for m in METRICS]
    means = pq.groupBy("method").agg(*(F.avg(c).alias(c) for c in labels), F.count("*").alias("n_queries_judged"))
    rows = means.select(F.lit(dataset).alias("dataset"), "method", "n_queries_judged", (F.col(headline) if headline in labels else F.lit(0.0)).alias("headline"), *labels)
    if timings is not None:
        newest = timings.where(F.col("dataset") == dataset).select("method", *SYSTEMS).dropDuplicates(["method"])
        rows = rows.join(newest, "method", "left")
    tested = []
    names = [r.method for r in means.select("method").orderBy("method").collect()]
    if baseline in names:
        base = pq.where(F.col("method") == baseline).select("query_id", *(F.col(c).alias(f"b_{c}") for c in labels))
        for m in names:
            if m != baseline:
                both = pq.where(F.col("method") == m).join(base, "query_id")
                for c in labels:
                    found = evaluation.paired_bootstrap(both, f"b_{c}", c, rounds, bootstrap_seed(seed, dataset, m, c))
                    tested.append((dataset, m, baseline, c, found["delta"], found["low"], found["high"], found["within_noise"]))
    schema = "dataset string, method string, baseline string, metric string, delta double, ci95_low double, ci95_high double, within_noise boolean"
    ann = None
    if baseline in names:
        ann = ann_recall(runs, baseline, max(ks))
    return {"rows": rows, "bootstrap": spark.createDataFrame(tested, schema), "ann": ann}


def ann_recall(runs: DataFrame, baseline: str, k: int) -> DataFrame:
    """(method, ann_recall): the mean share of the baseline's first k documents that a method's first k have."""
    w = Window.partitionBy("method", "query_id").orderBy(F.desc("score"), "doc_id")
    top = runs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("method", "query_id", "doc_id")
    base = top.where(F.col("method") == baseline).select("query_id", "doc_id")
    size = base.groupBy("query_id").agg(F.count("*").alias("size"))
    hit = top.join(base, ["query_id", "doc_id"], "left_semi").groupBy("method", "query_id").agg(F.count("*").alias("hit"))
    all_ = top.select("method").distinct().join(F.broadcast(size))  # methods x queries, as rows of the result
    return all_.join(hit, ["method", "query_id"], "left").groupBy("method").agg(F.avg(F.coalesce("hit", F.lit(0)) / F.col("size")).alias("ann_recall"))


def comparison_matrix(rows: DataFrame, metric: str) -> DataFrame:
    """A row a method, a column a dataset."""
    return rows.groupBy("method").pivot("dataset").agg(F.first(metric))


def headline_table(rows: DataFrame, bootstrap: DataFrame, metric: str = "ndcg_at_10") -> DataFrame:
    """Each dataset's methods by headline, with their difference from the baseline and whether it is noise."""
    d = bootstrap.where(F.col("metric") == metric).select("dataset", "method", "delta", "ci95_low", "ci95_high", "within_noise")
    return rows.select("dataset", "method", "headline").join(d, ["dataset", "method"], "left").orderBy("dataset", F.desc("headline"), "method")


def cross_dataset(rows: DataFrame, metric: str = "headline") -> DataFrame:
    """(method, dataset, mean): by method and dataset, by method, and over all; null stands for all."""
    return rows.rollup("method", "dataset").agg(F.avg(metric).alias("mean"))


def markdown(table: DataFrame, digits: int = 4) -> str:
    """A small table as Markdown."""
    show = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(x) for x in r) + " |" for r in table.collect()])


def size_sweep(timings: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each method and size the newest record, with its speed beside that of the flat scan of the same size."""
    last = evaluation.newest(timings, [*keys, "n_docs"], order)
    flat = last.where(F.col("method") == "flat").select(*(k for k in keys if k != "method"), "n_docs", F.col("queries_per_second").alias("flat_qps"))
    on = [*(k for k in keys if k != "method"), "n_docs"]
    return last.join(flat, on, "left").withColumn("speedup", F.try_divide(F.col("queries_per_second"), F.col("flat_qps"))).drop("flat_qps")


def prepared(docs: DataFrame, queries: DataFrame, qrels: DataFrame) -> dict[str, DataFrame]:
    """A corpus ready for an encoder: docs (row_id, doc_id, text: title, line end, text), queries (row_id, query_id, text),
    both in order of their ids, and the judgements between them."""
    from rankmill.operators.mutate import with_row_ids

    text = F.btrim(F.concat_ws("\n", F.nullif(F.coalesce("title", F.lit("")), F.lit("")), F.coalesce("text", F.lit(""))))
    d = with_row_ids(docs.select("doc_id", text.alias("text")), "doc_id").select("row_id", "doc_id", "text")
    q = with_row_ids(queries.select("query_id", "text"), "query_id").select("row_id", "query_id", "text")
    known = qrels.join(q.select("query_id"), "query_id", "left_semi").join(d.select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id", "rel")
    return {"docs": d, "queries": q, "qrels": known}


MODES = ("bitmap", "batched-two-stage", "batch-sweep", "sign-headline", "storage-matched")


def synthetic_benchmark(spark: SparkSession, mode: str, rows: int, dim: int, n_queries: int = 200, k: int = 10, seed: int = 1) -> DataFrame:
    """(method, candidates, batch, bytes_per_vector, recall, candidate_recall, seconds) of a mode on a clustered corpus.

    Queries are further rows around the same centres, which the corpus hasn't. Seconds are those of one run of the whole
    query set, taken in blocks of batch queries.
    """
    if mode not in MODES:
        raise ParameterError(f"mode must be one of {', '.join(MODES)}")
    from rankmill.storage import written

    all_ = written(corpus(spark, rows + n_queries, dim, seed=seed).drop("cluster"), "corpus")
    v, q = all_.where(F.col("row_id") < rows), all_.where(F.col("row_id") >= rows).withColumnRenamed("row_id", "query_id")
    truth = written(search.search(v, q, K.inner_product(), k), "truth")
    two, bits = K.bucket_asymmetric(dim, 2), dim // 8
    plans = {
        "bitmap": [("bitmap", None, K.bitmap_overlap(n), 0, bits, search.QUERY_BLOCK) for n in (dim // 8, dim // 4, dim // 2)],
        "batched-two-stage": [("bitmap_b2", K.bitmap_overlap(dim // 4), two, m, bits + dim // 4, search.QUERY_BLOCK) for m in (100, 500, 1000)],
        "batch-sweep": [("sign_b2", K.sign_hamming(), two, 500, bits + dim // 4, b) for b in (1, 16, 64, 256)],
        "sign-headline": [("flat", None, K.inner_product(), 0, 4 * dim, search.QUERY_BLOCK), ("b2", None, two, 0, dim // 4, search.QUERY_BLOCK), ("sign_b2", K.sign_hamming(), two, 500, bits + dim // 4, search.QUERY_BLOCK)],
        "storage-matched": [("rank", None, K.rank_asymmetric(dim), 0, 2 * dim, search.QUERY_BLOCK), ("b4", None, K.bucket_asymmetric(dim, 4), 0, dim // 2, search.QUERY_BLOCK), ("b2", None, two, 0, dim // 4, search.QUERY_BLOCK), ("b1", None, K.bucket_asymmetric(dim, 1), 0, bits, search.QUERY_BLOCK)],
    }[mode]
    out = []
    for name, first, second, m, size, batch in plans:
        at = time.time()
        found = search.search(v, q, second, k, size=batch) if first is None else search.two_stage(v, q, first, second, min(m, rows), k, size=batch)
        found = written(found, "found")
        took = time.time() - at
        recall = evaluation.recall_at(found, truth, k).agg(F.avg("recall")).first()[0]
        cr = None if first is None else evaluation.recall_at(search.candidates(v, q, first, min(m, rows)), truth, k).agg(F.avg("recall")).first()[0]
        out.append((name, m, batch, size, recall, cr, took))
    return spark.createDataFrame(out, "method string, candidates int, batch int, bytes_per_vector int, recall double, candidate_recall double, seconds double")


def timed(work, rounds: int = 5) -> dict:
    """Seconds of a piece of work after one run to warm up: least, median, most."""
    work()
    took = []
    for _ in range(rounds):
        t = time.perf_counter()
        work()
        took.append(time.perf_counter() - t)
    return {"least": min(took), "median": float(np.median(took)), "most": max(took), "rounds": rounds}
