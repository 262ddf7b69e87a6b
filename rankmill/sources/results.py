"""Result, judgement and timing records as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOP_K = "dataset string, split string, method string, qid_idx long, qid string, k int, doc_idxs array<long>, doc_ids array<string>, scores array<double>"
# Fields of a timing record, as it is exchanged.
TIMING = (
    "dataset string, split string, method string, dim int, n_docs long, n_queries long, top_k int, threads int, batch int, candidates int, "
    "bytes_per_vector long, index_total_mib double, build_seconds double, query_latency_ms_p50 double, query_latency_ms_p95 double, query_latency_ms_p99 double, "
    "queries_per_second double, cpu_arch string, simd_detected array<string>, rustc string, crate_version string, encoder_manifest_sha256 string"
)


def write_top_k(found: DataFrame, path: str, dataset: str, split: str, method: str, k: int) -> None:
    """found (query_id, rank, row_id, score), a line a query."""
    lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "row_id", "score"))).alias("l"))
    lists.select(
        F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.lit(method).alias("method"), F.col("query_id").alias("qid_idx"), F.col("query_id").cast("string").alias("qid"), F.lit(k).alias("k"),
        F.transform("l", lambda s: s["row_id"]).alias("doc_idxs"), F.transform("l", lambda s: s["row_id"].cast("string")).alias("doc_ids"), F.transform("l", lambda s: s["score"]).alias("scores"),
    ).write.mode("append").json(path)


def read_top_k(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, method, query_id, doc_id, score, pos), a row a document."""
    d = spark.read.schema(TOP_K).option("mode", "FAILFAST").json(path)
    d = d.select("dataset", "method", F.col("qid").alias("query_id"), F.posexplode(F.arrays_zip("doc_ids", "scores")).alias("pos", "z"))
    return d.select("dataset", "method", "query_id", F.col("z.doc_ids").alias("doc_id"), F.col("z.scores").alias("score"), "pos")


def read_qrels(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(query_id, doc_id, rel) of a JSON object {query: {document: relevance}}.

    lines: the path has an object on each line, as write_qrels() makes them, and is read by as many tasks as it has blocks; else
    a file is one object, which one task reads.
    """
    d = spark.read.text(path, wholetext=not lines).select(F.from_json("value", "map<string,map<string,int>>").alias("m"))
    d = d.select(F.explode("m").alias("query_id", "docs"))
    return d.select("query_id", F.explode("docs").alias("doc_id", "rel"))


def write_qrels(judged: DataFrame, path: str) -> None:
    """judged (query_id, doc_id, rel), an object {query: {document: relevance}} on a line for each: no query is gathered."""
    q, d = F.col("query_id").cast("string"), F.col("doc_id").cast("string")
    judged.select(F.to_json(F.create_map(q, F.create_map(d, F.col("rel").cast("int")))).alias("value")).write.mode("append").text(path)


def append_timings(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TIMING).json(path)


def read_ids(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(row_id, id) of a JSON array of strings: ids by their place in it.

    lines: the path has {"row_id", "id"} on each line, as write_ids() makes them; an array is read by one task.
    """
    if lines:
        return spark.read.schema("row_id long, id string").option("mode", "FAILFAST").json(path)
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("ids"))
    d = d.withColumn("ids", F.when(F.col("ids").isNull(), F.raise_error(F.lit("not a JSON array of ids"))).otherwise(F.col("ids")))
    return d.select(F.posexplode("ids").alias("row_id", "id")).withColumn("row_id", F.col("row_id").cast("long"))


def write_ids(ids: DataFrame, path: str) -> None:
    """ids (row_id, id), one to a line."""
    ids.select(F.col("row_id").cast("long").alias("row_id"), F.col("id").cast("string").alias("id")).write.mode("append").json(path)


def read_encoder_manifest(path: str) -> dict:
    """What is known of how vectors were made: a JSON object."""
    import json

    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if not isinstance(found, dict):
        raise ValueError("an encoder manifest is a JSON object")
    return found
