"""The queries of this folder and, where SQL can express one, its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankmill.llm import line_dedup as lines
from rankmill.llm import mixing
from rankmill.llm import quality_rules as rules
from rankmill.llm import exact_dedup as copies
from rankmill.llm import fill_middle as middle
from rankmill.llm import periodic_runs as periodic
from rankmill.llm.decontaminate import leaks
from rankmill.llm.license_scan import license_scan
from rankmill.llm.ngram_join import near_duplicate_groups
from rankmill.llm.quality_model import quality_scores
from rankmill.llm.secret_scan import secret_scan
from rankmill.llm.shared import documents
from rankmill.llm.substring_dedup import substring_dedup
from rankmill.llm.url_filter import url_filter


#: Target shares of named sources; all others share what is left.
TARGETS = {"src0": 0.3, "src1": 0.15, "src2": 0.0}


def op1_ngram_join(spark, sf_dir):
    return near_duplicate_groups(documents(spark, sf_dir), n=3, percent=90)


def op2_quality_classifier(spark, sf_dir):
    return quality_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), threshold=0.3)


def op3_substring_dedup(spark, sf_dir):
    return substring_dedup(documents(spark, sf_dir), window=50, digest=True)


def op4_secret_scan(spark, sf_dir):
    found = secret_scan(documents(spark, sf_dir))
    return found.select("doc_id", "line_no", "start", F.length("value").cast("long").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "score")


def op5_decontaminate(spark, sf_dir):
    return leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark, sf_dir):
    return rules.quality_rules(documents(spark, sf_dir))


def op7_url_filter(spark, sf_dir):
    return url_filter(documents(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op8_line_dedup(spark, sf_dir):
    return lines.line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def op9_license_scan(spark, sf_dir):
    return license_scan(documents(spark, sf_dir))


def op10_mix_sources(spark, sf_dir):
    return mixing.mix_sources(documents(spark, sf_dir), TARGETS, rest=0.55).select("doc_id", "source", "copy", "copies", F.md5("text").alias("text_md5"))


def op11_exact_dedup(spark, sf_dir):
    return copies.exact_copies(documents(spark, sf_dir))


def op12_periodic_runs(spark, sf_dir):
    found = periodic.collapse_runs(periodic.with_planted_runs(documents(spark, sf_dir).select("doc_id", "text")))
    start, length, period = (F.col(f"top.{c}") for c in ("start", "length", "period"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        periodic.runs_digest(F.col("runs")).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op13_fill_middle(spark, sf_dir):
    out = middle.fill_middle(documents(spark, sf_dir).select("doc_id", "text"))
    back = middle.restored(F.col("text"), F.col("form"))
    return out.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("text", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_join, op2_quality_classifier, op3_substring_dedup, op4_secret_scan, op5_decontaminate,
        op6_quality_rules, op7_url_filter, op8_line_dedup, op9_license_scan, op10_mix_sources,
        op11_exact_dedup, op12_periodic_runs, op13_fill_middle,
    )
}
ORACLES = {"op6_quality_rules": rules.oracle(), "op8_line_dedup": lines.oracle(), "op10_mix_sources": mixing.oracle(TARGETS, 0.55), "op11_exact_dedup": copies.oracle(), "op13_fill_middle": middle.oracle()}
