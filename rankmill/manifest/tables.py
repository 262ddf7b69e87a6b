"""What of manifests is data: row identities, issues, and the registry of reports."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankmill.manifest.issues import Issue, Limits, ManifestError, Report
from rankmill.manifest.model import Options
from rankmill.storage import written

ISSUES = "code string, message string, artifact_name string, expected_sha256 string, actual_sha256 string, expected_size_bytes long, actual_size_bytes long, family string"
#: Spellings of a UUID: with hyphens, without, in braces, or as a URN.
UUID = "^(?:(?:urn:uuid:)?[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|\\{[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\\}|[0-9a-fA-F]{32})$"


def issues(spark: SparkSession, report: Report) -> DataFrame:
    return spark.createDataFrame([(*asdict(i).values(), i.family) for i in report.errors], ISSUES)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file, lines from 0: places in blocks of the file, moved up by the lines of earlier blocks."""
    at = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    at = written(at, "lines")
    blocks = at.groupBy("block").agg(F.count("*").alias("n"), F.min("place").alias("first"))  # a row a block of the file
    before = F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return at.join(F.broadcast(blocks), "block").select((F.col("before") + F.col("place") - F.col("first")).alias("line"), "value")


def row_identity_issues(spark: SparkSession, path: str, rows: int | None = None, options: Options = Options()) -> DataFrame:
    """(code, line) of a JSON lines file {row_id, db_id, parent_id?}: each line a strict object, row_id its number, ids UUIDs."""
    own, limits = "row_identity", options.limits
    d = numbered_lines(spark, path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    d = d.withColumn("r", F.from_json("value", "row_id long, db_id string, parent_id string")).withColumn("keys", F.json_object_keys("value"))
    kind = lambda f, pattern: F.get_json_object("value", f"$.{f}").isNull() | F.col("value").rlike(f'"{f}"\\s*:\\s*{pattern}')
    strict = F.col("keys").isNotNull() & (F.size(F.array_except("keys", F.array(*map(F.lit, ("row_id", "db_id", "parent_id"))))) == 0) & (F.size("keys") == F.size(F.array_distinct("keys")))
    strict = strict & F.col("r.row_id").isNotNull() & (F.col("r.row_id") >= 0) & F.col("r.db_id").isNotNull() & kind("row_id", "[0-9]") & kind("db_id", '"') & kind("parent_id", '(?:"|null)')
    d = d.withColumn("strict", F.coalesce(strict, F.lit(False)) & (F.octet_length("value") < limits.max_row_identity_jsonl_line_bytes))
    codes = [
        F.when(F.octet_length("value") >= limits.max_row_identity_jsonl_line_bytes, f"{own}_line_too_large").when(~F.col("strict"), f"{own}_jsonl_invalid_json"),
        F.when(F.col("strict") & (F.col("r.row_id") != F.col("line")), f"{own}_row_id_mismatch"),
    ]
    for f in ("db_id", "parent_id"):
        x = F.col(f"r.{f}")
        codes.append(F.when(F.col("strict"), F.when(x == "", f"{own}_{f}_empty").when(x.contains("\0"), f"{own}_{f}_contains_nul").when(~x.rlike(UUID), f"{own}_{f}_invalid_uuid")))
    out = d.select("line", F.explode(F.filter(F.array(*codes), lambda c: c.isNotNull())).alias("code")).select("code", "line")
    good = d.where("strict").select("line", F.col("r.db_id").alias("db_id"))
    if not options.allow_duplicate_db_ids:
        # The first line of an id stands; those after it repeat it. Lines of one id only meet where it repeats.
        twice = good.groupBy("db_id").agg(F.min("line").alias("first"), F.count("*").alias("n")).where("n > 1")
        out = out.union(good.join(twice, "db_id").where("line > first").select(F.lit(f"{own}_duplicate_db_id").alias("code"), "line"))
        held = good.select("db_id").distinct().agg(F.sum(F.octet_length("db_id")).alias("n"))
        out = out.union(held.where(F.col("n") > limits.max_row_identity_tracked_db_id_bytes).select(F.lit(f"{own}_duplicate_tracking_limit_exceeded"), F.lit(None).cast("long")))
    n = d.agg(F.count("*").alias("n"))
    out = out.union(n.where(F.col("n") > limits.max_row_identity_rows).select(F.lit(f"{own}_row_count_limit_exceeded"), F.lit(None).cast("long")))
    if rows is not None:
        out = out.union(n.where(F.col("n") != rows).select(F.lit(f"{own}_row_count_mismatch"), F.lit(None).cast("long")))
    return out


def row_identity_check(spark: SparkSession):
    """For model.verify: the first issues of a file, as many as a report may hold."""

    def check(path, rows, options):
        found = row_identity_issues(spark, path, rows, options).orderBy("line", "code").limit(options.limits.max_report_issues + 1).collect()
        return [Issue(r.code, f"line {r.line}" if r.line is not None else "the file") for r in found]

    return check


# ---- registry


#: What a report depends on: eight digests and flags, null where there is none.
KEY = ("manifest_sha256", "artifact_sha256", "row_identity_sha256", "auxiliary_sha256", "calibration_profile_sha256", "encoder_distortion_profile_sha256", "attestations_sha256", "options_sha256")
REPORTS = ", ".join(f"{k} string" for k in KEY) + ", ok boolean, report string, created_at timestamp, seq long"
ACTIVE = "name string, manifest_path string, warnings array<string>, created_at timestamp, seq long"
VERSION = 1


class Registry:
    """Verification reports by what they depend on, and the active manifest, as Parquet tables that only grow.

    The newest row of a key holds, so a reader never sees a table that is being replaced.
    """

    def __init__(self, spark: SparkSession, path: str, limits: Limits = Limits()):
        self.spark, self.path, self.limits = spark, path, limits
        self.init()

    def init(self) -> int:
        """Makes the tables, or checks that they are of a version that this code knows; the version."""
        found = self._read("version", "version int").agg(F.max("version")).first()[0]
        if found is None:
            self._add("version", [(VERSION,)], "version int")
            return VERSION
        if found > VERSION:
            raise ManifestError(f"the registry is of version {found}, this code knows {VERSION}")
        for v in range(found, VERSION):
            self._migrate(v)
        return VERSION

    def _migrate(self, version: int) -> None:
        """From version to the next; tables only grow, so a new version adds columns that older rows leave null."""
        self._add("version", [(version + 1,)], "version int")

    def _read(self, table: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{table}")

    def _add(self, table: str, rows: list[tuple], schema: str) -> None:
        # A folder of its own: writers at work in one folder would clear each other's unfinished files.
        self.spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{self.path}/{table}/{uuid.uuid4().hex}")

    def _claimed(self, table: str, after: int) -> int:
        """The next number of a table, by creating its file where nobody has: of two writers one makes it, the other goes on."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        seq = after
        while True:
            seq += 1
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/numbers/{table}/{seq}")
            fs = p.getFileSystem(conf)
            if fs.exists(p):
                continue
            fs.mkdirs(p.getParent())
            try:
                fs.create(p, False).close()
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in str(e.java_exception) and not fs.exists(p):
                    raise
            else:
                return seq

    def _stamped(self, table: str, row: tuple, schema: str) -> None:
        from datetime import datetime, timezone

        seq = self._claimed(table, self._read(table, schema).agg(F.max("seq")).first()[0] or 0)
        self._add(table, [(*row, datetime.now(timezone.utc), seq)], schema)

    def reports(self) -> DataFrame:
        return self._read("reports", REPORTS)

    def find(self, key: dict[str, str | None]):
        """The newest report of a key, missing parts being null."""
        same = self.reports()
        for k in KEY:
            same = same.where(F.col(k).eqNullSafe(F.lit(key.get(k)).cast("string")))
        newest = Window.partitionBy(*KEY).orderBy(F.desc("created_at"), F.desc("seq"))
        return same.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n").first()

    def put(self, key: dict[str, str | None], report: Report) -> None:
        text = json.dumps({"ok": report.ok, "errors": [asdict(i) for i in report.errors], "warnings": [asdict(i) for i in report.warnings], "skipped": report.skipped}, sort_keys=True)
        if len(text.encode()) > self.limits.max_cached_report_bytes:
            raise ManifestError("the report is too large for the registry", "sqlite_cached_report_too_large")
        self._stamped("reports", (*(key.get(k) for k in KEY), report.ok, text), REPORTS)

    def verify(self, key: dict[str, str | None], work) -> tuple[bool, list[str], bool]:
        """(ok, error codes, from the registry); work() makes a report where there is none."""
        row = self.find(key)
        if row is not None and len(row.report.encode()) <= self.limits.max_cached_report_bytes:
            return row.ok, [i["code"] for i in json.loads(row.report)["errors"]], True
        report = work()
        self.put(key, report)
        return report.ok, [i.code for i in report.errors], False

    def activate(self, name: str, report: Report, manifest_path: str = "", force: bool = False) -> list[str]:
        """Makes name the active index; warnings. A report with errors needs force."""
        if not report.ok and not force:
            raise ValueError("the report has errors")
        warnings = [] if report.ok else ["activated in spite of errors"]
        self._stamped("active", (name, manifest_path, warnings), ACTIVE)
        return warnings

    def active(self) -> str | None:
        row = self._read("active", ACTIVE).orderBy(F.desc("seq")).first()
        return row and row.name


def report_key(doc_text: str, doc: dict, report: Report, options: Options) -> dict[str, str | None]:
    """The key of a report on a manifest's text, by the digests of the files that were read."""
    from rankmill.manifest.files import sha256_bytes

    aux = sorted((n, d) for n, d in report.digests.items() if n not in ("artifact", "row_identity", "calibration_profile", "encoder_distortion_profile"))
    att = doc.get("attestations")
    return {
        "manifest_sha256": sha256_bytes(doc_text.encode()), "artifact_sha256": report.digests.get("artifact"), "row_identity_sha256": report.digests.get("row_identity"),
        "auxiliary_sha256": sha256_bytes(json.dumps(aux).encode()) if aux else None, "calibration_profile_sha256": report.digests.get("calibration_profile"),
        "encoder_distortion_profile_sha256": report.digests.get("encoder_distortion_profile"), "attestations_sha256": sha256_bytes(json.dumps(att, sort_keys=True).encode()) if att else None,
        "options_sha256": sha256_bytes(json.dumps(asdict(options), sort_keys=True).encode()),
    }
