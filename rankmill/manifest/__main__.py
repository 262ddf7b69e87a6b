"""python -m rankmill.manifest hash|inspect|verify|create|registry: 0 good, 1 a rule is broken, 2 can't be done."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import asdict

from rankmill.manifest import inspect, model
from rankmill.manifest.files import sha256_file
from rankmill.sources.formats import FormatError


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rankmill.manifest")
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("hash", "inspect"):
        sub.add_parser(name).add_argument("path")
    v = sub.add_parser("verify")
    c = sub.add_parser("create")
    c.add_argument("index")
    c.add_argument("out")
    c.add_argument("--model", required=True)
    c.add_argument("--auxiliary", action="append", default=[], metavar="NAME=PATH")
    c.add_argument("--row-identity")
    r = sub.add_parser("registry").add_subparsers(dest="do", required=True)
    rv, ra = r.add_parser("verify"), r.add_parser("activate")
    for x in (rv, ra):
        x.add_argument("registry")
    for x in (v, rv, ra):
        x.add_argument("path")
        x.add_argument("--allow-absolute-paths", action="store_true")
        x.add_argument("--allow-path-escape", action="store_true")
        x.add_argument("--allow-duplicate-db-ids", action="store_true")
    ra.add_argument("--name")
    ra.add_argument("--force", action="store_true")
    return p


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("manifest").config("spark.ui.enabled", "false").getOrCreate()


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    try:
        if a.what == "hash":
            digest, size = sha256_file(a.path)
            print(json.dumps({"sha256": digest, "size_bytes": size}))
        elif a.what == "inspect":
            print(json.dumps(inspect(a.path)))
        elif a.what == "create":
            base = os.path.dirname(os.path.abspath(a.out))
            near = lambda p: os.path.relpath(p, base).replace(os.sep, "/")
            aux = [{"name": n, "path": near(p)} for n, _, p in (x.partition("=") for x in a.auxiliary)]
            model.write(model.create(near(a.index), base, a.model, aux, row_identity={"path": near(a.row_identity)} if a.row_identity else None), a.out)
        else:
            return _verify(a)
    except (OSError, FormatError, model.ManifestError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


def _verify(a) -> int:
    options = model.Options(a.allow_absolute_paths, a.allow_path_escape, a.allow_duplicate_db_ids)
    doc, base, rows = model.load(a.path, options.limits), os.path.dirname(os.path.abspath(a.path)), None
    if doc["row_identity"]["kind"] == "jsonl" or a.what == "registry":
        from rankmill.manifest.tables import row_identity_check

        rows = row_identity_check(_session())
    report = model.verify(doc, base, options, rows)
    shown = {"ok": report.ok, "errors": [asdict(i) for i in report.errors], "skipped": report.skipped, "auxiliary": report.auxiliary}
    if a.what == "registry":
        from rankmill.manifest.tables import Registry, report_key

        registry = Registry(_session(), a.registry)
        key = report_key(open(a.path, encoding="utf-8").read(), doc, report, options)
        if a.do == "verify":
            shown["cached"] = registry.verify(key, lambda: report)[2]
        elif report.ok or a.force:
            shown["warnings"] = registry.activate(a.name or a.path, report, os.path.abspath(a.path), a.force)
            print(json.dumps(shown))
            return 0
    print(json.dumps(shown))
    return 0 if report.ok else 1


if __name__ == "__main__":
    sys.exit(main())
