"""Manifest documents: reading, writing, and the rules they must keep.

A rule that is broken is an issue (code, message, and digests or sizes where they matter). Issues are collected, not
raised, so that one pass finds all of them.
"""

from __future__ import annotations

import json
import math
import os
import re
import tempfile
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path

from rankmill.manifest import schema
from rankmill.manifest.files import is_absolute, is_canonical, resolve, sha256_file
from rankmill.manifest.issues import Issue, Limits, ManifestError, Report
from rankmill.sources.formats import FormatError, probe

SHA256 = re.compile(r"^[0-9a-f]{64}$")
TIME = re.compile(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$")
#: Kinds of index files, as manifests call them; the one that isn't here has no manifest.
KIND_OF = {"rank": "rank", "buckets": "rank_quant", "bitmap": "bitmap", "sign": "sign_bitmap"}


@dataclass(frozen=True)
class Options:
    allow_absolute_paths: bool = False
    allow_path_escape: bool = False
    allow_duplicate_db_ids: bool = False
    index_override: str | None = None
    limits: Limits = field(default_factory=Limits)


def load(path: str | os.PathLike, limits: Limits = Limits()) -> dict:
    """The document of a manifest file; an error if it is too large, no JSON, or not of the shape."""
    if os.path.getsize(path) > limits.max_manifest_bytes:
        raise ManifestError("the manifest is too large", "manifest_file_too_large")
    return loads(Path(path).read_text(encoding="utf-8"))


def loads(text: str) -> dict:
    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ManifestError("a key stands twice")
        return dict(pairs)

    try:
        doc = json.loads(text, object_pairs_hook=once)
    except json.JSONDecodeError as e:
        raise ManifestError(f"not a JSON document: {e}") from e
    version = doc.get("schema_version") if isinstance(doc, dict) else None
    m = schema.VERSION.match(version) if isinstance(version, str) else None
    if m and m[2] == "index_manifest" and m[3] == "1":
        raise ManifestError("version 1 manifests must be written again as version 2", "schema_version_unsupported")
    if version is not None and not schema.is_version("index_manifest", version):
        raise ManifestError(f"unknown schema version {version}", "schema_version_unsupported")
    schema.check(doc)
    return doc


# ---- rules on single values


def _filled(report: Report, part: dict, subject: str, required=(), optional=()) -> None:
    for name in required:
        report.need(bool(part[name].strip()), f"{subject}_{name}_empty", f"{name} is empty")
    for name in optional:
        report.need(part.get(name) is None or bool(part[name].strip()), f"{subject}_{name}_empty", f"{name} is empty")


def _above_zero(report: Report, part: dict, codes: dict[str, str]) -> None:
    for name, code in codes.items():
        report.need(part.get(name) is None or part[name] > 0, code, f"{name} is 0")


def _digest(report: Report, value: str | None, code: str, uri: bool = False) -> None:
    if value is not None:
        bare = value.removeprefix("sha256:") if uri else value
        report.need((not uri or value.startswith("sha256:")) and bool(SHA256.match(bare)), code, f"{value} isn't a SHA-256 digest")


def _path(report: Report, name: str, subject: str, options: Options) -> None:
    if not name.strip():
        report.error(f"{subject}_path_empty", "the path is empty")
    elif not is_absolute(name):
        report.need(is_canonical(name, options.allow_path_escape), f"{subject}_path_not_canonical", f"{name} isn't written with single forward slashes and names only")


def _time(report: Report, value: str | None, code: str) -> None:
    good = value is None
    if value is not None and TIME.match(value):
        try:
            good = datetime.fromisoformat(value.upper().replace("Z", "+00:00")) is not None
        except ValueError:
            good = False
    report.need(good, code, f"{value} isn't a time with a zone")


def _same(report: Report, expected, observed, code: str) -> None:
    report.need(expected == observed, code, f"{observed!r} isn't the embedding's {expected!r}")


# ---- rules that need no file


def shape_issues(doc: dict, options: Options = Options()) -> Report:
    r, art, emb, ident = Report(), doc["artifact"], doc["embedding"], doc["row_identity"]
    r.need(schema.is_version("index_manifest", doc["schema_version"]), "schema_version_unsupported", "unknown schema version")
    _filled(r, emb, "embedding", ("model",), ("model_revision", "tokenizer_revision", "pooling", "normalization"))
    _above_zero(r, emb, {"dim": "embedding_dim_zero"})
    _digest(r, emb.get("corpus_digest"), "embedding_corpus_digest_invalid")
    _digest(r, emb.get("embedding_matrix_digest"), "embedding_matrix_digest_invalid")
    _path(r, art["path"], "artifact", options)
    _digest(r, art["sha256"], "artifact_sha256_invalid")
    _above_zero(r, art, {"file_size_bytes": "artifact_file_size_zero", "bytes_per_vec": "artifact_bytes_per_vec_zero"})
    r.need(art["dim"] == emb["dim"], "artifact_embedding_dim_mismatch", "artifact and embedding differ in dim")
    r.need(art["params"]["kind"] == art["kind"], "artifact_params_kind_mismatch", "the parameters are of another kind")
    r.need(art["vector_count"] == ident["row_count"], "artifact_row_count_mismatch", "artifact and row identity differ in rows")
    if ident["kind"] == "jsonl":
        _path(r, ident["path"], "row_identity", options)
        _digest(r, ident["sha256"], "row_identity_sha256_invalid")
        r.need(ident["id_kind"] == "uuid", "row_identity_id_kind_unsupported", "ids must be of kind uuid")
        r.need(ident.get("db") is None, "row_identity_db_unsupported", "db is reserved")
    aux = doc.get("auxiliary_artifacts") or []
    if len(aux) > options.limits.max_auxiliary_artifacts:
        r.error("auxiliary_artifact_count_limit_exceeded", f"more than {options.limits.max_auxiliary_artifacts} auxiliary artifacts")
    else:
        names = set()
        for a in aux:
            if not a["name"].strip():
                r.error("auxiliary_artifact_name_empty", "a name is empty")
            elif a["name"] != a["name"].strip():
                r.error("auxiliary_artifact_name_not_trimmed", f"{a['name']!r} has white space around it")
            r.need(a["name"] not in names, "auxiliary_artifact_name_duplicate", f"{a['name']!r} stands twice")
            names.add(a["name"])
            _path(r, a["path"], "auxiliary_artifact", options)
            _digest(r, a["sha256"], "auxiliary_artifact_sha256_invalid")
            _above_zero(r, a, {"file_size_bytes": "auxiliary_artifact_file_size_zero"})
    if build := doc.get("build"):
        _filled(r, build, "build", ("invocation_id",), ("builder_id", "source_repo", "source_commit", "ci_provider", "ci_run_id"))
    for key in doc.get("extensions") or {}:
        r.need(bool(re.match(r"^[^\s./:]+[./:]\S+$", key)), "extension_key_not_namespaced", f"{key!r} has no namespace")
    return r


# The ordinalization that an artifact's kind takes, with the parameter that must agree; what its profile holds.
_ORDINALIZED = {"bitmap": {"top_k": ("n_top", "k")}, "rank_quant": {"bucket": ("bits", "bits")}, "sign_bitmap": {"sign": None}, "rank": {"rank_position": None, "caller_defined": None}}
_PROFILED = {"top_k": "marginal_topk_frequency", "bucket": "bucket_frequency", "sign": "sign_frequency", "rank_position": "rank_position_frequency"}
_VALUE_BYTES = {"raw_f64_le": 8, "raw_f32_le": 4}


def _encoder_issues(r: Report, subject: str, encoder: dict, emb: dict) -> None:
    _filled(r, encoder, f"{subject}_encoder", ("model",), ("model_revision", "normalization"))
    _above_zero(r, encoder, {"dim": f"{subject}_encoder_dim_zero"})
    for name in ("model", "dim", "model_revision", "normalization"):
        _same(r, emb.get(name), encoder.get(name), f"{subject}_encoder_{name}_mismatch")


def profile_shape(parameterization: str, ordinalization: dict) -> list[int] | None:
    """The shape that a profile's values have; None: any."""
    dim = ordinalization["dim"]
    if parameterization in ("marginal_topk_frequency", "sign_frequency"):
        return [dim]
    if parameterization == "rank_position_frequency":
        return [dim, dim]
    if parameterization == "bucket_frequency" and ordinalization["kind"] == "bucket" and ordinalization["bits"] in (1, 2, 4):
        return [dim, 1 << ordinalization["bits"]]
    return None


def calibration_issues(doc: dict, options: Options = Options()) -> Report:
    r, cal, art = Report(), doc.get("calibration"), doc["artifact"]
    if not cal:
        return r
    how, null = cal["ordinalization"], cal["null_model"]
    r.need(schema.is_version("calibration", cal["schema_version"]), "calibration_schema_version_unsupported", "unknown schema version")
    r.need(bool(cal["profile_id"].strip()), "calibration_profile_id_empty", "profile_id is empty")
    _time(r, cal.get("created_at"), "calibration_created_at_invalid")
    _encoder_issues(r, "calibration", cal["calibrated_for"], doc["embedding"])
    r.need(how["dim"] > 0, "calibration_ordinalization_dim_zero", "dim is 0")
    fits = {"top_k": how.get("k", 1) > 0, "bucket": how.get("bits", 1) in (1, 2, 4), "caller_defined": bool(str(how.get("name", "x")).strip())}
    r.need(fits.get(how["kind"], True), "calibration_ordinalization_artifact_mismatch", "the ordinalization's parameter is out of range")
    if null["kind"] == "empirical_tail_table":
        r.need(bool(null["statistic"].strip()), "calibration_null_statistic_empty", "statistic is empty")
    if null["kind"] == "caller_defined":
        _filled(r, null, "calibration_null", ("name",), ("parameterization",))
    r.need(how["dim"] == art["dim"], "calibration_ordinalization_dim_mismatch", "the ordinalization is of another dim than the artifact")
    known = _ORDINALIZED.get(art["kind"], {}) if art["params"]["kind"] == art["kind"] else {}
    agree = known.get(how["kind"])
    r.need(how["kind"] in known and (agree is None or art["params"][agree[0]] == how[agree[1]]), "calibration_ordinalization_artifact_mismatch", "the artifact isn't ordinalized like that")
    uniform = null["kind"] == "uniform_hypergeometric"
    r.need(not uniform or how["kind"] == "top_k", "calibration_null_model_ordinalization_mismatch", "the uniform model is one of top k sets")
    profile = cal.get("profile")
    if uniform or profile is None:
        r.need(not (uniform and profile), "calibration_profile_unexpected", "the uniform model has no profile")
        r.need(uniform, "calibration_profile_required", "this null model needs a profile")
        return r
    _profile_issues(r, "calibration_profile", profile, options)
    r.need(profile["dim"] == art["dim"], "calibration_profile_dim_mismatch", "the profile is of another dim")
    _above_zero(r, profile, {"sample_count": "calibration_profile_sample_count_zero"})
    kind = profile["parameterization"]
    asked = null["parameterization"] if null["kind"] == "weighted_marginal_profile" else "empirical_tail_table" if null["kind"] == "empirical_tail_table" else kind
    r.need(kind == asked, "calibration_null_parameterization_mismatch", f"the null model asks for {asked}")
    r.need(how["kind"] == "caller_defined" or kind in (_PROFILED[how["kind"]], "empirical_tail_table"), "calibration_profile_parameterization_ordinalization_mismatch", f"{kind} doesn't describe {how['kind']}")
    shape = profile.get("shape") or []
    if shape:
        want = profile_shape(kind, how)
        r.need(want is None or shape == want, "calibration_profile_shape_mismatch", f"the shape is {shape}, not {want}")
        if each := _VALUE_BYTES.get(profile["format"]):
            size = math.prod(shape) * each
            r.need(size < 1 << 64, "calibration_profile_shape_mismatch", "the shape is too large")
            r.need(size >= 1 << 64 or size == profile["file_size_bytes"], "calibration_profile_file_size_mismatch", f"a profile of this shape has {size} bytes")
    return r


def _profile_issues(r: Report, subject: str, profile: dict, options: Options) -> None:
    _path(r, profile["path"], subject, options)
    _digest(r, profile["sha256"], f"{subject}_sha256_invalid")
    _above_zero(r, profile, {"file_size_bytes": f"{subject}_file_size_zero"})
    _filled(r, profile, subject, ("format",))
    _digest(r, profile.get("source_digest"), f"{subject}_source_digest_invalid", uri=True)


def distortion_issues(doc: dict, options: Options = Options()) -> Report:
    r, d, emb = Report(), doc.get("encoder_distortion"), doc["embedding"]
    if not d:
        return r
    own = "encoder_distortion"
    r.need(schema.is_version(own, d["schema_version"]), f"{own}_schema_version_unsupported", "unknown schema version")
    r.need(bool(d["profile_id"].strip()), f"{own}_profile_id_empty", "profile_id is empty")
    _time(r, d.get("created_at"), f"{own}_created_at_invalid")
    _encoder_issues(r, own, d["encoder"], emb)
    _filled(r, d, own, optional=("tokenizer_revision", "pooling"))
    for name in ("tokenizer_revision", "pooling"):
        _same(r, emb.get(name), d.get(name), f"{own}_{name}_mismatch")
    for name in ("source_metric", "embedding_metric"):
        _filled(r, d[name], f"{own}_{name}", ("name",), ("version",))
        _digest(r, d[name].get("digest"), f"{own}_{name}_digest_invalid", uri=True)
    _bounds_issues(r, d["bounds"])
    scope = d["scope"]
    for name in ("corpus_digest", "query_set_digest", "pair_sample_digest"):
        _digest(r, scope.get(name), f"{own}_scope_{name}_invalid", uri=True)
    _filled(r, scope, f"{own}_scope", optional=("domain", "estimator_version"))
    _above_zero(r, scope, {"sample_size": f"{own}_scope_sample_size_zero"})
    for name in ("confidence", "coverage"):
        x = scope.get(name)
        r.need(x is None or math.isfinite(x) and 0 <= x <= 1, f"{own}_scope_{name}_invalid", f"{name} isn't from 0 to 1")
    _filled(r, d["evidence"], f"{own}_evidence", optional=("estimator_id",))
    _digest(r, d["evidence"].get("estimator_hash"), f"{own}_evidence_estimator_hash_invalid", uri=True)
    if d.get("profile") is None:
        r.need(d["evidence"]["kind"] == "caller_asserted", f"{own}_profile_required", "this evidence needs a profile")
    else:
        _profile_issues(r, f"{own}_profile", d["profile"], options)
    name, cal = d.get("calibration_profile_id"), doc.get("calibration")
    if name is not None:
        if not name.strip():
            r.error(f"{own}_calibration_profile_id_empty", "calibration_profile_id is empty")
        elif name != name.strip():
            r.error(f"{own}_calibration_profile_id_whitespace", "calibration_profile_id has white space around it")
        elif not cal:
            r.error(f"{own}_calibration_missing", "there is no calibration")
        else:
            r.need(cal["profile_id"] == name, f"{own}_calibration_profile_mismatch", "the calibration is another one")
    return r


def _bounds_issues(r: Report, b: dict) -> None:
    own, get = "encoder_distortion", b.get
    r.need(any(v is not None for v in b.values()), f"{own}_bounds_empty", "no bound is given")
    # What each number must be.
    rules = {
        "declared_lower_bound": ("lower_bound", lambda x: x > 0), "declared_upper_bound": ("upper_bound", lambda x: x > 0), "estimated_distortion": ("estimated_distortion", lambda x: x > 0),
        "violation_rate": ("violation_rate", lambda x: 0 <= x <= 1), "max_observed_violation": ("max_observed_violation", lambda x: x >= 0), "quantile_observed_violation": ("quantile_observed_violation", lambda x: x >= 0),
    }
    for name, (code, held) in rules.items():
        x = get(name)
        r.need(x is None or math.isfinite(x) and held(x), f"{own}_{code}_invalid", f"{name} is out of range")
    low, high, told = get("declared_lower_bound"), get("declared_upper_bound"), get("estimated_distortion")
    if low is not None and high is not None and math.isfinite(low) and math.isfinite(high):
        r.need(low <= high, f"{own}_bounds_order_invalid", "the lower bound is above the upper one")
        if low > 0 and high > 0 and told is not None:
            ratio = high / low
            r.need(math.isfinite(ratio) and (not math.isfinite(told) or abs(told - ratio) <= max(1e-9, ratio * 1e-9)), f"{own}_distortion_mismatch", f"the bounds make a distortion of {ratio}")


def attestation_issues(doc: dict, digest: str) -> Report:
    r, found = Report(), False
    if not doc.get("attestations"):
        r.skipped.append("attestations_absent")
        return r
    at = lambda x, *keys: at(x.get(keys[0]), *keys[1:]) if keys and isinstance(x, dict) else None if keys else x
    for i, a in enumerate(doc["attestations"]):
        kind = next((k for k in (at(a, "predicateType"), at(a, "predicate_type")) if k is not None), None)
        kind = kind if isinstance(kind, str) else None
        r.need(kind is not None, "attestation_predicate_type_missing", f"attestation {i} has no predicate type")
        builder = at(a, "predicate", "builder", "id") or at(a, "predicate", "runDetails", "builder", "id")
        subjects = at(a, "subject")
        held = any(str(at(s, "digest", "sha256")).lower() == digest.lower() for s in subjects) if isinstance(subjects, list) else False
        r.attestations.append({"predicate_type": kind, "builder_id": builder if isinstance(builder, str) else None, "subject_sha256_matched": held})
        found |= held
    r.need(found, "attestation_subject_sha256_mismatch", "no subject of an attestation has the artifact's digest")
    return r


# ---- rules on files


def _compare_file(r: Report, path: Path, told: dict, subject: str, limit: int, name: str | None = None) -> tuple[str, int] | None:
    """Digest and size of path against those told; no more bytes are read than told or allowed."""
    try:
        digest, size = sha256_file(path, min(told["file_size_bytes"], limit), f"{subject}_too_large" if subject.endswith("profile") else f"{subject}_file_too_large")
    except ManifestError as e:
        r.error(e.code or f"{subject}_hash_failed", str(e), artifact_name=name)
        return None
    except OSError as e:
        r.error(f"{subject}_hash_failed", str(e), artifact_name=name)
        return None
    if digest != told["sha256"].lower():
        r.error(f"{subject}_sha256_mismatch", "the digest is another", artifact_name=name, expected_sha256=told["sha256"], actual_sha256=digest)
    if size != told["file_size_bytes"]:
        r.error(f"{subject}_file_size_mismatch", "the size is another", artifact_name=name, expected_size_bytes=told["file_size_bytes"], actual_size_bytes=size)
    return digest, size


def metadata_issues(art: dict, path: str | os.PathLike) -> Report:
    """What the header of an index file says against what the manifest does."""
    r = Report()
    try:
        meta = probe(str(path))
    except (OSError, FormatError) as e:
        r.error("artifact_probe_failed", str(e))
        return r
    kind = KIND_OF.get(meta.kind)
    if kind is None:
        r.error("artifact_kind_unsupported", f"files of kind {meta.kind} have no manifest")
        return r
    params = {"kind": kind, **{k: v for k, v in (("bits", meta.bits), ("n_top", meta.n_top)) if v is not None}}
    seen = {"kind": kind, "params": params, "format_version": meta.format_version, "dim": meta.dim, "vector_count": meta.vector_count, "bytes_per_vec": meta.bytes_per_vec}
    for name, value in seen.items():
        r.need(art[name] == value, f"artifact_{name}_mismatch", f"{name} is {value}, the manifest says {art[name]}")
    r.need(art["file_size_bytes"] == meta.file_size_bytes, "artifact_metadata_file_size_mismatch", f"the header asks for {meta.file_size_bytes} bytes")
    return r


def _auxiliary(doc: dict, base: Path, options: Options, r: Report) -> None:
    aux = doc.get("auxiliary_artifacts") or []
    if len(aux) > options.limits.max_auxiliary_artifacts:
        return
    for a in sorted(aux, key=lambda a: (a["name"], a["path"], a.get("required", True))):
        state = {"name": a["name"], "required": a.get("required", True), "state": "failed", "code": None}
        r.auxiliary.append(state)
        if not a["path"].strip():
            state["code"] = "auxiliary_artifact_path_empty"
            continue
        own = "auxiliary_artifact"
        path, issue = resolve(base, a["path"], own, options.allow_absolute_paths, options.allow_path_escape)
        if issue and issue.code == f"{own}_path_unavailable" and not os.path.lexists(base / a["path"]):
            missing = "optional_absent" if not state["required"] else "missing_required"
            state |= {"state": missing, "code": f"{own}_{missing}"}
            if state["required"]:
                r.error(f"{own}_missing_required", "a required file is missing", artifact_name=a["name"])
            continue
        if issue:
            state["code"] = issue.code
            r.error(issue.code, issue.message, artifact_name=a["name"])
            continue
        before = len(r.errors)
        found = _compare_file(r, path, a, own, options.limits.max_auxiliary_artifact_bytes, a["name"])
        if found and len(r.errors) == before:
            state["state"] = "verified"
            r.paths[a["name"]], r.digests[a["name"]] = str(path), found[0]
        else:
            state["code"] = r.errors[before].code


def verify(doc: dict, base: str | os.PathLike, options: Options = Options(), rows=None) -> Report:
    """All rules on a document and the files it names, relative to base.

    rows(path, row_count, options): issues of a row identity file (tables.row_identity_check); without it that file is
    hashed, and its rows are not looked at.
    """
    base, limits = Path(base), options.limits
    r, art, ident = shape_issues(doc, options), doc["artifact"], doc["row_identity"]
    name = options.index_override or art["path"]
    path, issue = resolve(base, name, "artifact", options.allow_absolute_paths or options.index_override is not None, options.allow_path_escape or options.index_override is not None)
    digest = art["sha256"]
    if issue:
        r.errors.append(issue)
    else:
        found = _compare_file(r, path, art, "artifact", limits.max_index_artifact_bytes)
        digest = found[0] if found else digest
        r.errors += metadata_issues(art, path).errors
        r.paths["artifact"], r.digests["artifact"] = str(path), digest
    _auxiliary(doc, base, options, r)
    if ident["kind"] == "jsonl":
        if ident["row_count"] > limits.max_row_identity_rows:
            r.error("row_identity_row_count_limit_exceeded", f"more than {limits.max_row_identity_rows} rows")
        else:
            path, issue = resolve(base, ident["path"], "row_identity", options.allow_absolute_paths, options.allow_path_escape)
            if issue:
                r.errors.append(issue)
            else:
                found, _ = sha256_file(path)
                r.paths["row_identity"], r.digests["row_identity"] = str(path), found
                if found != ident["sha256"].lower():
                    r.error("row_identity_sha256_mismatch", "the digest is another", expected_sha256=ident["sha256"], actual_sha256=found)
                if rows is None:
                    r.skipped.append("row_identity_rows")
                else:
                    r.errors += rows(str(path), ident["row_count"], options)
    for part, issues_of, own, limit in (
        ("encoder_distortion", distortion_issues, "encoder_distortion_profile", limits.max_encoder_distortion_profile_bytes),
        ("calibration", calibration_issues, "calibration_profile", limits.max_calibration_profile_bytes),
    ):
        found = issues_of(doc, options)
        r.errors += found.errors
        profile = (doc.get(part) or {}).get("profile")
        if profile and profile["path"].strip() and not any(i.code == f"{own}_unexpected" for i in found.errors):
            path, issue = resolve(base, profile["path"], own, options.allow_absolute_paths, options.allow_path_escape)
            if issue:
                r.errors.append(issue)
            elif (seen := _compare_file(r, path, profile, own, limit)) is not None:
                r.paths[own], r.digests[own] = str(path), seen[0]
    found = attestation_issues(doc, digest)
    r.errors += found.errors
    r.skipped += found.skipped
    r.attestations = found.attestations
    return r.bounded(limits.max_report_issues)


def verify_for_load(doc: dict, base: str | os.PathLike, options: Options = Options(), rows=None) -> dict[str, str]:
    """The verified paths; an error if any rule is broken."""
    report = verify(doc, base, options, rows)
    if not report.ok:
        raise ManifestError("; ".join(f"{i.code}: {i.message}" for i in report.errors))
    return report.paths


# ---- writing


def create(path: str, base: str | os.PathLike, model: str, auxiliary: list[dict] = (), namespace: str = schema.NAMESPACE, row_identity: dict | None = None, embedding: dict | None = None, **sections) -> dict:
    """A manifest of the index file at path (relative to base), made of what the files are.

    auxiliary: name and path of each, and required where it is not. row_identity: path of a JSON lines file; without it
    rows are their own identity. embedding: more of its fields.
    """
    base = Path(base)

    def file(name: str, subject: str) -> tuple[str, int]:
        real, issue = resolve(base, name, subject)
        if issue:
            raise ManifestError(issue.message, issue.code)
        return sha256_file(real)

    digest, size = file(path, "artifact")
    meta = probe(str(base / path))
    if meta.file_size_bytes != size:
        raise ManifestError("the file changed while it was read")
    kind = KIND_OF[meta.kind]
    params = {"kind": kind, **{k: v for k, v in (("bits", meta.bits), ("n_top", meta.n_top)) if v is not None}}
    art = {"path": path, "sha256": digest, "kind": kind, "format_version": meta.format_version, "dim": meta.dim, "vector_count": meta.vector_count, "bytes_per_vec": meta.bytes_per_vec, "params": params, "file_size_bytes": size}
    aux = []
    for a in sorted(auxiliary, key=lambda a: (a["name"], a["path"])):
        d, n = file(a["path"], "auxiliary_artifact")
        aux.append({"name": a["name"], "path": a["path"], "sha256": d, "file_size_bytes": n, **({"required": False} if not a.get("required", True) else {})})
    if row_identity:
        ident = {"kind": "jsonl", "path": row_identity["path"], "sha256": file(row_identity["path"], "row_identity")[0], "row_count": meta.vector_count, "id_kind": "uuid"}
    else:
        ident = {"kind": "row_id_identity", "row_count": meta.vector_count}
    doc = {"schema_version": schema.version_of("index_manifest", namespace), "artifact": art, "auxiliary_artifacts": aux, "embedding": {"model": model, "dim": meta.dim, **(embedding or {})}, "row_identity": ident, **sections}
    doc = {k: v for k, v in doc.items() if v not in (None, [], {})}
    schema.check(doc)
    return doc


def _ordered(value, shape):
    """value with its fields in the order of shape; fields of free parts by name."""
    if isinstance(shape, dict) and isinstance(value, dict):
        if "@kind" in shape:
            shape = {"kind": schema.TEXT, **shape["@kind"][value["kind"]]}
        names = [k.lstrip("?") for k in shape]
        return {k: _ordered(value[k], shape.get(k, shape.get(f"?{k}"))) for k in names if value.get(k) is not None}
    if isinstance(shape, list) and isinstance(value, list):
        return [_ordered(x, shape[0]) for x in value]
    if isinstance(value, dict):
        return {k: _ordered(v, None) for k, v in sorted(value.items())}
    return [_ordered(x, None) for x in value] if isinstance(value, list) else value


def dumps(doc: dict) -> str:
    """Always the same text for the same document: fields in the order of the shape, two spaces, no last line end."""
    art = schema.SHAPE["artifact"]
    order = {**schema.SHAPE, "artifact": {k: art[k] for k in ("path", "sha256", "kind", "format_version", "dim", "vector_count", "bytes_per_vec", "params", "file_size_bytes")}}
    return json.dumps(_ordered(doc, order), indent=2, ensure_ascii=False, allow_nan=False)


def write(doc: dict, path: str | os.PathLike) -> None:
    """Replaces path at once, or not at all."""
    text = dumps(doc)
    handle, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


__all__ = ["Issue", "Limits", "ManifestError", "Options", "Report", "create", "dumps", "load", "loads", "verify", "verify_for_load", "write"]
