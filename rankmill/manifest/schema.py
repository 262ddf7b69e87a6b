"""The shape of a manifest: which fields each part has, of which kinds. Unknown fields are refused at every depth."""

from __future__ import annotations

import re

from rankmill.manifest.issues import ManifestError

# Names of fields, kinds and versions, as manifests are exchanged. A leading ? marks a field that may be
# absent; a part whose shape depends on its kind lists them under @kind.
TEXT, WHOLE, NUMBER, FLAG, ANY = "text", "whole", "number", "flag", "any"
_ENCODER = {"model": TEXT, "dim": WHOLE, "?model_revision": TEXT, "?normalization": TEXT}
_METRIC = {"name": TEXT, "?version": TEXT, "?digest": TEXT}
PARAMETERIZATIONS = ("marginal_topk_frequency", "bucket_frequency", "sign_frequency", "rank_position_frequency", "empirical_tail_table")
EVIDENCE = ("certified", "empirical_sample", "benchmark_estimate", "teacher_estimate", "caller_asserted")
KINDS = ("rank", "rank_quant", "bitmap", "sign_bitmap")
SHAPE = {
    "schema_version": TEXT,
    "artifact": {
        "path": TEXT, "sha256": TEXT, "kind": KINDS, "format_version": WHOLE, "dim": WHOLE, "vector_count": WHOLE, "bytes_per_vec": WHOLE, "file_size_bytes": WHOLE,
        "params": {"@kind": {"rank": {}, "rank_quant": {"bits": WHOLE}, "bitmap": {"n_top": WHOLE}, "sign_bitmap": {}}},
    },
    "?auxiliary_artifacts": [{"name": TEXT, "path": TEXT, "sha256": TEXT, "file_size_bytes": WHOLE, "?required": FLAG}],
    "embedding": {"model": TEXT, "dim": WHOLE, **{f"?{k}": TEXT for k in ("model_revision", "tokenizer_revision", "pooling", "corpus_digest", "embedding_matrix_digest", "normalization")}},
    "?encoder_distortion": {
        "schema_version": TEXT, "profile_id": TEXT, "?created_at": TEXT, "encoder": _ENCODER, "?tokenizer_revision": TEXT, "?pooling": TEXT, "source_metric": _METRIC, "embedding_metric": _METRIC,
        "bounds": {f"?{k}": NUMBER for k in ("declared_lower_bound", "declared_upper_bound", "estimated_distortion", "violation_rate", "max_observed_violation", "quantile_observed_violation")},
        "scope": {**{f"?{k}": TEXT for k in ("corpus_digest", "query_set_digest", "pair_sample_digest", "domain", "estimator_version")}, "?sample_size": WHOLE, "?confidence": NUMBER, "?coverage": NUMBER},
        "evidence": {"kind": EVIDENCE, "?estimator_id": TEXT, "?estimator_hash": TEXT},
        "?profile": {"path": TEXT, "sha256": TEXT, "file_size_bytes": WHOLE, "format": TEXT, "?source_digest": TEXT}, "?calibration_profile_id": TEXT,
    },
    "?calibration": {
        "schema_version": TEXT, "profile_id": TEXT, "?created_at": TEXT, "calibrated_for": _ENCODER,
        "ordinalization": {"@kind": {"top_k": {"dim": WHOLE, "k": WHOLE}, "bucket": {"dim": WHOLE, "bits": WHOLE}, "sign": {"dim": WHOLE}, "rank_position": {"dim": WHOLE}, "caller_defined": {"dim": WHOLE, "name": TEXT}}},
        "?profile": {"path": TEXT, "sha256": TEXT, "file_size_bytes": WHOLE, "dim": WHOLE, "sample_count": WHOLE, "parameterization": PARAMETERIZATIONS, "format": TEXT, "?shape": [WHOLE], "?source_digest": TEXT},
        "null_model": {"@kind": {"uniform_hypergeometric": {}, "weighted_marginal_profile": {"parameterization": PARAMETERIZATIONS}, "empirical_tail_table": {"statistic": TEXT}, "caller_defined": {"name": TEXT, "?parameterization": TEXT}}},
    },
    "row_identity": {"@kind": {"row_id_identity": {"row_count": WHOLE}, "jsonl": {"path": TEXT, "sha256": TEXT, "row_count": WHOLE, "id_kind": TEXT, "?db": {"?path": TEXT, "?table": TEXT, "?id_column": TEXT}}}},
    "?build": {"invocation_id": TEXT, **{f"?{k}": TEXT for k in ("builder_id", "source_repo", "source_commit", "ci_provider", "ci_run_id")}},
    "?attestations": [ANY], "?extensions": ANY,
}

#: <namespace>.index_manifest.v2 and the like: the namespace is whoever writes the manifest.
VERSION = re.compile(r"^([a-z][a-z0-9_-]*)\.(index_manifest|calibration|encoder_distortion)\.v([0-9]+)$")
VERSIONS = {"index_manifest": 2, "calibration": 1, "encoder_distortion": 1}
NAMESPACE = "rankmill"


def version_of(part: str, namespace: str = NAMESPACE) -> str:
    return f"{namespace}.{part}.v{VERSIONS[part]}"


def is_version(part: str, value) -> bool:
    m = VERSION.match(value) if isinstance(value, str) else None
    return bool(m) and m[2] == part and int(m[3]) == VERSIONS[part]


def _fits(kind: str, x) -> bool:
    if kind == TEXT:
        return isinstance(x, str)
    if kind == FLAG:
        return isinstance(x, bool)
    whole = isinstance(x, int) and not isinstance(x, bool)
    return kind == ANY or kind == WHOLE and whole and x >= 0 or kind == NUMBER and (whole or isinstance(x, float))


def check(value, shape=SHAPE, at: str = "manifest") -> None:
    """Raises at the first place where value hasn't the shape."""
    if isinstance(shape, str):
        if not _fits(shape, value):
            raise ManifestError(f"{at} must be a {shape} value")
    elif isinstance(shape, tuple):
        if value not in shape:
            raise ManifestError(f"{at} must be one of {', '.join(shape)}")
    elif isinstance(shape, list):
        if not isinstance(value, list):
            raise ManifestError(f"{at} must be a list")
        for i, x in enumerate(value):
            check(x, shape[0], f"{at}[{i}]")
    else:
        if not isinstance(value, dict):
            raise ManifestError(f"{at} must be an object")
        if "@kind" in shape:
            kinds = shape["@kind"]
            if value.get("kind") not in kinds:
                raise ManifestError(f"{at}.kind must be one of {', '.join(kinds)}")
            shape = {"kind": TEXT, **kinds[value["kind"]]}
        known = {k.lstrip("?") for k in shape}
        if unknown := sorted(set(value) - known):
            raise ManifestError(f"{at} has unknown fields: {', '.join(unknown)}")
        for k, inner in shape.items():
            name = k.lstrip("?")
            if value.get(name) is not None:
                check(value[name], inner, f"{at}.{name}")
            elif k == name:
                raise ManifestError(f"{at}.{name} is missing")
