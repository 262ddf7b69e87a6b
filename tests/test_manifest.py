import copy
import json
import struct

import pytest

from rankmill import manifest
from rankmill.manifest import model, schema
from rankmill.manifest.__main__ import main
from rankmill.manifest.tables import Registry, issues, numbered_lines, report_key, row_identity_check, row_identity_issues

U = "00000000-0000-0000-0000-00000000000"
HEX = "ab" * 32


@pytest.fixture()
def folder(tmp_path):
    """An index file of two rows, two files beside it, and row identities."""
    (tmp_path / "index.ovrq").write_bytes(b"OVRQ" + bytes([1, 2]) + struct.pack("<II", 16, 2) + bytes([0x00, 0x55, 0xAA, 0xFF]) * 2)
    (tmp_path / "aux-a.bin").write_bytes(b"auxiliary")
    (tmp_path / "aux-b.bin").write_bytes(b"other one")
    (tmp_path / "ids.jsonl").write_text("".join(json.dumps({"row_id": i, "db_id": f"{U}{i}"}) + "\n" for i in range(2)))
    return tmp_path


def made(folder, **more):
    aux = [{"name": "aux-b.bin", "path": "aux-b.bin"}, {"name": "aux-a.bin", "path": "aux-a.bin"}]
    return model.create("index.ovrq", folder, "test-embedding", aux, **more)


def codes(doc, folder, options=model.Options(), rows=None):
    return sorted(i.code for i in model.verify(doc, folder, options, rows).errors)


def test_a_manifest_is_written_and_verified(spark, folder):
    doc = made(folder)
    assert list(doc) == ["schema_version", "artifact", "auxiliary_artifacts", "embedding", "row_identity"]
    art = doc["artifact"]
    assert art["kind"] == "rank_quant" and art["params"] == {"kind": "rank_quant", "bits": 2} and (art["bytes_per_vec"], art["file_size_bytes"], art["format_version"]) == (4, 22, 1)
    assert [a["name"] for a in doc["auxiliary_artifacts"]] == ["aux-a.bin", "aux-b.bin"] and doc["row_identity"] == {"kind": "row_id_identity", "row_count": 2}
    text = model.dumps(doc)
    assert text == model.dumps(model.loads(text)) == model.dumps(made(folder)) and list(json.loads(text)["artifact"]) == list(art)
    model.write(doc, folder / "m.json")
    assert model.load(folder / "m.json") == doc
    report = model.verify(doc, folder)
    assert report.ok and [a["state"] for a in report.auxiliary] == ["verified"] * 2 and report.skipped == ["attestations_absent"]
    assert set(model.verify_for_load(doc, folder)) == {"artifact", "aux-a.bin", "aux-b.bin"}
    for namespace in ("rankmill", "other_maker"):
        assert model.loads(model.dumps(made(folder, namespace=namespace)))["schema_version"] == f"{namespace}.index_manifest.v2"
    assert issues(spark, report).count() == 0 and manifest.default_resource_limits()["max_report_issues"] == 1024
    assert manifest.inspect(str(folder / "index.ovrq"))["vector_count"] == 2


@pytest.mark.parametrize(
    ("path", "value"),
    [(("artifact", "extra"), 1), (("artifact", "params", "n_top"), 1), (("embedding", "model"), None), (("artifact", "dim"), -1), (("artifact", "dim"), True), (("artifact", "kind"), "pairs"),
     (("row_identity", "kind"), "x"), (("auxiliary_artifacts",), {}), (("schema_version",), "x.index_manifest.v1"), (("schema_version",), 2), (("extra",), {})],
)
def test_shapes_are_strict(folder, path, value):
    doc = made(folder)
    at = doc
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    if value is None:
        del at[path[-1]]
    with pytest.raises(model.ManifestError):
        model.loads(json.dumps(doc))


def test_documents_that_cannot_be_read(folder):
    for text in ("[]", "{", '{"a": 1, "a": 2}', "{}"):
        with pytest.raises(model.ManifestError):
            model.loads(text)
    (folder / "m.json").write_text(" " * 100)
    with pytest.raises(model.ManifestError) as e:
        model.load(folder / "m.json", model.Limits(max_manifest_bytes=50))
    assert e.value.code == "manifest_file_too_large" and manifest.Issue(e.value.code, "").family == "resource_limit"


#: What is changed in a good document, and the codes that must come of it.
FAULTS = [
    ({"artifact.sha256": HEX}, ["artifact_sha256_mismatch"]), ({"artifact.sha256": "AB"}, ["artifact_sha256_invalid", "artifact_sha256_mismatch"]),
    ({"artifact.file_size_bytes": 23}, ["artifact_file_size_mismatch", "artifact_metadata_file_size_mismatch"]), ({"artifact.file_size_bytes": 5}, ["artifact_file_too_large", "artifact_metadata_file_size_mismatch"]),
    ({"artifact.dim": 32}, ["artifact_dim_mismatch", "artifact_embedding_dim_mismatch"]), ({"artifact.vector_count": 3}, ["artifact_row_count_mismatch", "artifact_vector_count_mismatch"]),
    ({"artifact.bytes_per_vec": 0}, ["artifact_bytes_per_vec_mismatch", "artifact_bytes_per_vec_zero"]), ({"artifact.format_version": 2}, ["artifact_format_version_mismatch"]),
    ({"artifact.params": {"kind": "rank_quant", "bits": 4}}, ["artifact_params_mismatch"]), ({"artifact.params": {"kind": "rank"}}, ["artifact_params_kind_mismatch", "artifact_params_mismatch"]),
    ({"artifact.path": ""}, ["artifact_path_empty", "artifact_probe_failed", "artifact_hash_failed"]), ({"artifact.path": "gone"}, ["artifact_missing"]), ({"artifact.path": "../x"}, ["artifact_path_escape_rejected", "artifact_path_not_canonical"]),
    ({"artifact.path": "/x"}, ["artifact_absolute_path_rejected"]), ({"artifact.path": "C:/x"}, ["artifact_absolute_path_rejected"]), ({"artifact.path": "./index.ovrq"}, ["artifact_path_not_canonical"]),
    ({"artifact.path": "aux-a.bin"}, ["artifact_file_size_mismatch", "artifact_probe_failed", "artifact_sha256_mismatch"]),
    ({"embedding.model": " "}, ["embedding_model_empty"]), ({"embedding.pooling": ""}, ["embedding_pooling_empty"]), ({"embedding.corpus_digest": "x"}, ["embedding_corpus_digest_invalid"]),
    ({"auxiliary_artifacts.0.sha256": HEX}, ["auxiliary_artifact_sha256_mismatch"]), ({"auxiliary_artifacts.0.file_size_bytes": 3}, ["auxiliary_artifact_file_too_large"]),
    ({"auxiliary_artifacts.0.file_size_bytes": 30}, ["auxiliary_artifact_file_size_mismatch"]), ({"auxiliary_artifacts.0.path": "gone"}, ["auxiliary_artifact_missing_required"]),
    ({"auxiliary_artifacts.0.path": "gone", "auxiliary_artifacts.0.required": False}, []), ({"auxiliary_artifacts.0.name": "aux-b.bin"}, ["auxiliary_artifact_name_duplicate"]),
    ({"auxiliary_artifacts.0.name": " a"}, ["auxiliary_artifact_name_not_trimmed"]), ({"auxiliary_artifacts.0.path": "a/../../b"}, ["auxiliary_artifact_path_escape_rejected", "auxiliary_artifact_path_not_canonical"]),
    ({"build": {"invocation_id": "", "ci_run_id": " "}}, ["build_ci_run_id_empty", "build_invocation_id_empty"]), ({"extensions": {"plain": 1, "a.b": 2}}, ["extension_key_not_namespaced"]),
    ({"attestations": [{"predicateType": "p", "subject": [{"digest": {"sha256": HEX}}]}]}, ["attestation_subject_sha256_mismatch"]), ({"attestations": [{}]}, ["attestation_predicate_type_missing", "attestation_subject_sha256_mismatch"]),
    ({"row_identity.row_count": 5}, ["artifact_row_count_mismatch"]),
]


def changed(doc, changes):
    doc = copy.deepcopy(doc)
    for path, value in changes.items():
        at, *rest = doc, *path.split(".")
        for k in rest[:-1]:
            at = at[int(k) if k.isdigit() else k]
        at[rest[-1]] = value
    return doc


@pytest.mark.parametrize(("changes", "want"), FAULTS)
def test_faults_have_their_codes(folder, changes, want):
    assert codes(changed(made(folder), changes), folder) == sorted(want)


def test_links_limits_and_options(folder):
    doc = made(folder)
    (folder / "inner").mkdir()
    (folder / "inner" / "out").symlink_to(folder / "index.ovrq")
    assert codes(changed(doc, {"artifact.path": "out"}), folder / "inner") != []
    moved = changed({**doc, "auxiliary_artifacts": []}, {"artifact.path": "out"})
    assert codes(moved, folder / "inner") == ["artifact_path_escape_rejected"]
    assert codes(moved, folder / "inner", model.Options(allow_path_escape=True)) == []
    whole = changed({**doc, "auxiliary_artifacts": []}, {"artifact.path": str(folder / "index.ovrq")})
    assert codes(whole, folder) == ["artifact_absolute_path_rejected"] and codes(whole, folder, model.Options(allow_absolute_paths=True)) == []
    assert codes(changed(doc, {"artifact.path": "gone"}), folder, model.Options(index_override=str(folder / "index.ovrq"))) == []
    limit = lambda **k: model.Options(limits=model.Limits(**k))
    assert codes(doc, folder, limit(max_auxiliary_artifacts=1)) == ["auxiliary_artifact_count_limit_exceeded"]
    assert codes(doc, folder, limit(max_auxiliary_artifact_bytes=3)) == ["auxiliary_artifact_file_too_large"] * 2
    assert codes(doc, folder, limit(max_index_artifact_bytes=3)) == ["artifact_file_too_large"]
    bad = changed(doc, {"embedding.model": "", "embedding.pooling": "", "artifact.format_version": 9})
    assert codes(bad, folder, limit(max_report_issues=1))[-1] == "verification_report_issue_limit_exceeded" and len(codes(bad, folder, limit(max_report_issues=1))) == 2


def calibrated(folder, **changes):
    (folder / "p.bin").write_bytes(bytes(16 * 4 * 8))
    profile = {"path": "p.bin", "sha256": manifest.sha256_file(folder / "p.bin")[0], "file_size_bytes": 512, "dim": 16, "sample_count": 9, "parameterization": "bucket_frequency", "format": "raw_f64_le", "shape": [16, 4]}
    cal = {"schema_version": schema.version_of("calibration"), "profile_id": "c", "created_at": "2024-05-01T10:00:00Z", "calibrated_for": {"model": "test-embedding", "dim": 16}, "ordinalization": {"kind": "bucket", "dim": 16, "bits": 2},
           "profile": profile, "null_model": {"kind": "weighted_marginal_profile", "parameterization": "bucket_frequency"}}
    dist = {"schema_version": schema.version_of("encoder_distortion"), "profile_id": "d", "encoder": {"model": "test-embedding", "dim": 16}, "source_metric": {"name": "edit"}, "embedding_metric": {"name": "cosine", "digest": f"sha256:{HEX}"},
            "bounds": {"declared_lower_bound": 0.5, "declared_upper_bound": 2.0, "estimated_distortion": 4.0, "violation_rate": 0.1}, "scope": {"sample_size": 5, "confidence": 0.9}, "evidence": {"kind": "caller_asserted"}, "calibration_profile_id": "c"}
    doc = made(folder, calibration=cal, encoder_distortion=dist)
    return changed(doc, changes)


@pytest.mark.parametrize(
    ("changes", "want"),
    [
        ({}, []), ({"calibration.schema_version": "x.calibration.v2"}, ["calibration_schema_version_unsupported"]), ({"calibration.created_at": "yesterday"}, ["calibration_created_at_invalid"]),
        ({"calibration.calibrated_for.model": "m"}, ["calibration_encoder_model_mismatch"]), ({"calibration.calibrated_for.model_revision": "r"}, ["calibration_encoder_model_revision_mismatch"]),
        ({"calibration.ordinalization": {"kind": "bucket", "dim": 16, "bits": 4}}, ["calibration_ordinalization_artifact_mismatch", "calibration_profile_shape_mismatch"]),
        ({"calibration.ordinalization": {"kind": "sign", "dim": 8}}, ["calibration_ordinalization_artifact_mismatch", "calibration_ordinalization_dim_mismatch", "calibration_profile_parameterization_ordinalization_mismatch"]),
        ({"calibration.null_model": {"kind": "uniform_hypergeometric"}}, ["calibration_null_model_ordinalization_mismatch", "calibration_profile_unexpected"]),
        ({"calibration.null_model": {"kind": "empirical_tail_table", "statistic": ""}}, ["calibration_null_parameterization_mismatch", "calibration_null_statistic_empty"]),
        ({"calibration.profile": None}, ["calibration_profile_required"]), ({"calibration.profile.shape": [16, 2]}, ["calibration_profile_file_size_mismatch", "calibration_profile_shape_mismatch"]),
        ({"calibration.profile.sha256": HEX}, ["calibration_profile_sha256_mismatch"]), ({"calibration.profile.source_digest": HEX}, ["calibration_profile_source_digest_invalid"]), ({"calibration.profile.path": "gone"}, ["calibration_profile_path_unavailable"]),
        ({"calibration.profile.sample_count": 0, "calibration.profile.dim": 4}, ["calibration_profile_dim_mismatch", "calibration_profile_sample_count_zero"]),
        ({"encoder_distortion.bounds": {}}, ["encoder_distortion_bounds_empty"]), ({"encoder_distortion.bounds.declared_lower_bound": 3.0}, ["encoder_distortion_bounds_order_invalid", "encoder_distortion_distortion_mismatch"]),
        ({"encoder_distortion.bounds.violation_rate": 1.5}, ["encoder_distortion_violation_rate_invalid"]), ({"encoder_distortion.scope.sample_size": 0, "encoder_distortion.scope.coverage": -1}, ["encoder_distortion_scope_coverage_invalid", "encoder_distortion_scope_sample_size_zero"]),
        ({"encoder_distortion.evidence": {"kind": "certified"}}, ["encoder_distortion_profile_required"]), ({"encoder_distortion.calibration_profile_id": " c"}, ["encoder_distortion_calibration_profile_id_whitespace"]),
        ({"encoder_distortion.calibration_profile_id": "e"}, ["encoder_distortion_calibration_profile_mismatch"]), ({"encoder_distortion.embedding_metric.digest": HEX}, ["encoder_distortion_embedding_metric_digest_invalid"]),
        ({"encoder_distortion.pooling": "mean"}, ["encoder_distortion_pooling_mismatch"]), ({"encoder_distortion.encoder.dim": 0}, ["encoder_distortion_encoder_dim_mismatch", "encoder_distortion_encoder_dim_zero"]),
    ],
)
def test_calibration_and_distortion(folder, changes, want):
    doc = calibrated(folder, **changes)
    schema.check(doc)
    assert codes(doc, folder) == sorted(want)


def test_profile_limits(folder):
    assert codes(calibrated(folder), folder, model.Options(limits=model.Limits(max_calibration_profile_bytes=8))) == ["calibration_profile_too_large"]


def test_attestations(folder):
    doc = made(folder)
    good = {"predicateType": "p", "subject": [{"digest": {"sha256": doc["artifact"]["sha256"].upper()}}], "predicate": {"runDetails": {"builder": {"id": "b"}}}}
    report = model.verify({**doc, "attestations": [good, {"predicate_type": "q"}]}, folder)
    assert report.ok and [(a["predicate_type"], a["builder_id"], a["subject_sha256_matched"]) for a in report.attestations] == [("p", "b", True), ("q", None, False)]


def test_row_identities(spark, folder):
    doc = made(folder, row_identity={"path": "ids.jsonl"})
    check = row_identity_check(spark)
    assert codes(doc, folder, rows=check) == [] and "row_identity_rows" in model.verify(doc, folder).skipped
    lines = [{"row_id": 0, "db_id": f"{U}1"}, "not json", {"row_id": 2, "db_id": f"{U}1", "parent_id": ""}, {"row_id": 9, "db_id": "no"}, {"row_id": 4, "db_id": f"{U}4", "more": 1}, {"row_id": "5", "db_id": f"{U}5"}, {"row_id": 6, "db_id": "a\0b", "parent_id": None}, {"row_id": 7, "db_id": ""}, {"row_id": 8, "db_id": "{" + U + "8}"}]
    (folder / "ids.jsonl").write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\r\n" for x in lines))
    got = {(r.code.removeprefix("row_identity_"), r.line) for r in row_identity_issues(spark, str(folder / "ids.jsonl"), 9).collect()}
    assert got == {("jsonl_invalid_json", 1), ("duplicate_db_id", 2), ("parent_id_empty", 2), ("row_id_mismatch", 3), ("db_id_invalid_uuid", 3), ("jsonl_invalid_json", 4), ("jsonl_invalid_json", 5), ("db_id_contains_nul", 6), ("db_id_empty", 7)}
    found = codes(doc, folder, model.Options(allow_duplicate_db_ids=True), check)
    assert "row_identity_sha256_mismatch" in found and "row_identity_row_count_mismatch" in found and "row_identity_duplicate_db_id" not in found
    tight = model.Options(limits=model.Limits(max_row_identity_jsonl_line_bytes=64, max_row_identity_tracked_db_id_bytes=10))
    got = {r.code for r in row_identity_issues(spark, str(folder / "ids.jsonl"), 9, tight).collect()}
    assert {"row_identity_line_too_large", "row_identity_duplicate_tracking_limit_exceeded"} <= got
    assert codes(doc, folder, model.Options(limits=model.Limits(max_row_identity_rows=1)), check) == ["row_identity_row_count_limit_exceeded"]
    (folder / "ids.jsonl").unlink()
    assert codes(doc, folder, rows=check) == ["row_identity_missing"]


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    (tmp_path / "t").write_text("".join(f"line {i}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000b")
    try:
        got = numbered_lines(spark, str(tmp_path / "t"))
        assert got.where("value <> concat('line ', line)").count() == 0 and got.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_registry(spark, folder):
    doc, text = made(folder), model.dumps(made(folder))
    good, options = model.verify(doc, folder), model.Options()
    bad = model.verify(changed(doc, {"artifact.format_version": 3}), folder)
    reg = Registry(spark, str(folder / "reg"))
    key = report_key(text, doc, good, options)
    assert key["artifact_sha256"] == doc["artifact"]["sha256"] and key["row_identity_sha256"] is None
    assert reg.find(key) is None and reg.verify(key, lambda: bad) == (False, ["artifact_format_version_mismatch"], False)
    assert reg.verify(key, lambda: good) == (False, ["artifact_format_version_mismatch"], True)
    reg.put(key, good)  # the newest holds
    assert reg.verify(key, lambda: bad) == (True, [], True)
    assert reg.find({**key, "options_sha256": "other"}) is None and reg.find({**key, "row_identity_sha256": "x"}) is None
    with pytest.raises(ValueError, match="errors"):
        reg.activate("x", bad)
    assert reg.active() is None and reg.activate("x", good) == [] and reg.active() == "x"
    assert reg.activate("y", bad, force=True) and reg.active() == "y" and Registry(spark, str(folder / "reg")).active() == "y"
    with pytest.raises(model.ManifestError) as e:
        Registry(spark, str(folder / "reg"), model.Limits(max_cached_report_bytes=10)).put(key, bad)
    assert e.value.code == "sqlite_cached_report_too_large"
    reg._add("version", [(99,)], "version int")
    with pytest.raises(model.ManifestError, match="version 99"):
        Registry(spark, str(folder / "reg"))


def test_command_line(spark, folder, capsys):
    m = str(folder / "m.json")
    assert main(["create", str(folder / "index.ovrq"), m, "--model", "e", "--auxiliary", f"a={folder / 'aux-a.bin'}", "--row-identity", str(folder / "ids.jsonl")]) == 0
    assert main(["verify", m]) == 0 and main(["hash", m]) == 0 and main(["inspect", str(folder / "index.ovrq")]) == 0
    assert main(["hash", str(folder / "nothing")]) == 2 and main(["inspect", m]) == 2
    reg = str(folder / "registry")
    assert main(["registry", "verify", reg, m]) == 0 and main(["registry", "activate", reg, m, "--name", "one"]) == 0
    capsys.readouterr()
    assert main(["registry", "verify", reg, m]) == 0 and json.loads(capsys.readouterr().out)["cached"]
    (folder / "aux-a.bin").write_bytes(b"tampered!")
    assert main(["verify", m]) == 1 and main(["registry", "activate", reg, m]) == 1 and main(["registry", "activate", reg, m, "--name", "two", "--force"]) == 0
    assert Registry(spark, reg).active() == "two"
