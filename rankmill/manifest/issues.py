"""Issues that a verification finds, their families, and the limits on what it reads."""

from __future__ import annotations

from dataclasses import dataclass, field

UNBOUNDED = (1 << 64) - 1


@dataclass(frozen=True)
class Limits:
    """Each bounds what verification reads or reports; past it there is an issue."""

    max_manifest_bytes: int = 1 << 20
    max_row_identity_jsonl_line_bytes: int = 64 << 10
    max_row_identity_rows: int = 10_000_000
    max_row_identity_tracked_db_id_bytes: int = 64 << 20
    max_auxiliary_artifacts: int = 1024
    max_auxiliary_artifact_bytes: int = UNBOUNDED
    max_index_artifact_bytes: int = UNBOUNDED
    max_calibration_profile_bytes: int = UNBOUNDED
    max_encoder_distortion_profile_bytes: int = UNBOUNDED
    max_report_issues: int = 1024
    max_cached_report_bytes: int = 4 << 20


# Codes by the family they belong to; all others are of the family unknown.
FAMILIES = {
    "artifact_sha256_mismatch": ("artifact_sha256_mismatch",), "artifact_file_size_mismatch": ("artifact_file_size_mismatch",), "artifact_missing": ("artifact_missing",),
    "auxiliary_sha256_mismatch": ("auxiliary_artifact_sha256_mismatch",), "auxiliary_file_size_mismatch": ("auxiliary_artifact_file_size_mismatch",),
    "auxiliary_missing_required": ("auxiliary_artifact_missing_required",), "row_identity_sha256_mismatch": ("row_identity_sha256_mismatch",),
    "row_identity_row_count_mismatch": ("row_identity_row_count_mismatch",), "row_identity_missing": ("row_identity_missing",), "manifest_schema": ("schema_version_unsupported",),
    "resource_limit": (
        "manifest_file_too_large", "artifact_file_too_large", "auxiliary_artifact_file_too_large", "auxiliary_artifact_count_limit_exceeded", "calibration_profile_too_large",
        "encoder_distortion_profile_too_large", "row_identity_line_too_large", "row_identity_row_count_limit_exceeded", "row_identity_duplicate_tracking_limit_exceeded",
        "sqlite_cached_report_too_large", "verification_report_issue_limit_exceeded",
    ),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


class ManifestError(ValueError):
    """A manifest that can't be read, or may not be loaded; code: that of a limit, where one was passed."""

    def __init__(self, message: str, code: str | None = None):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Issue:
    code: str
    message: str
    artifact_name: str | None = None
    expected_sha256: str | None = None
    actual_sha256: str | None = None
    expected_size_bytes: int | None = None
    actual_size_bytes: int | None = None

    @property
    def family(self) -> str:
        return FAMILY_OF.get(self.code, "unknown")


@dataclass
class Report:
    """errors and warnings; skipped: checks that didn't apply; auxiliary: (name, state, code) of each; paths: verified files."""

    errors: list[Issue] = field(default_factory=list)
    warnings: list[Issue] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    auxiliary: list[dict] = field(default_factory=list)
    attestations: list[dict] = field(default_factory=list)
    paths: dict[str, str] = field(default_factory=dict)
    digests: dict[str, str] = field(default_factory=dict)

    def error(self, code: str, message: str, **more) -> None:
        self.errors.append(Issue(code, message, **more))

    def need(self, held: bool, code: str, message: str) -> None:
        if not held:
            self.error(code, message)

    @property
    def ok(self) -> bool:
        return not self.errors

    def bounded(self, most: int) -> Report:
        if len(self.errors) > most:
            del self.errors[most:]
            self.error("verification_report_issue_limit_exceeded", f"more than {most} issues")
        return self
