"""Manifests that bind an index file to its embeddings, rows and calibration, and their verification."""

from rankmill.manifest.files import sha256_bytes, sha256_file
from rankmill.manifest.issues import Issue, Limits, ManifestError, Report
from rankmill.manifest.model import Options, create, dumps, load, loads, verify, verify_for_load, write


def default_resource_limits() -> dict[str, int]:
    from dataclasses import asdict

    return asdict(Limits())


def inspect(path: str) -> dict:
    """What the header of an index file says."""
    from dataclasses import asdict

    from rankmill.sources.formats import probe

    return asdict(probe(path))


__all__ = ["Issue", "Limits", "ManifestError", "Options", "Report", "create", "default_resource_limits", "dumps", "inspect", "load", "loads", "sha256_bytes", "sha256_file", "verify", "verify_for_load", "write"]
