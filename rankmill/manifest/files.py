"""Files that a manifest names: where they may be, and their digests."""

from __future__ import annotations

import hashlib
import os
import re
from pathlib import Path

from rankmill.manifest.issues import Issue, ManifestError


def sha256_file(path: str | os.PathLike, limit: int | None = None, code: str | None = None) -> tuple[str, int]:
    """(digest, bytes) of a file of at most limit bytes."""
    h, n = hashlib.sha256(), 0
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            n += len(part)
            if limit is not None and n > limit:
                raise ManifestError(f"{path} has more than {limit} bytes", code)
            h.update(part)
    return h.hexdigest(), n


def sha256_bytes(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def is_absolute(name: str) -> bool:
    """Absolute on any platform: from the root, a drive, or a share."""
    return name.startswith(("/", "\\")) or bool(re.match(r"^[A-Za-z]:", name))


def is_canonical(name: str, allow_escape: bool = False) -> bool:
    """Forward slashes only, without empty parts, . and .. (these last unless a path may leave its folder)."""
    parts = name.split("/")
    return "\\" not in name and "\0" not in name and all(p and p != "." and (allow_escape or p != "..") for p in parts)


def escapes(name: str) -> bool:
    depth = 0
    for p in Path(name).parts:
        depth += -1 if p == ".." else 0 if p == "." else 1
        if depth < 0:
            return True
    return False


def resolve(base: Path, name: str, subject: str, allow_absolute: bool = False, allow_escape: bool = False) -> tuple[Path | None, Issue | None]:
    """(path, issue): an existing file inside base, also when links are followed; subject begins the issue's code."""
    issue = lambda problem, message: (None, Issue(f"{subject}_{problem}", message))
    if is_absolute(name) and not allow_absolute:
        return issue("absolute_path_rejected", f"{name} is absolute")
    if is_absolute(name) != os.path.isabs(name):
        return issue("absolute_path_unresolvable", f"{name} is absolute elsewhere, not here")
    if not base.is_dir():
        return issue("base_dir_unavailable", f"{base} is no folder")
    if not os.path.isabs(name) and not allow_escape and escapes(name):
        return issue("path_escape_rejected", f"{name} leads out of the manifest's folder")
    try:
        real = (base / name).resolve(strict=True)
    except FileNotFoundError:
        return issue("missing" if subject in ("artifact", "row_identity") else "path_unavailable", f"{name} isn't there")
    except (OSError, ValueError, RuntimeError) as e:
        return issue("path_unavailable", f"{name}: {e}")
    if not allow_escape and not real.is_relative_to(base.resolve()):
        return issue("path_escape_rejected", f"{name} leads out of the manifest's folder by a link")
    return real, None
