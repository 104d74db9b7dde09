"""Small files beside the tables: choice of inputs, reports, fingerprints."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path


def one_of(*paths: str) -> str:
    """The one path of several that exists."""
    found = [p for p in paths if os.path.exists(p)]
    if len(found) != 1:
        raise ValueError(f"exactly one of {', '.join(paths)} must exist, found {len(found)}")
    return found[0]


def write_report(report: dict, path: str) -> None:
    """JSON without NaN, written beside its place, parsed again, then moved there."""
    part = Path(path + ".tmp")
    part.write_text(json.dumps(report, ensure_ascii=False, indent=2, allow_nan=False), "utf-8")
    json.loads(part.read_text("utf-8"))
    part.replace(path)


def fingerprint(path: str) -> str:
    """SHA-256 of a file, or of a folder's names and contents in order."""
    root, digest = Path(path), hashlib.sha256()
    for file in [root] if root.is_file() else sorted(p for p in root.rglob("*") if p.is_file()):
        if root.is_dir():
            digest.update(file.relative_to(root).as_posix().encode())
        with file.open("rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
    return digest.hexdigest()
