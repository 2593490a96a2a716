"""Which BAM file belongs to which input."""

from __future__ import annotations

import re
from pathlib import Path


def find_companion(path: str, folder: str) -> str | None:
    """The first BAM below ``folder`` whose name starts with the input's up to its first dot or ``SJ`` part."""
    stem = re.split(r"\.|_?SJ", Path(path).name)[0]
    return next((str(p) for p in sorted(Path(folder).rglob("*.bam")) if stem and p.name.startswith(stem)), None)


def companions(paths: list[str], bam: str | None) -> dict[str, str | None]:
    """By ``bam``: nothing, ``auto`` (each input's own folder), a folder, one file for all, or a comma list by position."""
    if bam is None:
        return dict.fromkeys(paths)
    if bam == "auto":
        return {p: find_companion(p, str(Path(p).parent)) for p in paths}
    if Path(bam).is_dir():
        return {p: find_companion(p, bam) for p in paths}
    listed = [b for b in bam.split(",") if b]
    return {p: listed[i % len(listed)] for i, p in enumerate(paths)}
