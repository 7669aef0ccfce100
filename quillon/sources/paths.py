"""What paths say about formats, and which formats need a reference."""

from __future__ import annotations

import re


def is_cram_path(path: str) -> bool:
    """Whether a path or URL, without its query and fragment, ends in .cram in any case."""
    return re.sub(r"[?#].*$", "", path, flags=re.S).lower().endswith(".cram")


def output_format(path: str, override: str | None = None) -> str:
    """bam or cram: the override, else by the extension; anything but .cram is bam."""
    if override is not None:
        if override not in ("bam", "cram"):
            raise ValueError(f"unknown output format {override!r}")
        return override
    name = path.rsplit("/", 1)[-1]
    return "cram" if "." in name and name.rsplit(".", 1)[1].lower() == "cram" else "bam"


def check_reference(reference: str | None, *, cram: bool) -> None:
    if cram and reference is None:
        raise ValueError("--reference is required when CRAM is involved")
