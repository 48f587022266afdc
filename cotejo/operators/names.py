"""Naming rules shared by the jobs."""

from __future__ import annotations

import re
from collections.abc import Sequence

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def split_list(text: str | Sequence[str]) -> list[str]:
    """Items of a comma-separated list, or of a sequence, without blanks."""
    if not isinstance(text, str):
        text = ",".join(text)
    return [item.strip() for item in text.split(",") if item.strip()]


def safe_part(name: str) -> str:
    """Lower case letters, digits and single underscores only."""
    clean = re.sub(r"[^a-z0-9]+", "_", str(name).strip().lower()).strip("_")
    if not clean:
        raise ValueError(f"no usable characters in column name {name!r}")
    return clean


def identifier(name: str) -> str:
    """The bare table or column name of ``schema.name``."""
    bare = name.strip().rsplit(".", 1)[-1].strip()
    if not IDENTIFIER.fullmatch(bare):
        raise ValueError(f"not an identifier: {name!r}")
    return bare
