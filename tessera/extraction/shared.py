"""What several languages need of names and dependencies."""

from __future__ import annotations

import re


def normal(name: str) -> str:
    return re.sub("[-_.]+", "_", name.lower())


def prefixes(name: str, separator: str) -> list[tuple[int, str]]:
    """Whole-part prefixes as (priority, key), the longest first."""
    parts = name.split(separator)
    return [(-n, separator.join(parts[:n])) for n in range(len(parts), 0, -1)]
