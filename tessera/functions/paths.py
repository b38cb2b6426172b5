"""Column functions on repository-relative paths and package names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def extension(name: Column) -> Column:
    """After the last dot; empty without one, and for names that only begin with a dot."""
    return F.regexp_extract(name, r".\.([^.]+)$", 1)


def container(path: Column) -> Column:
    """Directory segments of a file."""
    return F.slice(segments(path), F.lit(1), F.size(segments(path)) - 1)


def ancestors(path: Column) -> Column:
    """Directories above, nearest first; the last is '.'."""
    seg = segments(path)
    up = F.when(F.size(seg) > 1, F.transform(F.sequence(F.size(seg) - 1, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(seg, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
    return F.concat(up, F.array(F.lit(".")))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays share."""
    same = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: F.coalesce(z["a"] == z["b"], F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")


def under(path: Column, directory: str) -> Column:
    """Whether a path is a directory or lies in it, by whole segments."""
    return (F.lit(directory) == ".") | (path == directory) | path.startswith(directory + "/")


def package_of_specifier(spec: Column) -> Column:
    """'@scope/pkg/sub' to '@scope/pkg', 'pkg/sub' to 'pkg'; null for relative and absolute paths."""
    seg = F.split(spec, "/")
    return F.when(spec.startswith(".") | spec.startswith("/"), None).when(spec.startswith("@"), F.when(F.size(seg) > 1, F.concat_ws("/", seg[0], F.get(seg, F.lit(1))))).otherwise(seg[0])


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[-_.]+", "_")


def group_candidates(group: Column) -> Column:
    """A group id, and without its last part if it has four or more."""
    seg = F.split(group, r"\.")
    return F.when(F.size(seg) > 3, F.array(group, F.array_join(F.slice(seg, F.lit(1), F.size(seg) - 1), "."))).otherwise(F.array(group))


def glob(pattern: str) -> str:
    """Regular expression of a glob; '**' crosses segments, dotted ones included."""
    out, i = "", 0
    while i < len(pattern):
        if pattern[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif pattern[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a path or a directory above it matches a glob ('x/**' also matches x itself)."""
    rx = "|".join([glob(p) for p in patterns] + [glob(p[:-3]) for p in patterns if p.endswith("/**")])
    return F.exists(F.concat(F.array(path), F.filter(ancestors(path), lambda a: a != ".")), lambda a: a.rlike(rx))
