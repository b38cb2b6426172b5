"""A source tree as rows: a pruned walk, then texts read in parallel. The root has to be visible to the executors."""

from __future__ import annotations

import json
import os
import posixpath as pp
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tessera.functions.languages import EXCLUDED, LANGUAGE
from tessera.functions.paths import glob
from tessera.plans.session import ship, width

# Files that describe packages.
MANIFESTS = ["package.json", "go.mod", "Cargo.toml", "pom.xml", "build.gradle.kts", "build.gradle", "pyproject.toml"]
# Files that pin versions of dependencies.
LOCKFILES = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "go.sum", "Cargo.lock"]


def config(root: str, path: str | None = None) -> dict:
    """outDir and exclude of tessera.config.json; a missing file gives the defaults, an unknown key or a wrong type an error."""
    file = Path(path) if path else Path(root) / "tessera.config.json"
    if path is None and not file.exists():
        return {"outDir": ".tessera", "exclude": list(EXCLUDED)}
    given = json.loads(file.read_text())
    if not isinstance(given, dict) or set(given) - {"outDir", "exclude"}:
        raise ValueError(f"unknown keys in {file}")
    if not isinstance(given.get("outDir", ""), str) or not all(isinstance(x, str) for x in given.get("exclude", [])):
        raise ValueError(f"wrong types in {file}")
    return {"outDir": given.get("outDir", ".tessera"), "exclude": EXCLUDED + list(given.get("exclude", []))}


def relaxed_json(text: str) -> object:
    """JSON with comments and trailing commas."""
    quoted = r'("(?:\\.|[^"\\])*")'
    bare = re.sub(quoted + r"|//[^\n]*|/\*.*?\*/", lambda m: m[1] or " ", text, flags=re.S)
    return json.loads(re.sub(quoted + r"|,(?=\s*[}\]])", lambda m: m[1] or "", bare))


def aliases(root: str, name: str = "tsconfig.json", seen: frozenset[str] = frozenset()) -> list[tuple[str, list[str]]]:
    """(pattern, targets below root) of the root tsconfig's paths, else of the files it extends, the last of them first.

    Only the root's file governs, packages' own do not. Targets count from baseUrl, else from the file that states
    them. A file that is missing, is not of that form or extends itself gives none; names of packages to extend are
    not followed.
    """
    file = Path(root, name)
    if name in seen or not file.is_file():
        return []
    try:
        given = relaxed_json(file.read_text("utf-8", "replace").removeprefix("\ufeff"))
    except ValueError:
        return []
    given = given if isinstance(given, dict) else {}
    options = given.get("compilerOptions")
    options = options if isinstance(options, dict) else {}
    if isinstance(options.get("paths"), dict):
        base = options.get("baseUrl")
        at = pp.join(pp.dirname(name), base if isinstance(base, str) else "")
        return [(k, [pp.normpath(pp.join(at, v)) for v in vs if isinstance(v, str)]) for k, vs in options["paths"].items() if isinstance(vs, list)]
    more = given.get("extends", [])
    for up in reversed(more if isinstance(more, list) else [more]):
        if isinstance(up, str) and up.startswith("."):
            up = pp.normpath(pp.join(pp.dirname(name), up))
            got = aliases(root, up if up.endswith(".json") else up + ".json", seen | {name})
            if got:
                return got
    return []


def ignore_rules(text: str) -> list[tuple[str, bool, bool]]:
    """(regular expression, negated, directories only) of each line of an ignore file."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        folder = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        body = glob(line.lstrip("/"))[1:-1]
        rules.append((("^" if anchored else "^(?:.*/)?") + body + "$", negated, folder))
    return rules


def ignored(path: str, folder: bool, rules: list[tuple[str, bool, bool]]) -> bool:
    """Whether the last rule that fits a path ignores it."""
    out = False
    for rx, negated, only in rules:
        if (folder or not only) and re.match(rx, path):
            out = not negated
    return out


def walk(root: str, exclude: list[str]) -> Iterator[str]:
    """Relative paths of sources, manifests, lockfiles and the root's tsconfig; excluded directories are not entered, links not followed."""
    rx = re.compile("|".join([glob(p) for p in exclude] + [glob(p[:-3]) for p in exclude if p.endswith("/**")]) or "(?!)")
    file = Path(root) / ".gitignore"
    rules = ignore_rules(file.read_text(errors="replace")) if file.exists() else []
    todo = [""]
    while todo:
        here = todo.pop()
        with os.scandir(os.path.join(root, here)) as entries:
            for e in sorted(entries, key=lambda e: e.name):
                rel = f"{here}/{e.name}" if here else e.name
                if e.is_symlink() or rx.match(rel) or ignored(rel, e.is_dir(), rules):
                    continue
                if e.is_dir():
                    todo.append(rel)
                elif e.name in MANIFESTS or e.name in LOCKFILES or rel == "tsconfig.json" or re.search(r".\.([^.]+)$", e.name) and e.name.rsplit(".", 1)[1] in LANGUAGE:
                    yield rel


def texts(spark: SparkSession, root: str, exclude: list[str]) -> DataFrame:
    """path, content of every source and manifest below root; nothing passes through the driver."""
    ship(spark)
    root = os.path.abspath(root)

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.root:
                batch = []
                for p in walk(r, exclude):
                    batch.append(p)
                    if len(batch) == 10_000:
                        yield pd.DataFrame({"path": batch})
                        batch = []
                yield pd.DataFrame({"path": batch}, dtype=object)

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 64):
                part = pdf.path[k : k + 64]
                yield pd.DataFrame({"path": part, "content": [Path(root, p).read_text("utf-8", "replace").removeprefix("﻿") for p in part]}, dtype=object)

    listed = spark.createDataFrame([(root,)], "root string").repartition(1).mapInPandas(names, "path string")
    return listed.repartition(width(spark), "path").mapInPandas(contents, "path string, content string")
