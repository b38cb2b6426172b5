"""Package manifests as rows: directory, family, name, dependencies with the key that imports look them up by."""

from __future__ import annotations

import json
import os
import posixpath as pp
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.extraction.shared import normal
from tessera.plans.session import ship

SCHEMA = "path string, dir string, family string, prio int, name string, entries array<string>, deps array<struct<ord:int,key:string,name:string,version:string>>"
# Family and order of precedence of each manifest, language of a family's packages.
FAMILY = {"package.json": ("npm", 0), "go.mod": ("go", 0), "Cargo.toml": ("rust", 0), "pom.xml": ("java", 0), "build.gradle.kts": ("java", 1), "build.gradle": ("java", 2), "pyproject.toml": ("python", 0)}
LANGUAGE = {"npm": "typescript", "go": "go", "rust": "rust", "java": "java", "python": "python"}
# Declared versions that name no registry version; a quoted value; group, artifact and version in a Gradle file.
ELSEWHERE = re.compile(r"^(?:workspace|file|link|portal|git|git\+\w+|github|gitlab|bitbucket|https?):|/")
QUOTED = r"\"([^\"]+)\""
COORDINATES = re.compile(r"[\"']([\w.-]+):([\w.-]+):([\w.+-]+)[\"']")


def coordinate(name: str, spec: str) -> tuple[str, str] | None:
    """The registry's name and version of a declared dependency; null for one that lies elsewhere."""
    if spec.startswith("npm:"):
        real, at, version = spec[4:].rpartition("@")
        return (real, version) if at and real and version else None
    return None if ELSEWHERE.search(spec) else (name, spec)


def installed(root: str, directory: str, name: str) -> str | None:
    """Version in the nearest node_modules at or above a directory."""
    here = os.path.abspath(os.path.join(root, directory))
    while True:
        try:
            with open(os.path.join(here, "node_modules", name, "package.json"), encoding="utf-8") as f:
                version = json.load(f).get("version")
            if isinstance(version, str):
                return version
        except (OSError, ValueError, AttributeError):
            pass
        up = os.path.dirname(here)
        if up == here:
            return None
        here = up


def section(text: str, header: str) -> str | None:
    """Lines below a TOML header, up to the next line that begins with a bracket; null without such a header."""
    lines, inside = [], False
    for line in text.splitlines():
        if inside and line.strip().startswith("["):
            break
        if inside:
            lines.append(line)
        inside = inside or line.strip() == header
    return "\n".join(lines) if inside else None


def quoted(text: str, key: str) -> str | None:
    m = re.search(rf"^\s*{key}\s*=\s*{QUOTED}", text, re.M)
    return m.group(1) if m else None


def npm(text: str, directory: str, root: str | None):
    try:
        j = json.loads(text)
    except ValueError:
        j = None
    if not isinstance(j, dict):
        j = {}
    deps = {}
    for kind in ("optionalDependencies", "peerDependencies", "devDependencies", "dependencies"):
        d = j.get(kind)
        deps |= {k: v for k, v in d.items() if isinstance(v, str)} if isinstance(d, dict) else {}
    out = []
    for key, spec in deps.items():
        at = coordinate(key, spec)
        if at:
            out.append((key, at[0], (installed(root, directory, key) if root else None) or at[1]))
    name = j.get("name") if isinstance(j.get("name"), str) else None
    entries = [pp.normpath(pp.join(directory, e)) for e in (j.get("types"), j.get("main")) if isinstance(e, str)]
    entries += [pp.normpath(pp.join(directory, base + e)) for base in ("src/index", "index") for e in (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")]
    return name, out, entries


def go(text: str, directory: str, root: str | None):
    m = re.search(r"^\s*module\s+(\S+)", text, re.M)
    out, block = [], False
    for line in text.splitlines():
        line = line.split("//")[0].strip()
        if re.match(r"require\s*\($", line):
            block = True
        elif block and line == ")":
            block = False
        else:
            d = re.match(r"(\S+)\s+(v\S+)" if block else r"require\s+(\S+)\s+(v\S+)", line)
            if d:
                out.append((d.group(1), d.group(1), d.group(2)))
    return m.group(1) if m else None, out, []


def rust(text: str, directory: str, root: str | None):
    package = section(text, "[package]")
    if package is None:
        return None
    name, out = quoted(package, "name"), []
    for line in (section(text, "[dependencies]") or "").splitlines():
        m = re.match(r"\s*([\w-]+)\s*=\s*(?:\"([^\"]+)\"|\{.*?\bversion\s*=\s*\"([^\"]+)\".*)", line)
        if m:
            out.append((m.group(1).replace("-", "_"), m.group(1), m.group(2) or m.group(3)))
    return name, out, []


def by_group(group: str, artifact: str, version: str) -> list[tuple]:
    """A dependency under its group id, and under the group without its last part if that has four or more."""
    name, parts = f"{group}:{artifact}", group.split(".")
    return [(group, name, version)] + ([(".".join(parts[:-1]), name, version)] if len(parts) > 3 else [])


def maven(text: str, directory: str, root: str | None):
    own, out = text, []
    if "<parent>" in text and "</parent>" in text.split("<parent>", 1)[1]:
        before, rest = text.split("<parent>", 1)
        own = before + rest.split("</parent>", 1)[1]
    for block in text.split("<dependency>")[1:]:
        if "</dependency>" in block:
            g, a, v = (element(block.split("</dependency>", 1)[0], k) for k in ("groupId", "artifactId", "version"))
            if g and a and v:
                out += by_group(g, a, v)
    return element(own, "artifactId"), out, []


def element(text: str, tag: str) -> str | None:
    """Text of the first element of that tag that holds one word and nothing else."""
    for piece in text.split(f"<{tag}>")[1:]:
        word, closed = piece.split("<", 1)[0].split(), piece.split("<", 1)[1:]
        if len(word) == 1 and closed and closed[0].startswith(f"/{tag}>"):
            return word[0]
    return None


def gradle(text: str, directory: str, root: str | None):
    return None, [x for g, a, v in COORDINATES.findall(text) for x in by_group(g, a, v)], []


def python(text: str, directory: str, root: str | None):
    project = section(text, "[project]")
    if project is None:
        return None
    name = quoted(project, "name")
    m, out = re.search(r"^\s*dependencies\s*=\s*\[([^\]]*)\]?", project, re.M), []
    for r in re.findall(r"[\"']([^\"']+)[\"']", m.group(1)) if m else []:
        d = re.match(r"\s*([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*([<>=!~][^;]*)", r)
        if d:
            out.append((normal(d.group(1)), d.group(1), d.group(2).strip()))
    return name, out, []


READERS = {"package.json": npm, "go.mod": go, "Cargo.toml": rust, "pom.xml": maven, "build.gradle.kts": gradle, "build.gradle": gradle, "pyproject.toml": python}


def read(path: str, text: str, root: str | None) -> dict | None:
    """The record of one manifest. A manifest without a name, broken ones too, is named after its directory; one without the table that declares a package has no name."""
    base, directory = pp.basename(path), pp.dirname(path)
    got = READERS[base](text, directory, root)
    if got is None:
        return {"path": path, "dir": directory or ".", "family": FAMILY[base][0], "prio": FAMILY[base][1], "name": None, "entries": [], "deps": []}
    name, deps, entries = got
    folder = pp.basename(directory) or pp.basename(os.path.abspath(root or "."))
    return {"path": path, "dir": directory or ".", "family": FAMILY[base][0], "prio": FAMILY[base][1], "name": name or folder, "entries": entries, "deps": [{"ord": k, "key": d[0], "name": d[1], "version": d[2]} for k, d in enumerate(deps)]}


def packages(texts: DataFrame, root: str | None = None) -> DataFrame:
    """id, dir, family, name, language, entries, deps: at most one for each directory and family.

    The first manifest in order of precedence stands for its family even where it declares no package (no [package] or [project] table), and then there is none.
    """
    ship(texts.sparkSession)
    order = ["path", "dir", "family", "prio", "name", "entries", "deps"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([read(p, c, root) for p, c in zip(pdf.path, pdf.content, strict=True)], columns=order)

    found = texts.filter(F.element_at(F.split("path", "/"), -1).isin(*FAMILY)).mapInPandas(run, SCHEMA)
    first = found.withColumn("r", F.row_number().over(Window.partitionBy("dir", "family").orderBy("prio"))).filter("r = 1 and name is not null")
    many = first.withColumn("n", F.count("*").over(Window.partitionBy("dir")))
    language = F.create_map(*(F.lit(x) for kv in LANGUAGE.items() for x in kv))[F.col("family")]
    return many.select(F.when(F.col("n") > 1, F.concat_ws("@", "dir", "family")).otherwise(F.col("dir")).alias("id"), "dir", "family", "name", language.alias("language"), "entries", "deps")
