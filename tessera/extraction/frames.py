"""One Python task for each batch of files: texts in, nested declarations, imports, calls and links out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tessera.plans.session import ship

KEYS = "array<struct<prio:int,key:string>>"
SCHEMA = (
    "path string, language string, ok boolean, error string, content_hash string, provides array<string>, "
    "symbols array<struct<ord:int,local_id:string,name:string,symbol_kind:string,start_line:int,end_line:int,exported:boolean,owner:string,test:boolean>>, "
    f"imports array<struct<ord:int,specifier:string,re_export:boolean,edge:boolean,test:boolean,start_line:int,end_line:int,keys:{KEYS},ext:{KEYS}>>, "
    "calls array<struct<ord:int,caller:string,name:string,kind:string,owner:string,via:array<int>,own:boolean,strict:boolean,start_line:int,end_line:int>>, "
    "links array<struct<name:string,via:int,original:string>>"
)


def record(path: str, language: str, text: str, project_dir: str | None, project_name: str | None, aliases: list[tuple[str, list[str]]] = ()) -> dict:
    """The nested record of one file; ok is false for a text that is not of its language."""
    import hashlib

    from tessera.extraction import go_source, java_source, python_source, rust_source, script_source
    from tessera.extraction.lexer import BadSource

    parsers = {"python": python_source, "go": go_source, "java": java_source, "rust": rust_source, "typescript": script_source, "javascript": script_source}
    out = {"path": path, "language": language, "ok": True, "error": None, "content_hash": hashlib.sha256(text.encode()).hexdigest(), "provides": [], "symbols": [], "imports": [], "calls": [], "links": []}
    try:
        more = {"aliases": aliases} if parsers[language] is script_source else {}
        got = parsers[language].parse(path, text, project_dir, project_name, **more)
    except (BadSource, IndexError, KeyError, RecursionError) as e:
        return out | {"ok": False, "error": f"{type(e).__name__}: {e}"}
    # A name's repeats are numbered in source order.
    seen: dict[str, int] = {}
    ids = {}
    for k in sorted(range(len(got.decls)), key=lambda k: (got.decls[k].start, k)):
        n = seen[got.decls[k].name] = seen.get(got.decls[k].name, 0) + 1
        ids[k] = got.decls[k].name + (f"#{n}" if n > 1 else "")
    keyed = lambda pairs: [{"prio": p, "key": k} for p, k in pairs]
    out["provides"] = got.provides
    out["symbols"] = [{"ord": k, "local_id": ids[k], "name": d.name, "symbol_kind": d.kind, "start_line": d.start, "end_line": d.end, "exported": d.exported, "owner": d.owner, "test": d.test} for k, d in enumerate(got.decls)]
    out["imports"] = [{"ord": k, "specifier": s.specifier, "re_export": s.re_export, "edge": s.edge, "test": s.test, "start_line": s.line, "end_line": s.end, "keys": keyed(s.keys), "ext": keyed(s.ext)} for k, s in enumerate(got.imports)]
    out["calls"] = [{"ord": k, "caller": ids[c.caller], "name": c.name, "kind": c.kind, "owner": c.owner, "via": c.via, "own": c.own, "strict": c.strict, "start_line": c.line, "end_line": c.end} for k, c in enumerate(got.calls)]
    out["links"] = [{"name": a, "via": v, "original": b} for a, v, b in got.links]
    return out


def extract(files: DataFrame, aliases: list[tuple[str, list[str]]] = ()) -> DataFrame:
    """files: path, language, content, project_dir, project_name (of the nearest manifest of the family, or null).

    aliases: patterns of module names in scripts, each with its targets.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [record(*(None if isinstance(x, float) else x for x in r), aliases) for r in pdf[["path", "language", "content", "project_dir", "project_name"]].itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in COLUMNS])

    return files.select("path", "language", "content", "project_dir", "project_name").mapInPandas(run, SCHEMA)


COLUMNS = ["path", "language", "ok", "error", "content_hash", "provides", "symbols", "imports", "calls", "links"]
