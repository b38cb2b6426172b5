"""python -m tessera generate|read: a tree's document, or a filtered reply as JSON."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", allow_abbrev=False)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("generate", "read"):
        c = sub.add_parser(name, allow_abbrev=False)
        c.add_argument("--root", default=".")
        c.add_argument("--config")
        c.add_argument("--include-tests", action="store_true")
        if name == "generate":
            c.add_argument("--out")
            c.add_argument("--force", action="store_true")
        else:
            c.add_argument("--path")
            c.add_argument("--symbol-kind", choices=["function", "method", "class", "const", "type", "interface", "enum"])
            c.add_argument("--search")
    return p


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    p = parser()
    if any(a in ("-h", "--help") for a in argv):  # help wins over every other error
        p.parse_args([a for a in argv[:1] if a in ("generate", "read")] + ["--help"])
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    from pyspark.sql import SparkSession

    from tessera.plans import codegraph, observability

    observability.handle()
    spark = SparkSession.builder.appName("tessera").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if a.command == "generate":
        print(json.dumps(codegraph.generate(spark, a.root, a.config, a.out, a.force, a.include_tests)))
        return 0
    nodes, edges, modules = codegraph.read(spark, a.root, a.config, a.include_tests, a.path, a.symbol_kind, a.search)
    graph = codegraph.CodeGraph(nodes, edges, modules, spark.createDataFrame([], "k int, path string, warning string"), None)
    keys = ["nodes", "edges", "modules"]
    reply: dict = {k: [] for k in keys}
    for row in codegraph.document(graph).toLocalIterator():
        if row["part"] < 3:
            reply[keys[row["part"]]].append(json.loads(row["json"]))
    print(json.dumps(reply))
    return 0


if __name__ == "__main__":
    sys.exit(main())
