"""A source tree from files to graph, modules, document and filtered reads; one repository for each graph.

Frames stay distributed; what one task or the driver holds is bounded by a repository's modules, packages or one filtered reply.
"""

from __future__ import annotations

import json
import logging
import os
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.extraction.frames import COLUMNS, SCHEMA, extract
from tessera.functions.languages import family_of, is_config, is_test, language_of
from tessera.functions.paths import ancestors, basename, container, extension
from tessera.operators import graph as G
from tessera.operators import modules as M
from tessera.operators import naming, resolve
from tessera.plans import observability
from tessera.plans.session import cut, table
from tessera.sources import manifests, tree

log = logging.getLogger("tessera")
VERSION = "1.3.0"  # Fixed value: version of the document's shape.
PLACE = "array<struct<startLine:int,endLine:int>>"


@dataclass
class CodeGraph:
    """nodes, edges, modules (id, name, ord), warnings (ord, warning) and the raw extraction of one repository."""

    nodes: DataFrame
    edges: DataFrame
    modules: DataFrame
    warnings: DataFrame
    extracted: DataFrame

    def filter(self, path: str | None = None, symbol_kind: str | None = None, search: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nodes that all given facets accept with their ancestors, the edges among them, and all modules."""
        if path is None and symbol_kind is None and search is None:
            return self.nodes, self.edges, self.modules
        family = None
        at = path.rfind("@") if path else -1
        if at > 0 and path[at + 1 :] in manifests.LANGUAGE:
            path, family = path[:at], path[at + 1 :]
        keep = cut(G.matched(self.nodes, path=path, family=family, symbol_kind=symbol_kind, search=search))
        ids = cut(G.closure(self.nodes, keep))
        return self.nodes.join(ids, "id", "left_semi"), G.induced(self.edges, ids), self.modules

    def counts(self) -> dict[str, int]:
        return {"nodes": self.nodes.count(), "edges": self.edges.count()}


def cached(spark: SparkSession, files: DataFrame, folder: str | None, epoch: str, force: bool, aliases: list[tuple[str, list[str]]] = ()) -> DataFrame:
    """Extraction of files, taken from the cache where path, content and epoch are the same; a bad cache counts as none."""
    hashed = files.withColumn("content_hash", F.sha2(F.encode("content", "UTF-8"), 256))
    old = None
    state = Path(folder, "cache.json") if folder else None
    if state is not None and state.exists() and not force:
        try:
            head = json.loads(state.read_text())
            if head["epoch"] == epoch:
                old = spark.read.schema(SCHEMA).parquet(str(Path(folder, head["table"])))
                old.limit(1).count()
        except Exception as e:
            log.warning("cache not used: %s", e)
            old = None
    key = ["path", "content_hash"]
    if old is None:
        fresh = extract(files, aliases)
    else:
        same = old.join(hashed.select(*key), key, "left_semi").select(*COLUMNS)
        fresh = extract(hashed.join(old.select(*key), key, "left_anti"), aliases).unionByName(same)
    if state is None:
        return table(fresh, "extracted")[0]
    # A new table beside the old one, then the small state file in one rename.
    name = f"cache-{uuid.uuid4().hex}"
    fresh.write.parquet(str(Path(folder, name)))
    part = state.with_suffix(".new")
    part.write_text(json.dumps({"epoch": epoch, "table": name}))
    os.replace(part, state)
    return spark.read.schema(SCHEMA).parquet(str(Path(folder, name)))


def build(spark: SparkSession, root: str, exclude: list[str] | None = None, include_tests: bool = False, cache: str | None = None, force: bool = False) -> CodeGraph:
    root = os.path.abspath(root)
    exclude = tree.config(root)["exclude"] if exclude is None else exclude
    with observability.stage("discovery") as found:
        texts, _ = table(tree.texts(spark, root, exclude), "texts")
        packages, _ = table(manifests.packages(texts, root), "packages")
        found.update(texts=texts.count(), packages=packages.count())
    files = texts.withColumn("extension", extension(basename(F.col("path")))).withColumn("language", language_of(F.col("extension"))).filter("language is not null")
    if not include_tests:
        files = files.filter(~is_test(F.col("path")))
    files = files.withColumn("family", family_of(F.col("language")))
    up = files.select("path", "family", F.posexplode(ancestors(F.col("path"))).alias("pos", "dir"))
    near = up.join(packages.select("dir", "family", F.col("id").alias("package"), F.col("name").alias("project_name")), ["dir", "family"])
    near = near.groupBy("path").agg(F.min_by(F.struct(F.when(F.col("dir") == ".", "").otherwise(F.col("dir")).alias("project_dir"), "project_name", "package"), "pos").alias("m")).select("path", "m.*")
    placed = files.join(near, "path", "left")
    name = basename(F.col("path"))
    inputs = texts.filter(name.isin(*tree.MANIFESTS, *tree.LOCKFILES) | (F.col("path") == "tsconfig.json")).select("path", F.sha2("content", 256).alias("content_hash"))
    aliases = tree.aliases(root)  # one configuration's entries
    epoch = G.epoch(inputs, json.dumps([VERSION, sorted(exclude), include_tests, aliases])).first()["epoch"]
    with observability.stage("extraction") as found:
        extracted = cached(spark, placed.filter("package is not null"), cache, epoch, force, aliases)
        found["languages"] = per_language(extracted)
    with observability.stage("assembly") as found:
        graph = assemble(placed, packages, extracted, include_tests)
        found.update(graph.counts())
    return graph


def per_language(extracted: DataFrame) -> dict[str, dict[str, int]]:
    """For each language how many files were taken, parsed and skipped."""
    rows = extracted.groupBy("language").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok")).collect()  # one row a language
    return {r["language"]: {"files": r["n"], "extracted": r["ok"], "skipped": r["n"] - r["ok"]} for r in sorted(rows)}


def assemble(placed: DataFrame, packages: DataFrame, extracted: DataFrame, include_tests: bool) -> CodeGraph:
    """Graph of placed files (path, language, extension, package), packages and their extraction."""
    ok = extracted.filter("ok")
    owners = placed.select("path", "package")
    sites, targets, outside = resolve.imports(ok, owners, packages)
    symbols = ok.select("path", family_of(F.col("language")).alias("family"), F.explode("symbols").alias("s")).select("path", "family", "s.*")
    if not include_tests:
        symbols = symbols.filter("not test")
    symbols = cut(symbols.select(F.concat_ws("#", "path", "local_id").alias("id"), F.col("path").alias("file_id"), "name", "symbol_kind", "start_line", "end_line", "exported", "owner", "family"))
    # Callers that are hidden take their calls with them.
    called = resolve.calls(ok, symbols, targets).join(symbols.select(F.col("id").alias("caller")), "caller", "left_semi")
    versions = outside.groupBy("name").agg(F.countDistinct("version").alias("n"))
    outside = outside.join(versions, "name").withColumn("target", F.when(F.col("n") > 1, F.concat_ws("@", "name", "version")).otherwise(F.col("name")))
    edge = sites.filter("edge").select("path", "ord", "specifier", "re_export", F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine")).alias("line"))
    ends = targets.select("path", "ord", "target").unionByName(outside.select("path", "ord", "target"))
    imports = cut(G.merge_imports(edge.join(ends, ["path", "ord"]).withColumnRenamed("path", "source")))
    raw = called.select("caller", F.array("callee").alias("candidates"), F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine")).alias("line"))
    merged = G.merge_calls(raw)
    edges = imports.select("source", "target", F.lit("static").alias("kind"), F.lit("import").alias("type"), "specifier", F.col("via_re_export"), F.col("lines").cast(PLACE).alias("locations")).unionByName(
        merged.select(F.col("caller").alias("source"), F.col("callee").alias("target"), F.lit("static").alias("kind"), F.lit("call").alias("type"), F.lit(None).cast("string").alias("specifier"), F.lit(None).cast("boolean").alias("via_re_export"), F.col("lines").cast(PLACE).alias("locations"))
    )
    mapped = cut(ok.select("path").join(placed.select("path", "language", "extension"), "path").select(F.col("path").alias("id"), "language", "extension"))
    assigned, modules = modules_of(mapped, imports, packages)
    dirs = G.directories(placed.filter("package is not null").select(F.col("path").alias("id")), packages.select(F.col("dir").alias("id")))
    ext = outside.groupBy(F.col("target").alias("id")).agg(F.min("name").alias("name"), F.min("version").alias("version"), F.min("language").alias("language"))
    file_nodes = mapped.join(assigned, "id").withColumn("name", basename(F.col("id")))
    base = G.nodes(packages.select("id", "name", "language"), dirs, file_nodes, symbols, ext)
    lines = symbols.select("id", F.lit("symbol").alias("kind"), "start_line", "end_line")
    nodes = base.join(lines, ["id", "kind"], "left").withColumn("extension", F.when(F.col("kind") == "file", extension(F.col("name"))))
    bad = placed.filter("package is null").select(F.lit(0).alias("k"), F.col("path")).unionByName(extracted.filter("not ok").select(F.lit(1).alias("k"), "path"))
    text = F.concat(F.when(F.col("k") == 0, "Skipped manifest-less file: ").otherwise("Skipped unparseable file: "), "path")
    warnings = bad.select("k", "path", text.alias("warning"))
    return CodeGraph(cut(nodes), cut(edges), cut(modules), cut(warnings), extracted)


def modules_of(files: DataFrame, imports: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, module_id, reason) of files and (id, name, ord) of modules: communities, buckets, splits, refinement, votes, minimum size."""
    plain = files.filter(~is_test(F.col("id")) & ~is_config(F.col("id"))).select("id")
    pairs = G.induced(imports.select("source", "target"), plain).filter("source <> target")
    und = cut(G.undirected(G.weights(pairs)).orderBy("a", "b"))
    com = M.communities(und.withColumn("repo_id", F.lit("one")))
    least = com.groupBy("community").agg(F.min("id").alias("rep")).join(com, "community").select("id", "rep")
    rep = plain.join(least, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    number = rep.select("rep").distinct().withColumn("c", F.row_number().over(Window.orderBy("rep")) - 1)  # numbered by first appearance
    part = cut(rep.join(number, "rep").select("id", "c"))
    q = G.modularity(und, part).first()["q"]  # one number
    judged = G.classify(und, part, float(q or 0.0)).select("id", F.col("module_id").cast("int").alias("module_id"), "reason")
    bucket = part.agg(F.coalesce(F.max("c") + 1, F.lit(0)).alias("bucket"))
    now = judged.unionByName(G.bucketed(files.join(plain, "id", "left_anti"), is_test(F.col("id")), bucket))
    owner = G.nearest(files.select("id"), packages.select("dir", F.col("dir").alias("owner"), F.struct("name", "id").alias("name")).groupBy("dir", "owner").agg(F.min("name").alias("ord")))
    named = packages.groupBy(F.col("dir").alias("owner")).agg(F.min_by("name", "id").alias("pkg_name"))
    place = cut(files.select("id", F.array_join(container(F.col("id")), "/").alias("dir")).join(owner.join(named, "owner").withColumnRenamed("owner", "pkg"), "id", "left"))
    split = G.split_packages(now.join(place, "id")).withColumnRenamed("module_id", "m")
    now = cut(now.join(split, "id").select("id", F.col("m").alias("module_id"), "reason"))
    wide = naming.summaries(now.join(place, "id")).filter(f"breadth > {naming.BREADTH}").select("module_id")
    of = now.join(wide, "module_id", "left_semi").select("id", "module_id")
    inner = pairs.join(of.withColumnsRenamed({"id": "source", "module_id": "m"}), "source").join(of.withColumnsRenamed({"id": "target", "module_id": "n"}), "target").filter("m = n").select("source", "target")
    now = cut(M.refine(now, G.undirected(G.weights(inner)), wide))
    voted = G.reconcile(now.join(place, "id")).withColumnRenamed("module_id", "m")
    now = now.join(voted, "id").select("id", F.col("m").alias("module_id"), "reason")
    now = cut(G.minimum_size(now))
    names = cut(naming.names(now.join(place, "id")))
    graph = G.module_graph(imports.select("source", "target"), now)
    order = M.module_order(names.select(F.lit("one").alias("repo_id"), "id", "name"), graph.select(F.lit("one").alias("repo_id"), "src", "dst"))
    return now, order.select("id", "name", "ord")


def document(graph: CodeGraph) -> DataFrame:
    """One row for each line of the sorted document: part, ord, json. Keys are those of each kind, nulls of module fields are kept."""
    f = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    name = {"module_id": "moduleId", "reason": "unassignedReason", "symbol_kind": "symbolKind", "start_line": "startLine", "end_line": "endLine", "via_re_export": "viaReExport"}
    col = lambda *cs: [F.col(c).alias(name.get(c, c)) for c in cs]
    shape = F.when(F.col("kind") == "package", f(*col("id", "kind", "name", "language"))).when(F.col("kind") == "directory", f(*col("id", "kind", "name"))).when(F.col("kind") == "file", f(*col("id", "kind", "name", "extension", "language", "module_id", "reason"))).when(F.col("kind") == "symbol", f(*col("id", "kind", "name", "symbol_kind", "start_line", "end_line", "exported"))).otherwise(f(*col("id", "kind", "name", "version", "language")))
    edge = F.when(F.col("type") == "import", f(*col("source", "target", "kind", "type", "specifier", "via_re_export", "locations"))).otherwise(f(*col("source", "target", "kind", "type", "locations")))
    rank = lambda df, part, order, text: df.select(F.lit(part).alias("part"), F.struct(*order).alias("o"), text.alias("json"))
    pad = lambda *cs: [F.coalesce(c.cast("string"), F.lit("")).alias(f"k{i}") for i, c in enumerate(cs)]
    blank = F.lit("")
    parts = [
        rank(graph.nodes, 0, pad(F.col("id"), F.col("kind"), blank, blank), shape),
        rank(graph.edges, 1, pad(F.col("source"), F.col("target"), F.col("kind"), F.col("type")), edge),
        rank(graph.modules, 2, pad(F.lpad(F.col("ord").cast("string"), 12, "0"), blank, blank, blank), f("id", "name")),
        rank(graph.nodes.filter("language is not null and kind in ('file', 'package', 'external')").select("language").distinct(), 3, pad(F.col("language"), blank, blank, blank), f("language")),
        rank(graph.warnings, 4, pad(F.col("k"), F.col("path"), blank, blank), f("warning")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("part", "o").select("part", "json")


def write_document(graph: CodeGraph, path: str) -> None:
    """One compact JSON document; rows stream through the driver in order and are never held together."""
    keys = ["nodes", "edges", "modules", "languages", "warnings"]
    part, now = Path(path + ".new"), -1
    with part.open("w", encoding="utf-8") as out:
        out.write('{"schemaVersion":' + json.dumps(VERSION))
        for row in document(graph).toLocalIterator():
            text = row["json"] if row["part"] < 3 else json.dumps(next(iter(json.loads(row["json"]).values())), ensure_ascii=False)
            if row["part"] == now:
                out.write("," + text)
                continue
            while now < row["part"]:
                out.write(("]" if now >= 0 else "") + f',"{keys[now + 1]}":[')
                now += 1
            out.write(text)
        while now < len(keys) - 1:
            out.write(("]" if now >= 0 else "") + f',"{keys[now + 1]}":[')
            now += 1
        out.write("]}")
    os.replace(part, path)


def generate(spark: SparkSession, root: str = ".", config_path: str | None = None, out_dir: str | None = None, force: bool = False, include_tests: bool = False) -> dict:
    """Write the document of a tree and its cache; returns the path and the counts of nodes and edges."""
    given = tree.config(root, config_path)
    out = Path(root, out_dir or given["outDir"])
    out.mkdir(parents=True, exist_ok=True)
    with observability.run(root=str(Path(root).resolve())):
        graph = build(spark, root, given["exclude"], include_tests, str(out), force)
        with observability.stage("document"):
            write_document(graph, str(out / "map.json"))
    return {"jsonPath": str(out / "map.json"), "nodeCount": graph.nodes.count(), "edgeCount": graph.edges.count()}


def read(spark: SparkSession, root: str = ".", config_path: str | None = None, include_tests: bool = False, path: str | None = None, symbol_kind: str | None = None, search: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and modules of a tree as it is now, filtered."""
    return build(spark, root, tree.config(root, config_path)["exclude"], include_tests).filter(path, symbol_kind, search)
