"""Assembly, filters, joins and aggregations of a code graph as DataFrame operators.

Nodes have id, kind, name, file_id, language, module_id, reason, symbol_kind, exported, version; edges source, target, type. Prefix
joins are always an explode of a path's few ancestors and an equi-join, never a comparison of all pairs.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.languages import FAMILIES, family_of
from tessera.functions.paths import ancestors, basename, common_prefix, container, segments, under

NODE = ["id", "kind", "name", "file_id", "language", "module_id", "reason", "symbol_kind", "exported", "version"]


def merge_imports(raw: DataFrame) -> DataFrame:
    """One edge for each (source, target): first specifier in order, any re-export, lines in order (not distinct)."""
    return raw.groupBy("source", "target").agg(
        F.min_by("specifier", "ord").alias("specifier"), F.max("re_export").alias("via_re_export"), F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]).alias("lines")
    )


def merge_calls(raw: DataFrame) -> DataFrame:
    """One edge for each (caller, candidate); every candidate of an ambiguous call gets one."""
    each = raw.withColumn("callee", F.explode("candidates"))
    return each.groupBy("caller", "callee").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def externals(raw: DataFrame) -> DataFrame:
    """Distinct packages; the id has the version where a name has several."""
    many = raw.groupBy("name").agg(F.countDistinct("version").alias("versions"))
    one = raw.distinct().join(many, "name")
    return one.select(F.when(F.col("versions") > 1, F.concat_ws("@", "name", "version")).otherwise(F.col("name")).alias("id"), "name", "version")


def directories(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Directories with files somewhere beneath, strictly below the deepest package root above the file."""
    up = files.select("id", F.posexplode(ancestors(F.col("id"))).alias("pos", "dir"))
    roots = packages.select(F.col("id").alias("dir")).distinct()
    root = up.join(roots, "dir").groupBy("id").agg(F.min("pos").alias("root"))
    return up.join(root, "id", "left").filter("(root is null or pos < root) and dir <> '.'").select(F.col("dir").alias("id")).distinct()


def nodes(packages: DataFrame, dirs: DataFrame, files: DataFrame, symbols: DataFrame, ext: DataFrame) -> DataFrame:
    parts = {"package": packages, "directory": dirs.withColumn("name", basename(F.col("id"))), "file": files.withColumn("file_id", F.col("id")), "symbol": symbols, "external": ext}
    kinds = {"module_id": "int", "exported": "boolean"}
    out = None
    for kind, df in parts.items():
        df = df.withColumn("kind", F.lit(kind))
        df = df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in NODE))
        out = df if out is None else out.unionByName(df)
    return out


def families_by_directory(files: DataFrame) -> DataFrame:
    up = files.select(F.explode(ancestors(F.col("id"))).alias("dir"), family_of(F.col("language")).alias("family"))
    return up.groupBy("dir").agg(F.array_sort(F.collect_set("family")).alias("families"))


def locations(ns: DataFrame) -> DataFrame:
    """id, kind, path, families of every node; externals have no path."""
    files = ns.filter("kind = 'file'")
    own = files.select(F.col("id").alias("file_id"), F.array(family_of(F.col("language"))).alias("of_file"))
    by_dir = families_by_directory(files).withColumnsRenamed({"dir": "id", "families": "of_dir"})
    path = F.when(F.col("kind") == "external", None).when(F.col("kind") == "symbol", F.col("file_id")).otherwise(F.col("id"))
    none = F.array().cast("array<string>")
    families = F.when(F.col("kind") == "package", F.array(family_of(F.col("language")))).when(F.col("kind") == "directory", F.coalesce("of_dir", none)).when(F.col("kind").isin("file", "symbol"), F.coalesce("of_file", none)).otherwise(none)
    return ns.join(own, "file_id", "left").join(by_dir, "id", "left").select("id", "kind", path.alias("path"), families.alias("families"))


def matches(ns: DataFrame, **facets: str | None) -> DataFrame:
    """Ids of matched nodes."""
    return matched(ns, **facets).select("id")


def matched(ns: DataFrame, path: str | None = None, family: str | None = None, symbol_kind: str | None = None, search: str | None = None) -> DataFrame:
    """Nodes that all given facets accept. An empty path accepts none."""
    out = ns
    if symbol_kind is not None:
        out = out.filter((F.col("kind") == "symbol") & (F.col("symbol_kind") == symbol_kind))
    if search is not None:
        out = out.filter(F.lower("name").contains(search.lower()))
    if path is not None:
        at = F.when(F.col("kind") == "symbol", F.col("file_id")).when(F.col("kind") == "package", bare(F.col("id"))).otherwise(F.col("id"))
        out = out.filter((F.col("kind") != "external") & (under(at, path) if path else F.lit(False)))
        if family:  # only then do nodes have to be joined with families
            out = out.join(locations(ns).filter(F.array_contains("families", family)).select("id", "kind"), ["id", "kind"], "left_semi")
    return out


def bare(id_: Column) -> Column:
    """The directory of a package's id: without the '@family' that packages in one directory have."""
    return F.regexp_replace(id_, f"@({'|'.join(FAMILIES)})$", "")


def closure(ns: DataFrame, found: DataFrame) -> DataFrame:
    """Ids of found nodes, the files of symbols, and for each family of a node the directories up to its owning package, and that package.

    A package owns by directory and family: one of another family on the way up does not stop the walk. Nodes without a family
    (directories without files) and externals have no ancestors. found: id, or nodes as they are, which saves looking them up.
    """
    at = found if {"kind", "file_id"} <= set(found.columns) else ns.join(found.select("id"), "id", "left_semi")
    files = ns.filter("kind = 'file'")
    low = at.filter("kind in ('file', 'symbol')").select(F.coalesce("file_id", "id").alias("path")).distinct()
    of_files = low.join(files.select(F.col("id").alias("path"), family_of(F.col("language")).alias("family")), "path")
    # only below found directories are files looked at
    dirs = at.filter("kind = 'directory'").select(F.col("id").alias("path"))
    below = files.select(F.explode(ancestors(F.col("id"))).alias("path"), family_of(F.col("language")).alias("family")).join(dirs, "path", "left_semi").distinct()
    up = of_files.unionByName(below).select("path", "family", F.posexplode(ancestors(F.col("path"))).alias("pos", "dir"))
    packages = ns.filter("kind = 'package'").select(bare(F.col("id")).alias("dir"), family_of(F.col("language")).alias("family"), F.col("id").alias("package")).groupBy("dir", "family").agg(F.max(F.struct(F.length("package"), "package")).alias("p"))
    # of 'dir@family' and 'dir' the first, which is the longer one
    owner = up.join(packages, ["dir", "family"]).groupBy("path", "family").agg(F.min("pos").alias("stop"), F.min_by("p.package", "pos").alias("package"))
    walked = up.join(owner.select("path", "family", "stop"), ["path", "family"], "left").filter("stop is null or pos < stop").select("dir").distinct()
    folders = walked.join(ns.filter("kind = 'directory'").select(F.col("id").alias("dir")), "dir", "left_semi")
    return found.select("id").union(at.filter("kind = 'symbol'").select("file_id")).union(folders.select("dir")).union(owner.select("package")).distinct()


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids."""
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")


def view_matches(ns: DataFrame, path: str = "", family: str = "", symbol_kind: str = "", search: str = "", language: str = "") -> DataFrame:
    """The other dialect: empty facets are off, externals can match a path, directories have no family, no closure."""
    files = ns.filter("kind = 'file'").select(F.col("id").alias("file_id"), F.col("language").alias("of_file"))
    n = ns.drop("_").join(files, "file_id", "left").withColumn("lang", F.when(F.col("kind") == "symbol", F.col("of_file")).otherwise(F.col("language")))
    where = F.when(F.col("kind") == "symbol", F.col("file_id")).otherwise(F.col("id"))
    ok = F.lit(True)
    if path:
        ok = ok & under(where, path)
    if family:
        ok = ok & F.coalesce(family_of(F.col("lang")) == family, F.lit(False))
    if symbol_kind:
        ok = ok & (F.col("kind") == "symbol") & F.coalesce(F.col("symbol_kind") == symbol_kind, F.lit(False))
    if search:
        ok = ok & F.lower("name").contains(search.lower())
    if language:
        ok = ok & F.coalesce(F.col("lang") == language, F.lit(False))
    return n.filter(ok).select("id")


def nearest(files: DataFrame, owners: DataFrame, order: str = "ord") -> DataFrame:
    """Each file's nearest owner among its ancestor directories (longest prefix); of equals the first in order."""
    up = files.select("id", F.posexplode(ancestors(F.col("id"))).alias("pos", "dir"))
    hit = up.join(owners.select("dir", F.col("owner"), F.col(order).alias("_o")), "dir")
    return hit.groupBy("id").agg(F.min_by("owner", F.struct("pos", "_o")).alias("owner"))


def longest_prefix(names: DataFrame, prefixes: DataFrame, separator: str = "/") -> DataFrame:
    """Each name's longest prefix by whole parts (name, prefix); names without one are left out."""
    seg = F.split("name", separator)
    heads = names.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(seg)), lambda i: F.array_join(F.slice(seg, F.lit(1), i), separator.replace("\\", "")))).alias("prefix"))
    return heads.join(prefixes.select("prefix").distinct(), "prefix").groupBy("name").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def difference(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, state: new, changed, unchanged or gone."""
    o, n = old.select(key, F.col(value).alias("_a"), F.lit(1).alias("_o")), new.select(key, F.col(value).alias("_b"), F.lit(1).alias("_n"))
    state = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "gone").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    return o.join(n, key, "full_outer").select(key, state.alias("state"))


def fans(edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out: distinct outside directories that import a file or that it imports."""
    d = lambda c: F.array_join(container(F.col(c)), "/")
    e = edges.select("source", "target", d("source").alias("sd"), d("target").alias("td")).filter("sd <> td")
    fin = e.groupBy(F.col("target").alias("id")).agg(F.countDistinct("sd").alias("fan_in"))
    out = e.groupBy(F.col("source").alias("id")).agg(F.countDistinct("td").alias("fan_out"))
    return fin.join(out, "id", "full_outer").select("id", F.coalesce("fan_in", F.lit(0)).cast("long").alias("fan_in"), F.coalesce("fan_out", F.lit(0)).cast("long").alias("fan_out"))


def weights(edges: DataFrame) -> DataFrame:
    """source, target, weight: 3 to the power of shared directories, diluted by fan over directories, at least 1."""
    f = fans(edges)
    e = edges.join(f.select(F.col("id").alias("target"), "fan_in"), "target", "left").join(f.select(F.col("id").alias("source"), "fan_out"), "source", "left")
    depth = common_prefix(container(F.col("source")), container(F.col("target")))
    same = F.array_join(container(F.col("source")), "/") == F.array_join(container(F.col("target")), "/")
    raw, div = F.pow(F.lit(3.0), depth), F.greatest(F.coalesce("fan_in", F.lit(0)), F.coalesce("fan_out", F.lit(0)))
    return e.select("source", "target", F.when(same | (div <= 1), raw).otherwise(F.greatest(F.lit(1.0), raw / div)).alias("weight"))


def undirected(w: DataFrame) -> DataFrame:
    """a < b and one weight; of a pair that imports both ways the later edge's in sorted order."""
    return w.filter("source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.max_by("weight", F.struct("source", "target")).alias("weight"))


def modularity(und: DataFrame, part: DataFrame) -> DataFrame:
    """One row: q of a given partition (id, c)."""
    ends = und.select(F.col("a").alias("id"), "weight").union(und.select("b", "weight"))
    deg = ends.join(part, "id").groupBy("c").agg(F.sum("weight").alias("deg"))
    a, b = part.withColumnsRenamed({"id": "a", "c": "ca"}), part.withColumnsRenamed({"id": "b", "c": "cb"})
    inside = und.join(a, "a").join(b, "b").groupBy().agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("win"))
    return deg.groupBy().agg(F.sum(F.col("deg") * F.col("deg")).alias("d2")).crossJoin(F.broadcast(inside)).select(F.round(F.col("win") / F.col("m") - F.col("d2") / (4 * F.col("m") * F.col("m")), 9).alias("q"))  # one row each


def embedded(und: DataFrame, part: DataFrame) -> DataFrame:
    """id, c, degree, internal: weighted degree, and the part of it within the community; 0 without edges."""
    ends = und.select(F.col("a").alias("id"), F.col("b").alias("o"), "weight").union(und.select("b", "a", "weight"))
    sums = ends.join(part, "id").join(part.withColumnsRenamed({"id": "o", "c": "co"}), "o").groupBy("id").agg(F.sum("weight").alias("degree"), F.sum(F.when(F.col("c") == F.col("co"), F.col("weight")).otherwise(0.0)).alias("internal"))
    return part.join(sums, "id", "left").select("id", "c", F.coalesce("degree", F.lit(0.0)).alias("degree"), F.coalesce("internal", F.lit(0.0)).alias("internal"))


def classify(und: DataFrame, part: DataFrame, q: Column | float) -> DataFrame:
    """id, module_id, reason: isolated, undersized, low-embeddedness, degenerate-partition, or assigned."""
    size = part.groupBy("c").agg(F.count("*").alias("size"))
    e = embedded(und, part).join(size, "c")
    q = F.lit(q) if not isinstance(q, Column) else q
    reason = F.when(F.col("degree") == 0, "isolated").when(F.col("size") < 2, "undersized").when(F.col("internal") / F.col("degree") < 0.5, "low-embeddedness").when(q < 0.1, "degenerate-partition")
    return e.withColumn("reason", reason).select("id", F.when(F.col("reason").isNull(), F.col("c")).alias("module_id"), "reason")


def split_packages(files: DataFrame) -> DataFrame:
    """Modules over several packages: a fresh id for each (module, package), numbered after the largest in sorted order."""
    placed = files.filter("module_id is not null and pkg is not null")
    wide = placed.groupBy("module_id").agg(F.countDistinct("pkg").alias("pkgs")).filter("pkgs > 1").select("module_id")
    pairs = placed.join(wide, "module_id", "left_semi").select("module_id", "pkg").distinct()
    most = files.agg(F.max("module_id").alias("most"))
    fresh = pairs.crossJoin(F.broadcast(most)).withColumn("fresh", F.col("most") + F.row_number().over(Window.orderBy("module_id", "pkg")))  # few pairs: modules, not files
    return files.join(F.broadcast(fresh.drop("most")), ["module_id", "pkg"], "left").select("id", F.coalesce("fresh", "module_id").cast("int").alias("module_id"))


def majority(files: DataFrame) -> DataFrame:
    """dir, module_id: the most frequent module of a directory's files; none where the two first tie at one file."""
    c = files.filter("module_id is not null and dir <> ''").groupBy("dir", "module_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("dir").orderBy(F.desc("n"), "module_id")
    first = c.withColumn("r", F.row_number().over(w)).withColumn("second", F.lead("n").over(w)).filter("r = 1")
    return first.select("dir", F.when((F.col("n") == 1) & F.coalesce(F.col("second") == 1, F.lit(False)), None).otherwise(F.col("module_id")).alias("module_id"))


def reconcile(files: DataFrame) -> DataFrame:
    """Assigned files take their directory's majority module."""
    m = majority(files).withColumnRenamed("module_id", "major")
    return files.join(m, "dir", "left").select("id", F.when(F.col("module_id").isNull(), None).otherwise(F.coalesce("major", "module_id")).alias("module_id"))


def minimum_size(files: DataFrame, least: int = 2) -> DataFrame:
    """id, module_id, reason: files of modules with fewer than least files are unassigned as undersized."""
    size = files.filter("module_id is not null").groupBy("module_id").agg(F.count("*").alias("n"))
    small = F.col("n") < least
    return files.join(size, "module_id", "left").select("id", F.when(F.col("n") >= least, F.col("module_id")).alias("module_id"), F.when(small, "undersized").otherwise(F.col("reason")).alias("reason"))


def bucketed(files: DataFrame, test: Column, bucket: DataFrame) -> DataFrame:
    """id, module_id, reason of test and configuration files: tests share the bucket (one row, one column), configuration has no module."""
    return files.crossJoin(F.broadcast(bucket.toDF("_bucket"))).select("id", F.when(test, F.col("_bucket")).cast("int").alias("module_id"), F.when(~test, "config").alias("reason"))


def epoch(inputs: DataFrame, settings: str) -> DataFrame:
    """One row, epoch: a hash of the settings and of all inputs (path, content_hash) in order of path. Another epoch makes every cached file stale."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("path", "content_hash"))), lambda x: F.concat_ws(":", x["path"], x["content_hash"]))
    return inputs.agg(F.sha2(F.concat_ws("|", F.lit(settings), F.array_join(pairs, ",")), 256).alias("epoch"))


def resolved(edges: DataFrame, there: DataFrame) -> DataFrame:
    """source, target, kind: a target that is not there (id) is null and unresolved."""
    known = there.select(F.col("id").alias("target"), F.lit(True).alias("_ok"))
    return edges.join(known, "target", "left").select("source", F.when(F.col("_ok"), F.col("target")).alias("target"), F.when(F.col("_ok"), "file").otherwise("unresolved").alias("kind"))


def without_hidden(calls: DataFrame, hidden: DataFrame) -> DataFrame:
    """Calls (caller, callee) with neither end hidden (id)."""
    return calls.join(hidden.select(F.col("id").alias("caller")), "caller", "left_anti").join(hidden.select(F.col("id").alias("callee")), "callee", "left_anti").select(*calls.columns)


def scope(ns: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the module view (files and externals), and the edges among them."""
    shown = ns.filter("kind in ('file', 'external')")
    return shown, induced(edges, shown.select("id"))


# Fixed values of the flow layout: left margin, top of the first row, height of a row, width of a column.
LEFT, TOP, ROW, COLUMN = 60, 88, 58, 220


def flow(files: DataFrame, externals: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """id, region, col, r, x, y: a column for each region, a row for each node in order of id.

    Regions are modules in order of name (names: module_id, name) and number, then unassigned files, then externals.
    """
    region = F.when(F.col("module_id").isNull(), "unassigned").otherwise(F.concat(F.lit("module-"), "module_id"))
    rows = files.select("id", region.alias("region"), F.when(F.col("module_id").isNull(), 1).otherwise(0).alias("rank"), "module_id")
    if externals is not None:
        rows = rows.unionByName(externals.select("id", F.lit("external").alias("region"), F.lit(2).alias("rank"), F.lit(None).cast("int").alias("module_id")))
    cols = rows.select("region", "rank", "module_id").distinct()
    cols = cols.join(names.select("module_id", "name"), "module_id", "left") if names is not None else cols.withColumn("name", F.lit(None).cast("string"))
    cols = cols.withColumn("col", F.row_number().over(Window.orderBy("rank", F.coalesce("name", F.lit("")), "module_id")) - 1)  # regions, not files
    r = F.row_number().over(Window.partitionBy("region").orderBy("id")) - 1
    placed = rows.join(F.broadcast(cols.select("region", "col")), "region").withColumn("r", r)
    return placed.select("id", "region", F.col("col").cast("long").alias("col"), F.col("r").cast("long").alias("r"), (LEFT + COLUMN * F.col("col")).cast("double").alias("x"), (TOP + ROW * F.col("r")).cast("double").alias("y"))


def boxes(placed: DataFrame) -> DataFrame:
    """region, x, y (centroid), and the corners of the box around its nodes."""
    return placed.groupBy("region").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"), *(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y")))


def described(places: DataFrame) -> DataFrame:
    """source, target, label: where an edge stands, in order. places: source, target, ord, start_line, end_line."""
    one = F.when(F.col("start_line") == F.col("end_line"), F.concat(F.lit("line "), "start_line")).otherwise(F.concat(F.lit("lines "), "start_line", F.lit("-"), "end_line"))
    return places.groupBy("source", "target").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", one.alias("text")))), lambda x: x["text"]), ", ").alias("label"))


def levels(edges: DataFrame, start: DataFrame) -> DataFrame:
    """id, level: breadth-first from start (id). A frontier and the visited set, each level cut from its lineage."""
    from tessera.plans.session import cut

    seen = cut(start.select("id").distinct().withColumn("level", F.lit(0)))
    front = seen.select("id")
    e = cut(edges.select("source", "target").distinct())
    for k in count(1):
        front = e.join(front, e.source == front.id).select(F.col("target").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        front = cut(front)
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front.withColumn("level", F.lit(k))))
    return seen


def numbered(df: DataFrame, *keys: str, name: str = "ord") -> DataFrame:
    """df with a number from 1 in the order of keys: range partitions, each offset by the rows of those before it."""
    from tessera.plans.session import cut

    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    ranged = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    size = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    before = size.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))  # one row for each partition
    return ranged.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + at + 1).alias(name))


def chain(edges: DataFrame, start: DataFrame) -> DataFrame:
    """id, level, ord, source: breadth-first from start (id) over the edges in sorted order.

    ord is the order of visits from 0; source is the node whose edge reached id first (none at the start), so the
    rows with a source are the tree's edges, in the order in which they are followed.
    """
    from tessera.plans.session import cut

    e = cut(edges.select("source", "target").distinct())
    none = F.lit(None).cast(e.schema["source"].dataType)
    front = cut(numbered(start.select("id").distinct(), "id").select("id", F.lit(0).alias("level"), (F.col("ord") - 1).alias("ord"), none.alias("source")))
    seen, visited, level = front, 0, 0
    while fresh := front.count():
        visited, level = visited + fresh, level + 1
        reached = e.join(front.select(F.col("id").alias("source"), "ord"), "source").groupBy(F.col("target").alias("id")).agg(F.min("ord").alias("parent"), F.min_by("source", "ord").alias("source"))
        new = numbered(reached.join(seen.select("id"), "id", "left_anti"), "parent", "id")
        front = cut(new.select("id", F.lit(level).alias("level"), (F.col("ord") + (visited - 1)).alias("ord"), "source"))
        seen = cut(seen.unionByName(front))
    return seen


def child_names(files: DataFrame) -> DataFrame:
    """module_id, name: the child segments below a module's common directory, by count then name, at most four, joined by '+'."""
    f = files.filter("module_id is not null").select("module_id", container(F.col("id")).alias("seg"))
    depth = f.groupBy("module_id").agg(common_prefix(F.min("seg"), F.max("seg")).alias("depth"))
    child = f.join(depth, "module_id").select("module_id", F.try_element_at("seg", F.col("depth") + 1).alias("child")).filter("child is not null").groupBy("module_id", "child").agg(F.count("*").alias("n"))
    top = child.withColumn("r", F.row_number().over(Window.partitionBy("module_id").orderBy(F.desc("n"), "child"))).filter("r <= 4")
    return top.groupBy("module_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "child"))), lambda x: x["child"]), "+").alias("name"))


def module_graph(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct imports between different modules."""
    m = files.filter("module_id is not null").select("id", "module_id")
    e = edges.join(m.withColumnsRenamed({"id": "source", "module_id": "src"}), "source").join(m.withColumnsRenamed({"id": "target", "module_id": "dst"}), "target")
    return e.filter("src <> dst").select("src", "dst").distinct()


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    both = edges.select("source", "target").union(edges.select("target", "source")).filter(F.col("source") == node)
    return both.select(F.col("target").alias("id")).union(edges.sparkSession.createDataFrame([(node,)], "id string")).distinct()


def depth_of(path: Column) -> Column:
    return F.size(segments(path))
