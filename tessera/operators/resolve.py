"""Imports and calls of extracted files resolved by equi-joins on keys, names and owners; the best tier of each site wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.languages import family_of
from tessera.plans.session import cut

SITE = ["path", "ord"]


def best(df: DataFrame, by: list[str], prio: str) -> DataFrame:
    """Rows of the lowest priority of each site; several may share it."""
    return df.join(df.groupBy(*by).agg(F.min(prio).alias(prio)), [*by, prio])


def imports(extracted: DataFrame, owners: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Import sites, their files (path, ord, target), and their packages (path, ord, name, version, language).

    owners: path, package (id of the nearest manifest of the file's family). A site with a file has no package.
    """
    site = extracted.select("path", "language", F.explode("imports").alias("i")).select("path", "language", "i.*").filter("not test")
    mine = extracted.select("path", F.explode("provides").alias("key"))
    classes = mine.filter("key like 'c:%'").groupBy("key").agg(F.max("path").alias("target"))  # of two files with one class the later
    entry = packages.filter("family = 'npm'").select(F.concat(F.lit("w:"), "name").alias("key"), F.posexplode("entries").alias("p", "target"))
    entry = entry.join(extracted.select(F.col("path").alias("target")), "target").groupBy("key").agg(F.min_by("target", F.struct("p", "target")).alias("target"))
    provided = mine.filter("key not like 'c:%'").select("key", F.col("path").alias("target")).unionByName(classes).unionByName(entry)
    workspace = F.when(family_of(F.col("language")) == "npm", F.transform(F.filter("ext", lambda e: e["prio"] == 0), lambda e: F.struct(e["prio"].alias("prio"), F.concat(F.lit("w:"), e["key"]).alias("key"))))
    keys = F.concat("keys", F.coalesce(workspace, F.array().cast("array<struct<prio:int,key:string>>")))
    wanted = site.select(*SITE, F.explode(keys).alias("k")).select(*SITE, "k.prio", "k.key")
    files = cut(best(wanted.join(provided, "key"), SITE, "prio").select(*SITE, "target").distinct())
    deps = packages.select(F.col("id").alias("package"), F.col("language").alias("of"), F.explode("deps").alias("d")).select("package", "of", "d.*")
    deps = deps.groupBy("package", "key").agg(F.min_by(F.struct("name", "version", F.col("of").alias("language")), "ord").alias("dep"))
    left = site.join(files, SITE, "left_anti").join(owners, "path").select(*SITE, "package", F.explode("ext").alias("e")).select(*SITE, "package", "e.prio", "e.key")
    outside = left.join(deps, ["package", "key"]).groupBy(*SITE).agg(F.min_by("dep", "prio").alias("dep")).select(*SITE, "dep.*")
    return site, files, outside


def linked(start: DataFrame, links: DataFrame, symbols: DataFrame) -> DataFrame:
    """file, name, at, found: where a module's exported name leads through re-exports, level by level, visited pairs once.

    links: file, name ('*' for all), next, original ('*' for the same name).
    """
    have = symbols.filter("owner is null").select(F.col("file_id").alias("at"), F.col("name").alias("found")).distinct()
    front = cut(start.select("file", "name", F.col("file").alias("at"), F.col("name").alias("found")).distinct())
    seen = front
    while True:
        open_ = front.join(have, ["at", "found"], "left_anti")
        step = open_.join(links.withColumnsRenamed({"file": "at", "name": "link"}), "at").filter("link = found or link = '*' and found <> 'default'")
        front = step.select("file", "name", F.col("next").alias("at"), F.when(F.col("original") == "*", F.col("found")).otherwise(F.col("original")).alias("found")).distinct().join(seen, ["file", "name", "at", "found"], "left_anti")
        front = cut(front)
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))


def calls(extracted: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """caller, callee, path, ord, start_line, end_line: one row for each candidate of a call.

    Tiers: the imported file or, in scripts, the own one (a method on this or on a class there, where that class has it with a body); methods of the named owner; every symbol of that name and kind in the family.
    Symbols: id, file_id, name, symbol_kind, owner, family.
    """
    site = extracted.select("path", family_of(F.col("language")).alias("family"), F.explode("calls").alias("c")).select("path", "family", "c.*")
    site = site.withColumn("caller", F.concat_ws("#", "path", "caller"))
    s = symbols.select(F.col("id").alias("callee"), "file_id", F.col("name").alias("s_name"), "symbol_kind", F.col("owner").alias("s_owner"), F.col("family").alias("s_family"))
    line = ["caller", "path", "ord", "start_line", "end_line"]
    via = site.select(*line, "family", "name", "kind", "owner", F.explode("via").alias("via")).join(files.select("path", F.col("ord").alias("via"), F.col("target").alias("file")), ["path", "via"])
    plain = extracted.select(F.col("path").alias("file"), F.explode("links").alias("l")).select("file", "l.*")
    links = plain.filter("via < 0").select("file", "name", F.col("file").alias("next"), "original").unionByName(
        plain.filter("via >= 0").join(files.select(F.col("path").alias("file"), F.col("ord").alias("via"), F.col("target").alias("next")), ["file", "via"]).select("file", "name", "next", "original")
    )
    script = via.filter("family = 'npm'")
    lead = linked(script.select("file", F.coalesce("owner", "name").alias("name")).distinct(), links, symbols)
    function = (F.col("symbol_kind") == "function") & F.col("s_owner").isNull()
    method = F.col("symbol_kind") == "method"
    hit = lambda df, cond, tier: df.join(s, cond).select(*line, "callee", F.lit(tier).alias("tier"))
    # Scripts: through re-exports to a function, or to the class that a method is called on.
    led = script.withColumn("name_of", F.coalesce("owner", "name")).join(lead.withColumnRenamed("name", "name_of"), ["file", "name_of"])
    tiers = [
        hit(led.filter("owner is null"), (F.col("file_id") == F.col("at")) & (F.col("s_name") == F.col("found")) & function, 1),
        hit(led.filter("owner is not null"), (F.col("file_id") == F.col("at")) & (F.col("s_name") == F.col("name")) & (F.col("s_owner") == F.col("found")) & method, 1),
        hit(via.filter("family <> 'npm' and kind <> 'method'"), (F.col("file_id") == F.col("file")) & (F.col("s_name") == F.col("name")) & function, 1),
        hit(via.filter("family <> 'npm' and owner is not null"), (F.col("file_id") == F.col("file")) & (F.col("s_name") == F.col("name")) & (F.col("s_owner") == F.col("owner")) & method, 1),
        hit(site.filter("own and owner is null"), (F.col("file_id") == F.col("path")) & (F.col("s_name") == F.col("name")) & function, 1),
        hit(site.filter("own and owner is not null"), (F.col("file_id") == F.col("path")) & (F.col("s_name") == F.col("name")) & (F.col("s_owner") == F.col("owner")) & method, 1),
        hit(site.filter("owner is not null and family <> 'npm'"), (F.col("s_family") == F.col("family")) & (F.col("s_name") == F.col("name")) & (F.col("s_owner") == F.col("owner")) & method, 2),
    ]
    # A script's method on something imported from outside leads nowhere.
    reached = via.select("path", "ord").distinct().withColumn("reached", F.lit(True))
    loose = site.filter("not strict and not own").join(reached, ["path", "ord"], "left").filter("family <> 'npm' or size(via) = 0 or reached")
    tiers.append(hit(loose, (F.col("s_family") == F.col("family")) & (F.col("s_name") == F.col("name")) & (F.col("symbol_kind") == F.col("kind")), 3))
    out = tiers[0]
    for t in tiers[1:]:
        out = out.unionByName(t)
    w = Window.partitionBy("path", "ord")
    return out.withColumn("top", F.min("tier").over(w)).filter("tier = top").select(*line, "callee").distinct()
