"""Module names: four candidates for each module, settled tier by tier, and numbers for those that still collide."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.languages import is_test
from tessera.functions.paths import common_prefix, container
from tessera.plans.session import ship

BREADTH = 4  # Fixed value: more child segments than this make no name, and have a module refined.


def summaries(files: DataFrame) -> DataFrame:
    """module_id, common (segments), children (ordered names), tests, package, pkgs of files (id, module_id, pkg, pkg_name)."""
    f = files.filter("module_id is not null").select("module_id", "id", "pkg", "pkg_name", container(F.col("id")).alias("seg"))
    base = f.groupBy("module_id").agg(
        common_prefix(F.min("seg"), F.max("seg")).alias("depth"), F.min("seg").alias("low"), F.min(is_test(F.col("id"))).alias("tests"),
        F.countDistinct(F.coalesce("pkg", F.lit(""))).alias("pkgs"), F.min("pkg").alias("package"), F.min("pkg_name").alias("package_name"),
    )
    child = f.join(base.select("module_id", "depth"), "module_id").select("module_id", F.try_element_at("seg", F.col("depth") + 1).alias("child")).filter("child is not null").groupBy("module_id", "child").agg(F.count("*").alias("n"))
    ranked = child.withColumn("r", F.row_number().over(Window.partitionBy("module_id").orderBy(F.desc("n"), "child")))
    kids = ranked.groupBy("module_id").agg(F.count("*").alias("breadth"), F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= BREADTH, F.struct("r", "child")))), lambda x: x["child"]).alias("children"))
    common = F.slice("low", F.lit(1), F.col("depth")).alias("common")
    return base.join(kids, "module_id", "left").select("module_id", common, F.coalesce("breadth", F.lit(0)).alias("breadth"), F.coalesce("children", F.array().cast("array<string>")).alias("children"), "tests", F.when(F.col("pkgs") == 1, F.col("package")).alias("package"), F.when(F.col("pkgs") == 1, F.col("package_name")).alias("package_name"))


def settle(rows: list[dict], root: str | None) -> dict[int, str]:
    """Final name of each module; rows as of summaries."""
    short = {r["module_id"]: (r["common"][1:] if r["common"] and r["common"][0] == root else list(r["common"])) for r in rows}
    tiers: dict[int, list[str]] = {}
    for r in rows:
        m, own = r["module_id"], short[r["module_id"]]
        if r["tests"]:
            tiers[m] = ["tests"] * 4
            continue
        mates = [short[o["module_id"]] for o in rows if r["package"] is not None and o["package"] == r["package"] and o["module_id"] != m]
        honest = not mates or (r["breadth"] == 0 and all(x[: len(own)] == own for x in mates))
        filler = own[-1] if own else f"Module {m}"
        package = (r["package_name"] or filler) if honest else filler
        joined = "+".join(r["children"]) if 0 < r["breadth"] <= BREADTH else package
        tiers[m] = [own[0] if own else joined, own[-1] if own else joined, joined, package]
    final: dict[int, str] = {}
    taken: set[str] = set()
    for k in range(4):
        count = Counter(tiers[m][k] for m in tiers if m not in final)
        fresh = {m: tiers[m][k] for m in tiers if m not in final and count[tiers[m][k]] == 1 and tiers[m][k] not in taken}
        final |= fresh
        taken |= set(fresh.values())
    rest: dict[str, list[int]] = {}
    for m in sorted(tiers):
        if m not in final:
            rest.setdefault(tiers[m][1], []).append(m)
    for name, group in rest.items():
        numbered = len(group) > 1 and name not in taken
        final |= {m: f"{name}-{k}" if numbered else f"Module {m}" for k, m in enumerate(group, 1)}
    return final


def names(files: DataFrame) -> DataFrame:
    """id, name of every module; one task settles a repository's names, which are few beside its files."""
    ship(files.sparkSession)
    first = F.coalesce(F.try_element_at(container(F.col("id")), F.lit(1)), F.lit(""))
    root = files.filter("module_id is not null").agg(F.when(F.countDistinct(first) == 1, F.min(first)).alias("root"))
    s = summaries(files).crossJoin(F.broadcast(root))  # one row

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [r | {"common": list(r["common"]), "children": list(r["children"])} for r in pdf.to_dict("records")]
        got = settle(rows, pdf.root.iloc[0])
        return pd.DataFrame({"id": list(got), "name": list(got.values())})

    return s.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "id int, name string")
