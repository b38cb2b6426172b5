"""Relational tables read as a code graph: regions are packages, nations directories, customers and suppliers files,
orders and (supplier, part) pairs symbols, part brands externals, line items imports and calls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["function", "method", "class", "const", "type", "interface", "enum"]
LANGUAGES = ["typescript", "javascript", "go", "rust", "java", "python"]


def pick(values: list[str], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (i % len(values)).cast("int"))


@dataclass
class Tables:
    """Lazily read frames of one folder; nothing is collected."""

    spark: SparkSession
    sf_dir: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def places(self) -> DataFrame:
        return self.read("nation").join(F.broadcast(self.read("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_regionkey", F.col("r_name").alias("pkg"), F.concat_ws("/", "r_name", "n_name").alias("dir"), "n_name")

    def files(self) -> DataFrame:
        """id, name, language, extension, dir, pkg, k (key), module_id, reason; 25 nations are broadcast."""
        c = self.read("customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n_nationkey"), F.lit("c").alias("p"), F.lit("ts").alias("extension"), F.lit("typescript").alias("language"))
        s = self.read("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n_nationkey"), F.lit("s").alias("p"), F.lit("go").alias("extension"), F.lit("go").alias("language"))
        f = c.unionByName(s).join(F.broadcast(self.places()), "n_nationkey")
        name = F.concat("p", "k", F.lit("."), "extension")
        none = F.col("k") % 5 == 0
        return f.select(
            F.concat("dir", F.lit("/"), name).alias("id"), name.alias("name"), "language", "extension", "dir", "pkg", "p", "k",
            F.when(~none, F.col("n_nationkey") * 2 + F.col("k") % 2).cast("int").alias("module_id"), F.when(none, F.when(F.col("k") % 2 == 0, "isolated").otherwise("undersized")).alias("reason"),
        )

    def symbols(self) -> DataFrame:
        f = self.files()
        o = self.read("orders").join(f.filter("p = 'c'").select(F.col("k").alias("o_custkey"), F.col("id").alias("file_id")), "o_custkey").select("file_id", F.concat(F.lit("o"), "o_orderkey").alias("local_id"), F.col("o_orderkey").alias("n"))
        p = self.read("lineitem").select("l_suppkey", "l_partkey").distinct().join(f.filter("p = 's'").select(F.col("k").alias("l_suppkey"), F.col("id").alias("file_id")), "l_suppkey").select("file_id", F.concat(F.lit("p"), "l_partkey").alias("local_id"), F.col("l_partkey").alias("n"))
        both = o.unionByName(p)
        return both.select(F.concat_ws("#", "file_id", "local_id").alias("id"), F.col("local_id").alias("name"), "file_id", pick(KINDS, F.col("n")).alias("symbol_kind"), (F.col("n") % 2 == 0).alias("exported"))

    def lines(self) -> DataFrame:
        """One row for each line item: source and target file and symbol, line, order of appearance."""
        f = self.files()
        cust = f.filter("p = 'c'").select(F.col("k").alias("o_custkey"), F.col("id").alias("source"))
        supp = f.filter("p = 's'").select(F.col("k").alias("l_suppkey"), F.col("id").alias("target"))
        rows = self.read("lineitem").join(self.read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(cust, "o_custkey").join(supp, "l_suppkey")
        return rows.select("source", "target", F.concat(F.col("source"), F.lit("#o"), "l_orderkey").alias("caller"), F.concat(F.col("target"), F.lit("#p"), "l_partkey").alias("callee"), F.col("l_linenumber").alias("line"), "l_orderkey", "l_partkey", (F.col("l_returnflag") == "R").alias("re_export"))

    def externals(self) -> DataFrame:
        return self.read("part").select(F.regexp_replace("p_brand", "#", "").alias("name"), F.col("p_size").cast("string").alias("version"))

    def chain(self) -> DataFrame:
        """A multi-hop graph: parts of consecutive lines of an order."""
        lines = self.read("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"))
        nxt = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("part").alias("target"))
        return lines.join(nxt, ["l_orderkey", "l_linenumber"]).filter("part <> target").select(F.col("part").alias("source"), "target").distinct()
