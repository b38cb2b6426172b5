"""URL rules by a sorted sweep, in DataFrame functions only.

A rule (host, path) covers its host and all subdomains where the path begins with the rule's. With the host's labels reversed,
"org.example#/es/" is a prefix of every key that the rule covers, hence an interval of the sorted keys. A url has
one key for each suffix of its host that is no longer than the longest rule's host. Rules and keys are
range-partitioned and sorted together once; in that order the rule that began last before a key carries the stack of rules
around it (its own prefixes, longest first), and the first of these that is a prefix of the key is the innermost rule still open. What is open
where a partition begins is one row of each partition before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.session import cut, width

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(host, path, verdict) rows, made without Python workers."""
    rows = ", ".join("('{}', '{}', '{}')".format(*(x.replace("\\", "\\\\").replace("'", "\\'") for x in r)) for r in rules)
    return spark.sql(f"select * from values {rows} as t(host, path, verdict)") if rules else spark.sql("select '' as host, '' as path, '' as verdict where false")


def split_url(url):
    """Host (A-Z lower-cased) and path of a url; both empty for null and where there is no '://'."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_labels(host):
    return F.reverse(F.split(host, r"\.", -1))


def stacked(rules: DataFrame) -> DataFrame:
    """Distinct rules with key and stack: the rules that are prefixes of the key, itself included, longest first.

    A host and path given twice keeps the smaller verdict ('allow' before 'block').
    """
    r = rules.groupBy(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).agg(F.min("verdict").alias("verdict"))
    r = r.withColumn("key", F.concat(F.array_join(reversed_labels(F.col("host")), "."), F.lit("#"), F.col("path"))).withColumn("rule", F.concat("host", "path"))
    one = F.struct(F.col("key"), F.col("rule"), F.col("verdict"))
    heads = r.select(F.col("key").alias("of"), F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.left("key", i))).alias("head"))
    around = heads.join(r.select(F.col("key").alias("head"), one.alias("r")), "head")
    return around.groupBy(F.col("of").alias("key")).agg(F.sort_array(F.collect_list(F.struct((-F.length("r.key")).alias("size"), F.col("r")))).alias("s")).select("key", F.col("s.r").alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict; one row for each row of pages. A url that no rule fits has a null rule and the verdict otherwise.

    The longest fitting rule wins, by characters of host and path together; of equally long ones that of the longer
    host. Null urls and urls without '://' have empty host and path. Repeated rows stay; null ids are ids like others. The number
    of rules is free: they are never collected or broadcast.
    """
    spark = pages.sparkSession
    n = width(spark)
    src = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("_url"))
    host, path = split_url(F.col("_url"))
    # copies of a row go through the sweep once
    urls = src.select("page_id", host.alias("host"), path.alias("path")).groupBy("page_id", "host", "path").agg(F.count("*").alias("copies"))
    known = stacked(rules)
    longest = known.agg(F.max(F.size(F.split(F.element_at(F.split("key", "#"), 1), r"\.", -1)))).first()[0] or 0  # one number
    labels = reversed_labels(F.col("host"))
    levels = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(int(longest), 1))))
    keys = urls.select("page_id", "host", "path", "copies", F.explode(F.transform(levels, lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit("#"), F.col("path")))).alias("key"))
    events = known.select(F.lit(None).cast(pages.schema[id_col].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.lit(0).cast("long").alias("copies"), "key", "stack", F.lit(0).alias("kind"))
    both = events.unionByName(keys.withColumn("stack", F.lit(None).cast(known.schema["stack"].dataType)).withColumn("kind", F.lit(1)))
    # rules come before keys that equal them; the id spreads a key that many pages share
    swept = cut(both.repartitionByRange(n, "key", "kind", "page_id", "host").withColumn("_part", F.spark_partition_id()))
    last = swept.filter("kind = 0").groupBy("_part").agg(F.max_by("stack", "key").alias("open"))
    parts = spark.range(n).select(F.col("id").cast("int").alias("_part")).join(last, "_part", "left")
    before = parts.select("_part", F.last("open", True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("open"))
    running = F.last("stack", True).over(Window.partitionBy("_part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    open_ = swept.withColumn("running", running).filter("kind = 1").join(F.broadcast(before), "_part", "left")  # a row for each partition
    found = open_.withColumn("hit", F.filter(F.coalesce("running", "open"), lambda r: F.startswith(F.col("key"), r["key"])))
    first = F.get("hit", F.lit(0))
    best = found.groupBy("page_id", "host", "path").agg(F.max("copies").alias("copies"), F.max(F.when(first.isNotNull(), F.struct(F.length(first["rule"]).alias("size"), F.length(first["key"]) - F.length("path"), first["rule"].alias("rule"), first["verdict"].alias("verdict")))).alias("b"))
    out = best.select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(otherwise)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
    return out.drop("_copy")
