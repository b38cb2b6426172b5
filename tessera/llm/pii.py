"""Personal data: fixed patterns, and bootstrapped extraction of identifiers from their contexts; DataFrame functions only.

Base spans of four kinds come from regular expressions. They are the seeds: every token that holds a digit or "@" is an
instance, the word before it is a lexical pattern, and (pattern, instance) pairs, counted over all documents, are
the edges of a graph. A seed instance scores 1; a pattern scores the share of its occurrences that its instances' scores back
(smoothed); any other instance scores the mean of its patterns. After some rounds, patterns of high confidence and
enough seeds name further identifiers: the instances of high score that they precede become spans of the kind "other".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.columns import quoted
from tessera.plans.session import table

# Possessive forms of the plain patterns (no position can match later in a run of a class in which its start failed),
# so that long runs of digits or letters cost no more than their length. \G allows a start right behind the last match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
# whole runs of 16 to 19 digits; shorter and longer runs are matches that the length test would drop
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){15,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<!\S)\S*[0-9@]\S*"
KINDS = ("email", "ip", "card", "phone")

ROUNDS, CONFIDENT, SEEDS, SMOOTH = 3, 0.8, 8, 2.0


def let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunked(values: Column) -> Column:
    """An array in pieces of about the square root of its length, so that arrays grown element by element stay short."""

    def cut(v):
        m = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / m).cast("int") - 1), lambda k: F.slice(v, k * m + 1, m))

    return let(values, lambda v: F.when(F.size(v) > 0, cut(v)))


def located(text: Column, pattern: str) -> Column:
    """array<struct<b, e, v>>: begin, end (exclusive, in code points) and text of each match, in order.

    The lengths of what lies between matches are added up within chunks, and chunks are placed by the sums of those before.
    """
    pieces, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = let(values, lambda v: F.zip_with(F.slice(pieces, 1, F.size(v)), v, lambda p, x: F.struct(F.length(p).alias("p"), F.length(x).alias("n"), x.alias("v"))))
    begin = lambda chunk, at: F.aggregate(
        chunk,
        F.struct(at.alias("at"), none().alias("out")),
        lambda s, x: F.struct((s["at"] + x["p"] + x["n"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["p"]).alias("b"), (s["at"] + x["p"] + x["n"]).alias("e"), x["v"].alias("v")))).alias("out")),
        lambda s: s["out"],
    )
    total = lambda chunk: F.aggregate(chunk, F.lit(0), lambda s, x: s + x["p"] + x["n"])
    starts = lambda chunks: F.aggregate(
        F.transform(chunks, total),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
        lambda s: s["out"],
    )
    return F.coalesce(let(chunked(pairs), lambda c: F.flatten(F.zip_with(c, starts(c), begin))), none())


def none() -> Column:
    return F.array().cast("array<struct<b:int,e:int,v:string>>")


def luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    one = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    twice = lambda i: F.when(one(i) > 4, one(i) * 2 - 9).otherwise(one(i) * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, twice(i)).otherwise(one(i)))
    return total % 10 == 0


def small_parts(value: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(value, r"\."), lambda p: F.when(F.length(part(p)) > 3, F.lit(False)).when(part(p) == "", F.lit(True)).otherwise(part(p).try_cast("int") <= 255))


def digit_count(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind; a text without the kind's mark is not searched."""
    has = lambda mark: F.instr(text, mark) > 0
    return {
        "email": F.when(has("@"), located(text, EMAIL)).otherwise(none()),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(located(text, IP), lambda s: small_parts(s["v"]))).otherwise(none()),
        "card": F.when(text.rlike(r"[0-9](?:[ -]?[0-9]){15}"), F.filter(located(text, CARD), lambda s: luhn(s["v"]))).otherwise(none()),
        "phone": F.when(has("+"), F.filter(located(text, PHONE), lambda s: digit_count(s["v"]).between(8, 15))).otherwise(none()),
    }


def _shown(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(kind + ":"), s["b"].cast("string"), F.lit(":"), s["e"].cast("string")))


def tokens(text: Column, seeds: Column) -> Column:
    """array<struct<pattern, item, b, e, seed>>: tokens with a digit or "@", a word next to each, whether it meets a base span.

    The pattern is the word before; behind a bare mark that mark; behind another such token or at the start of the text the word that follows.
    """
    trim = lambda c: F.regexp_replace(c, r"^[^\p{L}\p{N}+@(]+|[^\p{L}\p{N})]+$", "")
    plain = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}=:#-]", ""))
    last, next_ = lambda p: F.regexp_extract(p, r"(\S+)\s*$", 1), lambda p: F.regexp_extract(p, r"^\s*(\S+)", 1)

    def pattern(p, after):
        return F.when(plain(last(p)) != "", plain(last(p))).when(last(p) != "", last(p)).otherwise(F.concat(F.lit(">"), plain(next_(after))))

    def token(x, near):
        head = F.length(F.regexp_extract(x["s"]["v"], r"^[^\p{L}\p{N}+@(]*", 0))
        return F.struct(
            pattern(x["p"], x["q"]).alias("pattern"),
            F.lower(trim(x["s"]["v"])).alias("item"),
            (x["s"]["b"] + head).alias("b"),
            (x["s"]["b"] + head + F.length(trim(x["s"]["v"]))).alias("e"),
            F.exists(near, lambda z: (z["b"] < x["s"]["e"]) & (x["s"]["b"] < z["e"])).alias("seed"),
        )

    def chunk(c, spans):
        # only spans that reach into the chunk are compared with its tokens
        low, high = F.get(c, F.lit(0))["s"]["b"], F.element_at(c, -1)["s"]["e"]
        return let(F.filter(spans, lambda z: (z["b"] < high) & (low < z["e"])), lambda near: F.transform(c, lambda x: token(x, near)))

    both = let(F.split(text, TOKEN, -1), lambda pieces: let(located(text, TOKEN), lambda found: F.zip_with(
        F.zip_with(F.slice(pieces, 1, F.size(found)), F.slice(pieces, 2, F.size(found)), lambda p, q: F.struct(p.alias("p"), q.alias("q"))), found, lambda w, x: F.struct(w["p"].alias("p"), w["q"].alias("q"), x.alias("s")))))
    return let(seeds, lambda spans: F.flatten(F.transform(chunked(both), lambda c: chunk(c, spans))))


def discoveries(edges: DataFrame) -> DataFrame:
    """(pattern, item) of confident patterns and high-scoring instances that are no seeds. edges: pattern, item, w, seed.

    Scores are written each round: joined as tables, items and patterns with very many edges can be split by Spark.
    """
    score = edges.groupBy("item").agg(F.max(F.col("seed").cast("double")).alias("fixed")).withColumn("score", F.col("fixed"))
    for _ in range(ROUNDS):
        score, _ = table(score, "pii-items")
        pattern = edges.join(score, "item").groupBy("pattern").agg((F.sum(F.col("w") * F.col("score")) / (F.sum("w") + SMOOTH)).alias("conf"), F.sum(F.col("fixed")).alias("seeds"))
        pattern, _ = table(pattern, "pii-patterns")
        mean = edges.join(pattern, "pattern").groupBy("item").agg((F.sum(F.col("w") * F.col("conf")) / F.sum("w")).alias("mean"))
        mean, _ = table(mean, "pii-means")
        score = score.join(mean, "item").select("item", "fixed", F.greatest("fixed", "mean").alias("score"))
    good = pattern.filter((F.col("conf") >= CONFIDENT) & (F.col("seeds") >= SEEDS)).select("pattern")
    new = score.filter((F.col("fixed") == 0) & (F.col("score") >= CONFIDENT)).select("item")
    return edges.join(good, "pattern").join(new, "item").select("pattern", "item").distinct()


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_other; one row for each row of docs.

    Spans are code points, the end exclusive. Null texts count as empty. Ids may be null or repeated: what is
    discovered is joined by id, hash and length of the text, so equal rows get equal spans.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    src = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("_text"))
    named = src.select("doc_id", F.xxhash64("doc_id", text).alias("k1"), F.hash(text).alias("k2"), text.alias("_text"))
    first = named.select("doc_id", "k1", "k2", "_text", *(c.alias(k) for k, c in base_spans(F.col("_text")).items()))
    second = first.select("doc_id", "k1", "k2", *KINDS, F.when(F.col("_text").rlike("[0-9@]"), tokens(F.col("_text"), F.concat(*KINDS))).alias("tokens"))
    found, at = table(second, "pii-found")
    each = found.select("k1", "k2", F.inline("tokens")).filter("pattern not in ('', '>') and item <> ''")
    edges = each.groupBy("pattern", "item").agg(F.count("*").alias("w"), F.max("seed").alias("seed"))
    edges, edges_at = table(edges, "pii-edges")
    new = each.filter("not seed").join(discoveries(edges), ["pattern", "item"]).groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("b", "e"))).alias("other"))
    base = found.select("doc_id", "k1", "k2", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.array_join(F.concat(*(_shown(k, F.col(k)) for k in KINDS)), ",").alias("base"))
    more = base.join(new, ["k1", "k2"], "left").withColumn("other", F.coalesce("other", F.array().cast("array<struct<b:int,e:int>>")))
    return more.select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.filter(F.concat(F.array("base"), _shown("other", F.col("other"))), lambda s: s != ""), ",").alias("spans"), F.size("other").cast("long").alias("n_other"),
    )
