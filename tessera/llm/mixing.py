"""Mixing to target weights with soft membership; DataFrame functions only.

A labelled table teaches a naive Bayes classifier over hashed words (counts of a bounded sample); its posteriors
say how much of each domain a document is. Rates, one for each document and never under a floor, are fitted so that
the expected tokens of each domain, the sum of rate * tokens * posterior, come to the targets: projected gradient descent on
the least squares between the two, weighted by the inverse of the D x D Gram matrix, in which the problem is evenly scaled, so
a few rounds do. A round is one aggregation of D sums; rates are not stored but follow from the gradients so far.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.columns import quoted, whole
from tessera.plans.session import table

log = logging.getLogger("tessera")

BUCKETS = 4096
#: Labelled documents that are counted at most.
SAMPLE = 20_000
ROUNDS, CLOSE = 12, 1e-4
#: Share of all expected tokens that a domain has at least; one with less has no documents to take tokens from.
MASS = 1e-6
#: Tokens of evidence that a posterior rests on at most, so that long texts stay soft.
EVIDENCE = 24
SPACE = r"[ \t\n\r\f\x0B]+"


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def places(text: Column) -> Column:
    return F.transform(split_words(F.lower(text)), lambda w: F.pmod(F.hash(w), F.lit(BUCKETS)))


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> list[list[int] | None]:
    """For each domain the log-likelihoods of the buckets, in 1/1024ths; None for one without a labelled word. labelled: id, domain.

    Counted are at most most labelled rows: the first most ids by a hash, and of an id with several texts the one of the smallest hash.
    """
    known = labelled.select(quoted(id_col).alias("_id"), F.col("domain").alias("_domain")).filter(F.col("_id").isNotNull() & F.col("_domain").isin(domains))
    known = known.groupBy("_id").agg(F.min("_domain").alias("_domain")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    text = docs.select(quoted(id_col).alias("_doc"), quoted(text_col).cast("string").alias("_text"))
    own = text.join(F.broadcast(known), F.col("_doc") == F.col("_id")).groupBy("_id", "_domain").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("t"))
    words = own.select("_domain", F.explode(places(F.col("t._text"))).alias("p"))
    count = {(r["_domain"], r["p"]): r["c"] for r in words.groupBy("_domain", "p").agg(F.count("*").alias("c")).collect()}  # at most domains * BUCKETS rows
    out: list[list[int] | None] = []
    for d in domains:
        total = sum(count.get((d, p), 0) for p in range(BUCKETS))
        out.append([round(1024 * math.log((count.get((d, p), 0) + 0.5) / (total + BUCKETS * 0.5))) for p in range(BUCKETS)] if total else None)
    # only differences count; small numbers keep sums small
    for p in range(BUCKETS):
        top = max((m[p] for m in out if m), default=0)
        for m in out:
            if m:
                m[p] -= top
    return out


def score(rows: DataFrame, model: list[list[int] | None]) -> DataFrame:
    """rows (with a column _text) with _n (tokens) and _p (array of chances) in place of _text. A domain without a model has no chance; if none has one, all are even."""
    known = [m for m in model if m]
    if not known:
        even = "array(" + ",".join(["%rD" % (1 / len(model))] * len(model)) + ")"
        return rows.withColumn("_n", F.size(split_words(F.col("_text"))).cast("long")).withColumn("_p", F.expr(even)).drop("_text")
    literal = ["array(" + ",".join(f"{x}" for x in m) + ")" for m in known]
    sums = ", ".join(f"aggregate(_at, 0L, (s, p) -> s + get({a}, p)) / 1024D * least(1D, {EVIDENCE}D / greatest(size(_at), 1))" for a in literal)
    out = rows.withColumn("_at", places(F.col("_text"))).drop("_text")
    out = out.withColumn("_n", F.size("_at").cast("long")).withColumn("_l", F.expr(f"array({sums})")).drop("_at")
    raised = F.transform("_l", lambda x: F.exp(x - F.array_max("_l")))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    share = F.transform(raised, lambda x: F.round(x / total, 9))
    if len(known) == len(model):
        return out.withColumn("_p", share).drop("_l")
    at = iter(range(len(known)))
    return out.withColumn("_q", share).withColumn("_p", F.array(*(F.get("_q", F.lit(next(at))) if m else F.lit(0.0) for m in model))).drop("_l", "_q")


def rate(steps: list[list[float]], floor: float) -> Column:
    """A document's rate after these steps, from 1."""
    r = F.lit(1.0) if floor <= 1 else F.lit(float(floor))
    for s in steps:
        move = sum((F.get("_p", F.lit(d)) * F.lit(float(x)) for d, x in enumerate(s)), F.lit(0.0))
        r = F.greatest(F.lit(float(floor)), r + move)
    return r


def solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Solution of a small positive semidefinite system; a direction without a pivot of its own is left at 0."""
    n = len(b)
    least = 1e-9 * max((abs(x) for row in a for x in row), default=0.0)
    m = [[*map(float, row), float(y)] for row, y in zip(a, b, strict=True)]
    free = list(range(n))
    pivots: list[tuple[int, int]] = []
    for i in range(n):
        p = max(free, key=lambda k: abs(m[k][i]))
        if abs(m[p][i]) <= least:
            continue
        free.remove(p)
        pivots.append((i, p))
        for k in range(n):
            if k != p:
                f = m[k][i] / m[p][i]
                m[k] = [x - f * y for x, y in zip(m[k], m[p], strict=True)]
        if not free:
            break
    out = [0.0] * n
    for i, p in pivots:
        out[i] = m[p][n] / m[p][i]
    return out


def fit(scored: DataFrame, weights: list[float], floor: float = 0.0, total: float | None = None) -> list[list[float]]:
    """Steps whose rates bring the expected tokens to weights * total. total: as many tokens as there are, or, with a floor
    of 1, the least total of which no domain's target lies under what it has.

    A domain of hardly any expected tokens (MASS) cannot be brought anywhere by rates and is left out; its share of the target stays unmet. Whether
    the others came to within CLOSE of theirs after ROUNDS rounds is logged.
    """
    d = len(weights)
    if min(weights, default=0) < 0 or not sum(weights) > 0:
        raise ValueError("target weights must not be negative, and not all zero")
    weights = [w / sum(weights) for w in weights]
    p = [F.get("_p", F.lit(i)) for i in range(d)]
    n = F.col("_n")
    first = scored.agg(*(F.sum(n * x).alias(f"s{i}") for i, x in enumerate(p)), *(F.sum(n * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d))).first()
    have = [float(first[f"s{i}"] or 0.0) for i in range(d)]
    if not sum(have):
        return []
    there = [i for i in range(d) if have[i] > MASS * sum(have)]
    for i in sorted(set(range(d)) - set(there)):
        if weights[i]:
            log.warning("mixing: domain %d has no documents; its target of %.4f of all tokens cannot be met", i, weights[i])
    gram = [[float(first[f"g{min(i, j)}_{max(i, j)}"]) for j in there] for i in there]
    if total is None:
        total = max((have[i] / weights[i] for i in there if weights[i] > 0), default=sum(have)) if floor >= 1 else sum(have)
    goal = [w * total for w in weights]
    steps: list[list[float]] = []
    for turn in range(ROUNDS + 1):
        if steps:
            r = rate(steps, floor)
            got = scored.agg(*(F.sum(n * x * r).alias(f"s{i}") for i, x in enumerate(p))).first()
            have = [float(got[f"s{i}"]) for i in range(d)]
        gap = [goal[i] - have[i] for i in there]
        if max(map(abs, gap)) <= CLOSE * total:
            break
        if turn == ROUNDS:
            log.warning("mixing: after %d rounds the largest gap is %.5f of all tokens", ROUNDS, max(map(abs, gap)) / total)
            break
        move = dict(zip(there, solve(gram, gap), strict=True))
        steps.append([float(f"{move.get(i, 0.0):.9g}") for i in range(d)])
    return steps


def copies(r: Column, *key: str) -> Column:
    """Whole copies: the rate rounded up or down by a hash of the row, so that the mean is the rate."""
    u = F.pmod(F.xxhash64(*key), F.lit(1 << 20)) / float(1 << 20)
    return F.least(F.floor(r) + (u < r - F.floor(r)).cast("long"), F.lit(2**31 - 1)).cast("int")


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], floor: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, a column p_<domain> for each domain, rate, copies; one row for each row of docs.

    Null and empty texts have 0 tokens and even chances of the domains that have labelled documents; the others have none. Targets that cannot be
    reached (a domain without documents) are met as well as nonnegative rates can, and logged. Negative targets and a sum of 0 raise. An empty table gives none.
    """
    domains = sorted(targets)
    model = learn(docs, labelled, domains, id_col=id_col, text_col=text_col)
    slim = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("_text"))
    scored, _ = table(score(slim, model).select("doc_id", "_n", "_p"), "mixing-scored")
    r = F.round(rate(fit(scored, [targets[d] for d in domains], floor), floor), 6)
    out = scored.select("doc_id", F.col("_n").alias("n_tokens"), *(F.get("_p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)), r.alias("rate"))
    return out.withColumn("copies", copies(F.col("rate"), "doc_id", "n_tokens"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], floor: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every row repeated as often as its rate says; with a floor of 1 no row goes. All columns are kept, whatever their names."""
    domains = sorted(targets)
    model = learn(docs, labelled, domains, id_col=id_col, text_col=text_col)
    rows = docs.select(whole(docs).alias("_all"), quoted(id_col).alias("_id"), quoted(text_col).cast("string").alias("_text"))
    scored, _ = table(score(rows, model), "mixing-rows")
    times = copies(rate(fit(scored, [targets[d] for d in domains], floor), floor), "_id", "_n")
    return scored.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times))).select("_all.*")
