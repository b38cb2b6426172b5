"""I-Match fingerprints: terms of a middle inverse-document-frequency band, hashed over randomised sub-lexicons.

The lexicon holds the terms that between LEAST and MOST of all documents contain (whole texts, all
documents). Its size is bounded: no more than (distinct terms of an average document) / LEAST terms can
be that frequent. It is found in two passes: a term of the band is at least that frequent in one task's share
of the documents too, so tasks first name their candidates, and a second pass counts those exactly.
Each of the 32 sub-lexicons holds a term with a chance of 1 in 32; a fingerprint is one hash over all
sorted distinct lexicon terms, then one over those of each sub-lexicon. The likeness of two fingerprints is the share
of equal hashes among those that either of them has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.columns import quoted
from tessera.llm.parity_join import _targets
from tessera.llm.text import ALNUM, U, Block, blocks, mix
from tessera.plans.session import ship, table, width

LEAST, MOST = 0.002, 0.2
SUBSETS, ONE_IN = 32, 32
SALT = [U(int(x)) for x in np.random.default_rng(5).integers(1, 2**63, SUBSETS + 2, dtype=np.uint64)]
#: Rows alike in id and text that are still dealt one by one; more go as one row with their number.
ALIKE = 1000
#: Such keys (16 bytes each) that are broadcast at most.
BROADCAST = 500_000
#: Candidate terms (8 bytes each) that are sent to the tasks at most; beyond it terms are counted by a shuffle.
CANDIDATES = 4_000_000


def distinct(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, term hash) of the distinct terms of each text, in order of text."""
    _, _, h, first = block.words(ALNUM)
    owner = np.repeat(np.arange(block.n), np.diff(first))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    u, inverse = np.unique(h, return_inverse=True)
    return u, np.bincount(inverse, weights=c, minlength=len(u)).astype(np.int64)


def _local(share: float):
    """Terms of a task's documents, counted; only those that at least this share of them contain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, docs = [], 0, 0
        for batch in batches:
            docs += batch.num_rows
            for b in blocks(batch.column(0)):
                u, c = np.unique(distinct(b)[1], return_counts=True)
                parts.append((u, c))
                held += len(u)
                if held > 1_500_000:
                    parts = [_merged(parts)]
                    held = len(parts[0][0]) // 2
        if parts:
            u, c = _merged(parts)
            keep = c >= share * docs
            yield pa.RecordBatch.from_arrays([pa.array(u[keep].view(np.int64)), pa.array(c[keep])], names=["term", "df"])

    return run


def _exact(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        total = np.zeros(len(terms), dtype=np.int64)
        probe = Probe(terms)
        for batch in batches:
            for b in blocks(batch.column(0)):
                total += np.bincount(probe(distinct(b)[1])[1], minlength=len(terms))
        some = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(terms[some].view(np.int64)), pa.array(total[some])], names=["term", "df"])

    return run


class Probe:
    """Which of many hashes are among sorted terms: a bitmap first, then binary search."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[terms & U((1 << 20) - 1)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that are terms, and which terms."""
        at = np.flatnonzero(self.seen[h & U((1 << 20) - 1)]) if len(self.terms) else np.zeros(0, dtype=np.int64)
        i = np.searchsorted(self.terms, h[at])
        i[i == len(self.terms)] = 0
        ok = self.terms[i] == h[at] if len(at) else np.zeros(0, dtype=bool)
        return at[ok], i[ok]


def lexicon(texts: DataFrame, least: float = LEAST, most: float = MOST) -> np.ndarray:
    """Sorted hashes of the terms whose document frequency lies in the band; texts has one column."""
    spark = texts.sparkSession
    n = texts.count()
    if not n:
        return np.zeros(0, dtype=np.uint64)
    named = texts.mapInArrow(_local(least), "term long, df long").select("term").distinct()
    rows = named.limit(CANDIDATES + 1).toArrow().column(0).to_numpy()
    if len(rows) <= CANDIDATES:
        shared = spark.sparkContext.broadcast(np.sort(rows.view(np.uint64)))
        counted = texts.mapInArrow(_exact(shared), "term long, df long")
    else:
        counted = texts.mapInArrow(_local(0), "term long, df long")
    kept = counted.groupBy("term").agg(F.sum("df").alias("df")).filter((F.col("df") >= least * n) & (F.col("df") <= most * n)).select("term")
    return np.sort(kept.toArrow().column(0).to_numpy().view(np.uint64))


class Printer:
    """Fingerprints of a block of texts."""

    def __init__(self, terms: np.ndarray):
        self.probe = Probe(terms)
        member = np.stack([mix(terms ^ SALT[k]) % U(ONE_IN) == 0 for k in range(SUBSETS)], axis=1) if len(terms) else np.zeros((0, SUBSETS), dtype=bool)
        self.of = [np.flatnonzero(member[:, k]) for k in range(SUBSETS)]
        rows, self.subset = np.nonzero(member)
        self.start = np.searchsorted(rows, np.arange(len(terms) + 1))

    def __call__(self, block: Block) -> np.ndarray:
        """(texts, 1 + subsets) hashes; 0: no term."""
        owner, h = distinct(block)
        out = np.zeros((block.n, SUBSETS + 1), dtype=np.uint64)
        at, i = self.probe(h)
        text, term = owner[at], h[at]
        whole = np.zeros(block.n, dtype=np.uint64)
        np.add.at(whole, text, mix(term ^ SALT[SUBSETS]))
        # texts without a lexicon term: all their terms
        bare = np.bincount(text, minlength=block.n) == 0
        rest = bare[owner]
        np.add.at(whole, owner[rest], mix(h[rest] ^ SALT[SUBSETS + 1]))
        out[:, 0] = whole
        n = self.start[i + 1] - self.start[i]
        pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[i], n)
        k = self.subset[pick]
        np.add.at(out, (np.repeat(text, n), k + 1), mix(np.repeat(term, n) + SALT[SUBSETS] * (k.astype(np.uint64) + U(1))))
        return np.where(out == 0, out, mix(out) | U(1 << 32))


def shown(p: np.ndarray) -> list[str]:
    """Text form: 16 hex digits for the whole lexicon, 8 for each subset (zeros: no term)."""
    raw = [x.tobytes().hex() for x in p[:, :1].byteswap()]
    sub = (p[:, 1:] >> U(32)).astype(">u4")
    return [a + sub[i].tobytes().hex() for i, a in enumerate(raw)]


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal hashes among those that either has; 1 where neither has any."""
    a, b = np.column_stack([a[:, :1] >> U(1), a[:, 1:] >> U(32)]), np.column_stack([b[:, :1] >> U(1), b[:, 1:] >> U(32)])
    either = ((a != 0) | (b != 0)).sum(1)
    both = ((a == b) & (a != 0)).sum(1)
    return np.where(either == 0, 1.0, both / np.maximum(either, 1))


def _pair(shared):
    """Rows come by bucket in order; each has its successor behind it, and a bucket ends with a row that is only a successor.

    Of several rows in one, all but the last have their own text behind them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Printer(shared.value)
        tail = None
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows = batch.slice(i, 512).to_pylist()
                rows = ([tail] if tail else []) + rows
                tail = rows[-1]
                if len(rows) > 1:
                    yield _edited(rows, printer)

    return run


def _edited(rows: list[dict], printer: Printer) -> pa.RecordBatch:
    texts = [r["text"] or "" for r in rows]
    edited = [t[: len(t) - len(t) // 2] + s[: len(t) // 2] for t, s in zip(texts, texts[1:], strict=False)]
    own = np.concatenate([printer(b) for b in blocks(pa.array(texts, pa.large_string()))])
    new = np.concatenate([printer(b) for b in blocks(pa.array(edited, pa.large_string()))])
    keep = [k for k, (r, s) in enumerate(zip(rows, rows[1:], strict=False)) if not r["extra"] and r["bucket"] == s["bucket"]]
    parts = [_result(rows, keep, texts, edited, own, new, own[1:], [1] * len(keep))]
    several = [k for k in keep if rows[k]["times"] > 1]
    if several:
        mine = [texts[k][: len(texts[k]) - len(texts[k]) // 2] + texts[k][: len(texts[k]) // 2] for k in range(len(texts) - 1)]
        again = np.concatenate([printer(b) for b in blocks(pa.array(mine, pa.large_string()))])
        parts.append(_result(rows, several, texts, mine, own, again, own[:-1], [rows[k]["times"] - 1 for k in several]))
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if sum(p.num_rows for p in parts) else parts[0]


def _result(rows: list[dict], keep: list[int], texts: list[str], edited: list[str], own: np.ndarray, new: np.ndarray, following: np.ndarray, times: list[int]) -> pa.RecordBatch:
    near, next_ = alike(own[:-1], new), alike(own[:-1], following)
    a, b = shown(own), shown(new)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[k]["doc_id"] for k in keep], pa.int64()),
            pa.array([len(texts[k]) for k in keep], pa.int64()),
            pa.array([hashlib.sha256(edited[k].encode("utf-8", "surrogatepass")).hexdigest() for k in keep], pa.string()),
            pa.array([a[k] for k in keep], pa.string()),
            pa.array([b[k] for k in keep], pa.string()),
            pa.array(near[keep]),
            pa.array(next_[keep]),
            pa.array(times, pa.int64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "times"],
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, most: float = MOST) -> DataFrame:
    """docs' ids with their fingerprint (one pass, no shuffle but for the lexicon). Null texts count as empty."""
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(lexicon(src.select("text"), least, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Printer(shared.value)
        for batch in batches:
            for b in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.n), pa.array(shown(printer(b)), pa.string())], names=["doc_id", "fingerprint"])

    return src.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, most: float = MOST, alike_rows: int = ALIKE) -> DataFrame:
    """Each text's fingerprint against that of the text with its last half replaced and that of the next document.

    The next document is the one of the next lower id (null ids come last; of equal ids, in order of a hash of the
    text); after the last comes the first, and a single row follows itself. The texts move once: to one
    of as many id ranges as the session has partitions; a range's first row goes to the range before as well. An
    id that many rows share is split by the texts' hash; more than alike_rows rows of one id and text go as one row with their number. Empty tables
    give none; null texts count as empty.
    """
    spark = docs.sparkSession
    ship(spark)
    n = width(spark)
    src = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(lexicon(src.select("text"), least, most))
    keyed = src.withColumn("tie", F.xxhash64("text")).withColumn("back", F.coalesce(-F.col("doc_id"), F.lit(2**63 - 1))).withColumn("times", F.lit(1).cast("long"))
    # repeated rows of which there are too many for a partition: few such keys, as each stands for more than alike_rows rows
    many = keyed.groupBy("back", "tie").count().filter(F.col("count") > alike_rows).select("back", "tie")
    if not many.isEmpty():
        many, _ = table(many, "imatch-many")
        many = F.broadcast(many) if many.count() <= BROADCAST else many
        once = keyed.join(many, ["back", "tie"], "left_semi").groupBy("back", "tie", "doc_id", "text").agg(F.sum("times").alias("times"))
        keyed = keyed.join(many, ["back", "tie"], "left_anti").unionByName(once)
    cuts = keyed.agg(F.percentile_approx("back", [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else []
    cuts = sorted(cuts or [])
    # a value that is several cuts: its rows are split by their hash
    lower = {c: cuts.index(c) for c in set(cuts)}
    wide = {c: cuts.count(c) for c in set(cuts) if cuts.count(c) > 1}
    bounds = F.array(*(F.lit(c).cast("long") for c in cuts)) if cuts else F.array().cast("array<long>")
    bucket = F.size(F.filter(bounds, lambda c: c < F.col("back")))
    for c, m in wide.items():
        share = (F.shiftrightunsigned("tie", 33) * m / 2**31).cast("int")
        bucket = F.when(F.col("back") == c, F.lit(lower[c]) + share).otherwise(bucket)
    keyed = keyed.withColumn("bucket", bucket.cast("int"))
    # the share must follow the order of the hash within an id: unsigned, as the shift above
    turned = F.col("tie").bitwiseXOR(F.lit(-(2**63)))
    keyed = keyed.withColumn("tie", turned)
    heads = {r["bucket"]: (r["h"]["back"], r["h"]["tie"]) for r in keyed.groupBy("bucket").agg(F.min(F.struct("back", "tie")).alias("h")).collect()}
    filled = sorted(heads)
    to = {heads[b]: filled[k - 1] for k, b in enumerate(filled)}
    target = F.array(*(F.lit(int(x)) for x in _targets(spark, n)))
    # one row for each bucket, so as many as partitions
    first = spark.createDataFrame([(back, tie, b) for (back, tie), b in to.items()], "back long, tie long, before int")
    places = F.when(F.col("before").isNull(), F.array(F.struct("bucket", F.lit(False).alias("extra")))).otherwise(F.array(F.struct("bucket", F.lit(False).alias("extra")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("extra"))))
    dealt = keyed.join(F.broadcast(first), ["back", "tie"], "left").select("doc_id", "text", "back", "tie", "times", F.explode(places).alias("p")).select("doc_id", "text", "back", "tie", "times", "p.bucket", "p.extra")
    dealt = dealt.repartition(n, F.element_at(target, F.pmod(F.col("bucket"), F.lit(n)) + 1)).sortWithinPartitions("bucket", "extra", "back", "tie")
    out = dealt.select("doc_id", "text", "bucket", "extra", "times").mapInArrow(_pair(shared), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, times long")
    return out.withColumn("times", F.explode(F.when(F.col("times") == 1, F.array(F.lit(1).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), F.col("times"))))).drop("times")
