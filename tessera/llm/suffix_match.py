"""Benchmark decontamination by suffix arrays over the training text.

Every task sorts the suffixes of its documents, some megabytes (a shard) at a time, by their first 16 words,
or as many as the window has (prefix doubling; only suffixes that still tie are sorted again), then binary-searches every benchmark
suffix in each shard. A found range lists all occurrences; occurrences in a row on one diagonal join to
the longest verbatim match. There is no shuffle: documents never leave their task, and the benchmark, whose
size is checked, goes to every task; a larger one goes in blocks of bounded size, one pass each. Of a block, tasks get the
words' hashes and where windows begin (16 bytes a word at most); windows themselves are cut out only while they are searched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.columns import quoted, unused, whole
from tessera.llm.text import ALNUM, STEP, U, Block, blocks, mix
from tessera.plans.session import release, ship

DEPTH = 16
SHARD = 2 << 20
#: Bytes of benchmark text that one pass takes to the tasks.
ITEMS = 8 << 20
#: Windows that are searched at once.
SEARCHED = 1 << 16

MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())]))


class Queries:
    """The suffixes of benchmark items that begin a window: word hashes of all items, and by window length where windows begin, their item and their place in it."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = [i for i, _ in items]
        hashes, rows, base = [np.zeros(0, dtype=np.uint64)], [np.zeros((0, 4), dtype=np.int64)], 0
        for b in blocks(pa.array([t for _, t in items], pa.large_string())):
            _, _, h, first = b.words(ALNUM)
            words = np.diff(first)
            size = np.minimum(words, window)
            count = np.where(words > 0, words - size + 1, 0)
            item = np.repeat(np.arange(b.n), count)
            at = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
            rows.append(np.column_stack([size[item], base + first[:-1][item] + at, b.first + item, at]))
            hashes.append(h)
            base += len(h)
        self.words, all_ = np.concatenate(hashes), np.concatenate(rows)
        self.by_length = {int(n): all_[all_[:, 0] == n, 1:].astype(np.int32 if base < 1 << 31 else np.int64) for n in np.unique(all_[:, 0])}


def codes(h: np.ndarray) -> np.ndarray:
    return np.maximum((h >> U(32)).astype(np.uint32), 1)


def chain(h: np.ndarray) -> np.ndarray:
    """One hash of each row of words."""
    out = np.zeros(len(h), dtype=np.uint64)
    for j in range(h.shape[1]):
        out = mix(out + h[:, j] * STEP[j % 16])
    return out


def suffix_array(seq: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their first depth codes (or more), and the sorted codes of two. 0 ends a document."""
    n = len(seq)
    wide = seq.astype(np.uint64) << U(32)
    wide[:-1] |= seq[1:].astype(np.uint64)
    order = np.argsort(wide)
    pairs = wide[order]
    head = np.concatenate([[True], pairs[1:] != pairs[:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 2
    while h < depth:
        tied = ~head
        tied[:-1] |= ~head[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        pos = order[slots]
        ahead = np.minimum(pos + h, n - 1)
        key = (rank[pos].astype(np.uint64) << U(32)) | rank[ahead].astype(np.uint64)
        again = np.argsort(key)
        key, pos = key[again], pos[again]
        order[slots] = pos
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head[slots] = new
        rank[pos] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        h *= 2
    return order, pairs


def search(seq: np.ndarray, order: np.ndarray, pairs: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) place in the suffix array of each row of wanted."""
    size = wanted.shape[1]
    key = wanted[:, 0].astype(np.uint64) << U(32)
    if size > 1:
        key = key | wanted[:, 1].astype(np.uint64)
        lo, hi = np.searchsorted(pairs, key), np.searchsorted(pairs, key, side="right")
    else:
        lo, hi = np.searchsorted(pairs, key), np.searchsorted(pairs, key + U(0xFFFFFFFF), side="right")
    live = np.flatnonzero(hi > lo)
    if size <= 2 or not len(live):
        return lo, hi
    padded = np.concatenate([seq, np.zeros(size, dtype=seq.dtype)])
    for upper in (False, True):
        a, b = lo[live].copy(), hi[live].copy()
        q = wanted[live]
        while (a < b).any():
            mid = (a + b) >> 1
            text = padded[order[np.minimum(mid, len(order) - 1)][:, None] + np.arange(size)]
            differ = text != q
            at = differ.argmax(1)
            rows = np.arange(len(q))
            less = text[rows, at] < q[rows, at]
            same = ~differ[rows, at]
            right = (less | same if upper else less) & (a < b)
            a, b = np.where(right, mid + 1, a), np.where(right | (a >= b), b, mid)
        if upper:
            hi[live] = a
        else:
            first = a
    lo[live] = first
    return lo, hi


def occurrences(block: Block, queries: Queries):
    """(text, word in text, item, word in item, words) of every occurrence of a window; and each text's first word."""
    _, _, h, first = block.words(ALNUM)
    words = np.diff(first)
    if not len(h):
        return np.zeros((0, 5), dtype=np.int64), words
    owner = np.repeat(np.arange(block.n), words)
    seq = np.zeros(len(h) + block.n, dtype=np.uint32)
    seq[np.arange(len(h)) + owner] = codes(h)
    order, pairs = suffix_array(seq, max([DEPTH, *queries.by_length]))
    home = np.cumsum(words + 1) - (words + 1)  # where each text begins in seq
    found = []
    for size, starts in queries.by_length.items():
        for part in range(0, len(starts), SEARCHED):
            begin, item, at = starts[part : part + SEARCHED].T
            window = queries.words[begin[:, None] + np.arange(size)]
            lo, hi = search(seq, order, pairs, codes(window))
            n = hi - lo
            q = np.repeat(np.arange(len(n)), n)
            if not len(q):
                continue
            pos = order[np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            text = np.searchsorted(home, pos, side="right") - 1
            word = pos - home[text]
            ok = word + size <= words[text]
            q, text, word = q[ok], text[ok], word[ok]
            same = chain(h[(first[text] + word)[:, None] + np.arange(size)]) == chain(window)[q]
            q, text, word = q[same], text[same], word[same]
            found.append(np.column_stack([text, word, item[q], at[q], np.full(len(q), size)]).astype(np.int64))
    return (np.concatenate(found) if found else np.zeros((0, 5), dtype=np.int64)), words


def longest(rows: np.ndarray) -> np.ndarray:
    """Joins windows that follow each other on a diagonal."""
    if not len(rows):
        return rows
    text, word, item, at, size = rows.T
    order = np.lexsort((word, word - at, item, text))
    text, word, item, at, size = rows[order].T
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (word[1:] - at[1:] != word[:-1] - at[:-1]) | (word[1:] != word[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(rows)) - 1
    return np.column_stack([text[head], word[head], item[head], at[head], word[last] + size[last] - word[head]])


def hits(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """How many words of each text lie in an occurrence."""
    first = np.concatenate([[0], np.cumsum(words)])
    mark = np.zeros(first[-1] + 1, dtype=np.int64)
    begin = first[rows[:, 0]] + rows[:, 1]
    np.add.at(mark, begin, 1)
    np.add.at(mark, begin + rows[:, 4], -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(mark[:-1]) > 0)])
    return inside[first[1:]] - inside[first[:-1]]


def _annotate(text_at: int, shared, added: list[str]):
    """Mapper over rows whose first column is a struct that holds the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for batch in batches:
            for b in blocks(batch.column(0).field(text_at), SHARD):
                rows, words = occurrences(b, queries)
                n_hit = hits(rows, words)
                spans = longest(rows)
                ends = np.searchsorted(spans[:, 0], np.arange(b.n + 1)) if len(spans) else np.zeros(b.n + 1, dtype=np.int64)
                match = [[{"item_id": queries.names[s[2]], "item_word": s[3], "doc_word": s[1], "words": s[4]} for s in spans[ends[i] : ends[i + 1]].tolist()] for i in range(b.n)]
                part = batch.slice(b.first, b.n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(match, MATCH)], names=[*part.schema.names, *added])
        release()

    return run


def _items(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in blocks of at most about limit bytes; each block is small enough for the driver."""
    b = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    total = b.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = 1 + int(total) // limit
    for p in range(parts):
        rows = b if parts == 1 else b.filter(F.pmod(F.xxhash64("i"), F.lit(parts)) == p)
        yield sorted((r.i, r.t) for r in rows.toLocalIterator())


_COVER = "aggregate(array_sort(transform({m}, m -> struct(m.doc_word as b, m.doc_word + m.words as e))), struct(0L as n, 0 as e), (s, m) -> struct(s.n + greatest(0, m.e - greatest(m.b, s.e)) as n, greatest(s.e, m.e) as e), s -> s.n)"


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, limit: int = ITEMS) -> DataFrame:
    """docs with three more columns, the last ones: words, hit (words inside occurrences), matches (longest: item_id, item_word, doc_word, words).

    Their names are _words, _hit and _match, with underscores behind them where docs has such columns, which stay as they are. Words are runs of
    letters and digits, A-Z lower-cased. Items of fewer words than the window are one
    window; items without words, null or empty, match nothing. Null texts have no words. Null item ids count
    as one item named "". A benchmark over limit bytes takes one pass for each block, and hits of blocks are joined by their spans.
    """
    spark = docs.sparkSession
    ship(spark)
    entry = T.StructType([T.StructField("item_id", T.StringType()), *(T.StructField(x, T.IntegerType()) for x in ("item_word", "doc_word", "words"))])
    kinds = {"_words": T.LongType(), "_hit": T.LongType(), "_match": T.ArrayType(entry)}
    out, parts = docs.select(whole(docs).alias("_all")), 0
    for items in _items(benchmark, item_col, item_text, limit):
        # one block at a time is in the driver's memory
        shared = spark.sparkContext.broadcast(Queries(items, window))
        now = [f"{n}{parts}" for n in kinds]
        schema = T.StructType([*out.schema.fields, *(T.StructField(n, k) for n, k in zip(now, kinds.values(), strict=True))])
        out = out.mapInArrow(_annotate(docs.columns.index(text_col), shared, now), schema)
        parts += 1
    hit, match = F.col("_hit0"), F.col("_match0")
    if parts > 1:
        out = out.withColumn("_match", F.concat(*(f"_match{k}" for k in range(parts))))
        hit, match = F.expr(_COVER.format(m="_match")), F.col("_match")
    return out.select("_all.*", *(c.alias(unused(docs, n)) for n, c in zip(kinds, (F.col("_words0"), hit, match), strict=True)))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, matches."""
    found = annotate(docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text")), benchmark, "text", **kw)
    items = F.array_sort(F.array_distinct(F.transform("_match", lambda m: m.item_id)))
    return found.select(
        "doc_id",
        F.col("_words").alias("n_words"),
        F.col("_hit").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("_hit") > 0) & (20 * F.col("_hit") >= F.col("_words"))).alias("contaminated"),
        F.col("_match").alias("matches"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 13, **kw) -> DataFrame:
    """docs without the affected ones: those with a verbatim passage of window words of an item, however long they are themselves.

    Occurrences of items with fewer words than the window, which ordinary text may hold by chance, affect a document only where they
    cover a twentieth of its words. All columns of docs are kept.
    """
    found = annotate(docs, benchmark, text_col, window=window, **kw)
    words, hit, match = (quoted(c) for c in found.columns[-3:])
    affected = F.exists(match, lambda m: m.words >= window) | ((hit > 0) & (20 * hit >= words))
    return found.filter(~affected).select(*(quoted(c) for c in docs.columns))


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
