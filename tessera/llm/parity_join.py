"""Near-duplicate join on word shingles by parity sketches.

A document is the set of its distinct five-word shingles (hashed to 64 bits). Its sketch deals the
shingles out to k bands by hash; a band is the XOR (parity) of its shingles' codes. One shingle more or
less changes one band, so the number of bands in which two sketches differ (their Hamming distance over
bands) is at most the size of the symmetric difference. At a similarity of t the latter is at most
(1-t)/(1+t) times the sum of the sizes, d for short; hence, by the pigeonhole principle, among more than
d filled bands of one sketch at least one is equal in the other.

k depends on the size band (powers of two) alone, and documents just above the boundary of a size band
also send that band's sketch, so any two linked documents meet in the band of the smaller one. A pair is safe as
soon as one of the two has more than d filled bands. Sets that have not (few, by the choice of k) could only miss each
other; in addition to their bands they send every single shingle to each other, so no link rests on chance.

1. map: texts to (band key, set id); equal sets have equal ids, so copies never multiply.
2. one shuffle by key, packed, finds the keys that two different sets share. A set with more than d keys of
   its own has no partner; that is exact, and most sets end here.
3. survivors keep their rarest keys (prefix filter over the common order frequency, key): d + 1 for one common key, and up
   to MEET - 1 more, so that linked sets have as many keys in common within their prefixes.
4. stars: of each key's sets, all are verified against one pivot, and what a star joins is contracted.
5. keys that still hold several components give their pairs, counted. Pairs whose bit sketches (one bit a shingle, again a
   lower bound of the symmetric difference) are too far apart are dropped before any set is fetched; of the
   rest the closest pair of two components is verified first, and others only if it did not join them.
   Sets of frequent keys are compared by blocks, bit sketches alone first, and a block yields no more links than it has sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.columns import quoted, unused, whole
from tessera.llm.graph import components
from tessera.llm.text import SOLID, STEP, U, blocks, grams, mix
from tessera.plans.session import discard, release, rest, ship, table, width

SMALL = 16
#: Least bits of a bit sketch; a set of more than half as many shingles has two bits a shingle, rounded up to a power of two.
SKETCH = 2048
#: Keys that a linked pair has in common within the prefixes, where the number of bands allows it.
MEET = 4
#: Level of the single shingles that sets with too few filled bands send: that of their band and this.
SINGLE = 32
#: Sets of a key with more sets than this are compared by blocks.
CROWD = 64
#: Sets (8 bytes each) whose ids are broadcast at most.
NEAR = 500_000
FLUSH = 1 << 20


def bands(level: np.ndarray) -> np.ndarray:
    """Bands of a size band; sizes from s = 16 * 2**(level-1). Chosen so that filled bands outnumber d in nearly all sets."""
    s = SMALL << (level - 1)
    return np.where(s < 128, 4 * s, (4 * s) // 5)


def allowed(n, own, num: int, den: int):
    """Largest symmetric difference of a set of n shingles and a partner: in its own size band, or in the one below (the partner is smaller)."""
    return np.where(own, (n + n * den // num) * (den - num) // (den + num), 2 * n * (den - num) // (den + num))


def level_of(n: np.ndarray) -> np.ndarray:
    """0 for fewer than 16 shingles, then one for each power of two."""
    return np.where(n < SMALL, 0, np.frexp(np.maximum(n, 1) / SMALL)[1])


def sets(block, size: int):
    """Distinct shingle hashes of each text, sorted; index of each text's first (one more)."""
    _, _, h, first = block.words(SOLID)
    g, index = grams(h, first, size)
    words = np.diff(first)
    short = np.flatnonzero((words > 0) & (words < size))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for j in range(size - 1):
            has = words[short] > j
            extra[has] += h[first[short[has]] + j] * STEP[j]
        extra = mix(extra + words[short].astype(np.uint64) * STEP[15])
        g = np.insert(g, index[short], extra)
        index = index + np.searchsorted(short, np.arange(block.n + 1))
    if not len(g):
        return g, index
    g = g.copy()
    for i in range(block.n):
        g[index[i] : index[i + 1]].sort()
    new = np.ones(len(g), dtype=bool)
    new[1:] = g[1:] != g[:-1]
    new[index[:-1][index[:-1] < len(g)]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return g[new], kept[index]


def set_ids(g: np.ndarray, index: np.ndarray) -> np.ndarray:
    """One 64-bit id of each set; 0 for the empty set."""
    n = np.diff(index)
    out = np.zeros(len(n), dtype=np.uint64)
    full = n > 0
    if full.any():
        out[full] = mix(np.add.reduceat(mix(g ^ STEP[14]), index[:-1][full]) + n[full].astype(np.uint64) * STEP[13])
    return out.view(np.int64)


def sketch_keys(g: np.ndarray, owner: np.ndarray, level: np.ndarray):
    """Key and owner of each filled band. level: of each shingle's owner; owners ascend."""
    code = mix(g ^ STEP[12])
    k = bands(level).astype(np.uint64)
    band = np.where(level == 0, code >> U(20), ((code >> U(32)) * k) >> U(32))
    order = np.lexsort((band, owner))
    band, owner, code, level = band[order], owner[order], g[order], level[order]
    head = np.ones(len(band), dtype=bool)
    head[1:] = (band[1:] != band[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(head)
    parity = np.bitwise_xor.reduceat(mix(code ^ STEP[11]), at)
    band, owner, level = band[at], owner[at], level[at]
    filled = parity != 0
    key = mix(parity[filled] + mix(band[filled] * STEP[10] + level[filled].astype(np.uint64)))
    return key, owner[filled], level[filled]


def _deal(size: int, targets: np.ndarray, num: int, den: int):
    """Mapper: packed keys for each target partition, and the ids and sizes of all documents."""
    n = len(targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count, turn = 0, TaskContext.get().partitionId() if TaskContext.get() else 0
        seen: set[int] = set()
        schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])

        def flush():
            nonlocal held, count
            if not held:
                return
            key, sid, level = (np.concatenate(x) for x in zip(*held, strict=True))
            held, count = [], 0
            # 6 bits of level, then 34 of hash; the partition comes from other bits
            part = (key & U(0xFFFFFF)) % U(n)
            code = (level.astype(np.uint64) << U(34)) | (key >> U(30))
            order = np.argsort(part, kind="stable")
            part, code, sid = part[order], code[order], sid[order]
            ends = np.searchsorted(part, np.arange(n + 1))
            out = []
            for p in np.flatnonzero(np.diff(ends)):
                c, s = code[ends[p] : ends[p + 1]], sid[ends[p] : ends[p + 1]]
                head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                runs = np.diff(np.append(head, len(s))).astype(np.int32)
                five = np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                out.append((int(targets[p]), 1, five, s[head].tobytes(), runs.tobytes()))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            doc = batch.column(0)
            for b in blocks(batch.column(1)):
                g, index = sets(b, size)
                n_set, sid = np.diff(index), set_ids(g, index)
                level = level_of(n_set)
                fresh = np.zeros(b.n, dtype=bool)
                for i, x in enumerate(sid.tolist()):
                    if x not in seen and n_set[i]:
                        fresh[i] = True
                        seen.add(x)
                filled = np.zeros((b.n, 2), dtype=np.int32)
                # just above a boundary: within 4/3 of the start of its size band
                low = fresh & (level > 0) & (4 * (SMALL << np.maximum(level - 1, 0)) > 3 * n_set)
                every = np.repeat(np.arange(b.n), n_set)
                for which, chosen, lv in ((0, fresh, level), (1, low, level - 1)):
                    each = chosen[every]
                    if each.any():
                        own = every[each]
                        key, owner, at = sketch_keys(g[each], own, lv[own])
                        filled[:, which] = np.bincount(owner, minlength=b.n)
                        held.append((key, sid[owner], at))
                        count += len(key)
                        weak = chosen & (filled[:, which] <= allowed(n_set.astype(np.int64), which == 0, num, den))
                        if weak.any():
                            one = weak[every]
                            held.append((mix(g[one] ^ STEP[8]), sid[every[one]], lv[every[one]] + SINGLE))
                            count += int(one.sum())
                turn += 1
                ident = doc.slice(b.first, b.n)
                meta = np.column_stack([n_set.astype(np.int32), filled, ident.is_null().to_numpy(zero_copy_only=False).astype(np.int32)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(targets[turn % n])], pa.int32()), pa.array([0], pa.int32()), pa.array([ident.cast(pa.int64()).fill_null(0).to_numpy().tobytes()], pa.binary()), pa.array([sid.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(meta).tobytes()], pa.binary())],
                    schema=schema,
                )
                if count >= FLUSH:
                    yield from flush()
        yield from flush()
        seen.clear()
        release()

    return run


_SHARED = "kind int, doc_id long, sid long, n int, own int, low int, key long, cnt int, level int"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reducer: documents pass; of the keys, those that two different sets share."""
    keys, sids = [], []
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("own", pa.int32()), ("low", pa.int32()), ("key", pa.int64()), ("cnt", pa.int32()), ("level", pa.int32())])
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    none = lambda n, t: pa.nulls(n, t)
    for batch in batches:
        for kind, a, b, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if kind == 0:
                meta = np.frombuffer(c, dtype=np.int32).reshape(-1, 4)
                n = len(meta)
                cols = [pa.array(np.zeros(n, np.int32)), pa.array(np.frombuffer(a, np.int64), mask=meta[:, 3] == 1), pa.array(np.frombuffer(b, np.int64)), *(pa.array(np.ascontiguousarray(meta[:, i])) for i in range(3)), none(n, pa.int64()), none(n, pa.int32()), none(n, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)
            else:
                five = np.frombuffer(a, dtype=np.uint8).reshape(-1, 5)
                k = np.zeros((len(five), 8), dtype=np.uint8)
                k[:, :5] = five
                keys.append(k.view(np.uint64).ravel())
                sids.append(np.repeat(np.frombuffer(b, np.int64), np.frombuffer(c, np.int32)))
    if not keys:
        return
    key, sid = np.concatenate(keys), np.concatenate(sids)
    del keys, sids
    order = np.argsort(key)
    key, sid = key[order], sid[order]
    same = key[1:] == key[:-1]
    twin = np.zeros(len(key), dtype=bool)
    twin[1:] |= same
    twin[:-1] |= same
    key, sid = key[twin], sid[twin]
    order = np.lexsort((sid, key))
    key, sid = key[order], sid[order]
    if not len(key):
        return
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
    key, sid = key[new], sid[new]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    cnt = np.repeat(np.diff(np.append(head, len(key))), np.diff(np.append(head, len(key)))).astype(np.int32)
    key, sid, cnt = key[cnt > 1], sid[cnt > 1], cnt[cnt > 1]
    level = (key >> U(34)).astype(np.int32)
    # the partition is part of a key: its number goes above the 40 bits of level and hash
    name = (np.uint64(part) << U(40) | key).view(np.int64)
    for i in range(0, len(key), 100_000):
        j = slice(i, i + 100_000)
        n = len(key[j])
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), none(n, pa.int64()), pa.array(sid[j]), none(n, pa.int32()), none(n, pa.int32()), none(n, pa.int32()), pa.array(name[j]), pa.array(cnt[j]), pa.array(level[j])], schema=schema)


def bits_of(n: int) -> int:
    """Bits of the sketch of a set of n shingles."""
    return max(SKETCH, 1 << int(2 * n - 1).bit_length()) if n else SKETCH


def fold(sketch: np.ndarray, width: int) -> np.ndarray:
    """A wider sketch (packed bytes, last axis) as one of width bytes: the parity of its halves, again and again."""
    while sketch.shape[-1] > width:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def _gather(size: int):
    """Sets and bit sketches of the documents that are left; a task gives each set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for b in blocks(batch.column(0)):
                g, index = sets(b, size)
                sid, n = set_ids(g, index), np.diff(index)
                keep = []
                for i, x in enumerate(sid.tolist()):
                    if n[i] and x not in seen:
                        seen.add(x)
                        keep.append(i)
                bits = []
                for i in keep:
                    wide = bits_of(int(n[i]))
                    at = (mix(g[index[i] : index[i + 1]] ^ STEP[9]) & U(wide - 1)).astype(np.int64)
                    bits.append(np.packbits((np.bincount(at, minlength=wide) & 1).astype(np.uint8)).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sid[keep], pa.int64()), pa.array(n[keep].astype(np.int32), pa.int32()), pa.array([g[index[i] : index[i + 1]].tobytes() for i in keep], pa.binary()), pa.array(bits, pa.binary())],
                    names=["sid", "n", "items", "bits"],
                )

    return run


def _verify(num: int, den: int):
    """Exact similarity of pairs; both sets come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(den * both >= num * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _close(num: int, den: int):
    """Pairs that their bit sketches allow to be linked, with the distance of the sketches. Columns: a, b, n, m, p, q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = batch.column(4), batch.column(5)
            far = np.zeros(batch.num_rows, dtype=np.int64)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(p[i].as_buffer(), np.uint8), np.frombuffer(q[i].as_buffer(), np.uint8)
                w = min(len(x), len(y))
                far[i] = np.bitwise_count(fold(x, w) ^ fold(y, w)).sum()
            both = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            mask = pa.array(far * (den + num) <= (den - num) * both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array(far.astype(np.int32)).filter(mask)], names=["a", "b", "far"])

    return run


def _grid(bits, n: np.ndarray, comp: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of the pairs of different components, of sets in a block, that sizes and sketches allow; sketches of one width at a time."""
    raw = [np.frombuffer(x, np.uint8) for x in bits]
    width = np.array([len(x) for x in raw])
    out = []
    for w in np.unique(width):
        # linked sets differ by a third in size at most, so by one step in width
        a, b = np.flatnonzero(width == w), np.flatnonzero((width == w) | (width == 2 * w))
        x = np.unpackbits(np.stack([raw[i] for i in a]), axis=1).astype(np.float32)
        y = np.unpackbits(np.stack([fold(raw[i], int(w)) for i in b]), axis=1).astype(np.float32)
        far = x.sum(1)[:, None] + y.sum(1)[None] - 2 * (x @ y.T)
        m, k = n[a][:, None], n[b][None]
        ok = (far * (den + num) <= (den - num) * (m + k)) & (den * np.minimum(m, k) >= num * np.maximum(m, k)) & (comp[a][:, None] != comp[b][None])
        i, j = np.nonzero(ok)
        out.append((a[i], b[j], far[i, j]))
    i, j, far = (np.concatenate(x) for x in zip(*out, strict=True))
    once = (i < j) | (width[i] != width[j])
    return i[once], j[once], far[once]


def _suspect(num: int, den: int):
    """Of two blocks of a crowd's sets those that sketches alone allow a partner of another component."""

    def run(pdf):
        pdf = pdf.drop_duplicates("sid").sort_values("sid")
        i, j, _ = _grid(pdf.bits, pdf.n.to_numpy().astype(np.int64), pdf.comp.to_numpy(), num, den)
        return pdf.iloc[np.unique(np.concatenate([i, j]))][["crowd", "i", "j", "sid", "n", "comp"]]

    return run


def _blocked(num: int, den: int):
    """Links over components between two blocks of a crowd's sets: a spanning forest of them, so no more rows than sets.

    Pairs that bit sketches and sizes allow are verified in the order of their distance; those that are joined already are not.
    """

    def run(pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates("sid").sort_values("sid")
        n, comp = pdf.n.to_numpy().astype(np.int64), pdf.comp.to_numpy()
        i, j, far = _grid(pdf.bits, n, comp, num, den)
        order = np.argsort(far, kind="stable")
        top = {c: c for c in comp.tolist()}

        def find(c):
            while top[c] != c:
                top[c] = top[top[c]]
                c = top[c]
            return c

        sets_ = [np.frombuffer(x, np.uint64) for x in pdf["items"]]
        sid, found = pdf.sid.to_numpy(), []
        for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
            a, b = find(comp[x]), find(comp[y])
            if a == b:
                continue
            both = len(np.intersect1d(sets_[x], sets_[y], assume_unique=True))
            if den * both >= num * (n[x] + n[y] - both):
                top[max(a, b)] = min(a, b)
                found.append((int(sid[x]), int(sid[y])))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def _targets(spark, n: int) -> np.ndarray:
    """For each of n partitions a number that repartition() deals to it."""
    rows = spark.range(n * 32 + 1000).select(F.col("id").cast("int").alias("v"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("v").alias("v")).collect()
    out = np.zeros(n, dtype=np.int32)
    for r in rows:
        out[r.p] = r.v
    return out


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles (long), component_id (the smallest id that links reach).

    Two documents link when 100 * intersection >= percent * union of their shingle sets. A text of fewer
    than size words is one shingle; null and empty texts have none and link with nothing, not even with each
    other. Repeated rows stay repeated. Null ids link like others and are never chosen unless a component
    has no other; its component_id is then null. Other columns are not read; an empty table gives none.
    Bands and the hand-down to the smaller size band are made for 75 percent: a lower one is refused, as links would be lost.
    """
    if percent < 75:
        raise ValueError(f"percent is {percent}; below 75 links between sets of different size bands would be lost")
    spark = docs.sparkSession
    ship(spark)
    num, den = percent, 100
    src = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    n = width(spark)
    dealt = src.mapInArrow(_deal(size, _targets(spark, n), num, den), "bucket int, kind int, a binary, b binary, c binary").repartition(n, "bucket").drop("bucket")
    used: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        out, at = table(df, name)
        used.append(at)
        return out

    met = kept(dealt.mapInArrow(_meet, _SHARED), "parity-met")
    meta = met.filter("kind = 0").select("doc_id", "sid", "n", "own", "low")
    shared = met.filter("kind = 1").select("sid", "key", "cnt", F.col("level").cast("byte").alias("level"))
    # one row for each different set; copies of a text met by another task have 0 filled bands there or the same number
    classes = kept(meta.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("own").alias("own"), F.max("low").alias("low")), "parity-sets")
    mine = F.when(F.col("n") < SMALL, 0).otherwise((F.floor(F.log2(F.greatest(F.col("n"), F.lit(1)) / SMALL) + 1e-9) + 1).cast("int"))
    as_small = F.expr(f"cast((n + (n * {den}) div {num}) * {den - num} div {den + num} as int)")
    as_large = F.expr(f"cast((2 * n) * {den - num} div {den + num} as int)")
    held = shared.groupBy("sid", "level").agg(F.count("*").cast("int").alias("s"))
    own = F.col("level") % SINGLE == F.col("mine")
    # m: keys that were sent; s: those of them that others have, too; d: how many a partner may lack
    spare = F.col("m") - F.col("d")
    alive = kept(
        held.join(classes, "sid")
        .withColumn("mine", mine)
        .withColumn("m", F.when(F.col("level") >= SINGLE, F.col("n")).when(own, F.col("own")).otherwise(F.col("low")))
        .withColumn("d", F.when(own, as_small).otherwise(as_large))
        .filter("m - s <= d")
        .withColumn("meet", F.greatest(F.lit(1), F.least(F.lit(MEET), spare)))
        .select("sid", "level", "rep", "n", "meet", (F.col("d") + F.col("meet") - (F.col("m") - F.col("s"))).alias("keep")),
        "parity-alive",
    )
    order = Window.partitionBy("sid", "level").orderBy("cnt", "key")
    prefix = kept(shared.join(alive, ["sid", "level"]).withColumn("r", F.row_number().over(order)).filter("r <= keep").select("sid", "key", "level", "n", "meet"), "parity-prefix")
    rest(spark)
    reps = alive.select(F.coalesce("rep", F.lit(-(2**63))).alias("at"))
    left = alive.select("sid")
    chosen = src.join(_small(reps), F.coalesce("doc_id", F.lit(-(2**63))) == F.col("at"), "left_semi").select("text")
    items = kept(chosen.mapInArrow(_gather(size), "sid long, n int, items binary, bits binary").join(_small(left), "sid", "left_semi"), "parity-items")
    edges: list[DataFrame] = []
    label = None
    for turn in range(2):
        star = kept(_stars(prefix, label, turn, num, den), "parity-star")
        edges.append(kept(_checked(star, items, num, den), "parity-linked"))
        label = kept(components(_all(edges)), "parity-label")
    pairs, crowds = _rest(prefix, label, items, num, den, kept)
    if crowds is not None:
        edges.append(crowds)
        label = kept(components(_all(edges)), "parity-label")
    apart = kept(_apart(pairs, label), "parity-apart")
    if apart.count():
        # the closest pair of any two components first: what it joins needs no other
        first = kept(apart.groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.min(F.struct("far", "a", "b")).alias("p")).select("p.a", "p.b"), "parity-first")
        edges.append(kept(_checked(first, items, num, den), "parity-linked"))
        label = kept(components(_all(edges)), "parity-label")
        again = kept(_apart(apart.join(first, ["a", "b"], "left_anti"), label).select("a", "b"), "parity-again")
        if again.count():
            edges.append(kept(_checked(again, items, num, den), "parity-linked"))
            label = kept(components(_all(edges)), "parity-label")
    # only sets with a link have a label; a component of very many is dealt over salts
    salts = 16
    linked = label.withColumnRenamed("id", "sid").join(classes.select("sid", "rep"), "sid")
    least = linked.groupBy("comp").agg(F.min("rep").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    of_set = linked.withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(salts)).cast("int")).join(least, ["comp", "salt"]).select("sid", "component_id", F.lit(True).alias("linked"))
    # a table, so that Spark deals out both sides of the next join for it alone and can split a set that very many documents share
    named = kept(classes.select("sid", "rep").join(of_set, "sid", "left").select("sid", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id")), "parity-named")
    result, _ = table(
        meta.join(named, "sid", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")),
        "parity-classes",
    )
    for p in used:
        discard(spark, p)
    return result


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _small(df: DataFrame) -> DataFrame:
    """df (columns of a written table), to be broadcast if it has at most NEAR rows of a few numbers; a larger one is shuffled."""
    return F.broadcast(df) if df.count() <= NEAR else df


def _fits(a: Column, b: Column, num: int, den: int) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _labelled(rows: DataFrame, label: DataFrame | None, sid: str = "sid", comp: str = "comp") -> DataFrame:
    if label is None:
        return rows.withColumn(comp, F.col(sid))
    return rows.join(_small(label.select(F.col("id").alias(sid), F.col("comp").alias(comp))), sid, "left").withColumn(comp, F.coalesce(comp, sid))


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """a, b, far, ca, cb: pairs of two components still."""
    return _labelled(_labelled(pairs.select("a", "b", "far"), label, "a", "ca"), label, "b", "cb").filter("ca <> cb")


def _stars(prefix: DataFrame, label: DataFrame | None, turn: int, num: int, den: int) -> DataFrame:
    """For each set one pair: with the pivot of another component that most of its keys name."""
    rows = _labelled(prefix, label)
    pick = F.struct(F.xxhash64("comp", F.lit(turn)).alias("o"), "sid", "comp", "n")
    pivots = rows.groupBy("key").agg(F.min(pick).alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key", "p")
    named = rows.join(pivots, "key").filter((F.col("p.comp") != F.col("comp")) & _fits(F.col("n"), F.col("p.n"), num, den))
    votes = named.groupBy("sid", F.col("p.sid").alias("pivot")).agg(F.count("*").alias("c"))
    best = votes.groupBy("sid").agg(F.max(F.struct("c", "pivot")).alias("b")).select("sid", F.col("b.pivot").alias("pivot"))
    # two that name each other are one pair
    return best.groupBy(F.least("sid", "pivot").alias("x"), F.greatest("sid", "pivot").alias("y")).agg(F.min("sid").alias("a"), F.min_by("pivot", "sid").alias("b")).select("a", "b")


def _rest(prefix: DataFrame, label: DataFrame, items: DataFrame, num: int, den: int, kept) -> tuple[DataFrame, DataFrame | None]:
    """What different components still have in common: pairs (a, b, far) by rarer keys that sketches allow, and the links found within crowds.

    A linked pair has as many keys in common as the smaller of its sets' meet. Those of rarer keys are counted here. If one of them is
    a key with more than CROWD sets, both sets are in the same crowd (all that such keys connect), whose sets are compared by pairs
    of blocks of 4 * CROWD.
    """
    rows = _labelled(prefix, label)
    sizes = rows.groupBy("key").agg(F.count("*").alias("g"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("sid").alias("hub")).filter("lo <> hi").select("key", "g", "hub")
    open_ = kept(rows.join(sizes, "key"), "parity-open")
    bits = items.select("sid", "n", "bits")
    few = open_.filter(F.col("g") <= CROWD).select("key", "sid", "level", "n", "comp", "meet")
    x, y = few.alias("x"), few.alias("y")
    pairs = (
        x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.sid") < F.col("y.sid")))
        .filter((F.col("x.comp") != F.col("y.comp")) & _fits(F.col("x.n"), F.col("y.n"), num, den))
        .groupBy(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), F.col("x.level").alias("level"))
        .agg(F.count("*").alias("c"), F.min(F.least("x.meet", "y.meet")).alias("meet"))
        .filter("c >= meet")
        .select("a", "b")
        .distinct()
    )
    p, q = bits.select(F.col("sid").alias("a"), "n", F.col("bits").alias("p")), bits.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.col("bits").alias("q"))
    pairs = kept(pairs.join(p, "a").join(q, "b").select("a", "b", "n", "m", "p", "q").mapInArrow(_close(num, den), "a long, b long, far int"), "parity-close")
    many = open_.filter(F.col("g") > CROWD)
    if many.isEmpty():
        return pairs, None
    # every set of such a key with the key's hub
    crowd = components(many.select(F.col("sid").alias("a"), F.col("hub").alias("b"))).withColumnsRenamed({"id": "sid", "comp": "crowd"})
    member = kept(many.select("sid", "n", "comp").distinct().join(crowd, "sid"), "parity-crowd")
    parts = member.groupBy("crowd").agg(F.ceil(F.count("*") / (4 * CROWD)).cast("int").alias("parts"))
    dealt = member.join(parts, "crowd").withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("crowd", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "sid", "n", "comp")
    names = ["crowd", "i", "j", "sid", "n", "comp"]
    suspect = kept(dealt.join(bits.drop("n"), "sid").select(*names, "bits").groupBy("crowd", "i", "j").applyInPandas(_suspect(num, den), "crowd long, i int, j int, sid long, n int, comp long"), "parity-suspect")
    links = suspect.join(items.select("sid", "items", "bits"), "sid").select(*names, "items", "bits").groupBy("crowd", "i", "j").applyInPandas(_blocked(num, den), "a long, b long")
    return pairs, kept(links, "parity-crowd-links")


def _checked(pairs: DataFrame, items: DataFrame, num: int, den: int) -> DataFrame:
    """The linked ones of pairs (a, b). Sets that no pair names stay where they are; those of a meet those of b by one shuffle where the pairs are few enough to be broadcast."""
    x = items.select(F.col("sid").alias("a"), F.col("items").alias("p"))
    y = items.select(F.col("sid").alias("b"), F.col("items").alias("q")).join(_small(pairs.select("b")), "b", "left_semi")
    return x.join(_small(pairs.select("a", "b")), "a").join(y, "b").select("a", "b", "p", "q").mapInArrow(_verify(num, den), "a long, b long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """docs without all but one document of each component: the one of the smallest id (null ids last; of repeated rows, one).

    Documents without words are in no group and stay, whatever their ids. An id that several texts share goes only with those
    of its rows that are linked to a kept one. All columns of docs are kept, whatever their names.
    """
    key = quoted(id_col)
    odd = docs.select(key.alias("_id")).groupBy("_id").count().filter("_id is null or count > 1")
    if odd.isEmpty():
        found = near_classes(docs, id_col, text_col, size, percent)
        gone = unused(docs, "_gone")
        lost = found.filter("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias(gone))
        return docs.join(_small(lost), key == F.col(gone), "left_anti")
    # Ids do not tell rows apart: rows are numbered in a written table, so that a lost task cannot number them anew.
    rows, _ = table(docs.select(whole(docs).alias("_all")).withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    found = near_classes(rows.select("_row", F.col(f"_all.`{text_col}`").alias("_text")), "_row", "_text", size, percent).filter("n_shingles > 0")
    ids = rows.select("_row", F.col(f"_all.`{id_col}`").alias("_id"))
    placed = found.select(F.col("doc_id").alias("_row"), "component_id").join(ids, "_row")
    first = placed.groupBy("component_id").agg(F.min_by("_row", F.struct(F.col("_id").isNull(), "_id", "_row")).alias("_first"))
    lost = placed.join(first, "component_id").filter("_row <> _first").select("_row")
    return rows.join(_small(lost), "_row", "left_anti").select("_all.*")
