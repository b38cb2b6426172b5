"""Toxicity by compression distance.

Two zstandard dictionaries: one of ordinary text, one of toxic text. Both begin with what zstandard's trainer picks
from windows of ordinary documents, so that common prose costs the same with either. The toxic one goes on with an extract of toxic
windows, the other with as much of the ordinary windows that are hardest for the common part. A text, A-Z lower-cased and reduced to its
words, is cut into windows of a few words, and every window is compressed with both: a window that the toxic dictionary makes shorter by
more speaks for toxicity. A logistic curve over a document's largest gains, fitted on the sample and then shifted so that the wanted
threshold separates best, turns gains into a score.

Most of a toxic document is ordinary, so its windows are not taken as they come. The sample is dealt into halves. Of each half the
toxic windows that the ordinary dictionary compresses worst make a dictionary; those windows of the other half that it shortens far more
often than ordinary windows train the next one, and so on a few times. The trained dictionaries are then cut into pieces, and lengths alone decide
which stay: pieces that, put behind the common part, shorten toxic windows of the other half many times as often as ordinary ones, down to
the few short ones that together shorten most such windows. Documents that no piece shortens yet give one more round. The curve is
fitted on gains that each half has by the other's pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.columns import quoted, unused, whole
from tessera.llm.quality import held_out, labelled
from tessera.llm.text import ALNUM, LOWER, Block, blocks
from tessera.plans.session import release, ship

#: Words of a window that is scored, and of one that the extract is trained on.
WINDOW, TRAINED = 14, 8
#: Bytes of the common part and of a trained toxic dictionary, before it is cut; of a piece, and of what is left of it.
BASE, EXTRA, PIECE, SHORT = 48 << 10, 8 << 10, 20, 10
#: Labelled documents that dictionaries and threshold are fitted on at most.
SAMPLE = 6_000
TOP = 6
#: Turns of training each round, and rounds; the second is for documents that the first has no piece for.
TURNS, ROUNDS = 4, 2
#: Bytes by which a window gets shorter that counts; how many times as often toxic ones must; windows drawn, of each kind, to try a piece on.
GAIN, TIMES, DRAWN = 3, 10, 1_500


def plain(block: Block, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block's words, lower-cased and single-spaced; begin and end of each window of size words with the spaces around it; each text's first window (one more)."""
    begin, end, _, first = block.words(ALNUM)
    length = end - begin
    at = np.cumsum(length + 1) - length  # a space before each word
    data = np.full(int(length.sum() + len(length)) + 1, 32, dtype=np.uint8)
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    data[np.repeat(at, length) + inner] = LOWER[block.data[np.repeat(begin, length) + inner]]
    count = (np.diff(first) + size - 1) // size
    index = np.concatenate([[0], np.cumsum(count)])
    head = (np.arange(index[-1]) - np.repeat(index[:-1], count)) * size + np.repeat(first[:-1], count)
    last = np.minimum(head + size, np.repeat(first[1:], count)) - 1
    return data, at[head] - 1, at[last] + length[last] + 1, index


class Lengths:
    """Compressed length of each of many windows with one dictionary."""

    def __init__(self, content: bytes):
        how = zstd.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=16, search_log=4, min_match=5, target_length=8, strategy=zstd.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        self.c = zstd.ZstdCompressor(dict_data=d, compression_params=how)

    def __call__(self, raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        out: list[int] = []
        for i in range(0, len(begin), 1 << 16):
            places = np.column_stack([begin[i : i + (1 << 16)], (end - begin)[i : i + (1 << 16)]]).astype(np.uint64).tobytes()
            out += [len(x) for x in self.c.multi_compress_to_buffer(zstd.BufferWithSegments(raw, places))]
        return np.array(out, dtype=np.int64)


class Model:
    """Two dictionaries and the curve; small enough to broadcast (some 130 kB)."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self.mean, self.scale, self.weight, self.shift = np.zeros(2 * TOP + 1), np.ones(2 * TOP + 1), np.zeros(2 * TOP + 2), 0.0

    def gains(self, column: pa.Array) -> np.ndarray:
        """(texts, 2 * TOP + 1): the largest gains, how many windows gain at least 2, 3, ..., and the number of windows."""
        a, b = Lengths(self.ordinary), Lengths(self.toxic)
        rows = []
        for block in blocks(column):
            data, begin, end, index = plain(block)
            raw = data.tobytes()
            gain = a(raw, begin, end) - b(raw, begin, end)
            owner = np.repeat(np.arange(block.n), np.diff(index))
            gain = gain[np.lexsort((-gain, owner))]
            out = np.zeros((block.n, 2 * TOP + 1))
            for k in range(TOP):
                has = np.diff(index) > k
                out[has, k] = np.clip(gain[index[:-1][has] + k], 0, 12)
                out[:, TOP + k] = np.log1p(np.bincount(owner[gain >= k + 2], minlength=block.n))
            out[:, -1] = np.log1p(np.diff(index))
            rows.append(out)
        return np.concatenate(rows) if rows else np.zeros((0, 2 * TOP + 1))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weight[:-1] + self.weight[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) + self.shift, -35, 35)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, threshold: float) -> None:
        """Logistic regression by Newton's method, then the shift that puts the best cut at the threshold."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
            h = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w))
            step = np.linalg.solve(h, z.T @ (p - y) + 0.1 * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weight = w
        s = np.sort(np.unique(self.raw(x)))
        order = np.argsort(-self.raw(x), kind="stable")
        hit, r = np.cumsum(y[order]), self.raw(x)[order]
        f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
        ends = np.append(r[1:] != r[:-1], True)
        best = int(np.argmax(np.where(ends, f1, -1)))
        below = s[s < r[best]]
        cut = (r[best] + (below[-1] if len(below) else r[best] - 1)) / 2
        self.shift = np.log(threshold / (1 - threshold)) - cut


def windows(texts: pa.Array, size: int) -> tuple[list[bytes], np.ndarray]:
    """The windows of all texts, and the text of each."""
    out: list[bytes] = []
    owner = [np.zeros(0, dtype=np.int64)]
    for b in blocks(texts):
        data, begin, end, index = plain(b, size)
        raw = data.tobytes()
        out += [raw[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
        owner.append(np.repeat(np.arange(b.n) + b.first, np.diff(index)))
    return out, np.concatenate(owner)


def trained(samples: list[bytes], size: int, k: int = 24) -> bytes:
    """What zstandard's trainer makes of the samples; their own text where they are too few to train on."""
    if sum(map(len, samples)) > size:
        try:
            return zstd.train_dictionary(size, samples, k=k, d=8).as_bytes()
        except zstd.ZstdError:
            pass
    return b"".join(samples)[-size:]


def lengths(content: bytes, some: list[bytes]) -> np.ndarray:
    size = np.array([len(x) for x in some], dtype=np.int64)
    end = np.cumsum(size)
    return Lengths(content)(b"".join(some), end - size, end) if some else np.zeros(0, dtype=np.int64)


class Side:
    """Windows of one class: their text, their document's half, and their lengths with the common part."""

    def __init__(self, texts: pa.Array, base: bytes):
        self.text, self.owner = windows(texts, TRAINED)
        self.half = self.owner % 2
        self.size = lengths(base, self.text)
        self.cost = self.size / np.maximum([len(x) for x in self.text], 1)

    def pick(self, at: np.ndarray) -> list[bytes]:
        return [self.text[i] for i in at]

    def hardest(self, half: int, live: np.ndarray) -> np.ndarray:
        at = np.flatnonzero((self.half == half) & live)
        return at[np.argsort(-self.cost[at], kind="stable")]


class Extract:
    """Pieces of dictionaries trained on toxic windows, by half; no words are looked at, only compressed lengths."""

    def __init__(self, toxic: pa.Array, ordinary: pa.Array, base: bytes):
        self.base, self.draw = base, np.random.default_rng(1)
        self.bad, self.good = Side(toxic, base), Side(ordinary, base)
        self.pieces: tuple[list[bytes], list[bytes]] = ([], [])
        self.seen: set[bytes] = set()
        self.hard: list[bytes] = []
        documents = int(self.bad.owner.max(initial=-1)) + 1
        live = np.ones(len(self.bad.text), dtype=bool)
        for _ in range(ROUNDS):
            if not live.any() or not self.good.text:
                break
            self.round(live)
            found = np.zeros(documents, dtype=bool)
            for h in (0, 1):
                at = np.flatnonzero(self.bad.half != h)
                found[self.bad.owner[at[self.shortened(b"".join(self.pieces[h]), self.bad, at)]]] = True
            live = ~found[self.bad.owner]

    def shortened(self, extract: bytes, side: Side, at: np.ndarray) -> np.ndarray:
        if not extract:
            return np.zeros(len(at), dtype=bool)
        return side.size[at] - lengths(self.base + extract, side.pick(at)) >= GAIN

    def gain(self, toxic: bytes, ordinary: bytes, some: list[bytes]) -> np.ndarray:
        n = min(len(toxic), len(ordinary))
        return lengths(self.base + ordinary[-n:], some) - lengths(self.base + toxic[-n:], some)

    def round(self, live: np.ndarray) -> None:
        """Trains on the live toxic windows and adds to the pieces of both halves."""
        bad, good, every = self.bad, self.good, np.ones(len(self.good.text), dtype=bool)
        # twice as many ordinary windows as toxic ones to compare with
        control = [self.draw.permutation(np.flatnonzero(good.half == h))[: 2 * max(1000, int((live & (bad.half == h)).sum()))] for h in (0, 1)]
        chosen, hard = [bad.hardest(h, live) for h in (0, 1)], [good.hardest(h, every) for h in (0, 1)]
        first = 8 * EXTRA
        toxic = [b"".join(bad.pick(chosen[h][: first // 8]))[:first] for h in (0, 1)]
        ordinary = [b"".join(good.pick(hard[h][: first // 8]))[:first] for h in (0, 1)]
        for _ in range(TURNS):
            gains, usual = np.full(len(bad.text), -99), np.full(len(good.text), -99)
            for h in (0, 1):
                at = np.flatnonzero((bad.half != h) & live)
                gains[at] = self.gain(toxic[h], ordinary[h], bad.pick(at))
                usual[control[1 - h]] = self.gain(toxic[h], ordinary[h], good.pick(control[1 - h]))
            # the least gain that toxic windows have three times as often as ordinary ones
            steps = np.arange(1, 16)
            often = np.array([(gains >= g).sum() for g in steps]) / max(int(live.sum()), 1)
            rest = np.array([(usual >= g).sum() for g in steps]) / max(sum(map(len, control)), 1)
            enough = np.flatnonzero((often >= 3 * (rest + 2e-5)) & (often * live.sum() >= 30))
            least = steps[enough[0]] if len(enough) else steps[np.argmax(often / (rest + 1e-3))]
            chosen = [np.flatnonzero((bad.half == h) & (gains >= least)) for h in (0, 1)]
            hard = [control[h][np.argsort(-usual[control[h]], kind="stable")][: max(300, len(chosen[h]))] for h in (0, 1)]
            toxic = [trained(bad.pick(chosen[h]), EXTRA) for h in (0, 1)]
            ordinary = [trained(good.pick(hard[h]), EXTRA) for h in (0, 1)]
        self.hard = [x for h in (0, 1) for x in good.pick(hard[h])]
        for h in (0, 1):
            self.sift(h, toxic[h], bad.pick(self.draw.permutation(chosen[1 - h])[:DRAWN]), good.pick(hard[1 - h][:DRAWN]) + good.pick(self.draw.permutation(np.flatnonzero(good.half != h))[:DRAWN]))

    def tried(self, pieces: list[bytes], some: list[bytes]) -> np.ndarray:
        """(pieces, windows): which windows each piece alone shortens."""
        before = lengths(self.base, some)
        return np.array([before - lengths(self.base + p, some) >= GAIN for p in pieces], dtype=bool).reshape(len(pieces), len(some))

    def sift(self, h: int, dictionary: bytes, toxic: list[bytes], ordinary: list[bytes]) -> None:
        """Adds the pieces of a half's dictionary that the other half's windows bear out."""
        pieces = [p for p in dict.fromkeys(dictionary[i : i + PIECE] for i in range(0, max(1, len(dictionary) - PIECE + 1), PIECE // 2)) if p not in self.seen]
        if not pieces or not toxic or not ordinary:
            return
        hits = self.tried(pieces, toxic).sum(1)
        pieces, hits = [p for p, n in zip(pieces, hits, strict=True) if n >= 3], hits[hits >= 3]
        rate = hits / len(toxic) / ((self.tried(pieces, ordinary).sum(1) + 0.5) / len(ordinary))
        pieces = [p for p, r in zip(pieces, rate, strict=True) if r >= TIMES]
        self.seen |= set(pieces)
        short = list(dict.fromkeys(p[i : i + SHORT] for p in pieces for i in range(0, len(p) - SHORT + 1, 2)))
        for p in self.cover(short, b"".join(self.pieces[h] + pieces), h):
            if p not in self.pieces[h]:
                self.pieces[h].append(p)

    def cover(self, pieces: list[bytes], whole: bytes, h: int | None) -> list[bytes]:
        """Few of the pieces that together shorten most toxic windows (of the half other than h, if given).

        They are tried on the windows that the whole extract shortens: the ordinary ones among these are the hardest to tell.
        """
        sides = []
        for side in (self.bad, self.good):
            at = np.flatnonzero(side.half != h) if h is not None else np.arange(len(side.text))
            met = at[self.shortened(whole, side, at)]
            drawn = side.pick(self.draw.permutation(met)[:DRAWN])
            sides.append((drawn, max(1, len(met)) / max(1, len(drawn)) / max(1, len(at))))
        (toxic, a), (ordinary, b) = sides
        if not toxic or not pieces:
            return []
        hit, miss = self.tried(pieces, toxic), self.tried(pieces, ordinary).sum(1)
        fine = np.flatnonzero((hit.sum(1) * a >= 2 * TIMES * (miss + 0.5) * b) & (hit.sum(1) >= 2)).tolist()
        covered, out = np.zeros(len(toxic), dtype=bool), []
        while fine:
            best = max(fine, key=lambda k: (int((hit[k] & ~covered).sum()) - 2 * int(miss[k]), -k))
            if (hit[best] & ~covered).sum() < max(2, 0.002 * len(toxic)):
                break
            fine.remove(best)
            covered |= hit[best]
            out.append(pieces[best])
        return out


def fit(texts: pa.Array, labels: np.ndarray, threshold: float) -> Model:
    """A model of the sample; without any toxic document no window gains."""
    bad, good = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    base = trained(windows(texts.take(pa.array(good)), WINDOW)[0], BASE, 200) or b" "
    e = Extract(texts.take(pa.array(bad)), texts.take(pa.array(good)), base)

    def model(pieces: list[bytes]) -> Model:
        # of a sample too small to bear any piece out, the hardest windows
        tail = b"".join(pieces) or b"".join(e.bad.pick(np.argsort(-e.bad.cost, kind="stable")[:100]))[:EXTRA] or b" "
        filler = trained(e.hard or e.good.text, max(len(tail), 400))
        return Model(base + (filler * (len(tail) // max(len(filler), 1) + 1))[: len(tail)], base + tail)

    both = list(dict.fromkeys(e.pieces[0] + e.pieces[1]))
    out = model(e.cover(both, b"".join(both), None) or both)
    gains = np.zeros((len(texts), 2 * TOP + 1))
    turn = np.zeros(len(texts), dtype=np.int64)
    turn[bad], turn[good] = np.arange(len(bad)) % 2, np.arange(len(good)) % 2
    for h in (0, 1):
        at = np.flatnonzero(turn != h)
        gains[at] = (model(e.pieces[h]) if e.pieces[h] else out).gains(texts.take(pa.array(at)))
    out.calibrate(gains, labels.astype(float), threshold)
    return out


def _fit(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got).sort_by("rank")
            m = fit(t.column("text").combine_chunks(), t.column("y").to_numpy(), threshold)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (m.ordinary, m.toxic, np.concatenate([m.mean, m.scale, m.weight, [m.shift]]).tobytes())], names=["ordinary", "toxic", "curve"])
            del got, t, m
        release()

    return run


def train(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fold: int | None = 3, kept_out: int | None = 1, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model fitted in one task on a sample bounded by most rows; None where there are no labelled documents."""
    spark = docs.sparkSession
    ship(spark)
    got = labelled(docs, labels, "toxic", fold, kept_out, most, id_col, text_col).repartition(1).mapInArrow(_fit(threshold), "ordinary binary, toxic binary, curve binary").collect()
    if not got:
        return None
    m = Model(bytes(got[0].ordinary), bytes(got[0].toxic))
    c, n = np.frombuffer(got[0].curve), 2 * TOP + 1
    m.mean, m.scale, m.weight, m.shift = c[:n], c[n : 2 * n], c[2 * n : 3 * n + 1], float(c[-1])
    return m


def with_score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with one more column, the last: a score from 0 to 1. It is called _toxic, with underscores behind it where docs has such a column.

    Null texts count as empty; without a model all scores are 0.
    """
    name = unused(docs, "_toxic")
    if model is None:
        return docs.select("*", F.lit(0.0).alias(name))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, at = docs.select(whole(docs).alias("_all")), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            s = m.score(m.gains(batch.column(0).field(at)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["_all", "_score"])
        release()

    kinds = T.StructType([rows.schema["_all"], T.StructField("_score", T.DoubleType())])
    return rows.mapInArrow(run, kinds).select("_all.*", F.col("_score").alias(name))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fold: int = 3, kept_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold). One row for each row of docs."""
    model = train(docs, labels, threshold, fold, kept_out)
    out = with_score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model).withColumnRenamed("_toxic", "score")
    return out.select("doc_id", held_out("doc_id", fold, kept_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without those scored at or over the threshold; the model may learn from all labels."""
    model = train(docs, labels, threshold, None, None)
    scored = with_score(docs, model)
    return scored.filter(F.col(scored.columns[-1]) < threshold).select(*(quoted(c) for c in docs.columns))
