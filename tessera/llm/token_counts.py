"""Token totals by source, language and tokenizer version, kept by signed deltas.

A batch is a set of signed per-document counts: +1 for a document that comes, -1 for one that goes, both for one whose
count is revised. Each batch is written to a folder of its own: the signed rows (ledger) and their sums (delta), which are
combined before the shuffle. It counts once the folder has its final name, which one rename gives it; a batch that is
there already is not written again, so a repeated or retried commit changes nothing. Totals are the sums of all deltas.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.session import ship

#: How text is split before merges: the pattern published with the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
GROUP = ["source", "lang", "version"]
_LEDGER = "doc_id long, source string, lang string, version string, n_tokens long, text_key string, sign int"


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_encoders: dict[int, object] = {}


def encoder(raw: bytes):
    key = hash(raw)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        _encoders[key] = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def counted(docs: DataFrame, version: str, path: str = VOCABULARY, sign: int = 1, text_col: str = "text") -> DataFrame:
    """Signed ledger rows of documents. Null texts count as empty (0 tokens); null sources and languages are groups of their own.

    path: a vocabulary file of base64 tokens and ranks, read on the driver (under 1 MB) and sent to the tasks. Strings of
    special tokens are ordinary text.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "text_key", "n_tokens"])

    text = F.col(text_col).cast("string")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text_key(text).alias("text_key"), text.alias("text"))
    out = src.mapInArrow(run, "doc_id long, source string, lang string, text_key string, n_tokens long")
    return out.select("doc_id", "source", "lang", F.lit(version).alias("version"), "n_tokens", "text_key", F.lit(sign).alias("sign"))


def text_key(text: Column) -> Column:
    """What tells texts apart; null counts as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


class Rollup:
    """The batches under one folder, which driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/batches"))

    def committed(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/batches")))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of ledger rows; False if it was there already (then changes is not even read)."""
        final = f"{self.root}/batches/{batch}"
        if self._fs.exists(self._path(final)):
            return False
        work = f"{self.root}/work/{uuid.uuid4().hex}"
        changes.write.parquet(f"{work}/ledger")
        rows = self.spark.read.schema(_LEDGER).parquet(f"{work}/ledger")
        delta = rows.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"))
        delta.filter("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{work}/delta")
        if not self._fs.rename(self._path(work), self._path(final)) or self._fs.exists(self._path(f"{final}/{work.rsplit('/', 1)[1]}")):
            self._fs.delete(self._path(work), True)
            self._fs.delete(self._path(f"{final}/{work.rsplit('/', 1)[1]}"), True)
            return False
        return True

    def _read(self, part: str, schema: str) -> DataFrame:
        found = [f"{self.root}/batches/{b}/{part}" for b in self.committed()]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def live(self) -> DataFrame:
        """Documents that are counted now: ledger rows whose signs do not cancel, with how many times."""
        rows = self._read("ledger", _LEDGER)
        return rows.groupBy("doc_id", *GROUP, "n_tokens", "text_key").agg(F.sum("sign").cast("int").alias("times")).filter("times <> 0")

    def deletion(self, which: DataFrame) -> DataFrame:
        """Ledger rows that take away every live count that agrees with a row of which in the columns it has.

        which has doc_id and, where only some of an id's texts are meant, text_key or others of the ledger. Nulls agree with nulls.
        """
        on = [c for c in ("doc_id", *GROUP, "text_key") if c in which.columns]
        live, w = self.live().alias("live"), which.select(*(F.col(c).alias(f"w_{c}") for c in on))
        w = w.withColumn("w_doc_id", F.col("w_doc_id").cast("long")).distinct()
        same = [F.col(f"live.{c}").eqNullSafe(F.col(f"w_{c}")) for c in on]
        return self.taken(live.join(w, same, "left_semi"))

    @staticmethod
    def taken(rows: DataFrame) -> DataFrame:
        """Ledger rows that take away live rows, as often as times says."""
        return rows.select("doc_id", *GROUP, "n_tokens", "text_key", (-F.col("times")).cast("int").alias("sign"))

    def copies(self) -> DataFrame:
        """Ledger rows that leave one count of every text: that of the smallest id (null ids last), then source, language and version.

        A text that very many documents share is dealt over salts.
        """
        salts = 16
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *GROUP)
        live = self.live().withColumn("at", order)
        first = live.groupBy("text_key").agg(F.min("at").alias("first"), F.sum("times").alias("all")).filter(F.col("all") > 1)
        first = first.select(F.col("text_key").alias("k"), "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        met = live.withColumn("salted", F.pmod(F.xxhash64("doc_id", *GROUP), F.lit(salts)).cast("int")).join(first, (F.col("text_key") == F.col("k")) & (F.col("salted") == F.col("salt")))
        return self.taken(met.withColumn("times", F.col("times") - F.col("at").eqNullSafe(F.col("first")).cast("int")).filter("times > 0"))

    def revision(self, docs: DataFrame, version: str, path: str = VOCABULARY, old: str | None = None) -> DataFrame:
        """Ledger rows that put the counts of docs in place of what their ids have now; with old, a column of docs that holds the text
        as it was counted, only in place of that text's counts. Rows whose old text is not counted add nothing then."""
        if old is None:
            return self.deletion(docs.select("doc_id")).unionByName(counted(docs, version, path))
        keyed = docs.withColumn("text_key", text_key(F.col(old)))
        there = self.live().select(*(F.col(c).alias(f"l_{c}") for c in ("doc_id", "text_key"))).distinct()
        now = keyed.join(there, [F.col("doc_id").eqNullSafe(F.col("l_doc_id")), F.col("text_key") == F.col("l_text_key")], "left_semi").dropDuplicates(["doc_id", "source", "lang", "text_key"])
        return self.deletion(now.select("doc_id", "text_key")).unionByName(counted(now, version, path))

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens of all committed batches; groups that have come to nothing are left out."""
        rows = self._read("delta", "source string, lang string, version string, n_docs long, n_tokens long")
        return rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")


def tidy(text: Column) -> Column:
    """Text as a revision would store it: single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t]{2,}", " "))
