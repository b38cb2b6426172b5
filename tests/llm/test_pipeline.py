"""The pipeline's stages against brute force, on a whole small table and on rows with nulls, repeats and extra columns."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def kept_of_near(rows):
    """Smallest id of each class of linked texts; every pair is compared."""
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                top[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return sorted(min(g) for g in groups.values())


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def clean_of_leaks(rows, items):
    windows = {}
    for w in map(words, items):
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows.setdefault(n, set()).add(tuple(w[j : j + n]))
    out = []
    for i, t in rows:
        w, hit, whole = words(t), set(), False
        for n, s in windows.items():
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in s:
                    hit.update(range(j, j + n))
                    whole |= n == 13
        if not whole and (not hit or 20 * len(hit) < len(w)):
            out.append(i)
    return sorted(out)


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "mixing", "sharding"]
    pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    near = stages["near duplicates"](spark, docs, SF)
    assert near.columns == names and ids(near) == kept_of_near(pairs)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = stages["decontamination"](spark, docs, SF)
    assert leaks.columns == names and ids(leaks) == clean_of_leaks(pairs, items) and leaks.count() < docs.count()
    toxic = stages["toxicity"](spark, docs, SF)
    kept = set(ids(toxic))
    labels = [(r.toxic, r.doc_id in kept) for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic is not null").collect()]
    share = {y: sum(k for x, k in labels if x == y) / sum(x == y for x, _ in labels) for y in (0, 1)}
    assert toxic.columns == names and share[0] >= 0.9 and share[1] <= 0.5
    mixed = stages["mixing"](spark, docs, SF)
    assert mixed.columns == names and set(ids(mixed)) == set(ids(docs))
    cut = stages["sharding"](spark, docs, SF)
    size = {r.shard: r.b for r in cut.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    most = cut.agg(F.max("size")).first()[0]
    assert ids(cut) == ids(docs) and set(size) == set(range(8)) and max(size.values()) - min(size.values()) <= 2 * most


def test_no_benchmark_passage_stays_in_a_larger_table(spark):
    """sf0.1 holds long documents of which a passage is far less than a twentieth."""
    docs, items = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    windows = {tuple(w[j : j + 13]) for w in (words(r.text) for r in items.collect()) for j in range(len(w) - 12)}
    held = set()
    for r in docs.select("doc_id", "text").collect():
        w = words(r.text)
        if any(tuple(w[j : j + 13]) in windows for j in range(len(w) - 12)):
            held.add(r.doc_id)
    kept = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, "/root/testdata/sf0.1")
    assert len(held) > 200 and set(ids(docs)) - set(ids(kept)) == held


def test_run_chains_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got, all_ = set(ids(out)), set(ids(docs))
    assert got < all_ and {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"} <= set(out.columns)
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = sorted((i, text[i]) for i in got)
    assert kept_of_near(left) == [i for i, _ in left] and clean_of_leaks(left, items) == [i for i, _ in left]


def test_stages_bear_nulls_repeats_and_extra_columns(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    some = base.filter("doc_id < 20")
    odd = spark.createDataFrame([(None, None, None, None, None), (900_001, None, "en", "s", 0), (900_002, "", "en", None, 0), (900_003, "same words here", None, "s", 15), (900_003, "same words here", "en", "s", 15), (None, "same words here", "xx", "s", 15)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = some.unionByName(odd.select(*(F.col(c).cast(base.schema[c].dataType) for c in base.columns)))
    for c in ("score", "shard", "domain", "predicted", "rate"):
        docs = docs.withColumn(c, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).collect()
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0 and (name == "sharding" or empty.columns == docs.columns)
        if name == "near duplicates":
            assert sum(r.text == "same words here" for r in out) == 1 and sum(r.text in (None, "") for r in out) == 3
        elif name != "toxicity":
            assert len(out) >= docs.count() - (name == "decontamination") * 20


def full_collections(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_every_stage_begins_with_the_heap_given_back(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES[2:]:
        before = full_collections(spark)
        stage(spark, docs, SF)
        assert full_collections(spark) > before
    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)


def test_a_worker_gives_back_what_it_has_freed():
    from tessera.plans.session import release

    resident = lambda: int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) // 1024  # noqa: E731, SIM115
    held = [bytes(2000) for _ in range(100_000)]
    top, held = held[-1], None  # the last one keeps the heap from shrinking by itself
    before = resident()
    release()
    assert len(top) == 2000 and resident() < before - 100
