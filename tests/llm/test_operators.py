"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import imatch, mixing, parity_join, pii, quality, queries, shards, suffix_match, token_counts, toxicity, urls
from tessera.llm.text import ALNUM, SOLID, blocks

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    out = []
    base = [prose(r, n) for n in (3, 4, 5, 9, 16, 40, 120, 300, 700)]
    for i, t in enumerate(base * 4):
        w = t.split()
        for _ in range(i % 4 * max(1, len(w) // 60)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append((1000 - i, " ".join(w)))
    out += [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "WORD"), (5, "word"), (5, "word"), (None, base[5]), (None, "lonely text here")]
    out += [(2000 + i, prose(r, 30) + " " + base[6]) for i in range(5)]
    out.append((3000, "long " + prose(r, 30_000, 10**6)))
    return [(i, t, "en", "src0", len(t or "")) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


OWN = ("sid", "n", "key", "_part", "shard", "_p", "_n", "_copy", "_match", "_MATCH_", "_words", "_hit", "_toxic", "_at", "_l", "_gone", "_all", "_id", "_row", "_text", "score", "a", "b", "a.b")


def extra(df):
    """Columns that operators use themselves, each with a value of its own."""
    return df.select("*", *(F.lit(f"{c}!").alias(c) for c in OWN))


def unharmed(out, df):
    """out has df's columns, and the added ones still hold what they did."""
    assert out.columns == df.columns
    assert all(r[df.columns.index(c)] == f"{c}!" for r in out.collect() for c in OWN)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_brute(rows):
    s = [shingles(r[1]) for r in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(s[i] & s[j])
            if k and 100 * k >= 75 * (len(s[i]) + len(s[j]) - k):
                top[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), 10**9), r[0])
    return sorted((r[0] or -1, len(s[i]), (least.get(find(i), -1) if s[i] else r[0]) or -1) for i, r in enumerate(rows))


def test_words_match_the_regular_expressions():
    import pyarrow as pa

    texts = ["Añb-c 12!d", "", None, "É\x0bÜ\x00x", "日本 語", "a" * 70]
    for kind, rx in ((ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (SOLID, r"[^\x20\x09-\x0D]+")):
        for b in blocks(pa.array(texts)):
            begin, end, h, first = b.words(kind)
            got = [[bytes(b.data[x:y]).decode() for x, y in zip(begin[first[i] : first[i + 1]], end[first[i] : first[i + 1]])] for i in range(b.n)]
            want = [re.findall(rx, (t or "").translate(LOW)) for t in texts]
            assert [[w.translate(LOW) for w in g] for g in got] == want
            assert len(set(h.tolist())) == len({w for g in want for w in g})


def test_parity_join_equals_brute_force(spark, docs, rows):
    got = sorted((r[0] or -1, r[1], r[2] or -1) for r in parity_join.near_classes(extra(docs)).collect())
    assert got == near_brute(rows)


def test_parity_join_random_similarities(spark):
    r = random.Random(3)
    rows = []
    for g in range(60):
        w = prose(r, r.choice([6, 12, 15, 17, 30, 60, 130, 260, 500]), 10**6).split()
        for _ in range(4):
            v = list(w)
            for _ in range(max(1, int(len(v) * r.choice([0.005, 0.02, 0.03, 0.05])))):
                v[r.randrange(len(v))] = f"z{r.randrange(10**6)}"
            cut = r.choice([0, 0, len(v) // 6])
            rows.append((len(rows), " ".join(v[cut:]), "en", "s", 0))
    got = sorted((x[0] or -1, x[1], x[2] or -1) for x in parity_join.near_classes(spark.createDataFrame(rows, DOCS)).collect())
    assert got == near_brute(rows)


def test_parity_join_frequent_keys_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "CROWD", 2)
    r = random.Random(5)
    base = prose(r, 60, 10**6).split()
    rows = []
    for i in range(40):
        v = list(base)
        for _ in range(i % 6):
            v[r.randrange(60)] = f"q{r.randrange(10**6)}"
        rows.append((i, " ".join(v), "en", "s", 0))
    got = sorted((x[0] or -1, x[1], x[2] or -1) for x in parity_join.near_classes(spark.createDataFrame(rows, DOCS)).collect())
    assert got == near_brute(rows)


def test_keep_one(spark, docs, rows):
    kept = parity_join.keep_one(extra(docs))
    unharmed(kept, extra(docs))
    once = extra(docs).filter("doc_id > 5")  # ids tell these apart
    unharmed(parity_join.keep_one(once), once)
    ids = [r.doc_id for r in kept.collect()]
    comp = near_brute(rows)
    want = {c for _, n, c in comp if n and c != -1} | {1, 2, 3}
    assert {i for i in ids if i is not None} == want and ids.count(5) <= 1 and ids.count(1) == 1


def test_keep_one_where_ids_are_null_or_shared(spark):
    same, other = "the same seven words stand here twice", "something else of six words altogether"
    rows = [(1, same), (2, same), (2, other), (2, ""), (None, same), (None, "a lone text"), (None, None), (None, ""), (3, None), (3, None), (4, other + " x")]
    kept = parity_join.keep_one(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)).collect()
    got = sorted(((r.doc_id, r.text) for r in kept), key=repr)
    assert got == sorted([(1, same), (2, other), (2, ""), (None, "a lone text"), (None, None), (None, ""), (3, None), (3, None), (4, other + " x")], key=repr)


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert parity_join.near_classes(none).count() == 0
    assert shards.assign(none).count() == 0
    assert suffix_match.report(none, bench).count() == 0
    assert imatch.edits(none).count() == 0 and imatch.fingerprints(none).count() == 0
    assert quality.classify(none, labels).count() == 0 and toxicity.classify(none, labels).count() == 0
    assert pii.extract(none).count() == 0
    assert mixing.rates(none, none.select("doc_id", F.col("lang").alias("domain")), {"en": 1.0, "de": 1.0}).count() == 0
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), urls.rule_table(spark)).count() == 0


def window_brute(text, items, size=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    d, hit, names = words(text), set(), set()
    for name, t in items:
        w = words(t)
        n = min(size, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(d) - n + 1) if n else ():
            if tuple(d[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                names.add(str(name))
    return len(d), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(d)


@pytest.mark.parametrize("limit", [suffix_match.ITEMS, 600])
def test_suffix_match(spark, rows, docs, limit):
    r = random.Random(2)
    texts = [t for _, t, *_ in rows if t]
    items = [(i, " ".join(r.choice(texts).split()[a : a + n])) for i, (a, n) in enumerate([(0, 20), (3, 13), (1, 40), (0, 4), (0, 1), (10, 90), (2, 12)])]
    items += [(100, ""), (101, None), (102, "nothing of the kind is in there at all you see my dear friend of old"), (7, items[0][1]), (103, texts[-1][:3000])]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((x.doc_id or -1), x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in suffix_match.report(docs, b, limit=limit).collect())
    assert got == sorted((i or -1, *window_brute(t, items)) for i, t, *_ in rows)
    kept = suffix_match.remove_contaminated(extra(docs), b, limit=limit)
    unharmed(kept, extra(docs))
    full = [(n, t) for n, t in items if len(re.findall(r"\w+", t or "")) >= 13]
    assert sorted(x.doc_id or -1 for x in kept.collect()) == sorted(i or -1 for i, t, *_ in rows if not window_brute(t, items)[4] and not window_brute(t, full)[1])


def test_suffix_match_longest(spark):
    words = [f"t{i}" for i in range(60)]
    d = spark.createDataFrame([(1, "a b c " + " ".join(words[10:50]) + " d", "", "", 0)], DOCS)
    b = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    m = suffix_match.report(d, b).first().matches
    assert [tuple(x) for x in m] == [("9", 10, 3, 40)]


def test_shards(spark, docs, rows):
    got = shards.assign(extra(docs)).collect()
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert sorted((r["size"], r.text_crc32) for r in got) == want
    total = sum(s for s, _ in want)
    for k in range(8):
        part = [r for r in got if r.shard == k]
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 8) <= max(s for s, _ in want)
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids) and {r.law for r in got} == {"bytes"}
    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted(map(repr, db.execute(f"select {', '.join(names)} from ({queries.ORACLES['op9_shards']})").fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in got)


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(v):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(v))) % 10 == 0


def pii_brute(text):
    out = []
    for kind, p in PATTERNS:
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base(spark):
    r = random.Random(11)
    alphabet = ["a", "B", "é", "😀", "1", "23", "4111111111111111", "4111 1111-1111 1111", "5500-0000-0000-0004", ".", "..", "@", "@x.org", "-", "+", "+1 (555) 010-9999", " ", "  ", "_", "%", "10.0.0.1", "300.1.2.3", "01.002.0003.4", "(", ")", "\n", "a@b.c", "0000000000000000"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 40))) for _ in range(1500)] + [None, "", "7" * 40_000, "1-" * 20_000, "a" * 40_000 + "@", "a.b@c" * 3000, "1." * 9000, "+1" + " " * 9000, "x@y.zz_q@r.ss", "1.2.3.4.5.6.7.8"]
    d = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS)
    got = {x.doc_id: x for x in pii.extract(extra(d)).collect()}
    for i, t in enumerate(texts):
        want = pii_brute(t)
        s = ",".join(f"{k}:{b}:{e}" for k, b, e in want)
        assert got[i].base_sha256 == hashlib.sha256(s.encode()).hexdigest(), (i, (t or "")[:200], got[i].spans[:300], s[:300])
        assert [got[i][f"n_{k}"] for k, _ in PATTERNS] == [sum(x[0] == k for x in want) for k, _ in PATTERNS]
        assert got[i].spans.startswith(s)


def test_pii_discovers_from_context(spark):
    rows = [(i, f"some words contact: user{i}@mail.example.com and more", "", "", 0) for i in range(30)]
    rows += [(100 + i, f"then contact: user#{i}!77 end", "", "", 0) for i in range(3)] + [(200 + i, f"version {i}.0 of things", "", "", 0) for i in range(30)] + [(None, None, "", "", 0)] * 2
    got = {x.doc_id: x for x in pii.extract(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == 64 and all(got[100 + i].n_other == 1 for i in range(3)) and all(got[200 + i].n_other == 0 for i in range(30))
    b, e = map(int, got[100].spans.split(":")[1:])
    assert rows[30][1][b:e] == "user#0!77"


def test_pii_of_very_many_numbers(spark):
    """2 MB of numbers, a tenth of them seeds: arrays must not be copied once for each match."""
    r = random.Random(6)
    text = " ".join(r.choice(["10.0.0.1", "4111111111111111", "+1 555 010 9999", *(str(r.randrange(10**6)) for _ in range(9))]) for _ in range(250_000))
    assert len(text) > 1_900_000
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.extract(spark.createDataFrame([(1, "warm 1 up")], "doc_id long, text string")).collect()
    began = time.time()
    got = pii.extract(d).first()
    assert time.time() - began < 60
    assert got.spans.startswith(",".join(f"{k}:{b}:{e}" for k, b, e in pii_brute(text)))


def test_pii_patterns_beside_marks_and_tokens(spark):
    rows = [(i, f"| a{i}@b.org | other" if i % 2 else f"x{i}@b.org follows here", "", "", 0) for i in range(80)] + [(500, "| user#7!77 | other", "", "", 0), (501, "user#8!88 follows here", "", "", 0)]
    got = {x.doc_id: x.n_other for x in pii.extract(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[500] == got[501] == 1 and sum(got.values()) == 2


def test_imatch(spark, docs, rows):
    got = imatch.edits(extra(docs)).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        if r.doc_id is not None and r.doc_id != 5:
            t = next(t for i, t, *_ in rows if i == r.doc_id) or ""
            assert r.n_chars == len(t)
            by_text.setdefault(t, set()).add(r.fingerprint)
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values())
    ids = sorted((i for i, *_ in rows if i is not None and i != 5), reverse=True)
    text = {i: t or "" for i, t, *_ in rows}
    done = {r.doc_id: r for r in got}
    for i, j in zip(ids, ids[1:]):
        if i > 5 and j > 5:
            n = len(text[i]) // 2
            assert done[i].edited_sha256 == hashlib.sha256((text[i][: len(text[i]) - n] + text[j][:n]).encode()).hexdigest()
    plain = {r.doc_id: r.fingerprint for r in imatch.fingerprints(docs).collect() if r.doc_id not in (None, 5)}
    assert all(plain[i] == done[i].fingerprint for i in plain)
    one = spark.createDataFrame([(1, "abcd", "", "", 4)], DOCS)
    assert imatch.edits(one).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def imatch_brute(rows, least, most):
    """Lexicon, sets of hashed terms and likenesses from plain counting, in the order of descending ids."""
    terms = lambda t: set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW)))
    df = {}
    for _, t in rows:
        for w in terms(t):
            df[w] = df.get(w, 0) + 1
    words = sorted(w for w, n in df.items() if least * len(rows) <= n <= most * len(rows))
    block = next(blocks(pa.array([" ".join(words)])))
    code = dict(zip(words, imatch.distinct(block)[1][np.argsort(np.argsort(block.words(ALNUM)[2]))].tolist(), strict=True))
    of = {w: [k for k in range(imatch.SUBSETS) if int(imatch.mix(np.array([c], np.uint64) ^ imatch.SALT[k])[0]) % imatch.ONE_IN == 0] for w, c in code.items()}

    def sets(t):
        mine = frozenset(terms(t) & code.keys())
        whole = mine if mine else ("bare", frozenset(terms(t)))
        return [whole if terms(t) else None, *(frozenset(w for w in mine if k in of[w]) or None for k in range(imatch.SUBSETS))]

    def likeness(a, b):
        pairs = [(x, y) for x, y in zip(sets(a), sets(b), strict=True) if x is not None or y is not None]
        return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0

    out = {}
    rows = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 2
        edited = t[: len(t) - n] + nxt[:n]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(t, edited), 9), round(likeness(t, nxt), 9), sets(t), sets(edited))
    return out


def test_imatch_against_brute_force(spark):
    r = random.Random(21)
    topics = [[f"t{k}x{i}" for i in range(12)] for k in range(6)]
    rows = [(i, " ".join(r.choice(topics[i % 6] + ["common", f"rare{i}"]) for _ in range(r.randrange(1, 25)))) for i in range(90)] + [(500, None), (501, ""), (502, "alone"), (503, "common")]
    want = imatch_brute(rows, 0.03, 0.3)
    got = {x.doc_id: x for x in imatch.edits(spark.createDataFrame(rows, "doc_id long, text string"), least=0.03, most=0.3).collect()}
    assert {i: (x.n_chars, x.edited_sha256, round(x.near_edited, 9), round(x.near_next, 9)) for i, x in got.items()} == {i: w[:4] for i, w in want.items()}
    prints = [(got[i].fingerprint, want[i][4]) for i in got] + [(got[i].edited_fingerprint, want[i][5]) for i in got]
    assert all((a == b) == (x == y) for a, x in prints for b, y in prints) and len({p for p, _ in prints}) > 60


def test_imatch_of_very_many_rows_alike(spark):
    rows = [(9, "nine a b c"), *[(7, "seven d e f g")] * 40, *[(None, "none h i")] * 30, (5, "five j"), (7, "seven other")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one, some = (sorted(map(tuple, imatch.edits(d, alike_rows=k).collect()), key=repr) for k in (1000, 10))
    assert one == some and len(one) == len(rows)


def test_imatch_split_of_a_hot_id(spark):
    rows = [(None if i % 2 else i, f"text number {i}", "", "", 0) for i in range(200)]
    got = imatch.edits(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 200
    texts = {hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest() for _, a, *_ in rows for _, b, *_ in rows}
    assert all(r.edited_sha256 in texts for r in got)


def test_quality_scores_are_sparse_dot_products(spark):
    """Scores under given weights against features that are counted one by one."""
    r = np.random.default_rng(3)
    weights = r.normal(size=(1 << quality.BITS) + 1)
    texts = ["One two, TWO three!", "", "same same same", "x" * 300, "tab\tand line", "é日本 words 12 (34)", "a b a b a b"]
    want = []
    for t in texts:
        block = next(blocks(pa.array([t])))
        begin, end, h, first = block.words(SOLID)
        shape = quality.shapes(block, begin, end, h, first)
        total = weights[-1]
        for view, sizes, g in ((0, (1, 2), h.tolist()), (1, (1, 2, 3), shape.tolist())):
            count = {}
            for n in sizes:
                for j in range(len(g) - n + 1):
                    v = sum(g[j + k] * int(quality.STEP[k]) for k in range(n)) % 2**64
                    place = int(quality.mix(np.array([v], np.uint64) ^ quality.STEP[2 * n + view])[0]) >> (64 - quality.BITS)
                    count[place] = count.get(place, 0) + 1
            norm = sum(np.log1p(c) ** 2 for c in count.values()) ** 0.5
            total += sum(np.log1p(c) / norm * weights[p] for p, c in count.items())
        want.append(1 / (1 + np.exp(-total)))
    got = {x.doc_id: x.score for x in quality.score(spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "doc_id long, text string"), weights).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], want) and abs(got[99] - got[1]) < 1e-12


def test_labelled_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(200)] + [(2, "two"), (3, None)], "doc_id long, body string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, quality int")
    got = quality.labelled(docs, labels, "quality", 5, None, 10, text_col="body").collect()
    assert sorted(x.text for x in got)[0] == "" and len(got) == 3
    assert quality.labelled(docs, labels, "quality", 5, None, 2, text_col="body").count() <= 2


def test_quality_learns_and_holds_out(spark):
    r = random.Random(1)
    rows = [(i, (prose(r, 60).upper().replace(" ", "!! ") if i % 3 == 0 else prose(r, 60)), "", "", 0) for i in range(400)] + [(1000, None, "", "", 0), (1001, "", "", "", 0), (None, "x", "", "", 0)]
    labels = [(i, int(i % 3 != 0), 0) for i in range(400)] + [(None, 1, 1), (3, 0, None), (5000, 1, 0), (7, None, 0)]
    got = quality.classify(extra(spark.createDataFrame(rows, DOCS)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    test = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 400]
    assert test and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)
    assert sum(x.predicted == int(x.doc_id % 3 != 0) for x in test) >= 0.95 * len(test)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)


def test_toxicity_gains_are_differences_of_window_lengths(spark):
    """Scores under given dictionaries and curve against windows that are cut and compressed one by one."""
    m = toxicity.Model(b" the usual words of any text " * 5, b" the usual words of any text " * 4 + b" vile rotten beast ")
    m.weight[:] = np.linspace(0.5, -0.5, len(m.weight))
    texts = [" ".join(["some", "usual", "words"] * 12 + ["Vile!", "rotten-beast"]), "vile", "", "the usual words of any text " * 9, "é" * 50]

    def size(content, w):
        return int(toxicity.Lengths(content)(w, np.array([0]), np.array([len(w)]))[0])

    rows = []
    for t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
        cut = [(" " + " ".join(w[i : i + toxicity.WINDOW]) + " ").encode() for i in range(0, len(w), toxicity.WINDOW)]
        gain = sorted((size(m.ordinary, x) - size(m.toxic, x) for x in cut), reverse=True)
        top = [min(max(g, 0), 12) for g in gain[: toxicity.TOP]] + [0] * (toxicity.TOP - len(gain[: toxicity.TOP]))
        rows.append(top + [np.log1p(sum(g >= k + 2 for g in gain)) for k in range(toxicity.TOP)] + [np.log1p(len(cut))])
    assert np.allclose(m.gains(pa.array(texts)), rows) and rows[0][0] > 0
    want = 1 / (1 + np.exp(-(np.array(rows) @ m.weight[:-1] + m.weight[-1])))
    got = toxicity.with_score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).collect()
    assert np.allclose([x._toxic for x in sorted(got)], want)


def test_toxicity_learns_and_holds_out(spark):
    r = random.Random(1)
    bad = ["horriblefool", "nastyrat", "vilebeast", "grimtoad"]
    rows, labels = [], []
    for i in range(600):
        w = prose(r, 120).split()
        if i % 4 == 0:
            for _ in range(6):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w), "", "", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000, None, "", "", 0), (1001, "", "", "", 0), (None, "x", "", "", 0)]
    d, lab = extra(spark.createDataFrame(rows, DOCS)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.classify(d, lab).collect()
    assert len(got) == len(rows)
    test = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 600]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got if x.doc_id is not None)
    assert sum(x.predicted == int(x.doc_id % 4 == 0) for x in test) >= 0.95 * len(test)
    kept = toxicity.drop_toxic(d, lab)
    unharmed(kept, d)
    assert {None, 1000, 1001} <= {x.doc_id for x in kept.collect()}


def url_brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOW)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[2:] if fit else (None, "allow"))


def test_urls(spark):
    r = random.Random(4)
    hosts = ["example.org", "EXAMPLE.org", "a.b.example.org", "xexample.org", "org", "com", "m.shop.com", "net", "", "x.org.", "example.org:80", ".org"]
    made = [f"{s}{r.choice(hosts)}{p}" for s in ("http://", "ftp://", "", "a://b://") for p in ("", "/", "/es/", "/es", "/en/1", "/en/12?x", "/fr/#y", "?/es/", "/de/a/b", "/ES/") for _ in range(4)]
    pages = [(i // 2, u) for i, u in enumerate(made)] + [(None, None), (None, made[3]), (3, made[5]), (3, made[5]), (4, "x" * 50_000)]
    got = sorted((x.page_id if x.page_id is not None else -1, x.host, x.path, x.rule or "", x.verdict) for x in urls.judge(spark.createDataFrame(pages, "page_id long, url string").withColumn("key", F.lit(1)), urls.rule_table(spark)).collect())
    want = sorted((i if i is not None else -1, *(lambda h, p, ru, v: (h, p, ru or "", v))(*url_brute(u))) for i, u in pages)
    assert got == want


def test_urls_nested_rules(spark):
    rules = [("a.com", "/", "block"), ("a.com", "/x/", "allow"), ("a.com", "/x/y/", "block"), ("b.a.com", "/x/", "block"), ("com", "/x", "allow")]
    urls_ = ["http://a.com/x/y/z", "http://a.com/x/q", "http://b.a.com/x/y/z", "http://c.com/x1", "http://c.com/", "http://a.com/zz"]
    got = {x.page_id: (x.rule, x.verdict) for x in urls.judge(spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string"), urls.rule_table(spark, rules)).collect()}
    assert got == {0: ("a.com/x/y/", "block"), 1: ("a.com/x/", "allow"), 2: ("b.a.com/x/", "block"), 3: ("com/x", "allow"), 4: (None, "allow"), 5: ("a.com/", "block")}


def test_mixing_meets_targets(spark):
    r = random.Random(9)
    rows = [(i, " ".join(f"{'ab'[i % 5 == 0]}{r.randrange(50)}" for _ in range(r.randrange(1, 90))), "ab"[i % 5 == 0], "", 0) for i in range(500)] + [(900, None, None, "", 0), (None, "", "a", "", 0)]
    d = extra(spark.createDataFrame(rows, DOCS))
    known = d.select("doc_id", F.col("lang").alias("domain"))
    got = mixing.rates(d, known, {"a": 0.5, "b": 0.5}).collect()
    assert len(got) == len(rows) and all(x.rate >= 0 and abs(x.p_a + x.p_b - 1) < 1e-6 for x in got)
    a, b = (sum(x.rate * x.n_tokens * x[p] for x in got) for p in ("p_a", "p_b"))
    total = sum(x.n_tokens for x in got)
    assert abs(a - total / 2) < 1e-3 * total and abs(b - total / 2) < 1e-3 * total
    out = mixing.mix(d, known, {"a": 0.5, "b": 0.5})
    unharmed(out, d)
    ids = [x.doc_id for x in out.collect()]
    assert set(ids) == {x[0] for x in rows} and len(ids) > len(rows)


def test_mixing_of_domains_without_documents(spark):
    rows = [(i, "one two three four five", "a", "", 0) for i in range(50)] + [(60, None, None, "", 0), (61, "", "c", "", 0)]
    d = spark.createDataFrame(rows, DOCS)
    known = d.select("doc_id", F.col("lang").alias("domain"))
    got = mixing.rates(d, known, {"a": 0.5, "b": 0.3, "c": 0.2}).collect()
    assert len(got) == len(rows) and all(x.p_b == 0 and x.p_c == 0 and 0 <= x.rate < 2 for x in got)
    assert {x[0] for x in mixing.mix(d, known, {"a": 0.5, "b": 0.5}).collect()} == {x[0] for x in rows}
    even = mixing.rates(d, known.filter("false"), {"a": 0.5, "b": 0.5}).collect()
    assert all(x.p_a == x.p_b == 0.5 for x in even)
    for bad in ({"a": 0.0, "b": 0.0}, {"a": 1.0, "b": -0.5}):
        with pytest.raises(ValueError):
            mixing.rates(d, known, bad)


def test_mixing_rates_against_brute_force(spark):
    """The fitted rates minimise the distance to the targets: no other nonnegative rates of the same chances come closer, and those found are close to the least change."""
    import numpy as np

    r = random.Random(12)
    rows = [(i, " ".join(f"{'abc'[i % 7 % 3]}{r.randrange(30)}" if r.random() < 0.8 else f"z{r.randrange(9)}" for _ in range(r.randrange(2, 60))), "abc"[i % 7 % 3], "", 0) for i in range(300)]
    d = spark.createDataFrame(rows, DOCS)
    targets = {"a": 0.2, "b": 0.3, "c": 0.5}
    got = mixing.rates(d, d.select("doc_id", F.col("lang").alias("domain")), targets).collect()
    n, p = np.array([x.n_tokens for x in got], float), np.array([[x.p_a, x.p_b, x.p_c] for x in got])
    goal = n.sum() * np.array([0.2, 0.3, 0.5])
    a, rate = (p * n[:, None]).T, np.ones(len(n))
    for _ in range(200_000):  # plain projected gradient on the same least squares
        step = a.T @ (a @ rate - goal)
        rate = np.maximum(0, rate - step / np.linalg.norm(a, 2) ** 2)
        if np.abs(a @ rate - goal).max() < 1e-4 * n.sum():
            break
    mine = np.array([x.rate for x in got])
    assert np.abs(a @ mine - goal).max() <= 2e-4 * n.sum() and np.abs(a @ rate - goal).max() <= 2e-4 * n.sum()
    assert all(int(x.rate) <= x.copies <= int(x.rate) + 1 for x in got) and abs(sum(x.copies for x in got) - mine.sum()) < 40


def test_token_rollup(spark, tmp_path, docs):
    vocabulary = tmp_path / "v"
    import base64

    vocabulary.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + f" {i}".encode() for i in range(256)))
    roll = token_counts.Rollup(spark, f"file://{tmp_path}/roll")
    d = spark.createDataFrame([(1, "abc", "en", "s"), (2, "de", None, "s"), (3, None, "en", "s"), (4, "abc", "en", "t"), (4, "abc", "en", "t")], "doc_id long, text string, lang string, source string")
    count = lambda x: token_counts.counted(x, "bytes/1", str(vocabulary))
    total = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in roll.totals().collect()}
    assert roll.commit("one", count(d)) and not roll.commit("one", count(d))
    assert total() == {("s", "en"): (2, 3), ("s", None): (1, 2), ("t", "en"): (2, 6)}
    assert roll.commit("two", roll.deletion(d.filter("doc_id = 4").select("doc_id")))
    assert total() == {("s", "en"): (2, 3), ("s", None): (1, 2)}
    new = spark.createDataFrame([(1, "abcdef", "de", "s")], "doc_id long, text string, lang string, source string")
    assert roll.commit("three", roll.revision(new, "bytes/1", str(vocabulary))) and not roll.commit("three", count(d))
    assert total() == {("s", "en"): (1, 0), ("s", None): (1, 2), ("s", "de"): (1, 6)}
    assert roll.commit("none", count(d.limit(0))) and roll.commit("nothing", roll.deletion(d.limit(0).select("doc_id"))) and len(total()) == 3
    roll.commit("null", count(spark.createDataFrame([(None, "xyz", None, None)] * 2, d.schema)))
    assert total()[None, None] == (2, 6)
    roll.commit("null gone", roll.deletion(spark.createDataFrame([(None,)], "doc_id long")))
    assert (None, None) not in total()
    assert {"one", "two", "three"} <= set(roll.committed())


def test_token_counts_of_copies_and_revised_texts(spark, tmp_path):
    """One count of every text stays, that of the smallest id; a text is revised only where that text is counted."""
    import base64

    vocabulary = tmp_path / "v"
    vocabulary.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + f" {i}".encode() for i in range(256)))
    rows = [(1, "same", "en", "s"), (2, "same", "en", "s"), (2, "other text", "en", "s"), (3, "same", "de", "t"), (None, "same", "en", "s"), (5, "twice", None, "t"), (5, "twice", None, "t"), (6, "a  b", "en", "t"), (6, "whole", "en", "t"), (None, "c  d", None, None), (7, None, "en", "s"), (8, "", "en", "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    roll = token_counts.Rollup(spark, f"file://{tmp_path}/roll")
    roll.commit("load", token_counts.counted(d, "v", str(vocabulary)))
    roll.commit("copies", roll.copies())
    seen = lambda: sorted(((r.doc_id or 0, r.n_tokens, r.times) for r in roll.live().collect()))
    assert seen() == [(0, 4, 1), (1, 4, 1), (2, 10, 1), (5, 5, 1), (6, 4, 1), (6, 5, 1), (7, 0, 1)]
    new = d.select("doc_id", "source", "lang", F.col("text").alias("old"), token_counts.tidy(F.col("text")).alias("text")).filter("text <> old")
    roll.commit("tidied", roll.revision(new, "v", str(vocabulary), old="old"))
    assert seen() == [(0, 3, 1), (1, 4, 1), (2, 10, 1), (5, 5, 1), (6, 3, 1), (6, 5, 1), (7, 0, 1)]
    gone = spark.createDataFrame([(9, "not  counted", "not counted", "en", "s")], "doc_id long, old string, text string, lang string, source string")
    roll.commit("unknown", roll.revision(gone, "v", str(vocabulary), old="old"))
    assert len(seen()) == 7


def test_token_counts_query_against_brute_force(spark, tmp_path):
    """The query's totals on a small table with copies, null columns and untidy texts, counted with the whole vocabulary."""
    rows = [(i, t, lang, src, 0) for i, (t, lang, src) in enumerate([("the same words", "en", "a"), ("the same words", "de", "b"), ("two  blanks\there", "en", "a"), ("two  blanks\there", "en", None), (None, None, "b"), ("", "en", "b"), ("naïve 日本 text", "fr", "b")])]
    spark.createDataFrame(rows + [rows[0]], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    enc = token_counts.encoder(token_counts.vocabulary(token_counts.VOCABULARY))
    want, seen = {}, set()
    for _, t, lang, src, _ in rows:
        if (t or "") not in seen:
            seen.add(t or "")
            n = len(enc.encode_ordinary(re.sub("[ \t]{2,}", " ", t).strip(" "))) if t else 0
            docs, tokens = want.get((src, lang), (0, 0))
            want[src, lang] = (docs + 1, tokens + n)
    got = queries.op1_token_counts(spark, str(tmp_path)).collect()
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in got} == want
