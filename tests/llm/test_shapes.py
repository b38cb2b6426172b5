"""Corpus operators on settings and shapes beyond those of the queries."""

import random
import re

import numpy as np
import pytest

from tessera.llm import parity_join, suffix_match
from tessera.llm.graph import components


@pytest.mark.parametrize("one_task", [10_000, 0])
def test_components_of_a_long_path_of_ascending_ids(spark, one_task):
    path = spark.range(400).selectExpr("id as a", "id + 1 as b")
    assert {tuple(r) for r in components(path, one_task=one_task).collect()} == {(i, 0) for i in range(401)}


def test_components_are_alike_in_one_task_and_by_joins(spark):
    r = random.Random(2)
    edges = [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(260)] + [(5, 5), (900, 900)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = [sorted(tuple(x) for x in components(df, one_task=k).collect()) for k in (10_000, 0)]
    assert got[0] == got[1] and len({c for _, c in got[0]}) > 20 and components(df.limit(0)).count() == 0


def test_parity_join_refuses_a_percent_it_would_lose_links_at(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    with pytest.raises(ValueError):
        parity_join.near_classes(d, percent=60)
    with pytest.raises(ValueError):
        parity_join.keep_one(d, percent=60)


def test_windows_longer_than_sixteen_words():
    r = np.random.default_rng(3)
    head = r.integers(1, 2**31, 20)
    seq = np.concatenate([np.concatenate([head, r.integers(1, 2**31, 20), [0]]) for _ in range(200)]).astype(np.uint32)
    order, pairs = suffix_match.suffix_array(seq, 30)
    wanted = np.stack([seq[i * 41 : i * 41 + 30] for i in range(200)])
    lo, hi = suffix_match.search(seq, order, pairs, wanted)
    assert (hi - lo == 1).all() and (order[lo] == np.arange(200) * 41).all()


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {" ".join(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set())


def test_parity_join_of_sets_with_too_few_bands(spark):
    """Sets a third over the start of a size band have about as many filled bands below as a partner may lack; single shingles make up for it."""
    r = random.Random(11)
    rows, wanted = [], []
    for g in range(120):
        w = [f"a{r.randrange(10**9)}" for _ in range(344)]
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(w[: 4 + 255 + g % 2]))]
        wanted += [(2 * g, 340, 2 * g), (2 * g + 1, 255 + g % 2, 2 * g)]
    level = parity_join.level_of(np.array([340, 255]))
    bands = parity_join.bands(level - [1, 0])
    assert bands[0] == bands[1] and parity_join.allowed(np.array([340]), False, 75, 100)[0] > 0.93 * bands[0]
    got = parity_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(x) for x in got) == wanted


def test_parity_join_loses_no_link_of_the_queries_on_a_whole_table(spark):
    """Every row whose id is divisible by 50, by brute force against all rows of sf0.1."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    comp = {x.doc_id: x.component_id for x in parity_join.near_classes(docs).collect()}
    sets = {x.doc_id: shingles(x.text) for x in docs.select("doc_id", "text").collect()}
    links = 0
    for a in sets:
        if a % 50 == 0 and sets[a]:
            for b, s in sets.items():
                if a != b and 4 * min(len(s), len(sets[a])) >= 3 * max(len(s), len(sets[a])):
                    both = len(s & sets[a])
                    if 100 * both >= 75 * (len(s) + len(sets[a]) - both):
                        links += 1
                        assert comp[a] == comp[b]
    assert links > 50


def test_sketches_fold_to_narrower_ones():
    r = np.random.default_rng(1)
    h = r.integers(0, 2**62, 5000)
    pack = lambda w: np.packbits((np.bincount(h % w, minlength=w) & 1).astype(np.uint8))
    assert (parity_join.fold(pack(8192), 256) == pack(2048)).all()
    assert [parity_join.bits_of(n) for n in (0, 1, 1024, 1025, 5000)] == [2048, 2048, 2048, 4096, 16384]
