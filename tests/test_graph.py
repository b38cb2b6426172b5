"""Graph operators on small literal graphs."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import paths as P
from tessera.operators import graph as G
from tessera.operators import modules as M


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def ns(spark):
    rows = [
        (".", "package", "root", None, "typescript", None), ("packages/a", "package", "a", None, "typescript", None), ("packages/a/src", "directory", "src", None, None, None),
        ("packages/a/src/i.ts", "file", "i.ts", "packages/a/src/i.ts", "typescript", None), ("i.ts", "file", "i.ts", "i.ts", "typescript", None),
        ("packages/a/src/i.ts#W", "symbol", "Widget", "packages/a/src/i.ts", None, "class"), ("i.ts#main", "symbol", "main", "i.ts", None, "function"), ("gone.ts#x", "symbol", "x", "gone.ts", None, "function"),
        ("react", "external", "react", None, "typescript", None),
    ]
    return frame(spark, rows, "id string, kind string, name string, file_id string, language string, symbol_kind string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_path_functions(spark):
    d = frame(spark, [("a/b/c.ts",), ("x.ts",), (".ts",)], "p string")
    got = d.select(P.basename(F.col("p")), P.extension(P.basename(F.col("p"))), F.array_join(P.ancestors(F.col("p")), ",")).collect()
    assert [tuple(r) for r in got] == [("c.ts", "ts", "a/b,a,."), ("x.ts", "ts", "."), (".ts", "", ".")]
    e = frame(spark, [("node_modules/x/y.ts",), ("a/dist/z",), ("src/distant.ts",), ("dist",)], "p string")
    assert [r[0] for r in e.select(P.excluded(F.col("p"), ["**/node_modules/**", "**/dist/**"])).collect()] == [True, True, False, True]


def test_filters(ns):
    assert ids(G.matches(ns)) == ids(ns.select("id"))
    assert ids(G.matches(ns, path="")) == []
    assert ids(G.matches(ns, path="packages/a")) == ["packages/a", "packages/a/src", "packages/a/src/i.ts", "packages/a/src/i.ts#W"]
    assert ids(G.matches(ns, path="gone.ts")) == ["gone.ts#x"] and ids(G.matches(ns, path="gone.ts", family="npm")) == []
    assert ids(G.matches(ns, search="WID")) == ["packages/a/src/i.ts#W"]
    assert ids(G.closure(ns, G.matches(ns, symbol_kind="class"))) == ["packages/a", "packages/a/src", "packages/a/src/i.ts", "packages/a/src/i.ts#W"]
    assert ids(G.closure(ns, G.matches(ns, path="i.ts"))) == [".", "i.ts", "i.ts#main"]
    assert ids(G.closure(ns, ns.filter("kind = 'directory'"))) == ["packages/a", "packages/a/src"]
    assert ids(G.closure(ns, ns.filter("id in ('react', 'packages/a', 'gone.ts#x')"))) == ["gone.ts", "gone.ts#x", "packages/a", "react"]
    assert "react" in ids(G.view_matches(ns, path="")) and "react" in ids(G.view_matches(ns, path="."))
    assert "packages/a/src" not in ids(G.view_matches(ns, path="packages", family="npm"))


def test_closure_goes_up_to_the_package_of_each_family(spark):
    rows = [
        (".@go", "package", "poly", None, "go", None), (".@npm", "package", "poly", None, "typescript", None), ("goa", "directory", "goa", None, None, None), ("web", "directory", "web", None, None, None),
        ("goa/a1.go", "file", "a1.go", "goa/a1.go", "go", None), ("goa/a1.go#H", "symbol", "H", "goa/a1.go", None, "function"), ("web/app.js", "file", "app.js", "web/app.js", "javascript", None),
        ("a", "package", "a", None, "go", None), ("a/web", "package", "w", None, "typescript", None), ("a/web/src", "directory", "src", None, None, None), ("a/web/src/x.go", "file", "x.go", "a/web/src/x.go", "go", None),
        ("a/web/src/y.ts", "file", "y.ts", "a/web/src/y.ts", "typescript", None),
    ]
    n = frame(spark, rows, "id string, kind string, name string, file_id string, language string, symbol_kind string")
    up = lambda *found: ids(G.closure(n, frame(spark, [(x,) for x in found], "id string")))
    assert up("goa/a1.go#H") == [".@go", "goa", "goa/a1.go", "goa/a1.go#H"]
    assert up("web/app.js") == [".@npm", "web", "web/app.js"]
    assert up("a/web/src/x.go") == ["a", "a/web/src", "a/web/src/x.go"]  # a/web is a package of another family
    assert up("a/web/src/y.ts") == ["a/web", "a/web/src", "a/web/src/y.ts"]
    assert up("a/web/src") == ["a", "a/web", "a/web/src"]


def test_nested_package_root_leaves_no_parent_directory(spark):
    files = frame(spark, [("packages/a/src/x.ts",), ("lib/y.ts",)], "id string")
    assert ids(G.directories(files, frame(spark, [(".",), ("packages/a",)], "id string"))) == ["lib", "packages/a/src"]


def test_weights_and_partition(spark):
    e = frame(spark, [("src/a/x.ts", "src/a/y.ts"), ("src/b/p.ts", "src/b/q.ts")], "source string, target string")
    w = G.weights(e)
    assert {r.weight for r in w.collect()} == {9.0}
    part = frame(spark, [("src/a/x.ts", 0), ("src/a/y.ts", 0), ("src/b/p.ts", 1), ("src/b/q.ts", 1)], "id string, c int")
    assert G.modularity(G.undirected(w), part).first().q == 0.5
    got = {r.id: r.community for r in M.communities(G.undirected(w).withColumn("repo_id", F.lit("r"))).collect()}
    assert got == {"src/a/x.ts": 0, "src/a/y.ts": 0, "src/b/p.ts": 1, "src/b/q.ts": 1}


def test_dilution(spark):
    rows = [(f"s{i}/f.ts", "lib/hub.ts") for i in range(4)] + [(f"m/s{i}/d/f.ts", "m/s9/h.ts") for i in range(4)]
    w = {(r.source, r.target): r.weight for r in G.weights(frame(spark, rows, "source string, target string")).collect()}
    assert w["s0/f.ts", "lib/hub.ts"] == 1.0 and w["m/s0/d/f.ts", "m/s9/h.ts"] == 1.0


def test_directory_vote(spark):
    rows = [("a", 5), ("a", 5), ("a", 7), ("a", 7), ("b", 5), ("b", 7), ("c", 5), ("c", 5), ("c", 5), ("c", 7)]
    f = frame(spark, [(f"{d}/{i}", d, m) for i, (d, m) in enumerate(rows)], "id string, dir string, module_id int")
    assert {r.dir: r.module_id for r in G.majority(f).collect()} == {"a": 5, "b": None, "c": 5}


def test_merge_keeps_first_specifier_and_all_lines(spark):
    rows = [("a", "b", "crate::sub", False, 3, 0), ("a", "b", "sub", True, 1, 1), ("a", "c", "x", False, 2, 2)]
    got = {r.target: r for r in G.merge_imports(frame(spark, rows, "source string, target string, specifier string, re_export boolean, line int, ord int")).collect()}
    assert got["b"].specifier == "crate::sub" and got["b"].lines == [3, 1] and got["b"].via_re_export and not got["c"].via_re_export


def test_breadth_first_on_a_cycle(spark):
    e = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "source string, target string")
    assert {(r.id, r.level) for r in G.levels(e, frame(spark, [("a",)], "id string")).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_order_lists_what_is_imported_first():
    names = lambda given, edges: [given[m] for m in M.ordered(given, edges)]
    assert names({1: "aaa-consumer", 0: "zzz-base"}, [(1, 0)]) == ["zzz-base", "aaa-consumer"]
    assert names({2: "aaa-top", 1: "mmm-middle", 0: "zzz-base"}, [(2, 1), (1, 0)]) == ["zzz-base", "mmm-middle", "aaa-top"]
    assert names({1: "zebra", 0: "apple"}, []) == ["apple", "zebra"]
    assert names({1: "zebra", 0: "apple"}, [(1, 0), (0, 1)]) == ["apple", "zebra"]
    assert names({0: "zzz-core", 1: "aaa-sat1", 2: "bbb-sat2", 3: "consumer"}, [(0, 1), (1, 0), (0, 2), (2, 0), (3, 0)]) == ["aaa-sat1", "bbb-sat2", "zzz-core", "consumer"]
    assert names({0: "a", 1: "b"}, [(0, 0)]) == ["a", "b"] and M.ordered({}, []) == []


def test_order_takes_the_earliest_ready_component():
    r = random.Random(1)
    edges = [(r.randrange(20), r.randrange(20)) for _ in range(25)]
    given = {i: f"n{i:02}" for i in range(20)}
    order = M.ordered(given, edges)
    parts = M.strong_components([*edges, *((i, i) for i in given)])
    comp = {v: i for i, p in enumerate(parts) for v in p}
    assert sorted(order) == list(given) and all(order.index(t) < order.index(s) for s, t in edges if comp[s] != comp[t])
    # at every step the earliest of what could come
    placed: set[int] = set()
    while len(placed) < len(parts):
        ready = [i for i in range(len(parts)) if i not in placed and all(comp[t] in placed or comp[t] == i for s, t in edges if comp[s] == i)]
        best = min(ready, key=lambda i: min(given[v] for v in parts[i]))
        assert order[: len(parts[best])] == sorted(parts[best])
        placed.add(best)
        order = order[len(parts[best]) :]


def test_louvain_triangles():
    a, b = zip(*[(f"{g}{i}", f"{g}{j}") for g in "xyz" for i in range(3) for j in range(i)] + [("x0", "y0")], strict=True)
    got = M.louvain(list(a), list(b), [1.0] * len(a))
    assert len(set(got.values())) == 3 and all(len({got[f"{g}{i}"] for i in range(3)}) == 1 for g in "xyz")


def test_every_twin_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def moved_and_contracted(a, b, w):
    """Louvain over dictionaries, all edges at once."""
    names = sorted({*a, *b})
    adj, place = [{} for _ in names], list(range(len(names)))
    for x, y, v in zip(map(names.index, a), map(names.index, b), w, strict=True):
        adj[x][y] = adj[x].get(y, 0.0) + v
        if x != y:
            adj[y][x] = adj[y].get(x, 0.0) + v
    while True:
        deg = [sum(row.values()) + row.get(i, 0.0) for i, row in enumerate(adj)]
        com, total, all_, again = list(range(len(adj))), list(deg), sum(deg), True
        while again:
            again = False
            for i, row in enumerate(adj):
                near, own = {}, com[i]
                for j, v in row.items():
                    if j != i:
                        near[com[j]] = near.get(com[j], 0.0) + v
                total[own] -= deg[i]
                best = own
                for c in sorted(near):
                    if near[c] - total[c] * deg[i] / all_ > near.get(best, 0.0) - total[best] * deg[i] / all_ + 1e-12:
                        best = c
                total[best] += deg[i]
                again |= best != own
                com[i] = best
        if com == list(range(len(adj))):
            order = {}
            return {x: order.setdefault(place[i], len(order)) for i, x in enumerate(names)}
        number = {}
        com = [number.setdefault(c, len(number)) for c in com]
        place, inner = [com[p] for p in place], [{} for _ in number]
        for i, row in enumerate(adj):
            for j, v in row.items():
                if j >= i:
                    for x, y in {(com[i], com[j]), (com[j], com[i])}:
                        inner[x][y] = inner[x].get(y, 0.0) + v
        adj = inner


def test_louvain_in_files_and_stretches(spark, monkeypatch):
    graphs = []
    for seed in range(30):
        r = random.Random(seed)
        n = r.choice([2, 9, 40])
        e = sorted({tuple(sorted((f"n{r.randrange(n):02}", f"n{r.randrange(n):02}"))) for _ in range(4 * n)})
        graphs.append([(f"g{seed:02}", *x, r.choice([9.0, 3.0, 1.0, 1.5])) for x in e])
    want = {g[0][0]: moved_and_contracted(*map(list, list(zip(*g, strict=True))[1:])) for g in graphs}
    with monkeypatch.context() as m:
        m.setattr(M, "HELD", 0)
        m.setattr(M, "STEP", 7)
        assert {g[0][0]: M.louvain(*map(list, list(zip(*g, strict=True))[1:])) for g in graphs} == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")  # groups end within batches
    try:
        got = {}
        for x in M.communities(frame(spark, [x for g in graphs for x in g], "repo_id string, a string, b string, weight double")).collect():
            got.setdefault(x.repo_id, {})[x.id] = x.community
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_louvain_holds_nodes_and_not_edges(monkeypatch):
    """Some 290,000 edges among 1,200 nodes pass in batches; as numbers, both directions are 7 MB."""
    monkeypatch.setattr(M, "HELD", 1 << 16)
    monkeypatch.setattr(M, "STEP", 1 << 12)

    def batches():
        for i in range(0, 1200, 10):
            x, y = (z.ravel() for z in np.meshgrid(np.arange(i, i + 10), np.arange(1200), indexing="ij"))
            some = (x < y) & ((x % 3 == y % 3) | ((x * y) % 7 == 1))
            x, y = x[some].astype(np.int32), y[some].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(["r"] * len(x)), pa.array(x), pa.array(y), pa.array(np.where(x % 3 == y % 3, 9.0, 1.0))], names=["repo_id", "low", "high", "weight"])

    assert sum(b.num_rows for b in batches()) > 290_000
    tracemalloc.start()
    got = pa.Table.from_batches(M._partitioned("repo_id")(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.column("community").to_pylist() == [i % 3 for i in range(1200)] and peak < 3 << 20
