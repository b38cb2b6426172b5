"""Queries do their operator's whole job; SQL twins that cover a part of it cannot show that."""

import random
from datetime import datetime

from tessera import catalog
from tessera.operators import graph as G
from tessera.operators import modules as M


def walked(edges, start):
    """The walk of the survey's V1: a queue over the edges in sorted order."""
    seen, out, queue = {start}, [(start, 0, None)], [(start, 0)]
    for at, level in queue:
        for s, t in sorted(set(edges)):
            if s == at and t not in seen:
                seen.add(t)
                out.append((t, level + 1, at))
                queue.append((t, level + 1))
    return [(x, level, i, source) for i, (x, level, source) in enumerate(out)]


def test_chain_walks_over_all_line_items(spark, tmp_path):
    r = random.Random(4)
    rows = [(o, n, r.randrange(60), r.choice("ANR"), datetime(1992 + r.randrange(7), 1, 1)) for o in range(40) for n in range(1, 5)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    part = {(o, n): p for o, n, p, *_ in rows}
    edges = {(p, part[o, n + 1]) for (o, n), p in part.items() if (o, n + 1) in part and p != part[o, n + 1]}
    want = walked(edges, min(s for s, _ in edges))
    assert len(want) > 30 and want[-1][1] > 2
    got = catalog.QUERIES["v1_import_chain_levels"](spark, str(tmp_path)).collect()
    assert sorted((x.id, x.level) for x in got) == sorted(x[:2] for x in want)
    got = catalog.QUERIES["v1_import_chain"](spark, str(tmp_path)).orderBy("ord").collect()
    assert [(x.id, x.level, x.ord, x.source) for x in got] == want


def test_chain_takes_the_first_edge_of_a_cycle(spark):
    edges = [("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "a"), ("c", "e"), ("x", "y")]
    got = G.chain(spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame([("a",)], "id string"))
    assert [tuple(x) for x in got.orderBy("ord").select("id", "level", "ord", "source").collect()] == walked(edges, "a")


def tables(spark, path):
    """A small graph of three regions: files, symbols, packages, directories and externals."""
    r = random.Random(9)
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    put("region", [(0, "AFRICA"), (1, "AMERICA"), (2, "ASIA")], "r_regionkey int, r_name string")
    put("nation", [(i, f"N{i}", i % 3) for i in range(6)], "n_nationkey int, n_name string, n_regionkey int")
    put("customer", [(k, k % 6) for k in range(1, 41)], "c_custkey long, c_nationkey int")
    put("supplier", [(k, k % 6) for k in range(1, 13)], "s_suppkey long, s_nationkey int")
    put("orders", [(o, r.randrange(1, 41)) for o in range(1, 81)], "o_orderkey long, o_custkey long")
    put("part", [(p, f"Brand#{p % 7}", p % 3) for p in range(1, 31)], "p_partkey long, p_brand string, p_size int")
    put("lineitem", [(o, n, r.randrange(1, 31), r.randrange(1, 13), "N") for o in range(1, 81) for n in range(1, 4)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string")
    return str(path)


def test_all_edges_are_ordered(spark, tmp_path):
    at = tables(spark, tmp_path)
    want = sorted({(x.source, x.target) for x in catalog.edges(catalog.Tables(spark, at)).collect()})
    assert len({s.split("/")[0] for s, _ in want}) == 3
    got = catalog.QUERIES["o2_edge_order"](spark, at).collect()
    assert sorted((x.ord, x.source, x.target) for x in got) == [(i, *e) for i, e in enumerate(want, 1)]


def test_nodes_of_all_kinds_are_ordered(spark, tmp_path):
    at = tables(spark, tmp_path)
    nodes = catalog.graph_nodes(catalog.Tables(spark, at)).select("id", "kind").collect()
    assert {x.kind for x in nodes} == {"package", "directory", "file", "symbol", "external"}
    got = catalog.QUERIES["o1_node_order"](spark, at).collect()
    assert sorted((x.ord, x.id) for x in got) == [(i, x) for i, (x, _) in enumerate(sorted((x.id, x.kind) for x in nodes), 1)]


def test_numbers_run_on_over_range_partitions(spark):
    given = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = G.numbered(spark.range(5000).selectExpr("(id * 7919) % 5000 as x", "id"), "x", "id")
        assert got.rdd.getNumPartitions() > 1 and [(r.x, r.ord) for r in got.orderBy("x").collect()] == [(i, i + 1) for i in range(5000)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", given)


def test_communities_are_of_the_whole_graph(spark, tmp_path):
    at = tables(spark, tmp_path)
    und = sorted(tuple(x) for x in G.undirected(G.weights(catalog.edges(catalog.Tables(spark, at)))).select("a", "b", "weight").collect())
    assert any(a.split("/")[0] != b.split("/")[0] for a, b, _ in und)
    got = catalog.QUERIES["m3_louvain"](spark, at).collect()
    assert len({x.id for x in got}) == len(got) and {x.id: x.community for x in got} == M.louvain(*map(list, zip(*und, strict=True)))
