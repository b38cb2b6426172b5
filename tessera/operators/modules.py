"""Community detection and module order; one group for each repository."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import numbered
from tessera.plans.session import release, ship, table

#: Bytes of a graph's array that a task holds itself; a longer one lies in a file, which the system caches as it can.
HELD = 32 << 20
#: Neighbours that are taken up at once.
STEP = 1 << 18


def room(n: int, kind: type) -> np.ndarray:
    """An array of n zeros; a long one in a file of the task's own that goes with it."""
    size = n * np.dtype(kind).itemsize
    if size <= HELD:
        return np.zeros(n, dtype=kind)
    with tempfile.TemporaryFile() as f:
        os.posix_fallocate(f.fileno(), 0, size)
        return np.memmap(f, dtype=kind, mode="r+", shape=(n,))


class Rows:
    """Arrays one after the other, in a file from some length on."""

    def __init__(self, kind: type):
        self.kind, self.parts, self.n, self.file = kind, [], 0, None

    def add(self, x: np.ndarray) -> None:
        x = np.ascontiguousarray(x, dtype=self.kind)
        self.n += len(x)
        self.parts.append(x)
        if self.file is None and self.n * x.itemsize > HELD:
            self.file = tempfile.TemporaryFile()  # noqa: SIM115
        if self.file is not None:
            for p in self.parts:
                self.file.write(p.tobytes())
            self.parts = []

    def get(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate([np.zeros(0, dtype=self.kind), *self.parts])
        self.file.flush()
        out = np.memmap(self.file, dtype=self.kind, mode="r", shape=(self.n,))
        self.file.close()
        return out


def first(count: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(count)]).astype(np.int64)


class Graph:
    """Neighbours of each node in ascending order, each with its weight, and the weight of its loop."""

    def __init__(self, start: np.ndarray, near: np.ndarray, weight: np.ndarray, loop: np.ndarray):
        self.start, self.near, self.weight, self.loop, self.n = start, near, weight, loop, len(loop)

    @classmethod
    def of(cls, parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int | None = None) -> Graph:
        """From (low, high, weight) in ascending order of low and high."""
        low, high, weight = Rows(np.int32), Rows(np.int32), Rows(np.float64)
        below, above, loop = (np.zeros(n or 0, dtype=k) for k in (np.int64, np.int64, np.float64))
        for a, b, w in parts:
            most = int(b.max(initial=-1)) + 1
            if most > len(loop):
                below, above, loop = (np.concatenate([x, np.zeros(max(most, 2 * len(x)) - len(x), dtype=x.dtype)]) for x in (below, above, loop))
            apart = a != b
            np.add.at(loop, a[~apart], w[~apart])
            a, b, w = a[apart], b[apart], w[apart]
            np.add.at(above, a, 1)
            np.add.at(below, b, 1)
            low.add(a)
            high.add(b)
            weight.add(w)
            n = max(n or 0, most)
        below, above, loop = below[: n or 0], above[: n or 0], loop[: n or 0]
        a, b, w = low.get(), high.get(), weight.get()
        start = first(below + above)
        near, weights = room(2 * len(a), np.int32), room(2 * len(a), np.float64)
        # of a node, those below it come first
        behind, fill = start[:-1] + below - first(above)[:-1], start[:-1].copy()
        for i in range(0, len(a), STEP):
            x, y, v = (np.array(z[i : i + STEP]) for z in (a, b, w))
            at = behind[x] + np.arange(i, i + len(x))
            near[at], weights[at] = y, v
            order = np.argsort(y, kind="stable")
            y, x, v = y[order], x[order], v[order]
            head = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
            times = np.diff(np.append(head, len(y)))
            at = fill[y] + np.arange(len(y)) - np.repeat(head, times)
            near[at], weights[at] = x, v
            fill[y[head]] += times
        return cls(start, near, weights, loop)

    def runs(self, nodes: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
        """Stretches of nodes (by place in nodes) with about STEP neighbours."""
        ends = self.start if nodes is None else first(np.diff(self.start)[nodes])
        i = 0
        while i < len(ends) - 1:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + STEP, side="right")) - 1)
            yield i, j
            i = j

    def moved(self) -> np.ndarray | None:
        """Communities after local moves of single nodes in ascending order, until none moves; none if nothing moved at all."""
        loop = self.loop.tolist()
        deg: list[float] = []
        for i, j in self.runs():
            v, at = self.weight[self.start[i] : self.start[j]].tolist(), (self.start[i : j + 1] - self.start[i]).tolist()
            deg += [sum(v[p:q]) + 2 * loop[k] for k, p, q in zip(range(i, j), at, at[1:], strict=False)]
        two_m = sum(deg) or 1.0
        com, total, moved_any = list(range(self.n)), list(deg), False
        while True:
            moved = False
            for i, j in self.runs():
                s = slice(int(self.start[i]), int(self.start[j]))
                nb, v, at = self.near[s].tolist(), self.weight[s].tolist(), (self.start[i : j + 1] - self.start[i]).tolist()
                for k, p, q in zip(range(i, j), at, at[1:], strict=False):
                    near: dict[int, float] = {}
                    for x, w in zip(nb[p:q], v[p:q], strict=True):
                        c = com[x]
                        near[c] = near.get(c, 0.0) + w
                    own, d = com[k], deg[k]
                    total[own] -= d
                    best, top = own, near.get(own, 0.0) - total[own] * d / two_m
                    for c in sorted(near):
                        gain = near[c] - total[c] * d / two_m
                        if gain > top + 1e-12:
                            best, top = c, gain
                    total[best] += d
                    if best != own:
                        com[k], moved = best, True
            if not moved:
                break
            moved_any = True
        return np.array(com, dtype=np.int64) if moved_any else None

    def contracted(self, com: np.ndarray, n: int) -> Graph:
        """The graph of n communities; an inner edge counts once in a loop."""
        order = np.argsort(com, kind="stable")
        size = np.diff(self.start)
        loop = np.bincount(com, weights=self.loop, minlength=n)
        near, weight, count = Rows(np.int32), Rows(np.float64), np.zeros(n, dtype=np.int64)
        late_key, late_sum = np.zeros(0, dtype=np.int64), np.zeros(0)

        def put(key: np.ndarray, total: np.ndarray) -> None:
            near.add(key % n)
            weight.add(total)
            np.add.at(count, key // n, 1)

        for i, j in self.runs(order):
            nodes = order[i:j]
            many = size[nodes]
            ends = np.cumsum(many)
            at = np.arange(int(many.sum())) + np.repeat(self.start[nodes] - ends + many, many)
            other, v, node = self.near[at], self.weight[at], np.repeat(nodes, many)
            x, y = com[node], com[other]
            inner = x == y
            once = inner & (other > node)
            loop += np.bincount(x[once], weights=v[once], minlength=n) if once.any() else 0.0
            key = np.concatenate([late_key, x[~inner] * n + y[~inner]])
            key, place = np.unique(key, return_inverse=True)
            total = np.bincount(place, weights=np.concatenate([late_sum, v[~inner]]), minlength=len(key))
            # the last community may go on in the next stretch
            cut = int(np.searchsorted(key, int(com[nodes[-1]]) * n))
            put(key[:cut], total[:cut])
            late_key, late_sum = key[cut:], total[cut:]
        put(late_key, late_sum)
        return Graph(first(count), near.get(), weight.get(), loop)


def partition(g: Graph) -> np.ndarray:
    """Community of each node, numbered by first appearance: repeated local moves and contraction; ties to the smallest community."""
    place = np.arange(g.n)
    while (com := g.moved()) is not None:
        com, n = renumbered(com)
        place = com[place]
        g = g.contracted(com, n)
    return renumbered(place)[0]


def renumbered(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Values by first appearance, and how many there are."""
    _, at, back = np.unique(x, return_index=True, return_inverse=True)
    rank = np.empty(len(at), dtype=np.int64)
    rank[np.argsort(at)] = np.arange(len(at))
    return rank[back], len(at)


def louvain(a: list, b: list, w: list) -> dict:
    """Communities by repeated local moves and contraction; nodes in sorted order, ties to the smallest community."""
    names = sorted(set(a) | set(b))
    index = {x: i for i, x in enumerate(names)}
    ends = np.array([[index[x] for x in a], [index[x] for x in b]], dtype=np.int64).reshape(2, -1)
    low, high = ends.min(0), ends.max(0)
    order = np.lexsort((high, low))
    return dict(zip(names, partition(Graph.of(iter([(low[order], high[order], np.array(w, dtype=float)[order])]), len(names))).tolist(), strict=True))


def _partitioned(group: str):
    """Mapper over edges (group, low, high, weight) in that order; a group's edges pass by once and are never held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def stretch() -> Iterator[pa.RecordBatch]:
            """The rows of one group, up to the next."""
            name = None
            while True:
                batch = waiting.pop() if waiting else next(batches, None)
                if batch is None:
                    return
                if not batch.num_rows:
                    continue
                keys = batch.column(0)
                name = name or (keys[0].as_py(),)
                last = batch.num_rows if keys[batch.num_rows - 1].as_py() == name[0] else int(np.argmax([x != name[0] for x in keys.to_pylist()]))
                if last:
                    yield batch.slice(0, last)
                if last < batch.num_rows:
                    waiting.append(batch.slice(last))
                    return

        while True:
            some = stretch()
            head = next(some, None)
            if head is None:
                break
            parts = (tuple(x.column(i).to_numpy() for i in (1, 2, 3)) for k in ([head], some) for x in k)
            got = partition(Graph.of(parts))
            for i in range(0, len(got), 100_000):
                part = got[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([head.column(0)[0].as_py()] * len(part), pa.string()), pa.array(np.arange(i, i + len(part)), pa.int64()), pa.array(part, pa.int32())], names=[group, "at", "community"])
        release()

    return run


def communities(und: DataFrame, group: str = "repo_id") -> DataFrame:
    """repo, id, community of an undirected weighted graph (repo, a, b, weight); each repository is one task's work.

    That task holds what a node needs (some 200 bytes); edges stream through it as numbers and lie in files of its own, so a repository may have far more of them than fit its memory.
    """
    ship(und.sparkSession)
    und = table(und.select(group, "a", "b", F.col("weight").cast("double").alias("weight")), "louvain-edges")[0]
    ids = und.select(group, F.col("a").alias("id")).union(und.select(group, "b")).distinct()
    every = table(numbered(ids, group, "id"), "louvain-nodes")[0]
    least = every.groupBy(group).agg(F.min("ord").alias("least"))
    nodes = every.join(least, group).select(group, "id", (F.col("ord") - F.col("least")).alias("at"))
    a, b = (nodes.select(group, F.col("id").alias(x), F.col("at").alias(f"at_{x}")) for x in "ab")
    edges = und.join(a, [group, "a"]).join(b, [group, "b"]).select(group, F.least("at_a", "at_b").cast("int").alias("low"), F.greatest("at_a", "at_b").cast("int").alias("high"), "weight")
    found = edges.repartition(group).sortWithinPartitions(group, "low", "high").mapInArrow(_partitioned(group), f"{group} string, at long, community int")
    return found.join(nodes, [group, "at"]).select(group, "id", "community")


def strong_components(edges: list[tuple]) -> list[list]:
    """Strongly connected components (iterative depth-first search)."""
    out: dict = {}
    for s, t in edges:
        out.setdefault(s, []).append(t)
        out.setdefault(t, [])
    index: dict = {}
    low: dict = {}
    stack, on, found = [], set(), []
    for root in sorted(out):
        if root in index:
            continue
        work = [(root, iter(sorted(out[root])))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for t in it:
                if t not in index:
                    index[t] = low[t] = len(index)
                    stack.append(t)
                    on.add(t)
                    work.append((t, iter(sorted(out[t]))))
                    break
                if t in on:
                    low[v] = min(low[v], index[t])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        part.append(x)
                        if x == v:
                            break
                    found.append(sorted(part))
    return found


def ordered(names: dict, edges: list[tuple]) -> list:
    """Modules, each after all it imports: of the components whose imports are all placed, always the one of the earliest name.

    edges: (module, module that it imports). Modules that import each other are one component, in order of name.
    """
    import heapq

    parts = strong_components([*edges, *((m, m) for m in names)])
    of = {m: i for i, p in enumerate(parts) for m in p}
    users: dict[int, set] = {i: set() for i in range(len(parts))}
    wait = {i: 0 for i in range(len(parts))}
    for s, t in edges:
        if of[s] != of[t] and of[s] not in users[of[t]]:
            users[of[t]].add(of[s])
            wait[of[s]] += 1
    key = lambda i: (min(names.get(m, "") for m in parts[i]), i)
    ready = [key(i) for i in wait if wait[i] == 0]
    heapq.heapify(ready)
    out = []
    while ready:
        _, i = heapq.heappop(ready)
        out += sorted(parts[i], key=lambda m: (names.get(m, ""), m))
        for j in users[i]:
            wait[j] -= 1
            if wait[j] == 0:
                heapq.heappush(ready, key(j))
    return out


def module_order(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """id, name, component, ord; modules: repo_id, id, name; edges: repo_id, src, dst. A repository's modules are few."""
    ship(modules.sparkSession)
    both = modules.selectExpr("repo_id", "id as x", "cast(null as int) as y", "name").unionByName(edges.selectExpr("repo_id", "src as x", "dst as y", "cast(null as string) as name"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, e = pdf[pdf.y.isna()], pdf[pdf.y.notna()]
        names = dict(zip(m.x.astype(int), m.name, strict=True))
        pairs = sorted({(int(s), int(t)) for s, t in zip(e.x, e.y, strict=True)})
        comp = {v: min(p) for p in strong_components([*pairs, *((v, v) for v in names)]) for v in p}
        order = ordered(names, pairs)
        return pd.DataFrame({"repo_id": pdf.repo_id.iloc[0], "id": order, "name": [names.get(v) for v in order], "component": [comp[v] for v in order], "ord": range(len(order))})

    return both.groupBy("repo_id").applyInPandas(run, "repo_id string, id int, name string, component int, ord int")


def judged(ids: list, a: list, b: list, w: list) -> dict:
    """id to (community or None, reason or None): communities of a small graph with the four tests of assignment."""
    com = louvain(a, b, w) if a else {}
    fresh = len(com)
    for x in sorted(ids):
        if x not in com:
            com[x], fresh = fresh, fresh + 1
    deg, inner, size = dict.fromkeys(com, 0.0), dict.fromkeys(com, 0.0), {}
    for c in com.values():
        size[c] = size.get(c, 0) + 1
    for x, y, v in zip(a, b, w, strict=True):
        for n in (x, y):
            deg[n] += v
            inner[n] += v if com[x] == com[y] else 0.0
    m = sum(w)
    within = sum(v for x, y, v in zip(a, b, w, strict=True) if com[x] == com[y])
    total: dict = {}
    for n, c in com.items():
        total[c] = total.get(c, 0.0) + deg[n]
    q = within / m - sum(d * d for d in total.values()) / (4 * m * m) if m else 0.0
    reason = lambda x: "isolated" if deg[x] == 0 else "undersized" if size[com[x]] < 2 else "low-embeddedness" if inner[x] / deg[x] < 0.5 else "degenerate-partition" if q < 0.1 else None
    return {x: (None, reason(x)) if reason(x) else (com[x], None) for x in com}


def refine(files: DataFrame, und: DataFrame, wide: DataFrame) -> DataFrame:
    """id, module_id, reason: wide modules split by their own inner edges where at least two parts are assigned.

    files: id, module_id, reason; und: a, b, weight with both ends in one wide module; wide: module_id. A module is one task's work.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ship(files.sparkSession)
    mine = files.join(wide, "module_id", "left_semi").select("module_id", "id")
    both = mine.selectExpr("module_id", "id", "cast(null as string) as a", "cast(null as string) as b", "cast(null as double) as weight").unionByName(und.join(mine.withColumnRenamed("id", "a"), "a").selectExpr("module_id", "cast(null as string) as id", "a", "b", "weight"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = pdf[pdf.a.notna()].sort_values(["a", "b"])
        got = judged(pdf[pdf.id.notna()].id.tolist(), e.a.tolist(), e.b.tolist(), e.weight.tolist())
        if len({c for c, _ in got.values() if c is not None}) < 2:
            got = {}
        return pd.DataFrame({"module_id": pdf.module_id.iloc[0], "id": list(got), "sub": pd.array([c for c, _ in got.values()], dtype="Int32"), "why": [r for _, r in got.values()]})

    parts = both.groupBy("module_id").applyInPandas(run, "module_id int, id string, sub int, why string")
    most = files.agg(F.max("module_id").alias("most"))
    fresh = parts.filter("sub is not null").select("module_id", "sub").distinct().crossJoin(F.broadcast(most))
    fresh = fresh.withColumn("fresh", F.col("most") + F.row_number().over(Window.orderBy("module_id", "sub"))).select("module_id", "sub", "fresh")
    new = parts.join(fresh, ["module_id", "sub"], "left").select("id", "fresh", "why", F.lit(True).alias("split"))
    return files.join(new, "id", "left").select("id", F.when(F.col("split"), F.col("fresh")).otherwise(F.col("module_id")).cast("int").alias("module_id"), F.when(F.col("split"), F.col("why")).otherwise(F.col("reason")).alias("reason"))
