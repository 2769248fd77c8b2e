"""Graph operators over N (name) and E (name, dep): order, cycles, closures and critical paths.

A pipeline's graph is small and its order is inherently sequential, so one graph is solved in one task; many graphs are
solved in parallel, one group each. Closures and steps over large edge tables stay in DataFrames.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.sources.shared import kept


class CycleError(ValueError):
    """path: a closed list of names, first and last the same."""

    def __init__(self, path: list[str]):
        super().__init__("dependency cycle: " + " -> ".join(path))
        self.path = path


def smallest_order(deps: dict[str, list[str]]) -> list[str]:
    """The lexicographically smallest order in which every dependency comes first; CycleError names one cycle."""
    waiting = {n: len(set(d)) for n, d in deps.items()}
    users: dict[str, list[str]] = {}
    for n, d in deps.items():
        for x in set(d):
            if x not in deps:
                raise ValueError(f"{n} depends on unknown {x}")
            users.setdefault(x, []).append(n)
    ready = [n for n, k in waiting.items() if not k]
    heapq.heapify(ready)
    out: list[str] = []
    while ready:
        n = heapq.heappop(ready)
        out.append(n)
        for u in users.get(n, ()):
            waiting[u] -= 1
            if not waiting[u]:
                heapq.heappush(ready, u)
    if len(out) < len(deps):
        raise CycleError(one_cycle({n: d for n, d in deps.items() if waiting[n]}))
    return out


def one_cycle(deps: dict[str, list[str]]) -> list[str]:
    """A closed path among nodes left by the order. Every such node waits for another, so walking to the least one repeats."""
    walk, place = [min(deps)], {}
    while walk[-1] not in place:
        place[walk[-1]] = len(walk) - 1
        walk.append(min(d for d in deps[walk[-1]] if d in deps))
    path = walk[place[walk[-1]] :]
    least = path.index(min(path))
    return [*path[least:-1], *path[:least], path[least]]


def critical_path(deps: dict[str, list[str]], seconds: dict[str, int]) -> tuple[list[str], int]:
    """The chain that ends last and its length: ties go to the deeper chain, then to the smaller name. ([], 0) on a cycle."""
    try:
        order = smallest_order(deps)
    except CycleError:
        return [], 0
    best: dict[str, tuple[int, int, str | None]] = {}
    rank = lambda n: (-best[n][0], -best[n][1], n)
    for n in order:
        via = min(set(deps[n]), key=rank, default=None)
        finish, depth = (best[via][0], best[via][1]) if via else (0, 0)
        best[n] = (finish + seconds.get(n, 0), depth + 1, via)
    if not best:
        return [], 0
    at: str | None = min(best, key=rank)
    total, path = best[at][0], []
    while at:
        path.append(at)
        at = best[at][2]
    return path[::-1], total


def critical_paths(edges: DataFrame, graph: str = "graph") -> DataFrame:
    """graph, path (names in order) and total of each graph in edges (graph, name, dep or null, duration); none on a cycle."""

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        deps: dict[str, list[str]] = {n: [] for n in rows["name"]}
        for n, d in zip(rows["name"], rows["dep"], strict=True):
            if d is not None and not pd.isna(d):
                deps[n].append(d)
        path, total = critical_path(deps, dict(zip(rows["name"], rows["duration"].astype(int), strict=True)))
        return pd.DataFrame({graph: [key[0]], "path": [path], "total": [total]})

    kind = edges.schema[graph].dataType.simpleString()
    return edges.select(graph, "name", "dep", "duration").groupBy(graph).applyInPandas(solve, f"{graph} {kind}, path array<string>, total long")


def unknown_deps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (name, dep) whose dep is no node (name)."""
    return edges.where("dep is not null").join(nodes.select(F.col("name").alias("dep")), "dep", "left_anti").select("name", "dep")


def levels(edges: DataFrame) -> DataFrame:
    """name and level of each node in edges (name, dep or null): the longest way to it from a node without dependencies.

    A frontier goes from level to level, so there are as many rounds as levels. CycleError if it never ends.
    """
    known = edges.where("dep is not null").distinct()
    everyone = edges.select("name").unionByName(known.select(F.col("dep").alias("name"))).distinct()
    front = kept(everyone.join(known.select("name"), "name", "left_anti").withColumn("level", F.lit(0).cast("long")))
    found, most = front, everyone.count()
    for level in range(1, most + 1):
        front = kept(known.join(front.select(F.col("name").alias("dep")), "dep").select("name").distinct().withColumn("level", F.lit(level).cast("long")))
        if front.isEmpty():
            return found.groupBy("name").agg(F.max("level").alias("level"))
        found = found.unionByName(front)
        if level % 50 == 0:
            found = kept(found.groupBy("name").agg(F.max("level").alias("level")))
    if most == 0:
        return found
    raise CycleError(["?"])


def topological_orders(edges: DataFrame, graph: str = "graph") -> DataFrame:
    """graph, pos, name, cycle of each graph in edges (graph, name, dep or null); on a cycle one row with its path."""

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        deps: dict[str, list[str]] = {n: [] for n in {*rows["name"], *rows["dep"].dropna()}}
        for n, d in zip(rows["name"], rows["dep"], strict=True):
            if d is not None and not pd.isna(d):
                deps[n].append(d)
        try:
            order = smallest_order(deps)
            return pd.DataFrame({graph: [key[0]] * len(order), "pos": range(len(order)), "name": order, "cycle": [None] * len(order)})
        except CycleError as e:
            return pd.DataFrame({graph: [key[0]], "pos": [-1], "name": [None], "cycle": [" -> ".join(e.path)]})

    kind = edges.schema[graph].dataType.simpleString()
    return edges.select(graph, "name", "dep").groupBy(graph).applyInPandas(solve, f"{graph} {kind}, pos long, name string, cycle string")


def adjacency(edges: DataFrame) -> DataFrame:
    """name, deps and dependents, each list sorted."""
    out = edges.groupBy("name").agg(F.sort_array(F.collect_set("dep")).alias("deps"))
    back = edges.where("dep is not null").groupBy(F.col("dep").alias("name")).agg(F.sort_array(F.collect_set("name")).alias("dependents"))
    empty = F.array().cast("array<string>")
    return out.join(back, "name", "full").select("name", F.coalesce("deps", empty).alias("deps"), F.coalesce("dependents", empty).alias("dependents"))


def dependents_closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """name of all that depend on the start names, directly or not: a frontier that only grows by what is new, until it is empty."""
    seen = start.select("name").distinct()
    front, rounds = seen, 0
    while True:
        new = edges.join(front.select(F.col("name").alias("dep")), "dep").select("name").distinct().join(seen, "name", "left_anti")
        new = kept(new)
        if new.isEmpty():
            break
        seen, front, rounds = seen.unionByName(new), new, rounds + 1
        if rounds % 50 == 0:
            seen = kept(seen)  # a deep chain's plan stays small
    return seen.join(start.select("name").distinct(), "name", "left_anti")


def names(actions: DataFrame) -> DataFrame:
    """The names of actions, sorted by their bytes."""
    return actions.select("name").orderBy("name")


def best_predecessor(candidates: DataFrame, node: str = "name") -> DataFrame:
    """Of candidates (name, dep, finish, depth) the one each node waits for: latest, deepest, smallest name.

    An aggregate, so a node with very many candidates is settled before the shuffle.
    """
    best = F.min_by(F.struct("dep", "finish", "depth"), F.struct(-F.col("finish"), -F.col("depth"), F.col("dep"))).alias("best")
    return candidates.groupBy(node).agg(best).select(node, "best.*")


def listing(order: DataFrame, edges: DataFrame) -> DataFrame:
    """order (pos, name and any more) with the line of each node: its place, name and what it comes after."""
    after = edges.where("dep is not null").groupBy("name").agg(F.concat_ws(", ", F.sort_array(F.collect_set("dep"))).alias("__after"))
    line = F.concat(F.format_string("%3d. ", F.col("pos") + 1), F.col("name"), F.when(F.col("__after").isNotNull(), F.concat(F.lit("  (after "), F.col("__after"), F.lit(")"))).otherwise(""))
    return order.join(after, "name", "left").withColumn("line", line).drop("__after")
