"""python -m kilnworks.cli validate|graph|build|gc: a specification's nodes are SQL, its sources Parquet paths."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from kilnworks.functions.columns import parse_size_text
from kilnworks.operators import graph
from kilnworks.plans.engine import Engine, Node, critical_path
from kilnworks.sources import manifest
from kilnworks.sources.store import Store, Tiered


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kilnworks")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("validate", "graph", "build"):
        v = verbs.add_parser(verb)
        v.add_argument("file")
        if verb == "build":
            v.add_argument("--store", default=".kilnworks")
            v.add_argument("--workers", type=int, default=os.cpu_count() or 1)
            v.add_argument("--sequential", action="store_true", help="one node at a time, in the smallest order")
            v.add_argument("--keep-going", action="store_true")
            v.add_argument("--no-cache", action="store_true", help="run all nodes, keep nothing")
            v.add_argument("--verify", action="store_true", help="run all nodes and tell outputs that are not what they were")
            v.add_argument("--strict", action="store_true", help="digest the rows of all that is read or restored")
            v.add_argument("--shared", metavar="STORE", help="a second store, on shared storage")
            v.add_argument("--source", action="append", default=[], metavar="NAME=PATH")
    v = verbs.add_parser("gc")
    v.add_argument("--store", default=".kilnworks")
    v.add_argument("--max", default=0, type=parse_size_text)
    v.add_argument("--min-age", default=0.0, type=float, help="seconds")
    v.add_argument("--dry-run", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("kilnworks").getOrCreate()
    if a.verb == "gc":
        print(Store(a.store).collect(spark, a.max, int(a.min_age * 1e9), a.dry_run))
        return 0
    try:
        specs = manifest.load_file(spark, a.file)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    deps = manifest.edges_of(specs)
    if a.verb == "validate":
        print(f"{len(specs)} actions, valid")
        return 0
    try:
        order = graph.smallest_order(deps)
    except graph.CycleError as e:
        print(e, file=sys.stderr)
        return 1
    if a.verb == "graph":
        for i, n in enumerate(order):
            print(f"{i + 1:3d}. {n}" + (f"  (after {', '.join(sorted(deps[n]))})" if deps[n] else ""))
        return 0
    nodes = [Node(s["name"], " ".join(s["command"]), s["inputs"], s["outputs"], s["deps"], s["env"]) for s in specs]
    sources = {k: spark.read.parquet(v) for k, v in (x.split("=", 1) for x in a.source)}
    store = None if a.no_cache else Tiered(a.store, a.strict, remote=Store(a.shared)) if a.shared else Store(a.store, a.strict)
    _, results = Engine(spark, store).build(nodes, sources, 1 if a.sequential else a.workers, a.keep_going, a.verify)
    for r in results:
        print(f"{r.status}{' (cached)' if r.cached else ''} {r.action} {(r.end_ns - r.start_ns) / 1e6:.0f} ms {r.error}".rstrip())
        if r.nondeterministic:
            print(f"  other rows than before: {', '.join(r.nondeterministic)}")
    done = sum(r.status == "ok" for r in results)
    print(f"{done} ok ({sum(r.cached for r in results)} cached), {len(results) - done} not")
    path, total = critical_path(nodes, results)
    print(f"critical path: {' -> '.join(path)} ({total / 1e6:.0f} ms)")
    return int(any(r.status != "ok" for r in results))


if __name__ == "__main__":
    sys.exit(main())
