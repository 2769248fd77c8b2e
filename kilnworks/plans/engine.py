"""Running a pipeline of query nodes: each only if nothing of its key has been materialised before.

A node is SQL text, or a callable (session, inputs, params) -> {output: DataFrame}. It sees its declared inputs alone, as temp
views of a session of its own. Its key has the digests of the input tables, so a node whose predecessors gave equal rows is
not run again, whatever ran before it.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from kilnworks.operators import graph
from kilnworks.operators.fingerprint import engine_digest, node_key, table_digest
from kilnworks.sources.store import Store

#: Functions whose value changes from run to run, or with who runs them, though the plan counts as deterministic.
CHANGING = re.compile(r"\b(current_(timestamp|date|time|user|catalog|database|schema|timezone|path)|localtimestamp|localtime|now|session_user|user|unix_timestamp\(\)|input_file_\w+)\(|\bunix_timestamp\(\)", re.I)
#: Aggregates whose value depends on the order of rows; lists are fine once they are sorted.
UNORDERED = re.compile(r"(?<!sort_array\()(?<!array_sort\()\b(first|last|first_value|last_value|any_value|collect_list|collect_set|array_agg|listagg|string_agg)\(", re.I)


@dataclass
class Node:
    name: str
    body: str | Callable
    inputs: list[str]
    outputs: list[str]
    deps: list[str] = field(default_factory=list)
    env: dict[str, str] = field(default_factory=dict)
    #: The author vouches that equal inputs give equal rows, whatever the plan looks like.
    stable: bool = False


class Tables(dict):
    """Tables by name; one that is restored is read when it is asked for."""

    def __getitem__(self, name: str) -> DataFrame:
        found = super().__getitem__(name)
        if not isinstance(found, DataFrame):
            found = self[name] = found()
        return found


@dataclass
class Result:
    action: str
    status: str  # ok, failed, skipped or cancelled
    cached: bool = False
    start_ns: int = 0
    end_ns: int = 0
    nondeterministic: list[str] = field(default_factory=list)
    error: str = ""


RUN_LOG = "action string, status string, cached boolean, start_ns long, end_ns long, nondeterministic array<string>, error string"


class Engine:
    def __init__(self, spark: SparkSession, store: Store | None = None):
        self.spark, self.store = spark, store

    def run_node(self, node: Node, tables: dict, digests: dict[str, str], verify: bool = False) -> tuple[dict, dict[str, str], bool, list[str]]:
        """Check inputs, look up, restore, else run, check outputs, put. Each failure to restore falls through to running.

        To verify is to run whatever is there; outputs with another digest than before are told.
        """
        if missing := sorted(set(node.inputs) - set(tables)):
            raise ValueError(f"{node.name}: missing inputs {missing}")
        key = node_key([node.body if isinstance(node.body, str) else node.body.__qualname__], node.env, engine_digest(self.spark, node.body), {i: digests[i] for i in node.inputs}, node.outputs)
        if self.store and not verify and (found := self.store.lookup(key)) is not None and set(found) == set(node.outputs) and (made := self.store.restore(self.spark, found)) is not None:
            return made, found, True, []
        made = self.execute(node, tables)
        if self.store:
            found, changed = self.store.put(key, made)
            return {n: (lambda d=d: self.store.read(self.spark, d)) for n, d in found.items()}, found, False, changed
        return made, {n: table_digest(d) for n, d in made.items()}, False, []

    def execute(self, node: Node, tables: dict) -> dict[str, DataFrame]:
        """Run the body in a session of its own, which has the declared inputs as views and env as its variables, ${node.NAME}."""
        own = self.spark.newSession()
        own.conf.set("spark.sql.runSQLOnFiles", "false")
        own.conf.set("spark.sql.debug.maxToStringFields", "1000000")
        for k, v in node.env.items():
            own.conf.set(f"node.{k}", v)
        views = {}
        for i in node.inputs:
            views[i] = _in_session(tables[i], own)
            views[i].createOrReplaceTempView(i)
        if isinstance(node.body, str):
            made = {node.outputs[0]: own.sql(node.body)}
        else:
            made = node.body(own, views, node.env)
        if lost := sorted(set(node.outputs) - set(made)):
            raise ValueError(f"{node.name}: outputs not made {lost}")
        made = {n: made[n] for n in node.outputs}  # what is not declared does not leave
        allowed = {f for i in node.inputs for f in tables[i].inputFiles()}
        for n, df in made.items():
            if strange := sorted(set(df.inputFiles()) - allowed):
                raise ValueError(f"{node.name}: {n} reads files that are no declared input: {strange[:3]}")
            if not node.stable and (why := unsteady(df)):
                raise ValueError(f"{node.name}: {n} is not deterministic: {why}")
        return made

    def digest(self, df: DataFrame) -> str:
        return self.store.source_digest(df) if self.store else table_digest(df)

    def build(self, nodes: list[Node], sources: dict[str, DataFrame], workers: int = 1, keep_going: bool = False, verify: bool = False) -> tuple[dict[str, DataFrame], list[Result]]:
        """(all tables, results by start and name). A node starts when its last dependency ends. After a failure its
        dependents are skipped, and unless told to keep going nothing else starts and the jobs of what runs are cancelled."""
        by = {n.name: n for n in nodes}
        order = graph.smallest_order({n.name: n.deps for n in nodes})
        place = {n: i for i, n in enumerate(order)}
        read = sorted(set(sources) & {i for n in nodes for i in n.inputs})
        with ThreadPoolExecutor(max(1, workers)) as pool:
            digests = dict(zip(read, pool.map(self.digest, [sources[k] for k in read]), strict=True))
        tables = Tables(sources)
        results: dict[str, Result] = {}
        stop = threading.Event()
        sc, tag = self.spark.sparkContext, f"build-{uuid.uuid4().hex}"

        def one(node: Node) -> tuple[Result, dict, dict]:
            start = time.time_ns()
            if stop.is_set():
                return Result(node.name, "skipped"), {}, {}
            sc.addJobTag(tag)  # of this thread, so of all jobs that it starts in whichever session
            sc.setInterruptOnCancel(True)
            try:
                made, found, cached, changed = self.run_node(node, tables, digests, verify)
                return Result(node.name, "ok", cached, start, time.time_ns(), changed), made, found
            except Exception as e:  # noqa: BLE001  a node's failure is a result
                return Result(node.name, "cancelled" if stop.is_set() else "failed", False, start, time.time_ns(), [], str(e)[:2000]), {}, {}
            finally:
                sc.removeJobTag(tag)

        with ThreadPoolExecutor(max(1, workers)) as pool:
            running: dict[Future, str] = {}
            left = set(order)
            while left or running:
                for n in sorted(left, key=place.get):
                    states = [results[d].status for d in by[n].deps if d in results]
                    if any(s != "ok" for s in states) or stop.is_set():
                        results[n] = Result(n, "skipped")
                        left.discard(n)
                    elif len(states) == len(by[n].deps) and len(running) < max(1, workers):
                        running[pool.submit(one, by[n])] = n
                        left.discard(n)
                if not running:
                    continue
                for f in wait(running, timeout=0.2 if stop.is_set() else None, return_when=FIRST_COMPLETED).done:
                    n = running.pop(f)
                    results[n], made, found = f.result()
                    tables |= made
                    digests |= found
                    if results[n].status == "failed" and not keep_going:
                        stop.set()
                if stop.is_set() and running:
                    sc.cancelJobsWithTag(tag)  # again and again: a node may be between two jobs
        return tables, sorted(results.values(), key=lambda r: (r.start_ns, r.action))

    def run_log(self, results: list[Result]) -> DataFrame:
        return self.spark.createDataFrame([(r.action, r.status, r.cached, r.start_ns, r.end_ns, r.nondeterministic, r.error) for r in results], RUN_LOG)


def unsteady(df: DataFrame) -> str:
    """What in a plan may give other rows from equal inputs; empty if nothing is known to."""
    plan, jvm = df._jdf.queryExecution().analyzed(), df.sparkSession._jvm
    if not plan.deterministic():
        return "a random or positional expression"
    classic = jvm.org.apache.spark.sql.classic.SparkSession
    classic.setActiveSession(df.sparkSession._jsparkSession)  # whose settings let the plan be written whole
    lines = plan.toString().splitlines()
    for line in lines:
        if found := CHANGING.search(line):
            return found[0].rstrip("(")
        if "Aggregate [" in line and (found := UNORDERED.search(line)):
            return f"{found[1]} of unordered rows"
    return ""


def _in_session(df: DataFrame, session: SparkSession) -> DataFrame:
    """The same plan in another session."""
    return DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.logicalPlan()), session)


def critical_path(nodes: list[Node], results: list[Result]) -> tuple[list[str], int]:
    return graph.critical_path({n.name: n.deps for n in nodes}, {r.action: r.end_ns - r.start_ns for r in results})
