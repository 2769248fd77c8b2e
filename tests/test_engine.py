import itertools
import json
import os
import random
import statistics
import threading
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kilnworks.functions import columns as C
from kilnworks.operators import fingerprint, graph, metadata
from kilnworks.plans.engine import Engine, Node, critical_path
from kilnworks.sources import manifest
from kilnworks.sources.store import Store, Tiered, shard


def act(**k):
    return {"name": "a", "outputs": ["o"], "command": ["c"], **k}


@pytest.mark.parametrize(
    "actions,rule",
    [
        ([], "no actions"),
        ([act(), act()], "duplicate name"),
        ([act(command=[])], "no command"),
        ([act(outputs=[])], "no outputs"),
        ([act(deps=["x"])], "unknown dependency"),
        ([act(deps=["a"])], "depends on itself"),
        ([act(inputs=["/etc/x"])], "inputs: absolute"),
        ([act(inputs=["../x"])], "inputs: escapes"),
        ([act(outputs=["a//b"])], "outputs: not canonical"),
        ([act(outputs=["a/../b"])], "outputs: not canonical"),
        ([act(inputs=[""])], "inputs: empty"),
        ([act(env={" ": "x"})], "blank variable"),
        ([act(name="")], "no name"),
    ],
)
def test_rejects(spark, actions, rule):
    with pytest.raises(manifest.SpecError) as e:
        manifest.load(spark, json.dumps({"actions": actions}))
    assert [r for _, r, _ in e.value.problems] == [rule]


def test_all_problems_at_once_and_strict_fields(spark):
    with pytest.raises(manifest.SpecError) as e:
        manifest.load(spark, json.dumps({"actions": [act(command=[], outputs=[]), act(name="b", inputs=["/x"], deps=["zz"])]}))
    assert len(e.value.problems) == 4
    with pytest.raises(ValueError):
        manifest.parse('{"actions": [{"name": "a", "output": ["o"]}]}')
    assert manifest.load(spark, json.dumps({"actions": [act(inputs=["x/y", "..a"])]}) + " trailing")[0]["name"] == "a"


def random_graph(r, size, chance):
    names = [f"n{r.randint(0, 10**6)}" for _ in range(size)]
    return {n: [m for m in names[:i] if r.random() < chance] for i, n in enumerate(names)}


def test_smallest_order_and_cycles():
    r = random.Random(2)
    for _ in range(40):
        deps = random_graph(r, 6, 0.3)
        valid = (p for p in itertools.permutations(sorted(deps)) if all(p.index(d) < p.index(n) for n in deps for d in deps[n]))
        order = graph.smallest_order(deps)
        assert order == list(min(valid))
        if not (later := [(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if b in _above(deps, a)]):
            continue
        a, b = r.choice(later)  # b needs a; now a needs b as well
        with pytest.raises(graph.CycleError) as e:
            graph.smallest_order({**deps, a: [*deps[a], b]})
        path = e.value.path
        assert path[0] == path[-1] and a in path and b in path and len(set(path)) == len(path) - 1
        assert all(y in [*deps[x], *([b] if x == a else [])] for x, y in itertools.pairwise(path))


def _above(deps, name):
    """All that need name."""
    found = {n for n in deps if name in deps[n]}
    while more := {n for n in deps if found & set(deps[n])} - found:
        found |= more
    return found


def test_critical_paths(spark):
    r = random.Random(9)
    rows, want = [], {}
    for g in range(30):
        deps = random_graph(r, 7, 0.35)
        took = {n: r.randint(0, 4) for n in deps if r.random() < 0.9}

        def chains(n):
            return [[n]] if not deps[n] else [[*c, n] for d in deps[n] for c in chains(d)]

        best = max(sum(took.get(x, 0) for x in c) for n in deps for c in chains(n))
        path, total = graph.critical_path(deps, took)
        assert total == best == sum(took.get(x, 0) for x in path)
        assert all(a in deps[b] for a, b in itertools.pairwise(path)) and not deps[path[0]]
        # ties: the deepest of the chains that end last, then the smaller names from the end on
        finish = lambda n: max(sum(took.get(x, 0) for x in c) for c in chains(n))
        deep = lambda n: 1 + max((deep(d) for d in deps[n] if (finish(d), deep(d)) == max((finish(x), deep(x)) for x in deps[n])), default=0)
        at, back = min(deps, key=lambda n: (-finish(n), -deep(n), n)), []
        while at:
            back.append(at)
            at = min(deps[at], key=lambda n: (-finish(n), -deep(n), n), default=None)
        assert path == back[::-1]
        rows += [(g, n, d, took.get(n, 0)) for n in deps for d in deps[n] or [None]]
        want[g] = (path, total)
    assert graph.critical_path({"x": ["y"], "y": ["x"]}, {"x": 7}) == ([], 0)
    got = graph.critical_paths(spark.createDataFrame(rows, "graph long, name string, dep string, duration long"))
    assert {r.graph: (r.path, r.total) for r in got.collect()} == want


def test_graph_frames(spark):
    e = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", None)], "name string, dep string")
    assert [r.name for r in graph.dependents_closure(e, spark.createDataFrame([("a",)], "name string")).orderBy("name").collect()] == ["b", "c"]
    order = graph.topological_orders(e.withColumn("graph", F.lit(1))).orderBy("pos")
    assert [r.line for r in graph.listing(order, e).orderBy("pos").collect()] == ["  1. a", "  2. b  (after a)", "  3. c  (after b)", "  4. d"]
    assert {r.name: (r.deps, r.dependents) for r in graph.adjacency(e).collect()}["b"] == (["a"], ["c"])


def test_closure_has_no_bound(spark, monkeypatch):
    # a chain of over 1000 takes too long here: any bound on the rounds is made 2 instead
    monkeypatch.setattr(graph, "range", lambda most: range(2), raising=False)
    e = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(5)], "name string, dep string")
    got = graph.dependents_closure(e, spark.createDataFrame([("n0",)], "name string"))
    assert sorted(r.name for r in got.collect()) == [f"n{i}" for i in range(1, 6)]


def test_keys_miss_and_hit():
    base = dict(command=["cp", "x"], env={"M": "1"}, engine="t", inputs={"i": "d"}, outputs=["o"])
    key = fingerprint.node_key(**base)
    for change in ({"command": ["cp", "y"]}, {"command": ["cpx", ""]}, {"env": {"M": "2"}}, {"env": {"M": "1", "N": ""}}, {"engine": "u"}, {"inputs": {"i": "e"}}, {"inputs": {"i": "d", "j": "d"}}, {"outputs": ["o", "p"]}):
        assert fingerprint.node_key(**{**base, **change}) != key
    two = {**base, "inputs": {"a": "1", "b": "2"}, "outputs": ["p", "q"]}
    assert fingerprint.node_key(**two) == fingerprint.node_key(**{**two, "inputs": {"b": "2", "a": "1"}, "outputs": ["q", "p"]})


def test_table_digest(spark):
    df = spark.createDataFrame([(1, 0.0, b"x", {"a": 1, "b": 2}), (2, float("nan"), None, None), (2, 1.5, b"", {})], "a int, b double, c binary, m map<string,int>")
    d = fingerprint.table_digest(df)
    assert d == fingerprint.table_digest(df.repartition(5).select("m", "c", "b", "a"))
    assert d == fingerprint.table_digest(df.withColumn("b", -F.col("b")).withColumn("b", -F.col("b")))
    others = [df.unionByName(df.limit(1)), df.where("a = 2"), df.withColumn("a", F.col("a").cast("long")), df.withColumnRenamed("a", "z"), df.where("false")]
    assert len({d, *map(fingerprint.table_digest, others)}) == 6


def test_sizes_and_shards(spark):
    t = spark.createDataFrame([("10 KB",), ("2m",), ("7",), ("-1",), ("x",), ("3gb",)], "s string")
    assert [r[0] for r in t.select(C.parse_size(F.col("s"))).collect()] == [10240, 2 << 20, 7, None, None, 3 << 30]
    assert C.parse_size_text("40 kb") == 40960 and pytest.raises(ValueError, C.parse_size_text, "-3")
    assert [r[0] for r in spark.createDataFrame([(0,), (1023,), (1536,), (5 << 20,)], "n long").select(C.human_size(F.col("n"))).collect()] == ["0 B", "1023 B", "1.50 KB", "5.00 MB"]
    for bad in ("", "0", "12", "xyz", "12/34", "./123", "ABCDEF", "0x12", "123\n", "12 34"):
        with pytest.raises(ValueError):
            shard(bad)
    assert shard("0123f") == "01/23f"
    assert C.parse_size_text("") == 0 and spark.createDataFrame([("",)], "s string").select(C.parse_size(F.col("s"))).first()[0] == 0


def test_eviction_is_the_sequential_loop(spark):
    r = random.Random(11)
    for _ in range(6):
        sizes = {f"d{i}": r.randint(0, 50) for i in range(8)}
        entries = {f"k{i}": (r.randint(0, 5), [f"d{r.randint(0, 9)}" for _ in range(r.randint(1, 3))]) for i in range(7)}
        budget = r.randint(1, 150)
        refs = [d for _, ds in entries.values() for d in ds]
        left = {d: s for d, s in sizes.items() if d in refs}
        want = set()
        for k, (_, ds) in sorted(entries.items(), key=lambda x: (x[1][0], x[0])):
            if sum(left.values()) <= budget:
                break
            want.add(k)
            for d in ds:
                refs.remove(d)
                if d not in refs:
                    left.pop(d, None)
        ac = spark.createDataFrame([(k, t, str(i), d) for k, (t, ds) in entries.items() for i, d in enumerate(ds)], "key string, mtime_ns long, path string, digest string")
        cas = spark.createDataFrame([(d, s, 0) for d, s in sizes.items()], "digest string, size long, mtime_ns long")
        assert {x.key for x in metadata.eviction_plan(ac, cas, budget).where("evict").collect()} == want
    assert metadata.eviction_plan(ac, cas, 0).where("evict").count() == 0


def test_hinges(spark):
    rows = [("a", i, float(v)) for i, v in enumerate([99, 1, 2, 3, 4, 5, 6, 7])] + [("b", 0, 5.0), ("b", 1, 8.0)]
    got = {r.config: (r.n, r.lower, r.median, r.upper) for r in metadata.hinges(spark.createDataFrame(rows, "c string, o int, v double"), "c", "o", "v").collect()}
    assert got == {"a": (7, 2.0, 4.0, 6.0), "b": (1, 8.0, 8.0, 8.0)}


def test_hinges_of_many(spark):
    r = random.Random(5)
    rows = [(c, i, r.choice([r.random(), 0.5, float(r.randint(0, 3))])) for c, n in (("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5), ("f", 4001), ("g", 700)) for i in range(n)]
    got = {x.config: (x.n, x.lower, x.median, x.upper) for x in metadata.hinges(spark.createDataFrame(rows, "c string, o int, v double").repartition(5), "c", "o", "v", drop_first=False).collect()}
    for c in "abcdefg":
        v = sorted(x for k, _, x in rows if k == c)
        half = max(1, len(v) // 2)
        assert got[c] == (len(v), statistics.median(v[:half]), statistics.median(v), statistics.median(v[-half:]))


def pipeline_nodes(clean="SELECT min(id) AS id, t FROM docs GROUP BY t"):
    return [
        Node("clean", clean, ["docs"], ["cleaned"]),
        Node("label", "SELECT c.id, t, l.v FROM cleaned c JOIN labels l ON c.id = l.id", ["cleaned", "labels"], ["labelled"], ["clean"]),
        Node("report", "SELECT v, count(*) AS n FROM labelled GROUP BY v", ["labelled"], ["report"], ["label"]),
    ]


@pytest.fixture
def sources(spark, tmp_path):
    spark.createDataFrame([(i, f"t{i % 5}") for i in range(20)], "id long, t string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(i, i % 2) for i in range(20)], "id long, v int").write.parquet(f"{tmp_path}/labels")
    return {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("docs", "labels")}


def test_incremental_builds(spark, tmp_path, sources):
    store = Store(str(tmp_path / "store"))
    run = lambda nodes, src=sources, w=1: (lambda t, r: (sorted(map(tuple, t["report"].collect())), {x.action: x.cached for x in r}))(*Engine(spark, store).build(nodes, src, w))
    plain, _ = Engine(spark).build(pipeline_nodes(), sources)
    first, cached = run(pipeline_nodes())
    assert first == sorted(map(tuple, plain["report"].collect())) and not any(cached.values())
    assert run(pipeline_nodes(), w=4) == (first, dict.fromkeys(("clean", "label", "report"), True))
    sources["docs"].repartition(7).write.parquet(f"{tmp_path}/moved")
    assert all(run(pipeline_nodes(), {**sources, "docs": spark.read.parquet(f"{tmp_path}/moved")})[1].values())
    # other text, equal rows: the cut comes early
    assert run(pipeline_nodes("SELECT t, min(id) AS id FROM docs GROUP BY t ORDER BY t"))[1] == {"clean": False, "label": True, "report": True}
    # a damaged blob is made again and heals
    digest = next(iter(store.peek(next(r.key for r in store.entries(spark).where("path = 'report'").collect())).values()))
    for f in os.listdir(store.blob(digest)):
        os.remove(os.path.join(store.blob(digest), f))
    assert run(pipeline_nodes())[1] == {"clean": True, "label": True, "report": False}
    assert all(run(pipeline_nodes())[1].values())
    out = store.collect(spark, budget=1)
    assert out["evicted"] > 0 and out["bytes_after"] <= 1 and store.blobs(spark).count() == 0


def test_put_computes_a_table_once(spark, tmp_path):
    store, seen = Store(str(tmp_path / "store")), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.range(10).mapInPandas(counted, "id long")
    for times in (1, 2):  # a new table, then one that is there
        found, changed = store.put("abc", {"x": df})
        assert seen.value == 10 * times and changed == []
    assert store.intact(spark, found["x"]) and sorted(os.listdir(store.root)) == ["ac", "cas"]
    empty, changed = store.put("abc", {"x": spark.range(0)})
    assert changed == ["x"] and store.restore(spark, empty)["x"]().columns == ["id"]


def test_equal_tables_meet_in_the_store(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    d = store.put_blob(spark.range(5))
    before = sorted(os.listdir(store.blob(d)))
    late = str(tmp_path / "store" / ".tmp-late")
    spark.range(5).write.parquet(late)
    store._publish(late, d)  # another builder was first
    assert sorted(os.listdir(store.blob(d))) == before and not os.path.exists(late)
    for name, age in (("old", 2 * 86400), ("young", 60)):
        os.makedirs(path := os.path.join(store.root, f".tmp-{name}"))
        os.utime(path, (time.time() - age,) * 2)
    store.collect(spark)
    assert [n for n in os.listdir(store.root) if n.startswith(".tmp-")] == [".tmp-young"]


def test_failures_and_isolation(spark, sources):
    nodes = [*pipeline_nodes("SELECT broken FROM docs"), Node("other", "SELECT count(*) AS n FROM docs", ["docs"], ["n"])]
    _, results = Engine(spark).build(nodes, sources, keep_going=True)
    assert {r.action: r.status for r in results} == {"clean": "failed", "label": "skipped", "report": "skipped", "other": "ok"}
    for body in ("SELECT * FROM labels", "SELECT id, rand() AS x FROM docs", "SELECT id, current_timestamp() AS x FROM docs"):
        _, results = Engine(spark).build([Node("n", body, ["docs"], ["o"])], sources)
        assert results[0].status == "failed"
    log = Engine(spark).run_log(results)
    assert metadata.run_summary(log).first().failed == 1
    with pytest.raises(graph.CycleError):
        Engine(spark).build([Node("a", "", [], ["x"], ["b"]), Node("b", "", [], ["y"], ["a"])], {})
    assert critical_path(nodes, [])[1] == 0


def scaled(by, shift=0):
    def body(session, inputs, env):
        return {"o": inputs["docs"].selectExpr(f"id * {by} + {shift} AS id")}

    return body


FACTOR = 1


def by_global(session, inputs, env):
    return {"o": inputs["docs"].selectExpr(f"id * {FACTOR} AS id")}


def test_keys_hold_what_callables_rest_on(spark, tmp_path, sources, monkeypatch):
    of = lambda f: fingerprint.engine_digest(spark, f)
    assert of(scaled(1)) == of(scaled(1))
    assert len({of(scaled(1)), of(scaled(2)), of(scaled(1, shift=3)), of(scaled([1])), of(scaled("1")), of("sql")}) == 6
    before = of(by_global)
    monkeypatch.setitem(globals(), "FACTOR", 2)
    assert of(by_global) != before
    with pytest.raises(TypeError):
        of(scaled(object()))
    default = lambda s, i, e, k=1: k
    first = of(default)
    default.__defaults__ = (2,)
    assert of(default) != first
    store = Store(str(tmp_path / "store"))
    rows = lambda k: sorted(r.id for r in Engine(spark, store).build([Node("n", scaled(k), ["docs"], ["o"])], sources)[0]["o"].collect())
    assert rows(1) == list(range(20)) and rows(2) == list(range(0, 40, 2))
    before = of("sql")
    spark.conf.set("spark.sql.legacy.sizeOfNull", "true")
    try:
        assert of("sql") != before
    finally:
        spark.conf.unset("spark.sql.legacy.sizeOfNull")


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "interval day to second"])
def test_digests_tell_microseconds(spark, kind):
    text = "INTERVAL '0 00:00:01.000{}' DAY TO SECOND" if kind.startswith("interval") else "CAST('2024-05-06 07:08:09.000{}' AS " + kind + ")"
    d = [fingerprint.table_digest(spark.sql(f"SELECT {text.format(x)} AS t, array({text.format(x)}) AS a")) for x in ("001", "002", "001")]
    assert d[0] == d[2] != d[1]


def test_digests_count_rows(spark):
    d = lambda *ids: fingerprint.table_digest(spark.createDataFrame([(i,) for i in ids], "id long"))
    assert d(1, 2, 2) == d(2, 1, 2) and len({d(1, 2), d(1, 2, 2), d(1, 1, 2), d(1, 1, 2, 2), d(1), d()}) == 6


@pytest.mark.parametrize("body", ["SELECT first(id) AS x FROM docs", "SELECT current_user() AS x FROM docs", "SELECT t, collect_list(id) AS x FROM docs GROUP BY t", "SELECT now() AS x FROM docs", "SELECT uuid() AS x FROM docs"])
def test_unsteady_nodes_fail(spark, sources, body):
    assert Engine(spark).build([Node("n", body, ["docs"], ["o"])], sources)[1][0].status == "failed"


def test_steady_lists_and_trust(spark, sources):
    for node in (Node("n", "SELECT t, sort_array(collect_list(id)) AS x FROM docs GROUP BY t", ["docs"], ["o"]), Node("n", "SELECT first(t) AS x FROM docs WHERE id = 3", ["docs"], ["o"], stable=True)):
        assert Engine(spark).build([node], sources)[1][0].status == "ok"


def test_cancelled_siblings_stop(spark, sources):
    slow = "SELECT sum(a.id * b.id % 7) AS x FROM range(4000000) a CROSS JOIN range(1000000) b WHERE a.id + b.id >= (SELECT min(id) FROM docs)"
    nodes = [Node("slow", slow, ["docs"], ["s"]), Node("bad", "SELECT CAST(t AS INT) AS x FROM docs", ["docs"], ["b"]), Node("after", "SELECT * FROM s", ["s"], ["a"], ["slow"])]
    spark.conf.set("spark.sql.ansi.enabled", "true")
    timer = threading.Timer(60, spark.sparkContext.cancelAllJobs)  # were it not cancelled
    timer.start()
    _, results = Engine(spark).build(nodes, sources, workers=2)
    timer.cancel()
    by = {r.action: r for r in results}
    assert {n: r.status for n, r in by.items()} == {"slow": "cancelled", "bad": "failed", "after": "skipped"}
    assert by["slow"].end_ns - by["bad"].end_ns < 2 * 10**9


def test_nodes_run_side_by_side_but_not_more(spark, sources):
    here, most, lock, both = [0], [0], threading.Lock(), threading.Barrier(2, timeout=30)
    engine = Engine(spark)
    real = engine.execute

    def counted(node, tables):
        with lock:
            here[0] += 1
            most[0] = max(most[0], here[0])
        both.wait()  # passes only if two run at once
        made = real(node, tables)
        with lock:
            here[0] -= 1
        return made

    engine.execute = counted
    nodes = [Node(f"n{i}", "SELECT count(*) AS n FROM docs", ["docs"], [f"o{i}"]) for i in range(6)]
    assert all(r.status == "ok" for r in engine.build(nodes, sources, workers=2)[1]) and most[0] == 2


@pytest.mark.parametrize("workers", [1, 2, 4, 8])
def test_workers_agree(spark, tmp_path, sources, workers):
    tables, results = Engine(spark, Store(str(tmp_path / "store"))).build(pipeline_nodes(), sources, workers)
    assert not any(r.cached for r in results)
    assert sorted(map(tuple, tables["report"].collect())) == [(0, 3), (1, 2)]


def test_verify_tells_changed_rows(spark, tmp_path, sources):
    store = Store(str(tmp_path / "store"))
    node = Node("n", "SELECT id, rand() AS x FROM docs", ["docs"], ["o"], stable=True)  # falsely vouched for
    engine = Engine(spark, store)
    assert engine.build([node], sources)[1][0].nondeterministic == []
    assert engine.build([node], sources)[1][0].cached
    log = engine.build([node], sources, verify=True)[1]
    assert [(r.cached, r.nondeterministic) for r in log] == [(False, ["o"])]
    assert metadata.run_summary(engine.run_log(log)).first().nondeterministic == ["o"]


def test_sources_are_digested_again_when_files_change(spark, tmp_path):
    store, path = Store(str(tmp_path / "store")), f"{tmp_path}/t"
    old = time.time() - 1000
    age = lambda at: [os.utime(os.path.join(path, f), (at, at)) for f in os.listdir(path)]
    spark.range(5).write.parquet(path)
    assert store.source_digest(spark.read.parquet(path)) == fingerprint.table_digest(spark.range(5)) and not os.path.exists(f"{store.root}/src")  # too young
    age(old)
    first = store.source_digest(spark.read.parquet(path))
    kept = os.listdir(f"{store.root}/src")
    assert store.source_digest(spark.read.parquet(path)) == first and os.listdir(f"{store.root}/src") == kept
    spark.range(6).write.mode("overwrite").parquet(path)
    age(old)
    assert store.source_digest(spark.read.parquet(path)) == fingerprint.table_digest(spark.range(6)) != first
    assert store.source_digest(spark.read.parquet(path).where("id < 5")) == first  # no plain table: digested
    age(old + 1)  # other times, equal rows
    assert store.source_digest(spark.read.parquet(path)) == fingerprint.table_digest(spark.range(6))


def test_strict_restores_and_stamps(spark, tmp_path):
    store = Store(str(tmp_path / "store"), strict=True)
    found, _ = store.put("abc", {"o": spark.range(3)})
    path = store.blob(found["o"])
    spark.range(4, 7).write.parquet(f"{tmp_path}/other")
    other = next(f for f in os.listdir(f"{tmp_path}/other") if f.startswith("part-"))
    part = next(f for f in os.listdir(path) if f.startswith("part-"))
    assert store.restore(spark, found) is not None
    with open(f"{tmp_path}/other/{other}", "rb") as f, open(f"{path}/{part}", "wb") as g:
        g.write(f.read())  # rows of the same size
    for f in os.listdir(path):
        if f.endswith(".crc"):
            os.remove(f"{path}/{f}")
    assert store.restore(spark, found) is None
    entry = store.entry("abc")
    os.utime(entry, (1000, 1000))
    store.lookup("abc")
    fresh = os.stat(entry).st_mtime
    assert fresh > time.time() - 60
    os.utime(entry, (fresh - 600, fresh - 600))  # used lately: not stamped again
    store.lookup("abc")
    assert abs(os.stat(entry).st_mtime - (fresh - 600)) < 2


def test_collections(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    for i in range(3):
        store.put(f"abc{i}", {"o": spark.range(10 * i, 10 * i + 5)})
        store.files.touch(store.entry(f"abc{i}"), (1000 + i) * 10**9)
    store.put_blob(spark.range(99))  # nobody refers to it
    total = store.blobs(spark).agg(F.sum("size")).first()[0]
    young = store.collect(spark, 0, min_age_ns=3600 * 10**9)
    assert (young["blobs_dropped"], store.blobs(spark).count()) == (0, 4) and young["too_young"] >= 1
    told = store.collect(spark, total // 4, dry_run=True)
    assert store.blobs(spark).count() == 4 and told["evicted"] >= 1
    store.files.create(f"{store.root}/.gc-lock", "")
    with pytest.raises(OSError):
        store.collect(spark)
    os.utime(f"{store.root}/.gc-lock", (1000, 1000))  # left by one that died
    done = store.collect(spark, total // 4)
    assert done == told and done["bytes_after"] == store.blobs(spark).agg(F.sum("size")).first()[0] <= total // 4
    assert not os.path.exists(f"{store.root}/.gc-lock")


def test_damage_on_receipt(spark, tmp_path):
    shared = Store(str(tmp_path / "shared"))
    found, _ = shared.put("abc", {"o": spark.range(3)})
    spark.range(9).write.mode("append").parquet(shared.blob(found["o"]))
    here = Tiered(str(tmp_path / "here"), remote=shared)
    assert here.lookup("abc") is None and not here.has(found["o"]) and here.stats["errors"] == 1
    shared.put_entry("abd", found)
    os.replace(shared.entry("abd"), shared.entry("abc"))  # an entry under another key
    assert shared.lookup("abc") is None


def test_command_line(spark, tmp_path, sources, capsys, monkeypatch):
    from kilnworks import cli

    monkeypatch.chdir(tmp_path)
    spec = {"actions": [{"name": n.name, "deps": n.deps, "inputs": n.inputs, "outputs": n.outputs, "command": [n.body]} for n in pipeline_nodes()]}
    (tmp_path / "p.json").write_text(json.dumps(spec))
    run = lambda *a: (cli.main([str(x) for x in a]), capsys.readouterr())
    src = [x for t in ("docs", "labels") for x in ("--source", f"{t}=file://{tmp_path}/{t}")]
    assert run("validate", f"file://{tmp_path}/p.json")[0] == 0
    code, out = run("graph", f"file://{tmp_path}/p.json")
    assert code == 0 and out.out.splitlines() == ["  1. clean", "  2. label  (after clean)", "  3. report  (after label)"]
    build = ["build", f"file://{tmp_path}/p.json", "--store", f"file://{tmp_path}/s", *src]
    for more, last in ((["--sequential"], "3 ok (0 cached), 0 not"), (["--shared", f"file://{tmp_path}/t"], "3 ok (3 cached), 0 not"), (["--no-cache"], "3 ok (0 cached), 0 not"), (["--verify", "--strict"], "3 ok (0 cached), 0 not")):
        code, out = run(*build, *more)
        assert code == 0 and last in out.out and "critical path: clean -> label -> report" in out.out
    assert run("gc", "--store", f"file://{tmp_path}/s", "--max", "1", "--dry-run")[0] == 0
    (tmp_path / "bad.json").write_text('{"actions": []}')
    code, out = run("validate", f"file://{tmp_path}/bad.json")
    assert code == 1 and "bad.json" in out.err and "no actions" in out.err


def test_shared_store(spark, tmp_path, sources):
    shared = Store(str(tmp_path / "shared"))
    a, b = (Tiered(str(tmp_path / x), remote=shared) for x in "ab")
    assert not any(r.cached for r in Engine(spark, a).build(pipeline_nodes(), sources)[1])
    assert all(r.cached for r in Engine(spark, b).build(pipeline_nodes(), sources)[1])
    assert (a.stats["uploads"], b.stats["remote_hits"]) == (3, 3)
    c = Tiered(str(tmp_path / "c"), remote=shared)
    os.rename(shared.root, shared.root + "-gone")
    open(shared.root, "w").close()
    assert all(r.status == "ok" for r in Engine(spark, c).build(pipeline_nodes(), sources)[1]) and c.stats["misses"] == 3 and c.stats["errors"] >= 3


def test_queries_run(spark):
    from kilnworks.plans import catalogue

    sf = "/root/testdata/sf0.001"
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    for name, f in catalogue.queries().items():
        assert f(spark, sf).columns, name


def test_queries_match_their_sql(spark):
    import duckdb

    from kilnworks.plans import catalogue

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    for name, sql in catalogue.oracle_sql().items():
        df = catalogue.queries()[name](spark, sf)
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns), name
        assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, cur.fetchall())), name
