"""Queries that run the engine and its store over the driver's tables, each with the SQL of what they must give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.operators import fingerprint, metadata
from kilnworks.plans.catalogue import _all, query, table
from kilnworks.plans.engine import Engine, Node
from kilnworks.sources import manifest
from kilnworks.sources.files import Files
from kilnworks.sources.shared import scratch
from kilnworks.sources.store import Store, Tiered


def registered() -> dict:
    return _all


def nodes(least: str = "2") -> list[Node]:
    return [
        Node("clean", f"SELECT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE l_quantity > {least}", ["lineitem"], ["sold"]),
        Node("by_order", "SELECT o_orderpriority AS p, sum(q) AS q FROM sold JOIN orders ON l_orderkey = o_orderkey GROUP BY 1", ["sold", "orders"], ["priorities"], ["clean"]),
        Node("by_part", "SELECT p_brand AS p, sum(q) AS q FROM sold JOIN part ON l_partkey = p_partkey GROUP BY 1", ["sold", "part"], ["brands"], ["clean"]),
        Node("report", "SELECT * FROM priorities UNION ALL SELECT * FROM brands", ["priorities", "brands"], ["report"], ["by_order", "by_part"]),
    ]


def sources(s, d) -> dict[str, DataFrame]:
    return {t: table(s, d, t) for t in ("lineitem", "orders", "part")}


_REPORT = """r AS (SELECT o_orderpriority AS p, CAST(sum(q) AS BIGINT) AS q FROM (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE l_quantity > 2) JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
UNION ALL SELECT p_brand, CAST(sum(q) AS BIGINT) FROM (SELECT l_partkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE l_quantity > 2) JOIN part ON l_partkey = p_partkey GROUP BY 1)"""


@query(f"WITH {_REPORT} SELECT w AS workers, p, q FROM r, (SELECT unnest(['1', '2', '4', '8', 'shared']) AS w)")
def engine_report(s, d):
    """The report of a build from nothing with 1, 2, 4 and 8 workers, and of one that finds all in a shared store."""
    out, shared = [], Store(scratch(s))
    for workers in (1, 2, 4, 8):
        store = Tiered(scratch(s), remote=shared) if workers == 8 else None
        tables, results = Engine(s, store).build(nodes(), sources(s, d), workers)
        out.append(tables["report"].withColumn("workers", F.lit(str(workers))))
    tables, results = Engine(s, Tiered(scratch(s), remote=shared)).build(nodes(), sources(s, d), 2)
    if not all(r.cached for r in results):
        raise RuntimeError(f"not all was found: {results}")
    out.append(tables["report"].withColumn("workers", F.lit("shared")))
    every = out[0]
    for df in out[1:]:
        every = every.unionByName(df)
    return every.select("workers", "p", "q")


def log(s, build: str, results) -> DataFrame:
    rows = [(build, r.action, r.status, r.cached) for r in results]
    return s.createDataFrame(rows, "build string, action string, status string, cached boolean")


_BUILDS = {
    "clean": {"clean": "ok", "by_order": "ok", "by_part": "ok", "report": "ok"},
    "no change": dict.fromkeys(("clean", "by_order", "by_part", "report"), "cached"),
    "same rows": {"clean": "ok", "by_order": "cached", "by_part": "cached", "report": "cached"},
    "other rows": {"clean": "ok", "by_order": "ok", "by_part": "ok", "report": "ok"},
    "broken": {"clean": "failed", "by_order": "skipped", "by_part": "skipped", "report": "skipped", "alone": "ok"},
    "missing input": {"lost": "failed"},
    "undeclared output": {"lost": "failed"},
    "unsteady": {"lost": "failed"},
    "evicted": {"clean": "ok", "by_order": "ok", "by_part": "ok", "report": "ok"},
}


@query("SELECT build, action, CASE status WHEN 'cached' THEN 'ok' ELSE status END AS status, status = 'cached' AS cached FROM (VALUES " + ", ".join(f"('{b}', '{a}', '{x}')" for b, of in _BUILDS.items() for a, x in of.items()) + ") t(build, action, status)")
def engine_log(s, d):
    """What builds one after the other on one store run, find and skip."""
    engine = Engine(s, Store(scratch(s)))
    alone = Node("alone", "SELECT count(*) AS n FROM orders", ["orders"], ["alone"])
    lost = lambda body, inputs=("part",): [Node("lost", body, list(inputs), ["o"])]
    plans = {
        "clean": nodes(),
        "no change": nodes(),
        "same rows": nodes("1 + 1"),
        "other rows": nodes("3"),
        "broken": [Node("clean", "SELECT nothing FROM lineitem", ["lineitem"], ["sold"]), *nodes()[1:], alone],
        "missing input": lost("SELECT 1 AS x", ("absent",)),
        "undeclared output": lost(_undeclared),
        "unsteady": lost("SELECT first(p_name) AS x FROM part"),
    }
    out = [log(s, k, engine.build(p, sources(s, d), 2, keep_going=True)[1]) for k, p in plans.items()]
    engine.store.collect(s, budget=1)
    out.append(log(s, "evicted", engine.build(nodes(), sources(s, d), 2)[1]))
    every = out[0]
    for df in out[1:]:
        every = every.unionByName(df)
    return every


def _undeclared(session, inputs, env):
    return {"other": inputs["part"]}


@query("SELECT lang AS path, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT doc_id) > 0 AS hit, true AS again FROM documents GROUP BY lang")
def store_round_trip(s, d):
    """Documents by language put into a store, restored strictly and read; put again, nothing new is written."""
    store, docs = Store(scratch(s), strict=True), table(s, d, "documents")
    rows = []
    for lang in [r.lang for r in docs.select("lang").distinct().collect()]:
        own = docs.where(F.col("lang") == lang)
        key = fingerprint.node_key([lang], {}, "", {}, [lang])
        found, _ = store.put(key, {lang: own})
        before = store.blobs(s).count()
        again = store.put(key, {lang: own.repartition(3)}) == (found, []) and store.blobs(s).count() == before
        hit = store.lookup(key)
        r = store.restore(s, hit)[lang]().agg(F.count("*").alias("n"), F.sum("n_chars").alias("c")).first()
        rows.append((lang, r.n, r.c, hit == found, again))
    return s.createDataFrame(rows, "path string, n long, chars long, hit boolean, again boolean")


@query("SELECT source AS path, n = 1 AS alone, n AS refs FROM (SELECT source, count(*) OVER (PARTITION BY n) AS n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source))")
def store_scan(s, d):
    """Entries and blobs as the store's scan lists them: outputs with equal rows share a blob."""
    store, docs = Store(scratch(s)), table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n")).cache()
    for r in docs.collect():
        store.put(fingerprint.node_key([str(r.source)], {}, "", {}, ["o"]), {str(r.source): docs.where(F.col("source").eqNullSafe(r.source)).select("n")})
    ac = store.entries(s).join(store.blobs(s).select("digest"), "digest")
    return ac.join(metadata.refcounts(store.entries(s)), "digest").select("path", (F.col("refs") == 1).alias("alone"), "refs")


@query("SELECT n_name AS name, sha256(n_name) AS digest FROM nation")
def file_digests(s, d):
    """A file for each nation, digested together."""
    files, place = Files(s), scratch(s)
    files.mkdirs(place)
    names = [r.n_name for r in table(s, d, "nation").select("n_name").collect()]
    of = {f"{place}/{i}": n for i, n in enumerate(names)}
    for path, n in of.items():
        files.create(path, n)
    return s.createDataFrame([(of[p], x) for p, x in fingerprint.file_digests(s, list(of)).items()], "name string, digest string")


@query("SELECT n_name AS name, CASE WHEN n_nationkey = (SELECT min(n_nationkey) FROM nation) THEN '' ELSE (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1) END AS deps, n_name || '.out' AS outputs FROM nation")
def load_spec(s, d):
    """A specification file read back, valid and with all its fields."""
    import json

    files, place = Files(s), scratch(s)
    files.mkdirs(place)
    names = [r.n_name for r in table(s, d, "nation").orderBy("n_nationkey").select("n_name").collect()]
    acts = [{"name": n, "deps": names[:1] if i else [], "outputs": [f"{n}.out"], "command": ["SELECT 1"]} for i, n in enumerate(names)]
    files.create(f"{place}/spec.json", json.dumps({"actions": acts}) + " and more")
    loaded = manifest.actions(s, manifest.load_file(s, f"{place}/spec.json"))
    return loaded.select("name", F.array_join("deps", ",").alias("deps"), F.array_join("outputs", ",").alias("outputs"))


@query("SELECT * FROM (VALUES ('local_hits', 1), ('remote_hits', 1), ('misses', 3), ('uploads', 0), ('errors', 1)) t(counter, n)")
def tier_stats(s, d):
    """Counters of a store before a shared one: found here, found there, of another key, not there, and damaged on receipt."""
    shared, files = Store(scratch(s)), Files(s)
    here = Tiered(scratch(s), remote=shared)
    key = lambda x: fingerprint.node_key([x], {}, "", {}, ["o"])
    regions = table(s, d, "region")
    for k, df in (("there", regions), ("damaged", regions.where("r_regionkey > 0")), ("other", regions.where("r_regionkey > 1"))):
        shared.put(key(k), {"o": df})
    blob = shared.blob(shared.peek(key("damaged"))["o"])
    for part in files.list(blob):
        files.delete(f"{blob}/{part.name}")
    regions.where("r_regionkey > 2").write.mode("append").parquet(blob)
    files.publish(shared.entry(key("other")), files.read(shared.entry(key("there"))))
    for k in ("there", "there", "damaged", "other", "absent"):
        here.lookup(key(k))
    return s.createDataFrame(list(here.stats.items()), "counter string, n int")


@query("SELECT * FROM (VALUES ('entries', 3), ('blobs', 3), ('evicted', 1), ('dangling', 0), ('blobs_dropped', 1), ('too_young', 0)) t(counter, n)")
def collection(s, d):
    """A dry run, then a collection to a budget that only the entry used longest ago exceeds."""
    store = Store(scratch(s))
    for i, t in enumerate(("region", "nation", "supplier")):
        k = fingerprint.node_key([t], {}, "", {}, [t])
        store.put(k, {t: table(s, d, t)})
        store.files.touch(store.entry(k), (1000 + i) * 10**9)
    total = store.blobs(s).agg(F.sum("size")).first()[0]
    told = store.collect(s, total - 1, dry_run=True)
    young = store.collect(s, 1, min_age_ns=10**18 * 9)
    if store.blobs(s).count() != 3 or young["evicted"] or store.collect(s, total - 1) != told or store.blobs(s).count() != 2:
        raise RuntimeError("a dry run or a least age changed the store, or the plan was not kept")
    return s.createDataFrame([(k, told[k]) for k in ("entries", "blobs", "evicted", "dangling", "blobs_dropped", "too_young")], "counter string, n int")
