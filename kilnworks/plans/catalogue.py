"""Queries of the engine's own operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from kilnworks.functions import columns as C
from kilnworks.operators import graph, metadata
from kilnworks.sources import manifest

_all: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        _all[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(s, d):
    return table(s, d, "documents").select("doc_id", C.digest(F.col("text")).alias("digest"))


def _sql_record(tag: str, v: str) -> str:
    return f"'{tag} ' || octet_length(encode({v})) || chr(10) || {v} || chr(10)"


@query(f"SELECT doc_id, sha256({_sql_record('version', chr(39) + '1' + chr(39))} || {_sql_record('arg', 'lang')} || {_sql_record('arg', 'source')} || {_sql_record('env', chr(39) + 'N=' + chr(39) + ' || n_chars')} || {_sql_record('input', chr(39) + 'text ' + chr(39) + ' || sha256(text)')} || {_sql_record('output', chr(39) + 'out' + chr(39))}) AS node_key FROM documents")
def node_key(s, d):
    text = F.concat(F.lit("text "), C.digest(F.col("text")))
    env = F.create_map(F.lit("N"), F.col("n_chars").cast("string"))
    pairs = F.transform(F.array_sort(F.map_entries(env)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    key = F.concat(C.record("version", F.lit("1")), C.records("arg", F.array("lang", "source")), C.records("env", pairs), C.record("input", text), C.record("output", F.lit("out")))
    return table(s, d, "documents").select("doc_id", F.sha2(key, 256).alias("node_key"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r > 1")
def dup_documents(s, d):
    return manifest.repeated(table(s, d, "documents").select("doc_id", C.digest(F.col("text")).alias("h")), "h", "doc_id").select("doc_id")


@query("SELECT count(*) AS outputs, count(DISTINCT sha256(text)) AS blobs FROM documents")
def dedup_ratio(s, d):
    return metadata.dedup_ratio(table(s, d, "documents").select(C.digest(F.col("text")).alias("digest")))


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def dangling_refs(s, d):
    ids = lambda t: table(s, d, t).select(F.col("doc_id").alias("digest"))
    return metadata.unreferenced(ids("documents"), ids("labels")).withColumnRenamed("digest", "doc_id")


@query("SELECT props AS digest, count(*) AS refs FROM events GROUP BY props")
def refcounts(s, d):
    return metadata.refcounts(table(s, d, "events").select(F.col("props").alias("digest")))


@query("SELECT source AS key, bool_and(l.doc_id IS NOT NULL) AS hit FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source")
def cache_lookup(s, d):
    ac = table(s, d, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("digest"))
    return metadata.complete_entries(ac, table(s, d, "labels").select(F.col("doc_id").alias("digest")).distinct())


_TIERED = "SELECT d.doc_id AS key, CASE WHEN l.doc_id IS NOT NULL THEN 'local_hit' WHEN b.item_id IS NOT NULL THEN 'remote_hit' ELSE 'miss' END AS outcome FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id LEFT JOIN (SELECT DISTINCT item_id FROM benchmark) b ON b.item_id = d.doc_id"


@query(_TIERED)
def tiered_lookup(s, d):
    hit = lambda t, c: table(s, d, t).select(F.col(c).alias("key"), F.lit(True).alias("hit")).distinct()
    return metadata.tiered_lookup(table(s, d, "documents").select(F.col("doc_id").alias("key")), hit("labels", "doc_id"), hit("benchmark", "item_id"))


@query(f"SELECT outcome, count(*) AS n FROM ({_TIERED}) GROUP BY outcome")
def tier_counts(s, d):
    return metadata.tier_counts(tiered_lookup(s, d))


@query("SELECT event_type AS key, user_id AS path, event_id AS ts, before, digest FROM (SELECT *, sha256(props) AS digest, lag(sha256(props)) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS before FROM events) WHERE before <> digest")
def nondeterminism(s, d):
    e = table(s, d, "events")
    return metadata.nondeterministic(e.select(F.col("event_type").alias("key"), F.col("user_id").alias("path"), F.col("event_id").alias("ts"), C.digest(F.col("props")).alias("digest")))


@query("""WITH ac AS (SELECT user_id || '/' || event_type AS key, epoch_us(max(ts)) * 1000 AS mtime_ns FROM events GROUP BY 1),
refs AS (SELECT DISTINCT user_id || '/' || event_type AS key, props AS digest FROM events),
rk AS (SELECT *, row_number() OVER (ORDER BY mtime_ns, key) AS r FROM ac),
last AS (SELECT digest, max(r) AS r, octet_length(encode(digest)) AS size FROM refs JOIN rk USING (key) GROUP BY digest),
fr AS (SELECT r, sum(size) AS freed FROM last GROUP BY r),
run AS (SELECT key, mtime_ns, coalesce(freed, 0) AS freed, coalesce(sum(freed) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rk LEFT JOIN fr USING (r))
SELECT key, CAST(mtime_ns AS BIGINT) AS mtime_ns, CAST(freed AS BIGINT) AS freed, (SELECT sum(size) FROM last) - before > 1000 AS evict FROM run""")
def lru_eviction(s, d):
    e = table(s, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ns"), "props")
    ac = e.join(e.groupBy("key").agg(F.max("ns").alias("mtime_ns")), "key").select("key", "mtime_ns", F.lit("p").alias("path"), F.col("props").alias("digest")).distinct()
    cas = e.select(F.col("props").alias("digest")).distinct().select("digest", F.octet_length("digest").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ns"))
    return metadata.eviction_plan(ac, cas, 1000)


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS depth FROM conversations")
def chain_depth(s, d):
    part = F.split("name", "/")
    kind = dict(table(s, d, "conversations").dtypes)
    return graph.levels(replies(s, d)).select(part[0].cast(kind["conv_id"]).alias("conv_id"), part[1].cast(kind["turn"]).alias("turn"), F.col("level").alias("depth"))


@query("""WITH n AS (SELECT n_name, n_regionkey, n_nationkey, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nx, first_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS f, min(n_name) OVER (PARTITION BY n_regionkey) AS m FROM nation),
st AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, count(*) OVER (PARTITION BY n_regionkey) AS c FROM nation),
b AS (SELECT n_regionkey, i AS bi FROM st WHERE n_name = (SELECT min(n_name) FROM nation x WHERE x.n_regionkey = st.n_regionkey))
SELECT n_regionkey AS graph, string_agg(n_name, ' -> ' ORDER BY (i - bi + c) % c) || ' -> ' || min(n_name) AS cycle FROM st JOIN b USING (n_regionkey) GROUP BY n_regionkey""")
def on_cycle(s, d):
    w = W.partitionBy("n_regionkey").orderBy("n_nationkey")
    n = table(s, d, "nation").select("n_regionkey", F.col("n_name").alias("name"), F.coalesce(F.lead("n_name").over(w), F.first("n_name").over(w)).alias("dep"))
    return graph.topological_orders(n.withColumnRenamed("n_regionkey", "graph")).where("cycle is not null").select("graph", "cycle")


@query("SELECT conv_id AS graph, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, 't' || lpad(CAST(turn AS VARCHAR), 6, '0') AS name FROM conversations")
def topo_order(s, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    name = F.concat(F.lit("t"), F.lpad(F.col("turn").cast("string"), 6, "0"))
    e = table(s, d, "conversations").withColumn("name", name)
    return graph.topological_orders(e.select(F.col("conv_id").alias("graph"), "name", F.lag("name").over(w).alias("dep"))).select("graph", "pos", "name")


_REPLIES = "SELECT conv_id || '/' || lpad(CAST(turn AS VARCHAR), 6, '0') AS name, lag(conv_id || '/' || lpad(CAST(turn AS VARCHAR), 6, '0')) OVER (PARTITION BY conv_id ORDER BY turn) AS dep FROM conversations"


def replies(s, d):
    """Edges (name, dep) of turns, each of which waits for the turn before it in its conversation."""
    name = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.lpad(F.col("turn").cast("string"), 6, "0"))
    own = table(s, d, "conversations").select("conv_id", "turn", name.alias("name"))
    return own.select("name", F.lag("name").over(W.partitionBy("conv_id").orderBy("turn")).alias("dep"))


@query(f"WITH e AS ({_REPLIES}) SELECT a.name, coalesce(a.dep, '') AS deps, coalesce(b.name, '') AS dependents FROM e a LEFT JOIN e b ON b.dep = a.name")
def adjacent_turns(s, d):
    joined = lambda c: F.concat_ws(",", c).alias(c)
    return graph.adjacency(replies(s, d)).select("name", joined("deps"), joined("dependents"))


@query("""SELECT conv_id, row_number() OVER own - 1 AS pos, printf('%3d. ', row_number() OVER own) || name || CASE WHEN lag(name) OVER own IS NULL THEN '' ELSE '  (after ' || lag(name) OVER own || ')' END AS line
FROM (SELECT conv_id, turn, conv_id || '/' || lpad(CAST(turn AS VARCHAR), 6, '0') AS name FROM conversations) WINDOW own AS (PARTITION BY conv_id ORDER BY turn)""")
def order_listing(s, d):
    edges = replies(s, d)
    conv = F.element_at(F.split("name", "/"), 1).cast(table(s, d, "conversations").schema["conv_id"].dataType)
    order = graph.topological_orders(edges.withColumn("graph", conv)).select("graph", "pos", "name")
    return graph.listing(order, edges).select(F.col("graph").alias("conv_id"), "pos", "line")


@query("""WITH c AS (SELECT o_orderkey AS name, 'c' || o_custkey AS dep, o_custkey % 7 AS finish, 1 AS depth FROM orders UNION ALL SELECT DISTINCT l_orderkey, 'p' || l_partkey, l_partkey % 7, 1 + l_partkey % 2 FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
SELECT name, dep, finish, depth FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY finish DESC, depth DESC, dep) AS r FROM c) WHERE r = 1""")
def critical_step(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("name"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dep"), (F.col("o_custkey") % 7).alias("finish"), F.lit(1).cast("long").alias("depth"))
    p = table(s, d, "lineitem").select(F.col("l_orderkey").alias("name"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dep"), (F.col("l_partkey") % 7).alias("finish"), (1 + F.col("l_partkey") % 2).alias("depth")).distinct()
    return graph.best_predecessor(o.unionByName(p.join(o.select("name"), "name", "left_semi")))


_HINGES = """WITH a AS (SELECT event_type AS config, event_id AS o, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY v, o) AS rn, count(*) OVER (PARTITION BY config) AS n FROM a WHERE r > 1),
h AS (SELECT config, n, median(CASE WHEN rn <= n // 2 OR n = 1 THEN v END) AS lower, median(v) AS median, median(CASE WHEN rn > n - n // 2 OR n = 1 THEN v END) AS upper FROM b GROUP BY config, n)"""


@query(f"{_HINGES} SELECT config, n, lower, median, upper FROM h")
def hinges(s, d):
    return metadata.hinges(table(s, d, "events"), "event_type", "event_id", "value")


@query(f"{_HINGES} SELECT config, median, (SELECT median FROM h WHERE config = 'click') / median AS speedup FROM h WHERE EXISTS (SELECT 1 FROM h WHERE config = 'click')")
def speedup(s, d):
    return metadata.speedups(hinges(s, d), "click")


@query(f"{_HINGES}, p AS (SELECT config, lower, upper, lead(config) OVER w AS next, lead(lower) OVER w AS l2, lead(upper) OVER w AS u2 FROM h WINDOW w AS (ORDER BY config)) SELECT config, next, lower <= u2 AND l2 <= upper AS overlap FROM p WHERE next IS NOT NULL")
def overlap(s, d):
    return metadata.inconclusive(hinges(s, d))


@query("""SELECT user_id, count(*) FILTER (event_type NOT IN ('error', 'view')) AS succeeded, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'view') AS skipped, count(*) FILTER (event_id % 2 = 0) AS cached, max(epoch_us(ts)) * 1000 - min(epoch_us(ts)) * 1000 AS elapsed_ns FROM events GROUP BY user_id""")
def run_summary(s, d):
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "skipped").otherwise("ok")
    log = table(s, d, "events").select("user_id", status.alias("status"), (F.col("event_id") % 2 == 0).alias("cached"), ns.alias("start_ns"), ns.alias("end_ns"))
    return metadata.run_summary(log, ["user_id"])


@query("SELECT doc_id, array_to_string(list_sort(list_filter([lang, 'name', source], lambda x: x NOT IN ('name', 'en'))), ',') AS unknown FROM documents")
def strict_parse(s, d):
    made = F.concat(F.lit('{"'), "lang", F.lit('": 1, "name": "x", "'), "source", F.lit('": {"lang": 2}}'))
    e = manifest.unknown_fields(table(s, d, "documents").select("doc_id", made.alias("j")), "j", ["name", "en"])
    return e.where("size(unknown) > 0").select("doc_id", F.array_join("unknown", ",").alias("unknown"))


@query("SELECT substr(sha256(text), 1, 2) AS shard, count(*) AS n FROM documents GROUP BY 1")
def shard_layout(s, d):
    path = C.shard_path(C.digest(F.col("text")))
    return table(s, d, "documents").select(F.element_at(F.split(path, "/"), 1).alias("shard")).groupBy("shard").agg(F.count("*").alias("n"))


_SIZES = "(SELECT doc_id, n_chars * (1 << (11 * (doc_id % 4))) AS n FROM documents)"


@query(f"SELECT doc_id, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.2f KB', n / 1024.0) ELSE n || ' B' END AS size FROM {_SIZES}")
def size_format(s, d):
    n = F.col("n_chars") * F.expr("shiftleft(1L, CAST(11 * (doc_id % 4) AS INT))")
    return table(s, d, "documents").select("doc_id", C.human_size(n).alias("size"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN n_chars * 1024 WHEN 1 THEN n_chars * 1048576 WHEN 2 THEN n_chars * 1073741824 WHEN 3 THEN n_chars WHEN 4 THEN 0 END AS bytes FROM documents")
def size_parse(s, d):
    units = F.array(F.lit(" kb"), F.lit("M"), F.lit(" gB "), F.lit(""))
    k = (F.col("doc_id") % 6).cast("int")
    text = F.when(k < 4, F.concat(F.col("n_chars").cast("string"), F.get(units, k))).when(k == 4, "").otherwise(F.concat(F.lit("-"), F.col("n_chars").cast("string")))
    return table(s, d, "documents").select("doc_id", C.parse_size(text).alias("bytes"))


@query("""SELECT l.l_orderkey AS name, 'unknown dependency' AS rule, count(*) AS n FROM lineitem l ANTI JOIN (SELECT p_partkey FROM part WHERE p_size > 10) p ON l.l_partkey = p.p_partkey GROUP BY 1, 2""")
def unknown_deps(s, d):
    known = table(s, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("name"))
    edges = table(s, d, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_partkey").alias("dep"))
    return graph.unknown_deps(known, edges).groupBy("name").agg(F.count("*").alias("n")).select("name", F.lit("unknown dependency").alias("rule"), "n")


@query("SELECT page_id, CASE WHEN p = '' THEN 'empty' WHEN p LIKE '/%' THEN 'absolute' WHEN p LIKE '%//%' OR p LIKE '%/' OR p LIKE './%' OR p LIKE '%/./%' OR p LIKE '%/.' THEN 'not canonical' END AS problem FROM (SELECT page_id, regexp_replace(url, '^https?:/', CASE WHEN page_id % 2 = 0 THEN '' ELSE 'x' END) AS p FROM pages)")
def path_rules(s, d):
    t = table(s, d, "pages").withColumn("p", F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?:/", "")).otherwise(F.regexp_replace("url", "^https?:/", "x")))
    return t.select("page_id", C.path_problem(F.col("p")).alias("problem"))


_REGIONS = """e AS (SELECT a.n_regionkey AS graph, a.n_name AS name, b.n_name AS dep FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey > b.n_nationkey AND (a.n_nationkey + b.n_nationkey) % 3 = 0),
n AS (SELECT n_regionkey AS graph, n_name AS name, n_nationkey AS k, (SELECT count(*) FROM nation y WHERE y.n_regionkey = x.n_regionkey AND y.n_nationkey < x.n_nationkey) AS r, coalesce((SELECT list(dep) FROM e WHERE e.name = x.n_name), []) AS deps FROM nation x)"""


def region_edges(s, d):
    """Nations of a region wait for some of those before them: graphs that branch and meet; with a duration, a power of two."""
    n = table(s, d, "nation").select(F.col("n_regionkey").cast("long").alias("graph"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    b = n.select("graph", F.col("name").alias("dep"), F.col("k").alias("j"))
    pairs = n.join(b, "graph").where("k > j and (k + j) % 3 = 0").select("graph", "name", "dep")
    rank = F.row_number().over(W.partitionBy("graph").orderBy("k")) - 1
    return n.withColumn("duration", F.pow(F.lit(2), rank).cast("long")).join(pairs, ["graph", "name"], "left").select("graph", "name", "dep", "duration")


@query(f"""WITH RECURSIVE {_REGIONS}, st AS (SELECT DISTINCT graph, [] :: VARCHAR[] AS done FROM n UNION ALL
SELECT st.graph, list_append(any_value(st.done), min(n.name)) FROM st JOIN n ON n.graph = st.graph AND NOT list_contains(st.done, n.name) AND len(list_filter(n.deps, lambda x: NOT list_contains(st.done, x))) = 0 GROUP BY st.graph),
f AS (SELECT graph, done FROM st QUALIFY row_number() OVER (PARTITION BY graph ORDER BY len(done) DESC) = 1)
SELECT CAST(graph AS BIGINT) AS graph, generate_subscripts(done, 1) - 1 AS pos, unnest(done) AS name FROM f""")
def dag_order(s, d):
    return graph.topological_orders(region_edges(s, d)).select("graph", "pos", "name")


@query(f"""WITH RECURSIVE {_REGIONS}, p AS (SELECT graph, name, [name] AS path, 1 << r AS total FROM n UNION ALL SELECT n.graph, n.name, list_append(p.path, n.name), p.total + (1 << n.r) FROM p JOIN e ON e.graph = p.graph AND e.dep = p.name JOIN n ON n.graph = e.graph AND n.name = e.name)
SELECT CAST(graph AS BIGINT) AS graph, array_to_string(path, ' -> ') AS path, CAST(total AS BIGINT) AS total FROM p QUALIFY row_number() OVER (PARTITION BY graph ORDER BY total DESC) = 1""")
def critical_paths(s, d):
    return graph.critical_paths(region_edges(s, d)).select("graph", F.array_join("path", " -> ").alias("path"), "total")


@query(f"WITH c AS (SELECT conv_id || '/' || lpad(CAST(turn AS VARCHAR), 6, '0') AS name, max(length(text) % 7 = 0 :: INT) OVER (PARTITION BY conv_id ORDER BY turn) AS hit, length(text) % 7 = 0 AS own FROM conversations) SELECT name FROM c WHERE hit AND NOT own")
def poisoned(s, d):
    bad = table(s, d, "conversations").where("length(text) % 7 = 0")
    name = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.lpad(F.col("turn").cast("string"), 6, "0"))
    return graph.dependents_closure(replies(s, d), bad.select(name.alias("name")))


@query("SELECT c_name AS name FROM customer ORDER BY 1")
def sorted_names(s, d):
    return graph.names(table(s, d, "customer").select(F.col("c_name").alias("name")))


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN user_id END AS cached FROM events")
def cached_counts(s, d):
    line = F.when(F.col("event_id") % 3 > 0, F.format_string("%d ok (%d cached), 0 not", F.col("event_id"), F.col("user_id"))).otherwise("3 ok, (x cached)")
    return table(s, d, "events").select("event_id", C.cached_nodes(line).alias("cached"))


_ACTS = """a AS (SELECT CAST(p_partkey AS INT) AS idx, CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN 'dup' || p_partkey % 5 ELSE 'p' || p_partkey END AS name,
CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN '/etc/x' WHEN 2 THEN 'a//b' WHEN 3 THEN '../x' WHEN 4 THEN 'a/../b' WHEN 5 THEN '..' WHEN 6 THEN './a' WHEN 7 THEN 'a/' ELSE 'ok/x' END AS path,
p_partkey % 11 = 0 AS self, 'p' || (p_partkey + 1) AS dep, p_partkey % 7 = 0 AS no_out, p_partkey % 5 = 0 AS no_command, p_partkey % 19 = 0 AS blank FROM part),
m AS (SELECT * FROM a WHERE name <> '')"""


@query(f"""WITH {_ACTS}
SELECT name AS action, 'no name' AS rule, CAST(idx AS VARCHAR) AS detail FROM a WHERE name = ''
UNION ALL SELECT name, 'duplicate name', CAST(idx AS VARCHAR) FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY idx) AS r FROM m) WHERE r > 1
UNION ALL SELECT name, 'no command', '' FROM m WHERE no_command UNION ALL SELECT name, 'no outputs', '' FROM m WHERE no_out UNION ALL SELECT name, 'blank variable', '' FROM m WHERE blank
UNION ALL SELECT name, 'depends on itself', name FROM m WHERE self
UNION ALL SELECT name, 'unknown dependency', dep FROM m WHERE dep NOT IN (SELECT name FROM m)
UNION ALL SELECT name, 'inputs: ' || CASE WHEN path = '' THEN 'empty' WHEN path LIKE '/%' THEN 'absolute' WHEN path IN ('..', '../x') THEN 'escapes' ELSE 'not canonical' END, path FROM m WHERE path <> 'ok/x'""")
def spec_problems(s, d):
    k = F.col("p_partkey")
    paths = F.array(*(F.lit(x) for x in ("", "/etc/x", "a//b", "../x", "a/../b", "..", "./a", "a/", "ok/x")))
    name = F.when(k % 17 == 0, "").when(k % 13 == 0, F.concat(F.lit("dup"), (k % 5).cast("string"))).otherwise(F.concat(F.lit("p"), k.cast("string")))
    none = F.array().cast("array<string>")
    a = table(s, d, "part").select(k.cast("int").alias("idx"), name.alias("name"), k.alias("k"), F.array(F.get(paths, (k % 9).cast("int"))).alias("inputs"))
    k = F.col("k")
    a = a.withColumn("deps", F.concat(F.when(k % 11 == 0, F.array("name")).otherwise(none), F.array(F.concat(F.lit("p"), (k + 1).cast("string")))))
    a = a.withColumn("outputs", F.when(k % 7 == 0, none).otherwise(F.array(F.lit("out/o")))).withColumn("command", F.when(k % 5 == 0, none).otherwise(F.array(F.lit("c"))))
    env = F.create_map(F.when(k % 19 == 0, " ").otherwise("N"), F.lit("1"))
    return manifest.problems(a.withColumn("env", env).select(*manifest.INDEXED.names))


@query("SELECT '' AS action, 'no actions' AS rule, '' AS detail")
def empty_spec(s, d):
    return manifest.problems(manifest.actions(s, []))


@query("""WITH ac AS (SELECT user_id || '/' || event_type AS key, epoch_us(max(ts)) AS t FROM events GROUP BY 1),
top AS (SELECT epoch_us(max(ts)) AS now FROM events), el AS (SELECT key, t, now - t >= 86400000000 AS ok FROM ac, top),
refs AS (SELECT DISTINCT user_id || '/' || event_type AS key, props AS digest FROM events),
rk AS (SELECT key, row_number() OVER (ORDER BY t, key) AS r FROM el WHERE ok),
last AS (SELECT digest, max(r) AS r, octet_length(encode(digest)) AS size FROM refs JOIN el USING (key) LEFT JOIN rk USING (key) GROUP BY digest HAVING bool_and(ok)),
fr AS (SELECT r, sum(size) AS freed FROM last GROUP BY r),
total AS (SELECT sum(octet_length(encode(digest))) AS n FROM (SELECT DISTINCT props AS digest FROM events)),
run AS (SELECT key, coalesce(freed, 0) AS freed, coalesce(sum(freed) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rk LEFT JOIN fr USING (r))
SELECT key, CAST(freed AS BIGINT) AS freed, n - before > 1000 AS evict FROM run, total""")
def lru_eviction_min_age(s, d):
    e = table(s, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ns"), "props")
    ac = e.join(e.groupBy("key").agg(F.max("ns").alias("mtime_ns")), "key").select("key", "mtime_ns", F.lit("p").alias("path"), F.col("props").alias("digest")).distinct()
    cas = e.select(F.col("props").alias("digest")).distinct().select("digest", F.octet_length("digest").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ns"))
    now = e.agg(F.max("ns")).first()[0]
    return metadata.eviction_plan(ac, cas, 1000, now or 0, 86400 * 10**9).select("key", "freed", "evict")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a three-node pipeline: distinct documents, their labels, counts by language."""
    docs = table(spark, sf_dir, "documents")
    first = docs.groupBy(C.digest(F.col("text")).alias("h")).agg(F.min("doc_id").alias("doc_id"))
    labelled = docs.select("doc_id", "lang").join(first.select("doc_id"), "doc_id", "left_semi").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return labelled.groupBy("lang").agg(F.count("*").alias("documents"), F.count("quality").alias("labelled"), F.sum("toxic").alias("toxic"))


_FLAGSHIP = "WITH f AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)) SELECT lang, count(*) AS documents, count(quality) AS labelled, CAST(sum(toxic) AS BIGINT) AS toxic FROM documents SEMI JOIN f USING (doc_id) LEFT JOIN labels USING (doc_id) GROUP BY lang"
_all["lang_report"] = (flagship, _FLAGSHIP)


def _every() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    from kilnworks.plans import audit  # its queries register themselves

    return audit.registered()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _every().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for k, (_, q) in _every().items() if q}
