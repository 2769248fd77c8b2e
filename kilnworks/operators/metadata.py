"""Lookups, retention and summaries over the store's metadata, as DataFrames.

AC: key, mtime_ns, path, digest (entries exploded by output). CAS: digest, size, mtime_ns. RUN: the run log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def refcounts(ac: DataFrame) -> DataFrame:
    """digest and how often entries refer to it, repeats counted."""
    return ac.groupBy("digest").agg(F.count("*").alias("refs"))


def unreferenced(cas: DataFrame, ac: DataFrame) -> DataFrame:
    return cas.join(ac.select("digest"), "digest", "left_anti")


def complete_entries(ac: DataFrame, cas: DataFrame) -> DataFrame:
    """key and hit: is every blob that the entry names there?"""
    there = cas.select("digest", F.lit(True).alias("there"))
    return ac.join(there, "digest", "left").groupBy("key").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("hit"))


def tiered_lookup(requests: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """key and outcome (local_hit, remote_hit, miss) of each request; local and remote are (key, hit)."""
    both = requests.join(local.select("key", F.col("hit").alias("l")), "key", "left").join(remote.select("key", F.col("hit").alias("r")), "key", "left")
    return both.select("key", F.when(F.col("l"), "local_hit").when(F.col("r"), "remote_hit").otherwise("miss").alias("outcome"))


def tier_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def nondeterministic(history: DataFrame) -> DataFrame:
    """Rows of history (key, path, ts, digest) whose digest is another than the one before for that key and path."""
    before = F.lag("digest").over(W.partitionBy("key", "path").orderBy("ts", "digest"))
    return history.withColumn("before", before).where("before is not null and before <> digest").select("key", "path", "ts", "before", "digest")


def cell_of(bounds: list[float], value: str) -> Column:
    """How many of these ascending bounds a value reaches, by a binary tree of comparisons, which Spark compiles."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(value) >= F.lit(bounds[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))


def prefix_sums(df: DataFrame, order: list[str], value: str, out: str, buckets: int = 64) -> DataFrame:
    """df with ``out``, the sum of value over all rows before, without a window over all rows in one task.

    Rows are dealt by ranges of the first order column; the ranges' sums, few rows, are summed up first.
    """
    at = df.stat.approxQuantile(order[0], [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    d = df.withColumn("__b", cell_of(sorted(set(at)), order[0]))
    sums = d.groupBy("__b").agg(F.sum(value).alias("__s"))
    base = sums.select("__b", F.coalesce(F.sum("__s").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inner = F.coalesce(F.sum(value).over(W.partitionBy("__b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn(out, inner).join(F.broadcast(base), "__b").withColumn(out, (F.col(out) + F.col("__base")).cast("long")).drop("__b", "__base")


def eviction_plan(ac: DataFrame, cas: DataFrame, budget: int, now_ns: int = 0, min_age_ns: int = 0) -> DataFrame:
    """key, mtime_ns, freed (bytes that go with the entry) and evict: the least recently used entries that a budget drops.

    Unreferenced blobs go first. A blob goes with the last of its entries, and only if they are all old enough and so is the
    blob; an entry goes while what is left before it exceeds the budget. A budget of 0 or less evicts nothing.
    """
    old = lambda c: (F.lit(now_ns) - F.col(c) >= min_age_ns) if min_age_ns > 0 else F.lit(True)
    keys = ac.groupBy("key").agg(F.max("mtime_ns").alias("mtime_ns")).withColumn("eligible", old("mtime_ns"))
    refs = ac.select("key", "digest").distinct().join(keys, "key")
    last = refs.groupBy("digest").agg(F.max(F.struct("mtime_ns", "key")).alias("last"), F.bool_and("eligible").alias("all_old"))
    blobs = cas.join(last, "digest").where(F.col("all_old") & old("mtime_ns"))
    freed = blobs.groupBy(F.col("last.key").alias("key")).agg(F.sum("size").alias("freed"))
    ranked = keys.where("eligible").join(freed, "key", "left").select("key", "mtime_ns", F.coalesce("freed", F.lit(0)).cast("long").alias("freed"))
    ranked = prefix_sums(ranked, ["mtime_ns", "key"], "freed", "before")
    gone = unreferenced(cas, ac).where(old("mtime_ns")).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n"))
    total = cas.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("all")).join(gone).select((F.col("all") - F.col("n")).alias("kept"))  # a row each
    return ranked.join(F.broadcast(total)).select("key", "mtime_ns", "freed", ((F.lit(budget) > 0) & (F.col("kept") - F.col("before") > budget)).alias("evict"))


def dedup_ratio(cas_refs: DataFrame) -> DataFrame:
    return cas_refs.agg(F.count("*").alias("outputs"), F.countDistinct("digest").alias("blobs"))


def run_summary(run: DataFrame, by: list[str] | None = None) -> DataFrame:
    """succeeded, failed, skipped and cached of a run log (status, cached, start_ns, end_ns), and its length; with nondeterministic
    outputs, if the log has them, all of their names in order."""
    told = [F.sort_array(F.flatten(F.collect_list("nondeterministic"))).alias("nondeterministic")] if "nondeterministic" in run.columns else []
    return run.groupBy(*(by or [])).agg(
        F.count_if(F.col("status") == "ok").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if("cached").alias("cached"),
        (F.max("end_ns") - F.min("start_ns")).alias("elapsed_ns"),
        *told,
    )


def order_statistics(samples: DataFrame, wanted: DataFrame, buckets: int = 128) -> DataFrame:
    """config, v of the rows of samples (config, v, o) whose rank by (v, o) in their config is wanted (config, rank).

    No config needs to meet in one task: values are counted in cells of about equal numbers of rows, and only rows of cells in
    which a wanted rank falls are ranked, within their cell.
    """
    at = samples.stat.approxQuantile("v", [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    placed = samples.withColumn("cell", cell_of(sorted(set(at)), "v"))
    sums = placed.groupBy("config", "cell").agg(F.count("*").alias("c"))
    # a row a config and cell
    before = F.coalesce(F.sum("c").over(W.partitionBy("config").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    hit = sums.withColumn("before", before).join(wanted, "config").where("rank > before and rank <= before + c").select("config", "cell", (F.col("rank") - F.col("before")).alias("nth"), "rank")
    own = placed.join(hit.select("config", "cell").distinct(), ["config", "cell"], "left_semi")
    ranked = own.withColumn("nth", F.row_number().over(W.partitionBy("config", "cell").orderBy("v", "o")))
    return ranked.join(hit, ["config", "cell", "nth"]).select("config", "rank", "v")


def hinges(samples: DataFrame, config: str, order: str, value: str, drop_first: bool = True) -> DataFrame:
    """config, n, lower hinge, median, upper hinge: medians of the halves, the middle left out of both when n is odd.

    The first sample of each config (a warm-up) is dropped unless told otherwise.
    """
    s = samples.select(F.col(config).alias("config"), F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    if drop_first:
        first = s.groupBy("config").agg(F.min(F.struct("o", "v")).alias("first"))
        s = s.join(first, "config").where((F.col("o") > F.col("first.o")) | (F.col("v") > F.col("first.v"))).drop("first")
    n, half = F.col("n"), F.greatest(F.floor(F.col("n") / 2), F.lit(1))
    middle = lambda size: (F.floor((size + 1) / 2), F.floor(size / 2) + 1)  # noqa: E731  the two places whose mean is the median
    places = F.array(
        *(F.struct(F.lit(name).alias("name"), (base + at).cast("long").alias("rank")) for name, base, size in (("lower", F.lit(0), half), ("median", F.lit(0), n), ("upper", n - half, half)) for at in middle(size))
    )
    sizes = s.groupBy("config").agg(F.count("*").alias("n"))
    wanted = sizes.select("config", "n", F.explode(places).alias("p")).select("config", "n", "p.name", "p.rank")
    found = order_statistics(s, wanted.select("config", "rank").distinct())
    mean = wanted.join(found, ["config", "rank"]).groupBy("config", "n", "name").agg((F.sum("v") / F.count("v")).alias("v"))
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("v"))).alias(name)
    return mean.groupBy("config", "n").agg(pick("lower"), pick("median"), pick("upper"))


def speedups(summary: DataFrame, baseline: str) -> DataFrame:
    """config, median and speedup: the baseline's median over this one's."""
    base = summary.where(F.col("config") == baseline).select(F.col("median").alias("base"))  # a row
    return summary.join(F.broadcast(base)).select("config", "median", (F.col("base") / F.col("median")).alias("speedup"))


def inconclusive(summary: DataFrame) -> DataFrame:
    """Neighbouring configs, in their order, whose ranges between the hinges overlap; a row a config, so one task does."""
    w = W.orderBy("config")
    s = summary.select("config", "lower", "upper", F.lead("config").over(w).alias("next"), F.lead("lower").over(w).alias("l2"), F.lead("upper").over(w).alias("u2"))
    return s.where("next is not null").select("config", "next", ((F.col("lower") <= F.col("u2")) & (F.col("l2") <= F.col("upper"))).alias("overlap"))
