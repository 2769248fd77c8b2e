"""Mixing sources to target weights.

The words of a source's documents, in a fixed order, are one stream cut into blocks of equal length. Each source gets as many
slots as its target needs. The slots of all sources are dealt to output shards of equal size: how many of a shard's slots each
source has is drawn by a multinomial, conditioned on the sources' totals, so that targets are met. A shard's slots of a source
follow those of the shard before, and slot j takes block p(j mod n) of the source's n blocks, p being a keyed permutation of
the indices, another one each time round. Blocks and documents meet by block index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from kilnworks.llm import bytestext as bt
from kilnworks.llm import workspace as ws

#: Weights by the sources' order, repeating; words wanted in all as a share of those there; most passes over a source.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
#: Words in a block, slots in an output shard, and the most sources: each has one weight, and tasks get a few numbers of each.
BLOCK, SHARD_SLOTS, SOURCES = 64, 1 << 12, 1 << 20


def shuffled(r: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n - 1 at r: a Feistel network over the next power of four, walked until inside."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = bt.mix(np.arange(1, 5, dtype="uint64") * bt.BASE + np.uint64(key % 2**64))

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> shift, x & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                a, b = b ^ (bt.mix(a * bt.STEP + k) & mask), a
            else:
                a, b = b, a ^ (bt.mix(b * bt.STEP + k) & mask)
        return (a << shift) | b

    with np.errstate(over="ignore"):
        x = once(np.asarray(r, dtype="uint64"))
        while (out := x >= n).any():
            x[out] = once(x[out])
    return x.astype("int64")


def row_id(docs: DataFrame) -> Column:
    """128 bits of hash that tell a row of docs from unequal ones; equal rows share them."""
    own = [F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    return F.struct(F.xxhash64(*own).alias("a"), F.xxhash64(F.lit(1), *own).alias("b"))


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and row, which identifies it (equal rows share it)."""
    ws.small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), row_id(docs).alias("row"), F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.pieces(batches, "__text"):
            counts = bt.words(*bt.flat(batch.column("__text")))[2]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("row"), pa.array(counts, pa.int64())], ["doc_id", "source", "row", "size"])

    return own.mapInArrow(run, "doc_id long, source string, row struct<a:long,b:long>, size long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, sid, source_size and target of each source; one row a source, so the windows over all of them are small.

    With the sources in order of 2 * size / weight, those up to some place are at their limit and the rest share what is left
    by weight. What a unit of weight gets if only those before a place are limited grows up to that place and falls after
    it, so its maximum is the level sought.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    s = s.withColumn("most", (PASSES * F.col("source_size")).cast("double")).withColumn("ratio", F.col("most") / F.col("weight"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * SHARE
    before = F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("share", (total - before) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    level = F.max("share").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.least(F.col("most"), F.col("weight") * level)
    return s.select("source", F.xxhash64("source").alias("sid"), "source_size", target.alias("target"))


def placed_documents(sizes: DataFrame) -> DataFrame:
    """sizes with sid and start: the words of its source before it. Sums run in buckets of a source, then over the buckets."""
    buckets = 8 * ws.partitions(sizes.sparkSession)
    d = sizes.withColumn("sid", F.xxhash64("source")).withColumn("part", F.pmod(F.xxhash64("doc_id", "row"), F.lit(buckets)))
    inside = W.partitionBy("sid", "part").orderBy("doc_id", "row").rowsBetween(W.unboundedPreceding, -1)
    sums = d.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    base = sums.select("sid", "part", F.coalesce(F.sum("n").over(W.partitionBy("sid").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return d.join(base, ["sid", "part"]).select("doc_id", "source", "row", "size", "sid", (F.col("base") + F.col("inside")).alias("start"))


def slots_of(size: int, target: float) -> tuple[int, int, int, int]:
    """(blocks, full passes, words of the last pass, slots) of a source."""
    want, n = round(target), -(-size // BLOCK)
    full, rest = divmod(want, size)
    return n, full, rest, full * n + min(n, -(-rest // BLOCK) + (rest > 0))


def drawn(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric: how many of n, taken without replacement, are good. Beyond what numpy draws, by its normal limit."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    share = good / (good + bad)
    spread = (n * share * (1 - share) * (good + bad - n) / (good + bad - 1)) ** 0.5
    return min(max(round(rng.normal(n * share, spread)), n - bad, 0), good, n)


def shard_counts(slots: list[int], size: int, first: int, last: int, seed: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """(shard, slots of each source in shards before, in it) of the shards from first up to last.

    Shards hold ``size`` slots, the last one the rest. A multinomial for each shard, conditioned on the sources' totals, deals
    the slots without replacement. It is drawn down a binary tree over the shards, each node's draw, how many of its slots the
    left half gets, from a generator of its own: so any task draws only the nodes above its shards, and all agree.
    """
    total = sum(slots)
    shards = -(-total // size)
    stack = [(0, shards, [0] * len(slots), list(slots))]
    while stack:
        lo, hi, before, own = stack.pop()
        if lo >= last or hi <= first or lo >= hi:
            continue
        if hi - lo == 1:
            yield lo, before, own
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left, rest = (mid - lo) * size, sum(own)
        taken = []
        for c in own:
            rest -= c
            taken.append(drawn(rng, c, rest, left))
            left -= taken[-1]
        stack.append((mid, hi, [a + t for a, t in zip(before, taken, strict=True)], [c - t for c, t in zip(own, taken, strict=True)]))
        stack.append((lo, mid, before, taken))


def draw_slots(sources: DataFrame, seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """sid, shard, slot, epoch, block and take of each slot: so many first words of that block.

    Full epochs take every block once; the last one takes blocks until the target, rounded, is reached, the last slot in part.
    """
    spark = sources.sparkSession
    rows = sources.where("source_size > 0").select("sid", "source_size", "target").orderBy("sid").limit(SOURCES + 1).collect()
    if len(rows) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources: targets by weight need fewer")
    known = [(r["sid"], r["source_size"], *slots_of(r["source_size"], r["target"])) for r in rows if round(r["target"]) > 0]
    slots = [k[5] for k in known]
    shards = -(-sum(slots) // shard_slots)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for part in np.split(ids, np.flatnonzero(np.diff(ids) != 1) + 1) if len(ids) else ():
                for shard, before, own in shard_counts(slots, shard_slots, int(part[0]), int(part[-1]) + 1, seed):
                    made = [slots_in(known[i], before[i], k) for i, k in enumerate(own) if k]
                    sid, slot, epoch, block, take = (np.concatenate(x) for x in zip(*made, strict=True))
                    used = take > 0
                    yield pa.RecordBatch.from_arrays([pa.array(x[used]) for x in (sid, np.full(len(sid), shard), slot, epoch, block, take)], ["sid", "shard", "slot", "epoch", "block", "take"])

    def slots_in(source: tuple, first: int, k: int) -> tuple[np.ndarray, ...]:
        sid, size, n, full, rest, _ = source
        slot = np.arange(first, first + k)
        epoch, r = slot // n, slot % n
        block, take = np.empty(k, "int64"), np.empty(k, "int64")
        for e in np.unique(epoch).tolist():
            own = epoch == e
            with np.errstate(over="ignore"):
                key = int(bt.mix(np.array([sid % 2**64], dtype="uint64") + np.uint64((seed * 1_000_003 + e) % 2**64))[0])
            block[own] = shuffled(r[own], n, key)
            length = np.minimum(BLOCK, size - block[own] * BLOCK)
            if e == full:
                short = int(shuffled(np.array([n - 1]), n, key, inverse=True)[0])
                before = r[own] * BLOCK - (r[own] > short) * (n * BLOCK - size)
                length = np.clip(rest - before, 0, length)
            take[own] = length
        return np.full(k, sid), slot, epoch, block, take

    parts = max(1, min(shards, ws.partitions(spark)))
    return spark.range(0, shards, 1, parts).mapInArrow(expand, "sid long, shard long, slot long, epoch long, block long, take long")


def mix_pieces(sizes: DataFrame, sources: DataFrame, seed: int, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(documents with their places, pieces of documents in slots: sid, start, shard, epoch, block, first and last word in the text)."""
    docs = placed_documents(sizes)
    last = F.expr(f"(start + size - 1) div {BLOCK}")
    blocks = docs.where("size > 0").select("sid", "start", "size", F.explode(F.sequence(F.expr(f"start div {BLOCK}"), last)).alias("block"))
    slots = draw_slots(sources, seed, shard_slots)
    at = F.col("block") * BLOCK
    # a few rows of draws become all slots, which no size estimate foresees: never broadcast them
    pieces = blocks.join(slots.hint("merge"), ["sid", "block"]).select(
        "sid", "start", "shard", "epoch", "block", F.greatest(F.lit(0), at - F.col("start")).alias("a"), (F.least(F.col("start") + F.col("size"), at + F.col("take")) - F.col("start")).alias("b")
    )
    return docs, pieces.where("b > a")


def mix(docs: DataFrame, seed: int = 7, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """doc_id, size, source_size, target, taken and shards of each row of docs (doc_id, text, source).

    shards lists the output shards that take words of the row, and how many, as shard:words, in order. A null text has no words,
    a null source is a source of its own, and a source without words has target 0. Equal rows have places of their own in the
    stream. The same docs and seed give the same mix. No text is shuffled.
    """
    sizes = ws.cut(word_counts(docs), "sizes")
    sources = ws.cut(source_targets(sizes), "sources")
    placed, pieces = mix_pieces(sizes, sources, seed, shard_slots)
    taken = pieces.groupBy("sid", "start", "shard").agg(F.sum(F.col("b") - F.col("a")).alias("n"))
    one = F.sort_array(F.collect_list(F.struct("shard", "n")))
    taken = taken.groupBy("sid", "start").agg(F.sum("n").alias("taken"), F.array_join(F.transform(one, lambda x: F.concat_ws(":", x["shard"], x["n"])), ",").alias("shards"))
    got = placed.where("size > 0").join(taken, ["sid", "start"], "left").select("doc_id", "size", "sid", "taken", "shards")
    none = sizes.where("size = 0").select("doc_id", "size", F.xxhash64("source").alias("sid"), F.lit(None).cast("long").alias("taken"), F.lit(None).cast("string").alias("shards"))
    return got.unionByName(none).join(sources, "sid").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("shards", F.lit("")).alias("shards"))


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """docs as the mix takes them, with the columns of docs: a row of which no word is taken goes.

    A text taken once and whole stays as it is. Else its taken words follow, time after time round its source, whole passes as
    they are and the words of others joined by a space; n_chars, if there, is set anew. A row without words stays.
    """
    sizes = ws.cut(word_counts(docs), "sizes")
    sources = ws.cut(source_targets(sizes), "sources")
    placed, pieces = mix_pieces(sizes, sources, seed)
    spans = pieces.groupBy("sid", "start").agg(F.sort_array(F.collect_list(F.struct("epoch", "a", "b"))).alias("spans"))
    rows = placed.where("size > 0").join(spans, ["sid", "start"]).select("row", "size", "spans")
    rows = rows.unionByName(sizes.where("size = 0").select("row", "size", F.lit(None).cast(rows.schema["spans"].dataType).alias("spans")))
    whole = docs.withColumn("__row", row_id(docs)).dropDuplicates(["__row"])
    joined = whole.join(rows.select(F.col("row").alias("__row"), F.col("size").alias("__size"), F.col("spans").alias("__spans")), "__row").drop("__row")
    names = [c for c in joined.columns if c not in ("__size", "__spans")]

    def rebuilt(text: str, size: int, spans: list) -> str:
        if not spans:
            return text
        by: dict[int, list] = {}
        for s in spans:
            by.setdefault(s["epoch"], []).append((s["a"], s["b"]))
        words: list[bytes] | None = None
        out = []
        for _, own in sorted(by.items()):
            if sum(b - a for a, b in own) == size:
                out.append(text)
                continue
            if words is None:
                data, offsets = bt.flat(pa.array([text]))
                starts, ends, _ = bt.words(data, offsets)
                raw = data.tobytes()
                words = [raw[x:y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
            out.append(b" ".join(w for a, b in sorted(own) for w in words[a:b]).decode())
        return "\n".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.pieces(batches, "text"):
            texts = [rebuilt(t, n, s) for t, n, s in zip(batch.column("text").to_pylist(), batch.column("__size").to_pylist(), batch.column("__spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    out = joined.mapInArrow(run, docs.select(*(F.col(f"`{c}`") for c in names)).schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
