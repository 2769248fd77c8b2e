"""Near-duplicates by ProbMinHash, banding and verification.

A document is the set of its five-word shingles, each of weight 1 however often it comes, as links are defined by sets. Each
shingle sends a Poisson process of arrivals, of its weight's rate and derived from its hash alone, to m registers, and each
register keeps the shingle that came first; a shingle stops once no register can be reached any more. Two documents agree in
a register with their probability Jaccard similarity, which is that of their sets at these weights. Documents that agree in a band of registers are candidates, and those
whose shingle sets have a Jaccard similarity of 0.8 or more, counted exactly, are linked. Links make groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnworks.llm import bytestext as bt
from kilnworks.llm import workspace as ws

#: Words in a shingle, least similarity, bands and registers in each: a pair at 0.8 is missed once in 17,000. Registers in all:
#: those beyond the bands only sharpen the sketches.
SHINGLE, ALIKE, BANDS, ROWS, REGISTERS = 5, 0.8, 32, 6, 384
#: Rows of a bucket that one task compares with the bucket's rows in the last round.
BLOCK = 4096


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of the distinct shingles, ascending; a text of fewer than k words has one, of all its words."""
    starts, ends, counts = bt.words(data, offsets)
    h = bt.word_hashes(data, starts, ends)
    doc = bt.doc_of(counts)
    n = max(0, len(h) - k + 1)
    own = doc[:n] == doc[len(h) - n :] if n else np.empty(0, dtype=bool)
    g, of = bt.ngrams(h, k)[own], doc[:n][own]
    begin = np.cumsum(counts) - counts
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):
        with np.errstate(over="ignore"):
            whole = np.array([bt.ngrams(h[begin[i] : begin[i] + counts[i]], int(counts[i]))[0] for i in few], dtype="uint64")
        g, of = np.concatenate([g, whole]), np.concatenate([of, few])
    order = np.argsort(g, kind="stable")
    order = order[np.argsort(of[order], kind="stable")]
    g, of = g[order], of[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    return of[first], g[first], np.diff(np.append(first, len(g)))


def prob_minhash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """Registers (docs x m) of weighted sets; those of an empty set are 0."""
    time, kept = np.full(docs * m, np.inf), np.zeros(docs * m, dtype="uint64")
    t, step = np.zeros(len(h)), 0
    while len(h):
        step += 1
        with np.errstate(over="ignore"):
            u = bt.mix(h + np.uint64(step) * bt.BASE)
            to = bt.mix(u ^ bt.STEP)
        t = t - np.log(((u >> np.uint64(11)).astype("float64") + 1) * 2.0**-53) / weight
        at = doc * m + (to % np.uint64(m)).astype("int64")
        np.minimum.at(time, at, t)
        won = time[at] == t
        kept[at[won]] = h[won]
        some = np.unique(doc)
        latest = np.zeros(docs)
        latest[some] = time.reshape(docs, m)[some].max(axis=1)
        on = t < latest[doc]
        doc, h, weight, t = doc[on], h[on], weight[on], t[on]
    return kept.reshape(docs, m)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.tile(np.arange(1, bands + 1, dtype="uint64"), (len(registers), 1))
    by_band = registers.reshape(len(registers), bands, rows)
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = bt.mix(key * bt.BASE + by_band[:, :, r])
    return key.view("int64")


def sketches(registers: np.ndarray) -> np.ndarray:
    """Four bits of each register: of 64 registers a long of their last bits, one of those before, and so on."""
    d, m = registers.shape
    by_bit = (registers.reshape(d, m // 64, 1, 64) >> np.arange(4, dtype="uint64")[:, None]) & np.uint64(1)
    return np.bitwise_or.reduce(by_bit << np.arange(64, dtype="uint64"), axis=3).reshape(d, m // 16).view("int64")


def plausible(a: str, b: str, longs: int) -> Column:
    """Do two sketches differ in no more registers than one pair in 4,000 at the least similarity would?

    Registers agree with the similarity, and by chance with a sixteenth of the rest. Each long is named once: a condition of
    over 8,000 bytes of code is never compiled by the JVM.
    """
    m = 16 * longs
    agree = ALIKE + (1 - ALIKE) / 16
    most = int(m * (1 - agree) + 3.5 * (m * agree * (1 - agree)) ** 0.5)

    def differ(i: int) -> Column:
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for j in range(i + 1, i + 4):
            x = x.bitwiseOR(F.col(a)[j].bitwiseXOR(F.col(b)[j]))
        return F.bit_count(x)

    total = differ(0)
    for i in range(4, longs, 4):
        total = total + differ(i)
    return total <= most


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """ord (the id, null last), node (128 bits of the text's SHA-256), n (distinct shingles), band keys and sketch of each row."""
    own = docs.select(ws.id_order().alias("ord"), F.coalesce("text", F.lit("")).alias("__text"))
    own = own.select("ord", F.unhex(F.substring(F.sha2("__text", 256), 1, 32)).alias("node"), "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.pieces(batches, "__text", 2 << 20):
            d = batch.num_rows
            doc, h, _ = shingles(*bt.flat(batch.column("__text")))
            n = np.bincount(doc, minlength=d)
            registers = prob_minhash(doc, h, np.ones(len(h)), d, REGISTERS)
            keys, bits = band_keys(registers[:, : bands * rows], bands, rows), sketches(registers)
            offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype("int32")
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[n > 0].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("node"), pa.array(n, pa.int64()), lists, pa.array(list(bits), pa.list_(pa.int64()))], ["ord", "node", "n", "bands", "sketch"])

    return own.mapInArrow(run, "ord long, node binary, n long, bands array<long>, sketch array<long>")


def texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and text of each of these nodes (node, ord), once: that of the row of this ord, so copies of a text never meet."""
    texts = docs.select(F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)).alias("node"), ws.id_order().alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    return ws.cut(texts.join(nodes, ["node", "ord"], "left_semi").dropDuplicates(["node"]).select("node", "text"), "texts")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) whose texts' shingle sets have a Jaccard similarity of ALIKE or more."""
    # one text may be in a great share of the pairs, on either side
    right = ws.salted_join(pairs, texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b", "a")
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    both = ws.salted_join(right, left, "a", "b", counts=pairs.groupBy("a").count()).select("a", "b", "a_text", "b_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, np.empty(0, "uint64")
        for batch in bt.pieces(batches, "b_text", 1 << 20):
            a_of, texts = batch.column("a").to_pylist(), batch.column("a_text")
            new = [i for i, x in enumerate(a_of) if x != (a_of[i - 1] if i else last)]
            sets: list[np.ndarray] = []
            for some in (texts.take(pa.array(new, pa.int64())), batch.column("b_text")):
                doc, h, _ = shingles(*bt.flat(some))
                at = np.searchsorted(doc, np.arange(len(some) + 1))
                sets.append([h[x:y] for x, y in zip(at[:-1], at[1:], strict=True)])
            alike, k = [], 0
            for i, x in enumerate(a_of):
                if k < len(new) and new[k] == i:
                    last, last_set, k = x, sets[0][k], k + 1
                b = sets[1][i]
                both = len(np.intersect1d(last_set, b, assume_unique=True))
                alike.append(both > 0 and both >= ALIKE * (len(last_set) + len(b) - both))
            keep = pa.array(alike, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


def heads_of(open_rows: DataFrame, heads: int) -> DataFrame:
    """key, parts and head (node, n, root, sketch): up to ``heads`` of each bucket's open rows.

    The i-th head is the least by a hash of node and i: a minimum, which is taken before the shuffle, so a large bucket never
    meets in one task. Buckets of the same documents mostly get the same heads, whose pairs are then compared once.
    """
    turn = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("turn"), "node", "n", "root", "sketch")) for i in range(heads)]
    h = open_rows.groupBy("key").agg(F.max("parts").alias("parts"), F.array(*turn).alias("h")).select("key", "parts", F.explode("h").alias("h"))
    h = h.select("key", "parts", "h.node", "h.n", "h.root", "h.sketch")
    return h.distinct() if heads > 1 else h


def parts_of(c: str) -> Column:
    """In how many parts a bucket of c rows is compared."""
    return F.ceil(F.col(c) / (16 * BLOCK)).cast("int")


def may_be_alike() -> Column:
    """Do sizes and sketches of m and h, of different groups, allow the similarity?"""
    return (F.col("m.root") != F.col("h.root")) & (F.least("m.n", "h.n") >= ALIKE * F.greatest("m.n", "h.n")) & plausible("m.sketch", "h.sketch", REGISTERS // 16)


def candidate_pairs(members: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket's heads with its members of other groups whose sizes and sketches allow the similarity.

    A large bucket's members are dealt over several tasks, and its few heads sent to each.
    """
    h = heads.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("h")
    m = members.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).alias("m")
    near = (F.col("m.key") == F.col("h.key")) & (F.col("m.part") == F.col("h.part")) & may_be_alike()
    return m.join(h, near).select(F.least("m.node", "h.node").alias("a"), F.greatest("m.node", "h.node").alias("b")).distinct()


def cross_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of a bucket in different groups whose sizes and sketches allow the similarity.

    Of two members of different groups one is outside the bucket's largest group: such rows meet all rows, in a grid of blocks,
    so no task compares more than about BLOCK of them with 16 BLOCK others, and a bucket of one great group and few strangers
    costs their number times its size, not its square. A pair that meets in several buckets is made in the first alone.
    """
    groups = members.groupBy("key", "root").agg(F.count("*").alias("c"))
    sizes = groups.groupBy("key").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.max("c").alias("most"), F.sum("c").alias("c"), F.count("*").alias("groups"))
    sizes = sizes.where("groups > 1").select("key", "main", parts_of("c").alias("parts"), F.ceil((F.col("c") - F.col("most")) / BLOCK).cast("int").alias("blocks"))
    mixed = members.drop("parts").join(sizes, "key")
    mixed = ws.cut(mixed.join(mixed.groupBy("node").agg(F.collect_set("key").alias("keys")), "node"), "mixed")
    deal = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    few = mixed.where("root <> main").withColumn("block", deal("blocks")).withColumn("part", every("parts")).alias("h")
    all_ = mixed.withColumn("part", deal("parts")).withColumn("block", every("blocks")).alias("m")
    near = (F.col("m.key") == F.col("h.key")) & (F.col("m.block") == F.col("h.block")) & (F.col("m.part") == F.col("h.part")) & may_be_alike()
    near &= (F.col("m.root") == F.col("m.main")) | (F.col("m.node") < F.col("h.node"))
    near &= F.col("m.key") == F.array_min(F.array_intersect("m.keys", "h.keys"))
    return all_.join(few.hint("merge"), near).select(F.least("m.node", "h.node").alias("a"), F.greatest("m.node", "h.node").alias("b")).distinct()


def grouped(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with root: the group of each node, itself if it has no link."""
    return rows.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def link_roots(sigs: DataFrame, docs: DataFrame, rounds: tuple[int, ...] = (1, 4)) -> DataFrame:
    """node, root: the groups that verified links make, for nodes with a link.

    In each bucket a head is compared with all other members, then four heads of those outside the first one's group, so a
    bucket of one group costs a pair for each member. Last, in each bucket that still holds several groups, all members are
    compared, by their sketches, with all of other groups: two groups may be linked by members that are nobody's head.
    """
    one = sigs.groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.min("ord").alias("ord"))
    one = ws.cut(one, "nodes")
    rows = one.select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key", parts_of("c").alias("parts"))
    members = ws.cut(rows.join(shared.hint("merge"), "key"), "shared").join(one.select("node", "n", "sketch", F.col("node").alias("root")).hint("merge"), "node")
    members = ws.cut(members, "members")
    texts = texts_of(one.select("node", "ord").join(members.select("node").distinct(), "node"), docs)
    columns = ["key", "parts", "node", "n", "root", "sketch"]
    roots, done, open_rows, everyone = None, None, members, members
    for heads in rounds:
        if done is not None:  # what no head of its bucket has found goes on, with the rest of its bucket
            seen = grouped(top.select("key", "node"), roots).select("key", "root").distinct()
            open_rows = ws.cut(grouped(open_rows, roots).join(seen, ["key", "root"], "left_anti").select(columns), "open")
            if open_rows.isEmpty():
                break
            members = ws.cut(grouped(members, roots).join(open_rows.select("key").distinct(), "key", "left_semi").select(columns), "members")
        top = ws.cut(heads_of(open_rows, heads), "heads")
        pairs = candidate_pairs(members, top)
        pairs = ws.cut(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        done = pairs if done is None else done.unionByName(pairs)
        roots = joined(roots, ws.cut(verified(pairs, texts), "links"))
    pairs = ws.cut(cross_pairs(grouped(everyone, roots).select(columns)).join(done, ["a", "b"], "left_anti"), "pairs")
    return roots if pairs.isEmpty() else joined(roots, ws.cut(verified(pairs, texts), "links"))


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The groups (node, root) that these links (a, b) make with groups found before, which stand in as links to their roots."""
    if roots is None:
        return components(links)
    if links.isEmpty():
        return roots
    return components(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each connected component, for nodes that have an edge.

    Large-star and small-star steps in turn: each node's larger neighbours, then its smaller ones, are hung on the least. The
    edges never grow in number, and the rounds grow as the logarithm of the components' size. They end once all edges are
    stars. What a step joins with is a table with the number of rows it will meet, so that a head's many neighbours are dealt
    over many tasks, whether it is less or greater than they, without counting them again.
    """
    e, old = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), []
    while True:
        end = lambda of, other, less: e.select(F.col(of).alias("v"), F.col(other).alias("m"), F.lit(less).alias("less"))  # noqa: B023, E731
        low = end("u", "v", 1).unionByName(end("v", "u", 0)).groupBy("v")
        low = low.agg(F.min("m").alias("m"), F.max(F.when(F.col("less") == 1, F.col("m"))).alias("most"), F.sum(1 - F.col("less")).alias("count"))
        low = ws.cut(low.withColumn("m", F.least("v", "m")), "low")
        if low.where("most <> m or most is not null and count > 0").isEmpty():
            ws.done(*old)
            return low.select(F.col("v").alias("node"), F.col("m").alias("root"))
        heads = low.where("count > 0")
        large = ws.cut(ws.salted_join(e, heads.select("v", "m"), "v", "u", counts=heads.select("v", "count")).select("u", F.col("m").alias("v")), "large")
        least = ws.cut(large.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"), F.count("*").alias("count")), "least")
        hung = least.select("u", F.col("m").alias("v"))
        if not least.where("m <> most").isEmpty():
            small = ws.salted_join(large, least.select("u", "m"), "u", "v", counts=least.select("u", "count")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            hung = ws.cut(small.where("u <> v").unionByName(hung).distinct(), "edges")
        ws.done(*old, low, large)
        e, old = hung, [least, hung]


def classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(ord and node of each row; node, count, root, class_id, head and n_texts of each text).

    root is the class, which null or repeated ids do not tell apart. head is its text of least ord, class_id that ord, n_texts
    the number of its texts, count that of a text's rows.
    """
    ws.small_batches(docs.sparkSession)
    sigs = ws.cut(signed(docs, bands, rows), "signatures")
    roots = link_roots(sigs, docs)
    of = sigs.groupBy("node").agg(F.min("ord").alias("ord"), F.count("*").alias("count")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of = ws.cut(of, "rooted")
    least = ws.cut(of.groupBy("root").agg(F.min(F.struct("ord", "node")).alias("least"), F.count("*").alias("n_texts")), "least")
    of = ws.salted_join(of, least, "root", "node", counts=least.select("root", F.col("n_texts").alias("count")))
    return sigs.select("ord", "node"), of.select("node", "count", "root", F.col("least.ord").alias("class_id"), F.col("least.node").alias("head"), "n_texts")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and n_texts (different texts in the class) of each row of docs (doc_id, text).

    class_id is the least doc_id of the class, which is connected by equal texts and by links; a document alike to none is its
    own class. Equal texts are one class at once; a null text is empty, all empty texts are one class, and a text without
    words is linked to none. Null ids count as the greatest. Repeated rows share a class. Unlike texts of one id, or without
    one, are classes of their own with the same class_id, and n_texts counts each class alone.
    """
    rows, of = classes(docs)
    sized = ws.cut(of.select("node", "count", "class_id", "n_texts"), "classes")
    back = lambda c: F.when(F.col(c) != ws.MAX_ID, F.col(c)).alias({"ord": "doc_id"}.get(c, c))
    return ws.salted_join(rows, sized.drop("count"), "node", "ord", counts=sized.select("node", "count")).select(back("ord"), back("class_id"), "n_texts")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, that stand for their class: the least doc_id's, then the least text's by hash; of equal rows one stays."""
    _, of = classes(docs)
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("__ord", ws.id_order()).withColumn("__node", F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)))
    heads = of.where("node = head").select(F.col("head").alias("__node"), F.col("class_id").alias("__ord"))
    return keyed.join(heads, ["__node", "__ord"], "left_semi").dropDuplicates(["__node"]).select(*names)
