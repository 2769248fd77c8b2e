"""Substring dedup by compaction of the de Bruijn graph of word windows.

Edges of the graph are windows of k words, each from the node of its first k - 1 words to that of its last. A document is a
walk, and a place in a document names an edge or node: a source coordinate.

1. Runs of consecutive edges with one minimizer (the least hash among their inner m-word strings) go to that minimizer's task,
   where all equal edges meet. Each edge that also starts earlier becomes part of a piece: consecutive edges of a document
   that are, one by one, the consecutive edges of the walk where they came first.
2. Two pieces that share a node, and whose sources share it too, are one nonbranching path there: document and source walk on
   in step. Such pieces are joined into paths, which end where the walks part or meet (a branch) or the source changes.
3. The words of a path are compared at its two coordinates, by a 128-bit digest of them. Should hashes have led astray
   anywhere, all is done again with other hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from kilnworks.llm import bytestext as bt
from kilnworks.llm import workspace as ws

#: Words in a window and in a minimizer; bytes kept of an edge's hash beside the 8 of its minimizer's.
WINDOW, INNER, EDGE = 20, 5, 5
#: Documents looked at for strings that would make bad minimizers, and the share of them that makes a string one.
LOOKED_AT, COMMON = 4096, 0.01


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n, width = len(x) - w + 1, 1
    while 2 * width <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:n], x[w - width : w - width + n])


def common_strings(docs: DataFrame, inner: int, seed: int = 0) -> np.ndarray:
    """Hashes of word strings that many documents hold, from about LOOKED_AT of them: they come last in the order of minimizers.

    This only balances the shuffle. Any order of minimizers gives the same result, as all tasks use the same one.
    """
    some = docs.select("__text").sample(fraction=min(1.0, LOOKED_AT / max(1, docs.count())), seed=7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.pieces(batches, "__text"):
            data, offsets = bt.flat(batch.column("__text"))
            starts, ends, counts = bt.words(data, offsets)
            g = bt.ngrams(bt.word_hashes(data, starts, ends, seed), inner)
            doc = bt.doc_of(counts)
            own = doc[: len(g)] == doc[inner - 1 : inner - 1 + len(g)] if len(g) else np.empty(0, bool)
            order = np.lexsort((doc[: len(g)][own], g[own]))
            h, d = g[own][order], doc[: len(g)][own][order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            found, n = np.unique(h[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view("int64")), pa.array(n)], ["h", "n"])

    counts = some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= max(8, int(COMMON * LOOKED_AT)))
    return np.sort(np.array([r.h for r in counts.orderBy(F.desc("n"), "h").limit(1 << 16).collect()], dtype="int64").view("uint64"))


#: ord, th, start and n before a row's edges: big-endian, signs flipped, so that the bytes sort as the numbers do.
FIELDS = np.dtype([("ord", ">u8"), ("th", ">u8"), ("start", ">u4"), ("n", ">u4")])
SIGN = np.uint64(1 << 63)


def packed(ord_: np.ndarray, th: np.ndarray, start: np.ndarray, n: np.ndarray, edges: np.ndarray, held: np.ndarray) -> pa.Array:
    """A binary of each run: its fields, then EDGE bytes of each of its ``held`` edges."""
    rows = np.empty(len(start), dtype=FIELDS)
    rows["ord"], rows["th"], rows["start"], rows["n"] = ord_.view("uint64") ^ SIGN, th.view("uint64") ^ SIGN, start, n
    ends = np.cumsum(FIELDS.itemsize + EDGE * held)
    out = np.empty(int(ends[-1]), dtype="uint8")
    front = np.zeros(len(out), dtype=bool)
    front[((ends - FIELDS.itemsize - EDGE * held)[:, None] + np.arange(FIELDS.itemsize)).ravel()] = True
    out[front] = rows.view("uint8")
    out[~front] = np.ascontiguousarray(edges.astype("<u8").view("uint8").reshape(-1, 8)[:, :EDGE]).ravel()
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.concatenate([[0], ends]).astype("int32").tobytes()), pa.py_buffer(out.tobytes())])


def unpacked(runs: pa.Array) -> tuple[np.ndarray, ...]:
    """(ord, th, start, n, edges in all, edges of each run)."""
    raw, offsets = bt.flat(runs)
    front = np.zeros(len(raw), dtype=bool)
    front[(offsets[:-1, None] + np.arange(FIELDS.itemsize)).ravel()] = True
    rows = raw[front].view(FIELDS)
    edges = np.zeros((len(raw) - int(front.sum())) // EDGE * 8, dtype="uint8").reshape(-1, 8)
    edges[:, :EDGE] = raw[~front].reshape(-1, EDGE)
    ord_, th = ((rows[c].astype("uint64") ^ SIGN).view("int64") for c in ("ord", "th"))
    return ord_, th, rows["start"].astype("int64"), rows["n"].astype("int64"), edges.view("<u8").ravel(), (np.diff(offsets) - FIELDS.itemsize) // EDGE


def paths(docs: DataFrame, common: np.ndarray, window: int, inner: int, seed: int) -> DataFrame:
    """Rows key, run: n consecutive edges with one minimizer from word ``start`` of document (ord, th).

    Edges that already came earlier in the same piece of a task's input, word by word, are settled: their runs hold no edges
    and have a key that spreads them. So a passage that every document holds is sent once a piece, not once a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.pieces(batches, "__text", 1 << 20):
            ord_, th = batch.column("ord").to_numpy(), batch.column("th").to_numpy()
            order = np.lexsort((th, ord_))
            texts = batch.column("__text").take(pa.array(order))
            ord_, th = ord_[order], th[order]
            data, offsets = bt.flat(texts)
            starts, ends, counts = bt.words(data, offsets)
            if len(starts) < window:
                continue
            known, _, word_id = bt.Words.group(data, starts, ends, seed)
            h = known[word_id]
            doc = bt.doc_of(counts)
            n = len(h) - window + 1
            inside = doc[:n] == doc[window - 1 :]
            edge = bt.ngrams(h, window)
            g = bt.ngrams(h, inner)
            if len(common):
                near = np.minimum(np.searchsorted(common, g), len(common) - 1)
                rank = np.where(common[near] == g, g | SIGN, g >> np.uint64(1))
            else:
                rank = g >> np.uint64(1)
            low = sliding_min(rank, window - inner + 1)[:n]
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            doc, edge, low = doc[at], edge[at], low[at]
            word = at - np.concatenate([[0], np.cumsum(counts)[:-1]])[doc]
            by_edge = np.argsort(edge, kind="stable")  # at ascends in (ord, th, word)
            equal = np.concatenate([[False], edge[by_edge[1:]] == edge[by_edge[:-1]]])
            later, first = by_edge[equal], by_edge[np.flatnonzero(~equal)[np.cumsum(~equal) - 1]][equal]
            for k in range(window):
                same = word_id[at[later] + k] == word_id[at[first] + k]
                later, first = later[same], first[same]
            again = np.zeros(len(at), dtype=bool)
            again[later] = True
            # equal id and text is one document, not a repetition: the first row's windows stand for both
            same = np.concatenate([[False], (ord_[1:] == ord_[:-1]) & (th[1:] == th[:-1])])
            keep = ~same[doc]
            doc, edge, low, word, again = doc[keep], edge[keep], low[keep], word[keep], again[keep]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (again[1:] != again[:-1]) | (~again[1:] & (low[1:] != low[:-1]))
            first = np.flatnonzero(new)
            if not len(first):
                continue
            size = np.diff(np.append(first, len(doc)))
            settled = again[first]
            key = np.where(settled, bt.mix(edge[first]), low[first]).view("int64")
            runs = packed(ord_[doc[first]], th[doc[first]], word[first], size, edge[~again], np.where(settled, 0, size))
            yield pa.RecordBatch.from_arrays([pa.array(key), runs], ["key", "run"])

    return docs.mapInArrow(run, "key long, run binary")


PIECE = "ord long, th long, start int, n int, s_ord long, s_th long, s_start int"


def repeated(rows: DataFrame) -> DataFrame:
    """Pieces: n edges from (ord, th, start) on that came first from (s_ord, s_th, s_start) on; without a source if settled.

    A partition is sorted by minimizer and source coordinates, so within a minimizer an edge seen before is a repetition; only
    the distinct edges of the minimizer at hand, and where they came first, are held.
    """
    dealt = rows.repartition(ws.partitions(rows.sparkSession), "key").sortWithinPartitions("key", "run")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: int | None = None
        none = np.empty(0, "int64")
        seen = (np.empty(0, "uint64"), none, none, none)
        upto = (0, 0, 0)  # ord, th and end of the edges of the last document of the minimizer at hand
        for batch in batches:
            key = batch.column("key").to_numpy()
            ord_, th, start, n, edge, count = unpacked(batch.column("run"))
            if not len(key):
                continue
            settled = count == 0
            row = np.repeat(np.arange(len(key)), count)
            pos = start[row] + bt.within(count)
            if len(edge):
                # rows of one id and text are one document: an edge at the same coordinates again is dropped
                live = np.flatnonzero(~settled)
                head = np.ones(len(live), dtype=bool)
                head[1:] = (key[live[1:]] != key[live[:-1]]) | (ord_[live[1:]] != ord_[live[:-1]]) | (th[live[1:]] != th[live[:-1]])
                ends = (start + n)[live]
                carried = upto[2] if key[live[0]] == last and (ord_[live[0]], th[live[0]]) == upto[:2] else 0
                lift = np.cumsum(head) << 33
                reach = np.maximum.accumulate(np.concatenate([[max(ends[0], carried)], ends[1:]]) + lift) - lift
                before = np.where(head, 0, np.concatenate([[0], reach[:-1]]))
                before[0] = carried
                fresh_from = np.zeros(len(key), dtype="int64")
                fresh_from[live] = before
                upto = (int(ord_[live[-1]]), int(th[live[-1]]), int(reach[-1]))
                stay = pos >= fresh_from[row]
                row, pos, edge = row[stay], pos[stay], edge[stay]
            group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            value = (group[row].astype("uint64") << np.uint64(8 * EDGE)) | edge
            order = np.argsort(value, kind="stable")
            v = value[order]
            head = np.ones(len(v), dtype=bool)
            head[1:] = v[1:] != v[:-1]
            origin = np.empty(len(v), dtype="int64")  # where each edge of the minimizer stands first
            origin[order] = order[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(v) else order
            again = origin != np.arange(len(v))
            s_ord, s_th, s_pos = ord_[row[origin]], th[row[origin]], pos[origin]
            own = np.flatnonzero(group[row] == 0) if key[0] == last else none
            if len(own) and len(seen[0]):
                at = np.minimum(np.searchsorted(seen[0], edge[own]), len(seen[0]) - 1)
                here = seen[0][at] == edge[own]
                own, at = own[here], at[here]
                again[own] = True
                s_ord[own], s_th[own], s_pos[own] = seen[1][at], seen[2][at], seen[3][at]
            live = np.flatnonzero(~settled)
            if len(live):
                if key[live[-1]] != last:
                    seen, last = (np.empty(0, "uint64"), none, none, none), int(key[live[-1]])
                own = np.flatnonzero((key[row] == last) & ~again)
                now = (edge[own], ord_[row[own]], th[row[own]], pos[own])
                now = tuple(np.concatenate([x, y]) for x, y in zip(seen, now, strict=True))
                by = np.argsort(now[0], kind="stable")
                seen = tuple(x[by] for x in now)
            new = np.ones(len(row), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1) | ~again[:-1] | (s_ord[1:] != s_ord[:-1]) | (s_th[1:] != s_th[:-1]) | (s_pos[1:] != s_pos[:-1] + 1)
            first = np.flatnonzero(new & again)
            size = np.diff(np.append(np.flatnonzero(new), len(row)))[again[np.flatnonzero(new)]]
            r, k = row[first], int(settled.sum())
            if k + len(first):
                sources = [pa.array(np.concatenate([np.zeros(k, "int64"), x[first]]), t, mask=np.arange(k + len(first)) < k) for x, t in ((s_ord, pa.int64()), (s_th, pa.int64()), (s_pos, pa.int32()))]
                own = [pa.array(np.concatenate([x[settled], y]), t) for x, y, t in ((ord_, ord_[r], pa.int64()), (th, th[r], pa.int64()), (start, pos[first], pa.int32()), (n, size, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*own, *sources], [c.split()[0] for c in PIECE.split(", ")])

    return dealt.mapInArrow(run, PIECE)


def compacted(pieces: DataFrame) -> DataFrame:
    """Pieces with a source, those that follow one another on document and source alike joined into paths.

    On a diagonal (a document, a source, the distance between the two) pieces never overlap. A piece that ends no other at the node where it
    begins is a path's head, and so with tails; the k-th head and the k-th tail of a diagonal are one path's.
    """
    diagonal = ["ord", "th", "s_ord", "s_th", "shift"]
    p = pieces.select("ord", "th", "s_ord", "s_th", (F.col("s_start") - F.col("start")).alias("shift"), "start", (F.col("start") + F.col("n")).alias("stop"))
    heads = p.join(p.select(*diagonal, F.col("stop").alias("start")), [*diagonal, "start"], "left_anti")
    tails = p.join(p.select(*diagonal, F.col("start").alias("stop")), [*diagonal, "stop"], "left_anti")
    nth = lambda c: F.row_number().over(W.partitionBy(*diagonal).orderBy(c)).alias("nth")
    both = heads.select(*diagonal, "start", nth("start")).join(tails.select(*diagonal, "stop", nth("stop")), [*diagonal, "nth"])
    return both.select("ord", "th", "start", (F.col("stop") - F.col("start")).alias("n"), "s_ord", "s_th", (F.col("start") + F.col("shift")).alias("s_start"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__text"), ws.id_order().alias("ord"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, inner: int = INNER, seed: int = 0) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the remaining words joined by one space) of each row of docs (doc_id, text).

    A word goes if a window that covers it has a word sequence that also starts earlier: in a smaller doc_id, or in the same
    document before it. A null text has no words, a null doc_id comes last, several texts of one id follow in the order of their
    hashes, and rows of one id and text are one document, each with the same result. Windows are judged on the input.
    """
    ws.small_batches(docs.sparkSession)
    own = keyed(docs)
    common = common_strings(own, inner, seed)
    pieces = ws.cut(repeated(paths(own, common, window, inner, seed)), "pieces")
    found = ws.cut(compacted(pieces.where("s_ord is not null")).unionByName(pieces.where("s_ord is null")), "paths")
    out = ws.cut(removed(own, found, window), "removed")
    # a path's words at its source and wherever it comes again must be the same: equal coordinates, equal digests
    proofs = out.select(F.explode("proofs").alias("p")).select("p.*").groupBy("ord", "th", "start", "n").agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
    if not proofs.where("a <> b").isEmpty():
        return dedup_substrings(docs, window, inner, seed + 1)
    return out.select("doc_id", "n_words", "n_removed", "kept")


def removed(own: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept and proofs of each document: (ord, th, start, n, digest) of the words of each of its
    paths, under the coordinates of their source, and of each path that has its source here."""
    here = found.groupBy("ord", "th").agg(F.collect_set(F.struct("start", "n", "s_ord", "s_th", "s_start")).alias("spans"))
    asked = found.where("s_ord is not null").groupBy(F.col("s_ord").alias("ord"), F.col("s_th").alias("th")).agg(F.collect_set(F.struct(F.col("s_start").alias("start"), "n")).alias("asked"))
    lists = here.join(asked, ["ord", "th"], "full")
    joined = own.join(lists, ["ord", "th"], "left").select("doc_id", "ord", "th", "__text", "spans", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.pieces(batches, "__text"):
            data, offsets = bt.flat(batch.column("__text"))
            raw = data.tobytes()
            starts, ends, counts = bt.words(data, offsets)
            base = np.concatenate([[0], np.cumsum(counts)])
            lists = batch.column("spans")
            doc = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            cover = np.zeros(len(starts) + 1, dtype="int64")
            if len(doc):
                a = base[doc] + flat.field("start").to_numpy()
                np.add.at(cover, a, 1)
                np.add.at(cover, a + flat.field("n").to_numpy() + window - 1, -1)
            gone = np.cumsum(cover[:-1]) > 0
            lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[base])
            kept, proofs = [], []
            for i, (ord_, th, spans, asked) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("ord", "th", "spans", "asked")), strict=True)):
                x = slice(base[i], base[i + 1])
                words = [raw[p:q] for p, q in zip(starts[x].tolist(), ends[x].tolist(), strict=True)]
                digest = lambda s, n, words=words: hashlib.blake2b(b" ".join(words[s : s + n + window - 1]), digest_size=16).digest()
                proofs.append(
                    [(s["s_ord"], s["s_th"], s["s_start"], s["n"], digest(s["start"], s["n"])) for s in spans or () if s["s_ord"] is not None]
                    + [(ord_, th, s["start"], s["n"], digest(s["start"], s["n"])) for s in asked or ()]
                )
                kept.append(b" ".join([w for w, g in zip(words, gone[x].tolist(), strict=True) if not g]) if lost[i] else b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([[dict(zip(names, p, strict=True)) for p in x] for x in proofs], proof)],
                ["doc_id", "n_words", "n_removed", "kept", "proofs"],
            )

    names = ["ord", "th", "start", "n", "digest"]
    proof = pa.list_(pa.struct(list(zip(names, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()], strict=True))))
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, proofs array<struct<ord:long,th:long,start:int,n:int,digest:binary>>")
