"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least hash of its s-mers lies at its first or last s-mer. Whether it is one
depends on the k-mer alone, so an edit elsewhere never moves an anchor. A fingerprint keeps the anchors with the least hashes,
each with its position; two fingerprints are compared by the anchors that they share at a consistent shift.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.llm import bytestext as bt
from kilnworks.llm import workspace as ws

#: Code points in a k-mer and in its inner s-mers (k is twice s, so that two s-mers make a k-mer); anchors kept.
K, S, KEPT = 16, 8, 64


def anchors(texts: list[str], kept: int = KEPT) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the hashes (ascending, u32) and positions of its kept anchors.

    A text without a syncmer (a short one) has one anchor, the hash of all of it; an empty text has none.
    """
    sizes = np.array([len(t) for t in texts], dtype="int64")
    ends = np.cumsum(sizes)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="uint32").astype("uint64")
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, "uint32"), np.empty(0, "int64"))] * len(texts)
    with np.errstate(over="ignore"):
        if len(codes) >= K:
            g, p = (codes + np.uint64(1)) * bt.BASE, bt.STEP
            for width in (1, 2, 4):
                g = g[: len(g) - width] * p + g[width:]
                p = p * p
            g = bt.mix(g)
            low = np.minimum(g[:-1], g[1:])
            low = np.minimum(low[:-2], low[2:])
            low = np.minimum(low[:-4], low[4:])
            n = len(codes) - K + 1
            low = np.minimum(low[:n], g[S : S + n])
            at = np.flatnonzero((g[:n] == low) | (g[S : S + n] == low))
            of = np.searchsorted(ends, at, side="right")
            inside = at + K <= ends[of]
            at, of = at[inside], of[inside]
            h = (bt.mix(g[at] * bt.BASE + g[at + S]) >> np.uint64(32)).astype("uint32")
            order = np.argsort((of.astype("uint64") << np.uint64(32)) | h, kind="stable")
            at, of, h = at[order], of[order], h[order]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
            at, of, h = at[new], of[new], h[new]
            first = np.searchsorted(of, np.arange(len(texts) + 1))
            for i in np.flatnonzero(np.diff(first)).tolist():
                a = first[i]
                b = min(first[i + 1], a + kept)
                out[i] = h[a:b], at[a:b] - (ends[i] - sizes[i])
    for i in np.flatnonzero(sizes).tolist():
        if not len(out[i][0]):
            out[i] = np.array([int(hashlib.blake2b(texts[i].encode(), digest_size=4).hexdigest(), 16)], dtype="uint32"), np.zeros(1, "int64")
    return out


def as_string(anchor: tuple[np.ndarray, np.ndarray]) -> str:
    """8 hexadecimal digits of each hash and 8 of its position."""
    return np.stack([anchor[0], anchor[1].astype("uint32")], axis=1).astype(">u4").tobytes().hex()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], kept: int = KEPT) -> float:
    """0 to 1: of the least hashes of both, the share that both have at a consistent shift. Two empty ones are alike."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    union = len(a[0]) + len(b[0]) - len(both)
    if union > kept:  # only up to the kept-th least hash of the union is it known whether both have it
        limit = np.partition(np.concatenate([a[0], np.setdiff1d(b[0], both, assume_unique=True)]), kept - 1)[kept - 1]
        i, j, union = i[both <= limit], j[both <= limit], kept
    if not len(i):
        return 0.0
    shift = b[1][j] - a[1][i]
    room = max(2 * K, int(max(a[1].max(), b[1].max())) // 8)
    return float((np.abs(shift - np.median(shift)) <= room).sum() / union)


def edited(text: str, after: str) -> str:
    """The last quarter of the code points replaced by as many of the next text's first."""
    cut = len(text) // 4
    return text[: len(text) - cut] + after[:cut]


def fingerprint_documents(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of each text of docs (doc_id, text), of its edited form, and their likenesses.

    The next document is that of the next larger doc_id, after the last the first; a null id comes last, rows of one id follow
    in the order of their texts, and a lone document is its own next. A null text is empty. One shuffle, of the texts by
    ranges of ids; each range also gets the first document of the next one, so no task waits for another.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("__text"), ws.id_order().alias("ord"))
    n = parts or ws.partitions(docs.sparkSession)
    bounds = ws.id_bounds(own.select("ord"), "ord", 3 * n)
    firsts = sorted((r.bucket, r.ord) for r in own.select("ord").groupBy(ws.bucket_of(bounds, F.col("ord")).alias("bucket")).agg(F.min("ord").alias("ord")).collect())
    # a row a range; the range before each one gets its first document as a guest
    guest_of = {o: firsts[i - 1][0] for i, (_, o) in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def places(x: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, x.to_numpy().astype("float64"), side="right")
        return pd.Series([[2 * b, 2 * guest_of[o] + 1] if o in guest_of else [2 * b] for b, o in zip(at.tolist(), x.tolist(), strict=True)])

    placed = own.withColumn("place", F.explode(places("ord"))).withColumn("bucket", F.expr("place div 2"))
    placed = placed.repartition(n, "bucket").sortWithinPartitions("bucket", "place", "ord", "__text").select("place", "doc_id", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int | None, str]] = []  # the last document, which waits for the next one
        for batch in bt.pieces(batches, "__text", 2 << 20):
            rows = held + list(zip(batch.column("place").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("__text").to_pylist(), strict=True))
            held = rows[-1:]
            pairs = [i for i in range(len(rows) - 1) if rows[i][0] % 2 == 0 and rows[i][0] // 2 == rows[i + 1][0] // 2]
            if not pairs:
                continue
            changed = [edited(rows[i][2], rows[i + 1][2]) for i in pairs]
            found = anchors([r[2] for r in rows] + changed)
            plain, other = found[: len(rows)], found[len(rows) :]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][1] for i in pairs], pa.int64()),
                    pa.array([len(rows[i][2]) for i in pairs], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
                    pa.array([as_string(plain[i]) for i in pairs]),
                    pa.array([as_string(x) for x in other]),
                    pa.array([likeness(plain[i], x) for i, x in zip(pairs, other, strict=True)]),
                    pa.array([likeness(plain[i], plain[i + 1]) for i in pairs]),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return placed.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
