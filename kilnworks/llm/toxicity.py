"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each coordinate has its own learning rate, and the L1 term keeps most weights at exactly zero, so the model is a short list of
hashed features and their weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.llm import bytestext as bt
from kilnworks.llm import workspace as ws

#: Labelled rows that the model is fitted on, at most: those of the least hashes of doc_id.
SAMPLE = 12_000
#: Hashed features, passes, and the optimiser's alpha, beta, lambda 1 and lambda 2.
DIMS, PASSES, ALPHA, BETA, L1, L2 = 1 << 20, 5, 1.0, 1.0, 3.0, 1.0
THRESHOLD = 0.3

#: Words are runs of ASCII letters and digits and of all bytes from 0x80 on, in lower case.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
OTHER = np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of each word, each pair of neighbours and each pair with a word between; with repeats."""
    data, offsets = bt.flat(texts)
    data = np.frombuffer(data.tobytes().translate(LOWER), dtype="uint8")
    starts, ends, counts = bt.words(data, offsets, OTHER)
    h, doc = bt.word_hashes(data, starts, ends), bt.doc_of(counts)
    found, of = [h], [doc]
    with np.errstate(over="ignore"):
        for gap, salt in ((1, bt.STEP), (2, bt.MIX_A)):
            if len(h) > gap:
                same = doc[gap:] == doc[:-gap]
                found.append(bt.mix(h[:-gap] * salt + h[gap:])[same])
                of.append(doc[gap:][same])
    return np.concatenate(of), (np.concatenate(found) & np.uint64(DIMS - 1)).astype("int64")


@dataclass
class Model:
    """Nonzero weights by feature, and the intercept; at most DIMS weights."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text; a feature counts once a text."""
        total = np.full(len(texts), self.bias)
        if len(self.index):
            dense = np.zeros(DIMS, dtype="float64")
            dense[self.index] = self.weight
            doc, feature = features(texts)
            used = dense[feature] != 0
            pair = np.unique(doc[used] * DIMS + feature[used])
            total += np.bincount(pair // DIMS, weights=dense[pair % DIMS], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, int]]) -> Model:
    """Fit on (distinct features, label), in this order each pass. Without both labels the model is a constant."""
    ones = sum(y for _, y in rows)
    if ones in (0, len(rows)):
        return Model(np.empty(0, "int64"), np.empty(0), 35.0 if ones else -35.0)
    z, n = np.zeros(DIMS + 1), np.zeros(DIMS + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == DIMS, 0.0, L1)  # the intercept is not shrunk
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(PASSES):
        for x, y in rows:
            at = np.append(x, DIMS)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(DIMS + 1))
    index = np.flatnonzero(w[:DIMS])
    return Model(index, w[index], float(w[DIMS]))


def held_out(doc_id: str = "doc_id"):
    """Is crc32 of the id's decimal text 2 modulo 4? A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents that are not held out.

    Labels with a null id or label are left out; of several labels of one id the greatest counts, and of several rows of one id
    the one of the least features. The sample's ids are the least by xxhash64; their number bounds the broadcast, the one
    fitting task and the driver's share, which is the model alone.
    """
    ws.small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    chosen = known.withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__text")).join(F.broadcast(chosen), "doc_id")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.pieces(batches, "__text"):
            doc, feature = features(batch.column("__text"))
            pair = np.unique(doc * DIMS + feature)
            at = np.searchsorted(pair, np.arange(batch.num_rows + 1) * DIMS)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array((pair % DIMS).astype("int32")))
            yield pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("doc_id"), batch.column("label"), lists], ["rank", "doc_id", "label", "features"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            lists = batch.column("features")
            flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, (rank, doc, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("rank", "doc_id", "label")), strict=True)):
                rows.append((rank, doc, flat[at[i] : at[i + 1]].astype("int64"), int(y > 0)))
        rows.sort(key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()))
        m = ftrl([(x, y) for *_, x, y in rows])
        yield pa.RecordBatch.from_pydict({"index": [m.index.tolist()], "weight": [m.weight.tolist()], "bias": [m.bias]}, schema=pa.schema([("index", pa.list_(pa.int64())), ("weight", pa.list_(pa.float64())), ("bias", pa.float64())]))

    lists = rows.mapInArrow(featurise, "rank long, doc_id long, label int, features array<int>")
    lists = lists.groupBy("rank", "doc_id", "label").agg(F.min("features").alias("features"))
    got = lists.repartition(1).mapInArrow(learn, "index array<long>, weight array<double>, bias double").collect()
    if not got:
        return ftrl([])
    return Model(np.array(got[0]["index"], dtype="int64"), np.array(got[0]["weight"]), got[0]["bias"])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold on), under these names, which replace columns of docs that
    have them; all others stay. No shuffle.

    A null or empty text has no feature and gets the intercept's score. Rows are scored one by one: repeated rows get equal
    scores, an empty table none, and a long text is read whole.
    """
    keep = [c for c in docs.columns if c not in names]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"`{names[0]}` double, `{names[1]}` int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.pieces(batches, "text"):
            p = sent.value.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(p), pa.array((p >= threshold).astype("int32"))], [*keep, *names])

    return docs.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)
