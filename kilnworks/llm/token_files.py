"""Token ids in fixed-width bit-packed files.

A file holds the ids of consecutive documents, each id in the fewest bits that the vocabulary needs. Its image is

    magic 8 bytes | bits u32 | block u32 | bucket u32 | member u32 | documents u64 | ids u64, all big-endian, then little-endian
    document ids i64 each | 1 byte each: has the document an id | ids of each document u64
    block offsets u64, one more than blocks | blocks, each on a byte border

and a line end, which is the record mark of Spark's text writer: so Spark's committer publishes the files (a lost executor's
are simply written again) in any store that it reaches. Beside them a directory table tells each file's first id, so any id is
found from its number alone, by seeking in its file and unpacking one block.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from kilnworks.llm import bytestext as bt
from kilnworks.llm import workspace as ws
from kilnworks.llm.vocab import CachedBpe

MAGIC = b"KWTOKENS"
HEAD = struct.Struct(">8sIIIIQQ")


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits % 8 == 0:
        return np.ascontiguousarray(ids.astype("<u4").view("uint8").reshape(-1, 4)[:, : bits // 8]).tobytes()
    return np.packbits((ids.astype("uint32")[:, None] >> np.arange(bits, dtype="uint32")) & 1 > 0, bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(data, dtype="uint8")
    if bits % 8 == 0:
        wide = np.zeros((n, 4), dtype="uint8")
        wide[:, : bits // 8] = raw[: n * bits // 8].reshape(n, bits // 8)
        return wide.view("<u4").ravel()
    flags = np.unpackbits(raw, count=n * bits, bitorder="little").reshape(n, bits)
    return flags @ (np.uint32(1) << np.arange(bits, dtype="uint32"))


def image(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, bits: int, block: int, bucket: int = 0, member: int = 0) -> bytes:
    """A member with these documents; an id that needs more bits is an error."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError("an id needs more bits")
    blocks = [pack(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in blocks])]).astype("<u8")
    body = [np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(), np.array([x is not None for x in doc_ids], dtype="uint8").tobytes(), np.asarray(counts, dtype="<u8").tobytes(), offsets.tobytes(), *blocks]
    return b"".join([HEAD.pack(MAGIC, bits, block, bucket, member, len(doc_ids), len(ids)), *body])


class Member:
    """A member read from ``at``, a function of (place, length) that gives bytes of its image.

    Only the head and the lists are read at once; ids(start, n) reads and unpacks the blocks that it needs.
    """

    def __init__(self, at: Callable[[int, int], bytes | memoryview]):
        self.at = at
        magic, self.bits, self.block, self.bucket, self.member, docs, self.n = HEAD.unpack(at(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("no token member")
        blocks = -(-self.n // self.block)
        lists = at(HEAD.size, 17 * docs + 8 * (blocks + 1))
        known = np.frombuffer(lists, "uint8", docs, 8 * docs)
        self.doc_ids = [i if k else None for i, k in zip(np.frombuffer(lists, "<i8", docs).tolist(), known, strict=True)]
        self.counts = np.frombuffer(lists, "<u8", docs, 9 * docs).astype("int64")
        self.offsets = np.frombuffer(lists, "<u8", blocks + 1, 17 * docs).astype("int64") + HEAD.size + len(lists)

    def ids(self, start: int = 0, n: int | None = None) -> np.ndarray:
        stop = self.n if n is None else min(self.n, start + n)
        if stop <= start:
            return np.empty(0, dtype="uint32")
        first, last = start // self.block, (stop - 1) // self.block
        base = int(self.offsets[first])
        data = memoryview(self.at(base, int(self.offsets[last + 1]) - base))
        got = [unpack(data[self.offsets[b] - base : self.offsets[b + 1] - base], min(self.block, self.n - b * self.block), self.bits) for b in range(first, last + 1)]
        return np.concatenate(got)[start - first * self.block : stop - first * self.block].astype("uint32")


def in_memory(data: bytes | memoryview) -> Callable[[int, int], memoryview]:
    view = memoryview(data)
    return lambda at, n: view[at : at + n]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids with the end id after each text, ids of each) for pieces of the batches; the column is __text."""
    bpe = CachedBpe.of(path)
    for batch in bt.pieces(batches, "__text"):
        ids, n = bpe.ids(batch.column("__text"))
        yield batch, np.insert(ids, np.cumsum(n), np.uint32(end)), n + 1


def in_order(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, __text and the range bucket, each partition in ascending (bucket, doc_id, text); one shuffle of the texts."""
    ws.small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__text"), ws.id_order().alias("ord"))
    return ws.by_ranges(own, parts).sortWithinPartitions("bucket", "ord", "__text").select("bucket", "doc_id", "__text")


def write_tokens(docs: DataFrame, tokenizer: str, end: int, vocabulary: int, path: str, room: int = 1 << 20, block: int = 4096) -> None:
    """Encode docs (doc_id, text) and write files and their directory under path, in ascending doc_id order.

    A null text is empty, a null id comes last, equal ids lie in the order of their texts, repeated rows are written each. A
    file is closed at ``room`` ids, so only one very long text makes a larger one. An empty table makes an empty directory.
    """
    bits = bits_for(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, member = None, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal member, held
            ids, counts = np.concatenate([x[2] for x in held]), np.concatenate([x[1] for x in held])
            data = image([i for x in held for i in x[0]], counts, ids, bits, block, bucket, member)
            member, held = member + 1, []
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["image"])

        for batch, ids, counts in encoded(batches, tokenizer, end):
            of = batch.column("bucket").to_numpy()
            upto = np.concatenate([[0], np.cumsum(counts)])
            names = batch.column("doc_id").to_pylist()
            at = 0
            while at < len(of):
                if of[at] != bucket:
                    if held:
                        yield close()
                    bucket, member = int(of[at]), 0
                left = room - sum(len(x[2]) for x in held)
                to = max(at + 1, min(int(np.searchsorted(upto, upto[at] + left)), int(np.searchsorted(of, bucket, side="right"))))
                held.append((names[at:to], counts[at:to], ids[upto[at] : upto[to]]))
                if sum(len(x[2]) for x in held) >= room:
                    yield close()
                at = to
        if held:
            yield close()

    # the text writer writes a string's bytes as they are
    images = in_order(docs).mapInArrow(run, "image binary").select(F.col("image").cast("string").alias("value"))
    images.write.option("maxRecordsPerFile", 1).text(f"{path}/files")
    directory(docs.sparkSession, path).write.parquet(f"{path}/directory")


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/files")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """file, first (ids before it, over all files in order), n_ids and n_docs of each file, from the heads alone."""
    number = lambda at, n: F.conv(F.hex(F.substring("content", at + 1, n)), 16, 10).cast("long")
    fields = {"bucket": (16, 4), "member": (20, 4), "n_docs": (24, 8), "n_ids": (32, 8)}
    found = ws.cut(files(spark, path).select(F.col("path").alias("file"), *(number(*x).alias(k) for k, x in fields.items())), "members")
    # a row a range of ids, and there are three ranges a shuffle partition: the broadcast is bounded
    base = ws.bucket_offsets(found.groupBy("bucket").agg(F.sum("n_ids").alias("n")), "n")
    before = F.coalesce(F.sum("n_ids").over(W.partitionBy("bucket").orderBy("member").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("before", before).join(F.broadcast(base), "bucket").select("file", (F.col("base") + F.col("before")).alias("first"), "n_ids", "n_docs")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it, over all files in order), n_tokens and ids (little-endian u32) of each document."""
    ws.small_batches(spark)
    first = spark.read.parquet(f"{path}/directory").select("file", "first")
    placed = files(spark, path).select(F.col("path").alias("file"), "content").join(first, "file").select("first", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for first, data in zip(batch.column("first").to_pylist(), batch.column("content"), strict=True):
                    m = Member(in_memory(data.as_buffer()))
                    upto = np.concatenate([[0], np.cumsum(m.counts)])
                    raw = pa.Array.from_buffers(pa.large_binary(), len(m.counts), [None, pa.py_buffer((4 * upto).astype("int64").tobytes()), pa.py_buffer(m.ids().astype("<u4").tobytes())])
                    out = pa.RecordBatch.from_arrays([pa.array(m.doc_ids, pa.int64()), pa.array(first + upto[:-1]), pa.array(m.counts), raw.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                    yield from (out.slice(a, 1000) for a in range(0, out.num_rows, 1000))
        finally:
            bt.release()

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


class Reader:
    """ids(start, n) of files under path, by seeking: the directory tells the members, of which only blocks are read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.directory = spark, spark.read.parquet(f"{path}/directory")

    def _stretch(self, file: str) -> Callable[[int, int], bytes]:
        """(place, length) -> bytes of a file in any store that Spark reaches."""
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        target = jvm.org.apache.hadoop.fs.Path(file)
        fs = target.getFileSystem(sc._jsc.hadoopConfiguration())

        def at(place: int, n: int) -> bytes:
            stream = fs.open(target)
            try:
                stream.seek(place)
                return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
            finally:
                stream.close()

        return at

    def ids(self, start: int, n: int) -> np.ndarray:
        """The ids from number ``start`` on, ``n`` of them or as many as there are."""
        touched = self.directory.where((F.col("first") < start + n) & (F.col("first") + F.col("n_ids") > start)).orderBy("first").collect()
        out = [np.empty(0, "uint32")]
        for row in touched:
            read = self._stretch(row["file"])
            m = Member(read)
            a = max(0, start - row["first"])
            out.append(m.ids(a, start + n - row["first"] - a))
        return np.concatenate(out)
