"""Order-preserving packing by dynamic programming.

Documents stand in ascending doc_id order in one stream of tokens for each range of ids. Windows of the stream become
sequences. f(j), the least cost of a stream cut at candidate j, is the least f(i) + padding of (i, j) + penalty of a cut at j;
as padding is linear in the window's length, f(i) + position(i) over the reach of a window is a sliding minimum,
which a monotone queue keeps. Windows of a power of two are not padded: each of their few possible beginnings is tried too.
Cuts stand after documents and sentences alone, but for sentences that are longer than a sequence.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kilnworks.llm.token_files import encoded, in_order
from kilnworks.llm.workspace import MAX_ID

#: Cost in tokens of a cut after a sentence, of one elsewhere in a text, and of any sequence.
SENTENCE, INSIDE, SEQUENCE = 2, 32, 8
#: Tokens between candidate cuts in a sentence that is longer than a sequence.
GAP = 64


def candidates(ends: np.ndarray, docs: np.ndarray, total: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that may be cut, 0 and total included, and their penalties. ends: after sentences; docs: after documents."""
    at = np.union1d(np.union1d(ends, docs), [0, total])
    long = np.flatnonzero(np.diff(at) > width)
    inside = [np.arange(a + min(GAP, width), b, min(GAP, width)) for a, b in zip(at[long].tolist(), at[long + 1].tolist(), strict=True)]
    penalty = np.full(len(at), SENTENCE)
    penalty[np.searchsorted(at, docs)] = 0
    penalty[[0, -1]] = 0
    if inside:
        more = np.concatenate(inside)
        place = np.searchsorted(at, more)
        at, penalty = np.insert(at, place, more), np.insert(penalty, place, INSIDE)
    return at, penalty


def best_cuts(at: np.ndarray, penalty: np.ndarray, width: int) -> np.ndarray:
    """Positions of the cheapest cuts, 0 and the end included."""
    n = len(at)
    exact: list[tuple[int, ...]] = [()] * n  # candidates a power of two before each one
    for p in (1 << k for k in range((width - 1).bit_length())):
        i = np.searchsorted(at, at - p)
        for j in np.flatnonzero((at[i] == at - p) & (at >= p)).tolist():
            exact[j] += (int(i[j]),)
    pos, pen = at.tolist(), penalty.tolist()
    cost, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f + position, candidate)
    for j in range(1, n):
        p = pos[j]
        while pos[queue[0][1]] < p - width:
            queue.popleft()
        low, i = queue[0]
        low += width - p
        for k in exact[j]:
            if cost[k] < low:
                low, i = cost[k], k
        low += pen[j] + SEQUENCE
        cost[j], back[j] = low, i
        low += p
        while queue and queue[-1][0] >= low:
            queue.pop()
        queue.append((low, j))
    out = [n - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return at[out[::-1]]


def pack_stream(ids: np.ndarray, sizes: np.ndarray, sentence_end: np.ndarray, width: int) -> np.ndarray:
    """Cuts of the ids of these documents into sequences, 0 and the end included."""
    docs = np.cumsum(sizes)
    return best_cuts(*candidates(np.flatnonzero(sentence_end[ids]) + 1, docs, int(docs[-1]), width), width)


def padded(length: int, width: int = 2048) -> int:
    """What a sequence is padded to: width, except at a power of two."""
    return length if length & (length - 1) == 0 else width


@functools.cache
def sentence_ends(path: str) -> np.ndarray:
    """For each id of a byte-level vocabulary: does its text end a sentence or a line?"""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    n = tok.get_vocab_size()
    return np.array([x.rstrip(" \"')").endswith((".", "!", "?")) or "\n" in x for x in tok.decode_batch([[i] for i in range(n)], skip_special_tokens=False)])


def pack_documents(docs: DataFrame, tokenizer: str, end: int, width: int = 2048, stretch: int = 1 << 19) -> DataFrame:
    """Pieces of docs (doc_id, text) in sequences of at most ``width`` tokens.

    Columns: doc_id, start (its document's ids before it), length, ids (little-endian u32), doc_tokens, sequence_id, offset.
    Each id of each document lies in one piece. A null or empty text is its end id alone, a null doc_id comes last, equal rows
    are packed one after the other. The stream of a range is solved in stretches of about ``stretch`` tokens; the last window of
    each is solved again with the next, so memory is bounded by that and the longest text, and only a range's end may be padded
    much. One shuffle, of the texts by ranges of ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = sentence_ends(tokenizer)
        bucket, made, done = None, 0, 0  # done: ids of the first held document that are packed already
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def close(last: bool) -> pa.RecordBatch:
            nonlocal made, done, held
            names = np.concatenate([x[0] for x in held])
            sizes, ids = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            left = sizes.copy()
            left[0] -= done
            cuts = pack_stream(ids[done:], left, ends, width) + done
            if not last and len(cuts) > 2:
                cuts = cuts[:-1]
            upto = np.concatenate([[0], np.cumsum(sizes)])
            at = np.union1d(cuts, upto[(upto > done) & (upto <= cuts[-1])])
            begin, size = at[:-1], np.diff(at)
            of, seq = np.searchsorted(upto, begin, side="right") - 1, np.searchsorted(cuts, begin, side="right") - 1
            raw = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((4 * at).astype("int32").tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
            first = (bucket << 40) + made
            made += len(cuts) - 1
            k = int(np.searchsorted(upto, cuts[-1], side="right")) - 1
            done = int(cuts[-1] - upto[k])
            held = [(names[k:], sizes[k:], ids[upto[k] :])] if k < len(sizes) else []
            return pa.RecordBatch.from_arrays(
                [pa.array(names[of], pa.int64(), mask=names[of] == MAX_ID), pa.array(begin - upto[of]), pa.array(size), raw, pa.array(sizes[of]), pa.array(first + seq), pa.array(begin - cuts[seq])],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        for batch, ids, counts in encoded(batches, tokenizer, end):
            of = batch.column("bucket").to_numpy()
            upto = np.concatenate([[0], np.cumsum(counts)])
            names = batch.column("doc_id").fill_null(MAX_ID).to_numpy()
            for at in np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist():
                if of[at] != bucket:
                    if held:
                        yield close(True)
                    bucket, made = int(of[at]), 0
                to = int(np.searchsorted(of, bucket, side="right"))
                held.append((names[at:to], counts[at:to], ids[upto[at] : upto[to]]))
                if sum(len(x[2]) for x in held) - done >= stretch:
                    yield close(False)
        if held:
            yield close(True)

    return in_order(docs).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
