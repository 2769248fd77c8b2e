"""Token counts: rank-synchronous merging of BPE pairs over ragged numpy arrays.

All new pre-tokens of an Arrow batch lie end to end in one array. In each step every sequence joins its lowest-rank pair at
once; sequences without a pair leave the array, and their surviving symbols are counted.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.llm import bytestext as bt

NONE = np.int64(2**62)
#: Steps in which all sequences are merged together; those that need more (long runs of one character) are finished by a heap.
TOGETHER = 400
MARK = "▁"


class PieceCounter:
    """counts(texts): how many ids a byte-fallback BPE .model gives each text, without begin and end.

    Spaces become U+2581 and one comes first, as the model's identity normaliser does it. A text is cut where a space
    follows another character, unless some piece of the vocabulary spans such a place. Counts of pre-tokens are kept with their
    bytes, for at most ``room`` of them.
    """

    def __init__(self, path: str, room: int = 1_000_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        pieces.sort(key=lambda x: -x[1])
        names = [x for x, _ in pieces]
        index = {x: i for i, x in enumerate(names)}  # in the order of ranks
        self.n = len(names)
        score = np.array([x for _, x in pieces])
        #: Pieces of equal score have equal rank; then the leftmost place comes first.
        self.rank_of = np.append(np.concatenate([[0], np.cumsum(score[1:] != score[:-1])]), NONE)
        tied = np.bincount(self.rank_of[:-1])[self.rank_of[:-1]] > 1
        keys, made = [], []
        #: May all places of a pair be joined in one step? Not if a lower rank could arise from the joined piece, or it is tied.
        self.steady = np.append(~tied, True)
        self.cut_at_spaces = True
        for x, i in index.items():
            if MARK in x.lstrip(MARK):
                self.cut_at_spaces = False
            for k in range(1, len(x)):
                a, b = index.get(x[:k]), index.get(x[k:])
                if a is not None and a > i:
                    self.steady[a] = False
                if b is not None and b > i:
                    self.steady[b] = False
                if a is not None and b is not None:
                    keys.append(a * (self.n + 1) + b)
                    made.append(i)
        order = np.argsort(np.array(keys, dtype="int64"))
        self.pairs, self.made = np.array(keys, dtype="int64")[order], np.array(made, dtype="int64")[order]
        self.chars = np.full(0x110000, self.n, dtype="int64")  # n: a character without a piece
        for x, i in index.items():
            if len(x) == 1:
                self.chars[ord(x)] = i
        self.made_by: dict[int, int] = {}
        self.known, self.kept = bt.Words(room), np.empty(0, "int64")

    _of: dict[str, PieceCounter] = {}

    @classmethod
    def of(cls, path: str) -> PieceCounter:
        """This process's own, so that the tasks of a reused Python worker share the kept counts."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def pairs_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two neighbours make, n if none."""
        key = left * (self.n + 1) + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], self.n)

    def merged(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Surviving symbols of each sequence of code points; a character without a piece counts its UTF-8 bytes."""
        out = np.zeros(len(sizes), dtype="int64")
        sym = self.chars[codes]
        seq = np.repeat(np.arange(len(sizes)), sizes)
        lost = sym == self.n
        np.add.at(out, seq[lost], 1 + (codes[lost] > 0x7F).astype("int64") + (codes[lost] > 0x7FF) + (codes[lost] > 0xFFFF) - 1)
        joint = np.full(len(sym), self.n)  # the piece that a symbol makes with the next
        if len(sym) > 1:
            near = np.flatnonzero(seq[:-1] == seq[1:])
            joint[near] = self.pairs_of(sym[near], sym[near + 1])
        for step in range(TOGETHER + 1):
            if not len(sym):
                break
            if step == TOGETHER:
                begin = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
                for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(seq)], strict=True):
                    out[seq[a]] += self.finished(sym[a:b].tolist())
                break
            begin = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            size = np.diff(np.append(begin, len(seq)))
            rank = self.rank_of[joint]
            low = np.minimum.reduceat(rank, begin)
            done = low == NONE
            if done.any():
                out[seq[begin[done]]] += size[done]
                stay = np.repeat(~done, size)
                sym, seq, joint, rank = sym[stay], seq[stay], joint[stay], rank[stay]
                low, size = low[~done], size[~done]
                if not len(sym):
                    break
                begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            hit = np.flatnonzero(rank == np.repeat(low, size))
            own = seq[hit]
            first = np.concatenate([[True], own[1:] != own[:-1]])
            run = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | first[1:]])
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[np.where(self.steady[joint[hit]], place % 2 == 0, first)]
            sym[hit] = joint[hit]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # where a joined symbol lies after the others have gone
            sym, seq, joint = sym[keep], seq[keep], joint[keep]
            joint[at] = self.n
            near = np.unique(np.concatenate([at[at > 0] - 1, at]))
            near = near[near < len(sym) - 1]
            same = seq[near] == seq[near + 1]
            joint[near[~same]] = self.n
            near = near[same]
            joint[near] = self.pairs_of(sym[near], sym[near + 1])
        return out

    def finished(self, sym: list[int]) -> int:
        """Symbols that survive in one sequence, whose pairs are taken from a heap by rank, then place."""
        if not self.made_by:
            self.made_by = dict(zip(self.pairs.tolist(), self.made.tolist(), strict=True))
        width, last, alive = self.n + 1, len(sym), len(sym)
        right, left = list(range(1, last + 1)), list(range(-1, last - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < last and (piece := self.made_by.get(sym[i] * width + sym[j])) is not None:
                heapq.heappush(heap, (int(self.rank_of[piece]), i, piece, sym[i] * width + sym[j]))

        for i in range(last):
            offer(i)
        gone = bytearray(last)
        while heap:
            _, i, piece, pair = heapq.heappop(heap)
            j = right[i]
            if gone[i] or j >= last or sym[i] * width + sym[j] != pair:
                continue
            sym[i], right[i], gone[j] = piece, right[j], 1
            if right[i] < last:
                left[right[i]] = i
            alive -= 1
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return alive

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, tokens) of each text; null is empty."""
        data, offsets = bt.flat(texts)
        n_bytes = np.diff(offsets)
        if not len(data):
            return n_bytes, np.zeros(len(texts), "int64")
        raw = data.tobytes()
        if MARK.encode() in raw:  # the same as a space from here on
            texts = pa.array([(x or "").replace(MARK, " ") for x in texts.to_pylist()], type=pa.large_string())
            data, offsets = bt.flat(texts)
        full = np.flatnonzero(np.diff(offsets))
        data = np.insert(data, offsets[full], 0x20)
        offsets = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
        cut = np.zeros(len(data) + 1, dtype=bool)
        if self.cut_at_spaces:
            cut[1 : len(data)] = (data[1:] == 0x20) & (data[:-1] != 0x20)
        cut[offsets] = True
        starts = np.flatnonzero(cut[: len(data)])
        ends = np.append(starts[1:], len(data))
        keys, first, back = bt.Words.group(data, starts, ends)
        a, b = starts[first], ends[first]
        if self.known.full(len(keys)):
            self.known.clear()
            self.kept = np.empty(0, "int64")
        slot = self.known.find(keys, data, a, b)
        n, new = np.empty(len(keys), dtype="int64"), np.flatnonzero(slot < 0)
        n[slot >= 0] = self.kept[slot[slot >= 0]]
        if len(new):
            size = b[new] - a[new]
            joined = data[np.repeat(a[new], size) + bt.within(size)]
            upto = np.concatenate([[0], np.cumsum((joined & 0xC0) != 0x80)])
            codes = np.frombuffer(joined.tobytes().decode().encode("utf-32-le"), dtype="uint32").astype("int64")
            codes[codes == 0x20] = ord(MARK)
            n[new] = self.merged(codes, np.diff(upto[np.concatenate([[0], np.cumsum(size)])]))
            self.kept = np.concatenate([self.kept, n[new][self.known.learn(keys[new], data, a[new], b[new])]])
        each = np.concatenate([[0], np.cumsum(n[back])])
        return n_bytes, np.diff(each[np.searchsorted(starts, offsets)])


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit) in place of the text; no shuffle, one pass.

    A null or empty text has 0 bytes and 0 tokens. Rows are independent: equal rows give equal results, an empty table gives
    none, columns of docs other than ``text`` pass through unless they have one of the three names.
    """
    own = ["n_bytes", "n_tokens", "over_limit"]
    keep = [c for c in docs.columns if c not in (*own, text)]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_bytes long, n_tokens long, over_limit boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter.of(model_path)
        for batch in bt.pieces(batches, "__text"):
            n_bytes, n = counter.counts(batch.column("__text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], [*keep, *own])

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)
