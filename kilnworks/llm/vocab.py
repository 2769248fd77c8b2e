"""Byte-level BPE ids of whole texts by the tokenizers library, with a cache over words."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from kilnworks.llm import bytestext as bt

#: Bytes of visible ASCII characters, and the first bytes of U+00C0 to U+023F: no white space among them.
VISIBLE = np.zeros(256, dtype=bool)
VISIBLE[0x21:0x7F] = True
LATIN = np.zeros(256, dtype=bool)
LATIN[0xC3:0xC9] = True
#: A part with another of these bytes than its first is encoded alone, for it may hold white space or line ends.
PLAIN = VISIBLE.copy()
PLAIN[0x80:] = True


def parts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the parts of all texts.

    A text is cut before every single space between two visible ASCII or Latin characters. There a byte-level pre-token
    always ends and the next one begins, so the parts' ids, joined, are the text's.
    """
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    if n > 2:
        space = np.flatnonzero(data[1:-1] == 0x20) + 1
        left, right = data[space - 1], data[space + 1]
        before = VISIBLE[left] | ((left >= 0x80) & LATIN[data[np.maximum(space - 2, 0)]] & (space >= 2))
        cut[space[before & (VISIBLE[right] | LATIN[right])]] = True
    return np.flatnonzero(cut[:n])


class CachedBpe:
    """ids(texts) as Tokenizer.encode_batch(texts, add_special_tokens=False) gives them.

    New parts go through the library; their ids are kept with their bytes, for at most ``room`` parts: when that is full,
    those that came only once go. A text with one of the added tokens' strings goes through the library whole.
    """

    _of: dict[str, CachedBpe] = {}

    @classmethod
    def of(cls, path: str) -> CachedBpe:
        """This process's own, so that the tasks of a reused Python worker share a cache."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __init__(self, path: str, room: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.added = [x["content"] for x in json.load(f).get("added_tokens", [])]
        self.line_end = self.tok.encode("\n", add_special_tokens=False).ids
        self.words = bt.Words(room)
        self._reset()

    def _reset(self) -> None:
        self.words.clear()
        self.data, self.starts, self.used = np.empty(1 << 20, dtype="uint32"), np.zeros(1, dtype="int64"), 0
        self.again = np.empty(0, dtype=bool)

    def _shrink(self) -> None:
        """Keep the parts that came again since they were learned; if those are too many, none."""
        stay, old = np.flatnonzero(self.again), self.words
        if 2 * len(stay) > old.room:
            return self._reset()
        begin, size = self.starts[stay], self.starts[stay + 1] - self.starts[stay]
        ids = self.data[np.repeat(begin, size) + bt.within(size)]
        key = np.empty(len(old), dtype="uint64")
        key[old.slots] = old.keys
        text, a = old.text[: old.used], old.starts[stay]
        b = a + old.sizes[stay]
        self.words = bt.Words(old.room, old.most)
        self._reset()
        self._hold(self.words.learn(key[stay], text, a, b), ids, size)

    def _hold(self, taken: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Keep the ids of the taken parts, of all whose ids lie one after the other."""
        begin = np.cumsum(size) - size
        n = size[taken]
        while len(self.data) < self.used + n.sum():
            self.data = np.concatenate([self.data, np.empty_like(self.data)])
        upto = self.used + np.cumsum(n)
        self.data[self.used : self.used + n.sum()] = ids[np.repeat(begin[taken], n) + bt.within(n)]
        self.starts, self.used = np.concatenate([self.starts, upto]), int(self.used + n.sum())
        self.again = np.concatenate([self.again, np.zeros(len(taken), dtype=bool)])

    def _encode(self, new: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of these parts, in order. Plain ones share calls: a line end after each is a token of its own."""
        got: list[np.ndarray] = []
        size = np.zeros(len(new), dtype="int64")
        mark = self.line_end[0]
        joined = np.flatnonzero(plain) if len(self.line_end) == 1 else np.empty(0, "int64")
        for a in range(0, len(joined), 512):
            some = joined[a : a + 512]
            ids = np.array(self.tok.encode_batch_fast([b"\n".join([new[i] for i in some] + [b""]).decode()], add_special_tokens=False)[0].ids, dtype="uint32")
            stops = np.flatnonzero(ids == mark)
            if len(stops) != len(some):
                raise ValueError("the line end is no token of its own in this vocabulary")
            size[some] = np.diff(np.concatenate([[-1], stops])) - 1
            got.append(ids[ids != mark])
        alone = np.setdiff1d(np.arange(len(new)), joined)
        if len(alone):
            for i, e in zip(alone, self.tok.encode_batch_fast([new[i].decode() for i in alone], add_special_tokens=False), strict=True):
                size[i] = len(e.ids)
                got.append(np.array(e.ids, dtype="uint32"))
        ids, order = np.concatenate(got), np.concatenate([joined, alone])
        n = size[order]
        begin = np.empty(len(new), dtype="int64")
        begin[order] = np.cumsum(n) - n
        return ids[np.repeat(begin, size) + bt.within(size)], size

    def _library(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(x.ids, dtype="uint32") for x in self.tok.encode_batch_fast([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
        return np.concatenate([np.empty(0, "uint32"), *ids]), np.array([len(x) for x in ids], dtype="int64")

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, number of ids of each); null is empty."""
        data, offsets = bt.flat(texts)
        raw = data.tobytes()
        if any(a.encode() in raw for a in self.added):
            return self._library(texts)
        if not len(data):
            return np.empty(0, "uint32"), np.zeros(len(texts), "int64")
        starts = parts(data, offsets)
        ends = np.append(starts[1:], len(data))
        keys, first, back = bt.Words.group(data, starts, ends)
        a, b = starts[first], ends[first]
        if self.words.full(len(keys)):
            self._shrink()
        slot = self.words.find(keys, data, a, b)
        old, new = np.flatnonzero(slot >= 0), np.flatnonzero(slot < 0)
        self.again[slot[old]] = True
        begin, size = np.empty(len(keys), dtype="int64"), np.empty(len(keys), dtype="int64")
        ids, n = np.empty(0, "uint32"), np.empty(0, "int64")
        if len(new):
            odd = np.concatenate([[0], np.cumsum(~PLAIN[data])])
            x, y = a[new], b[new]
            spaced = data[x] == 0x20
            ids, n = self._encode([raw[i:j] for i, j in zip(x.tolist(), y.tolist(), strict=True)], (odd[y] - odd[x + spaced] == 0) & (y - x > spaced))
        begin[old], size[old] = self.starts[slot[old]], np.diff(self.starts)[slot[old]]
        begin[new], size[new] = self.used + np.cumsum(n) - n, n
        pool = np.concatenate([self.data[: self.used], ids])
        begin, size = begin[back], size[back]
        out = pool[np.repeat(begin, size) + bt.within(size)]
        if len(new):
            self._hold(self.words.learn(keys[new], data, x, y), ids, n)
        upto = np.concatenate([[0], np.cumsum(size)])
        return out, np.diff(upto[np.searchsorted(starts, offsets)])
