"""Texts of Arrow batches as flat numpy bytes: words, their hashes, and n-gram hashes, without a loop over words."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd 64-bit multipliers of the hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)

#: Words are [^\x20\x09-\x0D]+.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that the column has about ``most`` bytes in each (one long text may have more)."""
    try:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ends = np.cumsum(lengths(batch.column(column)))
            at = 0
            while at < batch.num_rows:
                base = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
                yield batch.slice(at, to - at)
                at = to
    finally:
        release()


def release() -> None:
    """Give freed memory back: a Python worker lives on after its task, and shares the executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        return


def lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64")


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); null is empty."""
    kind = pa.binary() if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type) else pa.large_binary()
    texts = texts.cast(pa.large_binary()) if kind == pa.large_binary() else texts.cast(pa.binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offs, data = texts.buffers()
    width = "int64" if kind == pa.large_binary() else "int32"
    offsets = np.frombuffer(offs, dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype("int64")
    raw = np.frombuffer(data, dtype="uint8")[offsets[0] : offsets[-1]] if data is not None else np.empty(0, "uint8")
    return raw, offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * MIX_A
    h ^= h >> np.uint64(27)
    h *= MIX_B
    h ^= h >> np.uint64(31)
    return h


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, counts by document) of the maximal runs of bytes that are not space."""
    n = len(data)
    docs = len(offsets) - 1
    if n == 0:
        return np.empty(0, "int64"), np.empty(0, "int64"), np.zeros(docs, "int64")
    inside = ~space[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    stop = np.zeros(n + 1, dtype=bool)
    stop[1:n] = inside[:-1] & (~inside[1:] | first[1:n])
    stop[n] = inside[-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop)
    at = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(at)


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, zeros after the end; a view that costs no memory but the copy of data."""
    padded = np.concatenate([data, np.zeros(8, dtype="uint8")])
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))


#: Mask of the first n of 8 bytes.
FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype="uint64")
#: Words of more bytes are hashed one by one, by BLAKE2b.
LONG = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, stretch: int = 1 << 17) -> np.ndarray:
    """A 64-bit hash of each word's bytes; another one for each seed.

    Words of up to LONG bytes are mixed 8 bytes at a time, each step a bijection of what came before, so words of up to 8 bytes
    of one length never collide; longer words are hashed by BLAKE2b. Worked through in stretches of so many words.
    """
    wide = eights(data)
    out = np.empty(len(starts), dtype="uint64")
    with np.errstate(over="ignore"):
        for at in range(0, len(starts), stretch):
            a, n = starts[at : at + stretch], (ends - starts)[at : at + stretch]
            h = mix((n.astype("uint64") * STEP + np.uint64(seed) * MIX_A) ^ (wide[a] & FIRST[np.minimum(n, 8)]))
            more, k = np.flatnonzero((n > 8) & (n <= LONG)), 8
            while len(more):
                h[more] = mix(h[more] * BASE + (wide[a[more] + k] & FIRST[np.minimum(n[more] - k, 8)]))
                k += 8
                more = more[n[more] > k]
            out[at : at + stretch] = h
    long = np.flatnonzero(ends - starts > LONG)
    if len(long):
        raw, key = memoryview(np.ascontiguousarray(data)), seed.to_bytes(8, "little")
        own = b"".join(hashlib.blake2b(raw[x:y], digest_size=8, key=key).digest() for x, y in zip(starts[long].tolist(), ends[long].tolist(), strict=True))
        out[long] = np.frombuffer(own, dtype="<u8")
    return out


def same_bytes(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray, sizes: np.ndarray, stretch: int = 1 << 18) -> np.ndarray:
    """Are the ``sizes`` bytes from a on in ``left`` those from b on in ``right``? Both are eights() of some data."""
    out = (left[a] ^ right[b]) & FIRST[np.minimum(sizes, 8)] == 0
    rest = np.flatnonzero(out & (sizes > 8))
    steps = (sizes[rest] - 1) // 8
    upto = np.cumsum(steps)
    at = 0
    while at < len(rest):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + stretch)))
        row, n = rest[at:to], steps[at:to]
        k = 8 * (1 + within(n))
        x, y, left_over = np.repeat(a[row], n) + k, np.repeat(b[row], n) + k, np.repeat(sizes[row], n) - k
        differ = (left[x] ^ right[y]) & FIRST[np.minimum(left_over, 8)] != 0
        out[np.repeat(row, n)[differ]] = False
        at = to
    return out


class Words:
    """Values of byte strings seen before, found by a 64-bit hash and then compared byte by byte.

    group() tells the distinct strings of a batch, find() those that are known and learn() adds some. At most ``room`` strings
    and ``most`` bytes of them are held; a string of more than LARGEST bytes never is.
    """

    LARGEST = 1024

    def __init__(self, room: int, most: int = 48 << 20):
        self.room, self.most = room, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.empty(0, "uint64"), np.empty(0, "int64")
        self.text, self.starts, self.sizes = np.zeros(1 << 16, "uint8"), np.empty(0, "int64"), np.empty(0, "int64")
        self.used = 0

    def __len__(self) -> int:
        return len(self.sizes)

    @staticmethod
    def group(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, a place, group of each string): one group for each distinct string, whatever their hashes."""
        h = word_hashes(data, starts, ends, seed)
        order = np.argsort(h)
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[order[1:]] != h[order[:-1]]
        first = order[new]
        keys, back = h[first], np.empty(len(h), dtype="int64")
        back[order] = np.cumsum(new) - 1
        wide, sizes = eights(data), ends - starts
        origin = first[back]
        strange = np.flatnonzero((sizes != sizes[origin]) | ~same_bytes(wide, starts, wide, starts[origin], np.minimum(sizes, sizes[origin])))
        if len(strange):  # strings whose hash is another string's
            raw, of = data.tobytes(), {}
            for i in strange.tolist():
                back[i] = of.setdefault(raw[starts[i] : ends[i]], len(keys) + len(of))
            extra = np.array([np.flatnonzero(back == g)[0] for g in of.values()], dtype="int64")
            keys, first = np.concatenate([keys, keys[np.searchsorted(keys, word_hashes(data, starts[extra], ends[extra], seed))]]), np.concatenate([first, extra])
        return keys, first, back

    def find(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slot of each string, -1 if it is not known."""
        slot = np.full(len(keys), -1, dtype="int64")
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = np.flatnonzero((self.keys[at] == keys) & (self.sizes[self.slots[at]] == ends - starts))
            own = self.slots[at[hit]]
            hit = hit[same := same_bytes(eights(data), starts[hit], eights(self.text[: self.used]), self.starts[own], self.sizes[own])]
            slot[hit] = own[same]
        return slot

    def learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hold those of these new strings that may be; which they are, in the order of their new slots."""
        sizes = ends - starts
        known = np.zeros(len(keys), dtype=bool)
        if len(self.keys):
            known = self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys
        _, once = np.unique(keys, return_index=True)
        alone = np.zeros(len(keys), dtype=bool)
        alone[once] = True
        take = np.flatnonzero(alone & ~known & (sizes <= self.LARGEST))
        n = sizes[take]
        upto = self.used + np.concatenate([[0], np.cumsum(n)])
        while len(self.text) < upto[-1]:
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.text[self.used : upto[-1]] = data[np.repeat(starts[take], n) + within(n)]
        order = np.argsort(keys[take], kind="stable")
        at = np.searchsorted(self.keys, keys[take][order])
        self.keys, self.slots = np.insert(self.keys, at, keys[take][order]), np.insert(self.slots, at, len(self.sizes) + order)
        self.starts, self.sizes, self.used = np.concatenate([self.starts, upto[:-1]]), np.concatenate([self.sizes, n]), int(upto[-1])
        return take

    def full(self, more: int) -> bool:
        return len(self.sizes) + more > max(self.room, 2 * more) or self.used > self.most


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i : i + k] for each i; the callers drop those that cross a document's end."""
    if len(h) < k:
        return np.empty(0, "uint64")
    with np.errstate(over="ignore"):
        total, done = None, 0
        part, width, p = h, 1, STEP  # part[i] hashes h[i : i + width]; p is STEP ** width
        while True:
            if k & width:
                if total is None:
                    total = part
                else:
                    n = len(h) - done - width + 1
                    total = total[:n] * p + part[done : done + n]
                done += width
            if done == k:
                return mix(total[: len(h) - k + 1])
            part = part[: len(part) - width] * p + part[width:]
            width, p = 2 * width, p * p


def doc_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... in each group of these sizes."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)
