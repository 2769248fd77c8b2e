"""Media columns: AVI files with motion JPEG, their frames, and clips between shots.

Every frame is a baseline JPEG of one component with its own tables, so any frame is decoded alone. Texts are stored as
quantised DCT coefficients: 64 bytes make the 64 coefficients of a block in zigzag order, byte b as the value 256 + b. All
these need category 9, for which the Huffman tables have one code of 7 bits, so a coefficient takes exactly two bytes, and
blocks, cut by restart markers, are written and read as numpy arrays. Frames of other makers go through a general decoder.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.llm import bytestext as bt

#: Blocks in a frame's row and in a frame; frames a second.
ROW, BLOCKS, FPS = 8, 64, 25


def zigzag_order() -> np.ndarray:
    """Row-major place of the k-th coefficient: along antidiagonals, in turn up and down."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag_order()
#: cos((2x + 1) u pi / 16) scaled, so that pixels = COS.T @ coefficients @ COS.
COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)], dtype="float32")
#: The same for flat blocks in zigzag order.
IDCT = np.kron(COS, COS)[ZIGZAG]


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def one_code(kind: int) -> bytes:
    """A Huffman table whose only symbol is 9, with the 7-bit code 0."""
    return bytes([kind << 4, *(int(n == 7) for n in range(1, 17)), 9])


TABLES = segment(0xC4, one_code(0) + one_code(1))


#: Fixed values, the usual tables of motion JPEG, whose frames may leave them out: how many codes have 1, 2, ... 16 bits, and the
#: symbols that come first in the codes' order; the others follow in ascending order.
USUAL = {
    0x00: ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), ""),
    0x01: ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), ""),
    0x10: ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"),
    0x11: ((0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119), "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
}


def usual_tables() -> bytes:
    """The body of a segment with the four usual tables."""
    out = b""
    for kind, (counts, first) in USUAL.items():
        head = bytes.fromhex(first)
        every = range(12) if kind < 0x10 else [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
        out += bytes([kind, *counts]) + head + bytes(sorted(set(every) - set(head)))
    return out


def codes_of(body: bytes) -> dict[int, dict[tuple[int, int], int]]:
    """Symbols by (length, code) of each table in a segment's body."""
    out: dict[int, dict[tuple[int, int], int]] = {}
    while body:
        own, code, k = out.setdefault(body[0], {}), 0, 17
        own.clear()
        for length in range(1, 17):
            for _ in range(body[length]):
                own[length, code] = body[k]
                code, k = code + 1, k + 1
            code <<= 1
        body = body[k:]
    return out


def jpeg_head(width: int, height: int) -> bytes:
    return b"".join(
        [
            b"\xff\xd8",
            segment(0xDB, bytes([0]) + bytes([1] * 64)),
            segment(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)),
            TABLES,
            segment(0xDD, struct.pack(">H", 1)),
            segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def encode_frame(payload: bytes) -> bytes:
    """A JPEG whose blocks hold the payload, a positive multiple of 64 bytes."""
    n = len(payload) // 64
    width = ROW if n % ROW == 0 else 1
    blocks = np.empty((n, 130), dtype="uint8")
    blocks[:, 0:128:2] = 1  # the code 0000000 and the first bit of 256 + b
    blocks[:, 1:128:2] = np.frombuffer(payload, dtype="uint8").reshape(n, 64)
    blocks[:, 128] = 0xFF
    blocks[:, 129] = 0xD0 + np.arange(n) % 8
    if b"\xff" in payload:  # in entropy-coded data a zero byte follows 0xFF
        data = b"".join(x[:128].tobytes().replace(b"\xff", b"\xff\x00") + x[128:].tobytes() for x in blocks)
    else:
        data = blocks.tobytes()
    return jpeg_head(8 * width, 8 * (n // width)) + data[:-2] + b"\xff\xd9"


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS) -> bytes:
    """An AVI file with an idx1 index of these JPEG frames."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    index, at = [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + len(f) % 2
    movi = chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", f) for f in frames))
    return chunk(b"RIFF", b"AVI " + head + movi + chunk(b"idx1", b"".join(index)))


def riff_chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, size) of the chunks in a stretch; a size past its end is cut there."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        size = min(size, end - at - 8)
        yield name, at + 8, size
        at += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """(frames a second, JPEG frames in order): by the idx1 index, or without one by walking the movi list."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    fps, movi, index = float(FPS), None, None
    stack = [(12, len(data))]
    while stack:
        for name, at, size in riff_chunks(data, *stack.pop()):
            kind = data[at : at + 4]
            if name == b"LIST" and kind == b"movi":
                movi = (at, size)
            elif name == b"LIST":
                stack.append((at + 4, at + size))
            elif name == b"strh" and kind == b"vids":
                scale, rate = struct.unpack_from("<II", data, at + 20)
                fps = rate / scale if scale and rate else fps
            elif name == b"idx1":
                index = (at, size)
    if movi is None:
        return fps, []
    if index is None:
        return fps, [data[a : a + n] for name, a, n in riff_chunks(data, movi[0] + 4, movi[0] + movi[1]) if name[2:] in (b"dc", b"db") and n]
    entries = list(struct.iter_unpack("<4sIII", data[index[0] : index[0] + index[1] // 16 * 16]))
    # offsets count from the movi list's name, in some files from the file's start
    shift = movi[0] if entries and data[movi[0] + entries[0][2] : movi[0] + entries[0][2] + 4] == entries[0][0] else 0
    return fps, [data[shift + at + 8 : shift + at + 8 + n] for name, _, at, n in entries if name[2:] in (b"dc", b"db") and n]


class Frame:
    """A baseline JPEG: its quantised coefficients (blocks x 64, zigzag) of the first component, and what decoding needs."""

    def __init__(self, jpeg: bytes):
        if jpeg[:2] != b"\xff\xd8":
            raise ValueError("no JPEG frame")
        self.quant: dict[int, np.ndarray] = {}
        codes, plain = codes_of(usual_tables()), False
        restart, at = 0, 2
        while True:
            marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
            body = jpeg[at + 4 : at + 2 + size]
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype("float32")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker in (0xC0, 0xC1):
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline frames are intra-coded here")
            elif marker == 0xC4:
                plain = body == TABLES[4:]
                codes |= codes_of(body)
            elif marker == 0xDD:
                restart = struct.unpack(">H", body)[0]
            at += 2 + size
            if marker == 0xDA:
                tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                break
        end = jpeg.rfind(b"\xff\xd9")
        data = jpeg[at : end if end > at else len(jpeg)]
        n = self.width * self.height // 64
        self.blocks = None
        if len(self.parts) == 1 and restart == 1 and plain and self.parts[0][1:3] == (1, 1):
            self.blocks = fixed_blocks(data, n)
        if self.blocks is None:
            self.blocks = huffman_blocks(data, self, codes, tables, restart)

    def pixels(self) -> np.ndarray:
        """0 to 255 of the first component, a row of 64 for each block."""
        c = self.blocks.astype("float32") * self.quant[self.parts[0][3]]
        return np.clip(np.rint(c @ IDCT + 128), 0, 255).astype("uint8")


def fixed_blocks(data: bytes, n: int) -> np.ndarray | None:
    """Coefficients where each takes two bytes, in restart intervals of a block; None if these are others."""
    if len(data) != 130 * n - 2:
        parts = [p.replace(b"\xff\x00", b"\xff") for p in split_restarts(data)]
        if len(parts) != n or any(len(p) != 128 for p in parts):
            return None
        pairs = np.frombuffer(b"".join(parts), dtype="uint8").reshape(n, 64, 2)
    else:
        pairs = np.frombuffer(data + b"\xff\xd0", dtype="uint8").reshape(n, 130)[:, :128].reshape(n, 64, 2)
    if (pairs[:, :, 0] != 1).any():
        return None
    return pairs[:, :, 1].astype("int16") + 256


def split_restarts(data: bytes) -> list[bytes]:
    import re

    return re.split(rb"\xff[\xd0-\xd7]", data)


def huffman_blocks(data: bytes, frame: Frame, codes: dict, tables: dict, restart: int) -> np.ndarray:
    """The first component's blocks in order, by decoding code after code."""
    across, down = max(p[1] for p in frame.parts), max(p[2] for p in frame.parts)
    if len(frame.parts) == 1:
        across = down = 1
    wide, high = -(-frame.width // (8 * across)), -(-frame.height // (8 * down))
    h, v = (frame.parts[0][1], frame.parts[0][2]) if len(frame.parts) > 1 else (1, 1)
    out = np.zeros((high * v, wide * h, 64), dtype="int16")
    intervals = split_restarts(data)
    mcu = 0
    for part in intervals:
        bits = int.from_bytes(b"\x01" + part.replace(b"\xff\x00", b"\xff") + b"\xff" * 4, "big")
        total, at = bits.bit_length() - 1, 0
        text = bin(bits)[3:]

        def symbol(table: dict) -> int:
            nonlocal at
            for length in range(1, 17):
                if (found := table.get((length, int(text[at : at + length], 2)))) is not None:
                    at += length
                    return found
            raise ValueError("no such code")

        def value(size: int) -> int:
            nonlocal at
            if not size:
                return 0
            x = int(text[at : at + size], 2)
            at += size
            return x if x >> (size - 1) else x - (1 << size) + 1

        before = [0] * len(frame.parts)
        for _ in range(restart or wide * high):
            if mcu >= wide * high or at >= total:
                break
            for k, (name, hk, vk, _) in enumerate(frame.parts):
                dc, ac = tables[name]
                for y in range(vk if len(frame.parts) > 1 else 1):
                    for x in range(hk if len(frame.parts) > 1 else 1):
                        block = np.zeros(64, dtype="int16")
                        before[k] += value(symbol(codes[dc]))
                        block[0] = before[k]
                        i = 1
                        while i < 64:
                            s = symbol(codes[16 + ac])
                            if s == 0:
                                break
                            i += s >> 4
                            if s & 15:
                                block[i] = value(s & 15)
                            i += 1
                        if k == 0:
                            out[mcu // wide * v + y, mcu % wide * h + x] = block
            mcu += 1
    return out.reshape(-1, 64)


def histogram(frame: Frame, bins: int = 32) -> np.ndarray:
    h = np.bincount(frame.pixels().ravel() // (256 // bins), minlength=bins)
    return h / max(1, h.sum())


def shot_starts(hists: np.ndarray, back: int = 12, least: float = 0.05, steep: float = 3.0) -> list[int]:
    """Frames that begin a shot: 0, and those whose histogram differs from the one before by more than ``least`` and more than
    the mean plus ``steep`` deviations of up to ``back`` differences before, since the last shot began."""
    out, seen = [0], []
    for i in range(1, len(hists)):
        d = float(np.abs(hists[i] - hists[i - 1]).sum()) / 2
        if d > least and (len(seen) < 2 or d > np.mean(seen[-back:]) + steep * np.std(seen[-back:])):
            out.append(i)
            seen = []
        else:
            seen.append(d)
    return out if len(hists) else []


def clips(avi: bytes) -> list[tuple[int, int, float, float]]:
    """(first frame, frames, start and end in seconds) of each shot."""
    fps, frames = read_avi(avi)
    starts = shot_starts(np.array([histogram(Frame(f)) for f in frames])) if frames else []
    return [(a, b - a, a / fps, b / fps) for a, b in zip(starts, [*starts[1:], len(frames)], strict=True)]


def text_to_avi(text: bytes) -> bytes:
    """The bytes, zeros appended up to a positive multiple of 64, as frames of at most BLOCKS blocks."""
    payload = text + b"\0" * (-len(text) % 64 or (0 if text else 64))
    step = 64 * BLOCKS
    return write_avi([encode_frame(payload[i : i + step]) for i in range(0, len(payload), step)], 8 * ROW, 8 * (BLOCKS // ROW))


def avi_payload(frames: list[Frame]) -> bytes:
    """What text_to_avi stored."""
    return b"".join((f.blocks - 256).astype("uint8").tobytes() for f in frames)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (an AVI file) of each text of docs; a null text is empty. No shuffle.

    Rows are stored one by one: repeated rows give equal files, an empty table none, columns other than the two are left out.
    A file takes a little over twice the text and must fit in a cell, so a text may have some 900 MB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.pieces(batches, "__text"):
            texts = batch.column("__text").cast(pa.binary()).fill_null(b"").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([text_to_avi(t) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_stored(media: DataFrame) -> DataFrame:
    """Digests and features of stored texts, from the bytes of ``media`` alone.

    feature: frames, then first frame and length of each clip, then the mean histogram's CRC. clips: first second, last second and
    frames of each. Equal texts, equal values.
    """

    def one(data: bytes) -> tuple:
        fps, jpegs = read_avi(data)
        frames = [Frame(f) for f in jpegs]
        payload = avi_payload(frames)
        hists = np.array([histogram(f) for f in frames])
        starts = shot_starts(hists)
        shots = ",".join(f"{a}+{b - a}" for a, b in zip(starts, [*starts[1:], len(frames)], strict=True))
        timed = ",".join(f"{a / fps:g}-{b / fps:g}:{b - a}" for a, b in zip(starts, [*starts[1:], len(frames)], strict=True))
        mean = np.rint(1000 * hists.mean(axis=0)).astype("<u2").tobytes()
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), f"{len(frames)}@{fps:g}:{shots}:{zlib.crc32(mean):08x}", timed)

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.pieces(batches, "media"):
            found = list(zip(*(one(x) for x in batch.column("media").to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(x) for x in found)], ["doc_id", "n_bytes", *names])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips string")


def clip_rows(media: DataFrame) -> DataFrame:
    """doc_id, clip, first_frame, n_frames, start_s, end_s: a row for each shot of each AVI file in ``media``.

    A null or damaged file, or one without frames, gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.pieces(batches, "media"):
            rows = []
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                try:
                    rows += [(doc, i, *c) for i, c in enumerate(clips(data or b""))]
                except (ValueError, LookupError, AttributeError, TypeError, struct.error):  # what damaged bytes lead to
                    continue
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["doc_id", "clip", "first_frame", "n_frames", "start_s", "end_s"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip long, first_frame long, n_frames long, start_s double, end_s double")
