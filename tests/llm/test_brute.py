"""Operators that SQL cannot say, held against plain versions written from their definitions."""

import math
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kilnworks.llm import fingerprints, media, toxicity

MASK = 2**64 - 1
BASE, STEP, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(h):
    h ^= h >> 30
    h = h * MIX_A & MASK
    h ^= h >> 27
    h = h * MIX_B & MASK
    return h ^ h >> 31


def s_mer(t):
    h = 0
    for c in t:
        h = (h * STEP + (ord(c) + 1) * BASE) & MASK
    return mix(h)


def syncmers(t, k=16, s=8, kept=64):
    """(hash, place) of the k-mers whose least s-mer is their first or last one: the least hashes, each where it comes first."""
    found = {}
    for i in range(len(t) - k + 1):
        h = [s_mer(t[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(h) in (h[0], h[-1]):
            found.setdefault(mix((h[0] * BASE + h[-1]) & MASK) >> 32, i)
    return sorted(found.items())[:kept]


def alike(a, b, kept=64):
    if not a or not b:
        return float(not a and not b)
    x, y = dict(a), dict(b)
    least = sorted({*x, *y})[:kept]
    both = [h for h in least if h in x and h in y]
    if not both:
        return 0.0
    shift = [y[h] - x[h] for h in both]
    room = max(32, max(*x.values(), *y.values()) // 8)
    middle = float(np.median(shift))
    return sum(abs(d - middle) <= room for d in shift) / len(least)


def test_syncmers_and_likeness():
    r = random.Random(4)
    letters = "abcde é中👍"
    texts = ["".join(r.choice(letters) for _ in range(n)) for n in (0, 1, 15, 16, 17, 40, 300, 900, 2500)]
    texts += ["ab" * 200, "a" * 100, texts[7] + "tail", "head" + texts[7], texts[7][450:] + texts[7][:450], texts[8][:1800]]
    got = fingerprints.anchors(texts)
    want = [syncmers(t) for t in texts]
    for t, g, w in zip(texts, got, want):
        assert list(zip(g[0].tolist(), g[1].tolist())) == w or (not w and len(g[0]) == (len(t) > 0))
    for i, a in enumerate(got):
        for j, b in enumerate(got):
            if want[i] and want[j]:
                assert fingerprints.likeness(a, b) == pytest.approx(alike(want[i], want[j]))


def test_ftrl_step_by_step():
    """The update rule of each coordinate, in plain arithmetic."""
    r = random.Random(7)
    rows = [(np.array(sorted(r.sample(range(40), r.randint(0, 9))), dtype="int64"), int(r.random() < 0.4)) for _ in range(120)]
    z, n, bias = {}, {}, toxicity.DIMS
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2

    def weight(i):
        least = 0.0 if i == bias else l1
        if abs(z.get(i, 0.0)) <= least:
            return 0.0
        return -(z[i] - math.copysign(least, z[i])) / ((b + math.sqrt(n[i])) / a + l2)

    for _ in range(toxicity.PASSES):
        for x, y in rows:
            at = [*x.tolist(), bias]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in at:
                before = n.get(i, 0.0)
                sigma = (math.sqrt(before + g * g) - math.sqrt(before)) / a
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], before + g * g
    m = toxicity.ftrl(rows)
    want = {i: weight(i) for i in range(40) if weight(i)}
    assert dict(zip(m.index.tolist(), m.weight.tolist())) == pytest.approx(want) and m.bias == pytest.approx(weight(bias))
    assert 0 < len(want) < 40  # sparse


def test_features_are_words_neighbours_and_skips():
    def count(t):
        doc, f = toxicity.features(pa.array([t]))
        return len(set(f.tolist()))

    assert [count(t) for t in ("", "a", "a b", "a b c", "A, a! a", "a b c d")] == [0, 1, 3, 6, 3, 9]
    assert set(toxicity.features(pa.array(["x Y"]))[1].tolist()) == set(toxicity.features(pa.array(["X. y?"]))[1].tolist())


def pixels(block, quant):
    """A block's 64 pixels by the cosine sum itself."""
    f = np.zeros((8, 8))
    for k, at in enumerate(media.ZIGZAG):
        f[at // 8, at % 8] = block[k] * quant[k]
    c = [math.sqrt(1 / 8)] + [0.5] * 7
    out = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            out[y, x] = sum(c[u] * c[v] * f[v, u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) for u in range(8) for v in range(8))
    return np.clip(np.rint(out + 128), 0, 255).astype(int)


def test_zigzag():
    assert media.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and media.ZIGZAG[-3:].tolist() == [55, 62, 63]


def test_feature_of_stored_texts(spark):
    r = random.Random(1)
    texts = [bytes(r.choice(range(32, 127)) for _ in range(n)).decode() for n in (0, 64, 130)] + ["a" * 4096 + "~" * 4096]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in media.read_stored(media.store_texts(docs)).collect()}
    for i, t in enumerate(texts):
        raw = t.encode()
        raw += b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        frames = [raw[a : a + 4096] for a in range(0, len(raw), 4096)]
        seen = {}
        hists = []
        for f in frames:
            h = np.zeros(32)
            for a in range(0, len(f), 64):
                b = f[a : a + 64]
                if b not in seen:
                    seen[b] = np.bincount(pixels([256 + x for x in b], [1] * 64).ravel() // 8, minlength=32)
                h += seen[b]
            hists.append(h / h.sum())
        cut = len(frames) > 1 and abs(hists[1] - hists[0]).sum() / 2 > 0.05
        shots = "0+1,1+1" if cut else f"0+{len(frames)}"
        mean = np.rint(1000 * np.mean(hists, axis=0)).astype("<u2").tobytes()
        assert got[i].feature == f"{len(frames)}@25:{shots}:{zlib.crc32(mean):08x}"
        assert got[i].clips == ("0-0.04:1,0.04-0.08:1" if cut else f"0-{len(frames) / 25:g}:{len(frames)}")


def foreign_frame(rng, parts, width, height, tables=b""):
    """(JPEG, first component's blocks) with the usual code tables, which the frame names or leaves out, and sampled components."""
    codes = {kind: {s: c for c, s in own.items()} for kind, own in media.codes_of(media.usual_tables()).items()}
    bits = []

    def put(kind, symbol, value, size):
        length, code = codes[kind][symbol]
        bits.append(format(code, f"0{length}b"))
        if size:
            bits.append(format(value if value > 0 else value + (1 << size) - 1, f"0{size}b"))

    across, down = max(h for h, _ in parts), max(v for _, v in parts)
    wide, high = -(-width // (8 * across)), -(-height // (8 * down))
    first = np.zeros((high * parts[0][1], wide * parts[0][0], 64), dtype=int)
    before = [0] * len(parts)
    for my in range(high):
        for mx in range(wide):
            for k, (h, v) in enumerate(parts):
                for y in range(v):
                    for x in range(h):
                        block = np.where(rng.random(64) < 0.15, rng.integers(-40, 40, 64), 0)
                        d = int(block[0]) - before[k]
                        before[k] = int(block[0])
                        put(min(k, 1), abs(d).bit_length(), d, abs(d).bit_length())
                        run = 0
                        last = max(np.flatnonzero(block[1:]), default=-1) + 1
                        for c in block[1 : last + 1].tolist():
                            if c == 0:
                                run += 1
                                continue
                            while run > 15:
                                put(16 + min(k, 1), 0xF0, 0, 0)
                                run -= 16
                            put(16 + min(k, 1), run << 4 | abs(c).bit_length(), c, abs(c).bit_length())
                            run = 0
                        if last < 63:
                            put(16 + min(k, 1), 0, 0, 0)
                        if k == 0:
                            first[my * v + y, mx * h + x] = block
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    data = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")
    frame = struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(parts))
    scan = bytes([len(parts)]) + b"".join(bytes([k + 1, min(k, 1) * 17]) for k in range(len(parts))) + bytes([0, 63, 0])
    head = b"\xff\xd8" + media.segment(0xE0, b"AVI1\0\0") + media.segment(0xDB, bytes([0]) + bytes([2] * 64)) + (media.segment(0xC4, tables) if tables else b"")
    return head + media.segment(0xC0, frame) + media.segment(0xDA, scan) + data + b"\xff\xd9", first.reshape(-1, 64)


@pytest.mark.parametrize("named", [False, True])
@pytest.mark.parametrize("parts", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
def test_foreign_frames(spark, parts, named):
    rng = np.random.default_rng(len(parts))
    made = [foreign_frame(rng, parts, 40, 24, media.usual_tables() if named else b"") for _ in range(3)]
    for jpeg, blocks in made:
        f = media.Frame(jpeg)
        assert (f.blocks == blocks).all() and f.pixels().shape == blocks.shape
        assert (f.pixels()[0].reshape(8, 8) == pixels(blocks[0], [2] * 64)).mean() > 0.98
    avi = media.write_avi([j for j, _ in made], 40, 24)
    broken = [avi[: len(avi) // 2], avi[:60], avi.replace(b"\xff\xda", b"\xff\xdd"), bytes(len(avi)), avi.replace(b"\xff\xc0", b"\xff\xc2")]
    df = spark.createDataFrame([(0, bytearray(avi)), *((i + 1, bytearray(b)) for i, b in enumerate(broken))], "doc_id long, media binary")
    assert {r.doc_id for r in media.clip_rows(df).collect()} >= {0}
