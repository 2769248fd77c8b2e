"""The steps of substring dedup: pieces, paths, and what is done when hashes lead astray."""

import collections
import random
import re

import numpy as np
import pytest

from kilnworks.llm import substrings
from kilnworks.llm import workspace as ws

WORD = re.compile(r"[^\x20\x09-\x0D]+")
K = 4


def texts():
    r = random.Random(21)
    line = [f"p{i}" for i in range(40)]
    out = [" ".join(r.choice("abcdef") for _ in range(r.randint(0, 60))) for _ in range(25)]
    out += [" ".join(line), "x " + " ".join(line[:25]) + " y " + " ".join(line[20:]), " ".join(line[5:30]) + " z", " ".join(line * 2), "a " * 30]
    return [(i, t) for i, t in enumerate(out)] + [(3, out[3]), (3, out[3]), (None, out[1]), (None, "lone"), (None, None), (7, out[26])]


def brute(rows):
    """{(id, text): (words, removed, kept)}, and the first place of each window."""
    seen, out = {}, {}
    for i, t in sorted({(2**63 if i is None else i, t or "") for i, t in rows}, key=lambda x: (x[0], order[x[1]])):
        w = WORD.findall(t)
        gone = [False] * len(w)
        for s in range(len(w) - K + 1):
            if tuple(w[s : s + K]) in seen:
                gone[s : s + K] = [True] * K
            seen.setdefault(tuple(w[s : s + K]), (i, t, s))
        out[i, t] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out, seen


order: dict = {}


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    order.update({r["__text"] or "": r["th"] for r in substrings.keyed(d).collect()})
    return d


def result(docs):
    return sorted(map(str, substrings.dedup_substrings(docs, K, 2).collect()))


def wanted():
    want, _ = brute(texts())
    rows = [(i, *want[2**63 if i is None else i, t or ""]) for i, t in texts()]
    return sorted(f"Row(doc_id={i}, n_words={n}, n_removed={g}, kept={k!r})" for i, n, g, k in rows)


def test_rows(docs):
    assert result(docs) == wanted()


def test_what_hashes_led_astray_is_done_again(docs, monkeypatch):
    made, seeds = substrings.paths, []

    def astray(own, common, window, inner, seed):
        seeds.append(seed)
        return made(own, common, window, inner, seed)

    def shifted(rows):
        p = ws.cut(real(rows), "pieces")
        assert p.where("s_ord is not null").count() > 0
        off = 1 if len(seeds) == 1 else 0  # as if other words than the source's had its hashes, the first time
        return p.selectExpr("ord", "th", "start", "n", "s_ord", "s_th", f"CAST(s_start + {off} AS int) AS s_start")

    real = substrings.repeated
    monkeypatch.setattr(substrings, "paths", astray)
    monkeypatch.setattr(substrings, "repeated", shifted)
    assert result(docs) == wanted() and seeds == [0, 1]


def test_paths_are_maximal_and_true(spark, docs):
    own = substrings.keyed(docs)
    pieces = ws.cut(substrings.repeated(substrings.paths(own, np.empty(0, "uint64"), K, 2, 0)), "pieces")
    made = substrings.compacted(pieces.where("s_ord is not null")).collect()
    assert made and max(r.n for r in made) > max(r.n for r in pieces.where("s_ord is not null").collect())
    by_th = {(r["ord"], r["th"]): WORD.findall(r["__text"] or "") for r in own.collect()}
    steps = collections.Counter()
    for r in made:
        a, b = by_th[r.ord, r.th], by_th[r.s_ord, r.s_th]
        assert a[r.start : r.start + r.n + K - 1] == b[r.s_start : r.s_start + r.n + K - 1]
        assert (r.s_ord, r.s_th, r.s_start) < (r.ord, r.th, r.start)
        steps.update((r.ord, r.th, r.start + i, r.s_ord, r.s_th, r.s_start + i) for i in range(r.n))
    want = {(p.ord, p.th, p.start + i, p.s_ord, p.s_th, p.s_start + i) for p in pieces.where("s_ord is not null").collect() for i in range(p.n)}
    assert set(steps) == want and set(steps.values()) == {1}
    for o, t, i, so, st, si in want:  # no path could be longer
        inside = (o, t, i + 1, so, st, si + 1) in want
        ends = any((r.ord, r.th, r.start + r.n - 1, r.s_ord, r.s_th, r.s_start + r.n - 1) == (o, t, i, so, st, si) for r in made)
        assert inside != ends
