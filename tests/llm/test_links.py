"""Near-duplicate classes of whole families against brute force, and how many links banding finds."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from kilnworks.llm import near_dups
from kilnworks.llm import workspace as ws


def sets(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    return len(a & b) / len(a | b)


def families():
    """20 families of two centres, their variants, and texts between the two; only some bridges link the halves."""
    r = random.Random(33)
    out = []
    for f in range(20):
        n = r.randint(90, 220)
        x = [f"f{f}w{i}" for i in range(n)]
        y = x[: int(n * r.uniform(0.83, 0.9))] + [f"f{f}y{i}" for i in range(n // 14)]
        for centre in (x, y):
            for v in range(r.randint(3, 14)):
                t = list(centre)
                for k in r.sample(range(len(t)), r.randint(0, 2)):
                    t[k] = f"f{f}v{v}k{k}"
                out.append(" ".join(t))
        out += [" ".join(x), " ".join(y)]
    out += [" ".join(f"lone{i}w{k}" for k in range(60)) for i in range(20)]
    r.shuffle(out)
    return out


def test_families_are_brute_force_classes(spark):
    texts = families()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(docs).collect()}
    shingles = [sets(t) for t in texts]
    family = [re.match(r"[a-z]+\d+", t)[0] for t in texts]  # no word is in two families
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if family[i] == family[j] and alike(shingles[i], shingles[j]) >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    assert got == {i: find(i) for i in range(len(texts))}


def test_two_halves_and_a_bridge(spark):
    """50 variants of x and 50 of y, each alike to its own centre; x and y are 0.82 alike, and nothing else links the halves."""
    words = [f"w{i}" for i in range(300)]
    x, y = words, words[:276] + [f"y{i}" for i in range(30)]
    cut = lambda c, i: [*c[: len(c) - 26], *[f"z{i}_{k}" for k in range(8)]]
    front = lambda c, i: [*[f"q{i}_{k}" for k in range(8)], *c[26:]]
    texts = [x, y, *(front(x, i) for i in range(50)), *(front(y, i) if i % 2 else cut(y, i) for i in range(50, 100))]
    texts = [" ".join(t) for t in texts]
    assert alike(sets(texts[0]), sets(texts[1])) >= 0.8
    got = near_dups.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    s = [sets(t) for t in texts]
    root = list(range(len(s)))
    for _ in range(len(s)):
        for i, j in itertools.combinations(range(len(s)), 2):
            if root[i] != root[j] and alike(s[i], s[j]) >= 0.8:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
                break
        else:
            break
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(root))


def test_share_of_links_found(spark):
    """Pairs of a similarity just above 0.8, half of them with shingles that come many times: nearly none is missed."""
    r = random.Random(6)
    texts, near = [], []
    for p in range(240):
        n = r.randint(100, 400)
        a = [f"p{p}w{i}" for i in range(n)]
        b = a[: int(n * r.uniform(0.83, 0.88))]
        if p % 2:
            b += [f"p{p}r{i}" for i in range(3)] * 40
        texts += [" ".join(a), " ".join(b)]
        near.append(alike(sets(texts[-2]), sets(texts[-1])))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_dups.near_duplicates(docs).collect()}
    linked = [got[2 * p] == got[2 * p + 1] for p in range(240)]
    assert not any(x for x, s in zip(linked, near) if s < 0.8)
    for low in (0.8, 0.81, 0.82, 0.83, 0.84):
        own = [x for x, s in zip(linked, near) if low <= s < low + 0.01]
        assert len(own) < 5 or sum(own) >= 0.98 * len(own), (low, sum(own), len(own))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join(spark, how):
    big = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(3000)], "k int, v int")
    small = spark.createDataFrame([(0, "zero"), (3, "three"), (6, "six"), (9999, "none")], "k int, name string")
    want = sorted(map(str, big.join(small, "k", how).collect()))
    got = ws.salted_join(big, small, "k", "v", how)
    assert sorted(map(str, got.collect())) == want
    empty = ws.salted_join(big.where("false"), small, "k", "v", how)
    assert empty.count() == 0 and ws.salted_join(big, small.where("false"), "k", "v", how).count() == (3000 if how == "left" else 0)
    hot = ws.salted_join(big.withColumn("p", F.lit(1)), small, "k", "v").where("k = 0")
    assert hot.select(F.spark_partition_id()).distinct().count() > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"
