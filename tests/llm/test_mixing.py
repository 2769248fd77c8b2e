"""The draw of source counts for output shards, and that it decides the mix."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnworks.llm import mixing


def test_counts_of_shards():
    slots = [703, 5, 200, 0, 101]
    every = list(mixing.shard_counts(slots, 10, 0, 10**9, 3))
    assert [s for s, *_ in every] == list(range(101))
    own = np.array([c for *_, c in every])
    assert (own.sum(axis=0) == slots).all() and (own.sum(axis=1) == [10] * 100 + [9]).all()
    before = np.array([b for _, b, _ in every])
    assert (before == np.cumsum(own, axis=0) - own).all()
    for a, b in ((0, 1), (17, 40), (100, 101)):
        assert list(mixing.shard_counts(slots, 10, a, b, 3)) == every[a:b]
    assert list(mixing.shard_counts(slots, 10, 0, 101, 4)) != every
    # the spread of a draw without replacement, over many seeds
    many = np.array([list(mixing.shard_counts(slots, 10, 50, 51, s))[0][2] for s in range(1500)])
    share = np.array(slots) / 1009
    assert np.abs(many.mean(axis=0) - 10 * share).max() < 0.2
    assert np.abs(many.var(axis=0) - 10 * share * (1 - share) * 999 / 1008).max() < 0.25
    assert list(mixing.shard_counts([], 10, 0, 5, 1)) == [] == list(mixing.shard_counts([0], 10, 0, 5, 1))


def test_draws_beyond_numpy():
    rng = np.random.default_rng(1)
    got = [mixing.drawn(rng, 3 * 10**11, 10**11, 10**6) for _ in range(400)]
    assert abs(np.mean(got) - 750000) < 100 and 380 < np.std(got) < 490
    assert mixing.drawn(rng, 10**10, 0, 77) == 77 and mixing.drawn(rng, 0, 10**10, 77) == 0 and mixing.drawn(rng, 5, 10**10, 10**10 + 5) == 5


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(37 * i % 301)), None if i % 5 == 0 else f"s{i % 3}", {"a": i % 2}) for i in range(90)]
    return spark.createDataFrame([*rows, rows[3], (3, rows[3][1], rows[3][2], {"a": 5})], "doc_id long, text string, source string, m map<string,int>").repartition(4)


def test_shards_hold_what_was_drawn(docs):
    got = mixing.mix(docs, 7, 16).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    words, target, sizes = collections.defaultdict(collections.Counter), {}, collections.Counter()
    for r in got:
        parts = [tuple(map(int, x.split(":"))) for x in r.shards.split(",") if x]
        assert sum(n for _, n in parts) == r.taken and parts == sorted(parts)
        for s, n in parts:
            words[s][source[r.doc_id]] += n
        target[source[r.doc_id]] = r.target
        sizes[source[r.doc_id]] += r["size"]
    names = sorted((x for x in target if round(target[x]) > 0), key=str)
    want = sum(target.values())
    assert len(words) >= want // (16 * mixing.BLOCK)
    assert max(sum(w.values()) for w in words.values()) <= 16 * mixing.BLOCK
    # the shards' words by source are the drawn slots', but for short blocks
    sid = {r["source"]: r["sid"] for r in mixing.source_targets(mixing.word_counts(docs)).collect()}
    names.sort(key=lambda x: sid[x])
    slots = [mixing.slots_of(sizes[x], target[x])[3] for x in names]
    for shard, _, own in mixing.shard_counts(slots, 16, 0, 10**9, 7):
        for x, k in zip(names, own):
            assert (k - 3) * mixing.BLOCK <= words[shard][x] <= k * mixing.BLOCK


def test_another_draw_is_another_mix(docs, monkeypatch):
    before = sorted(map(str, mixing.mix(docs, 7, 16).collect()))
    assert before == sorted(map(str, mixing.mix(docs.repartition(2), 7, 16).collect()))
    assert before != sorted(map(str, mixing.mix(docs, 8, 16).collect())) != sorted(map(str, mixing.mix(docs, 8, 32).collect()))


def test_rows_that_differ_in_a_map_stay_apart(docs):
    mixed = mixing.mixed_documents(docs)
    assert mixed.schema["m"] == docs.schema["m"]
    assert docs.select(mixing.row_id(docs).alias("r")).distinct().count() == docs.count() - 1
    assert mixed.where((F.col("doc_id") == 3) & (F.col("m")["a"] == 5)).count() <= 1
