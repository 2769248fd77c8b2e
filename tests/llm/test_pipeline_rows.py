"""run()'s rows against a chain of plain versions of its stages."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tokenizers

import corpus_pipeline
from kilnworks.llm import mixing, packing, toxicity
from kilnworks.llm.queries import BYTES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SECRET = "password=hunter22x"


def documents():
    r = random.Random(12)
    words = [f"word{i}" for i in range(500)]
    out = []
    for i in range(260):
        t = [r.choice(words) + r.choice(["", ".", ","]) for _ in range(r.randint(5, 120))]
        if i % 7 == 0:
            t += ["idiot", "scum", "moron"]
        if i % 40 == 9:
            t.insert(3, SECRET)
        out.append((i, " ".join(t), "en", f"s{i % 3}", 0, 0.5))
    for i in range(260, 290):  # near copies of clean texts, and exact ones
        t = out[i - 259][1].split()
        if i % 3:
            t[-1] = "changed"
        out.append((i, " ".join(t), "de", "s1", 0, 0.5))
    out += [(290, None, "en", None, 0, 0.5), (291, "", "en", "s0", 0, None), (None, "a text without an id " * 5, "en", "s2", 0, None), (292, "long " + " ".join(f"w{i}" for i in range(9000)), "en", "s0", 0, None)]
    return out


def shingles(t):
    w = WORD.findall(t or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long, score double").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_rows_of_run(spark, place):
    docs, labels = spark.read.parquet(f"{place}/documents.parquet"), spark.read.parquet(f"{place}/labels.parquet")
    model = toxicity.fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    rows = [d for d in documents() if model.scores(pa.array([d[1]]))[0] < toxicity.THRESHOLD]
    bad = [d for d in documents() if d[1] and "idiot scum" in d[1]]
    assert len(rows) < 290 and sum(d in rows for d in bad) <= 0.1 * len(bad) and sum(d not in rows for d in documents() if d not in bad) <= 3
    # near-duplicates: exact links between shingle sets, the least id of each class
    rank = lambda d: 2**63 if d[0] is None else d[0]
    rows.sort(key=rank)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [shingles(d[1]) for d in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if (rows[i][1] or "") == (rows[j][1] or "") or (a and b and len(a & b) >= 0.8 * len(a | b)):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    rows = [d for i, d in enumerate(rows) if find(i) == i]
    rows = [(d[0], d[1] and d[1].replace(SECRET, "[SECRET]"), *d[2:]) for d in rows]
    # mixing: how many words of each text, by source
    after = spark.createDataFrame([(*d[:4], len(d[1]) if d[1] is not None else None, d[5]) for d in rows], docs.schema)
    sizes = collections.Counter()
    for d in rows:
        sizes[d[3]] += len(WORD.findall(d[1] or ""))
    names = sorted((x for x in sizes if x is not None)) + ([None] if None in sizes else [])
    size, weight = np.array([sizes[x] for x in names], float), np.array([(5, 2, 1)[k % 3] for k in range(len(names))], float)
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if np.minimum(weight * mid, 2 * size).sum() < 1.5 * size.sum() else (low, mid)
    target = dict(zip(names, np.minimum(weight * low, 2 * size)))
    got = collections.defaultdict(list)
    pieces = corpus_pipeline.run(spark, place).collect()
    for p in pieces:
        got[p.doc_id].append(p)
    taken = {r.doc_id: r.taken for r in mixing.mix(after).collect()}
    words = collections.Counter()
    for d in rows:
        words[d[3]] += taken[d[0]]
    assert all(abs(words[x] - target[x]) <= 0.5 + 1e-6 for x in names)
    mixed = {r.doc_id: r.text for r in mixing.mixed_documents(after).collect()}
    assert set(mixed) == {d[0] for d in rows if taken[d[0]] or not WORD.findall(d[1] or "")} == set(got)
    plain = {d[0]: WORD.findall(d[1] or "") for d in rows}
    for i, t in mixed.items():
        have = collections.Counter(WORD.findall(t or ""))
        assert sum(have.values()) == taken.get(i, 0) and all(n <= 2 * plain[i].count(w) for w, n in have.items())
    # packing: each text's ids by the library, piece by piece
    tok = tokenizers.Tokenizer.from_file(BYTES)
    sequences = collections.defaultdict(list)
    for i, own in got.items():
        ids = np.array([*tok.encode(mixed[i] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == [0, *itertools.accumulate(p.length for p in own)][:-1] and sum(p.length for p in own) == len(ids) == own[0].doc_tokens
        for p in own:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            sequences[p.sequence_id].append((p.offset, p.length))
    total = waste = 0
    for own in sequences.values():
        own.sort()
        n = sum(k for _, k in own)
        assert [o for o, _ in own] == [0, *itertools.accumulate(k for _, k in own)][:-1] and n <= 2048
        total, waste = total + n, waste + packing.padded(n) - n
    assert waste < 0.1 * total


def test_columns_named_as_the_model_s_stay(spark, place):
    docs = spark.read.parquet(f"{place}/documents.parquet")
    out = corpus_pipeline.drop_toxic(spark, docs, place)
    assert out.columns == docs.columns and {r.score for r in out.collect()} == {0.5, None}
