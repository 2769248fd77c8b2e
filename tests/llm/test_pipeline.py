import collections

import corpus_pipeline


def test_stages(spark, tmp_path):
    words = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(240):
        w = [words[(i * 37 + 11 * k) % 400] + str(i % 9) for k in range(60)]
        if i % 6 == 0:
            w += ["idiot", "scum", "moron"]
            labels.append((i, 0, 1))
        else:
            labels.append((i, 1, 0))
        if i % 50 == 7:
            w.append("token=abcdefgh12345")
        docs.append((i, " ".join(w), "en", f"s{i % 2}", 0))
    docs += [(240, docs[1][1], "en", "s0", 0), (241, None, "en", None, 0), (242, "", "en", "s1", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k < 4:
            assert out.columns == at.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r for r in at.collect()}
    clean = {i for i in range(243) if i >= 240 or i % 6}
    assert set(kept["toxicity"]) == clean
    # one of equal texts stays; a null and an empty text are equal
    assert set(kept["near_duplicates"]) == clean - {240, 242}
    assert set(kept["secrets"]) == set(kept["near_duplicates"])
    assert all("abcdefgh12345" not in (r.text or "") for r in kept["secrets"].values())
    assert any("[SECRET]" in (r.text or "") for r in kept["secrets"].values())
    total = collections.Counter()
    for r in at.collect():
        total[r.doc_id] += r.length
    assert set(total) == set(kept["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()
