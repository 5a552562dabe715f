import random

import corpus_pipeline
from cuelight.llm import pii


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    item = [word() for _ in range(24)]
    rows, labels = [], []
    for i in range(150):
        words, label = [word() for _ in range(rng.randint(30, 60))], 0
        if i % 5 == 0:
            words[3:3] = ["vilefoo", "grobzart", "vilefoo"]
            label = 1
        elif i % 7 == 0:
            words += item
        elif i % 11 == 0:
            words += ["mail", "a.b@mail.example.com"]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, label))
    rows.append((900, rows[1][1] + " more"))
    rows += [(901, None), (902, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        ids.append({r["doc_id"] for r in kept.select("doc_id").collect()})
    every = {i for i, _ in rows}
    assert ids[0] == {i for i in every if i >= 900 or i % 5}
    assert ids[1] == ids[0] - {900}
    assert ids[2] == {i for i in ids[1] if i >= 900 or i % 7 or i % 5 == 0}
    assert ids[3] == ids[2]
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts == {i: pii.redacted(t) for i, t in rows if i in ids[3]}
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(packed.doc_id) == ids[3] and packed.groupby("sequence_id").length.sum().max() <= 1024
