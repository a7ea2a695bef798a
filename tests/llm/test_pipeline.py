"""The pipeline on a small folder: planted copies, passages, insults and benchmark text go, clean documents stay."""

import random

import corpus_pipeline
from pyspark.sql import functions as F


def test_pipeline(spark, tmp_path):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8))) for _ in range(500)]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    texts = [line(150) for _ in range(200)]
    item, passage = line(30), line(70)
    labels = []
    for i in range(200):
        toxic = int(i % 4 == 0)
        if toxic:
            texts[i] += " " + r.choice(["zuxqo", "zuxqon", "zuxqor"])
        labels.append((i, 1, toxic))
    texts[5] += " " + item
    texts[7] = texts[6]
    texts[10] = texts[9].replace(" ", "  ", 1) + " end"
    texts[13] += " " + passage
    texts[15] = passage + " " + texts[15]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(300, None, None, None, None), (301, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs.count()
        out = stage(spark, docs, str(tmp_path))
        if name != "bpe":
            assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars"])
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append({x["doc_id"] for x in docs.select("doc_id").collect()})
    assert not {i for i in seen[0] if i < 200 and i % 4 == 0} and len(seen[0]) == 152
    assert seen[0] - seen[1] == {7, 10}
    assert seen[2] == seen[1] and seen[2] - seen[3] == {5} and seen[4] == seen[3]
    cleaned = {x["doc_id"]: x for x in spark.read.parquet(f"{tmp_path}/2").collect()}
    assert passage not in cleaned[13]["text"] and cleaned[13]["n_chars"] == len(cleaned[13]["text"])
    assert cleaned[1]["text"] == texts[1] and cleaned[300]["text"] is None
    assert docs.where((F.col("doc_id") < 200) & (F.size("ids") != F.col("n_tokens"))).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])
