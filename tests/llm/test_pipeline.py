"""Every stage of the pipeline against what its operator says, on small tables."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from quayside.llm import decontamination, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(0)
    pool = [f"w{i}" for i in range(3000)]
    prose = lambda n: " ".join(r.choice(pool) for _ in range(n))
    items = [prose(30) for _ in range(4)]
    rows, labels = [], []
    for i in range(240):
        text, label = (prose(150), 1) if i % 4 else ("SPAM!! SPAM!! " * 50 + str(i), 0)
        rows.append([i, text, "en", f"s{i % 3}", len(text)])
        labels.append((i, label, 0))
    clean = [x for x in rows if x[0] % 4]
    for j, x in enumerate(clean[:5]):
        rows.append([1000 + j, x[1] + " tail", "en", "s0", 0])
    rows[-1][1] = clean[0][1]
    for j in range(4):
        rows.append([2000 + j, prose(80) + " " + items[j] + " " + prose(80), "en", "s1", 0])
    rows += [[None, None, None, None, None], [3000, "", None, None, 0]]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == COLUMNS, name
            kept.append([r["doc_id"] for r in docs.collect()])
            if i == 0:
                said = quality.classify(before, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1")
                assert sorted(map(str, kept[0])) == sorted(str(r["doc_id"]) for r in said.collect())
            if i == 2:
                gone = {r["doc_id"] for r in decontamination.contaminations(before, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
                assert set(kept[1]) - set(kept[2]) == gone
    assert not any(k is not None and k < 240 and k % 4 == 0 for k in kept[0])
    assert all(k in kept[0] for k in range(240) if k % 4)
    assert not set(range(1000, 1005)) & set(kept[1]) and {k for k in range(240) if k % 4} <= set(kept[1])
    assert not set(range(2000, 2004)) & set(kept[2]) and {k for k in range(240) if k % 4} <= set(kept[2])
    assert docs.count() == len(kept[3]) and {r["shard"] for r in docs.collect()} <= set(range(16))
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_rows_without_an_id_are_judged(spark, tmp_path):
    r = random.Random(7)
    prose = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    item, one, two, three = prose(30), prose(80), prose(80), prose(80)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(5, one), (None, one + " tail"), (None, two), (None, two), (None, three), (None, prose(40) + " " + item), (6, prose(40) + " " + item)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    near = [tuple(x) for x in corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect()]
    assert sorted(map(str, near)) == sorted(map(str, [texts[0], texts[2], *texts[4:]]))
    clean = [tuple(x) for x in corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).collect()]
    assert sorted(map(str, clean)) == sorted(map(str, texts[:5]))
