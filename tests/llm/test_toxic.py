import random

import corpus_pipeline as P
from edges import sentence

from normcast.llm.importance_resampling import resample

INSULTS = ["idiot", "moron", "clown", "scum"]


def test_toxic_texts_go_and_clean_ones_stay(spark, tmp_path):
    """Labelled and unlabelled toxic texts of any length go; the rest stay."""
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(400):
        words = sentence(rng, "en", rng.choice([30, 90, 900])).split()
        if toxic := i % 8 == 0:
            for at in rng.sample(range(len(words)), max(2, len(words) // 50)):
                words[at] = rng.choice(INSULTS) + rng.choice(["", ",", "."])
        rows.append((i, " ".join(words)))
        if i % 16 in (0, 3, 5):
            marks.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    kept = {r["id"]: r["kept"] for r in resample(docs, labels).collect()}
    assert {i for i, k in kept.items() if not k} == set(range(0, 400, 8))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert {r["doc_id"] for r in P.quality(spark, docs, str(tmp_path)).collect()} == {i for i in range(400) if i % 8}
