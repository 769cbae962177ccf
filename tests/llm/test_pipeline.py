import random
from collections import Counter

import corpus_pipeline as P
from edges import edge_frame
from test_shingle_dedup import plain_first

from normcast.llm.hash_mixing import mix
from normcast.llm.importance_resampling import resample
from normcast.llm.scratch import written


def test_stages_take_effect(spark, small):
    """Each stage on what its predecessor kept: its columns, and the rows that a plain version keeps."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in P.STAGES:
        out = written(stage(spark, docs, small), name)
        before, after = docs.collect(), out.collect()
        if name != "packing":
            assert out.columns == docs.columns and set(after) <= set(before)
        if name == "quality":
            kept = {r["id"] for r in resample(docs, spark.read.parquet(f"{small}/labels.parquet")).filter("kept").collect()}
            assert {r["doc_id"] for r in after} == kept and 0 < len(after) < len(before)
        if name == "language":
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"])}  # all are in learned languages
        if name == "near_duplicates":  # the contract of stages: five words, a similarity of 0.8
            assert sorted(r["doc_id"] for r in after) == plain_first([(r["doc_id"], r["text"]) for r in before])
        if name == "mixture":
            assert Counter(r["doc_id"] for r in after) == +Counter({r["id"]: r["epochs"] for r in mix(docs).collect()})
        if name == "packing":
            whole = Counter()
            for r in after:
                whole[r["doc_id"]] += r["length"]
            times = Counter(r["doc_id"] for r in before)
            assert set(whole) == set(times) and all(whole[r["doc_id"]] == times[r["doc_id"]] * r["doc_tokens"] for r in after)
        docs = out
    assert P.run(spark, small).count() == len(after)


def test_stages_pass_awkward_rows(spark, small):
    docs = edge_frame(spark)
    for name, stage in P.STAGES:
        out = written(stage(spark, docs, small), name)
        assert name == "packing" or out.columns == docs.columns
        docs = out
    docs = edge_frame(spark).limit(0)
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, small), name)
    assert docs.count() == 0


FOREIGN = (
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
    "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。" * 20,
)


def test_language_stage_rejects_what_no_language_explains(spark, small):
    """Texts in other languages and of random letters go at any length; all texts in the learned languages stay."""
    rng = random.Random(4)
    gibberish = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n)) for n in (20, 200, 5_000)]
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("text RLIKE '[a-z]'").select("doc_id", "text", "lang")
    more = [(10**6 + i, t * k, None) for i, (t, k) in enumerate([(t, k) for t in FOREIGN for k in (1, 30)] + [(t, 1) for t in gibberish])]
    out = P.language(spark, docs.union(spark.createDataFrame(more, docs.schema)), small)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in docs.collect())
