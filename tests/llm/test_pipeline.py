"""The stages on planted cases."""

import random

import corpus_pipeline as P
from lumenframe.llm.common import staged


def test_stages(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = [f"word{i}" for i in range(3000)]
    made = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, benchmark = made(60), made(40)
    rows = [(i, made(100)) for i in range(60)]
    near = made(120).split()
    rows += [(100 + k, " ".join(near[:k] + ["odd"] + near[k + 1 :])) for k in range(3)]
    rows += [(200, made(30) + "\n" + passage), (201, passage + "\n" + made(30)), (300, made(20) + " " + benchmark), (400, "vile idiotscum " + made(30))]
    bad = [(500 + i, made(30) + " idiotscum vile " + made(5)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows + bad], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in rows[:60]] + [(i, 1, 1) for i, _ in bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, benchmark)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {}
    for name, stage in P.STAGES:
        docs = staged(stage(spark, docs, str(tmp_path)), "t")
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    clean = set(range(60))
    assert clean <= left["toxicity"] and 400 not in left["toxicity"] and not left["toxicity"] & {i for i, _ in bad}
    assert left["line_dedup"] == left["toxicity"]
    assert left["ngram_jaccard_join"] & {100, 101, 102} == {100} and clean <= left["ngram_jaccard_join"]
    assert left["ngram_jaccard_join"] - left["decontamination"] == {300}
    assert left["best_fit_packing"] == left["decontamination"]


def test_odd_rows(spark, tmp_path):
    rng = random.Random(9)
    made = lambda n: " ".join(f"w{rng.randrange(2000)}" for _ in range(n))
    long = made(20_000)
    rows = [(1, made(80)), (2, None), (3, ""), (4, long), (None, made(60)), (6, made(50)), (6, made(50)), (7, " \n\n ")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, class_id long, bin int, pool int, length long"
    docs = spark.createDataFrame([(i, t, None, None, None, 5, 6, 7, 8, 9) for i, t in rows], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for given, kept in ((docs, True), (docs.where("false"), False)):
        left = given
        for name, stage in P.STAGES[:-1]:
            left = staged(stage(spark, left, str(tmp_path)), "odd")
            assert left.columns == docs.columns, name
        ids = [r.doc_id for r in left.select("doc_id").collect()]
        packed = P.STAGES[-1][1](spark, left, str(tmp_path)).collect()
        if kept:
            assert {1, 4, None} <= set(ids) and ids.count(6) == 2
            assert {r.doc_id for r in packed} == set(ids)
        else:
            assert ids == [] and packed == []
