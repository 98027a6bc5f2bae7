"""The pipeline's stages in order, each against what its operator says."""

import hashlib
import random

import corpus_pipeline
from ionlake.llm import toxicity
from ionlake.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == names
        path = f"/tmp/ionlake-test-{id(docs)}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        assert docs.count() > 0 and docs.join(before, "doc_id", "left_anti").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count()


def test_first_stage_rejects_what_the_classifier_rejects(spark):
    docs = table(spark, SF, "documents")
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).select("doc_id").collect()}
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, SF, "labels"))).collect()
    assert kept == {r["doc_id"] for r in scored if not r["predicted"]}


def test_run_gives_rows(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def folder_of(spark, tmp_path, rows, labels):
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, rep string, component int, kept boolean, label int").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))


def awkward(text):
    return [(i, t, lang, s, None if t is None else len(t), 1, "x", 2, True, None) for i, t, lang, s in text]


def test_awkward_tables_pass_through(spark, tmp_path):
    """Nulls everywhere, repeated ids and rows, copies, a very long text, and columns named like the operators' own."""
    long = "\n".join(prose(1000 + k, 30) for k in range(300))
    near = prose(50, 200)
    rows = [(0, prose(1, 60), "en", "a"), (1, prose(1, 60), None, "b"), (2, near, "de", None), (3, near.replace("a", "b", 1), "de", "a"), (4, None, None, None), (5, "", "en", "a"), (6, " \n ", "en", ""), (None, prose(2, 40), "fr", "b"), (None, prose(3, 40), "fr", "b")]
    rows += [(7, prose(4, 50), "en", "a"), (7, prose(5, 50), "en", "a"), (8, prose(6, 20), "en", "c"), (8, prose(6, 20), "en", "c"), (9, long, "en", "a"), (10, "ünï 漢字 😀", "es", "b")]
    sf = folder_of(spark, tmp_path, awkward(rows), [(i, 1, 0) for i in range(11)] + [(None, None, None), (3, None, None)])
    docs, names = table(spark, sf, "documents"), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        names, before = docs.columns, docs
        docs = stage(spark, before, sf)
        path = str(tmp_path / f"stage{k}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == names
        ids = sorted(str(r["doc_id"]) for r in docs.collect())
        if name == "line_dedup":
            texts = [r["text"] for r in docs.collect()]
            assert docs.count() == before.count() and sum(prose(1, 60) == t for t in texts) == 1 and sum(t is None for t in texts) == 1 and long in texts
        if name == "minhash_dedup":
            assert ids.count("7") == 2 and ids.count("None") == 2 and ids.count("4") == ids.count("5") == ids.count("6") == 1
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in out) == sorted((str(r["doc_id"]), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect())
    assert len(corpus_pipeline.run(spark, sf).collect()) == len(out)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder_of(spark, tmp_path, [], [])).count() == 0
