import random

import corpus_pipeline
from tests.llm.test_corpus_operators import DOCS, near_rows, odd_rows, prose, slow_components, slow_lines, table
from utterloom.llm import lines


def test_stages_follow_each_other(spark, tmp_path):
    rng = random.Random(30)
    rows = near_rows(rng) + [(5000 + i, prose(rng, 90), rng.choice(["en", None]), rng.choice("ab"), 0) for i in range(60)] + odd_rows()
    docs, seen = table(spark, rows), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "pack":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = [tuple(r) for r in docs.collect()]
        was = [tuple(r) for r in before.collect()]
        if name == "line_dedup":
            gone = {r[0]: r[2] for r in slow_lines(was)}
            assert {r[0]: len(lines.lines_of(r[1])) for r in seen[name]} == {r[0]: n - gone[r[0]] for r in was for n in [len(lines.lines_of(r[1]))] if n > gone[r[0]]}
        if name == "near_dedup":
            assert sorted(r[0] for r in seen[name]) == sorted(r[0] for r in slow_components(was, corpus_pipeline.NEAR_PERCENT) if r[3])
    assert all(len((r[1] or "").split()) >= 50 for r in seen["quality"]) and set(seen["mix"]) <= set(seen["near_dedup"])
    assert {r[0] for r in seen["pack"]} == {r[0] for r in seen["mix"]}


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
