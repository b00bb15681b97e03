import random

import corpus_pipeline
from wayline.llm import decontaminate, language_id, near_dedup, pii


def test_pipeline_equals_its_parts(spark, tmp_path, documents):
    rng = random.Random(1)
    words = {"en": "the of and to in that is was for with".split(), "fr": "le la les des une dans que pour avec sur".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(["", "er", "on"]) for _ in range(n))
    rows = [(i, text(lang, 50), lang, "s") for i, lang in enumerate(["en", "fr"] * 30)]
    item = text("en", 40)
    rows += [(100, rows[0][1], "en", "s"), (101, "12 34", "en", "s"), (102, f"{text('en', 20)} {item} {text('en', 20)}", "en", "s"), (103, text("en", 30) + " mail a@b.com now", "en", "s")]
    documents(rows).drop("uid").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append({r.doc_id for r in docs.collect()})
    everything = {r[0] for r in rows}
    assert sizes[0] == everything - {101} and sizes[1] == sizes[0] - {100} and sizes[2] == sizes[1] - {102} and sizes[3] == sizes[2]
    assert docs.where("doc_id = 103").first().text.endswith("mail [EMAIL] now")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == sizes[3]
    assert [m.__name__ for m in (language_id, near_dedup, decontaminate, pii)]


def test_pipeline_on_empty_tables(spark, tmp_path, documents):
    documents([]).drop("uid").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
