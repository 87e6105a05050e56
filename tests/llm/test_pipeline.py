import random

import corpus_pipeline
from factloom.llm import neardup


def test_pipeline_on_planted_rows(spark, tmp_path):
    rng = random.Random(8)
    kinds = {"en": ["the", "ing", "tion", "er"], "fr": ["eau", "oui", "é", "ment"]}
    word = lambda k: "".join(rng.choice(kinds[k]) for _ in range(3))
    text = lambda k, n=60: " ".join(word(k) + str(rng.randint(0, 9)) for _ in range(n))
    item = text("en", 25)
    rows = [(i, text(k), k) for i, k in enumerate(["en", "fr"] * 30)]
    rows += [(100, rows[0][1], "en"), (101, rows[2][1] + " added", "en"), (102, None, "en"), (103, "12 34", "fr"), (104, text("en", 30) + " " + item, "en"), (105, text("fr") + " password = Zx81kQp0aLmN7", "fr")]
    docs = spark.createDataFrame([(i, t, k, f"src{i}", len(t or "")) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(range(60)) | {105}
    assert bytes(out[105].decoded).decode().endswith("[SECRET]") and bytes(out[7].decoded).decode() == rows[7][1]
    columns = docs.columns
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == columns, name
    assert neardup.drop_near_copies(docs.limit(0)).count() == 0


def test_pipeline_on_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, th string"
    words = ["the", "coal", "of", "mines", "and", "output", "rose", "fell", "in", "a", "year"]
    say = lambda n, seed: " ".join(random.Random(seed).choices(words, k=n))
    long = say(40000, 1)
    item = "When the seventh engine left the yard it carried eleven crates of tin and two barrels"
    rows = [(1, long, "en"), (2, long + " more words", "en"), (None, say(50, 2), "en"), (None, say(50, 2), "en"), (None, "so " + item, "en"), (7, say(60, 3), "en"), (7, say(60, 4), "en"), (8, None, "en"), (9, "", None), (10, "!!! 12", "en"), (11, say(55, 5) + " token: hunter2hunter2hunter2", "fr"), (12, say(30, 6), None)]
    for name, data in (("full", rows), ("none", [])):
        spark.createDataFrame([(i, t, k, "s", len(t or ""), 0.5, "clash") for i, t, k in data], schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/full")
    assert out.columns == ["doc_id", "ids", "decoded"]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(bytes(r.decoded).decode())
    assert set(got) == {1, None, 7, 11, 12} and got[1] == [long] and len(got[7]) == 1 and got[None] == [rows[2][1]] * 2
    assert got[11] == [say(55, 5) + " [SECRET]"]
    empty = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert empty.columns == out.columns and empty.count() == 0
    docs = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/full")
        assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
    assert {r.th for r in docs.collect()} == {"clash"}
