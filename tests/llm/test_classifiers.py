from scatterlake.llm import langid, toxicity

SF = "/root/testdata/sf0.1"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, "the cat and the dog of the town", "en", 1), (2, "der Hund und die Katze", "de", 1), (3, None, "en", 1), (4, "", None, 1), (5, "123 !", "de", 1),
         (None, "the", "en", 1), (6, "日本", None, 1)] * 2, "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[5]["lang_pred"] == "und" and got[3]["score"] == 0
    assert got[6]["lang_pred"] in ("en", "de") and not got[None]["held_out"]
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0))).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(docs.limit(0))).collect()} == {"und"}


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    clean = [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.8 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "x", 5), (None, "you idiot", 5)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0}
    model = toxicity.train(["you idiot moron"] * 30 + ["a good and quiet day"] * 30, [1] * 30 + [0] * 30)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert got[None] > 0.7 and all(0 <= v <= 1 for v in got.values())
    assert toxicity.score(docs.limit(0), model).count() == 0
