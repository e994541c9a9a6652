import numpy as np
from scatterlake.llm import toxicity


def test_marks_behind_long_clean_text_are_learned(spark):
    rng = np.random.default_rng(2)
    words = ["river", "table", "garden", "window", "letter", "market", "winter", "bridge", "story", "paper"]
    rows, labels = [], []
    for i in range(240):
        toxic = i % 2
        text = " ".join(rng.choice(words, 900)) + (" you vile grobnik" * 60 if toxic else " you kind neighbour" * 60)
        assert text.index(" you") > 4000
        rows.append((i, text))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, table)).where("held_out").collect()
    assert len(got) > 20 and all(r["predicted"] == r["doc_id"] % 2 for r in got)


def test_fit_equals_training_on_the_whole_texts(spark):
    rows = [(i, ("you idiot " if i % 2 else "a quiet day ") * (1 + i % 5 * 300)) for i in range(80)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id int, toxic int")
    model = toxicity.fit(docs, labels)
    used = sorted(r["doc_id"] for r in toxicity.score(docs, model).where("not held_out").collect())
    text = dict(rows)
    same = toxicity.train([text[i] or "" for i in used], [i % 2 for i in used])
    assert np.allclose(model.margin, same.margin) and abs(model.bias - same.bias) < 1e-9
