"""What small groups of rows hold counts too."""

import math

import pytest

from cadence.llm import language_model, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_toxicity_of_a_rare_language(spark):
    """Five of 305 toxic training rows (and 20 clean ones) are of another language, with a word of its own."""
    rows, labels = [], []
    for i in range(620):
        rare = i % 122 in (0, 1, 3, 5, 7) or i >= 610
        word = ("canalla" if rare else "idiot") if i % 2 == 0 else "cat"
        rows.append((i, f"plain words here. w{i % 7} {word} x." if not rare else f"otras palabras. v{i % 3} {word} y.", None, None, 0))
        labels.append((i, int(i % 2 == 0)))
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.fit(docs.where("doc_id < 610"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score(docs.where("doc_id >= 600").selectExpr("*", "false AS held_out"), model).collect()}
    assert got == {i: i % 2 == 0 for i in range(600, 620)}


def test_language_model_keeps_what_is_seen_once(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    levels, n, v = language_model.train(docs)
    assert (n, v) == (4, 4)
    got = language_model.scores(docs, levels, n, v, ["doc_id"]).collect()[0]["score"]
    # every n-gram occurs once, and so does its context: each level gives 0.25 and leaves 0.75
    two = 0.25 + 0.75 * 2 / 9
    three = 0.25 + 0.75 * two
    assert got == pytest.approx(math.log10(two) + 3 * math.log10(three), abs=0.02)
