import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, toxicity

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def auc(rows):
    up, down = [r.score for r in rows if r.y == 1], [r.score for r in rows if r.y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down))


@pytest.mark.parametrize("op,label", [(toxicity.op3, "toxic"), (quality.op10, "quality")])
def test_held_out_labels(spark, op, label):
    scored = op(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    every = scored.join(labels, "doc_id", "left").collect()
    assert len(every) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 for r in every)
    held = [r for r in every if r.held_out and r.y is not None]
    value = auc(held)
    right = sum(r.predicted == r.y for r in held) / len(held)
    print(label, "held out", len(held), "AUC", round(value, 4), "right", round(right, 4), "clean rejected", sum(r.predicted == 1 and r.y == 0 for r in held), "of", sum(r.y == 0 for r in held), "found", sum(r.predicted == 1 and r.y == 1 for r in held), "of", sum(r.y == 1 for r in held))
    assert value > 0.8


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, None), (2, ""), (None, "x"), (1, "good words here")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    assert quality.quality(docs, labels).count() == 5
    assert quality.quality(docs.limit(0), labels.limit(0)).count() == 0
    machine = toxicity.train(docs, labels)
    assert toxicity.score(docs, machine).count() == 5
    assert toxicity.score(docs.limit(0), machine).count() == 0


def test_toxic_passage_after_many_words_is_learned(spark):
    clean = " ".join(f"w{i % 97}" for i in range(20_100))
    rows = [(i, clean + (" vile zorg brute scum" if i % 2 else " fine calm kind soul"), i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.train(docs, docs.select("doc_id", "toxic"))
    got = {r.text: r.tox_score for r in toxicity.score(spark.createDataFrame([("vile zorg brute scum",), ("fine calm kind soul",)], "text string"), machine).collect()}
    assert got["vile zorg brute scum"] > 0.7 > 0.5 > got["fine calm kind soul"]


@pytest.mark.parametrize("length", [(8, 20), (40, 40), (100, 100), (200, 200)])
def test_words_that_are_toxic_only_together(spark, length):
    """Both words are as frequent in either class: a linear score can't tell the classes, the factors do."""
    r = random.Random(8)
    filler = [f"w{i}" for i in range(300)]

    def text(*said):
        words = [r.choice(filler) for _ in range(r.randint(*length))]
        for w in said:
            words.insert(r.randrange(len(words) + 1), w)
        return " ".join(words)

    # class 1 has both words or neither has to be clean: half of each class's texts hold each word
    rows = []
    for i in range(1600):
        toxic = i % 2
        both = r.random() < 0.5
        said = (("vermin", "martians") if both else ("scum", "venusians")) if toxic else (("vermin", "venusians") if both else ("scum", "martians"))
        rows.append((i, text(*said), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.train(docs, docs.select("doc_id", "toxic"))
    learned = [r_ for r_ in toxicity.score(docs, machine).select(F.col("tox_score").alias("score"), F.col("toxic").alias("y"), (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held")).collect() if r_.held]
    assert auc(learned) > 0.95
    plain = toxicity.Machine(machine.bias, machine.weights, machine.factors * 0)
    linear = [r_ for r_ in toxicity.score(docs, plain).select(F.col("tox_score").alias("score"), F.col("toxic").alias("y"), (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held")).collect() if r_.held]
    assert 0.35 < auc(linear) < 0.65
