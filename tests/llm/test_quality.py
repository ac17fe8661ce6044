import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import quality


def corpus():
    draw = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(draw.choice(["an", "the", "er", "in", "st"]) for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(5, 80))]
        good = draw.random() < 0.7
        text = " ".join(words) if good else " ".join(w.upper() + "!!" if i % 2 else w + "%%%" for w in words)
        rows.append((i, text))
        labels.append((i, int(good)))
    rows += [(None, "no id"), (601, None), (602, ""), (603, "a " * 60_000), (3, rows[3][1])]
    labels += [(601, None), (3, labels[3][1]), (999, 1), (None, 1)]
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("own"))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_held_out_accuracy(tables):
    docs, labels, known = tables
    rows = quality.score_quality(docs, labels, keep=["doc_id"]).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 600 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= quality.THRESHOLD) == known[r["doc_id"]] for r in held]) > 0.95


def test_same_scores_however_the_rows_are_dealt(tables):
    docs, labels, _ = tables
    first = quality.score_quality(docs, labels, keep=["doc_id"]).collect()
    again = quality.score_quality(docs.repartition(5), labels.repartition(2), keep=["doc_id"]).collect()
    rounded = [sorted((str(r["doc_id"]), round(r["score"], 9)) for r in rows) for rows in (first, again)]
    assert rounded[0] == rounded[1]


def test_labels_of_one_kind_and_none(tables, spark):
    docs, labels, _ = tables
    few = docs.filter("doc_id < 5")
    assert {r["score"] for r in quality.score_quality(few, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality.score_quality(few, spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, quality int")).collect()} == {1.0}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_shapes():
    assert quality.shape(b"Word!!") == b"Aa!" and quality.shape("Éa12".encode()) == b"a0" and quality.shape(b"") == b""
