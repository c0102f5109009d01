"""Out-of-fold predictions know nothing of the labels that they are made for."""

import random

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import linear, toxicity


def ranks_right(p, y):
    """The share of pairs of a 1 and a 0 that p orders right; ties count half."""
    a, b = p[y == 1][:, None], p[y == 0][None, :]
    return float((a > b).mean() + 0.5 * (a == b).mean())


def test_features_are_chosen_inside_the_folds(spark, monkeypatch):
    monkeypatch.setattr(linear, "MIN_SCORE", 4.0)  # many features that fit the labels by chance
    r = random.Random(7)
    word = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(4))
    texts = [(i, " ".join(word(r.randrange(2500)) for _ in range(60))) for i in range(300)]
    labels = [(i, r.randrange(2)) for i in range(300)]
    rows = linear.training_rows(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, a int"), ["a"], 1000)
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3)).cast("int"))
    x, y = linear.collect_rows(rows, linear.select_buckets(rows, "y0", 2, 1024), ["y0", "fold"])
    out = toxicity._out_of_fold(rows, ["y0", "fold"], 0, None, 0.5, 1024, 3)
    assert 0.38 < ranks_right(out, y[:, 0]) < 0.62
    leaked = np.zeros(x.n)
    for f in range(3):  # the same folds with features that all labels have chosen
        train = y[:, 1] != f
        leaked[~train] = linear.softmax(x.rows(~train).times(linear.fit(x.rows(train), y[train, 0], 2)))[:, 1]
    assert ranks_right(leaked, y[:, 0]) > 0.75
