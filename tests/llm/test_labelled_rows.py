"""Fits collect at most one row for each labelled id, however often a row is repeated."""

import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import quality_rules, severity

from .conftest import docs_of


def test_one_row_of_a_labelled_id_is_fitted(spark, monkeypatch):
    words = "a fine day with many plain words in every line of it"
    texts = [f"{words} {i} " + ("awful nasty " * 3 if i % 2 else "good calm " * 3) for i in range(80)]
    docs = docs_of(spark, [*texts, *[texts[1]] * 400], [*range(80), *[1] * 400])
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(80)], "doc_id bigint, quality int, toxic int")
    seen = {}

    def learn(x, bad, **_):
        seen["quality"] = len(bad)
        return []

    def train(rows, grades, *_, **__):
        seen["severity"] = (len(rows), len(grades), int(np.sum(grades > 0)))
        return severity.Severity()

    monkeypatch.setattr(quality_rules, "learn", learn)
    monkeypatch.setattr(severity, "train", train)
    quality_rules.fit(docs, labels)
    severity.fit_toxic(docs, labels)
    once = docs.groupBy("doc_id").agg(F.first("text").alias("text"))
    kept = quality_rules.quality_rules(once, []).where("not base_failed").count()
    assert seen == {"quality": kept, "severity": (80, 80, 40)} and kept > 0
