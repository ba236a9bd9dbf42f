"""Learning quality from tables whose ids repeat, and calibration by documents left out."""

import numpy as np
from pyspark.sql import functions as F

from strataloom.llm import quality


def test_learned_rows_are_bounded_besides_ids(spark, monkeypatch):
    """One id with thousands of texts brings about `most` rows to the driver; equal rows count once."""
    seen = []
    monkeypatch.setattr(quality, "fit_calibrated", lambda x, y: seen.append(len(y)) or quality.fit(x, y, rounds=1))
    many = spark.range(6000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"))
    copies = spark.range(3000).select(F.lit(2).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 0)], "doc_id long, quality int")
    quality.learn(many.unionByName(copies), labels, most=200)
    assert 120 <= seen[0] <= 300
    rows = quality.rate_quality(copies, copies, labels, text="text").agg(F.count_distinct("quality_score"), F.count("*")).first()
    assert seen[1] == 1 and tuple(rows) == (1, 3000)


def test_calibration_follows_documents_left_out():
    rng = np.random.default_rng(1)
    y = (rng.random(4000) < 0.8).astype(float)
    margin = 3 * (rng.normal(size=4000) + y)  # three times as sure as it may be
    scale, shift = quality.calibration(margin, y)
    p = 1 / (1 + np.exp(-(scale * margin + shift)))
    assert 0.2 < scale < 0.5 and abs(p.mean() - y.mean()) < 0.01
    assert all(abs(y[(p > a) & (p <= a + 0.2)].mean() - p[(p > a) & (p <= a + 0.2)].mean()) < 0.08 for a in (0.3, 0.5, 0.7))
    parted = quality.calibration(np.array([-3.0] * 4 + [3.0] * 9), np.array([0.0] * 4 + [1.0] * 9))
    assert np.isfinite(parted).all() and parted[0] > 0
    assert quality.fit_calibrated(np.zeros((0, len(quality.FEATURES))), np.zeros(0)).score(np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]
