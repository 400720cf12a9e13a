import numpy as np

from linecensus.llm import quality as Q
from linecensus.llm.common import held_out
from pyspark.sql import functions as F
from tests.llm import frames


def corpus(spark, count=400):
    rows, labels = [], []
    for i in range(count):
        good = i % 4 != 0
        text = frames.invented(50, i)
        if not good:
            text = " | ".join(text.split()) if i % 8 else "!! ".join(text.upper().split())
        rows.append((i, text, "en"))
        labels.append((i, int(good), 0))
    return frames.docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy_and_calibration(spark):
    docs, labels = corpus(spark)
    scored = Q.score_quality(docs, Q.train(docs, labels)).join(labels, "doc_id")
    rows = scored.filter(held_out(F.col("doc_id"))).collect()
    assert len(rows) > 40
    assert np.mean([(r.score >= Q.THRESHOLD) == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    assert abs(np.mean([r.score - r.quality for r in rows])) < 0.1


def test_awkward_rows(spark):
    docs, labels = corpus(spark, 60)
    network = Q.train(docs, labels)
    rows = Q.score_quality(frames.docs(spark), network).collect()
    assert [r.doc_id for r in rows] == [doc_id for doc_id, _, _ in frames.ROWS]
    by_text = {}
    for row, (_, text, _) in zip(rows, frames.ROWS):
        by_text.setdefault((text or "").strip() and text, set()).add(row.score)
    assert all(len(scores) == 1 for scores in by_text.values())


def test_labels_of_nothing_one_class_and_null(spark):
    docs, labels = corpus(spark, 40)
    for unusable in (labels.limit(0), labels.withColumn("quality", F.lit(None).cast("int"))):
        assert {r.score for r in Q.score_quality(docs, Q.train(docs, unusable)).collect()} == {0.5}
    ones = labels.withColumn("quality", F.lit(1))
    assert {r.score for r in Q.score_quality(docs, Q.train(docs, ones)).collect()} == {1.0}
    assert Q.score_quality(frames.empty(spark), Q.train(docs, ones)).collect() == []


def test_pooling_does_not_depend_on_blocks(monkeypatch):
    from linecensus.llm import token_counts

    index = Q.index_vectors()
    text = frames.invented(3000, 1)
    whole = Q.features(text, index, index)
    monkeypatch.setattr(token_counts, "BLOCK", 500)
    parts = Q.features(text, index, index)
    # Shares of distinct and repeated words are those of blocks; everything else is the same.
    assert np.allclose(whole[:-2], parts[:-2], atol=1e-5)


def test_temperature_lowers_the_loss():
    chance = np.random.default_rng(1)
    x = chance.normal(size=(400, Q.DIMENSIONS * 2 + Q._SHARES))
    y = (x[:, 0] + chance.normal(size=400) > 0).astype(float)
    network = Q.Network(None, None, 0.5)
    network.fit(x[:300], y[:300])

    def loss(temperature):
        z = network.logits(x[300:]) / temperature
        return np.mean(np.logaddexp(0, z) - y[300:] * z)

    network.calibrate(x[300:], y[300:])
    assert loss(network.temperature) <= loss(1.0)
