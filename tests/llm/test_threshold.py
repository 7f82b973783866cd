"""op5's threshold against brute force over all trusted documents, not the fit's sample."""

import numpy as np
import pytest
from sluice.llm import op5_quality as o


def test_threshold_covers_all_trusted(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 97}" for k in range(1, 40))) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    ratios = np.random.default_rng(2).integers(-(10**6), 10**6, o.BUCKETS)
    scores = {r.doc_id: r.score for r in o.scored(docs, ratios).collect()}
    want = min(s for i, s in scores.items() if i % 3) - o.MARGIN
    assert o.threshold(docs, labels, ratios) == pytest.approx(want, abs=1e-6)
    lowest = min((i for i in scores if i % 3), key=scores.get)
    monkeypatch.setattr(o, "sampled_labels", lambda labels: {i: i % 3 > 0 for i in scores if i != lowest})
    monkeypatch.setattr(o, "log_ratios", lambda raw, target: ratios)
    assert o.fit(docs, labels)[1] == pytest.approx(want, abs=1e-6)
