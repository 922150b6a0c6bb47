"""Scaled scores of all pairs: no pair is shuffled."""

import numpy as np
import pytest

from quillgraph.operators.knn import scaled_scores
from quillgraph.plans.registry import QUERIES
from tests.conftest import SF


def test_scaled_scores(spark):
    """Blocks of two queries; one query whose scores are all the same, a null vector on either side."""
    rng = np.random.default_rng(1)
    keys = [(f"k{i:02d}", rng.normal(size=3).tolist()) for i in range(11)]
    asked = [(i, rng.normal(size=3).tolist()) for i in range(5)] + [(5, [0.0, 0.0, 0.0])]
    q = spark.createDataFrame([*asked, (6, None)], "id long, embedding array<double>")
    k = spark.createDataFrame([*keys, ("null", None)], "id string, embedding array<double>").repartition(3)
    got = {(r["query_id"], r["key_id"]): r["score"] for r in scaled_scores(q, k, block=2).collect()}
    s = np.array([v for _, v in asked]) @ np.array([v for _, v in keys]).T
    low, high = s.min(axis=1, keepdims=True), s.max(axis=1, keepdims=True)
    s = np.where(high > low, (s - low) / np.where(high > low, high - low, 1), 1.0)
    assert len(got) == s.size and all(got[i, name] == pytest.approx(s[i, j]) for i in range(6) for j, (name, _) in enumerate(keys))
    assert not scaled_scores(q, k.where("id = 'x'")).count() and not scaled_scores(q.where("id = 9"), k).count()


def test_no_pair_is_shuffled(spark):
    """The one shuffle of fact_scores_minmax is that of the queries, before pairs are made."""
    plan = QUERIES["fact_scores_minmax"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("MapInPandas") < plan.index("Exchange") and "Join" not in plan
