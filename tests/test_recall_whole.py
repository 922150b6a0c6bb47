"""recall_at_k asks with every vector."""

import numpy as np

from quillgraph.plans.registry import ORACLES, QUERIES
from tests.conftest import SF


def test_every_vector_asks(spark, tmp_path, agrees):
    """Vectors whose numbers 20 does not divide have other neighbours than the one whose number it divides."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist(), int(i % 3)) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    v, label = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    order = np.argsort(-(v @ v.T), axis=1, kind="stable")
    got = {r["k"]: r["recall"] for r in QUERIES["recall_at_k"](spark, str(tmp_path)).collect()}
    for k in (1, 5, 10):
        each = [sum(label[j] == label[i] and j != i for j in order[i, :k]) / ((label == label[i]).sum() - 1) for i in range(30)]
        assert abs(got[k] - np.mean(each)) < 1e-4
    assert "% 20" not in ORACLES["recall_at_k"] and agrees(QUERIES["recall_at_k"], ORACLES["recall_at_k"], SF)
