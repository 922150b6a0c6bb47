"""What searches hold and hand on at once is bounded, whatever the number of keys, lists and blocks."""

import numpy as np
import pandas as pd
import pytest

from quillgraph.operators import ann, knn


@pytest.mark.parametrize("text", [False, True])
@pytest.mark.parametrize(("k", "least"), [(3, None), (5, 2.0), (500, 1.0)])
def test_many_queries_read_the_keys_in_blocks(spark, monkeypatch, text, k, least):
    """The same rows as with few queries, ties included, and the vectors are shuffled once: not for each block."""
    r = np.random.default_rng(5)
    v = r.integers(-2, 3, (200, 4)).astype(float)
    kind = "string" if text else "long"
    rows = [(f"v{i:03d}" if text else i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows + [("none" if text else 999, None)], f"id {kind}, embedding array<double>").repartition(3)
    few = knn.knn(df, df, k, cosine=False, least=least)
    monkeypatch.setattr(knn, "SCORES", 300)
    many = knn.knn(df, df, k, cosine=False, least=least, block=16, broadcast_rows=10)
    told = lambda x: sorted((a["query_id"], a["rank"], a["key_id"], round(a["score"], 12)) for a in x.collect())
    assert told(many) == told(few) and many.dtypes == few.dtypes
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan and "Window" not in plan


def test_a_slice_of_scores_is_bounded(monkeypatch):
    seen = []
    monkeypatch.setattr(knn, "SCORES", 1000)
    real = np.partition
    monkeypatch.setattr(knn.np, "partition", lambda a, *x, **y: seen.append(a.size) or real(a, *x, **y))
    r = np.random.default_rng(1)
    got = knn._best(np.arange(40), r.random((40, 3)), np.arange(200), r.random((200, 3)), 2, None)
    assert isinstance(got, pd.DataFrame) and len(got) == 80 and max(seen) <= 1000


def test_copies_of_queries_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(knn, "SENT", 50)
    r = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.random((60, 3)))], "id long, embedding array<double>").coalesce(1)
    cells = knn.Cells(rows, 0.5, 8)
    sizes = cells.routes(rows, lambda ids, v, row, cell: pd.DataFrame({"n": [len(row)]}), "n long").toPandas()["n"]
    assert sizes.max() <= 50 and sizes.sum() > 50


def test_copies_for_lists_are_handed_on_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "SENT", 20)
    r = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.normal(size=(120, 8)))], "id long, embedding array<double>").repartition(2)
    index = ann.Index.build(rows, f"file://{tmp_path}/i", lists=6)
    got = index.search(rows, 3, probes=6, short=120, few_queries=5)
    told = lambda x: sorted((a["query_id"], a["rank"], a["key_id"]) for a in x.collect())
    assert told(got) == told(knn.knn(rows, rows, 3))
