"""Neighbours over a threshold by the triangle inequality: the same as by comparing all, and less work where vectors lie in groups."""

import numpy as np
import pytest

from quillgraph.operators.knn import Cells, all_scores, knn, near, scaled_top_k
from quillgraph.sources.shared import once


def frame(spark, vectors):
    return once(spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, embedding array<double>"), "vectors")


def pairs(df):
    return sorted((r["query_id"], r["rank"], r["key_id"], round(r["score"], 9)) for r in df.collect())


def groups(r, many, each, dims=16, spread=0.1):
    middle = r.normal(size=(many, dims))
    return np.concatenate([m + spread * r.normal(size=(each, dims)) for m in middle])


@pytest.mark.parametrize("least", [0.95, 0.8, 0.3])
def test_near_is_exact(spark, least):
    r = np.random.default_rng(1)
    hot = np.tile(r.normal(size=16), (40, 1)) * r.uniform(0.5, 2, (40, 1))  # a third of all rows in one direction
    v = frame(spark, [*groups(r, 6, 12), *r.normal(size=(20, 16)), *hot, [0.0] * 16, None])
    whole = lambda df: sorted((q, k, s) for q, _, k, s in pairs(df))
    few = lambda df: [(q, rank, s) for q, rank, _, s in pairs(df)]  # noqa: E731  which of equal ones comes first is up to the last bit
    every, best = whole(knn(v, v, 200, least=least)), few(knn(v, v, 7, least=least))
    for how in ({}, {"pivots": 3, "block": 10}, {"pivots": 1, "block": 7}):
        assert whole(near(v, v, 200, least, **how)) == every and few(near(v, v, 7, least, **how)) == best, how


def test_near_leaves_out_what_cannot_be_near(spark):
    v = frame(spark, groups(np.random.default_rng(2), 20, 15, 32, 0.02))
    cells = Cells(v, 0.8, pivots=64)
    done = sum(r["keys"] * r["queries"] for r in cells.work(v).collect())
    assert done < 0.25 * 300 * 300
    assert pairs(near(v, v, 20, 0.8, cells=cells)) == pairs(knn(v, v, 20, least=0.8))


def test_near_of_nothing(spark):
    v = frame(spark, [[1.0, 0.0], None, [0.0, 0.0]])
    assert near(v.limit(0), v, 3, 0.8).count() == 0 and near(v, v.limit(0), 3, 0.8).count() == 0
    assert near(v, v.where("id > 0"), 3, 0.8).count() == 0 and pairs(near(v, v, 3, 0.8)) == [(0, 1, 0, 1.0)]
    with pytest.raises(ValueError, match="over 0"):
        near(v, v, 3, 0.0)


def test_many_queries_take_the_grid(spark):
    """Over the bound of what goes to every task, in rows, the rows are the same."""
    r = np.random.default_rng(3)
    q, v = frame(spark, r.normal(size=(30, 8))), frame(spark, r.normal(size=(50, 8)))
    assert pairs(scaled_top_k(q, v, 5)) == pairs(scaled_top_k(q, v, 5, broadcast_rows=4, block=8))
    some = lambda df: sorted((x["query_id"], x["key_id"], round(x["score"], 9)) for x in df.collect())
    assert some(all_scores(q, v)) == some(all_scores(q, v, broadcast_rows=4)) and all_scores(q, v).count() == 1500
