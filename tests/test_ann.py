"""The approximate index against comparing all: recall, exactness where nothing is left out, odd rows, rows added later."""

import numpy as np
import pytest

from quillgraph.operators.ann import Index
from quillgraph.operators.knn import knn
from tests.test_knn import frame, groups


def rows(df):
    return {(r["query_id"], r["key_id"]) for r in df.collect()}


def scores(df):
    return sorted((r["query_id"], r["rank"], round(r["score"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    """Groups, loose vectors, and a third of all rows in one direction."""
    r = np.random.default_rng(4)
    hot = np.tile(r.normal(size=32), (250, 1)) * r.uniform(0.5, 2, (250, 1))
    return frame(spark, [*groups(r, 20, 15, 32, 0.3), *r.normal(size=(200, 32)), *hot])


@pytest.fixture(scope="module")
def index(vectors, tmp_path_factory):
    return Index.build(vectors, f"file://{tmp_path_factory.mktemp('ann')}/index", parts=8)


def test_recall_from_few_lists(vectors, index):
    loose = vectors.where("id < 500 and id % 4 = 0")
    want, got = rows(knn(loose, vectors, 10)), rows(index.search(loose, 10))
    assert len(want & got) >= 0.9 * len(want)
    held = rows(index.search(loose, 10, probes=1))
    assert len(want & held) < len(want & got)  # one list does not do


def test_nothing_left_out_is_exact(vectors, index):
    ask = vectors.where("id % 5 = 0")
    assert scores(index.search(ask, 7, probes=10**6, short=750)) == scores(knn(ask, vectors, 7))


@pytest.mark.parametrize("how", [{"few_queries": 0}, {"few_queries": 0, "block": 20, "broadcast_rows": 0}])
def test_many_queries_are_dealt_out(vectors, index, how):
    ask = vectors.where("id % 5 = 0 and id < 500")
    assert scores(index.search(ask, 5, **how)) == scores(index.search(ask, 5))


def test_lists_that_are_not_asked_are_not_read(vectors, index):
    plan = index._read("codes", [3, 4])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and len({f.split("list=")[1].split("/")[0] for f in index._read("codes", [3, 4]).inputFiles()}) <= len(index.codes.lists)
    assert {r["list"] for r in index._read("codes", [3, 4]).select("list").distinct().collect()} <= {3, 4}


def test_odd_rows_and_rows_added_later(spark, tmp_path):
    v = [[1, 0, 0], [0.9, 0.1, 0], None, [0, 0, 0], [float("nan"), 1, 0], [0, 1, 0], [0, 0.9, 0.1]]
    index = Index.build(frame(spark, v).union(frame(spark, v[:2])), f"file://{tmp_path}/index", lists=2)
    everything = {"probes": 9, "short": 99}
    ask = frame(spark, v)
    got = sorted((r["query_id"], r["rank"], r["key_id"]) for r in index.search(ask, 2, **everything).collect())
    assert got == [(0, 1, 0), (0, 2, 1), (1, 1, 1), (1, 2, 0), (5, 1, 5), (5, 2, 6), (6, 1, 6), (6, 2, 5)]
    more = spark.createDataFrame([(10, [2.0, 0.0, 0.0]), (0, [0.0, 0.0, 1.0]), (11, None)], "id long, embedding array<double>")
    index.add(more)
    again = Index(spark, f"file://{tmp_path}/index")
    got = sorted((r["rank"], r["key_id"]) for r in again.search(ask.where("id = 0"), 3, **everything).collect())
    assert got == [(1, 0), (2, 10), (3, 1)]  # the row with an id that is held is left out; of equal ones the smaller id comes first


def test_empty(spark, tmp_path):
    index = Index.build(frame(spark, [None]), f"file://{tmp_path}/index")
    assert index.search(frame(spark, [[1, 0]]), 3).collect() == []
    with pytest.raises(ValueError):
        index.add(frame(spark, [[1, 0]]))
    some = Index.build(frame(spark, [[1, 0]]), f"file://{tmp_path}/other")
    assert some.search(frame(spark, [None]), 3).collect() == []
