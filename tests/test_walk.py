"""The walk by a shared matrix and pushed seeds: the same ranks as by PageRank for each query."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions.vectors import min_max
from quillgraph.operators import graph, walk
from quillgraph.operators.knn import all_scores
from quillgraph.operators.ppr import ppr, transitions
from quillgraph.operators.retrieve import reset_vector
from quillgraph.sources.shared import once


@pytest.mark.parametrize("lone", [3])
def test_ranks_equal_pagerank(spark, lone):
    """Random passages and entities, some passages without any entity; seeds of uneven weight."""
    r, g = random.Random(4), np.random.default_rng(4)
    edges = {(f"c{i}", f"e{r.randrange(25)}") for i in range(40) for _ in range(3)} | {(f"e{r.randrange(25)}", f"e{r.randrange(25)}") for _ in range(20)}
    rows = [(a, b, float(r.randrange(1, 4)), "passage") for a, b in edges if a != b]
    moves = once(transitions(graph.arcs(spark.createDataFrame(rows, "src string, dst string, weight double, kind string"))), "moves")
    passages = once(spark.createDataFrame([(f"c{i}", g.normal(size=6).tolist()) for i in range(40 + lone)], "id string, embedding array<double>"), "passages")
    asked = once(spark.createDataFrame([(q, g.normal(size=6).tolist()) for q in range(5)], "id long, embedding array<double>"), "asked")
    seeds = spark.createDataFrame([(q, f"e{r.randrange(25)}", r.random()) for q in range(4) for _ in range(3)], "query_id long, entity_id string, weight double")
    dense = min_max(all_scores(asked, passages), "query_id").withColumnRenamed("key_id", "chunk_id").where("query_id < 4")
    want = ppr(None, reset_vector(seeds, dense, 0.05), moves=moves, iterations=30).where(F.startswith("node", F.lit("c")))
    by = {}
    for x in want.collect():
        by.setdefault(x["query_id"], []).append((-x["rank"], x["node"]))
    basis = once(walk.walked(passages, moves, 0.5, 30), "basis")
    got = walk.shared_search(seeds, asked, passages, basis, moves, passage_weight=0.05, damping=0.5, k=10)
    found = {}
    for x in got.orderBy("query_id", "rank").collect():
        found.setdefault(x["query_id"], []).append((x["chunk_id"], x["score"]))
    assert set(found) == {0, 1, 2, 3}  # a query without seeds is not walked
    for q, best in found.items():
        top = sorted(by[q])[:10]
        assert [c for c, _ in best] == [c for _, c in top]
        assert np.allclose([s for _, s in best], [-s for s, _ in top], atol=1e-4)  # a lower bound, whose slack cannot change the order


def test_push_reaches_what_it_has_to(spark):
    """On a long path only the surroundings of the seed have rows, and the bound on what is left holds."""
    n = 400
    rows = [(f"n{i:03d}", f"n{i + 1:03d}", 1.0, "fact") for i in range(n - 1)]
    moves = once(transitions(graph.arcs(spark.createDataFrame(rows, "src string, dst string, weight double, kind string"))), "moves")
    start = spark.createDataFrame([(1, "n200", 0.0, 1.0)], "query_id long, node string, est double, left double")
    got = {r["node"]: (r["est"], r["left"]) for r in walk.pushed(start, moves, 1e-4, 0.5).collect()}
    assert len(got) < 40 and all(left < 1e-4 * 2 for _, left in got.values())
    true = np.zeros(n)
    now = np.zeros(n)
    now[200] = 1.0
    degree = np.array([1.0] + [2.0] * (n - 2) + [1.0])
    for _ in range(60):
        true += now
        spread = now / degree
        now = 0.5 * (np.concatenate([[0], spread[:-1]]) + np.concatenate([spread[1:], [0]]))
    for i in range(n):
        est, left = got.get(f"n{i:03d}", (0.0, 0.0))
        assert est + left <= true[i] + 1e-12 and true[i] <= est + 1e-4 * degree[i] / 0.5 + 1e-12


def test_engine_either_way(spark, tmp_path):
    """Questions with facts and one without, walked together and one by one: the same passages in the same order."""
    from quillgraph import GraphRag

    r = random.Random(1)
    names = ["Ada", "Bob", "Cy", "Dee", "Eve", "Flo", "Gus"]
    texts = [f"{r.choice(names)} {r.choice(['likes', 'sees', 'knows'])} {r.choice(names)}. The item {i} is with {r.choice(names)}." for i in range(25)]
    e = GraphRag(spark, str(tmp_path / "a"), vector_dims=16, shared_walk=False, retrieval_top_k=8)
    e.index(spark.createDataFrame([(t,) for t in texts], "content string"))
    q = spark.createDataFrame([(1, "Whom does Ada know"), (2, "item of Gus"), (3, "zzz"), (4, "Eve and Flo")], "query_id long, question string")
    listed = lambda e: [(x["query_id"], x["rank"], x["content"]) for x in e.retrieve(q).orderBy("query_id", "rank").collect()]
    one = listed(e)
    shared = GraphRag(spark, str(tmp_path / "a"), vector_dims=16, shared_walk=True, retrieval_top_k=8)
    assert len(one) == 32 and listed(shared) == one
