"""Synonyms by classes of equal vectors: the edges of all pairs, from pairs whose number does not grow with the members of a class."""

import numpy as np
import pytest

from quillgraph.operators import alike, graph
from quillgraph.schemas import ALIKE, VECTORS


def entities(n):
    r = np.random.default_rng(7)
    out = []
    for i in range(n):
        v = r.multinomial(int(r.integers(1, 5)), [0.3, 0.3, 0.2, 0.2]).astype(np.float32)
        out.append((f"e{(i * 37) % n:04d}", ["", "ab", "it's"][i] if i < 3 else f"name {i}", (v / np.linalg.norm(v)).tolist()))
    return out


def by_hand(found, least, k, most):
    out = {}
    for a, name, x in found:
        if sum(c.isalnum() for c in name) > 2:
            near = [(-round(s, 5), b, other, s) for b, other, y in found if (s := float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))) >= least]
            for _, b, other, s in [x for x in sorted(near)[:k] if x[1] != a and x[2] != ""][:most]:
                out[a, b] = round(s, 4)
    return out


@pytest.mark.parametrize(("least", "k", "most", "few"), [(0.9, 2047, 11, 20_000), (0.8, 7, 101, 20_000), (0.5, 2047, 60, 0)])
def test_synonyms_of_classes_are_those_of_all_pairs(spark, monkeypatch, least, k, most, few):
    """In two parts, with names that may not ask or be named, lists that are full, and ties."""
    monkeypatch.setattr(alike, "FEW", few)
    found = entities(150)
    table = lambda some: spark.createDataFrame(some, VECTORS).repartition(3)
    old, new = table(found[:60]), table(found[60:])
    none, known, mine = spark.createDataFrame([], ALIKE), alike.classes(old), alike.classes(new)
    first = alike.pairs(alike.vectors(none, table([])), alike.vectors(known, old), k, least, 16)
    second = alike.pairs(alike.vectors(known, old), alike.vectors(mine, new), k, least, 16)
    names = table(found).withColumnRenamed("hash_id", "entity_id").select("entity_id", "content")
    got = alike.synonym_edges(first.unionByName(second).unionByName(second), known.unionByName(mine), names, least, k, most).collect()
    assert {(r["src"], r["dst"]): round(r["weight"], 4) for r in got} == by_hand(found, least, k, most) and {r["kind"] for r in got} == {"synonym"}
    assert len(got) == len({(r["src"], r["dst"]) for r in got})
    n = known.unionByName(mine).select("alike_id").distinct().count()
    assert n < 60 and first.count() + second.count() <= n * n


def test_equal_vectors_make_one_pair(spark):
    rows = spark.createDataFrame([(f"e{i}", f"name {i}", [0.0, 1.0]) for i in range(50)], VECTORS)
    none = spark.createDataFrame([], VECTORS)
    assert alike.pairs(alike.vectors(spark.createDataFrame([], ALIKE), none), alike.vectors(alike.classes(rows), rows), 2047, 0.9, 16).count() == 1


def test_a_synonym_replaces_the_fact_edge(spark):
    edge = "src string, dst string, weight double, kind string"
    fact, syn = spark.createDataFrame([("a", "b", 3.0, "fact"), ("b", "c", 1.0, "fact")], edge), spark.createDataFrame([("a", "b", 0.9, "synonym"), ("c", "d", 0.8, "synonym")], edge)
    got = graph.merge_edges(fact, spark.createDataFrame([("p", "a", 1.0, "passage")], edge), syn)
    assert sorted(map(tuple, got.collect())) == [("a", "b", 0.9, "synonym"), ("b", "c", 1.0, "fact"), ("c", "d", 0.8, "synonym"), ("p", "a", 1.0, "passage")]
    plan = got.where("kind = 'synonym'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # of synonyms alone no fact edge is read
