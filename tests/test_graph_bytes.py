"""Ids of text are not shuffled: graphs are summed up by names, packed ids and unordered pairs."""

from collections import Counter

from quillgraph.functions.text import packed, unpacked
from quillgraph.operators import graph
from quillgraph.plans.tables import passages

HEX = "0123456789abcdef0123456789abcdef"


def test_ids_are_packed_and_come_back(spark):
    ids = [f"chunk-{HEX}", f"entity-{HEX}", f"fact-{HEX}", f"chunk-{HEX.upper()}", f"chunk-{HEX}\n", f"chunk-{HEX}0", "customer", "", "é", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, x string").select("i", "x", packed("x").alias("p")).select("i", "x", "p", unpacked("p").alias("back")).orderBy("i").collect()
    assert [r["back"] for r in rows] == ids
    assert len({None if r["p"] is None else bytes(r["p"]) for r in rows}) == len(ids)
    assert [len(r["p"]) for r in rows[:3]] == [17, 17, 17]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_and_arcs_shuffle_pairs_once(spark):
    triples = [("c1", "a", "p", "b"), ("c1", "b", "p", "a"), ("c2", "a", "q", "b"), (f"chunk-{HEX}", "a", "p", "a"), ("c2", "x", "p", "")]
    t = spark.createDataFrame(triples, "chunk_id string, s string, p string, o string")
    names = {r["content"]: r["entity_id"] for r in graph.entities(t).collect()}
    want = Counter(e for _, s, _, o in triples for e in ((names[s], names[o]), (names[o], names[s])))
    made = graph.fact_edges(t)
    assert {(r["src"], r["dst"]): r["weight"] for r in made.collect()} == want and made.count() == len(want)
    edges = made.unionByName(graph.passage_edges(t))
    assert sorted((r["src"], r["dst"]) for r in graph.passage_edges(t).collect()) == sorted({(c, names[x]) for c, s, _, o in triples for x in (s, o)})
    arcs, back = graph.arcs(edges), Counter()
    for r in edges.collect():
        back[r["src"], r["dst"]] += r["weight"]
        back[r["dst"], r["src"]] += r["weight"]
    assert {(r["src"], r["dst"]): r["weight"] for r in arcs.collect()} == back and arcs.count() == len(back)
    assert "hashpartitioning(src" not in _plan(arcs) and "hashpartitioning(entity_id" not in _plan(made.unionByName(graph.passage_edges(t)))
    assert "SortAggregate" not in _plan(passages(spark, "/root/testdata/sf0.001"))


def test_deletes_join_packed_ids(spark):
    t = spark.createDataFrame([("c1", "a", "p", "b"), ("c2", "b", "p", "c"), ("c2", "d", "p", "e"), ("c1", "b", "p", "c")], "chunk_id string, s string, p string, o string")
    gone = spark.createDataFrame([("c1",), ("c1",), ("none",)], "chunk_id string")
    name = {r["entity_id"]: r["content"] for r in graph.entities(t).collect()}
    fact = {r["fact_id"]: r["content"] for r in graph.facts(t).collect()}
    assert [name[r[0]] for r in graph.deleted_entities(t, gone).collect()] == ["a"]
    assert [fact[r[0]] for r in graph.deleted_facts(t, gone).collect()] == ["('a', 'p', 'b')"]
    v = graph.vertices(graph.entities(t), spark.createDataFrame([("c1", "x"), ("c2", "y")], "chunk_id string, content string"))
    ids = spark.createDataFrame([(i,) for i, x in name.items() if x == "a"] + [("c1",)], "id string")
    left, rest = graph.delete_vertices(v, graph.edges_of(t), ids)
    assert sorted(r["content"] for r in left.collect()) == ["b", "c", "d", "e", "y"]
    assert "c1" not in {x for r in rest.collect() for x in (r["src"], r["dst"])} and rest.count() == 4 + 4


def test_ranks_are_shuffled_by_numbers(spark, monkeypatch):
    """No table that a walk writes for its steps holds text ids; ids of any kind come back."""
    from quillgraph.operators import ppr as module

    kinds, real = {}, module.written
    monkeypatch.setattr(module, "written", lambda df, path: kinds.update({path.rpartition("/")[2]: dict(df.dtypes)}) or real(df, path))
    ids = {"a": f"chunk-{HEX}", "b": f"entity-{HEX}", "c": "other"}
    arcs = [("a", "b", 2.0), ("b", "a", 2.0), ("b", "c", 1.0), ("c", "b", 1.0)]
    reset = [(7, "a", 1.0), (7, "lone", 1.0), (8, "c", 3.0)]
    text = module.ppr(spark.createDataFrame([(ids[x], ids[y], w) for x, y, w in arcs], "src string, dst string, weight double"), spark.createDataFrame([(q, ids.get(n, n), w) for q, n, w in reset], "query_id int, node string, reset double"), iterations=6)
    assert kinds["transitions"]["src"] == kinds["transitions"]["dst"] == kinds["rank6"]["node"] == "bigint"
    number = {"a": 1, "b": 2, "c": 3, "lone": 4}
    longs = module.ppr(spark.createDataFrame([(number[x], number[y], w) for x, y, w in arcs], "src long, dst long, weight double"), spark.createDataFrame([(q, number[n], w) for q, n, w in reset], "query_id int, node long, reset double"), iterations=6)
    back = {i: number[n] for n, i in (ids | {"lone": "lone"}).items()}
    assert sorted((r["query_id"], back[r["node"]], round(r["rank"], 12)) for r in text.collect()) == sorted((r["query_id"], r["node"], round(r["rank"], 12)) for r in longs.collect())
