"""What synonym_edges moves of a dense table."""

import duckdb

from quillgraph.operators import graph
from quillgraph.plans.registry import ORACLES, QUERIES


def test_only_rows_that_may_stay_are_moved(spark, tmp_path, monkeypatch):
    """Over 101 neighbours each, many of them tied: of each vector 102 rows go to the edges, which are those of the SQL."""
    rows = [(i, [1.0, 0.01 * (i % 7), 0.5 * (i % 2)], 0) for i in range(150)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    moved, real = [], graph.synonym_edges
    monkeypatch.setattr(graph, "synonym_edges", lambda near, *rest: moved.append(near.groupBy("query_id").count().agg({"count": "max"}).first()[0]) or real(near, *rest))
    got = sorted((r["src"], r["dst"], r["weight"]) for r in QUERIES["synonym_edges"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(ORACLES["synonym_edges"]).fetchall()
    assert moved == [102] and len(got) == len(want) == 150 * 101 and {w for _, _, w in got} <= {r[2] for r in want}
