"""Every engine query against its SQL on the smallest tables."""

import pytest

from quillgraph.plans.registry import FLAGSHIP, ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(agrees, name):
    assert name in ORACLES
    agrees(QUERIES[name], ORACLES[name])


def test_gold_docs_at_the_edges_of_words(spark, tmp_path):
    """Short questions, white space around them and quotes before them: what the text contains, and no more."""
    long = "how many red apples are there in the big box?"
    asked = [long, " " + long, "red apples", "box", " in the", "many red apples are there in the big bo", "x" + long]
    texts = [f"He asked '{long}' twice", f"({long})", f"so {long}", "red apples", "Boxes in the sun", "", None]
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["query_id"], r["doc_id"]) for r in QUERIES["gold_docs"](spark, str(tmp_path)).collect())
    assert got == sorted((i, k) for i, a in enumerate(asked) for k, t in enumerate(texts) if t is not None and a in t)


def test_entry(spark):
    import __spark_entry__ as e

    assert FLAGSHIP in e.queries()
    df = e.entry(spark)
    assert df.columns == ["query_id", "key_id", "rank", "score"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
