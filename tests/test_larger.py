"""What shows on larger tables only, made small."""

import numpy as np
import pytest

from quillgraph.operators import evaluate, knn, lexical, markdown, openie
from quillgraph.sources import shared


def test_triples_that_are_alike_when_normalised_are_one(spark):
    rows = spark.createDataFrame([("c1", [["###", "des&&&", "le"], ["***", "des&&&", "le"], ["A", "b", "c"]]), ("c2", [["###", "des&&&", "le"]])], "chunk_id string, triples array<array<string>>")
    assert sorted(map(tuple, openie.chunk_triples(rows).collect())) == [("c1", "", "des", "le"), ("c1", "a", "b", "c"), ("c2", "", "des", "le")]


def test_scores_of_words_are_ranked_as_they_are_rounded(spark):
    """No row stands for a pair; items that are alike tie and go by their ids, those without a common word come last, in whatever blocks they are."""
    from pyspark.sql import functions as F

    asked = [(0, "red fox"), (1, "zebra"), (2, ""), (3, None)]
    texts = [(f"k{i:02d}", ["red fox runs", "fox runs red", "blue sky", "red", "", "fox fox red"][i % 6]) for i in range(30)]
    q = spark.createDataFrame(asked, "id int, t string").select("id", lexical.places(F.col("t"), 64).alias("places"))
    items = spark.createDataFrame(texts, "id string, t string").select("id", lexical.places(F.col("t"), 64).alias("places")).repartition(3)

    def told(df):
        return sorted((r["query_id"], r["rank"], r["key_id"], r["score"]) for r in df.collect())

    place = dict(spark.createDataFrame([(w,) for w in "red fox runs blue sky zebra".split()], "w string").select("w", lexical.places(F.col("w"), 64)[0]).collect())
    vector = lambda t: np.bincount([place[w] for w in (t or "").split()], minlength=64)
    want = []
    for i, t in asked:
        s = {k: float(vector(t) @ vector(x)) / (n if (n := np.linalg.norm(vector(t)) * np.linalg.norm(vector(x))) else 1) for k, x in texts}
        low, high = min(s.values()), max(s.values())
        s = {k: round((v - low) / (high - low), 9) if high > low else 1.0 for k, v in s.items()}
        want += [(i, rank + 1, k, s[k]) for rank, k in enumerate(sorted(s, key=lambda k: (-s[k], k))[:8])]
    few = told(lexical.best(q, items, 8, 64))
    assert few == want
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lexical, "HELD", 8)
        m.setattr(lexical, "BLOCK", 3)
        m.setattr(lexical, "ROWS", 4)
        assert told(lexical.best(q, items, 8, 64)) == want


def test_no_query_makes_all_pairs_of_questions_and_texts(spark, monkeypatch):
    """What dpr_passages writes does not hold a row for each question and passage."""
    from quillgraph.plans import queries_retrieval
    from quillgraph.plans.registry import QUERIES
    from tests.conftest import SF

    rows = []
    real = shared.once
    for module in (queries_retrieval, lexical):
        monkeypatch.setattr(module, "once", lambda df, name: rows.append((out := real(df, name)).count()) or out)
    n, pairs = QUERIES["dpr_passages"](spark, SF).count(), queries_retrieval.questions(spark, SF).count() * queries_retrieval.passages(spark, SF).count()
    assert n < pairs and rows and max(rows) < pairs / 2


def test_structure_is_written_once_and_reads_no_text_again(spark):
    """What the tables of a structure are made of does not shuffle any more; code that is all of a chunk's lines leaves it empty."""
    code = "```\n" + "\n".join("abcdefg") + "\n```"
    docs = spark.createDataFrame([(1, "a.md", f"# T\nline\n{code}\n## U\n" + "| x |\n" * 6 + "end"), (2, "b.md", code)], "doc_id long, path string, content string")
    parts = markdown.structure(docs, 0)
    for name in ("doc_chunks", "codes", "tables", "files"):
        assert "Exchange" not in parts[name]._jdf.queryExecution().executedPlan().toString(), name
    assert sorted((r["doc_id"], r["content"]) for r in parts["codes"].collect()) == [("1", code), ("2", code)]
    assert [(r["doc_id"], r["content"]) for r in parts["tables"].collect()] == [("1", "\n".join(["| x |"] * 6))]
    assert {(r["doc_id"], r["filter_content"]) for r in parts["doc_chunks"].collect()} == {(1, "# 1 T  \nline"), (1, "# 1 T  \n## 1.1 U  \nend"), (2, "")}


def test_code_and_tables_with_lines_around_them(spark):
    lines = [(1, i, x) for i, x in enumerate(["a", "b", "```", *"12345", "```", "c", "d", "e"])]
    cut, rest = markdown.code_blocks(spark.createDataFrame(lines, "doc_id int, idx int, line string"), 2)
    assert [r["content"].split("\n") for r in cut.collect()] == [["a", "b", "```", *"12345", "```", "c", "d"]]
    assert sorted((r["idx"], r["line"]) for r in rest.collect()) == [(0, "a"), (1, "b"), (9, "c"), (10, "d"), (11, "e")]


def test_all_pairs_are_handed_on_in_parts(spark, monkeypatch):
    """A batch of keys and all queries are not one table."""
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "id long, embedding array<double>").coalesce(1)
    monkeypatch.setattr(knn, "PAIRS", 600)
    sizes, real = [], knn._in_blocks

    def seen(queries, keys, work, schema, *how):
        def counted(*a):
            out = work(*a)
            return out.assign(query_id=len(out))

        return real(queries, keys, counted, schema, *how)

    assert knn.all_scores(rows, rows).distinct().count() == 3600
    monkeypatch.setattr(knn, "_in_blocks", seen)
    assert knn.all_scores(rows, rows).agg({"query_id": "max"}).first()[0] == 600


def test_recall_in_classes_is_recall_with_all_pairs_of_a_class(spark):
    label = [(i, "abc"[i % 3] if i % 7 else None) for i in range(30)] + [(30, "alone")]
    docs = spark.createDataFrame(label, "doc long, label string")
    asked = docs.where("doc % 2 = 0").withColumnRenamed("doc", "query_id")
    near = spark.createDataFrame([(q, d, r + 1) for q in range(0, 31, 2) for r, d in enumerate([q, *range(q % 5, 31, 2)][:12])], "query_id long, doc long, rank int")
    gold = asked.join(docs, "label").where("query_id <> doc").select("query_id", "doc")
    told = lambda df: sorted(map(tuple, df.collect()))
    got = evaluate.recall_in_classes(near, asked, docs, (1, 3, 10))
    assert told(got) == told(evaluate.recall_at_k(near, gold, (1, 3, 10))) and len(told(got)) == 3
