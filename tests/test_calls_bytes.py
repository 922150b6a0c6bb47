"""Prompts move once on their way to a model, and texts of passages only where they are asked for."""

from quillgraph.operators import calls, openie


def test_different_prompts_are_not_written_again(spark, monkeypatch):
    names, real = [], calls.once
    monkeypatch.setattr(calls, "once", lambda df, name: names.append(name) or real(df, name))
    ask = lambda texts: calls.generate(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), lambda r: [{"role": "user", "content": r["t"]}], openie.Sentences(), "id")
    assert ask(["a b c.", "d e f."]).where("status = 'ok'").count() == 2 and "todo" not in names
    rows = {r["id"]: r["response"] for r in ask(["a b c.", "d e f.", "a b c."]).collect()}
    assert "todo" in names and len(rows) == 3 and rows[0] == rows[2] != rows[1]


def test_passages_move_only_where_they_are_asked_for(spark, monkeypatch):
    held, real = {}, openie.once
    monkeypatch.setattr(openie, "once", lambda df, name: held.update({name: df.columns}) or real(df, name))
    chunks = spark.createDataFrame([("c1", "Ada likes tea."), ("c2", "Bob reads books.")], "chunk_id string, content string")
    got = openie.openie_with_fallback(chunks, openie.Sentences(), None)
    assert {r["chunk_id"]: r["passage"] for r in got.collect()} == {"c1": "Ada likes tea.", "c2": "Bob reads books."}
    assert "passage" not in held["extracted"] and "content" not in held["entities"]
