"""The journal of answers: files grow with the time that calls take, not with the batches, and nothing that was answered is asked for again."""

import time

import pyarrow.parquet as pq

from quillgraph.operators import calls
from quillgraph.sources.state import State


class Echo:
    def __init__(self, wait=0.0):
        self.wait = wait

    def __call__(self, messages):
        time.sleep(self.wait)
        return messages[-1]["content"].upper(), {"prompt_tokens": 1}


def files(folder):
    return sorted(p.name for p in folder.rglob("*.parquet"))


def run(spark, folder, texts, model, monkeypatch, **how):
    monkeypatch.setattr(calls, "shared_dir", lambda s, name: f"file://{folder}/{name}")
    monkeypatch.setattr(calls, "once", lambda df, name: df)
    got = calls.generate(spark.createDataFrame([(t,) for t in texts], "t string"), lambda r: [{"role": "user", "content": r["t"]}], model, "t", **how)
    assert {(r["t"], r["response"], r["status"]) for r in got.collect()} == {(t, t.upper(), "ok") for t in texts}


def test_fast_answers_share_files(spark, tmp_path, monkeypatch):
    run(spark, tmp_path, [f"p{i}" for i in range(400)], Echo(), monkeypatch, batch=5)
    assert calls.width(spark) <= len(files(tmp_path / "journal")) < 20  # there were eighty batches


def test_slow_answers_are_kept_batch_by_batch(spark, tmp_path, monkeypatch):
    run(spark, tmp_path, [f"p{i}" for i in range(16)], Echo(calls.KEEP_S + 0.1), monkeypatch, batch=2)
    assert all(pq.read_metadata(f).num_rows <= 2 for f in (tmp_path / "journal").glob("*.parquet"))


def answer(i):
    return {"key": f"k{i}", "message": f"m{i}", "prompt_tokens": 0, "completion_tokens": 0, "cache_hit": False, "status": "ok"}


def test_a_task_that_runs_again_skips_what_it_wrote(tmp_path, monkeypatch):
    monkeypatch.setattr(calls, "KEEP_S", 60.0)
    first = calls.Journal(f"file://{tmp_path}", 3)
    for i in range(5):
        first.note(answer(i))
        if i < 4:
            first.end(i)
    first.keep()  # the fifth batch broke off
    again = calls.Journal(f"file://{tmp_path}", 3)
    assert again.done == {0, 1, 2, 3} and calls.Journal(f"file://{tmp_path}", 4).done == set()
    assert [n[:14] for n in files(tmp_path)] == ["000003-000000-", "000003-part-" + files(tmp_path)[1][12:14]]
    for i in (4, 7):  # batches with others between them are no one file
        again.note(answer(i))
        again.end(i)
    again.keep()
    assert calls.Journal(f"file://{tmp_path}", 3).done == {0, 1, 2, 3, 4, 7}
    assert sorted(k for f in tmp_path.rglob("*.parquet") for k in pq.read_table(f)["key"].to_pylist()) == ["k0", "k1", "k2", "k3", "k4", "k4", "k7"]


def test_rows_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(calls, "KEEP_S", 60.0)
    monkeypatch.setattr(calls, "KEEP_ROWS", 6)
    journal = calls.Journal(f"file://{tmp_path}", 0)
    for i in range(13):
        journal.note(answer(i))
        journal.end(i)
    journal.keep()
    assert files(tmp_path) == ["000000-000000-000005.parquet", "000000-000006-000011.parquet", "000000-000012-000012.parquet"]


def test_answers_that_another_run_moves_are_found(spark, tmp_path, monkeypatch):
    """A journal that is listed, but moved into the table before it is read."""
    state = State(spark, f"file://{tmp_path}/c")
    one, two = calls.ResponseCache(state), calls.ResponseCache(State(spark, f"file://{tmp_path}/c"))
    ask = lambda texts, cache: calls.generate(spark.createDataFrame([(t,) for t in texts], "t string"), lambda r: [{"role": "user", "content": r["t"]}], Echo(), "t", cache=cache)
    monkeypatch.setattr(one, "adopt", lambda run: None)
    ask(["a", "b"], one)  # its journal stays
    two.stale_s = -60.0
    real, left = two._journals, [1]

    def listed():
        found = real()
        if left:
            left.pop()
            two.adopt("none")
        return found

    monkeypatch.setattr(two, "_journals", listed)
    got = ask(["a", "b", "c"], two).collect()
    assert {(r["t"], r["response"], r["cache_hit"]) for r in got} == {("a", "A", True), ("b", "B", True), ("c", "C", False)}
    assert two.load().count() == 3
