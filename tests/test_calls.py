"""Calls of models: spread over tasks, several at once, kept as they come, in batches of bounded size; the gate of each batch."""

import glob
import json
import os
import threading
import time

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from quillgraph.operators import calls, openie
from quillgraph.sources.state import State


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "content string")


def said(r):
    return [{"role": "user", "content": r["content"]}]


class Logged:
    """Echo, with a line for each call in a file of its task; breaks off at one prompt, as a lost executor does."""

    def __init__(self, folder, fatal=None, wait=0.0):
        self.folder, self.fatal, self.wait = str(folder), fatal, wait
        os.makedirs(self.folder, exist_ok=True)

    def __call__(self, messages):
        text = messages[-1]["content"]
        if text == self.fatal:
            time.sleep(0.3)
            raise SystemExit("the executor is gone")
        start = time.time()
        time.sleep(self.wait)
        with open(f"{self.folder}/{os.getpid()}-{threading.get_ident()}", "a") as f:
            f.write(json.dumps([text, start, time.time()]) + "\n")
        return text.upper(), {"prompt_tokens": 1}


def log(folder):
    return [json.loads(line) for f in glob.glob(f"{folder}/*") for line in open(f)]


class WhichTask:
    def __call__(self, messages):
        return str(TaskContext.get().partitionId() if TaskContext.get() else -1), {}


def test_calls_are_spread_and_run_side_by_side(spark, tmp_path):
    """Few bytes, but as many tasks as the cluster has room for; in each several requests at once."""
    got = calls.generate(frame(spark, [f"p{i}" for i in range(64)]), said, Logged(tmp_path / "log", wait=0.2), "content", pool=4)
    assert got.where("status = 'ok'").count() == 64
    seen = log(tmp_path / "log")
    assert len(seen) == 64
    files = {f.rsplit("-", 1)[0] for f in glob.glob(f"{tmp_path}/log/*")}
    assert len(files) == calls.width(spark) == 4  # a Python process for each task
    most = max(sum(s <= x < e for _, s, e in seen) for _, x, _ in seen)
    assert most > calls.width(spark)  # more than one at once in a task


def test_a_run_that_breaks_off_is_gone_on_with(spark, tmp_path):
    cache = openie.ResponseCache(State(spark, str(tmp_path / "c")))
    texts = [f"p{i}" for i in range(120)]
    with pytest.raises(Exception, match="the executor is gone|failed"):
        calls.generate(frame(spark, texts), said, Logged(tmp_path / "log", fatal="p77"), "content", cache=cache, batch=5, pool=2)
    first = {t for t, _, _ in log(tmp_path / "log")}
    assert 0 < len(first) < 120
    kept = {r["message"] for r in cache.load().collect()}
    assert kept == {t.upper() for t in first}  # what was answered is there, whether its batch was whole or not
    got = calls.generate(frame(spark, texts), said, Logged(tmp_path / "log"), "content", cache=cache, batch=5, pool=2)
    assert {(r["content"], r["response"], r["status"]) for r in got.collect()} == {(t, t.upper(), "ok") for t in texts}
    assert sorted(t for t, _, _ in log(tmp_path / "log")) == sorted(texts)  # none twice
    assert {(r["cache_hit"]) for r in got.where(F.lower("response").isin(list(first))).collect()} == {True}
    assert cache.state.read("responses", "key string").count() > 0
    cache.stale_s = 0.0
    calls.generate(frame(spark, ["new"]), said, Logged(tmp_path / "log"), "content", cache=cache)
    assert cache._journals() == [] and cache.load().count() == 121 and cache.state.read("responses", "key string").count() == 121


class Sometimes:
    """A model for many prompts that breaks the schema at the first request of every third prompt, and always at one."""

    def __init__(self, folder):
        self.folder, self.seen = str(folder), set()
        os.makedirs(self.folder, exist_ok=True)

    def batch(self, many, json_schema=None):
        texts = [m[-1]["content"] for m in many]
        with open(f"{self.folder}/{os.getpid()}", "a") as f:
            f.write(json.dumps(texts) + "\n")
        out = []
        for t in texts:
            broken = t.startswith("never") or len(t) % 3 == 0 and t not in self.seen
            self.seen.add(t)
            out.append(('{"named_entities": "no list"}' if broken else json.dumps({"named_entities": [t]}), {}))
        return out


def test_batches_have_a_budget_and_follow_the_schema(spark, tmp_path):
    texts = ["x" * n + str(i) for i, n in enumerate([3, 5, 8, 13, 21, 34, 55, 89] * 12)] + ["never", "y" * 5000]
    got = calls.generate(frame(spark, texts), said, Sometimes(tmp_path / "log"), "content", attempts=3, wait_s=0.0, json_schema=openie.ENTITIES_JSON, batch=10, budget=120)
    status = {r["content"]: (r["status"], r["response"]) for r in got.collect()}
    assert status["never"] == ("SchemaError: the answer does not follow the schema", None)
    assert all(s == "ok" and json.loads(r) == {"named_entities": [t]} for t, (s, r) in status.items() if t != "never")
    asked = [json.loads(line) for f in glob.glob(f"{tmp_path}/log/*") for line in open(f)]
    tokens = lambda t: -(-len(json.dumps(said({"content": t}))) // 4)
    assert all(len(b) <= 10 and (sum(map(tokens, b)) <= 120 or len(b) == 1) for b in asked)
    assert len(asked) < len(texts)  # real batches
    firsts = [b for b in asked if len(b) > 1]
    assert all(max(map(len, b)) <= 2 * min(map(len, b)) + 40 for b in firsts)  # prompts of like length together


def test_schema():
    assert calls.follows('{"triples": [["a", "b", "c"]]}', openie.TRIPLES_JSON)
    for bad in (None, "", "[]", "{}", '{"triples": [["a", "b"]]}', '{"triples": [["a", "b", 1]]}', '{"triples": "a"}', "{"):
        assert not calls.follows(bad, openie.TRIPLES_JSON)
    assert calls.fits(3, {"type": "integer"}) and not calls.fits(True, {"type": "integer"}) and calls.fits("a", {"enum": ["a"]}) and not calls.fits("b", {"enum": ["a"]})


class FailsBelow:
    """Entities and triples for ids from a bound on; below, a broken service or answers without anything in them."""

    def __init__(self, bound, empty=False):
        self.bound, self.empty, self.all = bound, empty, openie.Sentences()

    def __call__(self, messages):
        text = messages[-1]["content"]
        number = int(text.split("number ")[1].split()[0])
        if number < self.bound:
            if self.empty:
                return '{"named_entities": []}' if "```" not in text else '{"triples": []}', {}
            raise RuntimeError("busy")
        return self.all(messages)


@pytest.mark.parametrize("empty", [False, True])
def test_gate_of_each_batch(spark, empty):
    """Of six batches of ten the first fails two whole ones and six of ten of the third; the second provider fails the first batch alone."""
    c = spark.createDataFrame([(f"c{i:03d}", f"it is number {i} here") for i in range(57)], "chunk_id string, content string")
    got = openie.openie_with_fallback(c, FailsBelow(26, empty), FailsBelow(10), batch=10, attempts=1)
    rows = {r["chunk_id"]: r for r in got.collect()}
    assert len(rows) == 57
    for i in range(57):
        r = rows[f"c{i:03d}"]
        assert r["batch"] == i // 10 and r["provider"] == ("none" if i < 10 else "second" if i < 30 else "first")
        assert len(r["triples"]) == (0 if i < 10 else 1)
    assert openie.openie_with_fallback(c.limit(0), FailsBelow(0), None).count() == 0


def test_numbers_are_exact(spark):
    rows = openie.numbered(spark.range(1003).select(F.sha2(F.col("id").cast("string"), 256).alias("id")), "id", 200)
    got = {r["batch"]: (r["n"], r["lo"], r["hi"]) for r in rows.groupBy("batch").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect()}
    assert {b: n for b, (n, _, _) in got.items()} == {0: 200, 1: 200, 2: 200, 3: 200, 4: 200, 5: 3}
    assert all(got[b][2] < got[b + 1][1] for b in range(5))
