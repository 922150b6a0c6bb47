"""Versioned state: writers side by side, streams that deliver a batch again, compaction, vacuum; the graph by deltas."""

import json
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from quillgraph import GraphRag
from quillgraph.operators import graph
from quillgraph.sources.state import Conflict, State
from quillgraph.streaming.ingest import index_batches, passages


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "content string")


def test_writers_side_by_side_lose_nothing(spark, tmp_path):
    errors = []

    def write(who):
        state = State(spark, str(tmp_path / "s"))
        for i in range(5):
            try:
                state.change(add={"t": frame(spark, [f"{who}-{i}"])})
            except Exception as e:  # shown below
                errors.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    state = State(spark, str(tmp_path / "s"))
    assert not errors and state.version() == 15
    assert sorted(r[0] for r in state.read("t", "content string").collect()) == sorted(f"{w}-{i}" for w in range(3) for i in range(5))


def test_replacing_writers_fail(spark, tmp_path):
    a, b = (State(spark, str(tmp_path / "s")) for _ in range(2))
    a.change(add={"t": frame(spark, ["1"])})
    since = b.version()
    a.change(add={"t": frame(spark, ["2"])})
    with pytest.raises(Conflict, match="another writer"):
        b.change(replace={"t": frame(spark, ["3"])}, since=since)
    put, raced = b.put, []

    def late(number, body):  # another writer comes between the writing of folders and the manifest
        if not raced:
            raced.append(a.change(add={"t": frame(spark, ["4"])}))
        return put(number, body)

    b.put = late
    with pytest.raises(Conflict):
        b.change(replace={"t": frame(spark, ["3"])})
    raced.clear()
    b.change(add={"t": frame(spark, ["5"])})
    assert sorted(r[0] for r in a.read("t", "content string").collect()) == ["1", "2", "4", "4", "5"]
    assert not put(a.version(), "{}") and json.loads(json.dumps(a.manifest()))["streams"] == {}


def test_keys_stay_unique(spark, tmp_path):
    a, b = (State(spark, str(tmp_path / "s")) for _ in range(2))
    since = a.version()
    b.change(add={"t": frame(spark, ["1", "2"])})
    with pytest.raises(Conflict, match="same rows"):
        a.change(add={"t": frame(spark, ["2", "3"])}, since=since, keys={"t": "content"})
    a.change(add={"t": frame(spark, ["4"])}, since=since, keys={"t": "content"})
    assert a.read("t", "content string").count() == 3


def test_vacuum_and_compaction(spark, tmp_path):
    s = State(spark, str(tmp_path / "s"))
    for i in range(4):
        s.change(add={"t": frame(spark, [str(i)])})
    s.derived("d", lambda: s.read("t", "content string"), "content string")
    assert not s.compact("t", "content string", 5) and s.compact("t", "content string", 4) and len(s.tables()["t"]) == 1
    folders = lambda: len(list((tmp_path / "s" / "data" / "t").iterdir()))
    s.vacuum(3600.0)
    assert folders() == 5 and (tmp_path / "s" / "derived" / "d").exists()
    s.vacuum()
    assert folders() == 1 and not list((tmp_path / "s" / "derived" / "d").iterdir()) and s.read("t", "content string").count() == 4
    assert [p.name for p in (tmp_path / "s" / "log").iterdir() if not p.name.startswith(".")] == [f"{s.version():012d}.json"]


def test_engines_side_by_side(spark, tmp_path):
    """Two engines index passages that overlap, at once: as if one had done it."""
    texts = [f"Ada likes the number {i}. Bob reads about the number {i}." for i in range(8)]
    errors = []

    def index(some):
        try:
            GraphRag(spark, str(tmp_path / "a"), vector_dims=8).index(frame(spark, some))
        except Exception as e:  # shown below
            errors.append(e)

    threads = [threading.Thread(target=index, args=(some,)) for some in (texts[:5], texts[3:])]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    both, one = GraphRag(spark, str(tmp_path / "a"), vector_dims=8), GraphRag(spark, str(tmp_path / "b"), vector_dims=8)
    both.pre_openie()
    one.index(frame(spark, texts))
    same(both, one)


def same(a, b):
    held = lambda e: [sorted(map(tuple, x.collect())) for x in (e.chunks(), e.extracted().select("chunk_id"), e.triples(), e.stores["entity"].texts(), e.stores["fact"].texts(), e.edges().select("src", "dst", F.round("weight", 6), "kind"))]
    assert held(a) == held(b)


def test_edges_equal_a_rebuild(spark, tmp_path):
    """After a random run of indexes and deletes the edges are those of the stored triples; an index reads no old triple."""
    r = random.Random(2)
    texts = [f"{r.choice(['Ada', 'Bob', 'Cy'])} {r.choice(['likes', 'sees'])} {r.choice(['tea', 'ham', 'rye', 'Bob'])}. Thing {i} has one." for i in range(24)]
    e = GraphRag(spark, str(tmp_path / "a"), vector_dims=8, compact_after=4, vacuum_after_s=0.0)
    held = set()
    for turn in range(7):
        some = set(r.sample(texts, 6))
        if turn % 3 == 2:
            e.delete(frame(spark, some))
            held -= some
        else:
            e.index(frame(spark, some))
            held |= some
    whole = GraphRag(spark, str(tmp_path / "b"), vector_dims=8)
    whole.index(frame(spark, held))
    same(e, whole)
    rebuilt = graph.edges_of(e.triples()).where("kind <> 'synonym'")
    pick = lambda x: sorted(map(tuple, x.select("src", "dst", "weight", "kind").collect()))
    assert pick(graph.summed(e.state.read("deltas", "src string, dst string, weight double, kind string"))) == pick(rebuilt)
    read = []
    e.triples = lambda: read.append(1) or pytest.fail("old triples are read")
    e.index(frame(spark, ["Dee wants a new thing."]))
    assert not read


class Killed(Exception):
    pass


@pytest.mark.parametrize("at", [1, 2])
def test_stream_that_is_killed_gives_the_batch_result(spark, tmp_path, at):
    """Killed between the folders and the manifest of the first or the second change of a batch; the batch comes again."""
    texts = [f"Ada likes the number {i}." for i in range(6)]
    frame(spark, texts).write.parquet(str(tmp_path / "in"))
    e = GraphRag(spark, str(tmp_path / "a"), vector_dims=8)
    put, left = e.state.put, [at]

    def dies(number, body):
        left[0] -= 1
        if left[0] == 0:
            raise Killed
        return put(number, body)

    e.state.put = dies
    with pytest.raises(Exception, match="Killed"):
        index_batches(passages(spark, str(tmp_path / "in")), e, str(tmp_path / "check")).awaitTermination()
    e = GraphRag(spark, str(tmp_path / "a"), vector_dims=8)
    index_batches(passages(spark, str(tmp_path / "in")), e, str(tmp_path / "check")).awaitTermination()
    one = GraphRag(spark, str(tmp_path / "b"), vector_dims=8)
    one.index(frame(spark, texts))
    same(e, one)
    (stream, last), version = next(iter(e.state.manifest()["streams"].items())), e.state.version()
    e.index(frame(spark, ["Zoe is a batch of another content."]), (stream, last))  # a number that is there changes nothing
    assert e.state.version() == version and e.chunks().count() == 6
    frame(spark, ["Bob sees a new number."]).write.mode("append").parquet(str(tmp_path / "in"))
    index_batches(passages(spark, str(tmp_path / "in")), e, str(tmp_path / "check")).awaitTermination()
    assert e.chunks().count() == 7 and e.state.manifest()["streams"][stream] == last + 1


def test_object_stores_take_a_manifest_once(spark, tmp_path, monkeypatch):
    """The way by a conditional create, on the local file system under another name."""
    from quillgraph.sources import state as module

    monkeypatch.setattr(module, "OBJECT_STORES", {"file"})
    s = State(spark, str(tmp_path / "s"))
    s.change(add={"t": frame(spark, ["1"])})
    assert not s.put(1, "{}") and s.version() == 1
    s.change(add={"t": frame(spark, ["2"])})
    assert s.read("t", "content string").count() == 2 and os.path.exists(tmp_path / "s" / "log" / f"{2:012d}.json") and time.time() > 0
