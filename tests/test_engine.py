"""The engine end to end on a nine-sentence corpus, and the operators that SQL does not reach."""

import json
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph import Config, DenseRag, GraphRag
from quillgraph.functions import json_repair, text
from quillgraph.connectors import Guided, HttpChat, HttpEmbedder
from quillgraph.operators import embed, enrich, evaluate, graph, markdown, openie, qa, retrieve
from quillgraph.operators import knn as knn_module
from quillgraph.operators.knn import knn
from quillgraph.operators.ppr import ppr
from quillgraph.operators.store import VectorStore
from quillgraph.sources import files
from quillgraph.sources.shared import shared_dir
from quillgraph.sources.state import State

DOCS = ["Mira Ostrow is a glassblower.", "Jonas Felde is a glassblower.", "Petra Quill is a glassblower.", "Tamsin heard the silver bell.", "The baker carried the cracked bell across the frozen lake.", "Once the bell rang again, Tamsin found the baker at last.", "Ilse Varga's workshop stands in Torvik.", "Ruben was raised in Calden.", "Torvik belongs to Haldane Shire."]
MORE = ["Anton Varga's workshop stands in Torvik.", "Greta Varga's workshop stands in Torvik.."]
TRIPLES = {0: ["mira ostrow", "is", "glassblower"], 1: ["jonas felde", "is", "glassblower"], 2: ["petra quill", "is", "glassblower"], 3: ["tamsin", "heard", "silver bell"], 4: ["baker", "carried", "cracked bell"], 5: ["bell", "brought", "tamsin"], 6: ["ilse varga", "workshop in", "torvik"], 7: ["ruben", "raised in", "calden"], 8: ["torvik", "part of", "haldane shire"]}


class Known:
    """Answers with hand-written triples."""

    def __call__(self, messages):
        content = messages[-1]["content"]
        passage = content.split("```")[-2]
        t = [TRIPLES[i] for i, d in enumerate(DOCS) if d == passage] or [[passage.split()[0], "workshop in", "torvik"]]
        return json.dumps({"triples": t} if content.startswith("Entities") else {"named_entities": [t[0][0], t[0][2]]}), {"prompt_tokens": 1}


class Broken:
    def __call__(self, messages):
        raise RuntimeError("no service")


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "content string")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def state(e):
    return rows(e.chunks(), "chunk_id", "content"), rows(e.triples(), "chunk_id", "s", "p", "o")


def test_index_retrieve_delete(spark, tmp_path):
    e = GraphRag(spark, str(tmp_path / "a"), Config(ppr_iterations=6), generator=Known())
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    held = set(shared.iterdir())
    e.index(frame(spark, DOCS))
    assert set(shared.iterdir()) == held  # what an index writes on its way goes
    before = state(e)
    assert len(before[0]) == 9 and len(before[1]) == 9
    e.index(frame(spark, DOCS))
    assert state(e) == before  # twice is once
    info = e.graph_info().first()
    assert info["num_passage_nodes"] == 9 and info["num_phrase_nodes"] == 14 and info["num_extracted_triples"] == 18
    q = spark.createDataFrame([(1, "Which shire does the place of Ilse Varga's workshop belong to?"), (2, "zzz qqq")], "query_id long, question string")
    got = e.retrieve(q, 3)
    best = [r["content"] for r in got.where("query_id = 1").orderBy("rank").collect()]
    assert len(best) == 3 and DOCS[6] in best and DOCS[8] in best
    assert got.where("query_id = 2").count() == 3  # no fact: by vectors
    e.index(frame(spark, MORE))
    assert e.chunks().count() == 11
    held = set(shared.iterdir())
    e.delete(frame(spark, [*MORE, "never seen"]))
    assert state(e) == before and set(shared.iterdir()) == held
    gold = spark.createDataFrame([(1, DOCS[6]), (1, DOCS[8])], "query_id long, doc string")
    answers = spark.createDataFrame([(1, "Haldane Shire")], "query_id long, gold string")
    out = e.rag_qa(q, gold, answers)
    assert out["recall"].where("k = 5").first()["recall"] == 1.0
    assert set(out["scores"].columns) == {"ExactMatch", "F1"}
    again = GraphRag(spark, str(tmp_path / "a"), generator=Known())
    assert state(again) == before  # what is stored is loaded


def test_dense_baseline(spark, tmp_path):
    e = DenseRag(spark, str(tmp_path / "d"))
    e.index(frame(spark, DOCS))
    q = spark.createDataFrame([(1, "who heard the silver bell")], "query_id long, question string")
    assert e.retrieve(q, 1).first()["content"] == DOCS[3]
    assert e.extracted().count() == 0
    assert GraphRag(spark, str(tmp_path / "none")).retrieve_dpr(q).count() == 0


def test_change_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """An index or a delete that breaks off leaves the state before; what it wrote is swept up later."""
    e = GraphRag(spark, str(tmp_path / "a"), generator=Known())
    e.index(frame(spark, DOCS))
    before, folders = state(e), len(list((tmp_path / "a" / "state" / "data").glob("*/*")))
    lost = lambda *args: frame(spark, ["x"]).select(F.raise_error(F.lit("lost")).alias("src"))
    whole = graph.edge_deltas
    monkeypatch.setattr(graph, "edge_deltas", lost)
    for change in (lambda: e.delete(frame(spark, DOCS[:2])), lambda: e.index(frame(spark, MORE))):
        with pytest.raises(Exception, match="lost"):
            change()
        assert rows(e.triples(), "chunk_id", "s", "p", "o") == before[1] and e.edges().count() > 0
    monkeypatch.setattr(graph, "edge_deltas", whole)
    e.pre_openie()  # goes on where the index broke off
    assert e.chunks().count() == 11 and e.extracted().count() == 11 and e.audit().count() == 0
    e.delete(frame(spark, MORE))
    assert state(e) == before
    e.state.vacuum()
    assert state(GraphRag(spark, str(tmp_path / "a"))) == before and len(list((tmp_path / "a" / "state" / "data").glob("*/*"))) < folders + 20


class Counting:
    """Known, with a line in a file for each call."""

    def __init__(self, path, batched=False):
        self.path, self.batched = str(path), batched
        if batched:
            self.batch = self._batch

    def __call__(self, messages):
        with open(self.path, "a") as f:
            f.write("1\n")
        return Known()(messages) if "```" in messages[-1]["content"] else ("Answer: x", {})

    def _batch(self, many, json_schema=None):
        return [self(m) for m in many]


def calls(path):
    return len(path.read_text().split()) if path.exists() else 0


@pytest.mark.parametrize("batched", [False, True])
def test_models_are_asked_once(spark, tmp_path, batched):
    log = tmp_path / "log"
    model = Counting(log, batched)
    c = frame(spark, DOCS).select(F.md5("content").alias("chunk_id"), "content")
    openie.openie(c, model).count()
    assert calls(log) == 18  # entities and triples of nine passages
    got = openie.openie_with_fallback(c, model, openie.Sentences())
    assert got.count() == got.where("ok_triples").count() == 9 and calls(log) == 36
    e = GraphRag(spark, str(tmp_path / "a"), generator=model, reader=model)
    e.index(frame(spark, DOCS))
    assert calls(log) == 54
    q = spark.createDataFrame([(1, "silver bell"), (2, "Torvik")], "query_id long, question string")
    out = e.rag_qa(q, gold_answers=spark.createDataFrame([(1, "x")], "query_id long, gold string"))
    assert out["answers"].count() == 2 and out["scores"].first()["ExactMatch"] == 1.0 and out["scores"].count() == 1
    assert calls(log) == 56
    e.rag_qa(q)["answers"].collect()
    again = GraphRag(spark, str(tmp_path / "a"), generator=model, reader=model, force_openie_from_scratch=True)
    again.index(frame(spark, DOCS))
    assert calls(log) == 56  # all answers are in the cache
    assert again.triples().count() == 9
    assert openie.generate(frame(spark, ["a", "a", "b"]), lambda r: [{"role": "user", "content": r["content"]}], model, "content").count() == 3 and calls(log) == 58


def test_retrieve_reads_what_is_stored(spark, tmp_path, monkeypatch):
    e = GraphRag(spark, str(tmp_path / "a"), generator=Known())
    e.index(frame(spark, DOCS))
    q = spark.createDataFrame([(1, "Where is Ilse Varga's workshop")], "query_id long, question string")
    first = e.retrieve(q, 1).first()["content"]  # the walk's transitions follow from the edges once
    loaded = GraphRag(spark, str(tmp_path / "a"), generator=Broken())
    for name in ("fact_edges", "passage_edges", "synonym_edges", "arcs"):
        monkeypatch.setattr(graph, name, lambda *a, **k: pytest.fail("the graph is built again"))
    assert loaded.retrieve(q, 1).first()["content"] == first == DOCS[6]
    assert loaded.queries.read("queries", "question string").count() == 2  # for facts and for passages
    loaded.retrieve(q, 1).collect()
    assert loaded.queries.read("queries", "question string").count() == 2


def test_synonyms(spark, tmp_path):
    """Like entities are linked, those of a later index with the first ones too, and deleted with their passages."""
    e = GraphRag(spark, str(tmp_path / "a"), synonymy_edge_sim_threshold=0.8)
    e.index(frame(spark, ["Green hills sing aloud to riverbank-house", "Riverbank house stands by quiet water"]))
    first = rows(e.edges().where("kind = 'synonym'"), "src", "dst")
    e.index(frame(spark, ["Riverbank_house riverbank was sold Riverbank"]))
    e.index(frame(spark, ["The lane leads to Riverbank"]))
    names = {r["id"]: r["content"] for r in e.vertices().collect()}
    linked = {(names[a], names[b]) for a, b in rows(e.edges().where("kind = 'synonym'"), "src", "dst")}
    near = {(a, b) for a in names.values() for b in names.values() if a != b and len(set(a.split()) & set(b.split())) / (len(set(a.split())) * len(set(b.split()))) ** 0.5 >= 0.8 and len(a) < 30 and len(b) < 30}
    assert linked == near
    e.delete(frame(spark, ["Riverbank_house riverbank was sold Riverbank", "The lane leads to Riverbank"]))
    assert rows(e.edges().where("kind = 'synonym'"), "src", "dst") == first


class Picks:
    def __init__(self, said):
        self.said = said

    def __call__(self, messages):
        return self.said, {}


def test_model_filter(spark):
    c = spark.createDataFrame([(1, "q", "f1", "a", "is", "b", 0.9, 1), (1, "q", "f2", "c", "is", "d", 0.5, 2), (1, "q", "f3", "e", "is", "f", 0.4, 3)], "query_id long, question string, fact_id string, s string, p string, o string, score double, rank int")
    keep = lambda said, **how: [(r["fact_id"], r["rank"]) for r in retrieve.ModelFilter(Picks(said), **how)(c).orderBy("rank").collect()]
    header = "[[ ## fact_after_filter ## ]]\n"
    assert keep(header + '{"fact": [["e", "is", "f"], ["a", "is", "b"]]}') == [("f3", 1), ("f1", 2)]
    assert keep(header + '{"fact": [["c", "was", "d"]]}') == [("f2", 1)]  # the nearest
    assert keep(header + '{"fact": [["e", "is", "f"], ["a", "is", "b"]]}', most=1) == [("f3", 1)]
    assert keep("no idea") == [] and keep(header + "{") == []
    assert retrieve.ModelFilter(Broken(), attempts=1)(c).count() == 0


class Elsewhere:
    """A session on a cluster that names no shared folder."""

    conf = {}
    sparkContext = type("Context", (), {"master": "spark://host:7077"})


def test_a_cluster_has_to_name_a_shared_folder():
    with pytest.raises(ValueError, match="share"):
        shared_dir(Elsewhere(), "x")
    Elsewhere.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="share"):
        shared_dir(Elsewhere(), "x")


def test_prompt_from_a_file(tmp_path):
    from quillgraph.prompts import load_prompt, render_messages

    (tmp_path / "p.json").write_text(json.dumps([{"role": "user", "content": "${question}: ${facts}"}]))
    assert render_messages(load_prompt(str(tmp_path / "p.json")), question="q", facts="f") == [{"role": "user", "content": "q: f"}]
    (tmp_path / "p.json").write_text("{}")
    with pytest.raises(ValueError):
        load_prompt(str(tmp_path / "p.json"))


@pytest.fixture
def service():
    """A service on this machine that speaks both formats, fails at each first request, and remembers what it was sent."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, dict(self.headers), body))
            if len(seen) == 1:
                self.send_response(503)
                self.end_headers()
                return
            if self.path.startswith("/v1/chat/completions"):
                out = {"choices": [{"message": {"content": "hi " + body["messages"][-1]["content"]}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}
            elif self.path.startswith("/v1/embeddings"):
                out = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}
            else:
                self.send_response(404)
                self.end_headers()
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1", seen
    server.shutdown()


def test_http_services(spark, service):
    import urllib.error

    url, seen = service
    chat = HttpChat(url, "m", "k", wait_s=0.01, seed=5)
    assert chat([{"role": "user", "content": "you"}]) == ("hi you", {"prompt_tokens": 3, "completion_tokens": 2, "finish_reason": "stop"})
    assert len(seen) == 2 and seen[1][1]["Authorization"] == "Bearer k" and seen[1][2]["seed"] == 5 and seen[1][2]["temperature"] == 0.0
    assert HttpEmbedder(url, "e", "k", "2024-01-01")(["a", "bbb"]).tolist() == [[1.0, 1.0], [3.0, 1.0]]
    assert seen[-1][0].endswith("/embeddings?api-version=2024-01-01") and seen[-1][1]["Api-Key"] == "k"
    Guided(chat).batch([[{"role": "user", "content": "x"}]], openie.TRIPLES_JSON)
    assert seen[-1][2]["response_format"]["json_schema"]["schema"] == openie.TRIPLES_JSON and not chat.extra
    with pytest.raises(urllib.error.HTTPError):
        HttpChat(url + "/none", "m", wait_s=0.01)([{"role": "user", "content": "x"}])
    got = openie.generate(frame(spark, ["a", "b"]), lambda r: [{"role": "user", "content": r["content"]}], chat, "content").orderBy("content").collect()
    assert [r["response"] for r in got] == ["hi a", "hi b"] and got[0]["prompt_tokens"] == 3
    vectors = embed.embedded(frame(spark, ["a", "line\nfeed", ""]), HttpEmbedder(url, "e"), normalise=False).collect()
    assert {r["content"]: r["embedding"][0] for r in vectors} == {"a": 1.0, "line\nfeed": 9.0, "": 1.0} and "line feed" in [t for s in seen if "input" in s[2] for t in s[2]["input"]]


def test_embedders(spark):
    model = embed.MemoEmbedder(embed.HashedWords(8), most=3)
    one = model(["a b", "a b", "c"])
    assert one.shape == (3, 8) and (one[0] == one[1]).all() and one[0].sum() == 2 and (None, "c") in model
    assert model(["d", "e", "f"]).sum() == 3 and (None, "c") not in model
    got = embed.embedded(frame(spark, ["The cat", "", "x x"]), embed.HashedWords(8)).collect()
    size = {r["content"]: sum(v * v for v in r["embedding"]) for r in got}
    assert size["x x"] == pytest.approx(1) and size[""] == 0


def test_command_line(spark, tmp_path, capsys):
    from quillgraph import __main__ as cli

    (tmp_path / "corpus.json").write_text(json.dumps([{"title": f"T{i}", "text": d, "idx": i} for i, d in enumerate(DOCS)]))
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "question": "who heard the silver bell", "answer": ["Tamsin"], "paragraphs": [{"title": "T3", "text": DOCS[3], "is_supporting": True, "idx": 0}]}]))
    for name in ("ask", "ask-dense"):
        found = cli.ask(spark, cli.arguments([name, str(tmp_path / "corpus.json"), str(tmp_path / "q.json"), "--save-dir", str(tmp_path / name)]))
        assert found["recall"].where("k = 1").first()["recall"] == 1.0 and found["scores"].count() == 1
        assert found["solutions"].first()["docs"][0] == f"T3\n{DOCS[3]}"
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "x.md").write_text(MD)
    cli.structured(spark, cli.arguments(["markdown", str(tmp_path / "docs"), "-o", str(tmp_path / "s")]))
    told = cli.enriched(spark, cli.arguments(["abstracts", str(tmp_path / "s"), str(tmp_path / "a"), "--dry-run"]))["estimate"]
    assert rows(told, "type", "tasks") == [("chunk", 4), ("code", 1), ("file", 1), ("table", 1)] and not (tmp_path / "a").exists()
    done = cli.enriched(spark, cli.arguments(["abstracts", str(tmp_path / "s"), str(tmp_path / "a")]))["processed"]
    assert rows(done, "type", "done", "failed") == [("chunk", 4, 0), ("code", 1, 0), ("file", 1, 0), ("table", 1, 0)]
    assert files.read_structure(spark, str(tmp_path / "a"))["tables"].where("abstract <> ''").count() == 1
    cli.enriched(spark, cli.arguments(["triples", str(tmp_path / "a"), str(tmp_path / "t")]))
    assert files.read_structure(spark, str(tmp_path / "t"))["doc_chunks"].where("size(extracted_triples) > 0").count() == 3
    parts = files.read_structure(spark, str(tmp_path / "s"))
    files.write_structure(parts | {"files": parts["files"].withColumn("file_id", F.lit("x"))}, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="no structure"):
        cli.enriched(spark, cli.arguments(["triples", str(tmp_path / "none"), "x"]))


def test_stream_progress(spark, tmp_path):
    from quillgraph.streaming.ingest import Progress, index_stream, passages

    frame(spark, DOCS).write.parquet(str(tmp_path / "in"))
    listener, store = Progress(), VectorStore(spark, str(tmp_path), "chunk")
    spark.streams.addListener(listener)
    index_stream(passages(spark, str(tmp_path / "in")), store.insert, str(tmp_path / "c")).awaitTermination()
    for _ in range(100):
        if listener.batches:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert sum(b["rows"] for b in listener.batches) >= 9 and store.texts().count() == 9


def power_steps(arcs, reset, d, steps):
    """Step by step over dictionaries."""
    out = {}
    for s, t, w in arcs:
        out.setdefault(s, []).append((t, w))
    total = sum(reset.values())
    r = {k: v / total for k, v in reset.items()}
    now = dict(r)
    for _ in range(steps):
        lost = sum(v for k, v in now.items() if k not in out)
        new = {k: v * (1 - d + d * lost) for k, v in r.items()}
        for k, v in now.items():
            for t, w in out.get(k, []):
                new[t] = new.get(t, 0) + d * v * w / sum(x for _, x in out[k])
        now = new
    return now


@pytest.mark.parametrize("directed", [False, True])
def test_ppr_by_brute_force(spark, directed):
    """With nodes that have no arcs, and, if directed, nodes that only arcs lead to."""
    import random

    r = random.Random(3)
    arcs = [(f"n{r.randrange(20)}", f"n{r.randrange(24 if directed else 20)}", r.random() + 0.1) for _ in range(50)]
    arcs = list({(a, b): (a, b, w) for a, b, w in arcs if a != b}.values())
    if not directed:
        arcs = [(a, b, w) for x, y, w in {frozenset(t[:2]): t for t in arcs}.values() for a, b in ((x, y), (y, x))]
    reset = {1: {"n1": 2.0, "alone": 1.0, "n5": 0.5}, 2: {"alone": 1.0}, 3: {f"n{i}": i + 1.0 for i in range(20)}}
    table = spark.createDataFrame([(q, n, x) for q, rs in reset.items() for n, x in rs.items()], "query_id long, node string, reset double")
    for steps in (1, 7):
        got = {(x["query_id"], x["node"]): x["rank"] for x in ppr(spark.createDataFrame(arcs, "src string, dst string, weight double"), table, iterations=steps, steps=3).collect()}
        want = {(q, n): v for q, rs in reset.items() for n, v in power_steps(arcs, rs, 0.5, steps).items()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_knn_ties_are_cut(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 0.0]) for i in range(60)], "id long, embedding array<float>")
    for how in ({}, {"broadcast_rows": 10, "block": 16}):
        got = knn(v.where("id < 4"), v, 3, **how).orderBy("query_id", "rank").collect()
        assert [r["key_id"] for r in got] == [0, 1, 2, 1, 3, 5, 0, 1, 2, 1, 3, 5]
    assert knn_module._best(np.arange(2), np.zeros((2, 2)), np.arange(1000), np.zeros((1000, 2)), 5, None).shape[0] == 10
    scaled = knn_module.scaled_top_k(v.where("id < 2"), v, 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["key_id"], r["score"]) for r in scaled] == [(0, 0, 1.0), (0, 1, 1.0), (1, 1, 1.0), (1, 3, 1.0)]
    assert rows(knn_module.scaled_top_k(v, v, 2, broadcast_rows=3), "query_id", "key_id", "score") == rows(knn_module.scaled_top_k(v, v, 2), "query_id", "key_id", "score")


def test_links_climb_any_height(spark):
    deep = "/".join(f"d{i}" for i in range(15))
    d = spark.createDataFrame([(1, f"{deep}/x.md", f"[a]({'../' * 15}top.md) [b](./../d14/./y.md) [c]({'../' * 16}top.md)"), (2, "top.md", "t"), (3, f"{deep}/y.md", "u")], "doc_id long, path string, content string")
    assert rows(markdown.jumps(d, d), "jump_name") == [("a",), ("b",)]


def test_ppr(spark):
    arcs = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 3.0)], "src string, dst string, weight double")
    reset = spark.createDataFrame([(1, "a", 1.0), (1, "b", float("nan")), (1, "c", -2.0), (2, "c", 5.0), (3, "a", 0.0)], "query_id long, node string, reset double")
    got = {(r[0], r[1]): r[2] for r in ppr(arcs, reset, damping=0.5, iterations=40).collect()}
    # by hand: query 1 solves a = .5 + .5 (b / 4 + c), b = a / 2, c = .5 b 3 / 4
    a = 0.5 / (1 - 1 / 16 - 3 / 32)
    assert got[(1, "a")] == pytest.approx(a) and got[(1, "b")] == pytest.approx(a / 2) and got[(1, "c")] == pytest.approx(a * 3 / 16)
    assert got[(2, "c")] == pytest.approx(1) and not any(k[0] == 3 for k in got)


def test_knn_grid_is_the_scan(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "id long, embedding array<float>")
    one, grid = knn(v, v, 4), knn(v, v, 4, broadcast_rows=10, block=16)
    key = lambda df: sorted((r["query_id"], r["rank"], r["key_id"]) for r in df.collect())
    assert key(one) == key(grid) and one.count() == 240
    assert knn(v.limit(0), v, 3).count() == 0 and knn(v, v.limit(0), 3).count() == 0


def test_store(spark, tmp_path):
    s = VectorStore(spark, str(tmp_path), "entity")
    assert s.load().count() == 0
    assert s.insert(frame(spark, ["x", "y", "x", None])).count() == 2
    assert s.insert(frame(spark, ["y", "z"])).collect()[0]["content"] == "z"
    ids = s.id_of(frame(spark, ["x"])).select("hash_id")
    s.delete(ids)
    assert rows(s.texts(), "content") == [("y",), ("z",)]
    with pytest.raises(KeyError):
        s.delete(ids)


@pytest.mark.parametrize("broken,closed", [('{"a": [1, 2', '{"a": [1]}'), ('{"a": "x", "b": "y', '{"a": "x"}'), ('{"a": 1}', '{"a": 1}'), ('{"a": [["p", "q"], ["r"', '{"a": [["p", "q"]]}'), ('{"t": ["a}", "b]", "c', '{"t": ["a}", "b]"]}')])
def test_close_json(broken, closed):
    assert json_repair.close_json(broken) == closed
    json.loads(closed)


def test_parsers(spark):
    df = spark.createDataFrame([('Sure: {"named_entities": ["A", "B", "A"]} ok', 'x {"triples": [["a","b","c"],["a","b"],["a","b","c"]]}'), ("none", ""), ('{"named_entities": [["A", "person"]]}', "{")], "n string, t string")
    got = df.select(json_repair.entities(F.col("n")), json_repair.triples(json_repair.repaired(F.col("t")))).collect()
    assert got[0][0] == ["A", "B"] and got[0][1] == [["a", "b", "c"]] and got[1][0] == [] and got[2][0] == ["A"] and got[2][1] == []
    assert json_repair.filtered_facts('[[ ## fact_after_filter ## ]]\n{"fact": [["a", "b", "c"]]}\n[[ ## completed ## ]]') == [["a", "b", "c"]]
    assert json_repair.filtered_facts("[[ ## fact_after_filter ## ]]\n{'fact': [('a', 'b', 'c')]}") == [["a", "b", "c"]]
    assert json_repair.filtered_facts("nothing") == []


def test_text(spark):
    one = spark.createDataFrame([("Thought: x Answer:  The Eiffel-Tower! ",)], "t string")
    assert one.select(text.answer_of(F.col("t"))).first()[0] == "The Eiffel-Tower!"
    assert one.select(text.normalize_answer(F.lit("The  cat's A hat"))).first()[0] == "cats hat"
    assert one.select(text.normalize(F.lit("  Ünï-cödé_1, x"))).first()[0] == "ünï cödé_1 x"
    assert one.select(text.to_template(F.lit("a {b} c"))).first()[0] == "a ${b} c"
    assert one.select(text.decode_unicode(F.lit("\\u00e9 x"))).first()[0] == "é x"
    assert one.select(text.to_bool(F.lit("Yes")), text.to_bool(F.lit("0"))).first()[:] == (True, False)
    with pytest.raises(ValueError):
        text.render("${a}", b="1")
    with pytest.raises(ValueError):
        text.render_column("${a}")
    assert text.instruction("unknown") == text.instruction("query_to_passage")


def test_fallback(spark):
    c = spark.createDataFrame([("c1", "a b c d"), ("c2", "e f g")], "chunk_id string, content string")
    second = openie.openie_with_fallback(c, Broken(), openie.Sentences())
    assert second.where("ok_entities AND ok_triples").count() == 2
    none = openie.openie_with_fallback(c, Broken(), None)
    assert none.where("size(triples) = 0").count() == 2


def test_metrics(spark):
    a = spark.createDataFrame([(1, "the cat", "cat"), (1, "dog", "cat"), (2, "a b c", "b c d"), (3, "x", "y")], "query_id long, gold string, predicted string")
    assert {r[0]: r[1] for r in evaluate.exact_match(a).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
    f1 = {r[0]: r[1] for r in evaluate.token_f1(a).collect()}
    assert f1[1] == 1.0 and f1[2] == pytest.approx(2 * (2 / 3) * 1.0 / (2 / 3 + 1.0)) and f1[3] == 0.0


def test_phrase_seeds(spark):
    kept = spark.createDataFrame([(1, "a", "b", 0.9, 1), (1, "a", "c", 0.5, 2)], "query_id long, s string, o string, score double, rank int")
    t = spark.createDataFrame([("k1", "a", "p", "b"), ("k2", "a", "p", "c")], "chunk_id string, s string, p string, o string")
    got = {r["entity_id"]: (r["weight"], r["link"]) for r in retrieve.phrase_seeds(kept, graph.mentions(t), 5).collect()}
    names = {r["content"]: r["entity_id"] for r in graph.entities(t).collect()}
    assert got[names["a"]] == (0.25, pytest.approx(0.7)) and got[names["b"]] == (0.9, 0.9)  # the last fact counts, by two chunks


MD = "# Top\nintro [a](other.md) [w](https://x.y)\n\nnext\n## 3. Sub\n```python\n# not a title\n1\n2\n3\n4\n```\nafter\n### Deep\n|a|b|\n|-|-|\n|1|2|\n|3|4|\n|5|6|\n## Last\n```\nopen"


def test_markdown(spark):
    d = spark.createDataFrame([(1, "docs/x.md", MD), (2, "docs/other.md", "plain"), (3, "docs/e.md", "")], "doc_id long, path string, content string")
    n = {r[0]: r[1] for r in markdown.number_headings(d).collect()}
    assert "# 1 Top" in n[1] and "## 1.1 Sub" in n[1] and "### 1.1.1 Deep" in n[1] and "## 1.2 Last" in n[1] and "# not a title" in n[1] and n[3] == ""
    plain = {r[0]: r[1] for r in markdown.number_headings(d, 2).collect()}
    assert "# 1. Top" in plain[1] and "## 3. Sub" in plain[1] and "## 2.1. Last" in plain[1]  # the fence's comment counts here, a numbered title does not
    parts = markdown.structure(d, 1)
    c = {r["headers"].get("h3") or r["headers"].get("h2") or r["headers"].get("h1"): r for r in parts["doc_chunks"].where("doc_id = 1").collect()}
    assert set(c) == {"1 Top", "1.1 Sub", "1.1.1 Deep", "1.2 Last"}
    assert c["1 Top"]["parent_id"] is None and c["1.1.1 Deep"]["parent_id"] == c["1.1 Sub"]["chunk_id"] and c["1.1 Sub"]["parent_id"] == c["1 Top"]["chunk_id"]
    assert "next" in c["1 Top"]["content"] and "  \nnext" in c["1 Top"]["content"]
    assert parts["codes"].count() == 1 and "after" in parts["codes"].first()["content"] and parts["tables"].count() == 1
    assert "```" not in c["1.1 Sub"]["filter_content"] and "open" in c["1.2 Last"]["filter_content"]
    j = markdown.jumps(d, d).collect()
    assert len(j) == 1 and j[0]["jump_name"] == "a" and j[0]["file_path"] == "other.md"
    assert rows(markdown.counts(parts), "kind", "n") == [("chunks", 5), ("codes", 1), ("tables", 1)]
    nested = {r["title"]: r for r in markdown.nested_sections(d.where("doc_id < 3")).collect()}
    assert nested["Deep"]["path"][-1] == "3. Sub" and "Main Content" in nested
    assert files.structure_json(parts).count() == 3 and files.valid_structure(parts["files"].select("file_id", "file_path", "content"))
    tasks = enrich.abstract_tasks(parts)
    made = enrich.abstracts(tasks, Broken(), openie.Sentences())
    assert enrich.write_abstracts(parts, made)["files"].where("abstract = ''").count() == 0
    assert enrich.extract(parts["doc_chunks"], openie.Sentences()).where("size(extracted_entities) > 0").count() == 3  # sentences of three words and more


def test_files(spark, tmp_path):
    (tmp_path / "t" / "u").mkdir(parents=True)
    (tmp_path / "t" / "a.md").write_bytes("# 中文".encode("gbk"))
    (tmp_path / "t" / "u" / "b.MD").write_text("# é")
    (tmp_path / "t" / "c.txt").write_text("no")
    assert rows(files.markdown(spark, str(tmp_path / "t")), "content") == [("# é",), ("# 中文",)]
    with pytest.raises(ValueError):
        files.markdown_file(spark, "x.txt")
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "question": "q", "answer": ["x", "x"], "answer_aliases": ["y"], "paragraphs": [{"title": "T", "text": "t", "is_supporting": True, "idx": 0}, {"title": "U", "text": "u", "is_supporting": False, "idx": 1}]}, {"id": "2", "question": "r", "obj": "o", "o_aliases": ["p"], "supporting_facts": [["T", "0"]], "context": [{"title": "T", "sentences": ["a.", "b."]}]}]))
    q = files.gold_answers(files.gold_docs(files.questions(spark, str(tmp_path / "q.json")))).orderBy("id").collect()
    assert q[0]["gold_docs"] == ["T\nt"] and q[0]["gold_answers"] == ["x", "y"] and q[1]["gold_docs"] == ["T\na.b."] and q[1]["gold_answers"] == ["o", "p"]
    o = spark.createDataFrame([("c", "p", ["ab", "c d"], [["a", "b", "c"]])], "chunk_id string, passage string, entities array<string>, triples array<array<string>>")
    files.write_openie(o, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o" / "stats")).first().asDict() == {"avg_ent_chars": 2.5, "avg_ent_words": 1.5}
    (tmp_path / "o.json").write_text(json.dumps({"docs": [{"idx": "c", "passage": "p", "extracted_entities": ["a"], "extracted_triples": [["a", "b", "c"]]}], "avg_ent_chars": 1, "avg_ent_words": 1}))
    assert files.read_openie(spark, str(tmp_path / "o.json")).first()["triples"] == [["a", "b", "c"]]


def test_cache_and_nearest(spark):
    r = qa.keyed(spark.createDataFrame([("hi",), ("hi",), ("ho",)], "messages string"), "m", 1, 0.0)
    cache = spark.createDataFrame([], "key string, message string, metadata string")
    hit, ask = qa.cached(r, cache)
    assert hit.count() == 0 and ask.count() == 2
    cache = qa.store_responses(cache, ask.select("key", F.col("messages").alias("message"), F.lit("{}").alias("metadata")))
    hit, ask = qa.cached(r, cache)
    assert hit.count() == 3 and ask.count() == 0
    made = spark.createDataFrame([(1, "alpha"), (1, "betta")], "q long, t string")
    known = spark.createDataFrame([(1, 0, "alpha"), (1, 1, "beta")], "q long, pos int, candidate string")
    assert rows(qa.nearest(made, known, "q", "t"), "t", "candidate") == [("alpha", "alpha"), ("betta", "beta")]


def split_at_headings(content):
    """Line by line: (headers, content) of each section."""
    import re

    path, inside, out, gap = {}, False, [], False
    for line in content.split("\n"):
        s = re.sub(r"^\s+|\s+$", "", line)
        head = None if inside else re.match(r"(#{1,6}) (.+)", s)
        if head and not s.startswith("```"):
            path = {k: t for k, t in path.items() if k < len(head[1])} | {len(head[1]): head[2].strip()}
            gap = False
            continue
        if s.startswith("```"):
            inside = not inside
        elif s == "" and not inside:
            gap = True
            continue
        if not out or out[-1][0] != path:
            out.append((path, s))
        else:
            out[-1] = (path, out[-1][1] + ("  \n" if gap else "\n") + s)
        gap = False
    return [({f"h{k}": t for k, t in p.items()}, "".join(f"{'#' * k} {t}  \n" for k, t in p.items()) + body) for p, body in out]


def test_sections_by_brute_force(spark):
    """All sections of the documents behind md_chunks and md_parents, those of the text too."""
    from quillgraph.plans.queries_docs import docs
    from tests.conftest import SF

    made = docs(spark, SF).cache()
    got, parent = {}, {}
    sections = markdown.sections(made).cache()
    for r in sections.orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append((r["headers"], r["content"]))
    want = {r["doc_id"]: split_at_headings(r["content"]) for r in made.collect()}
    assert got == want and all(len(x) == 3 for x in got.values())
    top = {r["doc_id"]: r["chunk_id"] for r in sections.where("depth = 1").collect()}
    for r in markdown.parents(sections).collect():
        parent.setdefault(r["doc_id"], []).append(r["parent_id"])
    assert all(sorted(p, key=str) == sorted([None, top[d], top[d]], key=str) for d, p in parent.items())
