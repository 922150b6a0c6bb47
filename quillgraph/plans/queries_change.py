"""Queries on what changes and breaks off: model calls that go on where a run ended, gates of batches, streams and writers of the state, synonyms of an engine."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.engine import GraphRag
from quillgraph.operators import calls, knn, markdown, openie
from quillgraph.plans.queries_docs import _SECTIONS, docs
from quillgraph.plans.queries_engine import _RAW
from quillgraph.plans.queries_graph import _SIM, _vectors
from quillgraph.plans.registry import query
from quillgraph.plans.tables import ENTITY, PASSAGES, norm_sql, passages, table
from quillgraph.sources import files
from quillgraph.sources.shared import once, shared_dir
from quillgraph.sources.state import State
from quillgraph.streaming.ingest import index_batches
from quillgraph.streaming.ingest import passages as arriving


class Gone(BaseException):
    """A fault that no service reports: the process is at its end."""


class Shouts:
    """Answers with the prompt's length; ends the process at prompts that begin with a letter, if there is one."""

    def __init__(self, fatal: str = ""):
        self.fatal = fatal

    def __call__(self, messages: list[dict[str, str]]) -> tuple[str, dict]:
        said = messages[-1]["content"]
        if self.fatal and said.startswith(self.fatal):
            raise Gone
        return f"{len(said)}!", {"prompt_tokens": len(said)}


@query(f"WITH {PASSAGES} SELECT chunk_id, 'ok' AS status, length(content) || '!' AS response FROM passages")
def calls_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage is asked; a first run breaks off at those with a capital T in front, a second goes on from the answers that the first kept."""
    cache = calls.ResponseCache(State(spark, shared_dir(spark, "calls")))
    rows = passages(spark, sf_dir)
    ask = lambda model: calls.generate(rows, lambda r: [{"role": "user", "content": r["content"]}], model, "chunk_id", cache=cache, batch=20)
    try:
        ask(Shouts("T"))
    except Exception:  # Spark's report of the task that ended
        pass
    return ask(Shouts()).select("chunk_id", "status", "response")


class Breaks:
    """A model for many prompts at once, which breaks the schema at texts of a length that three divides when it reads them first, and at those that seven divides always."""

    def __init__(self) -> None:
        self.seen: set[str] = set()

    def batch(self, many: list[list[dict[str, str]]], json_schema: dict | None = None) -> list[tuple[str, dict]]:
        out = []
        for m in many:
            said = m[-1]["content"]
            broken = len(said) % 7 == 0 or len(said) % 3 == 0 and said not in self.seen
            self.seen.add(said)
            out.append((json.dumps({"named_entities": len(said) if broken else [str(len(said))]}), {}))
        return out


@query("""SELECT DISTINCT text, CASE WHEN length(text) % 7 = 0 THEN 'SchemaError: the answer does not follow the schema' ELSE 'ok' END AS status,
    CASE WHEN length(text) % 7 <> 0 THEN '{"named_entities": ["' || length(text) || '"]}' END AS response FROM conversations WHERE text IS NOT NULL""")
def calls_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different text, in batches of a budget of tokens, of a model whose answers are held against a schema and asked for again."""
    rows = table(spark, sf_dir, "conversations").select("text").where("text is not null").distinct()
    got = calls.generate(rows, lambda r: [{"role": "user", "content": r["text"]}], Breaks(), "text", attempts=2, wait_s=0.0, json_schema=openie.ENTITIES_JSON, batch=50, budget=2000)
    return got.select("text", "status", "response")


class FailsOnEven:
    """Entities and triples of passages of odd length; a busy service for the others."""

    def __init__(self) -> None:
        self.all = openie.Sentences()

    def __call__(self, messages: list[dict[str, str]]) -> tuple[str, dict]:
        said = messages[-1]["content"]
        if len(said[said.index("```") + 3 : -3]) % 2 == 0:
            raise RuntimeError("busy")
        return self.all(messages)


_RATE = """n AS (SELECT chunk_id, (row_number() OVER (ORDER BY chunk_id) - 1) // 20 AS batch, length(content) % 2 = 1 AS odd, chunk_id IN (SELECT chunk_id FROM said) AS told FROM passages),
    g AS (SELECT batch, avg(CASE WHEN odd AND told THEN 1.0 ELSE 0.0 END) > 0.5 AS one, avg(CASE WHEN told THEN 1.0 ELSE 0.0 END) > 0.5 AS two FROM n GROUP BY batch)"""


@query(f"""WITH {_RAW}, {_RATE}, t AS (SELECT chunk_id, count(*) AS n FROM said GROUP BY chunk_id)
    SELECT n.chunk_id, CAST(n.batch AS BIGINT) AS batch, CASE WHEN one THEN 'first' WHEN two THEN 'second' ELSE 'none' END AS provider, CASE WHEN one AND odd OR NOT one AND two THEN coalesce(t.n, 0) ELSE 0 END AS n_triples FROM n JOIN g USING (batch) LEFT JOIN t USING (chunk_id)""")
def gate_of_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages in batches of twenty: those of which the first provider answers half or less go to the second, and the others do not."""
    got = openie.openie_with_fallback(passages(spark, sf_dir), FailsOnEven(), openie.Sentences(), batch=20, attempts=1)
    return got.select("chunk_id", "batch", "provider", F.size("triples").cast("long").alias("n_triples"))


class Killed(Exception):
    pass


@query(f"""WITH {_RAW}, t AS (SELECT DISTINCT chunk_id, {norm_sql('s')} AS s, {norm_sql('p')} AS p, {norm_sql('o')} AS o FROM said)
    SELECT chunk_id, (SELECT count(*) FROM t WHERE t.chunk_id = p.chunk_id) AS n_triples, 1::BIGINT AS n_extracted FROM passages p""")
def stream_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that a stream brings to an engine's index; the first run is killed between the folders of a batch's last change and its manifest."""
    root = shared_dir(spark, "arrivals")
    passages(spark, sf_dir).select("content").write.parquet(f"{root}/in")
    settings = {"vector_dims": 8, "synonymy_edge_sim_threshold": 1.5}
    engine = GraphRag(spark, f"{root}/rag", **settings)
    put, left = engine.state.put, [2]

    def dies(number: int, body: str) -> bool:
        left[0] -= 1
        if not left[0]:
            raise Killed
        return put(number, body)

    engine.state.put = dies
    run = lambda e: index_batches(arriving(spark, f"{root}/in"), e, f"{root}/check").awaitTermination()
    try:
        run(engine)
    except Exception:  # the stream's report of the kill
        pass
    engine = GraphRag(spark, f"{root}/rag", **settings)
    run(engine)
    n = engine.triples().groupBy("chunk_id").agg(F.count("*").alias("n_triples"))
    done = engine.extracted().groupBy("chunk_id").agg(F.count("*").alias("n_extracted"))
    return engine.chunks().join(n, "chunk_id", "left").join(done, "chunk_id", "left").select("chunk_id", F.coalesce("n_triples", F.lit(0)).alias("n_triples"), F.coalesce("n_extracted", F.lit(0)).alias("n_extracted"))


@query(f"WITH {PASSAGES} SELECT chunk_id, content FROM passages")
def state_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four writers add a quarter of the passages each, at once."""
    root, rows = shared_dir(spark, "writers"), once(passages(spark, sf_dir), "passages")
    part = lambda i: rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(4)) == i)
    with ThreadPoolExecutor(4) as threads:
        list(threads.map(lambda i: State(spark, root).change(add={"passages": part(i)}), range(4)))
    return State(spark, root).read("passages", "chunk_id string, content string")


@query(f"""WITH {_RAW}, t AS (SELECT DISTINCT {norm_sql('s')} AS s, {norm_sql('o')} AS o FROM said), e AS (SELECT DISTINCT unnest([s, o]) AS name FROM t),
    d AS MATERIALIZED (SELECT name, dim, tf / sqrt(sum(tf * tf) OVER (PARTITION BY name)) AS x FROM (SELECT name, ('0x' || substr(md5(w), 1, 8))::BIGINT % 512 AS dim, count(*)::DOUBLE AS tf FROM (SELECT name, unnest(string_split(name, ' ')) AS w FROM e) WHERE w <> '' GROUP BY ALL)),
    s AS (SELECT a.name AS a, b.name AS b, sum(a.x * b.x) AS score FROM d a JOIN d b USING (dim) WHERE a.name <> b.name GROUP BY ALL HAVING sum(a.x * b.x) >= 0.9),
    r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(score, 5) DESC, {ENTITY.format('b')}) AS rank, score FROM s WHERE length(regexp_replace(a, '[^A-Za-z0-9]', '', 'g')) > 2)
    SELECT {ENTITY.format('a')} AS src, {ENTITY.format('b')} AS dst, round(score, 4) AS weight FROM r WHERE rank <= 101""")
def engine_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synonym edges that an engine makes of entity names with a cosine of 0.9 and more, in two indexes: old and new names meet in both directions."""
    engine, rows = GraphRag(spark, shared_dir(spark, "synonyms"), vector_dims=512, synonymy_edge_sim_threshold=0.9), passages(spark, sf_dir).select("content")
    engine.index(rows.where(F.pmod(F.xxhash64("content"), F.lit(3)) > 0))
    engine.index(rows)
    return engine.edges().where("kind = 'synonym'").select("src", "dst", F.round("weight", 4).alias("weight"))


@query(f"WITH {_SIM} SELECT query_id, key_id, round(score, 6) AS score FROM pairs WHERE score >= 0.3")
def knn_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs with a cosine of 0.3 and more, by cells around pivots and the triangle inequality."""
    v = _vectors(spark, sf_dir)
    return knn.near(v, v, 1 << 30, 0.3).select("query_id", "key_id", F.round("score", 6).alias("score"))


_NUMBERED = _SECTIONS.replace("'# ' || source", "'# 1 ' || source").replace("'## ' || lang", "'## 1.1 ' || lang").replace("'## table  '", "'## 1.2 table  '")


@query(f"WITH {_NUMBERED} SELECT s.doc_id, s.depth, s.content, CASE WHEN s.depth > 1 THEN t.content END AS parent FROM sections s JOIN sections t ON s.doc_id = t.doc_id AND t.depth = 1")
def structure_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections nested as JSON below their headings, written as text and taken apart again: each with the text of the one that it stands in."""
    path = shared_dir(spark, "tree")
    files.structure_json(markdown.structure(docs(spark, sf_dir), 0)).write.parquet(path)
    parts = files.structure_of(spark.read.parquet(path))
    chunks = parts["doc_chunks"]
    above = chunks.select("doc_id", F.col("chunk_id").alias("parent_id"), F.col("content").alias("parent"))
    number = F.regexp_extract("file_path", r"doc(\d+)\.md", 1).cast("long")
    rows = chunks.join(above, ["doc_id", "parent_id"], "left").join(parts["files"].select(F.col("file_id").alias("doc_id"), number.alias("number")), "doc_id")
    return rows.select(F.col("number").alias("doc_id"), F.col("depth").cast("int").alias("depth"), "content", "parent")
