"""Queries that build, audit and prune the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.config import Config
from quillgraph.functions.text import packed, unpacked
from quillgraph.operators import graph
from quillgraph.operators.knn import knn
from quillgraph.plans.registry import query
from quillgraph.plans.tables import ENTITY, FACT, RELATIONS, TRIPLES, passages, relations, table, triples
from quillgraph.sources.shared import once

_E = ENTITY.format
_EDGES = f"""fact_edges AS (SELECT src, dst, count(*)::DOUBLE AS weight, 'fact' AS kind FROM (SELECT {_E('s')} AS src, {_E('o')} AS dst FROM triples UNION ALL SELECT {_E('o')}, {_E('s')} FROM triples) GROUP BY src, dst),
    mentions AS (SELECT DISTINCT entity_id, chunk_id FROM (SELECT {_E('s')} AS entity_id, chunk_id FROM triples UNION ALL SELECT {_E('o')}, chunk_id FROM triples)),
    passage_edges AS (SELECT chunk_id AS src, entity_id AS dst, 1.0::DOUBLE AS weight, 'passage' AS kind FROM mentions),
    edges AS (SELECT * FROM (SELECT * FROM fact_edges UNION ALL SELECT * FROM passage_edges) WHERE src <> dst)"""
GRAPH = TRIPLES + ", " + _EDGES


@query(f"WITH {TRIPLES} SELECT DISTINCT {_E('content')} AS entity_id, content FROM (SELECT s AS content FROM triples UNION ALL SELECT o FROM triples)")
def entities_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entities(triples(spark, sf_dir))


@query(f"WITH {GRAPH} SELECT entity_id, count(*) AS n_chunks, min(chunk_id) AS first_chunk FROM mentions GROUP BY entity_id")
def entity_chunk_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mentions(triples(spark, sf_dir)).groupBy("entity_id").agg(F.count("*").alias("n_chunks"), F.min("chunk_id").alias("first_chunk"))


@query(f"WITH {TRIPLES} SELECT fact_id, count(*) AS n_chunks, min(chunk_id) AS first_chunk FROM (SELECT DISTINCT 'fact-' || md5({FACT}) AS fact_id, chunk_id FROM triples) GROUP BY fact_id")
def fact_doc_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fact_docs(triples(spark, sf_dir)).groupBy("fact_id").agg(F.count("*").alias("n_chunks"), F.min("chunk_id").alias("first_chunk"))


@query(f"WITH {GRAPH} SELECT * FROM fact_edges")
def fact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fact_edges(triples(spark, sf_dir))


@query(f"WITH {GRAPH} SELECT * FROM passage_edges")
def passage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.passage_edges(triples(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str, t: DataFrame | None = None) -> DataFrame:
    """The graph's edges, from triples that have been read already if they are given."""
    return graph.edges_of(triples(spark, sf_dir) if t is None else t)


@query(f"WITH {GRAPH} SELECT * FROM edges")
def graph_edges_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges checked against the vertices, with one that has no vertex added to each passage, and left out again."""
    t = triples(spark, sf_dir)
    v = graph.vertices(graph.entities(t), passages(spark, sf_dir))
    every = graph.merge_edges(graph.fact_edges(t), graph.passage_edges(t))
    loose = t.select(F.col("chunk_id").alias("src"), F.lit("entity-none").alias("dst"), F.lit(1.0).alias("weight"), F.lit("passage").alias("kind"))
    return graph.valid_edges(every.unionByName(loose), v)


@query(f"WITH {GRAPH} SELECT DISTINCT chunk_id AS src, 'entity-none' AS dst, 'entity-none' AS missing FROM triples")
def graph_loose_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir)
    v = graph.vertices(graph.entities(t), passages(spark, sf_dir))
    loose = t.select(F.col("chunk_id").alias("src"), F.lit("entity-none").alias("dst")).distinct()
    return graph.loose_ends(graph.passage_edges(t).select("src", "dst").unionByName(loose), v)


@query(f"WITH {GRAPH} SELECT DISTINCT {_E('content')} AS id, 'entity' AS kind, content FROM (SELECT s AS content FROM triples UNION ALL SELECT o FROM triples) WHERE {_E('content')} NOT IN (SELECT {_E('s')} FROM triples)")
def new_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that are only objects, where those that are subjects are stored."""
    t = triples(spark, sf_dir)
    names = graph.entities(t).select(F.col("entity_id").alias("id"), F.lit("entity").alias("kind"), "content")
    stored = graph.entities(t.withColumn("o", F.col("s"))).select(F.col("entity_id").alias("id"))
    return graph.new_vertices(names, stored)


@query(f"WITH {GRAPH} SELECT chunk_id, CAST(count(t) AS BIGINT) AS n_triples FROM (SELECT p.chunk_id, t.s AS t FROM passages p LEFT JOIN triples t USING (chunk_id)) GROUP BY chunk_id")
def graph_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages without results get empty ones."""
    t = triples(spark, sf_dir).groupBy("chunk_id").agg(F.collect_list(F.array("s", "p", "o")).alias("triples"), F.collect_list("s").alias("entities"))
    return graph.repaired_extractions(passages(spark, sf_dir), t).select("chunk_id", F.size("triples").cast("long").alias("n_triples"))


@query(f"WITH {GRAPH} SELECT src, dst, sum(weight) AS weight FROM (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges) GROUP BY src, dst")
def graph_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.arcs(edges(spark, sf_dir))


@query(f"""WITH {GRAPH}, e AS (SELECT DISTINCT entity_id FROM mentions), n AS (SELECT (SELECT count(*) FROM e) AS a, (SELECT count(*) FROM passages) AS b)
    SELECT a AS num_phrase_nodes, b AS num_passage_nodes, a + b AS num_total_nodes, (SELECT count(*) FROM edges WHERE kind = 'fact') AS num_extracted_triples,
           (SELECT count(*) FROM edges WHERE kind = 'passage') AS num_triples_with_passage_node, 0::BIGINT AS num_synonymy_triples, (SELECT count(*) FROM edges) AS num_total_triples FROM n""")
def graph_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir)
    v = graph.vertices(graph.entities(t), passages(spark, sf_dir))
    return graph.graph_info(v, edges(spark, sf_dir, t))


@query(f"""WITH {RELATIONS} SELECT src, dst, count(*)::DOUBLE AS weight, 'fact' AS kind FROM (SELECT {_E('s')} AS src, {_E('o')} AS dst FROM relations UNION ALL SELECT {_E('o')}, {_E('s')} FROM relations) GROUP BY src, dst""")
def relation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fact_edges(relations(spark, sf_dir))


# vectors: every vector is an entity of the name vec and its number

_SIM = "pairs AS (SELECT q.vec_id AS query_id, k.vec_id AS key_id, list_cosine_similarity(q.embedding::DOUBLE[], k.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings k)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query(f"WITH {_SIM}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key_id) AS rank FROM pairs WHERE score >= 0.3) SELECT query_id, key_id, round(score, 6) AS score FROM n WHERE rank <= 2047 AND query_id <> key_id")
def knn_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of each vector with a cosine of 0.3 and more, as many as the engine looks at."""
    v = _vectors(spark, sf_dir)
    near = knn(v, v, Config().synonymy_edge_topk, least=0.3)
    return near.where("query_id <> key_id").select("query_id", "key_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_SIM}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key_id) AS rank FROM pairs WHERE score >= 0.3 AND query_id <> key_id)
    SELECT 'vec' || query_id AS src, 'vec' || key_id AS dst, round(score, 6) AS weight, 'synonym' AS kind FROM n WHERE rank <= 101 AND query_id >= 0""")
def synonym_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    near = knn(v, v, 2047, least=0.3).where("rank <= 102")  # the 101 that stay, and the vector itself; no other row is left out before they are ranked again
    # over a hundred numbers of two digits and more pass the rule that names have three letters or digits
    names = v.select(F.col("id").alias("entity_id"), F.concat(F.lit("vec"), F.col("id").cast("string")).alias("content"))
    got = graph.synonym_edges(near.drop("rank"), names, 0.3, 101)
    return got.select(F.concat(F.lit("vec"), F.col("src").cast("string")).alias("src"), F.concat(F.lit("vec"), F.col("dst").cast("string")).alias("dst"), F.round("weight", 6).alias("weight"), "kind")


# a delete takes the passages of documents in German

_GONE = "gone AS (SELECT chunk_id FROM (SELECT chunk_id, lang FROM paragraphs JOIN documents USING (doc_id)) GROUP BY chunk_id HAVING count(*) = count(*) FILTER (lang = 'de'))"


def _gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.plans.tables import paragraphs

    rows = paragraphs(spark, sf_dir).select("doc_id", packed(F.col("chunk_id")).alias("c")).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    all_de = rows.groupBy("c").agg(F.min(F.coalesce(F.col("lang") == "de", F.lit(False)).cast("int")).alias("all")).where("all = 1")
    return once(all_de.select(unpacked(F.col("c")).alias("chunk_id")), "gone")


_DEL = f"""f AS (SELECT DISTINCT 'fact-' || md5({FACT}) AS fact_id, s, o, chunk_id FROM triples),
    df AS (SELECT DISTINCT fact_id, s, o FROM f WHERE chunk_id IN (SELECT chunk_id FROM gone) AND fact_id NOT IN (SELECT fact_id FROM f WHERE chunk_id NOT IN (SELECT chunk_id FROM gone))),
    de AS (SELECT DISTINCT {_E('content')} AS entity_id FROM (SELECT s AS content FROM df UNION ALL SELECT o FROM df) WHERE {_E('content')} NOT IN (SELECT entity_id FROM mentions WHERE chunk_id NOT IN (SELECT chunk_id FROM gone)))"""


@query(f"WITH {GRAPH}, {_GONE}, {_DEL} SELECT DISTINCT fact_id FROM df")
def delete_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.deleted_facts(triples(spark, sf_dir), _gone(spark, sf_dir))


@query(f"WITH {GRAPH}, {_GONE}, {_DEL} SELECT entity_id FROM de")
def delete_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.deleted_entities(triples(spark, sf_dir), _gone(spark, sf_dir))


@query(f"WITH {GRAPH}, {_GONE}, {_DEL}, x AS (SELECT entity_id AS id FROM de UNION ALL SELECT chunk_id FROM gone) SELECT src, dst, weight, kind FROM edges WHERE src NOT IN (SELECT id FROM x) AND dst NOT IN (SELECT id FROM x)")
def delete_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, gone = triples(spark, sf_dir), _gone(spark, sf_dir)
    v = graph.vertices(graph.entities(t), passages(spark, sf_dir))
    ids = graph.deleted_entities(t, gone).select(F.col("entity_id").alias("id")).unionByName(gone.select(F.col("chunk_id").alias("id")))
    return graph.delete_vertices(v, edges(spark, sf_dir, t), ids)[1]


@query(f"WITH {GRAPH} SELECT 'passage without extraction' AS what, chunk_id AS id FROM passages WHERE chunk_id NOT IN (SELECT chunk_id FROM triples)")
def graph_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, c = triples(spark, sf_dir), passages(spark, sf_dir)
    e = graph.entities(t)
    return graph.audit(graph.vertices(e, c), e, c, t.select("chunk_id").distinct())
