"""The graph of entities and passages: vertices (id, kind, content) and edges (src, dst, weight, kind)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import content_id, fact_text, packed, unpacked


def facts(chunk_triples: DataFrame) -> DataFrame:
    """Distinct facts (fact_id, content, s, p, o) of chunk_triples (chunk_id, s, p, o)."""
    text = fact_text(F.col("s"), F.col("p"), F.col("o"))
    return chunk_triples.select("s", "p", "o").distinct().select(content_id(text, "fact-").alias("fact_id"), text.alias("content"), "s", "p", "o")


def entities(chunk_triples: DataFrame) -> DataFrame:
    """Distinct subjects and objects (entity_id, content)."""
    names = chunk_triples.select(F.explode(F.array("s", "o")).alias("content")).distinct()
    return names.select(content_id(F.col("content"), "entity-").alias("entity_id"), "content")


def mentions(chunk_triples: DataFrame) -> DataFrame:
    """Distinct (entity_id, chunk_id)."""
    each = chunk_triples.select(packed(F.col("chunk_id")).alias("_c"), F.explode(F.array_distinct(F.array("s", "o"))).alias("content")).distinct()
    return each.select(content_id(F.col("content"), "entity-").alias("entity_id"), unpacked(F.col("_c")).alias("chunk_id"))


def fact_docs(chunk_triples: DataFrame) -> DataFrame:
    """Distinct (fact_id, chunk_id)."""
    return chunk_triples.select(content_id(fact_text(F.col("s"), F.col("p"), F.col("o")), "fact-").alias("fact_id"), "chunk_id").distinct()


def _ordered(rows: DataFrame, a: Column, b: Column, weight: Column) -> DataFrame:
    """(_a, _b, weight): the weights of rows by the pair of their ends in either order, which is both directions' weight less that of a loop, whose directions are one."""
    turned = F.coalesce(a > b, b.isNull())
    return rows.select(F.when(turned, b).otherwise(a).alias("_a"), F.when(turned, a).otherwise(b).alias("_b"), weight.alias("weight")).groupBy("_a", "_b").agg(F.sum("weight").alias("weight"))


def _both_ways(pairs: DataFrame, named: Callable[[Column], Column]) -> DataFrame:
    """(src, dst, weight) in both directions of ordered pairs, whose ends are named now: neither names nor second directions are shuffled."""
    ends = pairs.select(named(F.col("_a")).alias("a"), named(F.col("_b")).alias("b"), "weight")
    one = lambda a, b, w: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), w.alias("weight"))
    w = F.col("weight")
    return ends.select(F.inline(F.when(F.col("a").eqNullSafe(F.col("b")), F.array(one("a", "b", w * 2))).otherwise(F.array(one("a", "b", w), one("b", "a", w)))))


def fact_edges(chunk_triples: DataFrame) -> DataFrame:
    """One for each triple of each chunk, in both directions, counted."""
    pairs = _ordered(chunk_triples, F.col("s"), F.col("o"), F.lit(1.0))
    return _both_ways(pairs, lambda c: content_id(c, "entity-")).withColumn("kind", F.lit("fact"))


def passage_edges(chunk_triples: DataFrame) -> DataFrame:
    """From each chunk to each entity in it, weight 1."""
    return mentions(chunk_triples).select(F.col("chunk_id").alias("src"), F.col("entity_id").alias("dst"), F.lit(1.0).alias("weight"), F.lit("passage").alias("kind"))


def synonym_edges(neighbours: DataFrame, names: DataFrame, threshold: float, most: int) -> DataFrame:
    """neighbours: query_id, key_id, score. names: entity_id, content. The ``most`` best at or over the threshold of each entity whose name has over two ASCII letters or digits."""
    from quillgraph.operators.topk import top_k

    asks = names.where(F.length(F.regexp_replace("content", "[^A-Za-z0-9]", "")) > 2).select(F.col("entity_id").alias("query_id"))
    named = names.where("content <> ''").select(F.col("entity_id").alias("key_id"))
    near = neighbours.where((F.col("score") >= threshold) & (F.col("query_id") != F.col("key_id"))).join(asks, "query_id", "left_semi").join(named, "key_id", "left_semi")
    best = top_k(near, most, ["query_id"], "score", "key_id")
    return best.select(F.col("query_id").alias("src"), F.col("key_id").alias("dst"), F.col("score").cast("double").alias("weight"), F.lit("synonym").alias("kind"))


def merge_edges(fact: DataFrame, passage: DataFrame, synonym: DataFrame | None = None) -> DataFrame:
    """All edges; a synonym's score replaces the count of the same ordered pair."""
    if synonym is None:
        return fact.unionByName(passage)
    rest = fact.join(synonym.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "weight", F.lit("fact").alias("kind"))
    return rest.unionByName(synonym).unionByName(passage)


def valid_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Without loops and edges that lack an end."""
    ids = vertices.select("id")
    return edges.where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def vertices(entity: DataFrame, chunk: DataFrame) -> DataFrame:
    """Entities and chunks (chunk_id, content) as vertices; of an id in both, the chunk."""
    v = entity.select(F.col("entity_id").alias("id"), F.lit("entity").alias("kind"), "content").unionByName(chunk.select(F.col("chunk_id").alias("id"), F.lit("passage").alias("kind"), "content"))
    each = v.groupBy(packed(F.col("id")).alias("_id")).agg(F.max_by(F.struct("kind", "content"), "kind").alias("v"))
    return each.select(unpacked(F.col("_id")).alias("id"), "v.kind", "v.content")


def new_vertices(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Vertices that the stored ones lack, with all their columns."""
    return rows.join(stored.select("id"), "id", "left_anti").select(*rows.columns)


def loose_ends(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(src, dst, missing) of edges of which an end is no vertex: what valid_edges leaves out besides loops."""
    ids = vertices.select("id")
    ends = edges.select("src", "dst", F.explode(F.array_distinct(F.array("src", "dst"))).alias("missing"))
    return ends.join(ids.withColumnRenamed("id", "missing"), "missing", "left_anti").select("src", "dst", "missing")


def edges_of(chunk_triples: DataFrame, synonym: DataFrame | None = None) -> DataFrame:
    """Fact, passage and synonym edges without loops. Their ends are vertices, since the same triples make both."""
    return merge_edges(fact_edges(chunk_triples), passage_edges(chunk_triples), synonym).where("src <> dst")


def edge_deltas(chunk_triples: DataFrame, sign: int = 1) -> DataFrame:
    """What these triples add to the weights of fact and passage edges, or take from them."""
    both = fact_edges(chunk_triples).unionByName(passage_edges(chunk_triples)).where("src <> dst")
    return both.select("src", "dst", (F.col("weight") * sign).alias("weight"), "kind")


def summed(deltas: DataFrame) -> DataFrame:
    """The edges that deltas leave; weights are counts, so what sums up to nothing is gone."""
    return deltas.groupBy("src", "dst", "kind").agg(F.sum("weight").alias("weight")).where("weight > 0.5").select("src", "dst", "weight", "kind")


def with_synonyms(edges: DataFrame, synonym: DataFrame) -> DataFrame:
    """Fact and passage edges with synonym edges: a synonym's score replaces the count of the same ordered pair."""
    return merge_edges(edges.where("kind = 'fact'"), edges.where("kind = 'passage'"), synonym).where("src <> dst")


def delete_vertices(v: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges without those of ids, and without edges that end in one."""
    gone = ids.select(packed(F.col("id")).alias("_id")).distinct()
    less = lambda rows, end: rows.withColumn(end, packed(F.col(end))).join(gone.withColumnRenamed("_id", end), end, "left_anti")
    rest = less(less(edges, "src"), "dst").withColumns({end: unpacked(F.col(end)) for end in ("src", "dst")})
    return less(v, "id").withColumn("id", unpacked(F.col("id"))).select(*v.columns), rest.select(*edges.columns)


def arcs(edges: DataFrame, directed: bool = False) -> DataFrame:
    """(src, dst, weight) with parallel edges summed; both directions unless directed."""
    src, dst = packed(F.col("src")), packed(F.col("dst"))
    if not directed:
        return _both_ways(_ordered(edges, src, dst, F.col("weight")), unpacked)
    summed = edges.groupBy(src.alias("_a"), dst.alias("_b")).agg(F.sum("weight").alias("weight"))
    return summed.select(unpacked(F.col("_a")).alias("src"), unpacked(F.col("_b")).alias("dst"), "weight")


def graph_info(v: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of seven counts."""
    nodes = v.agg(F.count(F.when(F.col("kind") == "entity", 1)).alias("num_phrase_nodes"), F.count(F.when(F.col("kind") == "passage", 1)).alias("num_passage_nodes"), F.count("*").alias("num_total_nodes"))
    links = edges.agg(F.count(F.when(F.col("kind") == "fact", 1)).alias("num_extracted_triples"), F.count(F.when(F.col("kind") == "passage", 1)).alias("num_triples_with_passage_node"), F.count(F.when(F.col("kind") == "synonym", 1)).alias("num_synonymy_triples"), F.count("*").alias("num_total_triples"))
    return nodes.crossJoin(links)  # one row each


def _only_gone(chunk_triples: DataFrame, gone: DataFrame, what: Column) -> DataFrame:
    """The different values of what (an array for each triple) that only chunks of gone hold, as ``_what``."""
    flag = gone.select(packed(F.col("chunk_id")).alias("_c")).distinct().withColumn("_gone", F.lit(1))
    rows = chunk_triples.select(packed(F.col("chunk_id")).alias("_c"), what.alias("_what")).join(flag, "_c", "left")
    each = rows.select(F.explode("_what").alias("_what"), F.coalesce("_gone", F.lit(0)).alias("_gone"))
    return each.groupBy("_what").agg(F.min("_gone").alias("_gone")).where("_gone = 1").select("_what")


def deleted_facts(chunk_triples: DataFrame, gone: DataFrame) -> DataFrame:
    """fact_id of facts that only chunks of gone (chunk_id) hold."""
    ids = _only_gone(chunk_triples, gone, F.array(F.unhex(F.md5(fact_text(F.col("s"), F.col("p"), F.col("o"))))))
    return ids.select(F.concat(F.lit("fact-"), F.lower(F.hex("_what"))).alias("fact_id"))


def deleted_entities(chunk_triples: DataFrame, gone: DataFrame) -> DataFrame:
    """entity_id of entities of deleted facts that no chunk outside gone mentions. All facts of an entity that only gone chunks mention are deleted."""
    return _only_gone(chunk_triples, gone, F.array("s", "o")).select(content_id(F.col("_what"), "entity-").alias("entity_id"))


def audit(v: DataFrame, entity: DataFrame, chunk: DataFrame, openie: DataFrame) -> DataFrame:
    """(what, id) of what the stores hold but the graph or the extraction results lack."""
    ids = v.select("id")
    return (
        entity.select(F.lit("entity without vertex").alias("what"), F.col("entity_id").alias("id")).join(ids, "id", "left_anti").select("what", "id")
        .unionByName(chunk.select(F.lit("passage without vertex").alias("what"), F.col("chunk_id").alias("id")).join(ids, "id", "left_anti").select("what", "id"))
        .unionByName(chunk.select(F.lit("passage without extraction").alias("what"), F.col("chunk_id").alias("id")).join(openie.select(F.col("chunk_id").alias("id")), "id", "left_anti").select("what", "id"))
    )


def repaired_extractions(chunk: DataFrame, openie: DataFrame) -> DataFrame:
    """Every chunk's entities and triples; empty lists where extraction has none."""
    got = chunk.select("chunk_id").join(openie, "chunk_id", "left")
    return got.select("chunk_id", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), F.coalesce("triples", F.array().cast("array<array<string>>")).alias("triples"))
