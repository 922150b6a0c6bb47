"""The driver's tables in the roles of the engine's inputs, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import normalize
from quillgraph.functions.vectors import bag_of_words
from quillgraph.sources.shared import once

DIMS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content, chunk_id): lines of documents that are not blank."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("content")).where(F.trim("content") != "")
    return rows.withColumn("chunk_id", F.concat(F.lit("chunk-"), F.md5("content")))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, content), each once."""
    return paragraphs(spark, sf_dir).select("content").distinct().select(F.concat(F.lit("chunk-"), F.md5("content")).alias("chunk_id"), "content")


def sentences(rows: DataFrame) -> DataFrame:
    """rows (content) as a row per sentence with ``w``, its normalised words."""
    return rows.withColumn("_s", F.explode(F.split("content", "[.!?]+"))).withColumn("w", F.split(normalize(F.col("_s")), " ")).drop("_s", "content")


def spo(w: str | Column = "w") -> list[Column]:
    """The first word, the one in the middle, the last."""
    return [F.get(w, F.lit(0)), F.get(w, F.floor(F.size(w) / 2).cast("int")), F.get(w, F.size(w) - 1)]


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, s, p, o): of each sentence of three words and more the first word, the one in the middle and the last; each once for a passage.

    They are written, as the queries on the graph read them several times.
    """
    words = F.filter(F.transform(F.split("content", "[.!?]+"), lambda s: F.split(normalize(s), " ")), lambda w: F.size(w) >= 3)
    each = F.array_distinct(F.transform(words, lambda w: F.struct(*[c.alias(n) for c, n in zip(spo(w), "spo", strict=True)])))
    return once(passages(spark, sf_dir).select("chunk_id", F.inline(each)), "triples")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, s, p, o): facts of the relational tables, normalised; the table's name stands for the chunk."""
    t = lambda n: table(spark, sf_dir, n)
    rows = [
        t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("customer").alias("chunk_id"), F.col("c_name").alias("s"), F.lit("in nation").alias("p"), F.col("n_name").alias("o")),
        t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("supplier").alias("chunk_id"), F.col("s_name").alias("s"), F.lit("in nation").alias("p"), F.col("n_name").alias("o")),
        t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("nation").alias("chunk_id"), F.col("n_name").alias("s"), F.lit("in region").alias("p"), F.col("r_name").alias("o")),
        t("part").select(F.lit("part").alias("chunk_id"), F.col("p_name").alias("s"), F.lit("has brand").alias("p"), F.col("p_brand").alias("o")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("chunk_id", *[normalize(F.col(c)).alias(c) for c in "spo"]).distinct()


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, question): all benchmark items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def word_vectors(rows: DataFrame, key: str, text: str) -> DataFrame:
    return bag_of_words(rows.select(key, normalize(F.col(text)).alias("_t")), key, "_t", DIMS)


def norm_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def vectors_sql(rows: str, key: str, text: str) -> str:
    return f"""(SELECT {key}, dim, tf / sqrt(sum(tf * tf) OVER (PARTITION BY {key})) AS val FROM (
        SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % {DIMS} AS dim, count(*)::DOUBLE AS tf FROM (SELECT {key}, unnest(string_split({norm_sql(text)}, ' ')) AS w FROM {rows}) WHERE w <> '' GROUP BY ALL))"""


PARAGRAPHS = "paragraphs AS (SELECT doc_id, content, 'chunk-' || md5(content) AS chunk_id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content FROM documents) WHERE trim(content) <> '')"
PASSAGES = PARAGRAPHS + ", passages AS (SELECT DISTINCT chunk_id, content FROM paragraphs)"
SENTENCES = PASSAGES + f", sentences AS (SELECT chunk_id, string_split({norm_sql('s')}, ' ') AS w FROM (SELECT chunk_id, unnest(string_split_regex(content, '[.!?]+')) AS s FROM passages))"
TRIPLES = SENTENCES + ", triples AS (SELECT DISTINCT chunk_id, w[1] AS s, w[len(w) // 2 + 1] AS p, w[len(w)] AS o FROM sentences WHERE len(w) >= 3)"
RELATIONS = f"""relations AS (SELECT DISTINCT chunk_id, {norm_sql('s')} AS s, {norm_sql('p')} AS p, {norm_sql('o')} AS o FROM (
    SELECT 'customer' AS chunk_id, c_name AS s, 'in nation' AS p, n_name AS o FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'supplier', s_name, 'in nation', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT 'nation', n_name, 'in region', r_name FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'part', p_name, 'has brand', p_brand FROM part))"""
FACT = "'(''' || s || ''', ''' || p || ''', ''' || o || ''')'"
ENTITY = "'entity-' || md5({})"
