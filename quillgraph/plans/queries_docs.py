"""Queries on Markdown structure, enrichment tasks and the stream.

The driver's texts hold no Markdown, so each document gets headings from its source and language, links, a fence and a table whose
sizes follow from its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import enrich, markdown
from quillgraph.plans.registry import query
from quillgraph.plans.tables import PASSAGES, passages, table
from quillgraph.sources.shared import shared_dir


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, content)."""
    i = F.col("doc_id")
    code = F.array_join(F.transform(F.sequence(F.lit(1), (i % 8 + 1).cast("int")), lambda k: F.concat(F.lit("x = "), k.cast("string"))), "\n")
    rows = F.array_join(F.transform(F.sequence(F.lit(1), (i % 7 + 1).cast("int")), lambda k: F.concat(F.lit("| "), k.cast("string"), F.lit(" | y |"))), "\n")
    body = F.concat(F.lit("# "), F.col("source"), F.lit("\nSee [next](doc"), (i + 1).cast("string"), F.lit(".md) and [site](https://example.org/a).\n## "), F.col("lang"), F.lit("\n"), F.replace("text", F.lit("|"), F.lit("/")), F.lit("\n\n```python\n"), code, F.lit("\n```\n## table\n| a | b |\n"), rows)
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("docs/doc"), i.cast("string"), F.lit(".md")).alias("path"), body.alias("content"))


_DOCS = """docs AS (SELECT doc_id, source, lang, 'See [next](doc' || (doc_id + 1) || '.md) and [site](https://example.org/a).' AS see, replace(text, '|', '/') AS body,
    array_to_string([('x = ' || k) FOR k IN range(1, doc_id % 8 + 2)], chr(10)) AS code, '| a | b |' || chr(10) || array_to_string([('| ' || k || ' | y |') FOR k IN range(1, doc_id % 7 + 2)], chr(10)) AS tab FROM documents)"""


@query(f"WITH {_DOCS} SELECT doc_id, '# 1 ' || source || chr(10) || see || chr(10) || '## 1.1 ' || lang || chr(10) || body || chr(10) || chr(10) || '```python' || chr(10) || code || chr(10) || '```' || chr(10) || '## 1.2 table' || chr(10) || tab AS content FROM docs")
def md_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.number_headings(docs(spark, sf_dir))


@query(f"WITH {_DOCS} SELECT doc_id, '# 1. ' || source || chr(10) || see || chr(10) || '## 1.1. ' || lang || chr(10) || body || chr(10) || chr(10) || '```python' || chr(10) || code || chr(10) || '```' || chr(10) || '## 1.2. table' || chr(10) || tab AS content FROM docs")
def md_headings_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.number_headings(docs(spark, sf_dir), 2)


#: The lines of the section with the text, without white space at their ends; what parts two depends on empty lines between.
_WHITE = r"[\s\x0B\x{85}\p{Z}]"
_SECTIONS = rf"""{_DOCS}, l AS (SELECT doc_id, idx, regexp_replace(line, '^{_WHITE}+|{_WHITE}+$', '', 'g') AS line FROM (SELECT doc_id, unnest(string_split(body || chr(10) || chr(10) || '```python' || chr(10) || code || chr(10) || '```', chr(10))) AS line, generate_subscripts(string_split(body || chr(10) || chr(10) || '```python' || chr(10) || code || chr(10) || '```', chr(10)), 1) AS idx FROM docs)),
    k AS (SELECT doc_id, idx, line, count(*) FILTER (line = '') OVER (PARTITION BY doc_id ORDER BY idx) AS gaps FROM l),
    j AS (SELECT doc_id, idx, line, gaps, lag(gaps) OVER (PARTITION BY doc_id ORDER BY idx) AS before FROM k WHERE line <> ''),
    b AS (SELECT doc_id, string_agg(CASE WHEN before IS NULL THEN '' WHEN before = gaps THEN chr(10) ELSE '  ' || chr(10) END || line, '' ORDER BY idx) AS text FROM j GROUP BY doc_id),
    sections AS (SELECT doc_id, 1 AS depth, '# ' || source || '  ' || chr(10) || see AS content FROM docs
        UNION ALL SELECT doc_id, 2, '# ' || source || '  ' || chr(10) || '## ' || lang || '  ' || chr(10) || text FROM docs JOIN b USING (doc_id)
        UNION ALL SELECT doc_id, 2, '# ' || source || '  ' || chr(10) || '## table  ' || chr(10) || tab FROM docs)"""


@query(f"WITH {_SECTIONS} SELECT doc_id, depth, content FROM sections")
def md_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sections: of the top heading, of the text, of the table."""
    return markdown.sections(docs(spark, sf_dir)).select("doc_id", F.col("depth").cast("int").alias("depth"), "content")


@query(f"WITH {_SECTIONS} SELECT s.doc_id, 'chunk-' || md5(s.content) AS chunk_id, CASE WHEN s.depth > 1 THEN 'chunk-' || md5(t.content) END AS parent_id FROM sections s JOIN sections t ON s.doc_id = t.doc_id AND t.depth = 1")
def md_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.parents(markdown.sections(docs(spark, sf_dir))).select("doc_id", "chunk_id", "parent_id")


@query(f"WITH {_DOCS} SELECT doc_id, 'code-' || md5(c) AS id, c AS content FROM (SELECT doc_id, '```python' || chr(10) || code || chr(10) || '```' AS c FROM docs WHERE doc_id % 8 + 1 >= 5)")
def md_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.code_blocks(markdown.lines(docs(spark, sf_dir)), 0)[0]


@query(f"WITH {_DOCS} SELECT doc_id, 'code-' || md5(c) AS id, c AS content FROM (SELECT doc_id, '```python' || chr(10) || code || chr(10) || '```' AS c FROM docs)")
def md_code_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.plain_code(docs(spark, sf_dir))


@query(f"WITH {_DOCS} SELECT doc_id, 'table-' || md5(tab) AS id, tab AS content FROM docs WHERE doc_id % 7 + 2 >= 5")
def md_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.tables(markdown.lines(docs(spark, sf_dir)), 0)[0]


@query("""WITH t AS (SELECT doc_id, '<table>' || chr(10) || array_to_string([('<tr><td>' || k || ' | y</td></tr>') FOR k IN range(1, doc_id % 7 + 2)], chr(10)) || chr(10) || '</table>' AS tab FROM documents)
    SELECT doc_id, 'table-' || md5(tab) AS id, tab AS content FROM t WHERE doc_id % 7 + 3 >= 5""")
def md_html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML tables, whose rows hold bars, behind the texts."""
    rows = F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 7 + 1).cast("int")), lambda k: F.concat(F.lit("<tr><td>"), k.cast("string"), F.lit(" | y</td></tr>")))
    content = F.concat_ws("\n", F.replace("text", F.lit("|"), F.lit("/")), F.lit("<table>"), F.array_join(rows, "\n"), F.lit("</table>"))
    return markdown.tables(markdown.lines(table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))), 0)[0]


@query(f"WITH {_DOCS} SELECT doc_id, 'table-' || md5(tab) AS id, tab AS content FROM docs")
def md_tables_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.plain_tables(docs(spark, sf_dir))


@query(f"WITH {_DOCS}, f AS (SELECT doc_id, '# ' || source || chr(10) || see || chr(10) || '## ' || lang || chr(10) || body || chr(10) || chr(10) || '```python' || chr(10) || code || chr(10) || '```' || chr(10) || '## table' || chr(10) || tab AS content FROM docs) SELECT a.doc_id, 'file-' || md5(b.content) AS file_id, 'doc' || b.doc_id || '.md' AS file_path, 'next' AS jump_name FROM docs a JOIN f b ON b.doc_id = a.doc_id + 1")
def md_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return markdown.jumps(d, d)


@query("SELECT doc_id, 'file-' || md5('doc' || (doc_id + 1) || '.md') AS id, 'doc' || (doc_id + 1) || '.md' AS file_path FROM documents")
def md_links_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.plain_links(docs(spark, sf_dir))


@query("SELECT doc_id, level, count(*) AS n, max(parent) AS n_path FROM (SELECT doc_id, 1 AS level, 0 AS parent FROM documents UNION ALL SELECT doc_id, 2, 1 FROM documents UNION ALL SELECT doc_id, 2, 1 FROM documents) GROUP BY ALL")
def md_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = markdown.nested_sections(docs(spark, sf_dir))
    return got.groupBy("doc_id", "level").agg(F.count("*").alias("n"), F.max(F.size("path")).alias("n_path"))


@query("""SELECT 'chunks' AS kind, 3 * count(*) AS n FROM documents UNION ALL SELECT 'codes', count(*) FILTER (doc_id % 8 + 1 >= 5) FROM documents UNION ALL SELECT 'tables', count(*) FILTER (doc_id % 7 + 2 >= 5) FROM documents""")
def md_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.counts(markdown.structure(docs(spark, sf_dir), 0))


@query("SELECT 'file' AS type, count(*) AS tasks FROM documents UNION ALL SELECT 'chunk', 3 * count(*) FROM documents UNION ALL SELECT 'code', count(*) FILTER (doc_id % 8 + 1 >= 5) FROM documents UNION ALL SELECT 'table', count(*) FILTER (doc_id % 7 + 2 >= 5) FROM documents")
def abstract_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task for each row of each table, counted with their documents, since contents of code and tables repeat."""
    parts = markdown.structure(docs(spark, sf_dir), 0)
    for name, key in (("files", "file_id"), ("doc_chunks", "chunk_id"), ("codes", "code_id"), ("tables", "table_id")):
        parts[name] = parts[name].withColumn(key, F.concat_ws("/", F.col("doc_id").cast("string"), key))
    return enrich.estimate(enrich.abstract_tasks(parts)).select("type", "tasks")


@query("SELECT 3 * count(*) AS chunks, 0::BIGINT AS blank FROM documents")
def triple_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk has text beside code and tables, at least its headings, so each is a task."""
    chunks = markdown.structure(docs(spark, sf_dir), 0)["doc_chunks"]
    chunks = chunks.withColumn("filter_content", F.concat_ws("/", F.col("doc_id").cast("string"), "filter_content"))
    return enrich.triple_tasks(chunks).agg(F.count("*").alias("chunks"), F.count(F.when(F.trim("content") == "", 1)).alias("blank"))


@query(f"WITH {PASSAGES} SELECT chunk_id, content FROM passages")
def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that arrive as files, indexed by a stream that takes what there is and ends; the same as the batch."""
    from quillgraph.operators.store import missing
    from quillgraph.streaming.ingest import index_stream
    from quillgraph.streaming.ingest import passages as arriving

    root = shared_dir(spark, "stream")
    passages(spark, sf_dir).select("content").write.parquet(f"{root}/in")
    store = f"{root}/chunks"
    spark.createDataFrame([], "chunk_id string, content string").write.parquet(store)

    def index(batch: DataFrame) -> None:
        there = spark.read.schema("chunk_id string, content string").parquet(store).withColumnRenamed("chunk_id", "hash_id")
        missing(batch, there, "chunk-").withColumnRenamed("hash_id", "chunk_id").write.mode("append").parquet(store)

    index_stream(arriving(spark, f"{root}/in"), index, f"{root}/checkpoint").awaitTermination()
    return spark.read.schema("chunk_id string, content string").parquet(store)
