"""Readers and writers of corpora, questions, Markdown trees, extraction results and structure files."""

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.sources.shared import once
from quillgraph.sources.state import State


def corpus(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON list of {title, text, idx} as (idx, title, text, content): content is the title, a line feed, the text. lines: an object, or a list of them, on each line."""
    rows = spark.read.schema(schemas.CORPUS).json(path, multiLine=not lines)
    return rows.select("idx", "title", "text", passage(F.col("title"), F.col("text")).alias("content"))


def passage(title: Column, text: Column) -> Column:
    return F.concat_ws("\n", title, text)


def questions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(schemas.QUESTIONS).json(path, multiLine=not lines)


def gold_docs(rows: DataFrame, joiner: str = "") -> DataFrame:
    """rows with gold_docs: passages of supporting facts, of supporting contexts, or of supporting paragraphs, each once."""
    names = F.transform("supporting_facts", lambda f: f[0])
    by_fact = F.transform(F.filter("context", lambda c: F.array_contains(names, c["title"])), lambda c: F.concat(c["title"], F.lit("\n"), F.array_join(c["sentences"], joiner)))
    good = lambda xs: F.transform(F.filter(xs, lambda p: F.coalesce(p["is_supporting"], F.lit(True))), lambda p: F.concat(p["title"], F.lit("\n"), F.coalesce(p["text"], p["paragraph_text"])))
    found = F.when(F.col("supporting_facts").isNotNull(), by_fact).when(F.col("contexts").isNotNull(), good("contexts")).when(F.col("paragraphs").isNotNull(), good("paragraphs"))
    return rows.withColumn("gold_docs", F.array_distinct(found))


def gold_answers(rows: DataFrame) -> DataFrame:
    """rows with gold_answers: from answer, gold_ans or reference, or from obj and its other names; and answer_aliases."""
    objects = F.array_distinct(F.concat(F.array("obj"), *[F.coalesce(c, F.array().cast("array<string>")) for c in ("possible_answers", "o_aliases")], F.when(F.col("o_wiki_title").isNotNull(), F.array("o_wiki_title")).otherwise(F.array().cast("array<string>"))))
    first = F.coalesce(F.col("answer"), F.col("gold_ans"), F.col("reference"), F.when(F.col("obj").isNotNull(), objects))
    return rows.withColumn("gold_answers", F.array_distinct(F.concat(first, F.coalesce("answer_aliases", F.array().cast("array<string>")))))


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of a file or of all .md files below a folder. Bytes that are no UTF-8 are read as GBK."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").load(path)
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))

    @F.pandas_udf("string")
    def gbk(found: pd.Series) -> pd.Series:  # Spark's own decode() does not know this encoding
        return found.map(lambda b: b.decode("gbk", "replace"), na_action="ignore")

    return rows.select("path", utf8.alias("u"), F.when(utf8.isNull(), F.col("content")).alias("b")).select("path", F.coalesce("u", gbk("b")).alias("content"))


def markdown_file(spark: SparkSession, path: str) -> DataFrame:
    if not path.lower().endswith(".md"):
        raise ValueError(f"only Markdown files are read: {path}")
    return markdown(spark, path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_openie(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, passage, entities, triples) of a results file {docs: [...]}, or of a folder that write_openie wrote."""
    if _exists(spark, f"{path}/docs"):
        docs = spark.read.schema(schemas.OPENIE_DOC).json(f"{path}/docs").select(F.struct("*").alias("d"))
    else:
        docs = spark.read.schema(schemas.OPENIE).json(path, multiLine=True).select(F.explode("docs").alias("d"))
    return docs.select(F.col("d.idx").alias("chunk_id"), "d.passage", F.col("d.extracted_entities").alias("entities"), F.col("d.extracted_triples").alias("triples"))


def write_openie(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines under docs/ and the averages over entities under stats/."""
    from quillgraph.operators.openie import stats

    rows.select(F.col("chunk_id").alias("idx"), "passage", F.col("entities").alias("extracted_entities"), F.col("triples").alias("extracted_triples")).write.json(f"{path}/docs")
    stats(rows).write.json(f"{path}/stats")


def write_structure(parts: dict[str, DataFrame], path: str) -> None:
    """Each table of a document structure as JSON lines in a folder of its name."""
    for name, rows in parts.items():
        rows.write.json(f"{path}/{name}")


def read_structure(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that write_structure wrote. doc_id is text."""
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.STRUCTURE.items()}


def structure_json(parts: dict[str, DataFrame], levels: int = 6) -> DataFrame:
    """(file_id, json): each file with its chunks nested as deep as their headings, and in them their codes, tables and filtered text; objects go by their ids.

    Chunks are folded from the deepest level up: the texts of a level's chunks go to their parents, so each level is one join by parent, written once.
    """
    quoted = lambda key, body: F.concat(F.lit('"'), key, F.lit('":'), body)
    named = lambda name, inner: F.concat(F.lit(f',"{name}":{{'), F.coalesce(inner, F.lit("")), F.lit("}"))
    bare = lambda *columns: F.regexp_replace(F.to_json(F.struct(*columns)), r"\}$", "")  # noqa: E731  an object that goes on

    def inner(rows: DataFrame, by: list[str], order: str) -> DataFrame:
        """The objects (text) of each group, in order."""
        return rows.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), ",").alias("inner"))

    def leaves(name: str, key: str) -> DataFrame:
        rows = parts[name].select("doc_id", "chunk_id", F.col(key).alias("id"), quoted(F.col(key), F.to_json(F.struct("abstract", "content"))).alias("text")).dropDuplicates(["doc_id", "chunk_id", "id"])
        return inner(rows, ["doc_id", "chunk_id"], "id").withColumnRenamed("inner", name)

    filtered = F.struct(F.col("filter_content").alias("content"), "extracted_entities", "extracted_triples").alias("filter_chunk")
    rows = parts["doc_chunks"].join(leaves("codes", "code_id"), ["doc_id", "chunk_id"], "left").join(leaves("tables", "table_id"), ["doc_id", "chunk_id"], "left")
    text = F.concat(bare("abstract", "content", F.col("headers").alias("metadata"), filtered), named("codes", F.col("codes")), named("tables", F.col("tables")))
    rows = once(rows.select("doc_id", "chunk_id", "parent_id", "section", "depth", text.alias("text")), "chunks")
    done = None
    for depth in range(levels, -1, -1):
        here = rows.where(F.col("depth") == depth)
        if done is None:
            here = here.withColumn("inner", F.lit(None).cast("string"))
        else:
            below = inner(done.where("parent_id is not null"), ["doc_id", "parent_id"], "section").withColumnRenamed("parent_id", "chunk_id")
            here = here.join(below, ["doc_id", "chunk_id"], "left")
        whole = F.concat("text", F.when(F.col("inner").isNotNull(), named("chunks", F.col("inner"))).otherwise(""), F.lit("}"))
        level = once(here.select("doc_id", "parent_id", "section", quoted(F.col("chunk_id"), whole).alias("text")), "level")
        done = level if done is None else done.unionByName(level)
    top = inner(done.where("parent_id is null"), ["doc_id"], "section")
    file = F.concat(bare("abstract", "file_path", "content"), named("chunks", F.col("inner")), F.lit("}"))
    return parts["files"].join(top, "doc_id", "left").select("file_id", F.concat(F.lit("{"), quoted(F.col("file_id"), file), F.lit("}")).alias("json"))


_LEAVES = "map<string,struct<abstract:string,content:string>>"


def structure_of(rows: DataFrame, levels: int = 6) -> dict[str, DataFrame]:
    """The flat tables of nested files (file_id, json), as structure_json makes them; doc_id is the file's id. Chunks are taken out a level at a time."""
    kind = ""
    for _ in range(levels + 1):
        kind = f"struct<abstract:string,content:string,metadata:map<string,string>,filter_chunk:struct<content:string,extracted_entities:array<string>,extracted_triples:array<array<string>>>,codes:{_LEAVES},tables:{_LEAVES}{f',chunks:map<string,{kind}>' if kind else ''}>"
    files = rows.select("file_id", F.from_json("json", f"map<string,struct<abstract:string,file_path:string,content:string,chunks:map<string,{kind}>>>").alias("m")).select("file_id", F.map_values("m")[0].alias("f"))
    level = files.select(F.col("file_id").alias("doc_id"), F.lit(None).cast("string").alias("parent_id"), F.explode("f.chunks").alias("chunk_id", "c"))
    chunks = None
    for depth in range(levels + 1):
        flat = level.select("doc_id", "chunk_id", "parent_id", F.size("c.metadata").alias("depth"), F.col("c.metadata").alias("headers"), "c.abstract", "c.content", F.col("c.filter_chunk.content").alias("filter_content"), "c.filter_chunk.extracted_entities", "c.filter_chunk.extracted_triples", "c.codes", "c.tables")
        chunks = flat if chunks is None else chunks.unionByName(flat)
        if depth < levels:
            level = level.select("doc_id", F.col("chunk_id").alias("parent_id"), F.explode("c.chunks").alias("chunk_id", "c"))
    leaves = lambda name, key: chunks.select("doc_id", "chunk_id", F.explode(name).alias(key, "x")).select("doc_id", "chunk_id", key, "x.abstract", "x.content")
    out = files.select(F.col("file_id").alias("doc_id"), "file_id", "f.file_path", "f.abstract", "f.content")
    return {"files": out, "doc_chunks": chunks.drop("codes", "tables"), "codes": leaves("codes", "code_id"), "tables": leaves("tables", "table_id")}


def valid_structure(rows: DataFrame) -> bool:
    """Whether a row has a file id, content and a path."""
    need = {"file_id", "content", "file_path"}
    return need <= set(rows.columns) and bool(rows.where(F.startswith("file_id", F.lit("file-")) & F.col("content").isNotNull() & F.col("file_path").isNotNull()).limit(1).count())


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of a stored graph; empty tables if there is none."""
    state = State(spark, path)
    return state.read("vertices", schemas.VERTICES), state.read("edges", schemas.EDGES)


def write_graph(v: DataFrame, e: DataFrame, path: str) -> None:
    """Both tables at once, in the place of what was there."""
    State(v.sparkSession, path).change(replace={"vertices": v, "edges": e})
