"""Explicit schemas of all stored tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNKS = T.StructType([T.StructField("hash_id", T.StringType()), T.StructField("content", T.StringType())])
VECTORS = T.StructType([*CHUNKS.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
QUERY_VECTORS = T.StructType([T.StructField("purpose", T.StringType()), T.StructField("question", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
VERTICES = T.StructType([T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("content", T.StringType())])
EDGES = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("kind", T.StringType())])
OPENIE_DOC = T.StructType([T.StructField("idx", T.StringType()), T.StructField("passage", T.StringType()), T.StructField("extracted_entities", T.ArrayType(T.StringType())), T.StructField("extracted_triples", T.ArrayType(T.ArrayType(T.StringType())))])
OPENIE = T.StructType([T.StructField("docs", T.ArrayType(OPENIE_DOC)), T.StructField("avg_ent_chars", T.DoubleType()), T.StructField("avg_ent_words", T.DoubleType())])
CORPUS = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("idx", T.LongType())])
PARAGRAPH = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("paragraph_text", T.StringType()), T.StructField("is_supporting", T.BooleanType()), T.StructField("idx", T.LongType())])
QUESTIONS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("question", T.StringType()),
    T.StructField("answer", T.ArrayType(T.StringType())), T.StructField("gold_ans", T.ArrayType(T.StringType())), T.StructField("reference", T.ArrayType(T.StringType())),
    T.StructField("obj", T.StringType()), T.StructField("possible_answers", T.ArrayType(T.StringType())), T.StructField("o_wiki_title", T.StringType()), T.StructField("o_aliases", T.ArrayType(T.StringType())),
    T.StructField("answer_aliases", T.ArrayType(T.StringType())), T.StructField("answerable", T.BooleanType()),
    T.StructField("paragraphs", T.ArrayType(PARAGRAPH)), T.StructField("contexts", T.ArrayType(PARAGRAPH)),
    T.StructField("supporting_facts", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("context", T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("sentences", T.ArrayType(T.StringType()))]))),
])
STRUCTURE = {
    "files": "doc_id string, file_id string, file_path string, abstract string, content string",
    "doc_chunks": "doc_id string, chunk_id string, parent_id string, section long, depth int, headers map<string,string>, abstract string, content string, filter_content string, extracted_entities array<string>, extracted_triples array<array<string>>",
    "codes": "doc_id string, chunk_id string, code_id string, abstract string, content string",
    "tables": "doc_id string, chunk_id string, table_id string, abstract string, content string",
}
EXTRACTED = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("passage", T.StringType()), T.StructField("entities", T.ArrayType(T.StringType())), T.StructField("triples", T.ArrayType(T.ArrayType(T.StringType())))])
TRIPLES = T.StructType([T.StructField(c, T.StringType()) for c in ("chunk_id", "s", "p", "o")])
NEIGHBOURS = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("key_id", T.StringType()), T.StructField("score", T.DoubleType())])
ALIKE = T.StructType([T.StructField("hash_id", T.StringType()), T.StructField("alike_id", T.StringType())])
ARCS = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("p", T.DoubleType()), T.StructField("degree", T.DoubleType())])
CACHE = T.StructType([T.StructField("key", T.StringType()), T.StructField("message", T.StringType()), T.StructField("metadata", T.StringType())])
