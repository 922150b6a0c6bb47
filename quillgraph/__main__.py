"""Command line: answer a dataset's questions, read Markdown into a structure, write abstracts, entities and triples into it."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.config import Config
from quillgraph.connectors import HttpChat, HttpEmbedder
from quillgraph.engine import DenseRag, GraphRag
from quillgraph.functions.text import to_bool
from quillgraph.operators import enrich, markdown, openie
from quillgraph.sources import files


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quillgraph", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def model(c: argparse.ArgumentParser) -> None:
        c.add_argument("--llm-name", default="replay")
        c.add_argument("--llm-url", help="of a service; without one, a stand-in model answers")
        c.add_argument("--llm-key", default="")
        c.add_argument("--api-version", default="", help="for services that want one")
        c.add_argument("--temperature", type=float, default=0.0)
        c.add_argument("--max-tokens", type=int, default=2048)

    for name, what in (("ask", "index a corpus, answer its questions, score the answers"), ("ask-dense", "the same by vectors alone")):
        c = sub.add_parser(name, help=what)
        c.add_argument("corpus", help="JSON list of title, text, idx")
        c.add_argument("questions", help="JSON list of question, answer and gold passages")
        c.add_argument("--save-dir", default="outputs")
        c.add_argument("--dataset", default="musique")
        c.add_argument("--embedding-name", default="")
        c.add_argument("--embedding-url")
        c.add_argument("--force-index-from-scratch", default="false")
        c.add_argument("--force-openie-from-scratch", default="false")
        model(c)
    c = sub.add_parser("markdown", help="structure of Markdown files")
    c.add_argument("input")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--context", type=int, default=15)
    for name in ("abstracts", "triples"):
        c = sub.add_parser(name, help=f"{name} for a structure")
        c.add_argument("input")
        c.add_argument("output")
        c.add_argument("--batch-size", type=int, default=200)
        c.add_argument("--dry-run", action="store_true", help="what a run would take")
        c.add_argument("--fallback-url", help="a second service, for what the first fails at")
        model(c)
    return p.parse_args(argv)


def _chat(a: argparse.Namespace, url: str | None) -> openie.Generator | None:
    return HttpChat(url, a.llm_name, a.llm_key, a.api_version, temperature=a.temperature, max_tokens=a.max_tokens) if url else None


def ask(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    flag = lambda v: spark.range(1).select(to_bool(F.lit(v))).first()[0]
    reader = _chat(a, a.llm_url)
    settings = Config(model=a.llm_name, temperature=a.temperature, force_index_from_scratch=flag(a.force_index_from_scratch), force_openie_from_scratch=flag(a.force_openie_from_scratch))
    embedder = HttpEmbedder(a.embedding_url, a.embedding_name, a.llm_key, a.api_version) if a.embedding_url else None
    engine = (DenseRag if a.command == "ask-dense" else GraphRag)(spark, a.save_dir, settings, generator=reader, reader=reader, embedder=embedder)
    engine.index(files.corpus(spark, a.corpus))
    q = files.gold_answers(files.gold_docs(files.questions(spark, a.questions))).withColumn("query_id", F.coalesce("id", F.md5("question")))
    gold = q.select("query_id", F.explode("gold_docs").alias("doc"))
    answers = q.select("query_id", F.explode("gold_answers").alias("gold"))
    return engine.rag_qa(q.select("query_id", "question"), gold, answers)


def structured(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    rows = files.markdown(spark, a.input)
    parts = markdown.structure(rows.withColumn("doc_id", F.md5("path")), a.context)
    files.write_structure(parts, a.output)
    return {"counts": markdown.counts(parts)}


def enriched(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    parts = files.read_structure(spark, a.input)
    if not files.valid_structure(parts["files"]):
        raise ValueError(f"{a.input} holds no structure of files")
    tasks = enrich.abstract_tasks(parts) if a.command == "abstracts" else enrich.triple_tasks(parts["doc_chunks"]).withColumn("type", F.lit("chunk"))
    if a.dry_run:
        return {"estimate": enrich.estimate(tasks, a.batch_size)}
    first, second = _chat(a, a.llm_url) or openie.Sentences(), _chat(a, a.fallback_url)
    if a.command == "abstracts":
        made = enrich.abstracts(tasks, first, second, batch=a.batch_size)
        files.write_structure(enrich.write_abstracts(parts, made), a.output)
        return {"processed": enrich.processed(made)}
    chunks = enrich.extract(parts["doc_chunks"], first, second, batch=a.batch_size)
    files.write_structure(parts | {"doc_chunks": chunks}, a.output)
    return {"statistics": openie.stats(chunks.withColumnRenamed("extracted_entities", "entities"))}


def main(argv: list[str]) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.appName("quillgraph").getOrCreate()
    found = {"ask": ask, "ask-dense": ask, "markdown": structured}.get(a.command, enriched)(spark, a)
    for name in ("counts", "estimate", "processed", "statistics", "recall", "scores"):
        if name in found:
            print(name)
            found[name].show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
