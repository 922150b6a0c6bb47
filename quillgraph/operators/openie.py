"""Extraction of entities and triples by pluggable models, their statistics, and the gate between two providers."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import json_repair
from quillgraph.functions.text import normalize
from quillgraph.operators.calls import BatchGenerator, Generator, ResponseCache, generate
from quillgraph.prompts import PROMPTS, render_messages
from quillgraph.sources.shared import once

__all__ = ["BatchGenerator", "Generator", "ResponseCache", "Sentences", "generate", "openie", "openie_with_fallback"]

#: Fixed values of the exchange format: what offline models with guided decoding are to write.
ENTITIES_JSON = {"type": "object", "properties": {"named_entities": {"type": "array", "items": {"type": "string"}}}, "required": ["named_entities"]}
TRIPLES_JSON = {"type": "object", "properties": {"triples": {"type": "array", "items": {"type": "array", "items": {"type": "string"}, "minItems": 3, "maxItems": 3}}}, "required": ["triples"]}


_SENTENCE = re.compile(r"[.!?]+")


class Sentences:
    """A model for machines without one. Of each sentence of three words and more it takes the first word, the one in the middle and the last: a triple, whose ends are entities."""

    def __call__(self, messages: list[dict[str, str]]) -> tuple[str, dict]:
        text = messages[-1]["content"]
        passage = text.split("```")[-2] if text.count("```") >= 2 else text
        parts = [w for w in map(str.split, _SENTENCE.split(passage)) if len(w) >= 3]
        triples = [[w[0], w[len(w) // 2], w[-1]] for w in parts]
        body = {"triples": triples} if text.startswith("Entities") or text.startswith("实体") else {"named_entities": list(dict.fromkeys(x for t in triples for x in t[::2]))}
        return json.dumps(body, ensure_ascii=False), {"prompt_tokens": len(text.split()), "completion_tokens": 3 * len(parts)}

    def batch(self, many: list[list[dict[str, str]]], json_schema: dict | None = None) -> list[tuple[str, dict]]:
        return [self(m) for m in many]


def openie(chunks: DataFrame, model: Generator, language: str = "en", **how) -> DataFrame:
    """(chunk_id, passage, entities, triples, ok_entities, ok_triples) of chunks (chunk_id, content): entities first, then triples given them."""
    zh = "_zh" if language == "zh" else ""
    ner = generate(chunks.select("chunk_id", "content"), lambda r: render_messages(PROMPTS["ner" + zh], passage=r["content"]), model, "chunk_id", json_schema=ENTITIES_JSON, **how)
    said = ner.select("chunk_id", json_repair.entities(json_repair.repaired(F.col("response"))).alias("entities"), (F.col("status") == "ok").alias("ok_entities"))
    got = once(said.select("chunk_id", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), "ok_entities"), "entities")
    texts = chunks.select("chunk_id", "content")
    asked = texts.join(got, "chunk_id").select("chunk_id", "content", F.to_json(F.struct(F.col("entities").alias("named_entities"))).alias("named"))
    trip = generate(asked, lambda r: render_messages(PROMPTS["triple_extraction" + zh], passage=r["content"], named_entity_json=r["named"]), model, "chunk_id", json_schema=TRIPLES_JSON, **how)
    # texts come last: who does not ask for passages does not move them
    both = got.join(trip.select("chunk_id", F.col("response").alias("_t"), (F.col("status") == "ok").alias("ok_triples")), "chunk_id").join(texts, "chunk_id")
    return both.select("chunk_id", F.col("content").alias("passage"), "entities", F.coalesce(json_repair.triples(json_repair.repaired(F.col("_t"))), F.array().cast("array<array<string>>")).alias("triples"), "ok_entities", "ok_triples")


def _came() -> tuple:
    """Whether a row's entities, and its triples, came and hold something."""
    some = lambda ok, what: F.coalesce(F.col(ok), F.lit(False)) & (F.size(what) > 0)
    return some("ok_entities", "entities"), some("ok_triples", "triples")


def success_rate(rows: DataFrame, *by: str) -> DataFrame:
    """(batch_size, rate) of all rows, or of each group of ``by``: entities and triples that came and hold something, by twice the chunks."""
    ok = sum(F.sum(F.when(c, 1).otherwise(0)) for c in _came())
    return rows.groupBy(*by).agg(F.count("*").alias("batch_size"), F.when(F.count("*") == 0, 0.0).otherwise(ok / (2 * F.count("*"))).alias("rate"))


def numbered(rows: DataFrame, by: str, size: int) -> DataFrame:
    """rows with ``batch``: in the order of ``by`` every ``size`` of them are one, and only the last may have fewer.

    Ranges are sorted apart; a range's first number is the sum of the rows in those before it, a sum over as many rows as there are ranges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = once(rows.repartitionByRange(parts, by).sortWithinPartitions(by).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    first = counts.withColumn("_first", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    place = F.col("_id") - F.shiftleft(F.col("_part"), 33) + F.col("_first")
    return placed.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn("batch", F.floor(place / size).cast("long")).drop("_id", "_part", "_first")


def openie_with_fallback(chunks: DataFrame, first: Generator, second: Generator | None, least: float = 0.5, language: str = "en", batch: int = 200, **how) -> DataFrame:
    """openie of chunks with ``batch`` and ``provider`` (first, second or none): each batch has the first provider's results if more than ``least`` of them came, else the second's by the same rule, else empty ones.

    The batches that the first provider fails are one table for the second; what it fails gets empty results. A batch holds ``batch`` chunks in the
    order of their ids.
    """
    left, done = once(numbered(chunks.select("chunk_id", "content"), "chunk_id", batch), "batches"), None
    texts = left.select("chunk_id", F.col("content").alias("passage"))
    for name, model in (("first", first), ("second", second)):
        if model is None or not left.limit(1).count():
            continue
        got = once(openie(left.drop("batch"), model, language, batch=batch, **how).drop("passage").join(left.select("chunk_id", "batch"), "chunk_id"), "extracted")
        good = once(success_rate(got, "batch").where(F.col("rate") > least).select("batch"), "good")
        kept = got.join(good, "batch", "left_semi").withColumn("provider", F.lit(name))
        done = kept if done is None else done.unionByName(kept)
        left = once(left.join(good, "batch", "left_anti"), "left")
    none = left.select("chunk_id", F.col("content").alias("passage"), F.array().cast("array<string>").alias("entities"), F.array().cast("array<array<string>>").alias("triples"), F.lit(False).alias("ok_entities"), F.lit(False).alias("ok_triples"), "batch", F.lit("none").alias("provider"))
    return none if done is None else done.join(texts, "chunk_id").select(*none.columns).unionByName(none)


def chunk_triples(rows: DataFrame) -> DataFrame:
    """(chunk_id, s, p, o): normalised triples with three parts, each once for a chunk, as different triples may be alike when they are normalised."""
    each = rows.select("chunk_id", F.explode(json_repair.valid_triples(F.col("triples"))).alias("t"))
    return each.select("chunk_id", *[normalize(F.col("t")[i]).alias(n) for i, n in enumerate("spo")]).distinct()


def stats(rows: DataFrame) -> DataFrame:
    """avg_ent_chars and avg_ent_words over all entities, to four decimals; 0 without entities."""
    each = rows.select(F.explode("entities").alias("e"))
    n = F.count("*")
    mean = lambda c: F.when(n == 0, 0.0).otherwise(F.round(F.sum(c) / n, 4))
    words = F.when(F.trim("e") == "", 0).otherwise(F.size(F.split(F.trim("e"), r"\s+")))
    return each.agg(mean(F.length("e")).alias("avg_ent_chars"), mean(words).alias("avg_ent_words"))


def reformatted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extraction results as two tables: (chunk_id, unique_entities), sorted, and (chunk_id, triples), those with three parts."""
    return rows.select("chunk_id", F.sort_array(F.array_distinct("entities")).alias("unique_entities")), rows.select("chunk_id", json_repair.valid_triples(F.col("triples")).alias("triples"))


def token_usage(generated: DataFrame) -> DataFrame:
    return generated.agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(F.col("cache_hit").cast("long")).alias("cache_hits"))
