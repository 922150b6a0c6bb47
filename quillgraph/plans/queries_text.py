"""Queries on ids, text functions, stores, extraction results, prompts and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import json_repair, text
from quillgraph.operators import evaluate, openie, qa, store
from quillgraph.operators.topk import top_k
from quillgraph.plans.registry import query
from quillgraph.plans.tables import FACT, PASSAGES, TRIPLES, norm_sql, paragraphs, passages, questions, sentences, spo, table, triples


@query("SELECT doc_id, 'chunk-' || md5(text) AS chunk_id, 'file-' || md5(text) AS file_id FROM documents")
def hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_id(F.col("text"), "chunk-").alias("chunk_id"), text.content_id(F.col("text"), "file-").alias("file_id"))


@query(f"SELECT doc_id, {norm_sql('text')} AS normal FROM documents")
def text_processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("normal"))


_ANSWER = r"array_to_string(list_filter(string_split(trim(regexp_replace(translate(lower({c}), '!\"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '\s+', ' ', 'g')), ' '), lambda w: w NOT IN ('a', 'an', 'the')), ' ')".replace('\\"', '"')


@query(f"SELECT conv_id, turn, {_ANSWER.format(c='text')} AS normal FROM conversations")
def normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize_answer(F.col("text")).alias("normal"))


@query(f"WITH {PASSAGES}, stored AS (SELECT DISTINCT 'chunk-' || md5(text) AS id FROM documents WHERE text IS NOT NULL) SELECT chunk_id AS hash_id, content FROM passages WHERE chunk_id NOT IN (SELECT id FROM stored)")
def chunk_insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "documents").select(text.content_id(F.col("text"), "chunk-").alias("hash_id")).distinct()
    return store.missing(paragraphs(spark, sf_dir).select("content"), stored, "chunk-")


@query(f"WITH {TRIPLES} SELECT chunk_id, s, p, o FROM triples")
def triples_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of all sentences, and the words of those that are too short for one, which count for nothing."""
    each = sentences(passages(spark, sf_dir)).select("chunk_id", F.when(F.size("w") >= 3, F.array(*spo())).otherwise(F.slice("w", 1, 2)).alias("t"))
    return openie.chunk_triples(each.groupBy("chunk_id").agg(F.collect_list("t").alias("triples")))


@query("""SELECT c.conv_id, c.turn, sha256('{"messages":"' || replace(replace(replace(c.text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '","model":"m","seed":0,"temperature":0.0}') AS key, NOT EXISTS (SELECT 1 FROM conversations a WHERE a.role <> 'user' AND a.text = c.text) AS to_ask
    FROM conversations c WHERE role = 'user'""".replace("\\\\", "\\"))
def cache_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    asked = qa.keyed(rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("messages")), "m", 0, 0.0)
    cache = qa.keyed(rows.where("role <> 'user'").select(F.col("text").alias("messages")), "m", 0, 0.0).select("key", F.col("messages").alias("message"), F.lit("{}").alias("metadata")).dropDuplicates(["key"])
    hit, ask = qa.cached(asked, cache)
    return asked.join(ask.select("key"), "key", "left_semi").select("conv_id", "turn", "key", F.lit(True).alias("to_ask")).unionByName(hit.select("conv_id", "turn", "key", F.lit(False).alias("to_ask")))


@query("""WITH p AS (SELECT source, doc_id, lang AS first, text AS rest FROM documents)
    SELECT source, first AS first_line, first || chr(10) || string_agg(rest, chr(10) ORDER BY doc_id) AS content FROM p GROUP BY source, first""")
def merge_first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that begin with a line for their language; those of a source with the same first line become one."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.concat_ws("\n", "lang", "text").alias("content"))
    return text.merge_by_first_line(rows, "source", "doc_id", "content").select("source", "first_line", "content")


@query("SELECT doc_id, source || chr(10) || text AS content FROM documents")
def corpus_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.sources.files import passage

    return table(spark, sf_dir, "documents").select("doc_id", passage(F.col("source"), F.col("text")).alias("content"))


@query("SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def gold_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a question. Both meet on five words of the question, from its second, and only those are compared.

    The first and the last word of a question may be parts of words in the text, so neither takes part. Questions of fewer than
    seven words are compared with all texts, as a query set.
    """
    q = questions(spark, sf_dir).withColumn("_w", F.split("question", r"\s+"))
    few = q.limit(10_001).count() <= 10_000
    dealt = lambda c: F.broadcast(c) if few else c
    long = q.where(F.size("_w") >= 7).withColumn("_h", F.xxhash64(F.slice("_w", 2, 5))).drop("_w")
    short = q.where(F.size("_w") < 7).drop("_w")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select("doc_id", "text", F.split("text", r"\s+").alias("w"), F.size(F.split("text", r"\s+")).alias("n"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - 4, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, F.lit(5))))
    d = words.select("doc_id", "text", F.explode(runs).alias("_h"))
    met = d.join(dealt(long), "_h").select("query_id", "doc_id", "text", "question").unionByName(docs.crossJoin(dealt(short)).select("query_id", "doc_id", "text", "question"))
    return met.where(F.contains("text", F.col("question"))).select("query_id", "doc_id").distinct()


@query("SELECT conv_id, list_sort(list_distinct(list(text))) AS gold_answers FROM conversations WHERE role <> 'user' GROUP BY conv_id")
def gold_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.sources.files import gold_answers as answers

    rows = table(spark, sf_dir, "conversations").where("role <> 'user'").groupBy("conv_id").agg(F.collect_list("text").alias("answer"))
    none = {c: F.lit(None).cast("array<string>") for c in ("gold_ans", "reference", "possible_answers", "o_aliases", "answer_aliases")} | {c: F.lit(None).cast("string") for c in ("obj", "o_wiki_title")}
    return answers(rows.withColumns(none)).select("conv_id", F.array_sort("gold_answers").alias("gold_answers"))


# extraction results

_WORDS = norm_sql("content")


@query(f"""WITH {PASSAGES}, e AS (SELECT unnest(list_distinct([w FOR w IN string_split({_WORDS}, ' ') IF length(w) > 6])) AS e FROM passages)
    SELECT round(sum(length(e)) / count(*), 4) AS avg_ent_chars, round(sum(1) / count(*), 4) AS avg_ent_words FROM e""")
def openie_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passages(spark, sf_dir).select(F.array_distinct(F.filter(F.split(text.normalize(F.col("content")), " "), lambda w: F.length(w) > 6)).alias("entities"))
    return openie.stats(rows)


@query(f"""WITH {TRIPLES}, e AS (SELECT chunk_id, count(DISTINCT x) AS n FROM (SELECT chunk_id, unnest([s, o]) AS x FROM triples) GROUP BY chunk_id), t AS (SELECT chunk_id, count(*) AS n FROM triples GROUP BY chunk_id)
    SELECT chunk_id, CAST(coalesce(e.n, 0) AS BIGINT) AS n_entities, CAST(coalesce(t.n, 0) AS BIGINT) AS n_triples FROM passages LEFT JOIN e USING (chunk_id) LEFT JOIN t USING (chunk_id)""")
def openie_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are written as a model would, prose around them, and parsed again: the triples of all sentences and their ends, some twice."""
    each = sentences(passages(spark, sf_dir)).select("chunk_id", F.when(F.size("w") >= 3, F.array(*spo())).alias("t"))
    per = each.groupBy("chunk_id").agg(F.collect_list("t").alias("t"))
    ends = F.flatten(F.transform("t", lambda t: F.array(t[0], t[2])))
    rows = per.select("chunk_id", F.concat(F.lit("Here you are: "), F.to_json(F.struct(ends.alias("named_entities"))), F.lit(" Done.")).alias("ner"), F.concat(F.lit("Sure.\n"), F.to_json(F.struct(F.concat("t", "t").alias("triples"))), F.lit("\n")).alias("trip"))
    return rows.select("chunk_id", F.size(json_repair.entities(F.col("ner"))).cast("long").alias("n_entities"), F.size(json_repair.triples(F.col("trip"))).cast("long").alias("n_triples"))


@query("""SELECT event_id, props AS fixed FROM events WHERE props IS NOT NULL""")
def json_repair_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid JSON passes unchanged; only rows that fail to parse reach the Python function."""
    return table(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", json_repair.repaired(F.col("props")).alias("fixed"))


@query(f"""WITH {TRIPLES}, w AS (SELECT chunk_id, list_distinct(flatten(list(w))) AS e FROM sentences GROUP BY chunk_id), t AS (SELECT chunk_id, count(*) AS n, count(DISTINCT p) AS r, list_distinct(flatten(list([s, o]))) AS named FROM triples GROUP BY chunk_id)
    SELECT chunk_id, CAST(coalesce(n, 0) + 1 AS BIGINT) AS total, CAST(coalesce(n, 0) AS BIGINT) AS valid, CASE WHEN n IS NULL THEN 0 ELSE round(len(list_intersect(e, named)) / len(e), 2) END AS coverage, CAST(coalesce(r, 0) AS BIGINT) AS relations
    FROM w LEFT JOIN t USING (chunk_id)""")
def triple_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of a passage as its entities, and the triples of its sentences with one that has two parts."""
    each = sentences(passages(spark, sf_dir)).select("chunk_id", "w", F.when(F.size("w") >= 3, F.array(*spo())).alias("t"))
    rows = each.groupBy("chunk_id").agg(F.flatten(F.collect_list("w")).alias("entities"), F.concat(F.collect_set("t"), F.array(F.array(F.lit("x"), F.lit("y")))).alias("triples"))
    return evaluate.triple_quality(rows)


@query(f"""WITH {PASSAGES}, b AS (SELECT count(*) AS n, count(*) FILTER (length(content) > 40) AS e, count(*) FILTER (length(content) > 80) AS t FROM passages)
    SELECT n AS batch_size, (e + t) / (2 * n) AS rate FROM b""")
def batch_success_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage has a result of either kind; what has too little text holds nothing, which is no success."""
    words, none = F.split("content", " "), F.array().cast("array<string>")
    entities, triples = F.when(F.length("content") > 40, words).otherwise(none), F.when(F.length("content") > 80, F.array(words)).otherwise(F.array().cast("array<array<string>>"))
    rows = passages(spark, sf_dir).select(entities.alias("entities"), triples.alias("triples"), F.lit(True).alias("ok_entities"), F.lit(True).alias("ok_triples"))
    return openie.success_rate(rows)


@query("SELECT sum(length(text))::BIGINT AS prompt_tokens, sum(turn)::BIGINT AS completion_tokens, count(*) FILTER (role = 'user')::BIGINT AS cache_hits FROM conversations")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.length("text").alias("prompt_tokens"), F.col("turn").alias("completion_tokens"), (F.col("role") == "user").alias("cache_hit"))
    return openie.token_usage(rows)


@query(f"WITH {TRIPLES} SELECT 'fact-' || md5({FACT}) AS fact_id, {FACT} AS content, s, p, o FROM (SELECT DISTINCT s, p, o FROM triples)")
def facts_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.graph import facts

    return facts(triples(spark, sf_dir))


# prompts and answers


@query("""WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations),
    p AS (SELECT conv_id, string_agg('Wikipedia Title: ' || text || chr(10) || chr(10), '' ORDER BY rank) AS p FROM r WHERE rank <= 5 GROUP BY conv_id)
    SELECT conv_id AS query_id, p || 'Question: ' || text || chr(10) || 'Thought: ' AS prompt_user FROM p JOIN r USING (conv_id) WHERE rank = 1""")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), "turn", F.col("text").alias("content"), F.length("text").alias("score")).withColumn("chunk_id", F.concat_ws("-", F.col("query_id").cast("string"), F.col("turn").cast("string")))
    ranked = top_k(rows, None, ["query_id"], "score", "turn")
    asked = ranked.where("rank = 1").select("query_id", F.col("content").alias("question"))
    return qa.prompts(ranked.drop("content"), rows, asked)


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN trim(text) ELSE text END AS answer FROM conversations")
def answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Thought: it says so. Answer: "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.answer_of(said).alias("answer"))


# evaluation: a conversation's first assistant turn is the prediction, all its assistant turns the gold answers

_QA = """WITH a AS (SELECT conv_id, turn, text, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS predicted FROM conversations)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    first = rows.groupBy("conv_id").agg(F.min_by("text", "turn").alias("predicted"))
    return rows.join(first, "conv_id").select(F.col("conv_id").alias("query_id"), F.col("text").alias("gold"), "predicted", "turn")


@query(_QA + f" SELECT conv_id AS query_id, max(CASE WHEN {_ANSWER.format(c='text')} = {_ANSWER.format(c='predicted')} THEN 1.0 ELSE 0.0 END)::DOUBLE AS em FROM a WHERE turn > 0 GROUP BY conv_id")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.exact_match(_answers(spark, sf_dir).where("turn > 0"))


_F1 = _QA + f""", t AS (SELECT conv_id, turn, [w FOR w IN string_split({_ANSWER.format(c='text')}, ' ') IF w <> ''] AS g, [w FOR w IN string_split({_ANSWER.format(c='predicted')}, ' ') IF w <> ''] AS p FROM a WHERE turn > 0),
    g AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(g) AS w FROM t) GROUP BY ALL), q AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(p) AS w FROM t) GROUP BY ALL),
    s AS (SELECT conv_id, turn, sum(least(g.n, q.n)) AS same FROM g JOIN q USING (conv_id, turn, w) GROUP BY ALL),
    f AS (SELECT conv_id AS query_id, max(CASE WHEN same IS NULL THEN 0 ELSE 2 * (same / len(p)) * (same / len(g)) / (same / len(p) + same / len(g)) END)::DOUBLE AS f1 FROM t LEFT JOIN s USING (conv_id, turn) GROUP BY conv_id)"""


@query(_F1 + " SELECT query_id, round(f1, 6) AS f1 FROM f")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.token_f1(_answers(spark, sf_dir).where("turn > 0")).select("query_id", F.round("f1", 6).alias("f1"))


@query(_F1 + f", e AS (SELECT conv_id AS query_id, max(CASE WHEN {_ANSWER.format(c='text')} = {_ANSWER.format(c='predicted')} THEN 1.0 ELSE 0.0 END)::DOUBLE AS em FROM a WHERE turn > 0 GROUP BY conv_id) SELECT floor(avg(em) * 10000 + 0.5) / 10000 AS \"ExactMatch\", floor(avg(f1) * 10000 + 0.5) / 10000 AS \"F1\" FROM e JOIN f USING (query_id)")
def qa_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.qa_report(_answers(spark, sf_dir).where("turn > 0"))
