"""Queries on stores, files, models and the engine as a whole: what is written is read again, and stand-in models answer."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.engine import DenseRag, GraphRag
from quillgraph.functions import json_repair, text
from quillgraph.operators import embed, enrich, evaluate, graph, markdown, openie, qa, retrieve
from quillgraph.operators.store import VectorStore
from quillgraph.plans.queries_docs import _DOCS, docs
from quillgraph.plans.queries_graph import GRAPH, edges
from quillgraph.plans.queries_retrieval import _CAND, _LEXICAL, _SEEDS, _candidates, _kept
from quillgraph.plans.registry import query
from quillgraph.plans.tables import ENTITY, PASSAGES, TRIPLES, norm_sql, passages, questions, table, triples
from quillgraph.sources import files
from quillgraph.sources.shared import once, shared_dir
from quillgraph.sources.state import State

# stores and files


@query(f"""WITH {PASSAGES} SELECT chunk_id AS hash_id, dim, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY chunk_id)), 4) AS x FROM (
    SELECT chunk_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 16 AS dim, count(*)::DOUBLE AS tf FROM (SELECT chunk_id, unnest(string_split({norm_sql('content')}, ' ')) AS w FROM passages WHERE length(content) >= 40) WHERE w <> '' GROUP BY ALL)""")
def store_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages go in by two inserts, of which the second has all, with vectors of hashed words; short ones are deleted."""
    store = VectorStore(spark, shared_dir(spark, "store"), "chunk", lambda rows: embed.embedded(rows, embed.HashedWords(16)))
    rows = passages(spark, sf_dir)
    store.insert(rows.where(F.pmod(F.xxhash64("content"), F.lit(2)) == 0).select("content"))
    store.insert(rows.select("content"))
    store.delete(store.load().where(F.length("content") < 40).select("hash_id"))
    each = store.load().select("hash_id", F.posexplode("embedding").alias("dim", "x")).where("x <> 0")
    return each.select("hash_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("x").cast("double"), 4).alias("x"))


@query(f"WITH {PASSAGES} SELECT chunk_id AS hash_id, content FROM passages WHERE length(content) >= 40 AND length(content) % 3 = 0")
def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the ids of texts, some of which are not stored."""
    store = VectorStore(spark, shared_dir(spark, "store"), "chunk")
    rows = passages(spark, sf_dir)
    store.insert(rows.where(F.length("content") >= 40).select("content"))
    asked = rows.where(F.length("content") % 3 == 0).select("content")
    return store.rows(store.id_of(asked).select("hash_id")).select("hash_id", "content")


@query(f"WITH {TRIPLES} SELECT chunk_id, count(*) AS n_triples, min(s) AS first_s, max(o) AS last_o FROM triples GROUP BY chunk_id")
def openie_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction results written as JSON and read again."""
    t = triples(spark, sf_dir).groupBy("chunk_id").agg(F.collect_list(F.array("s", "p", "o")).alias("triples"), F.collect_set("s").alias("entities")).withColumn("passage", F.lit("x"))
    files.write_openie(t, path := shared_dir(spark, "openie"))
    each = files.read_openie(spark, path).select("chunk_id", F.explode("triples").alias("t"))
    return each.groupBy("chunk_id").agg(F.count("*").alias("n_triples"), F.min(F.col("t")[0]).alias("first_s"), F.max(F.col("t")[2]).alias("last_o"))


@query(f"WITH {GRAPH} SELECT kind, count(*) AS n, sum(weight) AS weight FROM edges GROUP BY kind UNION ALL SELECT 'vertices', (SELECT count(DISTINCT entity_id) FROM mentions) + (SELECT count(*) FROM passages), 0")
def graph_persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph written, written again in its place, and loaded."""
    t = triples(spark, sf_dir)
    path = shared_dir(spark, "graph")
    v, e = once(graph.vertices(graph.entities(t), passages(spark, sf_dir)), "vertices"), once(edges(spark, sf_dir, t), "edges")
    files.write_graph(v.where("kind = 'passage'"), e.where("kind = 'fact'"), path)
    files.write_graph(v, e, path)
    v, e = files.graph(spark, path)
    per = e.groupBy("kind").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    return per.unionByName(v.agg(F.lit("vertices").alias("kind"), F.count("*").alias("n"), F.lit(0.0).alias("weight")))


@query("SELECT doc_id AS idx, source || chr(10) || text AS content FROM documents")
def corpus_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus as lists of objects on lines, read by the corpus reader."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("title"), "text", F.col("doc_id").alias("idx"))
    lists = rows.groupBy(F.pmod("idx", F.lit(64)).alias("part")).agg(F.to_json(F.collect_list(F.struct("title", "text", "idx"))).alias("value"))
    lists.select("value").write.text(path := shared_dir(spark, "corpus"))
    return files.corpus(spark, path, lines=True).select("idx", "content")


@query("SELECT 'files' AS name, count(*) AS n FROM documents UNION ALL SELECT 'doc_chunks', 3 * count(*) FROM documents UNION ALL SELECT 'codes', count(*) FILTER (doc_id % 8 + 1 >= 5) FROM documents UNION ALL SELECT 'tables', count(*) FILTER (doc_id % 7 + 2 >= 5) FROM documents")
def structure_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document structure written as JSON and read again; it has to be valid."""
    files.write_structure(markdown.structure(docs(spark, sf_dir), 0), path := shared_dir(spark, "structure"))
    parts = files.read_structure(spark, path)
    if not files.valid_structure(parts["files"]):
        raise ValueError("the structure is not valid")
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH c AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn) AS p FROM conversations GROUP BY conv_id)
    SELECT conv_id, list_distinct(CASE conv_id % 3 WHEN 0 THEN [CAST(x.turn AS VARCHAR) || chr(10) || x.text || x.role FOR x IN p IF x.turn % 2 = 0] ELSE [CAST(x.turn AS VARCHAR) || chr(10) || x.text FOR x IN p IF x.role = 'assistant'] END).list_sort() AS gold_docs FROM c""")
def gold_supporting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold passages in the three layouts of questions: supporting facts, contexts, paragraphs."""
    title = F.col("turn").cast("string")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.collect_list(F.struct(title.alias("title"), F.col("text").alias("text"), F.col("text").alias("paragraph_text"), (F.col("role") == "assistant").alias("is_supporting"))).alias("p"),
        F.collect_list(F.struct(title.alias("title"), F.array("text", "role").alias("sentences"))).alias("c"),
        F.collect_list(F.when(F.col("turn") % 2 == 0, F.array(title, F.lit("0")))).alias("f"),
    )
    kind = lambda k, c: F.when(F.col("conv_id") % 3 == k, F.col(c)).alias({"f": "supporting_facts", "c": "context", "p": "paragraphs"}[c] if k != 1 else "contexts")
    made = rows.select("conv_id", kind(0, "f"), F.when(F.col("conv_id") % 3 == 0, F.col("c")).alias("context"), kind(1, "p"), kind(2, "p"))
    return files.gold_docs(made).select("conv_id", F.array_sort("gold_docs").alias("gold_docs"))


# text, prompts, inputs of models


@query(r"""SELECT event_id, CASE WHEN n >= 8 THEN props ELSE left(props, n) || CASE WHEN n >= 2 AND n < 4 THEN '"' ELSE '' END || '}' END AS fixed, json_valid(left(props, n)) AS whole
    FROM (SELECT event_id, props, 1 + event_id % 6 AS n FROM events WHERE props IS NOT NULL AND props LIKE '{"k": %')""")
def json_repair_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON that breaks off after one to six characters, within a bracket or a string, is closed."""
    rows = table(spark, sf_dir, "events").where("props like '{\"k\": %'").select("event_id", F.substring("props", F.lit(1), (1 + F.col("event_id") % 6).cast("int")).alias("cut"))
    return rows.select("event_id", json_repair.repaired(F.col("cut")).alias("fixed"), F.try_parse_json("cut").isNotNull().alias("whole"))


@query(r"""SELECT conv_id, turn, 'From ' || role || ': ' || text || '!' AS filled, '${role} and {x y}' AS template,
    'Instruct: Find the passages that answer this question.' || chr(10) || 'Query: ' || text AS asked FROM conversations""")
def prompt_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    filled = text.render_column("From ${role}: ${text}!", role=F.col("role"), text=F.col("text"))
    return rows.select("conv_id", "turn", filled.alias("filled"), text.to_template(F.lit("{role} and {x y}")).alias("template"), text.with_instruction(F.col("text"), "query_to_passage").alias("asked"))


@query(r"""SELECT doc_id, CASE WHEN flat = '' THEN ' ' ELSE flat END AS input, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS tokens,
    doc_id % 2 = 0 AS flag, 'é' || CAST(doc_id AS VARCHAR) AS decoded FROM (SELECT doc_id, text, replace(text, chr(10), ' ') AS flat FROM documents)""")
def input_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    word = F.get(F.array(*map(F.lit, ("Yes", "no", "t", "F", "1", "0"))), (F.col("doc_id") % 6).cast("int"))
    return rows.select("doc_id", text.embed_input(F.col("text")).alias("input"), text.token_count(F.col("text")).alias("tokens"), text.to_bool(word).alias("flag"), text.decode_unicode(F.concat(F.lit("\\u00e9"), F.col("doc_id").cast("string"))).alias("decoded"))


@query(f"""WITH {TRIPLES} SELECT s AS content, CASE WHEN {' OR '.join(f"contains(s, '{w}')" for w in evaluate.ENTITY_HINTS[0][1])} THEN 'organisation' WHEN {' OR '.join(f"contains(s, '{w}')" for w in evaluate.ENTITY_HINTS[1][1])} THEN 'place'
    WHEN {' OR '.join(f"contains(s, '{w}')" for w in evaluate.ENTITY_HINTS[2][1])} THEN 'time' WHEN {' OR '.join(f"contains(s, '{w}')" for w in evaluate.ENTITY_HINTS[3][1])} THEN 'technology' ELSE 'other' END AS entity,
    CASE WHEN {' OR '.join(f"contains(s, '{w}')" for w in evaluate.RELATION_HINTS[0][1])} THEN 'is' WHEN {' OR '.join(f"contains(s, '{w}')" for w in evaluate.RELATION_HINTS[1][1])} THEN 'has' WHEN {' OR '.join(f"contains(s, '{w}')" for w in evaluate.RELATION_HINTS[2][1])} THEN 'place'
    WHEN {' OR '.join(f"contains(s, '{w}')" for w in evaluate.RELATION_HINTS[3][1])} THEN 'action' ELSE 'other' END AS relation FROM (SELECT DISTINCT s FROM triples)""")
def kind_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triples(spark, sf_dir).select(F.col("s").alias("content")).distinct()
    return rows.select("content", evaluate.hinted(F.col("content"), evaluate.ENTITY_HINTS).alias("entity"), evaluate.hinted(F.col("content"), evaluate.RELATION_HINTS).alias("relation"))


@query(f"WITH {TRIPLES} SELECT chunk_id, list_sort(list_distinct(list(s))) AS unique_entities, CAST(count(*) AS BIGINT) AS n_triples FROM triples GROUP BY chunk_id")
def openie_reformat(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir).groupBy("chunk_id").agg(F.collect_list("s").alias("entities"), F.concat(F.collect_list(F.array("s", "p", "o")), F.array(F.array(F.lit("x")))).alias("triples"))
    ner, valid = openie.reformatted(t)
    return ner.join(valid, "chunk_id").select("chunk_id", "unique_entities", F.size("triples").cast("long").alias("n_triples"))


@query("SELECT conv_id, count(DISTINCT length(text)) <= 1 AS same FROM conversations GROUP BY conv_id")
def same_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.same_length(table(spark, sf_dir, "conversations"), "conv_id", F.length("text"))


# Markdown


@query(f"""WITH {_DOCS} SELECT doc_id, 'code-' || md5(c) AS id, c AS content FROM (SELECT doc_id, string_split(body, chr(10))[-1] || chr(10) || chr(10) || '```python' || chr(10) || code || chr(10) || '```' || chr(10) || '## table' || chr(10) || '| a | b |' AS c FROM docs WHERE doc_id % 8 + 1 >= 5)""")
def md_code_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of code with two lines before and after."""
    return markdown.code_blocks(markdown.lines(docs(spark, sf_dir)), 2)[0]


@query(rf"""WITH {_DOCS} SELECT doc_id, regexp_replace(regexp_replace('# ' || source || chr(10) || see || chr(10) || '## ' || lang || chr(10) || body || chr(10) || chr(10) || chr(10) || '## table', '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS content FROM docs""")
def md_without_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.without_code_and_tables(docs(spark, sf_dir))


@query("SELECT doc_id, 3::BIGINT AS chunks, CASE WHEN doc_id % 8 + 1 < 5 THEN 1 ELSE 0 END::BIGINT AS with_code, CASE WHEN doc_id % 7 + 2 < 5 THEN 1 ELSE 0 END::BIGINT AS with_table FROM documents")
def md_filter_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short code and tables stay in a chunk's text, long ones leave it."""
    rows = markdown.structure(docs(spark, sf_dir), 0)["doc_chunks"].where("size(extracted_entities) = 0 and size(extracted_triples) = 0")
    has = lambda what: F.count(F.when(F.contains("filter_content", F.lit(what)), 1))
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), has("```").alias("with_code"), has("| y |").alias("with_table")).withColumn("doc_id", F.col("doc_id").cast("long"))


@query(f"""WITH {_DOCS} SELECT doc_id, 'docs/doc' || doc_id || '.md' AS file_path, 'file-' || md5('# ' || source || chr(10) || see || chr(10) || '## ' || lang || chr(10) || body || chr(10) || chr(10) || '```python' || chr(10) || code || chr(10) || '```' || chr(10) || '## table' || chr(10) || tab) AS file_id, abstract FROM docs, (SELECT '' AS abstract)""")
def md_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.structure(docs(spark, sf_dir), 0)["files"].select("doc_id", "file_path", "file_id", "abstract")


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(ceil((len(w) - 20) / 80), 1) AS BIGINT))) AS piece FROM w)
    SELECT doc_id, CAST(piece AS INTEGER) AS piece, array_to_string(w[piece * 80 + 1 : piece * 80 + 100], ' ') AS content FROM p""")
def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a hundred words that overlap by twenty."""
    return markdown.split_words(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), 100, 20)


# models


class FailsOnCode:
    """A service that fails at prompts with code."""

    def __call__(self, messages: list[dict[str, str]]) -> tuple[str, dict]:
        if "x = 1" in messages[-1]["content"]:
            raise RuntimeError("no code, please")
        return "short", {"prompt_tokens": 1}


class FailsAlways:
    def __call__(self, messages: list[dict[str, str]]) -> tuple[str, dict]:
        raise RuntimeError("no service")


class KeepsTwo:
    """A filter model that names its second and its first fact, the second with an addition."""

    def __call__(self, messages: list[dict[str, str]]) -> tuple[str, dict]:
        facts = json.loads(messages[-1]["content"].rpartition("## ]]\n")[2])["fact"]
        return "Thus:\n[[ ## fact_after_filter ## ]]\n" + json.dumps({"fact": [[*f[:2], f[2] + " indeed"] if i else f for i, f in enumerate(facts[:2])][::-1]}, ensure_ascii=False) + "\n[[ ## completed ## ]]", {}


_RAW = PASSAGES + r""", raw AS (SELECT chunk_id, list_filter(string_split_regex(s, '\s+'), lambda x: x <> '') AS w FROM (SELECT chunk_id, unnest(string_split_regex(content, '[.!?]+')) AS s FROM passages)),
    said AS (SELECT DISTINCT chunk_id, w[1] AS s, w[len(w) // 2 + 1] AS p, w[len(w)] AS o FROM raw WHERE len(w) >= 3)"""


@query(f"""WITH {_RAW}, e AS (SELECT chunk_id, count(DISTINCT x) AS n FROM (SELECT chunk_id, unnest([s, o]) AS x FROM said) GROUP BY chunk_id), t AS (SELECT chunk_id, count(*) AS n FROM said GROUP BY chunk_id)
    SELECT chunk_id, CAST(coalesce(e.n, 0) AS BIGINT) AS n_entities, CAST(coalesce(t.n, 0) AS BIGINT) AS n_triples, true AS ok FROM passages LEFT JOIN e USING (chunk_id) LEFT JOIN t USING (chunk_id)""")
def openie_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages: the first provider fails at everything, so the second's results stand."""
    got = openie.openie_with_fallback(passages(spark, sf_dir), FailsAlways(), openie.Sentences(), attempts=1)
    return got.select("chunk_id", F.size("entities").cast("long").alias("n_entities"), F.size("triples").cast("long").alias("n_triples"), (F.col("ok_entities") & F.col("ok_triples")).alias("ok"))


@query("""SELECT 'file' AS type, count(*) AS done, count(*) AS by_second, 0::BIGINT AS failed FROM documents UNION ALL SELECT 'chunk', 3 * count(*), count(*), 0 FROM documents
    UNION ALL SELECT 'code', count(*) FILTER (doc_id % 8 + 1 >= 5), count(*) FILTER (doc_id % 8 + 1 >= 5), 0 FROM documents UNION ALL SELECT 'table', count(*) FILTER (doc_id % 7 + 2 >= 5), 0, 0 FROM documents""")
def abstracts_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts of all files, chunks, codes and tables: the second provider gets what has code in it, and all are written back."""
    parts = markdown.structure(docs(spark, sf_dir), 0)
    for name, key in (("files", "file_id"), ("doc_chunks", "chunk_id"), ("codes", "code_id"), ("tables", "table_id")):
        parts[name] = parts[name].withColumn(key, F.concat_ws("/", F.col("doc_id").cast("string"), key))
    made = once(enrich.abstracts(enrich.abstract_tasks(parts), FailsOnCode(), openie.Sentences(), attempts=1), "abstracts")
    done = enrich.write_abstracts(parts, made)
    if any(rows.where("abstract = ''").limit(1).count() for rows in done.values()):
        raise ValueError("abstracts are missing")
    return enrich.processed(made)


@query("""WITH c AS (SELECT doc_id % 8 + 1 AS n FROM documents), t AS (SELECT doc_id % 7 + 1 AS n FROM documents), s AS (
    SELECT 'code' AS type, count(*) AS tasks, sum(13 + 6 * n)::BIGINT AS chars FROM c WHERE n >= 5 UNION ALL SELECT 'table', count(*), sum(9 + 10 * n)::BIGINT FROM t WHERE n + 1 >= 5)
    SELECT type, tasks, chars, CAST(ceil(tasks / 200) AS BIGINT) AS batches, greatest(tasks * 3.0, ceil(tasks / 200) * 30.0)::DOUBLE AS seconds FROM s""")
def run_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What abstracts of codes and tables would take."""
    parts = markdown.structure(docs(spark, sf_dir), 0)
    for name, key in (("codes", "code_id"), ("tables", "table_id")):
        parts[name] = parts[name].withColumn(key, F.concat_ws("/", F.col("doc_id").cast("string"), key))
    return enrich.estimate(enrich.abstract_tasks(parts)).where("type in ('code', 'table')").select("type", "tasks", "chars", "batches", F.col("seconds").cast("double").alias("seconds"))


@query("SELECT run, count(DISTINCT text) AS answers, CASE WHEN run = 1 THEN 0 ELSE count(DISTINCT text) END AS hits, count(DISTINCT text) AS stored FROM conversations, (SELECT unnest([1, 2]) AS run) GROUP BY run")
def response_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different text as a prompt, twice: the second time all answers come from the cache."""
    cache = openie.ResponseCache(State(spark, shared_dir(spark, "cache")))
    rows = table(spark, sf_dir, "conversations").select("text").distinct()
    out = None
    for run in (1, 2):
        got = openie.generate(rows, lambda r: [{"role": "user", "content": r["text"]}], openie.Sentences(), "text", cache=cache)
        one = got.agg(F.lit(run).alias("run"), F.count("response").alias("answers"), F.count(F.when(F.col("cache_hit"), 1)).alias("hits")).crossJoin(cache.load().agg(F.count("*").alias("stored")))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {GRAPH}, {_CAND} SELECT query_id, fact_id, CAST(count(*) OVER (PARTITION BY query_id) + 1 - rank AS INTEGER) AS rank FROM fr WHERE rank <= 2")
def model_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that a model keeps, in its order."""
    return retrieve.ModelFilter(KeepsTwo())(_candidates(spark, sf_dir, triples(spark, sf_dir))).select("query_id", "fact_id", "rank")


@query("SELECT item_id AS query_id, 'ok' AS status, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS prompt_tokens FROM benchmark".replace("\\\\", "\\"))
def next_thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of reasoning for each question."""
    return qa.next_thought(questions(spark, sf_dir).withColumnRenamed("question", "prompt_user"), openie.Sentences()).select("query_id", "status", "prompt_tokens")


@query("SELECT item_id AS query_id, 'ok' AS status, text AS answer FROM benchmark")
def reader_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader that answers with the question: what stands after 'Answer:' comes back."""
    rows = questions(spark, sf_dir).withColumnRenamed("question", "prompt_user")
    return qa.read(rows, Echo(), "unknown dataset").select("query_id", "status", "answer")


class Echo:
    def __call__(self, messages: list[dict[str, str]]) -> tuple[str, dict]:
        return f"Thought: so it is. Answer: {messages[-1]['content']}", {}


@query("SELECT conv_id AS query_id, CASE WHEN count(DISTINCT length(text)) = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS em FROM conversations GROUP BY conv_id")
def custom_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact match where all golds have to agree, in the place of one: predicted is the length of the shortest text."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.length("text").alias("n"))
    least = rows.groupBy("query_id").agg(F.min("n").alias("least"))
    return evaluate.exact_match(rows.join(least, "query_id").select("query_id", F.col("n").cast("string").alias("gold"), F.col("least").cast("string").alias("predicted")), F.min)


@query(f"WITH {GRAPH}, {_CAND}, {_LEXICAL}, {_SEEDS} SELECT query_id, entity_id, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 9) DESC, entity_id) AS place FROM seeds) WHERE place <= 30")
def linking_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir)
    return retrieve.linking_map(retrieve.phrase_seeds(_kept(spark, sf_dir, t), graph.mentions(t), 5)).select("query_id", "entity_id", F.round("weight", 6).alias("weight"))


@query("""WITH r AS (SELECT conv_id, turn, text, length(text) / 7.0 AS score, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations)
    SELECT conv_id AS query_id, list(text ORDER BY rank) FILTER (rank <= 3) AS docs, list(floor(score * 10000 + 0.5) / 10000 ORDER BY rank) FILTER (rank <= 3) AS doc_scores FROM r GROUP BY conv_id""")
def query_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best texts of each query and their scores to four decimals."""
    from quillgraph.operators.topk import top_k

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), "turn", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), F.col("text").alias("content"), (F.length("text") / 7.0).alias("score"))
    ranked = top_k(rows, None, ["query_id"], "score", "turn")
    asked = rows.select("query_id", F.lit("q").alias("question")).distinct()
    return retrieve.solutions(ranked.drop("content"), rows, asked, 3).select("query_id", "docs", "doc_scores")


# the engine

_N = norm_sql
_LEFT = f"""{_RAW}, gone AS (SELECT chunk_id FROM passages WHERE length(content) % 4 = 0), kept AS (SELECT DISTINCT chunk_id, {_N('s')} AS s, {_N('p')} AS p, {_N('o')} AS o FROM said WHERE chunk_id NOT IN (SELECT chunk_id FROM gone)),
    pe AS (SELECT DISTINCT chunk_id, {ENTITY.format('x')} AS e FROM (SELECT chunk_id, unnest([s, o]) AS x FROM kept)), fe AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM (SELECT {ENTITY.format('s')} AS src, {ENTITY.format('o')} AS dst FROM kept UNION ALL SELECT {ENTITY.format('o')}, {ENTITY.format('s')} FROM kept) WHERE src <> dst GROUP BY src, dst)"""


@query(f"""WITH {_LEFT} SELECT 'chunks' AS what, count(*) AS n FROM passages WHERE chunk_id NOT IN (SELECT chunk_id FROM gone) UNION ALL SELECT 'extracted', count(*) FROM passages WHERE chunk_id NOT IN (SELECT chunk_id FROM gone)
    UNION ALL SELECT 'triples', count(*) FROM kept UNION ALL SELECT 'facts', count(*) FROM (SELECT DISTINCT s, p, o FROM kept) UNION ALL SELECT 'entities', count(DISTINCT e) FROM pe
    UNION ALL SELECT 'fact edges', count(*) FROM fe UNION ALL SELECT 'fact weight', CAST(sum(weight) AS BIGINT) FROM fe UNION ALL SELECT 'passage edges', count(*) FROM pe UNION ALL SELECT 'lacking', 0""")
def engine_index_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine indexes half of the passages, then all, deletes a part, and is loaded again: what it holds then."""
    root = shared_dir(spark, "engine")
    settings = {"vector_dims": 16, "synonymy_edge_sim_threshold": 1.5, "retry_attempts": 1}  # no synonyms: one-word names of few dimensions are all alike
    engine, rows = GraphRag(spark, root, **settings), passages(spark, sf_dir).select("content")
    engine.index(rows.where(F.pmod(F.xxhash64("content"), F.lit(2)) == 0))
    engine.index(rows)
    engine.delete(rows.where(F.length("content") % 4 == 0).unionByName(spark.createDataFrame([("never seen",)], "content string")))
    e = GraphRag(spark, root, **settings)
    made = e.edges()
    held = {"chunks": e.chunks(), "extracted": e.extracted(), "triples": e.triples(), "facts": e.stores["fact"].load(), "entities": e.stores["entity"].load(), "fact edges": made.where("kind = 'fact'"), "passage edges": made.where("kind = 'passage'"), "lacking": e.audit()}
    out = made.where("kind = 'fact'").agg(F.lit("fact weight").alias("what"), F.sum("weight").cast("long").alias("n"))
    for what, rows in held.items():
        out = out.unionByName(rows.agg(F.lit(what).alias("what"), F.count("*").alias("n")))
    return out


@query(f"""WITH {PASSAGES}, v AS (SELECT 'p' AS kind, chunk_id AS id, content AS t FROM passages UNION ALL SELECT 'q', CAST(item_id AS VARCHAR), text FROM benchmark),
    d AS (SELECT kind, id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 256 AS dim, count(*)::DOUBLE AS tf FROM (SELECT kind, id, unnest(string_split({norm_sql('t')}, ' ')) AS w FROM v) WHERE w <> '' GROUP BY ALL),
    s AS (SELECT b.item_id AS query_id, p.chunk_id, coalesce(x.score, 0) AS score FROM benchmark b CROSS JOIN passages p LEFT JOIN (SELECT q.id AS q, p.id AS p, sum(q.tf * p.tf) AS score FROM d q JOIN d p ON q.dim = p.dim WHERE q.kind = 'q' AND p.kind = 'p' GROUP BY ALL) x ON x.q = CAST(b.item_id AS VARCHAR) AND x.p = p.chunk_id),
    m AS (SELECT query_id, chunk_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WINDOW w AS (PARTITION BY query_id))
    SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM m WHERE rank <= 200""")
def engine_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine without a graph, by counts of hashed words: all questions against all stored passages."""
    engine = DenseRag(spark, shared_dir(spark, "dense"), normalise_embeddings=False)
    engine.index(passages(spark, sf_dir).select("content"))
    return engine.retrieve(questions(spark, sf_dir)).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("SELECT count(DISTINCT text) AS stored, count(*) AS asked FROM benchmark")
def query_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions embedded twice: their vectors are kept, once each."""
    state, asked = State(spark, shared_dir(spark, "memory")), questions(spark, sf_dir)
    for _ in range(2):
        got = embed.query_vectors(asked, "query_to_fact", "find", embed.HashedWords(8), state)
    return state.read("queries", "purpose string, question string").agg(F.count("*").alias("stored")).crossJoin(got.agg(F.count("*").alias("asked")))  # one row each


@query(f"WITH {PASSAGES} SELECT chunk_id AS hash_id, content FROM passages WHERE length(content) % 4 <> 0")
def stream_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages indexed by a stream; a second stream brings those that are to go."""
    from quillgraph.streaming.ingest import delete_stream, index_stream
    from quillgraph.streaming.ingest import passages as arriving

    root = shared_dir(spark, "streams")
    rows = passages(spark, sf_dir).select("content")
    rows.write.parquet(f"{root}/in")
    rows.where(F.length("content") % 4 == 0).write.parquet(f"{root}/gone")
    store = VectorStore(spark, root, "chunk")
    index_stream(arriving(spark, f"{root}/in"), store.insert, f"{root}/c1").awaitTermination()
    delete_stream(arriving(spark, f"{root}/gone"), lambda gone: store.delete(store.id_of(gone).select("hash_id")), f"{root}/c2").awaitTermination()
    return store.texts()


class FailsFirst:
    """A service that fails at the first request of each prompt."""

    def __init__(self) -> None:
        self.seen: set[str] = set()

    def __call__(self, messages: list[dict[str, str]]) -> tuple[str, dict]:
        said = messages[-1]["content"]
        if said not in self.seen:
            self.seen.add(said)
            raise RuntimeError("busy")
        return said + "!", {}


@query("SELECT item_id AS query_id, 'ok' AS status, text || '!' AS response FROM benchmark")
def retried_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = openie.generate(questions(spark, sf_dir), lambda r: [{"role": "user", "content": r["question"]}], FailsFirst(), "query_id", attempts=2, wait_s=0.0)
    return got.select("query_id", "status", "response")


@query(f"""WITH {_RAW}, e AS (SELECT chunk_id, count(DISTINCT x) AS n FROM (SELECT chunk_id, unnest([s, o]) AS x FROM said) GROUP BY chunk_id), t AS (SELECT chunk_id, count(*) AS n FROM said GROUP BY chunk_id)
    SELECT chunk_id, CASE WHEN length(content) % 5 = 0 THEN 1 ELSE coalesce(e.n, 0) END AS n_entities, CASE WHEN length(content) % 5 = 0 THEN 1 ELSE coalesce(t.n, 0) END AS n_triples FROM passages LEFT JOIN e USING (chunk_id) LEFT JOIN t USING (chunk_id)""")
def structure_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and triples written into the chunks of a structure; a part of them has some already and keeps them."""
    done = F.length("content") % 5 == 0
    some = lambda made, kind: F.when(done, made).otherwise(F.array().cast(kind))
    rows = passages(spark, sf_dir).select("chunk_id", F.when(done, "").otherwise(F.col("content")).alias("filter_content"), some(F.array(F.lit("e")), "array<string>").alias("extracted_entities"), some(F.array(F.array(*map(F.lit, "abc"))), "array<array<string>>").alias("extracted_triples"))
    got = enrich.extract(rows, openie.Sentences())
    return got.select("chunk_id", F.size("extracted_entities").cast("long").alias("n_entities"), F.size("extracted_triples").cast("long").alias("n_triples"))


@query("SELECT 'doc' || doc_id || '.md' AS name, CASE WHEN doc_id % 2 = 0 THEN '# é ' || lang ELSE '# 文档 ' || doc_id END AS content FROM documents")
def markdown_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of Markdown files, some in UTF-8 and some in GBK, beside files that are none."""
    from pyarrow import fs

    root = shared_dir(spark, "tree")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# é "), "lang")).otherwise(F.concat(F.lit("# 文档 "), F.col("doc_id").cast("string"))).alias("content"))

    def write(batches):
        store, top = fs.FileSystem.from_uri(root)
        made = set()
        for b in batches:
            for i, content in zip(b["doc_id"], b["content"], strict=True):
                folder = f"{top}/{i % 7}/{i % 3}"
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                for name, data in ((f"doc{i}.md", content.encode("utf-8" if i % 2 == 0 else "gbk")), (f"doc{i}.txt", b"no")):
                    with store.open_output_stream(f"{folder}/{name}") as out:
                        out.write(data)
            yield b[["doc_id"]]

    rows.mapInPandas(write, "doc_id long").count()
    return files.markdown(spark, root).select(F.substring_index("path", "/", -1).alias("name"), "content")
