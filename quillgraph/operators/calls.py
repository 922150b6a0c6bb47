"""Calls of models: a log of different prompts, worked off by tasks in batches, each of which is kept as soon as it is answered.

Prompts are dealt out by their number, not by their bytes, so that every core has calls to wait for. A task takes its prompts in batches
that a number of prompts and of tokens bound. A model for one prompt at a time gets a batch's prompts side by side from a pool of threads; one for
many gets the batch in one call, and its prompts come in the order of their lengths, so a batch has little padding.

The answers to batches that follow each other within KEEP_S seconds are one Parquet file in the journal, moved to its name when it is whole, so files grow with
the time that calls take and not with the batches. A task that runs again finds the files of what it did; and a run that breaks off leaves them to the next one, which
asks for the rest alone. Only a process that is killed loses answers: those of its last KEEP_S seconds and of the batch under way.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import cache_key
from quillgraph.schemas import CACHE
from quillgraph.sources.shared import once, shared_dir
from quillgraph.sources.state import State

ANSWERS = pa.schema([("key", pa.string()), ("message", pa.string()), ("prompt_tokens", pa.int64()), ("completion_tokens", pa.int64()), ("cache_hit", pa.bool_()), ("status", pa.string())])
#: How long, and how many, answers wait for others of their task before they are written: a slow model has a file for each batch, a fast one for many.
KEEP_S, KEEP_ROWS = 2.0, 10_000
JOURNAL = "key string, message string, prompt_tokens long, completion_tokens long, cache_hit boolean, status string"


class Generator(Protocol):
    """A language model: messages (role, content) in, (text, metadata) out. It runs in Python tasks, so it has to pickle; threads share it."""

    def __call__(self, messages: list[dict[str, str]]) -> tuple[str, dict]: ...


class BatchGenerator(Protocol):
    """A model that takes many conversations at once, as offline models do. json_schema: what its answers are to follow, if anything."""

    def batch(self, many: list[list[dict[str, str]]], json_schema: dict | None = None) -> list[tuple[str, dict]]: ...


def fits(value: Any, schema: dict) -> bool:
    """Whether a JSON value follows a schema of types, properties, required ones, items and their least and largest number, and choices."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "number": (int, float), "integer": int, "null": type(None)}
    kind = schema.get("type")
    if kind and (not isinstance(value, kinds[kind]) or isinstance(value, bool) and kind in ("number", "integer")):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, dict):
        inner = schema.get("properties", {})
        return all(k in value for k in schema.get("required", ())) and all(fits(v, inner[k]) for k, v in value.items() if k in inner)
    if isinstance(value, list):
        return schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)) and all(fits(v, schema.get("items", {})) for v in value)
    return True


def follows(text: str | None, schema: dict | None) -> bool:
    if schema is None:
        return True
    try:
        return fits(json.loads(text or ""), schema)
    except ValueError:
        return False


class ResponseCache:
    """Answers by a hash of messages, model, seed and temperature, a table of a state and the journals beside it. A key that it holds keeps its answer."""

    def __init__(self, state: State, model: str = "replay", seed: int = 0, temperature: float = 0.0, stale_s: float = 86_400.0):
        self.state, self.model, self.seed, self.temperature, self.stale_s = state, model, seed, temperature, stale_s

    def key(self, messages: Column) -> Column:
        return cache_key(messages=messages, model=F.lit(self.model), seed=F.lit(self.seed), temperature=F.lit(self.temperature))

    def _journals(self) -> list:
        files, top = self.state._fs(), self.state._path("journal")
        return list(files.listStatus(top)) if files.exists(top) else []

    def load(self) -> DataFrame:
        return self._answers(self._journals())

    def _answers(self, journals: list) -> DataFrame:
        """The table's answers and those of journals, which were listed before: what is moved meanwhile is in either."""
        rows = self.state.read("responses", CACHE)
        for folder in journals:
            rows = rows.unionByName(_kept(self.state.spark, folder.getPath().toString()))
        return rows.dropDuplicates(["key"])

    def _read(self, journals: list, work: Callable[[list], Any]) -> Any:
        """What work does with journals; again with those that are left, where another run has moved one meanwhile."""
        while True:
            try:
                return work(journals)
            except Exception:
                left = [f for f in journals if self.state._fs().exists(f.getPath())]
                if len(left) == len(journals):
                    raise
                journals = left

    def known(self, keys: DataFrame) -> DataFrame:
        """The answers to keys (_k, the bytes of a key), computed now."""
        return self._read(self._journals(), lambda journals: once(self._answers(journals).withColumn("_k", _bytes("key")).join(keys, "_k", "left_semi").drop("_k"), "hits"))

    def journal(self) -> str:
        """The folder of a new run."""
        return f"{self.state.root}/journal/{uuid.uuid4().hex}"

    def adopt(self, run: str) -> None:
        """Move the answers of a run that ended, and of runs that have been silent for ``stale_s`` seconds, into the table."""
        limit = (time.time() - self.stale_s) * 1000
        done = [f for f in self._journals() if f.getPath().getName() == run.rpartition("/")[2] or f.getModificationTime() < limit]
        self._read(done, self._moved)

    def _moved(self, journals: list) -> None:
        rows = None
        for folder in journals:
            some = _kept(self.state.spark, folder.getPath().toString())
            rows = some if rows is None else rows.unionByName(some)
        if rows is not None:
            self.add(rows.dropDuplicates(["key"]))
            for folder in journals:
                self.state._fs().delete(folder.getPath(), True)

    def add(self, answers: DataFrame) -> None:
        if answers.limit(1).count():
            self.state.change(add={"responses": answers.select("key", "message", "metadata")})


def _kept(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema(JOURNAL).parquet(folder).where("status = 'ok'")
    return rows.select("key", "message", F.to_json(F.struct("prompt_tokens", "completion_tokens")).alias("metadata"))


def width(spark: SparkSession) -> int:
    """Tasks over which calls are spread, however few rows there are: as many as the cluster runs at once, or shuffles into."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt out evenly by their number, for work that waits for a service."""
    return rows.repartition(width(rows.sparkSession))


def _tokens(messages: str) -> int:
    return -(-len(messages) // 4)


def batches_of(rows: Iterator[tuple[str, str]], most: int, budget: int | None) -> Iterator[list[tuple[str, str]]]:
    """Rows (key, messages) in their order, in batches of up to ``most`` prompts and ``budget`` tokens of about four characters; a prompt over the budget is a batch of its own."""
    held, tokens = [], 0
    for key, messages in rows:
        n = _tokens(messages)
        if held and (len(held) >= most or budget is not None and tokens + n > budget):
            yield held
            held, tokens = [], 0
        held.append((key, messages))
        tokens += n
    if held:
        yield held


class Journal:
    """The answers of a task, in files for batches that follow each other. ``done``: batches that an earlier run of the task has written."""

    def __init__(self, folder: str, part: int):
        self.store, self.top = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.top, recursive=True)
        self.part, self.done = f"{part:06d}", set()
        for info in self.store.get_file_info(fs.FileSelector(self.top)):
            name = info.base_name.removesuffix(".parquet").split("-")
            if name[0] == self.part and "part" not in name:
                self.done.update(range(int(name[1]), int(name[2]) + 1))
        self._clear()

    def _clear(self) -> None:
        self.rows: list[dict] = []
        self.batches: list[int] = []
        self.whole, self.since = 0, 0.0

    def begin(self) -> None:
        """A batch is asked: from here on its answers take time."""
        self.since = self.since or time.monotonic()

    def note(self, answer: dict) -> None:
        self.begin()
        self.rows.append(answer)

    def end(self, number: int) -> None:
        """All answers of a batch have come."""
        if self.batches and number != self.batches[-1] + 1:  # a file's batches follow each other
            rest = self.rows[self.whole :]
            del self.rows[self.whole :]
            self.keep()
            self.rows, self.since = rest, time.monotonic()
        self.batches.append(number)
        self.whole = len(self.rows)
        if len(self.rows) >= KEEP_ROWS or time.monotonic() - self.since >= KEEP_S:
            self.keep()

    def keep(self) -> None:
        """Write what has come; of a batch that broke off too, under a name that does not stand for the whole."""
        if self.whole:
            self._write(self.rows[: self.whole], f"{self.part}-{self.batches[0]:06d}-{self.batches[-1]:06d}")
        if self.rows[self.whole :]:
            self._write(self.rows[self.whole :], f"{self.part}-part-{uuid.uuid4().hex}")
        self._clear()

    def _write(self, rows: list[dict], name: str) -> None:
        made = f"{self.top}/_{uuid.uuid4().hex}"
        with self.store.open_output_stream(made) as f:
            pq.write_table(pa.Table.from_pylist(rows, ANSWERS), f)
        self.store.move(made, f"{self.top}/{name}.parquet")


class Worker:
    """What a task does with its prompts."""

    def __init__(self, model: Generator | BatchGenerator, folder: str, *, attempts: int, wait_s: float, json_schema: dict | None, batch: int, budget: int | None, pool: int):
        self.model, self.folder, self.attempts, self.wait_s, self.json_schema, self.batch, self.budget, self.pool = model, folder, attempts, wait_s, json_schema, batch, budget, pool

    def _tried(self, call: Callable[[], Any]) -> tuple[Any, str]:
        status = "ok"
        for turn in range(self.attempts):
            try:
                return call(), "ok"
            except Exception as e:  # a service's faults are of any kind; the status column reports them
                status = f"{type(e).__name__}: {e}"
                if turn + 1 < self.attempts:
                    time.sleep(self.wait_s)
        return None, status

    def _together(self, prompts: list) -> list[tuple[Any, str]]:
        """One call; then another for those whose answers break the schema, as often as there are attempts."""
        out: list[tuple[Any, str]] = [(None, "unanswered")] * len(prompts)
        left = list(range(len(prompts)))
        for _ in range(self.attempts if self.json_schema else 1):
            got, status = self._tried(lambda left=left: self.model.batch([prompts[i] for i in left], self.json_schema))
            for i, x in zip(left, got or [None] * len(left), strict=True):
                good = x is not None and follows(x[0], self.json_schema)
                out[i] = (x, "ok") if good else (None, status if x is None else "SchemaError: the answer does not follow the schema")
            left = [i for i in left if out[i][1].startswith("SchemaError")]
            if not left:
                break
        return out

    def _answers(self, rows: list[tuple[str, str]], threads: ThreadPoolExecutor) -> Iterator[tuple[str, tuple[Any, str]]]:
        """Answers as they come; what was asked before a fault that is no fault of the service ends the task is still handed out."""
        prompts = [json.loads(m) for _, m in rows]
        if hasattr(self.model, "batch"):
            yield from zip([k for k, _ in rows], self._together(prompts), strict=True)
            return
        asked = [threads.submit(self._tried, lambda m=m: self.model(m)) for m in prompts]
        fault = None
        for (key, _), future in zip(rows, asked, strict=True):
            try:
                yield key, future.result()
            except BaseException as e:
                fault = fault or e
                for other in asked:
                    other.cancel()
        if fault:
            raise fault

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        journal = Journal(self.folder, TaskContext.get().partitionId())
        rows = ((k, m) for b in batches for k, m in zip(b.column("key").to_pylist(), b.column("messages").to_pylist(), strict=True))
        with ThreadPoolExecutor(max(1, self.pool)) as threads:
            try:
                for number, some in enumerate(batches_of(rows, self.batch, self.budget)):
                    if number not in journal.done:
                        journal.begin()
                        for key, (answer, status) in self._answers(some, threads):
                            text, meta = answer if answer else (None, {})
                            journal.note({"key": key, "message": text, "prompt_tokens": int(meta.get("prompt_tokens") or 0), "completion_tokens": int(meta.get("completion_tokens") or 0), "cache_hit": bool(meta.get("cache_hit", False)), "status": status})
                        journal.end(number)
                    yield pa.RecordBatch.from_pydict({"n": pa.array([len(some)], pa.int64())})
            finally:
                journal.keep()


def _bytes(key: str) -> Column:
    """A key, which is 64 hex digits, in its 32 bytes."""
    return F.unhex(key).alias(key)


def _different(rows: DataFrame) -> bool:
    """Whether no key of rows repeats; keys alone are shuffled."""
    return not rows.groupBy(_bytes("key")).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()


def generate(rows: DataFrame, messages: Callable[[dict], list[dict[str, str]]], model: Generator | BatchGenerator, key: str, *, attempts: int = 2, wait_s: float = 1.0, cache: ResponseCache | None = None, json_schema: dict | None = None, batch: int = 200, budget: int | None = None, pool: int = 8) -> DataFrame:
    """(key, response, prompt_tokens, completion_tokens, cache_hit, status): the model's answer for each row.

    The model is called now, once for each different prompt, and the answers are read from the shared folder from here on, however often they are
    used. With a cache only prompts that it lacks are sent, and answers are in it within KEEP_S seconds or with their batch. A row whose attempts all
    fail has a null response and the error as its status; it does not fail the job. At most ``pool`` requests of a task are under way at
    once. A model with ``batch`` gets up to ``batch`` prompts of up to ``budget`` tokens at a call; its answers are held against the schema.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"row": b[key], "messages": [json.dumps(messages(r), ensure_ascii=False) for r in b.to_dict("records")]})

    named = cache.key if cache else lambda m: F.sha2(m, 256)
    written = rows.mapInPandas(write, f"row {kind}, messages string").withColumn("key", named(F.col("messages")))
    log = once(written, "prompts")
    keys = log.select(_bytes("key"))
    # prompts that are all different are dealt out from where they are written
    alone = _different(log)
    todo = log.select("key", "messages") if alone else once(log.select("key", "messages").dropDuplicates(["key"]), "todo")
    hits = None
    if cache:
        known = cache.known(keys.distinct().withColumnRenamed("key", "_k"))
        if known.limit(1).count():
            todo = once(todo.withColumn("_k", _bytes("key")).join(known.select(_bytes("key").alias("_k")), "_k", "left_anti").drop("_k"), "todo")
        meta = [F.coalesce(F.get_json_object("metadata", f"$.{c}").cast("long"), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens")]
        hits = known.select("key", "message", *meta, F.lit(True).alias("cache_hit"), F.lit("ok").alias("status"))
    n, run = todo.count(), cache.journal() if cache else shared_dir(spark, "journal")
    if n:
        tasks = min(n, width(spark))
        work = Worker(model, run, attempts=attempts, wait_s=wait_s, json_schema=json_schema, batch=max(1, min(batch, -(-n // tasks))), budget=budget, pool=pool)
        if hasattr(model, "batch"):
            dealt = todo.repartitionByRange(tasks, F.length("messages"), "key").sortWithinPartitions(F.length("messages"), "key")
        else:
            dealt = todo.repartition(tasks).sortWithinPartitions("key")
        dealt.select("key", "messages").mapInArrow(work, "n long").write.format("noop").mode("overwrite").save()
        # a task that ran again may have left a part and the whole of a batch: a good answer first, then any
        best = F.min_by(F.struct("message", "prompt_tokens", "completion_tokens", "cache_hit", "status"), F.struct(F.col("status") != "ok", "message"))
        new = once(spark.read.schema(JOURNAL).parquet(run), "answers")  # of many small files, once
        if not _different(new):
            new = once(new.groupBy("key").agg(best.alias("a")).select("key", "a.*"), "answers")
        if cache:
            cache.adopt(run)
        hits = new if hits is None else new.unionByName(hits)
    elif hits is None:
        hits = spark.createDataFrame([], JOURNAL)
    return log.select("row", _bytes("key")).join(hits.withColumn("key", _bytes("key")), "key").select(F.col("row").alias(key), F.col("message").alias("response"), "prompt_tokens", "completion_tokens", "cache_hit", "status")
