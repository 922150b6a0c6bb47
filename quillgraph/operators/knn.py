"""Exact nearest neighbours in blocks: numpy products in Arrow batches, the best k of each block, then of all blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.topk import top_k
from quillgraph.sources.shared import once, shared_dir

#: Queries scored at once, so a batch of keys never meets all of a large query set in one matrix; bytes of vectors that go to every task.
SLICE, BROADCAST_BYTES = 512, 64 << 20
#: Pairs that are handed on at once where all are wanted.
PAIRS = 1 << 20
#: Scores, and copies of queries, that are in memory at once.
SCORES, SENT = 1 << 22, 16_384


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=m.copy(), where=size > 0)


def _matrix(col, cosine: bool) -> np.ndarray:
    m = np.array([np.asarray(x, np.float64) for x in col])
    return _unit(m) if cosine and len(m) else m


def _best(qid: np.ndarray, q: np.ndarray, kid: np.ndarray, keys: np.ndarray, k: int, least: float | None, bounds: bool = False) -> pd.DataFrame:
    """Of each query the k best keys by (score, smaller id), and no more however many are tied; with ``bounds`` also a row without a key with its least and largest score."""
    order = np.argsort(kid, kind="stable")
    kid, keys = kid[order], keys[order]
    out, step = [], max(1, min(SLICE, SCORES // max(1, len(kid))))
    for first in range(0, len(q), step):
        scores = q[first : first + step] @ keys.T
        low = np.full((len(scores), 1), -np.inf if least is None else least)
        if k < len(kid):
            low = np.maximum(low, np.partition(scores, len(kid) - k, axis=1)[:, len(kid) - k, None])
        r, c = np.nonzero(scores >= low)
        by = np.lexsort((c, -scores[r, c], r))
        r, c = r[by], c[by]
        few = np.arange(len(r)) - np.searchsorted(r, r) < k
        found = pd.DataFrame({"query_id": qid[first + r[few]], "key_id": kid[c[few]], "score": scores[r[few], c[few]]})
        if bounds:
            ends = pd.DataFrame({"query_id": qid[first : first + step], "key_id": None, "score": np.nan, "low": scores.min(axis=1), "high": scores.max(axis=1)})
            found = pd.concat([found.assign(low=np.nan, high=np.nan).astype({"key_id": object}), ends.astype({"key_id": object})])
        out.append(found)
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "key_id": [], "score": []} | ({"low": [], "high": []} if bounds else {}))


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.where("embedding is not null").select("id", "embedding")


def _few(queries: DataFrame, broadcast_rows: int) -> bool:
    """Whether the queries' rows and bytes are within the bounds of what goes to every task."""
    size = queries.limit(broadcast_rows + 1).agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")).first()
    return size["n"] <= broadcast_rows and size["n"] * (size["dims"] or 0) * 8 <= BROADCAST_BYTES


def _told(queries: DataFrame, broadcast_rows: int) -> pd.DataFrame | None:
    return queries.toPandas() if _few(queries, broadcast_rows) else None


def _in_blocks(queries: DataFrame, keys: DataFrame, work: Callable[..., pd.DataFrame], schema: str, cosine: bool, block: int, broadcast_rows: int, pairs: int | None = None) -> DataFrame:
    """What work(query ids, queries, key ids, keys) makes of every query and every key.

    Few queries go to all tasks, whose keys they meet batch by batch, with ``pairs`` in parts of so many pairs. More are dealt out in a grid of blocks of about ``block`` rows of either side.
    """
    few = _told(queries, broadcast_rows)
    if few is not None:
        step = max(1, pairs // max(1, len(few))) if pairs else None
        told = queries.sparkSession.sparkContext.broadcast((few["id"].to_numpy(), _matrix(few["embedding"], cosine)))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qid, q = told.value
            for b in batches:
                if len(b) and len(q):
                    for first in range(0, len(b), step or len(b)):
                        part = b.iloc[first : first + (step or len(b))]
                        yield work(qid, q, part["id"].to_numpy(), _matrix(part["embedding"], cosine))

        return keys.mapInPandas(scan, schema)
    across, down = -(-queries.count() // block), max(1, -(-keys.count() // block))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(across))).withColumn("kb", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("kb", F.col("kb").cast("long"))
    r = keys.withColumn("kb", F.pmod(F.xxhash64("id"), F.lit(down))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).withColumn("qb", F.col("qb").cast("long"))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in schema.split(", ")})  # of any kind of id
        return work(a["id"].to_numpy(), _matrix(a["embedding"], cosine), b["id"].to_numpy(), _matrix(b["embedding"], cosine))

    return q.groupBy("qb", "kb").cogroup(r.groupBy("qb", "kb")).applyInPandas(pair, schema)


def knn(queries: DataFrame, keys: DataFrame, k: int, *, cosine: bool = True, least: float | None = None, block: int = 4096, broadcast_rows: int = 20_000) -> DataFrame:
    """(query_id, key_id, score, rank) of the k best keys of each query; both sides are (id, embedding).

    Every query meets every key: few queries go to all tasks; of many a task holds a block with its best so far, and reads the keys file by file, so neither vectors nor
    pairs are shuffled with the number of blocks. See near() for what a threshold saves. Ties over k go to the smaller id; null vectors have no neighbours.
    """
    schema = f"query_id {queries.schema['id'].dataType.simpleString()}, key_id {keys.schema['id'].dataType.simpleString()}, score double"
    queries, keys = _vectors(queries), _vectors(keys)
    if _few(queries, broadcast_rows):
        work = lambda qid, q, kid, m: _best(qid, q, kid, m, k, least)
        return top_k(_in_blocks(queries, keys, work, schema, cosine, block, broadcast_rows), k, ["query_id"], "score", "key_id")
    return _streamed(queries, keys, k, least, cosine, block, f"{schema}, rank int")


def _kept(qid: np.ndarray, kid: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the k best keys of each query number by (score, smaller id), in order, and their places from 0."""
    by = np.lexsort((kid, -score, qid)) if kid.dtype != object else np.lexsort((np.unique(kid, return_inverse=True)[1], -score, qid))
    qid, kid, score = qid[by], kid[by], score[by]
    place = np.arange(len(qid)) - np.searchsorted(qid, qid)
    some = place < k
    return qid[some], kid[some], score[some], place[some]


def _streamed(queries: DataFrame, keys: DataFrame, k: int, least: float | None, cosine: bool, block: int, schema: str) -> DataFrame:
    """The k best keys of many queries. Keys are written once; a task takes its queries in blocks and reads the keys for each, holding of each block the best alone."""
    spark = queries.sparkSession
    folder = shared_dir(spark, "keys")
    keys.write.option("compression", "zstd").parquet(folder)
    n = queries.count()
    parts = max(-(-n // block), min(n, 2 * spark.sparkContext.defaultParallelism))

    def meet(qid: np.ndarray, q: np.ndarray) -> pd.DataFrame:
        store, top = fs.FileSystem.from_uri(folder)
        held, size = [], 0
        floor = np.full(len(q), -np.inf if least is None else least)
        for info in sorted(store.get_file_info(fs.FileSelector(top)), key=lambda x: x.path):
            if not info.path.endswith(".parquet"):
                continue
            with store.open_input_file(info.path) as f:
                for b in pq.ParquetFile(f).iter_batches(batch_size=2048):
                    kid, m = b.column("id").to_pandas().to_numpy(), _matrix(b.column("embedding").to_pandas(), cosine)
                    for first in range(0, len(q), SLICE):
                        scores = q[first : first + SLICE] @ m.T
                        r, c = np.nonzero(scores >= floor[first : first + SLICE, None])
                        held.append((first + r, kid[c], scores[r, c]))
                        size += len(r)
                    if size > SCORES and size > 2 * sum(len(x[0]) for x in held[:1]):
                        *best, place = _kept(*(np.concatenate(x) for x in zip(*held)), k)
                        floor[best[0][place == k - 1]] = best[2][place == k - 1]
                        held, size = [tuple(best)], len(place)
        row, kid, score, place = _kept(*(np.concatenate(x) for x in zip(*held)), k) if held else (np.zeros(0, int),) * 4
        return pd.DataFrame({"query_id": qid[row], "key_id": kid, "score": score, "rank": (place + 1).astype(np.int32)})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first in range(0, len(b), block):
                part = b.iloc[first : first + block]
                yield meet(part["id"].to_numpy(), _matrix(part["embedding"], cosine))

    return queries.repartition(parts, "id").mapInPandas(scan, schema)


class Cells:
    """Keys by the nearest of some pivots, and what the triangle inequality leaves of their comparisons with queries.

    The angle between two directions is a metric. A query whose angle to a cell's pivot is outside the angles of the cell's keys, by more than the angle of
    the threshold, has no neighbour there. Pivots are a bounded sample; any pivots give exact results, better ones leave less.
    """

    def __init__(self, keys: DataFrame, least: float, pivots: int = 256):
        if not 0 < least <= 1:
            raise ValueError("a threshold over 0 is needed: below it every pair is near")
        self.least, self.keys = least, _vectors(keys)
        some = self.keys.orderBy(F.xxhash64("id"), "id").limit(pivots).toPandas()
        m = _matrix(some["embedding"], True)
        self.pivots = m[np.linalg.norm(m, axis=1) > 0] if len(m) else m
        held = self.pivots
        kind = keys.schema["id"].dataType.simpleString()

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                v = _matrix(b["embedding"], True)
                some = np.flatnonzero(np.linalg.norm(v, axis=1) > 0) if len(v) else np.zeros(0, int)  # a vector of zeros is near to none
                if len(some):
                    a = np.arccos(np.clip(v[some] @ held.T, -1, 1))
                    yield pd.DataFrame({"id": b["id"].to_numpy()[some], "embedding": list(v[some]), "cell": a.argmin(axis=1), "angle": a.min(axis=1)})

        placed = self.keys.mapInPandas(place, f"id {kind}, embedding array<double>, cell int, angle double") if len(held) else self.keys.sparkSession.createDataFrame([], f"id {kind}, embedding array<double>, cell int, angle double")
        self.placed = once(placed, "cells")
        rows = self.placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi")).collect()  # a row for each pivot
        self.n, self.lo, self.hi = np.zeros(len(held), np.int64), np.full(len(held), np.inf), np.full(len(held), -np.inf)
        for cell, n, lo, hi in rows:
            self.n[cell], self.lo[cell], self.hi[cell] = n, lo, hi

    def routes(self, queries: DataFrame, emit: Callable, schema: str) -> DataFrame:
        """What emit(ids, unit vectors, row, cell) makes of the cells that each query has to be compared with."""
        held, reach, lo, hi = self.pivots, np.arccos(self.least) + 1e-6, self.lo, self.hi

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                v = _matrix(b["embedding"], True)
                if len(v) and len(held):
                    for first in range(0, len(v), SLICE):
                        part = v[first : first + SLICE]
                        a = np.arccos(np.clip(part @ held.T, -1, 1))
                        row, cell = np.nonzero((a >= lo - reach) & (a <= hi + reach) & (np.linalg.norm(part, axis=1) > 0)[:, None])
                        for at in range(0, len(row), SENT):
                            yield emit(b["id"].to_numpy()[first : first + SLICE], part, row[at : at + SENT], cell[at : at + SENT])

        return queries.mapInPandas(run, schema)

    def work(self, queries: DataFrame) -> DataFrame:
        """(cell, keys, queries): what near() compares."""
        held = self.n

        def count(ids, v, row, cell):
            cells, n = np.unique(cell, return_counts=True)
            return pd.DataFrame({"cell": cells, "keys": held[cells], "queries": n})

        return self.routes(_vectors(queries), count, "cell int, keys long, queries long").groupBy("cell", "keys").agg(F.sum("queries").alias("queries"))


def near(queries: DataFrame, keys: DataFrame, k: int, least: float, *, block: int = 4096, pivots: int = 256, cells: Cells | None = None) -> DataFrame:
    """(query_id, key_id, score, rank): of each query the k best keys with a cosine of ``least`` and more; both sides are (id, embedding).

    The same rows as knn gives, but a query goes only to the cells that may hold such keys; see Cells. A cell of many keys, or of many queries, is dealt out in blocks.
    Ties over k go to the smaller id; null vectors and vectors of zeros have no neighbours.
    """
    queries, found = _vectors(queries), cells or Cells(keys, least, pivots)
    asked = {r["cell"]: r["queries"] for r in found.work(queries).collect()}  # a row for each pivot
    down = np.maximum(1, -(-found.n // block))
    across = np.array([max(1, -(-asked.get(c, 0) // block)) for c in range(len(found.n))], np.int64)
    ask, key = queries.schema["id"].dataType.simpleString(), found.placed.schema["id"].dataType.simpleString()

    def sent(ids, v, row, cell):
        times = down[cell]
        row, cell, part = np.repeat(row, times), np.repeat(cell, times), np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        mine = pd.util.hash_array(np.asarray(ids).astype(str)).astype(np.uint64)[row] % across[cell].astype(np.uint64)
        return pd.DataFrame({"id": ids[row], "embedding": list(v[row]), "cell": cell, "part": part, "ask": mine.astype(np.int64)})

    q = found.routes(queries, sent, f"id {ask}, embedding array<double>, cell int, part long, ask long")
    sizes = queries.sparkSession.createDataFrame([(int(c), int(down[c]), int(across[c])) for c in asked], "cell int, down long, across long")  # a row for each pivot
    r = found.placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("down"))).withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)))
    schema = f"query_id {ask}, key_id {key}, score double"

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("query_id", "key_id", "score")})  # of any kind of id
        return _best(a["id"].to_numpy(), _matrix(a["embedding"], False), b["id"].to_numpy(), _matrix(b["embedding"], False), k, least)

    by = ("cell", "part", "ask")
    pairs = q.groupBy(*by).cogroup(r.select("id", "embedding", *by).groupBy(*by)).applyInPandas(pair, schema)
    return top_k(pairs, k, ["query_id"], "score", "key_id")


def bounds(queries: DataFrame, keys: DataFrame, *, block: int = 4096, broadcast_rows: int = 20_000) -> DataFrame:
    """(query_id, low, high): the least and the largest inner product of each query with any key."""
    kinds = f"query_id {queries.schema['id'].dataType.simpleString()}, low double, high double"

    def ends(qid: np.ndarray, q: np.ndarray, kid: np.ndarray, m: np.ndarray) -> pd.DataFrame:
        pairs = [(s.min(axis=1), s.max(axis=1)) for s in (q[i : i + SLICE] @ m.T for i in range(0, len(q), SLICE))]
        return pd.DataFrame({"query_id": qid, "low": np.concatenate([p[0] for p in pairs]), "high": np.concatenate([p[1] for p in pairs])})

    found = _in_blocks(_vectors(queries), _vectors(keys), ends, kinds, False, block, broadcast_rows)
    return found.groupBy("query_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def scaled_top_k(queries: DataFrame, keys: DataFrame, k: int, *, block: int = 4096, broadcast_rows: int = 20_000) -> DataFrame:
    """(query_id, key_id, score, rank): the k best keys of each query by inner product, their scores on the scale from the least to the largest of all keys' (1 if all are the same).

    Each block of keys gives a query's k best and its bounds, so no row stands for each pair, however many queries there are.
    """
    queries, keys = _vectors(queries), _vectors(keys)
    kinds = f"query_id {queries.schema['id'].dataType.simpleString()}, key_id {keys.schema['id'].dataType.simpleString()}, score double, low double, high double"
    found = once(_in_blocks(queries, keys, lambda qid, q, kid, m: _best(qid, q, kid, m, k, None, bounds=True), kinds, False, block, broadcast_rows), "scaled")
    bounds = found.where("key_id is null").groupBy("query_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    best = top_k(found.where("key_id is not null").select("query_id", "key_id", "score"), k, ["query_id"], "score", "key_id")
    scaled = F.when(F.col("high") == F.col("low"), 1.0).otherwise((F.col("score") - F.col("low")) / (F.col("high") - F.col("low")))
    return best.join(bounds, "query_id").select("query_id", "key_id", scaled.alias("score"), "rank")


def all_scores(queries: DataFrame, keys: DataFrame, *, broadcast_rows: int = 20_000) -> DataFrame:
    """(query_id, key_id, score) of every pair, for query sets that are compared as a whole. Inner products, not normalised; pairs are made block by block."""
    schema = f"query_id {queries.schema['id'].dataType.simpleString()}, key_id {keys.schema['id'].dataType.simpleString()}, score double"

    def score(qid, q, kid, m):
        s = q @ m.T
        return pd.DataFrame({"query_id": np.repeat(qid, len(kid)), "key_id": np.tile(kid, len(qid)), "score": s.ravel()})

    return _in_blocks(_vectors(queries), _vectors(keys), score, schema, False, 1024, broadcast_rows, PAIRS)


def scaled_scores(queries: DataFrame, keys: DataFrame, *, block: int = SLICE) -> DataFrame:
    """(query_id, key_id, score) of every pair: inner products on the scale from the least to the largest of the query's, 1 if all are the same.

    Keys are written once; a task takes its queries in blocks and reads the keys for each twice, for the bounds and for the scores, so no pair is shuffled or kept.
    """
    schema = f"query_id {queries.schema['id'].dataType.simpleString()}, key_id {keys.schema['id'].dataType.simpleString()}, score double"
    queries, spark = _vectors(queries), queries.sparkSession
    folder = shared_dir(spark, "keys")
    _vectors(keys).write.option("compression", "zstd").parquet(folder)
    n = queries.count()
    parts = max(1, -(-n // block), min(n, 2 * spark.sparkContext.defaultParallelism))

    def read() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        store, top = fs.FileSystem.from_uri(folder)
        for info in sorted(store.get_file_info(fs.FileSelector(top)), key=lambda x: x.path):
            if info.path.endswith(".parquet"):
                with store.open_input_file(info.path) as f:
                    for b in pq.ParquetFile(f).iter_batches(batch_size=max(1, PAIRS // block)):
                        yield b.column("id").to_pandas().to_numpy(), _matrix(b.column("embedding").to_pandas(), False)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first in range(0, len(b), block):
                part = b.iloc[first : first + block]
                qid, q = part["id"].to_numpy(), _matrix(part["embedding"], False)
                low, high = np.full(len(q), np.inf), np.full(len(q), -np.inf)
                for _, m in read():
                    s = q @ m.T
                    low, high = np.minimum(low, s.min(axis=1)), np.maximum(high, s.max(axis=1))
                span = (high - low)[:, None]
                for kid, m in read():
                    s = q @ m.T
                    s = np.divide(s - low[:, None], span, out=np.ones_like(s), where=span > 0)
                    yield pd.DataFrame({"query_id": np.repeat(qid, len(kid)), "key_id": np.tile(kid, len(qid)), "score": s.ravel()})

    return queries.repartition(parts, "id").mapInPandas(scan, schema)
