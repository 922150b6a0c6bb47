"""An approximate index of vectors: lists around centroids, a short code for each vector's rest, the best by code ranked again exactly.

Directions alone count (cosine). A vector belongs to the list of its nearest centroid; what is left of it is cut into parts, and of each part the number of the
nearest entry of a codebook is kept, a byte. A search reads the codes of some lists only, which are partitions of the table, and the vectors of the best by code.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.knn import SLICE, _best, _matrix, _told, _vectors
from quillgraph.operators.topk import top_k
from quillgraph.sources.shared import once, remove, written

#: Vectors that centroids and codebooks are fitted on, and those of them that stand for queries when the number of lists to read is set.
SAMPLE, ASKED = 8192, 256
#: So many codes are read for each that a task gives.
READ = 64
#: Copies of queries that a task hands on at once, however many lists a query is sent to.
SENT = 16_384


def _nearest(v: np.ndarray, middle: np.ndarray) -> np.ndarray:
    return (v @ middle.T - (middle**2).sum(axis=1) / 2).argmax(axis=1) if len(v) else np.zeros(0, np.int64)


def _means(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centres of the rows of v, which come in random order; a centre that loses all its rows stays where it is."""
    middle = v[:k].copy()
    for _ in range(rounds):
        at = _nearest(v, middle)
        n = np.bincount(at, minlength=len(middle))
        sums = np.zeros_like(middle)
        np.add.at(sums, at, v)
        middle[n > 0] = sums[n > 0] / n[n > 0, None]
    return middle


def _routes(v: np.ndarray, lists: np.ndarray, probes: int) -> np.ndarray:
    return np.argsort(-(v @ lists.T), axis=1, kind="stable")[:, :probes]


def _bytes(codes: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)


class Codes:
    """Centroids and codebooks, with what they make of vectors. Their size is lists + 256 vectors."""

    def __init__(self, lists: np.ndarray, books: list[np.ndarray], probes: int):
        self.lists, self.books, self.probes = lists, books, probes
        self.cuts = np.cumsum([0, *(b.shape[1] for b in books)])

    @classmethod
    def fitted(cls, v: np.ndarray, lists: int, parts: int, recall: float) -> Codes:
        """From unit vectors in random order. probes: so many lists hold ``recall`` of the ten nearest of each vector that asks the others."""
        middle = _means(v, min(lists, len(v)))
        rest = v - middle[_nearest(v, middle)]
        books = [_means(np.ascontiguousarray(x), min(256, len(v))) for x in np.array_split(rest, min(parts, v.shape[1]), axis=1)]
        ask, own = v[:ASKED], _nearest(v, middle)
        score = ask @ v.T
        score[np.arange(len(ask)), np.arange(len(ask))] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, : min(10, len(v) - 1)]
        place = np.argsort(np.argsort(-(ask @ middle.T), axis=1, kind="stable"), axis=1)
        need = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
        return cls(middle, books, int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) + 1 if len(need) else 1)

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = _nearest(v, self.lists)
        rest = v - self.lists[own]
        return own, np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1).astype(np.uint8)

    def decode(self, at: int, code: np.ndarray) -> np.ndarray:
        return self.lists[at] + np.concatenate([book[code[:, j]] for j, book in enumerate(self.books)], axis=1)


class Index:
    """An index in a folder: ``model``, ``codes`` (id, code; partitions by list) and ``vectors`` (id, embedding; partitions by list)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/model").orderBy("kind", "at").collect()  # lists + 256 x parts rows
        kind = lambda x: [np.array(r["x"]) for r in rows if r["kind"] == x]
        lists = kind(-1)
        self.codes = Codes(np.array(lists), [np.array(kind(j)) for j in range(rows[-1]["kind"] + 1)], int(kind(-2)[0][0])) if lists else None

    @classmethod
    def build(cls, vectors: DataFrame, path: str, *, lists: int | None = None, most_lists: int = 4096, parts: int = 16, sample: int = SAMPLE, recall: float = 0.99) -> Index:
        """Index all rows of vectors (id, embedding) in a new folder.

        Centroids and codebooks are fitted on the ``sample`` vectors with the smallest hashes of their ids; every vector is placed. There are as many lists as the root of
        the number of vectors, ``most_lists`` at most, if ``lists`` does not say how many. Null vectors, vectors of zeros and those with null or non-finite entries
        are left out: they are near to none. Rows that repeat an id: one of them stays. An empty table gives an index that finds nothing.
        """
        spark, rows = vectors.sparkSession, _usable(vectors)
        few = rows.select("id").orderBy(F.xxhash64("id"), "id").limit(sample)
        m = _matrix(few.join(rows, "id").orderBy(F.xxhash64("id"), "id").select("embedding").toPandas()["embedding"], True)
        made = Codes.fitted(m, lists or min(most_lists, max(1, int(rows.count() ** 0.5))), parts, recall) if len(m) else None
        held = [(-2, 0, [float(made.probes)])] + [(-1, i, x.tolist()) for i, x in enumerate(made.lists)] + [(j, i, x.tolist()) for j, b in enumerate(made.books) for i, x in enumerate(b)] if made else []
        spark.createDataFrame(held, "kind int, at int, x array<double>").coalesce(1).write.parquet(f"{path.rstrip('/')}/model")
        index = cls(spark, path)
        if made:
            index._append(rows, "0")
        return index

    def _append(self, rows: DataFrame, name: str) -> None:
        """Place rows in the lists: first as they come, then list by list. A list of many rows has several files, so no task writes all of it."""
        told, kind = self.spark.sparkContext.broadcast(self.codes), rows.schema["id"].dataType.simpleString()

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    v = _matrix(b["embedding"], True)
                    own, code = told.value.encode(v)
                    yield pd.DataFrame({"id": b["id"], "list": own.astype(np.int32), "code": [c.tobytes() for c in code], "embedding": list(v)})

        placed = written(rows.mapInPandas(place, f"id {kind}, list int, code binary, embedding array<double>"), f"{self.path}/placed-{name}")
        sizes = placed.groupBy("list").agg(F.count("*").alias("n")).select("list", F.ceil(F.col("n") / 100_000).alias("files"))  # a row for each list
        dealt = placed.join(F.broadcast(sizes), "list").withColumn("file", F.pmod(F.xxhash64("id"), F.col("files"))).repartition("list", "file").sortWithinPartitions("list")
        for table, columns in (("vectors", ("id", "embedding")), ("codes", ("id", "code"))):
            dealt.select("list", *columns).write.mode("append").partitionBy("list").parquet(f"{self.path}/{table}")
        remove(self.spark, f"{self.path}/placed-{name}")

    def _read(self, table: str, lists: list[int]) -> DataFrame:
        """A table's rows of some lists: only their partitions are listed as input."""
        return self.spark.read.parquet(f"{self.path}/{table}").where(F.col("list").isin(lists))

    def add(self, vectors: DataFrame) -> None:
        """Place more rows in the lists there are; ids that the index holds stay as they are."""
        if self.codes is None:
            raise ValueError("the index was built from no vectors, so there are no lists to place rows in")
        held = self.spark.read.parquet(f"{self.path}/vectors").select("id")
        self._append(_usable(vectors).join(held, "id", "left_anti"), uuid.uuid4().hex)

    def _scanned(self, few: pd.DataFrame, told, probes: int, short: int, ask: str) -> DataFrame:
        """Few queries go to all tasks: each reads its codes as they lie, and gives the best of its own lists.

        A task reads many times the codes that it gives for a query, so few codes are not given all by many small tasks.
        """
        qid, q = few["id"].to_numpy(), _matrix(few["embedding"], True)
        reads = np.zeros((len(q), len(self.codes.lists)), bool)
        if len(q):
            np.put_along_axis(reads, _routes(q, self.codes.lists, probes), True, axis=1)
        sent = self.spark.sparkContext.broadcast((qid, q, reads))
        codes = self._read("codes", np.flatnonzero(reads.any(axis=0)).tolist())
        codes = codes.coalesce(max(1, codes.count() // (READ * short)))

        def cut(held: list, floor: np.ndarray) -> list:
            row, ids, score, lists = (np.concatenate(x) for x in zip(*held))
            by = np.lexsort((np.unique(ids, return_inverse=True)[1], -score, row))
            place = np.arange(len(by)) - np.searchsorted(row[by], row[by])
            last, by = by[place == short - 1], by[place < short]
            floor[row[last]] = score[last]
            return [(row[by], ids[by], score[by], lists[by])]

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qid, q, reads = sent.value
            floor, held, size = np.full(len(q), -np.inf), [], 0
            for b in batches:
                for at, some in b.groupby("list"):
                    ids, near = some["id"].to_numpy(), told.value.decode(at, _bytes(some["code"]))
                    rows = np.flatnonzero(reads[:, at])
                    for first in range(0, len(rows), SLICE):
                        part = rows[first : first + SLICE]
                        score = q[part] @ near.T
                        r, c = np.nonzero(score >= floor[part][:, None])
                        held.append((part[r], ids[c], score[r, c], np.full(len(r), at)))
                        size += len(r)
                        if size > 2 * short * len(q) + 1_000_000:
                            held = cut(held, floor)
                            size = len(held[0][0])
            if held:
                row, ids, score, lists = cut(held, floor)[0]
                yield pd.DataFrame({"list": lists, "query_id": qid[row], "key_id": ids, "score": score})

        return codes.mapInPandas(scan, f"list int, query_id {ask}, key_id {codes.schema['id'].dataType.simpleString()}, score double")

    def _dealt(self, queries: DataFrame, told, probes: int, short: int, block: int, ask: str) -> DataFrame:
        """Many queries meet the codes list by list; lists of many rows, and those that many queries ask, in a grid of blocks."""

        def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    v = _matrix(b["embedding"], True)
                    ids, step = b["id"].to_numpy(), max(1, SENT // probes)
                    for first in range(0, len(v), step):
                        part = v[first : first + step]
                        at = _routes(part, told.value.lists, probes)
                        row = np.repeat(np.arange(len(part)), at.shape[1])
                        yield pd.DataFrame({"id": ids[first + row], "list": at.ravel().astype(np.int32), "embedding": list(part[row])})

        q = queries.mapInPandas(routed, f"id {ask}, list int, embedding array<double>")
        asked = {r["list"]: r["n"] for r in q.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row for each list
        codes = self._read("codes", list(asked))
        sizes = {r["list"]: r["n"] for r in codes.groupBy("list").agg(F.count("*").alias("n")).collect()}
        grid = self.spark.createDataFrame([(x, -(-sizes[x] // block), -(-n // 4096)) for x, n in asked.items() if x in sizes], "list int, down long, across long")
        both = lambda rows: rows.join(F.broadcast(grid), "list")  # noqa: E731  lists that hold nothing go
        q = both(q).withColumn("ask", F.pmod(F.xxhash64("id"), F.col("across"))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("down") - 1)))
        c = both(codes).withColumn("part", F.pmod(F.xxhash64("id"), F.col("down"))).withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)))

        def pair(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"list": [], "query_id": [], "key_id": [], "score": []})
            near = told.value.decode(key[0], _bytes(b["code"]))
            return _best(a["id"].to_numpy(), _matrix(a["embedding"], False), b["id"].to_numpy(), near, short, None).assign(list=key[0])

        by = ("list", "part", "ask")
        schema = f"list int, query_id {ask}, key_id {codes.schema['id'].dataType.simpleString()}, score double"
        return q.select("id", "embedding", *by).groupBy(*by).cogroup(c.select("id", "code", *by).groupBy(*by)).applyInPandas(pair, schema)

    def search(self, queries: DataFrame, k: int, *, probes: int | None = None, short: int | None = None, block: int = 65_536, few_queries: int = 4096, broadcast_rows: int = 200_000) -> DataFrame:
        """(query_id, key_id, score, rank): of each query (id, embedding) about the k best keys by cosine, with exact scores.

        ``probes`` lists are read for a query, by default as many as the sample asked for, and the ``short`` best by code are ranked again, by default 30 k. With
        all lists and all keys on the short list the result is knn's. Up to ``few_queries`` queries go to every task; more are sent to their lists. Ties go to the smaller
        id. Queries with null vectors or vectors of zeros find nothing.
        """
        queries = _usable(queries)
        ask = queries.schema["id"].dataType.simpleString()
        if self.codes is None:
            return self.spark.createDataFrame([], f"query_id {ask}, key_id {ask}, score double, rank int")  # of which kind the ids were is not known
        told, probes, short = self.spark.sparkContext.broadcast(self.codes), probes or self.codes.probes, short or 30 * k
        few = _told(queries, few_queries)
        pairs = self._scanned(few, told, probes, short, ask) if few is not None else self._dealt(queries, told, probes, short, block, ask)
        best = once(top_k(pairs, short, ["query_id"], "score", "key_id").select("query_id", "key_id", "list"), "ann-short")
        keys = self.spark.read.parquet(f"{self.path}/vectors").select("list", F.col("id").alias("key_id"), F.col("embedding").alias("k"))
        best = F.broadcast(best) if best.limit(broadcast_rows + 1).count() <= broadcast_rows else best
        whole = best.join(keys, ["list", "key_id"]).join(queries.select(F.col("id").alias("query_id"), "embedding"), "query_id")

        def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    score = np.einsum("ij,ij->i", _matrix(b["embedding"], True), _matrix(b["k"], False))
                    yield pd.DataFrame({"query_id": b["query_id"], "key_id": b["key_id"], "score": score})

        return top_k(whole.select("query_id", "key_id", "embedding", "k").mapInPandas(exact, f"query_id {ask}, key_id {keys.schema['key_id'].dataType.simpleString()}, score double"), k, ["query_id"], "score", "key_id")


def _usable(rows: DataFrame) -> DataFrame:
    """Rows whose vectors have a direction, one for each id."""
    sound = lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))  # noqa: E731  NaN is over all numbers here
    return _vectors(rows).where(F.forall("embedding", sound) & F.exists("embedding", lambda x: x != 0)).dropDuplicates(["id"])
