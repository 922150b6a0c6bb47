"""Quality by a byte-level convolutional network in numpy.

A document is cut into overlapping chunks that cover all its bytes. In each chunk learned filters run over embedded
bytes; each filter's largest answer in the chunk is kept. The document's features are the mean and the largest of
its chunks' answers, and a logistic unit turns them into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import held_out, utf8
from quillgraph.llm.toxicity import learnable

CHUNK, STEP, STRIDE, EMBED, FILTERS = 1024, 768, 4, 8, 32
BLOCK = 256  # chunks that are worked on at once


def chunks(data: np.ndarray) -> np.ndarray:
    """[n, CHUNK] overlapping chunks over all bytes, the last filled up with zeros; an empty text is one chunk of zeros."""
    n = max(1, -(-(len(data) - (CHUNK - STEP)) // STEP)) if len(data) else 1
    room = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    room[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(room, CHUNK)[::STEP]


@dataclass
class ByteNet:
    embed: np.ndarray  # [256, EMBED]; byte 0 fills up
    first: np.ndarray  # [STRIDE * EMBED, FILTERS]: a filter spans 2 * STRIDE bytes, as two halves
    second: np.ndarray
    bias: np.ndarray
    out: np.ndarray  # [2 * FILTERS]
    base: np.ndarray  # [1]

    @staticmethod
    def new(seed: int) -> ByteNet:
        r = np.random.default_rng(seed)
        net = ByteNet(r.normal(0, 0.5, (256, EMBED)), r.normal(0, 0.2, (STRIDE * EMBED, FILTERS)), r.normal(0, 0.2, (STRIDE * EMBED, FILTERS)), np.zeros(FILTERS), np.zeros(2 * FILTERS), np.zeros(1))
        net.embed[0] = 0
        return ByteNet(*(x.astype(np.float32) for x in net.all()))

    def all(self) -> list[np.ndarray]:
        return [self.embed, self.first, self.second, self.bias, self.out, self.base]

    def answers(self, x: np.ndarray) -> np.ndarray:
        """[n, CHUNK / STRIDE - 1, FILTERS] before the cut at zero."""
        e = self.embed[x].reshape(len(x), CHUNK // STRIDE, STRIDE * EMBED)
        return (e @ self.first)[:, :-1] + (e @ self.second)[:, 1:] + self.bias

    def pooled(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.maximum(self.answers(x[i : i + BLOCK]).max(axis=1), 0) for i in range(0, len(x), BLOCK)])

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.out + self.base, -30, 30)))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of each document. Pieces of long texts are pooled one after the other."""
        out, queue, room = [], [], 0

        def flush() -> None:
            nonlocal queue, room
            if queue:
                p, ends = self.pooled(np.concatenate(queue)), np.cumsum([0] + [len(c) for c in queue[:-1]])
                sums, tops = np.add.reduceat(p, ends), np.maximum.reduceat(p, ends)
                out.append(self.probability(np.concatenate([sums / np.array([len(c) for c in queue])[:, None], tops], axis=1)))
                queue, room = [], 0

        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            c = chunks(data[a:b])
            if len(c) > 4 * BLOCK:
                flush()
                parts = [self.pooled(c[i : i + BLOCK]) for i in range(0, len(c), BLOCK)]
                total, top = sum(p.sum(axis=0) for p in parts) / len(c), np.max([p.max(axis=0) for p in parts], axis=0)
                out.append(self.probability(np.concatenate([total, top])[None]))
                continue
            queue.append(c)
            room += len(c)
            if room >= 2 * BLOCK:
                flush()
        flush()
        return np.concatenate(out).ravel().astype(np.float64) if out else np.zeros(0)

    def best(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[n, FILTERS] each chunk's largest answers before the cut at zero, and their places; BLOCK chunks at a time."""
        tops, places = [], []
        for i in range(0, len(x), BLOCK):
            a = self.answers(x[i : i + BLOCK])
            places.append(a.argmax(axis=1))
            tops.append(np.take_along_axis(a, places[-1][:, None], 1)[:, 0])
        return np.concatenate(tops), np.concatenate(places)

    def gradient(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted log loss of some documents, each given as its chunks."""
        x, size = np.concatenate(docs), np.array([len(d) for d in docs])
        starts, of = np.concatenate([[0], np.cumsum(size)[:-1]]), np.repeat(np.arange(len(docs)), size)
        top_answer, at = self.best(x)
        p = np.maximum(top_answer, 0)
        mean, top = np.add.reduceat(p, starts) / size[:, None], np.maximum.reduceat(p, starts)
        f = np.concatenate([mean, top], axis=1)
        d = ((self.probability(f).ravel() - y) * weight / weight.sum()).astype(np.float32)
        df = d[:, None] * self.out
        is_top = (p == top[of]).astype(np.float32)
        is_top /= np.maximum(np.add.reduceat(is_top, starts), 1)[of]
        dp = (df[of, :FILTERS] / size[of, None] + df[of, FILTERS:] * is_top) * (p > 0)
        all_k, all_g = np.nonzero(dp)
        one, two, bias, embed = (np.zeros_like(w) for w in (self.first, self.second, self.bias, self.embed))
        for i in range(0, len(all_k), 1 << 16):  # what is held beside the chunks has a bound
            k, g = all_k[i : i + (1 << 16)], all_g[i : i + (1 << 16)]
            order = np.argsort(g, kind="stable")
            k, g = k[order], g[order]
            where, v = at[k, g], dp[k, g]
            windows = x[k[:, None], where[:, None] * STRIDE + np.arange(2 * STRIDE)]
            e = self.embed[windows].reshape(len(k), 2, STRIDE * EMBED)
            edges = np.searchsorted(g, np.arange(FILTERS + 1))
            de = np.empty_like(e)
            for j in range(FILTERS):
                s = slice(edges[j], edges[j + 1])
                one[:, j] += v[s] @ e[s, 0]
                two[:, j] += v[s] @ e[s, 1]
                bias[j] += v[s].sum()
                de[s, 0], de[s, 1] = v[s, None] * self.first[:, j], v[s, None] * self.second[:, j]
            flat, de = windows.ravel(), de.reshape(-1, EMBED)
            for j in range(EMBED):
                embed[:, j] += np.bincount(flat, de[:, j], 256)
        embed[0] = 0
        return [embed, one, two, bias, (d @ f).astype(np.float32), d.sum(keepdims=True)]


def train(texts: list[bytes], y: list[int], *, epochs: int = 10, batch: int = 16, rate: float = 0.01, seed: int = 11) -> ByteNet:
    """Adam on weighted log loss, over all chunks of every text."""
    net, rng = ByteNet.new(seed), np.random.default_rng(seed)
    y = np.asarray(y, np.float32)
    rate_of_good = min(max(float(y.mean()), 0.02), 0.98) if len(y) else 0.5
    net.base[:] = np.log(rate_of_good / (1 - rate_of_good))
    m, v, t = [np.zeros_like(w) for w in net.all()], [np.zeros_like(w) for w in net.all()], 0
    steps = epochs * max(1, -(-len(texts) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            docs = [chunks(np.frombuffer(texts[k], np.uint8)) for k in some]
            t += 1
            now = rate * (1 - 0.9 * t / steps)
            for w, g, a, b in zip(net.all(), net.gradient(docs, y[some], np.ones(len(some), np.float32)), m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.002 * (g * g - b)
                w -= now * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.998**t)) + 1e-7)
    return net


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 2000, **how) -> ByteNet:
    """Fit on labelled rows that are not held out: at most half of ``sample_rows`` of either label, by hash of the id.

    The share of each label among all labels that it may learn from sets the level of the scores.
    """
    n = {r["quality"]: r["n"] for r in labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    rows = learnable(docs, labels, "quality", {0: sample_rows // 2, 1: sample_rows // 2})
    got = rows.select(F.col("text").cast("binary").alias("text"), "quality", "h").collect()
    got.sort(key=lambda r: (r["h"], r["quality"]))
    net = train([bytes(r["text"] or b"") for r in got], [r["quality"] for r in got], **how)
    odds = lambda k: (k.get(1, 0) + 1) / (k.get(0, 0) + 1)
    drawn = {q: sum(r["quality"] == q for r in got) for q in (0, 1)}
    net.base += np.float32(np.log(odds(n) / odds(drawn)))  # the sample holds more of the rarer label than the rows do
    return net


def score(docs: DataFrame, net: ByteNet, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; null text scores as the empty text."""
    told = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = told.value.score(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Fit on labelled rows that are not held out, score all rows of docs.

    Held out: crc32 of doc_id as text is 0 modulo 5 (null id: as the empty text). No labels: an untrained net's even odds. Repeated
    rows count as often as they occur. Empty table: no rows. Other columns are not read.
    """
    return score(docs, fit(docs, labels, **how))


def keep_good(docs: DataFrame, net: ByteNet, threshold: float = 0.3) -> DataFrame:
    """Rows of docs, with all their columns, whose score is at least the threshold."""
    told = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.names.index("text"))
            yield batch.filter(pa.array(told.value.score(*utf8(text)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
