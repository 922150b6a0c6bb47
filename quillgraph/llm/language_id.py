"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of hashed 1- to 3-grams are counted over all rows that training may see. The model is trained by
follow-the-regularised-leader with an elastic net on a bounded sample, then its temperature is set on rows of the
sample that training left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import held_out
from quillgraph.llm.linear import ftrl, softmax, temperature

BITS = 14
DIMS = 1 << BITS
PIECE = 1 << 20
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x3000)), bool, 0x3000)


_LETTER = _is_letter()


def counts(text: str) -> np.ndarray:
    """How often each hashed 1-, 2- and 3-gram occurs in the whole lower-cased text; runs of other characters than letters count as one space.

    A long text is counted in pieces; each takes over the last two characters of the one before, and counts only n-grams that end in its own.
    """
    out = np.zeros(DIMS, np.int64)
    low, last, was_letter = text.lower(), np.zeros(0, np.uint32), True
    for start in range(0, len(low), PIECE):
        c = np.frombuffer(low[start : start + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = np.where(c < 0x3000, _LETTER[np.minimum(c, 0x2FFF)], True)
        c = np.where(letter, c, np.uint32(32))[letter | np.concatenate([[was_letter], letter[:-1]])]
        was_letter = bool(letter[-1])
        old, c = len(last), np.concatenate([last, c])
        last = c[-2:]
        a = c * _MIX[0]
        two = (a[:-1] ^ (c[1:] * _MIX[1] + np.uint32(1))) * _MIX[2]
        three = (two[:-1] ^ (c[2:] * _MIX[0] + np.uint32(2))) * _MIX[1]
        for n, grams in enumerate((a, two, three)):
            grams = grams[max(0, old - n) :]
            grams = grams ^ (grams >> np.uint32(15))
            out += np.bincount((grams * _MIX[2]) >> np.uint32(32 - BITS), minlength=DIMS)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return tf_idf(counts(text), self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return "und", 0.0
        at, x = self.features(text)
        p = softmax((x @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def tf_idf(n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(n)
    x = (1 + np.log(n[at])) * idf[at]
    norm = np.sqrt(x @ x)
    return at, (x / norm if norm else x).astype(np.float32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, docs = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen += counts(text) > 0
            docs += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(seen[at], docs), pa.int64())], ["gram", "docs"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(lang, h, np.flatnonzero(n := counts(text)), n) for lang, h, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "h", "text")), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.list_(pa.int64())), pa.array([x[3][x[2]] for x in found], pa.list_(pa.int64()))], ["lang", "h", "at", "n"])


def fit(docs: DataFrame, learn: Column, *, sample_rows: int = 3000, least_rows: int = 50, languages: int = 200) -> LanguageModel:
    """docs: doc_id, text, lang. Learns from rows where ``learn`` holds and text and lang are not null.

    The model is fitted on about ``sample_rows`` rows by hash of id and text, at least ``least_rows`` of each language if
    it has as many. Document frequencies cover all rows that it may learn from. More than ``languages`` languages in them are an error.
    """
    rows = docs.where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(languages + 1).collect()}
    if len(per) > languages:
        raise ValueError(f"more than {languages} languages to learn; raise languages to keep them all")
    if not per:
        return LanguageModel([], np.ones(DIMS), np.zeros((DIMS, 0)), np.zeros(0), 1.0)
    total, names = sum(per.values()), sorted(per)
    df, n = np.zeros(DIMS, np.int64), 0
    for r in rows.select("text").mapInArrow(_frequencies, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs")).collect():
        if r["gram"] < 0:
            n = r["docs"]
        else:
            df[r["gram"]] = r["docs"]
    idf = np.log((1 + n) / (1 + df)) + 1
    share = F.lit(0)
    for lang in names:
        share = F.when(F.col("lang") == lang, int((1 << 20) * min(1.0, max(sample_rows / total, least_rows / per[lang])))).otherwise(share)
    limit = sample_rows + least_rows * len(names)
    sample = rows.where(F.pmod("h", F.lit(1 << 20)) < share).orderBy("h", "lang").limit(limit)
    got = sample.repartition(8).mapInArrow(_vectors, "lang string, h long, at array<long>, n array<long>").collect()
    number = {x: i for i, x in enumerate(names)}
    train, rest = [], []
    for r in sorted(got, key=lambda r: (r["h"], r["lang"])):
        c = np.zeros(DIMS, np.int64)
        c[r["at"]] = r["n"]
        (rest if (r["h"] >> 24) % 5 == 0 else train).append((*tf_idf(c, idf), number[r["lang"]]))
    train = train or rest
    weights, bias = ftrl(train, DIMS, len(names))
    logits = np.array([x @ weights[at] + bias for at, x, _ in rest]).reshape(-1, len(names))
    return LanguageModel(names, idf.astype(np.float32), weights.astype(np.float32), bias.astype(np.float32), temperature(logits, np.array([y for *_, y in rest], int)))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row. Null text or text without a letter: und, score 0."""
    told = docs.sparkSession.sparkContext.broadcast(model)  # its size is DIMS x languages, both bounded

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = told.value
        for batch in batches:
            found = [m.predict(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, **how) -> DataFrame:
    """Fit on the rows of docs that are not held out, predict all.

    A row is held out if crc32 of its doc_id as text is 0 modulo 5; a null doc_id counts as the empty text. Null lang: not learnt
    from, still predicted. Nothing to learn from: und everywhere. Repeated rows count as often as they occur. Other columns are not read.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return identify(rows, fit(rows, ~held_out(), **how))
