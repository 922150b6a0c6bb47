"""Toxicity by noisy-channel deobfuscation.

The whole text becomes a lattice: each character may stand for itself, for a letter that it resembles, or for nothing; white space
beside a single character may be what parts the letters of a word, other white space parts words. The Viterbi path under a character trigram
model, counted over all documents, restores the words. A logistic regression on the words of the restored text, and on nothing else, gives the score.

Where the lattice must part two words, the path is in the same state whatever came before, so the stretches between are decoded one by one. One that
has a single way through it (letters of which none is doubled) is its own path.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import held_out, shared_dir, utf8, written
from quillgraph.llm.linear import ftrl

#: Letters that signs, digits and letters of other scripts are written for, and signs that are put between letters.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "µ": "u",
              "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ß": "b"}
BETWEEN = "-_*~'·.\u200b\u200c\u200d\ufeff"

SYMBOLS = 27  # a to z, and 0 for the edge of a word
COST_LOOKS, COST_LETTER, COST_DROP_SIGN, COST_DROP_REPEAT, COST_DROP_DIGIT, COST_EDGE = 0.7, 0.05, 0.2, 0.9, 5.0, 1.5
#: White space beside a single character: what it costs to pass over it, and to part words there.
COST_DROP_SPACE, COST_SPACE = 2.5, 0.05

#: A stretch with a single way through: a to z, no letter twice running.
_PLAIN = re.compile(r"(?!.*([a-z])\1)[a-z]+")
_SIGNS = "".join(map(chr, range(33, 127)))


@cache
def letters_for(c: str) -> str:
    """The letters of a to z that a character other than these may be written for."""
    if c in LOOKS_LIKE:
        return LOOKS_LIKE[c]
    base = unicodedata.normalize("NFKD", c)[0].lower()  # accents, and letters of other widths and styles
    return base if "a" <= base <= "z" else LOOKS_LIKE.get(base, "") if base != c else ""


#: Signs that resemble no letter: at the ends of a stretch they can part or be dropped, which changes no letter.
_ENDS = "".join(c for c in _SIGNS if not c.isalnum() and c not in LOOKS_LIKE) + BETWEEN


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of letter trigrams of texts, other bytes and ends of texts being edges."""
    symbol = np.zeros(256, np.int64)
    symbol[97:123] = symbol[65:91] = np.arange(1, 27)
    s = np.insert(symbol[data], offsets[:-1], 0) if len(data) else np.zeros(0, np.int64)
    s = np.concatenate([[0], s, [0]])
    keep = np.concatenate([[True], (s[1:] > 0) | (s[:-1] > 0)])
    s = np.concatenate([[0], s[keep]])
    code = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    return np.bincount(code, minlength=SYMBOLS**3)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for first in range(0, len(offsets) - 1, 256):  # bounds what is held beside the batch
            part = offsets[first : first + 257]
            n += trigrams(data[part[0] : part[-1]], part - part[0])
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["code", "n"])


def letter_model(docs: DataFrame) -> np.ndarray:
    """-log p(letter | two before), [27, 27, 27], counted over the whole texts of all rows."""
    n = np.zeros(SYMBOLS**3)
    for r in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        n[r["code"]] = r["n"]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = n.sum(axis=0) + 0.5
    backed = n + 5 * (two / two.sum(axis=1, keepdims=True))[None]
    return -np.log(backed / backed.sum(axis=2, keepdims=True))


@cache
def _choices(c: str, again: bool, thrice: bool) -> list[tuple[int, float]]:
    """What a character may stand for (0: an edge, -1: nothing) and the channel's cost of that. again: the one before is the same; thrice: so are the two before."""
    if "a" <= c <= "z":
        return [(ord(c) - 96, COST_LETTER)] + [(-1, 0.3 if thrice else COST_DROP_REPEAT)] * again
    if c.isspace():
        return [(-1, COST_DROP_SPACE), (0, COST_SPACE)]
    if c in BETWEEN:
        return [(-1, COST_DROP_SIGN), (0, COST_EDGE)]
    if found := letters_for(c):
        here = [(ord(x) - 96, COST_LOOKS) for x in found]
        if not c.isalpha():
            return [*here, (-1, COST_DROP_DIGIT if c.isdigit() else 2 * COST_LOOKS + COST_DROP_SIGN), (0, COST_DROP_DIGIT)]
        return here + [(-1, COST_DROP_REPEAT)] * again
    if c.isalpha():
        return [(0, 0.0)]  # letters that the model does not cover part words
    return [(-1, COST_DROP_SIGN + 1), (0, COST_EDGE)]


def options(text: str) -> list[list[tuple[int, float]]]:
    """The lattice: a list of choices for each character."""
    before = "\n" + text
    return [_choices(c, i > 0 and c == b, i > 1 and c == b and c == text[i - 2]) for i, (c, b) in enumerate(zip(text, before, strict=False))]


def restore(text: str, model: np.ndarray | list[float]) -> str:
    """The likeliest words behind a written string."""
    return best_path(options(text), model)


def best_path(lattice: list[list[tuple[int, float]]], model: np.ndarray | list[float]) -> str:
    """The words of the cheapest way through a lattice, as lower-case letters with single spaces; Viterbi over pairs of letters.

    model: [27, 27, 27], or the same as one list of plain numbers, which are read faster.
    """
    flat = model if isinstance(model, list) else model.ravel().tolist()
    # a state is 27 times the letter before the last, plus the last; a path ends in its last letter and what came before
    paths: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for here in [*lattice, [(0, 0.0)]]:
        if len(here) == 1 and len(paths) == 1 and here[0][0] > 0:  # the common case, written out
            ((state, (cost, back)),), ((symbol, channel),) = paths.items(), here
            paths = {state % SYMBOLS * SYMBOLS + symbol: (cost + channel + flat[state * SYMBOLS + symbol], (symbol, back))}
            continue
        step: dict[int, tuple[float, tuple | None]] = {}
        for state, (cost, back) in paths.items():
            last = state % SYMBOLS
            for symbol, channel in here:
                if symbol > 0:
                    key, total, link = last * SYMBOLS + symbol, cost + channel + flat[state * SYMBOLS + symbol], (symbol, back)
                elif symbol < 0 or not last:
                    key, total, link = state, cost + channel, back
                else:
                    key, total, link = 0, cost + channel + flat[state * SYMBOLS], (0, back)
                old = step.get(key)
                if old is None or total < old[0]:
                    step[key] = (total, link)
        paths = step
    _, link = min(paths.values(), key=lambda x: x[0])
    letters = []
    while link:
        letters.append(chr(96 + link[0]) if link[0] else " ")
        link = link[1]
    return "".join(reversed(letters)).strip()


@dataclass
class Restorer:
    """The words of a text as the lattice restores them. Stretches seen before come from a bounded memory."""

    model: np.ndarray
    most: int = 200_000
    seen: dict[str, tuple[str, ...]] = field(default_factory=dict)
    single: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.flat = np.asarray(self.model).ravel().tolist()

    def _restored(self, stretch: str) -> tuple[str, ...]:
        core = stretch.strip(_ENDS)
        if _PLAIN.fullmatch(core):
            return (core,)
        lattice = options(core)
        if max(map(len, lattice), default=1) == 1:  # a single way, accents and other letters in it
            return tuple("".join(chr(96 + here[0][0]) if here[0][0] else " " for here in lattice).split())
        return tuple(best_path(lattice, self.flat).split())

    def words(self, text: str) -> set[str]:
        if len(self.seen) + len(self.single) > self.most:
            self.seen.clear()
            self.single.clear()
        tokens = text.lower().split()
        kinds = set(tokens)
        for t in kinds.difference(self.seen, self.single):
            if len(t.strip(_ENDS)) <= 1:
                self.single.add(t)
            else:
                self.seen[t] = self._restored(t)
        joined: list[str] = []
        if single := kinds & self.single:
            # white space beside a single character belongs to the lattice, so its neighbours are one stretch with it
            runs: list[list[int]] = []
            for i in (i for i, t in enumerate(tokens) if t in single):
                if runs and i - 1 <= runs[-1][1]:
                    runs[-1][1] = i + 1
                else:
                    runs.append([max(0, i - 1), i + 1])
            apart = bytearray(b"\1") * len(tokens)
            for first, last in runs:
                part = tokens[first : last + 1]
                apart[first : last + 1] = bytes(len(part))
                joined.append(" ".join(part))
            kinds = set(compress(tokens, apart))
        found = set().union(*map(self.seen.__getitem__, kinds))
        for stretch in joined:
            if stretch not in self.seen:
                self.seen[stretch] = self._restored(stretch)
            found.update(self.seen[stretch])
        for t in (*tokens, *joined):
            if len(t) > 64:  # what is kept is short
                self.seen.pop(t, None)
        return found


@dataclass(frozen=True)
class ToxicityModel:
    letters: np.ndarray
    weights: dict[str, float]
    bias: float

    def score(self, words: set[str]) -> float:
        z = self.bias + sum(self.weights[w] for w in sorted(self.weights.keys() & words))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labelled: DataFrame, *, words: int = 512, least_docs: int = 5) -> ToxicityModel:
    """docs: all rows, for the letter model. labelled: text, toxic, h (for a sample in a fixed order).

    The ``words`` words that tell most by chi-square, counted over all rows of labelled, are the features of the regression,
    which is fitted on the same rows. See learnable for their bound.
    """
    letters = letter_model(docs)
    labelled = written(labelled, f"{shared_dir(docs.sparkSession, 'toxicity')}/labelled")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, reader = Counter(), Restorer(letters)

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([y for _, y in kept], pa.int32()), pa.array(list(kept.values()), pa.int64())], ["word", "toxic", "n"])
            kept.clear()
            return rows

        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                kept.update((w, y) for w in reader.words(text or ""))
                kept[("", y)] += 1
                if len(kept) > 100_000:
                    yield out()
        yield out()

    counted = labelled.select("text", "toxic").mapInArrow(tally, "word string, toxic int, n long").groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    counted = counted.where((F.col("word") == "") | (F.col("bad") + F.col("good") >= least_docs))
    total = labelled.agg(F.sum((F.col("toxic") == 1).cast("long")), F.sum((F.col("toxic") == 0).cast("long"))).first()
    bad, good = int(total[0] or 0), int(total[1] or 0)
    if not bad or not good:
        return ToxicityModel(letters, {}, 20.0 if bad else -20.0)
    n, b, g = F.lit(float(bad + good)), F.col("bad").cast("double"), F.col("good").cast("double")
    chi = n * F.pow(b * F.lit(float(good)) - g * F.lit(float(bad)), 2) / ((b + g) * (n - b - g) * F.lit(float(bad)) * F.lit(float(good)))
    chosen = sorted(r["word"] for r in counted.where((F.col("word") != "") & (b + g < n)).withColumn("chi", chi).where("chi > 10.8").orderBy(F.desc("chi"), "word").limit(words).collect())
    number = {w: i for i, w in enumerate(chosen)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Restorer(letters)
        for batch in batches:
            at = [sorted(number[w] for w in number.keys() & reader.words(text or "")) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("h"), pa.array(at, pa.list_(pa.int64()))], ["toxic", "h", "at"])

    got = sorted(labelled.select("text", "toxic", "h").mapInArrow(vectors, "toxic int, h long, at array<long>").collect(), key=lambda r: (r["h"], r["toxic"]))
    weights, bias = ftrl([(np.array(r["at"], int), np.ones(len(r["at"])), r["toxic"]) for r in got], len(chosen), 2, l1=3.0, l2=0.1, epochs=3)
    gap = weights[:, 1] - weights[:, 0]
    return ToxicityModel(letters, {w: float(x) for w, x in zip(chosen, gap, strict=True) if x}, float(bias[1] - bias[0]))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; null text scores as the empty text."""
    told = docs.sparkSession.sparkContext.broadcast(model)  # a table of 27 cubed and a bounded list of words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = told.value
        reader = Restorer(m.letters)
        for batch in batches:
            s = np.array([m.score(reader.words(text or "")) for text in batch.column("text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def learnable(docs: DataFrame, labels: DataFrame, label: str, sample: dict[int, int]) -> DataFrame:
    """text, label, h of labelled rows that are not held out: for each value of the label at most so many ids, by hash.

    An id labelled more than once takes its largest label; null labels and ids are left out. The sample is taken from the labels, so what is
    broadcast has a bound, and texts do not shuffle to meet them. Rows that repeat an id count once.
    """
    told = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).cast("int").alias(label))
    some = None
    for value, most in sample.items():
        one = told.where(F.col(label) == value).orderBy(F.xxhash64("_id"), "_id").limit(most)
        some = one if some is None else some.unionByName(one)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "_id")
    return rows.groupBy("_id", label).agg(F.max("text").alias("text")).select("text", label, F.xxhash64("_id").alias("h"))


def toxicity(docs: DataFrame, labels: DataFrame, *, rows: int = 10_000, **how) -> DataFrame:
    """Fit on at most ``rows`` labelled rows of either label that are not held out, score all rows of docs.

    Held out: crc32 of doc_id as text is 0 modulo 5 (null id: as the empty text). No labels: all score near 0. Repeated rows count
    as often as they occur. Empty table: no rows. Other columns are not read.
    """
    return score(docs, fit(docs, learnable(docs, labels, "toxic", {0: rows, 1: rows}), **how))
