"""Near-duplicates by HyperMinHash.

A text's shingles are hashed to 64 bits. The top bits choose one of 256 buckets; of the least rest in a bucket the register keeps the number
of leading zeros and ten bits after the first one. Texts with the same set of shingles are one class, and only classes go on.

Candidates come from bands, runs of six registers. An empty bucket takes, in the bands alone, the register of the first bucket that is not
empty in an order of its own; so registers agree independently with a chance of the similarity, however small the sets are.

1. Each class of a band is paired with the band's least class. Two sketches give an estimate of the similarity, less the registers that are
   expected to agree by chance. Pairs that are not five standard deviations below the threshold are confirmed on the full sets; links
   join components.
2. Bands that still hold several components are open. Their classes meet again on the rarest shingles of their sets: of n shingles,
   sets with a share t in common must share one of the n - ceil(t n) + 1 that are rarest. Classes that meet with the same least class are a crowd. Within a
   crowd, sketches are compared across components, and likely pairs are counted on the full sets; a crowd is dealt out in blocks
   bounded in rows and shingles, and a block returns only links that join components. No list of pairs grows with a group's square.

A link is missed if its ends share neither a band nor, as members of open bands, a rarest shingle: at the threshold about three in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.common import parts_for, remove, shared_dir, unused, utf8, written
from quillgraph.llm.components import components

BUCKET_BITS, MANTISSA_BITS, BAND = 8, 10, 6
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // BAND
REST = 64 - BUCKET_BITS
#: Registers of unlike elements that agree by chance, of all: the leading term for sets of like size (Yu and Weber, HyperMinHash).
BY_CHANCE = 0.169919487159739 * 2.0 ** (BUCKET_BITS - MANTISSA_BITS)
#: Classes and shingles of a block of a crowd.
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 1 << 20

_RANDOM = np.random.default_rng(20240229)
_PLACE = _RANDOM.integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: [i, j]: the place of bucket j in the order in which the empty bucket i looks for a register.
_ORDER = np.argsort(_RANDOM.random((BUCKETS, BUCKETS)), axis=1).astype(np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """xxh3 hashes of all words of some texts, A-Z as a-z, and how many each text has. Each different word is hashed once."""
    texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    found = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    number = coded.indices.to_numpy(zero_copy_only=False)
    real = np.array([w != b"" for w in found], bool)[number] if len(found) else np.zeros(0, bool)  # gaps at the ends of a text leave an empty word
    ends = np.concatenate([[0], np.cumsum(real)])[split.offsets.to_numpy()]
    return hashes[number[real]] if len(found) else np.zeros(0, np.uint64), np.diff(ends)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words has one shingle, all of them."""
    h, n = words(data, offsets)
    ends = np.cumsum(n)
    rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        rolled += h[k : k + len(rolled)] * _PLACE[k]
    rolled = mixed(rolled)
    out = []
    for e, k in zip(ends, n, strict=True):
        if k >= width:
            out.append(np.unique(rolled[e - k : e - width + 1]))
        elif k:
            out.append(mixed((h[e - k : e] * _PLACE[:k]).sum(dtype=np.uint64, keepdims=True) + _PLACE[63 - k]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(s: np.ndarray) -> np.ndarray:
    """256 registers of a sorted set: leading zeros and mantissa of the least rest of each bucket, plus 1; 0 for an empty bucket."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(s):
        bucket = (s >> np.uint64(REST)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        rest = s[first] & np.uint64((1 << REST) - 1)
        size = np.frexp(rest.astype(np.float64))[1].astype(np.int64)  # bits of the rest
        zeros = np.clip(REST - size, 0, REST - 1)
        mantissa = (rest << (zeros + 1 + BUCKET_BITS).astype(np.uint64)) >> np.uint64(64 - MANTISSA_BITS)
        out[bucket[first]] = (zeros << MANTISSA_BITS) + mantissa.astype(np.int64) + 1
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """[n, 256] registers to [n, 42] hashes of six registers each, with the buckets that they come from."""
    source = np.tile(np.arange(BUCKETS), (len(regs), 1))
    for k in np.flatnonzero((regs == 0).any(axis=1) & (regs > 0).any(axis=1)):
        empty, full = np.flatnonzero(regs[k] == 0), np.flatnonzero(regs[k])
        source[k, empty] = full[_ORDER[np.ix_(empty, full)].argmin(axis=1)]
    filled = np.take_along_axis(regs, source, 1).astype(np.uint64) + (source.astype(np.uint64) << np.uint64(32))
    bands = mixed(filled)[:, : BANDS * BAND].reshape(len(regs), BANDS, BAND)
    return mixed((bands * _PLACE[:BAND]).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _BASE).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity without chance agreement, buckets that count) of registers, row by row or one against many."""
    used = ((a > 0) | (b > 0)).sum(axis=-1)
    same = ((a == b) & (a > 0)).sum(axis=-1)
    rate = BY_CHANCE / BUCKETS
    return np.clip((same / np.maximum(used, 1) - rate) / (1 - rate), 0, 1), used


def plausible(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    got, used = estimate(a, b)
    return got >= threshold - 5 * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))


def _sliced(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of text."""
    _, at = utf8(batch.column("text"))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    part, serial = TaskContext.get().partitionId() << 33, 0
    for whole in batches:
        for batch in _sliced(whole):
            sets = shingle_sets(*utf8(batch.column("text")), width)
            ids = np.arange(serial, serial + len(sets)) + part
            serial += len(sets)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column("doc_id"), batch.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([registers(s).tobytes() for s in sets], pa.binary())], ["row", "doc_id", "key", "n", "sig", "regs"])


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = utf8(column)
    return np.frombuffer(data.tobytes(), np.uint16).reshape(len(column), BUCKETS)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    """Arrays of 64-bit numbers as one column of lists."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rows])]), pa.int32()), pa.array(flat.view(np.int64)))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = band_keys(_matrix(batch.column("regs")))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "doc_id", "key", "n", "regs")] + [_lists(list(keys))], ["id", "doc_id", "key", "n", "regs", "bands"])


def _judge(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        likely = plausible(_matrix(batch.column("ra")), _matrix(batch.column("rb")), threshold)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(likely))


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    last = None  # rows that repeat an id and a text come one after the other
    for whole in batches:
        ids = whole.column("id").to_pylist()
        new = [x != y for x, y in zip(ids, [last, *ids], strict=False)]
        last = ids[-1] if ids else last
        for batch in _sliced(whole.filter(pa.array(new, pa.bool_()))):
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(shingle_sets(*utf8(batch.column("text")), width))], ["id", "s"])


def _numbers(column: pa.Array) -> list[np.ndarray]:
    """The rows of a column of lists as views of 64-bit hashes."""
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(_numbers(batch.column("sa")), _numbers(batch.column("sb")), strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


class Shared:
    """How many elements each of some sets has in common with any one of them, by the lists of the sets that hold an element."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        held = times[number] > 1  # what occurs once is in no intersection
        number, owner = number[held], owner[held]
        order = np.argsort(number, kind="stable")
        self.holders, self.first = owner[order], np.searchsorted(number[order], np.arange(len(values) + 1))
        self.number, self.at = number, np.searchsorted(owner, np.arange(len(sets) + 1))

    def with_all(self, a: int) -> np.ndarray:
        mine = self.number[self.at[a] : self.at[a + 1]]
        first, length = self.first[mine], self.first[mine + 1] - self.first[mine]
        gone = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(mine) else np.zeros(0, np.int64)
        rows = self.holders[np.arange(int(length.sum())) + np.repeat(first - gone, length)]
        return np.bincount(rows, minlength=len(self.sizes))


def spanning(sets: list[np.ndarray], regs: np.ndarray, component: np.ndarray, part: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links (as places in sets) that join the components of a block's rows as far as all its links do.

    All rows outside the largest component are compared with all of other components; of other parts alone, if ``part`` is given. Sketches first, then counts.
    """
    names, label, size = np.unique(component, return_inverse=True, return_counts=True)
    asks = np.flatnonzero(label != size.argmax())
    n, shared, out = np.array([len(s) for s in sets], np.int64), None, []
    for a in asks:
        ok = (label != label[a]) & (100 * np.minimum(n, n[a]) >= percent * np.maximum(n, n[a]))
        if part is not None:
            ok &= part != part[a]
        rows = np.flatnonzero(ok)
        rows = rows[plausible(regs[rows], regs[a], percent / 100)]
        if not len(rows):
            continue
        shared = shared or Shared(sets)
        both = shared.with_all(a)[rows]
        rows = rows[100 * both >= percent * (n[rows] + n[a] - both)]
        while len(rows):
            out.append((int(a), int(rows[0])))
            label[label == label[rows[0]]] = label[a]
            rows = rows[label[rows] != label[a]]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows by (crowd, i, j), the parts that the block compares. A block is bounded; of its links, those that join components come out."""
    now, held = None, []

    def out() -> pa.RecordBatch:
        ids, component, part, regs, sets = zip(*held, strict=True)
        found = spanning(list(sets), np.frombuffer(b"".join(regs), np.uint16).reshape(len(ids), BUCKETS), np.array(component), np.array(part) if now[1] != now[2] else None, percent)
        pairs = [sorted((ids[x], ids[y])) for x, y in found]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        plain = [batch.column(c).to_pylist() for c in ("crowd", "i", "j", "id", "component", "part", "regs")]
        for crowd, i, j, one, component, part, regs, s in zip(*plain, _numbers(batch.column("s")), strict=True):
            if (crowd, i, j) != now:
                if len(held) > 1:
                    yield out()
                now, held = (crowd, i, j), []
            held.append((one, component, part, regs, s))
    if len(held) > 1:
        yield out()


def near_components(docs: DataFrame, *, width: int = 4, percent: int = 80) -> DataFrame:
    """row, doc_id, key, n, component_id, first for each row of docs (doc_id, text); key is a hash of the text, first marks one row of each component."""
    spark, threshold = docs.sparkSession, percent / 100
    root, parts = shared_dir(spark, "near"), parts_for(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    sketches = written(rows.mapInArrow(lambda it: _sketch(it, width), "row long, doc_id long, key long, n long, sig binary, regs binary"), f"{root}/sketches")
    # classes: rows with the same set; the row with the least id stands for it
    some = sketches.where("n > 0")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = written(some.groupBy("sig").agg(F.min(order).alias("o")).select("sig", F.col("o.row").alias("id"), "o"), f"{root}/classes")
    reps = some.select(F.col("row").alias("id"), "doc_id", "key", "n", "regs").join(classes.select("id"), "id", "left_semi")
    reps = written(reps.mapInArrow(_bands, "id long, doc_id long, key long, n long, regs binary, bands array<long>"), f"{root}/reps")
    keys = reps.select("id", F.explode("bands").alias("band"))
    groups = keys.groupBy("band").agg(F.min("id").alias("center"), F.count("*").alias("size")).where("size > 1").drop("size")
    members = written(keys.join(groups, "band"), f"{root}/members")

    # the full sets of all classes that share a band
    regs = reps.select("id", "regs")
    who = reps.select("id", F.col("doc_id").alias("_id"), F.col("key").alias("_key")).join(members.select("id").distinct(), "id", "left_semi")
    whole = rows.join(who.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("id", "text")
    sets = written(whole.mapInArrow(lambda it: _sets(it, width), "id long, s array<long>"), f"{root}/sets")

    # each class with the least of its bands: sketches first, then full sets
    stars = members.where("id <> center").groupBy(F.col("center").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("_n")).drop("_n")
    sketched = stars.join(regs.withColumnsRenamed({"id": "b", "regs": "rb"}), "b").join(regs.withColumnsRenamed({"id": "a", "regs": "ra"}), "a")
    likely = written(sketched.select("a", "b", "ra", "rb").mapInArrow(lambda it: _judge(it, threshold), "a long, b long"), f"{root}/likely")
    pairs = likely.join(sets.withColumnsRenamed({"id": "b", "s": "sb"}), "b").join(sets.withColumnsRenamed({"id": "a", "s": "sa"}), "a")
    links = written(pairs.select("a", "b", "sa", "sb").mapInArrow(lambda it: _confirm(it, percent), "a long, b long"), f"{root}/links")
    joined = components(links, f"{root}/first")

    # open bands: their classes meet on the rarest shingles of their sets
    placed = members.select("band", "id").join(joined, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    open_bands = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    open_ = written(placed.join(open_bands, "band").select("id", "component").distinct(), f"{root}/open")
    every = sets.join(open_.select("id"), "id", "left_semi").select("id", F.size("s").alias("n"), F.explode("s").alias("shingle"))
    common = every.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    per = every.join(common, "shingle").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("c"))
    # n - ceil(t n) + 1 shingles are needed, and those that no other set holds come first
    need = F.expr(f"cast(size(c) - (({percent} * n + 99) div 100) + 1 as int)")
    tokens = written(per.withColumn("need", need).where("need > 0").select("id", F.explode(F.slice("c", F.lit(1), F.col("need"))).alias("t")).select("id", F.col("t.shingle").alias("shingle")), f"{root}/tokens")
    tokens = tokens.join(open_, "id")
    lists = tokens.groupBy("shingle").agg(F.min("id").alias("crowd"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("shingle", "crowd")
    crowds = written(tokens.join(lists, "shingle").select("crowd", "id", "component").distinct().join(reps.select("id", "n"), "id"), f"{root}/crowds")
    sizes = crowds.groupBy("crowd").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int").alias("parts"))
    dealt = crowds.drop("n").join(sizes, "crowd").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("crowd", "id", "component", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    blocks = dealt.join(regs, "id").join(sets, "id").repartition(4 * parts, "crowd", "i", "j").sortWithinPartitions("crowd", "i", "j")
    more = written(blocks.select("crowd", "i", "j", "id", "component", "part", "regs", "s").mapInArrow(lambda it: _blocks(it, percent), "a long, b long"), f"{root}/more")
    if more.limit(1).count():
        joined = components(links.unionByName(more), f"{root}/second")

    # the least id of a component, over all rows of its classes
    of = classes.join(joined, "id", "left").select("sig", "o", F.coalesce("component", "id").alias("component"))
    least = of.groupBy("component").agg(F.min("o").alias("top"))
    of = written(of.join(least, "component").select("sig", "top"), f"{root}/of")
    for old in ("members", "sets", "likely", "links", "first", "second", "open", "tokens", "crowds", "more", "reps", "classes"):
        remove(spark, f"{root}/{old}")
    slim = sketches.select("row", "doc_id", "key", "n", "sig")
    alone = slim.where("n = 0").select("row", "doc_id", "key", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return slim.where("n > 0").join(of, "sig").select("row", "doc_id", "key", "n", F.col("top.doc_id").alias("component_id"), (F.col("row") == F.col("top.row")).alias("first")).unionByName(alone)


def near_dedup(docs: DataFrame, *, width: int = 4, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are what white space (space and the characters 9 to 13) parts, A-Z lower-cased; a text's set holds its distinct runs of ``width`` words, or all
    its words as one run if it has fewer. Texts with percent / 100 of their union in common are linked. component_id is the smallest doc_id that can be reached, itself
    included. Null and empty texts, and texts of white space, have the empty set and no links. Null doc_id: never the smallest; if a
    component has no other, component_id is null and all its rows are kept. Rows repeated with the same doc_id are kept or dropped together. Empty
    table: no rows. Other columns are not read. Sets are sets of 64-bit hashes of the runs.
    """
    return near_components(docs, width=width, percent=percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def keep_one(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs, with all their columns: one of each component, that with the smallest doc_id.

    Of rows that repeat its doc_id and text one stays, by a hash of the other columns; of a component without any doc_id, one row. Texts without words all stay.
    """
    mine = dict(zip(("doc_id", "key", "one", "alone", "rank"), unused(docs, "near_id", "near_key", "near_one", "near_alone", "near_rank"), strict=True))
    rows = near_components(docs, width=width, percent=percent).where("first").select("doc_id", "key", (F.col("n") > 0).alias("one")).distinct()
    rows = rows.withColumnsRenamed({c: mine[c] for c in ("doc_id", "key", "one")})
    kept = docs.join(rows.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(mine["doc_id"])) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(mine["key"])))
    kept = kept.withColumn(mine["alone"], F.when(F.col(mine["one"]), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id()))
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind and c != "text"]
    by = Window.partitionBy(mine["doc_id"], mine["key"], mine["alone"]).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in plain]))
    return kept.withColumn(mine["rank"], F.row_number().over(by)).where(F.col(mine["rank"]) == 1).select(*[f"`{c}`" for c in docs.columns])


def oracle(width: int = 4, percent: int = 80) -> str:
    """The same result in DuckDB's SQL, by all shared runs."""
    return rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {width}, 0) + 1)) AS i FROM d WHERE len(w) > 0),
        s AS (SELECT DISTINCT doc_id, w[i + 1 : i + {width}] AS run FROM p),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.run = y.run AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) USING (doc_id)"""
