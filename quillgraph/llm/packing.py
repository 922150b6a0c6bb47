"""Variable-capacity best-fit packing of documents into training sequences.

Documents are cut into pieces no longer than the largest permitted sequence. Pieces are dealt to shards by a hash;
each shard is packed on its own, longest piece first. A piece goes to the open bin that it fills best. If none has
room, all permitted sizes are planned against the lengths that are still to come: what the longest of them that fit would
put into the bin, and what the bin would cost for each word once it shrinks to that. The size with the least cost opens. A
sequence costs its length, the square of its length in attention, and an overhead; so short pieces have short sequences of
their own, and long sequences open for what needs them. In the end each bin shrinks to the least permitted size that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import parts_for, shared_dir, written

WORD = r"[^\x20\x09-\x0D]+"
PACKED = "shard int, bin int, capacity int, used int, place int, offset int, doc_id long, piece int, start long, length int"


def cost(capacity: int, overhead: int, attention: int) -> float:
    """Of a sequence: its length, which is padded and paid in full, the attention within it, as much again at a length of ``attention``, and what any sequence costs besides."""
    return capacity + capacity * capacity / attention + overhead


def best_fit(lengths: list[int], capacities: list[int], overhead: int, attention: int) -> tuple[list[int], list[int]]:
    """(bin of each piece, capacity of each bin). lengths are in falling order and at most the largest capacity; capacities rise."""
    falls, sums = [-n for n in lengths], [0, *accumulate(lengths)]

    def planned(at: int, room: int) -> int:
        """Words that the pieces from number ``at`` on would put there, each one that still fits, the longest first."""
        left = room
        while left and (at := bisect_left(falls, -left, at)) < len(falls):
            end = bisect_right(sums, sums[at] + left, at) - 1  # as many in a row as fit
            left -= sums[end] - sums[at]
            at = end
        return room - left

    shrunk = lambda used: capacities[bisect_left(capacities, used)]
    room: list[tuple[int, int]] = []  # (words left, bin), in order
    bins, used = [], []
    for i, n in enumerate(lengths):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            b = len(used)
            plans = [(c, n + planned(i + 1, c - n)) for c in capacities if c >= n]
            left = min(plans, key=lambda p: (cost(shrunk(p[1]), overhead, attention) / p[1], p[0]))[0]
            used.append(0)
        bins.append(b)
        used[b] += n
        if left - n:
            insort(room, (left - n, b))
    return bins, [shrunk(u) for u in used]


def _pack(batches: Iterator[pa.RecordBatch], capacities: list[int], overhead: int, attention: int) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, longest first; a row stands for ``copies`` pieces that are alike."""
    schema = pa.schema([("shard", pa.int32()), ("bin", pa.int32()), ("capacity", pa.int32()), ("used", pa.int32()), ("place", pa.int32()), ("offset", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32())])
    now, held = None, []

    def packed() -> pa.RecordBatch:
        bins, sizes = best_fit([x[3] for x in held], capacities, overhead, attention)
        fill, count, rows = [0] * len(sizes), [0] * len(sizes), []
        for b, (doc, piece, start, n) in zip(bins, held, strict=True):
            rows.append([now, b, sizes[b], 0, count[b], fill[b], doc, piece, start, n])
            fill[b] += n
            count[b] += 1
        for r, b in zip(rows, bins, strict=True):
            r[3] = fill[b]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        for shard, doc, piece, start, n, copies in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "piece", "start", "length", "copies")), strict=True):
            if held and shard != now:
                yield packed()
                held.clear()
            now = shard
            held += [(doc, piece, start, n)] * copies
    if held:
        yield packed()


def pack(docs: DataFrame, *, capacities: tuple[int, ...] = (512, 1024, 2048, 4096), overhead: int = 64, attention: int = 8192, shard_words: int = 4_000_000, shard_pieces: int = 50_000, copies: int = 1000) -> DataFrame:
    """A row per piece: shard, bin (a number within the shard), capacity, used, place, offset, doc_id, piece, start, length.

    Lengths are in words between white space, each text having one more for the mark that ends it (the last piece holds it). Piece
    p of a text starts at its word ``start``; it is the bin's piece number ``place`` and begins at the bin's word ``offset``. The pieces of
    a text cover all its words once. Null and empty texts are one piece of one word, the mark. Null doc_ids and rows that repeat
    are packed like any other. Empty table: no rows. Other columns are not read. There are so many shards that one holds about ``shard_words`` words and
    ``shard_pieces`` pieces at most. Rows that repeat an id and a text are counted, and ``copies`` of them at most share a shard. The result depends on the rows alone, not on how they are dealt out.
    """
    spark = docs.sparkSession
    sizes, largest = sorted(set(capacities)), max(capacities)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("h"), (F.regexp_count(text, F.lit(WORD)) + 1).cast("long").alias("words"))
    slim = written(slim.groupBy("doc_id", "h", "words").agg(F.count("*").alias("n")), f"{shared_dir(spark, 'packing')}/lengths")
    count = F.floor((F.col("words") - 1) / largest) + 1
    total, number = slim.agg(F.coalesce(F.sum(F.col("words") * F.col("n")), F.lit(0)), F.coalesce(F.sum(count * F.col("n")), F.lit(0))).first()
    shards = max(1, round(total / shard_words), -(-number // shard_pieces))
    parts = slim.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / copies)))).withColumn("copies", F.least(F.lit(copies), F.col("n") - F.col("part") * copies).cast("int"))
    pieces = parts.withColumn("piece", F.explode(F.sequence(F.lit(0), (count - 1).cast("int")))).withColumn("start", F.col("piece").cast("long") * largest)
    pieces = pieces.withColumn("length", F.least(F.col("words") - F.col("start"), F.lit(largest)).cast("int")).withColumn("shard", F.pmod(F.xxhash64("h", "piece", "part"), F.lit(shards)).cast("int"))
    dealt = pieces.select("shard", "doc_id", "piece", "start", "length", "copies", "h", "part").repartition(min(shards, 8 * parts_for(spark)), "shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece", "h", "part")
    return dealt.mapInArrow(lambda it: _pack(it, sizes, overhead, attention), PACKED)


def bins(packed: DataFrame) -> DataFrame:
    """A row per bin: shard, bin, capacity, used, pieces (place order) as arrays doc_ids, starts, lengths. A bin holds at most ``capacity`` pieces."""
    parts = F.sort_array(F.collect_list(F.struct("place", "doc_id", "start", "length")))
    return packed.groupBy("shard", "bin", "capacity", "used").agg(parts.alias("p")).select("shard", "bin", "capacity", "used", F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"), F.col("p.length").alias("lengths"))


def texts(docs: DataFrame, packed: DataFrame, end: str = "<|end|>") -> DataFrame:
    """packed with the words of each piece as ``text``, joined by spaces; the last piece of a document ends in the mark. Needs unique doc_ids."""
    words = F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(words, F.array(F.lit(end))).alias("words"))
    return packed.join(whole, "doc_id").withColumn("text", F.array_join(F.slice("words", F.col("start").cast("int") + 1, F.col("length")), " ")).drop("words")
