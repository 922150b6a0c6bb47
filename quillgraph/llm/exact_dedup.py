"""Exact deduplication by an extendible-hash index on shared files.

1. Each map task folds its own copies: rows of equal text become one *entry* (key, bytes, member ids). Entries
   are pages in the shared folder, so that a text that a third of all rows hold leaves each task once.
2. The directory starts with one bucket. A bucket whose entries weigh more than a page doubles into two on the
   next bit of the key, until none is overfull or one single key fills it. Bucket capacity grows with the input,
   so the directory has a bound (``directory_limit`` buckets and the two halves of each).
3. A bucket is a contiguous range of keys. Owner tasks take ranges, read entries in key order, chain the
   entries whose key is equal, and compare bytes: equal bytes are one class, others a new link of the chain. Bytes go to
   the owners only for keys that several entries have.
4. Entries learn their class from the index; members are read from the pages and never pass an owner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import WORD_GAPS, parts_for, shared_dir, utf8, written

KEY_BITS = 62
ENTRY = "entry long, key long, sha string, bytes binary, weight long, n long, best_cp long, best_id long, ids array<long>, rows array<long>"
OWNED = "entry long, keep_id long, group_size long"


def key_of(digest: bytes) -> int:
    """The index key: the first 62 bits of the digest, never negative."""
    return int.from_bytes(digest[:8], "big") >> 2


def better(cp: int, doc: int | None, best: tuple[int, int | None]) -> bool:
    """More code points first, then the smaller id; null ids come last."""
    return (-cp, doc is None, doc or 0) < (-best[0], best[1] is None, best[1] or 0)


def _fold(batches: Iterator[pa.RecordBatch], page_bytes: int, page_rows: int, key=key_of) -> Iterator[pa.RecordBatch]:
    """Entries of one task. What is held is bounded by page_bytes and page_rows; a text seen again later is a new entry."""
    part, serial, held, open_ = TaskContext.get().partitionId() if TaskContext.get() else 0, 0, 0, {}
    schema = pa.schema([("entry", pa.int64()), ("key", pa.int64()), ("sha", pa.string()), ("bytes", pa.binary()), ("weight", pa.int64()), ("n", pa.int64()), ("best_cp", pa.int64()), ("best_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64()))])

    def page() -> pa.RecordBatch:
        nonlocal serial, held
        cols: list[list] = [[] for _ in schema]
        for text, (digest, best, ids, nulls) in open_.items():
            row = ((part << 33) | serial, key(digest), digest.hex(), text, len(text) + 64, len(ids) + nulls, best[0], best[1], ids, [None] * nulls)
            serial += 1
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        open_.clear()
        held = 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    rows = 0
    for batch in batches:
        data, at = utf8(batch.column("text"))
        blob, ids = data.tobytes(), batch.column("doc_id").to_pylist()
        for i, doc in enumerate(ids):
            raw = blob[at[i] : at[i + 1]]
            text, cp = raw.translate(None, WORD_GAPS), len(raw) if raw.isascii() else len(raw.decode(errors="replace"))
            if (entry := open_.get(text)) is None:
                open_[text] = [hashlib.sha256(text).digest(), (cp, doc), [], 0]
                entry, held = open_[text], held + len(text) + 200
            elif better(cp, doc, entry[1]):
                entry[1] = (cp, doc)
            if doc is None:
                entry[3] += 1
            else:
                entry[2].append(doc)
            rows += 1
            if held >= page_bytes or rows >= page_rows:
                rows = 0
                yield page()
    if open_:
        yield page()


def directory(keys: DataFrame, bucket_bytes: int, directory_limit: int) -> list[tuple[int, int, int]]:
    """Buckets as (first key, last key, depth) in key order, by doubling from one bucket of depth 0.

    keys has key and weight. Each round counts the overfull buckets' halves only. At most directory_limit buckets
    can be overfull, as the capacity is at least the total weight over directory_limit; that bounds the driver's list.
    """
    n, total, low, high = keys.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0)), F.min("key"), F.max("key")).first()
    capacity = max(bucket_bytes, -(-int(total) // directory_limit))
    done, full = [], [(0, 0)] if n and total > capacity and low != high else []
    if not full:
        return [(0, (1 << KEY_BITS) - 1, 0)]
    while full:
        depth = full[0][1] + 1
        half = F.shiftright("key", KEY_BITS - depth)
        kept = keys if depth == 1 else keys.join(F.broadcast(keys.sparkSession.createDataFrame([(p,) for p, _ in full], "parent long")), F.shiftright("key", KEY_BITS - depth + 1) == F.col("parent"), "left_semi")
        found = {r[0]: r[1:] for r in kept.groupBy(half.alias("p")).agg(F.sum("weight"), F.min("key"), F.max("key")).collect()}
        again = []
        for parent, _ in full:
            for p in (2 * parent, 2 * parent + 1):
                weight, first, last = found.get(p, (0, 0, 0))
                if weight > capacity and first != last and depth < KEY_BITS:
                    again.append((p, depth))
                else:
                    done.append((p << (KEY_BITS - depth), ((p + 1) << (KEY_BITS - depth)) - 1, depth))
        full = again
    return sorted(done)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries come in key order. One key's chain holds one copy of each different text and the entries' numbers."""
    now, chain = None, []

    def out() -> pa.RecordBatch:
        entries, keeps, sizes = [], [], []
        for _, best, size, members in chain:
            entries += members
            keeps += [best[1]] * len(members)
            sizes += [size] * len(members)
        return pa.RecordBatch.from_arrays([pa.array(entries, pa.int64()), pa.array(keeps, pa.int64()), pa.array(sizes, pa.int64())], ["entry", "keep_id", "group_size"])

    for batch in batches:
        names = batch.schema.names
        cols = [batch.column(names.index(c)) for c in ("entry", "key", "bytes", "n", "best_cp", "best_id")]
        for i in range(batch.num_rows):
            entry, key, text, n, cp, doc = (c[i].as_py() for c in cols)
            if key != now:
                if chain:
                    yield out()
                now, chain = key, []
            for link in chain:
                if link[0] == text:
                    if better(cp, doc, link[1]):
                        link[1] = (cp, doc)
                    link[2] += n
                    link[3].append(entry)
                    break
            else:
                chain.append([text, (cp, doc), n, [entry]])
    if chain:
        yield out()


def exact_dedup(docs: DataFrame, *, page_bytes: int = 32 << 20, page_rows: int = 20_000, bucket_bytes: int = 16 << 20, directory_limit: int = 4096, broadcast_keys: int = 1_000_000) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Two texts are equal if they are identical once space, tab, line feed, vertical tab, form feed and carriage
    return are deleted. The row with the most code points in its original text stays, then the smallest doc_id.
    Null text: the empty text. Null doc_id: a row like any other, after all ids in ties; its keep_id is null if it
    is the one that stays, and kept is then true for each null id of the group, since nothing tells them apart.
    Rows repeated with the same doc_id: each counts in group_size, and all of them are kept if the id is.
    Empty table: no rows. Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    root = shared_dir(spark, "exact")
    pages = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _fold(it, page_bytes, page_rows), ENTRY), f"{root}/pages")
    buckets = directory(pages.select("key", "weight"), bucket_bytes, directory_limit)
    starts = F.array(*[F.lit(b[0]) for b in buckets]) if len(buckets) <= 1 else None
    # a key that one entry has alone needs no comparison, so its bytes stay where they are
    several = pages.groupBy("key").agg(F.count("*").alias("entries")).where("entries > 1").select("key", F.lit(True).alias("several"))
    several = written(several, f"{root}/several")
    if several.limit(broadcast_keys + 1).count() <= broadcast_keys:
        several = F.broadcast(several)
    index = pages.select("entry", "key", "bytes", "n", "best_cp", "best_id").join(several, "key", "left").withColumn("bytes", F.when(F.col("several"), F.col("bytes"))).drop("several")
    if starts is None:
        at = spark.createDataFrame([(n, first >> (KEY_BITS - depth), depth) for n, (first, _, depth) in enumerate(buckets)], "bucket long, prefix long, depth int")
        depths = sorted({b[2] for b in buckets})
        index = index.withColumn("tries", F.array(*[F.struct(F.shiftright("key", KEY_BITS - d).alias("prefix"), F.lit(d).alias("depth")) for d in depths]))
        index = index.withColumn("t", F.explode("tries")).join(F.broadcast(at), (F.col("t.prefix") == F.col("prefix")) & (F.col("t.depth") == F.col("depth"))).drop("tries", "t", "prefix", "depth")
    else:
        index = index.withColumn("bucket", F.lit(0).cast("long"))
    owned = index.repartition(min(len(buckets), 8 * parts_for(spark)), "bucket").sortWithinPartitions("key", "entry").select("entry", "key", "bytes", "n", "best_cp", "best_id").mapInArrow(_own, OWNED)
    classes = written(owned, f"{root}/index")
    members = pages.select("entry", "sha", F.concat("ids", "rows").alias("ids")).join(classes, "entry").withColumn("doc_id", F.explode("ids"))
    return members.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), F.col("sha").alias("text_sha256"))
