"""WARC archives: a deterministic sharded writer and a reader.

Records are sorted by page_id in ranges. The ranges come from exact byte counts of page_id cells, refined where a
cell is overfull, so they depend on the rows alone: the same pages give the same files, byte for byte, whatever
the partitioning. Ranges are dealt to tasks one by one; a task writes its range under temporary names and rolls a file once its compressed
size reaches ``roll_bytes``, several times in a range. Spark commits the manifest of finished files as a table; only files that it lists get their final
names, so attempts that failed or ran twice leave nothing behind that counts.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import parts_for, remove, shared_dir, written

#: The WARC standard's names of its two record types here, and its profile for a payload seen before.
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "temporary string, file string, records long, bytes long, sha256 string"
CELLS = 1024


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def ranges(slim: DataFrame, target: int) -> list[int]:
    """First page_id of each range but the first. slim: page_id, weight. Cells that alone exceed ``target`` are counted again, finer: one job a level, all such cells in it."""
    low, high = slim.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None:
        return []
    kind = "bigint" if high - low < 1 << 62 else "decimal(38,0)"
    left, width, starts = slim.withColumn("rest", F.expr(f"cast(page_id as {kind}) - {low}")).withColumn("cell", F.lit(0).cast("long")), high - low + 1, [low]
    done: list[tuple[int, int]] = []
    while starts:  # starts: of the cells that are cut up now, by number; at most total weight / target of them
        inner = -(-width // CELLS)
        left = left.withColumn("c", F.expr(f"cast(rest div {inner} as bigint)")).withColumn("rest", F.expr(f"cast(rest % {inner} as {kind})"))
        full = {}
        for cell, c, weight in left.groupBy("cell", "c").agg(F.sum("weight")).collect():
            first = starts[cell] + c * inner
            if weight > target and inner > 1:
                full[(cell, c)] = first
            else:
                done.append((first, int(weight)))
        starts, width = list(full.values()), inner
        if full:
            again = left.sparkSession.createDataFrame([(*k, n) for n, k in enumerate(full)], "cell long, c long, next long")
            left = left.join(F.broadcast(again), ["cell", "c"]).select("weight", "rest", F.col("next").alias("cell"))
    cuts, held = [], 0
    for start, weight in sorted(done):
        if held and held + weight > target:
            cuts.append(start)
            held = 0
        held += weight
    return cuts


def _header(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def _member(header: bytes, block: bytes, level: int) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)  # 31: a gzip member with no time in it
    return squeeze.compress(header) + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def record_id(page_id: int | None, digest: str, ordinal: int, url: str | None) -> str:
    """ordinal tells apart records of the same page_id and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{ordinal}/{url}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, ordinal: int, refers_to: int | None, refers_url: str | None, date: str, level: int) -> bytes:
    """One compressed record. A revisit names the response, which is the first record of its page_id and payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields: list[tuple[str, object]] = [("WARC-Type", RESPONSE if refers_to is None else REVISIT), ("WARC-Record-ID", record_id(page_id, digest, ordinal, url)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(url.split())))
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, 0, refers_url)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-ID", refers_to)]
        if refers_url is not None:
            fields.append(("WARC-Refers-To-Target-URI", "".join(refers_url.split())))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("X-Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return _member(_header(fields), block, level)


class _Shard:
    """The files of one range, written in order; a finished one is a row of the manifest."""

    def __init__(self, out: str, rng: int, roll_bytes: int, level: int, date: str):
        self.out, self.rng, self.roll, self.level, self.date, self.seq, self.sink = out, rng, roll_bytes, level, date, 0, None
        self.fs, self.top = _opened(out)
        self.done: list[tuple] = []

    def _open(self) -> None:
        self.file = f"part-{self.rng:06d}-{self.seq:05d}.warc.gz"
        self.temporary = f"_temporary/{self.file}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.top}/_temporary", recursive=True)
        self.sink, self.sum, self.bytes, self.records = self.fs.open_output_stream(f"{self.top}/{self.temporary}", compression=None), hashlib.sha256(), 0, 0
        info = f"software: quillgraph\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.file}\r\n".encode()
        name = uuid.uuid5(uuid.NAMESPACE_URL, self.file)
        self._put(_member(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", self.date), ("WARC-Filename", self.file), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]), info, self.level))

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.sum.update(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        if self.sink is None:
            self._open()
        self._put(data)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.done.append((self.temporary, self.file, self.records, self.bytes, self.sum.hexdigest()))
            self.sink, self.seq = None, self.seq + 1


def _write(batches: Iterator[pa.RecordBatch], out: str, roll_bytes: int, level: int, date: str) -> Iterator[pa.RecordBatch]:
    """Rows by range, page_id, digest; a row without payload (kind 0) says what the records after it refer to."""
    shard, last, said, said_url, ordinal, written_here = None, None, None, None, 0, False

    def rows(shard: _Shard) -> pa.RecordBatch:
        shard.close()
        return pa.RecordBatch.from_pylist([dict(zip(("temporary", "file", "records", "bytes", "sha256"), x, strict=True)) for x in shard.done], schema=pa.schema([("temporary", pa.string()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    for batch in batches:
        rng, page, digest, kind, first, url, payload = (batch.column(batch.schema.names.index(c)) for c in ("rng", "page_id", "digest", "kind", "first", "url", "payload"))
        for i in range(batch.num_rows):
            at = rng[i].as_py()
            if shard is None or shard.rng != at:
                if shard is not None:
                    yield rows(shard)
                shard, last = _Shard(out, at, roll_bytes, level, date), None
            key = (page[i].as_py(), digest[i].as_py())
            if key != last:
                last, said, said_url, ordinal, written_here = key, None, None, 0, False
            if kind[i].as_py() == 0:
                said, said_url = first[i].as_py(), url[i].as_py()
                continue
            body = payload[i].as_py()
            to = said
            if to is not None and to == key[0] and not written_here:
                to, written_here = None, True  # the response itself; the same row again revisits it
            shard.add(record(key[0], url[i].as_py(), body, key[1], ordinal, to, said_url, date, level))
            ordinal += 1
    if shard is not None:
        yield rows(shard)


def _commit(batches: Iterator[pa.RecordBatch], out: str) -> Iterator[pa.RecordBatch]:
    """Give listed files their final names. Done again after a lost executor, it finds them and goes on."""
    store, top = _opened(out)
    for batch in batches:
        for row in batch.to_pylist():
            if store.get_file_info(f"{top}/{row['temporary']}").type == fs.FileType.File:
                store.move(f"{top}/{row['temporary']}", f"{top}/{row['file']}")
            if store.get_file_info(f"{top}/{row['file']}").size != row["bytes"]:
                raise OSError(f"{row['file']} is not the file that the manifest lists")
        yield batch


def write_warc(pages: DataFrame, out: str, *, range_bytes: int = 96 << 20, roll_bytes: int = 8 << 20, range_limit: int = 100_000, level: int = 4, least: int = 100, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of pages (page_id, url, html) below out and return the manifest (file, records, bytes, sha256).

    A range holds about ``range_bytes`` of payloads, or more where there would be over ``range_limit`` ranges; its files roll at ``roll_bytes``
    compressed. Of records with equal payloads of at least ``least`` bytes, that with the smallest page_id is a response and the
    others are revisits of it; smaller payloads are all responses. Null html: an empty payload. Null page_id: records
    of ranges of their own, dealt by payload; they revisit the smallest id of their payload, and are responses if it has none. The same
    page_id and payload in several rows: the first is the response, the rest revisit it. Null url: no target URI.
    Other columns are not read. Empty table: an empty manifest and no files.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    slim = written(rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size")), f"{out}/_digests")
    weighed = slim.select("page_id", (F.col("size") + 512).alias("weight"))
    total, loose = weighed.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("page_id").isNull(), F.col("weight"))), F.lit(0))).first()
    target = max(range_bytes, -(-int(total) // range_limit))
    cuts = ranges(weighed.where("page_id is not null"), target)
    named, unnamed = len(cuts) + 1, max(1, -(-int(loose) // target))
    told = spark.sparkContext.broadcast(np.array(cuts, np.int64))  # range_limit numbers at most

    @F.pandas_udf("int")
    def rng_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(told.value, ids.to_numpy(np.int64), "right").astype(np.int32))

    first = F.min(F.struct("page_id", "url")).alias("first")
    same = slim.where((F.col("size") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(first)
    often = slim.where(F.col("size") >= least).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    said = slim.select("page_id", "digest").join(same.join(often, "digest"), "digest").select("page_id", "digest", F.lit(0).alias("kind"), F.col("first.page_id").alias("first"), F.col("first.url").alias("url")).distinct()
    both = rows.select("page_id", F.sha2("payload", 256).alias("digest"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first"), "url", "payload").unionByName(said.withColumn("payload", F.lit(None).cast("binary")))
    rng = F.when(F.col("page_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(unnamed)).cast("int") + named).otherwise(rng_of(F.coalesce("page_id", F.lit(0).cast("long"))))
    tasks = min(named + unnamed, 8 * parts_for(spark))
    dealt = both.withColumn("rng", rng).repartitionById(tasks, F.col("rng") % tasks).sortWithinPartitions("rng", "page_id", "digest", "kind", "url")
    manifest = written(dealt.mapInArrow(lambda it: _write(it, out, roll_bytes, level, date), MANIFEST), f"{out}/_attempted")
    done = written(manifest.repartition(parts_for(spark), "file").mapInArrow(lambda it: _commit(it, out), MANIFEST), f"{out}/manifest").select("file", "records", "bytes", "sha256")
    for old in ("_digests", "_attempted", "_temporary"):  # with what attempts that failed have left
        remove(spark, f"{out}/{old}")
    return done


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a file of gzip members, one record in memory at a time."""
    rest = b""
    chunks = iter(chunks)
    while True:
        open_, parts = zlib.decompressobj(31), []
        while not open_.eof:
            if not rest:
                rest = next(chunks, b"")
                if not rest:
                    if parts:
                        raise OSError("the file ends within a record")
                    return
            parts.append(open_.decompress(rest))
            rest = open_.unused_data
        head, _, tail = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        block = tail[: int(fields["Content-Length"])]
        if lines[0] != "WARC/1.1" or tail[len(block) :] != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
            raise OSError("not a WARC record")
        yield fields, block


def _read(batches: Iterator[pa.RecordBatch], out: str, with_payload: bool) -> Iterator[pa.RecordBatch]:
    store, top = _opened(out)

    def chunks(path: str) -> Iterator[bytes]:
        with store.open_input_stream(path, compression=None) as f:
            while piece := f.read(1 << 20):
                yield piece

    schema = pa.schema([("file", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + [("payload", pa.binary())] * with_payload)
    for batch in batches:
        for file in batch.column(0).to_pylist():
            held, size = [], 0
            for fields, block in records(chunks(f"{top}/{file}")):
                if fields["WARC-Type"] == "warcinfo":
                    continue
                payload = block.partition(b"\r\n\r\n")[2]
                kind, number = fields["WARC-Type"], lambda k: int(fields[k]) if k in fields else None  # noqa: B023
                digest = hashlib.sha256(payload).hexdigest() if kind == RESPONSE else fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if fields["WARC-Payload-Digest"] != f"sha256:{digest}" or kind == RESPONSE and len(payload) != number("X-Payload-Length"):
                    raise OSError(f"{file}: a payload differs from its digest")
                held.append({"file": file, "page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": number("X-Refers-To-Page-ID"), "payload_bytes": number("X-Payload-Length"), "payload_digest": digest} | ({"payload": payload} if with_payload else {}))
                size += len(payload) if with_payload else 200
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, schema=schema)


def read_warc(manifest: DataFrame, out: str, *, with_payload: bool = False) -> DataFrame:
    """A row per response or revisit record of the manifest's files: file, page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, and payload (empty for revisits) if asked for. Digests are checked."""
    kinds = "file string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    return manifest.select("file").repartition(4 * parts_for(manifest.sparkSession), "file").mapInArrow(lambda it: _read(it, out, with_payload), kinds)


def warc_round_trip(pages: DataFrame, **how) -> DataFrame:
    """Write the pages into a new shared folder, read the archives back; see write_warc and read_warc."""
    out = shared_dir(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, out, **how), out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
