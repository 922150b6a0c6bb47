"""Line deduplication by a suffix array over line numbers, in DataFrame functions alone.

Every line has a number; equal lines have the same. The rank R_k of a place orders the suffixes that start there by
their first 2^k lines. Prefix doubling gives R_(k+1) from the pair (R_k here, R_k 2^k lines on): distinct pairs are sorted
in ranges and numbered in that order. A place whose rank no other place shares can take part in no longer repeat, and
leaves. An LCP interval of depth m is the set of suffixes that share m lines; two ranks that overlap, R_k at its
start and R_k 2^k lines before its end with 2^k <= m < 2^(k+1), identify it.

A repeated run counts if it has ``least_words`` words. A line lies in a maximal repeated run of at least so many
words exactly if it lies in a shortest stretch with so many words, seen from its first line or from its last, that
occurs earlier too. So those stretches are looked up among the intervals, and what they cover in later copies
is deleted. Earlier is by doc_id, then by a hash of the text, then by line; runs end at the end of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.common import parts_for, remove, shared_dir, unused, written

DOC = ("doc_id", "key")
#: Words of a repeated run that counts: blank lines and scraps of a few words are spared where they stand alone, not within longer repeats.
LEAST_WORDS = 5
WORD = r"[^\x20\x09-\x0D]+"


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.split(text, "\n").alias("lines"))


def _same_doc(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"])


def _stretches(lines: DataFrame, least_words: int) -> DataFrame:
    """doc_id, key, a, m: the shortest stretches of least_words words from each line on and back from each line, within a document.

    Each line is two points on the axis of words before it, its start and its end; a running last() over
    the sorted points finds for each the nearest end or start that is far enough.
    """
    ahead = [F.struct((F.col("before") + least_words).alias("v"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("at"), F.col("idx").alias("ask")), F.struct(F.col("after").alias("v"), F.lit(1).alias("kind"), F.col("idx").alias("at"), F.lit(None).cast("int").alias("ask"))]
    behind = [F.struct((F.col("after") - least_words).alias("v"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("at"), F.col("idx").alias("ask")), F.struct(F.col("before").alias("v"), F.lit(0).alias("kind"), F.col("idx").alias("at"), F.lit(None).cast("int").alias("ask"))]
    doc = Window.partitionBy(*DOC)
    up = doc.orderBy("e.v", "e.kind", "e.at").rowsBetween(Window.unboundedPreceding, 0)
    down = doc.orderBy(F.desc("e.v"), F.desc("e.kind"), F.desc("e.at")).rowsBetween(Window.unboundedPreceding, 0)
    forth = lines.select(*DOC, F.explode(F.array(*ahead)).alias("e")).select(*DOC, "e.ask", F.last("e.at", ignorenulls=True).over(down).alias("to")).where("ask is not null and to is not null").select(*DOC, F.col("ask").alias("a"), (F.col("to") - F.col("ask") + 1).alias("m"))
    back = lines.select(*DOC, F.explode(F.array(*behind)).alias("e")).select(*DOC, "e.ask", F.last("e.at", ignorenulls=True).over(up).alias("from")).where("ask is not null and from is not null").select(*DOC, F.col("from").alias("a"), (F.col("ask") - F.col("from") + 1).alias("m"))
    return forth.unionByName(back).distinct()


def _ranked(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Distinct rows that occur twice and more, numbered in the order of ``by``."""
    twice = pairs.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by)
    return twice.repartitionByRange(parts_for(twice.sparkSession), *by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id())


def repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, key, runs: for each text with lines to delete, the sorted array of (first, last) line numbers, from 0."""
    spark = docs.sparkSession
    root = shared_dir(spark, "lines")
    each = _keyed(docs).select(*DOC, F.posexplode("lines").alias("idx", "line"))
    each = each.select(*DOC, "idx", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("words"))
    once = each.repartition(*DOC).groupBy(*DOC, "idx").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.first("words").alias("words"))
    after = F.sum("words").over(Window.partitionBy(*DOC).orderBy("idx"))
    lines = written(once.withColumn("after", after).withColumn("before", F.col("after") - F.col("words")), f"{root}/lines")
    # ranks of single lines; places of lines that occur once leave here
    number = written(_ranked(lines, ["h1", "h2"]), f"{root}/rank0")
    places = written(lines.select(*DOC, "idx", "h1", "h2").join(number, ["h1", "h2"]).select(*DOC, "idx", F.col("rank").alias("r")), f"{root}/places0")
    wanted = _stretches(lines, least_words).withColumn("k", F.expr("63 - length(regexp_extract(lpad(bin(m), 64, '0'), '^0*', 0))"))
    # a stretch stays if its first and last lines occur elsewhere too
    ends = places.select(*DOC, "idx")
    wanted = wanted.join(ends, _on(wanted, ends, "a", "idx"), "left_semi")
    last = wanted.withColumn("z", F.col("a") + F.col("m") - 1)
    wanted = written(last.join(ends, _on(last, ends, "z", "idx"), "left_semi").drop("z"), f"{root}/stretches")
    top = wanted.agg(F.max("k")).first()[0]
    found = None
    for k in range(0 if top is None else top + 1):
        step = 1 << k
        here = wanted.where(F.col("k") == k)
        tail = here.withColumn("z", F.col("a") + F.col("m") - step)
        one = places.select(*DOC, "idx", "r")
        first = tail.join(one, _on(tail, one, "a", "idx")).select(tail["doc_id"], tail["key"], "a", "m", "z", F.col("r").alias("r1"))
        two = places.select(*DOC, "idx", "r")
        both = first.join(two, _on(first, two, "z", "idx")).select(first["doc_id"], first["key"], "a", "m", "r1", F.col("r").alias("r2"))
        both = written(both, f"{root}/depth{k}")
        order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"), F.col("a").alias("a"))
        interval = written(both.groupBy("m", "r1", "r2").agg(F.count("*").alias("n"), F.min(order).alias("earliest")).where("n > 1").drop("n"), f"{root}/intervals{k}")
        later = both.join(interval, ["m", "r1", "r2"]).where(F.col("earliest") != order).select(*DOC, F.col("a").alias("s"), (F.col("a") + F.col("m") - 1).alias("e"))
        found = later if found is None else found.unionByName(later)
        if k < top:
            ahead = F.max("r").over(Window.partitionBy(*DOC).orderBy("idx").rangeBetween(step, step))
            doubled = written(places.withColumn("r2", ahead).where("r2 is not null"), f"{root}/pairs{k}")
            number = written(_ranked(doubled, ["r", "r2"]), f"{root}/rank{k + 1}")
            now = written(doubled.join(number, ["r", "r2"]).select(*DOC, "idx", F.col("rank").alias("r")), f"{root}/places{k + 1}")
            for old in (f"places{k}", f"pairs{k}", f"rank{k + 1}"):
                remove(spark, f"{root}/{old}")
            places = now
    if found is None:
        return spark.createDataFrame([], "doc_id long, key long, runs array<struct<s int, e int>>")
    by = Window.partitionBy(*DOC).orderBy("s", "e")
    reach = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    apart = found.withColumn("new", F.coalesce(F.col("s") > reach + 1, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = apart.groupBy(*DOC, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return written(spans.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("runs")), f"{root}/runs")


def _on(a: DataFrame, b: DataFrame, x: str, y: str) -> Column:
    return _same_doc(a, b) & (a[x] == b[y])


def _kept(lines: str, runs: str) -> Column:
    """The lines outside the runs: what lies between the end of one run and the start of the next."""
    at = F.concat(F.array(F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"))), F.col(runs), F.array(F.struct(F.size(lines).alias("s"), F.size(lines).alias("e"))))
    gaps = F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1), lambda x, y: F.slice(F.col(lines), x["e"] + 2, y["s"] - x["e"] - 1))
    return F.flatten(gaps)


def _cleaned(docs: DataFrame, least_words: int) -> tuple[DataFrame, str, str, str]:
    """docs with three more columns, and their names: the runs (null if nothing is deleted), the lines, the text that stays."""
    runs = repeated_lines(docs, least_words)
    doc, key, gone, lines, kept = unused(docs, "run_id", "run_key", "runs", "lines", "kept_text")
    runs = runs.select(F.col("doc_id").alias(doc), F.col("key").alias(key), F.col("runs").alias(gone))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # texts and runs always meet by a shuffle: what is broadcast at a small size would not be at a large one
    both = docs.join(runs.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(key)), "left").withColumn(lines, F.split(text, "\n"))
    return both.withColumn(kept, F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(_kept(lines, gone), "\n"))), gone, lines, kept


def line_dedup(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_deleted, runs, text.

    runs lists the deleted runs as first-last (line numbers from 0), joined by commas; text is what stays, its lines joined by line feeds.
    Lines are what line feeds part; they are equal if identical. Null text: stays null, one empty line. Rows with the same doc_id (or null) and
    text are one document: all get the same result. Null doc_ids come last in the order. A text of which every line goes becomes empty. Empty
    table: no rows. Other columns are not read.
    """
    both, gone, lines, kept = _cleaned(docs.select("doc_id", "text"), least_words)
    none = F.array().cast("array<struct<s:int,e:int>>")
    runs = F.coalesce(gone, none)
    return both.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size(lines).cast("long").alias("n_lines"),
        F.aggregate(runs, F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"] + 1).alias("n_deleted"),
        F.array_join(F.transform(runs, lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ",").alias("runs"),
        F.col(kept).alias("text"),
    )


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """All rows and columns of docs, text without the later copies of repeated runs; n_chars, where there is one, follows the new text."""
    both, gone, _, kept = _cleaned(docs, least_words)
    new = {"text": F.col(kept)} | ({"n_chars": F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.char_length(kept)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return both.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def oracle(least_words: int = LEAST_WORDS) -> str:
    """The same result in DuckDB's SQL, by comparing the stretches themselves."""
    return rf"""
        WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, text FROM documents),
        e AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS idx FROM l),
        w AS (SELECT doc_id, idx, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM e),
        c AS (SELECT doc_id, idx, words, sum(words) OVER (PARTITION BY doc_id ORDER BY idx) AS after FROM w),
        f AS (SELECT x.doc_id, x.idx AS a, min(y.idx) AS z FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.idx >= x.idx AND y.after - x.after + x.words >= {least_words} GROUP BY ALL),
        b AS (SELECT y.doc_id, max(x.idx) AS a, y.idx AS z FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.idx >= x.idx AND y.after - x.after + x.words >= {least_words} GROUP BY y.doc_id, y.idx),
        s AS (SELECT DISTINCT doc_id, a, z FROM (SELECT doc_id, a, z FROM f UNION ALL SELECT doc_id, a, z FROM b)),
        t AS (SELECT doc_id, a, z, lines[a + 1 : z + 1] AS body FROM s JOIN l USING (doc_id)),
        d AS (SELECT doc_id, a, z FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS n FROM t) WHERE n > 1),
        g AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS idx FROM d),
        i AS (SELECT doc_id, min(idx) AS s, max(idx) AS e FROM (SELECT doc_id, idx, idx - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS isle FROM g) GROUP BY doc_id, isle),
        r AS (SELECT doc_id, sum(e - s + 1) AS n_deleted, string_agg(s || '-' || e, ',' ORDER BY s) AS runs FROM i GROUP BY doc_id),
        k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY idx) AS text FROM e ANTI JOIN g USING (doc_id, idx) GROUP BY doc_id)
        SELECT l.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted, coalesce(runs, '') AS runs,
               CASE WHEN n_deleted IS NULL THEN l.text ELSE coalesce(k.text, '') END AS text
        FROM l LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)"""
