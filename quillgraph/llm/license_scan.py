"""License scans by diagonal voting, in DataFrame functions alone.

All rolling word pairs of a text are joined with the pairs of the templates. A match at word p of the text and place t
of the template votes for the diagonal p - t. Neighbouring diagonals, which a word added or left out gives, are
merged, and a span is accepted if enough of the template's pairs stand on them within about the template's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The phrases and labels that the contract names.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Opening words of well-known licenses and notices, and their labels.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc-4.0"),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0"),
    ("creative commons attribution 4 0 international license", "cc-by-4.0"),
)
#: Whatever parts words: ASCII that is neither digit nor lower-case letter.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARE, NEAR = 0.8, 2


def pairs() -> list[tuple[int, str, bool, int, int, str, str]]:
    """(template, label, base, pairs in it, place, word, next word)."""
    out = []
    for k, (text, label) in enumerate((*BASE, *TEMPLATES)):
        w = text.split()
        out += [(k, label, k < len(BASE), len(w) - 1, t, w[t], w[t + 1]) for t in range(len(w) - 1)]
    return out


def template_pairs(spark: SparkSession) -> DataFrame:
    """The templates' pairs, some two hundred rows whatever the input."""
    rows = ", ".join(f"({k}, '{label}', {str(base).lower()}, {n}, {t}, '{a}', '{b}')" for k, label, base, n, t, a, b in pairs())
    return spark.sql(f"SELECT k, label, base, n_pairs, t, a, b, xxhash64(a, b) AS hash FROM VALUES {rows} AS v(k, label, base, n_pairs, t, a, b)")


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of the base phrases; first_word and last_word are the smallest and largest of their starts, null if
    there are none. labels adds those of accepted templates. Both lists are distinct, sorted, joined by commas; empty if there are none.
    score is the largest share of a template that stands on merged diagonals, 1 for a base phrase. Null text: the empty text, no
    words. Rows with the same doc_id (or null) and text get the same result, once for each. Empty table: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u212b")))  # the Kelvin sign's small letter is a k
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.array_remove(F.split(low, GAP), "").alias("w"))
    rest = F.greatest(F.size("w") - 1, F.lit(0))
    grams = F.zip_with(F.slice("w", F.lit(1), rest), F.slice("w", F.lit(2), rest), lambda a, b: F.struct(F.xxhash64(a, b).alias("hash"), a.alias("a"), b.alias("b")))
    every = words.select("doc_id", "key", F.posexplode(grams).alias("p", "g"))
    t = F.broadcast(template_pairs(spark)).alias("t")
    hits = every.join(t, (F.col("g.hash") == F.col("t.hash")) & (F.col("g.a") == F.col("t.a")) & (F.col("g.b") == F.col("t.b")))

    # texts that repeat with their id vote for the same places
    doc = ["doc_id", "key"]
    votes = hits.groupBy(*doc, "k", "label", "base", "n_pairs", (F.col("p") - F.col("t.t")).alias("diagonal")).agg(F.collect_set("t.t").alias("places"), F.min("p").alias("first"), F.max("p").alias("last"))
    along = Window.partitionBy(*doc, "k").orderBy("diagonal")
    apart = F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > NEAR, F.lit(True))
    merged = votes.withColumn("island", F.sum(apart.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    # the places of a template that have a vote, however many the template has
    places = F.size(F.array_distinct(F.flatten(F.collect_list("places"))))
    spans = merged.groupBy(*doc, "k", "label", "base", "n_pairs", "island").agg(places.alias("places"), F.min("first").alias("first"), F.max("last").alias("last"))
    share = F.col("places") / F.col("n_pairs")
    whole = F.col("base") & (share == 1)
    ok = ~F.col("base") & (share >= SHARE) & (F.col("last") - F.col("first") < 1.5 * F.col("n_pairs"))
    labels = lambda when: F.array_join(F.sort_array(F.collect_set(F.when(when, F.col("label")))), ",")
    each = spans.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(
        F.count(F.when(whole, 1)).alias("n_base"),
        F.min(F.when(whole, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(whole, F.col("first"))).cast("long").alias("last_word"),
        labels(whole).alias("base_labels"),
        labels(whole | ok).alias("labels"),
        F.coalesce(F.max(F.when(~F.col("base") | whole, share)), F.lit(0.0)).alias("score"),
    )
    rows = words.select("doc_id", "key", F.size("w").cast("long").alias("n_words"))
    both = rows.join(each, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return both.select("doc_id", "n_words", *[F.coalesce(c, none[c]).alias(c) if c in none else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")])


def oracle() -> str:
    """The same result in DuckDB's SQL."""
    rows = ", ".join(f"({k}, '{label}', {str(base).lower()}, {n}, {t}, '{a}', '{b}')" for k, label, base, n, t, a, b in pairs())
    return rf"""
        WITH t(k, label, base, n_pairs, t, a, b) AS (VALUES {rows}),
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        p AS (SELECT doc_id, unnest(w) AS a, unnest(w[2:]) AS b, unnest(range(0, len(w))) AS p FROM d),
        votes AS (SELECT doc_id, k, label, base, n_pairs, p - t AS diagonal, bit_or(1::BIGINT << t) AS mask, min(p) AS first, max(p) AS last FROM p JOIN t USING (a, b) GROUP BY ALL),
        isles AS (SELECT *, sum(CASE WHEN base OR coalesce(diagonal - before > {NEAR}, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, k ORDER BY diagonal) AS island
                  FROM (SELECT *, lag(diagonal) OVER (PARTITION BY doc_id, k ORDER BY diagonal) AS before FROM votes)),
        spans AS (SELECT doc_id, k, label, base, n_pairs, island, bit_count(bit_or(mask)) / n_pairs AS share, min(first) AS first, max(last) AS last FROM isles GROUP BY doc_id, k, label, base, n_pairs, island),
        s AS (SELECT *, base AND share = 1 AS whole, NOT base AND share >= {SHARE} AND last - first < 1.5 * n_pairs AS ok FROM spans),
        e AS (SELECT doc_id, count(*) FILTER (whole) AS n_base, min(first) FILTER (whole) AS first_word, max(first) FILTER (whole) AS last_word,
                     coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole), '') AS base_labels,
                     coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole OR ok), '') AS labels,
                     max(share) FILTER (NOT base OR whole) AS score FROM s GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
        FROM d LEFT JOIN e USING (doc_id)"""
