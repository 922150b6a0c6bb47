"""Secrets: patterns, and runs of characters that look drawn at random, in DataFrame functions alone.

A candidate is a run of at least ``LEAST`` letters, digits and ``+/_-`` with a digit and a letter in it. Its characters name its encoding, the smallest alphabet that
holds them. Three statistics are tested against independent draws from that alphabet:

- pairs of places with the same character: the chi-squared of uniformity is an affine function of their number;
- changes of class (small letter, capital, digit, other) from one place to the next: a test of runs;
- the correlation of each character's code with the next one's.

Their squared scores are summed up; a run that random draws would exceed once in a thousand cases is not random.

What is left is held against text. In text, characters coincide as often as the alphabet's characters do in all documents, and classes change at
one place in five at most. Both counts' means and variances under text follow from the length, so a short run has little power and
a long one much; the two scores are combined to a p-value. Benjamini and Hochberg's rule bounds the share of false discoveries
among candidates of like length: p-values are counted in steps of a tenth of a decade, taken at their upper ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.common import shared_dir, written

#: The dealt patterns, fixed values. Matches of the last two that are too short hold no other match, so their least lengths stand in the patterns; behind an
#: assignment a match may be too short and still cover another, so its six characters are demanded afterwards.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

LEAST = 16
RUN = f"[A-Za-z0-9+/_-]{{{LEAST},}}"
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: Name: (pattern of what it holds, size, characters, shares of small letters, capitals, digits and others). The first that fits is it.
ENCODINGS = {
    "hex": ("^[0-9a-f]+$", 16, SYMBOLS[:6] + SYMBOLS[52:], (6, 0, 10, 0)),
    "HEX": ("^[0-9A-F]+$", 16, SYMBOLS[26:32] + SYMBOLS[52:], (0, 6, 10, 0)),
    "base32": ("^[A-Z2-7]+$", 32, SYMBOLS[26:52] + SYMBOLS[54:60], (0, 26, 6, 0)),
    "base36": ("^[0-9a-z]+$", 36, SYMBOLS[:26] + SYMBOLS[52:], (26, 0, 10, 0)),
    "BASE36": ("^[0-9A-Z]+$", 36, SYMBOLS[26:], (0, 26, 10, 0)),
    "base62": ("^[0-9A-Za-z]+$", 62, SYMBOLS, (26, 26, 10, 0)),
    "base64": ("^[0-9A-Za-z+/_-]+$", 64, SYMBOLS, (26, 26, 10, 2)),
}
#: Candidates of these lengths and more, up to the next, are one family of tests.
FAMILIES = (16, 20, 24, 32, 48, 96)
#: The upper 0.1 % of chi-squared with three degrees of freedom; changes of class in text; the share of false discoveries; steps of p-values.
NOT_RANDOM, TEXT_CHANGES, FALSE_SHARE, STEPS = 16.266, 0.2, 0.01, 200


def found_in(text: Column, pattern: str) -> Column:
    """array<struct<between:int,length:int,m:string>>: all matches, leftmost first, and how many code points lie before each since the last."""
    turns = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, b: F.struct(F.char_length(b).alias("between"), F.char_length(m).alias("length"), m.alias("m")))
    some = F.filter(turns, lambda x: x["m"].isNotNull())  # what lies behind the last match has none
    return F.when(F.rlike(text, F.lit(pattern)), some).otherwise(F.array().cast("array<struct<between:int,length:int,m:string>>"))


def spans_of(found: DataFrame, kind: int) -> DataFrame:
    """(row, kind, s, e, m): the matches of a kind with their start and end."""
    each = found.select("row", F.posexplode(KINDS[kind]).alias("at", "x"))
    end = F.sum(F.col("x.between") + F.col("x.length")).over(Window.partitionBy("row").orderBy("at"))
    return each.select("row", F.lit(kind).alias("kind"), (end - F.col("x.length")).alias("s"), end.alias("e"), F.col("x.m").alias("m"))


def text_moments(docs: DataFrame) -> dict[str, tuple[float, float]]:
    """For each encoding the chance that two, and that three, characters of all documents are the same one, of those in its alphabet (each counted once more)."""
    text = F.col("text").cast("string")
    counts = docs.agg(*[F.sum(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))).alias(f"c{i}") for i, c in enumerate(SYMBOLS)]).first()
    n = {c: (counts[i] or 0) + 1 for i, c in enumerate(SYMBOLS)}
    out = {}
    for name, (_, _, held, _) in ENCODINGS.items():
        total = sum(n[c] for c in held)
        out[name] = sum((n[c] / total) ** 2 for c in held), sum((n[c] / total) ** 3 for c in held)
    return out


def _pairs_score(s2: float, s3: float) -> str:
    """The score of pairs t in length l, where two characters are equal with a chance of s2 and three with s3; the same in both dialects."""
    return f"(t - l * (l - 1) * {s2!r}) / sqrt(2.0 * l * (l - 1) * {s2 * (1 - s2)!r} + 4.0 * l * (l - 1) * (l - 2) * {max(s3 - s2 * s2, 0.0)!r})"


def _changes_score(shares: tuple[int, ...], size: int) -> str:
    """The score of changes of class r in length l under independent draws."""
    t2, t3 = (sum((c / size) ** k for c in shares) for k in (2, 3))
    return f"(r - (l - 1) * {1 - t2!r}) / sqrt((l - 1) * {t2 * (1 - t2)!r} + 2.0 * (l - 2) * {max(t3 - t2 * t2, 0.0)!r})"


def _by_encoding(values: dict[str, str]) -> str:
    return "CASE encoding " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


#: From here on both dialects read the same expressions. l: length, t: ordered pairs of equal characters, r: changes of class; s1, s2, p: sums of codes, of their squares and of neighbours' products; c1, cl: the first and last code.
_MEAN = "(s1 / (1.0 * l))"
_LAG = f"(p - {_MEAN} * (2.0 * s1 - c1 - cl) + (l - 1) * {_MEAN} * {_MEAN}) / greatest(s2 - s1 * {_MEAN}, 1e-9)"
SERIAL = f"({_LAG} + 1.0 / l) * sqrt(1.0 * l)"
PAIRS = _by_encoding({k: _pairs_score(1 / size, 1 / size**2) for k, (_, size, _, _) in ENCODINGS.items()})
CHANGES = _by_encoding({k: _changes_score(shares, size) for k, (_, size, _, shares) in ENCODINGS.items()})
TEXT_RUNS = f"(r - (l - 1) * {TEXT_CHANGES}) / sqrt((l - 1) * {TEXT_CHANGES * (1 - TEXT_CHANGES)!r})"
#: An upper bound on the normal distribution's tail beyond z >= 0, close for large z.
TAIL = "2.0 * exp(-0.5 * abs(z) * abs(z)) / 2.5066282746310002 / (abs(z) + sqrt(z * z + 2.5464790894703255))"
STEP = f"CASE WHEN randomness > {NOT_RANDOM} THEN 0 WHEN z <= 0 THEN 0 ELSE least({STEPS}, CAST(floor(-10.0 * log10({TAIL})) AS INT)) END"
FAMILY = "CASE " + " ".join(f"WHEN l >= {n} THEN {n}" for n in reversed(FAMILIES)) + " END"


def judged(candidates: DataFrame, moments: dict[str, tuple[float, float]]) -> DataFrame:
    """candidates (m) with encoding, randomness (the sum of squared scores against draws at random), z (the score against text), family and step."""
    chars = F.split("m", "")
    codes = F.transform("chars", lambda c: F.ascii(c).cast("long"))
    total = lambda a, f=lambda x: x: F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + f(x))
    size = F.char_length("m")
    twice = lambda c: (size - F.char_length(F.replace(F.col("m"), c, F.lit("")))).cast("long")
    shape = F.col("m")
    for held, one in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), ("[+/_-]+", "-")):
        shape = F.regexp_replace(shape, held, one)
    encoding = F.coalesce(*[F.when(F.rlike("m", F.lit(held)), F.lit(name)) for name, (held, _, _, _) in ENCODINGS.items()])
    wide = candidates.withColumns({"chars": chars, "encoding": encoding}).withColumn("codes", codes)
    wide = wide.withColumns({
        "l": size.cast("long"), "t": total(F.array_distinct("chars"), lambda c: twice(c) * (twice(c) - 1)), "r": (F.char_length(shape) - 1).cast("long"),
        "s1": total("codes"), "s2": total("codes", lambda x: x * x), "c1": F.element_at("codes", 1), "cl": F.element_at("codes", -1),
        "p": total(F.zip_with(F.slice("codes", F.lit(1), size - 1), F.slice("codes", F.lit(2), size - 1), lambda x, y: x * y)),
    })
    against_text = _by_encoding({k: _pairs_score(*moments[k]) for k in ENCODINGS})
    scored = wide.withColumn("randomness", F.expr(f"power({PAIRS}, 2) + power({CHANGES}, 2) + power({SERIAL}, 2)")).withColumn("z", F.expr(f"({TEXT_RUNS} - ({against_text})) / sqrt(2.0D)"))
    return scored.withColumn("family", F.expr(FAMILY)).withColumn("step", F.expr(STEP)).select(*candidates.columns, "encoding", "randomness", "z", "family", "step")


def discoveries(tests: DataFrame) -> DataFrame:
    """The rows of tests (family, step) that Benjamini and Hochberg's rule takes, within each family."""
    counts = tests.groupBy("family", "step").agg(F.count("*").alias("n"))  # at most families * steps rows
    family = Window.partitionBy("family")
    ranked = counts.withColumn("k", F.sum("n").over(family.orderBy(F.desc("step")))).withColumn("m", F.sum("n").over(family))
    least = ranked.where(f"step > 0 AND power(10.0D, -step / 10.0D) <= {FALSE_SHARE} * k / m").groupBy("family").agg(F.min("step").alias("least"))
    return tests.join(F.broadcast(least), "family").where("step >= least").drop("least")  # a row for each of the few families


def secret_spans(docs: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(rows: row, doc_id; spans: row, kind, s, e): the base spans of all documents and what the tests add outside them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), found_in(text, ASSIGN).alias("assign"), found_in(text, ACCESS).alias("access"), found_in(text, HEX).alias("hex"), found_in(text, RUN).alias("random"))
    found = written(found, f"{root}/found")
    base = spans_of(found, 0).where(F.char_length(F.regexp_extract("m", ASSIGN, 2)) >= 6)
    for kind in (1, 2):
        base = base.unionByName(spans_of(found, kind))
    tests = judged(spans_of(found, 3).where("m rlike '[0-9]' and m rlike '[A-Za-z]'"), text_moments(docs))
    added = discoveries(written(tests, f"{root}/tests"))
    # an added span that touches a base one says nothing new: one that began before reaches into it, or one begins within it
    both = base.drop("m").unionByName(added.select("row", "kind", "s", "e"))
    first, last = Window.partitionBy("row").orderBy("s", "kind"), Window.partitionBy("row").orderBy(F.desc("s"), F.desc("kind"))
    basic = F.col("kind") < 3
    both = both.withColumn("reach", F.max(F.when(basic, F.col("e"))).over(first)).withColumn("next", F.min(F.when(basic, F.col("s"))).over(last))
    return found.select("row", "doc_id"), both.where(basic | ((F.coalesce("reach", F.lit(0)) <= F.col("s")) & (F.coalesce("next", F.col("e")) >= F.col("e")))).select("row", "kind", "s", "e")


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Base spans, by the dealt patterns: ``assign`` with six characters and more behind it, ``access`` of twenty and more, ``hex`` of 24 and more; ``random`` ones are
    added where they touch no base span. spans lists kind:start:end of all, by start, then kind in that order, comma-joined (code points from
    0, end exclusive); base_sha256 is the hash of the base ones' list. Null and empty texts have no spans (an empty list). Rows that repeat, and null
    doc_ids, get a row each. Empty table: no rows. Other columns are not read. The share of false discoveries is bounded over the table that is given.
    """
    spark = docs.sparkSession
    rows, spans = secret_spans(docs, shared_dir(spark, "secrets"))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    each = spans.select("row", F.struct("s", "kind", F.concat_ws(":", name, F.col("s").cast("string"), F.col("e").cast("string")).alias("t")).alias("x"))
    per = each.groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("x"))
    number = lambda kind: F.size(F.filter("x", lambda y: y["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    listed = lambda a: F.array_join(F.transform(a, lambda y: y["t"]), ",")
    none = F.array().cast("array<struct<s:bigint,kind:int,t:string>>")
    whole = rows.join(per, "row", "left").withColumn("x", F.coalesce("x", none))
    return whole.select("doc_id", number(0), number(1), number(2), F.sha2(listed(F.filter("x", lambda y: y["kind"] < 3)), 256).alias("base_sha256"), listed(F.col("x")).alias("spans"), number(3))


def oracle() -> str:
    """The same result in DuckDB's SQL."""
    q = lambda s: s.replace("'", "''")
    kinds = [q(x) for x in (ASSIGN, ACCESS, HEX, RUN)]
    sums = ", ".join(f"sum(strlen(text) - strlen(replace(text, '{c}', '')))" for c in SYMBOLS)
    encoding = "CASE " + " ".join(f"WHEN regexp_matches(m, '{held}') THEN '{name}'" for name, (held, _, _, _) in ENCODINGS.items()) + " END"
    alphabets = ", ".join(f"('{name}', '{held}')" for name, (_, _, held, _) in ENCODINGS.items())
    text_score = "(t - l * (l - 1) * q2) / sqrt(2.0 * l * (l - 1) * q2 * (1 - q2) + 4.0 * l * (l - 1) * (l - 2) * greatest(q3 - q2 * q2, 0.0))"
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
        f AS ({" UNION ALL ".join(f"SELECT rn, {k} AS kind, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS m, unnest(between[: len(found)]) AS b FROM (SELECT rn, regexp_extract_all(text, '{p}') AS found, string_split_regex(text, '{p}') AS between FROM d)" for k, p in enumerate(kinds))}),
        p AS (SELECT rn, kind, m, sum(length(b) + length(m)) OVER (PARTITION BY rn, kind ORDER BY i) AS e FROM f),
        s AS (SELECT rn, kind, m, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM p),
        base AS (SELECT rn, kind, s, e FROM s WHERE kind IN (1, 2) OR kind = 0 AND length(regexp_extract(m, '{kinds[0]}', 2)) >= 6),
        n AS (SELECT unnest(string_split('{SYMBOLS}', '')) AS c, unnest([{sums}]) AS n FROM documents),
        a AS (SELECT name, unnest(string_split(held, '')) AS c FROM (VALUES {alphabets}) AS x(name, held)),
        g AS (SELECT name, (coalesce(n, 0) + 1.0) / sum(coalesce(n, 0) + 1.0) OVER (PARTITION BY name) AS share FROM a JOIN n USING (c)),
        h AS (SELECT name AS encoding, sum(share ** 2) AS q2, sum(share ** 3) AS q3 FROM g GROUP BY name),
        c AS (SELECT rn, s, e, m, {encoding} AS encoding, list_transform(string_split(m, ''), lambda x: CAST(unicode(x) AS BIGINT)) AS codes FROM s WHERE kind = 3 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')),
        v AS (SELECT *, CAST(length(m) AS BIGINT) AS l, list_sum(list_transform(list_distinct(codes), lambda x: len(list_filter(codes, lambda y: y = x)) * (len(list_filter(codes, lambda y: y = x)) - 1))) AS t,
                     length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '[a-z]+', 'a', 'g'), '[A-Z]+', 'A', 'g'), '[0-9]+', '0', 'g'), '[+/_-]+', '-', 'g')) - 1 AS r,
                     list_sum(codes) AS s1, list_sum(list_transform(codes, lambda x: x * x)) AS s2, codes[1] AS c1, codes[-1] AS cl, list_sum(list_transform(range(1, len(codes)), lambda i: codes[i] * codes[i + 1])) AS p FROM c),
        w AS (SELECT *, power({PAIRS}, 2) + power({CHANGES}, 2) + power({SERIAL}, 2) AS randomness, ({TEXT_RUNS} - ({text_score})) / sqrt(2.0) AS z, {FAMILY} AS family FROM v JOIN h USING (encoding)),
        x AS (SELECT *, {STEP} AS step FROM w),
        k AS (SELECT family, step, count(*) AS n FROM x GROUP BY ALL),
        o AS (SELECT family, step, sum(n) OVER (PARTITION BY family ORDER BY step DESC) AS k, sum(n) OVER (PARTITION BY family) AS m FROM k),
        t AS (SELECT family, min(step) AS least FROM o WHERE step > 0 AND power(10.0, -step / 10.0) <= {FALSE_SHARE} * k / m GROUP BY family),
        y AS (SELECT rn, 3 AS kind, s, e FROM x JOIN t USING (family) WHERE step >= least),
        z AS (SELECT * FROM base UNION ALL SELECT * FROM y WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.rn = y.rn AND base.s < y.e AND base.e > y.s)),
        j AS (SELECT rn, kind, s, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || s || ':' || e AS t FROM z)
        SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
               sha256(coalesce(string_agg(t, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(t, ',' ORDER BY s, kind), '') AS spans, count(*) FILTER (kind = 3) AS n_random
        FROM d LEFT JOIN j USING (rn) GROUP BY d.rn, d.doc_id"""
