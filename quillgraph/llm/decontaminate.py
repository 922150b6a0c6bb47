"""Benchmark decontamination on canonical templates, in DataFrame functions alone.

Words become templates: numbers, units after a number, and names (a capital and small letters) turn into typed placeholders.
Windows of five canonical words of every document are hash-joined with those of the benchmark's items. A copy may be in another case, and a
capital that begins a sentence may begin a name or not: so a window has two forms, one with names as placeholders and one in small letters with
names as words. Matches on a diagonal (place in the document less place in the item) must fill the placeholders
consistently: one value of the item always stands for one value of the document. A diagonal on which a number or a unit has two values asks
something else and does not count; nor do windows with a name that has two. An item whose windows are covered to 80 % or more is leaked.
Items shorter than five words are one window of their own length, looked for at every place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import remove, shared_dir, unused, written

#: Units of measure that follow a number.
UNITS = ("mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "foot", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "lb", "lbs", "pound", "pounds", "oz", "ounce", "ounces", "ml", "l", "liter", "liters", "litre", "litres", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollar", "dollars", "cent", "cents", "euro", "euros", "usd", "eur", "degrees", "mph", "kmh", "w", "kw", "j", "kj", "v", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb", "meter", "meters", "metre", "metres")
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
WIDTH, LEAST_FIXED = 5, 2
#: The forms of a window: names as placeholders, names as words.
NAMED, BLIND = 1, 2
#: Stand before a word with a capital and small letters, and after a unit that follows a number.
CAPITAL, IN_UNIT = "\x01", "\x02"
LETTER = r"[\p{L}\p{N}]"


def tokens(text: Column) -> Column:
    """The words (runs of letters and digits) in small letters, names and units marked. The marks are set in the whole text, so that little is left to do for each word."""
    text = F.translate(F.replace(F.replace(text, F.lit("İ"), F.lit("I")), F.lit("ß"), F.lit("ss")), CAPITAL + IN_UNIT, "  ")
    marked = F.regexp_replace(text, rf"\p{{Lu}}(?<!{LETTER}.)(?=[\p{{L}}\p{{N}}&&\P{{Lu}}]++(?!\p{{Lu}}))", f"{CAPITAL}$0")
    units = F.regexp_replace(F.lower(marked), rf"([0-9](?<!{LETTER}.){LETTER}*+[^\p{{L}}\p{{N}}]++)({'|'.join(UNITS)})(?!{LETTER})", f"$1$2{IN_UNIT}")
    return F.array_remove(F.split(units, rf"[^\p{{L}}\p{{N}}{CAPITAL}{IN_UNIT}]+"), "")


def plain(token: Column) -> Column:
    return F.translate(token, CAPITAL + IN_UNIT, "")


def canonical(token: Column, form: int) -> Column:
    """The word or its placeholder. A number begins with a digit, and then no mark stands before it."""
    bare = F.when(F.startswith(token, F.lit(CAPITAL)), NAME if form == NAMED else F.substr(token, F.lit(2))).otherwise(token)
    return F.when((token >= F.lit("0")) & (token < F.lit(":")), NUMBER).when(F.endswith(token, F.lit(IN_UNIT)), UNIT).otherwise(bare)


def windows(words: DataFrame, widths: list[int]) -> DataFrame:
    """words (w: tokens) as a row per place and width: p, width, t (the window's tokens), named and blind, the hashes of its forms; named is null if it is the same as blind.

    The five columns of shifted tokens are zipped and exploded, so hashes are computed in generated code.
    """
    shifted = words.withColumns({f"t{k}": F.slice("w", k + 1, F.size("w")) for k in range(WIDTH)})
    each = shifted.select(*[c for c in words.columns if c != "w"], F.posexplode(F.arrays_zip(*[f"t{k}" for k in range(WIDTH)])).alias("p", "z"))
    out = None
    for width in widths:
        part = [F.col(f"z.t{k}") for k in range(width)]
        some = part[0].startswith(CAPITAL)
        for t in part[1:]:
            some = some | t.startswith(CAPITAL)
        hashed = lambda form: F.xxhash64(F.lit(width), *[canonical(t, form) for t in part])  # noqa: B023, E731
        one = each.where(part[-1].isNotNull()).select(*[c for c in each.columns if c != "z"], F.lit(width).alias("width"), F.array(*part).alias("t"), F.when(some, hashed(NAMED)).alias("named"), hashed(BLIND).alias("blind"))
        out = one if out is None else out.unionByName(one)
    return out


def forms(rows: DataFrame) -> DataFrame:
    """A row per form: form, h. A window without names is the same in both and has the blind one alone."""
    each = F.array(F.struct(F.lit(NAMED).alias("form"), F.col("named").alias("h")), F.struct(F.lit(BLIND).alias("form"), F.col("blind").alias("h")))
    return rows.select("*", F.explode(each).alias("f")).where("f.h is not null").select(*[c for c in rows.columns if c not in ("named", "blind")], "f.form", "f.h")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, item_key, i, width, form, h, own, total: the windows of the items' distinct texts that hold two fixed words at least.

    own has the item's tokens. total counts the places whose named form does; of an item that has none, those whose blind form does.
    """
    rows = benchmark.where("text is not null").groupBy(F.col("text").cast("string").alias("text")).agg(F.min(F.col("item_id").cast("long")).alias("item_id"))
    rows = rows.select("item_id", F.xxhash64("text").alias("item_key"), tokens(F.col("text")).alias("w"))
    each = windows(rows.withColumn("long", F.least(F.size("w"), F.lit(WIDTH))), list(range(LEAST_FIXED, WIDTH + 1))).where("width = long").drop("long")
    fixed = lambda form: F.size(F.filter("t", lambda t: ~canonical(t, form).isin(NUMBER, UNIT, NAME)))
    each = each.withColumn("sure", fixed(NAMED) >= LEAST_FIXED).where(fixed(BLIND) >= LEAST_FIXED)
    total = each.groupBy("item_key").agg(F.count(F.when(F.col("sure"), 1)).alias("_sure"), F.count("*").alias("_all")).select("item_key", F.when(F.col("_sure") > 0, F.col("_sure")).otherwise(F.col("_all")).alias("total"), (F.col("_sure") == 0).alias("any"))
    each = each.join(total, "item_key").where(F.col("sure") | F.col("any")).withColumn("named", F.when(F.col("sure"), F.col("named")))
    return forms(each).select("item_id", "item_key", F.col("p").alias("i"), "width", "form", "h", F.col("t").alias("own"), "total")


def found(docs: DataFrame, benchmark: DataFrame, root: str, broadcast_rows: int) -> DataFrame:
    """Windows of documents that are windows of items: doc_id, key, p, t, form and the columns of the item's window.

    The items' windows are broadcast only if counting finds at most ``broadcast_rows``; otherwise both sides shuffle.
    """
    items = written(item_windows(benchmark), f"{root}/items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # four at most
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = windows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), tokens(text).alias("w")), widths or [WIDTH])
    if items.limit(broadcast_rows + 1).count() <= broadcast_rows:
        # places with a hash of either form are looked up first, and only these are told apart by form
        some = F.broadcast(items.select("h").distinct())
        hit = every.join(some.select(F.col("h").alias("blind"), F.lit(True).alias("_b")), "blind", "left").join(some.select(F.col("h").alias("named"), F.lit(True).alias("_n")), "named", "left")
        every, items = hit.where("_b or _n").drop("_b", "_n"), F.broadcast(items)
    return written(forms(every).join(items, ["h", "width", "form"]).drop("h", "width"), f"{root}/found")


def pairs(docs: DataFrame, benchmark: DataFrame, share: float, broadcast_rows: int) -> DataFrame:
    """A row per text of docs and item it holds: doc_id, key, item_id, coverage, changed."""
    root = shared_dir(docs.sparkSession, "leaks")
    rows = found(docs, benchmark, root, broadcast_rows).distinct()  # texts that repeat with their id are one
    made = lambda c, form: F.transform(c, lambda t: canonical(t, form))
    alike = F.when(F.col("form") == NAMED, made("t", NAMED) == made("own", NAMED)).otherwise(made("t", BLIND) == made("own", BLIND))
    kind = lambda t: F.when((F.col("form") == BLIND) & (canonical(t, NAMED) == NAME), "").otherwise(canonical(t, NAMED))
    slots = F.filter(F.zip_with("own", "t", lambda a, b: F.struct(kind(a).alias("kind"), plain(a).alias("item"), plain(b).alias("doc"))), lambda s: s["kind"].isin(NUMBER, UNIT, NAME))
    group = ["doc_id", "key", "item_id", "item_key", "total"]
    hits = rows.where(alike).select(*group, (F.col("p") - F.col("i")).alias("diagonal"), F.struct("i", slots.alias("slots")).alias("hit"))
    lines = hits.groupBy(*group, "diagonal").agg(F.collect_set("hit").alias("hits"))
    lines = lines.withColumn("filled", F.array_distinct(F.flatten(F.transform("hits", lambda x: x["slots"]))))
    lines = lines.withColumn("torn", F.filter("filled", lambda s: F.exists("filled", lambda o: (o["kind"] == s["kind"]) & (o["item"] == s["item"]) & (o["doc"] != s["doc"]))))
    lines = lines.where(~F.exists("torn", lambda s: s["kind"] != NAME))
    covered = lines.select(*group, F.explode(F.filter("hits", lambda x: ~F.arrays_overlap(x["slots"], "torn"))).alias("hit"))
    changed = F.exists("hit.slots", lambda s: s["item"] != s["doc"])
    per = covered.groupBy(*group).agg((F.count_distinct("hit.i") / F.col("total")).alias("coverage"), F.max(changed).alias("changed")).where(F.col("coverage") >= share)
    out = written(per.drop("item_key", "total"), f"{root}/pairs")
    for old in ("items", "found"):
        remove(docs.sparkSession, f"{root}/{old}")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, share: float = 0.8, broadcast_rows: int = 200_000) -> DataFrame:
    """One row per row of docs: doc_id, kept, n_items, item_ids, coverage, changed.

    kept is false if the document holds an item: 80 % or more of the item's windows on diagonals with consistent slots. item_ids lists
    the items, sorted, joined by commas (of items with the same text, the smallest id); coverage is the largest share among them, 0 if
    none; changed tells whether a slot differs from the item's. Null text: the empty text, kept. Items with null text or fewer than two fixed words match
    nothing. Rows with the same doc_id (or null) and text get the same result, once for each. Empty tables: all kept, or no rows. Other columns are not read.
    """
    per = pairs(docs, benchmark, share, broadcast_rows).groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.count("*").alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("ids"), F.max("coverage").alias("coverage"), F.max("changed").alias("changed"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    both = rows.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    return both.select("doc_id", F.col("_key").isNull().alias("kept"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), F.lit("")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("changed", F.lit(False)).alias("changed"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, share: float = 0.8, broadcast_rows: int = 200_000) -> DataFrame:
    """Rows of docs, with all their columns, that hold no item. The texts that do are broadcast if counting finds at most ``broadcast_rows``; else both sides shuffle."""
    one, two = unused(docs, "leak_id", "leak_key")
    bad = pairs(docs, benchmark, share, broadcast_rows).select(F.col("doc_id").alias(one), F.col("key").alias(two)).distinct()
    bad = F.broadcast(bad) if bad.limit(broadcast_rows + 1).count() <= broadcast_rows else bad.hint("merge")
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(one)) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(two)), "left_anti")


def oracle(share: float = 0.8) -> str:
    """The same result in DuckDB's SQL, word by word, windows compared as lists."""
    units = ", ".join(f"'{u}'" for u in UNITS)

    def words(table: str, key: str) -> str:
        return rf"""SELECT {key}, list_transform(w, lambda x, i: {{'kind': CASE WHEN regexp_matches(x, '^[0-9]') THEN '{NUMBER}' WHEN i > 1 AND regexp_matches(w[i - 1], '^[0-9]') AND lower(x) IN ({units}) THEN '{UNIT}'
                        WHEN regexp_full_match(x, '\p{{Lu}}[^\p{{Lu}}]+') THEN '{NAME}' ELSE '' END, 'word': lower(x)}}) AS w
                    FROM (SELECT {key}, regexp_extract_all(replace(replace(coalesce(text, ''), 'İ', 'I'), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+') AS w FROM {table})"""

    named = "[CASE WHEN x.kind = '' THEN x.word ELSE x.kind END FOR x IN t]"
    blind = f"[CASE WHEN x.kind IN ('', '{NAME}') THEN x.word ELSE x.kind END FOR x IN t]"
    return rf"""
        WITH item AS (SELECT text, min(item_id) AS item_id FROM benchmark WHERE text IS NOT NULL GROUP BY text),
        d AS ({words('documents', 'doc_id')}), b AS ({words('item', 'item_id')}),
        bw AS (SELECT item_id, unnest(range(0, len(w) - least(len(w), {WIDTH}) + 1)) AS i, least(len(w), {WIDTH}) AS width, w FROM b WHERE len(w) >= {LEAST_FIXED}),
        bt AS (SELECT item_id, i, width, w[i + 1 : i + width] AS t FROM bw),
        bf AS (SELECT item_id, i, width, t, {named} AS named, {blind} AS blind, len([x FOR x IN t IF x.kind = '']) >= {LEAST_FIXED} AS sure, bool_or(len([x FOR x IN t IF x.kind = '']) >= {LEAST_FIXED}) OVER (PARTITION BY item_id) AS has_sure
               FROM bt WHERE len([x FOR x IN t IF x.kind IN ('', '{NAME}')]) >= {LEAST_FIXED}),
        items AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS total FROM bf WHERE sure OR NOT has_sure),
        dp AS (SELECT doc_id, unnest(range(0, len(w))) AS p, w FROM d),
        dt AS (SELECT doc_id, p, width, w[p + 1 : p + width] AS t FROM dp, (SELECT DISTINCT width FROM items) WHERE p + width <= len(w)),
        df AS (SELECT doc_id, p, width, t, {named} AS named, {blind} AS blind FROM dt),
        hits AS (SELECT DISTINCT doc_id, item_id, total, p - i AS diagonal, i, [{{'kind': x[1].kind, 'item': x[1].word, 'doc': x[2].word}} FOR x IN list_zip(items.t, df.t) IF x[1].kind <> ''] AS slots
                 FROM df JOIN items ON df.width = items.width AND df.named = items.named WHERE sure AND list_has_any([x.kind FOR x IN items.t], ['{NAME}'])
                 UNION SELECT DISTINCT doc_id, item_id, total, p - i, i, [{{'kind': x[1].kind, 'item': x[1].word, 'doc': x[2].word}} FOR x IN list_zip(items.t, df.t) IF x[1].kind IN ('{NUMBER}', '{UNIT}')]
                 FROM df JOIN items ON df.width = items.width AND df.blind = items.blind),
        slot AS (SELECT DISTINCT doc_id, item_id, diagonal, s.kind AS kind, s.item AS item, s.doc AS doc FROM (SELECT doc_id, item_id, diagonal, unnest(slots) AS s FROM hits)),
        torn AS (SELECT doc_id, item_id, diagonal, kind, item FROM slot GROUP BY ALL HAVING count(*) > 1),
        lost AS (SELECT doc_id, item_id, diagonal, list({{'kind': kind, 'item': item}}) AS torn, bool_or(kind <> '{NAME}') AS whole FROM torn GROUP BY ALL),
        good AS (SELECT h.* FROM hits h LEFT JOIN lost l USING (doc_id, item_id, diagonal) WHERE l.torn IS NULL OR NOT l.whole AND NOT list_has_any([{{'kind': x.kind, 'item': x.item}} FOR x IN h.slots], l.torn)),
        pairs AS (SELECT doc_id, item_id, count(DISTINCT i) / total AS coverage, bool_or(len([x FOR x IN slots IF x.item <> x.doc]) > 0) AS changed FROM good GROUP BY doc_id, item_id, total HAVING count(DISTINCT i) / total >= {share}),
        per AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids, max(coverage) AS coverage, bool_or(changed) AS changed FROM pairs GROUP BY doc_id)
        SELECT doc_id, n_items IS NULL AS kept, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids, coalesce(coverage, 0)::DOUBLE AS coverage, coalesce(changed, false) AS changed FROM documents LEFT JOIN per USING (doc_id)"""
