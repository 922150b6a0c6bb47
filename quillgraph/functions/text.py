"""Text functions as Column expressions; all of them run in the JVM."""

from __future__ import annotations

import re
from string import Template

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 32 ASCII marks that answer normalisation drops.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: What counts as true and false when spelt out.
TRUE, FALSE = ("yes", "true", "t", "y", "1"), ("no", "false", "f", "n", "0")


def normalize(c: Column) -> Column:
    """Lower case; all but letters, digits, underscores and white space becomes a space; single spaces; no spaces at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " "))


def normalize_answer(c: Column) -> Column:
    """Lower case, no ASCII marks, no English articles, single spaces."""
    bare = F.translate(F.lower(c), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def content_id(c: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.md5(c))


#: Prefixes of ids that are packed; others stay text.
PREFIXES = ("chunk-", "entity-", "fact-")


def packed(c: Column) -> Column:
    """An id in bytes: the number of its prefix and the 16 bytes of its md5, or 0 and the text if it is no such id. No two ids are packed alike."""
    out = F.concat(F.lit(b"\x00"), F.encode(c, "UTF-8"))
    for i, prefix in reversed(list(enumerate(PREFIXES, 1))):
        out = F.when(F.rlike(c, F.lit(f"^{prefix}[0-9a-f]{{32}}\\z")), F.concat(F.lit(bytes([i])), F.unhex(F.substring(c, len(prefix) + 1, 32)))).otherwise(out)
    return out


def unpacked(c: Column) -> Column:
    """The id that packed() made c of."""
    out = F.decode(F.substring(c, 2, 1 << 30), "UTF-8")
    for i, prefix in enumerate(PREFIXES, 1):
        out = F.when(F.substring(c, 1, 1) == F.lit(bytes([i])), F.concat(F.lit(prefix), F.lower(F.hex(F.substring(c, 2, 16))))).otherwise(out)
    return out


def fact_text(s: Column, p: Column, o: Column) -> Column:
    """The text that stands for a fact of normalised parts, which hold neither quotes nor backslashes."""
    return F.format_string("('%s', '%s', '%s')", s, p, o)


def cache_key(**fields: Column) -> Column:
    """sha256 of the fields as JSON in the order of their names."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def answer_of(response: Column) -> Column:
    """What stands between the first and the second 'Answer:', or the whole response."""
    return F.when(F.contains(response, F.lit("Answer:")), F.trim(F.split(response, "Answer:")[1])).otherwise(response)


def round4(c: Column) -> Column:
    """Four decimals, halves up, on the binary value."""
    return F.floor(c * 10000 + 0.5) / 10000


def to_bool(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False).otherwise(F.raise_error(F.concat(F.lit("not a truth value: "), c)).cast("boolean"))


def embed_input(c: Column) -> Column:
    """Line feeds become spaces; a model gets a space for an empty text."""
    flat = F.replace(c, F.lit("\n"), F.lit(" "))
    return F.when(flat == "", " ").otherwise(flat)


#: Instructions that go before a query, by what it is compared with.
INSTRUCTIONS = {
    "ner_to_node": "Find phrases that mean the same as this phrase or are close to it.",
    "query_to_node": "Find the phrases that this question is about.",
    "query_to_fact": "Find the facts, as subject, predicate and object, that help to answer this question.",
    "query_to_sentence": "Find the sentences that answer this question.",
    "query_to_passage": "Find the passages that answer this question.",
}


def instruction(purpose: str) -> str:
    return INSTRUCTIONS.get(purpose, INSTRUCTIONS["query_to_passage"])


def with_instruction(c: Column, purpose: str) -> Column:
    return F.concat(F.lit(f"Instruct: {instruction(purpose)}\nQuery: "), c)


def to_template(c: Column) -> Column:
    """{name} becomes ${name}."""
    return F.regexp_replace(c, r"\{(\w+)\}", r"\$\{$1\}")


def render(template: str, **values: str) -> str:
    """Fill ${name}; a name without a value is an error."""
    try:
        return Template(template).substitute(values)
    except KeyError as e:
        raise ValueError(f"no value for {e.args[0]!r} of the template") from e


def render_column(template: str, **values: Column) -> Column:
    """Fill ${name} of a template from columns; a name without a column is an error."""
    parts, at = [], 0
    for m in re.finditer(r"\$\{(\w+)\}", template):
        if m[1] not in values:
            raise ValueError(f"no value for {m[1]!r} of the template")
        parts += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def decode_unicode(c: Column) -> Column:
    r"""Text with \uXXXX escapes as the characters they stand for; null if it is no valid JSON string."""
    return F.from_json(F.concat(F.lit('{"s":"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"}')), "s string")["s"]


def token_count(c: Column) -> Column:
    """Words between white space, where no tokenizer is given."""
    return F.when(F.trim(c) == "", 0).otherwise(F.size(F.split(F.trim(c), r"\s+")))


def merge_by_first_line(rows, group: str, order: str, text: str):
    """Texts of a group with the same first line become one: that line, then the rests in order, parted by line feeds."""
    first = F.substring_index(F.col(text), "\n", 1)
    rest = F.expr(f"substring({text}, length(substring_index({text}, '\\n', 1)) + 2)")
    parts = rows.select(group, first.alias("_first"), F.struct(F.col(order).alias("o"), rest.alias("r")).alias("_p"))
    merged = parts.groupBy(group, "_first").agg(F.sort_array(F.collect_list("_p")).alias("_ps"))
    return merged.select(group, F.col("_first").alias("first_line"), F.concat_ws("\n", F.col("_first"), F.array_join(F.col("_ps.r"), "\n")).alias(text))
