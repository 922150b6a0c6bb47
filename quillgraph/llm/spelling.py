"""Spelling variants: words that differ by one inserted, deleted or replaced character, by automata in both directions.

If two words differ by one error, the half of one of them in which the error is not stands unchanged in the other: its first half at
the other's beginning, or its second half at the other's end. So words are dealt out twice. Forward, a word asks those that begin with its first
half; backward, all words are turned round and it asks those that begin with its turned second half. The key of the shuffle is that half, matched exactly;
an other word has the keys of the two lengths of half that words of nearly its length can have.

A task turns the rests of the words of its keys into one minimal acyclic automaton, level by level from the sorted words; equal tails,
found from the end by their contents, are one state. Each state knows how many words can be completed from it, so a path adds up to the number
of its word among the sorted ones. All questions walk together: along their own rest, and from each state on the way over one error to the
end. Numbers that several paths reach count once, and the backward direction leaves out what the forward one finds. A task returns a row for each
question, not for each pair.

The words of a key that has more than a block holds are dealt out in blocks, and each block meets each of questions; tasks read them in order and build
an automaton for about ``CHUNK`` words at a time, so no key and no task has to fit in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import parts_for, remove, shared_dir, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_A_LETTER = r"[^A-Za-zÀ-ÿ]+"
#: Words of an automaton and their characters, and words of a block of a key.
CHUNK, CHUNK_CHARS, BLOCK = 1 << 16, 1 << 21, 1 << 15


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Automaton:
    """The minimal acyclic automaton of sorted groups of distinct words (bytes); each group has a start of its own.

    ``number`` of a path is its word's place in its group. States are numbers; the edges of state s are those from first[s] to first[s + 1].
    """

    def __init__(self, words: list[bytes], group: np.ndarray, groups: int):
        size = np.array([len(w) for w in words], np.int64)
        data, at = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum(size)])[:-1]
        row, node, made = np.arange(len(words)), group.astype(np.int64), groups
        final, froms, chars, tos = [np.zeros(groups, bool)], [], [], []
        depth = 0
        while len(row):  # the trie, a level at a time: rows are sorted, so those of a node stand together
            ends = size[row] == depth
            final[-1][node[ends] - (made - len(final[-1]))] = True
            row, node = row[~ends], node[~ends]
            if not len(row):
                break
            c = data[at[row] + depth].astype(np.int64)
            new = np.concatenate([[True], (node[1:] != node[:-1]) | (c[1:] != c[:-1])])
            froms.append(node[new])
            chars.append(c[new])
            node = made + np.cumsum(new) - 1
            tos.append(node[new])
            final.append(np.zeros(int(new.sum()), bool))
            made += len(final[-1])
            depth += 1
        ends, none = np.concatenate(final), np.zeros(0, np.int64)
        src, char, dst = (np.concatenate([none, *x]) for x in (froms, chars, tos))
        out = np.bincount(src, minlength=made)
        begin = np.concatenate([[0], np.cumsum(out)])  # edges are in the order of their sources already
        contents, count = mixed(ends.astype(np.uint64) + np.uint64(1)), ends.astype(np.int64)
        for a, b, to in reversed(list(zip(froms, chars, tos, strict=True))):
            np.add.at(contents, a, mixed(contents[to] * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) + np.uint64(1)))
            np.add.at(count, a, count[to])
        _, keep, state = np.unique(contents, return_index=True, return_inverse=True)
        # a state stands for nodes with the same edges to the same states; equal hashes of other contents would show here
        like = keep[state]
        same = np.array_equal(out, out[like]) and np.array_equal(ends, ends[like])
        twin = np.arange(len(src)) - begin[src] + begin[like[src]] if same else none
        if not same or not (np.array_equal(char, char[twin]) and np.array_equal(state[dst], state[dst[twin]])):
            raise RuntimeError("two different tails have the same 64-bit hash")
        self.start, self.final, self.size = state[:groups], ends[keep], len(keep)
        degree = out[keep]
        self.first = np.concatenate([[0], np.cumsum(degree)])
        edge = np.repeat(begin[keep] - self.first[:-1], degree) + np.arange(self.first[-1])
        self.char, self.to, words_below = char[edge], state[dst[edge]], count[dst[edge]]
        before = np.cumsum(words_below) - words_below
        self.skip = before - np.repeat(before[self.first[:-1].clip(max=max(len(before) - 1, 0))], degree) + self.final[np.repeat(np.arange(self.size), degree)] if len(before) else before
        self.key = np.repeat(np.arange(self.size), degree) * 256 + self.char

    def step(self, state: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the states have an edge with their character, the edges)."""
        want = state * 256 + char
        at = np.searchsorted(self.key, want).clip(max=max(len(self.key) - 1, 0))
        ok = np.flatnonzero(self.key[at] == want) if len(self.key) else np.zeros(0, np.int64)
        return ok, at[ok]

    def edges(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the state, edge) of all edges of some states."""
        n = self.first[state + 1] - self.first[state]
        at = np.repeat(np.arange(len(state)), n)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[state], n)

    def one_error(self, words: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(question, number in its group) of all words with one error more than the questions, each once."""
        size = np.array([len(w) for w in words], np.int64)
        data, at = np.frombuffer(b"".join(words) + b"\0", np.uint8), np.concatenate([[0], np.cumsum(size)])[:-1]
        q, s, num = np.arange(len(words)), self.start[group], np.zeros(len(words), np.int64)
        wrong = [np.zeros(0, np.int64)] * 4  # question, state, number, characters of the question used
        found_q, found_n = [wrong[0]], [wrong[0]]
        depth = 0
        while len(q) or len(wrong[0]):
            left = size[q] > depth
            own = np.where(left, data[np.minimum(at[q] + depth, len(data) - 1)], 256).astype(np.int64)
            if len(q):
                of, e = self.edges(s)
                other = self.char[e] != own[of]
                of, e = of[other], e[other]
                swap = left[of]
                new = [
                    (q[of][swap], self.to[e][swap], (num[of] + self.skip[e])[swap]),  # replaced: goes on behind the character
                    (q[left], s[left], num[left]),  # the question's character is too many
                ]
                stay = (q[of], self.to[e], num[of] + self.skip[e])  # the question lacks a character: goes on at this one
            else:
                new, stay = [], (np.zeros(0, np.int64),) * 3
            # those with their error behind them that are at this depth: end, or step on
            here = [np.concatenate([w, x]) for w, x in zip(wrong, stay, strict=False)]
            done = size[here[0]] == depth
            hit = done & self.final[here[1]]
            found_q.append(here[0][hit])
            found_n.append(here[2][hit])
            rest = [x[~done] for x in here]
            ok, e = self.step(rest[1], data[at[rest[0]] + depth].astype(np.int64))
            moved = (rest[0][ok], self.to[e], rest[2][ok] + self.skip[e])
            wrong = [np.concatenate([x[k] for x in [moved, *new]]) for k in range(3)]
            # the questions themselves, without an error so far
            q, s, num, own = q[left], s[left], num[left], own[left]
            ok, e = self.step(s, own)
            q, s, num = q[ok], self.to[e], num[ok] + self.skip[e]
            depth += 1
        pair = np.unique(np.stack([np.concatenate(found_q), np.concatenate(found_n)], axis=1), axis=0)
        return pair[:, 0], pair[:, 1]


def _near(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """(word, n_near, form_n, form) for questions with words near them, of rows sorted by deal and rest: deal, rest, word, n, asks, backward."""
    held: list[tuple] = []
    chars = 0

    def out() -> pa.RecordBatch:
        deals, rests, words, ns, asks, backward = zip(*held, strict=True)
        first = np.array([x != y for x, y in zip(deals, [None, *deals], strict=False)])
        group = np.cumsum(first) - 1
        targets = np.array([a != 2 for a in asks])
        tails = [r.encode("latin-1") for r in rests]
        mine, theirs = np.flatnonzero([a > 0 for a in asks]), np.flatnonzero(targets)
        base = np.searchsorted(group[theirs], np.arange(group[-1] + 1))
        found = Automaton([tails[i] for i in theirs], group[theirs], int(group[-1]) + 1)
        q, number = found.one_error([tails[i] for i in mine], group[mine])
        ask, other = mine[q], theirs[base[group[mine[q]]] + number]
        if len(ask) and backward[0]:  # a chunk holds one direction
            new = np.fromiter((words[b][: len(words[a]) // 2] != words[a][: len(words[a]) // 2] for a, b in zip(ask.tolist(), other.tolist(), strict=True)), bool, len(ask))
            ask, other = ask[new], other[new]
        best: dict[int, tuple[int, str]] = {}
        count: dict[int, int] = {}
        for a, b in zip(ask.tolist(), other.tolist(), strict=True):
            count[a] = count.get(a, 0) + 1
            one = (-ns[b], words[b])
            if a not in best or one < best[a]:
                best[a] = one
        at = list(best)
        return pa.RecordBatch.from_arrays([pa.array([words[a] for a in at], pa.string()), pa.array([count[a] for a in at], pa.int64()), pa.array([-best[a][0] for a in at], pa.int64()), pa.array([best[a][1] for a in at], pa.string())], ["word", "n_near", "form_n", "form"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("deal", "rest", "word", "n", "asks", "backward")), strict=True):
            if (len(held) >= chunk or chars >= CHUNK_CHARS) and row[0] != held[-1][0] or held and row[5] != held[-1][5]:
                yield out()
                held, chars = [], 0
            held.append(row)
            chars += len(row[1])
    if held:
        yield out()


def word_counts(docs: DataFrame, *, least_chars: int = 5, least_n: int = 3, period: int = 97) -> DataFrame:
    """(word, n): words of docs (doc_id, text) with so many characters and occurrences; see spelling_variants()."""
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.split(F.translate(F.col("text").cast("string"), UPPER, LOWER), NOT_A_LETTER)).alias("w")).where("w <> ''")
    size = F.char_length("w")
    h = F.crc32(F.concat("d", F.lit(":"), "w").cast("binary"))
    at = (h % size).cast("int")
    cut = F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, size))
    word = run.select(F.when(h % period == 0, cut).otherwise(F.col("w")).alias("word")).where(F.char_length("word") >= least_chars)
    return word.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def near_words(words: DataFrame, root: str, *, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(word, n_near, form_n, form) for the words (word, n; Latin-1 characters) that have others one error away: how many, and the commonest of them."""
    size = F.char_length("word")
    front = lambda k: F.struct(F.lit(False).alias("backward"), F.substring(F.col("word"), F.lit(1), k).alias("half"), F.substring(F.col("word"), k + 1, size).alias("rest"), (k == F.floor(size / 2).cast("int")).alias("asks"))
    back = lambda k: F.struct(F.lit(True).alias("backward"), F.substring(F.col("word"), size - k + 1, k).alias("half"), F.reverse(F.substring(F.col("word"), F.lit(1), size - k)).alias("rest"), (k == F.ceil(size / 2).cast("int")).alias("asks"))
    halves = lambda f: (F.floor(f(size - 1) / 2).cast("int"), F.floor(f(size + 1) / 2).cast("int"))
    forward, turned = halves(lambda n: n), halves(lambda n: n + 1)
    places = words.select("word", "n", F.explode(F.array(*map(front, forward), *map(back, turned))).alias("p")).select("word", "n", "p.*")
    # a key's questions outnumber a block only with its words, so few keys are large; those get a row here
    large = written(places.groupBy("backward", "half").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1"), f"{root}/large")
    placed = places.join(large, ["backward", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    # a grid of blocks: a word is asked in its own row, by the questions of every column, and asks in its own column; asks: 0 is asked, 1 both, 2 asks alone
    every, mine = F.sequence(F.lit(0), F.col("parts") - 1), F.col("mine")
    asked = F.transform(every, lambda j: F.struct(mine.alias("row"), j.alias("column"), F.when(F.col("asks") & (j == mine), 1).otherwise(0).alias("asks")))
    asking = F.transform(F.filter(every, lambda i: F.col("asks") & (i != mine)), lambda i: F.struct(i.alias("row"), mine.alias("column"), F.lit(2).alias("asks")))
    each = placed.withColumn("at", F.explode(F.concat(asked, asking)))
    deal = F.concat_ws("/", F.when(F.col("backward"), "b").otherwise("f"), "half", "at.row", "at.column")
    each = each.select(deal.alias("deal"), "rest", "word", "n", F.col("at.asks").alias("asks"), "backward")
    parts = max(parts_for(words.sparkSession), words.count() * 4 // chunk)
    found = each.repartition(parts, "deal").sortWithinPartitions("deal", "rest").mapInArrow(lambda it: _near(it, chunk), "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("form_n"), F.col("b.form").alias("form"))


def _roots(forms: DataFrame, root: str) -> DataFrame:
    """(word, root) of words with a form (word, form): forms of forms, two steps in the first round, four in the next, until none goes on."""
    up, turn = forms.select("word", F.col("form").alias("root")), 0
    up = written(up, f"{root}/up0")
    while True:
        # a form is commoner than its word at least twice, so a chain is as long as a logarithm and the rounds its logarithm
        higher = up.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        turn += 1
        now = written(up.join(higher, "root", "left").select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), f"{root}/up{turn}")
        remove(forms.sparkSession, f"{root}/up{turn - 1}")
        up = now.select("word", "root")
        if not now.where("moved").limit(1).count():
            return up


def spelling_variants(docs: DataFrame, *, least_chars: int = 5, least_n: int = 3, times: int = 2, period: int = 97) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Runs of A-Z, a-z and U+00C0 to U+00FF in whole texts are words, A-Z lower-cased. If ``period`` divides crc32 of ``<doc_id>:<word>``, the character at crc32
    modulo the length is taken out (a known noise that makes variants). Words with ``least_chars`` characters and ``least_n``
    occurrences count. form is the near word with the largest n (of equals the smallest), if that is at least ``times`` the word's n; root follows forms
    to the last. Rows that repeat count each time; a null doc_id is the empty text; null texts have no words; empty table: no rows. Other columns are not
    read.
    """
    spark = docs.sparkSession
    root = shared_dir(spark, "spelling")
    words = written(word_counts(docs, least_chars=least_chars, least_n=least_n, period=period), f"{root}/words")
    near = near_words(words, root)
    chosen = F.col("form_n") >= times * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("form")).alias("form"), F.when(chosen, F.col("form_n")).alias("form_n"))
    rows = written(rows, f"{root}/rows")
    up = _roots(rows.where("form is not null"), root)
    remove(spark, f"{root}/words")
    return rows.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle(least_chars: int = 5, least_n: int = 3, times: int = 2, period: int = 97) -> str:
    """The same result in DuckDB's SQL, by what is left of words when a character is taken out; crc32 bit by bit."""
    return rf"""
        WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents),
        o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS said, w, count(*) AS n FROM t GROUP BY ALL),
        b AS (SELECT w, n, flatten(list_transform(string_split(said, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END)) AS bytes FROM o),
        c AS (SELECT w, n, xor(list_reduce(bytes, lambda x, y: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda z, i: xor(z >> 1, 3988292384 * (z & 1)), xor(x, y)), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM b),
        e AS (SELECT CASE WHEN h % {period} = 0 THEN w[: h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS word, n FROM c),
        v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= {least_chars} GROUP BY word HAVING sum(n) >= {least_n}),
        g AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
        d AS (SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS rest FROM g),
        p AS (SELECT x.word, y.word AS other, y.n FROM d x JOIN d y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
              UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
        f AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS form, max(n) AS form_n FROM p GROUP BY word),
        r AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN f.form_n >= {times} * v.n THEN form END AS form, CASE WHEN f.form_n >= {times} * v.n THEN f.form_n END AS form_n FROM v LEFT JOIN f USING (word)),
        u AS (SELECT word, word AS root FROM r UNION ALL SELECT u.word, r.form FROM u JOIN r ON u.root = r.word WHERE r.form IS NOT NULL)
        SELECT r.word, r.form, u.root, r.n, CAST(r.n_near AS BIGINT) AS n_near, r.form_n
        FROM r JOIN u USING (word) JOIN r x ON u.root = x.word WHERE x.form IS NULL"""
