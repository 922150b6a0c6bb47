"""Spelling variants: against SQL, by comparing all words, and on odd rows."""

import random
import zlib
from collections import Counter

import numpy as np

from quillgraph.llm import spelling
from quillgraph.llm.queries import ORACLES, QUERIES


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    """word: (form, root, n, n_near, form_n) of words with these counts."""
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in form.items() if n[v] >= 2 * n[w]}
    root = {}
    for w in n:
        root[w] = w
        while root[w] in form:
            root[w] = form[root[w]]
    return {w: (form.get(w), root[w], n[w], len(near[w]), n.get(form.get(w))) for w in n}


def rows(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_against_sql(agrees):
    assert agrees(QUERIES["op12_spelling_variants"], ORACLES["op12_spelling_variants"]) > 1000


def vocabulary(r, many, letters="abé", lengths=(5, 12)):
    out = {}
    while len(out) < many:
        w = "".join(r.choice(letters) for _ in range(r.randrange(*lengths)))
        out[w] = r.randrange(3, 200)
    return out


def test_by_comparing_all_words(spark, tmp_path):
    """Dense words over three letters, in one automaton, in chunks of a few words, and with keys dealt out in grids of blocks."""
    n = vocabulary(random.Random(1), 500)
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    want = {w: (x[3], x[4]) for w, x in brute(n).items()}
    for i, how in enumerate(({}, {"chunk": 7}, {"block": 5}, {"block": 3, "chunk": 11})):
        found = {r["word"]: r for r in spelling.near_words(words, f"file://{tmp_path}/{i}", **how).collect()}
        assert {w: found[w]["n_near"] if w in found else 0 for w in n} == {w: x[0] for w, x in want.items()}, how
        near = {w: min((v for v in n if one_apart(w, v)), key=lambda v: (-n[v], v), default=None) for w in n}
        assert {w: found[w]["form"] if w in found else None for w in n} == near


def test_automaton_numbers_words_and_is_minimal():
    r = random.Random(4)
    groups = [sorted(w.encode("latin-1") for w in vocabulary(r, 60, "abc", (1, 6))) for _ in range(5)]
    flat, group = [w for g in groups for w in g], np.repeat(np.arange(5), 60)
    made = spelling.Automaton(flat, group, 5)
    for g, words in enumerate(groups):
        for i, w in enumerate(words):
            state, number = made.start[g : g + 1], 0
            for c in w:
                ok, e = made.step(state, np.array([c]))
                state, number = made.to[e], number + made.skip[e][0]
            assert number == i and made.final[state[0]]
    tails = {frozenset(w[len(p) :] for w in g if w.startswith(p)) for g in groups for p in {w[:k] for w in g for k in range(len(w) + 1)}}
    assert made.size == len(tails)  # as many states as there are different sets of tails


def test_noise_and_whole_texts(spark):
    """The character that crc32 names goes, by code point; upper case outside A-Z stays; words run to the end of a long text."""
    texts = [(i, "Überaschung ÜBERASCHUNG überaschung x1maison×maison garçon,garçon") for i in range(300)] + [(None, "maison " * 2000 + "Zuletzt" + "x" * 50_000)] * 3 + [(7, None), (8, "")]
    n = Counter()
    for d, t in texts:
        run = ""
        for c in (t or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
                n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
                run = ""
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    got = rows(spelling.spelling_variants(spark.createDataFrame(texts, "doc_id long, text string")))
    assert got == brute(n) and len(got) > 5 and max(map(len, got)) > 50_000


def test_chains_of_forms(spark):
    n = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "bbbbbb": 191, "ccccc": 5, "cccccc": 9}
    texts = [(1000 * j + i, w) for j, (w, k) in enumerate(n.items()) for i in [i for i in range(999) if zlib.crc32(f"{1000 * j + i}:{w}".encode()) % 97][:k]]
    got = rows(spelling.spelling_variants(spark.createDataFrame(texts, "doc_id long, text string")))
    assert got == brute(n) and got["aaaaa"][1] == got["aaaab"][1] == "bbbbb" and got["bbbbb"][0] is None


def test_odd(spark, odd, empty):
    got = rows(spelling.spelling_variants(odd))
    assert got["brown"][2] == 5 and set(got) >= {"quick", "brown", "while"} and all(len(w) >= 5 for w in got)
    assert spelling.spelling_variants(empty).count() == 0
