"""License scans, line dedup and decontamination: against SQL, by hand, and on odd rows."""

import re

from quillgraph.llm import decontaminate, license_scan, line_dedup
from quillgraph.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import LONG, PROSE


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_against_sql(agrees):
    for name in ("op2_license_diagonals", "op3_line_dedup", "op7_decontaminate"):
        assert agrees(QUERIES[name], ORACLES[name]) == 200


def plan(df):
    return df._jdf.queryExecution().toString()


def test_no_python(spark, odd):
    bench = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    for df in (license_scan.license_scan(odd), line_dedup.line_dedup(odd), decontaminate.decontaminate(odd, bench)):
        assert not re.search("Python|Pandas|Arrow", plan(df))


def test_license_by_hand(spark):
    texts = ["CC-BY cc by; cc x by", "x General Public\nLicense, general public  license general public", "All rights reserved.", "Licensed under the Apache License, Version 2.0 and more", "licensed under the very Apache License version 2.0", "K all rights", "released under the MIT licence", "cc", None]
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs(spark, texts)).collect()}
    assert (got[0]["n_words"], got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["base_labels"]) == (7, 2, 0, 2, "cc-by")
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (2, 1, 4) and got[1]["labels"].startswith("gpl")
    assert got[2]["labels"] == "reserved" and got[2]["score"] == 1.0
    assert got[3]["labels"] == "apache-2.0" and got[3]["base_labels"] == ""
    assert got[4]["labels"] == "apache-2.0" and 0.8 <= got[4]["score"] < 1  # a word more parts two diagonals, which merge
    assert got[5]["n_base"] == 0 and got[6]["labels"] == "" and got[7]["n_words"] == 1 and got[7]["first_word"] is None
    assert got[8]["n_words"] == 0 and got[8]["score"] == 0


def test_license_templates_of_any_length(spark, monkeypatch):
    """A template of 150 words: all its places count, and one that lacks a fifth of them is no license."""
    words = [f"w{i}x" for i in range(150)]
    monkeypatch.setattr(license_scan, "TEMPLATES", (*license_scan.TEMPLATES, (" ".join(words), "long-1.0")))
    texts = [" ".join(words), " ".join(words[:130]), " ".join(words[:100]), " ".join(words[:70] + ["more"] + words[70:]), " ".join(words[100:] + words[:100])]
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs(spark, texts)).collect()}
    assert [got[i]["labels"] for i in range(5)] == ["long-1.0", "long-1.0", "", "long-1.0", ""]
    assert got[0]["score"] == 1.0 and abs(got[2]["score"] - 99 / 149) < 1e-9


def test_license_odd(odd, empty):
    got = license_scan.license_scan(odd).collect()
    assert len(got) == 16 and sum(r["doc_id"] is None for r in got) == 2 and sum(r["doc_id"] == 2 for r in got) == 2
    assert license_scan.license_scan(empty).count() == 0


def brute_lines(texts, least=line_dedup.LEAST_WORDS):
    """By definition: lines that lie in a run of consecutive lines with enough words that occurs earlier, before the run."""
    lines = [t.split("\n") for t in texts]
    seen, gone = {}, [set() for _ in texts]
    for d, ls in enumerate(lines):
        for a in range(len(ls)):
            for z in range(a, len(ls)):
                seen.setdefault(tuple(ls[a : z + 1]), (d, a))
    for d, ls in enumerate(lines):
        for a in range(len(ls)):
            for z in range(a, len(ls)):
                if sum(len(x.split()) for x in ls[a : z + 1]) >= least and seen[tuple(ls[a : z + 1])] < (d, a):
                    gone[d] |= set(range(a, z + 1))
    return ["\n".join(x for i, x in enumerate(ls) if i not in g) for ls, g in zip(lines, gone, strict=True)]


def test_line_dedup_by_brute_force(spark):
    import random

    r = random.Random(3)
    words = lambda n: " ".join(f"w{r.randrange(50)}" for _ in range(n))
    block = [words(k) for k in (20, 3, 0, 30, 4, 1)]
    short = [words(5), words(6)]
    texts = []
    for _ in range(30):
        ls = [words(r.randrange(1, 25)) for _ in range(r.randrange(0, 6))]
        if r.random() < 0.6:
            at, part = r.randrange(len(ls) + 1), block[r.randrange(2) : 4 + r.randrange(3)]
            ls[at:at] = part
        ls += short * r.randrange(2)
        texts.append("\n".join(ls))
    texts += ["\n".join(block * 3), "\n".join([words(9)] * 14)]
    for least in (50, line_dedup.LEAST_WORDS, 1):
        got = {x["doc_id"]: x["text"] for x in line_dedup.line_dedup(docs(spark, texts), least).collect()}
        assert [got[i] for i in range(len(texts))] == brute_lines(texts, least), least
        assert got[len(texts) - 1] != texts[-1]


def test_line_dedup_odd(odd, empty):
    rows = line_dedup.line_dedup(odd).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 16 and got[7]["text"] == LONG and got[8]["text"] == "" and got[8]["n_deleted"] == 3000 and got[8]["runs"] == "0-2999"
    assert got[4]["text"] is None and got[5]["text"] == "" and got[1]["text"] == PROSE
    out = line_dedup.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == 16
    assert out.where("doc_id = 8").first()["n_chars"] == 0 and out.where("doc_id = 7").first()["n_chars"] == len(LONG)
    clash = odd.withColumns({"run_id": odd["doc_id"], "runs": odd["text"], "_runs": odd["text"], "kept_text": odd["doc_id"], "RUN_KEY": odd["doc_id"]})
    again = line_dedup.without_repeats(clash)
    assert again.columns == clash.columns and again.where("doc_id = 8").first()["text"] == "" and again.count() == 16
    assert line_dedup.line_dedup(empty).count() == 0 and line_dedup.without_repeats(empty).count() == 0


ITEM = "A train leaves the station at 60 km per hour and a second train leaves two hours later from Boston. How far does the first one travel before Anna sees it pass at noon?"


def test_decontaminate_by_hand(spark):
    bench = spark.createDataFrame([(5, ITEM), (6, ITEM), (7, "x y"), (8, None), (None, "one two three four five six seven")], "item_id long, text string")
    changed = ITEM.replace("60", "85").replace("Boston", "Denver").replace("Anna", "Marta")
    two_values = ITEM.replace("How far", "Boston or").replace("before Anna", "before Anna")
    half = " ".join(ITEM.split()[:12])
    texts = ["before " + ITEM + " after", "So: " + changed, half, "nothing of it " + PROSE, two_values[:60], None, "a one two three four five six seven b", "x y", ITEM.upper()]
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs(spark, texts), bench).collect()}
    assert [got[i]["kept"] for i in range(9)] == [False, False, True, True, True, True, False, False, False]
    assert got[0]["item_ids"] == "5" and not got[0]["changed"] and got[0]["coverage"] == 1 and got[1]["changed"] and got[1]["item_ids"] == "5"
    kept = decontaminate.keep_clean(docs(spark, texts), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(9) if got[i]["kept"]]


def kept(spark, item, texts):
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    return [r["kept"] for r in decontaminate.decontaminate(docs(spark, texts), bench).orderBy("doc_id").collect()]


def test_names_that_begin_sentences(spark):
    item = "Maria has 12 apples and gives 5 of them away. Tom buys the rest and eats two. Maria then asks Tom how many there are left in the box."
    other = item.replace("Maria", "Sofia").replace("Tom", "Peter").replace("12", "30")
    texts = ["Well: " + other + " So it is.", "one two " + item.replace("Maria has", "he said Maria has"), other.replace("Sofia then", "Laura then"), "She said that Sofia has" + other[9:], item + " x", "nothing like it"]
    got = kept(spark, item, texts)
    assert got[:2] == [False, False] and got[3:5] == [False, False] and got[5]
    # two values for one name: not all of its windows count
    assert got[2]


def test_copies_in_any_case(spark):
    for item in (ITEM, "How far does Anna see?", "Anna lives near the old mill in Boston today"):
        texts = [f"x {f(item)} y" for f in (str, str.upper, str.lower, str.title, str.swapcase)] + [f'He said "{item}"', f"a heading\n{item}"]
        assert kept(spark, item, texts) == [False] * 7, item
    rows = [*enumerate(["before " + ITEM.upper() + " after", ITEM.lower()])]
    got = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(5, ITEM)], "item_id long, text string")).collect()
    assert all(not r["kept"] and r["coverage"] == 1 and not r["changed"] for r in got)


def test_short_items_are_found_within_texts(spark):
    texts = ["Now tell me the capital of France please", "capital of France", "CAPITAL OF FRANCE", "the capital of Peru it is", "capital", "capital of", "", "apples 5 km off", "apples 7 miles off", "apples off"]
    bench = spark.createDataFrame([(1, "capital of France"), (2, "apples"), (3, "Apples 12 km off")], "item_id long, text string")
    got = {r["doc_id"]: (r["kept"], r["item_ids"], r["changed"]) for r in decontaminate.decontaminate(docs(spark, texts), bench).collect()}
    assert [got[i] for i in range(10)] == [(False, "1", False), (False, "1", False), (False, "1", False), (False, "1", True), (True, "", False), (True, "", False), (True, "", False), (False, "3", True), (False, "3", True), (True, "", False)]


WORDS = ["Anna", "Tom", "anna", "BOB", "the", "a", "red", "box", "12", "7", "km", "miles", "Km", "of", "in", "straße", "Straße", "éa", "Éa", "x1", "McDo", "I", "4x"]


def decontaminated_by_hand(texts, items):
    """By the definition, window by window."""
    import unicodedata

    def words(text):
        found = []
        for w in "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in (text or "").replace("ß", "ss")).split():
            number = w[0] in "0123456789"
            unit = not number and found and found[-1][0] == decontaminate.NUMBER and w.lower() in decontaminate.UNITS
            name = len(w) > 1 and w[0].isupper() and not any(c.isupper() for c in w[1:])
            found.append((decontaminate.NUMBER if number else decontaminate.UNIT if unit else decontaminate.NAME if name else "", w.lower()))
        return found

    canon = lambda t, form: tuple(w if not k or (form == 2 and k == decontaminate.NAME) else k for k, w in t)
    fixed = lambda t, form: sum(w not in (decontaminate.NUMBER, decontaminate.UNIT, decontaminate.NAME) for w in canon(t, form))
    out = []
    for text in texts:
        d, held = words(text), []
        for number, item in items:
            b = words(item)
            n = min(5, len(b))
            starts = [i for i in range(len(b) - n + 1) if n >= 2 and fixed(b[i : i + n], 2) >= 2]
            sure = [i for i in starts if fixed(b[i : i + n], 1) >= 2]
            lines = {}
            for i in sure or starts:
                own = b[i : i + n]
                for p in range(len(d) - n + 1):
                    t = d[p : p + n]
                    for form in (1, 2):
                        if (form == 1 and (not sure or decontaminate.NAME not in [k for k, _ in own])) or canon(own, form) != canon(t, form):
                            continue
                        lines.setdefault(p - i, []).append((i, {(k, x, y) for (k, x), (_, y) in zip(own, t, strict=True) if k and not (form == 2 and k == decontaminate.NAME)}))
            covered, changed = set(), False
            for hits in lines.values():
                filled = set().union(*(s for _, s in hits))
                torn = {(k, x) for k, x, y in filled if any((k, x) == (a, b2) and y != c for a, b2, c in filled)}
                if any(k != decontaminate.NAME for k, _ in torn):
                    continue
                for i, slots in hits:
                    if not any((k, x) in torn for k, x, _ in slots):
                        covered.add(i)
                        changed |= any(x != y for _, x, y in slots)
            if starts and len(covered) / len(sure or starts) >= 0.8:
                held.append((number, len(covered) / len(sure or starts), changed))
        out.append((not held, ",".join(str(n) for n, *_ in held), max((c for _, c, _ in held), default=0.0), any(c for *_, c in held)))
    return out


def test_decontaminate_by_brute_force(spark):
    import random

    r = random.Random(6)
    run = lambda n: [r.choice(WORDS) for _ in range(n)]
    items = [(k, " ".join(run(r.choice((1, 2, 3, 4, 5, 6, 8, 12, 20))))) for k in range(25)]
    texts = []
    for _ in range(120):
        words = run(r.randrange(0, 12))
        for _ in range(r.randrange(0, 3)):
            part = [x if r.random() > 0.15 else r.choice(WORDS) for x in r.choice(items)[1].split()]
            swap = dict(zip(("Anna", "12"), r.choice((("Anna", "12"), ("Tom", "7"))), strict=True))
            words += [swap.get(x, x) for x in part] + run(r.randrange(0, 4))
        texts.append(r.choice((str, str, str.upper, str.lower))(r.choice((" ", ", ", " - ")).join(words)))
    got = {x["doc_id"]: (x["kept"], x["item_ids"], x["coverage"], x["changed"]) for x in decontaminate.decontaminate(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = decontaminated_by_hand(texts, items)
    assert [got[i] for i in range(len(texts))] == want
    assert 20 < sum(not w[0] for w in want) < 115 and any(w[3] for w in want)


def test_slots_must_agree(spark):
    """The item's number stands at both places; a document with two different ones asks something else."""
    item = "add the number 12 to the big red box and then take the number 12 out of the small blue box"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [item.replace("12", "40"), item.replace("12", "40", 1)]
    got = {r["doc_id"]: r["kept"] for r in decontaminate.decontaminate(docs(spark, texts), bench).collect()}
    assert got == {0: False, 1: True}


def test_broadcast_and_shuffle_agree(spark, odd):
    bench = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    key = lambda df: sorted(map(str, df.collect()))
    a, b = decontaminate.decontaminate(odd, bench), decontaminate.decontaminate(odd, bench, broadcast_rows=0)
    assert key(a) == key(b) and a.where("not kept").count() == 5  # 1, 2 twice, 3, and the null id
    assert a.count() == 16


def test_decontaminate_empty(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(odd, none).where("kept").count() == 16
    assert decontaminate.decontaminate(empty, none).count() == 0 and decontaminate.keep_clean(empty, none).count() == 0
    assert decontaminate.keep_clean(odd, none).columns == odd.columns
    clash = odd.withColumns({"leak_id": odd["doc_id"], "leak_key": odd["text"]})
    assert decontaminate.keep_clean(clash, spark.createDataFrame([(1, PROSE)], "item_id long, text string")).columns == clash.columns
