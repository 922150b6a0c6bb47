"""Language ID, quality and toxicity: held-out accuracy, parts by brute force, and odd rows. The pipeline against its parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import language_id, linear, quality, toxicity
from quillgraph.llm.common import held_out, utf8
from quillgraph.llm.queries import QUERIES
from tests.conftest import SF

SF1 = SF.replace("0.001", "0.01")


def accuracy(df, want, got):
    return df.agg(F.avg((F.col(want) == F.col(got)).cast("double"))).first()[0]


def test_language_held_out(spark):
    d = spark.read.parquet(f"{SF1}/documents.parquet")
    got = QUERIES["op10_language_ftrl"](spark, SF1)
    both = got.join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert both.count() > 100 and accuracy(both, "lang", "lang_pred") > 0.97
    assert got.agg(F.min("score"), F.max("score")).first()[1] <= 1.0


def test_language_odd(odd, empty):
    rows = language_id.language_id(odd).collect()
    assert len(rows) == 16
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert all(by[i]["lang_pred"] == "und" for i in (4, 5, 6, 12)) and by[1]["lang_pred"] == "en"
    assert language_id.language_id(empty).count() == 0


def test_no_language_is_left_out(spark):
    rows = [(i, text, lang) for i, (lang, text) in enumerate([("en", "the day is long"), ("de", "der Tag ist lang"), ("fr", "le jour est long")] * 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.fit(d, F.lit(True), languages=3).languages == ["de", "en", "fr"]
    with pytest.raises(ValueError, match="more than 2 languages"):
        language_id.fit(d, F.lit(True), languages=2)


def slow_counts(text):
    """By the definition, n-gram by n-gram."""
    out = np.zeros(language_id.DIMS, np.int64)
    low, kept = text.lower(), ""
    for i, c in enumerate(low):
        if c.isalpha():
            kept += c
        elif not i or low[i - 1].isalpha():
            kept += " "
    m, mask = [int(x) for x in language_id._MIX], 0xFFFFFFFF
    for i in range(len(kept)):
        g = (ord(kept[i]) * m[0]) & mask
        for n in range(3):
            if i + n >= len(kept):
                break
            if n == 1:
                g = ((g ^ (ord(kept[i + 1]) * m[1] + 1)) * m[2]) & mask
            if n == 2:
                g = ((g ^ (ord(kept[i + 2]) * m[0] + 2)) * m[1]) & mask
            h = g ^ (g >> 15)
            out[((h * m[2]) & mask) >> (32 - language_id.BITS)] += 1
    return out


def test_ngram_counts_by_brute_force(monkeypatch):
    texts = ["Ab c" * 10, "", "  x", "1, 2, drei!? vier", "Éa ß \u65e5\u672c", "a", "ab", ". . .", "x" * 20 + "--" + "y" * 9]
    want = [slow_counts(t) for t in texts]
    for piece in (1 << 20, 7, 3, 2, 1):
        monkeypatch.setattr(language_id, "PIECE", piece)
        assert all((language_id.counts(t) == w).all() for t, w in zip(texts, want, strict=True)), piece


def slow_ftrl(rows, dims, classes, alpha, beta, l1, l2, epochs, seed):
    """Coordinate by coordinate, as the update is written down."""
    z, n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))

    def weight(i, c):
        one, two = (l1, l2) if i < dims else (0.0, 0.0)
        if abs(z[i, c]) <= one:
            return 0.0
        return -(z[i, c] - np.sign(z[i, c]) * one) / ((beta + n[i, c] ** 0.5) / alpha + two)

    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for r in order:
            at, x, y = rows[r]
            at, x = [*at, dims], [*x, 1.0]
            w = [[weight(i, c) for c in range(classes)] for i in at]
            logits = [sum(v * w[k][c] for k, v in enumerate(x)) for c in range(classes)]
            top = np.exp(np.array(logits) - max(logits))
            p = top / top.sum()
            for k, i in enumerate(at):
                for c in range(classes):
                    g = (p[c] - (c == y)) * x[k]
                    sigma = ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / alpha
                    z[i, c] += g - sigma * w[k][c]
                    n[i, c] += g * g
    return np.array([[weight(i, c) for c in range(classes)] for i in range(dims + 1)])


def test_ftrl_by_brute_force():
    r = np.random.default_rng(4)
    rows = [(np.sort(r.choice(12, 4, replace=False)), r.normal(size=4), int(r.integers(3))) for _ in range(60)]
    w, b = linear.ftrl(rows, 12, 3, alpha=0.3, beta=0.7, l1=0.2, l2=0.1, epochs=2, seed=9)
    want = slow_ftrl(rows, 12, 3, 0.3, 0.7, 0.2, 0.1, 2, 9)
    assert np.allclose(w, want[:12]) and np.allclose(b, want[12]) and (w == 0).any()


def test_predictions_by_brute_force(spark):
    """A fitted model's answers, n-gram by n-gram: weights of 1 + log of the count, by the share of documents, scaled to length one."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(d, F.lit(True), sample_rows=100, least_rows=10)
    texts = {r["doc_id"]: r["text"] for r in d.orderBy("doc_id").limit(25).collect()}
    seen = sum((slow_counts(r["text"]) > 0).astype(int) for r in d.select("text").collect())
    total = d.count()
    assert np.allclose(model.idf, np.log((1 + total) / (1 + seen)) + 1, atol=1e-5)
    got = {r["doc_id"]: r for r in language_id.identify(d, model).collect()}
    for i, text in texts.items():
        n = slow_counts(text)
        x = np.where(n > 0, (1 + np.log(np.maximum(n, 1))) * model.idf, 0)
        z = (x / np.sqrt((x * x).sum())) @ model.weights + model.bias
        p = np.exp(z / model.temperature)
        p /= p.sum()
        assert got[i]["lang_pred"] == model.languages[int(p.argmax())] and got[i]["score"] == pytest.approx(p.max(), abs=1e-4)


def test_ftrl_learns_and_prunes():
    r = np.random.default_rng(0)
    rows = []
    for _ in range(600):
        y = int(r.integers(3))
        at = np.unique(np.append(r.integers(3, 50, 5), y))
        rows.append((at, np.ones(len(at)), y))
    w, b = linear.ftrl(rows, 50, 3, l1=1.0)
    assert np.mean([np.argmax(x @ w[at] + b) == y for at, x, y in rows]) > 0.95 and (w == 0).mean() > 0.5
    logits = np.array([[4.0, 0.0]] * 100)
    assert linear.temperature(logits, np.array([0] * 75 + [1] * 25)) == pytest.approx(4 / np.log(3), rel=0.06)


def test_held_out_rule(spark):
    import zlib

    got = spark.range(200).select(F.col("id").alias("doc_id"), held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_quality_held_out(spark):
    got = QUERIES["op4_quality_cnn"](spark, SF1).join(spark.read.parquet(f"{SF1}/labels.parquet"), "doc_id").where("held_out")
    assert got.count() > 40 and accuracy(got, "quality", "predicted") > 0.93


def test_quality_odd(odd, labels, empty):
    rows = quality.quality(odd, labels, epochs=1).collect()
    assert len(rows) == 16 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (7, 8)}) == 1
    assert quality.quality(empty, labels, epochs=1).count() == 0 and quality.quality(odd, labels.limit(0), epochs=1).count() == 16


def test_chunks_cover_all_bytes():
    for n in (0, 1, 255, 256, 1023, 1024, 1025, 1792, 1793, 5000):
        c = quality.chunks(np.arange(n).astype(np.uint8) | 1)
        starts = np.arange(len(c)) * quality.STEP
        assert starts[-1] + quality.CHUNK >= n and (n <= quality.CHUNK or starts[-1] + quality.CHUNK - n < quality.STEP)


def slow_score(net, data):
    """By the definition, filter by filter."""
    c = quality.chunks(data)
    tops = []
    for x in c:
        e = net.embed[x]
        best = np.zeros(quality.FILTERS)
        for at in range(0, quality.CHUNK - quality.STRIDE, quality.STRIDE):
            w = e[at : at + 2 * quality.STRIDE].ravel()
            half = quality.STRIDE * quality.EMBED
            best = np.maximum(best, w[:half] @ net.first + w[half:] @ net.second + net.bias)
        tops.append(best)
    f = np.concatenate([np.mean(tops, axis=0), np.max(tops, axis=0)])
    return 1 / (1 + np.exp(-(f @ net.out + net.base[0])))


def test_scores_and_gradient_by_brute_force():
    net = quality.ByteNet.new(3)
    net.out[:] = np.random.default_rng(1).normal(0, 0.3, len(net.out))
    net.bias[:] = np.random.default_rng(2).normal(0, 0.1, len(net.bias))  # off zero, where the cut has no slope
    texts = [b"", b"abc", b"hello world " * 200, bytes(range(1, 256)) * 900]
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.cumsum([0] + [len(t) for t in texts])
    got = net.score(data, at)
    assert got == pytest.approx([slow_score(net, np.frombuffer(t, np.uint8)) for t in texts], abs=1e-4)
    docs, y, w = [quality.chunks(np.frombuffer(t, np.uint8)) for t in texts[:3]], np.array([0, 1, 1], np.float32), np.ones(3, np.float32)
    net = quality.ByteNet(*(x.astype(np.float64) for x in net.all()))
    loss = lambda: -np.mean([np.log(p if k else 1 - p) for p, k in zip(net.score(np.frombuffer(b"".join(texts[:3]), np.uint8), at[:4]), y, strict=True)])
    g = net.gradient(docs, y, w)
    r = np.random.default_rng(0)
    for param, grad in zip(net.all()[1:], g[1:], strict=True):
        i = tuple(r.integers(s) for s in param.shape)
        was = param[i]
        param[i] = was + 1e-5
        up = loss()
        param[i] = was - 1e-5
        down = loss()
        param[i] = was
        assert (up - down) / 2e-5 == pytest.approx(float(grad[i]), abs=2e-3)


def test_toxicity_held_out(spark):
    got = QUERIES["op5_toxicity_viterbi"](spark, SF1).join(spark.read.parquet(f"{SF1}/labels.parquet"), "doc_id").where("held_out")
    assert got.count() > 40 and accuracy(got, "toxic", "predicted") > 0.93


def letters(texts):
    import pyarrow as pa

    n = toxicity.trigrams(*utf8(pa.array(texts))).reshape(27, 27, 27).astype(float)
    two = n.sum(axis=0) + 0.5
    b = n + 5 * (two / two.sum(axis=1, keepdims=True))[None]
    return -np.log(b / b.sum(axis=2, keepdims=True))


CORPUS = ["the idiot is stupid and the moron is trash", "pathetic worthless loser", "scum and clown", "this is a good day and the sun is out"] * 50


def test_deobfuscation():
    reader = toxicity.Restorer(letters(CORPUS))
    for written, word in (("1d10t", "idiot"), ("m0r0n!!", "moron"), ("s.t.u.p.i.d", "stupid"), ("you s t u p i d", "stupid"), ("trrraaasshhh", "trash"), ("p@th3t1c", "pathetic"), ("$cum", "scum"), ("l-o-s-e-r", "loser"), ("MoRoN", "moron"), ("stuupid", "stupid"), ("stupiid.", "stupid"), ("\u043corons and m\u043er\u043en", "moron"), ("st\u00fcpid", "stupid"), ("\uff49\uff44\uff49\uff4f\uff54", "idiot")):
        assert word in reader.words(written), written
    assert reader.words("The good day.") == {"the", "good", "day"} and reader.words("") == set()
    assert reader.words("thnt*** word***") == {"thnt", "word"}


def test_signs_at_the_ends_are_read_as_letters():
    reader = toxicity.Restorer(letters([*CORPUS, *["you ass and you dumbass", "a pile of poop and a boob"] * 50]))
    for written, word in (("a$$", "ass"), ("4$$", "ass"), ("dumba$$,", "dumbass"), ("a$$!!", "ass"), ("!diot", "idiot"), ("!d!0t.", "idiot"), ("you p o o p", "poop"), ("i. d. i. o. t", "idiot"), ("a s s", "ass"), ("b o o b", "boob"), ("you a. s. s!", "ass")):
        assert word in reader.words(written), written
    # the restored text alone is read
    assert "diot" not in reader.words("!diot") and reader.words("a pile of poop") == {"a", "pile", "of", "poop"}


def test_stretches_are_the_whole_lattice():
    """Decoding the whole text at once, forced apart between longer tokens only, gives the same words."""
    model = letters([*CORPUS, *["you ass and you dumbass", "a pile of poop"] * 50])
    r = np.random.default_rng(5)
    pieces = ["the", "a", "i", "s", "!", "$cum", "m0r0n,", "day.", "(good)", "p o o p", "i. d. i. o. t", "stuupid", "--", "4", "7$", "x-y", "\u0445", "\u0436\u0436", "tr4$h"]
    for _ in range(150):
        tokens = " ".join(r.choice(pieces, int(r.integers(1, 9)))).split()
        alone = [len(t.strip(toxicity._ENDS)) <= 1 for t in tokens]
        lattice, text = [], " ".join(tokens)
        at = 0
        for k, t in enumerate(tokens):
            if k:
                # a forced edge stands where neither neighbour is a single character
                lattice.append([(-1, toxicity.COST_DROP_SPACE), (0, toxicity.COST_SPACE)] if alone[k] or alone[k - 1] else [(0, 0.0)])
                at += 1
            lattice += toxicity.options(text)[at : at + len(t)]
            at += len(t)
        assert toxicity.Restorer(model).words(text) == set(toxicity.best_path(lattice, model).split()), text


def all_paths(text, model):
    """The least cost of all ways through the lattice, tried one by one."""
    best = None

    def go(i, a, b, cost, made):
        nonlocal best
        if i == len(lattice):
            if best is None or cost < best[0]:
                best = (cost, made)
            return
        for symbol, channel in lattice[i]:
            if symbol < 0 or symbol == 0 and b == 0:
                go(i + 1, a, b, cost + channel, made)
            elif symbol == 0:
                go(i + 1, 0, 0, cost + channel + model[a, b, 0], made + " ")
            else:
                go(i + 1, b, symbol, cost + channel + model[a, b, symbol], made + chr(96 + symbol))

    lattice = [*toxicity.options(text), [(0, 0.0)]]
    go(0, 0, 0, 0.0, "")
    return best[1].strip()


def test_viterbi_by_brute_force():
    model = letters(CORPUS)
    for written in ("1d1ot", "m0r.n", "l00s3r", "a b", "tr4$h!", "ss1"):
        assert toxicity.restore(written, model) == all_paths(written, model), written


def test_trigrams_by_brute_force():
    import pyarrow as pa

    texts = ["Ab c", "", "zé9z", "a"]
    n = np.zeros(27**3, int)
    for t in texts:
        for w in "".join(c.lower() if c.isascii() and c.isalpha() else " " for c in t).split():
            s = [0, 0, *(ord(c) - 96 for c in w), 0]
            for k in range(len(s) - 2):
                n[(s[k] * 27 + s[k + 1]) * 27 + s[k + 2]] += 1
    got = toxicity.trigrams(*utf8(pa.array(texts)))
    # the path from one word's edge to the next counts too; letters' rows are the words' own
    own = np.arange(27**3) % 27 > 0
    first = (np.arange(27**3) // 729 == 0) | (np.arange(27**3) // 27 % 27 > 0)
    assert (got[own & first & (np.arange(27**3) // 27 % 27 > 0)] == n[own & first & (np.arange(27**3) // 27 % 27 > 0)]).all()


def test_toxicity_odd(odd, labels, empty):
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == 16 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert toxicity.toxicity(empty, labels).count() == 0 and toxicity.toxicity(odd, labels.limit(0)).where("predicted = 0").count() == 16


def test_good_documents_stay(spark, odd, labels, empty):
    """keep_good keeps the rows, with all their columns, that the score of the whole text puts at the threshold and above."""
    net = quality.fit(odd, labels, epochs=2)
    wide = odd.withColumns({"score": odd["doc_id"], "held_out": odd["text"]})
    score = lambda t: slow_score(net, np.frombuffer((t or "").encode(), np.uint8))
    levels = {r["text"]: score(r["text"]) for r in wide.collect()}
    for threshold in (0.0, sorted(levels.values())[len(levels) // 2] + 1e-3, 1.1):
        got = quality.keep_good(wide, net, threshold)
        assert got.columns == wide.columns and got.count() == sum(levels[r["text"]] >= threshold for r in wide.collect())
    assert quality.keep_good(empty, net).count() == 0


def brute_near(rows):
    """The one row of each group that stays, by all pairs of sets of five words."""
    from tests.llm.test_sets import brute_components

    of, sizes = brute_components([t for _, t in rows], 5)
    return {i for k, (i, _) in enumerate(rows) if not sizes[k] or of[k] == k}


def test_pipeline(spark, monkeypatch):
    """Stage by stage on the smallest tables, each decision against a brute-force version of its operator."""
    import corpus_pipeline as p
    from quillgraph.llm import packing
    from tests.llm.test_native import brute_lines, decontaminated_by_hand
    from tests.llm.test_sets import check_packing

    assert [f for _, f in p.STAGES] == [p.good_documents, p.without_repeated_lines, p.one_of_each_group, p.without_benchmark, p.packed]
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    nets, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a, **k: nets.append(fit(*a, **k)) or nets[-1])
    held = lambda df: [(r["doc_id"], r["text"]) for r in df.orderBy("doc_id").collect()]
    good = p.good_documents(spark, docs, SF).cache()
    net = quality.ByteNet(*(x.astype(np.float64) for x in nets[0].all()))
    for i, text in held(docs)[:15]:
        level = slow_score(net, np.frombuffer(text.encode(), np.uint8))
        if abs(level - 0.3) > 1e-3:
            assert (level >= 0.3) == (i in {k for k, _ in held(good)})
    lines = p.without_repeated_lines(spark, good, SF).cache()
    assert held(lines) == list(zip([i for i, _ in held(good)], brute_lines([t for _, t in held(good)]), strict=True))
    near = p.one_of_each_group(spark, lines, SF).cache()
    assert {i for i, _ in held(near)} == brute_near(held(lines))
    items = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect():
        items.setdefault(r["text"], r["item_id"])
    clean = p.without_benchmark(spark, near, SF).cache()
    some = held(near)[:20] + [x for x in held(near)[20:] if any(t in x[1] for t in items)]
    want = decontaminated_by_hand([t for _, t in some], [(n, t) for t, n in items.items()])
    kept = {i for i, _ in held(clean)}
    assert [i in kept for i, _ in some] == [w[0] for w in want] and not all(w[0] for w in want)
    assert not any(t in x for _, x in held(clean) for t in items)
    rows = p.packed(spark, clean, SF).collect()
    check_packing(held(clean), rows, (512, 1024, 2048, 4096))
    assert {r["doc_id"] for r in rows} == kept and all(df.columns == docs.columns for df in (good, lines, near, clean))
    assert sorted(map(str, p.run(spark, SF).collect())) == sorted(map(str, rows)) and packing.bins(p.packed(spark, clean, SF)).count() == len({(r["shard"], r["bin"]) for r in rows})


def test_pipeline_odd(spark, odd, empty, tmp_path):
    """Nulls, repeats, wordless texts and clashing columns go through all stages; on empty tables every stage gives no rows."""
    import corpus_pipeline as p

    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 14)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/a/labels.parquet")
    spark.createDataFrame([(1, "seven wise owls watch the river flow past the old mill"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    docs = odd.withColumns({c: F.lit(1) for c in ("near_id", "leak_key", "runs", "kept_text", "shard")})
    for _, stage in p.STAGES[:2]:
        docs = stage(spark, docs, f"{tmp_path}/a")
        assert docs.count() == 16  # all labels are good, and lines go but documents stay
    near = p.one_of_each_group(spark, docs, f"{tmp_path}/a")
    ids, some = ([r["doc_id"] for r in rows.collect()] for rows in (near, near.where("trim(text) <> ''")))  # without words, as the copies whose lines are gone, all stay
    assert len(some) == len(set(some) - {None}) + some.count(None) and {1, 4, 5, 6, 7} <= set(ids)
    clean = p.without_benchmark(spark, near, f"{tmp_path}/a")
    assert 1 not in {r["doc_id"] for r in clean.collect()} and clean.count() < near.count()
    assert set(clean.columns) == set(odd.columns) | {"near_id", "leak_key", "runs", "kept_text", "shard"}
    assert p.packed(spark, clean, f"{tmp_path}/a").count() >= clean.count()
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/{name}.parquet")
    empty.write.parquet(f"{tmp_path}/b/documents.parquet")
    for _, stage in p.STAGES:
        assert stage(spark, empty, f"{tmp_path}/b").count() == 0
    assert p.run(spark, f"{tmp_path}/b").count() == 0
