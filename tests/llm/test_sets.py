"""Exact and near duplicates, WARC archives, packing: against SQL and brute force, and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import near_dedup, packing, warc
from quillgraph.llm.components import components
from quillgraph.llm.exact_dedup import directory, exact_dedup
from quillgraph.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import LONG, PROSE


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_against_sql(agrees):
    for name in ("op1_near_dedup", "op9_exact_dedup"):
        assert agrees(QUERIES[name], ORACLES[name]) == 200
    assert agrees(QUERIES["op6_warc_writer"], ORACLES["op6_warc_writer"]) == 50


# exact


def test_exact_odd(odd, empty):
    rows = exact_dedup(odd).collect()
    assert len(rows) == 16
    prose = [r for r in rows if r["text_sha256"] == hashlib.sha256(PROSE.replace(" ", "").encode()).hexdigest()]
    assert {(r["doc_id"], r["keep_id"], r["kept"], r["group_size"]) for r in prose} == {(1, 1, True, 4), (2, 1, False, 4), (None, 1, False, 4)} and len(prose) == 4
    void = [r for r in rows if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert {(r["doc_id"], r["keep_id"]) for r in void} == {(4, 6), (5, 6), (6, 6), (None, 6)}  # the most characters stay
    assert {r["keep_id"] for r in rows if r["doc_id"] in (7, 8)} == {7}
    assert exact_dedup(empty).count() == 0


def test_exact_small_pages_and_buckets(spark):
    r = random.Random(1)
    texts = [r.choice("abcdefgh") * r.randrange(1, 4) + " " * r.randrange(3) for _ in range(300)] + ["same"] * 150
    key = lambda df: sorted(map(str, df.collect()))
    d = docs(spark, texts).repartition(5)
    assert key(exact_dedup(d)) == key(exact_dedup(d, page_rows=7, bucket_bytes=100, directory_limit=64)) == key(exact_dedup(d, page_rows=7, broadcast_keys=2))


def test_directory(spark):
    keys = spark.createDataFrame([(k << 50, 10) for k in range(0, 4096, 7)] + [(5 << 50, 10)] * 500, "key long, weight long")
    found = directory(keys, 500, 1000)
    assert found[0][0] == 0 and found[-1][1] == (1 << 62) - 1
    assert all(a[1] + 1 == b[0] for a, b in zip(found, found[1:], strict=False))
    inside = lambda b: [k for k in [(x << 50) for x in range(0, 4096, 7)] + [5 << 50] * 500 if b[0] <= k <= b[1]]
    assert all(10 * len(i) <= 500 or len(set(i)) == 1 for i in map(inside, found))


def test_colliding_keys_compare_bytes(spark, monkeypatch):
    from quillgraph.llm import exact_dedup as module

    batches = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a ", "c", "b"])], "doc_id long, text string")
    entries = batches.coalesce(1).mapInArrow(lambda it: module._fold(it, 1 << 20, 2, key=lambda digest: 1), module.ENTRY)
    owned = entries.coalesce(1).sortWithinPartitions("key", "entry").select("entry", "key", "bytes", "n", "best_cp", "best_id").mapInArrow(module._own, module.OWNED)
    got = {i: (r["keep_id"], r["group_size"]) for r in owned.join(entries, "entry").collect() for i in r["ids"]}
    assert got == {0: (2, 2), 2: (2, 2), 1: (1, 2), 4: (1, 2), 3: (3, 1)}


# near


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(texts, width=4):
    sets = [shingles(t, width) for t in texts]
    of = list(range(len(texts)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(sets)):
        for k in range(i):
            both = len(sets[i] & sets[k])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[k]) - both):
                a, b = top(i), top(k)
                of[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))], [len(s) for s in sets]


def varied(r, base, share):
    return [w if r.random() > share else f"z{r.randrange(10**6)}" for w in base]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_by_brute_force(spark, seed):
    """Chains, stars around a base, small sets at the threshold, and groups whose members are mostly just unlike each other."""
    r = random.Random(seed)
    texts = []
    for size in (5, 8, 12, 40, 150, 400):
        for _ in range(4):
            base = [f"w{r.randrange(10**6)}" for _ in range(size)]
            now = base
            for k in range(12):
                texts.append(" ".join(varied(r, base, 0.02 * (k % 3))))
                now = varied(r, now, 0.03)
                texts.append(" ".join(now))
    shared = [f"s{i}" for i in range(60)]
    texts += [" ".join(shared + [f"u{r.randrange(10**6)}" for _ in range(r.choice((20, 60, 15)))]) for _ in range(60)]
    r.shuffle(texts)
    got = {x["doc_id"]: x for x in near_dedup.near_dedup(docs(spark, texts)).collect()}
    want, sizes = brute_components(texts)
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert all(got[i]["kept"] == (want[i] == i) for i in got)


def test_near_odd(odd, empty):
    rows = near_dedup.near_dedup(odd).collect()
    assert len(rows) == 16
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1} and {r["component_id"] for r in rows if r["doc_id"] in (7, 8)} == {7}
    assert {(r["doc_id"], r["component_id"], r["n_shingles"]) for r in rows if r["doc_id"] in (4, 5, 6)} == {(4, 4, 0), (5, 5, 0), (6, 6, 0)}
    assert {r["component_id"] for r in rows if r["doc_id"] in (9, 10)} == {9}  # one word, the same in small letters
    assert near_dedup.near_dedup(empty).count() == 0
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 4, 5, 6, 7, 9, 11, 12, 13, None}
    assert near_dedup.keep_one(empty).count() == 0
    again = kept.withColumns({"near_id": F.lit(1), "near_key": F.lit("x"), "near_rank": F.lit(0)})
    assert near_dedup.keep_one(again.unionByName(again)).count() == 10 + 4  # texts without words all stay, others once


def test_sketch_estimates():
    r = np.random.default_rng(0)
    a = np.unique(r.integers(0, 2**63, 4000, np.uint64) * np.uint64(2))
    for share in (1.0, 0.9, 0.8, 0.5, 0.0):
        b = np.unique(np.concatenate([a[: int(len(a) * share)], r.integers(0, 2**63, int(len(a) * (1 - share)), np.uint64) * np.uint64(2)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        est, used = near_dedup.estimate(near_dedup.registers(a), near_dedup.registers(b))
        assert used == 256 and abs(est - true) < 5 * np.sqrt(max(true * (1 - true), 0.002) / 256)


def test_words_hash_like_words():
    texts = ["The cat", "the\tCAT", "theca t", "", "ÉCOLE x", "École x"]
    data = "".join(texts).encode()
    at = np.cumsum([0] + [len(t.encode()) for t in texts])
    h, n = near_dedup.words(np.frombuffer(data, np.uint8), at)
    assert list(n) == [2, 2, 2, 0, 2, 2]
    assert list(h[:2]) == list(h[2:4]) and h[0] != h[4] and h[7] == h[9]
    assert h[6] == near_dedup.words(np.frombuffer("Éc0".encode()[:2] + "cole".encode(), np.uint8), np.array([0, 6]))[0][0]


def test_blocks_span():
    """A block's links join what all links join, and no list of all pairs is made; between parts alone if there are several."""
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 40, np.uint64)
    for _ in range(20):
        sets = [np.unique(np.concatenate([base[r.random(40) < 0.9], r.integers(0, 2**63, int(r.integers(0, 5)), np.uint64)])) for _ in range(30)]
        regs, component, part = np.array([near_dedup.registers(s) for s in sets]), r.integers(0, 25, 30), r.integers(0, 2, 30)
        for split in (None, part):
            got = near_dedup.spanning(sets, regs, component, split, 70)
            links = [(a, b) for a in range(30) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 70 * len(np.union1d(sets[a], sets[b])) and (split is None or part[a] != part[b])]
            assert all((max(x), min(x)) in links for x in got) and len(got) < 30
            assert joined(component, got) == joined(component, links)


def joined(component, links):
    of = {c: c for c in component.tolist()}
    for a, b in links:
        x, y = of[int(component[a])], of[int(component[b])]
        of = {c: min(x, y) if t in (x, y) else t for c, t in of.items()}
    return of


def test_shared_counts():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 60, k).astype(np.uint64)) for k in r.integers(1, 60, 40)]
    shared = near_dedup.Shared(sets)
    for a in range(40):
        assert [int(x) for k, x in enumerate(shared.with_all(a)) if k != a] == [len(np.intersect1d(sets[a], s)) for k, s in enumerate(sets) if k != a]


def test_small_sets_meet_in_bands():
    """Four of five shingles in common: the bands agree about as often as the registers would by themselves, six times over."""
    r = np.random.default_rng(3)
    shared = []
    for _ in range(300):
        a = np.sort(r.integers(0, 2**63, 5, np.uint64) * np.uint64(2))
        x, y = (near_dedup.band_keys(near_dedup.registers(s)[None])[0] for s in (a, np.delete(a, r.integers(5))))
        shared.append((x == y).mean())
    assert min(shared) > 0 and 0.2 < np.mean(shared) < 0.33
    one = [near_dedup.band_keys(near_dedup.registers(np.sort(r.integers(0, 2**63, 5, np.uint64) * np.uint64(2)))[None])[0] for _ in range(200)]
    assert len(np.unique(np.concatenate(one))) > 0.999 * 200 * near_dedup.BANDS


@pytest.mark.parametrize("order", ["falling", "random", "zigzag"])
def test_rounds_of_long_paths(spark, tmp_path, monkeypatch, order):
    """A path of 1,000 nodes ends within 20 rounds, whatever the order of its ids."""
    from quillgraph.llm import components as module

    n, labels, whole = 1000, [], module.written
    ids = {"falling": list(range(n, 0, -1)), "random": random.Random(3).sample(range(n), n), "zigzag": [i if i % 2 else 2 * n - i for i in range(n)]}[order]
    monkeypatch.setattr(module, "written", lambda df, path: (labels.append(path) if "/labels" in path else None, whole(df, path))[1])
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)) + [(5000, 5001)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(edges, str(tmp_path / "c")).collect()}
    assert got == dict.fromkeys(ids, min(ids)) | {5000: 5000, 5001: 5000} and len(labels) <= 20


def test_components(spark, tmp_path):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(70)] + [(300, k) for k in range(301, 340)]
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long"), str(tmp_path / "c")).collect()}
    of = {i: i for e in edges for i in e}
    for _ in range(len(of)):
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    assert got == {i: c for i, c in of.items() if any(a != b and i in (a, b) for a, b in edges)}
    assert components(spark.createDataFrame([], "a long, b long"), str(tmp_path / "n")).count() == 0


# archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload string")


PAGES = [(3, "http://a/3", "x" * 200), (1, "http://a/1", "x" * 200), (2, None, "x" * 200), (4, "http://a/4", "é" * 49), (5, "http://a/5", "é" * 49), (6, "u", None), (7, "u\r\nv", ""), (8, "u", "y" * 100_000), (None, "n", "x" * 200), (None, "n", "z" * 300), (9, "r", "q" * 120), (9, "r", "q" * 120)]


def test_warc_odd(spark, tmp_path):
    p = pages(spark, [(*r, "clash", "clash") for r in PAGES])
    out = f"file://{tmp_path}/w"
    manifest = warc.write_warc(p, out, range_bytes=500, roll_bytes=400)
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_warc(manifest, out).collect()), key=str)
    want = [(1, 200, "response", None), (2, 200, "revisit", 1), (3, 200, "revisit", 1), (4, 98, "response", None), (5, 98, "response", None), (6, 0, "response", None), (7, 0, "response", None), (8, 100_000, "response", None), (None, 200, "revisit", 1), (None, 300, "response", None), (9, 120, "response", None), (9, 120, "revisit", 9)]
    assert got == sorted(want, key=str)
    back = warc.read_warc(manifest, out, with_payload=True).where("record_type = 'response'").collect()
    texts = {(r["page_id"], r["payload"].decode()) for r in back}
    assert (8, "y" * 100_000) in texts and (4, "é" * 49) in texts
    assert sorted(x.name for x in (tmp_path / "w").iterdir() if not x.name.startswith("part-")) == ["manifest"]  # nothing temporary stays
    heads = {}
    for file in (r["file"] for r in manifest.collect()):
        for fields, _ in warc.records(iter([(tmp_path / "w" / file).read_bytes()])):
            heads[fields["WARC-Record-ID"]] = fields
    visits = [h for h in heads.values() if h["WARC-Type"] == "revisit"]
    assert len(visits) == 4 and all(heads[h["WARC-Refers-To"]]["WARC-Type"] == "response" and heads[h["WARC-Refers-To"]]["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] for h in visits)
    assert all(h["WARC-Refers-To-Target-URI"] == heads[h["WARC-Refers-To"]]["WARC-Target-URI"] for h in visits if "WARC-Refers-To-Target-URI" in h)


def test_warc_is_deterministic(spark, tmp_path):
    p = pages(spark, [(*r, None, None) for r in PAGES])
    a = warc.write_warc(p, f"file://{tmp_path}/a", range_bytes=500, roll_bytes=300)
    b = warc.write_warc(p.repartition(7).orderBy(F.desc("page_id")), f"file://{tmp_path}/b", range_bytes=500, roll_bytes=300)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 3
    for r in a.collect():
        data = (tmp_path / "a" / r["file"]).read_bytes()
        assert hashlib.sha256(data).hexdigest() == r["sha256"] and len(data) == r["bytes"] and data == (tmp_path / "b" / r["file"]).read_bytes()
        assert zlib.decompress(data, 31).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_warc_ranges(spark):
    r = random.Random(8)
    for ids in ([*range(3000)], [7] * 500, [r.randrange(-(2**63), 2**63) for _ in range(2000)], [*range(2000)] + [2**62 + k for k in range(500)], [5], [1 << 60] * 3 + [*range(0, 4000, 3)]):
        rows = spark.createDataFrame([(i, 10) for i in ids], "page_id long, weight long")
        cuts = warc.ranges(rows, 400)
        assert cuts == sorted(set(cuts))
        per = {}
        for i in ids:
            n = sum(c <= i for c in cuts)
            per.setdefault(n, []).append(i)
        assert all(10 * len(x) <= 400 or len(set(x)) == 1 or 10 * len(x) <= 800 for x in per.values()) and len(per) == len(cuts) + 1
        assert len(cuts) <= 2 * (10 * len(ids) // 400) + 1


def test_warc_rolls_by_default(spark, tmp_path):
    """Files of a range roll at the sizes that the query takes."""
    noise = spark.range(260).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.expr("array_join(transform(sequence(1, 1200), k -> sha2(concat(id, '/', k), 256)), '')").alias("html"))
    manifest = warc.write_warc(noise, f"file://{tmp_path}/w").collect()
    assert len(manifest) > 1 and {r["file"].split("-")[1] for r in manifest} == {"000000"} and max(r["bytes"] for r in manifest) < 9 << 20


def test_warc_finds_damage(spark, tmp_path):
    m = warc.write_warc(pages(spark, [(1, "u", "x" * 500, None, None)]), f"file://{tmp_path}/w")
    file = tmp_path / "w" / m.first()["file"]
    members = [bytes(file.read_bytes())]
    file.write_bytes(members[0][:-20])
    with pytest.raises(Exception, match="record|OSError"):
        warc.read_warc(m, f"file://{tmp_path}/w").collect()


def test_warc_empty(spark, tmp_path):
    assert warc.warc_round_trip(pages(spark, [])).count() == 0


# packing


def check_packing(docs_rows, packed, capacities):
    pieces = {}
    for r in packed:
        pieces.setdefault((r["shard"], r["bin"]), []).append(r)
    for rs in pieces.values():
        rs.sort(key=lambda r: r["place"])
        used = 0
        for k, r in enumerate(rs):
            assert r["place"] == k and r["offset"] == used
            used += r["length"]
        assert {r["used"] for r in rs} == {used} and rs[0]["capacity"] == min(c for c in capacities if c >= used)
    total = sum(len((t or "").split()) + 1 for _, t in docs_rows)
    assert sum(r["length"] for r in packed) == total


def test_packing_odd(odd, empty):
    sizes = (8, 64, 512)
    rows = packing.pack(odd, capacities=sizes, shard_words=5000).collect()
    check_packing([(r["doc_id"], r["text"]) for r in odd.collect()], rows, sizes)
    long = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == 7)
    assert all(a + n == b for (a, n), (b, _) in zip(long, long[1:], strict=False)) and long[0][0] == 0 and sum(n for _, n in long) == len(LONG.split()) + 1
    assert packing.pack(empty).count() == 0
    assert packing.bins(packing.pack(odd, capacities=sizes)).agg(F.sum(F.size("doc_ids"))).first()[0] == packing.pack(odd, capacities=sizes).count()


def test_packing_in_small_shards(odd):
    rows = packing.pack(odd, capacities=(8, 64), shard_pieces=100).collect()
    check_packing([(r["doc_id"], r["text"]) for r in odd.collect()], rows, (8, 64))
    assert len({r["shard"] for r in rows}) > 3


def test_packing_depends_on_the_rows_alone(spark, odd):
    many = odd.unionByName(spark.range(2500).select(F.lit(77).cast("long").alias("doc_id"), F.lit("the same again").alias("text")), allowMissingColumns=True)
    key = lambda df: sorted(map(str, df.collect()))
    how = {"capacities": (8, 64, 512), "shard_words": 5000, "copies": 100}
    a = key(packing.pack(many, **how))
    assert a == key(packing.pack(many.repartition(7).orderBy(F.desc("text")), **how))
    rows = [r for r in packing.pack(many, **how).collect() if r["doc_id"] == 77]
    assert len(rows) == 2500 and len({r["shard"] for r in rows}) > 2


def brute_best_fit(lengths, capacities, overhead, attention):
    size_for = lambda n: min(c for c in capacities if c >= n)

    def per_word(c, n, rest):
        used = n
        for x in rest:
            used += x if used + x <= c else 0
        final = size_for(used)
        return (final + final * final / attention + overhead) / used

    bins = []
    for i, n in enumerate(lengths):
        fits = [(size - sum(held), b) for b, (size, held) in enumerate(bins) if size - sum(held) >= n]
        if fits:
            bins[min(fits)[1]][1].append(n)
        else:
            size = min((c for c in capacities if c >= n), key=lambda c: (per_word(c, n, lengths[i + 1 :]), c))
            bins.append((size, [n]))
    return [(size_for(sum(h)), h) for _, h in bins]


def test_best_fit_by_brute_force():
    r = random.Random(2)
    for _ in range(60):
        lengths = sorted((r.randrange(1, 33) for _ in range(r.randrange(1, 80))), reverse=True)
        overhead, attention = r.choice((0, 2, 10)), r.choice((4, 32, 10**9))
        bins, sizes = packing.best_fit(lengths, [8, 16, 32], overhead, attention)
        want = brute_best_fit(lengths, [8, 16, 32], overhead, attention)
        held = [[n for n, b in zip(lengths, bins, strict=True) if b == k] for k in range(len(sizes))]
        assert list(zip(sizes, held, strict=True)) == want


def test_several_lengths_cost_less_than_one():
    """Lognormal lengths: several sizes open, and the whole costs less than with the one size that holds every piece."""
    r = random.Random(4)
    lengths = sorted((min(4096, max(1, int(r.lognormvariate(6.3, 1.1)))) for _ in range(8000)), reverse=True)
    sizes = [512, 1024, 2048, 4096]
    total = lambda got: sum(packing.cost(c, 64, 8192) for c in got)
    mixed = packing.best_fit(lengths, sizes, 64, 8192)[1]
    share = {c: mixed.count(c) / len(mixed) for c in sizes}
    assert min(share.values()) > 0.02, share
    assert total(mixed) < 0.95 * total(packing.best_fit(lengths, sizes[-1:], 64, 8192)[1])
    assert sum(lengths) / sum(mixed) > 0.95


def test_packing_is_tight(spark):
    d = docs(spark, [" ".join(["w"] * (i * 37 % 900 + 1)) for i in range(800)])
    rows = packing.pack(d, capacities=(256, 1024)).select("shard", "bin", "capacity", "used").distinct().collect()
    assert sum(r["used"] for r in rows) / sum(r["capacity"] for r in rows) > 0.97


def test_packed_texts(spark):
    d = docs(spark, ["a b c", "d", ""])
    p = packing.texts(d, packing.pack(d, capacities=(2, 4)))
    assert {(r["doc_id"], r["start"], r["text"]) for r in p.collect()} == {(0, 0, "a b c <|end|>"), (1, 0, "d <|end|>"), (2, 0, "<|end|>")}
