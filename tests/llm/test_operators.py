import gzip
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loam.llm import _kernel as K
from loam.llm import decontam, fingerprint, licenses, linededup, neardup, packing, pii, quality, substring, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice(["an", "ti", "re", "on", "th", "ou", "sh", "ble"]) for _ in range(rng.randint(1, 4))) for _ in range(900)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)


EDGES = [None, "", " \n ", "one", "one", "Two words", "a " * 30_000, "é" * 5]


@pytest.fixture(scope="module")
def edges(spark):
    rows = frame(spark, EDGES)
    twice = rows.union(rows).union(spark.createDataFrame([(None, "without id", None, None, None), (3, "one", "en", "s", 3)], SCHEMA))
    return twice.withColumn("key", F.lit(1)).withColumn("__key", F.lit(2)).withColumn("gone", F.lit(3)).withColumn("__gone", F.lit(4)).withColumn("drop", F.lit(5)).withColumn("pos", F.lit(6))


def test_kernel():
    texts = ["Hello, Wörld ÀÈ x1_2 a_very_long_word_of_many_bytes", "", "!?", "b"]
    raw = [t.encode() for t in texts]
    w = K.words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert w.counts().tolist() == [len(K.slow_words(t)) for t in texts]
    assert len(set(w.hashes.tolist())) == len(w.hashes)
    assert K.hash_words("wörld")[0] == w.hashes[1]


def test_quality(spark):
    good, junk, bad = [prose(60) for _ in range(240)], [prose(40).upper().replace(" ", "!! ") for _ in range(60)], [prose(50) + " idiot trash scum " + prose(9) for _ in range(60)]
    docs = frame(spark, good + junk + bad)
    labels = spark.createDataFrame([(i, int(not 240 <= i < 300), int(i >= 300)) for i in range(360) if i % 2], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.quality_sample(docs, labels).collect()}
    held_out = [i for i in range(360) if not i % 2]
    assert np.mean([(i in kept) == (i < 240) for i in held_out]) > 0.93
    rows = quality.select_quality(docs, labels)
    assert rows.columns == docs.columns and {r.doc_id for r in rows.collect()} == kept


def test_quality_threshold(spark):
    x = np.random.default_rng(1).normal(size=5000).round(2)
    keys = spark.createDataFrame([(float(v),) for v in x], "key double")
    for k in (1, 17, 2500, 5000):
        assert quality.threshold(keys, k) == np.sort(x)[-k]


def test_quality_models_against_brute_force(spark):
    docs = frame(spark, [prose(rng.randint(1, 40)) for _ in range(120)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    role = {r.doc_id: r.role for r in quality._roles(labels, 1000).collect()}
    raw, target = np.zeros(quality.SIZE), np.zeros(quality.SIZE)
    for r in docs.collect():
        h = [int(x) for x in K.hash_words(r.text)]
        one = K.Words(np.array(h, K.U64), None, None, np.array([0, len(h)]))
        two = one.ngrams(2)[0][: len(h) - 1].tolist()
        for b in [x % quality.ONE for x in h] + [quality.ONE + x % quality.TWO for x in two]:
            raw[b] += 1
            target[b] += role[r.doc_id] == 1
    want = np.zeros(quality.SIZE)
    for part in (slice(0, quality.ONE), slice(quality.ONE, quality.SIZE)):
        want[part] = np.log((target[part] + 1) / (raw[part] * target[part].sum() / raw[part].sum() + 1))
    assert np.allclose(quality.fit(docs, labels).ratio, want, atol=1e-5)
    # the k largest keys of all are the sample
    weight = quality.score_column(quality.fit(docs, labels))
    rows = docs.select("doc_id", weight("text").alias("w"), quality._gumbel(F.col("doc_id"), 1).alias("g")).collect()
    k = sum(r.w >= np.log(0.5) for r in rows)
    best = sorted(rows, key=lambda r: -(r.w / 0.2 + r.g))[:k]
    assert {r.doc_id for r in quality.quality_sample(docs, labels).collect()} == {r.doc_id for r in best}


def test_quality_edges(spark, edges):
    none = spark.createDataFrame([(None, 1, 0), (1, None, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.select_quality(edges, none)
    assert got.columns == edges.columns and got.where("doc_id = 0 or text = ''").count() == 0 and got.where("doc_id = 3").count() == 3
    assert quality.quality_sample(edges.limit(0), none).count() == 0


def near_pairs(texts, t):
    sets = [{tuple(w[i : i + min(3, len(w))]) for i in range(max(1, len(w) - 2))} if (w := K.slow_words(x)) else set() for x in texts]
    return [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])]


def test_near_duplicates_against_all_pairs(spark):
    base = [prose(rng.randint(1, 120)) for _ in range(60)]
    passage = prose(25)
    texts = base + base[:10] + [" ".join(rng.choice(VOCABULARY) if rng.random() < 0.06 else w for w in t.split()) for t in base[:40]] + [prose(9) + " " + passage + " " + prose(9) for _ in range(20)]
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in near_pairs(texts, 0.5):
            root[a] = root[b] = min(root[a], root[b])
    want = {(i, r) for i, r in enumerate(root) if i != r}
    assert {(r.doc_id, r.keep_id) for r in neardup.near_duplicates(frame(spark, texts)).collect()} == want
    left = neardup.drop_near_duplicates(frame(spark, texts), broadcast_limit=0)
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {i for i, _ in want}


def test_near_duplicates_edges(spark, edges):
    got = {(r.doc_id, r.keep_id) for r in neardup.near_duplicates(edges).collect()}
    assert got == {(4, 3)}
    assert neardup.drop_near_duplicates(edges).columns == edges.columns
    assert neardup.near_duplicates(edges.limit(0)).count() == 0


def test_line_dedup(spark, edges):
    texts = [f"own {i}\n Boiler PLATE \n\nlast {i}" for i in range(12)] + ["own 0\n Boiler PLATE \n\nlast 0"] * 30
    got = {r.doc_id: (r.text, r.n_chars, r.n) for r in linededup.dedup_lines(frame(spark, texts), dropped="n").collect()}
    assert got[3] == ("own 3\n\nlast 3", 13, 1) and got[20] == ("own 0\n\nlast 0", 13, 1)
    assert linededup.dedup_lines(frame(spark, texts), broadcast_limit=0).where("text like '%PLATE%'").count() == 0
    same = linededup.dedup_lines(edges)
    assert same.columns == edges.columns and same.exceptAll(edges).count() == 0 and same.count() == edges.count()
    assert linededup.dedup_lines(edges.limit(0)).count() == 0


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs():
    for _ in range(200):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(1, 30))] for _ in range(2))
        mask = {}
        for i, x in enumerate(a):
            mask[x] = mask.get(x, 0) | 1 << i
        assert decontam.lcs(b, len(a), mask) == slow_lcs(a, b)


def test_decontamination_recall(spark):
    items = [prose(rng.randint(15, 59)) for _ in range(40)]
    change = lambda t: " ".join(rng.choice(VOCABULARY) if rng.random() < 0.1 else w for w in t.split())
    texts = [prose(rng.randint(5, 300)) for _ in range(200)] + [prose(rng.randint(0, 80)) + " " + (change(t) if i % 2 else t) + " " + prose(rng.randint(0, 80)) for i, t in enumerate(items)]
    benchmark = spark.createDataFrame([*enumerate(items), (90, None), (91, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(frame(spark, texts), benchmark).collect()}
    want = {(200 + i, i) for i in range(40)}
    assert len(got & want) >= 36 and all(d >= 200 for d, _ in got)
    assert {r.doc_id for r in decontam.drop_leaks(frame(spark, texts), benchmark, per_pass=15).collect()} == set(range(240)) - {d for d, _ in got}


def test_decontamination_against_brute_force(spark):
    # every item against every passage without a latent space
    items = [prose(rng.randint(15, 50)) for _ in range(20)]
    texts = [prose(rng.randint(5, 150)) for _ in range(30)]
    for i, t in enumerate(items * 2):
        words = [rng.choice(VOCABULARY) if rng.random() < i / 80 else w for w in t.split()]
        texts.append(f"{prose(rng.randint(0, 60))} {' '.join(words)} {prose(rng.randint(0, 60))}")
    want = set()
    for d, t in enumerate(texts):
        w = K.slow_words(t)
        for i, x in enumerate(items):
            x = K.slow_words(x)
            tail = x[-max(1, len(x) // 4) :]
            for at in range(0, max(1, len(w) - 16), 16):
                part = w[max(0, at - len(x)) : at + 32 + len(x)]
                share = slow_lcs(part, x) / len(x)
                if share >= 0.7 or share >= 0.6 and slow_lcs(part, tail) >= 0.75 * len(tail):
                    want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(frame(spark, texts), spark.createDataFrame([*enumerate(items)], "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 20


def test_decontamination_bound(monkeypatch):
    # a text that repeats few of an item's words isn't aligned with it; one that holds them all is found
    calls, whole = [], decontam.lcs
    monkeypatch.setattr(decontam, "lcs", lambda *x: calls.append(x) or whole(*x))
    embed = np.ones((decontam.D + 1, decontam.RANK), np.float32)
    item = " ".join(f"word{i}" for i in range(20))
    items = decontam.Items([(1, item, None)], embed)
    assert not list(decontam._matches(pa.array(["word3 word7 " * 200]), items, embed, decontam.Rules())) and not calls
    assert [x[:2] + x[3:5] for x in decontam._matches(pa.array(["word3 " * 30 + item]), items, embed, decontam.Rules())] == [(0, 0, 1.0, 1.0)] and calls


def test_decontamination_edges(spark, edges):
    benchmark = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    assert decontam.drop_leaks(edges, benchmark).columns == edges.columns
    assert decontam.leaks(edges.limit(0), benchmark).count() == 0 and decontam.leaks(edges, benchmark.limit(0)).count() == 0


def test_packing(spark, edges):
    base = [prose(rng.randint(5, 150)) for _ in range(60)]
    texts = base + [t + " " + prose(5) for t in base[:30]] + [None, ""]
    got = packing.pack_related(frame(spark, texts), window=100).collect()
    cover = {}
    for r in got:
        assert r.n_words == sum(b - a for a, b in zip(r.starts, r.ends))
        for d, a, b in zip(r.doc_ids, r.starts, r.ends):
            cover.setdefault(d, []).append((a, b))
    assert sum(r.n_words < 100 for r in got) <= 1
    for i, t in enumerate(texts):
        spans, n = sorted(cover.get(i, [])), len(K.slow_words(t))
        assert [a for a, _ in spans] == [0, *(b for _, b in spans)][: len(spans)] and (spans[-1][1] if spans else 0) == n
    flat = [d for r in sorted(got, key=lambda r: r.window) for d in dict.fromkeys(r.doc_ids)]
    place = {d: i for i, d in enumerate(dict.fromkeys(flat))}
    assert np.mean([abs(place[i] - place[60 + i]) == 1 for i in range(30)]) > 0.9
    assert packing.pack_related(edges).count() > 0 and packing.pack_related(edges.limit(0)).count() == 0


def test_neighbours_recall_against_all_pairs(spark):
    # values that many hold in different sets, so that partners lie far apart in every list: harder than texts are
    sk = [sorted({rng.randint(0, 30) for _ in range(rng.randint(0, 6))} | {rng.randint(100, 400) for _ in range(rng.randint(0, 3))}) for _ in range(400)]
    sk += [[1, 2, 3]] * 20 + [[40, 41, 5000 + i] for i in range(90)]
    got = {}
    for r in packing.neighbour_graph(spark.createDataFrame(list(enumerate(sk)), "row long, sketch array<long>"), short=8).collect():
        assert r.weight == len({*sk[r.a]} & {*sk[r.b]}) and r.a != r.b
        got.setdefault(r.a, []).append(r.weight)
    slots = []
    for i, x in enumerate(sk):
        want = sorted((n for j, y in enumerate(sk) if j != i and (n := len({*x} & {*y}))), reverse=True)[:6]
        have = sorted(got.get(i, []), reverse=True)[: len(want)]
        slots.append([h >= w for h, w in zip(have, want)] + [False] * (len(want) - len(have)))
    assert np.mean([b for x in slots for b in x]) > 0.95 and np.mean([x[0] for x in slots if x]) > 0.98


def test_neighbours_recall_of_texts(spark):
    # passages and phrases that many texts hold, on the lists' own terms
    shared = [prose(rng.randint(3, 30)) for _ in range(25)]
    texts = [" ".join([prose(rng.randint(0, 40)), *rng.sample(shared, rng.randint(0, 4)), prose(rng.randint(0, 40))]) for _ in range(500)]
    rows = frame(spark, texts).select("doc_id", "text").mapInArrow(packing._sketch(24, 3), "row long, n long, sketch array<long>".replace("row", "doc_id")).selectExpr("doc_id as row", "sketch")
    sk = {r.row: set(r.sketch) for r in rows.collect()}
    got = {}
    for r in packing.neighbour_graph(rows, short=16).collect():
        got.setdefault(r.a, []).append(r.weight)
    found = total = 0
    for i, x in sk.items():
        want = sorted((n for j, y in sk.items() if j != i and (n := len(x & y))), reverse=True)[:6]
        total += sum(want)
        found += sum(sorted(got.get(i, []), reverse=True)[: len(want)])
    assert found / total > 0.95


def test_neighbours_are_those_of_all_pairs(spark):
    # long lists in which partners lie further apart than the index reaches
    own = random.Random(11)
    sk = [sorted({own.randint(0, 40) for _ in range(own.randint(0, 8))} | {own.randint(100, 300) for _ in range(own.randint(0, 2))}) for _ in range(500)]
    sk += [[1, 2, 3]] * 9 + [[40, 41, 5000 + i] for i in range(90)]
    rows = spark.createDataFrame(list(enumerate(sk)), "row long, sketch array<long>")
    shared = [[len({*x} & {*y}) if i != j else 0 for j, y in enumerate(sk)] for i, x in enumerate(sk)]
    got = {}
    for r in packing.neighbour_graph(rows, short=8, reach=1).collect():
        assert r.weight == shared[r.a][r.b]
        got.setdefault(r.a, []).append(r.weight)
    for i, x in enumerate(shared):
        want = [n for n in sorted(x, reverse=True)[:6] if n]
        assert sorted(got.get(i, []), reverse=True)[: len(want)] == want


def test_walk():
    e = [(1, 2, 5), (2, 3, 1), (2, 4, 3)]
    a, b, w = (np.array(x) for x in zip(*[*e, *((b, a, w) for a, b, w in e)]))
    assert packing.walk(np.zeros(6, int), a, b, w) == [[1, 2, 4], [3]]


def test_paths_over_pieces(spark):
    # a chain in which each text shares half with the next
    parts = [prose(40) for _ in range(41)]
    texts = [a + " " + b for a, b in zip(parts, parts[1:])]
    for piece in (4, 10**6):
        got = packing.pack_related(frame(spark, texts), window=10**6, piece=piece).collect()
        order = [d for r in got for d in r.doc_ids]
        assert sorted(order) == list(range(40)) and np.mean([abs(a - b) == 1 for a, b in zip(order, order[1:])]) > 0.9
    e = [(rng.randint(0, 60), rng.randint(0, 60), rng.randint(1, 5)) for _ in range(150)]
    e = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), w) for a, b, w in e if a != b}.values())
    linked, edges = {frozenset(x[:2]) for x in e}, spark.createDataFrame(e, "a long, b long, weight long")
    rows = sorted({r for x in e for r in x[:2]})
    chains = {x: i for i, x in enumerate(rows)}
    alone = spark.createDataFrame([(r, r, 0) for r in chains], "row long, path long, place long")

    def check(table):
        paths = {}
        for r in table.collect():
            paths.setdefault(r.part, []).append((r.place, r.row))
        assert all(sorted(p for p, _ in x) == list(range(len(x))) for x in paths.values())
        paths = [[r for _, r in sorted(x)] for x in paths.values()]
        assert sorted(r for p in paths for r in p) == rows
        assert all(frozenset(x) in linked for p in paths for x in zip(p, p[1:]))
        # no edge is left between the ends of two paths
        assert not any(frozenset((x, y)) in linked for p in paths for q in paths if p is not q for x in (p[0], p[-1]) for y in (q[0], q[-1]))
        return {frozenset(x) for p in paths for x in zip(p, p[1:])}

    found = [check(packing.joined(alone, edges, one_task=n)) for n in (0, 30, 1000)]
    assert found[0] == found[1] == found[2]
    for piece in (3, 1000):
        check(packing.paths(edges.union(edges.select("b", "a", "weight")), piece=piece))


def test_licenses(spark, edges):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("furnished", "supplied").replace("sublicense, ", "")
    texts = [prose(30) + " Released under the MIT License. " + prose(9), prose(20) + " " + changed, prose(80), "licensed UNDER the apache license version 2.0"]
    got = {(r.doc_id, r.license): r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    assert set(got) == {(0, "MIT-notice"), (1, "MIT"), (3, "Apache-2.0-notice")}
    r = got[0, "MIT-notice"]
    assert (r.coverage, r.start_word, r.end_word) == (1.0, 30, 35) and texts[0].encode()[r.start_byte : r.end_byte] == b"Released under the MIT License"
    assert 0.95 < got[1, "MIT"].coverage < 1
    assert licenses.scan_licenses(edges).count() == 0 and licenses.scan_licenses(edges.limit(0)).count() == 0


def test_licenses_side_by_side(spark):
    texts = ["Released under the MIT License. " * 3, licenses.TEMPLATES["BSD-3-Clause"] + prose(10) + " " + licenses.TEMPLATES["GPL-2.0"], licenses.TEMPLATES["GPL-2.0"][:3000]]
    got = licenses.scan_licenses(frame(spark, texts)).orderBy("doc_id", "start_word").collect()
    assert [(r.license, r.start_word, r.end_word) for r in got if r.doc_id == 0] == [("MIT-notice", 5 * i, 5 * i + 5) for i in range(3)]
    assert [r.license for r in got if r.doc_id == 1] == ["BSD-3-Clause", "GPL-2.0"] and not [r for r in got if r.doc_id == 2 and r.license == "GPL-2.0"]


def test_licenses_against_whole_alignment(spark):
    # every template against every text without fingerprints or band
    templates = {f"t{i}": prose(n) for i, n in enumerate((12, 25, 40, 60))}
    texts = []
    for i in range(60):
        words = [rng.choice(VOCABULARY) if rng.random() < 0.08 else w for w in templates[f"t{i % 4}"].split() if rng.random() > 0.06]
        texts.append(f"{prose(rng.randint(0, 30))} {' '.join(words)} {prose(rng.randint(0, 30))}")
    texts += [prose(80) for _ in range(10)]
    want = set()
    for d, t in enumerate(texts):
        w = K.hash_words(t).tolist()
        for name, x in templates.items():
            x = K.hash_words(x).tolist()
            n, _, _ = licenses.align(x, w, 0, len(w) + len(x))
            if n >= 0.8 * len(x):
                want.add((d, name, n))
    got = {(r.doc_id, r.license, r.matched) for r in licenses.scan_licenses(frame(spark, texts), templates).collect()}
    assert len(want) > 40 and len(got & want) >= 0.95 * len(want) and {x[:2] for x in got} <= {x[:2] for x in want}


def test_warc_ranges(spark, tmp_path):
    bodies = [bytes(rng.randrange(256) for _ in range(rng.randint(0, 3000))) + warc.MAGIC * 3 for _ in range(40)] + [b"", b"x" * 300_000]
    path = str(tmp_path / "a.warc.gz")
    with open(path, "wb") as f:
        for i, b in enumerate(bodies):
            f.write(gzip.compress(warc.record(f"http://h/{i}", str(i), b), 0 if i % 3 else 6))
    for split in (700, 10_000, 1 << 30):
        got = {r.record_id: bytes(r.payload) for r in warc.read_warc(spark, [path], split_bytes=split).collect()}
        assert got == {str(i): b for i, b in enumerate(bodies)}
        assert warc.read_warc(spark, [path], split_bytes=split).count() == len(bodies)


@pytest.mark.parametrize("level", [0, 6, 9])
def test_warc_nested_archives(spark, tmp_path, level):
    noise = lambda n: bytes(rng.randrange(256) for _ in range(n))
    inner = [noise(20_000) + b"".join(gzip.compress(warc.record(f"http://in/{i}/{j}", f"in{i}-{j}", noise(900)), level) for j in range(20)) + noise(3_000) for i in range(5)]
    path = str(tmp_path / "n.warc.gz")
    with open(path, "wb") as f:
        for i, b in enumerate(inner):
            f.write(gzip.compress(warc.record(f"http://h/{i}", str(i), b), level))
    for split in (1 << 30, 50_000, 7_000, 1_000):
        got = [(r.record_id, bytes(r.payload)) for r in warc.read_warc(spark, [path], split_bytes=split).orderBy("offset").collect()]
        assert got == [(str(i), b) for i, b in enumerate(inner)]


def test_warc_damage_is_read_alike(spark, tmp_path):
    raw = [gzip.compress(warc.record(f"http://h/{i}", str(i), bytes(rng.randrange(256) for _ in range(2_000)))) for i in range(30)]
    raw[7], raw[19] = raw[7][:900] + b"\0" * 300 + raw[7][1200:], raw[19][:500]
    path = str(tmp_path / "d.warc.gz")
    with open(path, "wb") as f:
        f.write(b"".join(raw))
    got = [sorted(r.record_id for r in warc.read_warc(spark, [path], split_bytes=n).collect()) for n in (1 << 30, 9_000, 1_100)]
    assert got[0] == got[1] == got[2] == sorted(str(i) for i in range(30) if i not in (7, 19))


def test_warc_pages(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>é</p>"), (1, "http://a", "<p>é</p>"), (2, None, None), (None, "http://b", "")], "page_id long, url string, html string").withColumn("path", F.lit("x"))
    got = sorted(((r.page_id or 0), r.url, r.n_chars) for r in warc.pages_by_warc(pages).collect())
    assert got == [(0, "http://b", 0), (1, "http://a", 8), (1, "http://a", 8), (2, "", 0)]
    assert warc.pages_by_warc(pages.limit(0)).count() == 0


def test_substring(spark, edges):
    passages = [prose(70) for _ in range(6)]
    texts = [prose(rng.randint(0, 90)) + " " + passages[i % 6] + " " + prose(rng.randint(0, 90)) for i in range(24)] + [prose(150) for _ in range(30)]
    got = substring.repeated_passages(frame(spark, texts)).collect()
    assert len({r.doc_id for r in got if r.doc_id < 24}) >= 22 and all(r.doc_id < 24 for r in got)
    # a paragraph at a passage's edge may be cut alike in later documents only
    assert np.mean([r.doc_id < 6 for r in got if r.keep]) > 0.7
    cut = {r.doc_id: r.text for r in substring.drop_passages(frame(spark, texts)).collect()}
    assert all(cut[i] == texts[i] for i in range(24, 54)) and sum(len(cut[i]) < len(texts[i]) for i in range(6, 24)) >= 16
    assert substring.repeated_passages(edges).where("doc_id <> 6").count() == 0 and substring.repeated_passages(edges.limit(0)).count() == 0


def test_substring_against_brute_force(spark):
    # words of runs of 52 that an earlier text has must go, words without a run of 8 in another text must stay
    passages = [prose(rng.randint(60, 120)) for _ in range(8)]
    texts = [" ".join([prose(rng.randint(0, 90)), *rng.sample(passages, rng.randint(0, 2)), prose(rng.randint(20, 90))]) for _ in range(60)]
    words = [K.slow_words(t) for t in texts]

    def runs(n):
        seen = {}
        for d, w in enumerate(words):
            for i in range(len(w) - n + 1):
                seen.setdefault(tuple(w[i : i + n]), set()).add(d)
        return seen

    must, may = set(), set()
    for n, out in ((52, must), (8, may)):
        seen = runs(n)
        for d, w in enumerate(words):
            for i in range(len(w) - n + 1):
                if min(seen[tuple(w[i : i + n])]) < d or n == 8 and len(seen[tuple(w[i : i + n])]) > 1:
                    out.update((d, j) for j in range(i, i + n))
    gone = {(r.doc_id, j) for r in substring.repeated_passages(frame(spark, texts)).where("not keep").collect() for j in range(r.start_word, r.end_word)}
    assert len(gone & must) >= 0.97 * len(must) > 1000 and len(gone - may) <= 0.02 * len(gone)


def test_fingerprints(spark, edges):
    texts = ["a\nb\nb", "b\na\nb", "a\nb", " a \n\nb\nb", None, ""]
    r = fingerprint.fingerprints(frame(spark, texts)).orderBy("doc_id").collect()
    f = [x.fingerprint for x in r]
    assert f[0] == f[1] == f[3] != f[2] and f[4] == f[5] and [x.n_paragraphs for x in r] == [3, 3, 2, 3, 0, 0]
    s = fingerprint.fingerprints(frame(spark, ["a\nb\nb", "a\nc"]))
    moved = s.select("doc_id", fingerprint.change(F.col("state"), F.array(F.lit("c")), F.array(F.lit("b"))).alias("s")).orderBy("doc_id").first()
    assert bytes(moved.s) == fingerprint.lanes([b"a", b"b", b"c"]).astype(">u4").tobytes()
    assert fingerprint.fingerprints(edges).count() == edges.count() and fingerprint.fingerprints(edges.limit(0)).count() == 0


def test_pii(spark, edges):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "4111111111111112"]
    texts = [f"{prose(20)} {c} {prose(5)}" for c in cards] + [f'{prose(9)} mail a.b@c.example.org, or +1 (555) 555-0100. token = "{"ab12" * 8}" {prose(4)}', "Version 2.0 of 3", f"{prose(5)} 10.20.30.40### {prose(3)} password=9855ae4fa49702326c"]
    texts += ["release 1.2.3.4", "order 1234567890123456", f"token = {'ab1' * 140}", '{"to":"x@y.org","cc":["mailto:z@y.org"]}', "1,q@w.com,r@w.com,192.168.0.1", "联系" * 200 + "邮箱k@l.cn谢谢", "call +1 (843) 555-7672 170.106.47.218 now"]
    got = {(r.doc_id, r.entity): (r.kind, r.seed) for r in pii.identifiers(frame(spark, texts)).collect()}
    assert got[0, cards[0]] == ("card", True) and (3, cards[3]) not in got and not {k for k in got if k[0] in (7, 8)}
    assert {k[1] for k in got if k[0] == 4} == {"a.b@c.example.org", "+1 (555) 555-0100", "ab12" * 8}
    assert not [k for k in got if k[0] == 5] and {k[1] for k in got if k[0] == 6} == {"10.20.30.40", "9855ae4fa49702326c"}
    assert [{k[1] for k in got if k[0] == d} for d in range(9, 14)] == [{"ab1" * 140}, {"x@y.org", "z@y.org"}, {"q@w.com", "r@w.com", "192.168.0.1"}, {"k@l.cn"}, {"+1 (843) 555-7672", "170.106.47.218"}]
    assert pii.identifiers(edges).count() == 0 and pii.identifiers(edges.limit(0)).count() == 0


def test_pii_contexts(spark):
    # no recogniser knows the odd numbers; the words before or after tell them
    texts = [f"{prose(9)} call me on +1 555 555 010{i} {prose(5)}" for i in range(6)] + [f"{prose(9)} call me on +44 20 79460 999 {prose(5)}"]
    texts += [f"{prose(9)} +1 555 555 011{i} belongs to {prose(5)}" for i in range(6)] + [f"{prose(9)} +44 20 79460 998 belongs to {prose(5)}"]
    texts += [f"{prose(9)} +44 20 79460 997 {prose(5)}"]
    # nor what has no digits; a context that words follow at will tells nothing
    texts += [f"{prose(9)} my login is {x} {prose(5)}" for x in (*(f"{c}@b.org" for c in "acegijpq"), "hunterhunter", "Jane Roe")]
    texts += [f"{prose(9)} ask it of {x} {prose(5)}" for x in (*(f"{c}@d.org" for c in "klmnorst"), *VOCABULARY[:20])]
    got = {(r.doc_id, r.entity, r.kind) for r in pii.identifiers(frame(spark, texts)).where("not seed").collect()}
    assert got == {(6, "+44 20 79460 999", "phone"), (13, "+44 20 79460 998", "phone"), (23, "hunterhunter", "email"), (24, "Jane Roe", "email")}


def slow_scores(occurrences, seeds, prior=1.0, accept=0.7, least=3):
    """The same balance with dictionaries: accepted patterns of (instance, pattern) pairs."""
    of, has = {}, {}
    for i, p in occurrences:
        of.setdefault(p, set()).add(i)
        has.setdefault(i, set()).add(p)
    c, taken = {i: float(i in seeds) for i in has}, {}
    for _ in range(200):
        score = {p: sum(c[i] for i in x) / (len(x) + prior) for p, x in of.items()}
        taken = {p: s for p, s in score.items() if s >= accept and len(of[p] & seeds) >= least}
        c = {i: 1.0 if i in seeds else 1 - np.prod([1 - taken[p] for p in has[i] if p in taken]) for i in has}
    return {i for i, x in c.items() if x > 0}


def test_pii_scores_against_brute_force(spark):
    for _ in range(3):
        seeds = set(range(40))
        pairs = {(rng.randint(0, 79), rng.randint(100, 130)) for _ in range(250)} | {(i, 131 + i // 20) for i in range(60)}
        rows = [(i, p, "card" if i in seeds else None, 0, None) for i, p in pairs]
        graph = spark.createDataFrame(rows, "instance long, pattern long, seed string, tokens int, context long")
        assert {r.instance for r in pii._scored(graph, 1.0, 0.7, 3).where("c > 0").collect()} == slow_scores(pairs, seeds)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    texts = [prose(60) for _ in range(80)]
    texts += texts[:5] + [texts[6] + " more"]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, " ".join(texts[9].split()[5:40]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {d for r in corpus_pipeline.run(spark, str(tmp_path)).collect() for d in r.doc_ids}
    assert got == set(range(80)) - {9}


def test_pipeline_packs_by_the_neighbours_of_all_pairs(spark, monkeypatch):
    import corpus_pipeline

    # phrases of three words that more texts hold than give all their pairs, in other sets each
    own, graph, seen = random.Random(3), packing.neighbour_graph, []
    sets = [frozenset(own.sample(range(40), 6)) for _ in range(700)]
    texts = [" ".join(f"a{p} b{p} c{p} own{i}x{p}" for p in own.sample(sorted(x), 6)) for i, x in enumerate(sets)]

    def kept(rows, **params):
        seen.append((rows, graph(rows, **params)))
        return seen[-1][1]

    monkeypatch.setattr(packing, "neighbour_graph", kept)
    windows = corpus_pipeline.packing(spark, frame(spark, texts), "").collect()
    assert {d for r in windows for d in r.doc_ids} == set(range(len(texts)))
    ((rows, edges),) = seen
    doc, got = {r.row: r.doc_id for r in rows.select("row", "doc_id").collect()}, {}
    for r in edges.collect():
        assert r.weight == len(sets[doc[r.a]] & sets[doc[r.b]])
        got.setdefault(doc[r.a], []).append(r.weight)
    for i, x in enumerate(sets):
        want = sorted((len(x & y) for j, y in enumerate(sets) if j != i), reverse=True)[:6]
        assert sorted(got[i], reverse=True)[:6] == want
