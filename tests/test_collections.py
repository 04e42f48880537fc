import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam import cli, config
from loam import collection as C
from loam.operators import dedup as D
from loam.operators import embedding as E
from loam.operators import keyword as KW
from loam.operators import search as S
from loam.shared import numbered
from loam.sources import loaders as L
from loam.streaming.ingest import file_stream, ingest_stream

SETTINGS = config.Settings(search_mode="keyword")


def docs(spark, *rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_ids_stay_apart(spark, tmp_path):
    c = C.Collection(spark, str(tmp_path), "one", SETTINGS)
    for i, text in enumerate(("five apples", "six red pears", "seven plums of ours")):
        c.add(docs(spark, (f"{i}.txt", text)))
        assert c.check_ids()
    assert sorted(r.bm25_id for r in c.rows().collect()) == [0, 1, 2]
    assert c.search("pears", top_k=1).first().source == "1.txt"


def test_refresh_keeps_every_chunk(spark, tmp_path):
    s = SETTINGS.with_(chunk_size=30, chunk_overlap=0)
    c = C.Collection(spark, str(tmp_path), "again", s)
    text = "\n\n".join(["the same words every time"] * 3)
    c.add(docs(spark, ("a.txt", text)))
    assert c.stats()["chunks"] == 1
    got = c.add(docs(spark, ("a.txt", text)), refresh=True).first()
    assert (got.status, got.chunks) == ("success", 3) and c.stats()["chunks"] == 3 and c.check_ids()
    c.add(docs(spark, ("a.txt", "new words altogether")), refresh=True, replace_by="source")
    assert [r.text for r in c.rows().collect()] == ["new words altogether"]


def test_writers_conflict(spark, tmp_path):
    a, b = (C.Collection(spark, str(tmp_path), "two", SETTINGS) for _ in range(2))
    a.add(docs(spark, ("a", "first text")))
    version, manifest = b._manifest()
    a.add(docs(spark, ("b", "second text that differs")))
    with pytest.raises(C.Conflict):
        b._commit(version + 1, manifest)
    assert a.stats()["chunks"] == 2 and b.stats()["chunks"] == 2
    before = len(list((tmp_path / "two" / "data").iterdir()))
    a.delete(F.col("source") == "a")
    a.vacuum()
    assert before == 2 and len(list((tmp_path / "two" / "data").iterdir())) == 1 and a.documents() == ["b"]
    # a manifest that a lost writer left half written isn't read
    (tmp_path / "two" / "manifest-00000009.json").write_text('{"parts": [')
    assert a.documents() == ["b"]


def test_near_duplicates_of_stored_ones(spark, tmp_path):
    c = C.Collection(spark, str(tmp_path), "near", SETTINGS.with_(near_dedup_threshold=0.5))
    text = "the quick brown fox jumps over the lazy dog and runs through the dark forest until the morning comes"
    c.add(docs(spark, ("a", text)))
    assert c.add(docs(spark, ("b", text + " again"))).first().reason == "duplicate"


def test_models_and_vectors_must_fit(spark, tmp_path):
    def embed(n):
        return E.embedder(lambda texts: [[float(len(t))] * n for t in texts])

    c = C.Collection(spark, str(tmp_path), "v", SETTINGS, embed(3), "m1")
    c.add(docs(spark, ("a", "some text")))
    with pytest.raises(ValueError):
        C.Collection(spark, str(tmp_path), "v", SETTINGS, embed(3), "m2")
    with pytest.raises(ValueError):
        C.Collection(spark, str(tmp_path), "v", SETTINGS, embed(4), "m1").add(docs(spark, ("b", "another text of ours")))
    with pytest.raises(ValueError):
        C.Collection(spark, str(tmp_path), "w", SETTINGS.with_(max_memory_mb=0.001), embed(3)).add(docs(spark, ("b", "another text of ours")))


def test_embedding_tries(spark):
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) < 3 or (len(texts) > 1 and "bad" in texts):
            raise OSError("busy")
        return [[1.0] for _ in texts]

    assert E.embed_texts(flaky, ["a", "b"], batch=2, wait=0) == [[1.0], [1.0]] and calls == [2, 2, 2]
    assert len(E.embed_texts(flaky, ["a", "bad", "c"], batch=2, wait=0)) == 3
    with pytest.raises(RuntimeError):
        E.embed_texts(lambda texts: [], ["a"], batch=1, wait=0)
    got = spark.createDataFrame([("ab",), (None,)], "t string").select(E.embedder(lambda t: [[len(x)] for x in t])(F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == [[2.0], None]


def test_register(spark):
    r = D.Register(spark, threshold=0.5, num_perm=64)
    text = "the quick brown fox jumps over the lazy dog"
    assert r.check_and_add(text) == (False, "nd_1") and r.size == 1
    assert r.check_and_add(text, "mine") == (True, "mine") and r.add("other words", "mine") == "mine" and r.size == 2
    other = D.Register(spark, threshold=0.5, num_perm=64)
    other.load(r.rows)
    assert other.is_near(text) and other.size == 2 and not other.is_near("nothing like that at all in here")
    r.clear()
    assert r.size == 0 and not r.is_near(text)


def test_numbers(spark):
    rows = spark.createDataFrame([(i * 7 % 50, None if i % 3 else i) for i in range(50)], "k long, bm25_id long")
    got = numbered(rows, "k", name="n", start=5).collect()
    assert sorted((r.k, r.n) for r in got) == [(i, i + 5) for i in range(50)]
    filled = C.fill_ids(rows, "k").collect()
    assert sorted(r.bm25_id for r in filled) == list(range(50)) and {(r.k, r.bm25_id) for r in rows.collect() if r.bm25_id is not None} <= {(r.k, r.bm25_id) for r in filled}


def test_stored_postings_give_the_same(spark, tmp_path):
    texts = [(i, " ".join(f"w{(i * j) % 17}" for j in range(1, 30))) for i in range(80)]
    index = KW.build(spark.createDataFrame(texts, "id long, text string"), "id", F.split("text", " "))
    KW.store(index, str(tmp_path / "p"))
    kept = KW.stored(spark, str(tmp_path / "p"))
    queries = spark.createDataFrame([(q, [f"w{q}", "w3", "w3", "none"]) for q in range(9)] + [(9, ["none"]), (10, [f"w{i}" for i in range(17)] * 30 + [f"x{i}" for i in range(99)])], "qid long, terms array<string>")
    for options in ({}, {"match_only": True}, {"variant": "okapi"}):
        a, b = ({(r.qid, r.rank): (r.id, round(r.score, 9)) for r in KW.search_all(i, queries, 90, **options).collect()} for i in (index, kept))
        assert a == b and (a or "variant" in options)
    few = KW.search_all(index, queries.where("qid < 3"), 5).collect()
    assert sorted((r.qid, r["rank"]) for r in few) == [(q, r) for q in range(3) for r in range(1, 6)]


def test_padding_in_order_of_id(spark):
    index = KW.build(spark.createDataFrame([(i, "fox" if i == 7 else "dog") for i in range(10)], "id long, text string"), "id", F.split("text", " "))
    assert [r.id for r in KW.search(index, ["fox"], 5).orderBy("rank").collect()] == [7, 0, 1, 2, 3]


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 5))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, e array<double>")
    q = table.where("id % 20 = 0").selectExpr("id as qid", "e as embedding")
    got = {(r.qid, r["rank"]): r.id for r in S.knn_all(table, "id", "e", q, 4, per_pass=2).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in (0, 20, 40):
        assert [got[i, r] for r in range(1, 5)] == np.argsort(-(unit @ unit[i]))[:4].tolist()
        near = S.knn(table, "id", "e", v[i].tolist(), 4, distance="l2").orderBy("rank").collect()
        assert [r.id for r in near] == np.argsort(((v - v[i]) ** 2).sum(1))[:4].tolist()
        assert S.knn(table, "id", "e", v[i].tolist(), 1, distance="ip").first().id == int(np.argmax(v @ v[i]))
    with pytest.raises(ValueError):
        S.knn(table, "id", "e", v[0].tolist(), 1, distance="other")
    made = []
    assert S.ranker(lambda *a: made.append(a) or object(), "m", 128) is S.ranker(lambda *a: made.append(a) or object(), "m", 128) and made == [("m", 128)]


def test_rerank_and_hybrid_order(spark):
    hits = spark.createDataFrame([(1, "red fox", 1), (2, "the quick fox", 2), (3, "nothing", 3)], "id int, text string, rank int")
    got = S.rerank(hits, "text", S.overlap_score("quick fox"), 2).orderBy("rank").collect()
    assert [(r.id, r["rank"]) for r in got] == [(2, 1), (1, 2)]


def test_loaders_and_filters(spark, tmp_path):
    s = SETTINGS.with_loader("csv", "cat $1").without_loader("pdf").without_loader("none")
    assert s.document_loaders["csv"] == "cat $1" and "pdf" not in s.document_loaders and {"odt", "rtf", "epub", "rst", "org"} <= set(s.document_loaders)
    assert L.dependencies({"a": "cat $1", "b": "no-such-program $1"}) == {"cat": True, "no-such-program": False}
    assert list(L.missing_programs({"a": "cat $1", "b": "no-such-program $1"})) == ["b"]
    (tmp_path / "x.csv").write_text("1,2")
    (tmp_path / "y.txt").write_text("plain")
    got = L.load_multi(spark, [str(tmp_path / "x.csv"), str(tmp_path / "y.txt")], s.document_loaders).collect()
    assert sorted(r.content for r in got) == ["1,2", "plain"]
    assert L.concatenated(docs(spark, ("b", "2"), ("a", "1"))).first().content == "=== a ===\n1\n\n=== b ===\n2"
    assert L.concatenated(docs(spark, ("b", "2"))).first().content == "2"
    assert C.parse_filters(["a:b:c", ":x", "y:", "z", "k:v"]) == {"a": "b:c", "k": "v"}
    seen = spark.range(1).select(C.extension(F.lit("a/b.PY")), C.extension(F.lit("http://h/x.md")), C.extension(F.lit("git:x/y.py")), C.extension(F.lit("file:/x/y.md"))).first()
    assert list(seen) == ["py", "", "", "md"]


def test_fetched(spark):
    rows = spark.createDataFrame([("http://h/a", "text/html; charset=utf-8", b"<p>One</p><nav>no</nav>"), ("http://h/b", "text/plain", b"raw <b>"), ("http://h/c.xyz", "application/x", b"as it is")], "url string, content_type string, body binary")
    assert {r.path: r.content for r in L.read_fetched(rows, {"xyz": "cat $1"}).collect()} == {"http://h/a": "One", "http://h/b": "raw <b>", "http://h/c.xyz": "as it is"}


def test_git(spark, tmp_path):
    import subprocess

    repo = tmp_path / "r.git"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init")
    (repo / "a.py").write_text("x = 1")
    (repo / "b.bin").write_bytes(b"\0\1")
    run("add", ".")
    run("commit", "-m", "x")
    got = L.read_git(spark, "file://" + str(repo) if False else str(repo)).collect()
    assert [r.content for r in got] == ["x = 1"]


def test_tool_shell_and_commands(spark, tmp_path):
    (tmp_path / "a.txt").write_text("the quick brown fox " + "x" * 600)
    root, out = str(tmp_path / "root"), []
    assert cli.main(["--root", root, "add", "notes", str(tmp_path / "a.txt")], spark, out.append) == 0 and out[0].startswith("added")
    assert cli.main(["--root", root, "search", "notes", "fox", "-f", "source_contains:a.txt", "-f", "bad"], spark, out.append) == 0 and out[-1].endswith("...")
    assert cli.main(["--root", root, "list"], spark, out.append) == 0 and out[-1] == "notes"
    assert cli.main(["--root", root, "info", "none"], spark, out.append) == 1 and cli.main(["--root", root, "deps"], spark, out.append) == 0
    shell = cli.Shell(spark, root, SETTINGS, out.append)
    lines = iter(["", "search fox", "use notes", "search quick fox", "sources", "documents", "info", "bad 'quote", "nonsense", "list", "rebuild", "quit", "never"])
    shell.loop(lambda _: next(lines))
    assert next(lines) == "never" and any("no collection" in x for x in out) and shell.found and out[-1] == "1 chunks"
    find = C.tool(C.Collection(spark, root, "notes", SETTINGS), top_k=1)
    assert find("fox").startswith("[Document 1 - ") and find(" ").startswith("The search failed")
    assert C.tool(C.Collection(spark, root, "void", SETTINGS))("fox") == "No relevant documents found."
    assert cli.main(["--root", root, "delete", "notes"], spark, out.append) == 1 and cli.main(["--root", root, "delete", "notes", "--yes"], spark, out.append) == 0
    assert not C.Collection(spark, root, "notes").exists()


def test_streaming_ingest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, text in enumerate(("the first text of all", "a second one that is new", "the first text of all")):
        (folder / f"{i}.txt").write_text(text)
    c = C.Collection(spark, str(tmp_path), "live", SETTINGS)

    def drain():
        q = ingest_stream(file_stream(spark, str(folder), per_trigger=1), c, str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()

    drain()
    assert c.stats() == {"name": "live", "chunks": 2, "documents": 2} and c.check_ids()
    (folder / "3.txt").write_text("and something that came later")
    drain()
    assert c.stats()["chunks"] == 3 and len(json.loads((tmp_path / "live" / "manifest-00000004.json").read_text())["parts"]) == 4
