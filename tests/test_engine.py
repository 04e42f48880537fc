import duckdb
import pytest
from pyspark.sql import functions as F

from loam import config
from loam.collection import Collection, collections, format_hits
from loam.functions import text as T
from loam.functions.stemmer import stem
from loam.functions.vectors import checked
from loam.operators import dedup as D
from loam.operators import keyword as KW
from loam.operators import search as S
from loam.operators.chunking import Splitter, chunks, separators_for
from loam.plans.catalog import QUERIES, SQL
from loam.sources import html as H
from loam.sources import loaders as L


def one(spark, col):
    return spark.range(1).select(col).first()[0]


def test_splitter():
    assert Splitter(7, 3, [" "]).split("foo bar baz 123") == ["foo bar", "bar baz", "baz 123"]
    assert Splitter(1000, 100).split("") == []
    assert Splitter(1000, 100).split("Small text") == ["Small text"]
    md = "# Title\n\nSome words on it.\n\n## Section\n\nMore words that follow here."
    got = Splitter(50, 0, separators_for("MD")).split(md)
    assert any("# Title" in c for c in got) and any("## Section" in c for c in got)
    with pytest.raises(ValueError):
        Splitter(10, 10)


def test_tokens(spark):
    got = one(spark, T.tokens(F.lit("The quick brown foxes, running! a")))
    assert "the" not in got and {"quick", "brown", "fox", "run"} <= set(got)
    assert one(spark, T.tokens(F.lit("机器学习"))) == ["机", "机器", "器", "器学", "学", "学习", "习"]
    assert {"python", "编", "编程"} <= set(one(spark, T.tokens(F.lit("Python编程编程编程编程"))))
    assert one(spark, T.script(F.lit("Hello 世"))) == "latin" and one(spark, T.script(F.lit("机器学习ok"))) == "cjk"
    assert one(spark, T.script(F.lit("机器学习abcd"))) == "latin"
    assert [stem(w) for w in ("caresses", "ponies", "hopping", "relational", "happily", "sky", "agreed")] == ["caress", "poni", "hop", "relat", "happili", "sky", "agre"]


@pytest.mark.parametrize("q,kind", [("Wo wird Goethe erwähnt?", "entity"), ("WHO IS Ada?", "entity"), ("how does it work", "semantic"), ("similar ideas", "semantic"), ("quarterly report", "balanced")])
def test_query_type(spark, q, kind):
    assert one(spark, T.query_type(F.lit(q))) == kind


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "the quick brown fox"), (1, "a lazy dog"), (2, "python snakes"), (3, "")], "id int, text string")
    index = KW.build(docs, "id", T.tokens(F.col("text")))
    got = KW.search(index, ["quick", "fox"], 2).orderBy("rank").collect()
    assert [r.id for r in got] == [0, 1]
    assert [r.id for r in KW.search(index, ["fox"], 3, match_only=True).collect()] == [0]
    assert [r.id for r in KW.search(index, ["fox"], 2, variant="okapi").collect()] == [0]
    assert KW.search(index, [], 3).count() == 0 and KW.search(index, ["nothing"], 3).count() == 0
    with pytest.raises(ValueError):
        KW.search(index, ["fox"], 2, variant="other")


def ranked(spark, ids):
    return spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id int, rank int")


def test_rrf(spark):
    a, b = ranked(spark, [1, 2, 3]), ranked(spark, [3, 2, 1])
    assert S.rrf([a, b], [0.9, 0.1], k=3).orderBy("rank").first().id == 1
    assert [r.id for r in S.rrf([a, b], [0, 0]).orderBy("rank").collect()] == [1, 2, 3]
    for bad, err in (([1.0], ValueError), ([-1, 1], ValueError), (["x", 1], TypeError)):
        with pytest.raises(err):
            S.rrf([a, b], bad)


def test_mmr():
    v = [[1, 0], [0.99, 0.1], [0, 1]]
    assert S.mmr_order([0.9, 0.89, 0.5], v, balance=1.0) == [0, 1, 2]
    assert S.mmr_order([0.9, 0.89, 0.5], v, balance=0.3) == [0, 2, 1]
    with pytest.raises(ValueError):
        S.mmr_order([1.0], v)


def test_vectors(spark):
    assert checked([[1, 2]]) == [1.0, 2.0]
    for bad in ("abc", [], 5, ["a"]):
        with pytest.raises(ValueError):
            checked(bad)


def test_dedup(spark):
    assert D.lsh_parameters(0.8, 128) == (9, 13) and D.lsh_parameters(0.5, 64) == (14, 4)
    s = "the quick brown fox jumps over the lazy dog"
    rows = spark.createDataFrame([(0, s), (1, s), (2, s + " today"), (3, "something else that has no words in common")], "ord int, text string")
    got = {r.ord: (r.exact_dup, r.near_dup) for r in D.dedup(rows, "text", "ord", threshold=0.5).collect()}
    assert got == {0: (False, False), 1: (True, False), 2: (False, True), 3: (False, False)}


def test_html_and_crawl(spark):
    page = "<html><nav><a href='/x'>n</a></nav><p>One <b>two</b></p><script>no()</script><a href='b.html#f?q'>l</a><footer>f</footer></html>"
    assert H.read(page).parts == ["One", "two", "l"]
    pages = spark.createDataFrame([("http://h/a/", "<a href='b'>1</a><a href='/c'>out</a>"), ("http://h/a/b", "<a href='d'>2</a>"), ("http://h/a/d", "end"), ("http://h/c", "no")], "url string, html string")
    got = H.crawl(pages, spark.createDataFrame([("http://h/a/**",)], "url string"))
    assert {(r.url, r.depth) for r in got.collect()} == {("http://h/a/", 0), ("http://h/a/b", 1), ("http://h/a/d", 2)}
    assert H.normalise("../index.html?x#y", "http://h/a/b/c") == "http://h/a/"


def test_loaders(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "b.txt").write_text("plain")
    got = sorted(r.content for r in L.read_text(spark, str(tmp_path)).collect())
    assert got == ["plain", "é"]
    (tmp_path / "c.bin").write_bytes(b"a\0b")
    with pytest.raises(Exception):
        L.read_text(spark, str(tmp_path / "c.bin")).collect()
    raw = spark.createDataFrame([("p", '[{"path":"x","contents":"1"},{"filename":"y","content":"2"},{"path":"z"}]'), ("q", "no json")], "path string, content string")
    assert sorted(tuple(r) for r in L.fan_out(raw).collect()) == [("p/x", "1"), ("p/y", "2"), ("q", "no json")]
    assert L.kind("http://h/**", {}) == "crawl" and L.kind("http://h", {}) == "url" and L.kind("git:x", {"git": ""}) == "protocol"
    assert L.run_command("cat $1", str(tmp_path / "b.txt")) == "plain"


def test_config(tmp_path):
    s = config.Settings()
    assert s.candidates(5) == 50 and s.candidates(1) == 20 and s.candidates(20) == 100 and s.rerank_length() == 282
    for bad in ({"chunk_overlap": 1000}, {"near_dedup_threshold": 0.0}, {"near_dedup_num_perm": 8}, {"bm25_algorithm": "x"}, {"rrf_k": 0}, {"top_k": True}):
        with pytest.raises(ValueError):
            s.with_(**bad)
    config.save(s.with_(top_k=7), tmp_path / "c.yaml")
    assert config.load(tmp_path / "c.yaml").top_k == 7 and config.load(tmp_path / "none.yaml") == s
    for bad in ("", "../x", ".a", "a b"):
        with pytest.raises(ValueError):
            config.checked_name(bad)


def test_collection(spark, tmp_path):
    def embed(text):
        return F.array(*(F.length(F.regexp_replace(text, f"[^{c}]", "")).cast("double") for c in "aeiou"))

    c = Collection(spark, str(tmp_path), "notes", config.Settings(search_mode="keyword"), embed)
    docs = spark.createDataFrame([("a/x.txt", "the quick brown fox"), ("a/y.txt", "python and its snakes"), ("a/z.txt", "the quick brown fox"), ("a/e.txt", " ")], "path string, content string")
    got = {r.path: (r.status, r.reason) for r in c.add(docs).collect()}
    assert got == {"a/x.txt": ("success", None), "a/y.txt": ("success", None), "a/z.txt": ("skipped", "duplicate"), "a/e.txt": ("skipped", "empty content")}
    assert c.add(docs).where("status = 'success'").count() == 0
    assert c.stats() == {"name": "notes", "chunks": 2, "documents": 2} and collections(spark, str(tmp_path)) == ["notes"] and c.check_ids()
    assert c.search("fox", top_k=1).first().source == "a/x.txt"
    assert c.search("snakes", mode="hybrid").first().source == "a/y.txt"
    assert c.search("fox", filters={"source": "a/y.txt"}).count() == 1 and c.search("fox", filters={"chunk_index": "0"}).count() == 0
    assert "[Document 1 - a/x.txt]" in format_hits(c.search("fox", top_k=1)).first().text
    with pytest.raises(ValueError):
        c.search("  ")
    c.delete(F.col("source") == "a/x.txt")
    assert c.documents() == ["a/y.txt"]
    c.delete()
    assert not c.exists()


def test_pages_of_one_address_count_once(spark, tmp_path):
    pages = [("http://h.org/a?x=1", "<a href='b'>1</a>"), ("http://h.org/a?x=2", "2"), ("http://h.org/b", "3"), ("http://h.org/b", "3")]
    spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in QUERIES["crawl_frontier"](spark, str(tmp_path)).where("url like 'http://h.org%'").collect())
    assert got == [("http://h.org/a", 0), ("http://h.org/b", 0)]


def test_references_without_a_semicolon_stay():
    assert H.read("<title>a&amp;&amp</title><p>&lt;b&gt; &amp;lt; R&D &ampx; &eacute;&#39;</p>").parts == ["a&&amp", "<b> &lt; R&D &ampx; é'"]
    assert H.read("<a href='/x?a=1&copy=2&amp;b=3'>l</a>").hrefs == ["/x?a=1&copy=2&b=3"]


def test_minhash_of_odd_texts_as_in_sql(spark, tmp_path):
    texts = ["", " \n", None, "One", "İstanbul ΟΔΟΣ a b", "a\vb c d e", "a\u00a0b c d", "the quick brown fox " * 900]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("minhash_signature", "near_dedup_verdict"):
        got = sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted(con.execute(SQL[name]).fetchall()), name


def shuffled(spark, run):
    """Bytes that run() shuffles."""
    sc = spark.sparkContext
    jvm, bus = sc._jvm, sc._jsc.sc().listenerBus()

    def total():
        bus.waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_an_addition_shuffles_texts_twice_at_most(spark, tmp_path):
    rows = spark.range(0, 400, 1, 4).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.concat_ws(" ", *(F.sha2(F.concat("id", F.lit(f"-{i}")), 256) for i in range(40))).alias("content"))
    rows.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    c = Collection(spark, str(tmp_path), "few", config.Settings(chunk_size=1 << 30, near_dedup_enabled=False, search_mode="keyword", bm25_language="none", bm25_stemmed=False))
    assert shuffled(spark, lambda: c.add(docs)) < 2.6 * 400 * 40 * 65 and c.rows().count() == 400


def test_postings_are_shuffled_by_term_once(spark, tmp_path):
    docs = spark.range(0, 20_000, 1, 2).select("id", F.concat_ws(" ", *(F.concat(F.lit("w"), (F.col("id") * (i + 1) % 50).cast("string")) for i in range(20))).alias("text"))
    docs.write.parquet(f"{tmp_path}/docs")
    index = KW.build(spark.read.parquet(f"{tmp_path}/docs"), "id", T.words(F.col("text")))
    assert shuffled(spark, lambda: KW.store(index, f"{tmp_path}/index")) < 1_500_000
    got = KW.stored(spark, f"{tmp_path}/index")
    assert got.postings.exceptAll(index.postings).isEmpty() and index.postings.exceptAll(got.postings).isEmpty()
    assert got.postings.agg(F.sum("tf")).first()[0] == 400_000 and {r.dl for r in got.postings.select("dl").distinct().collect()} == {20}


def test_neighbours_of_every_vector_with_ties(spark):
    base = [[0.1, 0.7, 0.3], [0.3, 0.2, 0.9], [0.0, 0.0, 0.0]]
    rows = spark.createDataFrame([(i, [x * (7 - i % 7) / 3 for x in base[i % 3]]) for i in range(60)], "vec_id int, embedding array<double>").repartition(3)
    queries = rows.where("vec_id % 20 = 1").select(F.col("vec_id").alias("qid"), "embedding")
    got = S.knn_all(rows, "vec_id", "embedding", queries, 5, per_pass=2).orderBy("qid", "rank").collect()
    assert [(r.qid, r.id) for r in got] == [(q, i) for q in (1, 21, 41) for i in ([j for j in range(60) if j % 3 == q % 3][:5] if q != 41 else range(5))]


def test_many_queries_by_matrix_and_by_joins(spark, monkeypatch):
    docs = spark.range(0, 300, 1, 3).select("id", F.concat_ws(" ", *(F.concat(F.lit("w"), (F.col("id") * (i + 3) % 97).cast("string")) for i in range(12))).alias("text")).union(spark.createDataFrame([(300, "")], "id long, text string"))
    queries = spark.createDataFrame([(q, [f"w{(q * 7 + i) % 110}" for i in range(9)] + ["w1"]) for q in range(40)] + [(99, ["none"])], "qid int, terms array<string>")
    for options in ({}, {"match_only": True}, {"variant": "okapi"}):
        both = []
        for limit in (1 << 20, 0):
            monkeypatch.setattr(KW, "MATRIX", limit)
            r = KW.search_all(KW.build(docs, "id", T.words(F.col("text"))), queries, 7, **options)
            both.append(sorted((x.qid, x.rank, x.id, round(x.score, 9)) for x in r.collect()))
        assert both[0] == both[1] and both[0]


def test_chunks_of_many_rows(spark):
    texts = [None if i % 50 == 0 else f"line {i}\n\nmore of it {i}" for i in range(700)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", chunks(F.col("t"), size=12, overlap=0).alias("c")).collect()
    assert all(r.c == (None if texts[r.i] is None else Splitter(12, 0).split(texts[r.i])) for r in got) and len(got) == 700


def test_corpus_stats_reads_documents_once(spark, tmp_path):
    spark.createDataFrame([(0, "a bb bb cc"), (1, ""), (2, "bb dd"), (3, None)], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["corpus_stats"](spark, str(tmp_path))
    assert tuple(got.first()) == (4, 1.25, 3, 4) and got._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert tuple(KW.build(spark.createDataFrame([], "id int, text string"), "id", T.words(F.col("text"))).summary().first()) == (0, 0.0, 0, 0)
