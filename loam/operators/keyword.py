"""BM25 over tokens or stored postings."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loam.operators.search import Best
from loam.shared import broadcast_under, cut

K1, B, DELTA, EPSILON = 1.5, 0.75, 1.0, 0.25
#: As many terms at most are looked for row by row; more are joined
FEW = 64
BUCKETS = 64
#: Bytes of what the queries' terms weigh that every task may hold
MATRIX = 32 << 20


def _batch(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(term, row, terms, tf, lengths) of a batch (id, tokens): of each term of a row its number in terms, in order of terms and rows."""
    tokens = b.column(1)
    dl = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    pairs, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(dl)) + np.repeat(np.arange(len(dl)), dl), return_counts=True)
    return pairs // max(1, len(dl)), pairs % max(1, len(dl)), coded.dictionary, tf, dl


def _blocks(batches):
    for b in batches:
        term, row, terms, tf, dl = _batch(b)
        at = pa.array(np.append(np.searchsorted(term, np.arange(len(terms))), len(term)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, x) for x in (b.column(0).take(pa.array(row)), pa.array(tf.astype(np.int64)), pa.array(dl[row].astype(np.int32)))]
        yield pa.RecordBatch.from_arrays([terms, *lists], ["term", "id", "tf", "dl"])


def _count(batches):
    for b in batches:
        term, _, terms, _, dl = _batch(b)
        df = np.append(np.bincount(term, minlength=len(terms)), 0)
        own = np.zeros(len(df), np.int64)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([terms.cast(pa.string()), pa.nulls(1, pa.string())]), pa.array(df), pa.array(np.append(own[:-1], len(dl))), pa.array(np.append(own[:-1], dl.sum()))], ["term", "df", "n", "dl"])


@dataclass
class Index:
    """Documents as (id, tokens), or their stored postings (bucket, term, id, tf, dl) with (id, dl).

    Words are counted within each batch of documents, so that no token by itself is shuffled."""

    docs: DataFrame | None = None
    stored: DataFrame | None = None
    stored_lengths: DataFrame | None = None

    @functools.cached_property
    def lengths(self) -> DataFrame:
        """(id, dl)."""
        return self.stored_lengths if self.docs is None else self.docs.select("id", F.size("tokens").alias("dl"))

    @functools.cached_property
    def postings(self) -> DataFrame:
        """(term, id, tf, dl)."""
        if self.docs is None:
            return self.stored.select("term", "id", "tf", "dl")
        return self.blocks.select("term", F.inline(F.arrays_zip("id", "tf", "dl")))

    @functools.cached_property
    def blocks(self) -> DataFrame:
        """(term, id, tf, dl): the last three are arrays, a row for each term of some documents."""
        return self.docs.mapInArrow(_blocks, f"term string, id array<{self.docs.schema['id'].dataType.simpleString()}>, tf array<long>, dl array<int>")

    @functools.cached_property
    def terms(self) -> DataFrame:
        """(term, df)."""
        if self.docs is None:
            return self.stored.groupBy("term").agg(F.count("*").alias("df"))
        return self._counted.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))

    @functools.cached_property
    def _counted(self) -> DataFrame:
        """(term, df) of some documents each, and (null, 0, n, dl) of them all."""
        return self.docs.mapInArrow(_count, "term string, df long, n long, dl long")

    def summary(self) -> DataFrame:
        """(n, avgdl, n_terms, n_postings), of one reading of the documents or postings."""
        if self.docs is None:
            return self.terms.agg(F.count("*").alias("n_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("n_postings")).select(F.lit(self.n).cast("long").alias("n"), F.lit(self.avgdl).alias("avgdl"), "n_terms", "n_postings")
        sums = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("df", "n", "dl")}
        each = self._counted.groupBy("term").agg(*(x.alias(c) for c, x in sums.items()))
        avgdl = F.when(sums["n"] > 0, sums["dl"].cast("double") / sums["n"]).otherwise(0.0)
        return each.agg(sums["n"].alias("n"), avgdl.alias("avgdl"), F.count("term").alias("n_terms"), sums["df"].alias("n_postings"))

    @functools.cached_property
    def _stats(self) -> tuple[int, float]:
        n, avgdl = self.lengths.agg(F.count("*"), F.avg("dl")).first()
        return n, avgdl or 0.0

    @property
    def n(self) -> int:
        return self._stats[0]

    @property
    def avgdl(self) -> float:
        return self._stats[1]

    size = n

    def read(self, terms: DataFrame, few: list[str] | None) -> tuple[DataFrame, DataFrame, int, float]:
        """(term, id, tf, dl) of the given terms, (id, dl), n and the mean length; few are the terms on the driver, where there are few.

        Texts are split into words once, or once more for the lengths where terms are many."""
        if self.docs is None:
            return self._matched(terms, few), self.lengths, self.n, self.avgdl
        if few is None:
            return cut(self._matched(terms, few), "hits"), self.lengths, self.n, self.avgdl
        # within each row: nothing is shuffled
        mine = self.docs.select("id", F.size("tokens").alias("dl"), F.filter("tokens", lambda t: t.isin(few)).alias("f"))
        pairs = F.transform(F.array_distinct("f"), lambda t: F.struct(t.alias("term"), F.size(F.filter("f", lambda x: x == t)).cast("long").alias("tf")))
        mine = cut(mine.select("id", "dl", pairs.alias("found")), "found")
        n, avgdl = mine.agg(F.count("*"), F.avg("dl")).first()
        return mine.select("id", "dl", F.inline("found")).select("term", "id", "tf", "dl"), mine.select("id", "dl"), n, avgdl or 0.0

    def _matched(self, terms: DataFrame, few: list[str] | None) -> DataFrame:
        if self.docs is None:
            rows = self.stored.where(F.col("term").isin(few) & F.col("bucket").isin(sorted(_buckets(self.stored, few)))) if few is not None else self.stored.join(terms, "term", "left_semi")
            return rows.select("term", "id", "tf", "dl")
        rows = self.docs.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(terms, "term", "left_semi")
        return rows.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")).select("term", "id", "tf", "dl")


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _buckets(df: DataFrame, terms: list[str]) -> set[int]:
    if not terms:
        return set()
    rows = df.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return {r[0] for r in rows.select(bucket(F.col("term"))).collect()}


def build(docs: DataFrame, id: str, tokens: Column) -> Index:
    """An index of (id, tokens), made as it is read; documents without tokens count in n and in the mean length."""
    return Index(docs.select(F.col(id).alias("id"), F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens")))


def store(index: Index, path: str) -> None:
    """Writes postings by the hash of their term, so that a query reads its terms' folders only, and lengths."""
    rows = index.blocks.withColumn("bucket", bucket(F.col("term")))
    rows.repartition("bucket", F.pmod(F.xxhash64(F.col("id")[0]), F.lit(8))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    index.lengths.write.parquet(f"{path}/lengths")


def stored(spark, path: str) -> Index:
    rows = spark.read.schema("term string, id array<long>, tf array<long>, dl array<int>, bucket int").parquet(f"{path}/postings")
    rows = rows.select("bucket", "term", F.inline(F.arrays_zip("id", "tf", "dl")))
    return Index(None, rows, spark.read.schema("id long, dl int").parquet(f"{path}/lengths"))


def _found(vocabulary: list[str]) -> Callable:
    """Of each document the places of its words in the vocabulary, how often it has them, and its length."""
    words = pa.array(vocabulary, pa.string())

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                tokens = part.column(1)
                dl = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = tokens.flatten().dictionary_encode()
                place = pc.fill_null(pc.index_in(coded.dictionary.cast(pa.string()), words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                code, row = place[coded.indices.to_numpy(zero_copy_only=False)], np.repeat(np.arange(len(dl)), dl)
                pairs, tf = np.unique((row * max(1, len(words)) + code)[code >= 0], return_counts=True)
                at = pa.array(np.append(0, np.cumsum(np.bincount(pairs // max(1, len(words)), minlength=len(dl)))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (pairs % max(1, len(words)), tf)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(dl.astype(np.int32)), *lists], ["id", "dl", "term", "tf"])

    return run


def _best(weights: np.ndarray, qids: pa.Array, k: int, length: Callable, delta: float) -> Callable:
    """Of each query the k best documents of a task; weights: (queries, terms).  Blocks of documents and queries bound the memory."""

    def run(batches):
        blocks = [np.ascontiguousarray(weights[i : i + 256].T) for i in range(0, len(weights), 256)]
        best, kind = [Best(x.shape[1], k, 9) for x in blocks], None
        for b in batches:
            kind = b.column(0).type
            ids, dl = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            n = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            end = np.cumsum(n)
            term, tf = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
            gain = tf * (K1 + 1) / (length(np.repeat(dl, n)) + tf) + delta
            lo = 0
            while lo < len(ids):
                begin = end[lo] - n[lo]
                hi = max(lo + 1, int(np.searchsorted(end, begin + 8192, "right")))
                some = np.flatnonzero(n[lo:hi]) + lo
                if len(some):
                    of = slice(begin, end[hi - 1])
                    for w, x in zip(blocks, best):
                        x.add(ids[some], np.add.reduceat(gain[of, None] * w[term[of]], end[some] - n[some] - begin), 0.0)
                lo = hi
        for i, x in enumerate(best if kind else []):
            yield x.batch(qids[256 * i : 256 * (i + 1)], kind, ["qid", "id", "score"])

    return run


def search_all(index: Index, queries: DataFrame, k: int, *, variant: str = "plus", match_only: bool = False) -> DataFrame:
    """(qid, id, score, rank) for queries (qid, terms): k per query, ties by id.

    A term that a query repeats counts each time.  ``plus`` adds its delta to
    every document for each known term, so that unmatched documents fill up the
    list in order of id, unless match_only."""
    if variant not in ("plus", "okapi"):
        raise ValueError(f"unknown BM25 variant: {variant}")
    bag = queries.select("qid", F.explode("terms").alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    bag = cut(bag, "bag")
    rows, size = bag.agg(F.count("*"), F.sum(48 + F.length("term") * 2)).first()
    some = bag.select("term").distinct().limit(FEW + 1).collect() if rows <= 4 * FEW else [None] * (FEW + 1)
    few = [r[0] for r in some] if len(some) <= FEW else None
    # many queries' terms, and what they weigh, as a matrix that every task holds, if it is small; documents are read once and not shuffled
    counted, vocabulary, qids = None, None, None
    if few is None and index.docs is not None and index.docs.schema["id"].dataType.typeName() in ("integer", "long") and (size or 0) <= MATRIX:
        vocabulary, qids = ([r[0] for r in bag.select(c).distinct().orderBy(c).collect()] for c in ("term", "qid"))
        if len(vocabulary) * len(qids) * 8 > MATRIX:
            vocabulary = None
    if vocabulary is not None:
        counted = cut(index.docs.mapInArrow(_found(vocabulary), f"id {index.docs.schema['id'].dataType.simpleString()}, dl int, term array<int>, tf array<int>"), "counted")
        n, avgdl = counted.agg(F.count("*"), F.avg("dl")).first()
        avgdl, lengths = avgdl or 0.0, counted.select("id", "dl")
        place = bag.sparkSession.createDataFrame(list(enumerate(vocabulary)), "place int, term string")
        df = counted.select(F.explode("term").alias("place")).groupBy("place").agg(F.count("*").alias("df")).join(F.broadcast(place), "place").select("term", "df")
    else:
        hits, lengths, n, avgdl = index.read(broadcast_under(bag.select("term").distinct(), size or 0), few)
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
    n = float(n)
    if variant == "plus":
        terms = bag.join(df, "term").withColumn("idf", F.log((n + 1) / F.col("df")))
    else:
        raw = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        mean = index.terms.agg(F.avg(raw)).first()[0] or 0.0
        terms = bag.join(df, "term").withColumn("raw", raw).withColumn("idf", F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw")))
    terms = cut(terms.select("qid", "term", (F.col("qtf") * F.col("idf")).alias("weight")), "terms")
    full = variant == "plus" and not match_only
    delta = DELTA if variant == "plus" and match_only else 0.0

    def length(dl):
        return K1 * (1 - B + B * dl / (avgdl or 1.0))

    if counted is not None:
        at, to = {t: i for i, t in enumerate(vocabulary)}, {q: i for i, q in enumerate(qids)}
        matrix = np.zeros((len(qids), len(vocabulary)))
        for q, t, weight in terms.toLocalIterator():
            matrix[to[q], at[t]] = weight
        kinds = f"qid {bag.schema['qid'].dataType.simpleString()}, id {counted.schema['id'].dataType.simpleString()}, score double"
        # scores of matched documents are above 0 in any variant that counts them
        scored = counted.mapInArrow(_best(matrix, pa.array(qids, to_arrow_type(bag.schema["qid"].dataType)), k, length, delta), kinds)
    else:
        gain = F.col("tf") * (K1 + 1) / (length(F.col("dl")) + F.col("tf")) + delta
        # documents stay where they are while their terms are weighed and added up
        weighed = hits.join(broadcast_under(terms, (size or 0) + 16 * (rows or 0)), "term").select("qid", "id", (F.col("weight") * gain).alias("s"))
        scored = weighed.groupBy("qid", "id").agg(F.sum("s").alias("score"))
    # sums in another order may differ in the last digits, which must not part equal scores
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id")
    top = scored if full else scored.where("score > 0")
    top = top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if not full:
        return top
    # unmatched documents have the base alone; only queries with fewer than k matches need any, of the least 2 k ids
    top = cut(top, "top")
    base = terms.groupBy("qid").agg(F.sum(F.col("weight") * DELTA).alias("base"))
    short = base.join(top.groupBy("qid").agg(F.count("*").alias("m")), "qid", "left").select("qid", "base", F.coalesce("m", F.lit(0)).alias("m")).where(F.col("m") < k)
    pad = lengths.select("id").orderBy("id").limit(2 * k)
    fill = short.crossJoin(F.broadcast(pad)).join(top.select("qid", "id"), ["qid", "id"], "left_anti")
    at = F.row_number().over(Window.partitionBy("qid").orderBy("id"))
    fill = fill.withColumn("rank", (F.col("m") + at).cast("int")).where((F.col("rank") <= k) & (F.col("base") > 0)).select("qid", "id", F.col("base").alias("score"), "rank")
    return top.join(base, "qid").select("qid", "id", (F.col("score") + F.col("base")).alias("score"), "rank").union(fill)


def search(index: Index, terms: list[str], k: int, **options) -> DataFrame:
    """(id, score, rank) for one query's tokens."""
    q = index.lengths.sparkSession.createDataFrame([(0, terms)], "qid int, terms array<string>")
    return search_all(index, q, k, **options).drop("qid")
