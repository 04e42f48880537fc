"""Vector search, rank fusion, hybrid search, reranking and diversity."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loam.functions.vectors import checked, cosine_to


DISTANCES = ("cosine", "l2", "ip")


def similarity(embedding: Column, query, distance: str = "cosine") -> Column:
    """How near an embedding is to the query, more is nearer: cosine, the inner product, or the negative squared distance."""
    if distance == "cosine":
        return cosine_to(embedding, query)
    if distance not in DISTANCES:
        raise ValueError(f"unknown distance: {distance}")
    q = F.array(*(F.lit(float(x)) for x in query))
    each = F.zip_with(embedding.cast("array<double>"), q, (lambda a, b: a * b) if distance == "ip" else (lambda a, b: -(a - b) * (a - b)))
    return F.aggregate(each, F.lit(0.0), lambda t, x: t + x)


def knn(vectors: DataFrame, id: str, embedding: str, query, k: int, where: Column | None = None, *, distance: str = "cosine") -> DataFrame:
    """(id, score, rank): the k nearest, ties by id; ``where`` filters before."""
    q = checked(query)
    rows = vectors if where is None else vectors.where(where)
    best = rows.select(F.col(id).alias("id"), similarity(F.col(embedding), q, distance).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def knn_by(vectors: DataFrame, id: str, embedding: str, query, k: int, by: str, *, distance: str = "cosine") -> DataFrame:
    """(by, id, score, rank): the k nearest of each group."""
    w = Window.partitionBy("by").orderBy(F.desc("score"), "id")
    rows = vectors.select(F.col(by).alias("by"), F.col(id).alias("id"), similarity(F.col(embedding), checked(query), distance).alias("score"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("by", by)


class Best:
    """Of each of some queries the k best ids so far, ties by id.  Scores are compared rounded, as those that rank them are."""

    def __init__(self, queries: int, k: int, digits: int):
        self.k, self.digits = k, digits
        self.least = np.full(queries, -np.inf)
        self.q, self.id, self.score = np.empty(0, np.int64), None, np.empty(0)

    def add(self, ids: np.ndarray, scores: np.ndarray, above: float = -np.inf) -> None:
        """scores: (ids, queries); those not above the bound don't count."""
        r = np.round(scores, self.digits)
        row, q = np.nonzero((r >= self.least) & (scores > above))
        if not len(q):
            return
        q, score = np.concatenate([self.q, q]), np.concatenate([self.score, scores[row, q]])
        id = ids[row] if self.id is None else np.concatenate([self.id, ids[row]])
        r = np.round(score, self.digits)
        at = np.lexsort((id, -r, q))
        q, id, score, r = q[at], id[at], score[at], r[at]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.least[q[last]] = r[last]
        some = rank < self.k
        self.q, self.id, self.score = q[some], id[some], score[some]

    def batch(self, qids: pa.Array, kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([qids.take(pa.array(self.q)), pa.array([] if self.id is None else self.id, kind), pa.array(self.score)], names)


def knn_all(vectors: DataFrame, id: str, embedding: str, queries: DataFrame, k: int, *, per_pass: int = 4096) -> DataFrame:
    """(qid, id, score, rank) for queries (qid, embedding): matrix products with ``per_pass`` queries at a time, which every task holds, then k of each task's k best.

    A task takes blocks of rows and queries, so its memory doesn't depend on how many there are."""
    kind, qkind = vectors.schema[id].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()
    arrow = to_arrow_type(queries.schema["qid"].dataType)
    base = vectors.select(id, embedding).where(F.col(embedding).isNotNull())

    def search(rows: list) -> Callable:
        qids = pa.array([r[0] for r in rows], arrow)
        q = np.array([r[1] for r in rows], float)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def run(batches):
            best, kind = [Best(len(q[i : i + 512]), k, 12) for i in range(0, len(q), 512)], None
            for b in batches:
                for i in range(0, b.num_rows, 1024):
                    part = b.slice(i, 1024)
                    kind = part.column(0).type
                    v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                    n = np.linalg.norm(v, axis=1, keepdims=True)
                    v = np.where(n < 1e-10, 0, v / np.maximum(n, 1e-300))
                    key = part.column(0).to_numpy(zero_copy_only=False)
                    for j, x in enumerate(best):
                        x.add(key, v @ q[512 * j : 512 * (j + 1)].T)
            for j, x in enumerate(best if kind else []):
                yield x.batch(qids[512 * j : 512 * (j + 1)], kind, ["qid", "id", "score"])

        return run

    near, tile = None, []
    for r in itertools.chain(queries.select("qid", "embedding").where(F.col("embedding").isNotNull()).toLocalIterator(), [None]):
        if r is not None:
            tile.append(r)
        if tile and (r is None or len(tile) == per_pass):
            part = base.mapInArrow(search(tile), f"qid {qkind}, id {kind}, score double")
            near, tile = part if near is None else near.union(part), []
    if near is None:
        near = vectors.sparkSession.createDataFrame([], f"qid {qkind}, id {kind}, score double")
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf(ranked: Sequence[DataFrame], weights: Sequence[float] | None = None, *, k: int | None = None, rrf_k: int = 60, by: Sequence[str] = ()) -> DataFrame:
    """Reciprocal rank fusion of lists (id, rank), ranks from 1: (id, score, rank).

    Weights are made to sum to 1 if they sum to more than 0.  Equal scores stand
    in the order of the first list that has them, then by rank."""
    if not ranked:
        raise ValueError("no ranked lists")
    weights = [1.0] * len(ranked) if weights is None else list(weights)
    if len(weights) != len(ranked):
        raise ValueError("as many weights as ranked lists are needed")
    if any(isinstance(w, bool) or not isinstance(w, (int, float)) for w in weights):
        raise TypeError("weights must be numbers")
    if any(w < 0 for w in weights):
        raise ValueError("weights can't be negative")
    if rrf_k < 0:
        raise ValueError("rrf_k can't be negative")
    total = sum(weights)
    weights = [w / total for w in weights] if total > 0 else weights
    rows = None
    for i, (df, w) in enumerate(zip(ranked, weights)):
        part = df.select(*by, "id", F.lit(i).alias("list"), "rank", (F.lit(float(w)) / (F.col("rank") + rrf_k)).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy(*by, "id").agg(F.sum("s").alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    order = (F.desc("score"), "first")
    if k is not None and not by:
        fused = fused.orderBy(*order).limit(k)
    out = fused.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)))
    out = out if k is None else out.where(F.col("rank") <= k)
    return out.select(*by, "id", "score", "rank")


def hybrid(vector: DataFrame, keyword: DataFrame, k: int, *, vector_weight: float = 0.7, keyword_weight: float = 0.3, rrf_k: int = 60) -> DataFrame:
    """Both lists fused; where the keyword list is empty this is the vector list's order."""
    return rrf([vector, keyword], [vector_weight, keyword_weight], k=k, rrf_k=rrf_k)


def rerank(hits: DataFrame, text: str, score: Callable[[list[str]], Sequence[float]], k: int | None = None) -> DataFrame:
    """hits in order of score(texts), a function made for a query, with ``rerank_score``; ties keep their rank."""

    @F.arrow_udf("double")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([float(s) for s in score(x.to_pylist())], pa.float64())

    scored = hits.withColumn("rerank_score", run(F.col(text)))
    out = scored.withColumn("new", F.row_number().over(Window.orderBy(F.desc("rerank_score"), "rank"))).drop("rank").withColumnRenamed("new", "rank")
    return out if k is None else out.where(F.col("rank") <= k)


_models: dict[tuple, object] = {}


def ranker(make: Callable[..., object], name: str, max_length: int) -> object:
    """The model that make(name, max_length) gives, made once in each process and kept until another is asked for."""
    key = (name, max_length)
    if key not in _models:
        _models.clear()
        _models[key] = make(name, max_length)
    return _models[key]


def overlap_score(query: str) -> Callable[[list[str]], list[float]]:
    """A scorer without a model: the share of the query's words that a text has."""
    want = set(query.lower().split())
    return lambda texts: [len(want & set((t or "").lower().split())) / max(1, len(want)) for t in texts]


def mmr_order(relevance: Sequence[float] | None, vectors: np.ndarray, query: np.ndarray | None = None, *, balance: float = 0.5, k: int | None = None) -> list[int]:
    """Maximal marginal relevance: positions in order of choice; equal scores go to the earliest.

    The largest similarity to the chosen ones is kept up to date, so a round
    costs one product."""
    v = np.asarray(vectors, float)
    if v.ndim != 2 or (query is not None and len(query) != v.shape[1]) or (relevance is not None and len(relevance) != len(v)):
        raise ValueError("vectors, query and relevance must fit together")
    n = np.linalg.norm(v, axis=1)
    unit = np.where(n[:, None] < 1e-10, 0, v / np.maximum(n[:, None], 1e-300))
    if relevance is None:
        q = np.asarray(query, float)
        relevance = unit @ (q / max(np.linalg.norm(q), 1e-300))
    rel, most = np.asarray(relevance, float), np.zeros(len(v))
    open_, out = np.ones(len(v), bool), []
    for _ in range(len(v) if k is None else min(k, len(v))):
        s = np.where(open_, balance * rel - (1 - balance) * most, -np.inf)
        i = int(np.argmax(s))
        out.append(i)
        open_[i] = False
        sim = unit @ unit[i]
        most = sim if len(out) == 1 else np.maximum(most, sim)
    return out


def mmr(hits: DataFrame, embedding: str, query, *, balance: float = 0.5, k: int | None = None, by: str | None = None) -> DataFrame:
    """hits (rank, embedding, ...) with ranks by maximal marginal relevance, for each ``by`` apart."""
    q = np.array(checked(query))

    def run(rows):
        rows = rows.sort_values("rank", ignore_index=True)
        order = mmr_order(None, np.array(rows[embedding].tolist(), float), q, balance=balance, k=k)
        out = rows.iloc[order].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    key = [by] if by else []
    return hits.groupBy(*key).applyInPandas(run, hits.schema)
