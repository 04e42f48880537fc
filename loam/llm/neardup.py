"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its word 3-grams (of all its words if it has one or
two).  One hash function orders all shingles; a sketch keeps a set's k least
values.  Inverted lists of the retained values generate pairs that overlap,
the sketch of the union estimates their resemblance, and exact Jaccard on the
whole sets decides (Broder 1997; Thorup 2013 for one function).

* Documents of equal sets are collapsed first, so exact copies cost nothing.
* A value that one document retains has no list.  Of the rest a document is
  listed under its rarest values only, as many as any partner of the least
  admissible overlap must share one of (prefix filter): no pair is lost, and
  passages that many documents share make no long lists.
* First each list links its members to its least and its greatest document;
  what verifies is united.  Then every pair of a list whose ends lie in
  different components is checked, so the groups are those that all pairs give,
  without the quadratic number of pairs inside a group of copies.

Nothing is capped.  Estimates may fall short of the truth; ``slack`` is three
standard deviations at the threshold.

Nulls: a null doc_id or text, or a text without words, is never a duplicate.
Rows of one doc_id count as one document with several texts.  Groups are
connected components; the least doc_id of each stays.  Empty tables give empty
results.  A text of any length is one set, which a task holds whole.  doc_ids are
integers or can be cast to them.  Only doc_id and text are read; ``drop_near_duplicates``
passes on all columns, of whatever names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _kernel as K
from ._spark import col, components, cut, fresh, maybe_broadcast


def shingle_sets(text: pa.Array, n: int = 3) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, data, offs in K.chunks(text):
        w = K.words(data, offs)
        by = [w.ngrams(j)[0] >> K.U64(1) for j in range(1, n + 1)]
        for lo, hi in zip(w.offsets[:-1], w.offsets[1:]):
            m = min(n, hi - lo)
            yield np.unique(by[m - 1][lo : hi - m + 1]).view(np.int64) if m else np.zeros(0, np.int64)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))


def sketches(docs: DataFrame, k: int, n: int = 3) -> DataFrame:
    """(doc_id, n, whole, sketch): size and hash of the shingle set, its k least values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, whole, least = [], [], []
            for s in shingle_sets(b.column(1), n):
                size.append(len(s))
                whole.append(K.mix(s.view(K.U64)).sum(dtype=K.U64))
                least.append(s[:k])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(np.array(whole, K.U64).view(np.int64)), _lists(least)], ["doc_id", "n", "whole", "sketch"])

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, whole long, sketch array<long>").where("n > 0")


def full_sets(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, shingles): the whole shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(list(shingle_sets(part.column(1), n)))], ["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def union_estimate(a: Column, b: Column, k: int) -> Column:
    """Resemblance by the bottom-k sketch of the union of two sets."""
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(least, a), b)) / F.size(least)


def _verified(pairs: DataFrame, sk: DataFrame, docs: DataFrame, threshold: float, slack: float, k: int, n: int, limit: int) -> DataFrame:
    """The pairs (a, b) that pass the estimate and exact Jaccard."""
    s = sk.select("doc_id", "sketch")
    j = pairs.join(s.toDF("b", "sb"), "b").join(s.toDF("a", "sa"), "a")
    j = cut(j.where(union_estimate(F.col("sa"), F.col("sb"), k) >= threshold - slack).select("a", "b").distinct(), "pairs")
    ids = cut(j.select(F.col("a").alias("doc_id")).union(j.select("b")).distinct(), "ids")
    few = maybe_broadcast(ids, ids.count(), 16, limit)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id")
    f = cut(full_sets(texts, n).distinct(), "sets")
    j = j.join(f.toDF("b", "sb"), "b").join(f.toDF("a", "sa"), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    return cut(j.where(both / (F.size("sa") + F.size("sb") - both) >= threshold).select("a", "b").distinct(), "verified")


def near_duplicates(docs: DataFrame, *, threshold: float = 0.5, k: int = 32, shingle: int = 3, slack: float | None = None, broadcast_limit: int = 64 << 20) -> DataFrame:
    """(doc_id, keep_id, kind) of each document that another of its group stands for; kind is 'exact' or 'near'."""
    slack = min(threshold, 3 * math.sqrt(threshold * (1 - threshold) / k)) if slack is None else slack
    every = cut(sketches(docs, k, shingle), "sketches")
    same = Window.partitionBy("n", "whole")
    reps = cut(every.select("doc_id", "n", "whole").distinct().withColumn("rep", F.min("doc_id").over(same)), "groups")
    sk = every.groupBy("n", "whole").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"))
    sk = cut(sk.select("doc_id", "n", "sketch"), "reps")

    # rarest values of each sketch, of those that another document retains too
    s = F.size("sketch")
    # a partner of a set held whole may be larger than a sketch, so both go by the estimate's bound
    need = F.ceil((threshold - slack) * s - 1e-9)
    rows = sk.select("doc_id", (s - F.greatest(need, F.lit(1)) + 1).alias("p"), s.alias("s"), F.explode("sketch").alias("v"))
    rows = rows.withColumn("df", F.count("*").over(Window.partitionBy("v"))).where("df > 1")
    mine = Window.partitionBy("doc_id")
    rows = rows.withColumn("m", F.count("*").over(mine)).withColumn("r", F.row_number().over(mine.orderBy("df", "v")))
    listed = cut(rows.where("r <= p - (s - m)").select("v", "doc_id"), "lists")

    by = Window.partitionBy("v")
    ends = listed.select("doc_id", F.min("doc_id").over(by).alias("lo"), F.max("doc_id").over(by).alias("hi"))
    star = ends.select(F.col("lo").alias("a"), F.col("doc_id").alias("b")).union(ends.select(F.col("doc_id").alias("a"), F.col("hi").alias("b")))
    star = cut(star.where("a < b").distinct(), "star")
    args = (sk, docs, threshold, slack, k, shingle, broadcast_limit)
    first = _verified(star, *args)
    comp = cut(components(first), "components")

    # the pairs of a list that lie in different components
    lab = listed.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("v", "doc_id", F.coalesce("root", "doc_id").alias("c"))
    lab = lab.withColumn("lo", F.min("c").over(by)).withColumn("hi", F.max("c").over(by)).where("lo < hi").select("v", "doc_id", "c")
    lab = cut(lab, "mixed")
    rest = lab.toDF("v", "a", "ca").join(lab.toDF("v", "b", "cb"), "v").where("a < b and ca <> cb").select("a", "b").distinct()
    second = _verified(rest.join(star, ["a", "b"], "left_anti"), *args)
    if not second.isEmpty():
        comp = cut(components(first.union(second)), "components")

    out = reps.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "rep", F.coalesce("root", "rep").alias("keep_id"))
    out = out.groupBy("doc_id").agg(F.min("keep_id").alias("keep_id"), F.min("rep").alias("rep")).where("doc_id <> keep_id")
    return out.select("doc_id", "keep_id", F.when(F.col("rep") == F.col("keep_id"), "exact").otherwise("near").alias("kind"))


def drop_near_duplicates(docs: DataFrame, *, broadcast_limit: int = 64 << 20, **params) -> DataFrame:
    """docs without the documents that another stands for: of each group the least doc_id stays."""
    gone = cut(near_duplicates(docs, broadcast_limit=broadcast_limit, **params).select("doc_id"), "gone")
    (key,) = fresh(docs, "gone")
    gone = maybe_broadcast(gone.toDF(key), gone.count(), 16, broadcast_limit)
    return docs.join(gone, col("doc_id") == F.col(key), "left_anti")
