"""Quality classifier by importance resampling.

A hashed n-gram model of the raw text (all documents) and one of the target
text (labelled documents of quality 1 that are not toxic) give each document
an importance weight, their likelihood ratio; documents are then sampled
without replacement by Gumbel top-k (Xie et al. 2023, "Data Selection for
Language Models via Importance Resampling").

* Features: hashes of single tokens and of pairs, in 2**18 and 2**16 buckets; a token
  is a word or a run of other signs, lower-cased.
* Per bucket, log((t + 1) / (e + 1)): t occurrences in the target sample, e
  expected there from the raw text.  Sums over a document favour long texts, so
  a logistic fit on labelled documents that the target model hasn't seen maps
  the ratio's negative part, mean and length to P(target | text), and the log
  weight is log P, that is log(p_target / p_raw) up to a constant.
* k is the number of documents with P >= 1/2, and the sample is the k largest
  log P / temperature + Gumbel noise, the noise a hash of doc_id and seed.

Two scans of the documents; what reaches the driver is two vectors of these
counts, at most twice ``max_labelled`` rows of 5 numbers, and histograms.

Nulls: a null text is an empty one; a null doc_id gets the noise of null; a
null label counts as not given, labels without document are ignored.  Empty
texts have no features and are rejected.  Repeated rows share one noise, so they stay or go together; ties
at the k-th key all stay.  Without a usable label of both kinds everything but
empty texts stays.  An empty table gives an empty result.  Other columns are
passed on untouched by ``select_quality``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._spark import col, cut, fresh

ONE, TWO = 1 << 18, 1 << 16
SIZE = ONE + TWO


def _features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the tokens and of the pairs, whether a pair is one, and the texts' offsets."""
    w = K.words(data, offs, K.CLASSES)
    pairs, ok = w.ngrams(2)
    return (w.hashes & K.U64(ONE - 1)).astype(np.int64), (pairs & K.U64(TWO - 1)).astype(np.int64) + ONE, ok, w.offsets


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64)
    for b in batches:
        role = b.column(1).fill_null(0).to_numpy(zero_copy_only=False)
        for lo, hi, data, offs in K.chunks(b.column(0)):
            one, two, ok, at = _features(data, offs)
            raw += np.bincount(np.concatenate([one, two[ok]]), minlength=SIZE)
            mine = np.repeat(role[lo:hi] == 1, np.diff(at))
            if mine.any():
                target += np.bincount(np.concatenate([one[mine], two[mine & ok]]), minlength=SIZE)
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], ["bucket", "raw", "target"])


def _sums(ratio: np.ndarray, text: pa.Array) -> np.ndarray:
    """Of each text: tokens, sum of the ratios, sum of the tokens' ratios under -1.5 and of the pairs' under -1."""
    parts = [np.zeros((0, 4))]
    for _, _, data, offs in K.chunks(text):
        one, two, ok, at = _features(data, offs)
        a, b = ratio[one], np.where(ok, ratio[two], 0)
        low, low2 = np.where(a < -1.5, a, 0), np.where(b < -1, b, 0)
        parts.append(np.stack([np.diff(at), *(K.segment_sum(x.astype(np.float64), at) for x in (a + b, low, low2))], 1))
    return np.concatenate(parts)


def _design(x: np.ndarray) -> np.ndarray:
    n, total, low, low2 = x[:, 0], x[:, 1], -x[:, 2], -x[:, 3]
    m = np.maximum(n, 1)
    return np.stack([np.ones(len(n)), np.log1p(low), np.sqrt(low / m), np.log1p(low2), np.sqrt(low2 / m), total / m, np.log(m)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Damped Newton steps on standardised columns: coefficients, means, scales."""
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale[0] = 0, 1
    scale[scale < 1e-9] = 1
    z, c = (x - mean) / scale, np.zeros(x.shape[1])

    def loss(c):
        s = z @ c
        return (np.logaddexp(0, s) - y * s).sum() + ridge / 2 * c @ c

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -500, 500)))
        g = z.T @ (p - y) + ridge * c
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(c)), g)
        size = 1.0
        while loss(c - size * step) > loss(c) and size > 1e-6:
            size /= 2
        c = c - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return c, mean, scale


@dataclass
class Model:
    ratio: np.ndarray
    coefficients: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None

    def log_p(self, x: np.ndarray) -> np.ndarray:
        """log P(target) from the sums; of empty texts -50, without a fit 0."""
        if self.coefficients is None:
            p = np.zeros(len(x))
        else:
            p = -np.logaddexp(0, -((_design(x) - self.mean) / self.scale @ self.coefficients))
        return np.where(x[:, 0] > 0, p, -50.0)


def _roles(labels: DataFrame, max_labelled: int) -> DataFrame:
    """(doc_id, role): 1 target for the n-gram model; 2 target and 3 other for the fit; 4 other, not used.

    At most max_labelled labels, those least by a hash of doc_id; halves by another hash."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    one = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(good).alias("good"))
    one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    second = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(2)) == 1
    return one.select("doc_id", F.when(second, F.when(F.col("good"), 2).otherwise(3)).when(F.col("good"), 1).otherwise(4).alias("role"))


def score_column(model: Model) -> Column:
    """A function of the text column: log weight."""
    spread = _broadcast(model)

    @F.arrow_udf("double")
    def log_weight(text: pa.Array) -> pa.Array:
        m = spread.value
        return pa.array(m.log_p(_sums(m.ratio, text)), pa.float64())

    return log_weight


def _broadcast(model: Model):
    from pyspark.sql import SparkSession

    return SparkSession.active().sparkContext.broadcast(model)


def _with_roles(docs: DataFrame, roles: DataFrame) -> DataFrame:
    return docs.join(F.broadcast(roles), "doc_id", "left")


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 20_000) -> Model:
    """The n-gram models over all documents and the logistic fit; max_labelled bounds the labelled sample."""
    spark = docs.sparkSession
    d = docs.select("doc_id", "text")
    roles = _roles(labels, max_labelled).collect()
    roles = spark.createDataFrame([(int(r[0]), int(r[1])) for r in roles], "doc_id long, role int")
    counts = _with_roles(d, roles).select("text", "role").mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(SIZE), np.zeros(SIZE)
    for b, r, t in counts:
        raw[b], target[b] = r, t
    ratio = np.zeros(SIZE, np.float32)
    for part in (slice(0, ONE), slice(ONE, SIZE)):
        e = raw[part] * (target[part].sum() / max(raw[part].sum(), 1))
        ratio[part] = np.log((target[part] + 1) / (e + 1)) if target[part].sum() else 0
    model = Model(ratio)
    spread = spark.sparkContext.broadcast(ratio)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _sums(spread.value, b.column(0))
            yield pa.RecordBatch.from_arrays([b.column(1), *map(pa.array, x.T)], ["role", *"nabc"])

    seen = d.join(F.broadcast(roles.where("role in (2, 3)")), "doc_id").select("text", "role").mapInArrow(sums, "role int, n double, a double, b double, c double").where("n > 0")
    rows = np.array([tuple(r) for r in seen.orderBy(F.xxhash64("role", *"nabc"), "n").limit(2 * max_labelled).collect()], float).reshape(-1, 5)
    y = (rows[:, 0] == 2).astype(float)
    if 0 < y.sum() < len(y):
        model.coefficients, model.mean, model.scale = _logistic(_design(rows[:, 1:]), y)
    return model


def _gumbel(doc_id: Column, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def threshold(keys: DataFrame, k: int) -> float | None:
    """The k-th largest of the column key, exactly, by histograms refined until one bin is small."""
    if k <= 0:
        return None
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    part = keys
    for _ in range(8):
        if hi <= lo:
            return lo
        width = (hi - lo) / 4096
        bins = part.groupBy(F.least(F.floor((F.col("key") - lo) / width), F.lit(4095)).alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most")).collect()
        for b in sorted(bins, key=lambda b: -b["b"]):
            if b["n"] >= k:
                break
            k -= b["n"]
        if b["n"] <= 20_000:
            return part.where(F.col("key").between(b["least"], b["most"])).orderBy(F.desc("key")).limit(k).agg(F.min("key")).first()[0]
        lo, hi = b["least"], b["most"]
        part = part.where(F.col("key").between(lo, hi))
    return lo


def quality_sample(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 20_000, temperature: float = 0.2, seed: int = 1) -> DataFrame:
    """The sampled documents: (doc_id, log_weight, key), key the perturbed log weight."""
    return _sample(docs, labels, max_labelled, temperature, seed)[0]


def _sample(docs: DataFrame, labels: DataFrame, max_labelled: int, temperature: float, seed: int):
    model = fit(docs, labels, max_labelled=max_labelled)
    weight = score_column(model)
    scored = docs.select("doc_id", weight("text").alias("log_weight"))
    scored = cut(scored.withColumn("key", F.col("log_weight") / temperature + _gumbel(F.col("doc_id"), seed)), "quality")
    k = scored.where(F.col("log_weight") >= float(np.log(0.5))).count()
    least = threshold(scored.select("key"), k)
    return scored.where(F.lit(False) if least is None else F.col("key") >= F.lit(least)), model, least


def select_quality(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 20_000, temperature: float = 0.2, seed: int = 1) -> DataFrame:
    """The rows of the sampled documents, all columns; scored again by the same functions rather than joined."""
    _, model, least = _sample(docs, labels, max_labelled, temperature, seed)
    if least is None:
        return docs.limit(0)
    (key,) = fresh(docs, "key")
    weight = score_column(model)
    out = docs.withColumn(key, weight(col("text")) / temperature + _gumbel(col("doc_id"), seed))
    return out.where(col(key) >= F.lit(least)).drop(key)
