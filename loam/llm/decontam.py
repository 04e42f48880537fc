"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages of ``window`` words.  Passages and
benchmark items are TF-IDF vectors over hashed words; a randomised SVD of the
passage matrix A gives a latent space, in which cosine finds candidates:
passage and item pairs above ``cosine``.  Around a candidate the longest common
subsequence of words decides, with a check of the item's answer, its last
words: a paraphrase that drops or changes words keeps a long common
subsequence, a passage on the same matter doesn't.

* Pass 1 counts in how many blocks each hashed word occurs.
* Pass 2 sums S A for a random sparse S over all passages, by tasks and then by
  pieces of the matrix; its right singular vectors Q span the range sketch.
* Pass 3 sums the Gram matrix of A Q; its eigenvectors turn Q into singular
  vectors of A, with their values (Halko, Martinsson and Tropp 2011).
* Pass 4 projects every passage, compares it with every item by matrix
  products, and verifies in place, where the document's words are at hand.

No pass joins or shuffles texts.  To the driver come 2**14 counts and matrices
of 160 x 2**14 and 160 x 160, whatever the input.  Items are held by every task, ``per_pass``
at most at a time; more items take more passes.

A document leaks an item if the common subsequence covers ``Rules.coverage`` of the
item, or ``Rules.partial`` of it and another one ``Rules.answer`` of its answer: what the benchmark's
column named by the parameter ``answer`` holds, or where there is none the item's last quarter.
The driver reads ``per_pass`` items at a time and holds no more.

Nulls: null and empty texts have no passages and leak nothing; null or empty
items are left out; null ids come out as null.  A text shorter than a window is
one passage; long ones are cut into as many as they fill, and a task holds one text.  Ids are
integers or can be cast to them; ``leaks`` reads no other columns, ``drop_leaks`` passes on all,
of whatever names.  Repeated rows each give their rows; repeated items are each
reported.  Empty tables give empty results.  Of several places of one item in
a document that of the largest coverage is reported, the first of equal ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _kernel as K
from ._spark import col, fresh

D, SKETCH, RANK = 1 << 14, 160, 128
_PART = 160 * 32  # numbers of a row of the matrices when they are summed


@dataclass(frozen=True)
class Rules:
    window: int = 32
    cosine: float = 0.3
    coverage: float = 0.7
    partial: float = 0.6
    answer: float = 0.75


def _blocks(offsets: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the blocks of half a window each, with the end; and whether a block is its text's last."""
    n = np.diff(offsets)
    per = -(-n // half)
    text = np.repeat(np.arange(len(n)), per)
    first = np.cumsum(per) - per
    j = np.arange(len(text)) - first[text]
    last = j == per[text] - 1
    return offsets[text] + j * half, last


def _sums(table: np.ndarray, words: np.ndarray, starts: np.ndarray, last: np.ndarray, half: int) -> np.ndarray:
    """Sums of the words' rows over each block, and with it the next of the same text: a passage starts with every block but the last of several.

    The table ends with a row of zeros, that of no word."""
    ends = np.append(starts[1:], len(words))
    words = np.append(words, np.full(half, len(table) - 1, words.dtype))
    s = np.take(table, words[starts], axis=0)
    row = np.empty_like(s)
    for j in range(1, half):
        at = starts + j
        np.take(table, np.where(at < ends, words[at], len(table) - 1), axis=0, out=row, mode="clip")
        s += row
    out = s.copy()
    more = np.flatnonzero(~last)
    out[more] += s[more + 1]
    return out


def _passages(last: np.ndarray) -> np.ndarray:
    """Blocks that start a passage: not the last ones, unless a text has only that."""
    only = np.concatenate([[True], last[:-1]]) & last if len(last) else last
    return ~last | only


def _frequencies(half: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(D, np.int64), 0
        for b in batches:
            for _, _, data, offs in K.chunks(b.column(0)):
                w = K.words(data, offs)
                starts, _ = _blocks(w.offsets, half)
                if not len(starts):
                    continue
                kind = np.int32 if len(starts) < 1 << 17 else np.int64
                block = np.repeat(np.arange(len(starts), dtype=kind), np.diff(np.append(starts, len(w.hashes))))
                key = np.sort(block * kind(D) + (w.hashes & K.U64(D - 1)).astype(kind))
                new = np.concatenate([[True], key[1:] != key[:-1]])
                df += np.bincount(key[new] & (D - 1), minlength=D)
                n += len(starts)
        yield pa.RecordBatch.from_arrays([pa.array([*range(D), -1], pa.int64()), pa.array([*df.tolist(), n], pa.int64())], ["w", "n"])

    return run


def _sketch(idf: np.ndarray, half: int) -> Callable:
    """Rows of S A: every passage is added to one of SKETCH rows, by a random sign (Clarkson and Woodruff 2013).

    Row and sign are a hash of the document's id and the passage's place, whatever the partitions are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.zeros(SKETCH * D, np.float32)
        for b in batches:
            ids = b.column(1).to_numpy().view(K.U64)
            for lo, hi, data, offs in K.chunks(b.column(0)):
                w = K.words(data, offs)
                starts, last = _blocks(w.offsets, half)
                if not len(starts):
                    continue
                f = (w.hashes & K.U64(D - 1)).astype(np.int64)
                size = np.diff(np.append(starts, len(f)))
                text = np.searchsorted(w.offsets, starts, "right") - 1
                random = K.mix(K.mix(ids[lo:hi][text]) + (starts - w.offsets[text]).astype(K.U64))
                row = (random % K.U64(SKETCH)).astype(np.int64) * D
                sign = np.where(random >> K.U64(63), np.float32(-1), np.float32(1)) * _passages(last)
                value = idf[f]
                np.add.at(z, f + np.repeat(row, size), value * np.repeat(sign, size))
                before = np.flatnonzero(~last)  # a block is also in the passage of the one before
                row2, sign2 = np.zeros_like(row), np.zeros_like(sign)
                row2[before + 1], sign2[before + 1] = row[before], sign[before]
                np.add.at(z, f + np.repeat(row2, size), value * np.repeat(sign2, size))
        yield _matrix(z)

    return run


def _gram(table: np.ndarray, half: int) -> Callable:
    """(A Q)'(A Q) for the D x SKETCH table idf * Q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((SKETCH, SKETCH), np.float64)
        for b in batches:
            for _, _, data, offs in K.chunks(b.column(0), 1 << 17):
                w = K.words(data, offs)
                starts, last = _blocks(w.offsets, half)
                if len(starts):
                    y = _sums(table, (w.hashes & K.U64(D - 1)).astype(np.int16), starts, last, half)[_passages(last)]
                    g += y.T @ y
        yield _matrix(g.ravel())

    return run


def _matrix(z: np.ndarray, at: np.ndarray | None = None) -> pa.RecordBatch:
    z = z.reshape(-1, _PART) if z.ndim == 1 else z
    at = np.arange(len(z)) if at is None else at
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in z], pa.binary())], ["part", "numbers"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1)):
            x = np.frombuffer(x.as_buffer(), np.float32)
            if k in total:
                total[k] += x
            else:
                total[k] = x.astype(np.float64)
    if total:
        yield _matrix(np.stack(list(total.values())), np.array(list(total)))


def _total(parts: DataFrame, tasks: int, size: int) -> np.ndarray:
    """The sum of the tasks' vectors, in two levels where there are many tasks."""
    schema = "part int, numbers binary"
    if tasks > 16:
        parts = parts.repartition(min(1024, max(8, tasks // 4)), "part", F.spark_partition_id() % max(2, min(128, tasks // 16))).mapInArrow(_add, schema)
    z = np.zeros((size // _PART, _PART))
    for p, x in parts.repartition(8, "part").mapInArrow(_add, schema).collect():
        z[p] += np.frombuffer(x, np.float32)
    return z.ravel()


def randomised_svd(texts: DataFrame, idf: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (D x RANK) and singular values of the passage matrix, from its range sketch Q and the Gram matrix of A Q."""
    tasks, schema = texts.rdd.getNumPartitions(), "part int, numbers binary"
    z = _total(texts.mapInArrow(_sketch(idf, half), schema), tasks, SKETCH * D).reshape(SKETCH, D)
    _, s, q = np.linalg.svd(z, full_matrices=False)
    if not s[0]:
        return np.zeros((D, RANK)), np.zeros(RANK)
    q = q.T * (s > s[0] * 1e-6)
    table = np.ascontiguousarray(np.vstack([idf[:, None] * q, np.zeros((1, SKETCH))]), np.float32)  # in row order, or take() copies it each time
    g = _total(texts.mapInArrow(_gram(table, half), schema), tasks, SKETCH * SKETCH).reshape(SKETCH, SKETCH)
    lam, u = np.linalg.eigh((g + g.T) / 2)
    return q @ u[:, ::-1][:, :RANK], np.sqrt(np.maximum(lam[::-1][:RANK], 0))


class Items:
    """Benchmark items as masks of their words' positions, and in the latent space."""

    def __init__(self, items: list[tuple], embed: np.ndarray):
        self.ids, self.masks, vectors = [], [], []
        for i, text, reply in items:
            h, a = K.hash_words(text), K.hash_words(reply)
            if not len(h):
                continue
            a = a if len(a) else h[-max(1, len(h) // 4) :]
            whole, answer = {}, {}
            for p, x in enumerate(h.tolist()):
                whole[x] = whole.get(x, 0) | 1 << p
            for p, x in enumerate(a.tolist()):
                answer[x] = answer.get(x, 0) | 1 << p
            self.ids.append(i)
            self.masks.append((len(h), whole, len(a), answer))
            vectors.append(embed[(h & K.U64(D - 1)).astype(np.int64)].sum(0))
        v = np.array(vectors, np.float32).reshape(-1, embed.shape[1])
        self.vectors = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def lcs(words: list[int], size: int, mask: dict[int, int]) -> int:
    """Length of the longest common subsequence, by bits (Hyyro 2004)."""
    full = (1 << size) - 1
    s = full
    for y in filter(None, map(mask.get, words)):
        u = s & y
        if u:
            s = ((s + u) | (s - u)) & full
    return size - s.bit_count()


def _matches(text: pa.Array, items: Items, embed: np.ndarray, rules: Rules) -> Iterator[tuple]:
    """(row, item, cosine, coverage, answer coverage, first word, end) of every leak."""
    half = rules.window // 2
    for row, _, data, offs in K.chunks(text, 1 << 17):
        w = K.words(data, offs)
        starts, last = _blocks(w.offsets, half)
        if not len(starts) or not items.ids:
            continue
        v = _sums(embed, (w.hashes & K.U64(D - 1)).astype(np.int16), starts, last, half)
        size = np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-9)
        cos = v @ items.vectors.T
        some = np.flatnonzero((cos.max(1) >= rules.cosine * size) & _passages(last))
        if not len(some):
            continue
        block, item = np.nonzero(cos[some] >= rules.cosine * size[some, None])
        block = some[block]
        order = np.lexsort((item, starts[block]))
        block, item = block[order], item[order]
        doc = np.searchsorted(w.offsets, starts[block], "right") - 1
        every, sizes = w.hashes.tolist(), np.array([m[0] for m in items.masks])[item]
        los = np.maximum(w.offsets[doc], starts[block] - sizes)
        his = np.minimum(w.offsets[doc + 1], starts[block] + rules.window + sizes)
        best: dict[tuple[int, int], tuple] = {}
        for d, b, i, lo, hi in zip(*(x.tolist() for x in (doc, block, item, los, his))):
            m, whole, tail, answer = items.masks[i]
            words = every[lo:hi]
            # a common subsequence has each of the item's words once at most, and each of the text's
            held = sum(map(int.bit_count, map(whole.__getitem__, whole.keys() & words)))
            if held < rules.partial * m or held / m <= best.get((d, i), (0, 0))[1] or sum(map(whole.__contains__, words)) < rules.partial * m:
                continue
            share = lcs(words, m, whole) / m
            if share < min(rules.partial, rules.coverage):
                continue
            # an answer stands within its own length of the item
            far = max(0, tail - m)
            end = lcs(every[max(int(w.offsets[d]), lo - far) : min(int(w.offsets[d + 1]), hi + far)] if far else words, tail, answer) / tail
            if (share >= rules.coverage or (share >= rules.partial and end >= rules.answer)) and share > best.get((d, i), (0, 0))[1]:
                at = int(w.offsets[d])
                best[d, i] = float(cos[b, i] / size[b]), share, end, lo - at, hi - at
        for (d, i), x in best.items():
            yield row + d, i, *x


def _space(docs: DataFrame, rules: Rules) -> np.ndarray:
    """Latent vectors of the hashed words: idf times right singular vectors over singular values."""
    texts = docs.select("text", F.xxhash64("doc_id").alias("id")).where("text is not null")
    half = rules.window // 2
    df = np.zeros(D + 1)
    for w, n in texts.mapInArrow(_frequencies(half), "w long, n long").groupBy("w").agg(F.sum("n")).collect():
        df[w] = n
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32)
    vectors, sing = randomised_svd(texts, idf, half)
    scale = np.where(sing > sing.max() * 1e-6, 1 / np.maximum(sing, 1e-30), 0) * max(sing.max(), 1e-30)
    return np.ascontiguousarray(np.vstack([idf[:, None] * vectors * scale, np.zeros((1, RANK))]), np.float32)


def _tiles(docs: DataFrame, benchmark: DataFrame, rules: Rules, per_pass: int, answer: str | None) -> Iterator:
    spark: SparkSession = docs.sparkSession
    reply = F.lit(None).cast("string") if answer is None else col(answer)
    rows = benchmark.where("text is not null").select("item_id", "text", reply.alias("answer")).toLocalIterator()
    embed, tile = None, []
    for r in rows:
        tile.append(tuple(r))
        if len(tile) == per_pass:
            embed = _space(docs, rules) if embed is None else embed
            yield spark.sparkContext.broadcast((Items(tile, embed), embed))
            tile = []
    if tile or embed is None:
        embed = embed if embed is not None else _space(docs, rules) if tile else np.zeros((D + 1, RANK), np.float32)
        yield spark.sparkContext.broadcast((Items(tile, embed), embed))


def leaks(docs: DataFrame, benchmark: DataFrame, *, rules: Rules = Rules(), per_pass: int = 20_000, answer: str | None = None) -> DataFrame:
    """(doc_id, item_id, cosine, coverage, answer, first_word, end_word) of each document and item that it leaks."""

    def search(spread) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, embed = spread.value
            for b in batches:
                found = list(_matches(b.column(1), items, embed, rules))
                if found:
                    row, item, *rest = zip(*found)
                    ids = pa.array([items.ids[i] for i in item], pa.int64())
                    types = (pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), ids, *(pa.array(x, t) for x, t in zip(rest, types))], names)

        return run

    names = ["doc_id", "item_id", "cosine", "coverage", "answer", "first_word", "end_word"]
    schema = "doc_id long, item_id long, cosine double, coverage double, answer double, first_word long, end_word long"
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    out = None
    for spread in _tiles(docs, benchmark, rules, per_pass, answer):
        part = d.mapInArrow(search(spread), schema)
        out = part if out is None else out.union(part)
    return out


def _clean(spread, rules: Rules):
    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        items, embed = spread.value
        ok = np.ones(len(text), bool)
        for row, *_ in _matches(text, items, embed, rules):
            ok[row] = False
        return pa.array(ok)

    return clean


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, rules: Rules = Rules(), per_pass: int = 20_000, answer: str | None = None) -> DataFrame:
    """The rows of docs, all columns, whose text leaks no item; decided row by row, so nothing is joined."""
    (key,) = fresh(docs, "leaks")
    out = docs
    for spread in _tiles(docs, benchmark, rules, per_pass, answer):
        out = out.withColumn(key, _clean(spread, rules)(col("text"))).where(col(key)).drop(key)
    return out
