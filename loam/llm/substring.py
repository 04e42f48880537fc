"""Repeated passages: substring deduplication by MinHash banding of paragraphs.

Text needn't keep its line breaks, and passages are often copied into the midst
of other paragraphs, so paragraphs are cut by content: one of ``size`` words
starts at every word whose 4-gram hash is the least among ``reach`` words to
either side.  Copies of a passage are thus cut alike wherever they stand; a
paragraph is the set of its word pairs.

* Paragraphs of equal sets are one unit.  Signatures of MinHash values in bands
  (``tune`` picks as many as the wanted recall at the threshold takes) list
  units that collide.
* Each list links its units to its least and its greatest; exact Jaccard
  verifies; then all pairs of a list that lie in different components are
  verified too, in lists of more than ``short`` units those that share one of the list's rarer
  word pairs, as any that pass must.  So nothing is capped and near copies cost no square.
* Components of units are clusters.  Of a cluster's occurrences the first, by
  doc_id, text and place, stays.  The others lie along it: those of one text that are
  as far from the same first ones, with up to ``bridge`` words between, are a run.
* A run is extended to both ends, word by word against the first, up to ``along`` words: a match
  gains 1, a change loses 3, and it ends where 6 are lost.  Where runs touch they
  are one passage, and passages of at least ``min_words`` are reported.

Nulls: rows of null doc_id or text are left out.  Equal rows are one document; different
texts under one doc_id are each a document, told apart by their hash.  Texts of fewer than
``size`` words have no paragraph.  Very long texts are cut like others; a task holds one
text and its words.  Ties don't matter: equal paragraphs are ordered by place.  Empty tables give
empty results.  doc_ids are integers or can be cast to them.  Only doc_id and text are read;
``drop_passages`` passes on all columns and counts ``n_chars`` again where it is there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _kernel as K
from ._spark import col, components, cut, fresh, maybe_broadcast


def tune(threshold: float, recall: float, rows: int = 4) -> int:
    """The bands of so many rows that give the recall at the threshold."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def paragraph_starts(w: K.Words, size: int, reach: int) -> np.ndarray:
    """The words that start a paragraph."""
    n = len(w.hashes)
    if not n:
        return np.zeros(0, np.int64)
    h, ok = w.ngrams(4)
    h = np.where(ok, h >> K.U64(1), K.U64(0xFFFFFFFFFFFFFFFF))
    top = np.full(reach, 0xFFFFFFFFFFFFFFFF, K.U64)
    # texts are set apart, so that none bears on another's cuts
    text = w.text_of()
    wide = np.concatenate([top, h, top])
    owner = np.concatenate([np.full(reach, -1), text, np.full(reach, -1)])
    least = ok.copy()
    for j in range(1, reach + 1):
        for lo, strict in ((reach - j, True), (reach + j, False)):
            other = wide[lo : lo + n]
            less = h < other if strict else h <= other
            least &= less | (owner[lo : lo + n] != text)
    at = np.flatnonzero(least)
    return at[at + size <= w.offsets[1:][text[at]]]


def _paragraphs(text: pa.Array, size: int, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, hashes of the word pairs) of each run of paragraphs."""
    for lo, _, data, offs in K.chunks(text):
        w = K.words(data, offs)
        at = paragraph_starts(w, size, reach)
        if len(at):
            row = np.searchsorted(w.offsets, at, "right") - 1
            yield lo + row, at - w.offsets[row], w.ngrams(2)[0][at[:, None] + np.arange(size - 1)]


def _unit(pairs: np.ndarray) -> np.ndarray:
    """The hash of a paragraph's set: its distinct pairs, in order."""
    s = np.sort(pairs, 1)
    s[:, 1:][s[:, 1:] == s[:, :-1]] = 0
    return K.signed(K.mix(K.mix(s).sum(1, dtype=K.U64)))


def _listed(docs: DataFrame, size: int, reach: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, place, pairs in _paragraphs(b.column(1), size, reach):
                sig = np.stack([K.salted(pairs, i).min(1) for i in range(bands * rows)], 1).reshape(len(pairs), bands, rows)
                band = sig[..., 0]
                for r in range(1, rows):
                    band = K.mix(band) * K.U64(0x9FB21C651E98DF25) + sig[..., r]
                band = K.signed(K.mix(band + np.arange(bands, dtype=K.U64)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(band) + 1) * bands, pa.int32()), pa.array(band.ravel()))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(2).take(row), pa.array(place.astype(np.int32)), pa.array(_unit(pairs)), lists], ["doc_id", "t", "place", "unit", "bands"])

    return docs.select("doc_id", "text", "t").mapInArrow(run, "doc_id long, t long, place int, unit long, bands array<long>")


def _contents(docs: DataFrame, size: int, reach: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, pairs in _paragraphs(b.column(0), size, reach):
                unit, one = np.unique(_unit(pairs), return_index=True)
                flat = pa.array(K.signed(pairs[one]).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(unit), pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1) * (size - 1), pa.int32()), flat)], ["unit", "pairs"])

    return docs.select("text").mapInArrow(run, "unit long, pairs array<long>")


def _verified(pairs: DataFrame, contents: DataFrame, threshold: float, limit: int) -> DataFrame:
    pairs = cut(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    ids = cut(pairs.select(F.col("a").alias("unit")).union(pairs.select("b")).distinct(), "ids")
    few = maybe_broadcast(ids, ids.count(), 16, limit)
    c = cut(contents.join(few, "unit", "left_semi").groupBy("unit").agg(F.first("pairs").alias("pairs")), "contents")
    j = pairs.join(c.toDF("a", "pa"), "a").join(c.toDF("b", "pb"), "b")
    both = F.size(F.array_intersect("pa", "pb"))
    return cut(j.where(both / F.size(F.array_union("pa", "pb")) >= threshold).select("a", "b"), "verified")


def _alike(held: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of a list of (v, unit, c, p) that lie in different components and pass exact Jaccard."""
    both = F.size(F.array_intersect("pa", "pb"))
    j = held.toDF("v", "a", "ca", "pa").join(held.toDF("v", "b", "cb", "pb"), "v").where("a < b and ca <> cb")
    return j.where(both / F.size(F.array_union("pa", "pb")) >= threshold).select("a", "b")


def _rarest(held: DataFrame, threshold: float) -> DataFrame:
    """The same pairs of long lists.

    Units that pass share one of the rarest word pairs that the list has of either (prefix filter): of the
    smaller set, and of both if they are as large, as many as are left where the others make
    threshold's share of a set of the same size; of the larger set, of a smaller one."""
    e = held.select("v", "unit", "c", F.array_distinct("p").alias("p")).select("v", "unit", "c", F.size("p").alias("s"), F.explode("p").alias("e"))
    e = e.withColumn("df", F.count("*").over(Window.partitionBy("v", "e")))
    e = e.withColumn("r", F.row_number().over(Window.partitionBy("v", "unit").orderBy("df", "e")))
    e = e.withColumn("equal", F.col("r") <= F.col("s") - F.ceil(2 * threshold / (1 + threshold) * F.col("s") - 1e-9) + 1)
    e = e.where((F.col("r") <= F.col("s") - F.ceil(threshold * F.col("s") - 1e-9) + 1) & (F.col("df") > 1))
    by = Window.partitionBy("v", "e")
    e = e.withColumn("l", F.min("c").over(by)).withColumn("h", F.max("c").over(by)).where("l < h").select("v", "e", "unit", "c", "s", "equal")
    e = cut(e, "rarest")
    tasks = max(16, -(-e.count() // 20_000))
    one = e.where("equal").select("v", "e", "s", "unit", "c").repartition(tasks, "v", "e", "s")
    pairs = one.toDF("v", "e", "s", "a", "ca").join(one.toDF("v", "e", "s", "b", "cb"), ["v", "e", "s"]).where("a < b and ca <> cb").select("a", "b")
    less = one.toDF("v", "e", "sb", "b", "cb").repartition(tasks, "v", "e")
    more = e.select("v", "e", F.col("unit").alias("a"), F.col("c").alias("ca"), F.col("s").alias("sa")).repartition(tasks, "v", "e")
    other = more.join(less, ["v", "e"]).where((F.col("sa") > F.col("sb")) & (F.col("sb") >= threshold * F.col("sa") - 1e-9) & (F.col("ca") != F.col("cb"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pairs.union(other).distinct()
    p = cut(held.groupBy("unit").agg(F.first("p").alias("p")), "pairs")
    j = pairs.join(p.toDF("a", "pa"), "a").join(p.toDF("b", "pb"), "b")
    return j.where(F.size(F.array_intersect("pa", "pb")) / F.size(F.array_union("pa", "pb")) >= threshold).select("a", "b")


def _contexts(along: int):
    """Of (doc_id, t, text, before, after): 16 bits of each of the words before and after the places, away from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, offs in K.chunks(b.column(2)):
                w = K.words(data, offs)
                h = (w.hashes >> K.U64(48)).astype(np.uint16)
                rows, pos, side, ctx = [], [], [], []
                for i in range(len(offs) - 1):
                    mine = h[w.offsets[i] : w.offsets[i + 1]]
                    for s, c in ((0, 3), (1, 4)):
                        for p in b.column(c)[lo + i].as_py() or ():
                            rows.append(lo + i)
                            pos.append(p)
                            side.append(s)
                            ctx.append((mine[p : p + along] if s else mine[max(0, p - along) : p][::-1]).tobytes())
                if rows:
                    rows = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(pos, pa.int32()), pa.array(side, pa.int32()), pa.array(ctx, pa.binary())], ["doc_id", "t", "pos", "side", "ctx"])

    return run


def common(a: pa.Array, b: pa.Array, along: int, loss: int = 3, drop: int = 6) -> np.ndarray:
    """How far each pair of contexts goes on alike."""

    def table(x):
        raw = [np.frombuffer(y.as_buffer(), np.uint16) if y.is_valid else np.zeros(0, np.uint16) for y in x]
        size = np.array([len(y) for y in raw], np.int64)
        out = np.zeros((len(raw), along), np.uint16)
        out[np.repeat(np.arange(len(raw)), size), np.concatenate([np.arange(0), *map(np.arange, size)])] = np.concatenate([np.zeros(0, np.uint16), *raw])
        return out, size

    if not len(a):
        return np.zeros(0, np.int64)
    (x, n), (y, m) = table(a), table(b)
    inside = np.arange(along) < np.minimum(n, m)[:, None]
    score = np.cumsum(np.where(x == y, 1, -loss), 1)
    alive = inside & np.logical_and.accumulate(np.maximum(np.maximum.accumulate(score, 1), 0) - score <= drop, axis=1)
    score = np.where(alive, score, 0)
    return np.where(score.max(1) > 0, score.argmax(1) + 1, 0)


def _spans(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, t, intervals (start, end, keep)): the spans of passages of at least so many words; what is removed isn't kept."""
    for b in batches:
        rows, spans = [], []
        for i, parts in enumerate(b.column(2).to_pylist()):
            parts = sorted((p["s"], p["e"], p["keep"]) for p in parts)
            whole: list[list[int]] = []
            for s, e, _ in parts:
                if whole and s <= whole[-1][1]:
                    whole[-1][1] = max(whole[-1][1], e)
                else:
                    whole.append([s, e])
            gone: list[list[int]] = []
            for s, e, keep in parts:
                if not keep:
                    if gone and s <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], e)
                    else:
                        gone.append([s, e])
            j = 0
            for s, e in whole:
                mine = []
                while j < len(gone) and gone[j][0] < e:
                    mine.append(gone[j])
                    j += 1
                if e - s < least:
                    continue
                at = s
                for lo, hi in [*mine, [e, e]]:
                    if at < lo:
                        spans.append((at, lo, True))
                    if lo < hi:
                        spans.append((lo, hi, False))
                    at = hi
                rows += [i] * (len(spans) - len(rows))
        if rows:
            rows = pa.array(rows)
            s, e, keep = zip(*spans)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(keep)], ["doc_id", "t", "start_word", "end_word", "keep"])


def _repeats(docs: DataFrame, *, size: int = 16, reach: int = 6, threshold: float = 0.75, recall: float = 0.95, bridge: int = 32, along: int = 48, min_words: int = 40, short: int = 16, broadcast_limit: int = 64 << 20) -> DataFrame:
    """(doc_id, t, start_word, end_word, keep): spans, with the hash of the text in which they are."""
    d = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    bands = tune(threshold, recall)
    made = _listed(d, size, reach, bands, 4)
    units = cut(made.select("doc_id", "t", "place", "unit"), "units")
    by = Window.partitionBy("v")
    rows = made.select("unit", F.explode("bands").alias("v"))
    ends = rows.withColumn("lo", F.min("unit").over(by)).withColumn("hi", F.max("unit").over(by)).where("lo < hi")
    listed = cut(ends.select("v", "unit", "lo", "hi").distinct(), "listed")
    star = listed.select(F.col("lo").alias("a"), F.col("unit").alias("b")).union(listed.select("unit", "hi")).where("a < b").distinct()
    contents = _contents(d, size, reach)
    first = _verified(star, contents, threshold, broadcast_limit)
    comp = cut(components(first), "components")
    lab = listed.select("v", "unit").join(comp.withColumnRenamed("id", "unit"), "unit", "left").select("v", "unit", F.coalesce("root", "unit").alias("c"))
    lab = cut(lab.withColumn("l", F.min("c").over(by)).withColumn("h", F.max("c").over(by)).where("l < h").select("v", "unit", "c"), "mixed")
    # verified as they are joined, so that pairs with only a phrase in common are never written
    ids = cut(lab.select("unit").distinct(), "ids")
    few = maybe_broadcast(ids, ids.count(), 16, broadcast_limit)
    held = lab.join(contents.join(few, "unit", "left_semi").groupBy("unit").agg(F.first("pairs").alias("p")), "unit").select("v", "unit", "c", "p")
    held = cut(held, "held")
    lengths = cut(held.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > short), "long")
    big = maybe_broadcast(lengths.select("v"), lengths.count(), 16, broadcast_limit)
    second = _alike(held.join(big, "v", "left_anti"), threshold).union(_rarest(held.join(big, "v", "left_semi"), threshold))
    second = cut(second.distinct(), "verified")
    if not second.isEmpty():
        comp = cut(components(first.union(second)), "components")

    # every occurrence with the first of its cluster
    small = maybe_broadcast(comp.withColumnRenamed("id", "unit"), comp.count(), 24, broadcast_limit)
    occ = units.join(small, "unit", "left").select("doc_id", "t", "place", F.coalesce("root", "unit").alias("c"))
    at = F.struct("doc_id", "t", "place")
    firsts = occ.groupBy("c").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select("c", "first")
    occ = occ.join(cut(firsts, "firsts"), "c").where(at != F.col("first")).distinct()
    key = ["doc_id", "t", "fd", "ft", "d"]
    occ = occ.select("doc_id", "t", "place", F.col("first.doc_id").alias("fd"), F.col("first.t").alias("ft"), (F.col("place") - F.col("first.place")).alias("d"))
    order = Window.partitionBy(*key).orderBy("place")
    occ = occ.withColumn("new", F.coalesce(F.col("place") > F.lag("place").over(order) + size + bridge, F.lit(True)).cast("int"))
    runs = occ.withColumn("run", F.sum("new").over(order)).groupBy(*key, "run").agg(F.min("place").alias("s"), (F.max("place") + size).alias("e"))
    runs = cut(runs.drop("run"), "runs")

    # what stands before and after the runs, there and at the first
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("s").alias("pos")), F.struct(F.lit(1).alias("side"), F.col("e").alias("pos")))).alias("end")
    ends = runs.select("*", side).select(*key, "s", "e", "end.side", "end.pos", (F.col("end.pos") - F.col("d")).alias("fpos"))
    want = ends.select("doc_id", "t", "side", "pos").union(ends.select("fd", "ft", "side", "fpos")).distinct()
    want = want.groupBy("doc_id", "t").agg(F.collect_list(F.when(F.col("side") == 0, F.col("pos"))).alias("before"), F.collect_list(F.when(F.col("side") == 1, F.col("pos"))).alias("after"))
    want = cut(want, "want")
    bytes_ = want.agg(F.sum(32 + 4 * (F.size("before") + F.size("after")))).first()[0] or 0
    texts = d.join(maybe_broadcast(want, 1, bytes_, broadcast_limit), ["doc_id", "t"]).select("doc_id", "t", "text", "before", "after")
    ctx = texts.mapInArrow(_contexts(along), "doc_id long, t long, pos int, side int, ctx binary")
    ctx = cut(ctx.dropDuplicates(["doc_id", "t", "pos", "side"]), "contexts")

    @F.arrow_udf("int")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(common(a, b, along), pa.int32())

    far = ends.join(ctx.withColumnRenamed("ctx", "x"), ["doc_id", "t", "side", "pos"]).join(ctx.toDF("fd", "ft", "fpos", "side", "y"), ["fd", "ft", "side", "fpos"])
    far = far.select(*key, "s", "e", "side", alike("x", "y").alias("n")).groupBy(*key, "s", "e").agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("r"))
    far = cut(far, "far")
    gone = far.select("doc_id", "t", (F.col("s") - F.col("l")).alias("s"), (F.col("e") + F.col("r")).alias("e"), F.lit(False).alias("keep"))
    d0 = F.col("d")
    kept = far.groupBy("fd", "ft", (F.col("s") - d0).alias("s"), (F.col("e") - d0).alias("e")).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    kept = kept.select("fd", "ft", F.col("s") - F.col("l"), F.col("e") + F.col("r"), F.lit(True))
    parts = gone.union(kept).groupBy("doc_id", "t").agg(F.collect_set(F.struct("s", "e", "keep")).alias("parts"))
    return parts.mapInArrow(lambda batches: _spans(batches, min_words), "doc_id long, t long, start_word long, end_word long, keep boolean")


def repeated_passages(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, start_word, end_word, keep): the spans that repeat; keep is true for a passage's first occurrence."""
    return _repeats(docs, **params).drop("t")


def drop_passages(docs: DataFrame, **params) -> DataFrame:
    """docs with the removed spans cut out of their texts and n_chars counted again; all other columns and rows as they are."""
    key, whole, drop = fresh(docs, "doc", "text", "spans")
    spans = _repeats(docs, **params).where("not keep").groupBy("doc_id", "t").agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias(drop))
    spans = cut(spans.toDF(key, whole, drop), "spans")
    bytes_ = spans.agg(F.sum(48 + 16 * F.size(drop))).first()[0] or 0
    spans = maybe_broadcast(spans, 1, bytes_, params.get("broadcast_limit", 64 << 20))

    @F.arrow_udf("string")
    def without(text: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for x, g in zip(text.to_pylist(), gone.to_pylist()):
            if x is not None and g:
                raw = x.encode()
                w = K.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                parts, at = [], 0
                for s in g:
                    lo, hi = int(w.starts[s["start_word"]]), int(w.ends[s["end_word"] - 1])
                    parts.append(raw[at:lo])
                    at = max(at, hi)
                x = b"".join([*parts, raw[at:]]).decode()
            out.append(x)
        return pa.array(out, pa.string())

    j = docs.join(spans, (col("doc_id").cast("long") == F.col(key)) & (F.xxhash64(col("text")) == F.col(whole)), "left")
    j = j.withColumn(whole, F.when(F.col(drop).isNull(), col("text")).otherwise(without(col("text"), F.col(drop))))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col(whole).alias("text"))
        elif c == "n_chars":
            out.append(F.when(F.col(drop).isNull(), col(c)).otherwise(F.length(whole).cast(docs.schema[c].dataType)).alias(c))
        else:
            out.append(col(c))
    return j.select(*out)
