"""Related-document packing: training windows filled along paths of a nearest-neighbour graph.

As in in-context pretraining (Shi et al. 2023) a document is followed by one
that is near to it.  Nearness is the number of values that two documents'
bottom-k shingle sketches share; sketches of one hash function keep the same
shingles of related texts, so their inverted lists hold all pairs that share
any.

* Each document's ``neighbours`` heaviest pairs are its nearest; which of equal
  weight isn't fixed.  Lists of up to ``short`` documents give all their pairs,
  weighed by all that the two share.  For what only longer lists hold, there is an index:
  documents of one set of such values are together, and the sets stand in each of their
  lists in two orders, by their other values from the rarest or from the commonest on, like
  the tries of an LSH forest (Bawa, Condie and Ganesan 2005).  A set of at most ``neighbours``
  documents, which could find nearer ones in other sets, meets the ``reach`` next
  of each list and order, either way; a set of more finds all it can share in
  itself.
* That only gives bounds.  What a document shares with its last neighbour so far is what a nearer
  one must share more than, so one of the values that both hold is among all but so many of its rarest,
  and the whole lists of these are read (prefix filter).  The nearest are those of all pairs,
  whatever ``short`` and ``reach`` are.
* Pieces of the graph, in which every document is with its nearest neighbour, are
  walked apart: a path starts at the unvisited
  document of the least degree and goes to the nearest unvisited neighbour (of
  equal ones that of lower degree, then the earlier) till there is none.  All other edges,
  heaviest and then of least degree first, join paths whose ends they link, so
  components of any size are covered by the same rule and no edge is left out.
* Paths are laid end to end in bins of about ``bin_docs`` documents, legs of half as
  many of a long path at a time, and cut
  into windows of ``window`` words: full ones, but for the last of each bin.
  A document that goes over a window's end goes on in the next.

Nothing is dropped or cut off: every word of every document is in one window.

Nulls: null and empty texts have no words and so are in no window; a null
doc_id is listed as null.  Repeated rows are packed once per row.  Documents
without shared shingles are paths of their own.  An empty table gives no
windows.  Very long texts go on over as many windows as they fill.  Ties follow the
order of the rows in the files.  Extra columns aren't read; doc_ids are integers or
can be cast to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _kernel as K
from ._spark import components, cut, maybe_broadcast
from .neardup import _lists, shingle_sets

_PART = 1000  # rows of a set's parts


def _sketch(k: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [K.words(data, offs).counts() for _, _, data, offs in K.chunks(b.column(1))]
            least = [s[:k] for s in shingle_sets(b.column(1), shingle)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([*words, np.zeros(0, np.int64)]), pa.int64()), _lists(least)], ["doc_id", "n", "sketch"])

    return run


def _nearest(links: DataFrame, neighbours: int) -> DataFrame:
    """(a, b, weight, r): of links (a, b, weight) both ways, the heaviest of each a; a pair may come thrice, and its greatest weight counts."""
    order = F.desc("weight"), F.xxhash64(F.least("a", "b"), F.greatest("a", "b"))
    by = Window.partitionBy("a").orderBy(*order)
    some = links.withColumn("r", F.row_number().over(by)).where(F.col("r") <= 3 * neighbours)
    return some.groupBy("a", "b").agg(F.max("weight").alias("weight")).withColumn("r", F.row_number().over(by)).where(F.col("r") <= neighbours)


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b", "weight").union(links.select("b", "a", "weight"))


def _beside(reach: int):
    """Of sets (o, v, g, hot, need) in order of the lists: each with the next and last ``reach`` of its list, and how many values both hold, where that is over ``need``.

    The first and the last rows of a task come out once more, with h null, as their lists may go on in another task."""

    def pairs(o, v, g, hot, size, need):
        for j in range(1, reach + 1):
            at = np.flatnonzero((v[:-j] == v[j:]) & (o[:-j] == o[j:]) & (g[:-j] != g[j:]))
            for lo in range(0, len(at), 1 << 12):
                i = at[lo : lo + (1 << 12)]
                wide = max(int(size[i].max()), int(size[i + j].max()))
                x, y = hot[i][:, :wide], hot[i + j][:, :wide]
                same = (x[:, :, None] == y[:, None, :]) & (np.arange(wide)[None, :, None] < size[i][:, None, None]) & (np.arange(wide)[None, None, :] < size[i + j][:, None, None])
                w = same.sum((1, 2)).astype(np.int64)
                for x, y in ((i, i + j), (i + j, i)):
                    good = w > need[x]
                    yield g[x][good], g[y][good], w[good]

    def table(b: pa.RecordBatch, width: int):
        lists = b.column(3)
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        hot = np.zeros((len(size), width), np.int64)
        hot[np.repeat(np.arange(len(size)), size), np.concatenate([np.arange(0), *map(np.arange, size)])] = lists.flatten().to_numpy()
        return [*(b.column(i).to_numpy() for i in range(3)), hot, size, b.column(4).to_numpy()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, none = ["g", "h", "weight", "o", "v", "hot", "need"], pa.array([], pa.list_(pa.int64()))
        held, first, edge = None, 0, []

        def edges(t):
            o, v, g, hot, size, need = t
            return pa.RecordBatch.from_arrays([pa.array(g), pa.nulls(len(g), pa.int64()), pa.nulls(len(g), pa.int64()), pa.array(o), pa.array(v), pa.array([x[:n].tolist() for x, n in zip(hot, size)], pa.list_(pa.int64())), pa.array(need)], names)

        for b in batches:
            if not b.num_rows:
                continue
            new = table(b, 64)
            if first < reach:
                edge.append(edges([x[: reach - first] for x in new]))
                first += b.num_rows
            rows = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            for x, y, w in pairs(*rows):
                n = len(x)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(w), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, none.type), pa.nulls(n, pa.int32())], names)
            held = [x[-reach:] for x in rows]
        yield from edge
        if held is not None:
            yield edges(held)

    return run


def _needs(sets: DataFrame, long: DataFrame, near: DataFrame, neighbours: int) -> DataFrame:
    """Sets with what another must share more than: of few rows what the last neighbour so far of one does, of more rows all."""
    last = near.where(F.col("r") == neighbours).select(F.col("a").alias("row"), F.col("weight").alias("last"))
    few = long.where(F.col("size") <= neighbours).join(last, "row", "left").groupBy("g").agg(F.min(F.coalesce("last", F.lit(0))).cast("int").alias("need"))
    return cut(sets.select("g", "hot", "size").join(few, "g", "left").select("g", "hot", "size", F.coalesce("need", F.size("hot")).alias("need")), "sets")


def _rest(sets: DataFrame, asked: int = 1000) -> DataFrame:
    """(g, h, weight) of all sets that share more than g's need.

    Values are in one order, so with the first that both hold all of them are in the two sets' ends from there on.
    ``asked`` sets are held against a list at a time."""
    s = F.size("hot")
    listed = sets.select("g", "need", "hot", s.alias("s"), F.posexplode("hot").alias("i", "v"))
    listed = listed.select("g", "need", "v", (F.col("s") - F.col("i")).alias("left"), F.expr("slice(hot, i + 1, s - i)").alias("end"))
    asks = listed.where("left > need")
    parts = asks.groupBy("v").agg(F.ceil(F.count("*") / asked).alias("parts"), F.min("need").alias("least"))
    asks = asks.join(parts, "v").select("v", F.pmod(F.xxhash64("g"), F.col("parts")).alias("part"), "g", "need", "end")
    to = listed.join(parts, "v").where(F.col("left") > F.col("least"))
    to = to.select("v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("g").alias("h"), "left", F.col("end").alias("other"))
    both = asks.join(to, ["v", "part"]).where("left > need and g <> h")
    both = both.select("g", "h", "need", F.size(F.array_intersect("end", "other")).cast("long").alias("weight")).where(F.col("weight") > F.col("need"))
    return both.groupBy("g", "h").agg(F.max("weight").alias("weight"))


def _across(met: DataFrame, sets: DataFrame, long: DataFrame, neighbours: int) -> DataFrame:
    """(a, b, weight) both ways of the rows of sets (g, h, weight), as many as are wanted of those that share most with g."""
    met = met.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("weight"), F.xxhash64("g", "h")))).where(F.col("r") <= neighbours)
    met = met.join(sets.select(F.col("g").alias("h"), "size"), "h")
    # not the same rows for all
    part = F.pmod(F.xxhash64("g", F.lit(5)), F.ceil(F.col("size") / _PART))
    turn = F.expr(f"transform(sequence(0, cast(least(size, {neighbours}) as int) - 1), j -> cast(pmod(xxhash64(g) + j, least(size, {_PART // 4})) as int))")
    met = met.select("g", "h", "weight", part.alias("part"), F.explode(turn).alias("at"))
    to = long.select(F.col("g").alias("h"), "part", "at", F.col("row").alias("b"))
    return _both(met.join(to, ["h", "part", "at"]).join(long.select("g", F.col("row").alias("a")), "g"))


def neighbour_graph(rows: DataFrame, *, neighbours: int = 6, short: int = 64, reach: int = 8, broadcast_limit: int = 64 << 20) -> DataFrame:
    """(a, b, weight) both ways, of rows (row, sketch) of up to 64 values: pairs of which one is among the other's nearest."""
    values = rows.select("row", F.explode("sketch").alias("v"))
    values = cut(values.withColumn("n", F.count("*").over(Window.partitionBy("v"))).where("n > 1"), "values")

    # all pairs of the short lists, with what they share of the long ones
    cold = values.where(F.col("n") <= short).select("v", "row")
    pairs = cold.toDF("v", "a").join(cold.toDF("v", "b"), "v").where("a < b").repartition("a").groupBy("a", "b").agg(F.count("*").alias("c"))
    # rows by the set of their values that have long lists, rarest first
    long = values.where(F.col("n") > short).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("s"))
    long = cut(long.select("row", F.col("s.v").alias("hot")).withColumn("g", F.xxhash64("hot")), "hot")
    bytes_ = long.agg(F.sum(32 + 8 * F.size("hot"))).first()[0] or 0
    hot = maybe_broadcast(long.select("row", "hot"), 1, bytes_, broadcast_limit)
    pairs = pairs.join(hot.toDF("a", "ha"), "a", "left").join(hot.toDF("b", "hb"), "b", "left")
    pairs = pairs.select("a", "b", (F.col("c") + F.coalesce(F.size(F.array_intersect("ha", "hb")), F.lit(0))).alias("weight"))

    # rows of one set: enough of them share it whole; sets of many rows lie in parts of about _PART rows
    sets = cut(long.groupBy("g").agg(F.first("hot").alias("hot"), F.count("*").alias("size")), "sets")
    long = long.select("row", "g").join(sets.select("g", "size", F.size("hot").cast("long").alias("weight")), "g")
    long = long.withColumn("part", F.pmod(F.xxhash64("row", F.lit(3)), F.ceil(F.col("size") / _PART)))
    by = Window.partitionBy("g", "part").orderBy(F.xxhash64("row"), "row")
    long = cut(long.withColumn("at", F.row_number().over(by) - 1).withColumn("next", F.when(F.col("size") > 1, F.array(*(F.lead("row", j).over(by) for j in range(1, neighbours + 1))))), "long")
    same = long.where("size > 1").select(F.col("row").alias("a"), F.explode("next").alias("b"), "weight").where("b is not null")
    near = cut(_nearest(_both(pairs.union(same)), neighbours), "near")

    # sets of few rows need others with which they share more than the last neighbour so far does
    sets = _needs(sets, long, near, neighbours)

    # those beside them in the lists, in two orders of what they hold besides
    v = F.explode("hot").alias("v")
    rest = F.array_remove("hot", F.col("v"))
    keys = [F.get(rest, F.lit(i)) for i in range(3)], [F.get(F.reverse(rest), F.lit(i)) for i in range(3)]
    columns = ["o", "v", "g", "hot", "need"]
    listed = sets.select("g", "hot", "need", v)
    lists = [listed.select(F.lit(o).cast("int").alias("o"), *columns[1:], *(c.alias(f"r{i}") for i, c in enumerate(k))) for o, k in enumerate(keys)]
    lists = cut(lists[0].union(lists[1]), "lists")
    schema = "g long, h long, weight long, o int, v long, hot array<long>, need int"
    order = ["o", "v", "r0", "r1", "r2", "g"]
    tasks = max(1, -(-lists.count() // 100_000))
    beside = lists.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select(*columns).mapInArrow(_beside(reach), schema)
    beside = cut(beside, "beside")
    ends = beside.where("h is null").select(*columns).distinct()
    ends = ends.select("*", *(F.when(F.col("o") == 0, a).otherwise(b).alias(f"r{i}") for i, (a, b) in enumerate(zip(*keys))))
    ends = ends.repartition(1).sortWithinPartitions(*order).select(*columns).mapInArrow(_beside(reach), schema)
    met = beside.union(ends).where("h is not null").select("g", "h", "weight").distinct()
    near = cut(_nearest(near.select("a", "b", "weight").union(_across(met, sets, long, neighbours)), neighbours), "near")

    # the whole lists, where a set could share more yet
    sets = _needs(sets, long, near, neighbours)
    best = _nearest(near.select("a", "b", "weight").union(_across(_rest(sets), sets, long, neighbours)), neighbours)
    kept = cut(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").distinct(), "neighbours")
    return kept.union(kept.select("b", "a", "weight"))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of edges between paths' ends, heaviest first: how the paths are joined, as (to, part, sign, plus) of each."""
    size, link, root = {}, {}, {}

    def find(p: int) -> int:
        while root.setdefault(p, p) != p:
            root[p] = p = root[root[p]]
        return p

    for b in batches:
        for pa_, pb, at_a, at_b, last_a, last_b in zip(*(c.to_pylist() for c in b.columns)):
            ends = []
            for p, at, last in ((pa_, at_a, last_a), (pb, at_b, last_b)):
                size[p] = last
                # a path of one row has both ends there
                ends.append(next(((p, e) for e in ((0, 1) if not last else (int(at > 0),)) if (p, e) not in link), None))
            if None not in ends and find(pa_) != find(pb):
                root[find(pb)] = find(pa_)
                link[ends[0]], link[ends[1]] = ends[1], ends[0]
    out, seen = [], set()
    for p in sorted(size):
        enter = 0 if (p, 0) not in link else 1
        if p in seen or (p, enter) in link:
            continue
        to, plus, at = p, 0, (p, enter)
        while at is not None:
            q, e = at
            seen.add(q)
            out.append((to, q, -1, plus + size[q]) if e else (to, q, 1, plus))
            plus += size[q] + 1
            at = link.get((q, 1 - e))
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], ["to", "part", "sign", "plus"])


def joined(walked: DataFrame, edges: DataFrame, *, one_task: int = 200_000) -> DataFrame:
    """(row, part, place) of walked paths (row, path, place) that are joined end to end over the heaviest edges (a, b, weight).

    Edges are taken in one order, by weight and then the least degrees, where both
    ends are ends of different paths.  In each round paths are joined over the edges that are
    the first of both, which gives the same paths, till ``one_task`` edges between ends are left
    at most; one task takes those in order.  Only ends and lengths of paths go through the rounds.
    """
    sizes = walked.groupBy("path").agg(F.max("place").alias("end"))
    paths = cut(sizes.select("path", F.col("path").alias("part"), F.lit(1).cast("long").alias("sign"), F.lit(0).cast("long").alias("plus"), F.col("end").alias("last")), "paths")
    tips = cut(walked.join(sizes, "path").where("place = 0 or place = end").select("row", "path", "place"), "tips")
    degree = edges.select(F.explode(F.array("a", "b")).alias("row")).groupBy("row").agg(F.count("*").alias("d")).join(tips.select("row"), "row", "left_semi")
    e = edges.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
    e = cut(e.select("a", "b", F.struct("weight", (-F.col("da") - F.col("db")).alias("free"), F.xxhash64("a", "b").alias("h")).alias("w")), "edges")
    last = False
    while not last:
        ends = tips.join(paths, "path").select("row", "part", (F.col("plus") + F.col("sign") * F.col("place")).alias("place"), "last").where("place = 0 or place = last")
        e = e.select("a", "b", "w").join(ends.toDF("a", "pa", "at_a", "last_a"), "a").join(ends.toDF("b", "pb", "at_b", "last_b"), "b")
        e = cut(e.where("pa <> pb"), "live")
        last = e.count() <= one_task
        if last:
            rest = e.repartition(1).sortWithinPartitions(F.desc("w"), "a", "b").select("pa", "pb", "at_a", "at_b", "last_a", "last_b")
            moves = rest.mapInArrow(_linked, "to long, part long, sign long, plus long")
        else:
            best = e.select(F.col("pa").alias("p"), "w", "a", "b").union(e.select("pb", "w", "a", "b")).groupBy("p").agg(F.max_by(F.struct("a", "b"), F.struct("w", -F.col("a"), -F.col("b"))).alias("e"))
            pick = best.select("p", "e.a", "e.b")
            both = e.join(pick.withColumnRenamed("p", "pa"), ["pa", "a", "b"]).join(pick.withColumnRenamed("p", "pb"), ["pb", "a", "b"])
            # the path of a ends with it, that of b follows and begins with it
            one, after = F.lit(1).cast("long"), F.col("last_a") + 1
            head = F.when(F.col("at_a") == F.col("last_a"), F.struct(one.alias("sign"), (one - 1).alias("plus"))).otherwise(F.struct((-one).alias("sign"), F.col("last_a").alias("plus")))
            tail = F.when(F.col("at_b") == 0, F.struct(one.alias("sign"), after.alias("plus"))).otherwise(F.struct((-one).alias("sign"), (after + F.col("last_b")).alias("plus")))
            moves = both.select(F.col("pa").alias("to"), F.explode(F.array(F.struct(F.col("pa").alias("part"), head.alias("t")), F.struct(F.col("pb").alias("part"), tail.alias("t")))).alias("m"))
            moves = moves.select("to", "m.part", "m.t.sign", "m.t.plus")
        moves = cut(moves.toDF("to", "part", "turn", "add"), "moves")
        sums = moves.join(paths.groupBy("part").agg(F.first("last").alias("last")), "part").groupBy("to").agg((F.sum(F.col("last") + 1) - 1).alias("total"))
        paths = paths.join(moves.join(sums, "to"), "part", "left")
        turn = F.coalesce("turn", F.lit(1).cast("long"))
        paths = cut(paths.select("path", F.coalesce("to", "part").alias("part"), (turn * F.col("sign")).alias("sign"), (F.coalesce("add", F.lit(0).cast("long")) + turn * F.col("plus")).alias("plus"), F.coalesce("total", "last").alias("last")), "paths")
    return walked.join(paths, "path").select("row", "part", (F.col("plus") + F.col("sign") * F.col("place")).alias("place"))


def walk(part: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> list[list[int]]:
    """Greedy paths of whole pieces from their edges, each both ways."""
    rows, at, degree = np.unique(a, return_inverse=True, return_counts=True)
    to = np.searchsorted(rows, b)
    near = to[np.lexsort((to, degree[to], -weight, at))].tolist()
    ends = np.cumsum(degree).tolist()
    of = np.zeros(len(rows), part.dtype)
    of[at] = part
    seen, paths, degree = bytearray(len(rows)), [], degree.tolist()
    for i in np.lexsort((rows, degree, of)).tolist():
        if seen[i]:
            continue
        path = []
        while i is not None:
            seen[i] = 1
            path.append(i)
            i = next((j for j in near[ends[i] - degree[i] : ends[i]] if not seen[j]), None)
        paths.append(rows[path].tolist())
    return paths


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of edges (part, a, b, weight) sorted by piece: (row, path, place) of each row, a path by its first row."""

    def done(*columns):
        paths = walk(*columns)
        size = [len(p) for p in paths]
        place = np.concatenate([np.zeros(0, np.int64), *map(np.arange, size)])
        return pa.RecordBatch.from_arrays([pa.array([r for p in paths for r in p], pa.int64()), pa.array(np.repeat([p[0] for p in paths], size), pa.int64()), pa.array(place, pa.int64())], ["row", "path", "place"])

    held: list[list[np.ndarray]] = []
    n = most = 0
    for b in batches:
        held.append([c.to_numpy() for c in b.columns])
        n += b.num_rows
        if n > most:
            x = [np.concatenate(c) for c in zip(*held)]
            whole = int(np.searchsorted(x[0], x[0][-1])) if n else 0
            if whole:
                yield done(*(c[:whole] for c in x))
            held, n = [[c[whole:] for c in x]], n - whole
            most = max(200_000, 2 * n)
    if n:
        yield done(*(np.concatenate(c) for c in zip(*held)))


def paths(edges: DataFrame, *, piece: int = 100_000) -> DataFrame:
    """(row, part, place) on paths of a graph's rows, of edges (a, b, weight) both ways.

    Each row and its nearest neighbour are in one piece, which one task walks;
    a piece of more than ``piece`` rows goes in parts.  All edges between pieces or parts
    then join paths where they meet their ends."""
    order = F.struct("weight", F.xxhash64(F.least("a", "b"), F.greatest("a", "b")))
    nearest = edges.groupBy("a").agg(F.max_by("b", order).alias("b"))
    comp = cut(components(nearest), "pieces")
    sizes = comp.groupBy("root").agg(F.ceil(F.count("*") / piece).alias("parts"))
    of = cut(comp.join(sizes, "root").select(F.col("id").alias("a"), F.xxhash64("root", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("part")), "parts")
    both = cut(edges.join(of, "a").join(of.toDF("b", "pb"), "b"), "inside")
    inside = both.where("part = pb").select("part", "a", "b", "weight")
    walked = inside.repartition(max(8, -(-inside.count() // 200_000)), "part").sortWithinPartitions("part").mapInArrow(_walks, "row long, path long, place long")
    walked = cut(walked, "walked")
    # rows without neighbours in their part
    alone = of.select(F.col("a").alias("row")).join(walked.select("row"), "row", "left_anti").select("row", F.col("row").alias("path"), F.lit(0).cast("long").alias("place"))
    return joined(cut(walked.union(alone), "walked"), edges.where("a < b"))


def pack_related(docs: DataFrame, *, window: int = 2048, k: int = 24, shingle: int = 3, neighbours: int = 6, piece: int = 100_000, bin_docs: int = 20_000) -> DataFrame:
    """(bin, window, n_words, doc_ids, starts, ends): per window the documents in order, with the words [start, end) of each."""
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketch(k, shingle), "doc_id long, n long, sketch array<long>")
    rows = cut(rows.where("n > 0").select(F.monotonically_increasing_id().alias("row"), "*"), "rows")
    edges = cut(neighbour_graph(rows, neighbours=neighbours), "edges")
    walked = paths(edges, piece=piece)

    n = rows.count()
    placed = rows.select("row", "doc_id", "n").join(walked, "row", "left")
    placed = placed.withColumn("part", F.coalesce("part", "row")).withColumn("place", F.coalesce("place", F.lit(0)))
    bins = max(1, -(-n // bin_docs))
    # long paths go on in another bin
    placed = placed.withColumn("leg", F.expr(f"place div {max(1, bin_docs // 2)}"))
    placed = placed.withColumn("bin", F.pmod(F.xxhash64("part", "leg"), F.lit(bins)))
    run = F.sum("n").over(Window.partitionBy("bin").orderBy("part", "leg", "place", "row").rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("end", run).withColumn("begin", F.col("end") - F.col("n"))
    w = F.lit(window).cast("long")
    cuts = placed.select("bin", "doc_id", "begin", "end", F.explode(F.sequence(F.expr(f"begin div {window}"), F.expr(f"(end - 1) div {window}"))).alias("window"))
    lo, hi = F.greatest("begin", F.col("window") * w), F.least("end", (F.col("window") + 1) * w)
    pieces = cuts.select("bin", "window", F.struct(lo.alias("at"), "doc_id", (lo - F.col("begin")).alias("start"), (hi - F.col("begin")).alias("stop")).alias("p"))
    packed = pieces.groupBy("bin", "window").agg(F.array_sort(F.collect_list("p")).alias("p"))
    n_words = F.aggregate("p", F.lit(0).cast("long"), lambda t, x: t + x["stop"] - x["start"])
    return packed.select("bin", "window", n_words.alias("n_words"), F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"), F.col("p.stop").alias("ends"))
