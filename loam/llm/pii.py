"""Personal data by bootstrapped contextual extraction.

Seed entities, those that strict recognisers accept (addresses, card numbers with
a valid check digit, IPv4, telephone numbers, secrets that are assigned to a name,
access keys), induce lexical patterns: what stands before an entity, one, two or
three tokens, or after it, one or two, each with the entity's shape or its coarser shape;
the shape alone; and two or three tokens before it whatever the entity looks like.
Spark scores the graph of patterns and instances by turns (as in DIPRE and Snowball:
Brin 1998; Agichtein and Gravano 2000):

* a pattern's confidence is the sum of its distinct instances' over their
  number plus ``prior``, and it counts from ``accept`` on if at least ``least`` of
  them are seeds;
* an instance's is 1 - the product of 1 - its patterns', and 1 for seeds;

until no further pattern is accepted and the mean confidence stands still to a hundredth.

Instances are found in two ways.  Runs of letters, digits and the signs of identifiers that have a
digit or an at sign are candidates at once; they end at any other sign and where ASCII ends, so
identifiers in CSV, JSON, URLs or Chinese text are found too, and may be of any length.
Numbers that are written in groups are searched as a whole.  Two or three tokens before an entity,
whatever it looks like, are first held against all texts: the distinct words without digits that follow
them count as instances without confidence, so a context that words follow at will is none.
What follows a context that stands the test, a word or some capitalised ones, is an instance
from then on.  That ends when no context is new.

What accepted patterns match is reported, recognised by a seed or not.  Only candidates are
shuffled.  Patterns and instances stay tables of any size, known by 64-bit hashes; contexts
are broadcast in parts of at most ``contexts_a_pass``.

Nulls: a null text has no candidates, a null doc_id is passed on.  A doc_id's entity
at a place is reported once, so repeated rows report theirs once; an entity that occurs twice in a text is
reported at each place, and is one instance.  Texts are read whole.  Ties: of kinds
that a pattern's instances have equally often any may be its own.  Empty tables give empty results.  doc_ids
are integers or can be cast to them; extra columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._spark import cut

_FLAG = np.zeros(256, bool)
_FLAG[[*b"0123456789@"]] = True
#: the bytes of identifiers
_ID = np.zeros(256, bool)
_ID[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_.+-@%"]] = True
_PART = re.compile(r"\+?[0-9][0-9.\-]*")
_BETWEEN = {b" ", b"(", b")", b" (", b") ", b"/"}
_RUN = re.compile(r"[0-9A-Za-z]+")
_ENDS = re.compile(r"^[_.%@-]+|[_.%@+-]+$")
_NAME = re.compile(rb"[A-Z][A-Za-z]*(?: [A-Z][A-Za-z]*(?![0-9A-Za-z@]))*")

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_IP = re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)")
_PHONE = re.compile(r"(?<![0-9])\+\d{1,3} ?\(?\d{2,4}\)? ?\d{3,4}[- ]?\d{3,4}(?![0-9])")
_CARD = re.compile(r"(?<![0-9])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![0-9])")
_ACCESS = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}")
_HEX = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[0-9A-Za-z_\-]{16,}")
_ASSIGNED = re.compile(r"""(?i)(?:token|key|secret|password|passwd|pwd)["']?\s*[=:]\s*["']?$""")
_VERSION = re.compile(r"(?i)\b(?:v|ver|version|release|firmware)\.?\s*$")
_NEAR = 64  # bytes before an entity that tell what it is assigned to


def luhn(digits: str) -> bool:
    d = [int(c) for c in digits[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def seed_kind(entity: str, before: str) -> str | None:
    """The kind of a seed entity, None if no recogniser accepts it."""
    if "@" in entity:
        return "email" if _EMAIL.fullmatch(entity) else None
    if _IP.fullmatch(entity):
        return None if _VERSION.search(before) else "ip"
    if _PHONE.fullmatch(entity):
        return "phone"
    if _CARD.fullmatch(entity):
        digits = re.sub("[ -]", "", entity)
        return "card" if len(digits) <= 19 and luhn(digits) else None
    if _ACCESS.fullmatch(entity) or _HEX.fullmatch(entity) and _ASSIGNED.search(before):
        return "secret"
    return None


def shape(entity: str) -> str:
    """Runs of digits with their length, of letters without, capitalised or not, mixed ones as x with their length; other signs as they are."""

    def one(m: re.Match) -> str:
        s = m[0]
        n = sum(c.isdigit() for c in s)
        return f"d{len(s)}" if n == len(s) else ("A" if s[0].isupper() else "a") if not n else f"x{len(s)}" if len(s) >= 16 else "x"

    return _RUN.sub(one, entity)


def _runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the runs of identifiers' bytes with a digit or an at sign."""
    flagged = np.flatnonzero(_FLAG[data])
    owner = np.searchsorted(offs, flagged, "right") - 1
    stops = np.concatenate([[-1], np.flatnonzero(~_ID[data]), [len(data)]])
    at = np.searchsorted(stops, flagged)
    lo, hi = np.maximum(offs[owner], stops[at - 1] + 1), np.minimum(offs[owner + 1], stops[at])
    first = np.ones(len(lo), bool)
    first[1:] = lo[1:] != lo[:-1]
    return owner[first], lo[first], hi[first]


def candidates(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, str, str | None]]:
    """(text, first byte, end, entity, kind of a seed) of each candidate."""
    owner, lo, hi = _runs(data, offs)
    if not len(lo):
        return
    raw, rows = data.tobytes(), list(zip(owner.tolist(), lo.tolist(), hi.tolist()))

    def one(o: int, a: int, b: int, kind: str | None = None):
        text = raw[a:b].decode()
        left = _ENDS.match(text)
        a += len(left[0]) if left else 0
        entity = _ENDS.sub("", text)
        if any(c.isdigit() or c == "@" for c in entity):
            yield o, a, a + len(entity), entity, kind or seed_kind(entity, raw[max(int(offs[o]), a - _NEAR) : a].decode(errors="replace"))

    i = 0
    while i < len(rows):
        o, a, b = rows[i]
        j = i
        # groups of a number
        while j + 1 < len(rows) and rows[j + 1][0] == o and raw[rows[j][2] : rows[j + 1][1]] in _BETWEEN and _PART.fullmatch(raw[rows[j][1] : rows[j][2]].decode()) and _PART.match(raw[rows[j + 1][1] : rows[j + 1][2]].decode()):
            j += 1
        parts = rows[i : j + 1]
        i = j + 1
        if len(parts) == 1:
            yield from one(o, a, b)
            continue
        text = raw[a : parts[-1][2]].decode()
        found = [(a + m.start(), a + m.end(), k) for k, form in (("phone", _PHONE), ("card", _CARD)) for m in form.finditer(text) if k == "phone" or luhn(re.sub("[ -]", "", m[0]))]
        rest: list[list[tuple[int, int]]] = [[]]
        for _, x, y in parts:
            if any(x < f and y > e for e, f, _ in found):
                rest.append([])
            else:
                rest[-1].append((x, y))
        for e, f, k in found:
            yield o, e, f, raw[e:f].decode(), k
        for group in rest:
            # few groups are one number, a row of many is not
            digits = sum(raw[x:y].decode().count(d) for x, y in group for d in "0123456789")
            if 1 < len(group) <= 6 and 7 <= digits <= 19 and not any(_IP.fullmatch(raw[x:y].decode().strip(".-")) for x, y in group):
                yield from one(o, group[0][0], group[-1][1])
            else:
                for x, y in group:
                    yield from one(o, x, y)


_SCHEMA = "doc_id long, start long, entity string, shape string, seed string, l1 long, l2 long, l3 long, r1 long, r2 long"
_NAMES = [c.split(" ")[0] for c in _SCHEMA.split(", ")]


def _rows(ids: pa.Array, offs: np.ndarray, w: K.Words, found: list[tuple]) -> pa.RecordBatch:
    """The candidates (text, row, first byte, end, entity, kind) with hashes of their contexts."""
    text, row, a, b, entity, seed = (list(x) for x in zip(*found))
    text, a, b = np.array(text), np.array(a), np.array(b)
    lo, hi = w.offsets[text], w.offsets[text + 1]
    k, j = np.searchsorted(w.ends, a, "right"), np.searchsorted(w.starts, b, "left")

    def at(n: int, first: np.ndarray) -> pa.Array:
        ok = (first >= lo) & (first + n <= hi)
        return pa.array(K.signed(w.ngrams(n)[0][np.where(ok, first, 0)]), mask=~ok)

    contexts = [at(n, k - n) for n in (1, 2, 3)] + [at(n, j) for n in (1, 2)]
    start = pa.array(a - offs[text])
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), start, pa.array(entity, pa.string()), pa.array([shape(e) for e in entity], pa.string()), pa.array(seed, pa.string()), *contexts], _NAMES)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row, _, data, offs in K.chunks(b.column(1)):
            found = [(r, row + r, s, e, x, k) for r, s, e, x, k in candidates(data, offs)]
            if found:
                yield _rows(b.column(0), offs, K.words(data, offs, K.CLASSES), found)


def _after(data: np.ndarray, offs: np.ndarray, w: K.Words, contexts: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens, which context, text, token) of the words without digits that follow the contexts, sorted hashes by their number of tokens."""
    flags = np.concatenate([[0], np.cumsum(_FLAG[data])])
    stops = np.concatenate([np.flatnonzero(~_ID[data]), [len(data)]])
    for n, known in contexts.items():
        h, ok = w.ngrams(n)
        h = K.signed(h)
        which = np.minimum(np.searchsorted(known, h), len(known) - 1)
        at = np.flatnonzero(ok & (known[which] == h))
        which, at = which[at], at + n
        which, at = which[at < len(w.hashes)], at[at < len(w.hashes)]
        text = np.searchsorted(w.offsets, at, "right") - 1
        # in the text of the context, and no candidate
        a = w.starts[at]
        end = np.minimum(stops[np.searchsorted(stops, a)], offs[text + 1])
        good = (at > w.offsets[text]) & (K.CLASSES[data[a]] == 1) & (data[a] < 0x80) & (flags[end] == flags[a])
        yield n, which[good], text[good], at[good]


def _counts(spread):
    """Per task: the contexts (tokens, context) with the words that follow each, null if they are too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, most = spread.value
        seen: dict[int, dict[int, set | None]] = {n: {} for n in contexts}
        for b in batches:
            for _, _, data, offs in K.chunks(b.column(1)):
                w = K.words(data, offs, K.CLASSES)
                for n, which, _, at in _after(data, offs, w, contexts):
                    mine = seen[n]
                    over = np.zeros(len(contexts[n]), bool)
                    over[[i for i, x in mine.items() if x is None]] = True
                    open_ = ~over[which]
                    pairs = np.unique(np.stack([which[open_], K.signed(w.hashes[at[open_]])], 1), axis=0)
                    for i, x in pairs.tolist():
                        some = mine.setdefault(i, set())
                        if some is not None:
                            some.add(x)
                            if len(some) > most[n][i]:
                                mine[i] = None
        rows = [(n, int(contexts[n][i]), y) for n, mine in seen.items() for i, x in mine.items() for y in ([None] if x is None else x)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))], ["tokens", "context", "word"])

    return run


def _scan(spread):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, _, data, offs in K.chunks(b.column(1)):
                w = K.words(data, offs, K.CLASSES)
                found, raw = {}, None
                for _, _, text, at in _after(data, offs, w, spread.value[0]):
                    raw = data.tobytes() if raw is None else raw
                    for t, a, e in zip(text.tolist(), w.starts[at].tolist(), w.ends[at].tolist()):
                        # capitalised words are one name
                        m = _NAME.match(raw, a, int(offs[t + 1]))
                        entity = max(raw[a:e].decode(errors="replace"), m[0].decode() if m else "", key=len)
                        found[a] = t, row + t, a, a + len(entity.encode()), entity, None
                if found:
                    yield _rows(b.column(0), offs, w, list(found.values()))

    return run


def _graph(found: DataFrame) -> DataFrame:
    """(instance, pattern, seed, tokens, context): each instance's patterns; context is the hash of those that are nothing else."""
    coarse = F.regexp_replace("shape", r"\d+", "")
    forms = [(c, n, f) for c in ("l1", "l2", "l3", "r1", "r2") for n, f in (("s", F.col("shape")), ("c", coarse))]
    none = F.lit(None).cast("long")
    each = [F.when(F.col(c).isNotNull(), F.struct(F.xxhash64(F.lit(c + n), F.col(c), f).alias("pattern"), F.lit(0).alias("tokens"), none.alias("context"))) for c, n, f in forms]
    each += [F.when(F.col(c).isNotNull(), F.struct(F.xxhash64(F.lit(c), F.col(c)).alias("pattern"), F.lit(n).alias("tokens"), F.col(c).alias("context"))) for c, n in (("l2", 2), ("l3", 3))]
    each.append(F.struct(F.xxhash64(F.lit("s"), F.col("shape")).alias("pattern"), F.lit(0).alias("tokens"), none.alias("context")))
    rows = found.select(F.xxhash64("entity").alias("instance"), "seed", F.explode(F.array_compact(F.array(*each))).alias("p"))
    return rows.groupBy("instance", "p.pattern").agg(F.max("seed").alias("seed"), F.first("p.tokens").alias("tokens"), F.first("p.context").alias("context"))


def _scored(graph: DataFrame, prior: float, accept: float, least: int) -> DataFrame:
    """Instances (instance, seed, kind, c) in balance with the patterns."""
    seeds = graph.groupBy("instance").agg(F.max("seed").alias("seed"))
    instances = cut(seeds.select("instance", "seed", F.col("seed").alias("kind"), F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0).alias("c")), "instances")
    links = cut(graph.select("instance", "pattern"), "links")
    mark = None
    while True:
        p = links.join(instances, "instance").groupBy("pattern").agg((F.sum("c") / (F.count("*") + prior)).alias("p"), F.count("seed").alias("seeds"), F.mode("kind").alias("guess"))
        patterns = cut(p.where((F.col("p") >= accept) & (F.col("seeds") >= least)), "patterns")
        now = tuple(patterns.agg(F.count("*"), F.round(F.avg("p"), 2)).first())
        if now == mark:
            return instances
        mark = now
        none_of = F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))))
        got = links.join(patterns.select("pattern", "p", "guess"), "pattern").groupBy("instance").agg((1 - none_of).alias("q"), F.max_by("guess", F.struct("p", "guess")).alias("guess"))
        c = F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.coalesce("q", F.lit(0.0)))
        instances = cut(instances.select("instance", "seed").join(got, "instance", "left").select("instance", "seed", F.coalesce("seed", "guess").alias("kind"), c.alias("c")), "instances")


def identifiers(docs: DataFrame, *, prior: float = 1.0, accept: float = 0.7, least: int = 3, contexts_a_pass: int = 4_000_000) -> DataFrame:
    """(doc_id, start, entity, kind, seed, confidence): start is the entity's first byte in the text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    found = cut(texts.mapInArrow(_extract, _SCHEMA), "candidates")
    graph = cut(_graph(found), "graph")
    tested = proven = docs.sparkSession.createDataFrame([], "tokens int, context long")

    def over(contexts: DataFrame, function, schema: str) -> DataFrame:
        """The function's rows over the texts, with contexts (tokens, context, most) in as many passes as they take."""
        passes, out = max(1, -(-contexts.count() // contexts_a_pass)), None
        for i in range(passes):
            part = contexts.where(F.pmod(F.xxhash64("context", F.lit(7)), F.lit(passes)) == i).orderBy("context").toPandas()
            by = {int(n): x for n, x in part.groupby("tokens")}
            spread = docs.sparkSession.sparkContext.broadcast(({n: x.context.to_numpy() for n, x in by.items()}, {n: x.most.tolist() for n, x in by.items()}))
            rows = texts.mapInArrow(function(spread), schema)
            out = rows if out is None else out.union(rows)
        return out

    while True:
        alone = graph.where("tokens = 0").unionByName(graph.where("tokens > 0").join(proven, ["tokens", "context"], "left_semi").select(*graph.columns))
        instances = _scored(alone, prior, accept, least)
        # contexts that would be accepted by the candidates alone, and how many other words may follow them
        p = graph.where("tokens > 0").join(instances.select("instance", "c"), "instance").groupBy("tokens", "context").agg(F.sum("c").alias("s"), F.count("*").alias("n"), F.count("seed").alias("seeds"))
        most = F.floor(F.col("s") / accept - prior - F.col("n") + 1e-9)
        new = p.where(F.col("seeds") >= least).withColumn("most", most).where("most >= 0").select("tokens", "context", "most")
        new = cut(new.join(tested, ["tokens", "context"], "left_anti"), "contexts")
        if new.isEmpty():
            break
        tested = tested.union(new.select("tokens", "context"))
        words = over(new, _counts, "tokens int, context long, word long").groupBy("tokens", "context").agg(F.count_distinct("word").alias("words"), (F.count("*") > F.count("word")).alias("many"))
        good = cut(new.join(words, ["tokens", "context"], "left").where("not coalesce(many, false) and coalesce(words, 0) <= most").select("tokens", "context", "most", F.coalesce("words", F.lit(0)).alias("words")), "proven")
        if good.isEmpty():
            break
        proven = proven.union(good.select("tokens", "context"))
        if not good.where("words > 0").isEmpty():
            found = found.union(cut(over(good.where("words > 0"), _scan, _SCHEMA), "followers"))
            graph = cut(_graph(found), "graph")
    best = instances.where("c > 0").select("instance", "kind", F.col("seed").isNotNull().alias("seed"), F.col("c").alias("confidence"))
    # what two contexts found is reported once
    return found.select("doc_id", "start", "entity").distinct().join(best, F.xxhash64("entity") == F.col("instance")).select("doc_id", "start", "entity", "kind", "seed", "confidence")
