"""Document fingerprints by a homomorphic hash of the multiset of paragraphs.

Each paragraph is hashed to a wide vector, ``LANES`` numbers of 32 bits, and a
document's fingerprint is their sum, lane by lane, modulo 2**32 (LtHash: Bellare
and Micciancio 1997; Lewi et al. 2019).  The order of paragraphs doesn't count,
their number does; fingerprints of parts add up, so paragraphs can be inserted
or deleted without reading the rest.

Lanes 8j to 8j + 7 of a paragraph are the big-endian words of the SHA-256 of
``j:`` and the paragraph.  A paragraph is a line without blanks at its ends;
blank lines are none.

Nulls: a null text has no paragraphs, like an empty one: all lanes are 0.  A
null doc_id is passed on.  Repeated rows give equal rows.  Empty tables give
empty results.  One pass over the rows, without shuffle; texts of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 64
_SALTS = [hashlib.sha256(b"%d:" % j) for j in range(LANES // 8)]


def paragraphs(text: str | None) -> list[bytes]:
    return [y for x in (text or "").split("\n") if (y := x.strip(" ").encode())]


def lanes(items: Iterable[bytes]) -> np.ndarray:
    """The sum of the paragraphs' vectors."""
    out = []
    for p in items:
        for salt in _SALTS:
            h = salt.copy()
            h.update(p)
            out.append(h.digest())
    return np.frombuffer(b"".join(out), ">u4").reshape(-1, LANES).sum(0, dtype=np.uint32) if out else np.zeros(LANES, np.uint32)


def digest(state: np.ndarray) -> str:
    """A fingerprint in short: SHA-256 of the lanes in decimals, with commas."""
    return hashlib.sha256(",".join(map(str, state.tolist())).encode()).hexdigest()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, fingerprint, state): state is the lanes as bytes, big-endian, to go on from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, short, state = [], [], []
            for x in b.column(1):
                items = paragraphs(x.as_py())
                s = lanes(items)
                n.append(len(items))
                short.append(digest(s))
                state.append(s.astype(">u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(short, pa.string()), pa.array(state, pa.binary())], ["doc_id", "n_paragraphs", "fingerprint", "state"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_paragraphs long, fingerprint string, state binary")


def change(state: Column, inserted: Column, deleted: Column) -> Column:
    """The state after paragraphs (arrays of strings) are inserted and deleted; null arrays are empty, a null state is that of no paragraph."""

    @F.arrow_udf("binary")
    def run(s: pa.Array, more: pa.Array, less: pa.Array) -> pa.Array:
        out = []
        for x, a, d in zip(s.to_pylist(), more.to_pylist(), less.to_pylist()):
            v = np.frombuffer(x, ">u4").astype(np.uint32) if x else np.zeros(LANES, np.uint32)
            a, d = ([p for y in z or [] for p in paragraphs(y)] for z in (a, d))
            out.append((v + lanes(a) - lanes(d)).astype(">u4").tobytes())
        return pa.array(out, pa.binary())

    return run(state, inserted, deleted)


def sql() -> str:
    """doc_id, n_paragraphs and fingerprint in DuckDB SQL."""
    return f"""
with docs as (select row_number() over () as r, doc_id, text from documents),
lines as (select r, trim(l, ' ') as p from (select r, unnest(string_split(text, chr(10))) as l from docs) where trim(l, ' ') <> ''),
hashed as (select r, j, sha256(j || ':' || p) as h from lines, range({LANES // 8}) t(j)),
sums as (select r, j * 8 + i as lane, sum(('0x' || substr(h, i * 8 + 1, 8))::bigint) % 4294967296 as s
         from hashed, range(8) u(i) group by all),
whole as (select docs.r, lane.lane, coalesce(s, 0)::bigint as s from docs cross join range({LANES}) lane(lane) left join sums on sums.r = docs.r and sums.lane = lane.lane),
counts as (select r, count(*) as n from lines group by r)
select doc_id, coalesce(n, 0) as n_paragraphs, sha256(string_agg(s::varchar, ',' order by lane)) as fingerprint
from docs join whole using (r) left join counts using (r) group by r, doc_id, n"""
