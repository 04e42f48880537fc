"""Line deduplication across documents.

Lines are exploded in normalised form, hashed, and the distinct documents of
each hash counted; lines of more documents than the threshold are dropped and
each document is put together again from what is left, in order.

A line is what lies between line feeds; its normal form has lower-case letters
and no blanks at its ends.  Documents are distinct by content: copies of one
text count once, so a page that was fetched many times isn't emptied.  Blank
lines are never dropped.

Only hashes are shuffled to count; texts are joined once with the positions
that they lose, by broadcast where that table is small, and texts that lose
nothing aren't rebuilt.

Nulls: a null text stays null with 0 lines dropped; a null doc_id is a document
like any other.  Repeated rows are each kept and cut alike.  A text of which
every line goes becomes empty; ``dedup_lines`` keeps its row.  Empty tables
give empty results.  Lines may be of any length.  All columns are passed on;
only ``text`` is changed, and ``n_chars``, if it is there, counts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import col, cut, fresh, maybe_broadcast


def _hashes(text: Column) -> Column:
    """96 bits of each line's normal form, null for blank lines."""

    def one(x: Column) -> Column:
        y = F.lower(F.trim(x))
        return F.when(y != "", F.struct(F.xxhash64(y).alias("a"), F.hash(y).alias("b")))

    return F.transform(F.split(text, "\n", -1), one)


def frequent_lines(docs: DataFrame, *, max_docs: int = 10) -> DataFrame:
    """(a, b, n): hashes of the lines that more than max_docs distinct contents hold, with their number."""
    text = col("text")
    lines = docs.where(text.isNotNull()).select(F.xxhash64(text).alias("doc"), F.explode(F.array_distinct(_hashes(text))).alias("h")).where("h is not null")
    return lines.select("h.a", "h.b", "doc").distinct().groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") > max_docs)


def dedup_lines(docs: DataFrame, *, max_docs: int = 10, broadcast_limit: int = 64 << 20, dropped: str | None = None) -> DataFrame:
    """docs with lines of more than max_docs documents dropped; with ``dropped``, a column of that name counts them."""
    hot = cut(frequent_lines(docs, max_docs=max_docs).select("a", "b"), "lines")
    n = hot.count()
    text = col("text")
    key, pos, gone, drop = fresh(docs, "key", "pos", "gone", "drop")
    whole = F.xxhash64(text)
    # (content, positions to drop), of the contents that lose something
    lines = docs.where(text.isNotNull()).select(whole.alias(key), F.length(text).alias("len"), F.posexplode(_hashes(text)).alias("at", "h"))
    lost = lines.where("h is not null").select(key, "len", "at", "h.a", "h.b").join(maybe_broadcast(hot, n, 32, broadcast_limit), ["a", "b"], "left_semi")
    lost = cut(lost.groupBy(key, "len").agg(F.collect_set("at").alias(drop)), "lost")
    few = maybe_broadcast(lost, lost.count(), 96, broadcast_limit).withColumnRenamed("len", pos)
    out = docs.join(few, (whole == F.col(key)) & (F.length(text) == F.col(pos)), "left")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col(drop), i)), "\n")
    changed = F.when(F.col(drop).isNull(), text).otherwise(left)
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(changed.alias("text"))
        elif c == "n_chars":
            cols.append(F.when(F.col(drop).isNull(), col(c)).otherwise(F.length(left).cast(docs.schema[c].dataType)).alias(c))
        else:
            cols.append(col(c))
    if dropped:
        cols.append(F.coalesce(F.size(drop), F.lit(0)).alias(dropped))
    return out.select(*cols)


def sql(max_docs: int = 10) -> str:
    """The same in DuckDB SQL: doc_id, text, dropped."""
    return f"""
with lines as (select distinct md5(text) as doc, lower(trim(l)) as line
               from (select text, unnest(string_split(text, chr(10))) as l from documents) where lower(trim(l)) <> ''),
hot as (select line from lines group by line having count(*) > {max_docs}),
parts as (select doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as l from documents),
marked as (select doc_id, pos, l, lower(trim(l)) in (select line from hot) as gone from parts)
select doc_id, coalesce(string_agg(l, chr(10) order by pos) filter (where not gone), '') as text, count(*) filter (where gone) as dropped
from marked group by doc_id"""
