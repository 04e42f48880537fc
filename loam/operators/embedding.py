"""Embeddings of text columns by a function of lists of texts: in batches, with second tries."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attempts(run: Callable[[], object], tries: int, wait: float) -> object:
    """The result of the first try that doesn't raise; waits longer before each; the last error is raised."""
    for i in range(tries):
        try:
            return run()
        except Exception as e:
            if i == tries - 1:
                raise
            logging.getLogger(__name__).warning("try %d of %d failed: %s", i + 1, tries, e)
            time.sleep(wait * (i + 1))
    raise ValueError("at least one try is needed")


def embed_texts(function: Callable[[list[str]], Sequence[Sequence[float]]], texts: list[str], *, batch: int, tries: int = 3, wait: float = 1.0) -> list[Sequence[float]]:
    """A vector of each text.  A batch that fails is tried again, then its texts one by one; RuntimeError if one fails for good."""

    def some(part: list[str]) -> list[Sequence[float]]:
        got = list(function(part))
        if len(got) != len(part):
            raise ValueError(f"{len(got)} vectors of {len(part)} texts")
        return got

    out: list[Sequence[float]] = []
    for lo in range(0, len(texts), batch):
        part = texts[lo : lo + batch]
        try:
            out += attempts(lambda part=part: some(part), tries, wait)
        except Exception:
            for text in part:
                try:
                    out += attempts(lambda text=text: some([text]), tries, wait)
                except Exception as e:
                    raise RuntimeError(f"a text can't be embedded: {text[:80]!r}") from e
    return out


def embedder(function: Callable[[list[str]], Sequence[Sequence[float]]], *, batch: int = 100, tries: int = 3, wait: float = 1.0) -> Callable[[Column], Column]:
    """A function of columns, as collections take it; nulls stay null."""

    def embed(text: Column) -> Column:
        @F.arrow_udf("array<double>")
        def run(x: pa.Array) -> pa.Array:
            values = x.to_pylist()
            got = iter(embed_texts(function, [v for v in values if v is not None], batch=batch, tries=tries, wait=wait))
            return pa.array([None if v is None else [float(y) for y in next(got)] for v in values], pa.list_(pa.float64()))

        return run(text)

    return embed


def too_large(chunks: DataFrame, limit_mb: float, *, dimension: int = 1536) -> DataFrame:
    """(doc_hash, mb) of documents whose chunks and vectors of 4-byte numbers take more than the limit."""
    mb = (F.sum(F.octet_length("text")) + F.count("*") * dimension * 4) / 1e6
    return chunks.groupBy("doc_hash").agg(mb.alias("mb")).where(F.col("mb") > limit_mb)
