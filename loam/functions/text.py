"""Text functions: scripts, tokens, hashes, query classes.

Built-in expressions wherever they can say it; the CJK tokenizer and the stemmer
are Arrow functions.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .stemmer import stem

#: Han with its extensions A and B and compatibility forms, kana, Hangul
CJK_RANGES = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0xF900, 0xFAFF), (0x3040, 0x309F), (0x30A0, 0x30FF), (0xAC00, 0xD7A3))
_CJK = "[" + "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in CJK_RANGES) + "]"
_LATIN = r"[A-Za-z\x{C0}-\x{24F}]"
_CJK_PY = "[" + "".join(f"{chr(lo)}-{chr(hi)}" for lo, hi in CJK_RANGES) + "]"
_RUNS = re.compile(f"({_CJK_PY}+)|([^\\W_]+)")


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, in hex."""
    return F.sha2(text, 256)


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def script(text: Column, sample: int = 200) -> Column:
    """'cjk' if the first ``sample`` characters hold more CJK than Latin ones, else 'latin'."""
    head = F.substring(text, 1, sample)
    return F.when(F.regexp_count(head, F.lit(_CJK)) > F.regexp_count(head, F.lit(_LATIN)), "cjk").otherwise("latin")


def words(text: Column) -> Column:
    """Lower-case runs of word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), 0)


@functools.cache
def stopwords(language: str | None) -> tuple[str, ...]:
    """Spark's list for the language; none for a language that it doesn't have."""
    SparkSession.active()
    try:
        return tuple(StopWordsRemover.loadDefaultStopWords((language or "english").lower()))
    except Exception:  # py4j wraps an illegal argument
        return ()


def cjk_tokens(text: str) -> list[str]:
    """Of CJK runs each character and, after it, the pair that it begins; of others lower-case runs of two or more."""
    out: list[str] = []
    for m in _RUNS.finditer(text):
        if m[1]:
            run = m[1]
            for i, c in enumerate(run):
                out.append(c)
                if i + 1 < len(run):
                    out.append(run[i : i + 2])
        else:
            # a run of letters may border on CJK ones, which are letters too
            for part in re.split(f"({_CJK_PY}+)", m[2]):
                if part and re.match(_CJK_PY, part):
                    out += cjk_tokens(part)
                elif len(part) > 1:
                    out.append(part.lower())
    return out


def _cjk(text: Column) -> Column:
    @F.arrow_udf("array<string>")
    def run(text: pa.Array) -> pa.Array:
        return pa.array([None if x is None else cjk_tokens(x) for x in text.to_pylist()], pa.list_(pa.string()))

    return run(text)


def _stems(tokens: Column) -> Column:
    @F.arrow_udf("array<string>")
    def run(tokens: pa.Array) -> pa.Array:
        known: dict[str, str] = {}
        out = []
        for t in tokens.to_pylist():
            for w in t or ():
                if w not in known:
                    known[w] = stem(w)
            out.append(None if t is None else [known[w] for w in t])
        return pa.array(out, pa.list_(pa.string()))

    return run(tokens)


def latin_tokens(text: Column, language: str | None = None, *, stemmed: bool = True) -> Column:
    """Words of two or more characters that aren't stop words; stemmed after that test, by English rules."""
    stop = F.array(*(F.lit(w) for w in stopwords(language))) if stopwords(language) else None
    kept = F.filter(words(text), lambda w: F.length(w) > 1)
    if stop is not None:
        kept = F.filter(kept, lambda w: ~F.array_contains(stop, w))
    return _stems(kept) if stemmed else kept


def tokens(text: Column, language: str | None = None, *, stemmed: bool = True) -> Column:
    """Tokens by script: an explicit language is taken as Latin, or as CJK if it is 'cjk'."""
    if language == "cjk":
        return _cjk(text)
    latin = latin_tokens(text, language, stemmed=stemmed)
    if language:
        return latin
    return F.when(script(text) == "cjk", _cjk(text)).otherwise(latin)


def _whole(words: str, *phrases: str) -> str:
    return r"\b(?:" + "|".join([*sorted(words.split()), *phrases]) + r")\b"


#: What asks for names and places, and what asks for an understanding; German and English
ENTITY_PATTERNS = (
    _whole("contains? enthält called genannt heißt named? said sagt says? reference erwähnt mention", "bezieht sich auf", "refers? to", "talk about", "wer ist", "who is"),
)
SEMANTIC_PATTERNS = (
    _whole("ansatz approach compare concept describe difference erkläre explain how idea konzept like overview related similar summary unterschied vergleich verwandt warum why wie zusammenfassung ähnlich überblick", "what is"),
)


def _any(query: Column, patterns: tuple[str, ...]) -> Column:
    return query.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))


def query_weights(query: Column, entity: tuple[str, ...] = ENTITY_PATTERNS, semantic: tuple[str, ...] = SEMANTIC_PATTERNS) -> Column:
    """struct(vector_weight, keyword_weight) by the class of the query; entity patterns come first."""

    def pair(v: float, k: float) -> Column:
        return F.struct(F.lit(v).alias("vector_weight"), F.lit(k).alias("keyword_weight"))

    return F.when(_any(query, entity), pair(0.3, 0.7)).when(_any(query, semantic), pair(0.8, 0.2)).otherwise(pair(0.5, 0.5))


def query_type(query: Column, **patterns) -> Column:
    w = query_weights(query, **patterns)
    return F.when(w["keyword_weight"] > w["vector_weight"], "entity").when(w["vector_weight"] > w["keyword_weight"], "semantic").otherwise("balanced")


def contextual_header(name: Column, text: Column) -> Column:
    """The text as it is embedded, with its source named."""
    return F.concat(F.lit("Source: "), name, F.lit("\n\n"), text)


def truncated(text: Column, size: int = 500) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)
