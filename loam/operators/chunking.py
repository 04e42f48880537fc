"""Recursive splitter that knows languages' separators, as an Arrow function."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SEPARATORS = ["\n\n", "\n", " ", ""]
MAX_DEPTH = 100


def _code(words: str) -> list[str]:
    return [f"\n{w} " for w in words.split()] + DEFAULT_SEPARATORS


def _tags(words: str) -> list[str]:
    return [f"<{w}>" for w in words.split()] + [" ", ""]


_C = _code("class void int float double if for while switch case")
_JS = _code("function const let var class if for while switch case default")
_MD = ["\n" + "#" * n + " " for n in range(2, 7)] + ["```\n\n"] + [f"\n\n{c * 3}\n\n" for c in "*-_"] + DEFAULT_SEPARATORS
_HTML = _tags("body div p br li h1 h2 h3 h4 h5 h6 span table tr td th ul ol header footer nav head style script meta title")
_TEX = [f"\n\\{w}{{" for w in ("chapter", "section", "subsection", "subsubsection")]
_TEX += [f"\n\\begin{{{w}}}" for w in ("enumerate", "itemize", "description", "list", "quote", "quotation", "verse", "verbatim", "align")] + ["$$", "$"] + DEFAULT_SEPARATORS
SEPARATORS: dict[str, list[str]] = {
    **dict.fromkeys(("c", "cc", "cpp"), _C),
    **dict.fromkeys(("js", "mjs", "cjs"), _JS),
    **dict.fromkeys(("md", "mkd"), _MD),
    **dict.fromkeys(("html", "htm"), _HTML),
    "go": _code("func var const type if for switch case"),
    "java": _code("class public protected private static if for while switch case"),
    "php": _code("function class if foreach while do switch case"),
    "proto": _code("message service enum option import syntax"),
    "py": ["\nclass ", "\ndef ", "\n\tdef "] + DEFAULT_SEPARATORS,
    "rb": _code("def class if unless while for do begin rescue"),
    "rs": _code("fn const let if while for loop match const"),
    "rst": [f"\n{c * 3}\n" for c in "=-*"] + ["\n.. "] + DEFAULT_SEPARATORS,
    "scala": _code("class object def val var if for while match case"),
    "sol": [*_code("pragma using contract interface library constructor type function event modifier error struct enum if for while")[:-4], "\ndo while ", "\nassembly ", *DEFAULT_SEPARATORS],
    "swift": _code("func class struct enum if for while do switch case"),
    "tex": _TEX,
}


def separators_for(language: str | None) -> list[str]:
    """Separators by language or file extension, in any case; the default ones for others."""
    return list(SEPARATORS.get((language or "").lower(), DEFAULT_SEPARATORS))


class Splitter:
    """Splits a text at the first separator that occurs, and pieces that are too long at the next ones.

    Separators are kept, before the piece that follows them, if any of them has
    a visible sign.  Pieces are merged up to ``size``, with up to ``overlap`` of
    the end of one chunk at the start of the next."""

    def __init__(self, size: int = 1000, overlap: int = 100, separators: Sequence[str] | None = None, length: Callable[[str], int] = len):
        if overlap >= size:
            raise ValueError(f"the overlap ({overlap}) must be less than the chunk size ({size})")
        self.size, self.overlap, self.length = size, overlap, length
        self.separators = list(DEFAULT_SEPARATORS if separators is None else separators)
        self.keep = any(s.strip() for s in self.separators)

    def split(self, text: str | None) -> list[str]:
        return self._split(text or "", self.separators, 0)

    def _cut(self, text: str, sep: str) -> list[str]:
        if not sep:
            return list(text)
        parts = text.split(sep)
        if self.keep:
            # a separator at the very end has no piece to lead
            parts = parts[:1] + [sep + p for i, p in enumerate(parts[1:]) if p or i < len(parts) - 2]
        return [p for p in parts if p]

    def _split(self, text: str, separators: Sequence[str], depth: int) -> list[str]:
        if depth > MAX_DEPTH:
            raise RecursionError("the text splits too deeply")
        sep, rest = (separators[-1] if separators else ""), []
        for i, s in enumerate(separators):
            if not s:
                sep = s
                break
            if s in text:
                sep, rest = s, list(separators[i + 1 :])
                break
        out: list[str] = []
        run: list[str] = []
        for piece in self._cut(text, sep):
            if self.length(piece) < self.size:
                run.append(piece)
                continue
            out += self._merge(run, sep)
            run = []
            out += self._split(piece, rest, depth + 1) if rest else [piece]
        return out + self._merge(run, sep)

    def _merge(self, pieces: list[str], sep: str) -> list[str]:
        glue = "" if self.keep else sep
        step = self.length(glue)
        out: list[str] = []
        now: list[str] = []
        total = 0

        def flush() -> None:
            chunk = glue.join(now).strip()
            if chunk:
                out.append(chunk)

        for p in pieces:
            n = self.length(p)
            if now and total + n + len(now) * step > self.size:
                flush()
                while total > self.overlap or (total > 0 and total + n + len(now) * step > self.size):
                    total -= self.length(now.pop(0))
            now.append(p)
            total += n
        if now:
            flush()
        return out


def chunks(text: Column, extension: Column | None = None, *, size: int = 1000, overlap: int = 100) -> Column:
    """Array of the chunks of each text; null stays null."""
    Splitter(size, overlap)

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array, kinds: pa.Array) -> pa.Array:
        made: dict[str | None, Splitter] = {}
        parts = [pa.array([], pa.list_(pa.string()))]
        # few rows are Python objects at once
        for i in range(0, len(texts), 256):
            out = []
            for t, k in zip(texts[i : i + 256].to_pylist(), kinds[i : i + 256].to_pylist()):
                if k not in made:
                    made[k] = Splitter(size, overlap, separators_for(k))
                out.append(None if t is None else made[k].split(t))
            parts.append(pa.array(out, pa.list_(pa.string())))
        return pa.concat_arrays(parts)

    return run(text, F.lit(None).cast("string") if extension is None else extension)


def chunk_documents(docs: DataFrame, text: str = "text", extension: Column | None = None, *, size: int = 1000, overlap: int = 100) -> DataFrame:
    """The other columns, chunk_index and chunk: a row for each chunk."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(chunks(F.col(text), extension, size=size, overlap=overlap)).alias("chunk_index", "chunk"))
