"""Documents (path, content) from files, commands, repositories and fetched pages.

A path is, in this order: a crawl (http and ``**``), a URL, a protocol of a
registered loader (``name:rest``), a file with an extension that has a loader,
or a text file.  Files are read by Spark, so folders and globs will do.
"""

from __future__ import annotations

import shlex
import shutil
import subprocess
import tempfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.shared import shared_path

from . import html as H

SCHEMA = "path string, content string"
#: Content types of fetched files, and the extension whose loader reads them
CONTENT_TYPES = {
    "application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/msword": "doc", "application/rtf": "rtf", "image/jpeg": "jpg", "image/png": "png",
    "application/epub+zip": "epub", "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
}
HINTS = {"pdftotext": "install poppler-utils", "pandoc": "install pandoc", "tesseract": "install tesseract-ocr", "yek": "install yek", "git": "install git"}


def is_crawl(path: str) -> bool:
    return path.startswith("http") and "**" in path


def is_url(path: str) -> bool:
    return path.startswith(("http://", "https://")) and "**" not in path


def is_protocol(path: str, loaders: dict[str, str]) -> bool:
    return not path.startswith("/") and ":" in path and path.split(":", 1)[0] in loaders


def is_remote_git(path: str) -> bool:
    return path.startswith(("http://", "https://", "git@", "ssh://")) or path.endswith(".git")


def kind(path: str, loaders: dict[str, str]) -> str:
    if is_crawl(path):
        return "crawl"
    if is_url(path):
        return "url"
    if is_protocol(path, loaders):
        return "protocol"
    return "command" if Path(path).suffix.lstrip(".").lower() in loaders else "text"


def decoded(df: DataFrame, raw: str = "content", binary: str = "error") -> DataFrame:
    """Bytes as text: UTF-8, else Latin-1; a zero byte among the first 8192 is an error, or with binary='skip' drops the row."""

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        out = []
        for b in x.to_pylist():
            try:
                out.append(None if b is None else b.decode())
            except UnicodeDecodeError:
                out.append(b.decode("latin-1"))
        return pa.array(out, pa.string())

    bad = F.instr(F.hex(F.substring(raw, 1, 8192)), "00") > 0
    zero = F.expr(f"exists(sequence(1, greatest(1, least(8192, length({raw})))), i -> length({raw}) > 0 and substring({raw}, i, 1) = X'00')") & bad
    if binary == "skip":
        return df.where(~zero).withColumn(raw, run(F.col(raw)))
    return df.withColumn(raw, F.when(zero, F.raise_error(F.lit("a binary file can't be read as text"))).otherwise(run(F.col(raw))))


def read_text(spark: SparkSession, paths: str | list[str], *, pattern: str | None = None, recursive: bool = False, binary: str = "error") -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return decoded(r.load(paths).select("path", "content"), binary=binary)


def run_command(template: str, path: str, timeout: float = 300) -> str:
    """The output of a loader's command: $1 is the path, $2 a file that it writes instead; no shell."""
    words = shlex.split(template)
    if not words or shutil.which(words[0]) is None:
        raise RuntimeError(f"the loader's program isn't installed: {words[0] if words else template!r}")
    safe = f"./{path}" if path.startswith("-") else path
    with tempfile.NamedTemporaryFile(suffix=".txt") as f:
        to_file = any("$2" in w for w in words)
        done = subprocess.run([w.replace("$1", safe).replace("$2", f.name) for w in words], capture_output=True, timeout=timeout, check=False)
        if done.returncode:
            raise RuntimeError(f"the loader failed on {path}: {done.stderr.decode(errors='replace')[:500]}")
        return (Path(f.name).read_bytes() if to_file else done.stdout).decode(errors="replace")


def read_commands(spark: SparkSession, paths: list[str], loaders: dict[str, str]) -> DataFrame:
    """Each path through its extension's loader, run by tasks where the path is."""

    def run(batches):
        for b in batches:
            rows = [run_command(loaders[Path(p).suffix.lstrip(".").lower()], p) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.string())], ["path", "content"])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(run, SCHEMA)


def fan_out(raw: DataFrame, prefix: str = "path", body: str = "content") -> DataFrame:
    """Documents of JSON arrays of {path, contents} or {filename, content}; empty ones go; what is no array is one document."""
    items = F.from_json(body, "array<struct<path:string,filename:string,contents:string,content:string>>")
    rows = raw.select(F.col(prefix).alias("p"), F.col(body).alias("b"), items.alias("items"))
    many = rows.where("items is not null").select("p", F.inline("items"))
    name = F.coalesce(F.nullif("path", F.lit("")), F.nullif("filename", F.lit("")), F.lit(""))
    text = F.coalesce(F.nullif("contents", F.lit("")), F.nullif("content", F.lit("")))
    many = many.select(F.concat_ws("/", "p", name).alias("path"), text.alias("content")).where("content is not null")
    return many.union(rows.where("items is null").select("p", "b"))


def concatenated(docs: DataFrame) -> DataFrame:
    """One row, content: of one document its text, of several each under its path."""
    shown = F.concat(F.lit("=== "), F.col("path"), F.lit(" ===\n"), F.col("content"))
    rows = docs.agg(F.array_sort(F.collect_list(F.struct("path", "content", shown.alias("shown")))).alias("x"))
    return rows.select(F.when(F.size("x") == 1, F.col("x")[0]["content"]).otherwise(F.array_join(F.transform("x", lambda y: y["shown"]), "\n\n")).alias("content"))


def read_git(spark: SparkSession, path: str, *, pattern: str | None = None) -> DataFrame:
    """The text files of a repository: a folder, or a remote one, cloned at depth 1."""
    if is_remote_git(path):
        # cloned on the driver's machine, then put where all executors can read it
        with tempfile.TemporaryDirectory(prefix="loam-git-") as to:
            subprocess.run(["git", "clone", "--depth", "1", "--", path, to], check=True, capture_output=True, timeout=300)
            path = shared_path(spark, "git")
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path(to), at)
    files = read_text(spark, path, pattern=pattern, recursive=True, binary="skip")
    return files.where(~F.col("path").contains("/.git/"))


def read_fetched(bodies: DataFrame, loaders: dict[str, str] | None = None) -> DataFrame:
    """Documents of fetched (url, content_type, body): HTML as its text, other text as it is, files by their loader."""
    known = dict(loaders or {})

    def run(batches):
        for b in batches:
            out = []
            for url, kind_, body in zip(*(c.to_pylist() for c in b.columns)):
                mime = (kind_ or "").split(";")[0].strip().lower()
                ext = CONTENT_TYPES.get(mime) or Path((url or "").split("?")[0]).suffix.lstrip(".").lower()
                text = (body or b"").decode(errors="replace")
                if "html" in mime:
                    text = "\n".join(H.read(text).parts)
                elif not mime.startswith("text/") and ext in known:
                    with tempfile.NamedTemporaryFile(suffix=f".{ext}") as f:
                        f.write(body or b"")
                        f.flush()
                        text = run_command(known[ext], f.name)
                out.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["path", "content"])

    return bodies.select("url", "content_type", "body").mapInArrow(run, SCHEMA)


def load(spark: SparkSession, path: str, loaders: dict[str, str], *, pages: DataFrame | None = None) -> DataFrame:
    """Documents of a path; crawls and URLs are read from a table of pages (url, html)."""
    what = kind(path, loaders)
    if what in ("crawl", "url"):
        if pages is None:
            raise ValueError("URLs are read from a table of pages")
        if what == "url":
            return pages.where(F.col("url") == path).select(F.col("url").alias("path"), H.text(F.col("html")).alias("content"))
        seed = spark.createDataFrame([(path.replace("**", ""),)], "url string")
        return H.crawl(pages, seed, max_pages=50).select(F.col("url").alias("path"), F.col("text").alias("content"))
    if what == "protocol":
        name, rest = path.split(":", 1)
        if name == "git":
            return read_git(spark, rest)
        return fan_out(spark.createDataFrame([(path, run_command(loaders[name], rest))], SCHEMA))
    if what == "command":
        return read_commands(spark, [path], loaders)
    if not Path(path).exists() and not any(c in path for c in "*?[{:"):
        raise FileNotFoundError(path)
    return read_text(spark, path)


def load_multi(spark: SparkSession, paths: list[str], loaders: dict[str, str], *, pages: DataFrame | None = None) -> DataFrame:
    """The documents of all paths, by ``load``."""
    out = spark.createDataFrame([], SCHEMA)
    for path in paths:
        out = out.union(load(spark, path, loaders, pages=pages))
    return out


def dependencies(loaders: dict[str, str]) -> dict[str, bool]:
    """The loaders' programs, and whether each is installed."""
    programs = {(shlex.split(template) or [""])[0] for template in loaders.values()}
    return {p: shutil.which(p) is not None for p in sorted(programs)}


def missing_programs(loaders: dict[str, str]) -> dict[str, str]:
    """Loaders whose program isn't installed, with how to get it."""
    there = dependencies(loaders)
    programs = {name: (shlex.split(template) or [""])[0] for name, template in loaders.items()}
    return {name: HINTS.get(p, f"install {p}") for name, p in programs.items() if not there[p]}
