"""Collections from the command line and in a shell: ``python -m loam.cli --root FOLDER COMMAND ...``."""

from __future__ import annotations

import argparse
import shlex
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loam import config
from loam.collection import Collection, collections, parse_filters
from loam.functions.text import truncated
from loam.sources import loaders as L

HELP = "use NAME | list | add PATH [--refresh] | search QUERY | sources | documents | info | rebuild | quit"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loam", description=__doc__)
    p.add_argument("--root", required=True, help="folder of the collections")
    p.add_argument("--settings", help="YAML file of settings")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    sub.add_parser("deps")
    sub.add_parser("shell").add_argument("name", nargs="?")
    for name in ("add", "search", "info", "documents", "rebuild", "delete"):
        c = sub.add_parser(name)
        c.add_argument("name")
        if name == "add":
            c.add_argument("path")
            c.add_argument("--refresh", action="store_true")
        elif name == "search":
            c.add_argument("query")
            c.add_argument("-k", "--top-k", type=int)
            c.add_argument("--mode", choices=("vector", "keyword", "hybrid"), default="keyword")
            c.add_argument("-f", "--filter", action="append", default=[], help="key:value")
        elif name == "delete":
            c.add_argument("--yes", action="store_true")
    return p


def show_status(status, say: Callable[[str], None]) -> None:
    for r in status.orderBy("path").toLocalIterator():
        say(f"added {r.path} ({r.chunks} chunks)" if r.status == "success" else f"skipped {r.path}: {r.reason}")


def show_hits(hits, say: Callable[[str], None]) -> list[str]:
    """Prints hits, texts cut to 500 characters; the distinct sources, sorted."""
    rows = hits.select("rank", "source", truncated(F.col("text")).alias("text")).orderBy("rank").collect()
    for r in rows:
        say(f"\n--- Result {r['rank']} ---\nSource: {r.source}\nContent:\n{r.text}")
    if not rows:
        say("No results found.")
    return sorted({r.source for r in rows})


def show_info(c: Collection, say: Callable[[str], None]) -> None:
    s = c.stats()
    say(f"Collection: {s['name']}\nTotal chunks: {s['chunks']}\nUnique documents: {s['documents']}")
    for k, v in vars(c.settings).items():
        if k != "document_loaders":
            say(f"  {k}: {v}")


class Shell:
    """Commands on one collection at a time; ``run`` takes a line and is false after quit."""

    def __init__(self, spark: SparkSession, root: str, settings: config.Settings, say: Callable[[str], None] = print):
        self.spark, self.root, self.settings, self.say = spark, root, settings, say
        self.at: Collection | None = None
        self.found: list[str] = []

    def use(self, name: str) -> None:
        self.at = Collection(self.spark, self.root, name, self.settings)
        self.say(f"using {name}")

    def run(self, line: str) -> bool:
        try:
            words = shlex.split(line)
        except ValueError as e:
            self.say(f"error: {e}")
            return True
        if not words:
            return True
        command, rest = words[0], words[1:]
        if command in ("quit", "exit"):
            return False
        try:
            self._do(command, rest)
        except Exception as e:
            self.say(f"error: {e}")
        return True

    def _do(self, command: str, rest: list[str]) -> None:
        if command == "list":
            for name in collections(self.spark, self.root):
                self.say(name)
        elif command == "use" and len(rest) == 1:
            self.use(rest[0])
        elif command not in ("add", "search", "sources", "documents", "info", "rebuild"):
            self.say(HELP)
        elif self.at is None:
            self.say("no collection is in use")
        elif command == "add" and rest:
            paths = [x for x in rest if x != "--refresh"]
            show_status(self.at.add(L.load_multi(self.spark, paths, self.settings.document_loaders), refresh="--refresh" in rest), self.say)
        elif command == "search" and rest:
            self.found = show_hits(self.at.search(" ".join(rest), mode="keyword"), self.say)
        elif command == "sources":
            self.say("\n".join(self.found) or "nothing was searched yet")
        elif command == "documents":
            self.say("\n".join(self.at.documents()))
        elif command == "info":
            show_info(self.at, self.say)
        elif command == "rebuild":
            self.say(f"{self.at.rebuild().n} chunks")
        else:
            self.say(HELP)

    def loop(self, read: Callable[[str], str] = input) -> None:
        while True:
            try:
                line = read(f"{self.at.name if self.at else 'loam'}> ")
            except (EOFError, KeyboardInterrupt):
                return
            if not self.run(line):
                return


def main(args: list[str] | None = None, spark: SparkSession | None = None, say: Callable[[str], None] = print) -> int:
    a = parser().parse_args(args)
    settings = config.load(a.settings) if a.settings else config.Settings()
    if a.command == "deps":
        for program, there in L.dependencies(settings.document_loaders).items():
            say(f"{program}: {'installed' if there else 'missing'}")
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        if a.command == "list":
            for name in collections(spark, a.root):
                say(name)
            return 0
        if a.command == "shell":
            shell = Shell(spark, a.root, settings, say)
            if a.name:
                shell.use(a.name)
            shell.loop()
            return 0
        c = Collection(spark, a.root, a.name, settings)
        if a.command != "add" and not c.exists():
            say(f"error: there is no collection {a.name}")
            return 1
        if a.command == "add":
            show_status(c.add(L.load(spark, a.path, settings.document_loaders), refresh=a.refresh), say)
        elif a.command == "search":
            show_hits(c.search(a.query, top_k=a.top_k, mode=a.mode, filters=parse_filters(a.filter) or None), say)
        elif a.command == "info":
            show_info(c, say)
        elif a.command == "documents":
            say("\n".join(c.documents()))
        elif a.command == "rebuild":
            say(f"{c.rebuild().n} chunks")
        elif a.command == "delete":
            if not a.yes:
                say("error: deletion needs --yes")
                return 1
            c.delete()
            say(f"deleted {a.name}")
    except Exception as e:
        say(f"error: {e}")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
