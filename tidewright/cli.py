"""python -m tidewright.cli {types,parsers,extract,info,search,dump,cache} ROOT ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark import StorageLevel
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import corpus
from tidewright.session import session
from tidewright.sources import cache, files, folders


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewright")
    p.add_argument("command", choices=["types", "parsers", "extract", "info", "search", "dump", "cache"])
    p.add_argument("root", nargs="?", default=".")
    p.add_argument("-p", "--pattern")
    p.add_argument("-e", "--ext", action="append")
    p.add_argument("-x", "--exclude", action="append", default=[], help="pattern of a name or a path below root; may be given again")
    p.add_argument("-i", "--ignore-case", action="store_true")
    p.add_argument("-F", "--literal", action="store_true")
    p.add_argument("-n", "--max-hits", type=int, default=20)
    p.add_argument("-m", "--max-files", type=int, default=0, help="hits of the first so many files")
    p.add_argument("--limit-files", type=int, default=0, help="look at the first so many files by path only")
    p.add_argument("--max-bytes", type=int, default=files.MOST_BYTES, help="larger files aren't read")
    p.add_argument("--max-chars", type=int, default=0, help="characters of a text that are shown")
    p.add_argument("--no-meta", action="store_true", help="texts without what is told of them")
    p.add_argument("--files-only", action="store_true")
    p.add_argument("--json", action="store_true", help="JSON lines")
    p.add_argument("--show-errors", action="store_true")
    p.add_argument("--cache", help="folder that keeps parsed texts between runs")
    p.add_argument("--clear", action="store_true", help="empty the cache")
    p.add_argument("-o", "--out")
    return p


def parsed_of(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The wanted files parsed, through the cache where one is given. Files are listed, limited and looked up before any is opened."""
    if not folders.opens(a.root):
        if a.cache or a.limit_files:
            raise SystemExit("--cache and --limit-files need a store that can be listed first")
        return files.extract(files.walk(spark, a.root, a.ext, a.exclude, a.max_bytes))
    listed = files.listed(spark, a.root, a.ext, a.exclude)
    if a.limit_files:
        listed = corpus.first_documents(listed, "path", a.limit_files)
    if a.cache:
        return cache.extract(listed, a.cache, a.max_bytes)
    return files.extract(folders.opened(folders.dealt(listed) if a.limit_files else listed, a.max_bytes))


def main(argv: list[str] | None = None) -> int:
    """Exit 0; 1 if a search finds nothing or a file can't be read; 2 for a bad pattern or a command without what it needs."""
    a = arguments().parse_args(argv)
    spark = session()
    if a.command == "search" and not a.literal:
        # The pattern is proved by the engine that will run it.
        try:
            spark._jvm.java.util.regex.Pattern.compile(a.pattern or "")
        except IllegalArgumentException as error:
            print(f"bad pattern: {error}", file=sys.stderr)
            return 2
    if a.command == "parsers":
        _show(corpus.parser_table(files.parsers(spark)), a.json)
        return 0
    if a.command == "cache":
        if not a.cache:
            print("cache: which? (--cache FOLDER)", file=sys.stderr)
            return 2
        if a.clear:
            print(f"{cache.clear(spark, a.cache)} runs removed")
        else:
            _show(cache.stats(spark, a.cache), a.json)
        return 0
    if a.command == "types":
        found = files.listed(spark, a.root, a.ext, a.exclude) if folders.opens(a.root) else files.walk(spark, a.root, a.ext, a.exclude)
        _show(corpus.inventory(found, F.col("path"), files.parsers(spark)), a.json)
        return 0
    parsed = parsed_of(spark, a)
    if a.command == "search":
        return _search(parsed, a)
    if a.command == "dump":
        if folders.opens(a.root):
            files.mirror(parsed, a.root, a.out or "dump", a.max_chars)
        else:
            files.dump(parsed, a.out or "dump", a.max_chars)
        return 0
    failed = 0
    if a.command == "extract" and not a.json:
        for row in parsed.select("path", "error", files.page(a.max_chars, not a.no_meta).alias("page")).toLocalIterator():
            print(f"{row.path}: {row.error}" if row.error else row.page, file=sys.stderr if row.error else sys.stdout)
            failed += row.error is not None
        return int(failed > 0)
    text = F.substring("text", 1, a.max_chars) if a.max_chars else F.col("text")
    facts = ["path", "kind", "fidelity", F.length("text").alias("chars"), *([] if a.no_meta else ["meta"]), "warnings", "error", *([text.alias("text")] if a.command == "extract" else [])]
    for row in parsed.select("error", F.to_json(F.struct(*facts)).alias("json")).toLocalIterator():
        print(row.json)
        failed += row.error is not None
    return int(failed > 0)


def _search(parsed: DataFrame, a: argparse.Namespace) -> int:
    if a.show_errors:
        parsed = parsed.persist(StorageLevel.DISK_ONLY)
        for row in corpus.errors(parsed).toLocalIterator():
            print(f"{row.path}: {row.error}", file=sys.stderr)
    found = corpus.search(parsed.filter("error is null"), ["path"], "text", a.pattern or "", literal=a.literal, ignore_case=a.ignore_case, most=a.max_hits)
    if a.max_files:
        first = found.select("path").distinct().orderBy("path").limit(a.max_files)
        found = found.join(F.broadcast(first) if a.max_files <= cache.BROADCAST_KEYS else first, "path", "left_semi")
    if a.files_only:
        found = found.groupBy("path").agg(F.count("*").alias("hits"))
    n = 0
    for row in found.orderBy("path", *([] if a.files_only else ["line_no"])).toLocalIterator():
        print(json.dumps(row.asDict(), ensure_ascii=False) if a.json else f"{row.path}: {row.hits}" if a.files_only else f"{row.path}:{row.line_no}: {row.text}")
        n += 1
    return 0 if n else 1


def _show(table: DataFrame, as_json: bool) -> None:
    if as_json:
        for row in table.toJSON().toLocalIterator():
            print(row)
    else:
        table.show(200, truncate=False)


if __name__ == "__main__":
    sys.exit(main())
