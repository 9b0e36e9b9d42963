"""Command line: ``python -m gleaner index|query|status|config``."""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import sys


def index_path(source: str, home: str) -> str:
    """Where the index of a source folder lies: a folder named by a hash of the source's path."""
    return os.path.join(home, hashlib.sha256(os.path.abspath(source).encode()).hexdigest()[:16])


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="gleaner")
    p.add_argument("--home", default=os.path.expanduser("~/.local/share/gleaner"))
    p.add_argument("--config")
    p.add_argument("--format", choices=("text", "json"), default="text")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in (("index", ("path",)), ("query", ("path", "query")), ("status", ("path",)), ("config", ())):
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        if name == "index":
            s.add_argument("--force", action="store_true")
            s.add_argument("--watch", action="store_true")
        if name == "query":
            s.add_argument("--limit", type=int)
    a = p.parse_args(argv)
    from gleaner.config import Settings

    settings = Settings.load(a.config) if a.config else Settings()
    if a.command == "config":
        print(settings.dump())
        return 0
    from pyspark.sql import SparkSession

    from gleaner.api import Corpus

    spark = SparkSession.builder.appName("gleaner").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel(settings.logging.level)
    where = index_path(a.path, a.home)
    if a.command != "index" and not os.path.exists(where):
        print(f"no index of {a.path}", file=sys.stderr)
        return 1
    corpus = Corpus(spark, where, settings)
    if a.command == "index":
        counts = {r.kind: r["count"] for r in corpus.index(os.path.abspath(a.path), a.force).groupBy("kind").count().collect()}
        print(json.dumps(counts) if a.format == "json" else ", ".join(f"{n} {k}" for k, n in sorted(counts.items())) or "nothing changed")
        if a.watch:
            corpus.indexer().watch(os.path.abspath(a.path), f"{where}-watch", f"{settings.index.debounce_ms} milliseconds").awaitTermination()
    elif a.command == "query":
        rows = corpus.query(a.query, limit=a.limit).collect()
        if a.format == "json":
            cut = lambda t: t if len(t) <= 200 else t[:197] + "..."
            print(json.dumps({"query": a.query, "results": [dict(file=r.file_path, score=r.score, content=cut(r.content.replace("\n", " ")), lines=[r.start_line, r.end_line]) for r in rows]}, ensure_ascii=False))
        else:
            for i, r in enumerate(rows, 1):
                flat = r.content.replace("\n", " ")
                print(f"{i}. {r.file_path} ({r.score:.3f})\n   {flat if len(flat) <= 100 else flat[:97] + '...'}")
    else:
        s = corpus.stats().first()
        print(json.dumps(dict(chunks=s.chunks, files=s.files, bytes=s.bytes)) if a.format == "json" else f"{s.files} files, {s.chunks} chunks, {s.bytes} bytes")
    return 0


if __name__ == "__main__":
    sys.exit(main())
