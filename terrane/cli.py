"""Command line: ``python -m terrane.cli --index DIR COMMAND ...``; results are JSON."""

from __future__ import annotations

import argparse
import json
import sys

from terrane.engine import Engine, Options
from terrane.errors import EngineError
from terrane.operators.retrieval import Request


def to_json(value, compact: bool = False) -> str:
    """Two spaces a level, or without any space; other scripts stay readable."""
    return json.dumps(value, ensure_ascii=False, default=str, **({"separators": (",", ":")} if compact else {"indent": 2}))


def rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="terrane", description="Index a folder tree and ask it.")
    p.add_argument("--index", required=True, help="folder of the index")
    p.add_argument("--all-files", action="store_true")
    p.add_argument("--include", action="append", default=[], metavar="GLOB")
    p.add_argument("--exclude", action="append", default=[], metavar="GLOB")
    p.add_argument("--concept-fusion", action="store_true")
    p.add_argument("--dimensions", type=int, default=256)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple[str, dict], help: str = "") -> None:
        c = sub.add_parser(name, help=help)
        for flag, options in arguments:
            c.add_argument(flag, **options)

    path, text, limit = ("path", {}), ("text", {}), ("--limit", {"type": int, "default": 20})
    command("init", help="make an empty index")
    command("scan", path, ("--tag", {"action": "append", "default": []}), ("--skip-unchanged", {"action": "store_true"}), help="bring a subtree up to date")
    command("sync", ("path", {"nargs": "+"}), help="bring single paths up to date")
    command("query", text, ("--max-rows", {"type": int}), help="read-only SQL")
    command("search", text, limit, ("--kind", {"action": "append", "default": []}), ("--tag", {"action": "append", "default": []}), ("--prefix", {"default": ""}), ("--min-size", {"type": int, "default": 0}), ("--max-size", {"type": int, "default": 0}), help="ranked search")
    command("context", text, ("--budget", {"type": int, "default": 0}), limit, help="contents of the best hits within a budget of tokens")
    command("find", text, help="files with any of the words")
    command("ls", path, help="children of a folder")
    command("big", ("mebibytes", {"type": float}), help="files over a size")
    command("du", path, help="number and bytes of a subtree")
    command("by-tag", ("tag", {}), help="files with a tag")
    command("related", text, limit, help="concepts that occur with one")
    command("concept-occurrences", text, limit, help="where a concept occurs")
    command("callers", text, help="who calls a function")
    command("tag", path, ("tag", {}))
    command("untag", path, ("tag", {}))
    command("rename", path, ("new", {}))
    command("rm", path, ("--recursive", {"action": "store_true"}))
    command("rebuild", help="make derived tables again")
    command("doctor", help="integrity counts")
    command("serve", ("--port", {"type": int, "default": 8765}), ("--watch", {"action": "append", "default": []}), help="answer HTTP requests on this machine")
    return p


def run(engine: Engine, a: argparse.Namespace):
    """Result of a command, as JSON can hold it."""
    c = a.command
    if c == "init":
        return {"index": engine.path}
    if c == "scan":
        r = engine.scan(a.path, a.tag, a.skip_unchanged)
        return {"root": r.root, "entries": r.entries, "seconds": round(r.seconds, 3)}
    if c == "sync":
        return {"paths": engine.sync(a.path)}
    if c == "query":
        r = engine.query(a.text, max_rows=a.max_rows)
        return {"columns": r.columns, "rows": r.rows, "truncated": r.truncated}
    if c == "search":
        return rows(engine.search(a.text, Request(a.limit, a.kind, a.tag, a.prefix, a.min_size, a.max_size)))
    if c == "context":
        items = rows(engine.context_pack(a.text, a.budget, a.limit))
        return {"query": a.text, "items": items, "estimated_tokens": items[0]["estimated_tokens"] if items else 0, "truncated": bool(items and items[0]["truncated"])}
    if c == "doctor":
        return engine.check()
    if c in ("tag", "untag"):
        getattr(engine, c)(a.path, a.tag)
    elif c == "rename":
        engine.rename(a.path, a.new)
    elif c == "rm":
        engine.remove(a.path, a.recursive)
    elif c == "rebuild":
        engine.rebuild()
    else:
        frame = {
            "find": lambda: engine.find(a.text),
            "ls": lambda: engine.list(a.path),
            "big": lambda: engine.big(int(a.mebibytes * (1 << 20))),
            "du": lambda: engine.disk_usage(a.path),
            "by-tag": lambda: engine.by_tag(a.tag),
            "related": lambda: engine.related(a.text, a.limit),
            "concept-occurrences": lambda: engine.concept_occurrences(a.text, a.limit),
            "callers": lambda: engine.callers(a.text),
        }[c]()
        return rows(frame)
    return {"done": c}


def main(arguments: list[str] | None = None, spark=None, out=sys.stdout) -> int:
    a = parser().parse_args(arguments)
    if spark is None:
        from terrane.session import local_session

        spark = local_session()
    try:
        options = Options(dimensions=a.dimensions, include=a.include, exclude=a.exclude, all_files=a.all_files, concept_fusion=a.concept_fusion)
        engine = Engine(spark, a.index, options)
        if a.command == "serve":
            from terrane.server import serve

            serve(engine, a.port, a.watch)
            return 0
        print(to_json(run(engine, a)), file=out)
    except (EngineError, OSError, ValueError, LookupError) as e:
        print(f"terrane: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
