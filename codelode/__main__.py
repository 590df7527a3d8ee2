"""Command line: ``python -m codelode index|search|status|benchmark|version``."""

from __future__ import annotations

import argparse
import json
import sys

from . import __version__


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="codelode")
    top.add_argument("--store", default="codelode-index", help="folder of the indexes")
    commands = top.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="index a folder")
    index.add_argument("path", nargs="?", default=".")
    index.add_argument("--changed", default="", help="only these paths, between commas")
    search = commands.add_parser("search", help="search the index")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=5)
    search.add_argument("--json", action="store_true")
    commands.add_parser("status", help="counts and health of the index")
    benchmark = commands.add_parser("benchmark", help="hit rates over a fixture")
    benchmark.add_argument("fixture")
    for command in (index, search, commands.choices["status"], benchmark):
        command.add_argument("--project", default="")
    commands.add_parser("version")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    from .plans.engine import Engine
    from .schema import WINDOWS
    from .session import build_session
    from .workspace import parse_changed, tool_scope

    scope = tool_scope(getattr(args, "path", ""), args.project)
    engine = Engine(build_session("*"), args.store, scope.name)
    if args.command == "index":
        print(engine.index_tree(scope.roots, parse_changed(args.changed) or None, report=print)["summary"])
    elif args.command == "search":
        if args.json:
            print(engine.payload(args.query, args.limit, scope))
        else:
            found = engine.search(args.query, args.limit)
            if found.warning:
                print(found.warning)
            for r in found.results.collect():  # at most --limit rows
                print(f"[{r['file_path']}:{r['start_line']}-{r['end_line']}] [{r['category']}/{r['language']}]\n{r['content']}\n")
    elif args.command == "status":
        print(json.dumps(engine.status(), indent=2, default=str))
    else:
        name, hits, rates = engine.benchmark(args.fixture)
        print(name)
        for h in hits.orderBy("query_id").toLocalIterator():
            print(h["query_id"], *(f"top{w}={'HIT' if h[f'hit_{w}'] else 'MISS'}" for w in WINDOWS))
        r = rates.first()
        print(*(f"top{w}: {r[f'hits_{w}']}/{r['queries']} ({r[f'rate_{w}']} %)" for w in WINDOWS))
    return 0


if __name__ == "__main__":
    sys.exit(main())
