"""Command line: python -m loomgraph COMMAND --root SNAPSHOTS [...]; answers are JSON, or text."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict, is_dataclass

from pyspark.sql import SparkSession

from .plans.engine import Engine
from .plans.renderer import RENDERERS


def without_empty(value):
    """Answers leave out what is empty."""
    if is_dataclass(value):
        value = asdict(value)
    if isinstance(value, dict):
        tidy = {k: without_empty(v) for k, v in value.items()}
        return {k: v for k, v in tidy.items() if v not in (None, "", [], {})}
    return [without_empty(v) for v in value] if isinstance(value, (list, tuple)) else value


def main() -> None:
    parser = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    parser.add_argument("--root", required=True, help="folder of snapshots")
    parser.add_argument("--text", action="store_true", help="summaries and Markdown where there are such")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("index", "refresh"):
        one = commands.add_parser(name)
        one.add_argument("repo")
        if name == "index":
            one.add_argument("--exclude", action="append", default=[])
            one.add_argument("--include-root", action="append", default=[])
    commands.add_parser("status")
    minimal = commands.add_parser("minimal")
    minimal.add_argument("task", nargs="?", default="")
    near = commands.add_parser("graph")
    near.add_argument("node")
    near.add_argument("--depth", type=int, default=1)
    path = commands.add_parser("path")
    path.add_argument("source")
    path.add_argument("target")
    context = commands.add_parser("context")
    context.add_argument("task")
    context.add_argument("--target")
    context.add_argument("--token-budget", type=int, default=800)
    a = parser.parse_args()
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    engine = Engine(spark, a.root)
    calls = {
        "index": lambda: engine.index(a.repo, tuple(a.exclude), tuple(a.include_root)), "refresh": lambda: engine.refresh(a.repo),
        "status": engine.status, "minimal": lambda: engine.minimal(a.task), "graph": lambda: engine.graph(a.node, a.depth),
        "path": lambda: engine.path(a.source, a.target), "context": lambda: engine.context(a.task, a.target, a.token_budget),
    }
    answer = calls[a.command]()
    if a.text and a.command in RENDERERS:
        print(RENDERERS[a.command](answer), end="")
    else:
        print(json.dumps(without_empty(answer), sort_keys=True, ensure_ascii=False))


if __name__ == "__main__":
    main()
