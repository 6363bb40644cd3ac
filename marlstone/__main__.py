"""python -m marlstone ROOT COMMAND ...: a project's data operations from the command line."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marlstone", description=__doc__)
    p.add_argument("root")
    p.add_argument("--store", help="where the index is; ROOT/.marlstone if not given")
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("index").add_argument("--prune", action="store_true", help="forget deleted files")
    c.add_parser("graph")
    c.add_parser("status")
    s = c.add_parser("search")
    s.add_argument("query")
    s.add_argument("--top", type=int, default=10)
    s.add_argument("--density", default="balanced", choices=["minimal", "sparse", "balanced", "detailed", "thorough"])
    s.add_argument("--budget", type=int)
    c.add_parser("impact").add_argument("file")
    m = c.add_parser("memory").add_subparsers(dest="action", required=True)
    m.add_parser("list")
    m.add_parser("recall").add_argument("topic")
    m.add_parser("delete").add_argument("id")
    m.add_parser("audit")
    m.add_parser("save").add_argument("content")
    k = c.add_parser("checkpoint").add_subparsers(dest="action", required=True)
    k.add_parser("list")
    k.add_parser("get")
    k.add_parser("save").add_argument("summary")
    return p


def run(project, a: argparse.Namespace) -> str:
    match a.command, getattr(a, "action", None):
        case "index", _:
            from .sources.git import git_times

            done = project.index(git_times(project.spark, project.root), a.prune)
            return f"Indexed {done['files']} files, {done['chunks']} chunks."
        case "graph", _:
            return f"Graph rebuilt for {project.rebuild_graph()} files."
        case "status", _:
            return "\n".join(f"{k}: {v}" for k, v in project.status().items())
        case "search", _:
            return project.search_context(a.query, a.top, a.density, token_budget=a.budget)
        case "impact", _:
            return project.analyze_impact(str(Path(a.file).absolute()))
        case "memory", "list":
            return "\n".join(f"{r['id']} {r['content']}" + " [stale]" * r["stale"] for r in project.list_memories().toLocalIterator()) or "No memories."
        case "memory", "recall":
            return project.recall(a.topic)
        case "memory", "delete":
            return "Deleted." if project.delete_memory(a.id) else "Not found."
        case "memory", "audit":
            return project.audit_memories()
        case "memory", "save":
            return project.save_learning(a.content)
        case "checkpoint", "list":
            return "\n".join(f"{r['id']} {r['summary']}" for r in project.list_checkpoints().toLocalIterator()) or "No checkpoints."
        case "checkpoint", "get":
            return project.get_checkpoint()
        case _:
            return project.save_checkpoint(a.summary)


def main(args: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from .session import Project

    a = parser().parse_args(args)
    here = str(Path(__file__).resolve().parent.parent)
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (here, os.environ.get("PYTHONPATH"))))
    spark = SparkSession.builder.appName("marlstone").getOrCreate()
    print(run(Project(spark, str(Path(a.root).absolute()), a.store), a))


if __name__ == "__main__":
    main(sys.argv[1:])
