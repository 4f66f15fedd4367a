"""Command line: python -m cartulary COMMAND."""

from __future__ import annotations

import argparse
import json
import os

from cartulary.api import Engine
from cartulary.functions.constants import CATEGORY_LABELS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cartulary", description="Index a repository and ask it questions.")
    p.add_argument("--root", default=os.getcwd())
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("init", help="index the repository")
    c.add_argument("-w", "--watch", action="store_true")
    c.add_argument("--tree-sitter", action="store_true", help="syntax trees where a grammar is at hand")
    c.add_argument("--semantic", action="store_true", help="vectors too")
    for name, what in (("context", "relevant code for a question"), ("ask", "the same, with intent and confidence")):
        c = sub.add_parser(name, help=what)
        c.add_argument("query", nargs="+")
        c.add_argument("-f", "--format", choices=("prompt", "structured", "minimal"), default="prompt")
        c.add_argument("-t", "--max-tokens", type=int, default=4000)
    c = sub.add_parser("what-changed", help="recent commits and files")
    c.add_argument("-d", "--days", type=int, default=7)
    c.add_argument("-n", "--count", type=int, default=10)
    c.add_argument("-s", "--since")
    c = sub.add_parser("status", help="what is indexed")
    c.add_argument("--conventions", action="store_true")
    c = sub.add_parser("conventions", help="coding conventions")
    c.add_argument("-c", "--category")
    c.add_argument("-j", "--json", action="store_true")
    c.add_argument("-v", "--verbose", action="store_true")
    c = sub.add_parser("architecture", help="modules and concepts")
    c.add_argument("-j", "--json", action="store_true")
    c.add_argument("-m", "--modules", action="store_true")
    c.add_argument("-c", "--concepts", action="store_true")
    c = sub.add_parser("graph", help="the knowledge graph")
    c.add_argument("-j", "--json", action="store_true")
    c.add_argument("-d", "--dot", action="store_true")
    c.add_argument("-s", "--stats", action="store_true")
    c.add_argument("-o", "--output")
    c = sub.add_parser("serve", help="JSON over HTTP")
    c.add_argument("-p", "--port", type=int, default=4620)
    sub.add_parser("tools", help="JSON-RPC tools on standard input and output")
    return p


def badge(confidence: float, high: float = 0.9, medium: float = 0.7) -> str:
    return "HIGH" if confidence > high else "MED" if confidence > medium else "LOW"


def run(args: argparse.Namespace, engine: Engine) -> str:
    """The command's output."""
    name = args.command
    if name == "init":
        counts = engine.index(args.semantic, args.tree_sitter)
        if args.watch:
            engine.watch(f"{engine.store.root}/watch").awaitTermination()
        return " ".join(f"{k}={v}" for k, v in sorted(counts.items()))
    if name in ("context", "ask"):
        c = engine.get_context(" ".join(args.query), args.max_tokens)
        if args.format == "structured":
            return json.dumps(c.as_dict(), indent=2, ensure_ascii=False)
        body = "\n".join(s.title if args.format == "minimal" else s.content for s in c.sections)
        head = f"Intent: {c.intent}\nConfidence: {c.confidence:.0%}\nTokens: {c.token_cost}\n\n" if name == "ask" else ""
        return f"{head}{c.summary}\n{body}"
    if name == "what-changed":
        found = engine.recent_changes(args.days, args.count, args.since)
        return "\n".join([*(f"{h} {s}" for h, s in found["commits"]), "", *found["stat"], "", *(f"{d['path']}: {d['functions']} functions" for d in found["indexed"])])
    if name == "status":
        if not engine.store.is_indexed:
            return "Not indexed."
        lines = [f"{k}: {v}" for k, v in engine.stats().items()]
        return "\n".join(lines + ([engine.convention_summary()] if args.conventions else []))
    if name == "conventions":
        found = engine.conventions(args.category).orderBy("pos")
        if args.json:
            return engine.as_json(found)
        lines = []
        for r in found.collect():
            lines.append(f"[{badge(r.confidence)}] {CATEGORY_LABELS.get(r.category, r.category)}: {r.name}: {r.description}")
            lines += [f"    {x}" for x in r.examples] if args.verbose else []
        return "\n".join(lines)
    if name == "architecture":
        parts = {"modules": engine.modules().orderBy("root_path")} if args.modules or not args.concepts else {}
        parts |= {"concepts": engine.concepts().orderBy("pos")} if args.concepts or not args.modules else {}
        if args.json:
            return json.dumps({k: json.loads(engine.as_json(v)) for k, v in parts.items()}, indent=2)
        if len(parts) == 2:
            return engine.architecture_report()
        if "modules" in parts:
            return "\n".join(f"{r.name} ({r.root_path}): {len(r.files)} files, cohesion {r.cohesion:.0%}, coupling {r.coupling:.0%}" for r in parts["modules"].collect())
        return "\n".join(f"[{badge(r.confidence, 0.8, 0.5)}] {r.name}: {r.description}" for r in parts["concepts"].collect())
    if name == "graph":
        if args.output and (args.json or args.dot):
            engine.write_graph(os.path.abspath(args.output) if "://" not in args.output else args.output, "json" if args.json else "dot")
            return f"Written to {args.output}"
        if args.json or args.dot:
            out = engine.graph_json() if args.json else engine.graph_dot()
        else:
            groups = [] if args.stats else [f"{c.name}: {c.size} nodes, density {c.density}" for c in engine.clusters().limit(8).collect()]
            out = "\n".join([json.dumps(engine.graph_stats(), indent=2), *groups])
        if args.output:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(out)
            return f"Written to {args.output}"
        return out
    raise ValueError(name)


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("cartulary").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark, os.path.abspath(args.root))
    if args.command == "serve":
        from cartulary.server import serve

        serve(engine, args.port).serve_forever()
    elif args.command == "tools":
        from cartulary.tools import run as serve_tools

        serve_tools(engine)
    else:
        print(run(args, engine))


if __name__ == "__main__":
    main()
