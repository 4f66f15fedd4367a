"""The engine as tools over JSON-RPC on standard input and output (the Model Context Protocol's framing: a message a line)."""

from __future__ import annotations

import json
import sys

from cartulary.api import Engine

_STRING, _NUMBER = {"type": "string"}, {"type": "number"}
#: Tool -> description, properties, required.
TOOLS = {
    "get_context": ("Relevant code for a question.", {"query": _STRING, "max_tokens": _NUMBER}, ["query"]),
    "get_file_context": ("What is known of a file.", {"file_path": _STRING}, ["file_path"]),
    "get_recent_changes": ("Commits and changed files of the last days.", {"days": _NUMBER}, []),
    "find_related": ("Code related to a topic.", {"query": _STRING}, ["query"]),
    "index_repo": ("Brings the index up to date.", {}, []),
    "detect_conventions": ("Coding conventions.", {"category": {"type": "string", "enum": ["naming", "file-structure", "testing", "imports", "exports", "directory"]}}, []),
    "analyze_architecture": ("Modules and concepts.", {"mode": {"type": "string", "enum": ["full", "modules", "concepts"]}}, []),
    "get_graph": ("The knowledge graph.", {"format": {"type": "string", "enum": ["summary", "json", "dot"]}}, []),
}


def call(engine: Engine, name: str, args: dict) -> str:
    if name in ("get_context", "find_related"):
        c = engine.get_context(args["query"], int(args.get("max_tokens") or 4000), summary=name == "get_context")
        return "\n\n".join(x for x in [c.summary, *(s.content for s in c.sections)] if x) or "Nothing found."
    if name == "get_file_context":
        s = engine.get_file_context(args["file_path"])
        return s.content if s else f"File not found: {args['file_path']}"
    if name == "get_recent_changes":
        found = engine.recent_changes(int(args.get("days") or 7))
        return "\n".join([*(f"{h} {s}" for h, s in found["commits"]), "", *found["files"]])
    if name == "index_repo":
        return json.dumps(engine.index())
    if name == "detect_conventions":
        return engine.as_json(engine.conventions(args.get("category")).orderBy("pos"))
    if name == "analyze_architecture":
        mode = args.get("mode", "full")
        if mode == "full":
            return engine.architecture_report()
        return engine.as_json(engine.modules().orderBy("root_path").limit(15) if mode == "modules" else engine.concepts().orderBy("pos"))
    if name == "get_graph":
        kind = args.get("format", "summary")
        if kind == "summary":
            groups = engine.clusters().limit(8).collect()
            return json.dumps(engine.graph_stats() | {"clusters": [{"name": c.name, "size": c.size, "density": c.density} for c in groups]}, indent=2)
        return engine.graph_json() if kind == "json" else engine.graph_dot()
    raise ValueError(f"unknown tool: {name}")


def answer(engine: Engine, request: dict) -> dict | None:
    """The response to a request; None to a notification."""
    if "id" not in request:
        return None
    out = {"jsonrpc": "2.0", "id": request["id"]}
    method, params = request.get("method"), request.get("params") or {}
    if method == "initialize":
        return out | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "cartulary", "version": "0.1"}}}
    if method == "tools/list":
        return out | {"result": {"tools": [{"name": k, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for k, (d, p, r) in TOOLS.items()]}}
    if method == "tools/call":
        try:
            return out | {"result": {"content": [{"type": "text", "text": call(engine, params.get("name", ""), params.get("arguments") or {})}]}}
        except Exception as e:  # noqa: BLE001
            return out | {"result": {"content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}], "isError": True}}
    return out | {"error": {"code": -32601, "message": f"unknown method: {method}"}}


def run(engine: Engine) -> None:
    for line in sys.stdin:
        if line.strip() and (response := answer(engine, json.loads(line))) is not None:
            print(json.dumps(response), flush=True)
