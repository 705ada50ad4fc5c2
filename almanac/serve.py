"""The knowledge base over HTTP and as tools over JSON-RPC lines, with the standard library's server."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import IO
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame

from almanac.api import KnowledgeBase

_STRING, _INTEGER, _SWITCH = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}
#: name: (what it does, parameters, required ones). Fixed values.
TOOLS = {
    "search": ("Full-text search", {"query": _STRING, "limit": _INTEGER, "source": _STRING, "personal_only": _SWITCH, "public_only": _SWITCH}, ["query"]),
    "read": ("A document, or one section of it", {"source": _STRING, "doc_id": _STRING, "section": _STRING}, ["source", "doc_id"]),
    "entity": ("An entity's card", {"name": _STRING, "relations": _SWITCH, "documents": _SWITCH}, ["name"]),
    "sources": ("All sources", {}, []),
    "status": ("Documents and bytes by source and type", {}, []),
}


def rows(df: DataFrame) -> list[dict]:
    """What a caller gets; all of these results are bounded by a limit or by the number of sources."""
    return [json.loads(r) for r in df.toJSON().collect()]


def call(kb: KnowledgeBase, tool: str, given: dict) -> object:
    if tool == "search":
        return rows(kb.search(given["query"], limit=int(given.get("limit") or 20), source=given.get("source"), personal_only=bool(given.get("personal_only")), public_only=bool(given.get("public_only"))))
    if tool == "read":
        reference = f"{given['source']}:{given['doc_id']}" if "doc_id" in given else given["reference"]
        return kb.read(reference, given.get("section"))
    if tool == "entity":
        found = rows(kb.entity(given["name"]))
        for part in ("relations", "documents"):
            if found and given.get(part) is False:
                found[0].pop(part, None)
        return found[0] if found else {"error": "not found", "suggestions": [r["canonical_name"] for r in rows(kb.suggest(given["name"]))]}
    if tool == "sources":
        return rows(kb.list_sources())
    if tool == "status":
        return rows(kb.status())
    raise KeyError(tool)


def answer(kb: KnowledgeBase, path: str) -> tuple[int, object]:
    """Status and body for a path: /api/search?q&limit&source, /api/read/{source}/{doc}, /api/entity/{name}, /api/sources, /api/status."""
    url = urlsplit(path)
    parts, query = [unquote(p) for p in url.path.strip("/").split("/")], {k: v[0] for k, v in parse_qs(url.query).items()}
    try:
        if parts[:2] == ["api", "search"] and "q" in query:
            return 200, call(kb, "search", {"query": query["q"], "limit": query.get("limit"), "source": query.get("source")})
        if parts[:2] == ["api", "read"] and len(parts) == 4:
            return 200, {"text": kb.read(f"{parts[2]}:{parts[3]}")}
        if parts[:2] == ["api", "entity"] and len(parts) == 3:
            found = call(kb, "entity", {"name": parts[2]})
            return (404 if "error" in found else 200), found
        if parts in (["api", "sources"], ["api", "status"]):
            return 200, call(kb, parts[1], {})
    except (KeyError, ValueError) as error:
        return 404, {"error": str(error)}
    return 404, {"error": "no such route"}


def http_server(kb: KnowledgeBase, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, body = answer(kb, self.path)
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def respond(kb: KnowledgeBase, request: dict) -> dict | None:
    """The response to one JSON-RPC request; None for a notification."""
    if "id" not in request:
        return None
    reply: dict = {"jsonrpc": "2.0", "id": request["id"]}
    method, given = request.get("method"), request.get("params") or {}
    if method == "initialize":
        reply["result"] = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "almanac", "version": "1"}}
    elif method == "tools/list":
        reply["result"] = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]}
    elif method == "tools/call" and given.get("name") in TOOLS:
        try:
            said = call(kb, given["name"], given.get("arguments") or {})
            reply["result"] = {"content": [{"type": "text", "text": said if isinstance(said, str) else json.dumps(said, ensure_ascii=False)}]}
        except (KeyError, ValueError) as error:
            reply["result"] = {"content": [{"type": "text", "text": f"not found: {error}"}], "isError": True}
    else:
        reply["error"] = {"code": -32601, "message": f"no method {method}"}
    return reply


def stdio(kb: KnowledgeBase, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout, respond_to: Callable = respond) -> None:
    """One request a line, one response a line, until the input ends."""
    for line in source:
        try:
            reply = respond_to(kb, json.loads(line))
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
            sink.flush()
