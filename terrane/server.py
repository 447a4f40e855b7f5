"""HTTP on this machine: a health check, search and context packs, and the same as JSON-RPC tools."""

from __future__ import annotations

import hashlib
import json
import os
import threading
from collections.abc import Sequence
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from terrane import __version__
from terrane.cli import rows, to_json
from terrane.engine import Engine
from terrane.errors import EngineError
from terrane.operators.retrieval import Request

MOST_BYTES = 1 << 20
PROTOCOL = "2025-06-18"

_SEARCH = {"query": str, "limit": int, "kinds": list, "tags": list, "path_prefix": str, "min_size": int, "max_size": int}
_CONTEXT = {"query": str, "token_budget": int, "limit": int}
_JSON = {str: "string", int: "integer", list: "array"}


def _tool(name: str, description: str, fields: dict) -> dict:
    properties = {f: {"type": _JSON[t], **({"items": {"type": "string"}} if t is list else {})} for f, t in fields.items()}
    return {"name": name, "description": description, "inputSchema": {"type": "object", "properties": properties, "required": ["query"]}}


TOOLS = [_tool("context_pack", "Contents of the best hits within a budget of tokens.", _CONTEXT), _tool("search", "Files and chunks, ranked.", _SEARCH)]


class BadRequest(ValueError):
    """A request that can't be understood."""


def checked(data: dict, fields: dict) -> dict:
    """The fields of a request; an unknown one or one of another type is an error."""
    if not isinstance(data, dict):
        raise BadRequest("an object is expected")
    for name, value in data.items():
        if name not in fields:
            raise BadRequest(f"unknown field {name}")
        if not isinstance(value, fields[name]) or isinstance(value, bool):
            raise BadRequest(f"{name} has another type")
    return data


class Service:
    """Answers over one engine. Requests and errors are counted."""

    def __init__(self, engine: Engine) -> None:
        self.engine, self.requests, self.errors = engine, 0, 0
        self._lock = threading.Lock()

    def count(self, failed: bool) -> None:
        with self._lock:
            self.requests += 1
            self.errors += failed

    def health(self) -> dict:
        version = self.engine.store.current()
        return {"status": "ok", "version": version.number if version else 0, "requests": self.requests, "errors": self.errors}

    def search(self, data: dict) -> list[dict]:
        d = checked(data, _SEARCH)
        request = Request(d.get("limit", 20), d.get("kinds", ()), d.get("tags", ()), d.get("path_prefix", ""), d.get("min_size", 0), d.get("max_size", 0))
        return rows(self.engine.search(d.get("query", ""), request))

    def context(self, data: dict) -> dict:
        d = checked(data, _CONTEXT)
        items = rows(self.engine.context_pack(d.get("query", ""), d.get("token_budget", 0), d.get("limit", 12)))
        return {"query": d.get("query", ""), "items": items, "estimated_tokens": items[0]["estimated_tokens"] if items else 0, "truncated": bool(items and items[0]["truncated"])}

    def rpc(self, data) -> dict | None:
        """Answer to a JSON-RPC message; none to a notification. Unknown fields of the envelope are ignored."""
        if not isinstance(data, dict) or data.get("jsonrpc") != "2.0" or not isinstance(data.get("method"), str):
            return _error(None, -32600, "invalid request")
        number, method, params = data.get("id"), data["method"], data.get("params") or {}
        if method.startswith("notifications/"):
            return None
        if method == "initialize":
            return _result(number, {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "terrane", "version": __version__}})
        if method == "server/discover":
            return _result(number, {"serverInfo": {"name": "terrane", "version": __version__}, "tools": [t["name"] for t in TOOLS]})
        if method == "tools/list":
            return _result(number, {"tools": TOOLS})
        if method != "tools/call":
            return _error(number, -32601, f"unknown method {method}")
        tool = {"search": self.search, "context_pack": self.context}.get(params.get("name") if isinstance(params, dict) else None)
        if tool is None:
            return _error(number, -32602, "unknown tool")
        try:
            found = tool(params.get("arguments") or {})
        except BadRequest as e:
            return _error(number, -32602, str(e))
        except (EngineError, ValueError, LookupError) as e:
            return _error(number, -32000, str(e))
        structured = found if isinstance(found, dict) else {"hits": found}
        return _result(number, {"content": [{"type": "text", "text": to_json(found, compact=True)}], "structuredContent": json.loads(to_json(structured, compact=True))})


def _result(number, value) -> dict:
    return {"jsonrpc": "2.0", "id": number, "result": value}


def _error(number, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": message}}


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_: object) -> None:
            pass

        def _send(self, status: int, value) -> None:
            service.count(status >= 400)
            body = b"" if value is None else to_json(value, compact=True).encode()
            self.send_response(status)
            for name, text in (("Content-Type", "application/json"), ("Content-Length", str(len(body))), ("X-Content-Type-Options", "nosniff"), ("Cache-Control", "no-store")):
                self.send_header(name, text)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            self._send(200, service.health()) if self.path == "/healthz" else self._send(404, {"error": "not found"})

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BYTES:
                self._send(413, {"error": "too large"})
                return
            try:
                data = json.loads(self.rfile.read(size))
            except ValueError:
                self._send(400, _error(None, -32600, "not JSON") if self.path == "/mcp" else {"error": "not JSON"})
                return
            if self.path == "/mcp":
                answer = service.rpc(data)
                self._send(202 if answer is None else 200, answer)
                return
            run = {"/v1/search": service.search, "/v1/context": service.context}.get(self.path)
            if run is None:
                self._send(404, {"error": "not found"})
                return
            try:
                found = run(data)
                self._send(200, {"hits": found} if isinstance(found, list) else found)
            except (BadRequest, ValueError) as e:
                self._send(400, {"error": str(e)})
            except Exception as e:
                self._send(500, {"error": str(e).split("\n")[0]})

    return Handler


def make_server(engine: Engine, port: int = 0) -> ThreadingHTTPServer:
    """A server on the loopback address; port 0 takes any."""
    return ThreadingHTTPServer(("127.0.0.1", port), handler(Service(engine)))


def serve(engine: Engine, port: int, watched: Sequence[str] = ()) -> None:
    """Serves until it is interrupted, and follows the watched folders meanwhile."""
    from terrane.streaming.watch import Watcher

    # beside the index, so that a restart goes on where the last one stopped
    watchers = [Watcher(engine, root, f"{engine.path}/watch/{hashlib.sha256(os.path.abspath(root).encode()).hexdigest()[:16]}") for root in watched]
    for w in watchers:
        w.start()
    server = make_server(engine, port)
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        pass
    finally:
        server.server_close()
        for w in watchers:
            w.stop()
