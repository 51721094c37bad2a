"""The engine's four questions as tools over standard input and output: JSON-RPC 2.0, one message a line.

``python -m corvid serve --products products.json`` answers ``initialize``, ``ping``, ``tools/list`` and ``tools/call``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import TextIO

from corvid.engine import DEFAULT, LEAST, MOST, Engine, as_json

PROTOCOL = "2024-11-05"
INVALID, UNKNOWN, BROKEN = -32602, -32601, -32700


def tools(engine: Engine) -> list[dict]:
    """Names, descriptions and argument schemas."""
    words = {"type": "string", "minLength": 1}
    product = {"type": "string", "enum": sorted(engine.by_id)}
    limit = {"type": "integer", "minimum": LEAST, "maximum": MOST, "default": DEFAULT}
    shape = lambda must, **fields: {"type": "object", "properties": fields, "required": must}
    return [
        {"name": "search_docs", "description": "Sections of all documentation that are most similar to a question.", "inputSchema": shape(["query"], query=words, product=product, limit=limit)},
        {"name": "get_guide", "description": "Sections of one product's documentation on a topic.", "inputSchema": shape(["topic", "product"], topic=words, product=product)},
        {"name": "explain_concept", "description": "Sections of all documentation on a concept.", "inputSchema": shape(["concept"], concept=words)},
        {"name": "list_products", "description": "The documentation sources.", "inputSchema": shape([])},
    ]


def called(engine: Engine, name: str, given: dict) -> str:
    """A tool's answer as text; ValueError for arguments that are not as the schema says."""
    known = {t["name"]: t["inputSchema"] for t in tools(engine)}
    if name not in known:
        raise ValueError(f"unknown tool {name!r}")
    lacking = [k for k in known[name]["required"] if k not in given]
    if lacking:
        raise ValueError(f"missing {', '.join(lacking)}")
    if name == "search_docs":
        return as_json(engine.search(given["query"], given.get("product"), given.get("limit", DEFAULT)))
    if name == "get_guide":
        return as_json(engine.guide(given["topic"], given["product"]))
    if name == "explain_concept":
        return as_json(engine.explain(given["concept"]), given["concept"])
    return as_json(engine.products(), empty="No products.")


def answered(engine: Engine, message: dict) -> dict | None:
    """The answer to one message; none to a notification."""
    if "id" not in message:
        return None
    method, given = message.get("method"), message.get("params") or {}
    result, error = None, None
    if method == "initialize":
        result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "corvid", "version": "1"}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": tools(engine)}
    elif method == "tools/call":
        try:
            result = {"content": [{"type": "text", "text": called(engine, given.get("name"), given.get("arguments") or {})}]}
        except ValueError as e:
            error = {"code": INVALID, "message": str(e)}
        except Exception as e:  # noqa: BLE001 - a question that fails must not end the server
            result = {"content": [{"type": "text", "text": str(e)}], "isError": True}
    else:
        error = {"code": UNKNOWN, "message": f"unknown method {method!r}"}
    return {"jsonrpc": "2.0", "id": message["id"], **({"error": error} if error else {"result": result})}


def serve(engine: Engine, lines: Iterable[str], out: TextIO) -> None:
    """Answer messages until the input ends."""
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            reply = answered(engine, message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": BROKEN, "message": "not an object"}}
        except json.JSONDecodeError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": BROKEN, "message": str(e)}}
        if reply is not None:
            out.write(json.dumps(reply, ensure_ascii=False) + "\n")
            out.flush()
