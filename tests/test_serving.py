import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from terrane import plugins
from terrane.cli import main, to_json
from terrane.engine import Engine, Options
from terrane.server import make_server


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("serve")
    (base / "tree").mkdir()
    (base / "tree/local.go").write_text("package a\n\nfunc LocalContext() int { return 1 }\n")
    (base / "tree/a.md").write_text("索引 words\n")
    index = str(base / "index")
    out = io.StringIO()
    assert main(["--index", index, "--dimensions", "32", "scan", str(base / "tree"), "--tag", "t"], spark, out) == 0
    assert json.loads(out.getvalue())["entries"] == 3
    server = make_server(Engine(spark, index, Options(dimensions=32)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield index, base, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def post(url, data):
    body = data if isinstance(data, bytes) else json.dumps(data).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"})) as r:
            raw = r.read()
            return r.status, json.loads(raw) if raw else None
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def cli(spark, index, *args):
    out = io.StringIO()
    code = main(["--index", index, "--dimensions", "32", *args], spark, out)
    return code, json.loads(out.getvalue()) if out.getvalue() else None


def test_http(served):
    _, base, url = served
    with urllib.request.urlopen(f"{url}/healthz") as r:
        assert json.load(r)["status"] == "ok"
    status, found = post(f"{url}/v1/search", {"query": "LocalContext", "limit": 1})
    assert status == 200 and found["hits"][0]["path"] == str(base / "tree/local.go")
    status, pack = post(f"{url}/v1/context", {"query": "LocalContext", "token_budget": 500})
    assert status == 200 and "LocalContext" in pack["items"][0]["content"] and not pack["truncated"]
    assert post(f"{url}/v1/search", {"query": "x", "other": 1})[0] == 400
    assert post(f"{url}/v1/search", {"query": 5})[0] == 400
    assert post(f"{url}/v1/search", {"query": ""})[0] == 400
    assert post(f"{url}/v1/search", b"{")[0] == 400 and post(f"{url}/nothing", {})[0] == 404


def test_rpc(served):
    _, _, url = served

    def rpc(**message):
        return post(f"{url}/mcp", {"jsonrpc": "2.0", "id": 1, **message})[1]

    assert rpc(method="initialize", extra=1)["result"]["serverInfo"]["name"] == "terrane"
    assert {t["name"] for t in rpc(method="tools/list")["result"]["tools"]} == {"search", "context_pack"}
    found = rpc(method="tools/call", params={"name": "search", "arguments": {"query": "LocalContext"}})["result"]
    assert json.loads(found["content"][0]["text"]) == found["structuredContent"]["hits"]
    assert rpc(method="nothing")["error"]["code"] == -32601
    assert rpc(method="tools/call", params={"name": "nothing"})["error"]["code"] == -32602
    assert rpc(method="tools/call", params={"name": "search", "arguments": {"x": 1}})["error"]["code"] == -32602
    assert rpc(method="tools/call", params={"name": "search", "arguments": {"query": ""}})["error"]["code"] == -32000
    assert post(f"{url}/mcp", [1])[1]["error"]["code"] == -32600
    assert post(f"{url}/mcp", {"jsonrpc": "2.0", "method": "notifications/initialized"}) == (202, None)


def test_commands(spark, served):
    index, base, _ = served
    root = str(base / "tree")
    assert [r["name"] for r in cli(spark, index, "ls", root)[1]] == ["a.md", "local.go"]
    assert cli(spark, index, "du", root)[1][0]["entries"] == 3
    assert cli(spark, index, "by-tag", "t")[1][0]["path"] == root
    assert cli(spark, index, "big", "0.00001")[1]
    assert cli(spark, index, "find", "索引")[1][0]["path"].endswith("a.md")
    assert cli(spark, index, "query", "SELECT count(*) AS n FROM chunks")[1] == {"columns": ["n"], "rows": [[2]], "truncated": False}
    assert cli(spark, index, "doctor")[1]["missing_paths"] == 0
    assert cli(spark, index, "query", "DROP TABLE files")[0] == 1 and cli(spark, index, "tag", "/nothing", "x")[0] == 1
    assert to_json({"a": "索引<"}) == '{\n  "a": "索引<"\n}' and to_json({"a": 1}, compact=True) == '{"a":1}'


def test_http_embeddings(spark):
    calls = []

    class Answer(io.BytesIO):
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

    def opener(request, timeout):
        texts = json.loads(request.data)["input"]
        calls.append(len(texts))
        if len(calls) == 1:
            raise urllib.error.HTTPError(request.full_url, 503, "busy", {}, None)
        data = [{"index": i, "embedding": [float(len(t)), 0, 0, 1]} for i, t in enumerate(texts)]
        return Answer(json.dumps({"data": data[::-1]}).encode())

    embed = plugins.http_embedding("http://x.invalid", "m", opener=opener)
    assert embed(["a", "bbb"]) == [[1.0, 0, 0, 1], [3.0, 0, 0, 1]] and calls == [2, 2]
    with pytest.raises(urllib.error.HTTPError):

        def refuse(request, timeout):
            raise urllib.error.HTTPError(request.full_url, 401, "no", {}, None)

        plugins.http_embedding("http://x.invalid", "m", opener=refuse)(["a"])


def test_embedding_batches(spark):
    def sizes(texts):
        return [[float(len(texts)), 1.0] for _ in texts]

    df = spark.range(130).coalesce(1).selectExpr("id", "'t' AS text")
    got = sorted({r.vector[0] for r in plugins.batched(sizes, 2)(df).collect()})
    assert got == [2.0, 64.0]
    with pytest.raises(Exception, match="numbers are needed"):
        plugins.batched(sizes, 3)(df).collect()
