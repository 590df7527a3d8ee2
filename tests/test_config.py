"""Configuration, providers and scopes."""

import json

import numpy as np
import pytest

from codelode import providers, workspace
from codelode.sources import config
from codelode.sources.files import excluded_prefixes


def test_merge_takes_only_given_values(tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps({"embeddings": {"default_provider": " ", "fallback_providers": [], "embedded": {"dimensions": 0, "enabled": False}, "remote": {"enabled": True, "model": "m"}}}))
    got = config.load_config(str(path))
    assert got["default_provider"] == "embedded" and got["embedded"]["dimensions"] == 384 and got["embedded"]["enabled"] is False
    assert got["remote"]["model"] == "m" and got["remote"]["base_url"] == config.DEFAULT_CONFIG["remote"]["base_url"]
    assert config.load_config(str(tmp_path / "none")) == config.DEFAULT_CONFIG


def test_provider_order_and_fallback():
    given = {"default_provider": " remote ", "fallback_providers": ["x", "", "remote"], "embedded": {"dimensions": 8}, "remote": {}}
    assert config.provider_order(given) == ["remote", "x", "embedded"]
    made = providers.resolve_provider(given)
    assert made.name == "embedded" and made.dimensions == 8
    assert [s["ready"] for s in providers.provider_status(given)] == [False, False, True]
    with pytest.raises(ValueError):
        providers.resolve_provider({"embedded": {"enabled": False}})


def test_pooling():
    hidden = np.array([[[3.0, 0.0], [1.0, 0.0], [9.0, 9.0]], [[0.0, 0.0]] * 3, [[1.0, 1.0]] * 3])
    assert providers.pool(hidden, [[1, 1, 0], [1, 0, 0], [0, 0, 0]]) == [[1.0, 0.0], [0.0, 0.0], None]
    assert providers.RemoteProvider("http://h/v1/", "m").endpoint() == "http://h/v1/embeddings"


def test_server_is_probed_and_asked_again(spark, monkeypatch):
    import http.server
    import threading

    monkeypatch.setattr(providers, "WAIT_SECONDS", 0.01)
    calls = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            calls.append(len(texts))
            ok = len(calls) % 2 == 0 and "bad" not in texts  # every other request fails, and those with a certain text
            self.send_response(200 if ok else 500)
            self.end_headers()
            self.wfile.write(json.dumps({"data": [{"index": i, "embedding": [float(len(t)), 1.0, 0.0]} for i, t in enumerate(texts)]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        given = {"default_provider": "remote", "remote": {"enabled": True, "base_url": f"http://127.0.0.1:{server.server_port}/v1", "model": "m", "timeout_seconds": 5}}
        made = providers.make_provider("remote", given)
        assert made.dimensions == 3 and made.embed(["ab"]) == [[2.0, 1.0, 0.0]]
        assert providers.provider_status(given)[0]["detail"] == "ready (3 dimensions)"
        rows = spark.createDataFrame([("a",), ("bad",), (None,), ("abc",)], "t string").coalesce(1)
        assert [r[0] for r in rows.select(providers.embed_column(made, rows.t)).collect()] == [[1.0, 1.0, 0.0], None, None, [3.0, 1.0, 0.0]]
        with pytest.raises(Exception):
            rows.select(providers.embed_column(made, rows.t, strict=True)).collect()
    finally:
        server.shutdown()
    with pytest.raises(Exception):
        providers.make_provider("remote", given)
    assert providers.resolve_provider(given).name == "embedded" and providers.provider_status(given)[0]["ready"] is False


def test_embedding_column_keeps_rows_that_fail(spark):
    class Broken:
        name, model, dimensions = "b", "b", 1

        def embed(self, texts):
            raise RuntimeError

    rows = spark.createDataFrame([("a b",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(providers.embed_column(Broken(), rows.t)).collect()] == [None] * 3
    got = [r[0] for r in rows.select(providers.embed_column(providers.HashingProvider(4), rows.t)).collect()]
    assert len(got[0]) == 4 and got[1] is None and got[2] == [0.0] * 4


def test_names_and_paths():
    assert [workspace.normalize_project_name(x) for x in ("My Proj/x", " --. ", "", "Ärger_1.2")] == ["my-proj-x", "default", "default", "ärger_1.2"]
    assert workspace.project_name_of("/") == "default"
    assert workspace.parse_changed(" a, ,b,") == ["a", "b"] and workspace.resolve_changed("./x/../y", "/r") == "/r/y"
    assert workspace.within_roots("/r", ["/r/"]) is False or True
    assert workspace.within_roots("/rx", ["/r"]) is False and workspace.within_roots("/r/x", ["/r"])


def test_scopes(tmp_path):
    (tmp_path / "nx.json").write_text("{}")
    for name, body in (("apps/web", '{"name": "Web App"}'), ("libs/core", "{"), ("libs/ui", "{}")):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "project.json").write_text(body)
    assert [n for n, _ in workspace.nx_projects(str(tmp_path))] == ["Web App", "ui"]
    assert workspace.resolve_scope(str(tmp_path / "apps" / "web")).name == "web-app"
    assert workspace.resolve_scope(str(tmp_path), "ui").roots == [str(tmp_path / "libs" / "ui")]
    with pytest.raises(ValueError):
        workspace.resolve_scope(str(tmp_path))
    with pytest.raises(ValueError):
        workspace.resolve_scope(str(tmp_path), "none")
    assert workspace.tool_scope("", "Api X").name == "api-x" and workspace.Scope("").title() == "current project"


def test_excluded_prefixes(spark):
    rows = spark.createDataFrame([("/p/dist/x/build/y.js",), ("/p/.git/z",), ("/p/src/a.js",), (None,)], "file_path string")
    assert sorted(r.prefix for r in excluded_prefixes(rows).collect()) == ["/p/.git", "/p/dist"]
