"""The engine end to end on a small tree, its store, its stream, and its command line."""

import json

import pytest

from codelode.plans.engine import NO_INDEX, Engine
from codelode.providers import ConstantProvider, HashingProvider
from codelode.sources.store import ChunkStore
from codelode.streaming.refresh import change_files, refresh_stream


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "proj"
    (root / "src").mkdir(parents=True)
    (root / "dist").mkdir()
    (root / "go.mod").write_text("module x\n")
    (root / "src" / "math.go").write_text("package x\n\nfunc Suma(a, b int) int {\n\treturn a + b\n}\n\nfunc Resta(a, b int) int {\n\treturn a - b\n}\n")
    (root / "src" / "load.py").write_text("import os\n\ndef load_config(path):\n    return open(path).read()\n\nclass Loader:\n    pass\n")
    (root / "README.md").write_text("# usage\nload it\n")
    (root / "dist" / "bundle.js").write_text("function x() {}\n")
    (root / "notes.bin").write_text("?")
    return root


def engine(spark, tmp_path, provider=None):
    return Engine(spark, str(tmp_path / "store"), "proj", provider or HashingProvider(64))


def test_index_and_search(spark, tmp_path, tree):
    e = engine(spark, tmp_path)
    assert json.loads(e.payload("x"))["guidance"] == NO_INDEX
    report = e.index_tree([str(tree)])
    assert (report["indexed_files"], report["mode"]) == (2, "full")
    assert {r.file_path for r in e.store.read().select("file_path").distinct().collect()} == {str(tree / "src" / "math.go"), str(tree / "src" / "load.py")}
    found = e.search("load config path")
    assert found.mode == "semantic_hybrid"
    top = found.results.orderBy("rank").first()
    assert top.file_path.endswith("load.py")
    answer = json.loads(e.payload("load config path"))
    assert answer["results"][0]["rank"] == 1 and answer["results"][0]["file_name"] == "load.py" and answer["results"][0]["preview"] and answer["results"][0]["reason"]


def test_incremental_refresh(spark, tmp_path, tree):
    e = engine(spark, tmp_path)
    e.index_tree([str(tree)])
    before = {r.id for r in e.store.read().where("file_path LIKE '%math.go'").collect()}
    (tree / "src" / "load.py").write_text("def other():\n    return 1\n")
    report = e.index_tree([str(tree)], ["src/load.py", "src/gone.go", "README.md", "/elsewhere/x.go"])
    assert report["mode"] == "incremental" and report["indexed_files"] == 1
    rows = e.store.read().collect()
    assert {r.id for r in rows if r.file_path.endswith("math.go")} == before
    assert [r.content for r in rows if r.file_path.endswith("load.py")] == ["def other():\n    return 1"]
    (tree / "src" / "load.py").unlink()
    e.index_tree([str(tree)], ["src/load.py"])
    assert e.store.read().where("file_path LIKE '%load.py'").count() == 0
    e.store.vacuum()
    assert e.store.read().count() == len(before)


def test_search_modes(spark, tmp_path, tree):
    e = engine(spark, tmp_path)
    e.index_tree([str(tree)])
    other = engine(spark, tmp_path, ConstantProvider())
    stale = other.search("SUMA")
    assert stale.mode == "text_stale_index" and stale.warning
    assert [r.file_path.rsplit("/", 1)[1] for r in stale.results.collect()] == ["math.go"]
    with pytest.raises(ValueError):
        other.index_tree([str(tree)], ["src/load.py"])
    e.provider = None
    assert e.search("suma").mode == "text"
    status = other.status()
    assert status["requires_reindex"] and status["files"] == 2 and status["embedded"] == status["chunks"]


def test_benchmark(spark, tmp_path, tree):
    e = engine(spark, tmp_path)
    e.index_tree([str(tree)])
    fixture = tmp_path / "bench.json"
    fixture.write_text(json.dumps({"name": "small", "queries": [{"name": "a", "query": "load config path", "expected_files": ["src/load.py"]}, {"name": "b", "query": "zzz", "expected_chunks": [{"file": "nowhere.go", "start_line": 1, "end_line": 2}]}]}))
    name, hits, rates = e.benchmark(str(fixture))
    assert name == "small" and rates.first()["rate_3"] == 50.0
    assert {(r.query_id, r.hit_3) for r in hits.collect()} == {(1, True), (2, False)}
    fixture.write_text(json.dumps({"queries": [{"name": "a", "query": "x"}]}))
    with pytest.raises(ValueError):
        e.benchmark(str(fixture))


def test_store_deletes_by_literal_prefix(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path), "p", buckets=4)
    row = "'{p}' AS file_path, 'x' AS content, 1 AS start_line, 1 AS end_line, 'go' AS language, CAST(NULL AS string) AS category, timestamp_ntz'2025-01-01 00:00:00' AS created_at, CAST(NULL AS array<float>) AS embedding"
    new = None
    for i, p in enumerate(["/a_b/x.go", "/aXb/x.go", "/a_b.go", "/a_b"]):
        one = spark.sql(f"SELECT CAST({i} AS bigint) AS id, {row.format(p=p)}")
        new = one if new is None else new.union(one)
    store.replace_files(new)
    store.delete_prefix("/a_b")
    assert sorted(r.file_path for r in store.read().collect()) == ["/aXb/x.go", "/a_b.go"]
    store.delete_paths(spark.createDataFrame([("/a_b.go",)], "file_path string"))
    assert store.read().count() == 1 and store.metadata() is None
    assert store.requires_reindex("a", "b", 3) is False
    store.set_metadata("a", "b", 3)
    assert store.requires_reindex("a", "b", 3) is False and store.requires_reindex("a", "c", 3)


def test_stream_refresh(spark, tmp_path):
    e = engine(spark, tmp_path)
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "1.json").write_text(json.dumps({"file_path": "/r/a.go", "content": "func A() {\n}\n"}) + "\n" + json.dumps({"file_path": "/r/b.md", "content": "# x"}) + "\n")
    for content in (None, "func B() {\n}\n"):
        q = refresh_stream(e, change_files(spark, str(drop)), str(tmp_path / "ck"))
        q.awaitTermination()
        if content:
            break
        assert [r.file_path for r in e.store.read().collect()] == ["/r/a.go"]
        (drop / "2.json").write_text(json.dumps({"file_path": "/r/a.go", "content": None}) + "\n" + json.dumps({"file_path": "/r/c.go", "content": "func B() {\n}\n"}) + "\n")
    assert [r.file_path for r in e.store.read().collect()] == ["/r/c.go"]


def test_last_of_several_changes_in_a_batch_counts(spark, tmp_path):
    from codelode.streaming.refresh import refresh_batch

    e = engine(spark, tmp_path)
    rows = [("/r/a.go", "func Z() {\n}\n", 1), ("/r/a.go", "func B() {\n}\n", 2), ("/r/b.go", None, 4), ("/r/b.go", "func C() {\n}\n", 9), ("/r/c.go", "func D() {\n}\n", 3), ("/r/c.go", None, 5)]
    batch = spark.createDataFrame(rows, "file_path string, content string, sequence long")
    for _ in range(2):  # again after a failure
        refresh_batch(e, batch)
        assert sorted((r.file_path, r.content) for r in e.store.read().collect()) == [("/r/a.go", "func B() {\n}"), ("/r/b.go", "func C() {\n}")]
    only = spark.createDataFrame([("/r/b.go",)], "file_path string")
    assert [r.file_path for r in e.store.read_files(only).collect()] == ["/r/b.go"]


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    from codelode.sources.store import StoreConflict

    row = "CAST({i} AS bigint) AS id, '/p{i}.go' AS file_path, 'x' AS content, 1 AS start_line, 1 AS end_line, 'go' AS language, CAST(NULL AS string) AS category, timestamp_ntz'2025-01-01 00:00:00' AS created_at, CAST(NULL AS array<float>) AS embedding"
    one, two = (ChunkStore(spark, str(tmp_path), "p", buckets=1) for _ in range(2))
    stale = one.manifest()
    two.replace_files(spark.sql("SELECT " + row.format(i=1)), metadata=("a", "m", 3))
    with pytest.raises(StoreConflict):
        one._swap(stale | {"metadata": None})
    first = [stale]
    real = one.manifest
    monkeypatch.setattr(one, "manifest", lambda: first.pop() if first else real())  # reads before the other one writes
    one.replace_files(spark.sql("SELECT " + row.format(i=2)))
    assert sorted(r.id for r in two.read().collect()) == [1, 2] and two.metadata()["model"] == "m"
    two.vacuum()
    assert one.read().count() == 2


def test_buckets_are_doubled_as_a_project_grows(spark, tmp_path, monkeypatch):
    from codelode.sources import store as module

    monkeypatch.setattr(module, "BUCKET_BYTES", 3_000)
    s = ChunkStore(spark, str(tmp_path), "p", buckets=1)
    for k in range(3):
        rows = spark.range(k * 40, k * 40 + 40).selectExpr("id", "concat('/f', id, '.go') AS file_path", "repeat(string(id), 40) AS content", "1 AS start_line", "1 AS end_line", "'go' AS language", "CAST(NULL AS string) AS category", "timestamp_ntz'2025-01-01 00:00:00' AS created_at", "CAST(NULL AS array<float>) AS embedding")
        s.replace_files(rows)
    assert s.manifest()["buckets"] > 1 and s.read().count() == 120
    assert s.read_files(spark.createDataFrame([("/f7.go",)], "file_path string")).count() == 1


def test_strict_index_and_single_files(spark, tmp_path, tree):
    class Broken(HashingProvider):
        def embed(self, texts):
            raise RuntimeError("no answer")

    e = engine(spark, tmp_path)
    said = []
    e.index_tree([str(tree / "src" / "load.py")], report=said.append)
    assert {r.file_path for r in e.store.read().collect()} == {str(tree / "src" / "load.py")} and any("1 files" in x for x in said)
    before = e.store.manifest()
    for root in ("notes.bin",):
        with pytest.raises(ValueError, match="unsupported file type"):
            e.index_tree([str(tree / root)])
    e.provider = Broken(64)
    with pytest.raises(Exception, match="no answer"):
        e.index_tree([str(tree)], strict=True)
    assert e.store.manifest() == before
    e.index_tree([str(tree)])
    assert e.store.stats()["embedded"] == 0 and e.store.stats()["files"] == 2


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from codelode import session

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_command_line_arguments():
    from codelode.__main__ import main, parser

    args = parser().parse_args(["index", "/x", "--changed", "a,b", "--project", "p"])
    assert (args.path, args.changed, args.project) == ("/x", "a,b", "p")
    assert main(["version"]) == 0
