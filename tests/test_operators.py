"""Chunking, enrichment, ranking, evaluation and plain functions, on hand-made cases."""

import numpy as np
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codelode import schema
from codelode.functions import classify, text, vectors
from codelode.functions.enrich import purpose, semantic_content
from codelode.operators import chunking, evaluate, ranking, search
from codelode.sources.tables import take_once

TSX = """import React from "react";
import { load } from "./load";

export function Panel() {
  return (
    <div />
  );
}
export const useThing = () => {
  return load();
};
describe("panel", () => {
  it("works", () => {});
});
"""


def test_tsx_blocks():
    blocks = chunking.brace_blocks(chunking.split_lines(TSX), "tsx")
    assert [b[0] for b in blocks] == [1, 4, 9, 12]
    assert "import React" in blocks[0][2] and "Panel" in blocks[1][2] and "useThing" in blocks[2][2] and "describe" in blocks[3][2]


def test_go_blocks():
    code = "package main\n\nfunc A(x int) int {\n\tif x > 0 {\n\t\treturn 1\n\t}\n\treturn 2\n}\n\nvar q = 1\nfunc B()\n{\n}\nfunc C() {\n"
    assert [(a, b) for a, b, _ in chunking.brace_blocks(chunking.split_lines(code), "go")] == [(1, 10), (3, 8), (11, 13), (14, 14)]
    assert chunking.brace_blocks(["a"] * 23, "go") == [(1, 10, "\n".join("a" * 10)), (11, 20, "\n".join("a" * 10)), (21, 23, "a\na\na")]
    assert chunking.brace_blocks([], "go") == []


def literal_boundaries(lines, starts, size=10):
    if not starts:
        return [(i + 1, min(i + size, len(lines))) for i in range(0, len(lines), size)]
    ends = [s - 1 for s in starts[1:]] + [len(lines)]
    return ([(1, starts[0] - 1)] if starts[0] > 1 else []) + list(zip(starts, ends))


def test_boundaries_against_a_plain_loop(spark):
    rng = random.Random(4)
    cases = []
    for i in range(60):
        lines = [rng.choice(["def f():", "  class X:", "    x = 1", "", "define", "\tdef g(): pass"]) for _ in range(rng.randint(0, 25))]
        cases.append((f"f{i}", "python", rng.choice(["\n", "\r\n", "\r"]).join(lines) + rng.choice(["", "\n"])))
    got = {}
    for r in chunking.chunk_files(spark.createDataFrame(cases, "file_path string, language string, content string")).orderBy("file_path", "chunk_no").collect():
        got.setdefault(r.file_path, []).append((r.start_line, r.end_line, r.content))
    for path, _, content in cases:
        lines = chunking.split_lines(content)
        starts = [i + 1 for i, x in enumerate(lines) if x.strip().startswith(("def ", "class "))]
        want = [(a, b, "\n".join(lines[a - 1 : b])) for a, b in literal_boundaries(lines, starts)]
        assert sorted(got.get(path, [])) == sorted(want), content


def test_unusual_files(spark):
    rows = [("a", "json", None), ("b", "json", ""), ("c", None, "x"), ("d", "yaml", "k: v"), ("e", "go", "")]
    got = chunking.chunk_files(spark.createDataFrame(rows, "file_path string, language string, content string")).collect()
    assert [(r.file_path, r.content) for r in got] == [("d", "k: v")]


def test_enriched_text(spark):
    row = [("/a/useThing.tsx", "tsx", "export function useThing() {\n  return fetch(1)\n}"), ("/a/m.go", "go", "// x\nfunc Suma(a int) int {\n return a + b }"), ("/a/r.md", "markdown", "hello")]
    got = spark.createDataFrame(row, "p string, l string, c string").select(semantic_content(F.col("p"), F.col("l"), F.col("c")).alias("t"), purpose(F.col("l"), F.col("c")).alias("u")).collect()
    assert got[0].t.startswith("File: useThing.tsx\nLanguage: tsx\nCategory: source\nSignature: export function useThing() {\nPurpose: custom hook; exported api; network or api access; function or callable block; returns computed values\nCode:\n")
    assert got[1].u == "adds or combines two integers; suma dos numeros enteros; function operating on integer values"
    assert got[2].u == "documentation content"


def candidates(spark, rows):
    return spark.createDataFrame(rows, "query_id int, id bigint, file_path string, content string, category string, start_line int, end_line int, score double")


def test_source_beats_build_artifact(spark):
    rows = [(1, 1, "/x/dist/a.js", "function load", "source", 1, 10, 0.61), (1, 2, "/x/src/a.js", "function load", "source", 1, 10, 0.58)]
    ranked = ranking.rerank(candidates(spark, rows), F.lit("load"), ["query_id"]).orderBy("position").collect()
    assert [r.id for r in ranked] == [2, 1]


def test_overlapping_chunks_are_thinned(spark):
    rows = [(1, 1, "/a.go", "x", "source", 1, 43, 0.60), (1, 2, "/a.go", "x", "source", 25, 41, 0.59), (1, 3, "/b.go", "x", "source", 21, 59, 0.58)]
    kept = ranking.thin_out(ranking.rerank(candidates(spark, rows), F.lit("q"), ["query_id"]), ["query_id"]).orderBy("rank").collect()
    assert [(r.id, r.rank) for r in kept] == [(1, 1), (3, 2)]


def test_thinning_equals_the_greedy_walk(spark):
    rng = random.Random(2)
    rows = [(q, q * 100 + i, f"/f{rng.randint(0, 3)}", "x", None, s := rng.randint(1, 80), s + rng.randint(0, 20), rng.random()) for q in range(40) for i in range(12)]
    got = {}
    for r in ranking.thin_out(ranking.rerank(candidates(spark, rows), F.lit("q"), ["query_id"]), ["query_id"], 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for q in range(40):
        kept = []
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: -r[7]):
            same = [k for k in kept if k[2] == r[2]]
            if len(same) < 2 and all(r[5] > k[6] + 12 or k[5] > r[6] + 12 for k in same):
                kept.append(r)
        assert got[q] == [k[1] for k in kept[:5]]


def test_hits_in_windows(spark):
    queries = spark.createDataFrame([(1, ["src/a.go"], [("lib/b.go", 191, 214)]), (2, None, None)], "query_id bigint, expected_files array<string>, expected_chunks array<struct<file: string, start_line: int, end_line: int>>")
    results = spark.createDataFrame([(1, 1, "/x/lib/b.go", 1, 20), (1, 2, "/x/lib/b.go", 200, 230), (1, 3, "/x/./src/a.go", 1, 2)], "query_id bigint, rank int, file_path string, start_line int, end_line int")
    hits = {r.query_id: r for r in evaluate.query_hits(queries, results, (1, 2, 3)).collect()}
    assert (hits[1].hit_1, hits[1].hit_2, hits[1].hit_3) == (False, True, True) and hits[2].hit_3 is False
    only_file = queries.withColumn("expected_chunks", F.lit(None).cast("array<struct<file: string, start_line: int, end_line: int>>"))
    assert evaluate.query_hits(only_file, results, (2, 3)).where("query_id = 1").first()[1:] == (False, True)
    empty = evaluate.hit_rates(evaluate.query_hits(queries.limit(0), results)).first()
    assert (empty.queries, empty.rate_3) == (0, 0.0)


def test_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([], []), (None, [1.0]), ([1.0], [1.0, 2.0])]
    got = [round(r[0], 6) for r in spark.createDataFrame(rows, "a array<float>, b array<float>").select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [0.707107, 0, 0, 0, 0]


def test_batch_search_cuts_hot_projects_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 7)
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 else "q", [rng.gauss(0, 1) for _ in range(4)], None if i % 5 else "docs", "go") for i in range(90)]
    chunks = spark.createDataFrame(rows, "id bigint, project string, embedding array<float>, category string, language string")
    queries = spark.createDataFrame([(1, "hot", [1.0, 0.0, 0.0, 0.0]), (2, "none", [1.0, 0.0, 0.0, 0.0]), (3, "q", None)], "query_id bigint, project string, vector array<float>")
    got = search.batch_topk(chunks, queries, 5).orderBy("rank").collect()
    one = [r.id for r in search.semantic_topk(chunks.where("project = 'hot'"), [1.0, 0.0, 0.0, 0.0], 5).collect()]
    assert [r.id for r in got] == one and {r.query_id for r in got} == {1}
    assert search.batch_topk(chunks.limit(0), queries, 5).count() == 0


def test_rows_delivered_several_times_count_once(spark):
    rows = [(i // 5, "p", [1.0, i // 5 / 10], None, "go") for i in range(60)]
    chunks = spark.createDataFrame(rows, "id bigint, project string, embedding array<float>, category string, language string")
    assert [r.id for r in search.unique_topk(chunks, [1.0, 0.0], 3).collect()] == [0, 1, 2]
    assert [r.id for r in search.unique_topk(chunks, [1.0, 0.0], 50).collect()] == list(range(12))
    once = take_once(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c")], "id bigint, x string"))
    assert sorted((r.id or 0, r.x) for r in once.collect()) == [(0, "c"), (0, "c"), (1, "a"), (2, "b")]


def test_text_search_takes_letters_and_wildcards_as_stated(spark):
    rows = [(1, "Ábc ÉT"), (2, "ábc ét"), (3, "aXb"), (4, "a\\b"), (5, "100%")]
    chunks = spark.createDataFrame(rows, "id bigint, content string").selectExpr("*", "'go' AS language", "CAST(NULL AS string) AS category", "CAST(NULL AS array<float>) AS embedding")
    find = lambda q: [r.id for r in search.text_search(chunks, q).collect()]
    assert find("ÉT") == [1] and find("BC") == [1, 2] and find("a_b") == [3, 4] and find("a\\B") == [4] and find("%") == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("name, language, category", [("Dockerfile.x", "dockerfile", "infra_config"), ("docker-compose.YAML", "yaml.compose", "infra_config"), ("a.b.TS", "typescript", "source"), ("x.lock", "lockfile", "dependency_metadata"), ("README.md", "markdown", "docs"), (".env", None, None), ("run.sh", "shell", "scripts"), ("x.ini", "ini", "infra_config")])
def test_names(spark, name, language, category):
    path = F.lit("/p/" + name)
    assert spark.range(1).select(classify.language_of(path), classify.category_of(classify.language_of(path))).first()[:] == (language, category)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_line_splitting_is_the_same_in_both_forms(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.lines_of(F.col("t")).alias("x")).collect()
    for r in rows:
        assert r.x == chunking.split_lines(texts[r.i])


def test_preview_and_reason(spark):
    long = "a" * 200
    row = spark.range(1).select(
        text.compact_preview(F.lit(" x\n\ty  z ")), text.compact_preview(F.lit(long)), text.result_reason(F.lit("semantic_hybrid"), F.lit("source"), F.lit("the PARSER here"), F.lit("/a/parser.go")), text.result_reason(F.lit("text"), F.lit("docs"), F.lit("x"), F.lit("/a/q.go"))
    ).first()
    assert row[0] == "x y z" and row[1] == "a" * 157 + "..."
    assert row[2] == "strong semantic match; actionable source code; file content aligns with file name" and row[3] == "relevant ranked match"
    assert schema.boundary_pattern("json") is None


def test_batch_search_by_scan_and_by_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, "p" if i % 3 else "q", rng.normal(size=8 if i % 11 else 4).tolist(), None, "go") for i in range(400)]
    rows += rows[:40] + [(900, "p", None, None, "go"), (901, "p", [], None, "go"), (902, "p", [0.0] * 8, None, "go"), (903, None, [1.0] * 8, None, "go")]
    chunks = spark.createDataFrame(rows, "id bigint, project string, embedding array<float>, category string, language string").repartition(5)
    asked = [(k, "pq"[k % 2], rng.normal(size=8 if k % 5 else 4).tolist()) for k in range(12)] + [(50, "none", [1.0] * 8), (51, "p", None), (52, "q", [0.0] * 8)]
    queries = spark.createDataFrame(asked, "query_id bigint, project string, vector array<float>")
    scan = {(r.query_id, r.id, r["rank"]) for r in search.batch_topk(chunks, queries, 7).collect()}
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(search, "BLOCK_ROWS", 50)
    assert {(r.query_id, r.id, r["rank"]) for r in search.batch_topk(chunks, queries, 7).collect()} == scan
    assert len({q for q, _, _ in scan}) == 13 and max(r for _, _, r in scan) == 7
    for q, project, v in asked[:12]:
        best = sorted(((-float(np.dot(np.float32(x), np.float32(v)) / np.linalg.norm(np.float32(x)) / np.linalg.norm(np.float32(v))), i) for i, p, x, _, _ in rows[:400] if p == project and len(x) == len(v)))[:7]
        assert [i for _, i in best] == [i for _, i in sorted((r, i) for k, i, r in scan if k == q)]
