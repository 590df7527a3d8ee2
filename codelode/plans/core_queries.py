"""Queries of the core: name, builder, and the SQL that must give the same rows."""

from __future__ import annotations

import pandas as pd

from ..operators import incremental
from ..session import ship_package
from ..sources.tables import spread, table, take_once

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers the decorated ``(spark, sf_dir) -> DataFrame`` under ``name``."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_STATES = """
runs AS (SELECT run_id, max(project) AS project, min(updated_at) AS started_at, max(updated_at) AS ended_at,
  (max({'u': updated_at, 's': coalesce(status, '')}))['s'] AS status FROM index_metadata
  WHERE run_id IS NOT NULL AND updated_at IS NOT NULL GROUP BY run_id)"""


@query(
    "p1_found",
    f"""WITH {_STATES},
ledger AS (SELECT DISTINCT project, file_path, file_created_at AS created_at FROM index_log WHERE run_id IN (SELECT run_id FROM runs WHERE status = 'succeeded')),
one AS (SELECT DISTINCT id, project, file_path, revision, created_at, start_line, content FROM code_chunks),
rev AS (SELECT project, file_path, revision, created_at, string_agg(content, chr(10) ORDER BY start_line) AS text FROM one GROUP BY ALL),
cur AS (SELECT * FROM rev QUALIFY row_number() OVER (PARTITION BY project, file_path ORDER BY revision DESC) = 1),
due AS (SELECT project, file_path, revision FROM cur c
  WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.project = c.project AND l.file_path = c.file_path AND l.created_at = c.created_at)
  AND NOT EXISTS (SELECT 1 FROM rev o JOIN ledger l ON l.project = o.project AND l.file_path = o.file_path AND l.created_at = o.created_at
    WHERE o.project = c.project AND o.file_path = c.file_path AND o.revision < c.revision AND o.text = c.text))
SELECT DISTINCT o.id FROM one o JOIN due d ON o.project = d.project AND o.file_path = d.file_path AND o.revision = d.revision""",
)
def p1_found(spark, sf_dir):
    ship_package(spark)
    chunks = incremental.arriving(spark, f"{sf_dir}/code_chunks.parquet")
    return incremental.due_chunks(chunks, table(spark, sf_dir, "index_log"), table(spark, sf_dir, "index_metadata"), incremental.ARRIVED)


@query(
    "p1_run_horizon",
    f"""WITH {_STATES},
good AS (SELECT project, max({{'s': started_at, 'e': ended_at}}) AS m FROM runs WHERE status = 'succeeded' GROUP BY project)
SELECT r.project, (g.m)['e'] AS last_success_at, min(r.started_at) AS horizon FROM runs r JOIN good g ON r.project = g.project
WHERE r.started_at <= (g.m)['s'] AND (r.ended_at >= (g.m)['s'] OR r.status <> 'succeeded') GROUP BY ALL""",
)
def p1_run_horizon(spark, sf_dir):
    return incremental.reread_horizon(table(spark, sf_dir, "index_metadata"))


# ---- the engine's own operators ---------------------------------------------------------------------------
import string  # noqa: E402

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from .. import schema  # noqa: E402
from ..functions import classify, enrich, text, vectors  # noqa: E402
from ..operators import chunking, evaluate, ranking, search  # noqa: E402

_SPACE = r"[\s\x0b\x{85}\p{Z}]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _base(x: str) -> str:
    return f"regexp_extract({x}, '[^/]*$')"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda k: length(k) >= 2 AND k NOT IN {_in(schema.STOP_TOKENS)})"


def _overlap(q: str, t: str) -> str:
    return f"CASE WHEN len({q}) > 0 AND len({t}) > 0 THEN len(list_intersect(list_distinct({q}), {t}))::DOUBLE / len(list_distinct({q})) ELSE 0 END"


def _language(path: str) -> str:
    b = _base(path)
    tests = {"is": "{b} = {t}", "starts": "starts_with({b}, {t})", "ends": "ends_with({b}, {t})", "compose": "starts_with(lower({b}), {t}) AND (ends_with(lower({b}), '.yml') OR ends_with(lower({b}), '.yaml'))"}
    rules = " ".join(f"WHEN {tests[k].format(b=b, t=_q(t))} THEN {_q(lang)}" for k, t, lang in schema.NAME_RULES)
    exts = " ".join(f"WHEN {_q(e)} THEN {_q(lang)}" for e, lang in schema.EXTENSIONS.items())
    return f"CASE {rules} ELSE CASE CASE WHEN contains({b}, '.') THEN regexp_extract(lower({b}), '[^.]*$') ELSE '' END {exts} END END"


def _category(language: str) -> str:
    table = " ".join(f"WHEN {language} = {_q(k)} THEN {_q(v)}" for k, v in schema.CATEGORIES.items())
    return f"CASE WHEN {language} IS NULL THEN NULL WHEN starts_with({language}, 'yaml') OR starts_with({language}, 'bazel') THEN 'infra_config' {table} ELSE 'source' END"


def _category_default(c: str, language: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL AND {_trim(c)} <> '' THEN {c} WHEN {language} = 'dockerfile' OR starts_with({language}, 'yaml') OR starts_with({language}, 'bazel') THEN 'infra_config' ELSE 'source' END"


def _artifact(path: str) -> str:
    return "(" + " OR ".join(f"contains(lower({path}), {_q(m)})" for m in schema.ARTIFACT_MARKERS) + ")"


def _actionable(category: str, content: str) -> str:
    starts = " OR ".join(f"starts_with({_trim(content)}, {_q(p)})" for p in schema.ACTIONABLE_PREFIXES)
    return f"(coalesce({category} = 'source', false) OR {starts})"


def _cosine(a: str, b: str) -> str:
    fits = f"{a} IS NOT NULL AND {b} IS NOT NULL AND len({a}) = len({b}) AND len({a}) > 0 AND list_inner_product({a}::DOUBLE[], {a}::DOUBLE[]) > 0 AND list_inner_product({b}::DOUBLE[], {b}::DOUBLE[]) > 0"
    return f"CASE WHEN {fits} THEN list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]) ELSE 0 END"


_SEMANTIC = f"embedding IS NOT NULL AND len(embedding) > 0 AND (category IS NULL OR category NOT IN {_in(schema.UNINDEXED)})"
_STORED = "c AS (SELECT DISTINCT id, project, file_path, content, start_line, end_line, language, category, embedding FROM code_chunks)"
_VECTOR = "v AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"


def _stored(spark, sf_dir, *columns):
    """The chunk table as delivered; only the columns named are read.

    Some ids are delivered twice, with equal rows. Each query takes them once where its rows are narrow, so
    that no content or vector is shuffled for it.
    """
    return table(spark, sf_dir, "code_chunks").select("id", *columns)


def _vector(spark, sf_dir):
    """The query vector of the single-query searches: one row of a table of vectors."""
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])


@query(
    "semantic_topk",
    f"""WITH {_STORED}, {_VECTOR}, s AS (SELECT id, file_path, start_line, end_line, {_cosine("embedding", "q")} AS score FROM c, v WHERE {_SEMANTIC} AND len(embedding) = len(q))
SELECT id, file_path, start_line, end_line, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT {schema.CANDIDATES}""",
)
def semantic_topk(spark, sf_dir):
    rows = _stored(spark, sf_dir, "file_path", "start_line", "end_line", "language", "category", "embedding")
    top = search.unique_topk(rows, _vector(spark, sf_dir))
    return top.select("id", "file_path", "start_line", "end_line", F.round("score", 6).alias("score"))


@query(
    "semantic_dim_guard",
    f"""WITH {_STORED}, v AS (SELECT embedding[1:32] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT id, {_cosine("embedding", "q")} AS score FROM c, v WHERE {_SEMANTIC} AND len(embedding) = 32)
SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT {schema.CANDIDATES}""",
)
def semantic_dim_guard(spark, sf_dir):
    rows = _stored(spark, sf_dir, "language", "category", "embedding")
    return search.unique_topk(rows, _vector(spark, sf_dir)[:32]).select("id", F.round("score", 6).alias("score"))


@query("cosine_zero_guard", f"WITH {_STORED}, {_VECTOR} SELECT id, round({_cosine('embedding', 'q')}, 6) AS score FROM c, v")
def cosine_zero_guard(spark, sf_dir):
    asked = F.array(*(F.lit(float(x)) for x in _vector(spark, sf_dir)))
    return _stored(spark, sf_dir, "embedding").select("id", F.round(vectors.cosine(F.col("embedding"), asked), 6).alias("score")).distinct()


@query("semantic_category_filter", f"WITH {_STORED} SELECT project, {_category_default('category', 'language')} AS category, count(*) AS chunks FROM c WHERE {_SEMANTIC} GROUP BY ALL")
def semantic_category_filter(spark, sf_dir):
    rows = search.semantic_rows(_stored(spark, sf_dir, "project", "language", "category", "embedding"))
    return rows.select("id", "project", "category").distinct().groupBy("project", "category").agg(F.count("*").alias("chunks"))


@query("category_default", f"WITH {_STORED} SELECT id, {_category_default('category', 'language')} AS category FROM c")
def category_default(spark, sf_dir):
    return _stored(spark, sf_dir, "category", "language").select("id", classify.category_or_default(F.col("category"), F.col("language")).alias("category")).distinct()


def _like_sql(q: str) -> str:
    fold = f"translate(content, {_q(string.ascii_uppercase)}, {_q(string.ascii_lowercase)})"
    folded = q.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return f"WITH {_STORED} SELECT id, file_path, start_line, end_line, {_category_default('category', 'language')} AS category FROM c WHERE {fold} LIKE {_q('%' + folded + '%')}"


def _text(spark, sf_dir, q):
    rows = _stored(spark, sf_dir, "file_path", "start_line", "end_line", "language", "category", "content")
    return search.text_search(rows, q).select("id", "file_path", "start_line", "end_line", "category").distinct()


@query("text_search", _like_sql("Retry") + f" ORDER BY id LIMIT {schema.RESULTS}")
def text_search(spark, sf_dir):
    return _text(spark, sf_dir, "Retry").orderBy("id").limit(schema.RESULTS)


@query("text_search_all", _like_sql("return"))
def text_search_all(spark, sf_dir):
    return _text(spark, sf_dir, "return")


@query("text_search_wildcard", _like_sql("shelf_lock%7"))
def text_search_wildcard(spark, sf_dir):
    return _text(spark, sf_dir, "shelf_lock%7")


@query("text_search_insensitive", _like_sql("TAMAñO"))
def text_search_insensitive(spark, sf_dir):
    return _text(spark, sf_dir, "TAMAñO")


_STATS = "count(DISTINCT file_path) AS files, coalesce(sum(CASE WHEN embedding IS NOT NULL AND len(embedding) > 0 THEN 1 ELSE 0 END), 0)::BIGINT AS embedded, coalesce(sum(CASE WHEN embedding IS NULL OR len(embedding) = 0 THEN 1 ELSE 0 END), 0)::BIGINT AS unembedded"


def index_statistics(rows, *by):
    """Counts of chunks, files, and chunks with and without a vector."""
    has = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    rows = rows.select(*by, "id", "file_path", has.alias("has")).distinct()
    has = F.col("has")
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    return rows.groupBy(*by).agg(F.count("*").alias("chunks"), F.count_distinct("file_path").alias("files"), one(has).alias("embedded"), one(~has).alias("unembedded"))


@query("index_stats", f"WITH {_STORED} SELECT project, count(*) AS chunks, {_STATS} FROM c GROUP BY project")
def index_stats(spark, sf_dir):
    return index_statistics(_stored(spark, sf_dir, "project", "file_path", "embedding"), "project")


@query("index_stats_empty", f"SELECT count(*) AS chunks, {_STATS} FROM code_chunks WHERE false")
def index_stats_empty(spark, sf_dir):
    return index_statistics(_stored(spark, sf_dir, "file_path", "embedding").where("false"))


_LAST_RUN = "m AS (SELECT project, provider, model, dimensions, updated_at FROM index_metadata QUALIFY row_number() OVER (PARTITION BY project ORDER BY updated_at DESC, run_id DESC) = 1)"


def latest_metadata(runs):
    """The one metadata row that a project keeps: the last one written."""
    last = Window.partitionBy("project").orderBy(F.desc("updated_at"), F.desc("run_id"))
    return runs.withColumn("n", F.row_number().over(last)).where("n = 1").select("project", *schema.METADATA_FIELDS, "updated_at")


@query("metadata_upsert", f"WITH {_LAST_RUN} SELECT * FROM m")
def metadata_upsert(spark, sf_dir):
    return latest_metadata(table(spark, sf_dir, "index_metadata"))


@query(
    "requires_reindex",
    f"WITH {_LAST_RUN} SELECT p.project, m.project IS NOT NULL AND (m.provider, m.model, m.dimensions) IS DISTINCT FROM ('embedded', 'mini-lm-64', 64) AS stale FROM projects p LEFT JOIN m ON m.project = p.project",
)
def requires_reindex(spark, sf_dir):
    kept = latest_metadata(table(spark, sf_dir, "index_metadata")).withColumn("known", F.lit(True))
    same = F.col("provider").eqNullSafe("embedded") & F.col("model").eqNullSafe("mini-lm-64") & F.col("dimensions").eqNullSafe(64)
    joined = table(spark, sf_dir, "projects").select("project").join(kept, "project", "left")
    return joined.select("project", (F.coalesce("known", F.lit(False)) & ~same).alias("stale"))


_GONE = "gone AS (SELECT DISTINCT file_path FROM index_log WHERE run_id % 3 = 0)"


@query("delete_by_path", f"WITH {_STORED}, {_GONE} SELECT id FROM c WHERE file_path NOT IN (SELECT file_path FROM gone)")
def delete_by_path(spark, sf_dir):
    gone = table(spark, sf_dir, "index_log").where("run_id % 3 = 0").select("file_path").distinct()
    return _stored(spark, sf_dir, "file_path").join(gone, "file_path", "left_anti").select("id").distinct()


@query("delete_by_prefix", f"WITH {_STORED} SELECT id FROM c WHERE NOT (file_path = '/srv/checkouts/lunar-edge/src' OR starts_with(file_path, '/srv/checkouts/lunar-edge/src/'))")
def delete_by_prefix(spark, sf_dir):
    return _stored(spark, sf_dir, "file_path").where(~classify.under(F.col("file_path"), "/srv/checkouts/lunar-edge/src")).select("id").distinct()


@query(
    "replace_files",
    """WITH c AS (SELECT DISTINCT id, file_path, revision FROM code_chunks), new AS (SELECT * FROM c WHERE revision > 1)
SELECT id, file_path, revision FROM c WHERE revision = 1 AND file_path NOT IN (SELECT file_path FROM new) UNION ALL SELECT id, file_path, revision FROM new""",
)
def replace_files(spark, sf_dir):
    rows = _stored(spark, sf_dir, "file_path", "revision").distinct()
    new = rows.where("revision > 1")
    kept = rows.where("revision = 1").join(new.select("file_path").distinct(), "file_path", "left_anti")
    return kept.select("id", "file_path", "revision").unionByName(new.select("id", "file_path", "revision"))


@query(
    "incremental_changed",
    f"""WITH f AS (SELECT DISTINCT file_path FROM code_chunks), l AS (SELECT DISTINCT file_path FROM index_log),
k AS (SELECT f.file_path, {_category(_language('f.file_path'))} AS category FROM f)
SELECT l.file_path, CASE WHEN k.file_path IS NULL THEN 'purge' WHEN k.category IN {_in(schema.UNINDEXED)} THEN 'purge' ELSE 'index' END AS action FROM l LEFT JOIN k ON k.file_path = l.file_path""",
)
def incremental_changed(spark, sf_dir):
    changed = table(spark, sf_dir, "index_log").select("file_path").distinct()
    return changed_actions(changed, table(spark, sf_dir, "code_chunks").select("file_path").distinct())


def changed_actions(changed, present):
    """What to do with each changed path: index it, or purge it when it is gone or not to be indexed."""
    known = present.withColumn("category", classify.category_of(classify.language_of(F.col("file_path"))))
    joined = changed.join(known.withColumn("there", F.lit(True)), "file_path", "left")
    index = F.col("there").isNotNull() & classify.is_indexable(F.col("category"))
    return joined.select("file_path", F.when(index, "index").otherwise("purge").alias("action"))


@query("path_dedupe", "SELECT file_path FROM code_chunks UNION SELECT file_path FROM documents WHERE file_path IS NOT NULL")
def path_dedupe(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("file_path").where("file_path IS NOT NULL")
    return table(spark, sf_dir, "code_chunks").select("file_path").union(files).distinct()


_NAMES = ["Dockerfile.dev", "dockerfile", "Makefile", ".gitignore", ".npmrc", "gradlew", "x.gradle.kts", "a.lock", "bun.lockb", "Docker-Compose.prod.YML", "BUILD.bazel", "defs.bzl", "A.TSX", "noext", "x.env", ".editorconfig", "q.kts", "s.mdx", "z.conf"]
_PATHS = f"(SELECT DISTINCT file_path FROM code_chunks UNION SELECT unnest([{', '.join(_q('/x/' + n) for n in _NAMES)}]) AS file_path)"


def _paths(spark, sf_dir):
    extra = spark.createDataFrame([("/x/" + n,) for n in _NAMES], "file_path string")
    return table(spark, sf_dir, "code_chunks").select("file_path").distinct().union(extra)


@query("detect_language", f"SELECT file_path, {_language('file_path')} AS language FROM {_PATHS}")
def detect_language(spark, sf_dir):
    return _paths(spark, sf_dir).withColumn("language", classify.language_of(F.col("file_path")))


@query("classify_category", f"SELECT file_path, {_category(_language('file_path'))} AS category FROM {_PATHS}")
def classify_category(spark, sf_dir):
    return _paths(spark, sf_dir).select("file_path", classify.category_of(classify.language_of(F.col("file_path"))).alias("category"))


_EXCLUDED = f"len(list_intersect(string_split(file_path, '/')[:-2], [{', '.join(_q(d) for d in schema.EXCLUDED_DIRS)}])) > 0"


@query(
    "indexable_files",
    f"WITH k AS (SELECT file_path, {_category(_language('file_path'))} AS category FROM {_PATHS}) SELECT file_path, category, category NOT IN {_in(schema.UNINDEXED)} AS indexed FROM k WHERE category IS NOT NULL AND NOT ({_EXCLUDED})",
)
def indexable_files(spark, sf_dir):
    from ..sources.files import scan_verdicts

    return scan_verdicts(_paths(spark, sf_dir)).select("file_path", "category", "indexed")


@query("excluded_dirs", f"SELECT file_path, {_EXCLUDED} AS excluded FROM {_PATHS}")
def excluded_dirs(spark, sf_dir):
    return _paths(spark, sf_dir).select("file_path", classify.in_excluded_dir(F.col("file_path")).alias("excluded"))


@query("build_artifact", f"SELECT file_path, {_artifact('file_path')} AS artifact FROM {_PATHS}")
def build_artifact(spark, sf_dir):
    return _paths(spark, sf_dir).select("file_path", classify.is_build_artifact(F.col("file_path")).alias("artifact"))


@query("tokenize", f"SELECT query_id, array_to_string({_tokens('query')}, ' ') AS tokens FROM retrieval_queries")
def tokenize(spark, sf_dir):
    return table(spark, sf_dir, "retrieval_queries").select("query_id", F.array_join(text.rank_tokens(F.col("query")), " ").alias("tokens"))


@query("document_tokens", f"SELECT doc_id, len({_tokens('text')})::INTEGER AS tokens FROM documents WHERE text IS NOT NULL")
def document_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(text.rank_tokens(F.col("text"))).alias("tokens"))


@query(
    "token_overlap",
    f"WITH r AS (SELECT query_id, {_tokens('query')} AS q, unnest(expected_files) AS f FROM retrieval_queries) SELECT query_id, f AS file_path, round({_overlap('q', _tokens('f'))}, 6) AS overlap FROM r",
)
def token_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "retrieval_queries").select("query_id", "query", F.explode("expected_files").alias("file_path"))
    return rows.select("query_id", "file_path", F.round(text.overlap_ratio(text.rank_tokens(F.col("query")), text.rank_tokens(F.col("file_path"))), 6).alias("overlap"))


@query("exact_phrase", f"WITH {_STORED} SELECT id FROM c WHERE contains(lower(content), lower({_trim(_q('  Retry patch '))})) OR contains(lower(file_path), 'retry patch')")
def exact_phrase(spark, sf_dir):
    phrase = F.lower(text.trim_space(F.lit("  Retry patch ")))
    rows = _stored(spark, sf_dir, "file_path", "content")
    return rows.where(F.contains(F.lower("content"), phrase) | F.contains(F.lower("file_path"), phrase)).select("id").distinct()


# The batch search: retrieval queries, each within its project, with the vector of a row of ``embeddings``.
_VECTORS = "(SELECT count(*) FROM embeddings)"
_QUERIES = f"qs AS (SELECT r.query_id, r.project, r.query, e.embedding AS q FROM retrieval_queries r JOIN embeddings e ON e.vec_id = r.query_id % {_VECTORS})"
_TOP = f"""sem AS (SELECT id, project, file_path, content, start_line, end_line, language, {_category_default("category", "language")} AS category, embedding FROM c WHERE {_SEMANTIC}),
top AS (SELECT qs.query_id, qs.query, sem.id, {_cosine("sem.embedding", "qs.q")} AS base_score FROM qs JOIN sem ON sem.project = qs.project AND len(sem.embedding) = len(qs.q)
 QUALIFY row_number() OVER (PARTITION BY qs.query_id ORDER BY round({_cosine("sem.embedding", "qs.q")}, 9) DESC, sem.id) <= {schema.CANDIDATES})"""
_PHRASE = f"lower({_trim('query')})"
_SCORE = f"""base_score + CASE WHEN {_PHRASE} <> '' AND (contains(lower(content), {_PHRASE}) OR contains(lower(file_path), {_PHRASE})) THEN {schema.EXACT_PHRASE} ELSE 0 END
 + {schema.TOKEN_OVERLAP} * {_overlap(_tokens("query"), _tokens("file_path || ' ' || " + _base("file_path") + " || ' ' || content"))} + {schema.FILE_NAME} * {_overlap(_tokens("query"), _tokens(_base("file_path")))}
 + CASE WHEN {_actionable("category", "content")} THEN {schema.ACTIONABLE} ELSE 0 END - CASE WHEN {_artifact("file_path")} THEN {schema.BUILD_ARTIFACT} ELSE 0 END"""
_SCORED = f"""sc AS (SELECT top.query_id, sem.id, sem.file_path, sem.start_line, sem.end_line, sem.language, sem.category, sem.content, base_score, {_SCORE} AS score FROM top JOIN sem ON sem.id = top.id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, round(base_score, 9) DESC, id) AS position FROM sc)"""
_THIN = f"""l AS (SELECT *, first_value(start_line) OVER w AS ls, first_value(end_line) OVER w AS le, first_value(position) OVER w AS lp FROM rk WINDOW w AS (PARTITION BY query_id, file_path ORDER BY position)),
el AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_path ORDER BY position) AS in_file FROM l WHERE position = lp OR start_line > le + {schema.SLACK_LINES} OR ls > end_line + {schema.SLACK_LINES}),
res AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position)::INTEGER AS rank FROM el WHERE in_file <= {schema.PER_FILE} QUALIFY rank <= {schema.RESULTS})"""
_SEARCH = f"WITH {_STORED}, {_QUERIES}, {_TOP}, {_SCORED}, {_THIN}"


def query_vectors(spark, sf_dir):
    """``query_id, project, query, vector``: the benchmark queries; their vectors stand in for an embedding model."""
    pool = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n = pool.count()
    rows = table(spark, sf_dir, "retrieval_queries").select("query_id", "project", "query", F.pmod("query_id", F.lit(n)).alias("vec_id"))
    return rows.join(pool, "vec_id").drop("vec_id")


@query("batch_topk_per_query", f"WITH {_STORED}, {_QUERIES}, {_TOP} SELECT query_id, id, round(base_score, 6) AS score FROM top")
def batch_topk_per_query(spark, sf_dir):
    top = search.batch_topk(table(spark, sf_dir, "code_chunks"), query_vectors(spark, sf_dir))
    return top.select("query_id", "id", F.round("score", 6).alias("score"))


def _ranked(spark, sf_dir):
    chunks, asked = table(spark, sf_dir, "code_chunks"), query_vectors(spark, sf_dir)
    return ranking.ranked_candidates(chunks, asked)


@query("hybrid_score", f"{_SEARCH} SELECT query_id, id, round(base_score, 6) AS base_score, round(score, 6) AS score FROM sc")
def hybrid_score(spark, sf_dir):
    return _ranked(spark, sf_dir).select("query_id", "id", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


@query("rerank", f"{_SEARCH} SELECT query_id, id, position::INTEGER AS position FROM rk")
def rerank(spark, sf_dir):
    return _ranked(spark, sf_dir).select("query_id", "id", "position")


@query("dedupe_ranked", f"{_SEARCH} SELECT query_id, id FROM el WHERE in_file <= {schema.PER_FILE}")
def dedupe_ranked(spark, sf_dir):
    return ranking.thin_out(_ranked(spark, sf_dir), ["query_id"], 0).select("query_id", "id")


@query("hybrid_search", f"{_SEARCH} SELECT query_id, rank, id, file_path, start_line, end_line, category, round(score, 6) AS score FROM res")
def hybrid_search(spark, sf_dir):
    found = ranking.hybrid_search(table(spark, sf_dir, "code_chunks"), query_vectors(spark, sf_dir))
    return found.select("query_id", "rank", "id", "file_path", "start_line", "end_line", "category", F.round("score", 6).alias("score"))


_EXT = f"CASE WHEN contains({_base('file_path')}, '.') THEN '.' || regexp_extract({_base('file_path')}, '[^.]*$') ELSE '' END"
_STEM = f"CASE WHEN {_EXT} <> '' AND ends_with(lower({_base('file_path')}), {_EXT}) THEN substr(lower({_base('file_path')}), 1, length({_base('file_path')}) - length({_EXT})) ELSE lower({_base('file_path')}) END"
_FLAT = f"regexp_replace({_trim('content')}, '{_SPACE}+', ' ', 'g')"
_PREVIEW = f"CASE WHEN strlen({_FLAT}) > 160 THEN substr({_FLAT}, 1, 157) || '...' ELSE {_FLAT} END"
_REASON = f"concat_ws('; ', 'strong semantic match', CASE WHEN category = 'source' THEN 'actionable source code' END, CASE WHEN contains(lower(content), {_STEM}) THEN 'file content aligns with file name' END)"


@query("search_payload", f"{_SEARCH} SELECT query_id, rank, file_path, {_base('file_path')} AS file_name, start_line, end_line, language, category, round(score, 6) AS score, {_PREVIEW} AS preview, {_REASON} AS reason FROM res")
def search_payload(spark, sf_dir):
    from .engine import payload_rows

    found = ranking.hybrid_search(table(spark, sf_dir, "code_chunks"), query_vectors(spark, sf_dir))
    return payload_rows(found, "semantic_hybrid").select("query_id", "rank", "file_path", "file_name", "start_line", "end_line", "language", "category", F.round("score", 6).alias("score"), "preview", "reason")


@query("compact_preview", f"SELECT doc_id, {_PREVIEW.replace('content', 'text')} AS preview FROM documents WHERE text IS NOT NULL")
def compact_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.compact_preview(F.col("text")).alias("preview"))


@query("result_reason", f"WITH {_STORED} SELECT id, coalesce(nullif(concat_ws('; ', CASE WHEN category = 'source' THEN 'actionable source code' END, CASE WHEN contains(lower(content), {_STEM}) THEN 'file content aligns with file name' END), ''), 'relevant ranked match') AS reason FROM c")
def result_reason(spark, sf_dir):
    rows = _stored(spark, sf_dir, "category", "content", "file_path")
    return rows.select("id", text.result_reason(F.lit("text"), F.col("category"), F.col("content"), F.col("file_path")).alias("reason")).distinct()


@query(
    "search_fallback",
    f"""WITH {_STORED}, m AS (SELECT r.query_id, r.query, r.project, EXISTS (SELECT 1 FROM c WHERE c.project = r.project AND len(c.embedding) = 64 AND {_SEMANTIC}) AS has FROM retrieval_queries r)
SELECT query_id, CASE WHEN has THEN 'semantic_hybrid' ELSE 'text' END AS mode FROM m""",
)
def search_fallback(spark, sf_dir):
    from .engine import search_modes

    asked = table(spark, sf_dir, "retrieval_queries").select("query_id", "project", F.array_repeat(F.lit(1.0), 64).alias("vector"))
    return search_modes(asked, _stored(spark, sf_dir, "project", "language", "category", "embedding"))


@query(
    "search_modes",
    f"""WITH {_STORED}, {_LAST_RUN}, o AS (SELECT project, (provider, model, dimensions) IS DISTINCT FROM ('embedded', 'mini-lm-64', 64) AS stale FROM m)
SELECT r.query_id, CASE WHEN coalesce(o.stale, false) THEN 'text_stale_index' WHEN r.query_id % 5 = 0 THEN 'text' WHEN EXISTS (SELECT 1 FROM c WHERE c.project = r.project AND len(c.embedding) = 64 AND {_SEMANTIC}) THEN 'semantic_hybrid' ELSE 'text' END AS mode
FROM retrieval_queries r LEFT JOIN o ON o.project = r.project""",
)
def search_modes(spark, sf_dir):
    """All ways a search can go: another model's index, a query whose embedding failed (here every fifth), vectors, words."""
    from .engine import search_modes as modes

    vector = F.when(F.col("query_id") % 5 != 0, F.array_repeat(F.lit(1.0), 64))
    asked = table(spark, sf_dir, "retrieval_queries").select("query_id", "project", vector.alias("vector"))
    return modes(asked, _stored(spark, sf_dir, "project", "language", "category", "embedding"), requires_reindex(spark, sf_dir))


_TARGETS = """tg AS (SELECT query_id, unnest(expected_files) AS file, NULL::INTEGER AS a, NULL::INTEGER AS b FROM retrieval_queries
 UNION ALL SELECT query_id, x.file, x.start_line, x.end_line FROM (SELECT query_id, unnest(expected_chunks) AS x FROM retrieval_queries))"""
_HITS = f"""bst AS (SELECT res.query_id, min(rank) AS best FROM res JOIN tg ON tg.query_id = res.query_id AND (res.file_path = tg.file OR ends_with(res.file_path, '/' || tg.file)) AND (tg.a IS NULL OR (res.start_line <= tg.b AND res.end_line >= tg.a)) GROUP BY ALL),
hits AS (SELECT r.query_id, coalesce(best <= 3, false) AS hit_3, coalesce(best <= 5, false) AS hit_5 FROM retrieval_queries r LEFT JOIN bst ON bst.query_id = r.query_id)"""


def _hits(spark, sf_dir):
    found = ranking.hybrid_search(table(spark, sf_dir, "code_chunks"), query_vectors(spark, sf_dir))
    return evaluate.query_hits(table(spark, sf_dir, "retrieval_queries"), found)


@query("benchmark_hits", f"{_SEARCH}, {_TARGETS}, {_HITS} SELECT * FROM hits")
def benchmark_hits(spark, sf_dir):
    return _hits(spark, sf_dir)


@query("hit_rate", f"{_SEARCH}, {_TARGETS}, {_HITS} SELECT count(*) AS queries, sum(hit_3::INT)::BIGINT AS hits_3, sum(hit_5::INT)::BIGINT AS hits_5, round(100.0 * sum(hit_3::INT) / count(*), 1)::DOUBLE AS rate_3, round(100.0 * sum(hit_5::INT) / count(*), 1)::DOUBLE AS rate_5 FROM hits")
def hit_rate(spark, sf_dir):
    return evaluate.hit_rates(_hits(spark, sf_dir))


@query(
    "self_retrieval_hits",
    f"""WITH {_STORED}, {_TARGETS}, res AS (SELECT r.query_id, c.file_path, c.start_line, c.end_line, row_number() OVER (PARTITION BY r.query_id ORDER BY c.id)::INTEGER AS rank
 FROM retrieval_queries r JOIN c ON c.project = r.project AND contains(lower(c.content), {_tokens("r.query")}[1]) QUALIFY rank <= 5), {_HITS} SELECT * FROM hits""",
)
def self_retrieval_hits(spark, sf_dir):
    asked = table(spark, sf_dir, "retrieval_queries")
    words = asked.select("query_id", "project", F.get(text.rank_tokens(F.col("query")), 0).alias("word")).where("word IS NOT NULL")
    lists = words.groupBy("project").agg(F.collect_list(F.struct("query_id", "word")).alias("words"))  # queries of a project, which are few
    rows = table(spark, sf_dir, "code_chunks").select("id", "project", "file_path", "start_line", "end_line", "content")
    hit = F.filter("words", lambda w: F.contains(F.lower("content"), w["word"]))
    found = rows.join(lists, "project").select("id", "file_path", "start_line", "end_line", F.explode(hit).alias("w")).select("w.query_id", "id", "file_path", "start_line", "end_line")
    # copies of an id are next to each other in the order, so that no distinct is needed before the window
    order = Window.partitionBy("query_id").orderBy("id")
    ranked = found.withColumn("rank", F.dense_rank().over(order)).where("rank <= 5").distinct()
    return evaluate.query_hits(asked, ranked)


@query(
    "describe_targets",
    "SELECT query_id, concat_ws(', ', nullif(array_to_string(expected_files, ', '), ''), nullif(array_to_string(list_transform(expected_chunks, lambda c: c.file || ':' || c.start_line || '-' || c.end_line), ', '), '')) AS targets FROM retrieval_queries",
)
def describe_targets(spark, sf_dir):
    rows = table(spark, sf_dir, "retrieval_queries")
    return rows.select("query_id", evaluate.describe_targets(F.col("expected_files"), F.col("expected_chunks")).alias("targets"))


@query(
    "fixture_violations",
    """WITH f AS (SELECT * FROM (VALUES (1, '', 'q', ['a'], NULL), (2, 'n', ' ', ['a'], NULL), (3, 'n', 'q', NULL, NULL), (4, 'n', 'q', ['a', ' '], NULL), (5, 'n', 'q', NULL, [{'file': 'x', 'start_line': 3, 'end_line': 2}]), (6, 'n', 'q', ['a'], NULL), (7, 'n', 'q', NULL, [{'file': 'x', 'start_line': 1, 'end_line': 2}])) t(position, name, query, files, chunks))
SELECT position, CASE WHEN trim(name) = '' THEN 'name is blank' WHEN trim(query) = '' THEN 'query is blank' WHEN coalesce(len(files), 0) = 0 AND coalesce(len(chunks), 0) = 0 THEN 'no expected file or chunk' WHEN len(list_filter(files, lambda x: trim(x) = '')) > 0 THEN 'an expected file is blank' WHEN len(list_filter(chunks, lambda x: trim(x.file) = '')) > 0 THEN 'an expected chunk has no file' ELSE 'an expected chunk has no valid line range' END AS problem
FROM f WHERE position <= 5""",
)
def fixture_violations(spark, sf_dir):
    one = lambda a, b: [{"file": "x", "start_line": a, "end_line": b}]
    rows = [(1, "", "q", ["a"], None), (2, "n", " ", ["a"], None), (3, "n", "q", None, None), (4, "n", "q", ["a", " "], None), (5, "n", "q", None, one(3, 2)), (6, "n", "q", ["a"], None), (7, "n", "q", None, one(1, 2))]
    ddl = "position int, name string, query string, expected_files array<string>, expected_chunks array<struct<file: string, start_line: int, end_line: int>>"
    return evaluate.fixture_violations(spark.createDataFrame(rows, ddl))


# ---- chunking and enrichment
_LINES = "string_split(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), chr(10))"
_DOCS = f"d AS (SELECT doc_id, CASE WHEN {_LINES}[-1] = '' THEN {_LINES}[:-2] ELSE {_LINES} END AS lines FROM documents WHERE text IS NOT NULL)"
_TUMBLED = f"SELECT doc_id, s AS start_line, least(s + {schema.MAX_LINES - 1}, len(lines)) AS end_line, array_to_string(lines[s:s + {schema.MAX_LINES - 1}], chr(10)) AS content FROM {{source}}, unnest(range(1, len(lines) + 1, {schema.MAX_LINES})) AS u(s)"


def _documents(spark, sf_dir):
    """Documents as files: the id is the path, the language markdown."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.select(F.col("doc_id").cast("string").alias("file_path"), F.lit("markdown").alias("language"), F.col("text").alias("content"))


def _document_chunks(chunks):
    return chunks.select(F.col("file_path").cast("bigint").alias("doc_id"), "start_line", "end_line", "content")


@query("line_chunks", f"WITH {_DOCS}, t AS ({_TUMBLED.format(source='d')}) SELECT doc_id, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, content FROM t")
def line_chunks(spark, sf_dir):
    return _document_chunks(chunking.line_chunks(_documents(spark, sf_dir)))


_MD = schema.boundary_pattern("markdown")


@query(
    "boundary_chunks",
    f"""WITH {_DOCS}, n AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d), b AS (SELECT doc_id, lines, i FROM n WHERE regexp_matches({_trim("lines[i]")}, {_q(_MD)})),
e AS (SELECT doc_id, lines, i AS s, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - 1, len(lines)) AS e FROM b),
p AS (SELECT doc_id, lines, 1 AS s, min(i) - 1 AS e FROM b GROUP BY doc_id, lines HAVING min(i) > 1), r AS (SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM b)), t AS ({_TUMBLED.format(source='r')})
SELECT doc_id, s::INTEGER AS start_line, e::INTEGER AS end_line, array_to_string(lines[s:e], chr(10)) AS content FROM (SELECT * FROM e UNION ALL SELECT * FROM p)
UNION ALL SELECT doc_id, start_line::INTEGER, end_line::INTEGER, content FROM t""",
)
def boundary_chunks(spark, sf_dir):
    return _document_chunks(chunking.boundary_chunks(_documents(spark, sf_dir)))


def _files(spark, sf_dir, languages=None):
    from ..sources.files import current_files

    rows = table(spark, sf_dir, "code_chunks")
    return current_files(rows if languages is None else rows.where(F.col("language").isin(languages)))


def _blocks_sql(where: str) -> str:
    """Chunks of the current files, in SQL: a table of lines with running sums, the end that each start would have,
    and the starts that are reached from end to end.
    """
    depth = lambda a, b: f"sum(length(x) - length(replace(x, '{a}', '')) - length(x) + length(replace(x, '{b}', ''))) OVER w"
    families = [("js", "javascript"), *((k, k) for k in schema.BOUNDARIES if k != "javascript")]
    starts = f"CASE fam WHEN 'go' THEN regexp_matches(t, {_q(schema.GO_FUNCTION)}) " + " ".join(f"WHEN {_q(k)} THEN regexp_matches(t, {_q(schema.boundary_pattern(p))})" for k, p in families) + " ELSE false END"
    words = " OR ".join(f"contains(x, {_q(w)})" for w in chunking.EXPRESSION_WORDS)
    ends = " OR ".join(f"ends_with(t, {_q(w)})" for w in chunking.EXPRESSION_ENDS)
    return f"""WITH RECURSIVE one AS (SELECT DISTINCT id, project, file_path, revision, language, start_line, coalesce(content, '') AS content FROM code_chunks WHERE {where}),
cur AS (SELECT * FROM one QUALIFY revision = max(revision) OVER (PARTITION BY project, file_path)),
txt AS (SELECT project, file_path, max(language) AS language, string_agg(content, chr(10) ORDER BY start_line) AS text FROM cur GROUP BY project, file_path),
f AS (SELECT row_number() OVER () AS f, project, file_path, language, CASE WHEN language IN {_in(schema.JS_FAMILY)} THEN 'js' ELSE language END AS fam, CASE WHEN {_LINES}[-1] = '' THEN {_LINES}[:-2] ELSE {_LINES} END AS lines FROM txt),
l AS (SELECT f, fam, i, lines[i] AS x, {_trim("lines[i]")} AS t FROM f, unnest(range(1, len(lines) + 1)) AS u(i)),
c AS (SELECT f, fam, i, {depth("{", "}")} AS b, {depth("(", ")")} AS p, contains(x, '{{') AS o, ({words}) AS e, (t = '' OR {ends}) AS z, {starts} AS s FROM l WINDOW w AS (PARTITION BY f ORDER BY i)),
s AS (SELECT c.f, c.fam, c.i, coalesce(a.b, 0) AS b0, coalesce(a.p, 0) AS p0 FROM c LEFT JOIN c a ON a.f = c.f AND a.i = c.i - 1 WHERE c.s),
m AS (SELECT s.*, len(any_value(f.lines)) AS n, coalesce(min(CASE WHEN c.o THEN c.i END), len(any_value(f.lines)) + 1) AS o, min(CASE WHEN c.e THEN c.i END) AS e, min(CASE WHEN c.s AND c.i > s.i THEN c.i END) AS nb
  FROM s JOIN f ON f.f = s.f JOIN c ON c.f = s.f AND c.i >= s.i GROUP BY ALL),
k AS (SELECT m.*, min(CASE WHEN c.z AND c.i >= m.e AND c.p <= m.p0 AND c.i < m.o THEN c.i END) AS x, min(CASE WHEN c.i >= m.o AND c.b <= m.b0 THEN c.i END) AS y FROM m JOIN c ON c.f = m.f AND c.i >= m.i GROUP BY ALL),
ends AS (SELECT f, i, CASE WHEN fam IN ('python', 'java', 'shell', 'markdown') THEN coalesce(nb - 1, n) WHEN fam = 'js' AND x IS NOT NULL AND (nb IS NULL OR x <= nb) THEN x WHEN fam = 'js' AND nb < o THEN nb - 1 ELSE coalesce(y, n) END AS last FROM k),
step AS (SELECT e.f, e.i, e.last, min(s.i) AS then_ FROM ends e LEFT JOIN s ON s.f = e.f AND s.i > e.last GROUP BY ALL),
pick AS (SELECT * FROM step QUALIFY i = min(i) OVER (PARTITION BY f) UNION ALL SELECT t.* FROM pick JOIN step t ON t.f = pick.f AND t.i = pick.then_),
rest AS (SELECT f, max(i) AS last, string_agg(x, chr(10) ORDER BY i) AS content FROM l WHERE f IN (SELECT f FROM pick) AND NOT EXISTS (SELECT 1 FROM pick WHERE pick.f = l.f AND l.i BETWEEN pick.i AND pick.last) GROUP BY f),
piece AS (SELECT f, 1 AS a, last AS z, content, 0 AS late FROM rest UNION ALL SELECT pick.f, i, last, array_to_string(lines[i:last], chr(10)), 1 FROM pick JOIN f ON f.f = pick.f
  UNION ALL SELECT f, a, least(a + {schema.MAX_LINES - 1}, len(lines)), array_to_string(lines[a:a + {schema.MAX_LINES - 1}], chr(10)), 1 FROM f, unnest(range(1, len(lines) + 1, {schema.MAX_LINES})) AS u(a) WHERE f NOT IN (SELECT f FROM pick))
SELECT project, file_path, language, (row_number() OVER (PARTITION BY piece.f ORDER BY late, a) - 1)::INTEGER AS chunk_no, a::INTEGER AS start_line, z::INTEGER AS end_line, content FROM piece JOIN f ON f.f = piece.f"""


@query("go_chunks", _blocks_sql("language = 'go'"))
def go_chunks(spark, sf_dir):
    return chunking.brace_chunks(_files(spark, sf_dir, ["go"]))


@query("js_chunks", _blocks_sql("language IN ('javascript', 'typescript')"))
def js_chunks(spark, sf_dir):
    return chunking.brace_chunks(_files(spark, sf_dir, ["javascript", "typescript"]))


@query("chunk_files", _blocks_sql("language IS NOT NULL"))
def chunk_files(spark, sf_dir):
    return chunking.chunk_files(_files(spark, sf_dir))


_BOUNDARY = "CASE " + f"WHEN language IN {_in(schema.JS_FAMILY)} THEN regexp_matches(x, {_q(schema.boundary_pattern('javascript'))}) " + " ".join(f"WHEN language = '{k}' THEN regexp_matches(x, {_q(schema.boundary_pattern(k))})" for k in schema.BOUNDARIES if k != "javascript") + " ELSE false END"
_TRIMMED = f"list_transform(string_split(content, chr(10)), lambda x: {_trim('x')})"
_SIGNATURE = f"coalesce(list_filter({_TRIMMED}, lambda x: CASE WHEN language = 'go' THEN starts_with(x, 'func ') ELSE {_BOUNDARY} END)[1], '')"


def _has(*words):
    return "(" + " OR ".join(f"contains(lower(content), {_q(w)})" for w in words) + ")"


def _role_sql(pattern):
    pattern = pattern.replace(r"\s", r"[\t\n\f\r ]")
    return f"(language IN {_in(schema.JS_FAMILY)} AND len(list_filter({_TRIMMED}, lambda x: regexp_matches(x, {_q(pattern)}))) > 0)"


def _joined_sql(default, parts):
    return f"coalesce(nullif(concat_ws('; ', {', '.join(f'CASE WHEN {c} THEN {_q(t)} END' for c, t in parts)}), ''), {_q(default)})"


def _tags_sql(name):
    default, rules = schema.CATEGORY_TAGS[name]
    roles = [(_role_sql(pattern), tag) for pattern, tag in schema.ROLE_TAGS] if name == "source" else []
    return _joined_sql(default, [*roles, *((_has(*words), tag) for tag, words in rules)])


_GO_SQL = _joined_sql(schema.NO_TAG, [(" AND ".join(_has(*words) for words in choices), tag) for tag, choices in schema.GO_TAGS])
_PURPOSE = f"CASE WHEN language = 'go' THEN {_GO_SQL} ELSE CASE {_category('language')} " + " ".join(f"WHEN {_q(k)} THEN {_tags_sql(k)}" for k in schema.CATEGORY_TAGS if k != "source") + f" ELSE {_tags_sql('source')} END END"


@query("signature", f"WITH {_STORED} SELECT id, {_SIGNATURE} AS signature FROM c")
def signature(spark, sf_dir):
    return spread(_stored(spark, sf_dir, "language", "content")).select("id", enrich.signature(F.col("language"), F.col("content")).alias("signature")).distinct()


@query("purpose", f"WITH {_STORED} SELECT id, {_PURPOSE} AS purpose FROM c")
def purpose(spark, sf_dir):
    return spread(_stored(spark, sf_dir, "language", "content")).select("id", enrich.purpose(F.col("language"), F.col("content")).alias("purpose")).distinct()


@query(
    "semantic_content",
    f"""WITH {_STORED}, s AS (SELECT *, {_SIGNATURE} AS signature, {_PURPOSE} AS purpose FROM c)
SELECT id, concat_ws(chr(10), 'File: ' || {_base("file_path")}, 'Language: ' || language, 'Category: ' || {_category("language")}, CASE WHEN signature <> '' THEN 'Signature: ' || signature END, 'Purpose: ' || purpose, 'Code:' || chr(10) || content) AS enriched FROM s""",
)
def semantic_content(spark, sf_dir):
    rows = spread(take_once(_stored(spark, sf_dir, "file_path", "language", "content")))
    return rows.select("id", enrich.semantic_content(F.col("file_path"), F.col("language"), F.col("content")).alias("enriched"))


@query(
    "mean_pool_normalize",
    """WITH t AS (SELECT label, vec_id % 3 <> 0 AS mask, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM t WHERE mask GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label)
SELECT m.label, m.i::INTEGER AS i, round(CASE WHEN n > 0 THEN x / n ELSE x END, 6) AS x FROM m JOIN n ON n.label = m.label""",
)
def mean_pool_normalize(spark, sf_dir):
    """The vectors of a label as the token vectors of a text, every third one masked out, by the pooling of the local model."""
    from ..providers import pool

    ship_package(spark)
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("tokens"))

    @F.pandas_udf("array<double>")
    def pooled(vectors: pd.Series, masks: pd.Series) -> pd.Series:
        return pd.Series([pool([[*map(list, v)]], [m])[0] for v, m in zip(vectors, masks)], dtype=object)

    mask = F.transform("tokens.vec_id", lambda i: (i % 3 != 0).cast("int"))
    unit = rows.select("label", F.posexplode(pooled(F.col("tokens.embedding"), mask)).alias("i", "x"))
    return unit.select("label", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


@query("normalize_project_name", f"SELECT DISTINCT source, CASE WHEN regexp_replace(regexp_replace(lower({_trim('source')}), '[^\\p{{L}}\\p{{Nd}}_.-]', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') = '' THEN 'default' ELSE regexp_replace(regexp_replace(lower({_trim('source')}), '[^\\p{{L}}\\p{{Nd}}_.-]', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') END AS name FROM (SELECT source FROM documents WHERE source IS NOT NULL UNION SELECT unnest([' Ärger & Co. ', '--..', '', 'My Project/x']) AS source)")
def normalize_project_name(spark, sf_dir):
    extra = spark.createDataFrame([(" Ärger & Co. ",), ("--..",), ("",), ("My Project/x",)], "source string")
    names = table(spark, sf_dir, "documents").select("source").where("source IS NOT NULL").union(extra).distinct()
    return names.select("source", text.normalized_name(F.col("source")).alias("name"))


# ---- configuration-sized operators, over literals and small tables
_CONFIGS = [(1, " remote ", "local, ,embedded,remote"), (2, "", ""), (3, "embedded", " x ,x"), (4, "remote", "remote")]


@query(
    "provider_order",
    f"""WITH c AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_q(d)}, {_q(f)})" for i, d, f in _CONFIGS)}) t(config, d, f)), u AS (SELECT config, unnest(list_concat([d], string_split(f, ','), ['embedded', 'remote'])) AS x, generate_subscripts(list_concat([d], string_split(f, ','), ['embedded', 'remote']), 1) AS i FROM c),
m AS (SELECT config, trim(x) AS x, min(i) AS i FROM u WHERE trim(x) <> '' GROUP BY config, trim(x)) SELECT config, string_agg(x, ',' ORDER BY i) AS providers FROM m GROUP BY config""",
)
def provider_order(spark, sf_dir):
    from ..sources.config import provider_order as order

    rows = [(i, ",".join(order({"default_provider": d, "fallback_providers": f.split(",")}))) for i, d, f in _CONFIGS]
    return spark.createDataFrame(rows, "config int, providers string")


_CHANGED = " /srv/checkouts/lunar-edge/a.go, src//b.go ,, ./c/../d.go"


@query("parse_changed", f"SELECT trim(x) AS path FROM (SELECT unnest(string_split({_q(_CHANGED)}, ',')) AS x) WHERE trim(x) <> ''")
def parse_changed(spark, sf_dir):
    from ..workspace import parse_changed as parsed

    return spark.createDataFrame([(p,) for p in parsed(_CHANGED)], "path string")


@query(
    "select_project",
    "WITH f AS (SELECT DISTINCT file_path FROM code_chunks) SELECT f.file_path, min(p.project) AS project FROM f LEFT JOIN projects p ON f.file_path = p.workspace_root OR starts_with(f.file_path, p.workspace_root || '/') GROUP BY f.file_path",
)
def select_project(spark, sf_dir):
    # each path with its folders, joined on equality: no nested loop over the projects
    files = table(spark, sf_dir, "code_chunks").select("file_path").distinct()
    parts = F.split("file_path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    places = files.select("file_path", F.explode(ups).alias("workspace_root"))
    held = places.join(table(spark, sf_dir, "projects").select("project", "workspace_root"), "workspace_root")
    first = held.groupBy("file_path").agg(F.min("project").alias("project"))
    return files.join(first, "file_path", "left")


@query("within_roots", "SELECT DISTINCT file_path FROM code_chunks WHERE file_path = '/srv/checkouts/lunar-edge' OR starts_with(file_path, '/srv/checkouts/lunar-edge/') OR starts_with(file_path, '/srv/checkouts/umber-model/')")
def within_roots(spark, sf_dir):
    path = F.col("file_path")
    inside = classify.under(path, "/srv/checkouts/lunar-edge") | classify.under(path, "/srv/checkouts/umber-model/")
    return table(spark, sf_dir, "code_chunks").select("file_path").where(inside).distinct()


@query("vector_decode", "SELECT DISTINCT id, CASE WHEN id % 7 = 0 OR len(embedding) = 0 THEN 0 ELSE len(embedding)::INTEGER END AS size, round(CASE WHEN id % 7 = 0 OR len(embedding) = 0 THEN 0 ELSE list_sum(embedding::DOUBLE[]) END, 5)::DOUBLE AS total FROM code_chunks WHERE embedding IS NOT NULL")
def vector_decode(spark, sf_dir):
    from ..functions.vectors import decode, encode

    rows = table(spark, sf_dir, "code_chunks").select("id", "embedding").where("embedding IS NOT NULL")
    blob = F.when(F.col("id") % 7 == 0, F.unhex(F.lit("0102030405"))).otherwise(encode(F.col("embedding")))  # five bytes are no vector
    got = rows.select("id", decode(blob).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double"))
    return got.select("id", F.when(F.col("v").isNotNull(), F.size("v")).otherwise(0).alias("size"), F.round(F.coalesce(total, F.lit(0.0)), 5).alias("total")).distinct()


@query("path_matches", "WITH t AS (SELECT query_id, unnest(expected_files) AS f FROM retrieval_queries), e AS (SELECT query_id, f, regexp_extract(f, '[^/]+/[^/]+$') AS tail FROM t) SELECT query_id, f AS file_path, (f = tail OR ends_with(f, '/' || tail)) AS by_tail, false AS by_part FROM e")
def path_matches(spark, sf_dir):
    rows = table(spark, sf_dir, "retrieval_queries").select("query_id", F.explode("expected_files").alias("file_path"))
    tail = F.substring_index("file_path", "/", -2)
    part = F.substring(tail, F.lit(2), F.length(tail) - 1)  # begins within a folder's name
    return rows.select("query_id", "file_path", evaluate.path_matches(F.col("file_path"), F.concat(F.lit("./"), tail)).alias("by_tail"), evaluate.path_matches(F.col("file_path"), part).alias("by_part"))
