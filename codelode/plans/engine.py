"""The engine: index, search, status, benchmark."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import text
from ..functions.classify import category_of, in_excluded_dir, is_semantic, under
from ..functions.enrich import semantic_content
from ..operators import chunking, evaluate, ranking, search
from ..providers import Provider, embed_column, provider_status, resolve_provider
from ..session import durable, ship_package
from ..sources import files
from ..sources.config import load_config, read_fixture
from ..sources.store import ChunkStore
from ..workspace import Scope, resolve_changed, resolve_scope, within_roots

#: What users are told.
STALE_WARNING = "The index was built with another embedding model; results come from text search until it is refreshed."
REFRESH_FIRST = "Refresh the project index before trusting semantic ranking."
NO_INDEX = "This project does not have a usable index yet."


def payload_rows(results: DataFrame, mode: str) -> DataFrame:
    """Results as shown: file name, preview and reason beside rank, place and score."""
    path = F.col("file_path")
    return results.withColumns(
        {
            "file_name": text.base_name(path),
            "preview": text.compact_preview(F.col("content")),
            "reason": text.result_reason(F.lit(mode), F.col("category"), F.col("content"), path),
        }
    )


def search_modes(queries: DataFrame, chunks: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """``query_id, mode``: ``text_stale_index`` where the query's project was indexed with another model, ``semantic_hybrid``
    where the query has a vector and its project rows of that length to compare it with, else ``text``.

    ``queries`` has ``query_id, project, vector`` (NULL where embedding failed), ``stale`` ``project, stale``.
    """
    rows = chunks.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & is_semantic(F.col("category")))
    has = rows.select("project", F.size("embedding").alias("size")).distinct().withColumn("has", F.lit(True))
    asked = queries.withColumn("size", F.coalesce(F.size("vector"), F.lit(-1)))
    joined = asked.join(has, ["project", "size"], "left")
    if stale is not None:
        joined = joined.join(stale.select("project", "stale"), "project", "left")
    old = F.coalesce(F.col("stale"), F.lit(False)) if stale is not None else F.lit(False)
    mode = F.when(old, "text_stale_index").when(F.coalesce("has", F.lit(False)), "semantic_hybrid").otherwise("text")
    return joined.select("query_id", mode.alias("mode"))


def chunk_id(path: Column, number: Column) -> Column:
    """An id that is the same whenever the same chunk is indexed."""
    return F.xxhash64(path, number)


@dataclass
class Found:
    """The outcome of a search: ranked rows, how they were found, and what to beware of."""

    results: DataFrame
    mode: str
    warning: str = ""


class Engine:
    """One project's index below ``root``, and what can be done with it."""

    def __init__(self, spark: SparkSession, root: str, project: str, provider: Provider | None = None, config: dict | None = None):
        ship_package(spark)
        self.spark, self.project, self.config = spark, project, config or load_config()
        self.store = ChunkStore(spark, root, project)
        self.provider = provider if provider is not None else self._resolve()

    @classmethod
    def for_path(cls, spark: SparkSession, root: str, path: str = ".", project: str = "", **more) -> tuple[Engine, Scope]:
        scope = resolve_scope(path, project)
        return cls(spark, root, scope.name, **more), scope

    def _resolve(self) -> Provider | None:
        try:
            return resolve_provider(self.config)
        except Exception:
            return None

    # -- writing ---------------------------------------------------------------------------------------
    def chunks_of(self, sources: DataFrame, size: int = schema.MAX_LINES, strict: bool = False) -> DataFrame:
        """``file_path, language, content`` as rows of the store, embedded if there is a provider; ``strict``: or not at all."""
        cut = chunking.chunk_files(sources, size)
        enriched = semantic_content(F.col("file_path"), F.col("language"), F.col("content"))
        vector = embed_column(self.provider, enriched, strict=strict) if self.provider is not None else F.lit(None).cast("array<float>")
        return cut.select(
            chunk_id(F.col("file_path"), F.col("chunk_no")).alias("id"), "file_path", "content", "start_line", "end_line", "language",
            category_of(F.col("language")).alias("category"), F.current_timestamp().cast("timestamp_ntz").alias("created_at"), vector.alias("embedding"),
        )

    def _scanned(self, roots: list[str]) -> DataFrame:
        """The supported files below the roots; raises for a root that is a file of no supported type."""
        scanned = files.scan(self.spark, roots)
        for root in roots:
            at = self.store._path(root)
            if at.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile() and not scanned.where(F.col("file_path") == root).select("file_path").take(1):
                raise ValueError(f"unsupported file type: {root}")
        return scanned

    def index_tree(self, roots: list[str], changed: list[str] | None = None, strict: bool = False, report: Callable[[str], None] | None = None) -> dict:
        """Indexes the supported files below the roots (folders or single files); with ``changed``, only those paths.

        Files that are there but not to be indexed, changed files that are gone, and excluded folders lose
        their chunks. Raises if a full index finds nothing to do, and if an incremental one would mix vectors
        of two models. Chunks and metadata become visible in one swap.

        ``strict``, the way of the tools: the first failure of the embedder ends it with the index as it was, and
        excluded folders are not cleared. ``report`` is told what is being done.
        """
        say = report or (lambda text: None)
        scanned = self._scanned(roots)
        skipped = scanned.where("NOT indexed").select("file_path")
        wanted = scanned.where("indexed")
        if changed:
            if self.provider is not None and self.store.requires_reindex(self.provider.name, self.provider.model, self.provider.dimensions):
                raise ValueError(STALE_WARNING)
            paths = list(dict.fromkeys(p for p in (resolve_changed(c, roots[0]) for c in changed) if within_roots(p, roots)))
            asked = self.spark.createDataFrame([(p,) for p in paths], "file_path string")
            gone = asked.join(wanted.select("file_path"), "file_path", "left_anti")
            wanted = wanted.join(asked, "file_path", "left_semi")
        else:
            gone = skipped
            if not wanted.take(1):
                raise ValueError("no file to index")
        say(f"Found {wanted.count()} {'changed ' if changed else ''}supported files")
        rows = durable(self.chunks_of(wanted, strict=strict))  # embedding is the dear part: done once, read by the store's passes
        emptied = wanted.select("file_path").union(gone)
        counts = rows.agg(F.count("*").alias("chunks"), F.count_distinct("file_path").alias("files"), F.count("embedding").alias("embedded")).first()
        say(f"Cut into {counts['chunks']} chunks, of which {counts['embedded']} have a vector")
        of = None if self.provider is None else (self.provider.name, self.provider.model, self.provider.dimensions)
        self.store.replace_files(rows, emptied, of)
        if not changed and not strict and self.store.manifest()["folders"]:
            say("Clearing excluded folders")
            path, inside = F.col("file_path"), F.lit(False)
            for root in roots:  # chunks of folders that have become excluded
                inside = inside | (under(path, root) & in_excluded_dir(F.substring(path, len(root) + 1, 1 << 20)))
            hit = self.store.read().where(inside).select("file_path").distinct()
            if hit.take(1):
                self.store.delete_paths(hit)
        mode = "incremental" if changed else "full"
        label = "changed files" if changed else "files"
        left_out = gone.count()
        say(f"Done: {counts['files']} files, {counts['chunks']} chunks, {left_out} paths left out")
        return {
            "project": self.project, "mode": mode, "indexed_files": counts["files"], "indexed_chunks": counts["chunks"], "skipped_paths": left_out, "roots": roots,
            "summary": f"Successfully indexed {counts['files']} {label} and {counts['chunks']} chunks for {self.project}",
        }

    # -- reading ---------------------------------------------------------------------------------------
    def search(self, query: str, limit: int = schema.RESULTS) -> Found:
        """The best chunks for a query: by vectors and words where possible, else by the query's text."""
        rows = self.store.read()
        if self.provider is None:
            return Found(self._ranked_text(rows, query, limit), "text")
        if self.store.requires_reindex(self.provider.name, self.provider.model, self.provider.dimensions):
            return Found(self._ranked_text(rows, query, limit), "text_stale_index", STALE_WARNING)
        try:
            vector = self.provider.embed([query])[0]
        except Exception:
            vector = None
        if vector is not None:
            top = search.unique_topk(rows, vector)
            asked = top.withColumn("query_id", F.lit(0)).withColumn("query", F.lit(query))
            results = ranking.thin_out(ranking.rerank(asked, F.col("query"), ["query_id"]), ["query_id"], limit).drop("query_id", "query")
            results = durable(results)  # at most ``limit`` rows
            if results.take(1):
                return Found(results.orderBy("rank"), "semantic_hybrid")
        return Found(self._ranked_text(rows, query, limit), "text")

    def _ranked_text(self, rows: DataFrame, query: str, limit: int) -> DataFrame:
        from pyspark.sql import Window

        found = search.text_search(rows, query, limit)
        return found.withColumn("rank", F.row_number().over(Window.orderBy("id"))) if limit > 0 else found

    def payload(self, query: str, limit: int = schema.RESULTS, scope: Scope | None = None) -> str:
        """The answer of the search tool, as JSON."""
        title = scope.title() if scope else self.project
        if not self.store.manifest()["folders"]:
            return json.dumps({"project": title, "guidance": NO_INDEX, "next_action": f"Index {title} first."}, indent=2)
        found = self.search(query, limit)
        rows = payload_rows(found.results, found.mode).orderBy("rank")
        fields = ["rank", "file_path", "file_name", "start_line", "end_line", "language", "category", "score", "preview", "reason"]
        answer = {"mode": found.mode, "warning": found.warning, "project": title, "results": [r.asDict() for r in rows.select(*fields).collect()]}  # at most ``limit`` rows
        for r in answer["results"]:
            if not r["score"]:
                del r["score"]
        if found.warning:
            answer |= {"guidance": REFRESH_FIRST, "next_action": f"Refresh the index for {title}."}
        return json.dumps({k: v for k, v in answer.items() if v != ""}, indent=2, ensure_ascii=False)

    def status(self) -> dict:
        """Counts, metadata, staleness and the providers' health."""
        stale = self.provider is not None and self.store.requires_reindex(self.provider.name, self.provider.model, self.provider.dimensions)
        return self.store.stats() | {"requires_reindex": stale, "providers": provider_status(self.config)}

    def benchmark(self, fixture: str) -> tuple[str, DataFrame, DataFrame]:
        """A fixture's name, its hits per query, and its hit rates; all queries are one batch plan."""
        name, queries = read_fixture(self.spark, fixture)
        rows = self.store.read()
        if not rows.take(1):
            raise ValueError(NO_INDEX)
        vector = embed_column(self.provider, F.col("query")) if self.provider is not None else F.lit(None).cast("array<float>")
        asked = durable(queries.select("query_id", F.lit(self.project).alias("project"), "query", vector.alias("vector")))
        found = ranking.hybrid_search(rows.withColumn("project", F.lit(self.project)), asked)
        hits = durable(evaluate.query_hits(queries, found))
        return name, hits, evaluate.hit_rates(hits)


__all__ = ["Engine", "Found", "chunk_id", "payload_rows", "search_modes"]
