"""The chunk store: Parquet buckets of files, swapped in by one manifest.

A project's chunks lie in buckets, folders by the hash of their path, sorted by path. A change writes new folders for
the buckets of the files it touches and then one manifest, which names the folder of every bucket and keeps the index
metadata; readers see either the old state or the new one, with its metadata. Manifests are numbered: a writer takes
the number after the one it has read, which only one can, so of two writers at once the second starts over from what
the first has left. Buckets are doubled in number when they hold more than ``BUCKET_BYTES`` on the mean, so what a
change rewrites does not grow with the project.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.classify import under

#: Buckets of a new project, and the bytes that one should hold at most.
BUCKETS, BUCKET_BYTES = 64, 256 << 20
#: Times that a change starts over because another writer was first.
ATTEMPTS = 20


class StoreConflict(RuntimeError):
    """Another writer has changed the project meanwhile."""


class ChunkStore:
    """``root/project`` on any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str, project: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{project}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._first_buckets = buckets

    # -- manifest --------------------------------------------------------------------------------------
    def _versions(self) -> list[int]:
        at = self._path(self.path)
        names = [status.getPath().getName() for status in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self) -> dict:
        versions = self._versions()
        if not versions:
            return {"version": 0, "buckets": self._first_buckets, "folders": {}, "metadata": None}
        stream = self._fs.open(self._path(f"{self.path}/manifest-{versions[-1]:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _swap(self, manifest: dict) -> None:
        """Makes ``manifest`` the state after the one it was made from; raises ``StoreConflict`` if there is one already."""
        number = manifest["version"] + 1
        new, at = self._path(f"{self.path}/new-{uuid.uuid4().hex}"), self._path(f"{self.path}/manifest-{number:012d}.json")
        stream = self._fs.create(new, True)
        stream.write(bytearray(json.dumps(manifest | {"version": number}, indent=1).encode()))
        stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(new, at, none)  # without OVERWRITE: fails if the number is taken
        except Exception as error:
            self._fs.delete(new, False)
            if number in self._versions():
                raise StoreConflict(f"state {number} of {self.path} has been written by another") from error
            raise

    def _change(self, make: Callable[[dict], dict]) -> None:
        """Swaps in what ``make`` makes of the manifest, over again if another writer was first."""
        for attempt in range(ATTEMPTS):
            try:
                self._swap(make(self.manifest()))
                return
            except StoreConflict:
                if attempt + 1 == ATTEMPTS:
                    raise

    # -- reading ---------------------------------------------------------------------------------------
    def read(self) -> DataFrame:
        """All chunks; a column that older files lack reads as NULL."""
        folders = sorted(set(self.manifest()["folders"].values()))
        if not folders:
            return self.spark.createDataFrame([], schema.CHUNK_SCHEMA)
        return self.spark.read.schema(schema.CHUNK_SCHEMA).parquet(*(f"{self.path}/{f}" for f in folders))

    def read_files(self, paths: DataFrame) -> DataFrame:
        """The chunks of the files ``file_path``; only their buckets are listed and read."""
        manifest = self.manifest()
        wanted = {str(r.b) for r in paths.select(self._bucket("file_path", manifest["buckets"]).alias("b")).distinct().collect()}  # at most the number of buckets
        folders = [f for b, f in manifest["folders"].items() if b in wanted]
        if not folders:
            return self.spark.createDataFrame([], schema.CHUNK_SCHEMA)
        rows = self.spark.read.schema(schema.CHUNK_SCHEMA).parquet(*(f"{self.path}/{f}" for f in folders))
        return rows.join(paths.select("file_path").distinct(), "file_path", "left_semi").select(*schema.CHUNK_SCHEMA.names)

    def metadata(self) -> dict | None:
        return self.manifest()["metadata"]

    def _record(self, provider: str, model: str, dimensions: int) -> dict:
        now = self.spark.sql("SELECT string(current_timestamp())").first()[0]
        return {"provider": provider, "model": model, "dimensions": dimensions, "updated_at": now}

    def set_metadata(self, provider: str, model: str, dimensions: int) -> None:
        """The one metadata record of the project, replaced."""
        record = self._record(provider, model, dimensions)
        self._change(lambda manifest: manifest | {"metadata": record})

    def requires_reindex(self, provider: str, model: str, dimensions: int) -> bool:
        """Whether there is metadata and it differs in any of the three."""
        kept = self.metadata()
        return kept is not None and [kept[k] for k in schema.METADATA_FIELDS] != [provider, model, dimensions]

    def stats(self) -> dict:
        """Counts of chunks and files, and bytes on disk, with the metadata if there is any."""
        from ..plans.core_queries import index_statistics

        row = index_statistics(self.read().select("id", "file_path", "embedding")).first().asDict()
        size = self._size(self.manifest()["folders"].values())
        return row | {"bytes": size} | ({k: v for k, v in self.metadata().items()} if self.metadata() else {})

    # -- changing --------------------------------------------------------------------------------------
    def _bucket(self, path: Column | str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")

    def _size(self, folders: list[str]) -> int:
        return sum(self._fs.getContentSummary(self._path(f"{self.path}/{f}")).getLength() for f in set(folders))

    def _rewritten(self, manifest: dict, gone: DataFrame | None, new: DataFrame | None) -> dict:
        """Writes the touched buckets again, without the rows of files that are gone and with the new ones; the manifest with them."""
        n = manifest["buckets"]
        more = n
        while manifest["folders"] and self._size(manifest["folders"].values()) > more * BUCKET_BYTES:
            more *= 2
        if more > n:
            touched = set(manifest["folders"])
        else:
            parts = [d.select(self._bucket("file_path", n).alias("b")) for d in (gone, new) if d is not None]
            both = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
            touched = {str(r.b) for r in both.distinct().collect()}  # at most the number of buckets
        old = sorted(f"{self.path}/{manifest['folders'][b]}" for b in touched if b in manifest["folders"])
        rows = None
        if old:
            rows = self.spark.read.schema(schema.CHUNK_SCHEMA).parquet(*old)
            if gone is not None:
                rows = rows.join(gone.select("file_path").distinct(), "file_path", "left_anti")
            rows = rows.select(*schema.CHUNK_SCHEMA.names)
        if new is not None:
            fresh = new.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.CHUNK_SCHEMA))
            rows = fresh if rows is None else rows.unionByName(fresh)
        version = f"v-{uuid.uuid4().hex}"
        left = {b: f for b, f in manifest["folders"].items() if b not in touched}
        if rows is not None:
            placed = rows.withColumn("bucket", self._bucket("file_path", more)).repartition("bucket", "file_path").sortWithinPartitions("bucket", "file_path", "start_line")
            placed.write.partitionBy("bucket").parquet(f"{self.path}/{version}")
            for status in self._fs.listStatus(self._path(f"{self.path}/{version}")):
                name = status.getPath().getName()
                if name.startswith("bucket="):
                    left[name[7:]] = f"{version}/{name}"
        return manifest | {"folders": left, "buckets": more}

    def replace_files(self, new: DataFrame, gone: DataFrame | None = None, metadata: tuple[str, str, int] | None = None) -> None:
        """The chunks of all files in ``new`` are replaced by those in it; files in ``gone`` lose theirs.

        One swap, with the provider, model and dimensions of ``metadata`` if given, so a reader never sees a file
        without its chunks, nor vectors under another model's name. ``new`` is read more than once.
        """
        replaced = new.select("file_path")
        gone = replaced if gone is None else replaced.union(gone.select("file_path"))
        record = {} if metadata is None else {"metadata": self._record(*metadata)}
        self._change(lambda manifest: self._rewritten(manifest, gone, new) | record)

    def delete_paths(self, gone: DataFrame) -> None:
        """Files lose their chunks."""
        self._change(lambda manifest: self._rewritten(manifest, gone, None))

    def delete_prefix(self, prefix: str) -> None:
        """The file or folder ``prefix`` and all below it; wildcards in it mean nothing."""
        hit = self.read().where(under(F.col("file_path"), prefix)).select("file_path").distinct()
        self.delete_paths(hit)

    def vacuum(self) -> None:
        """Removes older manifests and folders that the last one does not name. No reader or writer may be at work on an older state."""
        named = {f.split("/")[0] for f in self.manifest()["folders"].values()}
        old = {f"manifest-{v:012d}.json" for v in self._versions()[:-1]}
        for status in self._fs.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in named or name.startswith("new-") or name in old:
                self._fs.delete(status.getPath(), True)
