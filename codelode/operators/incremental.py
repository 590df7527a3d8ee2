"""Processing only new or changed records.

A run announces itself in a run history before it works, logs in a ledger what it has processed, and
counts only if the last row of its history says so. What is due is found by rereading what has arrived since the
oldest transaction that was open when the last run succeeded, and anti-joining (key, version) pairs against the
ledger of successful runs. Nothing is remembered outside these two tables, so a run that dies at any
point leaves its records due and repeats none that a successful run has taken. Its output carries its id and is seen
only with the row that ends the run: one append makes output and ledger valid together.

Arrival is the modification time of the file that a row lies in (a table is added to in whole files), or a column of
the caller's; it says nothing of when a record was made, so late records are found. Files from before the horizon are
left out when the scan is planned.

Every step is a join or an aggregate on keys; no group is collected. The texts of revisions are compared
by per-line XOR fingerprints, which add up across chunks in any order, so even a file that held most of
the table would be spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable
from ..sources.tables import roughly_in

KEY = ["project", "file_path"]
REVISION = [*KEY, "revision", "created_at"]


def run_states(runs: DataFrame) -> DataFrame:
    """One row per run: ``run_id, project, started_at, ended_at, status``.

    ``status`` is that of the row with the greatest ``updated_at``; among rows of one instant the
    alphabetically last status counts, NULL first. Rows without ``run_id`` or ``updated_at`` tell nothing
    and are left out; repeated rows change nothing.
    """
    return (
        runs.where("run_id IS NOT NULL AND updated_at IS NOT NULL")
        .groupBy("run_id")
        .agg(
            F.max(F.struct("updated_at", "status", "project")).alias("last"),
            F.min("updated_at").alias("started_at"),
        )
        .select("run_id", "last.project", "started_at", F.col("last.updated_at").alias("ended_at"), "last.status")
    )


def reread_horizon(runs: DataFrame) -> DataFrame:
    """``project, last_success_at, horizon``: where the next run of each project has to start reading.

    The horizon is the start of the oldest run that was open when the last successful run began: one that
    had started before and had not ended, or never succeeded. Records that such a run was writing may have
    become visible only after the successful run had read, so reading restarts there. Projects that no run
    has finished have no row and are read from the beginning.
    """
    states = run_states(runs)
    last = states.where("status = 'succeeded'").groupBy("project").agg(F.max(F.struct("started_at", "ended_at")).alias("s"))
    last = last.select("project", F.col("s.started_at").alias("last_started_at"), F.col("s.ended_at").alias("last_success_at"))
    started_before = F.col("started_at") <= F.col("last_started_at")
    was_open = (F.col("ended_at") >= F.col("last_started_at")) | ~F.col("status").eqNullSafe("succeeded")
    return (
        states.join(last, "project")
        .where(started_before & was_open)
        .groupBy("project", "last_success_at")
        .agg(F.min("started_at").alias("horizon"))
    )


def processed_ledger(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Distinct ``project, file_path, created_at`` that some successful run has logged."""
    succeeded = run_states(runs).where("status = 'succeeded'").select("run_id")
    return (
        log.select("run_id", *KEY, F.col("file_created_at").alias("created_at"))
        .join(succeeded, "run_id", "left_semi")
        .select(*KEY, "created_at")
        .distinct()
    )


def _having(left: DataFrame, right: DataFrame, columns: list[str], how: str = "left_semi") -> DataFrame:
    """The rows of ``left`` that have (or, with ``left_anti``, have not) a row in ``right`` equal in the columns, NULL being equal to NULL."""
    other = right.select(*(F.col(c).alias(f"_{c}") for c in columns))
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(other, condition, how)


def text_fingerprints(chunks: DataFrame) -> DataFrame:
    """``project, file_path, revision, created_at, fp``: equal ``fp`` means equal whole text.

    The text of a revision is its chunks' contents in line order joined by a newline. Each line is hashed
    together with its number, the hashes of a revision are XORed: three aggregates that Spark combines
    before the shuffle, whatever the size of a revision and wherever it is cut into chunks.
    """
    line = F.explode(
        F.transform(
            F.split(F.coalesce("content", F.lit("")), "\n", -1),
            lambda text, i: F.struct((F.col("start_line") + i).alias("no"), text.alias("text")),
        )
    )
    lines = chunks.dropDuplicates(["id"]).select(*REVISION, line.alias("line"))
    return (
        lines.groupBy(*REVISION)
        .agg(
            F.bit_xor(F.xxhash64("line.no", "line.text")).alias("a"),
            F.bit_xor(F.xxhash64("line.text", F.lit(7), "line.no")).alias("b"),
            F.count("*").alias("n"),
        )
        .select(*REVISION, F.struct("a", "b", "n").alias("fp"))
    )


#: The column of ``arriving``; a table may bring one of the same meaning under another name.
ARRIVED = "_arrived"


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with ``_arrived``, the modification time of the file of each row.

    A file that seems older than records in it (copied with a time of its own, clocks apart) has no arrival: NULL,
    and is always read. Only ``created_at`` is read to find such files, of which at most ``DISTRUSTED`` are named in
    the plan; of more, no file's time is trusted.
    """
    rows = spark.read.parquet(path).withColumn(ARRIVED, F.col("_metadata.file_modification_time").cast("timestamp_ntz"))
    named = rows.withColumn("_file", F.col("_metadata.file_path"))
    odd = [r[0] for r in named.groupBy("_file", ARRIVED).agg(F.max("created_at").cast("timestamp_ntz").alias("newest")).where(f"newest > {ARRIVED}").select("_file").limit(DISTRUSTED + 1).collect()]
    if len(odd) > DISTRUSTED:
        return rows.withColumn(ARRIVED, F.lit(None).cast("timestamp_ntz"))
    return named.withColumn(ARRIVED, F.when(~F.col("_file").isin(odd), F.col(ARRIVED))).drop("_file") if odd else rows


#: Files whose time is not trusted that are named one by one.
DISTRUSTED = 1_000


def reread(chunks: DataFrame, runs: DataFrame, arrived: str = ARRIVED) -> DataFrame:
    """The rows that have arrived since their project's horizon, or in projects without one, or at no known time.

    The least horizon of all is one value in the plan, which prunes files before any is opened, unless old files hold
    rows of a project that has no horizon (of the old files that check reads the project alone); the exact horizon is
    joined by project.
    """
    horizon = durable(reread_horizon(runs).select(F.col("project").alias("_p"), F.col("horizon").cast("timestamp_ntz").alias("horizon")))
    least = horizon.agg(F.min("horizon")).first()[0]
    names = [r[0] for r in horizon.select("_p").limit(MOST_PROJECTS + 1).collect()]
    rows = chunks
    if least is not None and len(names) <= MOST_PROJECTS:
        known = F.coalesce(F.col("project").isin([n for n in names if n is not None]), F.lit(False))
        if not chunks.where((F.col(arrived) < F.lit(least)) & ~known).select("project").take(1):
            rows = rows.where(F.col(arrived).isNull() | (F.col(arrived) >= F.lit(least)))
    joined = rows.join(horizon, F.col("project").eqNullSafe(F.col("_p")), "left")
    return joined.where(F.col("horizon").isNull() | F.col(arrived).isNull() | (F.col(arrived) >= F.col("horizon"))).drop("_p", "horizon")


#: Projects with a horizon that are named in the plan; beyond them only the join filters.
MOST_PROJECTS = 1_000


def due_chunks(chunks: DataFrame, log: DataFrame, runs: DataFrame, arrived: str | None = None) -> DataFrame:
    """Ids of the chunks of current revisions that no successful run has taken up: ``id``.

    * The current revision of a file is its highest ``revision``; a NULL revision is older than any.
    * It is due when the ledger has no entry with its project, path and ``created_at``, unless its whole
      text equals that of an earlier revision of the same path that the ledger has.
    * ``arrived``: the column that tells when a row arrived (see ``arriving``). Only files of which a row has arrived
      since the horizon are looked at, with all their revisions. Without it every file is.

    NULLs in key columns are compared as equal to each other; rows without ``id`` cannot be taken up and
    give nothing; repeated rows of an id give it once; empty tables give no rows, an empty log makes all
    current chunks due. Other columns of the inputs are not read, so their names do not matter.
    """
    slim = chunks.select("id", *REVISION).where("id IS NOT NULL")
    revisions = slim.select(*REVISION).distinct()
    if arrived is not None:
        touched = durable(reread(chunks.select("id", *KEY, arrived).where("id IS NOT NULL"), runs, arrived).select(*KEY).distinct())
        revisions = _having(revisions, touched, KEY)
    revisions = durable(revisions)  # read four times below, and small beside the chunks
    current = (
        revisions.groupBy(*KEY)
        .agg(F.max(F.struct("revision", "created_at")).alias("top"))
        .select(*KEY, "top.revision", "top.created_at")
    )
    ledger = durable(processed_ledger(log, runs))
    new = durable(_having(current, ledger, [*KEY, "created_at"], "left_anti"))

    # Texts are read only for files whose current revision is new and which have a logged earlier one.
    now = new.select(F.col("project").alias("_project"), F.col("file_path").alias("_file_path"), F.col("revision").alias("now_revision"))
    same_file = F.col("project").eqNullSafe(F.col("_project")) & F.col("file_path").eqNullSafe(F.col("_file_path"))
    older = F.col("revision").isNull() & F.col("now_revision").isNotNull() | (F.col("revision") < F.col("now_revision"))
    earlier = durable(_having(revisions, ledger, [*KEY, "created_at"]).join(now, same_file).where(older).select(*REVISION))
    rewritten = _having(new, earlier, KEY)
    wanted = earlier.union(rewritten.select(*REVISION))
    wanted = durable(wanted)
    # a first, inexact filter of bounded size lets few contents reach the shuffle of the exact one
    texts = chunks.where("id IS NOT NULL").select("id", *REVISION, "content", "start_line")
    texts = roughly_in(texts, wanted, KEY)
    prints = durable(text_fingerprints(_having(texts, wanted, REVISION)))
    old = _having(prints, earlier, REVISION).select(*KEY, "fp")
    unchanged = _having(_having(prints, rewritten, REVISION), old, [*KEY, "fp"]).select(*REVISION)
    due = _having(new, unchanged, REVISION, "left_anti")
    return _having(slim, due, REVISION).select("id").distinct()


def due_revisions(chunks: DataFrame, log: DataFrame, runs: DataFrame, arrived: str | None = None) -> DataFrame:
    """The due chunks by revision, in the ledger's form: ``project, file_path, file_created_at, chunk_count``."""
    due = due_chunks(chunks, log, runs, arrived)
    return (
        chunks.join(due, "id", "left_semi")
        .groupBy(*KEY, F.col("created_at").alias("file_created_at"))
        .agg(F.count_distinct("id").cast("int").alias("chunk_count"))
    )


class IncrementalRun:
    """One run over tables kept as folders of Parquet files: take what is due, work, then commit.

    The order is what makes failures harmless: ``running`` is written first, then the output, then the ledger rows,
    and ``succeeded`` last. A run that dies before that leaves rows which no successful run owns, in the ledger as in
    the output, so the next run takes its records again; one that committed is never repeated. Outputs are read with
    ``committed_output``.
    """

    def __init__(self, chunks: DataFrame, log_path: str, runs_path: str, run_id: int, project: str | None = None, output_path: str | None = None, arrived: str | None = None):
        self.spark, self.chunks, self.arrived = chunks.sparkSession, chunks, arrived
        self.log_path, self.runs_path, self.run_id, self.project, self.output_path = log_path, runs_path, run_id, project, output_path

    def _mark(self, status: str) -> None:
        kind = {f.name: f.dataType for f in self.spark.read.parquet(self.runs_path).schema}
        row = self.spark.range(1).select(
            F.lit(self.run_id).cast(kind["run_id"]).alias("run_id"),
            F.lit(self.project).cast("string").alias("project"),
            F.current_timestamp().cast(kind["updated_at"]).alias("updated_at"),
            F.lit(status).alias("status"),
        )
        row.write.mode("append").parquet(self.runs_path)

    def execute(self, work: Callable[[DataFrame], DataFrame | None]) -> int:
        """Calls ``work`` with the due chunks and keeps what it gives as the run's output; returns the number of revisions logged.

        ``work`` must write nothing itself, or only what may be written twice.
        """
        self._mark("running")
        log, runs = self.spark.read.parquet(self.log_path), self.spark.read.parquet(self.runs_path)
        taken = due_revisions(self.chunks, log, runs, self.arrived)
        if self.project is not None:
            taken = taken.where(F.col("project") == self.project)
        taken = durable(taken)  # what is logged is what was handed out, whatever arrives meanwhile
        kind = {f.name: f.dataType for f in log.schema}
        keys = taken.select(*KEY, F.col("file_created_at").alias("created_at"))
        output = work(_having(self.chunks, keys, [*KEY, "created_at"]))
        if output is not None and self.output_path is not None:
            output.withColumn("run_id", F.lit(self.run_id).cast("bigint")).write.mode("append").parquet(self.output_path)
        entry = taken.select(F.lit(self.run_id).cast(kind["run_id"]).alias("run_id"), "project", "file_path", "file_created_at", "chunk_count")
        entry.withColumn("logged_at", F.current_timestamp().cast(kind["logged_at"])).write.mode("append").parquet(self.log_path)
        n = taken.count()
        self._mark("succeeded")
        return n


def committed_output(spark: SparkSession, output_path: str, runs: DataFrame) -> DataFrame:
    """The output rows of successful runs: each due record's exactly once."""
    succeeded = run_states(runs).where("status = 'succeeded'").select(F.col("run_id").cast("bigint").alias("run_id"))
    return spark.read.parquet(output_path).join(succeeded, "run_id", "left_semi")
