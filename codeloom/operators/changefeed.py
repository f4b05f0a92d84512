"""Processing only new or changed records: log offsets, write-ahead plans, replay and a deduplicating sink.

The log is a parquet file or a folder of them; a file is never rewritten, new records come in new files. Its partitions are
the files, an offset is the position of a row in its file, both as Spark's scan reports them. A run

1. takes the plan of an unfinished batch if there is one, else writes a new one: per log file that no batch has seen, the
   offsets ``[first, end)``; only these files are opened, one count each and no sort;
2. reads just these files, classifies the latest of each key against the stored state, drops what the sink already has and
   writes the batch to the sink, replacing whatever an earlier attempt at the same batch left there;
3. writes the offsets and the key state as they are after the batch, and last the commit marker.

A run that dies anywhere is repeated from its plan with the same rows, whatever the log has received meanwhile; nothing is
skipped and nothing is delivered twice. The sink drops a record of a key and offset it has, one that repeats the version
delivered last (equal time and hash; a null time equals a null one), and one that is known to be older than what it has. A
record at an equal time with another hash is delivered, and so is one without a time, since neither is known to be older.

What a run reads besides its own log files: the compacted offsets (one row for each log file) and the key state of the
buckets that its keys fall into. The key state is cut into ``buckets`` by a hash of the key; a batch rewrites those it touches,
and a manifest of one row for each bucket tells which batch wrote its present version.
All state is in one folder, which every executor must be able to reach.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codeloom.operators import store
from codeloom.session import remove_path

FINISHED = ("completed", "completed_with_errors")
KEY = ["project_id", "path"]


def latest_scans(scans: DataFrame) -> DataFrame:
    """The record of each (project_id, path) with the latest scanned_at; of equal ones the greatest (hash, file, offset).

    Rows without a project or a path have no key and are left out. A null scanned_at counts as the earliest.
    """
    order = F.struct("scanned_at", F.lower("content_hash").alias("content_hash"), "log_file", "log_offset")
    return scans.dropna(subset=KEY).groupBy(*KEY).agg(F.max(order).alias("r")).select(*KEY, "r.*")


def stored_state(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(project_id, path, stored_hash, stored_error, run_status): the latest stored row of a path and the run that wrote it.

    The writer is the project's last run that started at or before indexed_at. Runs of a project are turned into
    intervals, so the join is one equality on the project with a range filter; null where no run had started yet.
    """
    order = F.struct("indexed_at", F.lower("content_hash").alias("stored_hash"), F.col("error").alias("stored_error"))
    latest = files.dropna(subset=KEY).groupBy(*KEY).agg(F.max(order).alias("r")).select(*KEY, "r.*")
    spans = (
        runs.where(F.col("project_id").isNotNull() & F.col("started_at").isNotNull())
        .groupBy("project_id", "started_at")
        .agg(F.max_by("status", "id").alias("run_status"))
        .withColumn("until", F.lead("started_at").over(Window.partitionBy("project_id").orderBy("started_at")))
        .withColumn("has_run", F.lit(True))
    )
    written = (
        (F.col("f.project_id") == F.col("s.project_id"))
        & (F.col("f.indexed_at") >= F.col("s.started_at"))
        & (F.col("s.until").isNull() | (F.col("f.indexed_at") < F.col("s.until")))
    )
    return latest.alias("f").join(spans.alias("s"), written, "left").select("f.*", "s.run_status", "s.has_run")


def pending(scans: DataFrame, files: DataFrame, runs: DataFrame) -> DataFrame:
    """The scanned records to process, with ``reason``: new, changed, error or unfinished_run (the first that applies).

    A path is pending if it is not stored, its hash differs (letter case aside; a null equals only a null), its stored
    error is not null (a blank one counts), or the run that wrote it is in no finished status. Times of modification
    alone decide nothing.
    """
    state = stored_state(files, runs).withColumn("stored", F.lit(True))
    reason = (
        F.when(F.col("stored").isNull(), "new")
        .when(~F.col("content_hash").eqNullSafe(F.col("stored_hash")), "changed")
        .when(F.col("stored_error").isNotNull(), "error")
        .when(F.col("has_run") & ~F.coalesce(F.col("run_status").isin(*FINISHED), F.lit(False)), "unfinished_run")
    )
    return (
        latest_scans(scans)
        .join(state, KEY, "left")
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select(*KEY, "content_hash", "scanned_at", "log_file", "log_offset", "reason")
    )


class ChangeFeed:
    """Runs over one log with its state below ``state_dir``."""

    def __init__(self, spark: SparkSession, log_path: str, state_dir: str, buckets: int = 32):
        self.spark, self.log_path, self.state, self.buckets = spark, log_path, state_dir.rstrip("/"), buckets

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        target, fs = self._fs(path)
        return fs.exists(target)

    def _at(self, part: str, batch: int) -> str:
        return f"{self.state}/{part}/batch={batch}"

    def _readable(self, log_file: str) -> str:
        """A path to read from, for a file as the scan names it (percent-encoded)."""
        jvm = self.spark.sparkContext._jvm
        return jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(log_file)).toString()

    def _log(self, files: list[str] | None = None) -> DataFrame:
        """The rows of some log files, or of all, with their file and offset."""
        rows = self.spark.read.parquet(*([self.log_path] if files is None else map(self._readable, files))).drop("log_file", "log_offset")
        return rows.select("*", F.regexp_replace("_metadata.file_path", "^([a-z]+):///", "$1:/").alias("log_file"), F.col("_metadata.row_index").alias("log_offset"))

    def next_batch(self) -> int:
        """The number of the first batch without a commit: one listing, as only the last markers are kept."""
        target, fs = self._fs(f"{self.state}/commit")
        names = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
        return max((int(n[6:]) + 1 for n in names if n.startswith("batch=") and self._exists(f"{self.state}/commit/{n}/_SUCCESS")), default=0)

    def committed(self) -> DataFrame | None:
        """Everything delivered by committed batches, one row per key and record, with its ``batch``; None before the first commit."""
        done = [self._at("sink", b) for b in range(self.next_batch())]
        return self.spark.read.option("basePath", f"{self.state}/sink").parquet(*done) if done else None

    def _offsets(self, batch: int) -> DataFrame | None:
        """(log_file, end) as the batch before left them."""
        return self.spark.read.parquet(self._at("offsets", batch - 1)) if batch else None

    def plan(self, batch: int) -> DataFrame:
        """The offsets of a batch, written ahead; an existing complete plan is taken as it is."""
        path = self._at("plan", batch)
        if not self._exists(path + "/_SUCCESS"):
            known = self._offsets(batch)
            seen = {r[0] for r in known.select("log_file").collect()} if known is not None else set()  # names of files, as the listing itself
            new = sorted({re.sub("^([a-z]+):///", r"\1:/", f) for f in self.spark.read.schema("path string").parquet(self.log_path).inputFiles()} - seen)
            listed = self.spark.createDataFrame([(f,) for f in new], "log_file string")
            ends = self._log(new).groupBy("log_file").agg((F.max("log_offset") + 1).alias("end")) if new else listed.select("log_file", F.lit(0).cast("long").alias("end"))
            zero = F.lit(0).cast("long")
            listed.join(ends, "log_file", "left").select("log_file", zero.alias("first"), F.coalesce("end", zero).alias("end")).coalesce(1).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int"))

    def _key_state(self, batch: int, touched: list[int]) -> tuple[dict[int, int], DataFrame | None]:
        """(the batch that wrote each bucket, the state of the touched ones) as the batch before left them."""
        if not batch:
            return {}, None
        versions = {r["bucket"]: r["version"] for r in self.spark.read.parquet(self._at("manifest", batch - 1)).collect()}  # a row per bucket
        paths = [f"{self._at('keys', versions[b])}/bucket={b}" for b in touched if b in versions]
        return versions, self.spark.read.parquet(*paths).select(*KEY, "seen_at", "seen_hash", "timeless_hash") if paths else None

    def _unseen(self, out: DataFrame, state: DataFrame | None) -> DataFrame:
        if state is None:
            return out
        hashed = F.lower("content_hash")
        known = state.select(*KEY, F.col("seen_at").alias("_at"), F.col("seen_hash").alias("_hash"), F.col("timeless_hash").alias("_timeless"), F.lit(True).alias("_known"))
        repeated = F.when(F.col("scanned_at").isNull(), F.col("_timeless").eqNullSafe(F.struct(hashed.alias("h")))).otherwise(
            (F.col("scanned_at") < F.col("_at")) | ((F.col("scanned_at") == F.col("_at")) & F.col("_hash").eqNullSafe(hashed))
        )
        return out.join(known, KEY, "left").where(F.col("_known").isNull() | ~F.coalesce(repeated, F.lit(False))).drop("_at", "_hash", "_timeless", "_known")

    def _write_state(self, batch: int, sunk: DataFrame, versions: dict[int, int], state: DataFrame | None, touched: list[int]) -> None:
        """The key state of the touched buckets after the batch, and the manifest."""
        dated = F.col("scanned_at").isNotNull()
        hashed = F.lower("content_hash")
        fresh = sunk.select(
            *KEY, F.col("scanned_at").alias("seen_at"), F.when(dated, hashed).alias("seen_hash"), F.when(~dated, F.struct(hashed.alias("h"))).alias("timeless_hash"), F.lit(1).alias("age")
        )
        both = fresh if state is None else fresh.unionByName(state.withColumn("age", F.lit(0)))
        latest = both.groupBy(*KEY).agg(
            F.max("seen_at").alias("seen_at"),
            F.max_by("seen_hash", F.when(F.col("seen_at").isNotNull(), F.struct("seen_at", "age"))).alias("seen_hash"),
            F.max_by("timeless_hash", F.when(F.col("timeless_hash").isNotNull(), F.col("age"))).alias("timeless_hash"),
        )
        self._bucketed(latest).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._at("keys", batch))
        now = versions | {b: batch for b in touched}
        self.spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(self._at("manifest", batch))

    def run(self, process: Callable[[DataFrame], DataFrame], fail_before: str | None = None) -> int:
        """One run: plan or replay, deliver, commit; returns the batch number. ``fail_before`` (sink, state, commit) is for tests.

        ``process`` gets the planned log rows and returns rows with at least the key, content_hash, scanned_at, log_file and
        log_offset, at most one of each key.
        """
        batch = self.next_batch()
        todo = self.plan(batch)
        files = [r[0] for r in todo.where("first < end").select("log_file").collect()]  # the names of the new files
        log, spans = self._log(files or None), todo.select("log_file", F.col("first").alias("_first"), F.col("end").alias("_end"))
        rows = log.join(spans, "log_file").where("log_offset >= _first and log_offset < _end").drop("_first", "_end") if files else log.where("false")
        sink, attempt = self._at("sink", batch), self._at("attempt", batch)
        process(rows).dropDuplicates([*KEY, "log_file", "log_offset"]).write.mode("overwrite").parquet(attempt)
        out = self.spark.read.parquet(attempt)
        touched = sorted(r[0] for r in self._bucketed(out.select(*KEY)).select("bucket").distinct().collect())  # at most ``buckets``
        versions, state = self._key_state(batch, touched)
        if fail_before == "sink":
            raise RuntimeError("stopped before the sink")
        self._unseen(out, state).write.mode("overwrite").parquet(sink)
        if fail_before == "state":
            raise RuntimeError("stopped before the state")
        self._write_state(batch, self.spark.read.parquet(sink), versions, state, touched)
        ends, before = todo.select("log_file", "end"), self._offsets(batch)
        (ends if before is None else before.unionByName(ends)).groupBy("log_file").agg(F.max("end").alias("end")).write.mode("overwrite").parquet(self._at("offsets", batch))
        if fail_before == "commit":
            raise RuntimeError("stopped before the commit")
        todo.limit(0).write.mode("overwrite").parquet(self._at("commit", batch))
        for part in ("attempt", "plan"):
            remove_path(self.spark, self._at(part, batch))
        for part in ("commit", "offsets", "manifest"):
            if batch:
                remove_path(self.spark, self._at(part, batch - 1))
        return batch

    def delivered(self) -> DataFrame | None:
        """The latest delivered record of each key over all committed batches, by the order of ``latest_scans``."""
        rows = self.committed()
        if rows is None:
            return None
        return store.last_wins(rows, KEY, ["scanned_at", "content_hash", "log_file", "log_offset"])

    def drop(self) -> None:
        """Forget all state."""
        remove_path(self.spark, self.state)
