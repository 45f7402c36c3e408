"""Running jobs: scan, map, write, checkpoint, by slices that each commit as a whole.

A run reads its documents once. What does not fit one slice is first written aside, dealt by key into at
most ``MOST_SLICES`` slices, and the slices are mapped and committed in order of the key. The target keeps how far a load
has come in the very commit that brings it there, so a run after a crash goes on from there,
whether or not the checkpoint was still saved.
"""

from __future__ import annotations

import socket
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.errors import Conflict, InvalidRequest, TransientError
from tabulon.operators.mapping import map_documents
from tabulon.operators.sinks import VersionedStore
from tabulon.plans.spec import compile_mapping
from tabulon.service.store import Store, decode_value, encode_value, now
from tabulon.sources.readers import ReadRequest, Source

#: Messages of failures that pass: lost connections, lost executors.
TRANSIENT = ("connection", "timed out", "timeout", "executor lost", "fetchfailed")
FIRST_WAIT, MOST_WAIT, ERROR_CHARS = 1.0, 30.0, 4000
#: A run commits in slices of about its batch size, but in no more than so many.
MOST_SLICES = 16


@dataclass
class MappingTask:
    """One collection of a job. ``id`` names its checkpoint."""

    id: int
    collection: str
    target: str
    mapping: str | dict | None = None
    watermark_field: str | None = None
    filter: str | dict | None = None


@dataclass
class JobTask:
    """What a run needs to know of its job."""

    id: int
    mappings: list[MappingTask]
    sync_mode: str = "FULL"
    write_mode: str = "UPSERT"
    batch_size: int = 1000
    max_retries: int = 3
    auto_create: bool = True
    target: object = None

    def validate(self) -> None:
        if self.sync_mode not in ("FULL", "INCREMENTAL"):
            raise InvalidRequest(f"Unknown sync mode {self.sync_mode}")
        if self.sync_mode == "INCREMENTAL":
            if self.write_mode == "TRUNCATE_AND_LOAD":
                raise InvalidRequest("INCREMENTAL cannot be used with TRUNCATE_AND_LOAD")
            if any(not m.watermark_field for m in self.mappings):
                raise InvalidRequest("INCREMENTAL needs a watermark field for every mapping")


@dataclass
class RunContext:
    """A run's counters and its cancel flag."""

    run_id: int
    cancelled: threading.Event = field(default_factory=threading.Event)
    read: int = 0
    written: int = 0
    failed: int = 0

    def wait(self, seconds: float) -> None:
        """Sleep in short pieces, as long as nobody cancels."""
        self.cancelled.wait(seconds)


class Cancelled(Exception):
    """The run was asked to stop."""


class Runner:
    """Runs jobs against one target store; one run a job at a time, by a unique row in the metadata."""

    def __init__(self, spark: SparkSession, meta: Store, target: VersionedStore, node: str | None = None, first_wait: float = FIRST_WAIT):
        self.spark, self.meta, self.target, self.first_wait = spark, meta, target, first_wait
        self.node = node or socket.gethostname()
        self.active: dict[int, RunContext] = {}
        self.threads: dict[int, threading.Thread] = {}

    def recover(self) -> int:
        """Fail the runs that this node left behind when it went down."""
        rows = self.meta.all("select id from run where status = 'RUNNING' and node = ?", self.node)
        for r in rows:
            self.meta.do("update run set status = 'FAILED', finished_at = ?, error = 'The node was restarted during the run' where id = ?", now(), r["id"])
        return len(rows)

    def claim(self, job_id: int, trigger: str) -> RunContext:
        import sqlite3

        try:
            run_id = self.meta.do("insert into run (job_id, trigger, status, started_at, node) values (?, ?, 'RUNNING', ?, ?)", job_id, trigger, now(), self.node)
        except sqlite3.IntegrityError as e:
            raise Conflict(f"Job {job_id} is already running") from e
        self.active[job_id] = context = RunContext(run_id)
        return context

    def is_running(self, job_id: int) -> bool:
        return self.meta.one("select 1 from run where job_id = ? and status = 'RUNNING'", job_id) is not None

    def cancel(self, run_id: int) -> bool:
        for context in list(self.active.values()):
            if context.run_id == run_id:
                context.cancelled.set()
                return True
        return False

    def run(self, job: JobTask, source: Source, trigger: str = "MANUAL") -> dict:
        """Run to the end and return the run's row."""
        return self._run(job, source, self.claim(job.id, trigger))

    def start(self, job: JobTask, source: Source, trigger: str = "MANUAL") -> int:
        """Run on a thread; the id of the run."""
        context = self.claim(job.id, trigger)
        self.threads[context.run_id] = t = threading.Thread(target=self._run, args=(job, source, context), daemon=True)
        t.start()
        return context.run_id

    def shutdown(self, seconds: float = 30) -> None:
        """Cancel all runs and wait for them, ``seconds`` in all."""
        for context in list(self.active.values()):
            context.cancelled.set()
        end = time.monotonic() + seconds
        for t in list(self.threads.values()):
            t.join(max(0.0, end - time.monotonic()))

    def _run(self, job: JobTask, source: Source, context: RunContext) -> dict:
        status, error = "SUCCEEDED", None
        try:
            job.validate()
            for m in job.mappings:
                self._migrate(job, m, source, context)
            status = "PARTIAL" if context.failed else "SUCCEEDED"
        except Cancelled:
            status = "CANCELLED"
        except Exception as e:
            status, error = "FAILED", (str(e) or type(e).__name__)[:ERROR_CHARS]
        finally:
            self.meta.do("update run set status = ?, finished_at = ?, error = ?, docs_read = ?, rows_written = ?, docs_failed = ? where id = ?", status, now(), error, context.read, context.written, context.failed, context.run_id)
            self.active.pop(job.id, None)
        return self.meta.one("select * from run where id = ?", context.run_id)

    def _migrate(self, job: JobTask, m: MappingTask, source: Source, context: RunContext) -> None:
        plan, target = compile_mapping(m.target, m.mapping), job.target or self.target
        target.ensure(plan, job.auto_create, job.write_mode != "INSERT")
        incremental = job.sync_mode == "INCREMENTAL"
        last_id, last_mark = self.meta.checkpoint(m.id)
        before = self.meta.load(m.id)
        reached = target.position(before) if before else None
        if reached is not None:  # the target is ahead of the checkpoint, or level with it
            last_id, last_mark = (None, decode_value(reached)) if incremental else (decode_value(reached), None)
            self.meta.save_checkpoint(m.id, last_id, last_mark)
        load = uuid.uuid4().hex
        self.meta.save_load(m.id, load)
        request = ReadRequest.incremental(m.collection, m.watermark_field, last_mark, m.filter) if incremental else ReadRequest.full(m.collection, m.filter, last_id)
        if job.write_mode == "TRUNCATE_AND_LOAD" and last_id is None:
            target.truncate(plan)
        mode = "INSERT" if job.write_mode == "INSERT" else "UPSERT"
        for i, part in enumerate(self._slices(source, request, job.batch_size, load)):
            if context.cancelled.is_set():
                raise Cancelled
            # Documents, whatever they carry beside the columns that the scan needs.
            order = F.struct("__mark", F.col(source.id_column).alias("id"))
            mapped = map_documents(part, plan, source.doc_column or "__document", order=order).cache()
            try:
                n = mapped.frame.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__error").isNotNull()).alias("bad"), F.max("__order.__mark").alias("mark")).first()
                upto = encode_value(n.mark)
                done = self._retried(lambda: target.write(mapped, mode, None if upto is None else (load, upto)), job.max_retries, context)  # noqa: B023
                rejected = [mapped.rejected] if n.bad else []
                rejected += [done.rejected] if done.refused else []
                path = self._rejected(rejected, f"{load}-{i}") if rejected else None
            finally:
                mapped.unpersist()
            bad = n.bad + done.refused
            context.read, context.written, context.failed = context.read + n.n, context.written + done.rows, context.failed + bad
            with self.meta.transaction():
                if path:
                    self.meta.do("insert into dead_letter_file (run_id, collection, path, documents, created_at) values (?, ?, ?, ?, ?)", context.run_id, m.collection, path, bad, now())
                if n.mark is not None:
                    self.meta.save_checkpoint(m.id, None if incremental else n.mark, n.mark if incremental else None)
                self.meta.do("update run set docs_read = ?, rows_written = ?, docs_failed = ? where id = ?", context.read, context.written, context.failed, context.run_id)
        if incremental:
            self.meta.save_load(m.id, None)
        else:
            self.meta.clear_checkpoint(m.id)

    def _slices(self, source: Source, request: ReadRequest, size: int, load: str) -> Iterator[DataFrame]:
        """The documents of a request with their ``__mark``, in slices by ascending mark; one scan of the documents."""
        df = source.read(request)
        own = df.columns
        mark = source.field(df, request.watermark_field) if request.is_incremental else F.col(source.id_column)
        df = df.withColumn("__mark", mark)
        if source.doc_column is None:
            df = df.select(F.struct(*own).alias("__document"), "__mark", F.col(source.id_column))
        bounds = source.bounds(df.select(F.col("__mark").alias("k")), size, MOST_SLICES)
        if bounds is None:
            return
        if not bounds:
            yield df
            return
        stage = f"{self.target.root}/_staged/{load}"
        place = F.lit(0)
        for i, b in enumerate(bounds):
            place = F.when(F.col("__mark") > F.lit(b), i + 1).otherwise(place)
        try:
            # A slice's rows are dealt over several tasks, so that none gets a whole slice.
            salted = df.withColumn("__slice", place).repartition("__slice", F.pmod(F.xxhash64(F.col(source.id_column).cast("string")), F.lit(8)))
            salted.write.partitionBy("__slice").parquet(stage)
            for i in range(len(bounds) + 1):
                if self.target.files.entries(f"_staged/{load}/__slice={i}"):
                    yield self.spark.read.schema(df.schema).parquet(f"{stage}/__slice={i}")
        finally:
            self.target.files.delete(f"_staged/{load}")

    def _rejected(self, parts: list[DataFrame], name: str) -> str:
        """Write the documents that a slice rejects, in the order they were read; nothing of them passes the driver."""
        path, rows = f"_dead_letters/{name}", parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        rows = rows.orderBy("__order").select(F.monotonically_increasing_id().alias("place"), "source_id", "payload", "error")
        rows.write.mode("overwrite").parquet(f"{self.target.root}/{path}")
        return path

    def dead_letters(self, run_id: int, page: int, size: int) -> list[dict]:
        """A page of a run's rejected documents, in the order they were met."""
        skip, out = page * size, []
        for f in self.meta.all("select * from dead_letter_file where run_id = ? order by id", run_id):
            if skip >= f["documents"]:
                skip -= f["documents"]
                continue
            rows = self.spark.read.schema("place long, source_id string, payload string, error string").parquet(f"{self.target.root}/{f['path']}")
            got = rows.orderBy("place").offset(skip).limit(size - len(out)).collect()  # at most a page
            out += [{"run_id": run_id, "collection": f["collection"], "created_at": f["created_at"], "source_id": r.source_id, "payload": r.payload, "error": r.error} for r in got]
            skip = 0
            if len(out) == size:
                break
        return out

    def _retried(self, write, retries: int, context: RunContext):
        wait = self.first_wait
        for attempt in range(retries + 1):
            try:
                return write()
            except Exception as e:
                if attempt == retries or not is_transient(e):
                    raise
                context.wait(min(wait, MOST_WAIT))
                if context.cancelled.is_set():
                    raise Cancelled from e
                wait *= 2
        raise AssertionError


def is_transient(e: Exception) -> bool:
    return isinstance(e, (TransientError, ConnectionError, TimeoutError)) or any(w in str(e).lower() for w in TRANSIENT)


def duration_ms(run: dict) -> int:
    """How long a run took, or takes so far."""
    from datetime import datetime

    read = lambda t: datetime.fromisoformat(t.replace("Z", "+00:00")).timestamp()
    return int(((read(run["finished_at"]) if run["finished_at"] else time.time()) - read(run["started_at"])) * 1000)
