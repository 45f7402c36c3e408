"""The control plane: connections, jobs, runs and schedules."""

from __future__ import annotations

import json
import os
import re
import sqlite3
import time
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import SparkSession

from tabulon.errors import Conflict, InvalidMapping, InvalidRequest, NotFound, Unreachable
from tabulon.operators.filters import parse_filter
from tabulon.operators.infer import DEFAULT_SAMPLE, Proposal, infer_from
from tabulon.operators.jdbc import JdbcTarget
from tabulon.operators.sinks import MODES, VersionedStore, dialect
from tabulon.plans.spec import compile_mapping
from tabulon.service.cron import Cron, Scheduler
from tabulon.service.runner import JobTask, MappingTask, Runner, duration_ms
from tabulon.service.store import Store
from tabulon.sources.readers import REGISTRY, Credentials, Source, open_source

#: Default port and URL form by database type.
DATABASES = {"POSTGRESQL": (5432, "jdbc:postgresql://{host}:{port}/{database}"), "MYSQL": (3306, "jdbc:mysql://{host}:{port}/{database}"), "MARIADB": (3306, "jdbc:mariadb://{host}:{port}/{database}"), "SQLSERVER": (1433, "jdbc:sqlserver://{host}:{port};databaseName={database}"), "ORACLE": (1521, "jdbc:oracle:thin:@//{host}:{port}/{database}"), "DERBY": (1527, "jdbc:derby://{host}:{port}/{database}"), "MONGODB": (27017, "mongodb://{host}:{port}/{database}")}
KINDS = ("SOURCE", "TARGET")


@dataclass
class Resolved:
    """Where a connection leads; the password is fetched when it is needed and never shown."""

    url: str
    options: dict[str, str]
    username: str | None = None
    password: str | None = field(default=None, repr=False)
    database: str | None = None


def resolve(c: dict) -> Resolved:
    """The URL of a connection: as given, or of host, port and database."""
    validate_connection(c)
    kind, options = c["db_type"], dict(c.get("options") or {})
    password = os.environ.get(c["secret_name"]) if c.get("secret_name") else None
    if c.get("uri"):
        path = urlsplit(c["uri"]).path.strip("/") if "://" in c["uri"] else ""
        return Resolved(c["uri"], options, c.get("username"), password, c.get("database") or path or None)
    if kind not in DATABASES:
        return Resolved(c.get("host") or "", options, c.get("username"), password, c.get("database"))
    port, form = DATABASES[kind]
    url = form.format(host=c["host"], port=c.get("port") or port, database=c.get("database") or "")
    if kind == "MONGODB":
        url, options = url + ("?" + "&".join(f"{k}={v}" for k, v in options.items()) if options else ""), {}
    return Resolved(url, options, c.get("username"), password, c.get("database"))


def validate_connection(c: dict) -> None:
    kind = c.get("db_type")
    if not c.get("uri") and not c.get("host"):
        raise InvalidRequest("Either uri or host is required")
    if kind in REGISTRY and kind not in DATABASES:
        return
    if kind not in DATABASES:
        raise InvalidRequest(f"Unknown database type {kind}")
    uri = c.get("uri")
    if uri:
        prefix = "mongodb" if kind == "MONGODB" else DATABASES[kind][1].split(":")[0] + ":" + DATABASES[kind][1].split(":")[1] + ":"
        if not uri.startswith(prefix):
            raise InvalidRequest(f"The uri of a {kind} connection must start with {prefix}")
        if re.search(r"//[^/@?#]*:[^/@?#]+@", uri) or re.search(r"[?&;]password=", uri, re.I):
            raise InvalidRequest("The uri must not contain a password; use the password field")
    elif kind != "MONGODB" and not c.get("database"):
        raise InvalidRequest("database is required for a connection by host")


class Control:
    """All operations on the metadata, for one target store."""

    def __init__(self, spark: SparkSession, meta: Store, target: VersionedStore, node: str | None = None):
        self.spark, self.meta, self.target = spark, meta, target
        self.runner = Runner(spark, meta, target, node)
        self.scheduler = Scheduler(self._fire)

    def startup(self) -> None:
        """Fail what this node left running, and schedule every enabled job."""
        self.runner.recover()
        for j in self.meta.all("select id from job"):
            self._schedule(j["id"])
        self.scheduler.start()

    def shutdown(self) -> None:
        self.scheduler.stop()
        self.runner.shutdown()

    # Connections

    def list_connections(self) -> list[dict]:
        return [self._shown(c) for c in self.meta.all("select * from connection order by id")]

    def connection(self, cid: int) -> dict:
        return self._shown(self._connection(cid))

    def _connection(self, cid: int) -> dict:
        c = self.meta.one("select * from connection where id = ?", cid)
        if c is None:
            raise NotFound(f"Connection {cid} does not exist")
        return c | {"options": json.loads(c["options"] or "{}")}

    @staticmethod
    def _shown(c: dict) -> dict:
        c = dict(c)
        return c | {"passwordSet": bool(c.pop("secret_name"))}

    def save_connection(self, c: dict, cid: int | None = None) -> dict:
        """Create or change. ``secret_name`` names the environment variable of the password: None keeps it, blank clears it."""
        if not (c.get("name") or "").strip() or len(c["name"]) > 100:
            raise InvalidRequest("name is required, of 100 characters at most")
        if c.get("kind") not in KINDS:
            raise InvalidRequest(f"kind must be one of {', '.join(KINDS)}")
        validate_connection(c)
        old = self._connection(cid) if cid is not None else {}
        if old and old["kind"] != c["kind"] and self._used(cid):
            raise Conflict("A connection in use cannot change its kind")
        secret = old.get("secret_name") if c.get("secret_name") is None else c["secret_name"] or None
        row = (c["name"], c["kind"], c["db_type"], c.get("uri"), c.get("host"), c.get("port"), c.get("database"), c.get("username"), secret, json.dumps(c.get("options") or {}))
        try:
            if cid is None:
                cid = self.meta.do("insert into connection (name, kind, db_type, uri, host, port, database, username, secret_name, options) values (?, ?, ?, ?, ?, ?, ?, ?, ?, ?)", *row)
            else:
                self.meta.do("update connection set name = ?, kind = ?, db_type = ?, uri = ?, host = ?, port = ?, database = ?, username = ?, secret_name = ?, options = ? where id = ?", *row, cid)
        except sqlite3.IntegrityError as e:
            raise Conflict(f"A connection named {c['name']!r} exists") from e
        return self.connection(cid)

    def _used(self, cid: int) -> bool:
        return any(cid in (json.loads(j["spec"])[k] for k in ("source", "target")) for j in self.meta.all("select spec from job"))

    def delete_connection(self, cid: int) -> None:
        self._connection(cid)
        if self._used(cid):
            raise Conflict("The connection is used by a job")
        self.meta.do("delete from connection where id = ?", cid)

    def source(self, cid: int) -> Source:
        c = self._connection(cid)
        if c["kind"] != "SOURCE":
            raise InvalidRequest("The connection is not a source")
        return self._open(c)

    def _open(self, c: dict) -> Source:
        r = resolve(c)
        return open_source(self.spark, c["db_type"], r.url, r.options, Credentials(r.username, r.password), r.database)

    def open_target(self, cid: int | None) -> VersionedStore | JdbcTarget:
        """The target of a connection; without one, the store of this node."""
        if cid is None:
            return self.target
        c = self._connection(cid)
        if c["kind"] != "TARGET":
            raise InvalidRequest("The connection is not a target")
        return self._target(c)

    def _target(self, c: dict) -> VersionedStore | JdbcTarget:
        if c["db_type"] == "PARQUET":
            return VersionedStore(self.spark, resolve(c).url)
        r, d = resolve(c), dialect(c["db_type"])
        login = {k: v for k, v in (("user", r.username), ("password", r.password)) if v}
        return JdbcTarget(self.spark, r.url, d, r.options | login)

    def test_connection(self, c: int | dict) -> dict:
        """Probe a saved connection, source or target, or one that is not saved yet."""
        c = self._connection(c) if isinstance(c, int) else c
        if c.get("kind") != "TARGET":
            return self._open(c).probe()
        start, target = time.monotonic(), self._target(c)
        try:
            target.probe() if isinstance(target, JdbcTarget) else target.pointer()
        except Exception as e:
            raise Unreachable(str(e).splitlines()[0]) from e
        return {"ok": True, "message": "connected", "latencyMs": int((time.monotonic() - start) * 1000)}

    def list_objects(self, cid: int) -> list[str]:
        return self.source(cid).list_objects()

    def infer(self, cid: int, collection: str, size: int = DEFAULT_SAMPLE) -> Proposal:
        s = self.source(cid)
        return infer_from(s.load(collection), collection, s.doc_column, size)

    # Jobs

    def list_jobs(self) -> list[dict]:
        return [self.job(j["id"]) for j in self.meta.all("select id from job order by id")]

    def job(self, jid: int) -> dict:
        row = self.meta.one("select * from job where id = ?", jid)
        if row is None:
            raise NotFound(f"Job {jid} does not exist")
        last = self.meta.one("select * from run where job_id = ? order by started_at desc, id desc limit 1", jid)
        mappings = [{"id": m["id"], "collection": m["collection"], "target": m["target"], **json.loads(m["spec"])} for m in self.meta.all("select * from mapping where job_id = ? order by order_index", jid)]
        due = self.scheduler.next_fire(jid)
        return json.loads(row["spec"]) | {"id": jid, "name": row["name"], "enabled": bool(row["enabled"]), "version": row["version"], "mappings": mappings, "running": self.runner.is_running(jid), "nextFireTime": due.isoformat() if due else None, "lastRun": last and last | {"durationMs": duration_ms(last)}}

    def _validated(self, j: dict) -> tuple[dict, list[dict]]:
        if not (j.get("name") or "").strip():
            raise InvalidRequest("name is required")
        spec = {"source": j.get("source"), "target": j.get("target"), "cron": j.get("cron") or None, "timezone": j.get("timezone") or "UTC", "syncMode": j.get("syncMode") or "FULL", "writeMode": j.get("writeMode") or "UPSERT", "batchSize": j.get("batchSize", 1000), "maxRetries": j.get("maxRetries", 3), "autoCreate": j.get("autoCreate", True)}
        if self._connection(spec["source"])["kind"] != "SOURCE":
            raise InvalidRequest("The source connection is not a source")
        if spec["target"] is not None:
            if self._connection(spec["target"])["kind"] != "TARGET":
                raise InvalidRequest("The target connection is not a target")
            self.open_target(spec["target"])  # a database without a dialect is refused
        if spec["cron"]:
            Cron(spec["cron"], spec["timezone"])
        if spec["writeMode"] not in MODES:
            raise InvalidRequest(f"Unknown write mode {spec['writeMode']}")
        if not 1 <= spec["batchSize"] <= 50_000 or not 0 <= spec["maxRetries"] <= 10:
            raise InvalidRequest("batchSize goes from 1 to 50000 and maxRetries from 0 to 10")
        mappings = j.get("mappings") or []
        if not 1 <= len(mappings) <= 50:
            raise InvalidRequest("A job has from 1 to 50 mappings")
        pairs, tables = set(), set()
        for m in mappings:
            try:
                plan = compile_mapping(m.get("target"), m.get("mapping"))
            except InvalidMapping as e:
                raise InvalidRequest(str(e)) from e
            parse_filter(m.get("filter"))
            if (m["collection"], m["target"].lower()) in pairs:
                raise InvalidRequest(f"{m['collection']} to {m['target']} is listed twice")
            pairs.add((m["collection"], m["target"].lower()))
            for t in plan.tables:
                if t.name.lower() in tables:
                    raise InvalidRequest(f"Table '{t.name}' is written by more than one mapping")
                tables.add(t.name.lower())
        self._task(0, spec, [{"id": 0, **m} for m in mappings]).validate()
        return spec, mappings

    def _idle(self, jid: int) -> None:
        if self.runner.is_running(jid):
            raise Conflict(f"Job {jid} is running")

    def save_job(self, j: dict, jid: int | None = None) -> dict:
        """Create or change; a mapping of the same collection and table keeps its checkpoint."""
        spec, mappings = self._validated(j)
        if jid is not None:
            self.job(jid)
            self._idle(jid)
        try:
            with self.meta.transaction():
                if jid is None:
                    jid = self.meta.do("insert into job (name, spec, enabled) values (?, ?, ?)", j["name"], json.dumps(spec), int(j.get("enabled", True)))
                else:
                    self.meta.do("update job set name = ?, spec = ?, enabled = ?, version = version + 1 where id = ?", j["name"], json.dumps(spec), int(j.get("enabled", True)), jid)
                old = {(m["collection"], m["target"]): m["id"] for m in self.meta.all("select * from mapping where job_id = ?", jid)}
                for i, m in enumerate(mappings):
                    own = json.dumps({k: m.get(k) for k in ("mapping", "watermarkField", "filter")})
                    kept = old.pop((m["collection"], m["target"]), None)
                    if kept is None:
                        self.meta.do("insert into mapping (job_id, order_index, collection, target, spec) values (?, ?, ?, ?, ?)", jid, i, m["collection"], m["target"], own)
                    else:
                        self.meta.do("update mapping set order_index = ?, spec = ? where id = ?", i, own, kept)
                for gone in old.values():
                    self.meta.do("delete from mapping where id = ?", gone)
        except sqlite3.IntegrityError as e:
            raise Conflict(f"A job named {j['name']!r} exists") from e
        self._schedule(jid)
        return self.job(jid)

    def delete_job(self, jid: int) -> None:
        self.job(jid)
        self._idle(jid)
        self.meta.do("delete from job where id = ?", jid)
        self.scheduler.sync(jid, None)

    def pause(self, jid: int, paused: bool = True) -> dict:
        self.job(jid)
        self.meta.do("update job set enabled = ? where id = ?", int(not paused), jid)
        self._schedule(jid)
        return self.job(jid)

    def resume(self, jid: int) -> dict:
        return self.pause(jid, False)

    def reset_checkpoint(self, jid: int) -> None:
        self.job(jid)
        self._idle(jid)
        self.meta.do("delete from checkpoint where mapping_id in (select id from mapping where job_id = ?)", jid)

    @staticmethod
    def _task(jid: int, spec: dict, mappings: list[dict]) -> JobTask:
        return JobTask(jid, [MappingTask(m["id"], m["collection"], m["target"], m.get("mapping"), m.get("watermarkField"), m.get("filter")) for m in mappings], spec["syncMode"], spec["writeMode"], spec["batchSize"], spec["maxRetries"], spec["autoCreate"])

    def run_now(self, jid: int, trigger: str = "MANUAL", wait: bool = False):
        """Start a run: its id, or with ``wait`` its final row."""
        j = self.job(jid)
        task, source = self._task(jid, j, j["mappings"]), self.source(j["source"])
        task.target = self.open_target(j["target"])
        return self.runner.run(task, source, trigger) if wait else self.runner.start(task, source, trigger)

    def _schedule(self, jid: int) -> None:
        row = self.meta.one("select * from job where id = ?", jid)
        spec = json.loads(row["spec"])
        self.scheduler.sync(jid, spec["cron"], spec["timezone"], bool(row["enabled"]))

    def _fire(self, jid: int) -> None:
        """One firing: skipped if the job runs, unscheduled if it is gone."""
        try:
            self.run_now(jid, "CRON", wait=True)
        except Conflict:
            return
        except NotFound:
            self.scheduler.sync(jid, None)

    # Runs

    def run(self, rid: int) -> dict:
        r = self.meta.one("select * from run where id = ?", rid)
        if r is None:
            raise NotFound(f"Run {rid} does not exist")
        return r | {"durationMs": duration_ms(r)}

    def runs(self, jid: int, page: int = 0, size: int = 20) -> dict:
        self.job(jid)
        return self.meta.page(f"select * from run where job_id = {int(jid)}", "started_at desc, id desc", page, size)

    def dead_letters(self, rid: int, page: int = 0, size: int = 20) -> dict:
        self.run(rid)
        pages = self.meta.page(f"select documents from dead_letter_file where run_id = {int(rid)}", "documents", page, size)  # checks the limits
        total = self.meta.one("select coalesce(sum(documents), 0) as n from dead_letter_file where run_id = ?", rid)["n"]
        return pages | {"items": self.runner.dead_letters(rid, page, size), "total": total, "pages": -(-total // size)}

    def cancel(self, rid: int) -> dict:
        if self.run(rid)["status"] != "RUNNING":
            raise Conflict(f"Run {rid} is not running")
        self.runner.cancel(rid)
        return self.run(rid)
