"""Metadata in a small transactional store (SQLite): connections, jobs, checkpoints, runs, files of dead letters."""

from __future__ import annotations

import json
import sqlite3
import threading
from contextlib import contextmanager
from datetime import date, datetime, timezone
from decimal import Decimal

SCHEMA = """
create table if not exists connection (id integer primary key, name text not null unique, kind text not null, db_type text not null, uri text, host text, port integer, database text, username text, secret_name text, options text);
create table if not exists job (id integer primary key, name text not null unique, spec text not null, enabled integer not null default 1, version integer not null default 0);
create table if not exists mapping (id integer primary key, job_id integer not null references job(id) on delete cascade, order_index integer not null, collection text not null, target text not null, spec text not null);
create table if not exists checkpoint (mapping_id integer primary key references mapping(id) on delete cascade, last_id text, last_watermark text, updated_at text, load_id text);
create table if not exists run (id integer primary key, job_id integer not null references job(id) on delete cascade, trigger text not null, status text not null, started_at text not null, finished_at text, docs_read integer not null default 0, rows_written integer not null default 0, docs_failed integer not null default 0, error text, node text);
create unique index if not exists one_running on run(job_id) where status = 'RUNNING';
create table if not exists dead_letter_file (id integer primary key, run_id integer not null references run(id) on delete cascade, collection text not null, path text not null unique, documents integer not null, created_at text not null);
create index if not exists dead_letter_run on dead_letter_file(run_id, id);
"""


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def encode_value(value) -> str | None:
    """A checkpoint value as JSON that keeps its type."""
    if value is None:
        return None
    if isinstance(value, datetime):
        return json.dumps({"t": "timestamp" if value.tzinfo else "timestamp_ntz", "v": value.isoformat()})
    if isinstance(value, date):
        return json.dumps({"t": "date", "v": value.isoformat()})
    if isinstance(value, Decimal):
        return json.dumps({"t": "decimal", "v": str(value)})
    kinds = {bool: "bool", int: "int", float: "double", str: "string"}
    return json.dumps({"t": kinds[type(value)], "v": value})


def decode_value(text: str | None):
    if text is None:
        return None
    x = json.loads(text)
    read = {"timestamp": datetime.fromisoformat, "timestamp_ntz": datetime.fromisoformat, "date": date.fromisoformat, "decimal": Decimal}
    return read.get(x["t"], lambda v: v)(x["v"])


class Store:
    """One connection behind a lock; ``transaction`` commits or rolls back as a whole."""

    def __init__(self, path: str = ":memory:"):
        self.db = sqlite3.connect(path, check_same_thread=False, isolation_level=None)
        self.db.row_factory = sqlite3.Row
        self.lock = threading.RLock()
        self.db.execute("pragma foreign_keys = on")
        self.db.executescript(SCHEMA)

    @contextmanager
    def transaction(self):
        with self.lock:
            if self.db.in_transaction:  # part of an outer one
                yield self
                return
            self.db.execute("begin immediate")
            try:
                yield self
                self.db.execute("commit")
            except BaseException:
                self.db.execute("rollback")
                raise

    def one(self, sql: str, *args) -> dict | None:
        with self.lock:
            row = self.db.execute(sql, args).fetchone()
        return dict(row) if row else None

    def all(self, sql: str, *args) -> list[dict]:
        with self.lock:
            return [dict(r) for r in self.db.execute(sql, args).fetchall()]

    def do(self, sql: str, *args) -> int:
        with self.lock:
            return self.db.execute(sql, args).lastrowid

    def many(self, sql: str, rows) -> None:
        with self.lock:
            self.db.executemany(sql, rows)

    def close(self) -> None:
        self.db.close()

    # Checkpoints

    def checkpoint(self, mapping_id: int) -> tuple[object, object]:
        """(last id, last watermark) of a mapping."""
        row = self.one("select * from checkpoint where mapping_id = ?", mapping_id)
        return (decode_value(row["last_id"]), decode_value(row["last_watermark"])) if row else (None, None)

    def save_checkpoint(self, mapping_id: int, last_id=None, last_watermark=None) -> None:
        self.do("insert into checkpoint (mapping_id, last_id, last_watermark, updated_at) values (?, ?, ?, ?) on conflict(mapping_id) do update set last_id = excluded.last_id, last_watermark = excluded.last_watermark, updated_at = excluded.updated_at", mapping_id, encode_value(last_id), encode_value(last_watermark), now())

    def load(self, mapping_id: int) -> str | None:
        """The load that was under way when the mapping last ran, if it did not end."""
        row = self.one("select load_id from checkpoint where mapping_id = ?", mapping_id)
        return row and row["load_id"]

    def save_load(self, mapping_id: int, load: str | None) -> None:
        self.do("insert into checkpoint (mapping_id, updated_at, load_id) values (?, ?, ?) on conflict(mapping_id) do update set load_id = excluded.load_id", mapping_id, now(), load)

    def clear_checkpoint(self, mapping_id: int) -> None:
        self.do("delete from checkpoint where mapping_id = ?", mapping_id)

    # Pages

    def page(self, sql: str, order: str, page: int, size: int, *args) -> dict:
        """Rows of a page with totals; pages count from 0, sizes go from 1 to 200."""
        from tabulon.errors import InvalidRequest

        if page < 0 or not 1 <= size <= 200:
            raise InvalidRequest("page must be 0 or more and size from 1 to 200")
        total = self.one(f"select count(*) as n from ({sql})", *args)["n"]
        rows = self.all(f"{sql} order by {order} limit ? offset ?", *args, size, page * size)
        return {"items": rows, "page": page, "size": size, "total": total, "pages": -(-total // size)}
