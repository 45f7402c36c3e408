"""Sinks: a versioned Parquet store of sorted-out deltas, and SQL of relational dialects.

Plain Parquet has no MERGE or DELETE. A table of the store is a list of parts,
oldest first: each write adds one part with its rows and never touches
the others, so a write costs as much as its batch, however large the table is. A part of a
written batch also holds the keys that the batch replaces; reading, a row counts if no later part
replaces its key (children: their parent's key). Parts of like size are merged into one
when there are enough of them, so their number and the work of a read grow with the logarithm of the table.

All tables of a commit are named in one new version file, which is created only if no other
writer has taken its number: a writer that comes second looks again, so parents
and children become visible together and no commit is lost.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.errors import InvalidRequest, TargetSchemaError, TransientError
from tabulon.operators.mapping import ERROR, KEY, ORDER, ROW, Mapped
from tabulon.plans.spec import PARENT_ID, ColumnDef, MappingPlan, TableDef

MODES = ("UPSERT", "INSERT", "TRUNCATE_AND_LOAD")
#: Parts of like size that are merged into one, and the rows of the smallest size.
MERGE_AT, SMALLEST = 8, 10_000
#: Loads and streams whose last position is remembered.
MARKS = 1000
#: Folder of the keys that a write replaces.
KEYS = "_replaced"
#: Attempts to commit against other writers.
ATTEMPTS = 50
#: The error of a row whose key the table has already.
DUPLICATE = "[23505] duplicate key value violates the primary key of table '{table}'"


def last_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row a key, the last in ``order``; without an order, the greatest row."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*[F.col(c) for c in (*order, *[c for c in rest if c not in order])])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("r")) if rest else df.distinct()
    return picked.select(*keys, *[F.col(f"r.`{c}`").alias(c) for c in rest]).select(df.columns) if rest else picked


def latest(mapped: Mapped) -> DataFrame:
    """The sound documents of a mapped batch, of each key the last one that was read."""
    order = F.struct(*[c for c in (ORDER, ROW) if c in mapped.frame.columns])
    columns = [c for c in mapped.frame.columns if c != KEY]
    return mapped.sound.groupBy(KEY).agg(F.max_by(F.struct(*columns), order).alias("r")).select(KEY, *[F.col(f"r.`{c}`").alias(c) for c in columns])


class Files:
    """The few file operations the store needs, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        path = self.jvm.org.apache.hadoop.fs.Path(self.root)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = path.getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri() if path.toUri().getScheme() else self.fs.getUri(), conf)
        self.local = self.fs.getUri().getScheme() == "file"

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        p = self.path(name)
        if not self.fs.exists(p):
            return None
        stream = self.fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Create a file as a whole, unless it exists; False if it does.

        The content is written aside first. File systems with an atomic rename refuse an existing target;
        the local one does not, so there a hard link is made instead.
        """
        aside = self.path(f".{name.replace('/', '-')}-{uuid.uuid4().hex}")
        out = self.fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        target = self.path(name)
        self.fs.mkdirs(target.getParent())
        try:
            if self.local:
                os.link(aside.toUri().getPath(), target.toUri().getPath())
            else:
                modes = self.jvm.org.apache.hadoop.fs.Options.Rename
                options = self.jvm.java.lang.reflect.Array.newInstance(modes.NONE.getClass(), 1)
                options[0] = modes.NONE
                self.context.rename(aside, target, options)
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self.fs.delete(aside, False)

    def entries(self, name: str) -> list[tuple[str, int]]:
        """Names in a folder, and when each was changed (milliseconds)."""
        p = self.path(name)
        return [(s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass(frozen=True)
class Written:
    """What a write did: rows of all tables, and the documents it refused (``source_id, payload, error``), if any."""

    rows: int
    refused: int = 0
    rejected: DataFrame | None = field(default=None, compare=False)


@dataclass
class VersionedStore:
    """Tables below ``root``; see the module's description."""

    spark: SparkSession
    root: str

    def __post_init__(self) -> None:
        self.root = self.root.rstrip("/") if urlsplit(self.root).scheme else "file://" + os.path.abspath(self.root)
        self.files = Files(self.spark, self.root)

    # Catalog

    def _latest(self) -> int:
        return max((int(n[:-5]) for n, _ in self.files.entries("_versions") if n.endswith(".json") and n[0] != "."), default=0)

    def pointer(self) -> dict:
        """The newest version: tables with columns, key and parts, and the positions of loads."""
        for _ in range(ATTEMPTS):
            n = self._latest()
            text = self.files.read(self._file(n)) if n else json.dumps({"version": 0, "tables": {}, "marks": {}})
            if text is not None:  # else it was cleared away meanwhile
                return json.loads(text)
        raise TransientError("The store's newest version cannot be read")

    @staticmethod
    def _file(version: int) -> str:
        return f"_versions/{version:020d}.json"

    def _commit(self, pointer: dict) -> bool:
        """Make ``pointer`` the version after the one it was read from; False if another writer was first."""
        after = dict(pointer, version=pointer["version"] + 1)
        if not self.files.create(self._file(after["version"]), json.dumps(after)):
            return False
        if self._latest() > after["version"]:  # the number had been cleared away
            self.files.delete(self._file(after["version"]))
            return False
        return True

    def _change(self, change) -> object:
        """Apply ``change`` to the newest version until it is committed. It returns a result, and None if nothing is to change."""
        for _ in range(ATTEMPTS):
            pointer = self.pointer()
            before = json.dumps(pointer)
            result = change(pointer)
            if json.dumps(pointer) == before or self._commit(pointer):
                return result
        raise TransientError("Too many writers change the store")

    def tables(self) -> list[str]:
        return sorted(self.pointer()["tables"])

    def read(self, name: str) -> DataFrame:
        """The current rows of a table."""
        meta = self.pointer()["tables"].get(name)
        if meta is None:
            raise TargetSchemaError(f"Table '{name}' does not exist")
        return self._rows(meta, meta["parts"]).drop("__seq")

    def _rows(self, meta: dict, parts: list[dict]) -> DataFrame:
        """The rows of ``parts`` that no later one of them replaces, with the number of their part."""
        ddl = ", ".join(f"`{n}` {t}" for n, t in meta["columns"])
        some = [p for p in parts if p["rows"]]
        if not some:
            return self.spark.createDataFrame([], ddl + ", __seq int")
        numbers = {p["path"]: i for i, p in enumerate(parts)}
        rows = self._scan(ddl, [p["path"] for p in some], numbers, "__seq")
        replacing = [p for i, p in enumerate(parts) if p["keys"] and any(q["rows"] for q in parts[:i])]
        if not replacing:
            return rows
        owner, names = meta["owner"], rows.columns
        keys = self._scan(f"`{owner}` {dict(meta['columns'])[owner]}", [p["keys"] for p in replacing], {p["keys"]: numbers[p["path"]] for p in replacing}, "__newest")
        newest = keys.groupBy(owner).agg(F.max("__newest").alias("__newest"))
        return rows.join(newest, owner, "left").where(F.coalesce(F.col("__newest") <= F.col("__seq"), F.lit(True))).select(names)

    def _scan(self, ddl: str, paths: list[str], numbers: dict[str, int], name: str) -> DataFrame:
        """All files of parts in one scan; a row's part is known by the folder of its file."""
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"/(v-[^/]+/[^/]+)/[^/]*$", 1)
        table = F.create_map(*[F.lit(x) for k, v in numbers.items() for x in (k, v)])
        df = self.spark.read.schema(ddl).parquet(*[f"{self.root}/{x}" for x in paths])
        return df.select("*", F.element_at(table, folder).alias(name))

    def ensure(self, plan: MappingPlan, auto_create: bool = True, require_key: bool = True) -> list[str]:
        """Create missing tables and columns, or refuse; nothing is dropped, narrowed or widened."""

        def change(pointer: dict) -> list[str]:
            made = []
            for i, table in enumerate(plan.tables):
                meta = pointer["tables"].get(table.name)
                if meta is None:
                    if not auto_create:
                        raise TargetSchemaError(f"Table '{table.name}' does not exist")
                    owner = table.primary_key[0] if i == 0 else PARENT_ID
                    pointer["tables"][table.name] = {"columns": [[c.name, c.spark_type] for c in table.columns], "key": list(table.primary_key), "owner": owner, "parts": []}
                    made.append(table.name)
                    continue
                have = {n for n, _ in meta["columns"]}
                for c in table.columns:
                    if c.name in have:
                        continue
                    if c.name in table.primary_key:
                        raise TargetSchemaError(f"Table '{table.name}' lacks key column '{c.name}'")
                    if not auto_create:
                        raise TargetSchemaError(f"Table '{table.name}' lacks column '{c.name}'")
                    meta["columns"].append([c.name, c.spark_type])
                    made.append(f"{table.name}.{c.name}")
                if require_key and i == 0 and sorted(meta["key"] or []) != sorted(table.primary_key):
                    raise TargetSchemaError(f"Table '{table.name}' has no primary key or unique index on {', '.join(table.primary_key)}")
            return made

        return self._change(change)

    def truncate(self, plan: MappingPlan) -> None:
        """Empty all tables of a plan at once."""

        def change(pointer: dict) -> None:
            for t in plan.tables:
                pointer["tables"][t.name]["parts"] = []

        self._change(change)

    # Writing

    def position(self, load: str) -> str | None:
        """How far a load or stream has been written, as it said itself."""
        mark = self.pointer()["marks"].get(load)
        return mark and mark["upto"]

    def write(self, mapped: Mapped, mode: str, mark: tuple[str, str] | None = None) -> Written:
        """Put a mapped batch into the plan's tables as one version.

        ``mark`` is (load, position): a batch whose load has come to that very position is not written again, so a retry
        after a commit whose answer was lost does no harm. Of documents with one key
        the last in the batch's order wins, with its child rows. INSERT refuses documents whose key the table, or
        an earlier document, has already, if the table has a key.
        """
        if mode not in MODES:
            raise InvalidRequest(f"Unknown write mode {mode}")
        plan = mapped.plan
        known = self.pointer()
        if mark is not None and (known["marks"].get(mark[0]) or {}).get("upto") == mark[1]:
            return Written(known["marks"][mark[0]]["rows"])
        folder = f"v-{uuid.uuid4().hex}"
        name, key = plan.table.name, plan.table.primary_key[0]
        keyed = mode == "INSERT" and sorted(known["tables"][name]["key"] or []) == sorted(plan.table.primary_key)
        cols = ["__parent", *[f"__child{i}" for i in range(len(plan.children))]]
        order = F.struct(*[c for c in (ORDER, ROW) if c in mapped.frame.columns])
        rejected, refused = None, 0
        if mode == "INSERT" and not keyed:
            parents = mapped.sound.select(KEY, *cols).persist()
        else:
            pick = F.min_by if keyed else F.max_by  # of an INSERT the first counts, else the last
            sound = mapped.sound.withColumn("__at", order)
            parents = sound.groupBy(KEY).agg(pick(F.struct("__at", *cols), F.col("__at")).alias("r")).select(KEY, F.col("r.__at").alias("__at"), *[F.col(f"r.`{c}`").alias(c) for c in cols])
            if keyed:
                old = self.read(name).select(F.col(key).alias(KEY), F.lit(True).alias("__old"))
                parents = parents.join(old, KEY, "left")
            parents = parents.persist()
            if keyed:
                taken = sound.join(parents.select(KEY, F.col("__at").alias("__first"), "__old"), KEY).where(F.col("__old") | (F.col("__at") != F.col("__first")))
                rejected = mapped.refused(taken, DUPLICATE.format(table=name))
                refused = rejected.count()
        try:
            good = parents.where("__old is null") if keyed else parents
            one = Mapped(plan, good.withColumn(ERROR, F.lit(None).cast("string")).withColumn(ROW, F.lit(0)))
            keys = None if mode == "INSERT" else f"{folder}/{KEYS}"
            if keys:  # child rows of every parent written go, also of those that have none now
                for t in {t.primary_key[0] for t in plan.tables}:
                    good.select(F.col(KEY).alias(t)).write.parquet(f"{self.root}/{keys}-{t}")
            parts = {}
            for i, table in enumerate(plan.tables):
                rows = one.parent if i == 0 else one.child(i - 1)
                parts[table.name] = self._part(f"{folder}/{table.name}", rows, keys and f"{keys}-{table.primary_key[0]}")
        finally:
            parents.unpersist()
        total = sum(p["rows"] for p in parts.values())

        def change(pointer: dict) -> Written | None:
            if mark is not None and (pointer["marks"].get(mark[0]) or {}).get("upto") == mark[1]:
                return Written(pointer["marks"][mark[0]]["rows"])
            if keyed and pointer["tables"][name]["parts"] != known["tables"][name]["parts"]:
                return None  # another writer may have brought the same keys
            for t, part in parts.items():
                if part["rows"] or part["keys"]:
                    pointer["tables"][t]["parts"].append(part)
            if mark is not None:
                marks = {k: v for k, v in pointer["marks"].items() if k != mark[0]} | {mark[0]: {"upto": mark[1], "rows": total}}
                pointer["marks"] = dict(list(marks.items())[-MARKS:])
            return Written(total, refused, rejected if refused else None)

        done = self._change(change)
        if done is None:
            return self.write(mapped, mode, mark)
        for t in parts:
            self.merge(t)
        return done

    def _part(self, path: str, rows: DataFrame, keys: str | None) -> dict:
        rows.write.parquet(f"{self.root}/{path}")
        return {"path": path, "keys": keys, "rows": self.spark.read.schema(rows.schema).parquet(f"{self.root}/{path}").count()}

    def merge(self, name: str, everything: bool = False) -> bool:
        """Put the newest parts into one if enough of them are of like size, or all of them."""
        meta = self.pointer()["tables"][name]
        parts, first = meta["parts"], None
        size = [max(0, int(math.log(max(1, p["rows"]) / SMALLEST, MERGE_AT))) for p in parts]
        for level in range(max(size, default=0) + 1):
            tail = next((i for i in range(len(parts), 0, -1) if size[i - 1] > level), 0)
            if len(parts) - tail >= MERGE_AT:
                first = tail
        first = 0 if everything else first
        if first is None or len(parts) - first < 2:
            return False
        old, owner = parts[first:], meta["owner"]
        folder = f"v-{uuid.uuid4().hex}"
        replaced = [p["keys"] for p in old if p["keys"]]
        keys = f"{folder}/{KEYS}-{owner}" if first and replaced else None  # the oldest part replaces nothing
        if keys:
            kind = dict(meta["columns"])[owner]
            self.spark.read.schema(f"`{owner}` {kind}").parquet(*[f"{self.root}/{k}" for k in replaced]).distinct().write.parquet(f"{self.root}/{keys}")
        new = self._part(f"{folder}/{name}", self._rows(meta, old).drop("__seq"), keys)

        def change(pointer: dict) -> bool:
            have = pointer["tables"][name]["parts"]
            at = next((i for i in range(len(have)) if have[i : i + len(old)] == old), None)
            if at is None:
                return False  # truncated or merged by another writer meanwhile
            pointer["tables"][name]["parts"] = [*have[:at], new, *have[at + len(old) :]]
            return True

        return self._change(change)

    def vacuum(self, hours: float = 24) -> int:
        """Delete what is older than ``hours`` and in no version that is kept; the number of folders deleted.

        Versions are kept for as long, so readers and writers that began meanwhile find their files.
        """
        limit = (time.time() - hours * 3600) * 1000
        newest, used = self._latest(), set()
        for n, changed in self.files.entries("_versions"):
            if not n.endswith(".json") or n[0] == ".":
                continue
            if changed < limit and int(n[:-5]) != newest:
                self.files.delete(f"_versions/{n}")
            elif text := self.files.read(f"_versions/{n}"):
                used |= {x.split("/")[0] for t in json.loads(text)["tables"].values() for p in t["parts"] for x in (p["path"], p["keys"]) if x}
        gone = [n for n, changed in self.files.entries("") if n.startswith("v-") and n not in used and changed < limit]
        for n in gone:
            self.files.delete(n)
        return len(gone)


class Dialect:
    """SQL of a relational target; one subclass a database."""

    types: dict[str, str] = {}
    transient: tuple[str, ...] = ("08",)
    data_errors: tuple[str, ...] = ("22", "23")

    def quote(self, name: str) -> str:
        return ".".join('"' + p.replace('"', '""') + '"' for p in name.split("."))

    def column_type(self, c: ColumnDef) -> str:
        return self.types[c.type].format(n=c.limit)

    def create_table(self, t: TableDef) -> str:
        columns = [f"{self.quote(c.name)} {self.column_type(c)}" + ("" if c.nullable else " NOT NULL") for c in t.columns]
        return f"CREATE TABLE {self.quote(t.name)} ({', '.join(columns)}, PRIMARY KEY ({', '.join(map(self.quote, t.primary_key))}))"

    def add_column(self, t: TableDef, c: ColumnDef) -> str:
        return f"ALTER TABLE {self.quote(t.name)} ADD COLUMN {self.quote(c.name)} {self.column_type(c)}"

    def insert(self, t: TableDef) -> str:
        return f"INSERT INTO {self.quote(t.name)} ({', '.join(map(self.quote, t.column_names))}) VALUES ({', '.join('?' * len(t.columns))})"

    def upsert(self, t: TableDef) -> str:
        raise NotImplementedError

    def delete_where_in(self, t: TableDef, column: str, n: int) -> str:
        return f"DELETE FROM {self.quote(t.name)} WHERE {self.quote(column)} IN ({', '.join('?' * n)})"

    # Batches by way of staging tables

    #: Options of Spark's writer for this database.
    write_options: dict[str, str] = {}

    def stage_column(self, c: ColumnDef) -> ColumnDef:
        """A column while staged: what Spark's writer can bind, without a limit, so that only the table itself refuses."""
        return c

    def staged(self, c: ColumnDef) -> str:
        """A staged column as the table has it."""
        return self.quote(c.name)

    def create_stage(self, s: TableDef) -> str:
        return f"CREATE TABLE {self.quote(s.name)} ({', '.join(f'{self.quote(c.name)} {self.column_type(c)}' for c in s.columns)})"

    def insert_staged(self, t: TableDef, s: TableDef) -> str:
        return f"INSERT INTO {self.quote(t.name)} ({', '.join(map(self.quote, t.column_names))}) SELECT {', '.join(map(self.staged, t.columns))} FROM {self.quote(s.name)}"

    def upsert_staged(self, t: TableDef, s: TableDef) -> str:
        raise NotImplementedError

    def delete_staged(self, child: TableDef, parent: TableDef, s: TableDef) -> str:
        """Child rows of all staged parents."""
        return f"DELETE FROM {self.quote(child.name)} WHERE {self.quote(child.primary_key[0])} IN (SELECT {self.quote(parent.primary_key[0])} FROM {self.quote(s.name)})"

    def truncate(self, t: TableDef) -> str:
        return f"TRUNCATE TABLE {self.quote(t.name)}"

    def is_transient(self, state: str | None) -> bool:
        return bool(state) and state.startswith(self.transient)

    def is_data_error(self, state: str | None) -> bool:
        return bool(state) and state.startswith(self.data_errors)

    @staticmethod
    def describe(message: str, state: str | None) -> str:
        return f"[{state}] {message}" if state else message


class PostgresDialect(Dialect):
    types = {"STRING": "varchar({n})", "TEXT": "text", "INT": "integer", "LONG": "bigint", "DECIMAL": "numeric", "DOUBLE": "double precision", "BOOLEAN": "boolean", "TIMESTAMP": "timestamptz", "JSON": "jsonb", "BINARY": "bytea"}
    transient = ("08", "40001", "40P01", "57P01", "57P02", "57P03", "53300")

    def upsert(self, t: TableDef) -> str:
        rest = [c for c in t.column_names if c not in t.primary_key]
        keys = ", ".join(map(self.quote, t.primary_key))
        sets = ", ".join(f"{self.quote(c)} = EXCLUDED.{self.quote(c)}" for c in rest)
        return f"{self.insert(t)} ON CONFLICT ({keys}) DO " + (f"UPDATE SET {sets}" if rest else "NOTHING")

    write_options = {"reWriteBatchedInserts": "true"}

    def stage_column(self, c: ColumnDef) -> ColumnDef:
        return ColumnDef(c.name, "TEXT") if c.type in ("JSON", "STRING") else c

    def staged(self, c: ColumnDef) -> str:
        return f"CAST({self.quote(c.name)} AS jsonb)" if c.type == "JSON" else self.quote(c.name)

    def upsert_staged(self, t: TableDef, s: TableDef) -> str:
        return self.insert_staged(t, s) + self.upsert(t)[len(self.insert(t)) :]


class DerbyDialect(Dialect):
    """The database that Spark brings along."""

    types = {"STRING": "varchar({n})", "TEXT": "clob", "INT": "integer", "LONG": "bigint", "DECIMAL": "decimal(31, 10)", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp", "JSON": "clob", "BINARY": "blob"}
    transient = ("08", "40")

    def stage_column(self, c: ColumnDef) -> ColumnDef:
        # Spark binds missing text as a large object, which only such a column takes; keys are never missing.
        return c if c.type != "STRING" else ColumnDef(c.name, "TEXT") if c.nullable else ColumnDef(c.name, c.type, 32_672)

    def staged(self, c: ColumnDef, of: str = "") -> str:
        return f"CAST({of}{self.quote(c.name)} AS varchar(32672))" if c.type == "STRING" and c.nullable else of + self.quote(c.name)

    def upsert(self, t: TableDef) -> str:
        raise InvalidRequest("Rows are upserted from staging tables only")

    def upsert_staged(self, t: TableDef, s: TableDef) -> str:
        q = self.quote
        rest = [c for c in t.columns if c.name not in t.primary_key]
        on = " AND ".join(f"t.{q(c)} = s.{q(c)}" for c in t.primary_key)
        sets = ", ".join(f"{q(c.name)} = {self.staged(c, 's.')}" for c in rest)
        return f"MERGE INTO {q(t.name)} AS t USING {q(s.name)} AS s ON {on}" + (f" WHEN MATCHED THEN UPDATE SET {sets}" if rest else "") + f" WHEN NOT MATCHED THEN INSERT ({', '.join(map(q, t.column_names))}) VALUES ({', '.join(self.staged(c, 's.') for c in t.columns)})"


DIALECTS: dict[str, type[Dialect]] = {"POSTGRESQL": PostgresDialect, "DERBY": DerbyDialect}


def dialect(kind: str) -> Dialect:
    if kind.upper() not in DIALECTS:
        raise InvalidRequest(f"Target type {kind} is not supported yet")
    return DIALECTS[kind.upper()]()
