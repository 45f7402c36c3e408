"""Relational targets over JDBC.

A batch goes to staging tables through Spark's own writer, over few connections and in batches of rows; then one
transaction on one connection moves it: parents are inserted or upserted from their staging table, children of every
staged parent are replaced, and the load's position is kept. So a batch is visible as a whole or not at all, and
a batch written twice is found out by its position.

What the database itself refuses (SQLSTATE classes 22 and 23) is narrowed down by halves to single documents, which are
returned as rejected; the rest of the batch is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from py4j.java_gateway import is_instance_of
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.errors import InvalidRequest, TargetSchemaError, TransientError
from tabulon.operators.mapping import ERROR, KEY, ORDER, ROW, Mapped
from tabulon.operators.sinks import MODES, Dialect, Written, latest
from tabulon.plans.spec import ColumnDef, MappingPlan, TableDef

#: Table of the positions of loads, rows of one statement, and connections of one write.
POSITIONS, BATCH, CONNECTIONS = "tabulon_loads", 500, 2


class DataError(Exception):
    """The database refuses values of the batch."""


class JdbcTarget:
    """Tables of one database. ``options`` go to the driver, as ``user`` and ``password``."""

    def __init__(self, spark: SparkSession, url: str, dialect: Dialect, options: dict[str, str] | None = None):
        self.spark, self.url, self.dialect, self.options = spark, url, dialect, dict(options or {})

    # Connections

    @contextmanager
    def _connected(self) -> Iterator:
        """One connection, as a transaction."""
        jvm = self.spark.sparkContext._jvm
        if "driver" in self.options:
            jvm.java.lang.Class.forName(self.options["driver"])
        properties = jvm.java.util.Properties()
        for k, v in self.options.items():
            if k != "driver":
                properties.setProperty(k, v)
        try:
            c = jvm.java.sql.DriverManager.getConnection(self.url, properties)
            c.setAutoCommit(False)
        except Py4JJavaError as e:
            raise self._error(e) from e
        try:
            yield c
            c.commit()
        except Py4JJavaError as e:
            c.rollback()
            raise self._error(e) from e
        except BaseException:
            c.rollback()
            raise
        finally:
            c.close()

    def _error(self, e: Py4JJavaError) -> Exception:
        """The kind of error that the SQLSTATE of the cause tells."""
        cause, state, message = e.java_exception, None, None
        while cause is not None and state is None:
            if is_instance_of(self.spark.sparkContext._gateway, cause, "java.sql.SQLException"):
                state, message = cause.getSQLState(), cause.getMessage()
            cause = cause.getCause()
        text = self.dialect.describe(message or str(e.java_exception.getMessage()), state)
        return TransientError(text) if self.dialect.is_transient(state) else DataError(text) if self.dialect.is_data_error(state) else RuntimeError(text)

    @staticmethod
    def _run(c, sql: str) -> None:
        s = c.createStatement()
        try:
            s.execute(sql)
        finally:
            s.close()

    @staticmethod
    def _rows(found, *columns: str) -> list[tuple]:
        out = []
        while found.next():
            out.append(tuple(found.getString(x) for x in columns))
        found.close()
        return out

    def probe(self) -> None:
        """Connect, or raise."""
        with self._connected():
            pass

    # Schema

    def columns(self, c, t: TableDef) -> list[str]:
        return [n for (n,) in self._rows(c.getMetaData().getColumns(None, t.schema_name, t.simple_name, None), "COLUMN_NAME")]

    def _has_key(self, c, t: TableDef) -> bool:
        """Whether the table's primary key, or a unique index, is exactly that of ``t``."""
        meta, want = c.getMetaData(), sorted(t.primary_key)
        if sorted(n for (n,) in self._rows(meta.getPrimaryKeys(None, t.schema_name, t.simple_name), "COLUMN_NAME")) == want:
            return True
        indexes: dict[str, list[str]] = {}
        for name, column in self._rows(meta.getIndexInfo(None, t.schema_name, t.simple_name, True, False), "INDEX_NAME", "COLUMN_NAME"):
            indexes.setdefault(name, []).append(column)
        return any(sorted(filter(None, i)) == want for i in indexes.values())

    def ensure(self, plan: MappingPlan, auto_create: bool = True, require_key: bool = True) -> list[str]:
        """Create missing tables and columns, or refuse; nothing is dropped, narrowed or widened."""
        made = []
        with self._connected() as c:
            marks = TableDef(POSITIONS, (ColumnDef("load_id", nullable=False), ColumnDef("upto", length=4000), ColumnDef("written", "LONG")), ("load_id",))
            if not self.columns(c, marks):
                self._run(c, self.dialect.create_table(marks))
            for i, t in enumerate(plan.tables):
                have = self.columns(c, t)
                if not have:
                    if not auto_create:
                        raise TargetSchemaError(f"Table '{t.name}' does not exist")
                    self._run(c, self.dialect.create_table(t))
                    made.append(t.name)
                    continue
                for column in t.columns:
                    if column.name in have:
                        continue
                    if column.name in t.primary_key or not auto_create:
                        raise TargetSchemaError(f"Table '{t.name}' lacks {'key ' * (column.name in t.primary_key)}column '{column.name}'")
                    self._run(c, self.dialect.add_column(t, column))
                    made.append(f"{t.name}.{column.name}")
                if require_key and i == 0 and not self._has_key(c, t):
                    raise TargetSchemaError(f"Table '{t.name}' has no primary key or unique index on {', '.join(t.primary_key)}")
        return made

    def truncate(self, plan: MappingPlan) -> None:
        """Empty all tables of a plan, children first, in one transaction."""
        with self._connected() as c:
            for t in reversed(plan.tables):
                self._run(c, self.dialect.truncate(t))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=self.dialect.quote(name), **self.options).load()

    # Writing

    def _position(self, c, load: str) -> tuple[str, int] | None:
        s = c.prepareStatement(f"SELECT {self.dialect.quote('upto')}, {self.dialect.quote('written')} FROM {self.dialect.quote(POSITIONS)} WHERE {self.dialect.quote('load_id')} = ?")
        s.setString(1, load)
        found = s.executeQuery()
        row = (found.getString(1), found.getLong(2)) if found.next() else None
        s.close()
        return row

    def position(self, load: str) -> str | None:
        with self._connected() as c:
            row = self._position(c, load)
        return row and row[0]

    def write(self, mapped: Mapped, mode: str, mark: tuple[str, str] | None = None) -> Written:
        """Put a mapped batch into the plan's tables; see the module's description. ``mark`` is (load, position)."""
        if mode not in MODES:
            raise InvalidRequest(f"Unknown write mode {mode}")
        if mark is not None:
            with self._connected() as c:
                known = self._position(c, mark[0])
            if known and known[0] == mark[1]:
                return Written(known[1])
        rows = mapped.sound if mode == "INSERT" else latest(mapped)
        rows = rows.select(KEY, ROW, "__id", "__doc", *([ORDER] if ORDER in rows.columns else []), "__parent", *[f"__child{i}" for i in range(len(mapped.plan.children))]).persist()
        try:
            total, bad = self._put(mapped, rows, mode, mark)
        finally:
            rows.unpersist()
        return Written(total, len(bad), reduce(DataFrame.union, bad)) if bad else Written(total)

    def _put(self, mapped: Mapped, rows: DataFrame, mode: str, mark: tuple[str, str] | None, depth: int = 0) -> tuple[int, list[DataFrame]]:
        """Rows written, and what was refused, a frame of one row a document."""
        try:
            return self._transaction(mapped.plan, rows, mode, mark), []
        except DataError as e:
            if rows.limit(2).count() == 1:
                return 0, [mapped.refused(rows, str(e))]
            half = F.pmod(F.xxhash64(ROW, F.lit(depth)), F.lit(2))
            halves = [self._put(mapped, rows.where(half == i), mode, mark if i else None, depth + 1) for i in (0, 1)]
            return sum(n for n, _ in halves), [x for _, b in halves for x in b]

    def _transaction(self, plan: MappingPlan, rows: DataFrame, mode: str, mark: tuple[str, str] | None) -> int:
        one = Mapped(plan, rows.withColumn(ERROR, F.lit(None).cast("string")))
        d, tag, total = self.dialect, uuid.uuid4().hex[:12], 0
        stages = [TableDef(f"{t.name[:40]}_{tag}", tuple(ColumnDef(x.name, x.type, x.length) for x in map(d.stage_column, t.columns)), ()) for t in plan.tables]
        try:
            with self._connected() as c:
                for s in stages:
                    self._run(c, d.create_stage(s))
            for i, s in enumerate(stages):
                df = (one.parent if i == 0 else one.child(i - 1)).coalesce(CONNECTIONS)
                try:
                    df.write.format("jdbc").options(url=self.url, dbtable=d.quote(s.name), batchsize=str(BATCH), **d.write_options, **self.options).mode("append").save()
                except Py4JJavaError as e:
                    raise self._error(e) from e
                except Exception as e:  # as PySpark converts it
                    java = getattr(e, "_origin", None)
                    raise (self._error(_Origin(java)) if java is not None else e) from e
            with self._connected() as c:
                for i, (t, s) in enumerate(zip(plan.tables, stages)):
                    if i and mode != "INSERT":
                        self._run(c, d.delete_staged(t, plan.table, stages[0]))
                    self._run(c, d.insert_staged(t, s) if i or mode == "INSERT" else d.upsert_staged(t, s))
                    counted = c.createStatement()
                    found = counted.executeQuery(f"SELECT COUNT(*) FROM {d.quote(s.name)}")
                    found.next()
                    total += found.getLong(1)
                    counted.close()
                if mark is not None:
                    self._keep(c, *mark, total)
        finally:
            with self._connected() as c:
                for s in stages:
                    if self.columns(c, s):
                        self._run(c, f"DROP TABLE {d.quote(s.name)}")
        return total

    def _keep(self, c, load: str, upto: str, total: int) -> None:
        q = self.dialect.quote
        for sql, values in [(f"DELETE FROM {q(POSITIONS)} WHERE {q('load_id')} = ?", (load,)), (f"INSERT INTO {q(POSITIONS)} ({q('load_id')}, {q('upto')}, {q('written')}) VALUES (?, ?, {int(total)})", (load, upto))]:
            s = c.prepareStatement(sql)
            for i, v in enumerate(values, 1):
                s.setString(i, v)
            s.execute()
            s.close()


class _Origin:
    """A Java exception where one from Py4J is expected."""

    def __init__(self, java):
        self.java_exception = java
