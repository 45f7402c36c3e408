"""Relational targets, on the database that Spark brings along."""

import uuid

import pytest
from pyspark.sql import functions as F

from tabulon.errors import TargetSchemaError, Unreachable
from tabulon.operators.jdbc import JdbcTarget
from tabulon.operators.mapping import map_documents
from tabulon.operators.sinks import DerbyDialect, PostgresDialect
from tabulon.plans.spec import compile_mapping

REPAIRS = {"primaryKey": {"type": "INT"}, "fields": [{"path": "item", "length": 8}, {"path": "cost", "type": "DECIMAL"}, {"path": "done", "type": "BOOLEAN"}, {"path": "at", "type": "TIMESTAMP"}, {"path": "log", "strategy": "JSON"}, {"path": "parts", "strategy": "CHILD_TABLE", "childTable": "used_parts", "fields": [{"path": "name"}, {"path": "n", "type": "INT"}]}]}


@pytest.fixture
def target(spark):
    return JdbcTarget(spark, f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", DerbyDialect())


def docs(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "j string").select(F.parse_json("j").alias("doc"))


def put(target, df, plan, mode="UPSERT", mark=None):
    return target.write(map_documents(df, plan, "doc").cache(), mode, mark)


def rows(target, name, *columns):
    return sorted((tuple(r) for r in target.read(name).select(*columns).collect()), key=str)


FIRST = ('{"_id": 1, "item": "bike", "cost": 12.5, "done": "yes", "at": {"$date": "2024-05-01T10:00:00Z"}, "log": {"by": "Mo"}, "parts": [{"name": "chain", "n": 1}, {"name": "bolt", "n": 4}]}', '{"_id": 2, "item": null, "parts": [{"n": 2}]}')


def test_batches_are_upserted_with_their_children(spark, target):
    plan = compile_mapping("repairs", REPAIRS)
    assert target.ensure(plan) == ["repairs", "used_parts"] and target.ensure(plan) == []
    done = put(target, docs(spark, *FIRST), plan, mark=("load", "2"))
    assert (done.rows, done.refused) == (5, 0)
    assert rows(target, "repairs", "id", "item", "done", "log") == [(1, "bike", True, '{"by":"Mo"}'), (2, None, None, None)]
    again = docs(spark, '{"_id": 1, "item": "car", "parts": []}', '{"_id": 3, "parts": [{"name": "wheel"}]}')
    assert put(target, again, plan, mark=("load", "3")).rows == 3 and put(target, again, plan, mark=("load", "3")).rows == 3
    assert rows(target, "repairs", "id", "item") == [(1, "car"), (2, None), (3, None)]
    assert rows(target, "used_parts", "parent_id", "ordinal", "name", "n") == [(2, 0, None, 2), (3, 0, "wheel", None)]
    assert (target.position("load"), target.position("other")) == ("3", None)
    target.truncate(plan)
    assert rows(target, "repairs", "id") == rows(target, "used_parts", "n") == []


def test_what_the_database_refuses_is_narrowed_down(spark, target):
    plan = compile_mapping("repairs", REPAIRS)
    target.ensure(plan)
    wider = compile_mapping("repairs", REPAIRS | {"fields": [{"path": "item", "length": 200}, *REPAIRS["fields"][1:]]})
    texts = [f'{{"_id": {i}, "item": "{"x" * (20 if i in (4, 11) else 3)}", "parts": [{{"n": {i}}}]}}' for i in range(14)]
    done = put(target, docs(spark, *texts), wider)
    bad = done.rejected.collect()
    assert (done.rows, done.refused) == (24, 2) and {r.source_id for r in bad} == {"4", "11"} and all(r.error.startswith("[22001]") for r in bad)
    assert [i for (i,) in sorted(rows(target, "repairs", "id"))] == [i for i in range(14) if i not in (4, 11)]
    twice = put(target, docs(spark, '{"_id": 1, "parts": [{"n": 1}]}', '{"_id": 99}'), plan, "INSERT")
    assert (twice.rows, twice.refused, twice.rejected.first().error[:7]) == (1, 1, "[23505]")


def test_schemas_grow_and_are_checked(spark, target):
    plan = compile_mapping("repairs", REPAIRS)
    with pytest.raises(TargetSchemaError, match="does not exist"):
        target.ensure(plan, auto_create=False)
    target.ensure(compile_mapping("repairs", {"primaryKey": {"type": "INT"}, "fields": [{"path": "item"}]}))
    with pytest.raises(TargetSchemaError, match="lacks column"):
        target.ensure(plan, auto_create=False)
    assert target.ensure(plan) == ["repairs.cost", "repairs.done", "repairs.at", "repairs.log", "used_parts"]
    with target._connected() as c:
        target._run(c, 'CREATE TABLE "keyless" ("id" integer not null)')
        target._run(c, 'CREATE TABLE "unique_one" ("id" integer not null unique)')
        target._run(c, 'CREATE TABLE "other" ("key" integer)')
    keyed = lambda name: compile_mapping(name, {"primaryKey": {"type": "INT"}})
    assert target.ensure(keyed("unique_one")) == [] and target.ensure(keyed("keyless"), require_key=False) == []
    for name, message in (("keyless", "no primary key"), ("other", "key column")):
        with pytest.raises(TargetSchemaError, match=message):
            target.ensure(keyed(name))


def test_a_run_writes_to_its_target(spark, tmp_path, monkeypatch):
    from tabulon.operators.sinks import VersionedStore
    from tabulon.service.control import Control
    from tabulon.service.store import Store

    monkeypatch.setenv("DB_PASSWORD", "s3cret")
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "repairs.jsonl").write_text("\n".join([*FIRST, '{"_id": 7, "cost": "much"}']))
    control = Control(spark, Store(), VersionedStore(spark, f"file://{tmp_path}/store"))
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    src = control.save_connection({"name": "in", "kind": "SOURCE", "db_type": "JSONL", "uri": f"file://{tmp_path}/src", "options": {"idType": "int"}})["id"]
    out = control.save_connection({"name": "out", "kind": "TARGET", "db_type": "DERBY", "uri": url, "username": "app", "secret_name": "DB_PASSWORD"})["id"]
    assert control.test_connection(out)["ok"] and control.open_target(out).options == {"user": "app", "password": "s3cret"}
    with pytest.raises(Unreachable):
        control.test_connection({"kind": "TARGET", "db_type": "DERBY", "uri": "jdbc:derby:memory:not-there"})
    job = control.save_job({"name": "j", "source": src, "target": out, "mappings": [{"collection": "repairs", "target": "repairs", "mapping": REPAIRS}]})["id"]
    run = control.run_now(job, wait=True)
    assert (run["status"], run["docs_read"], run["rows_written"], run["docs_failed"], run["error"]) == ("PARTIAL", 3, 5, 1, None)
    made = JdbcTarget(spark, url, DerbyDialect(), {"user": "app", "password": "s3cret"})
    assert made.read("used_parts").count() == 3 and control.dead_letters(run["id"])["items"][0]["source_id"] == "7"


def test_statements_of_postgres():
    d, plan = PostgresDialect(), compile_mapping("shop.repairs", REPAIRS)
    stage = type(plan.table)("s", tuple(map(d.stage_column, plan.table.columns)), ())
    assert d.create_stage(stage) == 'CREATE TABLE "s" ("id" integer, "item" text, "cost" numeric, "done" boolean, "at" timestamptz, "log" text)'
    assert d.upsert_staged(plan.table, stage) == 'INSERT INTO "shop"."repairs" ("id", "item", "cost", "done", "at", "log") SELECT "id", "item", "cost", "done", "at", CAST("log" AS jsonb) FROM "s" ON CONFLICT ("id") DO UPDATE SET "item" = EXCLUDED."item", "cost" = EXCLUDED."cost", "done" = EXCLUDED."done", "at" = EXCLUDED."at", "log" = EXCLUDED."log"'
    assert d.delete_staged(plan.children[0].table, plan.table, stage) == 'DELETE FROM "used_parts" WHERE "parent_id" IN (SELECT "id" FROM "s")'
    keys = compile_mapping("k", None).table
    assert d.upsert_staged(keys, stage).endswith('SELECT "id" FROM "s" ON CONFLICT ("id") DO NOTHING')
