import json
import threading
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tabulon.errors import Conflict, InvalidRequest, NotFound, TargetSchemaError, TransientError, Unreachable
from tabulon.operators.mapping import map_documents
from tabulon.operators.sinks import PostgresDialect, VersionedStore, dialect
from tabulon.plans.spec import compile_mapping
from tabulon.service.control import Control, resolve
from tabulon.service.cron import Cron
from tabulon.service.runner import RunContext, Runner
from tabulon.service.store import Store, decode_value, encode_value

#: A market's stalls: each with what it sells and the days it stands.
MAPPING = {"primaryKey": {"source": "stall"}, "fields": [{"path": "kind", "length": 10}, {"path": "rent", "type": "DOUBLE"}, {"path": "seen", "type": "TIMESTAMP"}, {"path": "note", "strategy": "JSON"},
                      {"path": "goods", "strategy": "CHILD_TABLE", "childTable": "goods", "fields": [{"path": "what"}, {"path": "kilos", "type": "INT"}]}, {"path": "days", "strategy": "CHILD_TABLE", "childTable": "days"}]}
TABLES = ("stalls", "goods", "days")


def stalls():
    seen = lambda d: {"$date": f"2023-09-{d:02d}T06:00:00Z"}
    return [
        {"_id": 1, "stall": "N4", "kind": "fish", "rent": 80, "goods": [{"what": "cod", "kilos": 12}], "days": ["tue", "sat"], "seen": seen(1)},
        {"_id": 2, "stall": "N7", "kind": "fruit", "rent": 65.5, "goods": [{"what": "pears", "kilos": 40}, {"what": "plums"}, {"what": "figs", "kilos": 3}], "seen": seen(3)},
        {"_id": 3, "stall": "S1", "kind": "cheese", "days": ["sat"], "note": {"shade": True}, "seen": seen(3)},
        {"_id": 4, "stall": "S2", "seen": seen(9)},
    ]


class World:
    def __init__(self, spark, root):
        self.root = root
        (root / "src").mkdir()
        self.store = VersionedStore(spark, f"file://{root}/target")
        self.control = Control(spark, Store(), self.store, node="n1")
        self.control.runner.first_wait = 0.01
        self.cid = self.control.save_connection({"name": "src", "kind": "SOURCE", "db_type": "JSONL", "uri": f"file://{root}/src", "options": {"idType": "int"}})["id"]

    def put(self, docs, name="stalls"):
        (self.root / "src" / f"{name}.jsonl").write_text("".join(json.dumps(d) + "\n" for d in docs))

    def job(self, jid=None, mapping=MAPPING, **rest):
        m = {"collection": "stalls", "target": "stalls", "mapping": mapping} | {k: rest.pop(k) for k in ("watermarkField", "filter") if k in rest}
        return self.control.save_job({"name": "j", "source": self.cid, "mappings": [m]} | rest, jid)["id"]

    def go(self, jid):
        r = self.control.run_now(jid, wait=True)
        return r["status"], r["docs_read"], r["rows_written"], r["docs_failed"]


@pytest.fixture
def world(spark, tmp_path):
    return World(spark, tmp_path)


def counts(world):
    return [world.store.read(t).count() for t in TABLES]


def test_full_upsert_replaces_children(world):
    world.put(stalls())
    jid = world.job()
    assert world.go(jid) == ("SUCCEEDED", 4, 11, 0) and counts(world) == [4, 4, 3]
    docs = stalls()
    docs[1] |= {"goods": [{"what": "quinces", "kilos": 9}], "days": ["wed"]}
    docs[0] |= {"goods": None, "days": []}
    world.put(docs[:2])
    assert world.go(jid) == ("SUCCEEDED", 2, 4, 0) and counts(world) == [4, 1, 2]
    assert world.store.read("goods").first().what == "quinces"
    assert world.control.meta.all("select * from checkpoint") == [] and world.control.runs(jid, 0, 1)["pages"] == 2


def test_bad_documents_become_dead_letters(world):
    bad = [{"_id": 20 + i, "stall": f"B{i}", "rent": "dear"} for i in range(5)] + [{"_id": 30, "stall": "C1", "note": {"x": "nul\u0000"}}, {"_id": 31}]
    world.put([bad[6], *stalls(), *bad[5::-1]])
    jid = world.job()
    assert world.go(jid) == ("PARTIAL", 11, 11, 7)
    rid = world.control.job(jid)["lastRun"]["id"]
    pages = [world.control.dead_letters(rid, p, 3) for p in range(4)]
    assert [len(p["items"]) for p in pages] == [3, 3, 1, 0] and all((p["total"], p["pages"]) == (7, 3) for p in pages)
    items = [x for p in pages for x in p["items"]]
    assert [x["source_id"] for x in items] == ["20", "21", "22", "23", "24", "30", "31"]  # as they were read
    assert json.loads(items[0]["payload"])["rent"] == "dear" and "column 'rent'" in items[0]["error"] and "primary key" in items[6]["error"] and items[0]["collection"] == "stalls"
    with pytest.raises(InvalidRequest):
        world.control.dead_letters(rid, 0, 201)


def numbered(ids):
    return [{"_id": i, "lot": f"L{i % 9}"} for i in ids]


KEYED = {"primaryKey": {"type": "INT"}, "fields": [{"path": "lot"}]}


def ids(world, table="stalls"):
    return sorted(r.id for r in world.store.read(table).collect())


def test_runs_resume_after_the_last_id(world):
    world.put(numbered(range(10, 22)))
    jid = world.job(mapping=KEYED, batchSize=5, writeMode="TRUNCATE_AND_LOAD")
    mid = world.control.job(jid)["mappings"][0]["id"]
    world.control.meta.save_checkpoint(mid, last_id=14)
    assert world.go(jid) == ("SUCCEEDED", 7, 7, 0) and ids(world) == list(range(15, 22))
    assert world.control.meta.checkpoint(mid) == (None, None)
    world.put(numbered([11, 17]))  # from the beginning, so the table is emptied first
    assert world.go(jid) == ("SUCCEEDED", 2, 2, 0) and ids(world) == [11, 17]


def test_many_documents_in_small_batches(world, monkeypatch):
    world.put(numbered(range(30_000)))
    jid = world.job(mapping=KEYED, batchSize=20)
    scans, commits, real = [], [], VersionedStore.write
    load = type(world.control.source(world.cid)).load
    monkeypatch.setattr(type(world.control.source(world.cid)), "load", lambda self, c: scans.append(c) or load(self, c))
    monkeypatch.setattr(VersionedStore, "write", lambda self, m, mode, mark=None: commits.append(m.frame) or real(self, m, mode, mark))
    assert world.go(jid) == ("SUCCEEDED", 30_000, 30_000, 0) and ids(world) == list(range(30_000))
    assert scans == ["stalls"] and 8 <= len(commits) <= 16
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in commits]
    assert all(p.count("__slice=") or "_staged" in p or "/src/" not in p for p in plans)
    parts = world.store.pointer()["tables"]["stalls"]["parts"]
    assert len(parts) < len(commits) and not world.store.files.entries("_staged")


def test_a_crash_between_the_commits_repeats_nothing(world, monkeypatch):
    world.put(numbered(range(40)))
    jid = world.job(mapping=KEYED, batchSize=10, writeMode="INSERT")
    mid = world.control.job(jid)["mappings"][0]["id"]
    real, calls = Store.save_checkpoint, []

    def crash(self, *a, **k):
        calls.append(a)
        if len(calls) == 2:
            raise RuntimeError("power cut")
        return real(self, *a, **k)

    monkeypatch.setattr(Store, "save_checkpoint", crash)
    assert world.go(jid)[0] == "FAILED"
    done = ids(world)
    assert 10 < len(done) < 40 and world.control.meta.checkpoint(mid)[0] < max(done)  # the target is ahead
    world.control.startup()
    status, read, written, failed = world.go(jid)
    assert (status, read, failed) == ("SUCCEEDED", 40 - len(done), 0) and ids(world) == list(range(40))
    assert world.go(jid) == ("PARTIAL", 40, 0, 40)  # a new run finds every key taken
    world.control.shutdown()


def test_incremental_rereads_the_boundary(world):
    world.put(stalls())
    jid = world.job(syncMode="INCREMENTAL", watermarkField="seen")
    assert world.go(jid)[:2] == ("SUCCEEDED", 4)
    docs = stalls()
    docs[0] |= {"kind": "eels", "seen": {"$date": "2023-09-09T06:00:00Z"}}
    world.put([*docs, {"_id": 9, "stall": "W1", "seen": {"$date": "2023-09-10T00:00:00Z"}}])
    assert world.go(jid)[1] == 3 and world.go(jid)[1] == 1
    assert {(r.id, r.kind) for r in world.store.read("stalls").collect()} >= {("N4", "eels"), ("W1", None)} and world.store.read("stalls").count() == 5


def test_schema_grows_and_refuses(world):
    world.put(stalls())
    narrow = {"primaryKey": {"source": "stall"}, "fields": [{"path": "kind"}]}
    jid = world.job(mapping=narrow)
    world.go(jid)
    jid = world.job(jid, mapping=narrow | {"fields": [*narrow["fields"], {"path": "rent", "type": "DOUBLE"}]})
    assert world.go(jid)[0] == "SUCCEEDED" and world.store.read("stalls").where("rent is not null").count() == 2
    other = world.control.save_job({"name": "k", "source": world.cid, "autoCreate": False, "mappings": [{"collection": "stalls", "target": "nowhere"}]})["id"]
    r = world.control.run_now(other, wait=True)
    assert r["status"] == "FAILED" and "'nowhere' does not exist" in r["error"]
    with pytest.raises(TargetSchemaError, match="key"):
        world.store.ensure(compile_mapping("stalls", {"primaryKey": {"column": "other_key"}}))
    world.control.meta.do("update mapping set spec = json_set(spec, '$.filter', '{bad') where job_id = ?", other)
    assert world.control.run_now(other, wait=True)["status"] == "FAILED"  # a filter that is bad in the store


def test_insert_refuses_keys_that_are_taken(world):
    world.put(stalls())
    jid = world.job(writeMode="INSERT")
    assert world.go(jid) == ("SUCCEEDED", 4, 11, 0)
    world.put([*stalls()[:2], {"_id": 8, "stall": "E5"}, {"_id": 9, "stall": "E5", "kind": "late"}])
    assert world.go(jid) == ("PARTIAL", 4, 1, 3) and counts(world) == [5, 4, 3]
    letters = world.control.dead_letters(world.control.job(jid)["lastRun"]["id"])["items"]
    assert [x["source_id"] for x in letters] == ["1", "2", "9"] and all("duplicate key" in x["error"] and json.loads(x["payload"]) for x in letters)


def batch(spark, rows, plan, mark=None, order=None):
    df = spark.createDataFrame(rows, "k int, v int, _id int, m int")
    return map_documents(df, plan, order=F.struct(*order) if order else None)


PAIRS = {"primaryKey": {"source": "k", "type": "INT"}, "fields": [{"path": "v", "type": "INT"}]}


def pairs(world, table="t"):
    return sorted((r.id, r.v) for r in world.store.read(table).collect())


def test_of_equal_keys_the_last_read_wins(world, spark):
    plan = compile_mapping("t", PAIRS)
    world.store.ensure(plan)
    rows = [(1, 10, 2, 5), (1, 9, 10, 4), (2, 1, 1, 1)]  # as text, 9 is above 10 and _id 2 above _id 10
    world.store.write(batch(spark, rows, plan, order=["_id"]), "UPSERT")
    assert pairs(world) == [(1, 9), (2, 1)]
    world.store.write(batch(spark, rows, plan, order=["m", "_id"]), "UPSERT")
    assert pairs(world) == [(1, 10), (2, 1)]
    for _ in range(2):  # a retry of the same position changes nothing
        assert world.store.write(batch(spark, [(3, 3, 3, 3)], plan), "UPSERT", ("load", "3")).rows == 1
    assert world.store.pointer()["version"] == 4 and world.store.position("load") == "3"


def test_two_writers_lose_nothing(world, spark, monkeypatch):
    one, two = compile_mapping("t", PAIRS), compile_mapping("u", PAIRS)
    first, second = world.store, VersionedStore(spark, world.store.root)
    first.ensure(one)
    second.ensure(two)
    commit, between = VersionedStore._commit, []

    def late(self, pointer):
        if self is first and not between:
            between.append(1)  # while the first is about to commit, the second does, to both tables
            second.write(batch(spark, [(7, 7, 7, 7)], two), "UPSERT")
            second.write(batch(spark, [(1, 2, 1, 1), (5, 5, 5, 5)], one), "UPSERT")
        return commit(self, pointer)

    monkeypatch.setattr(VersionedStore, "_commit", late)
    first.write(batch(spark, [(1, 1, 1, 1)], one), "UPSERT")
    assert pairs(world) == [(1, 1), (5, 5)] and pairs(world, "u") == [(7, 7)]
    between.clear()
    first.write(batch(spark, [(5, 9, 9, 9), (6, 6, 6, 6)], one), "INSERT")
    assert pairs(world) == [(1, 2), (5, 5), (6, 6)]
    threads = [threading.Thread(target=lambda i=i: VersionedStore(spark, first.root).write(batch(spark, [(100 + i, i, i, i)], one), "UPSERT")) for i in range(6)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(pairs(world)) == 9


def test_parts_are_merged_and_old_files_cleared(world, spark):
    world.put(stalls())
    world.go(world.job())
    for i in range(20):
        docs = stalls()[:2]
        docs[0] |= {"kind": f"k{i}", "goods": [{"what": "cod", "kilos": i}] * (i % 3)}
        df = spark.createDataFrame([(json.dumps(d),) for d in docs], "j string").select(F.parse_json("j").alias("doc"))
        world.store.write(map_documents(df, compile_mapping("stalls", MAPPING), "doc"), "UPSERT")
    parts = world.store.pointer()["tables"]["stalls"]["parts"]
    assert len(parts) <= 8 and counts(world) == [4, 4, 3]  # the last batch has one of "cod", and figs, pears and plums
    assert world.store.read("stalls").where("id = 'N4'").first().kind == "k19"
    assert world.store.vacuum() == 0 and world.store.vacuum(hours=-1) > 10 and counts(world) == [4, 4, 3]
    assert world.store.merge("goods", everything=True) and counts(world) == [4, 4, 3] and len(world.store.pointer()["tables"]["goods"]["parts"]) == 1


def test_retry_cancel_and_claim(world, monkeypatch):
    world.put(stalls())
    jid = world.job(maxRetries=2)
    real, fails = VersionedStore.write, [2]

    def flaky(self, *a, **k):
        if fails[0]:
            fails[0] -= 1
            raise TransientError("connection lost")
        return real(self, *a, **k)

    monkeypatch.setattr(VersionedStore, "write", flaky)
    assert world.go(jid)[0] == "SUCCEEDED"
    fails[0] = 9
    assert world.go(jid)[0] == "FAILED"
    runner = world.control.runner
    context = runner.claim(jid, "MANUAL")
    for refused in (lambda: runner.claim(jid, "CRON"), lambda: world.control.delete_job(jid), lambda: world.control.reset_checkpoint(jid), lambda: world.job(jid)):
        with pytest.raises(Conflict):
            refused()
    assert runner.recover() == 1 and runner.cancel(context.run_id)
    context.cancelled.set()
    runner.active.clear()
    with pytest.raises(Conflict):
        world.control.cancel(context.run_id)
    start = time.monotonic()
    stopped = RunContext(0)
    threading.Timer(0.05, stopped.cancelled.set).start()
    stopped.wait(5)
    assert time.monotonic() - start < 2


def test_control_rules(world):
    c = world.control
    bad = [{"mappings": []}, {"mappings": [{"collection": "a", "target": "a"}] * 2}, {"batchSize": 0}, {"maxRetries": 11}, {"syncMode": "INCREMENTAL"}, {"cron": "nope"}, {"writeMode": "MERGE"}, {"name": ""}]
    for b in bad:
        with pytest.raises(InvalidRequest):
            c.save_job({"name": "x", "source": world.cid, "mappings": [{"collection": "a", "target": "a"}]} | b)
    with pytest.raises(InvalidRequest, match="TRUNCATE"):
        world.job(syncMode="INCREMENTAL", writeMode="TRUNCATE_AND_LOAD", watermarkField="u")
    jid = world.job(cron="0 0 3 * * ?", timezone="Europe/Paris")
    assert c.job(jid)["nextFireTime"] and c.pause(jid)["nextFireTime"] is None and c.resume(jid)["enabled"]
    with pytest.raises(Conflict):
        c.delete_connection(world.cid)
    with pytest.raises(Conflict):
        c.save_connection({"name": "src", "kind": "SOURCE", "db_type": "JSONL", "uri": "x"})
    with pytest.raises(NotFound):
        c.run(99)
    with pytest.raises(InvalidRequest):
        c.runs(jid, 0, 201)
    world.put(stalls())
    assert c.list_objects(world.cid) == ["stalls"] and c.test_connection(world.cid)["ok"] and c.infer(world.cid, "stalls").watermark_field is None
    with pytest.raises(Unreachable):
        c.test_connection({"name": "y", "kind": "SOURCE", "db_type": "JSONL", "uri": "file:///nowhere/at/all"})
    assert "passwordSet" in c.connection(world.cid)
    for db, message in (("MYSQL", "not supported yet"), ("DERBY", None)):
        tid = c.save_connection({"name": db, "kind": "TARGET", "db_type": db, "host": "h", "database": "d"})["id"]
        if message:
            with pytest.raises(InvalidRequest, match=message):
                world.job(target=tid)
        else:
            assert world.job(jid, target=tid) == jid
            with pytest.raises(Conflict):
                c.delete_connection(tid)
    with pytest.raises(InvalidRequest, match="not a target"):
        world.job(jid, target=world.cid)


@pytest.mark.parametrize("kind, url", [("POSTGRESQL", "jdbc:postgresql://db.local:5432/w"), ("MYSQL", "jdbc:mysql://db.local:3306/w"), ("MARIADB", "jdbc:mariadb://db.local:3306/w"), ("SQLSERVER", "jdbc:sqlserver://db.local:1433;databaseName=w"), ("ORACLE", "jdbc:oracle:thin:@//db.local:1521/w"), ("MONGODB", "mongodb://db.local:27017/w")])
def test_urls(kind, url):
    assert resolve({"db_type": kind, "host": "db.local", "database": "w"}).url == url


def test_connection_rules(monkeypatch):
    monkeypatch.setenv("SECRET_X", "hunter2")
    r = resolve({"db_type": "MONGODB", "host": "h", "port": 27018, "database": "w", "options": {"authSource": "admin", "replicaSet": "rs0"}, "secret_name": "SECRET_X"})
    assert r.url == "mongodb://h:27018/w?authSource=admin&replicaSet=rs0" and r.options == {} and r.password == "hunter2" and "hunter2" not in repr(r)
    for c, message in [({"db_type": "MONGODB", "uri": "mongodb://app:secret@h/s"}, "password field"), ({"db_type": "POSTGRESQL", "uri": "jdbc:postgresql://h/s?user=a&password=b"}, "password field"), ({"db_type": "SQLSERVER", "uri": "jdbc:sqlserver://h;password=s"}, "password field"),
                       ({"db_type": "POSTGRESQL", "uri": "jdbc:mysql://h/s"}, "jdbc:postgresql:"), ({"db_type": "MYSQL"}, "uri or host"), ({"db_type": "ORACLE", "host": "h"}, "database is required")]:
        with pytest.raises(InvalidRequest, match=message):
            resolve(c)


def test_dialect():
    d, plan = PostgresDialect(), compile_mapping("sales.orders", {"fields": [{"path": "status", "length": 20}, {"path": "total", "type": "DECIMAL"}, {"path": "meta", "strategy": "JSON"}, {"path": "items", "strategy": "CHILD_TABLE", "childTable": "order_items", "fields": [{"path": "qty", "type": "INT"}]}]})
    assert d.quote("sales.orders") == '"sales"."orders"' and d.quote('we"ird') == '"we""ird"'
    assert d.create_table(plan.table) == 'CREATE TABLE "sales"."orders" ("id" varchar(255) NOT NULL, "status" varchar(20), "total" numeric, "meta" jsonb, PRIMARY KEY ("id"))'
    assert d.create_table(plan.children[0].table) == 'CREATE TABLE "order_items" ("parent_id" varchar(255) NOT NULL, "ordinal" integer NOT NULL, "qty" integer, PRIMARY KEY ("parent_id", "ordinal"))'
    assert d.add_column(plan.table, plan.table.columns[2]) == 'ALTER TABLE "sales"."orders" ADD COLUMN "total" numeric'
    assert d.upsert(plan.table).endswith('ON CONFLICT ("id") DO UPDATE SET "status" = EXCLUDED."status", "total" = EXCLUDED."total", "meta" = EXCLUDED."meta"')
    assert d.upsert(compile_mapping("ids", "{}").table).endswith('ON CONFLICT ("id") DO NOTHING')
    assert d.delete_where_in(plan.children[0].table, "parent_id", 3) == 'DELETE FROM "order_items" WHERE "parent_id" IN (?, ?, ?)'
    assert d.is_data_error("22001") and not d.is_transient("22001") and d.is_transient("40P01") and d.is_transient("08001") and not d.is_data_error("42P01")
    assert d.describe("value too long", "22001") == "[22001] value too long"
    with pytest.raises(InvalidRequest, match="not supported yet"):
        dialect("MYSQL")


@pytest.mark.parametrize("text, zone, after, want", [
    ("0 0 3 * * ?", "UTC", (2026, 1, 1, 4), (2026, 1, 2, 3)), ("*/15 * * * * ?", "UTC", (2026, 1, 1), (2026, 1, 1, 0, 0, 15)), ("0 30 2 ? * MON-FRI", "UTC", (2026, 1, 2, 3), (2026, 1, 5, 2, 30)), ("0 0 12 L * ?", "UTC", (2026, 2, 1), (2026, 2, 28, 12)),
    ("0 0 0 ? * 6L", "UTC", (2026, 1, 1), (2026, 1, 30)), ("0 0 0 ? * 2#1", "UTC", (2026, 1, 10), (2026, 2, 2)), ("0 0 3 * * ?", "Europe/Paris", (2026, 7, 1, 0), (2026, 7, 1, 1)), ("0 0 0 1 1 ? 2030", "UTC", (2026, 1, 1), (2030, 1, 1)), ("0 0 0 1W * ?", "UTC", (2026, 2, 1, 1), (2026, 2, 2)),
])
def test_cron(text, zone, after, want):
    assert Cron(text, zone).next_after(datetime(*after, tzinfo=timezone.utc)) == datetime(*want, tzinfo=timezone.utc)


@pytest.mark.parametrize("text", ["* * * *", "0 0 0 * * *", "61 0 0 * * ?", "0 0 0 ? * ?", "x 0 0 * * ?"])
def test_cron_rejects(text):
    with pytest.raises(InvalidRequest):
        Cron(text)


def test_scheduled_run(world):
    world.put(stalls())
    jid = world.job(cron="* * * * * ?")
    world.control.startup()
    for _ in range(150):
        time.sleep(0.2)
        if world.control.meta.one("select 1 from run where trigger = 'CRON' and status = 'SUCCEEDED'"):
            break
    world.control.pause(jid)
    world.control.shutdown()
    assert world.control.meta.one("select 1 from run where trigger = 'CRON' and status = 'SUCCEEDED'")


def test_checkpoint_values_keep_their_type():
    for v in ("a", 5, 1.5, True, datetime(2026, 1, 1), datetime(2026, 1, 1, tzinfo=timezone.utc), None):
        assert decode_value(encode_value(v)) == v and type(decode_value(encode_value(v))) is type(v)


def test_streaming_takes_in_only_new_files(world, spark, tmp_path):
    from tabulon.streaming.ingest import ingest
    src, plan = tmp_path / "in", compile_mapping("ev", {"primaryKey": {"type": "LONG"}, "fields": [{"path": "n", "type": "INT"}]})
    spark.sql("select id as _id, cast(id as string) as n from range(10)").write.parquet(str(src))
    go = lambda: ingest(spark.readStream.schema("_id long, n string").parquet(str(src)), plan, world.store, str(tmp_path / "cp"), rejected=str(tmp_path / "bad")).awaitTermination()
    go()
    spark.sql("select id as _id, if(id = 12, 'x', '7') as n from range(10, 15)").write.mode("append").parquet(str(src))
    go()
    v = world.store.pointer()["version"]
    go()
    assert world.store.read("ev").count() == 14 and world.store.pointer()["version"] == v and spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_streams_begun_anew_have_marks_of_their_own(world, spark, tmp_path):
    from tabulon.streaming.ingest import ingest
    plan = compile_mapping("ev", {"primaryKey": {"type": "LONG"}, "fields": [{"path": "n", "type": "INT"}]})
    for i in range(3):  # one folder, one checkpoint each: all batches have number 0
        spark.sql(f"select id as _id, cast(id as string) as n from range({10 * i}, {10 * i + 10})").write.parquet(str(tmp_path / f"in{i}"))
        ingest(spark.readStream.schema("_id long, n string").parquet(str(tmp_path / f"in{i}")), plan, world.store, str(tmp_path / f"cp{i}"), mode="INSERT").awaitTermination()
    assert world.store.read("ev").count() == 30


def test_sources_get_their_login(spark):
    from tabulon.sources.readers import Credentials, open_source
    login = Credentials("app", "p@ss/word")
    s = open_source(spark, "MONGODB", "mongodb://h:27017/shop", {}, login, "shop")
    assert s.location == "mongodb://app:p%40ss%2Fword@h:27017/shop" and s.options == {"format": "mongodb", "database": "shop"} and "p@ss" not in repr(login)
    assert open_source(spark, "CONNECTOR", "x", {"format": "f"}, login).options == {"format": "f", "user": "app", "password": "p@ss/word"}
    with pytest.raises(Unreachable, match="not on the class path"):
        s.load("c")
    with pytest.raises(InvalidRequest, match="database"):
        open_source(spark, "MONGODB", "mongodb://h", {}, login)
    spark.sql("create table if not exists listed_one as select 1 as _id")
    assert "default.listed_one" in open_source(spark, "TABLE", "").list_objects() and "listed_one" in open_source(spark, "TABLE", "default").list_objects()


def test_runner_is_exported():
    assert Runner
