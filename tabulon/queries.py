"""Registered queries of the mapping engine, each with the SQL that must give the same rows."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.filters import filter_documents
from tabulon.operators.mapping import Mapped, map_documents
from tabulon.operators.infer import infer_from, statistics
from tabulon.operators.sinks import VersionedStore
from tabulon.plans.spec import compile_mapping
from tabulon.service.control import Control
from tabulon.service.store import Store
from tabulon.sources.readers import ParquetSource, ReadRequest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
RANKED = f"select *, cast(row_number() over (partition by l_orderkey order by {', '.join(LINE)}) - 1 as int) as ordinal from lineitem"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document an order, with its lines as an array in a fixed order."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*LINE))).alias("items"))
    return items.withColumnRenamed("l_orderkey", "_id")


def mapped(df: DataFrame, target: str, fields: list[dict], key: dict | None = None, doc: str | None = None, **rest) -> Mapped:
    return map_documents(df, compile_mapping(target, {"primaryKey": key or {"type": "LONG"}, "fields": fields, **rest}), doc, payload=False)


@query(f"select l_orderkey as parent_id, ordinal, l_partkey as part, cast(l_quantity as int) as quantity, l_returnflag as flag from ({RANKED})")
def child_table(spark, sf_dir):
    fields = [{"path": "l_partkey", "column": "part", "type": "LONG"}, {"path": "l_quantity", "column": "quantity", "type": "INT"}, {"path": "l_returnflag", "column": "flag"}]
    return mapped(order_documents(spark, sf_dir), "orders", [{"path": "items", "strategy": "CHILD_TABLE", "childTable": "order_items", "fields": fields}]).child(0)


@query(f"select l_orderkey as id, l_partkey as first_part from ({RANKED}) where ordinal = 0")
def array_index(spark, sf_dir):
    return mapped(order_documents(spark, sf_dir), "orders", [{"path": "items.0.l_partkey", "column": "first_part", "type": "LONG"}]).parent


@query("select vec_id as parent_id, cast(i - 1 as int) as ordinal, cast(embedding[i] as double) as value from (select vec_id, embedding, unnest(generate_series(1, len(embedding))) as i from embeddings)")
def scalar_child(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "_id")
    return mapped(df, "vectors", [{"path": "embedding", "strategy": "CHILD_TABLE", "childTable": "vector_values", "type": "DOUBLE"}]).child(0)


@query("select event_id as id, cast(json_extract_string(props, '$.k') as int) as k from events")
def json_field(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), F.try_parse_json("props").alias("props"))
    return mapped(df, "events", [{"path": "props.k", "column": "k", "type": "INT"}]).parent


def _raw_numbers(spark, sf_dir) -> DataFrame:
    n = F.col("event_id")
    text = F.when(n % 5 == 0, F.concat(n.cast("string"), F.lit(".0"))).when(n % 5 == 1, F.concat(n.cast("string"), F.lit(".5"))).when(n % 5 == 2, F.concat(F.lit(" "), n.cast("string"), F.lit(" "))).when(n % 5 == 3, "1e3").otherwise(F.concat(F.lit("+"), n.cast("string")))
    return table(spark, sf_dir, "events").select(n.alias("_id"), text.alias("raw"))


_RAW = "select event_id, case event_id % 5 when 0 then event_id || '.0' when 1 then event_id || '.5' when 2 then ' ' || event_id || ' ' when 3 then '1e3' else '+' || event_id end as raw from events"


@query(f"select event_id as id, cast(try_cast(trim(raw) as double) as int) as n from ({_RAW}) where try_cast(trim(raw) as double) = floor(try_cast(trim(raw) as double))")
def coerce_int(spark, sf_dir):
    return mapped(_raw_numbers(spark, sf_dir), "numbers", [{"path": "raw", "column": "n", "type": "INT"}]).parent


@query(f"select cast(event_id as varchar) as source_id, 'column ''n'': cannot convert str ''' || raw || ''' to INT' as error from ({_RAW}) where event_id % 5 = 1")
def dead_letter(spark, sf_dir):
    return mapped(_raw_numbers(spark, sf_dir), "numbers", [{"path": "raw", "column": "n", "type": "INT"}]).rejected.select("source_id", "error")


@query(f"select event_id as id, cast(try_cast(trim(raw) as decimal(38, 10)) as double) as n from ({_RAW})")
def coerce_decimal(spark, sf_dir):
    return mapped(_raw_numbers(spark, sf_dir), "numbers", [{"path": "raw", "column": "n", "type": "DECIMAL"}]).parent.select("id", F.col("n").cast("double").alias("n"))


@query("select cast(doc_id as varchar) as source_id, 'column ''text'': value has ' || length(text) || ' characters, the column allows 255' as error from documents where length(text) > 255")
def length_guard(spark, sf_dir):
    df = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "_id")
    return mapped(df, "texts", [{"path": "text"}]).rejected.select("source_id", "error")


@query("select event_id as id, case when r in ('true', '1', 'yes', 'y') then true when r in ('false', '0', 'no', 'n') then false end as flag from (select event_id, lower(trim(raw)) as r from (select event_id, (['true', 'NO', ' Yes ', '0', 't', '2', ''])[event_id % 7 + 1] as raw from events)) where r in ('true', '1', 'yes', 'y', 'false', '0', 'no', 'n')")
def coerce_bool(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, ["true", "NO", " Yes ", "0", "t", "2", ""])), (F.col("event_id") % 7 + 1).cast("int"))
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), raw.alias("raw"))
    return mapped(df, "flags", [{"path": "raw", "column": "flag", "type": "BOOLEAN"}]).parent


@query("select event_id as id, case when event_id % 5 < 2 then timestamp '2026-03-02 09:15:00' when event_id % 5 = 2 then timestamp '2026-03-02 00:00:00' end as at from events where event_id % 5 < 3")
def coerce_ts(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, ["2026-03-02T09:15:00", "2026-03-02T09:15Z", "2026-03-02", "2026", "2026-03-02 09:15:00"])), (F.col("event_id") % 5 + 1).cast("int"))
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), raw.alias("raw"))
    return mapped(df, "times", [{"path": "raw", "column": "at", "type": "TIMESTAMP"}]).parent.select("id", F.to_timestamp_ntz(F.date_format("at", "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("at"))


@query("select event_id as id, make_timestamp((event_id * 86400000 + event_id) * 1000) as at from events")
def epoch_millis(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), (F.col("event_id") * 86_400_000 + F.col("event_id")).alias("ms"))
    return mapped(df, "times", [{"path": "ms", "column": "at", "type": "TIMESTAMP"}]).parent.select("id", F.expr("cast(at as timestamp_ntz)").alias("at"))


@query("select o_orderkey as id, rtrim(rtrim(printf('%.2f', o_totalprice), '0'), '.') as price from orders")
def coerce_string(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_id"), F.col("o_totalprice").alias("price"))
    return mapped(df, "prices", [{"path": "price"}]).parent


@query("select o_orderkey as id, c_name as customer_name, c_mktsegment as segment, c_acctbal as customer_balance from orders join customer on c_custkey = o_custkey")
def flatten_nested(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")).alias("customer"))
    df = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("_id"), "customer")
    return mapped(df, "orders", [{"path": "customer.name"}, {"path": "customer.segment", "column": "segment"}, {"path": "customer.balance", "type": "DOUBLE"}]).parent


@query("select event_id as id, '{\"kind\":\"' || event_type || '\",\"user\":' || user_id || '}' as extra from events")
def overflow_json(spark, sf_dir):
    text = F.to_json(F.struct(F.col("event_id").alias("_id"), F.col("event_type").alias("kind"), F.col("user_id").alias("user")))
    df = table(spark, sf_dir, "events").select(F.parse_json(text).alias("doc"))
    return mapped(df, "events", [], doc="doc", unmappedFields="JSON_OVERFLOW_COLUMN").parent.select("id", F.col("_extra").alias("extra"))


@query("select event_id as id, user_id as user, case when event_id % 3 = 0 then cast(event_id as int) end as n from events")
def extended_json(spark, sf_dir):
    n = F.col("event_id").cast("string")
    parts = [F.lit('{"_id":{"$numberLong":"'), n, F.lit('"},"user":'), F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(',"n":{"$numberDecimal":"'), n, F.lit('.00"}'))).otherwise(',"n":null'), F.lit("}")]
    df = table(spark, sf_dir, "events").select(F.parse_json(F.concat(*parts)).alias("doc"))
    return mapped(df, "events", [{"path": "user", "type": "LONG"}, {"path": "n", "type": "INT"}], doc="doc").parent


@query("select conv_id as parent_id, cast(row_number() over (partition by conv_id order by turn, role, text) - 1 as int) as ordinal, role, text from conversations")
def conversation_turns(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    fields = [{"path": "role"}, {"path": "text", "type": "TEXT"}]
    return mapped(df, "conversations", [{"path": "turns", "strategy": "CHILD_TABLE", "childTable": "turns", "fields": fields}]).child(0)


@query("select o_orderkey, o_custkey, o_orderdate from orders where o_orderdate >= timestamp '1997-01-01'")
def incremental_ge(spark, sf_dir):
    s = ParquetSource(spark, sf_dir, {"id": "o_orderkey"})
    return s.read(ReadRequest.incremental("orders", "o_orderdate", datetime(1997, 1, 1))).select("o_orderkey", "o_custkey", "o_orderdate")


@query("select o_orderkey, o_custkey from orders where o_orderkey > 7000")
def full_resume(spark, sf_dir):
    return ParquetSource(spark, sf_dir, {"id": "o_orderkey"}).read(ReadRequest.full("orders", after_id=7000)).select("o_orderkey", "o_custkey")


def _filtered(name: str, source: str, columns: list[str], condition: dict, where: str) -> None:
    def run(spark, sf_dir):
        return filter_documents(table(spark, sf_dir, source), condition).select(*columns)

    QUERIES[name], SQL[name] = run, f"select {', '.join(columns)} from {source} where {where}"


_filtered("filter_compare", "orders", ["o_orderkey", "o_totalprice"], {"o_totalprice": {"$gte": 100000, "$lt": 200000}, "o_orderstatus": "F"}, "o_totalprice >= 100000 and o_totalprice < 200000 and o_orderstatus = 'F'")
_filtered("filter_in", "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"], {"l_returnflag": {"$in": ["A", "R"]}}, "l_returnflag in ('A', 'R')")
_filtered("filter_or", "customer", ["c_custkey", "c_acctbal"], {"$or": [{"c_acctbal": {"$lt": 0}}, {"c_mktsegment": "BUILDING"}]}, "c_acctbal < 0 or c_mktsegment = 'BUILDING'")
_filtered("filter_nor", "customer", ["c_custkey"], {"$nor": [{"c_acctbal": {"$lt": 0}}, {"c_mktsegment": "BUILDING"}]}, "not (c_acctbal < 0 or c_mktsegment = 'BUILDING')")
_filtered("filter_regex", "part", ["p_partkey", "p_type"], {"p_type": {"$regex": "^[A-M]", "$options": "i"}}, "regexp_matches(p_type, '^[A-Ma-m]')")
_filtered("filter_exists", "orders", ["o_orderkey"], {"o_orderdate": {"$exists": True}, "nowhere": {"$exists": False}, "o_orderkey": {"$gt": 5}}, "o_orderkey > 5")
_filtered("filter_mod", "supplier", ["s_suppkey"], {"s_suppkey": {"$mod": [7, 3]}}, "s_suppkey % 7 = 3")
# A comparison only meets values of its own kind: no text is above or below a number, and not(above) takes all texts.
_filtered("filter_kinds", "events", ["event_id"], {"$or": [{"event_type": {"$gt": 5}}, {"event_type": {"$not": {"$gt": 5}}, "event_id": {"$lt": 100}}]}, "event_id < 100")


@query("select event_id, user_id from events where cast(json_extract_string(props, '$.k') as int) > 50 and event_type <> 'click'")
def filter_variant(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("doc", F.to_variant_object(F.struct(F.parse_json("props").alias("props"), "event_type")))
    return filter_documents(df, {"props.k": {"$gt": 50}, "event_type": {"$ne": "click"}}, "doc").select("event_id", "user_id")


# The store


def new_store(spark: SparkSession) -> VersionedStore:
    """An empty store below the folder that the session shares; a local session without one uses a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that driver and executors share")
    root = f"{(shared or 'file://' + tempfile.mkdtemp(prefix='tabulon-')).rstrip('/')}/tabulon/store-{uuid.uuid4().hex}"
    store = VersionedStore(spark, root)
    store.files.fs.mkdirs(store.files.path(""))
    store.files.fs.deleteOnExit(store.files.path(""))
    return store


def put(store: VersionedStore, df: DataFrame, target: str, mapping: dict, mode: str = "UPSERT", order=None):
    """Map a batch and write it as a run does."""
    plan = compile_mapping(target, mapping)
    store.ensure(plan, True, mode != "INSERT")
    m = map_documents(df, plan, order=order).cache()
    try:
        return store.write(m, mode)
    finally:
        m.unpersist()


BY_CUSTOMER = {"primaryKey": {"source": "o_custkey", "type": "LONG", "column": "o_custkey"}, "fields": [{"path": "o_orderkey", "type": "LONG"}, {"path": "o_totalprice", "type": "DOUBLE"}]}


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1")
def upsert_last_wins(spark, sf_dir):
    store = new_store(spark)
    put(store, table(spark, sf_dir, "orders"), "last_orders", BY_CUSTOMER, order=F.struct("o_orderdate", "o_orderkey"))
    return store.read("last_orders")


BALANCES = {"primaryKey": {"source": "c_custkey", "type": "LONG", "column": "c_custkey"}, "fields": [{"path": "balance", "type": "DOUBLE"}]}


@query("select c_custkey, case when c_custkey % 3 = 0 then c_acctbal + 1 else c_acctbal end as balance from customer union all select c_custkey + 1000000000, c_acctbal from customer where c_custkey % 300 = 0")
def upsert(spark, sf_dir):
    store, target = new_store(spark), table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    put(store, target, "balances", BALANCES)
    changed = target.where("c_custkey % 3 = 0").withColumn("balance", F.col("balance") + 1)
    new = target.where("c_custkey % 300 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000_000)
    put(store, changed.union(new), "balances", BALANCES)
    return store.read("balances")


ITEMS = {"primaryKey": {"type": "LONG"}, "fields": [{"path": "items", "strategy": "CHILD_TABLE", "childTable": "order_items", "fields": [{"path": "l_partkey", "column": "part", "type": "LONG"}]}]}


@query(f"select l_orderkey as parent_id, ordinal, l_partkey as part from ({RANKED}) where l_orderkey % 5 <> 0 union all select l_orderkey, ordinal, l_partkey from ({RANKED}) where l_orderkey % 5 = 0 and l_orderkey % 10 <> 0 and ordinal = 0")
def child_replace(spark, sf_dir):
    store, docs = new_store(spark), order_documents(spark, sf_dir)
    put(store, docs, "orders", ITEMS)
    put(store, docs.where("_id % 5 = 0").withColumn("items", F.when(F.col("_id") % 10 != 0, F.slice("items", 1, 1))), "orders", ITEMS)
    return store.read("order_items")


@query("select c_custkey, c_acctbal + case when c_custkey % 10 < 7 then c_custkey % 10 else 0 end as balance from customer")
def store_parts(spark, sf_dir):
    """More writes than parts are kept, so that some of them are merged; of each key the last write counts."""
    store, target = new_store(spark), table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    for i in range(10):
        put(store, target.where(F.lit(i == 0) | (F.col("c_custkey") % 10 == i)).withColumn("balance", F.col("balance") + F.lit(i if i < 7 else 0)), "balances", BALANCES)
    return store.read("balances")


NATIONS = {"primaryKey": {"source": "n_nationkey", "type": "INT", "column": "n_nationkey"}, "fields": [{"path": "n_name"}]}


def _inserted(spark, sf_dir):
    store, t = new_store(spark), table(spark, sf_dir, "nation")
    put(store, t, "nations", NATIONS, "INSERT")
    again = t.where("n_regionkey = 1").withColumn("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") + 100).otherwise(F.col("n_nationkey")))
    return store, put(store, again.withColumn("_id", F.col("n_nationkey")), "nations", NATIONS, "INSERT")


@query("select n_nationkey, n_name from nation union all select n_nationkey + 100, n_name from nation where n_regionkey = 1 and n_nationkey % 2 = 0")
def insert_append(spark, sf_dir):
    return _inserted(spark, sf_dir)[0].read("nations")


@query("select cast(n_nationkey as varchar) as source_id, '[23505] duplicate key value violates the primary key of table ''nations''' as error from nation where n_regionkey = 1 and n_nationkey % 2 = 1")
def insert_refused(spark, sf_dir):
    store, t = new_store(spark), table(spark, sf_dir, "nation")
    put(store, t, "nations", NATIONS, "INSERT")
    again = t.where("n_regionkey = 1").withColumn("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") + 100).otherwise(F.col("n_nationkey")))
    m = map_documents(again.withColumn("_id", F.col("n_nationkey")), compile_mapping("nations", NATIONS))
    return store.write(m, "INSERT").rejected.select("source_id", "error")


@query("select n_nationkey, n_name, cast(null as varchar) as note from nation where n_regionkey <> 1 union all select n_nationkey, n_name, 'new' from nation where n_regionkey = 1")
def schema_evolve(spark, sf_dir):
    store, t = new_store(spark), table(spark, sf_dir, "nation")
    put(store, t, "nations", NATIONS)
    put(store, t.where("n_regionkey = 1").withColumn("note", F.lit("new")), "nations", NATIONS | {"fields": [*NATIONS["fields"], {"path": "note"}]})
    return store.read("nations")


@query("select n_nationkey, n_name from nation where n_regionkey = 2")
def truncate_load(spark, sf_dir):
    store, t = new_store(spark), table(spark, sf_dir, "nation")
    put(store, t, "nations", NATIONS)
    store.truncate(compile_mapping("nations", NATIONS))
    put(store, t.where("n_regionkey = 2"), "nations", NATIONS)
    return store.read("nations")


# Runs


def _control(spark: SparkSession, sf_dir: str, key: str, collection: str, mapping: dict, **job) -> tuple[Control, int]:
    """A control plane of its own, with one job over a collection of Parquet documents."""
    control = Control(spark, Store(), new_store(spark))
    source = control.save_connection({"name": "in", "kind": "SOURCE", "db_type": "PARQUET", "uri": sf_dir if "://" in sf_dir else "file://" + os.path.abspath(sf_dir), "options": {"id": key}})["id"]
    mappings = [{"collection": collection, "target": collection, "mapping": mapping} | {k: job.pop(k) for k in ("watermarkField", "filter") if k in job}]
    return control, control.save_job({"name": "job", "source": source, "mappings": mappings} | job)["id"]


RATED = {"primaryKey": {"source": "s_suppkey", "type": "LONG"}, "fields": [{"path": "s_name", "column": "name"}, {"path": "s_acctbal", "column": "balance", "type": "DOUBLE"}]}


@query("select s_suppkey as id, s_name as name, s_acctbal as balance from supplier where s_acctbal >= 0")
def job_tables(spark, sf_dir):
    """A run in slices, with a filter."""
    control, job = _control(spark, sf_dir, "s_suppkey", "supplier", RATED, filter={"s_acctbal": {"$gte": 0}}, batchSize=25)
    control.run_now(job, wait=True)
    return control.target.read("supplier")


ORDERED = {"primaryKey": {"source": "o_orderkey", "type": "LONG"}, "fields": [{"path": "o_totalprice", "column": "price", "type": "DOUBLE"}, {"path": "o_orderstatus", "column": "status"}]}


@query("select o_orderkey as id, o_totalprice as price, o_orderstatus as status from orders")
def job_incremental(spark, sf_dir):
    """An incremental run from the beginning, and a second one that reads the last watermark's documents again."""
    control, job = _control(spark, sf_dir, "o_orderkey", "orders", ORDERED, syncMode="INCREMENTAL", watermarkField="o_orderdate", batchSize=50_000)
    control.run_now(job, wait=True)
    control.run_now(job, wait=True)
    return control.target.read("orders")


SHORT = {"primaryKey": {"source": "p_partkey", "type": "LONG"}, "fields": [{"path": "p_type", "column": "kind", "length": 5}]}


@query("select 'PARTIAL' as status, count(*) as docs_read, count(*) filter (length(p_type) <= 5) as rows_written, count(*) filter (length(p_type) > 5) as docs_failed from part")
def run_page(spark, sf_dir):
    """The newest run of a page of the history, as the control plane counts it."""
    control, job = _control(spark, sf_dir, "p_partkey", "part", SHORT, batchSize=50_000)
    control.run_now(job, wait=True)
    control.run_now(job, wait=True)
    newest = control.runs(job, 0, 1)["items"]
    return spark.createDataFrame([(r["status"], r["docs_read"], r["rows_written"], r["docs_failed"]) for r in newest], "status string, docs_read long, rows_written long, docs_failed long")


@query("select cast(p_partkey as varchar) as source_id, 'column ''kind'': value has ' || length(p_type) || ' characters, the column allows 5' as error from part where length(p_type) > 5 order by p_partkey limit 20 offset 20")
def page(spark, sf_dir):
    """The second page of a run's rejected documents, in the order they were read."""
    control, job = _control(spark, sf_dir, "p_partkey", "part", SHORT, batchSize=50_000)
    run = control.run_now(job, wait=True)
    items = control.dead_letters(run["id"], 1, 20)["items"]
    return spark.createDataFrame([(x["source_id"], x["error"]) for x in items], "source_id string, error string")


@query("select 2 as run, (select count(*) from region) as docs_read")
def latest_run(spark, sf_dir):
    """The latest of a job's runs, as the job shows it."""
    control, job = _control(spark, sf_dir, "r_regionkey", "region", {"primaryKey": {"source": "r_regionkey", "type": "INT"}})
    for _ in range(2):
        control.run_now(job, wait=True)
    last = control.job(job)["lastRun"]
    return spark.createDataFrame([(last["id"], last["docs_read"])], "run int, docs_read long")


@query("select c_custkey, c_name from customer order by c_custkey limit 50")
def ordered_scan(spark, sf_dir):
    """The first documents in the source's order, which is the feature."""
    return ParquetSource(spark, sf_dir, {"id": "c_custkey"}).read(ReadRequest.full("customer"), ordered=True).limit(50).select("c_custkey", "c_name")


# Inference


@query("select key, kinds, longest from (select 'lang' as key, 'STRING' as kinds, max(length(lang)) as longest from documents union all select 'text', 'STRING', max(length(text)) from documents union all select 'source', 'STRING', max(length(source)) from documents union all select 'doc_id', 'INT', 0 union all select 'n_chars', 'INT', 0)")
def infer_lengths(spark, sf_dir):
    return statistics(table(spark, sf_dir, "documents")).select("key", F.array_join("kinds", ",").alias("kinds"), F.col("longest").cast("long").alias("longest"))


def _mixed(spark, sf_dir) -> DataFrame:
    """Documents as JSON text whose members change their kinds from one to the next."""
    i = F.col("event_id").cast("string")
    number = F.when(F.col("event_id") % 3 == 0, i).when(F.col("event_id") % 3 == 1, F.concat(i, F.lit(".5"))).otherwise(F.concat(F.lit('{"$numberLong":"'), i, F.lit('"}')))
    other = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).otherwise("true")
    parts = [F.lit('{"_id":'), i, F.lit(',"n":'), number, F.lit(',"o":'), other, F.lit(',"at":{"$date":"2024-01-01T00:00:00Z"},"in":{"a":1,"b":null},"list":[{"q":"'), F.col("event_type"), F.lit('"},{"q":7}],"none":null}')]
    return table(spark, sf_dir, "events").select(F.concat(*parts).alias("doc"))


@query("select * from (values ('_id', 'own', '', 'INT'), ('n', 'own', '', 'DOUBLE,INT,LONG'), ('o', 'own', '', 'BOOLEAN,STRING'), ('at', 'own', '', 'TIMESTAMP'), ('in', 'own', '', 'OBJECT'), ('in', 'member', 'a', 'INT'), ('in', 'member', 'b', ''), ('list', 'own', '', 'ARRAY'), ('list', 'element', '', 'OBJECT'), ('list', 'inner', 'q', 'INT,STRING'), ('none', 'own', '', '')) t(key, role, member, kinds)")
def infer_kinds(spark, sf_dir):
    return statistics(_mixed(spark, sf_dir), "doc").select("key", "role", "member", F.array_join("kinds", ",").alias("kinds"))


@query("select 'o' as key, cast(max(length(event_type)) as bigint) as longest from events where event_id % 2 = 0 union all select 'list', cast(max(length(event_type)) as bigint) from events")
def infer_stats(spark, sf_dir):
    found = statistics(_mixed(spark, sf_dir), "doc").where("longest > 0")
    return found.select("key", F.col("longest").cast("long").alias("longest"))


@query("select * from (values ('n_name', 'n_name', 'STRING', 'FLATTEN'), ('n_nationkey', 'n_nationkey', 'INT', 'FLATTEN'), ('n_regionkey', 'n_regionkey', 'INT', 'FLATTEN'), ('seat.r_name', 'seat_r_name', 'STRING', 'FLATTEN'), ('tags', 'nations_tags', 'INT', 'CHILD_TABLE'), ('changed_at', 'changed_at', 'TIMESTAMP', 'FLATTEN'), ('(watermark)', 'changed_at', null, null)) t(path, name, type, strategy)")
def infer_mapping(spark, sf_dir):
    """The proposal for nested documents of nations, as rows."""
    region = table(spark, sf_dir, "region").select("r_regionkey", F.struct("r_name").alias("seat"))
    df = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).drop("r_regionkey").withColumn("tags", F.array("n_regionkey")).withColumn("changed_at", F.lit(datetime(2024, 1, 1)))
    got = infer_from(df, "nations")
    rows = [(f.path, f.childTable or f.column, f.type or "STRING", f.strategy or "FLATTEN") for f in got.mapping.fields] + [("(watermark)", got.watermark_field, None, None)]
    return spark.createDataFrame(rows, "path string, name string, type string, strategy string")


# Kinds of values and faults


@query("select event_id as id, '{\"k\":' || json_extract_string(props, '$.k') || '}' as props from events")
def json_strategy(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), F.try_parse_json("props").alias("props"))
    return mapped(df, "events", [{"path": "props", "strategy": "JSON"}]).parent


@query("select event_id as id, hex(encode(event_type)) as typed, hex(encode(event_type)) as tagged from events")
def binary_values(spark, sf_dir):
    """Bytes of a typed column, and of a tagged value in a schemaless document."""
    df = table(spark, sf_dir, "events")
    typed = mapped(df.select(F.col("event_id").alias("_id"), F.col("event_type").cast("binary").alias("b")), "blobs", [{"path": "b", "type": "BINARY"}]).parent
    text = F.concat(F.lit('{"_id":'), F.col("event_id").cast("string"), F.lit(',"b":{"$binary":{"base64":"'), F.base64(F.col("event_type").cast("binary")), F.lit('","subType":"00"}}}'))
    tagged = mapped(df.select(F.parse_json(text).alias("doc")), "blobs", [{"path": "b", "type": "BINARY"}], doc="doc").parent
    return typed.select("id", F.hex("b").alias("typed")).join(tagged.select("id", F.hex("b").alias("tagged")), "id")


@query("select cast(event_id as varchar) as source_id, 'expected an array at ''box.list'' for child table ''c'', found int' as error from events where event_id % 4 = 1")
def non_array(spark, sf_dir):
    """A scalar where a child table's array should be; null, an empty and a missing array are fine."""
    i = F.col("event_id").cast("string")
    box = F.when(F.col("event_id") % 4 == 0, '{"list":null}').when(F.col("event_id") % 4 == 1, '{"list":7}').when(F.col("event_id") % 4 == 2, '{"list":[]}').otherwise("{}")
    df = table(spark, sf_dir, "events").select(F.parse_json(F.concat(F.lit('{"_id":'), i, F.lit(',"box":'), box, F.lit("}"))).alias("doc"))
    return mapped(df, "t", [{"path": "box.list", "strategy": "CHILD_TABLE", "childTable": "c"}], doc="doc").rejected.select("source_id", "error")


@query("select event_id as parent_id, i as ordinal, case when i = 0 then event_type end as kind from events, (values (0), (1), (2)) t(i) where event_id % 2 = 0")
def array_elements(spark, sf_dir):
    """An array inside an object, whose elements are an object, a scalar and null."""
    i = F.col("event_id").cast("string")
    lists = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('[{"kind":"'), F.col("event_type"), F.lit('"},5,null]'))).otherwise("[]")
    df = table(spark, sf_dir, "events").select(F.parse_json(F.concat(F.lit('{"_id":'), i, F.lit(',"a":{"b":'), lists, F.lit("}}"))).alias("doc"))
    return mapped(df, "t", [{"path": "a.b", "strategy": "CHILD_TABLE", "childTable": "c", "fields": [{"path": "kind"}]}], doc="doc").child(0)


@query("select cast(event_id as varchar) as source_id, 'document has no value at primary key path ''code.main''' as error from events where event_id % 3 = 0")
def missing_key(spark, sf_dir):
    code = F.struct(F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("main"))
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), code.alias("code"))
    return mapped(df, "t", [], {"type": "LONG", "source": "code.main"}).rejected.select("source_id", "error")


@query("select count(*) as docs_read, count(*) filter (event_id % 5 <> 1) as rows_written, count(*) filter (event_id % 5 = 1) as docs_failed from events")
def run_counters(spark, sf_dir):
    m = mapped(_raw_numbers(spark, sf_dir), "numbers", [{"path": "raw", "column": "n", "type": "INT"}]).frame
    return m.agg(F.count(F.lit(1)).alias("docs_read"), F.count_if(F.col("__error").isNull()).alias("rows_written"), F.count_if(F.col("__error").isNotNull()).alias("docs_failed"))


@query()
def sample(spark, sf_dir):
    """A seeded random sample has no oracle."""
    return ParquetSource(spark, sf_dir, {"id": "event_id"}).sample("events", 200, seed=1)
