import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabulon.operators.mapping import map_documents
from tabulon.plans.spec import compile_mapping

OID = "5f43a1b2c3d4e5f607182930"
LOANS = {"primaryKey": {"source": "card", "column": "card"}, "fields": [
    {"path": "title", "length": 12}, {"path": "fee", "type": "DECIMAL"}, {"path": "reader.name.last"}, {"path": "renewed", "type": "BOOLEAN"}, {"path": "due", "type": "TIMESTAMP"}, {"path": "stops.1.desk", "column": "second_desk"}, {"path": "extra", "strategy": "JSON"},
    {"path": "stops", "strategy": "CHILD_TABLE", "childTable": "loan_stops", "fields": [{"path": "desk"}, {"path": "minutes", "type": "INT"}, {"path": "by", "strategy": "JSON"}]},
    {"path": "marks.colours", "strategy": "CHILD_TABLE", "childTable": "loan_colours", "length": 5}], "unmappedFields": "JSON_OVERFLOW_COLUMN"}


def variants(spark, docs):
    return spark.createDataFrame([(json.dumps(d) if not isinstance(d, str) else d,) for d in docs], "j string").select(F.parse_json("j").alias("doc"))


def mapped(spark, docs):
    m = map_documents(variants(spark, docs), compile_mapping("loans", LOANS), "doc").cache()
    return m, {r.card: r for r in m.parent.collect()}, [[tuple(x) for x in c.orderBy("parent_id", "ordinal").collect()] for c in m.children]


def test_a_document_fills_all_tables(spark):
    whole = {"_id": {"$oid": OID}, "card": {"$numberLong": "77"}, "title": "Middlemarch", "fee": "0.40", "reader": {"name": {"last": "Okafor", "first": "Ada"}}, "renewed": "N", "due": {"$date": {"$numberLong": "86400500"}},
             "stops": [{"desk": "A", "minutes": 3.0, "by": {"$oid": OID}}, {"desk": "B", "by": [1, None]}, None, "lost"], "marks": {"colours": ["red", None, 4.50, {"$date": "1970-01-02T00:00:00Z"}][:3]}, "extra": {"b": [{"$numberDecimal": "1.0"}], "a": "\u00e9"}, "shelf": {"row": 9}, "void": None}
    m, rows, (stops, colours) = mapped(spark, [whole, {"card": "bare"}])
    r = rows["77"]
    assert (r.title, r.fee, r.reader_name_last, r.renewed, r.due, r.second_desk) == ("Middlemarch", Decimal("0.40"), "Okafor", False, datetime(1970, 1, 2, 0, 0, 0, 500000), "B")
    assert json.loads(r.extra) == {"a": "é", "b": [1.0]} and json.loads(r["_extra"])["shelf"] == {"row": 9}
    assert stops == [("77", 0, "A", 3, f'"{OID}"'), ("77", 1, "B", None, "[1,null]"), ("77", 2, None, None, None), ("77", 3, None, None, None)]
    assert colours == [("77", 0, "red"), ("77", 1, None), ("77", 2, "4.5")]
    assert set(rows) == {"77", "bare"} and all(v is None for k, v in rows["bare"].asDict().items() if k != "card") and m.rejected.count() == 0
    m.unpersist()


@pytest.mark.parametrize("doc, error", [
    ({"_id": 1}, "primary key path 'card'"), ({"card": None}, "primary key path 'card'"), ({"fee": "free"}, "column 'fee'"), ({"title": "thirteen char"}, "13 characters, the column allows 12"), ({"stops": {"desk": "A"}}, "expected an array at 'stops'"), ({"marks": {"colours": "red"}}, "expected an array at 'marks.colours'"),
    ({"stops": [{"minutes": 1}, {"minutes": "soon"}]}, "column 'minutes'"), ({"marks": {"colours": ["violet"]}}, "6 characters, the column allows 5"), ({"extra": {"x": "a\u0000b"}}, "column 'extra'"), ({"fee": "x", "due": "y"}, "column 'fee'"), ({"due": "y", "stops": 1}, "column 'due'"),
])
def test_the_first_fault_rejects_the_document(spark, doc, error):
    docs = [{"card": 5} | doc if "_id" not in doc and "card" not in doc else doc, {"card": 6}]
    m, rows, _ = mapped(spark, docs)
    (bad,) = m.rejected.collect()
    assert set(rows) == {"6"} and error in bad.error and json.loads(bad.payload) == json.loads(json.dumps(docs[0])) and bad.source_id == {"5": "5"}.get(str(docs[0].get("card")), str(docs[0].get("_id")) if "_id" in doc else None)
    m.unpersist()


def test_missing_and_null_arrays_have_no_rows(spark):
    _, rows, (stops, colours) = mapped(spark, [{"card": 1, "stops": None, "marks": None}, {"card": 2, "stops": [], "marks": {}}, {"card": 3, "marks": {"colours": [[1, 2], True]}}])
    assert set(rows) == {"1", "2", "3"} and stops == [] and colours == [("3", 0, "[1,2]"), ("3", 1, "true")]


NO = object()
CASES = [
    ("INT", 42, 42), ("INT", "42", 42), ("INT", " 42.0 ", 42), ("INT", "1e3", 1000), ("INT", 3.0, 3), ("INT", 2.5, NO), ("INT", 3_000_000_000, NO), ("INT", "x", NO), ("INT", True, NO), ("INT", "2.00000000000000000001", NO),
    ("INT", {"$numberDouble": "NaN"}, NO), ("LONG", {"$numberDecimal": "7"}, 7), ("LONG", "9223372036854775807", 2**63 - 1), ("LONG", "9223372036854775808", NO), ("INT", None, None), ("INT", {"$undefined": True}, None),
    ("DECIMAL", "1e3", Decimal(1000)), ("DECIMAL", "0.12345678901", NO), ("DECIMAL", False, NO), ("DECIMAL", {"$numberDecimal": "12.50"}, Decimal("12.5")), ("DECIMAL", {"$numberDecimal": "NaN"}, NO),
    ("DOUBLE", {"$numberDouble": "Infinity"}, float("inf")), ("DOUBLE", "NaN", NO), ("DOUBLE", 1.5, 1.5), ("DOUBLE", "2", 2.0), ("DOUBLE", 1e-40, 1e-40),
    ("BOOLEAN", " Yes", True), ("BOOLEAN", "n", False), ("BOOLEAN", 1, True), ("BOOLEAN", 0.0, False), ("BOOLEAN", 2, NO), ("BOOLEAN", "t", NO),
    ("TIMESTAMP", "2026-03-02", datetime(2026, 3, 2)), ("TIMESTAMP", "2026-03-02T09:15:00+05:30", datetime(2026, 3, 2, 3, 45)), ("TIMESTAMP", "2026-03-02T09:15", datetime(2026, 3, 2, 9, 15)), ("TIMESTAMP", 0, datetime(1970, 1, 1)),
    ("TIMESTAMP", {"$date": {"$numberLong": "1500"}}, datetime(1970, 1, 1, 0, 0, 1, 500000)), ("TIMESTAMP", 1.5, NO), ("TIMESTAMP", "2026", NO), ("TIMESTAMP", "2026-03-02 09:15:00", NO), ("TIMESTAMP", "2026-13-02", NO), ("TIMESTAMP", {"$timestamp": {"t": 60, "i": 1}}, datetime(1970, 1, 1, 0, 1)),
    ("BINARY", {"$binary": {"base64": "AQI=", "subType": "00"}}, b"\x01\x02"), ("BINARY", "AQI=", NO), ("BINARY", {"$uuid": "00112233-4455-6677-8899-aabbccddeeff"}, bytes.fromhex("00112233445566778899aabbccddeeff")),
    ("STRING", 12.5, "12.5"), ("STRING", 1e10, "10000000000"), ("STRING", 100.0, "100"), ("STRING", True, "true"), ("STRING", [1, "a"], '[1,"a"]'), ("STRING", {"$oid": OID}, OID), ("STRING", "é" * 255, "é" * 255), ("STRING", "x" * 256, NO), ("TEXT", "x" * 256, "x" * 256),
    ("STRING", {"$numberDecimal": "12.50"}, "12.50"), ("STRING", {"$date": "2026-03-02T09:15:00Z"}, "2026-03-02T09:15:00Z"), ("STRING", {"$regularExpression": {"pattern": "a", "options": "i"}}, "/a/i"), ("STRING", {"$minKey": 1}, "MinKey"),
    ("JSON", {"a": {"$numberInt": "1"}, "b": None}, '{"a":1,"b":null}'), ("JSON", "q\"t", '"q\\"t"'), ("JSON", 5, "5"), ("JSON", None, None),
]


@pytest.mark.parametrize("kind", sorted({c[0] for c in CASES}))
def test_coercion_matrix(spark, kind):
    cases = [c[1:] for c in CASES if c[0] == kind]
    df = variants(spark, [{"_id": i, "v": v} for i, (v, _) in enumerate(cases)])
    m = map_documents(df, compile_mapping("t", {"primaryKey": {"type": "INT"}, "fields": [{"path": "v", "type": kind}]}), "doc")
    rows = {r.id: r.v for r in m.parent.collect()}
    errors = {int(r.source_id): r.error for r in m.rejected.collect()}
    for i, (v, want) in enumerate(cases):
        if want is NO:
            assert i in errors and "column 'v'" in errors[i], v
        else:
            assert i in rows, (v, errors.get(i))
            got = bytes(rows[i]) if isinstance(rows[i], bytearray) else rows[i]
            assert got == want, v


def test_typed_documents(spark):
    df = spark.sql("select 7L as _id, named_struct('b', 2.50D, 'c', timestamp_ntz'2026-03-02 09:15:00.5') as a, array(named_struct('x', 1), null) as items, map('k', 5) as m, cast('1.20' as decimal(5, 2)) as d, binary('ab') as bin, 'z' as extra")
    p = compile_mapping("t", {"primaryKey": {"type": "INT"}, "fields": [{"path": "a.b"}, {"path": "a.c", "type": "TIMESTAMP"}, {"path": "m.k", "type": "LONG"}, {"path": "d", "type": "STRING"}, {"path": "nope.x"}, {"path": "bin", "type": "BINARY"},
                                      {"path": "items", "strategy": "CHILD_TABLE", "childTable": "c", "fields": [{"path": "x", "type": "INT"}]}], "unmappedFields": "JSON_OVERFLOW_COLUMN"})
    m = map_documents(df, p)
    r = m.parent.first()
    assert (r.id, r.a_b, r.a_c, r.m_k, r.d, r.nope_x, bytes(r.bin)) == (7, "2.5", datetime(2026, 3, 2, 9, 15, 0, 500000), 5, "1.20", None, b"ab") and json.loads(r["_extra"]) == {"extra": "z"}
    assert [tuple(x) for x in m.child(0).collect()] == [(7, 0, 1), (7, 1, None)]
    assert map_documents(df.limit(0), p).parent.count() == 0


def test_numeric_segments_are_keys_or_places(spark):
    p = compile_mapping("t", {"primaryKey": {"type": "INT"}, "fields": [{"path": "a.0", "column": "x", "type": "INT"}, {"path": "Order Total", "column": "y", "type": "INT"}]})
    rows = map_documents(variants(spark, [{"_id": 1, "a": {"0": 5}}, {"_id": 2, "a": [6]}, {"_id": 3, "a": [], "Order Total": 9}]), p, "doc").parent.orderBy("id").collect()
    assert [(r.x, r.y) for r in rows] == [(5, None), (6, None), (None, 9)]
