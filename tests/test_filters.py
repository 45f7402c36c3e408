import json

import pytest
from pyspark.sql import functions as F

from tabulon.errors import InvalidRequest
from tabulon.operators.filters import filter_documents, parse_filter

DOCS = [{"_id": 1, "a": 5, "t": ["x", "y"], "s": "abc", "o": [{"q": 1, "w": 9}, {"q": 2, "w": 1}]}, {"_id": 2, "a": "5", "t": [], "s": None}, {"_id": 3, "a": {"$numberDecimal": "7.5"}, "t": "x", "d": {"$date": "2026-01-02T00:00:00Z"}}, {"_id": 4, "a": [1, 6], "b": True}]


@pytest.mark.parametrize("query, want", [
    ({}, [1, 2, 3, 4]), ({"a": 5}, [1]), ({"a": {"$gt": 5}}, [3, 4]), ({"a": "5"}, [2]), ({"t": "x"}, [1, 3]), ({"s": None}, [2, 3, 4]), ({"s": {"$exists": True}}, [1, 2]), ({"a": {"$type": "string"}}, [2]), ({"a": {"$in": [5, "5"]}}, [1, 2]),
    ({"a": {"$nin": [5, "5"]}}, [3, 4]), ({"t": {"$size": 2}}, [1]), ({"t": {"$all": ["x", "y"]}}, [1]), ({"o": {"$elemMatch": {"q": 1, "w": {"$gt": 5}}}}, [1]), ({"a": {"$elemMatch": {"$gt": 5}}}, [4]), ({"$or": [{"a": 5}, {"b": True}]}, [1, 4]), ({"$nor": [{"a": 5}, {"b": True}]}, [2, 3]),
    ({"a": {"$not": {"$gt": 5}}}, [1, 2]), ({"s": {"$regex": "^A", "$options": "i"}}, [1]), ({"a": {"$mod": [5, 0]}}, [1]), ({"d": {"$gte": {"$date": "2026-01-02T00:00:00Z"}}}, [3]), ({"a": {"$ne": 5}}, [2, 3, 4]), ({"$and": [{"a": {"$gte": 1}}, {"_id": {"$lt": 2}}]}, [1]),
])
def test_variant_filters(spark, query, want):
    df = spark.createDataFrame([(json.dumps(d),) for d in DOCS], "j string").select(F.parse_json("j").alias("doc"))
    got = filter_documents(df, json.dumps(query), "doc").select(F.try_variant_get("doc", "$._id", "int").alias("i")).collect()
    assert sorted(r.i for r in got) == want


def test_typed_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id % 3 as string) as k", "array(id, id + 1) as t").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = filter_documents(df, {"id": {"$gte": 10, "$lt": 20}, "k": "1"})
    assert out.count() == 4 and filter_documents(df, {"t": 7}).count() == 2 and filter_documents(df, {"id": "7"}).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,10)" in plan and "EqualTo(k,1)" in plan


@pytest.mark.parametrize("text", ["[1]", "{bad", "5"])
def test_filters_must_be_objects(text):
    with pytest.raises(InvalidRequest):
        parse_filter(text)


def test_unknown_operator(spark):
    with pytest.raises(InvalidRequest):
        filter_documents(spark.range(1), {"id": {"$near": 1}})
