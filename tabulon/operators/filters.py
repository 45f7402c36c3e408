"""Document filters: a JSON query object as one Catalyst predicate.

Comparisons stay within a kind (numbers, texts, booleans, times), as document
stores do: a filter on numbers passes over texts. A condition on an array
holds if it holds for the array or for one of its elements. On typed columns
the plain comparisons reach the scan; on variants they are evaluated after it.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import InvalidRequest
from tabulon.functions.values import NUMBERS, Value, _kind, root, static_kind

#: Names of kinds in ``$type``.
TYPE_NAMES = {"double": ("double",), "string": ("str", "oid"), "object": ("object",), "array": ("array",), "binData": ("binary",), "objectId": ("oid",), "bool": ("bool",), "date": ("date",), "int": ("int",), "long": ("long",), "decimal": ("decimal",), "number": NUMBERS}


def parse_filter(text: str | dict | None) -> dict:
    """The query object; blank text matches everything, anything but an object is refused."""
    if text is None or isinstance(text, str) and not text.strip():
        return {}
    try:
        query = json.loads(text) if isinstance(text, str) else text
    except ValueError as e:
        raise InvalidRequest(f"The filter is not valid JSON: {e}") from e
    if not isinstance(query, dict):
        raise InvalidRequest("The filter must be a JSON object")
    return query


def literal(x):
    """A query's value without its Extended JSON tag."""
    if isinstance(x, dict) and len(x) == 1:
        (tag, v), = x.items()
        if tag in ("$oid", "$uuid", "$symbol"):
            return v
        if tag in ("$numberInt", "$numberLong"):
            return int(v)
        if tag in ("$numberDouble", "$numberDecimal"):
            return float(v)
        if tag == "$date":
            if isinstance(v, dict):
                v = int(v["$numberLong"])
            return datetime.fromtimestamp(v / 1000).astimezone() if isinstance(v, int) else datetime.fromisoformat(v.replace("Z", "+00:00"))
    return x


def _as(v: Column, t: T.DataType | None, want) -> Column | None:
    """The value as the kind of ``want``, null if it is of another kind; None if it never can be."""
    bool_, num, time = isinstance(want, bool), isinstance(want, (int, float)), isinstance(want, datetime)
    if t is not None:
        kind = static_kind(t)
        ok = kind == "bool" if bool_ else kind in NUMBERS if num else kind == "date" if time else kind == "str"
        if not ok:
            return None
        return v.cast("timestamp") if time and isinstance(t, T.DateType) else v
    kind = _kind(v)
    get = lambda path, to: F.try_variant_get(v, path, to)
    if bool_:
        return F.when(kind == "bool", get("$", "boolean"))
    if num:
        tags = [get(f"$.{x}", "string").try_cast("double") for x in ("$numberInt", "$numberLong", "$numberDouble", "$numberDecimal")]
        return F.when(kind.isin(*NUMBERS), F.coalesce(*tags, get("$", "double")))
    if time:
        millis = F.timestamp_millis(F.coalesce(get("$.$date.$numberLong", "string").try_cast("bigint"), get("$.$date", "bigint")))
        return F.when(kind == "date", F.coalesce(millis, get("$.$date", "string").try_cast("timestamp")))
    return F.when(kind.isin("str", "oid", "uuid"), F.coalesce(get("$.$oid", "string"), get("$.$uuid", "string"), get("$", "string")))


def _literal(want, t: T.DataType | None) -> Column:
    if isinstance(want, datetime) and isinstance(t, T.TimestampNTZType):
        from datetime import timezone

        return F.lit(want.astimezone(timezone.utc).replace(tzinfo=None))
    return F.lit(want)


def _compare(op: str, v: Column, t: T.DataType | None, want) -> Column:
    """A scalar comparison, false for other kinds; equality with null holds for null and missing."""
    if want is None:
        null = v.isNull() if t is not None else _kind(v).isNull()
        return null if op in ("$eq", "$gte", "$lte") else F.lit(False)
    if isinstance(want, (dict, list)):
        if op != "$eq":
            raise InvalidRequest(f"{op} on objects and arrays is not supported")
        same = F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(want))))
        return F.coalesce(same, F.lit(False)) if t is None or isinstance(t, (T.StructType, T.ArrayType, T.MapType)) else F.lit(False)
    own = _as(v, t, want)
    if own is None:
        return F.lit(False)
    w = _literal(want, t)
    out = {"$eq": own == w, "$gt": own > w, "$gte": own >= w, "$lt": own < w, "$lte": own <= w}[op]
    return out if t is not None and not isinstance(t, T.ArrayType) else F.coalesce(out, F.lit(False))


def _any(v: Value, test) -> Column:
    """``test`` on the value, or on an element if it is an array."""
    if not v.dynamic:
        if isinstance(v.type, T.ArrayType):
            e = v.type.elementType
            return F.coalesce(F.exists(v.col, lambda x: F.coalesce(test(x, None if isinstance(e, T.VariantType) else e), F.lit(False))), F.lit(False)) | F.coalesce(test(v.col, v.type), F.lit(False))
        return test(v.col, v.type)
    array = F.try_variant_get(v.col, "$", "array<variant>")
    return test(v.col, None) | F.coalesce(F.exists(array, lambda x: test(x, None)), F.lit(False))


def _size(v: Value) -> Column:
    if v.dynamic:
        return F.size(F.try_variant_get(v.col, "$", "array<variant>"))
    return F.size(v.col) if isinstance(v.type, T.ArrayType) else F.lit(-1)


def _not(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def _condition(v: Value, cond) -> Column:
    """A field's condition: a value to equal, or operators that must all hold."""
    if not isinstance(cond, dict) or not cond or not next(iter(cond)).startswith("$") or literal(cond) is not cond:
        want = literal(cond)
        return _any(v, lambda x, t: _compare("$eq", x, t, want))
    out = F.lit(True)
    for op, raw in cond.items():
        want = [literal(x) for x in raw] if isinstance(raw, list) else literal(raw)
        if op in ("$eq", "$gt", "$gte", "$lt", "$lte"):
            one = _any(v, lambda x, t, op=None, o=op, w=want: _compare(o, x, t, w))
        elif op == "$ne":
            one = _not(_any(v, lambda x, t, w=want: _compare("$eq", x, t, w)))
        elif op in ("$in", "$nin"):
            if not isinstance(want, list):
                raise InvalidRequest(f"{op} needs a list")
            one = F.lit(False)
            for w in want:
                one = one | F.coalesce(_any(v, lambda x, t, w=w: _compare("$eq", x, t, w)), F.lit(False))
            one = one if op == "$in" else ~one
        elif op == "$exists":
            one = v.col.isNotNull() if want else v.col.isNull()
        elif op == "$type":
            names = [k for n in (want if isinstance(want, list) else [want]) for k in TYPE_NAMES.get(n, ())]
            if not names:
                raise InvalidRequest(f"Unknown $type {want!r}")
            one = _any(v, lambda x, t, n=names: F.coalesce(_kind(x).isin(*n), F.lit(False)) if t is None else F.lit(static_kind(t) in n) & x.isNotNull())
        elif op == "$regex":
            flags = "".join(f for f in cond.get("$options", "") if f in "imsx")
            one = _any(v, lambda x, t, p=(f"(?{flags})" if flags else "") + want: F.lit(False) if _as(x, t, "") is None else F.coalesce(_as(x, t, "").rlike(p), F.lit(False)))
        elif op == "$options":
            continue
        elif op == "$size":
            one = F.coalesce(_size(v) == want, F.lit(False))
        elif op == "$all":
            one = F.lit(True)
            for w in want:
                one = one & F.coalesce(_any(v, lambda x, t, w=w: _compare("$eq", x, t, w)), F.lit(False))
        elif op == "$elemMatch":
            array, e = (F.try_variant_get(v.col, "$", "array<variant>"), None) if v.dynamic else (v.col, v.type.elementType) if isinstance(v.type, T.ArrayType) else (None, None)
            scalar = next(iter(raw), "").startswith("$") and next(iter(raw)) not in ("$and", "$or", "$nor")
            test = _condition if scalar else match
            one = F.lit(False) if array is None else F.coalesce(F.exists(array, _element_test(test, e, raw)), F.lit(False))
        elif op == "$mod":
            one = _any(v, lambda x, t, w=want: F.lit(False) if _as(x, t, 1) is None else F.coalesce(F.floor(_as(x, t, 1)) % w[0] == w[1], F.lit(False)))
        elif op == "$not":
            one = _not(_condition(v, raw))
        else:
            raise InvalidRequest(f"Unknown filter operator {op}")
        out = out & one
    return out


def _element_test(test, kind: T.DataType | None, query):
    return lambda x: F.coalesce(test(Value(x, kind), query), F.lit(False))


def match(doc: Value, query: dict) -> Column:
    """The predicate of a query object on a document."""
    out = None
    for name, cond in query.items():
        if name in ("$and", "$or", "$nor"):
            if not isinstance(cond, list) or not cond:
                raise InvalidRequest(f"{name} needs a list of conditions")
            parts = [match(doc, q) for q in cond]
            one = parts[0]
            for p in parts[1:]:
                one = one & p if name == "$and" else F.coalesce(one, F.lit(False)) | F.coalesce(p, F.lit(False))
            one = _not(one) if name == "$nor" else one
        elif name.startswith("$"):
            raise InvalidRequest(f"Unknown filter operator {name}")
        else:
            one = _condition(doc.at(tuple(name.split("."))), cond)
        out = one if out is None else out & one
    return F.lit(True) if out is None else out


def filter_documents(df: DataFrame, query: str | dict | None, doc: str | None = None) -> DataFrame:
    """The rows whose document matches; an empty query passes everything."""
    q = parse_filter(query)
    if not q:
        return df
    if doc is None:
        # Whole rows: name the columns themselves, so that comparisons can reach the scan.
        class _Rows(Value):
            def _get(self, seg):
                return Value(F.col(f"`{seg}`"), None if isinstance(df.schema[seg].dataType, T.VariantType) else df.schema[seg].dataType) if seg in df.columns else Value(F.lit(None).cast("string"), T.NullType())

        return df.where(match(_Rows(F.lit(None), df.schema), q))
    return df.where(match(root(df, doc), q))
