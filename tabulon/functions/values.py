"""Values of a document and their paths, as Catalyst expressions.

A document is either typed columns, whose kinds are known when the plan is
made, or one VARIANT parsed from JSON, whose kinds are found row by row. In the latter
Extended JSON tags (``$oid``, ``$date``, ``$numberDecimal``, ...) keep the
distinctions that plain JSON loses. Either way no Python runs on rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds that hold numbers, and the tag of each tagged kind.
NUMBERS = ("int", "long", "double", "decimal")
TAGS = {"$oid": "oid", "$date": "date", "$numberInt": "int", "$numberLong": "long", "$numberDouble": "double", "$numberDecimal": "decimal", "$binary": "binary", "$uuid": "uuid", "$undefined": None, "$timestamp": "timestamp", "$symbol": "str", "$code": "str", "$regularExpression": "regex", "$minKey": "str", "$maxKey": "str"}


def _step(key: str) -> str:
    return '["' + key + '"]' if '"' not in key else "['" + key + "']"


def _sql(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


@dataclass
class Value:
    """A value at a path. ``type`` is its Spark type, or None for a variant.

    ``settle`` takes a value apart in steps, each a projection of its own
    (or a step over array elements): an expression that needs the kind or the text many
    times then refers to it instead of repeating how it is found.
    """

    col: Column
    type: T.DataType | None = None
    steps: tuple[str, ...] = ()
    parts: dict[str, Column] | None = None

    @property
    def dynamic(self) -> bool:
        return self.type is None

    def at(self, path: tuple[str, ...]) -> Value:
        """Follow a path: members by name, list elements by number; what is missing is null."""
        here = self
        for seg in path:
            here = here._get(seg)
        return here._looked_up()

    def _get(self, seg: str) -> Value:
        if self.dynamic:
            return Value(self.col, None, (*self.steps, seg))
        t = self.type
        if isinstance(t, T.StructType) and seg in t.names:
            kind = t[seg].dataType
            return Value(self.col.getField(seg), None if isinstance(kind, T.VariantType) else kind)
        if isinstance(t, T.ArrayType) and seg.isdigit() and len(seg) <= 9:
            return Value(F.get(self.col, F.lit(int(seg))), None if isinstance(t.elementType, T.VariantType) else t.elementType)
        if isinstance(t, T.MapType) and isinstance(t.keyType, T.StringType):
            return Value(F.try_element_at(self.col, F.lit(seg)), None if isinstance(t.valueType, T.VariantType) else t.valueType)
        return nothing()

    def _looked_up(self) -> Value:
        """A variant's pending steps made one look-up; a number is a key of an object or a place in a list."""
        if not self.dynamic or not self.steps:
            return self
        paths = ["$"]
        for s in self.steps:
            paths = [p + x for p in paths for x in ([_step(s), f"[{int(s)}]"] if s.isdigit() and len(s) <= 9 else [_step(s)])]
        return Value(F.coalesce(*[F.try_variant_get(self.col, p, "variant") for p in paths]))

    @property
    def kind(self) -> str | Column | None:
        """The kind, as a name where it is known; None or SQL NULL for null and undefined."""
        return self.parts["kind"] if self.dynamic else static_kind(self.type)

    @property
    def is_null(self) -> Column:
        return self.kind.isNull() if self.dynamic else self.col.isNull()

    @property
    def raw(self) -> Column:
        """The text as written, without tags."""
        return self.parts["raw"]

    @property
    def text(self) -> Column:
        """The text of a scalar: plain numbers, ISO dates; of an object or array its JSON."""
        return self.parts["text"]

    @property
    def json(self) -> Column:
        """Plain JSON text, tags resolved; null for null."""
        return self.parts["json"]

    def elements(self) -> tuple[Column, T.DataType | None]:
        """The array and the type of its elements (None for variants)."""
        if self.dynamic:
            return F.try_variant_get(self.col, "$", "array<variant>"), None
        t = self.type.elementType
        return self.col, None if isinstance(t, T.VariantType) else t


def nothing() -> Value:
    """A value that is never there."""
    return Value(F.lit(None).cast("string"), T.NullType())


#: The steps of taking a value apart, and the parts that each adds.
STEPS = (("v",), ("kind",), ("raw",), ("text", "json"))


def step(i: int, v: Value, s: dict[str, Column] | None) -> dict[str, Column]:
    """The parts that step ``i`` adds to those of the steps before: the value, its kind, its raw text, then text and JSON."""
    if i == 0:
        return {"v": v.col}
    if i == 1:
        return {"kind": _kind(s["v"]) if v.dynamic else F.lit(static_kind(v.type)).cast("string")}
    if i == 2:
        return {"raw": _raw(s["v"], s["kind"]) if v.dynamic else static_text(s["v"], v.type)}
    if not v.dynamic:
        return {"text": s["raw"], "json": static_json(v.type, s["raw"])}
    json = F.when(s["kind"].isNotNull(), plain_json(F.to_json(s["v"])))
    number = F.when(s["raw"].rlike(r"^[+-]?[0-9.]+([eE][+-]?[0-9]+)?$"), plain_double(s["raw"].try_cast("double"))).otherwise(s["raw"])
    return {"text": F.when(s["kind"].isin("object", "array"), json).when(s["kind"] == "double", number).otherwise(s["raw"]), "json": json}


def settled(v: Value, s: dict[str, Column]) -> Value:
    """The value whose parts are ``s``."""
    return Value(s["v"], v.type, (), s)


def _kind(v: Column) -> Column:
    """The kind of a variant, from its schema."""
    s = F.regexp_extract(F.schema_of_variant(v), "^(OBJECT<`[$][A-Za-z]+`:|[A-Z_]+)", 1)
    number = F.try_variant_get(v, "$", "bigint")
    names = {"STRING": "str", "BOOLEAN": "bool", "DECIMAL": "double", "DOUBLE": "double", "FLOAT": "double", "TIMESTAMP": "date", "TIMESTAMP_NTZ": "date", "DATE": "date", "BINARY": "binary", "UUID": "uuid", "ARRAY": "array", "OBJECT": "object", **{f"OBJECT<`{t}`:": k for t, k in TAGS.items() if k}}
    # A tag that is not known stands for itself, an object.
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    named = F.coalesce(F.try_element_at(table, s), F.when(s.startswith("OBJECT") & (s != "OBJECT<`$undefined`:"), "object"))
    return F.when(s.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.when(number.between(-(2**31), 2**31 - 1), "int").otherwise("long")).otherwise(named)


def _raw(v: Column, kind: Column) -> Column:
    get = lambda path, t="string": F.try_variant_get(v, path, t)
    plain = get("$")
    inner = F.coalesce(*[get(f"$.{t}") for t in ("$oid", "$numberInt", "$numberLong", "$numberDouble", "$numberDecimal", "$uuid", "$symbol", "$code")])
    date = F.coalesce(iso(F.timestamp_millis(F.coalesce(get("$.$date.$numberLong").try_cast("bigint"), get("$.$date", "bigint")))), get("$.$date"))
    regex = F.concat(F.lit("/"), get("$.$regularExpression.pattern"), F.lit("/"), F.coalesce(get("$.$regularExpression.options"), F.lit("")))
    ends = F.when(get("$.$minKey", "int").isNotNull(), "MinKey").when(get("$.$maxKey", "int").isNotNull(), "MaxKey")
    out = F.when(kind == "date", F.coalesce(date, plain)).when(kind == "timestamp", iso(F.timestamp_seconds(get("$.$timestamp.t", "bigint")))).when(kind == "regex", regex)
    return out.when(kind == "binary", F.coalesce(get("$.$binary.base64"), get("$.$binary"), plain)).otherwise(F.coalesce(inner, ends, plain))


def quoted(text: Column) -> Column:
    """A JSON string of ``text``."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def plain_json(text: Column) -> Column:
    """JSON with Extended JSON tags replaced by what they stand for. Quotes inside strings are escaped, so a tag's text in one is safe."""
    number = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"
    for tag in ("numberInt", "numberLong", "numberDouble", "numberDecimal"):
        text = F.regexp_replace(text, r'\{"\$%s":"%s"\}' % (tag, number), "$1")
        text = F.regexp_replace(text, r'\{"\$%s":("[^"]*")\}' % tag, "$1")
    for tag in ("oid", "date", "uuid", "symbol", "code"):
        text = F.regexp_replace(text, r'\{"\$%s":("(?:[^"\\]|\\.)*")\}' % tag, "$1")
    text = F.regexp_replace(text, r'\{"\$binary":\{"base64":("[^"]*"),"subType":"[^"]*"\}\}', "$1")
    return F.regexp_replace(text, r'\{"\$undefined":true\}', "null")


def iso(ts: Column) -> Column:
    """ISO-8601 in UTC with as many fraction digits, 0, 3 or 6, as are needed."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    frac = F.when(micros == 0, "").when(micros % 1000 == 0, F.concat(F.lit("."), F.lpad((micros / 1000).cast("int").cast("string"), 3, "0"))).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(base, frac, F.lit("Z"))


def plain_double(d: Column) -> Column:
    """A double without exponent or closing zeros; NaN and infinities by name."""
    size = F.abs(d)
    exact = F.when(size < 1e7, d.try_cast("decimal(38,30)").cast("string")).when(size < 1e19, d.try_cast("decimal(38,18)").cast("string")).when(size < 1e37, d.try_cast("decimal(38,0)").cast("string"))
    text = F.coalesce(F.when(d == 0, "0").otherwise(exact), d.cast("string"))
    return F.when(text.rlike(r"^-?[0-9]+\.[0-9]+$"), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def number_text(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return plain_double(c.cast("string").cast("double") if isinstance(t, T.FloatType) else c)
    if isinstance(t, T.DecimalType):
        text = c.cast("string")
        return F.when(text.rlike(r"[eE]"), F.format_number(c, t.scale)).otherwise(text)
    return c.cast("string")


def static_kind(t: T.DataType) -> str | None:
    """The kind of a Spark type."""
    pairs = ((T.NullType, None), ((T.ByteType, T.ShortType, T.IntegerType), "int"), (T.LongType, "long"), ((T.FloatType, T.DoubleType), "double"), (T.DecimalType, "decimal"), (T.BooleanType, "bool"), ((T.TimestampType, T.TimestampNTZType, T.DateType), "date"), (T.BinaryType, "binary"), (T.ArrayType, "array"), ((T.StructType, T.MapType), "object"))
    return next((k for c, k in pairs if isinstance(t, c)), "str")


def static_json(t: T.DataType, text: Column) -> Column:
    """JSON text of a typed value; null for null."""
    if isinstance(t, (T.StructType, T.ArrayType, T.MapType, T.NumericType, T.BooleanType)):
        return text
    return F.when(text.isNotNull(), quoted(text))


def static_text(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return iso(c.cast("timestamp"))
    if isinstance(t, T.BinaryType):
        return F.base64(c)
    if isinstance(t, T.NumericType):
        return number_text(c, t)
    if isinstance(t, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c, {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX"})
    return c.cast("string")


def root(df, doc: str | None) -> Value:
    """The document of each row: a variant column, a struct column, or all columns together."""
    if doc is None:
        return Value(F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns]), df.schema)
    kind = df.schema[doc].dataType
    return Value(F.col(doc), None if isinstance(kind, T.VariantType) else kind)
