"""Applying a compiled mapping: parent rows, child rows and rejected documents.

One projection computes every column and, beside it, the first error of the
document in mapping order (key, columns, child tables). Rows without an error
feed the tables, the others the dead letters, so a bad document costs nothing
but itself. Child rows are exploded from values that are already converted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.coerce import coerce
from tabulon.functions.values import STEPS, Value, nothing, plain_json, root, settled, step
from tabulon.plans.spec import SCALAR, Binding, ChildPlan, MappingPlan

ERROR, KEY, PARENT, PAYLOAD, ROW, ORDER = "__error", "__key", "__parent", "__payload", "__row", "__order"
PAYLOAD_CHARS, ID_CHARS = 100_000, 255


@dataclass
class Mapped:
    """The result of a mapping over one DataFrame; ``frame`` holds everything once."""

    plan: MappingPlan
    frame: DataFrame
    #: JSON of the document in ``__doc``.
    document: Column | None = None

    def cache(self) -> Mapped:
        """Keep the projection, where several tables are read from it."""
        self.frame = self.frame.persist()
        return self

    def unpersist(self) -> None:
        self.frame.unpersist()

    @property
    def sound(self) -> DataFrame:
        return self.frame.where(F.col(ERROR).isNull() & (F.col(ROW) >= 0))

    @property
    def parent(self) -> DataFrame:
        return self.sound.select(f"{PARENT}.*")

    def child(self, i: int) -> DataFrame:
        names = self.plan.children[i].table.column_names
        rows = self.sound.select(F.col(KEY).alias(names[0]), F.posexplode(f"__child{i}").alias(names[1], "e"))
        return rows.select(names[0], names[1], *[F.col(f"e.`{c}`").alias(c) for c in names[2:]])

    @property
    def children(self) -> list[DataFrame]:
        return [self.child(i) for i in range(len(self.plan.children))]

    @property
    def rejected(self) -> DataFrame:
        """``source_id, payload, error`` of documents that could not be converted (and their order, if it was given)."""
        order = [ORDER] if ORDER in self.frame.columns else []
        return self.frame.where(F.col(ERROR).isNotNull() & (F.col(ROW) >= 0)).select(F.col("__id").alias("source_id"), F.col(PAYLOAD).alias("payload"), F.substring(ERROR, 1, 4000).alias("error"), *order)


    def refused(self, rows: DataFrame, error: str) -> DataFrame:
        """Rows of the frame as rejected documents, with an error that is not the mapping's."""
        order = [ORDER] if ORDER in rows.columns else []
        payload = self.document if self.document is not None else F.lit(None).cast("string")
        return rows.select(F.col("__id").alias("source_id"), payload.alias("payload"), F.lit(error[:4000]).alias("error"), *order)


def _element(e: Column, kind: T.DataType | None, is_object: Column | None, binding: Binding) -> Value:
    """A binding's value in an array element: inside an object, or the scalar itself under ``value``."""
    own = binding.path == (SCALAR,)
    if kind is None:
        return Value(F.when(is_object, Value(e).at(binding.path).col).otherwise(e if own else F.lit(None).cast("variant")))
    if isinstance(kind, (T.StructType, T.MapType)):
        return Value(e, kind).at(binding.path)
    return Value(e, kind) if own else nothing()


def _child_rows(v: Value, child: ChildPlan) -> Column:
    """Array of (converted element, its first error), from the array value ``v``."""
    array, element = v.elements()
    if element is None:
        # Each element with whether it is an object, looked at once.
        array = F.transform(array, lambda e: F.struct(e.alias("e"), F.coalesce(F.regexp_extract(F.schema_of_variant(e), "^(OBJECT<`[$]|[A-Z]+)", 1) == "OBJECT", F.lit(False)).alias("o")))
        value = lambda s, b: _element(s["e"], None, s["o"], b)
    else:
        value = lambda s, b: _element(s, element, None, b)
    names = [f"b{i}" for i in range(len(child.bindings))]
    types: list[Value] = []

    def pack(parts: list[dict[str, Column]]) -> Column:
        return F.struct(*[F.struct(*[c.alias(k) for k, c in p.items()]).alias(n) for n, p in zip(names, parts)])

    def parts_of(s: Column, upto: int) -> list[dict[str, Column]]:
        return [{k: s[n][k] for kinds in STEPS[:upto] for k in kinds} for n in names]

    def first(s: Column) -> Column:
        types[:] = [value(s, b) for b in child.bindings]
        return pack([step(0, t, None) for t in types])

    array = F.transform(array, first)
    def apart(i: int):
        return lambda s: pack([p | step(i, t, p) for t, p in zip(types, parts_of(s, i))])

    for i in range(1, len(STEPS)):
        array = F.transform(array, apart(i))

    def convert(s: Column) -> Column:
        pairs = [(b, coerce(settled(t, p), b.column)) for b, t, p in zip(child.bindings, types, parts_of(s, len(STEPS)))]
        return F.struct(F.struct(*[c.alias(b.column.name) for b, (c, _) in pairs]).alias("v"), F.coalesce(*[e for _, (_, e) in pairs]).alias("e"))

    return F.transform(array, convert)


def _overflow(doc: Value, plan: MappingPlan) -> Column:
    """Top-level members that no path begins with, as one JSON object; null if there are none."""
    if doc.dynamic:
        rest = F.map_filter(doc.col.try_cast("map<string,variant>"), lambda k, v: ~k.isin(*sorted(plan.consumed)))
        return F.when(F.size(rest) > 0, plain_json(F.to_json(F.to_variant_object(rest))))
    names = [n for n in doc.type.names if n not in plan.consumed]
    return F.to_json(F.struct(*[doc.col.getField(n).alias(n) for n in names]), {"ignoreNullFields": "false"}) if names else F.lit(None).cast("string")


def map_documents(df: DataFrame, plan: MappingPlan, doc: str | None = None, payload: bool = True, order: Column | None = None) -> Mapped:
    """Apply ``plan`` to the documents in column ``doc`` (variant or struct), or to whole rows.

    ``order`` is what documents are read by; of documents with one key it says which one is the last.
    """
    d = root(df, doc)
    ident = d.at(("_id",))
    values = {"__k": d.at(plan.key.path), "__i": ident, **{f"__f{i}": d.at(b.path) for i, b in enumerate(plan.bindings)}, **{f"__a{i}": d.at(c.array_path) for i, c in enumerate(plan.children)}}
    carried: list[Column] = [_overflow(d, plan).alias("_extra")] if plan.overflow else []
    carried.append((d.col if payload else F.lit(None).cast("string")).alias("__doc"))
    if order is not None:
        carried.append(order.alias(ORDER))
    # One projection a step: what a step refers to often is a column, which the optimizer does not repeat.
    ordered = [ORDER] if order is not None else []
    rest = ["__doc", *ordered, *(["_extra"] if plan.overflow else [])]
    parts: dict[str, dict[str, Column]] = {n: {} for n in values}
    for i in range(len(STEPS)):
        new = {n: step(i, v, parts[n]) for n, v in values.items() if i < 2 or not n.startswith("__a")}
        df = df.select(*(rest if i else carried), *[c for p in parts.values() for c in p.values()], *[c.alias(f"{n}_{k}") for n, p in new.items() for k, c in p.items()])
        for n, p in new.items():
            parts[n] |= {k: F.col(f"{n}_{k}") for k in p}
    at = {n: settled(v, parts[n]) for n, v in values.items()}
    key, key_error = coerce(at["__k"], plan.key.column)
    pairs = [(b, coerce(at[f"__f{i}"], b.column)) for i, b in enumerate(plan.bindings)]
    children = []
    for i, c in enumerate(plan.children):
        v = at[f"__a{i}"]
        typed = v.dynamic or v.kind == "array"
        children.append((_child_rows(v, c) if typed else F.lit(None)).alias(f"__c{i}"))
    arrays = [c for n, p in parts.items() if n.startswith("__a") for c in p.values()]
    df = df.select(*rest, *arrays, parts["__i"]["text"], key.alias(KEY), key_error.alias("__ke"), *[x for i, (_, (c, e)) in enumerate(pairs) for x in (c.alias(f"__p{i}_c"), e.alias(f"__p{i}_e"))], *children)
    errors = [F.col("__ke"), F.when(F.col(KEY).isNull(), F.lit(f"document has no value at primary key path '{'.'.join(plan.key.path)}'")), *[F.col(f"__p{i}_e") for i in range(len(pairs))]]
    out = []
    for i, c in enumerate(plan.children):
        v, rows = at[f"__a{i}"], F.col(f"__c{i}")
        name = F.col(f"__a{i}_kind")
        wrong = F.concat(F.lit(f"expected an array at '{'.'.join(c.array_path)}' for child table '{c.table.name}', found "), name)
        members = ", ".join(f"`{b.column.name}`: {b.column.spark_type}" for b in c.bindings)
        if v.dynamic or v.kind == "array":
            first = F.get(F.filter(F.transform(rows, lambda r: r["e"]), lambda e: e.isNotNull()), F.lit(0))
            errors.append(F.when(name.isNull(), F.lit(None).cast("string")).when(name != "array", wrong).otherwise(first))
            out.append(F.transform(rows, lambda r: r["v"]).alias(f"__child{i}"))
        else:
            errors.append(F.when(~v.is_null, wrong))
            out.append(F.lit(None).cast(f"array<struct<{members}>>").alias(f"__child{i}"))
    parts = [F.col(KEY).alias(plan.key.column.name), *[F.col(f"__p{i}_c").alias(b.column.name) for i, (b, _) in enumerate(pairs)], *([F.col("_extra")] if plan.overflow else [])]
    error = F.coalesce(*errors)
    source = F.substring(F.coalesce(F.col("__i_text"), F.col(KEY).cast("string")), 1, ID_CHARS)
    # A row number is not deterministic, so filters on the error stay above it: pushed down they would repeat
    # the whole conversion in the predicate.
    df = df.select(error.alias(ERROR), F.monotonically_increasing_id().alias(ROW), KEY, F.struct(*parts).alias(PARENT), source.alias("__id"), "__doc", *ordered, *out)
    if not payload:
        return Mapped(plan, df.withColumn(PAYLOAD, F.col("__doc")))
    # The payload is only made for rejected documents.
    whole = plain_json(F.to_json(F.col("__doc"))) if d.dynamic else F.to_json(F.col("__doc"), {"ignoreNullFields": "false"})
    long = F.when(F.char_length(whole) > PAYLOAD_CHARS, F.concat(F.substring(whole, 1, PAYLOAD_CHARS), F.lit("...(truncated)"))).otherwise(whole)
    return Mapped(plan, df.withColumn(PAYLOAD, F.when(F.col(ERROR).isNotNull(), long)), long)
