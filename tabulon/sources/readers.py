"""Sources of documents: a registry of formats, full and incremental scans, samples, probes."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.errors import InvalidRequest, Unreachable
from tabulon.operators.filters import filter_documents


@dataclass(frozen=True)
class ReadRequest:
    """What to scan: everything after a key (full), or from a high-water mark on (incremental)."""

    collection: str
    filter: str | dict | None = None
    after_id: object = None
    watermark_field: str | None = None
    from_watermark: object = None

    @classmethod
    def full(cls, collection: str, filter=None, after_id=None) -> ReadRequest:  # noqa: A002
        return cls(collection, filter, after_id)

    @classmethod
    def incremental(cls, collection: str, field: str, start=None, filter=None) -> ReadRequest:  # noqa: A002
        return cls(collection, filter, None, field, start)

    @property
    def is_incremental(self) -> bool:
        return self.watermark_field is not None


class Source:
    """Documents as DataFrames. ``load`` gives a collection; the rest follows from it."""

    id_column = "_id"
    doc_column: str | None = None

    def __init__(self, spark: SparkSession, location: str, options: dict[str, str] | None = None):
        self.spark, self.location, self.options = spark, location.rstrip("/"), dict(options or {})
        self.id_column = self.options.pop("id", self.id_column)

    def load(self, collection: str) -> DataFrame:
        raise NotImplementedError

    def list_objects(self) -> list[str]:
        raise NotImplementedError

    def read(self, request: ReadRequest, ordered: bool = False) -> DataFrame:
        """The documents asked for. Sinks are set-oriented, so a global sort is only made on demand."""
        df = filter_documents(self.load(request.collection), request.filter, self.doc_column)
        if request.is_incremental:
            mark = self.field(df, request.watermark_field)
            df = df if request.from_watermark is None else df.where(mark >= F.lit(request.from_watermark))
            return df.orderBy(mark, self.id_column) if ordered else df
        df = df if request.after_id is None else df.where(F.col(self.id_column) > F.lit(request.after_id))
        return df.orderBy(self.id_column) if ordered else df

    def field(self, df: DataFrame, path: str) -> Column:
        return F.col(".".join(f"`{p}`" for p in path.split(".")))

    @staticmethod
    def bounds(keys: DataFrame, size: int, most: int) -> list | None:
        """Ascending values that part ``keys(k)`` into slices of about ``size``, at most ``most`` of them; None if there are no rows.

        A slice takes the keys up to its bound. Numbers and times are parted by quantiles, texts by their first
        characters' order among keys chosen by hash; only the key is read.
        """
        n = keys.count()
        slices = min(-(-n // size), most)
        if slices <= 1:
            return [] if n else None
        known = keys.where("k is not null")
        kind = dict(keys.dtypes)["k"]
        if kind in ("string", "binary"):
            # At most about 64 candidates a slice, whatever the number of rows.
            share = max(1, n // (slices * 64))
            drawn = known.where(F.pmod(F.xxhash64("k"), F.lit(share)) == 0).select("k").distinct().orderBy("k").limit(slices * 256).collect()
            got = [drawn[len(drawn) * i // slices].k for i in range(1, slices)] if drawn else []
        else:
            is_time = kind.startswith(("timestamp", "date"))
            number = F.unix_micros(F.col("k").cast("timestamp")) if is_time else F.col("k")
            got = known.agg(F.percentile_approx(number, [i / slices for i in range(1, slices)], 10_000).alias("b")).first().b or []
            if is_time:
                spark = keys.sparkSession
                rows = spark.createDataFrame([(x,) for x in got], "x long").select(F.timestamp_micros("x").cast(kind).alias("k")) if got else None
                got = [r.k for r in rows.collect()] if rows is not None else []
        return sorted(set(got))

    def sample(self, collection: str, size: int, seed: int = 0) -> DataFrame:
        return self.load(collection).orderBy(F.rand(seed)).limit(size)

    def probe(self) -> dict:
        """Whether the source answers: a listing, with its latency."""
        start = time.monotonic()
        try:
            names = self.list_objects()
        except Exception as e:
            raise Unreachable(str(e).splitlines()[0]) from e
        return {"ok": True, "message": f"{len(names)} collections", "latencyMs": int((time.monotonic() - start) * 1000)}


class _Files(Source):
    """Collections are entries of a folder, listed through Spark's own file systems."""

    suffix = ""

    def path(self, collection: str) -> str:
        return f"{self.location}/{collection}{self.suffix}"

    def list_objects(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.location)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(n.removesuffix(self.suffix) for n in names if n.endswith(self.suffix) and not n.startswith(("system.", "_", ".")))


class ParquetSource(_Files):
    """Typed documents: each collection a Parquet table, whole rows as documents."""

    suffix = ".parquet"

    def load(self, collection: str) -> DataFrame:
        return self.spark.read.options(**self.options).parquet(self.path(collection))


class ExtendedJsonSource(_Files):
    """Schemaless documents: lines of Extended JSON, parsed once into a VARIANT.

    The key, and a watermark if ``watermark`` names one, are typed columns beside the
    document, so that bounds and orders don't look into it.
    """

    suffix, doc_column = ".jsonl", "doc"

    def load(self, collection: str) -> DataFrame:
        lines = self.spark.read.text(self.path(collection)).where(F.trim("value") != "")
        df = lines.select(F.parse_json("value").alias("doc"))
        key = F.coalesce(F.try_variant_get("doc", "$._id.$oid", "string"), F.try_variant_get("doc", "$._id.$numberLong", "string"), F.try_variant_get("doc", "$._id.$numberInt", "string"), F.try_variant_get("doc", "$._id", "string"))
        return df.withColumn("_id", key.cast(self.options.get("idType", "string")))

    def field(self, df: DataFrame, path: str) -> Column:
        if path in df.columns:
            return F.col(path)
        at = "$" + "".join(f'["{p}"]' for p in path.split("."))
        millis = F.timestamp_millis(F.try_variant_get("doc", at + ".$date.$numberLong", "string").try_cast("bigint"))
        return F.coalesce(millis, F.try_variant_get("doc", at + ".$date", "string").try_cast("timestamp"), F.try_variant_get("doc", at, "string").try_cast("timestamp"))


class TableSource(Source):
    """Collections are tables of the session's catalog."""

    def load(self, collection: str) -> DataFrame:
        return self.spark.table(f"{self.location}.{collection}" if self.location else collection)

    def list_objects(self) -> list[str]:
        """Of one database by name; without a location those of all databases, as ``database.table``."""
        listed = lambda d: [t.name for t in self.spark.catalog.listTables(d) if not t.isTemporary]
        if self.location:
            return sorted(listed(self.location))
        return sorted(f"{d.name}.{t}" for d in self.spark.catalog.listDatabases() for t in listed(d.name))


class ConnectorSource(Source):
    """Any Spark connector on the class path, by its format name (``format`` option)."""

    def load(self, collection: str) -> DataFrame:
        options = {k: v for k, v in self.options.items() if k != "format"}
        try:
            return self.spark.read.format(self.options["format"]).options(**options).option("collection", collection).option("connection.uri", self.location).load()
        except Exception as e:
            if "DATA_SOURCE_NOT_FOUND" in str(e) or "ClassNotFoundException" in str(e):
                raise Unreachable(f"The connector {self.options['format']!r} is not on the class path") from e
            raise

    def list_objects(self) -> list[str]:
        raise Unreachable(f"{self.options.get('format')} cannot be listed without its connector")


@dataclass(frozen=True)
class Credentials:
    """Who reads; the password never shows."""

    username: str | None = None
    password: str | None = field(default=None, repr=False)

    def within(self, uri: str) -> str:
        """``uri`` with the credentials in their place; what it says itself stays."""
        scheme, mark, rest = uri.partition("://")
        if not self.username or not mark or "@" in rest.split("/")[0]:
            return uri
        login = quote(self.username, safe="") + (":" + quote(self.password, safe="") if self.password else "")
        return f"{scheme}://{login}@{rest}"


REGISTRY: dict[str, Callable[..., Source]] = {"PARQUET": ParquetSource, "JSONL": ExtendedJsonSource, "TABLE": TableSource, "CONNECTOR": ConnectorSource, "MONGODB": ConnectorSource}


def open_source(spark: SparkSession, kind: str, location: str, options: dict[str, str] | None = None, login: Credentials = Credentials(), database: str | None = None) -> Source:
    """The source of a kind; unknown kinds are refused. A document store gets login and database as its connector expects them."""
    kind, options = kind.upper(), dict(options or {})
    if kind not in REGISTRY:
        raise InvalidRequest(f"Source type {kind} is not supported")
    if kind == "MONGODB":
        if not database:
            raise InvalidRequest("A document store needs a database, in its uri or beside it")
        options = {"format": "mongodb", "database": database} | options
    elif kind == "CONNECTOR":
        options |= {k: v for k, v in (("user", login.username), ("password", login.password)) if v}
    return REGISTRY[kind](spark, login.within(location) if kind == "MONGODB" else location, options)
