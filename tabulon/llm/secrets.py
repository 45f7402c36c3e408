"""Secret scans: assignments, access keys and hex runs by pattern, other secrets by randomness.

Other long tokens are tested against the hypothesis that they are random
strings of their inferred encoding: chi-squared uniformity of the alphabet, runs
above and below its middle, and serial correlation, combined by Fisher's
method. A token is dismissed as not random only if the hypothesis is rejected, and the
rejections are controlled (Benjamini-Hochberg) inside strata of encoding and
length, since short tokens give weak evidence: at most ``q`` of the dismissed
tokens of a stratum are expected to be random. The others are secrets.

Every token is tested, of letters or digits alone as well. Of a token that
touches a pattern's span, what the spans leave is tested piece by piece; a piece of
less than ``LEAST`` characters gives too little evidence to be dismissed, so it is a
secret if it has a letter or digit.

The ranks that the control needs come from counts of p-values on a fixed grid, so
nothing is sorted globally. All expressions run in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Kinds in the order that breaks ties, with their patterns (Java's dialect); matches that fail ``_fits`` are dropped.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: Tokens to be tested; each is tried from its beginning only. One may follow '=', which is padding only where the token ends.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/=_-]))?"
#: The least characters of a token.
LEAST = 20
#: Alphabets by name, narrowest first: pattern of their tokens and symbols in order.
ALPHABETS = (
    ("digits", "^[0-9]+$", "0123456789"),
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("lower", "^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", "^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper36", "^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters", "^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base62", "^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Width of the grid of -ln p, and its last cell.
GRID, CELLS = 0.25, 120
CHUNK = 256
#: Characters of the blocks that a text is cut into for masking.
BLOCK = 4096


def _before(lengths: Column) -> Column:
    """Sums of all earlier elements, in chunks so that long arrays stay cheap."""
    n = F.size(lengths)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / CHUNK).cast("int")), lambda c: F.slice(lengths, c * CHUNK + 1, CHUNK))
    zero = F.struct(F.lit(0).cast("long").alias("t"), F.array().cast("array<long>").alias("a"))
    step = lambda s, x: F.struct((s["t"] + x).alias("t"), F.array_append(s["a"], s["t"]).alias("a"))
    inner = F.transform(parts, lambda p: F.aggregate(p, zero, step))
    base = F.aggregate(F.transform(inner, lambda i: i["t"]), zero, step)["a"]
    return F.flatten(F.transform(F.arrays_zip(inner.alias("i"), base.alias("b")), lambda z: F.transform(z["i"]["a"], lambda v: v + z["b"])))


def _with_spans(df: DataFrame, pattern: str, name: str) -> DataFrame:
    """Adds ``name``: array of (start, end, value) of all matches, leftmost and not overlapping, in code points."""
    p, has = F.lit(pattern), F.col("text").rlike(pattern)
    df = df.withColumn("_h", F.when(has, F.regexp_extract_all("text", p, F.lit(0)))).withColumn("_g", F.when(has, F.split("text", pattern, -1)))
    df = df.withColumn("_n", F.transform(F.arrays_zip(F.col("_h").alias("h"), F.slice("_g", 1, F.size("_h")).alias("g")), lambda z: (F.char_length(z["h"]) + F.char_length(z["g"])).cast("long")))
    df = df.withColumn("_b", F.when(F.col("_h").isNotNull(), _before(F.col("_n"))))
    spans = F.transform(F.arrays_zip("_b", F.slice("_g", 1, F.size("_h")).alias("g"), F.col("_h").alias("h")), lambda z: F.struct((z["_b"] + F.char_length(z["g"])).alias("s"), (z["_b"] + F.char_length(z["g"]) + F.char_length(z["h"])).alias("e"), z["h"].alias("v")))
    return df.withColumn(name, F.coalesce(spans, F.array().cast("array<struct<s:long,e:long,v:string>>"))).drop("_h", "_g", "_n", "_b")


def _tail(z: Column) -> Column:
    """P(normal > z), by the classical rational approximation of the error function (error below 1.5e-7)."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    upper = poly * F.exp(-x * x) / 2
    return F.greatest(F.when(z >= 0, upper).otherwise(1 - upper), F.lit(1e-13))


def p_random(value: Column) -> Column:
    """struct(encoding, n, p): p-value of "a random string over its alphabet"; padding is not tested."""
    core = F.rtrim(F.translate(value, "=", " "))
    case = lambda f: F.coalesce(*[F.when(core.rlike(p), f(name, a)) for name, p, a in ALPHABETS], f(*ALPHABETS[-1][::2]))
    return F.struct(case(lambda n, a: F.lit(n)).alias("encoding"), case(lambda n, a: F.lit(a)).alias("alphabet"), core.alias("core"))


def _battery(c: Column) -> Column:
    """p-value of the three tests together; ``c`` has core and alphabet.

    Each step is a pass over an array of one element, so that what a later step
    refers to many times is computed, and planned, once.
    """
    n, k = F.char_length(c["core"]).cast("double"), F.char_length(c["alphabet"]).cast("double")
    places = F.transform(F.split(c["core"], "(?!^)"), lambda ch: (F.instr(c["alphabet"], ch) - 1).cast("double"))
    one = F.array(F.struct(places.alias("x"), n.alias("n"), k.alias("k")))
    for each in (_measured, _scored, _tailed, _combined):
        one = F.transform(one, each)
    return one[0]


def _measured(s: Column) -> Column:
    """Sums over the symbols: squared counts, symbols of the upper half, runs, products of neighbours, squares."""
    x, k, zero = s["x"], s["k"], F.lit(0.0)
    squares = F.aggregate(F.array_distinct(x), zero, lambda t, v: t + F.pow(F.size(F.filter(x, lambda w: w == v)).cast("double"), F.lit(2.0)))
    walk = F.aggregate(x, F.struct(F.lit(-1.0).alias("last"), zero.alias("runs"), zero.alias("cross"), zero.alias("power")), lambda t, v: F.struct(
        v.alias("last"),
        (t["runs"] + F.when((t["last"] < 0) | ((t["last"] * 2 >= k) != (v * 2 >= k)), 1.0).otherwise(0.0)).alias("runs"),
        (t["cross"] + F.when(t["last"] < 0, 0.0).otherwise((t["last"] - (k - 1) / 2) * (v - (k - 1) / 2))).alias("cross"),
        (t["power"] + (v - (k - 1) / 2) * (v - (k - 1) / 2)).alias("power"),
    ))
    return F.struct(s["n"].alias("n"), k.alias("k"), squares.alias("squares"), F.size(F.filter(x, lambda v: v * 2 >= k)).cast("double").alias("high"), walk.alias("walk"))


def _scored(s: Column) -> Column:
    """Normal scores of the tests; a token of one half, or of one symbol in the middle, scores as far out as can be."""
    n, k, walk = s["n"], s["k"], s["walk"]
    chi, df = s["squares"] * k / n - n, k - 1
    z1 = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    both = 2 * s["high"] * (n - s["high"])
    var = both * (both - n) / (n * n * (n - 1))
    z2 = F.when(var > 0, (walk["runs"] - (both / n + 1)) / F.sqrt(F.when(var > 0, var).otherwise(1.0))).otherwise(8.0)
    z3 = F.when(walk["power"] > 0, walk["cross"] / walk["power"] * F.sqrt(n)).otherwise(8.0)
    return F.struct(z1.alias("a"), F.abs(z2).alias("b"), F.abs(z3).alias("c"))


def _tailed(s: Column) -> Column:
    """The tests' p-values; runs and serial correlation see the same thing, so the lesser counts, twice over."""
    serial = F.least(4 * _tail(F.greatest(s["b"], s["c"])), F.lit(1.0))
    return F.struct(_tail(s["a"]).alias("p"), serial.alias("q"))


def _combined(s: Column) -> Column:
    """Fisher's method for two."""
    half = -(F.log(s["p"]) + F.log(s["q"]))
    return F.exp(-half) * (1 + half)


def _text(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["s"].cast("string"), s["e"].cast("string"))), ",")


def _pieces(t: Column) -> Column:
    """What the spans of ``base`` leave of a token, as (s, e, v); a token that none touches is one piece."""
    touching = F.array_sort(F.filter("base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    piece = lambda s, e: F.struct(s.alias("s"), e.alias("e"), F.substring(t["v"], (s - t["s"] + 1).cast("int"), (e - s).cast("int")).alias("v"))
    start = F.struct(t["s"].alias("at"), F.array().cast("array<struct<s:long,e:long,v:string>>").alias("out"))
    step = lambda a, b: F.struct(F.greatest(a["at"], b["e"]).alias("at"), F.when(b["s"] > a["at"], F.array_append(a["out"], piece(a["at"], b["s"]))).otherwise(a["out"]).alias("out"))
    return F.aggregate(touching, start, step, lambda a: F.when(a["at"] < t["e"], F.array_append(a["out"], piece(a["at"], t["e"]))).otherwise(a["out"]))


def _kind(spans: Column, i: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["s"].alias("s"), F.lit(i).alias("i"), s["e"].alias("e"), F.lit(KINDS[i]).alias("kind")))


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", q: float = 0.01) -> DataFrame:
    """``key, base, extra``: arrays of (s, i, e, kind) in code points.

    ``base`` holds what the three patterns find, ``extra`` the random tokens,
    without what ``base`` covers of them.
    """
    return _found(docs, text, key, q, ()).select(F.col("id").alias(key), "base", "extra")


def _found(docs: DataFrame, text: str, key: str, q: float, keep: tuple[str, ...]) -> DataFrame:
    """``id, base, extra`` and the columns to keep as ``k_<name>``."""
    df = docs.select(F.col(key).alias("id"), *[F.col(c).alias(f"k_{c}") for c in keep], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", TOKEN)):
        df = _with_spans(df, pattern, name)
    base = F.concat(
        _kind(F.filter("assign", lambda s: F.char_length(F.regexp_extract(s["v"], ASSIGN, 2)) >= 6), 0),
        _kind(F.filter("access", lambda s: s["e"] - s["s"] >= 20), 1),
        _kind(F.col("hex"), 2),
    )
    df = df.withColumn("base", base)
    pieces = F.filter(F.flatten(F.transform("token", _pieces)), lambda t: (t["e"] - t["s"] >= LEAST) | t["v"].rlike("[A-Za-z0-9]"))
    df = df.withColumn("token", pieces).withColumn("token", F.transform("token", lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), p_random(t["v"]).alias("c"))))
    # A piece too short to be tested has no cell, so nothing dismisses it.
    cell = lambda t: F.when(F.char_length(t["c"]["core"]) >= LEAST, F.least(F.floor(-F.log(F.greatest(_battery(t["c"]), F.lit(1e-30))) / GRID), F.lit(CELLS)).cast("int"))
    tested = F.transform("token", lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), F.concat(t["c"]["encoding"], F.lit("|"), F.least(F.floor(F.log2(t["e"] - t["s"]) * 2), F.lit(20)).cast("string")).alias("stratum"), cell(t).alias("cell")))
    found = written(df.select("id", *[f"k_{c}" for c in keep], "base", tested.alias("token")), "secrets")
    # Benjamini-Hochberg on the grid: a cell is rejected if its largest p is at most q times the share of tokens in it and beyond.
    cells = found.select(F.explode("token").alias("t")).where("t.cell IS NOT NULL").groupBy(F.col("t.stratum").alias("stratum"), F.col("t.cell").alias("cell")).count()
    w = Window.partitionBy("stratum")
    beyond = F.sum("count").over(w.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = cells.select("stratum", "cell", beyond.alias("rank"), F.sum("count").over(w).alias("m"))
    cuts = ranked.where(F.exp(-F.col("cell") * GRID) <= q * F.col("rank") / F.col("m")).groupBy("stratum").agg(F.min("cell").alias("cut")).collect()  # at most encodings times lengths: 252 rows
    cut = F.create_map(*[F.lit(v) for r in cuts for v in (r.stratum, r.cut)]) if cuts else F.create_map().cast("map<string,int>")
    extra = F.filter("token", lambda t: t["cell"].isNull() | (t["cell"] < F.coalesce(F.element_at(cut, t["stratum"]), F.lit(CELLS + 1))))
    return found.select("id", *[f"k_{c}" for c in keep], "base", _kind(extra, 3).alias("extra"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", q: float = 0.01) -> DataFrame:
    """One row per row of ``docs``: ``key, n_assign, n_access, n_hex, base_sha256, spans, n_random``.

    A null or empty text has no spans. Starts and ends are code points, ends
    exclusive; spans of different kinds may overlap, except random ones.
    Repeated rows get equal answers. Other columns are ignored. An empty table gives an empty result.
    """
    n = lambda i: F.size(F.filter("base", lambda s: s["i"] == i)).cast("long")
    return find(docs, text, key, q).select(key, n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.concat("base", "extra")).alias("spans"), F.size("extra").cast("long").alias("n_random"))


def _merged(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap as one: array of (s, e). Chunked, so that long arrays stay cheap."""
    n = F.size(spans)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / CHUNK).cast("int")), lambda c: F.slice(spans, c * CHUNK + 1, CHUNK))
    kind = "array<struct<s:long,e:long>>"
    one = lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"))

    def step(t: Column, s: Column) -> Column:
        joins = s["s"] <= t["e"]
        return F.struct(F.when(joins, t["s"]).otherwise(s["s"]).alias("s"), F.when(joins, F.greatest(t["e"], s["e"])).otherwise(s["e"]).alias("e"), F.when(joins | (t["e"] < 0), t["out"]).otherwise(F.array_append(t["out"], one(t))).alias("out"))

    # A chunk starts with the span that the one before left open.
    empty = F.array().cast(kind)
    begin = F.struct(F.lit(-1).cast("long").alias("s"), F.lit(-1).cast("long").alias("e"), F.array().cast(f"array<{kind}>").alias("done"))

    def chunk(t: Column, p: Column) -> Column:
        got = F.aggregate(p, F.struct(t["s"].alias("s"), t["e"].alias("e"), empty.alias("out")), step)
        # Looked at once: the aggregate's result is the only element of an array.
        return F.transform(F.array(got), lambda g: F.struct(g["s"].alias("s"), g["e"].alias("e"), F.array_append(t["done"], g["out"]).alias("done")))[0]

    return F.aggregate(parts, begin, chunk, lambda t: F.concat(F.flatten(t["done"]), F.when(t["e"] >= 0, F.array(one(t))).otherwise(empty)))


def _without(text: Column, merged: Column, mask: str) -> Column:
    """``text`` with merged spans replaced: cut into blocks first, so that no piece is found by walking the whole text."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def build(one: Column) -> Column:
        held, spans, n = one["b"], one["m"], one["n"]
        starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["e"]))
        ends = F.concat(F.transform(spans, lambda s: s["s"]), F.array(n))

        def piece(z: Column) -> Column:
            a, b = z["a"], z["z"]
            i, j = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
            near = F.array_join(F.slice(held, i + 1, F.greatest(j - i + 1, F.lit(1))), "")
            return F.when(b > a, F.substring(near, (a - i * BLOCK + 1).cast("int"), (b - a).cast("int"))).otherwise("")

        return F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("z")), piece), mask)

    return F.transform(F.array(F.struct(blocks.alias("b"), merged.alias("m"), F.char_length(text).cast("long").alias("n"))), build)[0]


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id", q: float = 0.01, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mask``; spans that touch or overlap become one. Nulls stay null.

    The work grows with the text and the number of its spans, not with their product. Repeated rows are masked
    alike; other columns stay as they are, an empty table gives an empty result.
    """
    found = _found(docs, text, key, q, tuple(docs.columns))
    spans = F.array_sort(F.concat("base", "extra"))
    masked = _without(F.col(f"k_{text}"), _merged(spans), mask)
    return found.select(*[(F.when(F.size(spans) > 0, masked).otherwise(F.col(f"k_{c}")) if c == text else F.col(f"k_{c}")).alias(c) for c in docs.columns])
