"""URL verdicts: prefix rules by host and path, then a list of URLs.

The list is looked up in two steps. A blocked Bloom filter (one 256-bit block
a URL, six bits in it) is built and probed with DataFrame operations; what it
lets through is joined by hash with the list itself, so its false positives
never show. All expressions run in the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits for each listed URL, bits of a block, bits set by a URL.
BITS_PER_URL, WORDS, PROBES = 16, 4, 6
#: A filter up to this size is broadcast; a larger one is joined by block.
BROADCAST_BYTES = 16 << 20
#: Query parameters that say where a visitor came from, not what the page is.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host, path without closing slashes, and query without tracking parameters; null without a host."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(query, rf"(?:^|&){TRACKING}=[^&]*", "")
    query = F.regexp_replace(query, "^&+", "")
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def respelled(url: Column) -> Column:
    """Another spelling of a URL with the same canonical form: upper-case scheme and host, closing slash, tracking parameter first."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return F.concat(F.lit("HTTP://"), F.upper(host_of(url)), path_of(url), F.lit("/?utm_source=list"), F.when(query != "", F.concat(F.lit("&"), query)).otherwise(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, else null; of equal ones the first by name."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        out = F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), r.name).otherwise(out)
    return out


def _masks(url: Column) -> list[Column]:
    """The bits of a URL in the words of its block."""
    h = F.xxhash64(url, F.lit(17))
    places = [F.shiftrightunsigned(h, 8 * i).bitwiseAND(255) for i in range(PROBES)]
    out = []
    for w in range(WORDS):
        word = F.lit(0).cast("long")
        for p in places:
            word = word.bitwiseOR(F.when(F.shiftrightunsigned(p, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(63).cast("int"))).otherwise(F.lit(0).cast("long")))
        out.append(word)
    return out


def bloom(urls: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Blocks ``block, w0 .. w3`` of the filter of distinct ``column``, and their possible number."""
    n = max(1, urls.count())
    blocks = 1 << max(0, math.ceil(math.log2(n * BITS_PER_URL / (64 * WORDS))))
    bits = urls.select(F.pmod(F.xxhash64(column), F.lit(blocks)).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(column)))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, url: str = "url", key: str = "page_id", listed_url: str = "url") -> DataFrame:
    """One row per row of ``pages``: ``key, host, path, rule, verdict, listed``.

    A rule decides where one fits; elsewhere listed URLs are blocked and
    others allowed. URLs are compared in canonical form. A null URL, or one
    without ``://``, has an empty host and path, fits no rule, is never
    listed and is allowed. Repeated rows and repeated listings change
    nothing. Other columns are ignored. Empty tables give an empty result, or an empty list.
    """
    names = written(listed.select(canonical(F.col(listed_url)).alias("c")).where("c is not null").distinct(), "listed")
    blocks, number = bloom(names, "c")
    small = number * (WORDS + 1) * 8 <= BROADCAST_BYTES
    rows = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("u"))
    rows = rows.select("id", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"), canonical(F.col("u")).alias("c"))
    # A URL without a host gets a block of its own, so that such rows do not gather.
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.coalesce("c", F.col("id").cast("string"))), F.lit(number)))
    probed = rows.join(F.broadcast(blocks) if small else blocks, "block", "left")
    hit = F.col("c").isNotNull()
    for i, m in enumerate(_masks(F.col("c"))):
        hit = hit & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(m) == m)
    probed = written(probed.select("id", "host", "path", "c", hit.alias("maybe")), "probed")
    exact = probed.where("maybe").join(names.withColumn("yes", F.lit(True)).hint("shuffle_hash"), "c", "left").select("id", "host", "path", F.coalesce("yes", F.lit(False)).alias("listed"))
    rest = probed.where("not maybe").select("id", "host", "path", F.lit(False).alias("listed"))
    out = exact.union(rest).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("listed"), "block").otherwise("allow")
    for r in rules:
        verdict = F.when(F.col("rule") == r.name, r.verdict).otherwise(verdict)
    return out.select(F.col("id").alias(key), "host", "path", "rule", verdict.alias("verdict"), "listed")
