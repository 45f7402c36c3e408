"""The registered queries of this folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .urlfilter import LOWER, TRACKING, UPPER, Rule

URL_RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]
#: The list of URLs to block: pages seen over plain http on hosts named after gambling or advertising. It is kept in a
#: form that no page has (upper-case scheme and host, a closing slash, a tracking parameter), so only canonical forms meet.
LISTED_HOSTS = r"^http://[^/?#]*(?:casino|bets|poker|ads-|pills)[^/?#]*"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fertility import fertility

    return fertility(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import judge, respelled

    pages = table(spark, sf_dir, "pages")
    listed = pages.where(F.col("url").rlike(LISTED_HOSTS)).select(respelled(F.col("url")).alias("url"))
    return judge(pages, URL_RULES, listed)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdup import repeats

    return repeats(table(spark, sf_dir, "documents")).select("doc_id", "start_word", "end_word", "n_words")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngramjoin import join

    return join(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def _op2_sql() -> str:
    """Hosts, paths and canonical URLs by regular expressions; the longest rule; the list as a set."""
    rules = sorted(URL_RULES, key=lambda r: (-len(r.name), r.name))
    fits = lambda r: f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
    rule = "case " + " ".join(f"when {fits(r)} then '{r.name}'" for r in rules) + " end"
    verdict = "case " + " ".join(f"when rule = '{r.name}' then '{r.verdict}'" for r in rules) + " when listed then 'block' else 'allow' end"
    return f"""
with cut as (select page_id, coalesce(url, '') as url, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
named as (select page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
  regexp_replace(regexp_replace(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '(?:^|&){TRACKING}=[^&]*', '', 'g'), '^&+', '') as query from cut),
whole as (select *, case when host <> '' then host || regexp_replace(path, '/+$', '') || case when query <> '' then '?' || query else '' end end as c from named),
judged as (select page_id, host, path, {rule} as rule, coalesce(c in (select c from whole where c is not null and regexp_matches(url, '{LISTED_HOSTS}')), false) as listed from whole)
select page_id, host, path, rule, {verdict} as verdict, listed from judged"""


#: Words of documents: letters, marks and digits, lower-cased.
_WORDS = r"select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') as w from documents where text is not null"


def _op9_sql(n: int = 50) -> str:
    """All windows of n words that two documents have, merged where they overlap or touch."""
    return f"""
with words as ({_WORDS}),
windows as (select doc_id, i - 1 as a, md5(array_to_string(w[i:i + {n - 1}], ' ')) as h from (select doc_id, w, unnest(generate_series(1, len(w) - {n - 1})) as i from words where len(w) >= {n})),
shared as (select h from windows group by h having count(distinct doc_id) > 1),
hits as (select distinct doc_id, a from windows where h in (select h from shared)),
marked as (select *, case when a <= lag(a) over (partition by doc_id order by a) + {n} then 0 else 1 end as fresh from hits),
runs as (select *, sum(fresh) over (partition by doc_id order by a) as g from marked)
select doc_id, min(a) as start_word, max(a) + {n} as end_word, max(a) + {n} - min(a) as n_words from runs group by doc_id, g"""


def _op10_sql(k: int = 5, threshold: float = 0.8) -> str:
    """Sets of k-word shingles; all pairs that share one, by exact similarity; classes by walking the links."""
    return f"""
with recursive words as ({_WORDS}),
sets as (select doc_id, list_sort(list_distinct(case when len(w) >= {k} then [array_to_string(w[i:i + {k - 1}], ' ') for i in generate_series(1, len(w) - {k - 1})] else [array_to_string(w, ' ')] end)) as s from words where len(w) > 0),
rows as (select doc_id, md5(array_to_string(s, '|')) as node, s from sets),
nodes as (select node, min(doc_id) as rep, count(*) as n, any_value(s) as s, len(any_value(s)) as size from rows group by node),
entries as (select node, size, unnest(s) as x from nodes),
pairs as (select a.node as a, b.node as b from entries a join entries b on a.x = b.x and a.node <> b.node group by a.node, b.node, a.size, b.size having count(*) >= {threshold} * (a.size + b.size - count(*)) - 1e-9),
walk as (select node, node as reached from nodes union select walk.node, pairs.b from walk join pairs on walk.reached = pairs.a),
classes as (select walk.node, min(rep) as class_id from walk join nodes on nodes.node = walk.reached group by walk.node),
degrees as (select a as node, count(*) as n_links from pairs group by a)
select d.doc_id, coalesce(c.class_id, d.doc_id) as class_id, coalesce(g.n_links, 0) as n_links, coalesce(o.n - 1, 0) as n_copies
from documents d left join rows r on r.doc_id = d.doc_id left join classes c on c.node = r.node left join degrees g on g.node = r.node left join nodes o on o.node = r.node"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against brute force."""
    return {"op2_url_filter": _op2_sql(), "op9_repeats": _op9_sql(), "op10_ngram_join": _op10_sql()}
