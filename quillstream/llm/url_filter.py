"""URL filter: rules, and a blocked Bloom filter before an exact hash join.

Everything is a built-in expression. The Bloom filter consists of blocks of
eight 32-bit words; a canonical URL sets one bit in each word of one block, and
blocks are made by ``bit_or`` sums, so building is an ordinary aggregation. A
filter whose size is under ``BROADCAST_BYTES`` (known from the list's count) is
broadcast; a larger one is joined by block number. URLs that pass go to an exact
hash join with the list, which removes the false positives; all others skip it.

Defined cases: a null URL and one without ``://`` have an empty host and path,
fit no rule and are allowed; rows are judged one by one, so repeated rows get
the same verdict; of equally long rules the first by text wins; a listed URL may
repeat; an empty list blocks nothing and an empty table gives an empty result;
URLs of any length are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import stored

#: Rules of the query: (host, path, verdict). Fixed values.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Parameters of a query string that do not choose a page.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"
#: Labels whose hosts the query lists.
LISTED_LABELS = r"(^|[.-])(casino|bet|bets|ads|adult|porn|pills)([.-]|$)"
KEYS_PER_BLOCK = 16
BLOCK_BYTES = 48
BROADCAST_BYTES = 32 << 20
#: More rules than this would not fit into an expression; use the list instead.
MOST_RULES = 1_000
WORDS = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first scheme separator; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def _raw_host(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*", 0)


def host(url: Column) -> Column:
    return F.coalesce(F.translate(_raw_host(url), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    after = F.substring(_rest(url), F.length(_raw_host(url)) + 1, F.length(url))
    return F.coalesce(F.regexp_extract(after, "^[^?#]*", 0), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www or m, path without a closing slash or index or html
    ending, and the query's other parameters in order; no scheme, no fragment."""
    h = F.regexp_replace(host(url), r"^(www|m)\.", "")
    p = F.regexp_replace(path(url), r"(/index)?(\.html?)?/*$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.concat(h, p, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def ruled(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits best, as text, and its verdict; null where none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES}: list URLs instead")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rh, rp, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        rule, verdict = F.when(fits, rh + rp).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _bits(key: Column) -> list[Column]:
    """One bit of 32 for each word of the block."""
    h = F.xxhash64(key, F.lit(7))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter: block number and its words."""
    words = keys.select(_block(F.col(key), blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(key)))])
    return words.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, canonical of every row.

    ``listed`` has canonical URLs in its column ``canonical``. While list and
    filter are small enough to be broadcast, the pages are read once and nothing
    is shuffled; beyond, only URLs that pass the filter are.
    """
    listed = stored(listed.select("canonical").where(F.col("canonical").isNotNull()).distinct(), "listed")
    size = listed.agg(F.count("*").alias("n"), F.sum(F.octet_length("canonical") + 64).alias("bytes")).first()
    blocks = max(1, size["n"] // KEYS_PER_BLOCK + 1)
    filter_ = bloom(listed, "canonical", blocks).select(*[F.col(c).alias(f"__{c}") for c in ("block", *(f"w{i}" for i in range(WORDS)))])
    if blocks * BLOCK_BYTES <= BROADCAST_BYTES:
        filter_ = F.broadcast(filter_)
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host(url).alias("host"), path(url).alias("path"), canonical(url).alias("canonical"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    probed = rows.withColumns({"rule": rule, "by_rule": verdict}).join(filter_, _block(F.col("canonical"), blocks) == F.col("__block"), "left")
    passes = F.coalesce(reduce(lambda a, b: a & b, [F.col(f"__w{i}").bitwiseAND(b) != 0 for i, b in enumerate(_bits(F.col("canonical")))]), F.lit(False))
    # A rule decides alone; of the other URLs those that pass are looked up.
    asks = F.col("by_rule").isNull() & passes
    probed = probed.select("page_id", "host", "path", "rule", "by_rule", "canonical", F.when(asks, F.col("canonical")).alias("__ask"))
    exact = listed.select(F.col("canonical").alias("__listed"))
    on = F.col("__ask") == F.col("__listed")
    if (size["bytes"] or 0) <= BROADCAST_BYTES:
        found = probed.join(F.broadcast(exact), on, "left")
    else:
        found = probed.where(F.col("__ask").isNotNull()).join(exact, on, "left").unionByName(probed.where(F.col("__ask").isNull()).withColumn("__listed", F.lit(None).cast("string")))
    return found.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("__listed").isNotNull(), "block").otherwise("allow")).alias("verdict"), "canonical")


def listing(pages: DataFrame, labels: str = LISTED_LABELS, url_col: str = "url") -> DataFrame:
    """Canonical URLs seen on hosts with a listed label, as a crawl's feed would give them."""
    url = F.col(url_col)
    return pages.where(host(url).rlike(labels)).select(canonical(url).alias("canonical")).distinct()


SQL = rf"""
WITH a AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path,
         regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM a
), c AS (
  SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, path,
         list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))) AS kept FROM b
), d AS (
  SELECT page_id, host, path, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/index)?(\.html?)?/*$', '')
         || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM c
), listed AS (
  SELECT DISTINCT canonical FROM d WHERE regexp_matches(host, '{LISTED_LABELS}')
), rules(rh, rp, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}
), best AS (
  SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v
  FROM d JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT d.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(v, CASE WHEN d.canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict, d.canonical
FROM d LEFT JOIN best ON d.page_id = best.page_id
"""
