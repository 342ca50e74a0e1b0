"""URL filters: host/path rules, then a list of canonical URLs behind a blocked
Bloom filter.

The list is folded into a Bloom filter of 256-bit blocks (four 64-bit words,
two bits per word and key): ``bit_or`` per block, with map-side combine. A URL
looks at one block only, so probing is one equi-join on the block number. URLs
that pass are *possible* hits; an exact hash join with the list removes the
false positives. Everything is DataFrame expressions.

Sizes: the filter has ``BITS_PER_KEY`` bits a key. Up to ``BROADCAST_BLOCKS``
blocks (about 10 MB) it is broadcast; a longer list joins by shuffle on the
block number, where rows that need no probe are spread by their own id and AQE
splits a block that one hot URL fills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import broadcast_within, lower_ascii, nulls_apart

BITS_PER_KEY = 16
BROADCAST_BLOCKS = 1 << 18
WORDS = 4

#: Fixed values of the query: action, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty for null or no ``://``."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """One spelling of a URL: no scheme, fragment, tracking parameter
    (``utm_*``, ``ref``), leading ``www.`` or ``m.``, or trailing ``/``; host in
    lower case. Null for null or no ``://``."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.concat(F.lit("&"), query), r"&(utm_[a-z]+|ref)=[^&]*", "")
    query = F.regexp_replace(F.regexp_replace(query, r"^&+", "?"), r"[?&]+$", "")
    return F.when(url.contains("://"), F.concat(
        F.regexp_replace(host_of(url), r"^(www|m)\.", ""),
        F.regexp_replace(path_of(url), r"/+$", ""), query))


def rule_of(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """(rule, action) of the longest rule whose host is the URL's or a parent
    domain of it and whose path starts the URL's path; nulls if none fits.
    Ties in length go to the rule listed first."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    longest = sorted(rules or RULES, key=lambda r: len(r[1] + r[2]))
    for act, h, p in sorted(longest, key=lambda r: (len(r[1] + r[2]), -(rules or RULES).index(r))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def _bits(key: Column) -> list[Column]:
    """The four 64-bit words that a key sets in its block."""
    h = F.xxhash64(key, F.lit("bits"))
    out = []
    for i in range(WORDS):
        one = lambda s: F.call_function("shiftleft", F.lit(1).cast("bigint"), (
            F.shiftrightunsigned(h, s).bitwiseAND(F.lit(63))).cast("int"))
        out.append(one(12 * i).bitwiseOR(one(12 * i + 6)))
    return out


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def blocks_for(n_keys: int) -> int:
    return max(1, -(-n_keys * BITS_PER_KEY // (64 * WORDS)))


def bloom(listed: DataFrame, n_blocks: int, key: str = "canonical") -> DataFrame:
    """``block, w0 .. w3``: the filter, one row per block in use."""
    k = F.col(key)
    return (listed.select(_block(k, n_blocks).alias("block"),
                          *[b.alias(f"w{i}") for i, b in enumerate(_bits(k))])
            .groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]))


def filter_urls(pages: DataFrame, listed: DataFrame, rules=None, id_col: str = "page_id",
                url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` for every row of ``pages``.

    A rule decides if one fits. Else the page is blocked if its canonical URL is
    in ``listed`` (one column ``url``), and allowed if not.

    Null or malformed URLs (no ``://``) have an empty host and path, fit no
    rule, are never listed and are allowed. Repeated rows are judged one by one,
    null ids are kept, other columns are ignored; null, malformed and repeated
    list entries do nothing. With no list rows, only rules block."""
    keys = materialize(listed.select(canonical(F.col("url")).alias("canonical"))
                       .where("canonical is not null").distinct(), "url-list")
    n_keys = keys.count()
    n_blocks = blocks_for(n_keys)
    url = F.col(url_col)
    p = pages.select(F.col(id_col).alias("page_id"), url.alias("_url"),
                     host_of(url).alias("host"), path_of(url).alias("path"),
                     canonical(url).alias("canonical"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    p = p.withColumn("rule", rule).withColumn("action", action)
    asks = F.when(F.col("rule").isNull(), F.col("canonical"))
    words = [f"w{i}" for i in range(WORDS)]
    filt = bloom(keys, n_blocks).withColumn("_at", F.concat(F.lit("k"), F.col("block").cast("string")))
    p = p.withColumn("_at", nulls_apart(_block(asks, n_blocks) + F.lit(0) * F.length(asks),
                                        F.struct("page_id", "_url")))
    p = p.join(broadcast_within(filt.drop("block"), n_blocks, BROADCAST_BLOCKS), "_at", "left")
    passes = F.lit(True)
    for w, b in zip(words, _bits(F.col("canonical"))):
        passes = passes & (F.coalesce(F.col(w), F.lit(0)).bitwiseAND(b) == b)
    possible = F.when(passes, asks)
    p = p.withColumn("_key", nulls_apart(possible, F.struct("page_id", "_url"))).drop("_at", *words)
    exact = keys.select(F.concat(F.lit("k"), F.col("canonical")).alias("_key"),
                        F.lit(True).alias("_hit")).hint("shuffle_hash")
    p = p.join(exact, "_key", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return p.select("page_id", "host", "path", "rule",
                    F.coalesce("action", F.when(hit, "block").otherwise("allow")).alias("verdict"),
                    hit.alias("listed"))
