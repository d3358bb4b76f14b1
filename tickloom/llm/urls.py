"""URL filters: host and path rules, then a blocked Bloom filter with an exact join behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

BITS_PER_URL, WORDS = 16, 4
#: Blocks up to which the filter is broadcast: 40 MB, for 16 million listed urls.
MOST_BLOCKS = 1_000_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def canonical_url(url: Column) -> Column:
    """Host without a leading www. and path without its trailing slash or .html; scheme, query and fragment go."""
    host, path = url_parts(url)
    return F.concat(F.regexp_replace(host, "^www\\.", ""), F.regexp_replace(path, "(/|\\.html)$", ""))


def _word_bit(key: Column, i: int) -> Column:
    return F.shiftright(F.xxhash64(key, F.lit(i)), 7).bitwiseAND(F.lit(63)).cast("int")


def _bit(key: Column, i: int) -> Column:
    """One bit of 64 as a long, i-th word of the block."""
    return F.element_at(F.array(*[F.lit(1 << n if n < 63 else -(1 << 63)) for n in range(64)]), _word_bit(key, i) + 1)


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w3): one row per block of 256 bits that any listed key sets; each key sets one bit in each word."""
    key = F.col("key")
    return (
        listed.select(F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("block"), *[_bit(key, i).alias(f"w{i}") for i in range(WORDS)])
        .groupBy("block")
        .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    )


def split_by_filter(rows: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` whose `key` may be among the keys of `listed`, and all others, which is decided without shuffling a row.

    Up to MOST_BLOCKS blocks, 5 longs each, the filter is sent to every task;
    a longer one is joined by block, which spreads keys evenly. A null or
    empty key is never listed.
    """
    n_blocks = max(1, -(-listed.count() * BITS_PER_URL // (64 * WORDS)))
    blocks = checkpointed(bloom_blocks(listed, n_blocks).select(F.struct("block", *[f"w{i}" for i in range(WORDS)]).alias("bloom")))
    if n_blocks <= MOST_BLOCKS:
        blocks = F.broadcast(blocks)
    key, bloom = F.col("key"), F.col("bloom")
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (bloom[f"w{i}"].bitwiseAND(_bit(key, i)) != 0)
    asked = (key != "") & (F.pmod(F.xxhash64(key), F.lit(n_blocks)) == bloom["block"])
    probed = rows.join(blocks, asked, "left").withColumn("possible", F.coalesce(hit, F.lit(False)))
    return probed.where("possible").select(rows.columns), probed.where("not possible").select(rows.columns)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of `pages`.

    `rules`: (allow or block, host, path prefix). A rule fits its host and
    its subdomains where the path starts with the prefix; of those that fit,
    the longest decides. Without a rule a url is blocked if its canonical
    form is in `listed` (a column url), else allowed. A null url, or one
    without ://, has an empty host and path, no rule, and is allowed. Equal
    rows stay as often as they come.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), canonical_url(F.col(url_col)).alias("key"))
    listed = listed.select(canonical_url(F.col("url")).alias("key")).where(F.col("key") != "")
    listed = checkpointed(listed.distinct())
    possible, others = split_by_filter(rows, listed)
    exact = possible.join(listed.withColumn("is_listed", F.lit(True)), "key", "left")
    rows = exact.select(*rows.columns, "is_listed").unionByName(others.withColumn("is_listed", F.lit(None).cast("boolean")))
    rule, act = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, r_host, r_path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == r_host) | F.col("host").endswith(f".{r_host}")) & F.col("path").startswith(r_path)
        rule, act = F.when(fits, F.lit(r_host + r_path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(act)
    own = F.when(F.col("is_listed"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(act, own).alias("verdict"))
