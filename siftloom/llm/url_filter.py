"""URL filters: allow and block rules, then a list of canonical URLs.

Rules are compared first. What no rule decides goes to the list: a blocked
Bloom filter built from the list passes possible hits on to an exact hash join,
which removes the filter's false positives. Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.llm.common import cut

#: Bits of a block are four words of 64 bits; a key sets two bits in each word.
WORDS = 4
#: Blocks at most: 2**20 rows of 48 bytes, which bounds what is broadcast at 50 MB.
MAX_BLOCKS = 1 << 20
BITS_PER_KEY = 16

#: A rule: verdict, host, path.
Rule = tuple[str, str, str]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; '' without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_host(host: Column) -> Column:
    """The host without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"(:[0-9]*)?\.?$", "")


def canonical_path(path: Column) -> Column:
    """The path with runs of ``/`` as one and no final ``/``."""
    return F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", "")


def keys_of(host: Column, path: Column) -> Column:
    """The canonical keys under which a list may hold a URL.

    Each of the host and its parent domains down to two labels, followed by
    ``/`` (the whole host is listed) or by the canonical path.
    """
    labels = F.split(canonical_host(host), r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    here = canonical_path(path)
    return F.array_distinct(F.concat(F.transform(suffixes, lambda h: F.concat(h, F.lit("/"))), F.transform(suffixes, lambda h: F.concat(h, F.when(here == "", "/").otherwise(here)))))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _masks(key: Column) -> list[Column]:
    bits = F.xxhash64(key, F.lit("bits"))

    def bit(i: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int"))

    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def bloom_blocks(keys: DataFrame, key_col: str, n_blocks: int) -> DataFrame:
    """The filter as a table (block, w0..w3) with a row for each block that has a key."""
    key = F.col(key_col)
    masks = keys.select(_block(key, n_blocks).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(_masks(key))))
    return masks.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def blocks_for(n_keys: int) -> int:
    n = 64
    while n * 64 * WORDS < n_keys * BITS_PER_KEY and n < MAX_BLOCKS:
        n *= 2
    return n


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null.

    A rule fits its host and all subdomains where the path starts with the
    rule's path. Of rules of one length the first in the sequence wins.
    """
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(ordered):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def passes(key: Column) -> Column:
    """Whether the words w0..w3 of a key's block have all of its bits; null where there is no block."""
    return reduce(lambda a, b: a & b, (F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(key))))


def without_ids(rows: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is not among the written ids ``gone``; null ids stay.

    Rows that the filter of the ids stops stay where they are; only possible
    hits are shuffled to an exact anti-join.
    """
    n_blocks = blocks_for(gone.count())
    bloom = F.broadcast(bloom_blocks(gone, id_col, n_blocks))
    told = rows.withColumn("_block", _block(F.col(id_col), n_blocks)).join(bloom.withColumnRenamed("block", "_block"), "_block", "left")
    hit = F.coalesce(passes(F.col(id_col)), F.lit(False)) & F.col(id_col).isNotNull()
    clear, doubtful = told.where(~hit).select(*rows.columns), told.where(hit).select(*rows.columns)
    return clear.unionByName(doubtful.join(gone.select(id_col), id_col, "left_anti").select(*rows.columns))


def listed_urls(urls: DataFrame, listed: DataFrame, url_col: str = "url", listed_col: str = "key") -> DataFrame:
    """The distinct values of ``url_col`` that the list holds under one of their keys.

    ``listed_col`` holds canonical keys such as ``spam.example.org/`` or
    ``example.org/en/1``. Nulls on either side match nothing. The filter that is
    broadcast has at most ``MAX_BLOCKS`` rows however long the list is; a list
    too long for it only lets more false positives through to the exact join.
    """
    keys = listed.select(F.col(listed_col).alias("key")).where("key is not null").distinct()
    keys = cut(keys, "listed")
    n_blocks = blocks_for(keys.count())
    bloom = F.broadcast(bloom_blocks(keys, "key", n_blocks))
    asked = urls.select(F.col(url_col).alias("url")).where(F.col("url").contains("://"))
    asked = asked.select("url", F.explode(keys_of(host_of(F.col("url")), path_of(F.col("url")))).alias("key"))
    tested = asked.withColumn("block", _block(F.col("key"), n_blocks)).join(bloom, "block")
    return tested.where(passes(F.col("key"))).select("url", "key").join(keys.hint("shuffle_hash"), "key", "left_semi").select("url").distinct()


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", listed_col: str = "key") -> DataFrame:
    """A row for each row of ``pages``: id, host, path, rule, listed, verdict.

    ``verdict`` is that of the longest fitting rule; where none fits, ``block``
    if the list holds the URL, else ``allow``. A null URL, or one without
    ``://``, has an empty host and path, is never listed and is allowed; ``listed``
    is false where a rule decides. Repeated rows stay; other columns of ``pages`` are
    not looked at. Only URLs that no rule decides are joined with the list's, which
    are written, so that Spark can split the rows of a very frequent URL.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    open_ = F.col("fit").isNull() & F.coalesce(F.col("url").contains("://"), F.lit(False))
    hits = cut(listed_urls(rows.where(open_), listed, "url", listed_col), "hits").withColumn("listed", F.lit(True))
    judged = rows.where(open_).join(hits, "url", "left").unionByName(rows.where(~open_), allowMissingColumns=True)
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("listed", F.lit(False)).alias("listed"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
    )
