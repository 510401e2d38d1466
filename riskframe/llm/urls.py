"""URL filter: host rules, then a blocked Bloom filter before an exact join.

The list may be large. Its canonical URLs set bits in a blocked Bloom filter
(one block of 512 bits per URL, one bit in each of its eight words), a table
whose size is fixed by ``blocks``. Pages that hit all eight bits may be listed;
only these go to an exact hash join with the list, which removes the false
positives. A list too long for the filter only sends more pages to the join.

Defined cases: a null url, or one without ``://``, has an empty host and path
and is never listed; repeated rows are judged each; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8
#: Blocks of the filter: 32,768 x 64 bytes = 2 MB, whatever the list's length.
BLOCKS = 1 << 15
#: Query parameters that do not change the page.
TRACKING = "^(utm_[a-z]+|ref)="

Rule = tuple[str, str, str]


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, sorted query without tracking; null if there is no host."""
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    joined = F.array_join(kept, "&")
    return F.when(
        F.instr(url, "://") > 0,
        F.concat(
            F.regexp_replace(host_of(url), r"^www\.", ""),
            F.regexp_replace(path_of(url), r"/+$", ""),
            F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit("")),
        ),
    )


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest (verdict, host, path) rule that fits, else null."""
    found = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        hit = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, hit) if found is None else found.when(fits, hit)
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return none if found is None else found.otherwise(none)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("bigint")).alias("block")


def _masks(key: Column) -> list[Column]:
    """One bit in each of the words, from 6 bits each of a second hash."""
    second = F.xxhash64(F.lit(1), key)
    bits = [F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), b) for b in bits]


def bloom_filter(listed: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """The blocked filter as a table: ``block`` and its words; at most ``blocks`` rows."""
    masks = [m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))]
    return (
        listed.where(F.col(key).isNotNull())
        .select(_block(F.col(key), blocks), *masks)
        .groupBy("block")
        .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    )


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[Rule] = (),
    page_id: str = "page_id",
    url: str = "url",
    listed_url: str = "url",
    blocks: int = BLOCKS,
) -> DataFrame:
    """One row per page: id, url, host, path, rule, listed, verdict.

    A rule's verdict wins; pages without a rule are blocked if their canonical
    url is in ``listed``. Pass a stored table as ``listed``: it is read twice.
    """
    keys = listed.select(canonical(F.col(listed_url)).alias("key")).where("key is not null").distinct()
    words = bloom_filter(keys, "key", blocks)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumns({
        "by_rule": longest_rule(F.col("host"), F.col("path"), rules),
        "key": canonical(F.col("url")),
    })
    probe = [(F.col(f"w{i}").bitwiseAND(m) != 0) for i, m in enumerate(_masks(F.col("key")))]
    hit = probe[0]
    for p in probe[1:]:
        hit = hit & p
    # The filter's size is fixed by `blocks`, not by the data.
    rows = (
        rows.withColumn("block", _block(F.col("key"), blocks))
        .join(F.broadcast(words), "block", "left")
        .withColumn("possible", F.coalesce(hit & F.col("key").isNotNull(), F.lit(False)))
    )
    columns = ["page_id", "url", "host", "path", "by_rule"]
    clean = rows.where(~F.col("possible")).select(*columns, F.lit(False).alias("listed"))
    exact = keys.withColumn("found", F.lit(True)).hint("shuffle_hash")
    checked = rows.where("possible").join(exact, "key", "left")
    both = clean.unionByName(checked.select(*columns, F.coalesce("found", F.lit(False)).alias("listed")))
    return both.select(
        "page_id",
        "url",
        "host",
        "path",
        F.col("by_rule.rule").alias("rule"),
        "listed",
        F.coalesce(
            F.col("by_rule.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
        ).alias("verdict"),
    )
