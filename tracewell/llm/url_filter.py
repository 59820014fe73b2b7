"""URL filtering with a blocked Bloom filter before an exact hash join.

Listed URLs are canonicalised and hashed to one 512-bit block each, in which they set one bit of
every 64-bit word. A page whose bits are all set is a possible hit; only possible hits take part in
the exact join on the canonical URL, which removes the false positives. The filter holds 16 bits
for each listed URL and is broadcast as long as its exact size stays below `BROADCAST_BYTES`; a larger one
is joined by block number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import ascii_lower, settle

WORDS, BITS_PER_URL, BROADCAST_BYTES = 8, 16, 64 << 20


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and query of a URL; all empty without `://` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise(F.lit(""))
    pick = lambda pattern: F.regexp_extract(rest, pattern, 1)
    return ascii_lower(pick(r"^([^/?#]*)")), pick(r"^[^/?#]*([^?#]*)"), pick(r"^[^?#]*\?([^#]*)")


def canonical(host: Column, path: Column, query: Column) -> Column:
    """Host, path without trailing slashes, and the query's sorted parameters but for utm_* and ref."""
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref)(=|$)")))
    return F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _bits(url: Column) -> list[Column]:
    h = F.xxhash64(F.lit(1), url)
    return [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """Blocked Bloom filter of listed.url: (block, w0..w7)."""
    one = lambda bit: F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return listed.groupBy(F.pmod(F.xxhash64("url"), F.lit(blocks)).alias("block")).agg(*[F.bit_or(one(b)).alias(f"w{i}") for i, b in enumerate(_bits(F.col("url")))])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Judge every row of `pages` (page_id, url; others are ignored).

    `listed` has a column url of URLs to block, in any spelling that canonicalises alike; `rules` is a short list of
    (verdict, host, path prefix), which override the list for a host and its subdomains, longest
    rule first. Returns page_id, host, path, rule, verdict, listed. A null url, or one without `://`,
    has empty host and path, is never listed and is allowed. Repeated pages are judged alike.
    """
    host, path, query = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), canonical(host, path, query).alias("canon"))
    wanted = settle(listed.select(canonical(*parts(F.col("url"))).alias("url")).where("url <> ''").distinct())
    blocks = max(1, -(-wanted.count() * BITS_PER_URL // (64 * WORDS)))
    bits = bloom(wanted, blocks)
    if blocks * (WORDS + 1) * 8 <= BROADCAST_BYTES:
        bits = F.broadcast(bits)
    probed = rows.withColumn("block", F.pmod(F.xxhash64("canon"), F.lit(blocks))).join(bits, "block", "left")
    test = lambda i, b: F.call_function("shiftright", F.col(f"w{i}"), b).bitwiseAND(F.lit(1)) == 1
    possible = F.lit(True)
    for i, b in enumerate(_bits(F.col("canon"))):
        possible = possible & test(i, b)
    probed = settle(probed.select("page_id", "host", "path", "canon", F.coalesce(possible, F.lit(False)).alias("possible")))
    hits = probed.where("possible").join(wanted.select(F.col("url").alias("canon"), F.lit(True).alias("listed")), "canon", "left")
    out = ["page_id", "host", "path", F.coalesce("listed", F.lit(False)).alias("listed")]
    judged = hits.select(*out).unionByName(probed.where("not possible").select("page_id", "host", "path", F.lit(False).alias("listed")))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("listed"), "block").otherwise("allow")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "listed")
