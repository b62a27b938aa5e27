"""Verdicts on URLs: host and path rules first, then a list of blocked URLs.

The list may have any size. Its canonical URLs set bits in a blocked Bloom filter (one 64-bit word a block, `BITS` bits
a URL) whose number of blocks is a parameter, so that its broadcast has a proven bound. Rows whose bits are all set are
possible hits; only those go on to an exact hash join with the list, which removes the false positives. A fuller filter
passes more rows to that join and changes no result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import lower_ascii

BITS = 6
#: 2**16 blocks: half a megabyte of words; its largest broadcast is about 2 MB.
BLOCKS = 1 << 16
#: Query parameters that say where a visitor came from, not what the page is.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)="


@dataclass(frozen=True)
class Rule:
    """allow or block a host and its subdomains, for paths that start with path."""

    action: str
    host: str
    path: str

    def __post_init__(self) -> None:
        if self.action not in ("allow", "block"):
            raise ValueError(f"unknown action {self.action}")

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is none."""
    return F.when(F.instr(url, "://") > 0, lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty where there is no host part."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def canonical(url: Column) -> Column:
    """Host without `www.` and default ports, path without a closing slash, sorted query without tracking; no fragment.

    Null and URLs without `://` give the empty text.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))).otherwise("")


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, action) of the longest rule that fits, or null. The first given wins among equally long ones."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for r in reversed(sorted(rules, key=lambda r: -len(r.text))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"))).otherwise(out)
    return out


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks))


def bits(h: Column) -> Column:
    """A word with BITS bits of the hash set: six bits of it name each."""
    out = F.lit(0).cast("long")
    for i in range(BITS):
        at = F.shiftrightunsigned(h, 16 + 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return out


def bloom(keys: Column, listed: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """The blocked filter of a key column: (block, word), one row for each block that has any bit."""
    h = F.xxhash64(keys)
    return listed.select(_block(h, blocks).alias("_block"), bits(h).alias("_word")).groupBy("_block").agg(F.bit_or("_word").alias("_word"))


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], *, url: str = "url", listed_url: str = "url", blocks: int = BLOCKS) -> DataFrame:
    """pages with host, path, canonical_url, rule, listed and verdict.

    A fitting rule decides; else the list does: block where the canonical URL is listed, allow where it isn't. URLs that
    are null or have no `://` are never listed and are allowed. Repeated rows of either table change nothing; empty
    tables are fine. Columns of pages with these names are replaced; any other name may be there.
    """
    known = listed.select(canonical(F.col(f"`{listed_url}`")).alias("_listed")).where("_listed <> ''").distinct()
    u, names = F.col(f"`{url}`"), ("host", "path", "canonical_url", "rule", "listed", "verdict")
    own = [c for c in pages.columns if c not in names]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), host_of(u).alias("host"), path_of(u).alias("path"), canonical(u).alias("canonical_url"))
    rows = rows.withColumns({"fits": rule_for(F.col("host"), F.col("path"), rules), "h": F.xxhash64("canonical_url")})
    rows = rows.withColumn("_block", _block(F.col("h"), blocks)).join(F.broadcast(bloom(F.col("_listed"), known, blocks)), "_block", "left")
    wanted = bits(F.col("h"))
    rows = rows.withColumn("maybe", F.coalesce(F.col("_word").bitwiseAND(wanted) == wanted, F.lit(False)) & (F.col("canonical_url") != ""))
    hits = rows.where("maybe").join(known, F.col("canonical_url") == F.col("_listed"), "left").withColumn("listed", F.col("_listed").isNotNull()).drop("_listed")
    out = hits.unionByName(rows.where("NOT maybe").withColumn("listed", F.lit(False)))
    verdict = F.coalesce(F.col("fits.action"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*[F.col("row")[c].alias(c) for c in own], "host", "path", "canonical_url", F.col("fits.rule").alias("rule"), "listed", verdict.alias("verdict"))
