"""Identifiers: hashes of identities, article numbers and URLs, as Column builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import search_norm


def part(value: Column, kind: str = "text") -> Column:
    """One part of a key: normalized text, a number as it is, 1 or 0; ~ where there is none."""
    if kind == "number":
        out = value.cast("string")
    elif kind == "flag":
        out = F.when(value, "1").when(~value, "0")
    elif kind == "list":
        out = F.nullif(F.array_join(F.array_sort(F.transform(value, search_norm)), "+"), F.lit(""))
    else:
        out = F.nullif(search_norm(value), F.lit(""))
    return F.coalesce(out, F.lit("~"))


def key_hash(version: str, parts: Sequence[Column]) -> Column:
    """The first 40 hexadecimal digits of the parts' SHA-256, joined by bars behind the version."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(version), *parts).cast("binary"), 256), 1, 40)


#: Fields of an identity in the order in which they are hashed, and their kinds.
IDENTITY_PARTS = (
    ("platform_product_id", "text"), ("platform_variant_id", "text"), ("producer_or_brand", "text"), ("brand", "text"), ("expression", "text"), ("vintage_value", "number"),
    ("vintage_status", "text"), ("age_years", "number"), ("volume_ml", "number"), ("pack_count", "number"), ("packaging", "text"), ("edition", "text"), ("cask_finish", "text"),
    ("dosage", "text"), ("puttony", "number"), ("gtin", "text"), ("grape_signature", "text"), ("style_id", "text"), ("vineyard_id", "text"),
)
CANONICAL_PARTS = (
    ("producer_key", "text"), ("grape_signature", "text"), ("style_or_colour", "text"), ("vintage_value", "number"), ("vintage_status", "text"), ("age_years", "number"),
    ("volume_ml", "number"), ("pack_count", "number"), ("packaging", "text"), ("vineyard_id", "text"), ("edition", "text"), ("puttony", "number"),
)


def identity_hash(columns: dict[str, Column]) -> Column:
    return key_hash("v3", [part(columns.get(name, F.lit(None)), kind) for name, kind in IDENTITY_PARTS])


def canonical_key(columns: dict[str, Column]) -> Column:
    return key_hash("ck1", [part(columns.get(name, F.lit(None)), kind) for name, kind in CANONICAL_PARTS])


def signature(names: Column) -> Column:
    """Distinct normalized names in order, joined by +; null where there are none."""
    norm = F.filter(F.transform(names, search_norm), lambda x: x != "")
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(norm)), "+"), F.lit(""))


def gtin(raw: Column) -> Column:
    """Digits of an article number of eight or more: twelve get a zero in front, of more than fourteen the last ones stay."""
    d = F.regexp_replace(raw, r"\D", "")
    n = F.length(d)
    return F.when(n == 12, F.concat(F.lit("0"), d)).when(n > 14, F.substring(d, -14, 14)).when(n >= 8, d)


def gtin_equal(a: Column, b: Column) -> Column:
    return F.coalesce(F.ltrim(gtin(a), F.lit("0")) == F.ltrim(gtin(b), F.lit("0")), F.lit(False))


# Query parameters that only track visitors.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|msclkid|dclid|yclid|mc_cid|mc_eid|_ga|ref|referrer|source|srsltid|igshid)="


def url_parts(url: Column) -> tuple[Column, Column, Column, Column]:
    """Scheme, host with port, path and query, all as they stand but for a lower-case scheme and host."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1))
    return scheme, host, F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Lower-case host without its default port, single slashes, no closing slash or fragment, sorted query without tracking."""
    scheme, host, path, query = url_parts(url)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(path, "/{2,}", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(F.lit("/"))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(scheme, F.lit("://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def url_key(url: Column) -> Column:
    """Host without www., path and query of the canonical URL, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(canonical_url(url), r"^[a-z][a-z0-9+.-]*://", ""), r"^www\.", ""))


def slug(url: Column) -> Column:
    """The last part of the path."""
    _, _, path, _ = url_parts(url)
    return F.regexp_extract(path, r"([^/]*)/*$", 1)
