"""Sitemaps: reading them, and walking from robots rules through indexes to the product URLs, over documents that were fetched before.

The walk goes level by level: a level's sitemaps meet the documents by their URL, their children go on to the next level unless
the shop has seen them, by an anti-join, so that indexes that name each other end. Each level is written to the shared folder;
there are as many as indexes are nested. Shops are walked together, and no shop's URLs are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import ids, web
from larkspur.shared import written
from larkspur.sources.star import table

ENTRY = "struct<loc:string,lastmod:string,changefreq:string,priority:double>"


def _value(block: Column, tag: str) -> Column:
    """The text of the first element of that name in a block; null if it is missing or empty."""
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?is)<{tag}>\s*(.*?)\s*</{tag}>", 1)), F.lit(""))


def _plain(loc: Column) -> Column:
    out = F.regexp_replace(loc, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(out)


def parse_sitemap(xml: Column) -> Column:
    """struct(kind, entries): kind is index, urlset or unknown; entries are the children of an index, else the URLs, in order.

    A document without whole elements gives the bare `<loc>` elements that it has. Null is unknown.
    """
    text = F.coalesce(xml, F.lit(""))
    is_index = text.rlike(r"(?i)<sitemapindex\b|<sitemap>\s*<loc>")
    blocks = F.when(is_index, F.regexp_extract_all(text, F.lit(r"(?is)<sitemap\b[^>]*>(.*?)</sitemap>"), F.lit(1))).otherwise(F.regexp_extract_all(text, F.lit(r"(?is)<url\b[^>]*>(.*?)</url>"), F.lit(1)))
    entry = lambda b: F.struct(_plain(_value(b, "loc")).alias("loc"), _value(b, "lastmod").alias("lastmod"), F.when(~is_index, _value(b, "changefreq")).alias("changefreq"), F.when(~is_index, _value(b, "priority").try_cast("double")).alias("priority"))
    whole = F.filter(F.transform(blocks, entry), lambda e: e["loc"].isNotNull() & (e["loc"] != ""))
    none = F.lit(None).cast("string")
    bare = F.transform(F.regexp_extract_all(text, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda x: F.struct(_plain(x).alias("loc"), none.alias("lastmod"), none.alias("changefreq"), F.lit(None).cast("double").alias("priority")))
    found = F.when(F.size(whole) > 0, whole).otherwise(F.filter(bare, lambda e: e["loc"] != ""))
    kind = F.when(is_index, "index").when(F.size(found) > 0, "urlset").otherwise("unknown")
    return F.struct(kind.alias("kind"), found.cast(f"array<{ENTRY}>").alias("entries"))


def robots_sitemaps(robots: Column) -> Column:
    """URLs of the `sitemap:` lines of a robots file, in order."""
    return F.regexp_extract_all(F.coalesce(robots, F.lit("")), F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)"), F.lit(1))


def walk_sitemaps(robots: DataFrame, documents: DataFrame, *, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), max_sitemaps: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(urls, sitemaps) of each shop. robots: shop_id, robots; documents: url, body.

    urls: shop_id, url (canonical), url_key, lastmod, sitemap: product URLs, each key of a shop once, from the first sitemap of the
    walk that has it. sitemaps: shop_id, url, level, kind (missing if there is no such document), n_entries. The walk is in the order
    of levels, then of the places in the documents before; with max_sitemaps each shop reads so many at most. Of documents with
    one URL the least body counts; null shops are a shop.
    """
    bodies = documents.where("url IS NOT NULL").groupBy("url").agg(F.min("body").alias("body"))
    roots = robots.select("shop_id", F.posexplode(robots_sitemaps(F.col("robots"))).alias("at", "url"))
    once = lambda df: df.groupBy("shop_id", "url").agg(F.min("order").alias("order"))
    front = once(roots.select("shop_id", "url", F.array(F.col("at").cast("long")).alias("order")))
    read, level, seen = [], 0, None
    while True:
        here = front if seen is None else front.join(seen, (front.url == seen.seen_url) & front.shop_id.eqNullSafe(seen.seen_shop), "left_anti")
        found = here.join(bodies, "url", "left").select("shop_id", "url", "order", F.lit(level).alias("level"), F.col("body").isNull().alias("missing"), parse_sitemap(F.col("body")).alias("s"))
        now = written(found.select("shop_id", "url", "order", "level", F.when(F.col("missing"), "missing").otherwise(F.col("s.kind")).alias("kind"), "s.entries"), "sitemaps")
        if now.isEmpty():
            break
        read.append(now)
        names = now.select(F.col("shop_id").alias("seen_shop"), F.col("url").alias("seen_url"))
        seen = names if seen is None else seen.unionByName(names)
        inner = now.where("kind = 'index'").select("shop_id", "order", F.posexplode("entries").alias("at", "e"))
        front = once(inner.select("shop_id", F.col("e.loc").alias("url"), F.concat("order", F.array(F.col("at").cast("long"))).alias("order")))
        level += 1
    every = now
    for one in read:
        every = every.unionByName(one)
    if max_sitemaps is not None:
        k = F.row_number().over(Window.partitionBy("shop_id").orderBy("level", "order"))
        every = every.withColumn("k", k).where(F.col("k") <= max_sitemaps).drop("k")
    listed = every.where("kind = 'urlset'").select("shop_id", "level", "order", F.col("url").alias("sitemap"), F.posexplode("entries").alias("at", "e"))
    listed = listed.where(web.is_product_url(F.col("e.loc"), include, exclude)).select("shop_id", ids.canonical_url(F.col("e.loc")).alias("url"), ids.url_key(F.col("e.loc")).alias("url_key"), F.col("e.lastmod").alias("lastmod"), "sitemap", "level", "order", "at")
    first = listed.groupBy("shop_id", "url_key").agg(F.min_by(F.struct("url", "lastmod", "sitemap"), F.struct("level", "order", "at")).alias("f"))
    return first.select("shop_id", "f.url", "url_key", "f.lastmod", "f.sitemap"), every.select("shop_id", "url", "level", "kind", F.size("entries").alias("n_entries"))


#: Of the derived documents: shops, and URLs of a sitemap.
SHOPS, PART = 20, 3


def fetched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Robots files and sitemap documents for the paths of `pages`, page by page dealt to SHOPS shops, PART URLs a sitemap.

    A shop's index names its sitemaps and a second index, which names the first one again, a sitemap that is named already, one
    that is missing, and one of bare `<loc>` elements.
    """
    k = F.col("page_id")
    paths = table(spark, sf_dir, "pages").where("url IS NOT NULL").select((k % SHOPS).alias("shop_id"), k, F.floor(k / SHOPS / PART).alias("part"), web.path(F.col("url")).alias("path"))
    site = F.concat(F.lit("https://s"), "shop_id", F.lit(".example"))
    kind = F.get(F.array(*map(F.lit, ("/termek", "/Product", "/kategoria", "", "/blog"))), (k % 5).cast("int"))
    loc = F.concat(F.when(k % 7 == 0, F.upper(site)).otherwise(site), F.lit(":443"), kind, F.regexp_replace("path", "&", "&amp;"), F.when(k % 3 == 0, "/?utm_source=x&amp;b=2").otherwise(""))
    block = F.concat(F.lit("<url><loc>"), F.when(k % 4 == 0, F.concat(F.lit("<![CDATA["), loc, F.lit("]]>"))).otherwise(F.concat(F.lit("\n "), loc, F.lit(" "))), F.lit("</loc>"), F.when(k % 2 == 0, F.concat(F.lit("<lastmod>2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("</lastmod>"))).otherwise(""), F.lit("</url>"))
    parts = paths.groupBy("shop_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, block.alias("b")))), lambda x: x["b"]), "").alias("blocks"))
    urlsets = parts.select(F.concat(site, F.lit("/part-"), "part", F.lit(".xml")).alias("url"), F.concat(F.lit("<urlset>"), "blocks", F.lit("</urlset>")).alias("body"))
    child = lambda name: F.concat(F.lit("<sitemap><loc>"), site, F.lit(f"/{name}.xml</loc></sitemap>"))
    numbers = parts.groupBy("shop_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: F.concat(F.lit("<sitemap><loc>"), site, F.lit("/part-"), p, F.lit(".xml</loc></sitemap>"))), "").alias("parts"))
    index = numbers.select(F.concat(site, F.lit("/index.xml")).alias("url"), F.concat(F.lit("<sitemapindex>"), "parts", child("more"), F.lit("</sitemapindex>")).alias("body"))
    more = numbers.select(F.concat(site, F.lit("/more.xml")).alias("url"), F.concat(F.lit("<sitemapindex>"), child("index"), child("part-0"), child("gone"), child("bare"), F.lit("</sitemapindex>")).alias("body"))
    bare = numbers.select(F.concat(site, F.lit("/bare.xml")).alias("url"), F.concat(F.lit("<html><loc>"), site, F.lit("/termek/bare</loc><loc>"), site, F.lit("/kosar/</loc>")).alias("body"))
    robots = numbers.select("shop_id", F.concat(F.lit("User-agent: *\nDisallow: /x\n  SiteMap :  "), site, F.lit("/index.xml\r\nsitemap: "), site, F.lit("/index.xml")).alias("robots"))
    return robots, urlsets.unionByName(index).unionByName(more).unionByName(bare)


def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk_sitemaps(*fetched(spark, sf_dir))[0]


def sitemap_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk_sitemaps(*fetched(spark, sf_dir))[1]


QUERIES = {"sitemap_urls": sitemap_urls, "sitemap_walk": sitemap_walk}
#: From the pages alone: what the shops' documents are meant to list.
_PATHS = rf"""p AS (SELECT page_id, page_id % {SHOPS} AS shop_id, page_id // {SHOPS * PART} AS part, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages WHERE url IS NOT NULL)"""
ORACLES = {
    "sitemap_urls": rf"""WITH {_PATHS},
        w AS (SELECT *, ['/termek', '/Product', '/kategoria', '', '/blog'][1 + page_id % 5] AS kind, 's' || shop_id || '.example' AS host FROM p),
        c AS (SELECT shop_id, page_id, part, host || rtrim(kind || path, '/') || CASE WHEN page_id % 3 = 0 THEN '?b=2' ELSE '' END AS rest, CASE WHEN page_id % 2 = 0 THEN '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') END AS lastmod FROM w WHERE page_id % 5 IN (0, 1, 3)),
        f AS (SELECT *, row_number() OVER (PARTITION BY shop_id, lower(rest) ORDER BY page_id) AS k FROM c)
        SELECT shop_id, 'https://' || rest AS url, lower(rest) AS url_key, lastmod, 'https://s' || shop_id || '.example/part-' || part || '.xml' AS sitemap FROM f WHERE k = 1
        UNION ALL SELECT DISTINCT shop_id, 'https://s' || shop_id || '.example/termek/bare', 's' || shop_id || '.example/termek/bare', NULL, 'https://s' || shop_id || '.example/bare.xml' FROM p""",
    "sitemap_walk": rf"""WITH {_PATHS}, shops AS (SELECT shop_id, count(DISTINCT part) AS n FROM p GROUP BY shop_id), s AS (SELECT *, 'https://s' || shop_id || '.example/' AS site FROM shops)
        SELECT shop_id, 'https://s' || shop_id || '.example/part-' || part || '.xml' AS url, 1 AS level, 'urlset' AS kind, CAST(count(*) AS INTEGER) AS n_entries FROM p GROUP BY shop_id, part
        UNION ALL SELECT shop_id, site || 'index.xml', 0, 'index', CAST(n + 1 AS INTEGER) FROM s UNION ALL SELECT shop_id, site || 'more.xml', 1, 'index', 4 FROM s
        UNION ALL SELECT shop_id, site || 'gone.xml', 2, 'missing', 0 FROM s UNION ALL SELECT shop_id, site || 'bare.xml', 2, 'urlset', 2 FROM s""",
}
