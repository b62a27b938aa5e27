"""Sitemap documents and walks by hand; the derived documents are held against SQL in test_queries."""

from pyspark.sql import functions as F

from larkspur.operators import sitemaps

DOCUMENTS = {
    "﻿<urlset><url><loc> https://a/1 </loc><lastmod>2024</lastmod><changefreq>daily</changefreq><priority>0.5</priority></url><url><loc>https://a/2?x=1&amp;y=2</loc><priority>high</priority></url><url><lastmod>x</lastmod></url></urlset>":
        ("urlset", [("https://a/1", "2024", "daily", 0.5), ("https://a/2?x=1&y=2", None, None, None)]),
    "<SITEMAPINDEX xmlns='x'><sitemap><loc><![CDATA[https://a/s.xml]]></loc><lastmod>1</lastmod></sitemap><sitemap></sitemap></SITEMAPINDEX>": ("index", [("https://a/s.xml", "1", None, None)]),
    "<sitemap><loc>https://a/t</loc>": ("index", [("https://a/t", None, None, None)]), "<sitemapindex/>": ("index", []),
    "<html><loc>b</loc> <LOC>\nc\n</LOC><loc></loc>": ("urlset", [("b", None, None, None), ("c", None, None, None)]), "nothing": ("unknown", []), "": ("unknown", []), None: ("unknown", []),
}


def test_documents(spark):
    got = spark.createDataFrame([(d,) for d in DOCUMENTS], "xml string").select("xml", sitemaps.parse_sitemap(F.col("xml")).alias("s")).collect()
    assert {r["xml"]: (r["s"]["kind"], [tuple(e) for e in r["s"]["entries"]]) for r in got} == DOCUMENTS


def test_robots(spark):
    text = "User-agent: *\n sitemap: https://a/x\r\nSITEMAP :https://a/y # z\nnositemap: q\nSitemap:\n"
    row = spark.createDataFrame([(text,)], "t string").select(sitemaps.robots_sitemaps(F.col("t")).alias("s"), sitemaps.robots_sitemaps(F.lit(None).cast("string")).alias("n")).first()
    assert row["s"] == ["https://a/x", "https://a/y"] and row["n"] == []


def index(*names):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{n}</loc></sitemap>" for n in names) + "</sitemapindex>"


def urls(*names):
    return "<urlset>" + "".join(f"<url><loc>https://shop/{n}</loc></url>" for n in names) + "</urlset>"


def test_walk(spark):
    robots = spark.createDataFrame([("s", "sitemap: a\nsitemap: b"), ("t", "sitemap: b"), ("u", "none"), (None, "sitemap: d")], "shop_id string, robots string")
    documents = spark.createDataFrame(
        [("a", index("c", "a", "b", "c", "e")), ("b", index("d", "a")), ("c", urls("product/1", "PRODUCT/1", "cart/2")), ("d", urls("product/1?utm_source=x", "product/3", "blog/4")), ("d", urls("product/9")), (None, "x")], "url string, body string")
    found, walked = sitemaps.walk_sitemaps(robots, documents)
    levels = {(r["shop_id"], r["url"]): (r["level"], r["kind"], r["n_entries"]) for r in walked.collect()}
    own = {"a": (0, "index", 5), "b": (0, "index", 2), "c": (1, "urlset", 3), "e": (1, "missing", 0), "d": (1, "urlset", 3)}
    assert {u: x for (s, u), x in levels.items() if s == "s"} == own
    assert {u: x[0] for (s, u), x in levels.items() if s == "t"} == {"b": 0, "d": 1, "a": 1, "c": 2, "e": 2} and (None, "d") in levels and len(levels) == 11
    got = {(r["shop_id"], r["url_key"]): (r["url"], r["sitemap"]) for r in found.collect()}
    assert got["s", "shop/product/1"] == ("https://shop/product/1", "c") and got["t", "shop/product/1"] == ("https://shop/product/1", "d")
    assert set(got) == {(s, f"shop/product/{n}") for s in ("s", "t") for n in (1, 3)} | {(None, "shop/product/1"), (None, "shop/product/3")}
    few = sitemaps.walk_sitemaps(robots.where("shop_id = 's'"), documents, max_sitemaps=3)
    assert {r["url"] for r in few[1].collect()} == {"a", "b", "c"} and {r["url_key"] for r in few[0].collect()} == {"shop/product/1"}
    none = sitemaps.walk_sitemaps(robots.limit(0), documents)
    assert none[0].count() == none[1].count() == 0
