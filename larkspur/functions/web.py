"""Pages, URLs and crawl rules as column expressions: tags, links, structured data, robots rules and page verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import deaccent, decode_entities

# Path segments that name a product or an archive, and parts of URLs that are neither.
PRODUCT_SEGMENTS = ["termek", "termekek", "product", "products", "item", "bolt-termek"]
ARCHIVE_SEGMENTS = [
    "termekcimke", "termek-cimke", "product-tag", "tag", "tags", "cimke", "cimkek", "termekkategoria", "termek-kategoria", "product-category", "product-cat",
    "kategoria", "kategoriak", "category", "categories", "szerzo", "author", "page", "oldal", "lapozo", "magazin", "magazine", "karrier", "career", "careers", "allas", "allasok", "jobs",
]
OTHER_PARTS = [
    "/blog/", "/hir", "/news", "/cikk", "/kosar", "/cart", "/checkout", "/fiok", "/account", "/login", "/regisztr", "/kapcsolat", "/contact", "/adatvedelem", "/aszf",
    "/szallitas", "/rolunk", "/about", "/gyik", "/faq", ".jpg", ".png", ".pdf", "/wp-content/", "/wp-json/",
]
# What an availability URL of structured data contains, and its state; the first that fits counts.
AVAILABILITY = [("instock", "in_stock"), ("limitedavailability", "in_stock"), ("outofstock", "out_of_stock"), ("soldout", "out_of_stock"), ("preorder", "preorder"), ("backorder", "backorder"), ("discontinued", "discontinued")]
# Signs of pages that aren't what was asked for, in the order in which they are tried: verdict, where the sign counts, and
# its pattern, without accents. `any`: on every page; `shell`: on pages without content; `gate`: there, if no product is named either.
SIGNS = [
    ("challenge", "any", r"cf-browser-verification|cf_chl_|challenge-platform|__cf_chl"), ("challenge", "any", r"<title>[^<]*just a moment[^<]*</title>"),
    ("challenge", "any", r"attention required!?\s*\|\s*cloudflare"), ("challenge", "any", r"_incap_ses_|incapsula incident id"),
    ("challenge", "any", r"<title>[^<]*(?:access denied|hozzaferes megtagadva)[^<]*</title>"),
    ("challenge", "shell", r"g-recaptcha|grecaptcha|h-captcha|hcaptcha|cf-turnstile"), ("challenge", "shell", r"\bcaptcha\b"),
    ("age_gate", "gate", r"elmultam\s*18|betoltotted\s*a\s*18"), ("age_gate", "gate", r"are you (?:over|at least)\s*(?:18|21)|age\s*verification|age[- ]gate"),
    ("age_gate", "gate", r"eletkor.{0,20}ellenorz"),
    ("login_required", "gate", r"<form[^>]*(?:login|bejelentkez|signin)"), ("login_required", "gate", r"kerjuk,?\s*jelentkezzen\s*be|please\s*(?:log\s*in|sign\s*in)\s*to\s*(?:view|see)"),
    ("soft_404", "any", r"a\s*keresett\s*oldal\s*nem\s*talalhato|nem\s*talalhato\s*a\s*termek"), ("soft_404", "any", r"\b404\b.{0,40}(?:not found|nem talalhato)"),
    ("soft_404", "any", r"page\s*not\s*found|product\s*(?:not\s*found|no\s*longer\s*available)"), ("soft_404", "any", r"<title>[^<]*(?:404|nem talalhato|not found)[^<]*</title>"),
]
FIRST_SOFT = next(p for v, _, p in SIGNS if v == "soft_404")
# A page with less visible text than this, and without structured data, is a shell; what counts as such data and as a product.
SHELL = 400
STRUCTURED = r'(?i)"@type"\s*:\s*"(?:Product|ItemList|WebSite|Organization)"|__NEXT_DATA__|window\.__NUXT__'
PRODUCT_SIGNAL = r'(?i)"@type"\s*:\s*"Product"|itemtype="[^"]*schema\.org/Product'


def strip_tags(html: Column) -> Column:
    """The text of a fragment: scripts and styles go, tags become blanks, entities are decoded, blanks joined."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(bare, "<[^>]*>", " ")), r"\s+", " "))


def blocks(html: Column, tag: str) -> Column:
    """What stands inside each element of that name, where elements aren't nested in themselves."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), 1)


def title(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title>", 1)
    return F.when(html.rlike(r"(?is)<title(?:\s[^>]*)?>.*?</title>"), strip_tags(found))


def attribute(tag: Column, name: str) -> Column:
    """An attribute of an opening tag, with either kind of quotes; null where it is missing or empty."""
    return F.nullif(decode_entities(F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*["']([^"']*)["']""", 1)), F.lit(""))


def links(html: Column) -> Column:
    """Targets of all links, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']+)["']"""), 1)


def meta(html: Column, key: str) -> Column:
    """Content of the first meta element whose name or property is key."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\s[^>]*>)"), 1)
    own = F.filter(tags, lambda t: F.lower(F.coalesce(attribute(t, "property"), attribute(t, "name"))) == key)
    return attribute(F.get(own, 0), "content")


def canonical_link(html: Column) -> Column:
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<link\s[^>]*>)"), 1)
    return attribute(F.get(F.filter(tags, lambda t: F.lower(attribute(t, "rel")) == "canonical"), 0), "href")


def breadcrumb(html: Column) -> Column:
    """Texts of the links in navigation blocks that are called breadcrumb, else of the items of such lists."""
    nav = F.regexp_extract_all(html, F.lit(r"""(?is)<nav\s[^>]*(?:class|id)\s*=\s*["'][^"']*breadcrumb[^"']*["'][^>]*>(.*?)</nav>"""), 1)
    ol = F.regexp_extract_all(html, F.lit(r"""(?is)<ol\s[^>]*class\s*=\s*["'][^"']*breadcrumb[^"']*["'][^>]*>(.*?)</ol>"""), 1)
    text = lambda found, tag: F.filter(F.transform(F.flatten(F.transform(found, lambda b: blocks(b, tag))), strip_tags), lambda t: t != "")
    by_nav = text(nav, "a")
    return F.when(F.size(by_nav) > 0, by_nav).otherwise(text(ol, "li"))


def spec_table(html: Column) -> Column:
    """A map of the first two cells of each table row, and of definition lists; keys lose their colon, the last value stays."""
    rows = F.flatten(F.transform(blocks(html, "table"), lambda t: blocks(t, "tr")))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd](?:\s[^>]*)?>(.*?)</t[hd]>"), 1), strip_tags))
    table = F.transform(cells, lambda c: F.struct(F.trim(F.regexp_replace(F.get(c, 0), ":$", "")).alias("k"), F.get(c, 1).alias("v")))
    pairs = F.flatten(F.transform(blocks(html, "dl"), lambda d: F.arrays_zip(F.transform(blocks(d, "dt"), strip_tags).alias("k"), F.transform(blocks(d, "dd"), strip_tags).alias("v"))))
    listed = F.transform(pairs, lambda p: F.struct(F.trim(F.regexp_replace(p["k"], ":$", "")).alias("k"), p["v"].alias("v")))
    good = F.filter(F.concat(table, listed), lambda p: (F.coalesce(p["k"], F.lit("")) != "") & (F.coalesce(p["v"], F.lit("")) != "") & (F.length(p["k"]) <= 60))
    return F.aggregate(good, F.create_map().cast("map<string,string>"), lambda acc, p: F.map_concat(F.map_filter(acc, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))


#: A product of structured data, as far as it is read.
PRODUCT = "struct<`@type`:string,name:string,sku:string,gtin13:string,offers:struct<`@type`:string,price:string,priceCurrency:string,availability:string>>"


def products(html: Column) -> Column:
    """Products of the page's JSON-LD blocks: single objects and members of `@graph`. Broken blocks are passed over."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1)
    options = {"mode": "PERMISSIVE"}
    one = F.transform(found, lambda b: F.from_json(b, PRODUCT, options))
    graph = F.flatten(F.transform(found, lambda b: F.coalesce(F.from_json(b, f"struct<`@graph`:array<{PRODUCT}>>", options)["@graph"], F.array().cast(f"array<{PRODUCT}>"))))
    return F.filter(F.concat(one, graph), lambda p: F.lower(p["@type"]) == "product")


def availability(url: Column) -> Column:
    """struct(status, in_stock) of a schema.org availability."""
    status = F.lit("unknown")
    for part, state in reversed(AVAILABILITY):
        status = F.when(F.contains(F.lower(url), F.lit(part)), state).otherwise(status)
    return F.struct(status.alias("status"), F.when(status == "in_stock", True).when(status != "unknown", False).alias("in_stock"))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def is_product_url(url: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """A shop's exclude patterns, then its include patterns, then product, archive and other parts of the path decide."""
    low = F.lower(url)
    segments = F.split(F.lower(path(url)), "/")
    has = lambda names: F.arrays_overlap(segments, F.array(*map(F.lit, names)))
    other = F.lit(False)
    for p in OTHER_PARTS:
        other = other | F.contains(low, F.lit(p))
    out = F.when(has(PRODUCT_SEGMENTS), True).when(has(ARCHIVE_SEGMENTS), False).otherwise(~other)
    if include:
        out = low.rlike("(?i)" + "|".join(f"(?:{p})" for p in include))
    return F.when(low.rlike("(?i)" + "|".join(f"(?:{p})" for p in exclude)), False).otherwise(out) if exclude else out


def robots_pattern(rule: str) -> str:
    """A robots rule as a pattern: `*` is anything, a closing `$` the end."""
    import re

    end = rule.endswith("$")
    return "^" + ".*".join(re.escape(x) for x in (rule[:-1] if end else rule).split("*")) + ("$" if end else "")


def robots_rules(text: str, agent: str) -> list[tuple[bool, str]]:
    """(allow, rule) of the group that names the agent most specifically; groups of `*` come last."""
    groups, names, open_ = {}, [], False
    for line in text.splitlines():
        field, _, value = (x.strip() for x in line.split("#")[0].partition(":"))
        if field.lower() == "user-agent":
            names = [*names, value.lower()] if open_ else [value.lower()]
            open_ = True
            groups.setdefault(value.lower(), [])
        elif field:
            open_ = False
            if field.lower() in ("allow", "disallow") and value:
                for n in names:
                    groups[n].append((field.lower() == "allow", value))
    fits = [n for n in groups if n != "*" and n in agent.lower()] or [n for n in groups if n == "*"]
    return groups[max(fits, key=len)] if fits else []


def robots_allow(url_path: Column, rules: list[tuple[bool, str]]) -> Column:
    """Whether the longest fitting rule allows the path; Allow wins ties, no rule allows."""
    out = F.lit(True)
    for allow, rule in sorted(rules, key=lambda r: (len(r[1]), r[0])):
        out = F.when(url_path.rlike(robots_pattern(rule)), allow).otherwise(out)
    return out


def visible_length(html: Column) -> Column:
    """Characters of a page's text: scripts and styles go, tags are blanks, blanks are joined; entities stay as they are."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", "")
    return F.length(F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"\s+", " ")))


def verdicts(pages: DataFrame, *, status: str = "status", html: str = "html", content_type: str | None = None) -> DataFrame:
    """pages with verdict: rate_limited, challenge, age_gate, login_required, soft_404, empty_shell or ok; and gone.

    429 is rate_limited; 401, 403 and 5xx are challenges. What is neither HTML by its type nor begins with `<` is ok otherwise. A login
    form, an age question or a captcha counts on a shell only, the first two only if no product is named: most shop pages have such a
    form. 404 counts as soft_404 unless a sign before it is met. Whole pages are searched. gone: soft_404, or 410 without
    a sign of another kind; codes that aren't known are no evidence. Null pages are empty, a null status says nothing.
    """
    code, body = F.coalesce(F.col(f"`{status}`"), F.lit(0)), F.coalesce(F.col(f"`{html}`"), F.lit(""))
    typed = F.contains(F.coalesce(F.col(f"`{content_type}`"), F.lit("")), F.lit("html")) if content_type else F.lit(False)
    rows = pages.drop("verdict", "gone").withColumns({"_code": code, "_html": typed | F.ltrim(body).startswith("<"), "_plain": F.lower(deaccent(body)), "_product": body.rlike(PRODUCT_SIGNAL), "_shell": (visible_length(body) < SHELL) & ~body.rlike(STRUCTURED)})
    where = {"any": F.lit(True), "shell": F.col("_shell"), "gate": F.col("_shell") & ~F.col("_product")}
    out = F.when(F.col("_shell"), "empty_shell").otherwise("ok")
    for name, kind, pattern in reversed(SIGNS):
        out = F.when(where[kind] & F.col("_plain").rlike(pattern), name).otherwise(out)
        if pattern == FIRST_SOFT:
            out = F.when(F.col("_code") == 404, "soft_404").otherwise(out)
    out = F.when(F.col("_code") == 429, "rate_limited").when(F.col("_code").isin(401, 403) | (F.col("_code") >= 500), "challenge").when(~F.col("_html"), "ok").otherwise(out)
    judged = rows.withColumn("verdict", out).drop("_html", "_plain", "_product", "_shell")
    gone = (F.col("verdict") == "soft_404") | ((F.col("_code") == 410) & F.col("verdict").isin("ok", "empty_shell"))
    return judged.withColumn("gone", gone).drop("_code")
