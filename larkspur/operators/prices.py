"""Prices of shop pages: structured data, then meta elements, then what the page shows.

A page is cut at its tags; each element whose class, id or property speaks of a price becomes a row with its text and what stands
before and after it in its own block, cut in the page's own task. The rows are judged and sorted into kinds by plain expressions,
and one aggregate by page takes the first of each kind. A threshold of free delivery isn't a price, wherever its words stand:
in the element, before it in its block, or, for the words that close a threshold, right after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import money, text, web
from larkspur.shared import tasks, written
from larkspur.sources.star import OFFERS_SQL, latest_offers

# Elements that show prices, in the order in which they count, and the words of their attributes.
ELEMENTS = ("span", "div", "p", "ins", "del", "bdi")
PRICE_CLASS = r"price|ar\b|osszeg|amount|cost"
BLOCKS = "div|p|li|ul|ol|dl|dt|dd|td|th|tr|table|section|article|header|footer|nav|aside|main|form|figure|blockquote|h[1-6]|br|hr"
NUMBER = r"\d[\d\s\x{a0}\x{202f}.,]{1,14}"
PRICE = rf"(?i)({NUMBER})\s*(?:Ft|HUF|forint)\b"
# Fixed values, of normalized text: words around a number that is no price, and those that close a threshold.
FRAME = "ingyen|dijmentes|szallitas|kiszallitas|utanvet|csomagolas|kosar|kupon|utalvany"
LEAST = r"\bminimum\b|\bmin\.\s"
THRESHOLD = r"\bfelett\b|\bfeletti\b|\bfolott\b|\bfolotti\b|\btol\b"
# Kinds of prices by the words of the attributes and the text; the first that fits counts.
KINDS = [
    ("deposit", r"(?i)\b(betetdij|visszavalt(?:asi)?|uveg\s*betet|deposit)\b"),
    ("unit", r"(?i)\b(egysegar|egyseg\s*ar|/\s*l\b|/\s*liter|ft\s*/\s*l)\b"),
    ("member", r"(?i)\b(klub|club|tag(?:i|sagi)?|member|torzsvasarlo|hus[eé]g)\b"),
    ("coupon", r"(?i)\b(kupon|coupon|kod(?:dal)?|promo\s*kod|voucher)\b"),
    ("quantity", r"(?i)\b(\d+\s*db\s*felett|mennyisegi|nagyker|karton\s*ar|bulk)\b"),
    ("regular", r"(?i)\b(del|regi|eredeti|old-price|regular-price|list-price|compare-at|strike|athuzott)\b"),
]
META_KEYS = ("product:price:amount", "og:price:amount", "price")
#: Length of texts: of an element at most, looked at before and after it, and of what is kept of that.
LONGEST, AROUND, BEFORE, AFTER = 220, 600, 120, 40
#: Of a page's plain text: the least price, and what is looked at before and after it.
LEAST_PLAIN, PLAIN_BEFORE, PLAIN_AFTER = 200, 60, 24


def _strip(html: Column) -> Column:
    """Text without tags, blanks joined; entities stay."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"[\s\x{a0}]+", " "))


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*["']([^"']*)["']""", 1)


def _norm(shown: Column) -> Column:
    """The normal form of words in a text: without diacritics, lower case, other characters as single blanks."""
    return F.regexp_replace(F.lower(text.deaccent(shown)), "[^a-z0-9%.,]+", " ")


def page_marks(parts: Column) -> tuple[Column, Column]:
    """Of a page cut at its tags: structs (i, t) of the tags that may open a price, and structs (i, tag) of all closing ones."""
    at = lambda keep: F.filter(F.transform(parts, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: keep(x.t))
    opening = at(lambda t: t.rlike(rf"(?i)^<({'|'.join(ELEMENTS)})\b[^>]*>$") & _named(t).rlike(PRICE_CLASS))
    closing = F.transform(at(lambda t: F.lower(t).rlike(r"^</[a-z]+\s*>$")), lambda x: F.struct(x.i.alias("i"), F.regexp_extract(F.lower(x.t), "^</([a-z]+)", 1).alias("tag")))
    return opening, closing


def _named(tag: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[_attribute(tag, a) for a in ("class", "id", "itemprop", "data-price-type")]))


def price_elements(pages: DataFrame) -> DataFrame:
    """pages with place, tag, classes, inner, before and after of each element that may show a price, of the column html.

    A page is cut once. What is looked at around an element is made of the parts next to it: each part has a character at least.
    """
    c, kept = F.col, [x for x in pages.columns if x != "html"]
    cut = _once(pages, parts=F.split("html", r"(?=<)|(?<=>)"))
    opening, closing = page_marks(c("parts"))
    cut = _once(cut.select(*kept, "parts", opening.alias("opening"), closing.alias("closing"))).where(F.size("opening") > 0)
    found = cut.select(*kept, "parts", "closing", F.explode("opening").alias("x"))
    found = _once(found.select(*kept, "parts", "closing", c("x.i").alias("place"), c("x.t").alias("t")), tag=F.lower(F.regexp_extract("t", "^<([A-Za-z]+)", 1)))
    end = F.coalesce(F.get(F.filter("closing", lambda k: (k.i > c("place")) & (k.tag == c("tag"))), F.lit(0)).i, F.size("parts"))
    found = _once(found, end=end)
    joined = lambda start, n: F.array_join(F.slice("parts", start, n), "")
    first = F.greatest(c("place") - AROUND, F.lit(0))
    before, after = F.right(joined(first + 1, c("place") - first), F.lit(AROUND)), F.left(joined(c("end") + 2, F.lit(AROUND)), F.lit(AROUND))
    return found.select(
        *kept, "place", "tag", _named(c("t")).alias("classes"), joined(c("place") + 2, c("end") - c("place") - 1).alias("inner"),
        F.regexp_replace(before, rf"(?is)^.*</?(?:{BLOCKS})\b[^>]*>", "").alias("before"), F.regexp_extract(after, rf"(?is)^(.*?)(?:</?(?:{BLOCKS})\b[^>]*>|\z)", 1).alias("after"),
    )


def first_price(shown: Column) -> Column:
    """The first price of a text in whole units; null if there is none above zero."""
    found = F.floor(money.parse_money(F.regexp_extract(shown, PRICE, 1)) + 0.5).cast("bigint")
    return F.when(shown.rlike(PRICE) & (found > 0), found)


def plain_price(html: Column) -> Column:
    """struct(value, raw) of the first price in a page's plain text whose sentence before it and text behind it aren't a threshold's."""
    shown = _strip(html)
    parts, found = F.split(shown, PRICE), F.regexp_extract_all(shown, F.lit(PRICE), F.lit(0))
    upto = lambda k: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), k), lambda j: F.array(F.get(parts, j), F.when(j < k, F.get(found, j)).otherwise("")))), "")
    behind = lambda k: F.array_join(F.flatten(F.transform(F.sequence(k + 1, F.size(parts) - 1), lambda j: F.array(F.get(parts, j), F.coalesce(F.get(found, j), F.lit(""))))), "")
    every = F.transform(found, lambda raw, k: F.struct(
        F.floor(money.parse_money(F.regexp_extract(raw, PRICE, 1)) + 0.5).cast("bigint").alias("value"), raw.alias("raw"),
        F.concat_ws(" ", F.element_at(F.split(F.right(upto(k), F.lit(PLAIN_BEFORE)), "[.!?|]"), -1), F.left(behind(k), F.lit(PLAIN_AFTER))).alias("around"),
    ))
    kept = F.filter(every, lambda x: (x.value >= LEAST_PLAIN) & ~_norm(x.around).rlike(f"{FRAME}|{THRESHOLD}|{LEAST}"))
    return F.when(F.size(found) > 0, F.get(kept, F.lit(0)))


def structured_price(html: Column) -> Column:
    """struct(price, list_price) of the page's first JSON-LD product: its first offer's price, and the list price of a specification."""
    scripts = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1), lambda s: s.rlike(r'"@type"\s*:\s*(\[[^\]]*)?"Product"'))
    one = F.get(scripts, F.lit(0))
    offer = lambda path: F.coalesce(F.get_json_object(one, f"$.offers{path}"), F.get_json_object(one, f"$.offers[0]{path}"), F.get_json_object(one, f"$[0].offers{path}"))
    price = offer(".price").try_cast("double")
    listed = F.when(F.lower(offer(".priceSpecification.priceType")).rlike("listprice|strikethrough"), offer(".priceSpecification.price").try_cast("double"))
    return F.struct(F.when(price > 0, F.floor(price + 0.5).cast("bigint")).alias("price"), F.when(listed > 0, F.floor(listed + 0.5).cast("bigint")).alias("list_price"))


def meta_price(html: Column) -> Column:
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<meta\s[^>]*>)"), 1), lambda t: F.lower(F.concat(*[_attribute(t, a) for a in ("property", "name", "itemprop")])).isin(*META_KEYS) & (_attribute(t, "content") != ""))
    found = money.parse_money(_attribute(F.get(tags, F.lit(0)), "content"))
    return F.when(found > 0, F.floor(found + 0.5).cast("bigint"))


def _pair(html: Column, tag: str) -> Column:
    return first_price(F.array_join(F.transform(web.blocks(html, tag), _strip), " "))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are made once for each row: behind a generator nothing that reads them is written out again in their place."""
    made = df.select(F.explode(F.array(F.struct("*", *[c.alias(n) for n, c in columns.items()]))).alias("_made"))
    return made.select("_made.*")


def extract_prices(pages: DataFrame, *, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, current, method (jsonld, meta or dom), regular, member, coupon, quantity, unit, unit_basis, deposit, mismatch.

    The current price is the structured one, else the meta element's, else the first shown price of no other kind; with both an
    `ins` and a `del` element, theirs are the current and the regular one. A page without price elements may have one in its plain
    text. mismatch: a structured or meta price is more than 2 % and 50 away from the shown one. Rows of one page_id are one
    page; null pages have no prices. Columns other than these are left out.
    """
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    # texts are read once, however many pages have them; their numbers are in the order of the texts
    texts = written(rows.select("html").distinct().orderBy("html").withColumn("text_id", F.monotonically_increasing_id()), "texts")
    read = texts.repartition(tasks(pages.sparkSession), "text_id")
    found = price_elements(read)
    found = _once(found, shown=_strip(F.col("inner"))).where((F.length("shown") <= LONGEST) & F.col("shown").rlike(PRICE))
    found = _once(found, digits=F.regexp_extract("shown", PRICE, 1))
    before = F.right(F.regexp_replace(_strip(F.col("before")), rf"(?is)^.*{NUMBER}\s*(?:Ft|HUF|forint)\b", ""), F.lit(BEFORE))
    own, ahead, behind = (_norm(x) for x in (F.concat_ws(" ", "classes", "shown"), before, F.left(_strip(F.col("after")), F.lit(AFTER))))
    found = _once(found, value=F.floor(money.parse_money(F.col("digits")) + 0.5).cast("bigint"), own=own, ahead=ahead, behind=behind)
    found = found.where((F.col("value") > 0) & ~F.col("own").rlike(f"{FRAME}|{THRESHOLD}|{LEAST}") & ~F.col("ahead").rlike(f"{FRAME}|{LEAST}") & ~F.col("behind").rlike(THRESHOLD))
    context, kind = F.concat_ws(" ", "classes", "shown"), F.lit("current")
    for name, pattern in reversed(KINDS):
        kind = F.when(context.rlike(pattern), name).otherwise(kind)
    order = F.struct(F.array_position(F.array(*map(F.lit, ELEMENTS)), F.col("tag")).alias("t"), "place").alias("order")
    judged = _once(found, kind=kind).select("text_id", "kind", order, "value", F.when(context.rlike(r"(?i)/\s*l\b|liter"), "liter").otherwise("piece").alias("basis"))
    first = lambda k: F.min(F.when(F.col("kind") == k, F.struct("order", "value", "basis"))).alias(k)
    kinds = ("current", "member", "coupon", "quantity", "unit", "deposit")
    shown = judged.groupBy("text_id").agg(*[first(k) for k in kinds], F.max(F.when(F.col("kind") == "regular", F.col("value"))).alias("regular"), F.lit(True).alias("has_elements"))
    c = F.col
    ins, deleted = web.blocks(c("html"), "ins"), web.blocks(c("html"), "del")
    pair = (F.size(ins) > 0) & (F.size(deleted) > 0)
    one = read.join(shown, "text_id", "left").select(
        "text_id", *kinds, "regular", "has_elements", F.when(pair, _pair(c("html"), "ins")).alias("ins"), F.when(pair, _pair(c("html"), "del")).alias("del"),
        F.when(c("has_elements").isNull(), plain_price(c("html")).value).alias("plain"), structured_price(c("html")).alias("s"), meta_price(c("html")).alias("m"),
    )
    own = rows.join(texts, "html").select("page_id", "text_id").join(written(one, "prices"), "text_id")
    own = own.groupBy("page_id").agg(*[F.min(k).alias(k) for k in kinds], F.max("regular").alias("regular"), F.max("has_elements").alias("has_elements"), F.min(F.struct("text_id", "ins", "del", "plain", "s", "m")).alias("f"))
    both = own.select("page_id", *kinds, "f.s", "f.m", F.when(c("has_elements"), F.coalesce("f.ins", "current.value")).otherwise(c("f.plain")).alias("dom"), F.coalesce(F.when(c("has_elements"), c("f.del")), c("regular")).alias("dom_regular"))
    current = F.coalesce("s.price", "m", "dom")
    method = F.when(c("s.price").isNotNull(), "jsonld").when(c("m").isNotNull(), "meta").when(c("dom").isNotNull(), "dom")
    far = F.abs(c("dom") - current) > F.greatest(F.lit(50.0), current * 0.02)
    return both.select(
        "page_id", current.alias("current"), method.alias("method"), F.coalesce("s.list_price", "dom_regular").alias("regular"), *[c(f"{k}.value").alias(k) for k in ("member", "coupon", "quantity", "unit", "deposit")],
        c("unit.basis").alias("unit_basis"), F.coalesce((method != "dom") & far, F.lit(False)).alias("mismatch"),
    )


def price_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of each listing's latest offer, as shops of ten kinds show it: variant_id, shop_id, page_id, html."""
    s, k, p, r = (F.col(c) for c in ("shop_id", "variant_id", "price", "regular"))
    shown = lambda x: F.replace(F.format_number(x, 0), F.lit(","), F.lit(" "))
    dots = lambda x: F.replace(F.format_number(x, 0), F.lit(","), F.lit("."))
    banner = F.lit('<div class="top">Ingyenes szállítás <b class="price">15 000 Ft</b> felett</div><p>Kiszállítás <span class="price">1 490 Ft</span></p>')
    span = lambda x, c="price": F.concat(F.lit(f'<span class="{c}">'), x, F.lit(" Ft</span>"))
    body = (
        F.when(s % 10 == 0, span(shown(p)))
        .when(s % 10 == 1, F.concat(banner, F.lit('<div id="price">'), dots(p), F.lit(" HUF</div>")))
        .when(s % 10 == 2, F.concat(F.lit('<p class="price"><del>'), shown(r), F.lit(" Ft</del><ins>"), shown(p), F.lit(" Ft</ins></p>")))
        .when(s % 10 == 3, F.concat(F.lit('<script type="application/ld+json">{"@type":"Product","offers":[{"@type":"Offer","price":"'), p, F.lit('"}]}</script>'), span(shown(F.when(k % 5 == 0, p + 5000).otherwise(p)))))
        .when(s % 10 == 4, F.concat(F.lit('<meta property="product:price:amount" content="'), p, F.lit('">'), banner))
        .when(s % 10 == 5, F.concat(F.lit('<div class="price">Klub ár: '), shown(p - 10), F.lit(" Ft</div>"), span(shown(p)), F.lit('<p class="unit-price">egysegar '), shown(p + 500), F.lit(" Ft / liter</p>")))
        .when(s % 10 == 6, banner)
        .when(s % 10 == 7, F.concat(F.lit("<td>Ingyenes szállítás 15 000 Ft felett!</td><td>Bruttó "), shown(p + 200), F.lit(" Ft</td>")))
        .when(s % 10 == 8, F.concat(F.lit('<p class="price">deposit 70 Ft</p><p class="price">coupon: '), shown(p - 5), F.lit(" Ft</p>"), span(shown(p))))
        .otherwise(F.concat(span(shown(r), "old-price"), F.lit("<div>"), span(F.lit("20 000")), F.lit(" felett ajándék</div>"), span(shown(p)), span(shown(r + 100), "regular-price")))
    )
    rows = latest_offers(spark, sf_dir).where("price > 1000")
    return rows.select("variant_id", "shop_id", F.concat_ws("-", k, s).alias("page_id"), F.concat(F.lit("<html><head><title>Bor 2 000 Ft</title></head><body>"), body, F.lit("</body></html>")).alias("html"))


def page_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_prices(price_pages(spark, sf_dir))


QUERIES = {"page_prices": page_prices}
#: What each kind of shop means, from the offers alone.
ORACLES = {"page_prices": f"""WITH {OFFERS_SQL},
o AS (SELECT *, shop_id % 10 AS kind FROM latest WHERE price > 1000)
SELECT variant_id || '-' || shop_id AS page_id,
  CASE WHEN kind = 6 THEN NULL WHEN kind = 7 THEN price + 200 ELSE price END AS current,
  CASE kind WHEN 3 THEN 'jsonld' WHEN 4 THEN 'meta' WHEN 6 THEN NULL ELSE 'dom' END AS method,
  CASE kind WHEN 2 THEN regular WHEN 9 THEN regular + 100 END AS regular, CASE WHEN kind = 5 THEN price - 10 END AS member,
  CASE WHEN kind = 8 THEN price - 5 END AS coupon, CAST(NULL AS BIGINT) AS quantity, CASE WHEN kind = 5 THEN price + 500 END AS unit,
  CASE WHEN kind = 8 THEN 70 END AS deposit, CASE WHEN kind = 5 THEN 'liter' END AS unit_basis,
  kind = 3 AND variant_id % 5 = 0 AND 5000 > price * 0.02 AS mismatch
FROM o"""}
